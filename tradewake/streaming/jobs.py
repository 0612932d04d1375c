"""The streaming jobs: topic in, keyed table or topic out.

Each function takes source frames (``value``, ``timestamp``, ``offset``) from
:mod:`tradewake.sources.topics` and returns a started query. Offsets and state are
in the job's checkpoint, and every sink write is keyed by the batch id, so a
restarted or retried batch repeats nothing and loses nothing.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery, StreamingQueryListener

from tradewake import config, schemas
from tradewake.config import JobPaths
from tradewake.functions import values
from tradewake.operators import alerts, changes, ingest, joins, metrics
from tradewake.sources import tables
from tradewake.sources.launch_store import launch_store
from tradewake.sources.sale_records import Kept, SaleRecords
from tradewake.sources.topics import Sink


def _start(writer: DataStreamWriter, checkpoint: str, once: bool) -> StreamingQuery:
    """Start with a 5 second trigger, or work off what is there and stop."""
    timed = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=config.TRIGGER)
    return timed.option("checkpointLocation", checkpoint).start()


def _per_batch(rows: DataFrame, write: Callable[[DataFrame, int, str], None], name: str) -> DataStreamWriter:
    """Writer that hands each batch, its number and the query's id to ``write``.

    The id lives in the checkpoint. A job that restarts from it writes on where it
    stopped; one with a fresh checkpoint counts its batches anew under another id.

    Spark turns adaptive execution off in the session of a stateful stream, where
    the number of state partitions is fixed. What is done with the result of a
    batch is batch work again, and its joins and files need it: so it is on for
    the time of the call.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        conf = batch.sparkSession.conf
        before = conf.get("spark.sql.adaptive.enabled")
        conf.set("spark.sql.adaptive.enabled", "true")
        try:
            query = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
            write(batch, batch_id, query)
        finally:
            conf.set("spark.sql.adaptive.enabled", before)

    return rows.writeStream.queryName(name).outputMode("append").foreachBatch(run)


def flagged_launches(source: DataFrame) -> DataFrame:
    return ingest.decode_logs(source, schemas.LAUNCH, ["mid", "ts"])


def decoded_launches(source: DataFrame) -> DataFrame:
    return ingest.accepted(flagged_launches(source))


def flagged_events(source: DataFrame) -> DataFrame:
    return ingest.decode_logs(source, schemas.EVENT, ["ts"])


def flagged_orders(source: DataFrame) -> DataFrame:
    return ingest.prepare_orders(ingest.decode(source, schemas.ORDER, ["id"]))


def flagged_lines(source: DataFrame) -> DataFrame:
    return ingest.prepare_lines(ingest.decode(source, schemas.ORDER_LINE, ["id", "order_id"]))


def flagged_users(source: DataFrame) -> DataFrame:
    return ingest.decode(source, schemas.USER, ["id"])


def flagged_changes(source: DataFrame) -> DataFrame:
    """Change records; what is no JSON object of their form has a ``problem``."""
    wire = schemas.CHANGE.fieldNames()
    parsed = source.select("*", values.once(F.from_json("value", schemas.CHANGE)).alias("c"))
    bad = F.col("c").isNull() | F.coalesce(*[F.col(f"c.{n}").cast("string") for n in wire]).isNull()
    return parsed.select("c.*", F.when(bad, F.lit("malformed")).alias(ingest.PROBLEM), "value")


def launch_job(source: DataFrame, paths: JobPaths, once: bool = False) -> StreamingQuery:
    """First launch per device and day into the launch store.

    No state and no watermark: a batch is compared with what is stored for its own days,
    so a launch is kept however late it comes.
    """
    decoded = metrics.observed(decoded_launches(source), "launches")
    store = launch_store(paths.tables).create(source.sparkSession)

    def write(batch: DataFrame, batch_id: int, query: str) -> None:
        store.add(batch, batch_id, query)

    return _start(_per_batch(decoded, write, "launches"), paths.checkpoint("launches"), once)


def order_job(source: DataFrame, paths: JobPaths, once: bool = False) -> StreamingQuery:
    """Orders with masked phone into the order table; the latest record of an id wins."""
    good = metrics.observed(ingest.accepted(flagged_orders(source)), "orders")
    store = tables.order_table(paths.tables).create(source.sparkSession)

    def write(batch: DataFrame, batch_id: int, query: str) -> None:
        store.upsert(tables.upper_case(batch), batch_id, ["TIMESTAMP", "OFFSET"], query)

    return _start(_per_batch(good, write, "orders"), paths.checkpoint("orders"), once)


def user_job(source: DataFrame, paths: JobPaths, once: bool = False) -> StreamingQuery:
    """The latest record of every user into the user table."""
    good = ingest.accepted(flagged_users(source))
    store = tables.user_table(paths.tables).create(source.sparkSession)

    def write(batch: DataFrame, batch_id: int, query: str) -> None:
        store.upsert(batch, batch_id, ["timestamp", "offset"], query)

    return _start(_per_batch(good, write, "users"), paths.checkpoint("users"), once)


def sale_records(order_source: DataFrame, line_source: DataFrame) -> DataFrame:
    """Orders and lines of the two streams as one, with their source time ``at``."""
    orders = ingest.accepted(flagged_orders(order_source))
    lines = ingest.accepted(flagged_lines(line_source))
    at = F.col("timestamp").alias("at")
    order = F.struct("id", "order_status", "create_time", "user_id", "create_date").alias("order")
    line = F.struct("id", "order_id", "sku_id", "sku_price", "sku_name").alias("line")
    o = orders.select(at, F.lit(True).alias("is_order"), order)
    l = lines.select(at, F.lit(False).alias("is_order"), line)
    return o.unionByName(l, allowMissingColumns=True)


def matched_sales(kept: Kept, before_seconds: int, after_seconds: int) -> DataFrame:
    """Lines with their orders that a batch adds, joined on source time.

    A line whose order can no longer come has a null order.
    """
    joined = joins.late_join_stream(kept.lines, kept.orders, before_seconds, after_seconds, kept.since, kept.until)
    # The order's time tells which of two records of one order is the later.
    line = F.when(F.col("order").isNull(), F.struct("id", "sku_id", "sku_name", "line_at"))
    sales = joins.merge_sale(joined, F.col("order.order_at"), line.alias("unmatched"), F.col("order_id").alias("line_of"))
    # Named by the line, the order is what the join was dealt by: the tables these rows go
    # to find their latest where they lie.
    return sales.withColumn("order_id", F.col("line_of")).drop("line_of")


def sale_job(
    order_source: DataFrame,
    line_source: DataFrame,
    paths: JobPaths,
    as_of: Column | None = None,
    once: bool = False,
    before_seconds: int = config.LINE_BEFORE_ORDER_SECONDS,
    after_seconds: int = config.LINE_AFTER_ORDER_SECONDS,
    delay: str = "10 seconds",
) -> StreamingQuery:
    """Sale details with the user as known when the batch runs, into the sale table.

    Lines that stay without an order go to the table of unmatched lines. ``as_of`` is the
    day ages are counted to, by default the current one. The records that may still meet
    are kept as files beside the checkpoint (see ``sources/sale_records.py``) and not in a
    state store, which would hold each of them three times.
    """
    spark = order_source.sparkSession
    arrived = metrics.observed(sale_records(order_source, line_source), "sale_records")
    records = SaleRecords(paths.checkpoint("sale_records"), before_seconds, after_seconds, delay)
    store = tables.sale_table(paths.tables).create(spark)
    users = tables.user_table(paths.tables).create(spark)
    expired = tables.unmatched_table(paths.tables).create(spark)
    today = as_of if as_of is not None else F.current_date()

    def write(batch: DataFrame, batch_id: int, query: str) -> None:
        kept = records.add(batch, batch_id, query)
        # Read for its size, its user ids and its rows.
        joined = matched_sales(kept, before_seconds, after_seconds).persist()
        try:
            if not joined.count():
                return
            lines = joined.where("unmatched is not null").select("order_id", "unmatched.*")
            day = F.date_format("line_at", "yyyy-MM-dd").alias("day")
            expired.upsert(lines.select("*", day), batch_id, ["line_at"], query)
            sales = joined.where("unmatched is null")
            # The size is known now: Spark broadcasts the ids if they are few, and only
            # the buckets that hold them are read.
            known = users.read(batch.sparkSession, wanted=joins.user_ids(sales))
            full = joins.with_users(sales, known, today)
            doc_id = values.sale_document_id(F.col("order_id"), F.col("order_detail_id"))
            store.upsert(full.withColumn("doc_id", doc_id), batch_id, ["order_at"], query)
        finally:
            joined.unpersist()

    return _start(_per_batch(arrived, write, "sales"), paths.checkpoint("sales"), once)


def alert_stream(
    source: DataFrame,
    window_seconds: int = config.ALERT_WINDOW_SECONDS,
    slide_seconds: int = config.ALERT_SLIDE_SECONDS,
    threshold: int = config.ALERT_ACCOUNTS,
    delay: str = "10 seconds",
) -> DataFrame:
    """Alerts of all closed windows.

    Events are first counted per slide and device, in tasks of their own for each
    account and item, and only these counts enter the sliding windows.
    """
    events = ingest.accepted(flagged_events(source))
    timed = events.withColumn("at", F.timestamp_millis("ts")).withWatermark("at", delay)
    return alerts.alerting(alerts.window_state(timed, window_seconds, slide_seconds), threshold)


def alert_job(source: DataFrame, paths: JobPaths, once: bool = False, **options) -> StreamingQuery:
    """Coupon alerts, one per device and minute, into the alert table."""
    found = metrics.observed(alert_stream(source, **options), "alerts")
    store = tables.alert_table(paths.tables).create(source.sparkSession)

    def write(batch: DataFrame, batch_id: int, query: str) -> None:
        store.upsert(alerts.alert_per_minute(batch), batch_id, ["ts"], query)

    return _start(_per_batch(found, write, "alerts"), paths.checkpoint("alerts"), once)


def stamped_logs(source: DataFrame, at_millis: Column | None = None) -> DataFrame:
    """Collected log lines with the receiving time, as ``topic``, ``value``, ``log_date``."""
    rows = ingest.accepted(ingest.stamp(source, at_millis))
    routed = ingest.route_logs(rows, config.TOPIC_LAUNCH, config.TOPIC_EVENT)
    return routed.select(
        "topic",
        F.col("line").alias("value"),
        F.date_format(F.timestamp_millis("ts"), "yyyy-MM-dd").alias("log_date"),
    )


def log_landing_job(
    source: DataFrame, paths: JobPaths, at_millis: Column | None = None, once: bool = False
) -> StreamingQuery:
    """Raw log lines to text files in a folder per batch and day."""

    def write(batch: DataFrame, batch_id: int, query: str) -> None:
        tables.write_raw_logs(batch, paths.raw_logs, batch_id, query)

    rows = stamped_logs(source, at_millis)
    return _start(_per_batch(rows, write, "raw_logs"), paths.checkpoint("raw_logs"), once)


def log_route_job(
    source: DataFrame, sink: Sink, paths: JobPaths, at_millis: Column | None = None, once: bool = False
) -> StreamingQuery:
    """Log lines to the launch topic or the event topic."""
    return _start(sink(stamped_logs(source, at_millis)), paths.checkpoint("log_routes"), once)


def routed_changes(source: DataFrame) -> DataFrame:
    """Change records given as JSON, as ``topic`` and ``value`` of each passed-on row."""
    return changes.after_images(changes.route_changes(ingest.accepted(flagged_changes(source))))


def change_route_job(source: DataFrame, sink: Sink, paths: JobPaths, once: bool = False) -> StreamingQuery:
    """Database changes to the topics of their tables."""
    return _start(sink(routed_changes(source)), paths.checkpoint("change_routes"), once)


# How each kind of record is told apart into good and bad ones. A job stores the good rows
# of this frame, the quarantine the bad ones, so a record is in exactly one of the two.
FLAGGED: dict[str, Callable[[DataFrame], DataFrame]] = {
    "launches": flagged_launches,
    "events": flagged_events,
    "orders": flagged_orders,
    "lines": flagged_lines,
    "users": flagged_users,
    "changes": flagged_changes,
    "logs": ingest.stamp,
}


def quarantine_job(source: DataFrame, name: str, paths: JobPaths, once: bool = False) -> StreamingQuery:
    """The records of a kind (see ``FLAGGED``) that its job cannot use, with the reason, as JSON."""
    bad = ingest.quarantined(FLAGGED[name](source))
    writer = bad.writeStream.queryName(f"bad_{name}").format("json").option("path", paths.table(f"quarantine/{name}"))
    return _start(writer, paths.checkpoint(f"bad_{name}"), once)


def late_rows(spark: SparkSession, query: StreamingQuery) -> DataFrame:
    """``operator, rows``: what each stateful operator dropped as later than its watermark.

    The counts are those of the query's progress reports, one row for each operator. An
    aggregation counts what it has combined, other operators count the rows themselves.
    """
    counts: dict[tuple[int, str], int] = {}
    for progress in query.recentProgress:
        for place, operator in enumerate(progress.stateOperators):
            key = (place, operator.operatorName)
            counts[key] = counts.get(key, 0) + operator.numRowsDroppedByWatermark
    rows = [(name, n) for (_, name), n in sorted(counts.items())]
    return spark.createDataFrame(rows, "operator string, rows long")


class StageCounts(StreamingQueryListener):
    """Prints the counts that :func:`metrics.observed` took, per query and batch.

    Rows that a stateful operator dropped as too late are printed as well.
    """

    def __init__(self, show: Callable[[str], None] = print):
        self._show = show

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        for stage, row in progress.observedMetrics.items():
            self._show(json.dumps({"query": progress.name, "batch": progress.batchId, "stage": stage, "rows": row.rows}))
        for operator in progress.stateOperators:
            if operator.numRowsDroppedByWatermark:
                late = {"late": operator.operatorName, "rows": operator.numRowsDroppedByWatermark}
                self._show(json.dumps({"query": progress.name, "batch": progress.batchId, **late}))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def start_all(
    spark: SparkSession,
    source: Callable[[str], DataFrame],
    paths: JobPaths,
    show: Callable[[str], None] = print,
    once: bool = False,
) -> list[StreamingQuery]:
    """All warehouse jobs on one session, each with the quarantine of its records.

    ``source`` gives the stream of a topic. With ``once``, the jobs stop at its end.
    """
    spark.streams.addListener(StageCounts(show))
    topics = {
        "launches": config.TOPIC_LAUNCH,
        "events": config.TOPIC_EVENT,
        "orders": config.TOPIC_ORDER,
        "lines": config.TOPIC_ORDER_LINE,
        "users": config.TOPIC_USER,
    }
    return [
        launch_job(source(config.TOPIC_LAUNCH), paths, once),
        order_job(source(config.TOPIC_ORDER), paths, once),
        user_job(source(config.TOPIC_USER), paths, once),
        alert_job(source(config.TOPIC_EVENT), paths, once),
        sale_job(source(config.TOPIC_ORDER), source(config.TOPIC_ORDER_LINE), paths, once=once),
        *[quarantine_job(source(topic), name, paths, once) for name, topic in topics.items()],
    ]


def compacted(spark: SparkSession, paths: JobPaths, into: str) -> JobPaths:
    """Merge every stored table into a fresh one below ``into``; jobs go on from there.

    To be called between runs of the jobs: their checkpoints stay, so their next batches
    are later than what is merged.
    """
    store = launch_store(paths.tables)
    kept = [store.launches, store.devices, store.counts]
    kept += [make(paths.tables) for make in (tables.order_table, tables.sale_table, tables.alert_table)]
    kept += [tables.user_table(paths.tables), tables.unmatched_table(paths.tables)]
    for table in kept:
        name = table.path.removeprefix(paths.tables).lstrip("/")
        table.create(spark).compact(spark, f"{into.rstrip('/')}/{name}")
    return JobPaths(into, paths.checkpoints, paths.raw_logs)


def start_collection(
    logs: DataFrame, changes_: DataFrame, sink: Callable[[DataFrame], DataStreamWriter], paths: JobPaths, once: bool = False
) -> list[StreamingQuery]:
    """The jobs that fill the topics: log landing and routing, change routing, and quarantines."""
    return [
        log_landing_job(logs, paths, once=once),
        log_route_job(logs, sink, paths, once=once),
        change_route_job(changes_, sink, paths, once),
        quarantine_job(logs, "logs", paths, once),
        quarantine_job(changes_, "changes", paths, once),
    ]
