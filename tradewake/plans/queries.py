"""Every operator as a query over the benchmark tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tradewake import config, schemas
from tradewake.functions import values
from tradewake.functions.times import previous_day
from tradewake.operators import alerts, changes, dedup, ingest, joins, metrics, paging, relevance, search
from tradewake.plans import reports
from tradewake.session import configure, shared_folder
from tradewake.config import JobPaths
from tradewake.sources import driver_tables as d
from tradewake.sources import launch_store, sale_index, sql_reports, tables, topics
from tradewake.streaming import jobs

# Parameters with results on these tables.
DAY = "2024-01-02"
ORDER_DAY = "1997-08-23"
AGE_DAY = "2001-08-01"
SEARCH_DAY, KEYWORD = "1997-10-08", "Blue"
PAGE, PAGE_SIZE = 2, 5
DEEP_PAGE = 10_000
RANKED_KEYWORD = "Blue widget"
RUN_DAYS = ("2024-01-02", "2024-01-03")
AUDIT_DAYS = 40
STAMP_MILLIS = 1_704_200_000_000
WINDOW, SLIDE = 86_400, 21_600
BEFORE, AFTER = 300 * 86_400, 100 * 86_400
REPEAT_DAYS = (150, 350)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(build: Query) -> Query:
    """Register a query under the name of its function."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        return build(configure(spark), folder)

    QUERIES[build.__name__] = run
    return run


def _log_columns(rows: DataFrame) -> DataFrame:
    return rows.withColumnsRenamed({"logDate": "log_date", "logHour": "log_hour"})


def _joined(values_array: str | Column) -> Column:
    return F.array_join(F.array_sort(values_array), ",")


def _as_of() -> Column:
    return F.lit(AGE_DAY).cast("date")


def _sales(spark: SparkSession, folder: str) -> DataFrame:
    """All sales."""
    return joins.sale_detail(d.lines(spark, folder), d.orders(spark, folder), d.users(spark, folder), _as_of())


def _day_sales(spark: SparkSession, folder: str, day: str) -> DataFrame:
    """The sales of a day's orders, which are written first, so that their size is known.

    Where they are few, the lines are neither shuffled nor named before they meet them.
    """
    path = shared_folder(spark)
    d.order_heads(spark, folder, (day, day)).write.parquet(path)
    lines = d.lines_of(spark, folder, spark.read.parquet(path))
    return joins.sale_columns(joins.with_users(lines.withColumnRenamed("create_date", "dt"), d.users(spark, folder), _as_of()))


def _documents(sales: DataFrame) -> DataFrame:
    return sales.withColumn("doc_id", values.sale_document_id(F.col("order_id"), F.col("order_detail_id")))


# The day asked for, and with the day before.
ONE_DAY = (DAY, DAY)
TWO_DAYS = (previous_day(DAY), DAY)


def _first_launches(spark: SparkSession, folder: str, days: d.Days | None = None) -> DataFrame:
    return dedup.first_launch_of_day(d.launches(spark, folder, days))


def _launch_rows(first: DataFrame) -> DataFrame:
    """First launches with all eleven columns of the launch table."""
    return first.select(
        *[
            F.col(f.name) if f.name in first.columns else F.lit(None).cast(f.dataType).alias(f.name)
            for f in schemas.LAUNCH
        ]
    )


# --- ingestion ---------------------------------------------------------------


@query
def launch_derived(spark, folder):
    decoded = ingest.decode_logs(d.log_records(spark, folder), schemas.LAUNCH, ["mid", "ts"])
    good = ingest.accepted(decoded)
    return _log_columns(good.select("mid", "uid", "type", "ts", "logDate", "logHour"))


@query
def ingest_stamped(spark, folder):
    stamped = ingest.stamp(d.log_records(spark, folder), F.lit(STAMP_MILLIS))
    return ingest.accepted(stamped).select("type", "mid", "uid", "ts")


@query
def route_logs(spark, folder):
    routed = ingest.route_logs(d.logs(spark, folder), config.TOPIC_LAUNCH, config.TOPIC_EVENT)
    return routed.groupBy("topic").agg(F.count(F.lit(1)).alias("lines"))


@query
def raw_landing(spark, folder):
    stamped = ingest.accepted(ingest.stamp(d.log_records(spark, folder), F.lit(STAMP_MILLIS)))
    landed = stamped.select(
        F.col("line").alias("value"), F.date_format(F.timestamp_millis("ts"), "yyyy-MM-dd").alias("log_date")
    )
    path = shared_folder(spark)
    tables.write_raw_logs(landed, path, 0)
    tables.write_raw_logs(landed, path, 0)  # a retry
    return tables.read_raw_logs(spark, path)


@query
def cdc_route(spark, folder):
    routed = changes.route_changes(d.changes(spark, folder))
    return routed.groupBy("table", "op", "topic").agg(F.count(F.lit(1)).alias("records"))


@query
def cdc_after_image(spark, folder):
    return changes.after_images(changes.route_changes(d.changes(spark, folder)))


def _order_records(spark, folder):
    raw = d.raw_orders(spark, folder).drop("order_at")
    return raw.select(F.to_json(F.struct("*")).alias("value"))


def _order_shape(orders: DataFrame) -> DataFrame:
    return ingest.accepted(orders).select(
        "id", "user_id", "province_id", "consignee_tel", "order_status", "total_amount", "create_date", "create_hour"
    )


@query
def order_enriched(spark, folder):
    decoded = ingest.decode(_order_records(spark, folder), schemas.ORDER, ["id"])
    return _order_shape(ingest.prepare_orders(decoded))


@query
def order_masked_sale(spark, folder):
    decoded = ingest.decode(_order_records(spark, folder), schemas.ORDER, ["id"])
    return _order_shape(ingest.prepare_sale_orders(decoded))


# --- deduplication -----------------------------------------------------------


@query
def first_launch_rows(spark, folder):
    return _log_columns(_first_launches(spark, folder).select("mid", "uid", "ts", "logDate", "logHour"))


@query
def seen_anti_join(spark, folder):
    launches = d.launches(spark, folder)
    seen = launches.where(F.col("logHour") < "12").select("mid", "logDate").distinct()
    return _log_columns(dedup.first_launch_not_seen(launches, seen).select("mid", "uid", "ts", "logDate"))


@query
def latest_user(spark, folder):
    records = d.logs(spark, folder).select(
        F.col("mid").alias("id"), "uid", F.col("ts").alias("timestamp"), F.col("event_id").alias("offset")
    )
    return dedup.latest_users(records).select("id", "uid", "offset")


@query
def doc_upsert(spark, folder):
    lines = d.lines(spark, folder).select(
        values.sale_document_id(F.col("order_id"), F.col("id")).alias("doc_id"), "sku_id", "sku_price", "sku_name", "sku_num"
    )
    return dedup.latest_documents(lines, ["doc_id"])


# --- joins -------------------------------------------------------------------


@query
def order_detail_outer(spark, folder):
    joined = joins.lines_with_orders_outer(
        d.lines(spark, folder).select("id", "order_id", "sku_id", "sku_price"),
        d.orders(spark, folder).select("id", "user_id", "order_status"),
    )
    return joined.select(
        "order_id", F.col("line.id").alias("line_id"), "line.sku_id", "line.sku_price", "order.user_id", "order.order_status"
    )


@query
def late_join(spark, folder):
    joined = joins.late_join(
        d.lines(spark, folder).select("id", "order_id", "sku_id", "sku_price", "sku_name", "line_at"),
        d.orders(spark, folder).select("id", "order_status", "create_time", "user_id", "create_date", "order_at"),
        BEFORE,
        AFTER,
    )
    return joins.merge_sale(joined)


@query
def late_join_repeats(spark, folder):
    """Every order also came twice before, at other times and with other states."""
    orders = d.orders(spark, folder).select("id", "order_status", "create_time", "user_id", "create_date", "order_at")
    earlier = [
        orders.withColumns({
            "order_at": F.col("order_at") - F.expr(f"interval {days} days"),
            "order_status": F.concat("order_status", F.lit(f"-{days}")),
        })
        for days in REPEAT_DAYS
    ]
    joined = joins.late_join(
        d.lines(spark, folder).select("id", "order_id", "sku_id", "sku_price", "sku_name", "line_at"),
        orders.union(earlier[0]).union(earlier[1]),
        BEFORE,
        AFTER,
    )
    return joins.merge_sale(joined)


@query
def user_lookup(spark, folder):
    rows = d.orders(spark, folder).select(F.col("id").alias("order_id"), "user_id")
    return joins.with_users(rows, d.users(spark, folder), _as_of())


@query
def sale_detail(spark, folder):
    return _sales(spark, folder)


# --- alerts ------------------------------------------------------------------


@query
def coupon_window_state(spark, folder):
    state = alerts.window_state(d.events(spark, folder), WINDOW, SLIDE)
    return state.select(
        "mid",
        F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("window_start"),
        F.size("accounts").cast("bigint").alias("accounts"),
        _joined(F.transform("accounts", lambda a: a["uid"])).alias("uids"),
        _joined(F.transform("items", lambda i: i["itemid"])).alias("items"),
        F.aggregate("event_counts", F.lit(0).cast("bigint"), lambda s, e: s + e["n"]).alias("events"),
        "views",
    )


def _alerts(spark, folder):
    return alerts.coupon_alerts(
        d.events(spark, folder), WINDOW, SLIDE, config.ALERT_ACCOUNTS, scratch=shared_folder(spark)
    )


def _alert_columns(found: DataFrame) -> DataFrame:
    return found.select(
        "day",
        "doc_id",
        "mid",
        F.array_join("uids", ",").alias("uids"),
        F.array_join("itemIds", ",").alias("item_ids"),
        _joined(F.transform("events", lambda e: F.concat_ws(":", e["evid"], e["n"]))).alias("events"),
        "ts",
    )


@query
def coupon_alerts(spark, folder):
    return _alert_columns(_alerts(spark, folder))


@query
def coupon_alerts_five_minutes(spark, folder):
    """The original window and slide. One account is enough here: no device of
    these tables has three within five minutes."""
    found = alerts.coupon_alerts(
        d.events(spark, folder),
        config.ALERT_WINDOW_SECONDS,
        config.ALERT_SLIDE_SECONDS,
        threshold=1,
        scratch=shared_folder(spark),
    )
    return _alert_columns(found)


# --- dashboard figures -------------------------------------------------------


@query
def daily_active(spark, folder):
    return _log_columns(metrics.daily_active(d.launches(spark, folder)))


@query
def active_of_day(spark, folder):
    return metrics.active_of_day(_first_launches(spark, folder, ONE_DAY), DAY)


@query
def hourly_active(spark, folder):
    return metrics.active_by_hour(_first_launches(spark, folder, ONE_DAY), DAY)


@query
def hourly_active_compare(spark, folder):
    return metrics.compare_active_hours(_first_launches(spark, folder, TWO_DAYS), DAY)


@query
def order_amount_day(spark, folder):
    return metrics.amount_by_day(d.order_amounts(spark, folder))


@query
def order_amount_total(spark, folder):
    return metrics.amount_of_day(d.order_amounts(spark, folder, (ORDER_DAY, ORDER_DAY)), ORDER_DAY)


@query
def order_amount_hour(spark, folder):
    return metrics.amount_by_hour(d.purchases(spark, folder, ONE_DAY), DAY)


@query
def hourly_amount_compare(spark, folder):
    return metrics.compare_amount_hours(d.purchases(spark, folder, TWO_DAYS), DAY)


@query
def kpi_cards(spark, folder):
    return metrics.kpi_cards(d.launches(spark, folder), d.purchases(spark, folder, ONE_DAY), DAY)


@query
def new_devices(spark, folder):
    return _log_columns(metrics.new_devices(d.launches(spark, folder)))


@query
def province_sales(spark, folder):
    return metrics.province_sales(d.orders(spark, folder))


@query
def observed_counts(spark, folder):
    return metrics.stage_counts(d.launches(spark, folder))


@query
def sql_active_total(spark, folder):
    launches = tables.upper_case(_first_launches(spark, folder, ONE_DAY))
    return sql_reports.run(sql_reports.ACTIVE_TOTAL, DAY, launches=launches)


@query
def sql_active_by_hour(spark, folder):
    launches = tables.upper_case(_first_launches(spark, folder, ONE_DAY))
    return sql_reports.run(sql_reports.ACTIVE_BY_HOUR, DAY, launches=launches)


@query
def sql_amount_total(spark, folder):
    orders = tables.upper_case(d.order_amounts(spark, folder, (ORDER_DAY, ORDER_DAY)))
    return sql_reports.run(sql_reports.AMOUNT_TOTAL, ORDER_DAY, orders=orders)


@query
def sql_amount_by_hour(spark, folder):
    orders = tables.upper_case(d.purchases(spark, folder, ONE_DAY))
    return sql_reports.run(sql_reports.AMOUNT_BY_HOUR, DAY, orders=orders)


@query
def realtime_total(spark, folder):
    return reports.realtime_total(d.launches(spark, folder), d.purchases(spark, folder, ONE_DAY), DAY)


@query
def realtime_hours_dau(spark, folder):
    first, bought = _first_launches(spark, folder, TWO_DAYS), d.purchases(spark, folder, TWO_DAYS)
    return reports.realtime_hours(first, bought, "dau", DAY)


@query
def realtime_hours_amount(spark, folder):
    first, bought = _first_launches(spark, folder, TWO_DAYS), d.purchases(spark, folder, TWO_DAYS)
    return reports.realtime_hours(first, bought, "order_amount", DAY)


# --- search ------------------------------------------------------------------


@query
def sale_search_page(spark, folder):
    return search.page(search.hits(_day_sales(spark, folder, SEARCH_DAY), SEARCH_DAY, KEYWORD), KEYWORD, PAGE, PAGE_SIZE)


@query
def sale_search_total(spark, folder):
    return search.total(search.hits(_day_sales(spark, folder, SEARCH_DAY), SEARCH_DAY, KEYWORD))


@query
def age_terms(spark, folder):
    return search.age_terms(search.hits(_day_sales(spark, folder, ORDER_DAY), ORDER_DAY))


@query
def gender_terms(spark, folder):
    return search.gender_terms(search.hits(_day_sales(spark, folder, ORDER_DAY), ORDER_DAY))


@query
def age_share(spark, folder):
    return search.age_share(search.hits(_day_sales(spark, folder, ORDER_DAY), ORDER_DAY))


@query
def gender_share(spark, folder):
    return search.gender_share(search.hits(_day_sales(spark, folder, ORDER_DAY), ORDER_DAY))


@query
def sale_search_report(spark, folder):
    return reports.sale_detail(_day_sales(spark, folder, SEARCH_DAY), SEARCH_DAY, PAGE, PAGE_SIZE, KEYWORD)


def _stored_sales(spark, folder) -> tables.KeyedTable:
    store = tables.sale_table(shared_folder(spark))
    store.upsert(_documents(_sales(spark, folder)), 0)
    return store


@query
def sale_breakdowns(spark, folder):
    """Terms, shares and total of a day from one pass over its sales."""
    return search.breakdowns(search.hits(_day_sales(spark, folder, ORDER_DAY), ORDER_DAY))


@query
def sale_page_deep(spark, folder):
    """A page far behind in all sales; only the range that it lies in is read for it."""
    sales = _sales(spark, folder)
    order = [F.col(c) for c in ("order_id", "order_detail_id", *[c for c in sales.columns if not c.startswith("order_")])]
    return paging.sorted_rows(sales, order, shared_folder(spark)).page(DEEP_PAGE, PAGE_SIZE).drop(paging.PLACE)


@query
def sale_table_report(spark, folder):
    """The report from the stored sale table."""
    sales = _stored_sales(spark, folder).read(spark, SEARCH_DAY)
    return reports.sale_detail(sales.drop("doc_id"), SEARCH_DAY, PAGE, PAGE_SIZE, KEYWORD, shared_folder(spark))


def _index(spark, folder) -> tuple[tables.KeyedTable, sale_index.SaleIndex]:
    store = _stored_sales(spark, folder)
    index = sale_index.SaleIndex(f"{store.path}-index")
    index.refresh(store, spark, [SEARCH_DAY, ORDER_DAY])
    return store, index


@query
def sale_search_ranked(spark, folder):
    """The best sales of a day by BM25, from the stored index."""
    store, index = _index(spark, folder)
    found = index.ranked(spark, SEARCH_DAY, RANKED_KEYWORD)
    return search.ranked_page(found, store.read(spark, SEARCH_DAY), 1, 2 * PAGE_SIZE, shared_folder(spark))


@query
def sale_word_scores(spark, folder):
    """The BM25 score of every word of every sale of two days, each day by its own figures."""
    _, index = _index(spark, folder)
    scores = relevance.word_scores(index.postings(spark), index.sizes(spark))
    return scores.select("dt", "word", "doc_id", F.round("score", relevance.DIGITS).alias("score"))


# --- tables ------------------------------------------------------------------


@query
def wide_upsert(spark, folder):
    """First launches in two batches, the first of them retried."""
    store = tables.launch_table(shared_folder(spark))
    rows = tables.upper_case(_launch_rows(_first_launches(spark, folder)))
    store.upsert(rows.where("LOGHOUR < '12'"), 0)
    store.upsert(rows.where("LOGHOUR < '12'"), 0)
    store.upsert(rows, 1)
    return store.read(spark).select("MID", "UID", "LOGDATE", "LOGHOUR", "TS")


@query
def order_upsert(spark, folder):
    """Orders, then a second batch that changes the finished ones."""
    store = tables.order_table(shared_folder(spark))
    rows = tables.upper_case(d.orders(spark, folder).drop("order_at"))
    store.upsert(rows, 0)
    store.upsert(rows.where("ORDER_STATUS = 'F'").withColumn("TOTAL_AMOUNT", F.col("TOTAL_AMOUNT") + 1), 1)
    return store.read(spark).select("ID", "USER_ID", "ORDER_STATUS", "TOTAL_AMOUNT", "CREATE_DATE")


@query
def sale_upsert(spark, folder):
    return _stored_sales(spark, folder).read(spark)


@query
def sale_table_search(spark, folder):
    """Search in the stored sale table; only the day's folders are listed and read."""
    store = _stored_sales(spark, folder)
    return search.page(search.hits(store.read(spark, SEARCH_DAY), SEARCH_DAY, KEYWORD).drop("doc_id"), KEYWORD, 1, PAGE_SIZE)


@query
def order_upsert_out_of_order(spark, folder):
    """Records of one order in three batches; the latest by its source's time stays."""
    store = tables.order_table(shared_folder(spark))
    rows = tables.upper_case(d.orders(spark, folder))
    store.upsert(rows, 0, ["ORDER_AT"])

    def moved(some: DataFrame, days: int, status: str) -> DataFrame:
        at = F.col("ORDER_AT") + F.expr(f"interval {days} days")
        return some.withColumns({"ORDER_AT": at, "ORDER_STATUS": F.lit(status)})

    store.upsert(moved(rows.where("cast(ID as long) % 3 = 0"), 1, "later"), 1, ["ORDER_AT"])
    store.upsert(moved(rows, -1, "earlier"), 2, ["ORDER_AT"])
    return store.read(spark).select("ID", "USER_ID", "ORDER_STATUS", "CREATE_DATE")


@query
def dated_targets(spark, folder):
    """Sales stored by the runs of two days; under the alias the newer run's row holds."""
    store = tables.dated_sales(shared_folder(spark))
    sales = _documents(_day_sales(spark, folder, ORDER_DAY))
    first, second = RUN_DAYS
    store.upsert(sales, first, 0)
    store.upsert(sales.where("user_gender = 'M'").withColumn("order_status", F.lit("again")), second, 1)
    return store.alias(spark).select("doc_id", "order_status", "target")


@query
def user_lookup_buckets(spark, folder):
    """Users of a day's orders from the stored users; only the buckets of their ids are read."""
    store = tables.user_table(shared_folder(spark))
    store.upsert(d.users(spark, folder), 0)
    rows = d.order_heads(spark, folder, (ORDER_DAY, ORDER_DAY)).select(F.col("_key").cast("string").alias("order_id"), "user_id")
    return joins.with_users(rows, store.read(spark, wanted=joins.user_ids(rows)), _as_of())


def _launch_batches(spark, folder) -> launch_store.LaunchStore:
    """All launches in three batches, of which each has some of every day."""
    store = launch_store.launch_store(shared_folder(spark)).create(spark)
    rows = d.launches(spark, folder)
    for batch_id in (2, 1, 0):
        store.add(_launch_rows(rows.where(F.col("event_id") % 3 == batch_id)), 2 - batch_id)
    return store


@query
def new_devices_incremental(spark, folder):
    """New devices per day, kept up to date batch by batch."""
    figures = _launch_batches(spark, folder).figures(spark)
    return figures.where("new > 0").select(F.col("day").alias("log_date"), F.col("new").alias("new_mid"))


@query
def kpi_cards_stored(spark, folder):
    """The cards of a day from its stored counts; no launch is read for them."""
    figures = _launch_batches(spark, folder).figures(spark, DAY)
    return metrics.kpi_cards_of_counts(figures, d.purchases(spark, folder, ONE_DAY), DAY)


@query
def alert_upsert(spark, folder):
    store = tables.alert_table(shared_folder(spark))
    found = _alerts(spark, folder)
    store.upsert(found, 0)
    store.upsert(found, 1)
    return _alert_columns(store.read(spark))


@query
def user_snapshot(spark, folder):
    """Users, an update of one segment, and a merge into a fresh table."""
    root = shared_folder(spark)
    store = tables.user_table(root)
    users = d.users(spark, folder)
    store.upsert(users, 0)
    store.upsert(users.where("user_level = 'BUILDING'").withColumn("user_level", F.lit("VIP")), 1)
    return store.compact(spark, f"{root}/merged").read(spark)


# --- streaming jobs over the same tables, run until all files are read ---------


def _paths(spark: SparkSession) -> JobPaths:
    root = shared_folder(configure(spark, streaming=True))
    return JobPaths(f"{root}/tables", f"{root}/checkpoints", f"{root}/raw")


def _finish(job) -> None:
    job.awaitTermination()
    if job.exception():
        raise job.exception()


@query
def stream_first_launches(spark, folder):
    """Device-days of the launch job. Which launch of a day arrives first is open."""
    paths = _paths(spark)
    _finish(jobs.launch_job(d.log_records(spark, folder, d.stream_table), paths, once=True))
    return tables.launch_table(paths.tables).read(spark).select("MID", "LOGDATE")


def _in_two_runs(spark, folder, run) -> None:
    """Hand ``run`` a stream of the launches, twice: one in five only comes the second time."""
    topic = f"{shared_folder(spark)}/topic"
    records = d.log_records(spark, folder)
    for late in (False, True):
        records.where((F.col("offset") % 5 == 0) == late).write.mode("append").parquet(topic)
        run(topics.file_source(spark, topic))


@query
def stream_late_launches(spark, folder):
    """Device-days of the launch job, where one launch in five comes after all others."""
    paths = _paths(spark)
    _in_two_runs(spark, folder, lambda source: _finish(jobs.launch_job(source, paths, once=True)))
    return tables.launch_table(paths.tables).read(spark).select("MID", "LOGDATE")


@query
def stream_launch_figures(spark, folder):
    """Active and new devices per day, as the same job counts them."""
    paths = _paths(spark)
    _in_two_runs(spark, folder, lambda source: _finish(jobs.launch_job(source, paths, once=True)))
    return launch_store.launch_store(paths.tables).figures(spark)


@query
def late_rows_counted(spark, folder):
    """How many of these launches a dedup that waits a day finds too late to look at."""
    paths, counts = _paths(spark), []

    def run(source: DataFrame) -> None:
        timed = jobs.decoded_launches(source).withColumn("at", F.timestamp_millis("ts"))
        first = dedup.first_launch_stream(timed, "at", "1 day", salts=1)
        writing = first.writeStream.format("noop").option("checkpointLocation", paths.checkpoint("late"))
        query_ = writing.trigger(availableNow=True).start()
        _finish(query_)
        counts.append(jobs.late_rows(spark, query_))

    _in_two_runs(spark, folder, run)
    return counts[0].union(counts[1]).groupBy("operator").agg(F.sum("rows").alias("rows"))


@query
def sale_expiry_audit(spark, folder):
    """Order lines that met their order, that waited in vain, and that still wait."""
    paths = _paths(spark)
    job = jobs.sale_job(
        d.order_records(spark, folder, d.stream_table),
        d.line_records(spark, folder, d.stream_table),
        paths,
        _as_of(),
        once=True,
        before_seconds=AUDIT_DAYS * 86_400,
        after_seconds=AUDIT_DAYS * 86_400,
        delay=f"{AUDIT_DAYS} days 12 hours",
    )
    _finish(job)
    key = ["order_id", "id"]
    sent = d.lines(spark, folder).select(*key).distinct()
    sales = tables.sale_table(paths.tables).read(spark)
    matched = sales.select("order_id", F.col("order_detail_id").alias("id")).distinct()
    expired = tables.unmatched_table(paths.tables).read(spark).select(*key).distinct().join(matched, key, "left_anti")
    places = {"matched": matched, "expired": expired}
    told = sent.withColumn("place", F.lit("waiting"))
    for place, rows in places.items():
        mark = rows.withColumn("_mark", F.lit(place))
        told = told.join(mark, key, "left").withColumn("place", F.coalesce("_mark", "place")).drop("_mark")
    return told.groupBy("place").agg(F.count(F.lit(1)).alias("lines"))


@query
def stream_alerts(spark, folder):
    """Alerts of all windows: two later records of another device close them."""
    paths = _paths(spark)
    topic = f"{shared_folder(spark)}/topic"
    records = d.event_records(spark, folder)
    records.write.parquet(topic)

    def run() -> None:
        source = topics.file_source(spark, topic)
        _finish(jobs.alert_job(source, paths, once=True, window_seconds=WINDOW, slide_seconds=SLIDE, delay="1 hour"))

    run()
    for step in (1, 2):
        # The first one lets go of the panes, the second one of the windows.
        at = F.max("timestamp") + F.expr(f"interval {2 * step * WINDOW} seconds")
        line = F.to_json(F.struct(F.lit("closing").alias("mid"), F.lit("addCart").alias("evid"), F.unix_millis("timestamp").alias("ts")))
        last = records.agg(at.alias("timestamp")).select(line.alias("value"), "timestamp", F.lit(0).cast("bigint").alias("offset"))
        last.write.mode("append").parquet(topic)
        run()
    return _alert_columns(tables.alert_table(paths.tables).read(spark))


@query
def stream_sales(spark, folder):
    """The sale job with its user table, with time limits in days."""
    paths = _paths(spark)
    tables.user_table(paths.tables).upsert(d.users(spark, folder), 0)
    job = jobs.sale_job(
        d.order_records(spark, folder, d.stream_table),
        d.line_records(spark, folder, d.stream_table),
        paths,
        _as_of(),
        once=True,
        before_seconds=BEFORE,
        after_seconds=AFTER,
        delay="400 days",
    )
    _finish(job)
    return tables.sale_table(paths.tables).read(spark)


@query
def stream_log_routes(spark, folder):
    """Stamped log lines by topic, as the routing job publishes them."""
    paths = _paths(spark)
    source = d.log_records(spark, folder, d.stream_table)
    out = paths.table("topics")
    _finish(jobs.log_route_job(source, lambda rows: topics.file_sink(rows, out), paths, F.lit(STAMP_MILLIS), once=True))
    return spark.read.schema("value string, topic string").json(out)


@query
def stream_change_routes(spark, folder):
    """Change records by topic, as the routing job publishes them."""
    paths = _paths(spark)
    source = d.change_records(spark, folder, d.stream_table)
    out = paths.table("topics")
    _finish(jobs.change_route_job(source, lambda rows: topics.file_sink(rows, out), paths, once=True))
    return spark.read.schema("value string, topic string").json(out)


@query
def stream_orders(spark, folder):
    """The order table as the order job fills it."""
    paths = _paths(spark)
    _finish(jobs.order_job(d.order_records(spark, folder, d.stream_table), paths, once=True))
    stored = tables.order_table(paths.tables).read(spark)
    return stored.select("ID", "USER_ID", "CONSIGNEE_TEL", "ORDER_STATUS", "TOTAL_AMOUNT", "CREATE_DATE", "CREATE_HOUR")


@query
def stream_users(spark, folder):
    """The user table as the user job fills it."""
    paths = _paths(spark)
    _finish(jobs.user_job(d.user_records(spark, folder, d.stream_table), paths, once=True))
    return tables.user_table(paths.tables).read(spark)


@query
def stream_raw_logs(spark, folder):
    """Landed log lines, as the landing job writes them."""
    paths = _paths(spark)
    source = d.log_records(spark, folder, d.stream_table)
    _finish(jobs.log_landing_job(source, paths, F.lit(STAMP_MILLIS), once=True))
    return tables.read_raw_logs(spark, paths.raw_logs)


@query
def quarantine_counts(spark, folder):
    """Orders sent, stored and quarantined; some have no usable time, some are no JSON."""
    paths = _paths(spark)

    def source() -> DataFrame:
        sent = d.order_records(spark, folder, d.stream_table)
        number = F.get_json_object("value", "$.id").cast("long")
        spoilt = F.when(number % 7 == 0, F.regexp_replace("value", "create_time", "time")).when(
            number % 11 == 0, F.substring("value", 1, 20)
        )
        return sent.withColumn("value", F.coalesce(spoilt, F.col("value")))

    _finish(jobs.order_job(source(), paths, once=True))
    _finish(jobs.quarantine_job(source(), "orders", paths, once=True))
    bad = spark.read.schema("problem string, value string").json(paths.table("quarantine/orders"))
    stored = tables.order_table(paths.tables).read(spark)
    return stored.select(F.lit("stored").alias("place")).union(bad.select("problem")).groupBy("place").agg(
        F.count(F.lit(1)).alias("records")
    )


@query
def two_checkpoints(spark, folder):
    """Users of two runs with checkpoints of their own into one table; none is lost."""
    paths = _paths(spark)
    again = JobPaths(paths.tables, f"{paths.checkpoints}-again", paths.raw_logs)
    for at, even in ((paths, True), (again, False)):
        records = d.user_records(spark, folder, d.stream_table)
        number = F.get_json_object("value", "$.id").cast("long")
        _finish(jobs.user_job(records.where((number % 2 == 0) == even), at, once=True))
    return tables.user_table(paths.tables).read(spark)
