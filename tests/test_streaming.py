"""Replays from files: streaming results against the batch operators."""

import datetime as dt
import json

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tradewake import config, schemas
from tradewake.config import JobPaths
from tradewake.operators import alerts, dedup, ingest, joins
from tradewake.sources import driver_tables, tables, topics
from tradewake.streaming import jobs

SF = "/root/testdata/sf0.001"
T0 = dt.datetime(2024, 1, 1, 12, 0, 0, tzinfo=dt.timezone.utc)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def ms(seconds):
    return int(at(seconds).timestamp() * 1000)


class Feed:
    """A folder of topic files, written in order of arrival."""

    def __init__(self, spark, folder):
        self.spark, self.folder, self.n = spark, str(folder), 0
        folder.mkdir(parents=True)

    def send(self, *records):
        """One file of (value, seconds) pairs; values are dicts or text."""
        rows = [
            (v if isinstance(v, str) else json.dumps(v), at(s), self.n * 1000 + i) for i, (v, s) in enumerate(records)
        ]
        self.spark.createDataFrame(rows, topics.RECORD).coalesce(1).write.mode("append").parquet(self.folder)
        self.n += 1

    def stream(self, files_per_batch=1):
        return topics.file_source(self.spark, self.folder, files_per_batch)

    def batch(self):
        return topics.read_topic_files(self.spark, self.folder)


@pytest.fixture
def paths(tmp_path):
    return JobPaths(str(tmp_path / "tables"), str(tmp_path / "checkpoints"), str(tmp_path / "raw"))


@pytest.fixture
def feed(spark, tmp_path):
    def make(name):
        return Feed(spark, tmp_path / "topics" / name)

    return make


def finish(query):
    query.awaitTermination(120)
    assert query.exception() is None
    return query


def test_first_launches_equal_batch_keys_over_many_batches(spark, paths, tmp_path):
    records = driver_tables.log_records(spark, SF)
    folder = str(tmp_path / "launches")
    # Twelve files in rough order of time, each with stragglers of up to ten hours.
    jitter = F.pmod(F.xxhash64("offset"), F.lit(36_000_000))
    arrival = Window.orderBy(F.unix_millis("timestamp") + jitter)
    moved = records.withColumn("slot", F.ntile(12).over(arrival))
    for slot in range(1, 13):
        moved.where(F.col("slot") == slot).drop("slot").coalesce(1).write.mode("append").parquet(folder)
    finish(jobs.launch_job(topics.file_source(spark, folder, 1), paths, once=True))
    stored = tables.launch_table(paths.tables).read(spark)
    batch = dedup.first_launch_of_day(
        ingest.accepted(ingest.decode_logs(topics.read_topic_files(spark, folder), schemas.LAUNCH, ["mid", "ts"]))
    )
    want = {(r.mid, r.logDate) for r in batch.collect()}
    got = [(r.MID, r.LOGDATE) for r in stored.collect()]
    assert len(want) == 397
    assert set(got) == want and len(got) == len(want)


def launch(mid, seconds, **more):
    return {"type": "startup", "mid": mid, "uid": "u", "ts": ms(seconds), **more}


def test_restart_goes_on_without_loss_or_repeat(spark, paths, feed):
    f = feed("launches")
    f.send((launch("a", 0), 0), (launch("b", 1), 1))
    finish(jobs.launch_job(f.stream(), paths, once=True))
    f.send((launch("a", 60), 60), (launch("c", 61), 61))
    finish(jobs.launch_job(f.stream(), paths, once=True))
    got = sorted((r.MID, r.TS) for r in tables.launch_table(paths.tables).read(spark).collect())
    assert got == [("a", ms(0)), ("b", ms(1)), ("c", ms(61))]


def test_launches_around_midnight_and_bad_records(spark, paths, feed):
    f = feed("launches")
    f.send(
        (launch("a", 12 * 3600 - 1), 0),
        (launch("a", 12 * 3600), 1),
        ("{not json", 2),
        ({"type": "startup", "mid": "x"}, 3),
        ({"type": "startup", "ts": ms(5)}, 4),
    )
    f.send((launch("a", -3600), 10), (launch("late", 12 * 3600 - 30), 11))
    finish(jobs.launch_job(f.stream(), paths, once=True))
    got = sorted((r.MID, r.LOGDATE) for r in tables.launch_table(paths.tables).read(spark).collect())
    assert got == [("a", "2024-01-01"), ("a", "2024-01-02"), ("late", "2024-01-01")]
    finish(jobs.quarantine_job(f.stream(), "launches", paths, once=True))
    bad = spark.read.json(paths.table("quarantine/launches"))
    assert sorted(r.problem for r in bad.collect()) == ["malformed", "missing mid", "missing ts"]


def order(i, **more):
    return {
        "id": i, "user_id": "u1", "order_status": "1001", "consignee_tel": "13812345678",
        "total_amount": "12.50", "create_time": "2024-01-01 12:00:00", **more,
    }


def line(i, order_id, **more):
    return {"id": i, "order_id": order_id, "sku_id": "s", "sku_name": "blue ring", "order_price": "9.99", "sku_num": "1", **more}


def test_order_job_masks_and_keeps_the_latest_record(spark, paths, feed):
    f = feed("orders")
    f.send((order("1"), 0), (order("1", order_status="1002"), 1), (order("2", create_time="?"), 2), (order("3", consignee_tel="12"), 3))
    f.send((order("4", total_amount="oops"), 4))
    finish(jobs.order_job(f.stream(), paths, once=True))
    rows = sorted(tables.order_table(paths.tables).read(spark).collect(), key=lambda r: r.ID)
    assert [(r.ID, r.ORDER_STATUS, r.CONSIGNEE_TEL, r.TOTAL_AMOUNT, r.CREATE_DATE, r.CREATE_HOUR) for r in rows] == [
        ("1", "1002", "1381****5678", 12.5, "2024-01-01", "12"),
        ("3", "1001", None, 12.5, "2024-01-01", "12"),
    ]
    finish(jobs.quarantine_job(f.stream(), "orders", paths, once=True))
    bad = spark.read.json(paths.table("quarantine/orders")).collect()
    assert sorted(r.problem for r in bad) == ["bad create_time", "bad total_amount"]


def test_fresh_checkpoint_overwrites_nothing(spark, paths, feed, tmp_path):
    first, second = feed("users"), feed("more_users")
    first.send(({"id": "a"}, 0), ({"id": "b", "login_name": "old"}, 1))
    finish(jobs.user_job(first.stream(), paths, once=True))
    second.send(({"id": "b", "login_name": "new"}, 2), ({"id": "c"}, 3))
    again = JobPaths(paths.tables, str(tmp_path / "fresh"), paths.raw_logs)
    finish(jobs.user_job(second.stream(), again, once=True))
    stored = {r.id: r.login_name for r in tables.user_table(paths.tables).read(spark).collect()}
    assert stored == {"a": None, "b": "new", "c": None}


def test_malformed_change_records_are_quarantined(spark, paths, feed):
    f = feed("changes")
    good = {"entry_type": "ROWDATA", "table": "order_info", "op": "INSERT", "rows": [[{"name": "id", "value": "1"}]]}
    f.send((good, 0), ("{not json", 1), ("[]", 2))
    finish(jobs.quarantine_job(f.stream(), "changes", paths, once=True))
    assert spark.read.json(paths.table("quarantine/changes")).count() == 2


def test_all_jobs_run_together(spark, paths, feed):
    orders, lines = fill_sales(feed)
    more = {name: feed(name) for name in ("launches", "events", "users")}
    more["launches"].send((launch("a", 0), 0))
    more["events"].send(({"mid": "m", "uid": "u", "evid": "coupon", "ts": ms(0)}, 0))
    more["users"].send(({"id": "u1"}, 0), ("{", 1))
    of = {
        config.TOPIC_LAUNCH: more["launches"], config.TOPIC_EVENT: more["events"], config.TOPIC_USER: more["users"],
        config.TOPIC_ORDER: orders, config.TOPIC_ORDER_LINE: lines,
    }
    started = jobs.start_all(spark, lambda topic: of[topic].stream(), paths, show=lambda text: None, once=True)
    for job in started:
        finish(job)
    assert len(started) == 10
    assert tables.launch_table(paths.tables).read(spark).count() == 1
    assert tables.order_table(paths.tables).read(spark).count() >= len(SALE_ORDERS)
    assert tables.user_table(paths.tables).read(spark).count() == 1
    assert spark.read.json(paths.table("quarantine/users")).count() == 1


SALE_ORDERS = [("o1", 1000), ("o2", 1000), ("o3", 1000), ("o4", 1000), ("o5", 1000)]
SALE_LINES = [
    ("same", "o1", 1000),
    ("early299", "o2", 701), ("early300", "o2", 700), ("early301", "o2", 699),
    ("late99", "o3", 1099), ("late100", "o3", 1100), ("late101", "o3", 1101),
    ("waiting", "o4", 900), ("with", "o4", 1000),
    ("lost", "none", 1000),
]
MATCHED = {("o1", "same"), ("o2", "early299"), ("o2", "early300"), ("o3", "late99"), ("o3", "late100"), ("o4", "waiting"), ("o4", "with")}


def fill_sales(feed):
    orders, lines = feed("orders"), feed("lines")
    for until in (800, 1000, 1200):
        o = [(order(i), s) for i, s in SALE_ORDERS if until - 200 < s <= until]
        l = [(line(i, oid), s) for i, oid, s in SALE_LINES if (until - 200 < s or until == 800) and s <= until]
        orders.send(*(o or [(order("filler"), until)]))
        lines.send(*(l or [(line("filler", "x"), until)]))
    return orders, lines


def test_sale_join_at_the_time_limits_in_stream_and_batch(spark, paths, feed):
    orders, lines = fill_sales(feed)
    users = feed("users")
    users.send(({"id": "u1", "birthday": "1990-01-01", "gender": "M", "user_level": "1"}, 0))
    users.send(({"id": "u1", "birthday": "1990-01-01", "gender": "M", "user_level": "2"}, 1))
    finish(jobs.user_job(users.stream(), paths, once=True))
    finish(jobs.sale_job(orders.stream(), lines.stream(), paths, F.lit("2020-12-31").cast("date"), once=True, delay="500 seconds"))
    stored = tables.sale_table(paths.tables).read(spark).collect()
    assert {(r.order_id, r.order_detail_id) for r in stored} == MATCHED and len(stored) == len(MATCHED)
    assert {(r.user_age, r.user_gender, r.user_level, r.sku_price, r.dt) for r in stored} == {(31, "M", "2", 9.99, "2024-01-01")}

    o = ingest.accepted(ingest.prepare_sale_orders(ingest.decode(orders.batch(), schemas.ORDER, ["id"]))).withColumnRenamed("timestamp", "order_at")
    l = ingest.accepted(ingest.prepare_lines(ingest.decode(lines.batch(), schemas.ORDER_LINE, ["id"]))).withColumnRenamed("timestamp", "line_at")
    batch = joins.merge_sale(joins.late_join(l, o, config.LINE_BEFORE_ORDER_SECONDS, config.LINE_AFTER_ORDER_SECONDS))
    assert sorted((r.order_id, r.order_detail_id) for r in batch.collect()) == sorted(MATCHED)


def test_repeated_order_gives_one_document_with_its_latest_values(spark, paths, feed):
    orders, lines = feed("orders"), feed("lines")
    lines.send((line("l", "o"), 0))
    orders.send((order("o", order_status="old"), 5))
    orders.send((order("o", order_status="new"), 6))
    finish(jobs.sale_job(orders.stream(), lines.stream(), paths, once=True))
    (row,) = tables.sale_table(paths.tables).read(spark).collect()
    assert (row.doc_id, row.order_status, row.user_age, row.user_gender) == ("o:l", "new", 0, None)


def test_sale_state_survives_a_crash_in_the_middle_of_a_batch(spark, paths, feed, monkeypatch):
    orders, lines = feed("orders"), feed("lines")
    lines.send((line("waiting", "o"), 0))
    orders.send((order("other"), 0))
    whole = tables.KeyedTable.upsert

    def run():
        return jobs.sale_job(orders.stream(), lines.stream(), paths, once=True)

    finish(run())
    orders.send((order("o"), 5))
    lines.send((line("with", "o"), 5))

    def write_then_fail(self, rows, batch_id, order=(), writer="batch"):
        whole(self, rows, batch_id, order, writer)
        raise RuntimeError("lost after the write, before the commit")

    monkeypatch.setattr(tables.KeyedTable, "upsert", write_then_fail)
    broken = run()
    with pytest.raises(Exception, match="lost after the write"):
        broken.awaitTermination(120)
    monkeypatch.setattr(tables.KeyedTable, "upsert", whole)
    finish(run())
    stored = tables.sale_table(paths.tables)
    assert sorted(r.doc_id for r in stored.read(spark).collect()) == ["o:waiting", "o:with"]
    assert spark.read.parquet(stored.path).count() == 2


def event(mid, uid, evid, seconds, item="i"):
    return {"type": "event", "mid": mid, "uid": uid, "evid": evid, "itemid": item, "pgid": 3, "ts": ms(seconds)}


EVENTS = [
    ("d1", "a", "coupon", 0), ("d1", "b", "coupon", 10), ("d1", "c", "coupon", 20), ("d1", "c", "addCart", 21),
    ("d2", "a", "coupon", 0), ("d2", "b", "coupon", 10), ("d2", "c", "coupon", 20), ("d2", "c", "clickItem", 21),
    # The view leaves the window while three coupons are still in it.
    ("d3", "x", "clickItem", 0), ("d3", "a", "coupon", 280), ("d3", "b", "coupon", 290), ("d3", "c", "coupon", 299),
    # A null account is one account.
    ("d4", None, "coupon", 0), ("d4", "a", "coupon", 1), ("d4", "b", "coupon", 2),
    ("d5", "a", "coupon", 0), ("d5", "a", "coupon", 1), ("d5", "b", "coupon", 2), (None, "q", "coupon", 3),
]


def test_alerts_in_stream_equal_batch(spark, paths, feed):
    f = feed("events")
    f.send(*[(event(*e), e[3]) for e in EVENTS if e[3] < 100])
    f.send(*[(event(*e), e[3]) for e in EVENTS if e[3] >= 100])
    f.send((event("closing", "z", "addCart", 3600), 3600))
    finish(jobs.alert_job(f.stream(), paths, once=True))
    stored = tables.alert_table(paths.tables).read(spark)
    decoded = ingest.accepted(ingest.decode_logs(f.batch(), schemas.EVENT, ["ts"])).withColumn("at", F.timestamp_millis("ts"))
    batch = alerts.coupon_alerts(decoded, 300, 5, 3)

    def rows(df):
        return sorted((r.doc_id, r.ts, tuple(str(u) for u in r.uids), tuple(r.itemIds), tuple(map(tuple, r.events))) for r in df.collect())

    assert rows(stored) == rows(batch)
    devices = {r.mid for r in batch.collect()}
    assert devices == {"d1", "d3", "d4"}
    whole = [r for r in rows(batch) if r[0].startswith("d1") and r[4] == (("addCart", 1), ("coupon", 3))]
    assert whole and whole[0][2] == ("a", "b", "c")


def test_logs_are_stamped_landed_and_routed(spark, paths, feed, tmp_path):
    f = feed("logs")
    f.send(
        ({"type": "startup", "mid": "a", "ts": 1}, 0), ({"type": "event", "mid": "a", "evid": "coupon", "pgid": 7, "new": {"x": [1, None]}}, 1),
        ({"mid": "b", "ts": "x"}, 2), ("nonsense", 3),
    )
    now = F.lit(ms(42))
    finish(jobs.log_landing_job(f.stream(), paths, now, once=True))
    landed = tables.read_raw_logs(spark, paths.raw_logs).collect()
    assert {r.log_date for r in landed} == {"2024-01-01"} and len(landed) == 3
    assert all(json.loads(r.value)["ts"] == ms(42) for r in landed)
    out = str(tmp_path / "out")
    finish(jobs.log_route_job(f.stream(), lambda df: topics.file_sink(df, out), paths, now, once=True))
    routed = spark.read.json(out).collect()
    assert sorted((r.topic, json.loads(r.value)["mid"]) for r in routed) == [
        (config.TOPIC_EVENT, "a"), (config.TOPIC_EVENT, "b"), (config.TOPIC_LAUNCH, "a"),
    ]
    event_line = [json.loads(r.value) for r in routed if "coupon" in r.value]
    assert event_line == [{"type": "event", "mid": "a", "evid": "coupon", "pgid": 7, "new": {"x": [1, None]}, "ts": ms(42)}]


def change(table, op, *rows, entry_type="ROWDATA"):
    return {
        "entry_type": entry_type, "table": table, "op": op,
        "rows": [[{"name": n, "value": v} for n, v in row] for row in rows],
    }


def test_changes_are_routed_to_their_topics(spark, paths, feed, tmp_path):
    f = feed("changes")
    f.send(
        (change("order_info", "INSERT", [("id", "1"), ("total_amount", "5.5")], [("id", "2")]), 0),
        (change("order_info", "UPDATE", [("id", "3")]), 1),
        (change("user_info", "UPDATE", [("id", "4"), ("gender", "F"), ("gender", "M")]), 2),
        (change("order_detail", "DELETE", [("id", "5")]), 3),
        (change("sku_info", "INSERT", [("id", "6")]), 4),
        (change("order_detail", "INSERT", [("id", "7")], entry_type="TRANSACTIONBEGIN"), 5),
        (change("order_detail", "INSERT", [("id", "8")]), 6),
    )
    out = str(tmp_path / "out")
    finish(jobs.change_route_job(f.stream(), lambda df: topics.file_sink(df, out), paths, once=True))
    got = sorted((r.topic, r.value) for r in spark.read.json(out).collect())
    assert got == [
        (config.TOPIC_ORDER_LINE, '{"id":"8"}'),
        (config.TOPIC_ORDER, '{"id":"1","total_amount":"5.5"}'),
        (config.TOPIC_ORDER, '{"id":"2"}'),
        (config.TOPIC_USER, '{"id":"4","gender":"M"}'),
    ]


def test_stage_counts_are_reported(spark, paths, feed):
    f = feed("launches")
    f.send((launch("a", 0), 0), (launch("a", 1), 1))
    lines = []
    listener = jobs.StageCounts(lines.append)
    spark.streams.addListener(listener)
    try:
        query = finish(jobs.launch_job(f.stream(), paths, once=True))
        counts = {}
        for progress in query.recentProgress:
            for stage, row in progress.observedMetrics.items():
                counts[stage] = counts.get(stage, 0) + row["rows"]
        assert counts == {"launches": 2}
        assert tables.launch_table(paths.tables).read(spark).count() == 1
    finally:
        spark.streams.removeListener(listener)


def test_state_is_dropped_behind_the_watermark(spark, paths, feed):
    f = feed("launches")
    for day in range(6):
        f.send(*[(launch(f"m{i}", day * 86400 + i), day * 86400) for i in range(50)])
    query = finish(jobs.launch_job(f.stream(), paths, once=True))
    last = query.recentProgress[-1]
    assert tables.launch_table(paths.tables).read(spark).count() == 300
    assert all(s.numRowsTotal <= 150 for s in last.stateOperators)


def test_collection_jobs_fill_topics_and_quarantines(spark, paths, feed, tmp_path):
    logs, changed = feed("logs"), feed("changes")
    logs.send(({"type": "startup", "mid": "a"}, 0), ({"type": "event", "mid": "a", "evid": "coupon"}, 1), ("no json", 2))
    row = [[{"name": "id", "value": "7"}]]
    changed.send(
        ({"entry_type": "ROWDATA", "table": "order_info", "op": "INSERT", "rows": row}, 0),
        ({"entry_type": "ROWDATA", "table": "order_info", "op": "DELETE", "rows": row}, 1),
        ("{", 2),
    )
    outs = []

    def sink(rows):
        outs.append(str(tmp_path / f"out{len(outs)}"))
        return topics.file_sink(rows, outs[-1])

    for query in jobs.start_collection(logs.stream(), changed.stream(), sink, paths, once=True):
        finish(query)
    told = [r for out in outs for r in spark.read.schema("value string, topic string").json(out).collect()]
    assert sorted(r.topic for r in told) == sorted([config.TOPIC_LAUNCH, config.TOPIC_EVENT, config.TOPIC_ORDER])
    assert tables.read_raw_logs(spark, paths.raw_logs).count() == 2
    for kind in ("logs", "changes"):
        assert [r.problem for r in spark.read.json(paths.table(f"quarantine/{kind}")).collect()] == ["malformed"]


def test_tables_are_compacted_and_jobs_go_on(spark, paths, feed, tmp_path):
    f = feed("launches")
    for day in range(3):
        f.send(*[(launch(f"m{i}", day * 86_400 + i), day * 86_400) for i in range(5)])
    finish(jobs.launch_job(f.stream(), paths, once=True))
    merged = jobs.compacted(spark, paths, str(tmp_path / "merged"))
    f.send((launch("m0", 0), 300_000), (launch("new", -86_400), 300_000))
    finish(jobs.launch_job(f.stream(), merged, once=True))
    got = [(r.MID, r.LOGDATE) for r in tables.launch_table(merged.tables).read(spark).collect()]
    assert len(got) == len(set(got)) == 16 and ("new", "2023-12-31") in got


def test_rows_behind_a_watermark_are_counted(spark, paths, feed):
    f, counts = feed("launches"), []
    for ages in ((200_000,), (0, 50_000, 150_000)):
        f.send(*[(launch(f"m{s}", s), s) for s in ages])
        timed = jobs.decoded_launches(f.stream()).withColumn("at", F.timestamp_millis("ts"))
        first = dedup.first_launch_stream(timed, "at", "1 day", salts=1)
        writing = first.writeStream.format("noop").option("checkpointLocation", paths.checkpoint("late"))
        counts.append(jobs.late_rows(spark, finish(writing.trigger(availableNow=True).start())).collect())
    assert [sum(r.rows for r in c) for c in counts] == [0, 2]


def test_lines_that_wait_in_vain_are_kept(spark, paths, feed):
    orders, lines = feed("orders"), feed("lines")
    orders.send((order_of("1"), 0))
    lines.send((line_of("a", "1"), 10), (line_of("b", "2"), 11))
    orders.send((order_of("9"), 9000))
    lines.send((line_of("c", "9"), 9001), (line_of("d", "8"), 9002))
    finish(jobs.sale_job(orders.stream(), lines.stream(), paths, once=True))
    assert [r.order_detail_id for r in tables.sale_table(paths.tables).read(spark).orderBy("order_id").collect()] == ["a", "c"]
    assert [(r.order_id, r.id) for r in tables.unmatched_table(paths.tables).read(spark).collect()] == [("2", "b")]


def order_of(order_id):
    return {"id": order_id, "user_id": "u", "total_amount": "1.5", "create_time": "2024-01-01 12:00:00", "consignee_tel": "13812345678"}


def line_of(line_id, order_id):
    return {"id": line_id, "order_id": order_id, "sku_id": "s", "sku_name": "n", "order_price": "2.5", "sku_num": "1"}
