"""Operators on tiny frames with the edge cases of each."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tradewake import config, schemas
from tradewake.functions import times, values
from tradewake.operators import alerts, changes, dedup, ingest, joins, metrics, search
from tradewake.plans import reports
from tradewake.sources import sql_reports, tables, topics


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*(columns or df.columns)).collect())


# --- functions ---------------------------------------------------------------


@pytest.mark.parametrize(
    "tel, order_mask, sale_mask",
    [
        ("13812345678", "1381****5678", "1381****678"),
        ("1381234", "1381****", None),
        ("13812345", "1381****5", "1381****"),
        ("138123", None, None),
        (None, None, None),
    ],
)
def test_phone_masks(spark, tel, order_mask, sale_mask):
    t = F.lit(tel).cast("string")
    assert one(spark, values.mask_order_phone(t), values.mask_sale_phone(t)) == (order_mask, sale_mask)


@pytest.mark.parametrize(
    "born, as_of, age",
    [
        ("1990-01-01", "2020-12-31", 31),
        ("2020-01-01", "2020-12-30", 0),
        ("2020-01-01", "2020-12-31", 1),
        ("2021-06-01", "2020-12-31", 0),
        ("2025-12-31", "2020-12-31", -5),
        ("no date", "2020-12-31", None),
        (None, "2020-12-31", None),
    ],
)
def test_age_counts_years_of_365_days(spark, born, as_of, age):
    assert one(spark, values.age_in_years(F.lit(born).cast("string"), F.lit(as_of))) == (age,)


@pytest.mark.parametrize("part, total, share", [(1, 3, 33.3), (2, 3, 66.7), (1, 2000, 0.1), (0, 0, 0.0), (5, 5, 100.0)])
def test_share_rounds_half_up(spark, part, total, share):
    assert one(spark, values.share_of(F.lit(part), F.lit(total))) == (share,)


def test_rest_of_hundred(spark):
    assert one(spark, values.rest_of_hundred(F.lit(33.3), F.lit(33.3))) == (33.4,)


def test_tokens_keep_all_scripts(spark):
    assert one(spark, values.tokens(F.lit("小米 Note-3, (Pro)"))) == (["小米", "note", "3", "pro"],)
    assert one(spark, values.tokens(F.lit("")), values.tokens(F.lit(None).cast("string"))) == ([], [])


def test_times(spark):
    assert one(spark, times.day_of_millis(F.lit(0)), times.hour_of_millis(F.lit(3_600_000))) == ("1970-01-01", "01")
    text = F.lit("2020-02-03 04:05:06")
    assert one(spark, times.day_of_text(text), times.hour_of_text(text)) == ("2020-02-03", "04")
    assert one(spark, times.day_of_text(F.lit("2020")), times.hour_of_text(F.lit("2020"))) == (None, None)
    assert times.previous_day("2024-03-01") == "2024-02-29"


def test_document_names(spark):
    at = F.lit(dt.datetime(2020, 1, 2, 3, 4, 5))
    assert one(
        spark,
        values.sale_document_id(F.lit("1"), F.lit("2")),
        values.alert_document_id(F.lit("mid_1"), at),
        values.dated_name("sales", at),
    ) == ("1:2", "mid_1-03:04", "sales-2020-01-02")


# --- ingestion ---------------------------------------------------------------


def records(spark, *texts):
    return spark.createDataFrame([(t,) for t in texts], "value string")


def test_decode_coerces_and_reports_problems(spark):
    got = ingest.decode(
        records(
            spark,
            '{"id": 7, "total_amount": "12.5", "unknown": 1}',
            '{"id": "8", "total_amount": 3}',
            '{"id": "9", "total_amount": "x"}',
            '{"total_amount": 1}',
            "{broken",
            None,
        ),
        schemas.ORDER,
        ["id"],
    )
    assert rows(ingest.accepted(got), "id", "total_amount") == [("7", 12.5), ("8", 3.0)]
    problems = [r.problem for r in ingest.quarantined(got).collect()]
    assert sorted(problems) == ["bad total_amount", "malformed", "malformed", "missing id"]


def test_nested_ids_of_the_event_log_become_text(spark):
    got = ingest.decode_logs(records(spark, '{"mid":"m","pgid":12,"itemid":3,"ts":0}'), schemas.EVENT, ["ts"])
    assert rows(got, "pgid", "itemid", "logDate", "logHour") == [("12", "3", "1970-01-01", "00")]


def test_routing_is_null_safe(spark):
    df = spark.createDataFrame([("startup",), ("event",), (None,)], "type string")
    got = ingest.route_logs(df, "L", "E").select("topic").collect()
    assert [r.topic for r in got] == ["L", "E", "E"]


def test_stamp_uses_the_query_clock_by_default(spark):
    before = int(dt.datetime.now().timestamp() * 1000)
    (ts,) = ingest.stamp(records(spark, '{"mid":"m"}')).select("ts").first()
    assert before - 1000 <= ts <= before + 60_000


def test_stamp_keeps_every_field_and_replaces_ts(spark):
    got = ingest.stamp(
        records(spark, '{"ts":1,"type":"a","type":"startup","pgid":7,"more":{"ts":2}}', "[1]", None), F.lit(42)
    )
    (row,) = ingest.accepted(got).collect()
    assert (row.type, row.pgid, row.mid, row.ts) == ("startup", "7", None, 42)
    assert row.line == '{"type":"startup","pgid":7,"more":{"ts":2},"ts":42}'
    assert [r.problem for r in ingest.quarantined(got).collect()] == ["malformed"] * 2


def test_change_routes(spark):
    cases = {
        ("order_info", "INSERT"): config.TOPIC_ORDER,
        ("order_info", "UPDATE"): None,
        ("user_info", "INSERT"): config.TOPIC_USER,
        ("user_info", "UPDATE"): config.TOPIC_USER,
        ("user_info", "DELETE"): None,
        ("order_detail", "INSERT"): config.TOPIC_ORDER_LINE,
        ("order_detail", "UPDATE"): None,
        ("other", "INSERT"): None,
    }
    df = spark.createDataFrame([(t, o) for t, o in cases], "table string, op string")
    got = {(r.table, r.op): r.topic for r in df.withColumn("topic", changes.change_topic(F.col("table"), F.col("op"))).collect()}
    assert got == cases


def test_after_image_keeps_last_of_equal_names(spark):
    def image(*pairs):
        kind = "topic string, rows array<array<struct<name: string, value: string>>>"
        return changes.after_images(spark.createDataFrame([("t", [list(pairs)])], kind)).first().value

    assert image(("a", "1"), ("b", "2"), ("a", "3"), (None, "4"), (None, "5")) == '{"b":"2","a":"3"}'
    assert image() == "{}"
    many = [(f"n{i % 700}", str(i)) for i in range(20_000)]
    assert json.loads(image(*many)) == {f"n{i % 700}": str(i) for i in range(20_000)}


# --- dedup -------------------------------------------------------------------

LAUNCH = "mid string, uid string, ts bigint"
DAY_MS = 86_400_000


def launches(spark, *data):
    return ingest.with_log_time(spark.createDataFrame(list(data), LAUNCH))


def test_first_launch_is_per_device_and_day(spark):
    got = dedup.first_launch_of_day(
        launches(spark, ("a", "2", 50), ("a", "1", 50), ("a", "x", 60), ("a", "y", DAY_MS - 1), ("a", "z", DAY_MS), (None, "n", 5), (None, "m", 6))
    )
    got = sorted(((r.mid or "", r.uid, r.ts) for r in got.collect()))
    assert got == [("", "n", 5), ("a", "1", 50), ("a", "z", DAY_MS)]


def test_seen_devices_are_dropped_for_their_day_only(spark):
    seen = launches(spark, ("a", "s", 0), ("a", "s", 1)).select("mid", "logDate")
    new = launches(spark, ("a", "1", 10), ("a", "2", DAY_MS + 1), ("b", "3", 5))
    assert rows(dedup.first_launch_not_seen(new, seen), "mid", "uid") == [("a", "2"), ("b", "3")]


def test_latest_user_by_time_then_offset(spark):
    df = spark.createDataFrame([("1", "old", 1, 9), ("1", "new", 2, 1), ("1", "newest", 2, 2)], "id string, login_name string, timestamp int, offset int")
    assert rows(dedup.latest_users(df), "login_name") == [("newest",)]


# --- joins -------------------------------------------------------------------


def test_outer_join_keeps_both_sides(spark):
    lines = spark.createDataFrame([("l1", "1"), ("l2", "1"), ("l3", "9"), ("l4", None)], "id string, order_id string")
    orders = spark.createDataFrame([("1", "u"), ("2", "u"), (None, "u")], "id string, user_id string")
    got = joins.lines_with_orders_outer(lines, orders).select("order_id", "line.id", F.col("order.id").alias("oid"))
    assert sorted(map(str, got.collect())) == sorted(
        map(str, lines.join(orders.toDF("oid", "u"), F.col("order_id") == F.col("oid"), "full_outer").select(
            F.coalesce("order_id", "oid").alias("order_id"), "id", "oid").collect())
    )


def test_late_join_equals_brute_force_with_repeated_orders(spark):
    base = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)

    def at(s):
        return base + dt.timedelta(seconds=s)

    orders = [(str(i % 3), s) for i in range(3) for s in (0, 1, 350, 399, 400, 800, 1600 + 37 * i)]
    lines = [(f"l{i}-{s}", str(i % 4), s) for i in range(4) for s in range(-700, 2500, 23)]
    o = spark.createDataFrame([(i, at(s)) for i, s in orders], "id string, order_at timestamp")
    l = spark.createDataFrame([(i, oid, at(s)) for i, oid, s in lines], "id string, order_id string, line_at timestamp")
    got = rows(joins.late_join(l, o, 300, 100).select("id", F.unix_seconds("order.order_at").alias("s")), "id", "s")
    near = {
        i: [t for other, t in orders if oid == other and s - 100 <= t <= s + 300] for i, oid, s in lines
    }
    assert got == sorted((i, int(at(max(ts)).timestamp())) for i, ts in near.items() if ts)


def test_late_join_ends_are_included(spark):
    base = dt.datetime(2024, 1, 1, 0, 0, 0, 100001, tzinfo=dt.timezone.utc)
    l = spark.createDataFrame(
        [(str(s), "o", base + dt.timedelta(seconds=s)) for s in (699, 700, 1000, 1100, 1101)],
        "id string, order_id string, line_at timestamp",
    )
    o = spark.createDataFrame([("o", base + dt.timedelta(seconds=1000))], "id string, order_at timestamp")
    assert rows(joins.late_join(l, o, 300, 100), "id") == [("1000",), ("1100",), ("700",)]


def test_missing_user_keeps_defaults(spark):
    sales = spark.createDataFrame([("1", "a"), ("2", "b"), ("3", "c"), ("4", None)], "order_id string, user_id string")
    users = spark.createDataFrame(
        [("a", "1990-01-01", "M", "2"), ("c", "broken", "F", "1")], "id string, birthday string, gender string, user_level string"
    )
    got = joins.with_users(sales, users, F.lit("2020-12-31")).select("order_id", "user_gender", "user_age", "user_level").orderBy("order_id")
    assert [tuple(r) for r in got.collect()] == [("1", "M", 31, "2"), ("2", None, 0, None), ("3", "F", 0, "1"), ("4", None, 0, None)]
    assert rows(joins.user_ids(sales)) == [("a",), ("b",), ("c",)]


# --- alerts ------------------------------------------------------------------

EVENT = "mid string, uid string, itemid string, evid string, at timestamp"


def brute_alerts(data, window, slide, threshold):
    found = {}
    for mid in {d[0] for d in data}:
        mine = [d for d in data if d[0] == mid]
        starts = {s for d in mine for s in range((d[4] // slide) * slide - window + slide, d[4] + 1, slide)}
        for start in starts:
            inside = [d for d in mine if start <= d[4] < start + window]
            coupons = [d for d in inside if d[3] == "coupon"]
            if len({d[1] for d in coupons}) >= threshold and not any(d[3] == "clickItem" for d in inside):
                end = start + window
                key = (mid, end // 60)
                if key not in found or found[key][0] < end:
                    found[key] = (end, sorted({str(d[1]) for d in coupons}), sorted({d[2] for d in coupons}), sorted(d[3] for d in inside))
    return sorted((mid or "", *v) for (mid, _), v in found.items())


def _unrolled(events):
    return sorted(e.evid for e in events for _ in range(e.n))


def test_alerts_equal_brute_force(spark, tmp_path):
    import random

    rnd = random.Random(7)
    kinds = ["coupon"] * 6 + ["addCart", "addComment", "clickItem"]
    data = [
        (f"m{rnd.randrange(4)}", rnd.choice(["a", "b", "c", "d", None]), f"i{rnd.randrange(5)}", rnd.choice(kinds), rnd.randrange(0, 4000))
        for _ in range(260)
    ]
    base = dt.datetime(1970, 1, 2, tzinfo=dt.timezone.utc)
    df = spark.createDataFrame([(*d[:4], base + dt.timedelta(seconds=d[4])) for d in data], EVENT)
    got = alerts.coupon_alerts(df, 300, 5, 3, scratch=str(tmp_path / "buckets"))
    assert sorted(map(str, got.drop("events").collect())) == sorted(map(str, alerts.coupon_alerts(df, 300, 5, 3).drop("events").collect()))
    got = sorted(
        (r.mid, r.ts // 1000 - 86400, sorted(str(u) for u in r.uids), list(r.itemIds), _unrolled(r.events)) for r in got.collect()
    )
    want = brute_alerts(data, 300, 5, 3)
    assert want and got == want


def test_window_has_to_fit_the_slide(spark):
    with pytest.raises(ValueError):
        alerts.window_state(spark.createDataFrame([], EVENT), 300, 7)


# --- figures -----------------------------------------------------------------


def test_amount_is_null_without_orders_and_exact_with(spark):
    orders = spark.createDataFrame([("2020-01-01", "00", 0.1)] * 3, "create_date string, create_hour string, total_amount double")
    assert metrics.amount_of_day(orders, "2020-01-01").first()[0] == 0.3
    assert metrics.amount_of_day(orders, "2020-01-02").first()[0] is None


def test_hours_are_filled(spark):
    first = launches(spark, ("a", "u", DAY_MS + 1), ("b", "u", 7_200_000))
    got = metrics.compare_active_hours(first, "1970-01-02").orderBy("hour").collect()
    assert [r.hour for r in got] == times.hours_of_day()
    assert [(r.hour, r.yesterday, r.today) for r in got if r.yesterday or r.today] == [("00", 0, 1), ("02", 1, 0)]


def test_cards_of_an_empty_day(spark):
    orders = spark.createDataFrame([], "create_date string, total_amount double")
    got = metrics.kpi_cards(launches(spark, ("a", "u", 1)), orders, "2020-01-01").collect()
    assert {r.id: r.value for r in got} == {"dau": 0.0, "new_mid": 0.0, "order_amount": None}
    assert {r.name for r in got} == set(config.CARD_NAMES.values())


def test_hour_report_shapes(spark):
    first = launches(spark, ("a", "u", DAY_MS + 1), ("b", "u", 7_200_000))
    orders = spark.createDataFrame([("1970-01-02", "05", 2.5)], "create_date string, create_hour string, total_amount double")
    ask = lambda kind: json.loads(reports.realtime_hours(first, orders, kind, "1970-01-02").first().json)
    assert ask("dau") == {"yesterday": {"02": 1}, "today": {"00": 1}}
    assert ask("order_amount") == {"yesterday": {}, "today": {"05": 2.5}}
    assert ask("anything") == {"yesterday": {}, "today": {}}


def test_sql_texts_over_wide_tables(spark):
    wide = tables.upper_case(launches(spark, ("a", "u", 1), ("b", "u", 3_600_000), ("c", "u", DAY_MS)))
    assert sql_reports.run(sql_reports.ACTIVE_TOTAL, "1970-01-01", launches=wide).first().ct == 2
    assert rows(sql_reports.run(sql_reports.ACTIVE_BY_HOUR, "1970-01-01", launches=wide)) == [("00", 1), ("01", 1)]


# --- search ------------------------------------------------------------------


def sales(spark):
    data = [
        ("1", "o1", "blue ring", 10, "M"), ("2", "o1", "Blue-Steel ring", 25, "F"), ("3", "o2", "blueish ring", 40, None),
        ("4", "o3", "ring blue large", 30, "M"), ("5", "o4", "blue", 19, "M"), ("6", "o5", "小米 blue", 0, None),
    ]
    df = spark.createDataFrame(
        [(i, o, "1001", "2020-01-01 00:00:00", "u", "s", g, a, "1", 1.5, n, "2020-01-01") for i, o, n, a, g in data], schemas.SALE_DETAIL
    )
    return df


@pytest.mark.parametrize(
    "keyword, ids",
    [
        ("blue", {"1", "2", "4", "5", "6"}),
        ("RING blue", {"1", "2", "4"}),
        ("", {"1", "2", "3", "4", "5", "6"}),
        (" - ", {"1", "2", "3", "4", "5", "6"}),
        ("小米", {"6"}),
        ("none", set()),
    ],
)
def test_keyword_needs_every_word(spark, keyword, ids):
    assert {r.order_detail_id for r in search.hits(sales(spark), "2020-01-01", keyword).collect()} == ids


def test_a_sale_without_a_name_is_found_without_a_keyword(spark):
    nameless = sales(spark).limit(1).withColumn("sku_name", F.lit(None).cast("string"))
    assert search.page(search.hits(nameless, "2020-01-01"), "", 1, 5).count() == 1
    assert search.hits(nameless, "2020-01-01", "blue").count() == 0


def test_pages_are_in_order_and_end(spark):
    found = search.hits(sales(spark), "2020-01-01", "blue")
    ids = lambda n: [r.order_detail_id for r in search.page(found, "blue", n, 2).collect()]
    assert (ids(1), ids(2), ids(3), ids(4)) == (["5", "1"], ["6", "2"], ["4"], [])
    with pytest.raises(ValueError):
        search.page(found, "blue", 0, 2)


def test_breakdowns(spark):
    found = search.hits(sales(spark), "2020-01-01", "blue")
    assert search.total(found).first().total == 5
    assert [tuple(r) for r in search.gender_terms(found).collect()] == [("M", 3), ("F", 1)]
    assert [tuple(r) for r in search.age_terms(found, 2).collect()] == [(0, 1), (10, 1)]
    assert {r.name: r.value for r in search.age_share(found).collect()} == {
        config.AGE_UNDER_20: 60.0, config.AGE_FROM_30: 20.0, config.AGE_20_TO_30: 20.0,
    }
    assert {r.name: r.value for r in search.gender_share(found).collect()} == {config.GENDER_MALE: 60.0, config.GENDER_FEMALE: 40.0}


def test_shares_without_hits(spark):
    found = search.hits(sales(spark), "1999-01-01", "blue")
    assert [r.value for r in search.age_share(found).collect()] == [0.0, 0.0, 100.0]
    assert [r.value for r in search.gender_share(found).collect()] == [0.0, 100.0]


def test_report_has_total_breakdown_and_page(spark):
    got = json.loads(reports.sale_detail(sales(spark), "2020-01-01", 2, 2, "blue").first().json)
    assert got["total"] == 5
    assert [s["title"] for s in got["stat"]] == [config.AGE_TITLE, config.GENDER_TITLE]
    assert [d["order_detail_id"] for d in got["detail"]] == ["6", "2"]
    assert got["detail"][1]["user_age"] == 25
    past = json.loads(reports.sale_detail(sales(spark), "2020-01-01", 9, 2, "blue").first().json)
    assert (past["total"], past["detail"]) == (5, [])
    none = json.loads(reports.sale_detail(sales(spark), "2020-01-02", 1, 2, "blue").first().json)
    assert (none["total"], none["detail"]) == (0, [])


# --- tables ------------------------------------------------------------------


def test_upsert_is_idempotent_and_last_write_wins(spark, tmp_path):
    store = tables.user_table(str(tmp_path / "users"))
    with pytest.raises(ValueError, match="no table"):
        store.read(spark)
    assert store.create(spark).read(spark).count() == 0
    user = lambda i, level: (i, "n", level, "1990-01-01", "M")
    frame = lambda *users: spark.createDataFrame(list(users), schemas.USER)
    store.upsert(frame(user("1", "a"), user("2", "a")), 0)
    store.upsert(frame(user("1", "b")), 1)
    store.upsert(frame(user("1", "b")), 1)
    assert rows(store.read(spark), "id", "user_level") == [("1", "b"), ("2", "a")]
    merged = store.compact(spark, str(tmp_path / "merged"))
    merged.upsert(frame(user("2", "c")), 2)
    assert rows(merged.read(spark), "id", "user_level") == [("1", "b"), ("2", "c")]


def test_wanted_keys_are_filtered_before_the_shuffle(spark, tmp_path):
    store = tables.user_table(str(tmp_path))
    users = spark.range(1000).select(
        F.col("id").cast("string").alias("id"), *[F.lit("x").alias(c) for c in schemas.USER.names[1:]]
    )
    store.upsert(users, 0)
    store.upsert(users.where("id < '2'").withColumn("user_level", F.lit("new")), 1)
    wanted = spark.createDataFrame([("1",), ("5",), ("none",)], "id string").persist()
    assert wanted.count() == 3
    got = store.read(spark, wanted=wanted)
    assert rows(got, "id", "user_level") == [("1", "new"), ("5", "x")]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Exchange hashpartitioning") < plan.index("BroadcastHashJoin")
    wanted.unpersist()


def test_day_filter_reads_one_partition(spark, tmp_path):
    store = tables.sale_table(str(tmp_path))
    docs = sales(spark).withColumn("doc_id", F.col("order_detail_id"))
    store.upsert(docs.unionByName(docs.withColumn("dt", F.lit("2020-01-02"))), 0)
    one_day = store.read(spark, "2020-01-02")
    plan = one_day._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(dt,2020-01-02)" in plan
    assert all("part=2020-01" in f for f in one_day.inputFiles())
    assert one_day.count() == store.read(spark).where("dt = '2020-01-02'").count() == 6
    assert store.read(spark, "1999-01-02").count() == 0


def test_topic_sinks_and_sources_name_the_connector(spark):
    stream = spark.readStream.format("rate").load().select(F.lit("t").alias("topic"), F.lit("v").alias("value"))
    assert topics.kafka_sink(stream, "broker:9092") is not None
    try:
        got = topics.kafka_source(spark, "broker:9092", "t")
    except Exception as missing:  # no connector on this classpath
        assert "kafka" in str(missing).lower()
    else:
        assert got.columns == ["value", "timestamp", "offset"]
