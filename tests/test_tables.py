"""Stored tables: source order, buckets, dated targets, launches kept batch by batch, the index."""

import datetime as dt
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tradewake import schemas
from tradewake.operators import joins, metrics, paging, search
from tradewake.sources import launch_store, sale_index, tables


def rows(frame, *columns):
    return sorted(tuple(r) for r in frame.select(*columns).collect())


USER = "id string, login_name string, user_level string, birthday string, gender string, timestamp timestamp, offset long"


def user(i, level, seconds, offset=0):
    at = None if seconds is None else dt.datetime(2024, 1, 1, 0, 0, seconds)
    return (i, "n", level, "1990-01-01", "M", at, offset)


# --- source order ---------------------------------------------------------------


def test_any_order_of_arrival_gives_the_same(spark, tmp_path):
    records = [user("a", f"a{s}{o}", s, o) for s in (1, 3, 2, None) for o in (0, 2, 1)] + [user("b", "b", 1)]
    draw = random.Random(4)
    for trial in range(4):
        draw.shuffle(records)
        store = tables.user_table(str(tmp_path / str(trial)), buckets=3)
        cut = sorted(draw.sample(range(1, len(records)), 2))
        for batch, part in enumerate((records[: cut[0]], records[cut[0] : cut[1]], records[cut[1] :])):
            store.upsert(spark.createDataFrame(part, USER), batch, ["timestamp", "offset"], f"writer{batch % 2}")
        assert rows(store.read(spark), "id", "user_level") == [("a", "a32"), ("b", "b")]
        kept = store.compact(spark, str(tmp_path / f"{trial}c"))
        kept.upsert(spark.createDataFrame([user("a", "old", 2), user("b", "new", 2)], USER), 9, ["timestamp", "offset"])
        assert rows(kept.read(spark), "id", "user_level") == [("a", "a32"), ("b", "new")]


def test_order_has_to_be_times_or_numbers(spark, tmp_path):
    with pytest.raises(ValueError, match="login_name"):
        tables.user_table(str(tmp_path)).upsert(spark.createDataFrame([user("a", "x", 1)], USER), 0, ["login_name"])


# --- buckets ----------------------------------------------------------------------


def test_a_batch_of_ten_users_reads_at_most_ten_buckets(spark, tmp_path):
    store = tables.user_table(str(tmp_path), buckets=64)
    users = spark.range(5000).select(
        F.col("id").cast("string").alias("id"), *[F.lit("x").alias(c) for c in schemas.USER.names[1:]]
    )
    store.upsert(users, 0)
    wanted = spark.range(10).select((F.col("id") * 431).cast("string").alias("user_id"))
    found = store.read(spark, wanted=joins.user_ids(wanted))
    read = {f.split("part=")[1].split("/")[0] for f in found.inputFiles()}
    assert 1 < len(read) <= 10
    assert rows(found, "id") == sorted((str(i * 431),) for i in range(10))
    none = store.read(spark, wanted=joins.user_ids(wanted.where("false")))
    assert none.count() == 0


# --- dated targets ------------------------------------------------------------------


def test_alias_takes_the_newest_run(spark, tmp_path):
    kind = "doc_id string, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schemas.SALE_DETAIL)

    def sale(doc, status):
        return (doc, doc, "o", status, *[None] * 9)

    store = tables.dated_sales(str(tmp_path))
    store.upsert(spark.createDataFrame([sale("x", "second")], kind), "2024-01-03", 5)
    store.upsert(spark.createDataFrame([sale("x", "first"), sale("y", "first")], kind), "2024-01-02", 7)
    store.upsert(spark.createDataFrame([sale("y", "retried")], kind), "2024-01-02", 8)
    got = rows(store.alias(spark), "doc_id", "order_status", "target")
    assert got == [("x", "second", "sale_detail-2024-01-03"), ("y", "retried", "sale_detail-2024-01-02")]
    one = store.alias(spark, ["2024-01-02"])
    assert rows(one, "doc_id", "order_status") == [("x", "first"), ("y", "retried")]
    assert all("target=sale_detail-2024-01-02" in f for f in one.inputFiles())


# --- launches -------------------------------------------------------------------------


def launches(spark, *told):
    made = spark.createDataFrame([(m, d, ts) for m, d, ts in told], "mid string, logDate string, ts long")
    return made.select(*[F.col(f.name) if f.name in made.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schemas.LAUNCH])


def expected(told):
    first, active = {}, set()
    for mid, day, _ in told:
        first[mid] = min(day, first.get(mid, day))
        active.add((mid, day))
    a, n = Counter(d for _, d in active), Counter(first.values())
    return sorted((d, a[d], n[d]) for d in a)


def test_launches_in_any_order_and_with_retries(spark, tmp_path):
    draw = random.Random(7)
    told = [(f"m{draw.randint(0, 30)}", f"2024-01-{draw.randint(1, 9):02}", draw.randint(0, 999)) for _ in range(300)]
    store = launch_store.launch_store(str(tmp_path)).create(spark)
    assert store.figures(spark).count() == 0
    for batch in range(4):
        part = launches(spark, *told[batch::4])
        store.add(part, batch)
        if batch % 2:
            store.add(part, batch)  # a retry
    store.add(launches(spark), 4)  # an empty batch
    assert rows(store.figures(spark), "day", "active", "new") == expected(told)
    assert rows(store.launches.read(spark), "MID", "LOGDATE") == sorted({(m, d) for m, d, _ in told})
    first = {m: min(d for x, d, _ in told if x == m) for m, _, _ in told}
    assert rows(store.devices.read(spark), "mid", "first_day") == sorted(first.items())


def test_a_launch_five_days_late_is_stored_once(spark, tmp_path):
    store = launch_store.launch_store(str(tmp_path)).create(spark)
    store.add(launches(spark, ("a", "2024-01-06", 6), ("b", "2024-01-06", 6)), 0)
    store.add(launches(spark, ("a", "2024-01-01", 1), ("a", "2024-01-06", 1)), 1)
    store.add(launches(spark, ("a", "2024-01-01", 0)), 2)
    assert rows(store.launches.read(spark), "MID", "LOGDATE", "TS") == [
        ("a", "2024-01-01", 1), ("a", "2024-01-06", 6), ("b", "2024-01-06", 6),
    ]
    assert rows(store.figures(spark), "day", "active", "new") == [("2024-01-01", 1, 1), ("2024-01-06", 2, 1)]


def test_cards_read_the_counts_of_their_month_only(spark, tmp_path):
    store = launch_store.launch_store(str(tmp_path)).create(spark)
    store.add(launches(spark, ("a", "2023-12-31", 1), ("a", "2024-01-02", 2), ("b", "2024-01-02", 3)), 0)
    figures = store.figures(spark, "2024-01-02")
    assert figures.inputFiles() and all("launch_counts" in f and "part=2024-01" in f for f in figures.inputFiles())
    orders = spark.createDataFrame([("2024-01-02", 2.5)], "create_date string, total_amount double")
    cards = rows(metrics.kpi_cards_of_counts(figures, orders, "2024-01-02"), "id", "value")
    assert cards == [("dau", 2.0), ("new_mid", 1.0), ("order_amount", 2.5)]


# --- the index ---------------------------------------------------------------------------


def sales(spark, names, day="2024-01-02", first=0):
    made = [(f"d{i:03}", name, day) for i, name in enumerate(names, first)]
    docs = spark.createDataFrame(made, "doc_id string, sku_name string, dt string")
    return docs.select("doc_id", *[
        F.col(f.name) if f.name in ("sku_name", "dt") else F.lit(None).cast(f.dataType).alias(f.name) for f in schemas.SALE_DETAIL
    ])


def bm25(names, keyword):
    docs = {f"d{i:03}": [w for w in (n or "").lower().replace(",", " ").split()] for i, n in enumerate(names)}
    size, total = len(docs), sum(map(len, docs.values()))
    out = []
    for doc, words in docs.items():
        score = 0.0
        for w in set(keyword.lower().split()):
            df = sum(w in x for x in docs.values())
            n = words.count(w)
            rarity = math.log(1 + (size - df + 0.5) / (df + 0.5))
            score += rarity * n / (n + 1.2 * (0.25 + 0.75 * len(words) * size / total)) if n else -math.inf
        if score > -math.inf and keyword.split():
            out.append((doc, round(score, 6)))
    return sorted(out)


NAMES = ["Blue rod", "blue blue widget", "BLUE", "red rod, long and heavy and old", "rod blue rod blue x", None, "", "rod"] * 3


@pytest.mark.parametrize("keyword", ["blue", "rod Blue", "blue blue", "none", ""])
def test_scores_are_those_of_bm25(spark, tmp_path, keyword):
    store = tables.sale_table(str(tmp_path / "sales"))
    store.upsert(sales(spark, NAMES), 0)
    index = sale_index.SaleIndex(str(tmp_path / "index"))
    index.refresh(store, spark)
    assert rows(index.ranked(spark, "2024-01-02", keyword), "doc_id", "score") == bm25(NAMES, keyword)
    assert index.ranked(spark, "2020-01-01", keyword).count() == 0


def test_a_day_indexed_anew_forgets_old_words(spark, tmp_path):
    store = tables.sale_table(str(tmp_path / "sales"))
    index = sale_index.SaleIndex(str(tmp_path / "index"))
    store.upsert(sales(spark, ["blue", "red"]).union(sales(spark, ["blue"], "2024-01-03", 7)), 0)
    index.refresh(store, spark)
    store.upsert(sales(spark, ["green"]), 1)
    index.refresh(store, spark, ["2024-01-02"])
    found = lambda day, word: rows(index.ranked(spark, day, word), "doc_id")
    assert found("2024-01-02", "blue") == [] and found("2024-01-02", "green") == [("d000",)]
    assert found("2024-01-03", "blue") == [("d007",)]


def test_a_search_reads_postings_of_its_words_only(spark, tmp_path):
    store = tables.sale_table(str(tmp_path / "sales"))
    store.upsert(sales(spark, NAMES), 0)
    index = sale_index.SaleIndex(str(tmp_path / "index"))
    index.refresh(store, spark)
    plan = index.ranked(spark, "2024-01-02", "blue rod")._jdf.queryExecution().executedPlan().toString()
    assert "In(word, [blue,rod])" in plan and "2024-01-02" in plan.split("PartitionFilters")[1]
    assert "sales/" not in plan


# --- pages ---------------------------------------------------------------------------------


def test_pages_follow_each_other(spark, tmp_path):
    made = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x"), (F.col("id") % 3).alias("y")).repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        kept = paging.sorted_rows(made, [F.desc("y"), F.col("x")], str(tmp_path / "kept"))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    want = sorted(((r.x, r.y) for r in made.collect()), key=lambda r: (-r[1], r[0]))
    assert kept.total == 1000 and len(kept.counts) > 1
    for number, size in ((1, 7), (3, 300), (143, 7), (4, 333), (200, 5), (201, 5), (10_000, 5)):
        page = [(r.x, r.y) for r in kept.page(number, size).collect()]
        assert page == want[(number - 1) * size : number * size]
    files = kept.page(200, 5)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^]]*_range#\d+ = ", files)
    with pytest.raises(ValueError):
        kept.page(0, 5)


def test_pages_of_nothing(spark, tmp_path):
    kept = paging.sorted_rows(spark.range(0), [F.col("id")], str(tmp_path / "none"))
    assert kept.total == 0 and kept.page(1, 5).collect() == []


# --- breakdowns -----------------------------------------------------------------------------


def test_breakdowns_of_no_hits(spark):
    none = sales(spark, []).drop("doc_id")
    got = {(r.part, r.name): r.value for r in search.breakdowns(none).collect()}
    assert {k[0] for k in got} == {"age share", "gender share"}
    assert all(v in (0.0, 100.0) for v in got.values())
    assert search.breakdowns(none)._jdf.queryExecution().optimizedPlan().toString()
