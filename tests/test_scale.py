"""Plans and results where one key holds a third of all rows."""

from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from tradewake.operators import alerts, dedup, joins, metrics, search
from tradewake.plans.queries import QUERIES
from tradewake.sources import tables

SF = "/root/testdata/sf0.01"
N = 150_000


@contextmanager
def settings(spark, **values):
    names = {k: k.replace("__", ".") for k in values}
    before = {k: spark.conf.get(names[k], None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(names[k], v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(names[k]) if v is None else spark.conf.set(names[k], v)


def big_data(spark):
    """Settings under which the small test data behaves like large data."""
    return settings(
        spark,
        spark__sql__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes="100k",
        spark__sql__adaptive__skewJoin__skewedPartitionFactor="2",
        spark__sql__adaptive__advisoryPartitionSizeInBytes="100k",
        spark__sql__shuffle__partitions="16",
    )


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def run(df):
    """Rows of a result and the plan it was finally run with."""
    counted = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).alias("h"))
    n = counted.collect()[0]["n"]
    return n, plan(counted)


def hot(column, key="7"):
    """A third of the rows get the same key."""
    return F.when(F.col("n") % 3 == 0, F.lit(key)).otherwise(column.cast("string"))


@pytest.fixture(scope="module")
def hot_tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("hot"))
    n = spark.range(N, numPartitions=12).withColumnRenamed("id", "n")
    at = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("n") % 97)
    n.select(
        F.col("n").cast("string").alias("id"), hot(F.col("n") % 20_000).alias("order_id"), F.lit("s").alias("sku_id"),
        F.lit(1.0).alias("sku_price"), F.sha2(F.col("n").cast("string"), 256).alias("sku_name"), at.alias("line_at"),
    ).write.parquet(f"{folder}/lines")
    o = spark.range(20_000).withColumnRenamed("id", "n")
    o.select(
        F.col("n").cast("string").alias("id"), F.lit("1").alias("order_status"), F.lit("2020-01-01 00:00:00").alias("create_time"),
        F.when(F.col("n") % 3 == 0, F.lit("1")).otherwise(F.col("n").cast("string")).alias("user_id"),
        F.lit("2020-01-01").alias("create_date"), F.timestamp_seconds(F.lit(1_700_000_000)).alias("order_at"),
    ).write.parquet(f"{folder}/orders")
    return spark.read.parquet(f"{folder}/lines"), spark.read.parquet(f"{folder}/orders")


def test_hot_order_is_split_in_the_outer_join(spark, hot_tables):
    lines, orders = hot_tables
    with big_data(spark):
        n, text = run(joins.lines_with_orders_outer(lines, orders))
    # The even orders of the residues the hot key displaced have no line.
    lineless = 20_000 - lines.select("order_id").distinct().count()
    assert n == N + lineless
    assert "skew=true" in text and "LeftOuter" in text and "FullOuter" not in text


def test_hot_order_is_split_in_the_late_join(spark, hot_tables):
    lines, orders = hot_tables
    with big_data(spark):
        n, text = run(joins.late_join(lines, orders, 300, 100))
    assert n == N
    assert "SortMergeJoin(skew=true)" in text


def test_repeated_orders_do_not_multiply_with_their_lines(spark, hot_tables):
    lines, orders = hot_tables
    again = orders.where("id = '7'").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(4_999)))).drop("k")
    n, _ = run(joins.late_join(lines, orders.unionByName(again), 300, 100))
    assert n == N


def test_hot_order_is_split_in_the_sale_table(spark, hot_tables):
    lines, orders = hot_tables
    users = orders.select(F.col("id"), F.lit("1990-01-01").alias("birthday"), F.lit("M").alias("gender"), F.lit("1").alias("user_level"))
    lines = lines.select("id", "order_id", "sku_id", "sku_price", "sku_name")
    with big_data(spark):
        n, text = run(joins.sale_detail(lines, orders, users, F.lit("2020-01-01")))
    assert n == N
    assert "SortMergeJoin(skew=true)" in text


def test_first_rows_are_limited_before_the_shuffle(spark):
    launches = spark.range(N).select(
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id")).cast("string").alias("mid"),
        F.lit("2020-01-01").alias("logDate"), F.col("id").alias("ts"),
    )
    first = dedup.first_launch_of_day(launches)
    text = plan(first)
    assert text.index("Partial") > text.index("Exchange") > text.index("Final")
    assert first.count() == 2 * N // 3 + 1


def test_suspects_are_filtered_without_a_shuffle_once_their_size_is_known(spark, tmp_path):
    events = spark.range(N).select(
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 5_000).cast("string").alias("mid"),
        (F.col("id") % 11).cast("string").alias("uid"), F.lit("i").alias("itemid"),
        F.when(F.col("id") % 3 == 0, "coupon").otherwise("addCart").alias("evid"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") % 3_600).alias("at"),
    )
    found = alerts.coupon_alerts(events, 300, 60, 3, scratch=str(tmp_path / "b"))
    assert "BroadcastHashJoin" in plan(found)
    assert {r.mid for r in found.select("mid").collect()} == {"0"}
    with big_data(spark):
        whole = alerts.coupon_alerts(events, 300, 60, 3)
        assert "Broadcast" not in plan(whole)
        assert whole.count() == found.count()


def test_counts_combine_before_the_shuffle(spark):
    for name in ("daily_active", "province_sales", "order_amount_day", "new_devices"):
        text = plan(QUERIES[name](spark, SF))
        assert "partial_" in text or text.count("HashAggregate") >= 2


def test_scans_read_only_the_columns_they_need(spark):
    text = plan(QUERIES["daily_active"](spark, SF))
    assert "ReadSchema: struct<ts:timestamp_ntz,user_id:bigint>" in text
    text = plan(QUERIES["order_amount_day"](spark, SF))
    assert "o_orderpriority" not in text


def test_page_is_taken_without_a_full_sort(spark, tmp_path):
    store = tables.sale_table(str(tmp_path))
    found = search.hits(store.read(spark), "2020-01-01", "x")
    assert "TakeOrderedAndProject" in plan(search.page(found, "x", 3, 10))


def test_no_query_asks_for_a_cross_join(spark):
    for name in ("sale_search_report", "kpi_cards", "realtime_total", "hourly_active_compare", "coupon_window_state", "late_join"):
        text = plan(QUERIES[name](spark, SF))
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_hot_day_is_written_by_several_tasks(spark, tmp_path):
    docs = spark.range(N).select(
        F.col("id").cast("string").alias("doc_id"), F.sha2(F.col("id").cast("string"), 512).alias("sku_name"),
        F.when(F.col("id") % 50 == 0, "2020-01-02").otherwise("2020-01-01").alias("dt"),
    )
    store = tables.sale_table(str(tmp_path))
    for field in store.schema:
        if field.name not in docs.columns:
            docs = docs.withColumn(field.name, F.lit(None).cast(field.dataType))
    with settings(spark, spark__sql__adaptive__advisoryPartitionSizeInBytes="2m"):
        store.upsert(docs, 0)
    files = store.read(spark).inputFiles()
    by_day = {day: sum(f"dt={day}" in f for f in files) for day in ("2020-01-01", "2020-01-02")}
    assert by_day["2020-01-01"] > 2 and by_day["2020-01-02"] <= 2
    assert store.read(spark).count() == N


def test_stage_counts_match(spark):
    launches = spark.range(100).select((F.col("id") % 7).cast("string").alias("mid"), F.lit("d").alias("logDate"))
    assert {tuple(r) for r in metrics.stage_counts(launches).collect()} == {("launches", 100), ("first_launches", 7)}
