"""Stored sales: what is shuffled for them, and that results stay whole."""

import pytest
from pyspark.sql import functions as F

from tests.test_scale import N, big_data, hot_tables, plan, run  # noqa: F401
from tradewake.operators import dedup, joins
from tradewake.sources import tables


def sale_rows(spark, hot):
    lines, orders = hot
    users = orders.select(F.col("id"), F.lit("1990-01-01").alias("birthday"), F.lit("M").alias("gender"), F.lit("1").alias("user_level"))
    lines = lines.select("id", "order_id", "sku_id", "sku_price", "sku_name")
    sales = joins.sale_detail(lines, orders, users, F.lit("2020-01-01"))
    return sales.withColumn("doc_id", F.concat_ws(":", "order_id", "order_detail_id"))


def test_sales_find_their_latest_where_they_were_joined(spark, hot_tables, tmp_path):  # noqa: F811
    sales = sale_rows(spark, hot_tables)
    store = tables.sale_table(str(tmp_path))
    with big_data(spark):
        n, text = run(dedup.latest_documents(sales, store._group()))
        assert n == N and "SortMergeJoin(skew=true)" in text  # a hot order is still split
        even = sales.where("order_id != '7'")
        assert plan(dedup.latest_documents(even, store._group())).count("Exchange") == plan(even).count("Exchange")


def test_one_batch_is_read_without_a_shuffle_and_two_are_merged(spark, tmp_path):
    store = tables.sale_table(str(tmp_path / "writer=x" / "batch=y"))
    empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in store.schema if f.name not in ("doc_id", "order_id", "dt", "order_status")]
    docs = spark.range(200).select(
        F.concat(F.col("id") % 50, F.lit(":l")).alias("doc_id"), (F.col("id") % 50).cast("string").alias("order_id"),
        F.lit("2020-01-01").alias("dt"), (F.col("id") / 50).cast("int").cast("string").alias("order_status"), *empty,
    )
    store.upsert(docs, 0)
    once = store.read(spark)
    assert "Exchange" not in plan(once)
    assert [r.order_status for r in once.collect()] == ["3"] * 50
    store.upsert(docs.where("order_id < '3'").withColumn("order_status", F.lit("new")), 1)
    twice = store.read(spark).collect()
    assert len(twice) == 50 and {r.order_id for r in twice if r.order_status == "new"} == {r.order_id for r in twice if r.order_id < "3"}
    merged = store.compact(spark, str(tmp_path / "merged"))
    assert "Exchange" not in plan(merged.read(spark)) and sorted(merged.read(spark).collect()) == sorted(twice)
    assert merged._group() == store._group()


def test_streams_do_not_look_up_state_only_to_count_it(spark):
    assert spark.conf.get("spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows") == "false"


def test_a_wrong_path_is_an_error_and_a_table_to_come_is_empty(spark, tmp_path):
    assert tables.sale_table(str(tmp_path)).read(spark).count() == 0
    with pytest.raises(ValueError, match="there is no table"):
        tables.sale_table(str(tmp_path / "wrong")).read(spark)
