"""What the sale job keeps between batches: its size, its bounds, and that nothing is lost by it."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tests.test_scale import N, big_data, hot_tables, run  # noqa: F401
from tests.test_streaming import at, feed, finish, line_of, order_of, paths  # noqa: F401
from tradewake.operators import joins
from tradewake.sources import tables, topics
from tradewake.sources.sale_records import SaleRecords
from tradewake.streaming import jobs


def size(folder):
    return sum(f.stat().st_size for f in Path(folder).rglob("*") if f.is_file())


def test_each_record_is_kept_once_and_not_in_a_state_store(spark, paths, tmp_path):  # noqa: F811
    n, id_ = 20_000, F.col("id").cast("string")
    when = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") % 86_400)
    line = F.to_json(F.struct(F.concat(F.lit("l"), id_).alias("id"), id_.alias("order_id"), F.lit("s").alias("sku_id"), F.lit("2.5").alias("order_price")))
    order = F.to_json(F.struct(id_.alias("id"), F.lit("u").alias("user_id"), F.lit("2024-01-01 12:00:00").alias("create_time")))
    for name, value in (("lines", line), ("orders", order)):
        spark.range(n).select(value.alias("value"), when.alias("timestamp"), F.col("id").alias("offset")).write.parquet(str(tmp_path / name))
    streams = [topics.file_source(spark, str(tmp_path / name)) for name in ("orders", "lines")]
    finish(jobs.sale_job(*streams, paths, once=True))
    assert tables.sale_table(paths.tables).read(spark).count() == n
    assert not Path(paths.checkpoint("sales"), "state").exists()
    assert size(paths.checkpoints) < size(tmp_path / "lines") + size(tmp_path / "orders")


def test_batches_give_what_one_join_over_all_gives(spark, paths, feed):  # noqa: F811
    orders, lines, rng = feed("orders"), feed("lines"), random.Random(3)
    all_orders, all_lines = [], []
    for n in range(4):  # orders repeat; both sides come in any order within the delay
        o = [(f"o{rng.randrange(12)}", rng.randrange(500 * n, 500 * n + 700), f"s{n}-{i}") for i in range(8)]
        l = [(f"l{n}-{i}", f"o{rng.randrange(14)}", rng.randrange(500 * n, 500 * n + 700)) for i in range(20)]
        orders.send(*[(order_of(i) | {"order_status": status}, s) for i, s, status in o])
        lines.send(*[(line_of(i, oid), s) for i, oid, s in l])
        all_orders, all_lines = all_orders + o, all_lines + l
    job = finish(jobs.sale_job(orders.stream(), lines.stream(), paths, once=True, delay="700 seconds"))
    near = {l[0]: [o for o in all_orders if o[0] == l[1] and l[2] - 100 <= o[1] <= l[2] + 300] for l in all_lines}
    mark = min(max(o[1] for o in all_orders), max(l[2] for l in all_lines)) - 700
    latest = {(i, max(s for _, s, _ in met)) for i, met in near.items() if met}
    time_of = {status: s for _, s, status in all_orders}
    sales = tables.sale_table(paths.tables).read(spark).collect()
    assert {(r.order_detail_id, time_of[r.order_status]) for r in sales} == latest and len(sales) == len(latest)
    assert all(r.order_id in {o[0] for o in near[r.order_detail_id]} for r in sales)
    lost = {l[0] for l in all_lines if not near[l[0]] and l[2] + 300 <= mark}
    stored = [(r.id, r.order_id) for r in tables.unmatched_table(paths.tables).read(spark).collect()]
    assert lost and sorted(stored) == sorted((l[0], l[1]) for l in all_lines if l[0] in lost)
    assert SaleRecords(paths.checkpoint("sale_records"), 300, 100, "700 seconds").late(spark, job.lastProgress["batchId"], str(job.id)) == 0


def test_late_records_are_counted_and_folders_behind_the_watermark_go(spark, tmp_path):
    records = SaleRecords(str(tmp_path / "records"), 300, 100, "10 seconds")
    kind = "at timestamp, is_order boolean, order struct<id: string>, line struct<id: string, order_id: string>"

    def add(batch_id, *rows):
        made = [(None if s is None else at(s), o, (i,) if o else None, None if o else (i, i)) for s, o, i in rows]
        kept = records.add(spark.createDataFrame(made, kind), batch_id, "w")
        new = joins.late_join_stream(kept.lines, kept.orders, 300, 100, kept.since, kept.until)
        return sorted((r.id, r.order and r.order.id) for r in new.collect())

    def folders():
        return sorted(p.name for p in Path(tmp_path, "records", "writer=w").iterdir())

    assert add(0, (0, False, "a"), (0, False, "b"), (0, True, "c"), (None, False, "c")) == []
    assert add(1, (250, True, "a")) == [("a", "a")]  # from the folder of the first batch
    assert add(1, (250, True, "a")) == [("a", "a")]  # again, as after a crash
    assert add(2, (1000, True, "x"), (1000, False, "x")) == [("b", None), ("x", "x")]
    assert records.late(spark, 2, "w") == 0 and "batch=0" in folders()
    assert add(3, (1000, True, "y"), (990, True, "x"), (991, False, "x")) == [("x", "x")]
    assert records.late(spark, 3, "w") == 1 and folders() == ["batch=2", "batch=3"]
    with pytest.raises(ValueError, match="another job"):
        add(9, (2000, True, "y"))


def test_a_hot_order_of_a_batch_is_split(spark, hot_tables):  # noqa: F811
    lines, orders = hot_tables
    now = F.timestamp_seconds(F.lit(1_700_000_000))
    l = lines.select("id", "order_id", now.alias("line_at"), F.lit(True).alias("fresh"))
    o = orders.select("id", now.alias("order_at"), F.lit(True).alias("fresh"))
    with big_data(spark):
        n, text = run(joins.late_join_stream(l, o, 300, 100, 0, 0))
    assert n == N and "skew=true" in text
