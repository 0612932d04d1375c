"""The three report requests, each answered with one row of JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradewake.functions.times import previous_day
from tradewake.operators import metrics, search
from tradewake.session import shared_folder


def realtime_total(launches: DataFrame, orders: DataFrame, date: str) -> DataFrame:
    """The dashboard cards of a day: ``[{id, name, value}, ...]``."""
    cards = metrics.kpi_cards(launches, orders, date)
    place = F.array_position(F.array(F.lit("dau"), F.lit("new_mid"), F.lit("order_amount")), F.col("id"))
    gathered = cards.agg(F.array_sort(F.collect_list(F.struct(place.alias("p"), F.struct("id", "name", "value").alias("card")))).alias("c"))
    return gathered.select(F.to_json(F.transform("c", lambda x: x["card"])).alias("json"))


def realtime_hours(launches: DataFrame, orders: DataFrame, kind: str, date: str) -> DataFrame:
    """Hour to value, of the day and the day before: ``{yesterday, today}``.

    ``kind`` is ``dau`` or ``order_amount``; anything else answers with two empty
    maps. ``launches`` is the table of first launches.
    """
    before = previous_day(date)
    if kind == "dau":
        rows, value = launches.select(F.col("logDate").alias("day"), F.col("logHour").alias("hour")), F.count(F.lit(1))
    elif kind == "order_amount":
        rows = orders.select(F.col("create_date").alias("day"), F.col("create_hour").alias("hour"), "total_amount")
        value = metrics.money_sum(F.col("total_amount"))
    else:
        rows, value = launches.sparkSession.createDataFrame([], "day string, hour string"), F.count(F.lit(1))
    # Both days from one scan.
    by_hour = rows.where(F.col("day").isin(before, date)).groupBy("day", "hour").agg(value.alias("value"))

    def hours(day: str, name: str):
        entries = F.collect_list(F.when(F.col("day") == day, F.struct("hour", "value")))
        return F.map_from_entries(F.array_sort(entries)).alias(name)

    both = by_hour.agg(hours(before, "yesterday"), hours(date, "today"))
    return both.select(F.to_json(F.struct("yesterday", "today")).alias("json"))


def sale_detail(sales: DataFrame, date: str, page: int, size: int, keyword: str, path: str | None = None) -> DataFrame:
    """Search in the sale table: ``{total, stat, detail}``.

    The hits are read from the table once and kept, in order, in a fresh folder ``path``,
    by default below ``spark.checkpoint.dir``.
    """
    found = search.hits(sales, date, keyword)
    return search.report(search.stored_hits(found, keyword, path or shared_folder(sales.sparkSession)), page, size)
