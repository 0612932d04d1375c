"""Dashboard figures over the launch and order tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradewake import config
from tradewake.functions import times

MONEY = "decimal(18,2)"


def money_sum(amount: Column) -> Column:
    """Sum that does not depend on the order of the rows; null over no rows."""
    return F.sum(amount.cast(MONEY)).cast("double")


def daily_active(launches: DataFrame) -> DataFrame:
    """Active devices per day, straight from launches in any state of repetition."""
    return (
        launches.select("logDate", "mid").distinct().groupBy("logDate").agg(F.count(F.lit(1)).alias("dau"))
    )


def active_of_day(first_launches: DataFrame, day: str) -> DataFrame:
    """Number of stored first launches of a day, as one row."""
    return first_launches.where(F.col("logDate") == day).agg(F.count(F.lit(1)).alias("ct"))


def active_by_hour(first_launches: DataFrame, day: str) -> DataFrame:
    """Stored first launches of a day by hour."""
    return (
        first_launches.where(F.col("logDate") == day)
        .groupBy(F.col("logHour").alias("lh"))
        .agg(F.count(F.lit(1)).alias("ct"))
    )


def amount_of_day(orders: DataFrame, day: str) -> DataFrame:
    """Order amount of a day, as one row; null when the day has no orders."""
    return orders.where(F.col("create_date") == day).agg(money_sum(F.col("total_amount")).alias("amount"))


def amount_by_day(orders: DataFrame) -> DataFrame:
    """Order amount of every day."""
    return orders.groupBy("create_date").agg(money_sum(F.col("total_amount")).alias("amount"))


def amount_by_hour(orders: DataFrame, day: str) -> DataFrame:
    """Order amount of a day by hour."""
    return (
        orders.where(F.col("create_date") == day)
        .groupBy("create_hour")
        .agg(money_sum(F.col("total_amount")).alias("sum_amount"))
    )


def compare_hours(rows: DataFrame, day_column: str, hour_column: str, value: Column, day: str) -> DataFrame:
    """24 rows ``(hour, yesterday, today)``; hours without rows are 0.

    Both days come from one scan: the value is added up by hour into the column of
    its day, over two days only.
    """
    before = times.previous_day(day)
    by_hour = (
        rows.where(F.col(day_column).isin(before, day))
        .groupBy(F.col(hour_column).alias("hour"))
        .agg(
            F.sum(F.when(F.col(day_column) == before, value)).alias("yesterday"),
            F.sum(F.when(F.col(day_column) == day, value)).alias("today"),
        )
    )
    grid = rows.sparkSession.range(24).select(F.lpad(F.col("id").cast("string"), 2, "0").alias("hour"))
    return grid.join(by_hour, "hour", "left").na.fill(0, ["yesterday", "today"])


def compare_active_hours(first_launches: DataFrame, day: str) -> DataFrame:
    """Active devices by hour, today beside yesterday."""
    return compare_hours(first_launches, "logDate", "logHour", F.lit(1).cast("bigint"), day)


def compare_amount_hours(orders: DataFrame, day: str) -> DataFrame:
    """Order amount by hour, today beside yesterday."""
    sums = compare_hours(orders, "create_date", "create_hour", F.col("total_amount").cast(MONEY), day)
    return sums.withColumns({c: F.col(c).cast("double") for c in ("yesterday", "today")})


def new_devices(launches: DataFrame) -> DataFrame:
    """Devices per day that launch for the first time ever (an extension)."""
    first = launches.groupBy("mid").agg(F.min("logDate").alias("logDate"))
    return first.groupBy("logDate").agg(F.count(F.lit(1)).alias("new_mid"))


def province_sales(orders: DataFrame) -> DataFrame:
    """Order amount and number by province (an extension)."""
    return orders.groupBy("province_id").agg(
        money_sum(F.col("total_amount")).alias("amount"), F.count(F.lit(1)).alias("orders")
    )


def kpi_cards(launches: DataFrame, orders: DataFrame, day: str) -> DataFrame:
    """The three cards ``(id, name, value)`` of a day.

    ``launches`` is the whole launch history, because a device is new on the first
    day it is ever seen. It is read once for both device cards.
    """
    devices = launches.groupBy("mid").agg(
        F.min("logDate").alias("first"), F.max((F.col("logDate") == day).cast("int")).alias("active")
    )
    counts = devices.agg(
        F.coalesce(F.sum("active"), F.lit(0)).cast("double").alias("dau"),
        F.count_if(F.col("first") == day).cast("double").alias("new_mid"),
    )
    cards = counts.select(
        F.explode(F.array(*[_card(name, F.col(name)) for name in ("dau", "new_mid")])).alias("c")
    ).unionByName(
        amount_of_day(orders, day).select(_card("order_amount", F.col("amount")).alias("c"))
    )
    return cards.select("c.*")


def kpi_cards_of_counts(figures: DataFrame, orders: DataFrame, day: str) -> DataFrame:
    """The same cards from the stored counts ``day, active, new`` of the day.

    No launch is read: neither the day's nor those of earlier days.
    """
    counts = figures.where(F.col("day") == day).agg(
        F.coalesce(F.sum("active"), F.lit(0)).cast("double").alias("dau"),
        F.coalesce(F.sum("new"), F.lit(0)).cast("double").alias("new_mid"),
    )
    devices = F.explode(F.array(*[_card(name, F.col(name)) for name in ("dau", "new_mid")])).alias("c")
    amount = amount_of_day(orders, day).select(_card("order_amount", F.col("amount")).alias("c"))
    return counts.select(devices).unionByName(amount).select("c.*")


def _card(name: str, value: Column) -> Column:
    return F.struct(
        F.lit(name).alias("id"), F.lit(config.CARD_NAMES[name]).alias("name"), value.alias("value")
    )


def stage_counts(launches: DataFrame) -> DataFrame:
    """Rows read and rows kept by the daily dedup, from one pass."""
    per_day = launches.groupBy("mid", "logDate").agg(F.count(F.lit(1)).alias("n"))
    totals = per_day.agg(F.sum("n").alias("launches"), F.count(F.lit(1)).alias("first_launches"))
    return totals.select(F.stack(
        F.lit(2), F.lit("launches"), F.col("launches"), F.lit("first_launches"), F.col("first_launches")
    ).alias("stage", "rows"))


def observed(rows: DataFrame, stage: str) -> DataFrame:
    """Count rows as they pass; listeners and query progress report it under ``stage``."""
    return rows.observe(stage, F.count(F.lit(1)).alias("rows"))
