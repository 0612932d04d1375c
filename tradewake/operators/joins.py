"""Orders, order lines and users.

No broadcast is asked for anywhere: these inputs all grow with the data, and
Spark's measured sizes decide. Each join reads both sides straight from a shuffle
on the join key, the form in which adaptive execution can split a hot key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradewake.functions import times, values
from tradewake.schemas import SALE_DETAIL


def lines_with_orders_outer(lines: DataFrame, orders: DataFrame) -> DataFrame:
    """Full outer join of lines and orders on the order id.

    Columns are ``order_id`` and the structs ``line`` and ``order``, one of them
    null where there is no partner. It is a left join of the lines plus the orders
    that no line names: adaptive execution can split a hot (or null) order id of a
    left join, but not of a full outer join. The second reading of the lines takes
    their order id only.
    """
    o = orders.select(F.col("id").alias("_oid"), F.struct(*orders.columns).alias("order"))
    l = lines.select("order_id", F.struct(*lines.columns).alias("line"))
    with_line = l.join(o, F.col("order_id") == F.col("_oid"), "left").select("order_id", "line", "order")
    used = lines.select(F.col("order_id").alias("_used")).distinct()
    lineless = o.join(used, F.col("_oid") == F.col("_used"), "left_anti")
    return with_line.unionByName(
        lineless.select(F.col("_oid").alias("order_id"), "order"), allowMissingColumns=True
    )


def late_join(
    lines: DataFrame,
    orders: DataFrame,
    before_seconds: int,
    after_seconds: int,
    line_at: str = "line_at",
    order_at: str = "order_at",
) -> DataFrame:
    """Lines with the order of the same id that is close enough in time.

    A line may come up to ``before_seconds`` before its order and up to
    ``after_seconds`` after it, both ends included. Result: the columns of the
    lines, then ``order`` (the order's columns as a struct).

    Where an order is repeated, a line gets the latest of its records that are near
    enough, and comes out once per order. Repeats must not multiply with the lines: time
    is cut into buckets as long as the tolerance, and in its bucket a record holds until
    the next one of its id. The records a line accepts lie in two neighbouring buckets,
    so it meets at most two, of which the later one is taken.
    """
    width = (before_seconds + after_seconds) * 1_000_000
    at = F.unix_micros(F.col(order_at))
    o = orders.where(F.col("id").isNotNull() & F.col(order_at).isNotNull()).select(
        F.col("id").alias("_oid"),
        at.alias("_at"),
        times.bucket_start(at, width).alias("_bucket"),
        F.struct(*orders.columns).alias("order"),
    )
    following = F.lead("_at").over(Window.partitionBy("_oid", "_bucket").orderBy("_at", "order"))
    # Of records of one time, the last one holds.
    held = o.withColumn("_next", following).where("_next is null or _next > _at")
    reach = held.withColumn("_slot", F.explode(F.array("_bucket", F.col("_bucket") + width)))

    lowest = F.unix_micros(F.col(line_at)) - after_seconds * 1_000_000
    highest = F.unix_micros(F.col(line_at)) + before_seconds * 1_000_000
    slotted = lines.where(F.col("order_id").isNotNull()).select(
        F.col("order_id").alias("_order_id"),
        F.col("id").alias("_line_id"),
        F.col(line_at).alias("_line_at"),
        lowest.alias("_lowest"),
        highest.alias("_highest"),
        times.bucket_start(highest, width).alias("_line_slot"),
        F.struct(*lines.columns).alias("line"),
    )
    same = (F.col("_order_id") == F.col("_oid")) & (F.col("_line_slot") == F.col("_slot"))
    near = F.col("_at").between(F.col("_lowest"), F.col("_highest"))
    latest = F.expr("_next is null or _next > _highest")
    met = slotted.join(reach, same & near & latest)
    one = met.groupBy("_order_id", "_line_id").agg(F.max(F.struct("_at", "_line_at", "order", "line")).alias("m"))
    return one.select(*[F.col("m.line").getField(c).alias(c) for c in lines.columns], "m.order")


def late_join_stream(
    lines: DataFrame,
    orders: DataFrame,
    before_seconds: int,
    after_seconds: int,
    since: int,
    until: int,
    line_at: str = "line_at",
    order_at: str = "order_at",
    fresh: str = "fresh",
) -> DataFrame:
    """Streaming form of :func:`late_join`: the rows that a batch adds to the result.

    Both sides hold what is kept from earlier batches and what came with this one, for
    which ``fresh`` is true. Pairs of two earlier rows came out before. A line without an
    order comes out too, with a null ``order``, as soon as no order that is still to come
    can be near enough: when the watermark, ``since`` before this batch and ``until`` after
    it (in microseconds), has passed all times of an order that the line accepts.
    """
    own = [c for c in orders.columns if c != fresh]
    o = orders.select(
        F.col("id").alias("_oid"),
        F.col(order_at).alias("_at"),
        F.col(fresh).alias("_fresh_order"),
        F.struct(*own).alias("order"),
    )
    near = F.col("_at").between(
        F.col(line_at) - F.expr(f"interval {after_seconds} seconds"),
        F.col(line_at) + F.expr(f"interval {before_seconds} seconds"),
    )
    last = F.unix_micros(F.col(line_at)) + before_seconds * 1_000_000
    given_up = (last <= until) & (F.col(fresh) | (last > since))
    met = lines.join(o, (F.col("order_id") == F.col("_oid")) & near, "left")
    new = met.where(F.when(F.col("_oid").isNull(), given_up).otherwise(F.col(fresh) | F.col("_fresh_order")))
    return new.select(*[c for c in lines.columns if c != fresh], "order")


def with_users(rows: DataFrame, users: DataFrame, as_of: Column) -> DataFrame:
    """Add ``user_gender``, ``user_age`` and ``user_level`` by ``user_id``.

    A row whose user is unknown keeps age 0 and null gender and level; so does
    the age of a user whose birthday is absent or no date.
    """
    u = users.select(
        F.col("id").alias("_uid"),
        F.col("gender").alias("user_gender"),
        values.age_in_years(F.col("birthday"), as_of).alias("_age"),
        F.col("user_level"),
    )
    return (
        rows.join(u, F.col("user_id") == F.col("_uid"), "left")
        .withColumn("user_age", F.coalesce("_age", F.lit(0)))
        .drop("_uid", "_age")
    )


def user_ids(rows: DataFrame) -> DataFrame:
    """The ids of the users that a batch of rows needs."""
    return rows.select(F.col("user_id").alias("id")).where(F.col("id").isNotNull()).distinct()


def merge_sale(matched: DataFrame, *more: Column) -> DataFrame:
    """The order and line columns of a sale, from a line with its ``order`` struct."""
    return matched.select(
        F.col("id").alias("order_detail_id"),
        F.col("order.id").alias("order_id"),
        F.col("order.order_status").alias("order_status"),
        F.col("order.create_time").alias("create_time"),
        F.col("order.user_id").alias("user_id"),
        "sku_id",
        "sku_price",
        "sku_name",
        F.col("order.create_date").alias("dt"),
        *more,
    )


def sale_columns(sales: DataFrame) -> DataFrame:
    """The twelve columns of the sale table, in order."""
    return sales.select(*SALE_DETAIL.names)


def sale_detail(lines: DataFrame, orders: DataFrame, users: DataFrame, as_of: Column) -> DataFrame:
    """Batch form of the sale table: every line that has an order, with its user.

    The user is added to the orders first. Orders are the smaller side, so the
    lines, by far the largest input, are shuffled once instead of twice.
    """
    o = with_users(
        orders.select("id", "order_status", "create_time", "user_id", F.col("create_date").alias("dt")),
        users,
        as_of,
    ).withColumnRenamed("id", "order_id")
    l = lines.select(
        F.col("id").alias("order_detail_id"), F.col("order_id"), "sku_id", "sku_price", "sku_name"
    )
    return sale_columns(l.join(o, "order_id"))
