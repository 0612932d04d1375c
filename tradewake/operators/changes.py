"""Database change records: which ones are passed on, where to, and as what."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradewake import config
from tradewake.functions import values

# Table and operations that are passed on, with their topic.
ROUTES = (
    ("order_info", ("INSERT",), config.TOPIC_ORDER),
    ("user_info", ("INSERT", "UPDATE"), config.TOPIC_USER),
    ("order_detail", ("INSERT",), config.TOPIC_ORDER_LINE),
)
ROW_DATA = "ROWDATA"


def change_topic(table: Column, op: Column) -> Column:
    """Topic of a change, or null when it is not passed on."""
    branches = [F.when((table == name) & op.isin(*ops), F.lit(topic)) for name, ops, topic in ROUTES]
    return F.coalesce(*branches)


def route_changes(changes: DataFrame) -> DataFrame:
    """Keep the row-data changes that have a topic, and name it.

    Updates of orders have none, so an order keeps the status it was created with.
    """
    return (
        changes.where(F.col("entry_type") == ROW_DATA)
        .withColumn("topic", change_topic(F.col("table"), F.col("op")))
        .where(F.col("topic").isNotNull())
    )


def after_images(routed: DataFrame) -> DataFrame:
    """One ``(topic, value)`` record per changed row: the JSON object of its columns.

    A repeated name keeps its last value; a column without a name is left out.
    """
    rows = routed.select("topic", F.explode("rows").alias("row"))
    # Put out by a generator, so that what is looked up is not sorted anew each time.
    ordered = rows.select("topic", "row", values.once(values.latest_first(F.col("row"), "name")).alias("ordered"))
    last = values.last_of_each(F.col("row"), F.col("ordered"))
    return ordered.select("topic", F.to_json(F.map_from_entries(last)).alias("value"))
