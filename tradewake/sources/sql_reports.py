"""Report queries as SQL text with a bound date, over views of the wide tables."""

from __future__ import annotations

from pyspark.sql import DataFrame

ACTIVE_TOTAL = "SELECT count(*) AS ct FROM {launches} WHERE LOGDATE = :date"
ACTIVE_BY_HOUR = """
    SELECT LOGHOUR AS lh, count(*) AS ct FROM {launches} WHERE LOGDATE = :date GROUP BY LOGHOUR
"""
AMOUNT_TOTAL = """
    SELECT cast(sum(cast(TOTAL_AMOUNT AS decimal(18,2))) AS double) AS amount
    FROM {orders} WHERE CREATE_DATE = :date
"""
AMOUNT_BY_HOUR = """
    SELECT CREATE_HOUR AS create_hour,
           cast(sum(cast(TOTAL_AMOUNT AS decimal(18,2))) AS double) AS sum_amount
    FROM {orders} WHERE CREATE_DATE = :date GROUP BY CREATE_HOUR
"""


def run(text: str, date: str, **tables: DataFrame) -> DataFrame:
    """Run a report text. ``{name}`` stands for a table, ``:date`` for the day."""
    spark = next(iter(tables.values())).sparkSession
    return spark.sql(text, args={"date": date}, **tables)
