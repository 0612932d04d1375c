"""The stored inverted index of the sale table, a folder for each day."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradewake.functions import values
from tradewake.operators import relevance
from tradewake.sources.tables import KeyedTable

_POSTINGS = "word string, doc_id string, n long, length long, dt string"
_SIZES = "docs long, words long, dt string"


@dataclass(frozen=True)
class SaleIndex:
    """Postings sorted by word, and the size of every day, below ``path``."""

    path: str

    def refresh(self, sales: KeyedTable, spark: SparkSession, days: Iterable[str] | None = None) -> None:
        """Index the given days of the sale table anew, or all of them.

        A day is replaced whole, so changed and repeated sales leave nothing behind.
        Other days stay as they are.
        """
        rows = sales.read(spark, days=days) if days is not None else sales.read(spark)
        words = relevance.postings(rows)
        # By ranges, so that a word of most documents is no burden to one task and files
        # tell by their statistics which words they hold.
        sorted_ = words.repartitionByRange("dt", "word", "doc_id").sortWithinPartitions("dt", "word")
        self._replace(sorted_, "postings")
        self._replace(relevance.day_sizes(rows).hint("rebalance"), "sizes")

    def _replace(self, rows: DataFrame, name: str) -> None:
        writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy("dt").parquet(f"{self.path}/{name}")

    def postings(self, spark: SparkSession) -> DataFrame:
        """``word, doc_id, n, length, dt`` of all indexed days."""
        return spark.read.schema(_POSTINGS).parquet(f"{self.path}/postings")

    def sizes(self, spark: SparkSession) -> DataFrame:
        """``docs, words, dt`` of all indexed days."""
        return spark.read.schema(_SIZES).parquet(f"{self.path}/sizes")

    def ranked(self, spark: SparkSession, day: str, keyword: str) -> DataFrame:
        """``dt, doc_id, score`` of the day's sales that hold every word of the keyword.

        Of the index, only the postings of these words on this day are read.
        """
        words = spark.range(1).select(F.explode(F.array_distinct(values.tokens(F.lit(keyword or "")))))
        of_day = F.col("dt") == day
        found = self.postings(spark).where(of_day & F.col("word").isin([r[0] for r in words.collect()]))
        return relevance.ranked(found, self.sizes(spark).where(of_day), keyword)
