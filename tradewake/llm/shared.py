"""Scratch tables, stable row numbers and Arrow settings used by the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tradewake.session import shared_folder

# Rows and bytes in one Arrow batch. Texts average a few kB, so a batch is a few MB; where
# texts are long it has fewer rows, down to one.
BATCH_ROWS = 1000
BATCH_BYTES = 32 << 20


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch of whole texts takes in a task.

    Spark reads these settings when a result is computed, so they stay set in the session.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


class Scratch:
    """Written tables below the cluster's shared folder.

    A step that more than one job reads is written once and read back. That cuts the
    lineage, so a lost executor costs the running tasks only, and it gives the planner
    true sizes, from which it decides on broadcasts.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.folder = shared_folder(spark)

    def save(self, frame: DataFrame, name: str) -> DataFrame:
        path = f"{self.folder}/{name}"
        frame.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(frame.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Remove tables whose readers have all been written."""
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
            path.getFileSystem(conf).delete(path, True)


def numbered(
    scratch: Scratch,
    rows: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    to: str,
    name: str,
    weight: str | None = None,
) -> DataFrame:
    """Number the rows of each group from 0, in ``order``, without gaps.

    With ``weight``, a column of whole numbers, a row's number is the sum of the weights
    before it. No group meets in one task: the rows are dealt by ranges of (group, order),
    each chunk numbers its own part, and the chunks' sums give the first number of each.
    Rows equal in ``order`` are told apart by their place in the input, so a value that
    repeats without end is split as well. Null is a group like any other.
    """
    keys = [*group, *order]
    step = F.col(weight) if weight else F.lit(1)
    placed = scratch.save(
        rows.withColumn("_place", F.monotonically_increasing_id())
        .repartitionByRange(*keys, "_place")
        .withColumn("_chunk", F.spark_partition_id()),
        name,
    )
    part = ["_chunk", *group]
    before = W.partitionBy(*group).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    first = (
        placed.groupBy(*part)
        .agg(F.sum(step).alias("_n"))
        .withColumn("_first", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .select("_first", *[F.col(c).alias(f"_of_{c}") for c in part])
    )
    same = F.lit(True)
    for c in part:
        same = same & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    earlier = W.partitionBy(*part).orderBy(*order, "_place").rowsBetween(W.unboundedPreceding, -1)
    within = F.coalesce(F.sum(step).over(earlier), F.lit(0))
    return (
        placed.withColumn("_within", within)
        .join(first, same)
        .withColumn(to, (F.col("_first") + F.col("_within")).cast("long"))
        .drop("_place", "_chunk", "_first", "_within", *[f"_of_{c}" for c in part])
    )


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def row_mark() -> list[Column]:
    """Two columns that name a document row by its id and its text.

    Rows that agree in both are the same document twice, so whatever holds for one
    holds for the other.
    """
    return [
        F.coalesce(F.col("doc_id"), F.lit(-(2**63))).alias("row_id"),
        F.xxhash64("text").alias("row_mark"),
    ]
