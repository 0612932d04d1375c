"""First launches, the day each device was first seen, and their counts, batch by batch.

Three tables are kept together. ``launches`` has one row per device and day; a launch that
comes any number of days late is compared with its own day only, so none is lost and no
state grows. ``devices`` has the first day of every device. ``counts`` has what each batch
changed in the number of active and of new devices of a day, so that a figure of a day is
a sum over that day's few rows, whatever the history.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tradewake import schemas
from tradewake.operators import dedup
from tradewake.sources import tables
from tradewake.sources.tables import KeyedTable

DEVICE_BUCKETS = 64

_DEVICE = T.StructType([T.StructField("mid", T.StringType()), T.StructField("first_day", T.StringType())])
_COUNT = T.StructType(
    [
        T.StructField("day", T.StringType()),
        T.StructField("change", T.StringType()),
        T.StructField("active", T.LongType()),
        T.StructField("new", T.LongType()),
    ]
)


@dataclass(frozen=True)
class LaunchStore:
    launches: KeyedTable
    devices: KeyedTable
    counts: KeyedTable

    def create(self, spark: SparkSession) -> LaunchStore:
        for table in (self.launches, self.devices, self.counts):
            table.create(spark)
        return self

    def add(self, batch: DataFrame, batch_id: int, writer: str = "batch") -> None:
        """Store the first launches among ``batch`` (rows of ``schemas.LAUNCH``).

        A retried batch finds the tables as they were before its first try, and writes
        the same again.
        """
        spark, before = batch.sparkSession, (writer, batch_id)
        first = dedup.first_launch_of_day(batch.select(*schemas.LAUNCH.names)).persist()
        try:
            # As many rows as the batch has days.
            days = [r[0] for r in first.select("logDate").distinct().collect()]
            if not days:
                return
            stored = self.launches.read(spark, days=days, before=before)
            fresh = dedup.drop_seen(first, stored.select(F.col("MID").alias("mid"), F.col("LOGDATE").alias("logDate")))
            self.launches.upsert(tables.upper_case(fresh), batch_id, writer=writer)
        finally:
            first.unpersist()
        # Read back: what is new for its day is computed once.
        own = self.launches.batch(spark, batch_id, writer).select(F.col("MID").alias("mid"), F.col("LOGDATE").alias("day"))
        earliest = own.groupBy("mid").agg(F.min("day").alias("day"))
        known = self.devices.read(spark, wanted=earliest, before=before)
        moved = earliest.join(known, "mid", "left").where("first_day is null or day < first_day").persist()
        try:
            # Of two first days the earlier one holds, whichever is written last.
            earlier = (-F.unix_date(F.to_date("day"))).alias("earlier")
            self.devices.upsert(moved.select("mid", F.col("day").alias("first_day"), earlier), batch_id, ["earlier"], writer)
            gained = moved.select("day", F.lit(0).alias("active"), F.lit(1).alias("new"))
            lost = moved.where("first_day is not null").select(F.col("first_day"), F.lit(0), F.lit(-1))
            all_ = own.select("day", F.lit(1), F.lit(0))
            changes = gained.union(lost).union(all_).groupBy("day").agg(
                F.sum("active").alias("active"), F.sum("new").alias("new")
            )
            self.counts.upsert(changes.withColumn("change", F.lit(f"{writer}/{batch_id}")), batch_id, writer=writer)
        finally:
            moved.unpersist()

    def figures(self, spark: SparkSession, day: str | None = None) -> DataFrame:
        """``day, active, new`` of one day, from its own rows only, or of all days."""
        changes = self.counts.read(spark, day)
        return changes.groupBy("day").agg(F.sum("active").alias("active"), F.sum("new").alias("new"))


def launch_store(root: str) -> LaunchStore:
    return LaunchStore(
        tables.launch_table(root),
        KeyedTable(f"{root}/devices", _DEVICE, ("mid",), buckets=DEVICE_BUCKETS),
        KeyedTable(f"{root}/launch_counts", _COUNT, ("day", "change"), "day"),
    )
