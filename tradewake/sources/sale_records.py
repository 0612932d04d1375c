"""Orders and order lines that may still meet, as the sale job keeps them.

A batch is one folder of plain Parquet rows, and no row is written a second time. Next to
the folders, a mark of one row for each batch says how far both topics have come and which
folders can still hold a partner. A retried batch starts from the mark of the batch before
it and writes the same again. A folder is deleted one batch after no row of it can be needed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradewake.sources.tables import BATCH, WRITER, _exists

_MARK = (
    "order_at long, line_at long, watermark long, late long, "
    f"kept array<struct<{BATCH}: long, until: long>>, gone array<long>"
)
_START = {"order_at": None, "line_at": None, "watermark": 0, "late": 0, "kept": [], "gone": []}


@dataclass(frozen=True)
class Kept:
    """Lines and orders with ``fresh``, true for those of the batch, and the watermark (in
    microseconds) as it was before the batch and as it is after it."""

    lines: DataFrame
    orders: DataFrame
    since: int
    until: int


@dataclass(frozen=True)
class SaleRecords:
    """Records ``at, is_order, order, line``, of which either ``order`` or ``line`` is null.

    A line may come ``before_seconds`` before its order and ``after_seconds`` after it. Both
    topics wait ``delay`` for stragglers: the watermark is the least of their latest times
    less the delay, and what comes at or behind it is late: it is counted and left out.
    """

    path: str
    before_seconds: int
    after_seconds: int
    delay: str

    def add(self, batch: DataFrame, batch_id: int, writer: str) -> Kept:
        """Store a batch; give its records and those of earlier batches that they may meet."""
        spark = batch.sparkSession
        last = self._mark(spark, batch_id - 1, writer)
        for old in last["gone"]:
            _delete(spark, self._folder(writer, old))
        since, folder = last["watermark"], self._folder(writer, batch_id)
        late = F.coalesce(F.col("at") <= F.timestamp_micros(F.lit(since)), F.lit(False))
        flagged = batch.withColumn("late", late)
        flagged.write.option("compression", "zstd").mode("overwrite").parquet(folder)
        at = F.unix_micros("at")
        seen = spark.read.schema(flagged.schema).parquet(folder).agg(
            F.max(F.when(F.col("is_order"), at)).alias("order_at"),
            F.max(F.when(~F.col("is_order"), at)).alias("line_at"),
            F.max(at).alias("until"),
            F.count_if("late").alias("late"),
            F.expr(f"unix_micros(timestamp_seconds(0) + interval '{self.delay}')").alias("delay"),
        ).first()
        until = self._marked(spark, last, seen, batch_id, writer)
        folders = [self._folder(writer, k["batch"]) for k in last["kept"]] + [folder]
        kept = spark.read.schema(flagged.schema.add(BATCH, "long")).option("basePath", self.path).parquet(*folders)
        kept = kept.where("not late").withColumn("fresh", F.col(BATCH) == batch_id)
        first_line = since - self.before_seconds * 1_000_000
        first_order = first_line - self.after_seconds * 1_000_000

        # A record without a time meets nothing, and is not among these either.
        after = lambda first: F.col("at") > F.timestamp_micros(F.lit(first))
        lines = kept.where(~F.col("is_order") & after(first_line)).select("line.*", F.col("at").alias("line_at"), "fresh")
        orders = kept.where(F.col("is_order") & after(first_order)).select("order.*", F.col("at").alias("order_at"), "fresh")
        return Kept(lines, orders, since, until)

    def late(self, spark: SparkSession, batch_id: int, writer: str) -> int:
        """How many records had come too late when a batch was done."""
        return self._mark(spark, batch_id, writer)["late"]

    def _marked(self, spark: SparkSession, last: dict, seen, batch_id: int, writer: str) -> int:
        """Write the mark of a batch; the watermark after it."""
        latest = [max((t for t in (last[n], seen[n]) if t is not None), default=None) for n in ("order_at", "line_at")]
        watermark = last["watermark"]
        if None not in latest:
            # In whole milliseconds, and never back.
            watermark = max(watermark, min(t // 1000 * 1000 for t in latest) - seen["delay"])
        reach = watermark - (self.before_seconds + self.after_seconds) * 1_000_000
        kept = [(k["batch"], k["until"]) for k in last["kept"]]
        kept += [(batch_id, seen["until"])] if seen["until"] is not None else []
        still = [k for k in kept if k[1] > reach]
        gone = [k[0] for k in kept if k[1] <= reach]
        row = (*latest, watermark, last["late"] + seen["late"], still, gone)
        spark.createDataFrame([row], _MARK).coalesce(1).write.mode("overwrite").parquet(self._mark_folder(writer, batch_id))
        _delete(spark, self._mark_folder(writer, batch_id - 2))
        return watermark

    def _mark(self, spark: SparkSession, batch_id: int, writer: str) -> dict:
        if batch_id < 0:
            return _START
        at = self._mark_folder(writer, batch_id)
        if not _exists(spark, at):
            raise ValueError(f"no mark at {at}: the checkpoint is of another job or of an earlier version")
        return spark.read.schema(_MARK).parquet(at).first().asDict()

    def _folder(self, writer: str, batch_id: int) -> str:
        return f"{self.path}/{WRITER}={writer}/{BATCH}={batch_id}"

    def _mark_folder(self, writer: str, batch_id: int) -> str:
        return f"{self.path}-marks/{WRITER}={writer}/{BATCH}={batch_id}"


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
