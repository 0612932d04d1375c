"""Keyed tables on plain Parquet: idempotent upsert by batch, latest row per key.

A batch is written to its own folder ``writer=<id>/batch=<id>`` below the table, split
into parts: months of the table's day, or buckets of its key. A retried batch overwrites
exactly its own folder, so nothing is lost or doubled, no file is ever written that the
same plan reads, and the cost of an upsert is the size of the batch, not of the table. A
job that starts over with a fresh checkpoint is another writer, and so never overwrites
what an earlier one stored. Reading keeps, per key, the row that comes last in the order
of its source, which is stored with it; where there is none, the row that was written
last. ``compact`` merges the batches into a fresh table.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, replace

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tradewake import schemas
from tradewake.functions import values
from tradewake.operators.dedup import first_per_key, latest_documents

BATCH = "batch"
WRITER = "writer"
WRITTEN = "written"
SEQUENCE = "sequence"
PART = "part"

# Folders that users are dealt to by their id.
USER_BUCKETS = 64


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def _read_folders(spark: SparkSession, kind: T.StructType, path: str, folders: str) -> DataFrame:
    """The files of folders below ``path``: no rows if there are none, an error if no tables lie where it should."""
    try:
        return spark.read.schema(kind).option("basePath", path).parquet(folders)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        if not _exists(spark, path) and not _exists(spark, path.rpartition("/")[0]):
            raise ValueError(f"there is no table at {path}") from missing
        return spark.createDataFrame([], kind)


@dataclass(frozen=True)
class KeyedTable:
    """A table with a key. Rows of one key always lie in one part.

    ``day`` names a column of days as text, whose months are the parts and by which files
    are sorted, so that a day is found by its month's folder and the files' statistics.
    ``buckets`` deals the keys to so many parts instead. ``told`` names columns that the
    key tells: rows that come from a join on them find their latest where they are, without
    another shuffle.
    """

    path: str
    schema: T.StructType
    key: tuple[str, ...]
    day: str | None = None
    buckets: int = 0
    told: tuple[str, ...] = ()

    def create(self, spark: SparkSession) -> KeyedTable:
        """Make the table's folder, so that it can be read before anything is stored."""
        at = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(at)
        return self

    def upsert(
        self, rows: DataFrame, batch_id: int, order: Sequence[str] = (), writer: str = "batch"
    ) -> None:
        """Write the latest row per key of ``rows`` as batch ``batch_id`` of ``writer``.

        ``order`` names times or numbers in ``rows`` that tell which of two rows is later,
        in this batch and among all batches; they need not belong to the table. Without
        it, the later batch wins.
        """
        latest = latest_documents(rows, self._group(), order)
        self._write(latest.select(*self.schema.names, self._sequence(rows, order)), self._folder(writer, batch_id))

    def read(
        self,
        spark: SparkSession,
        day: str | None = None,
        wanted: DataFrame | None = None,
        days: Iterable[str] | None = None,
        before: tuple[str, int] | None = None,
    ) -> DataFrame:
        """The current row of every key.

        With ``day`` or ``days``, only the folders of their months are listed, and of the
        files there what may hold them is read. With ``wanted``, a frame of keys, all
        other rows are dropped first, so that the shuffle to the latest rows moves wanted
        keys only; where the table has buckets, only those of wanted keys are read. With
        ``before``, a (writer, batch), that writer's batches from this one on are left
        out: what the table was when the batch was first tried. A table that was neither
        created nor written has no rows; where there is no folder for it either, the path
        is wrong, and that is an error.
        """
        return self._current(spark, day, wanted, days, before).select(*self.schema.names)

    def batch(self, spark: SparkSession, batch_id: int, writer: str = "batch") -> DataFrame:
        """The rows that one batch wrote."""
        stored = spark.read.schema(self._stored()).parquet(self._folder(writer, batch_id))
        return stored.select(*self.schema.names)

    def compact(self, spark: SparkSession, into: str) -> KeyedTable:
        """Merge all batches into a new table at ``into`` and return it.

        Later batches go to the new table. The old folder stays for readers that still
        use it.
        """
        target = replace(self, path=into)
        rows = self._current(spark).select(*self.schema.names, SEQUENCE)
        target._write(rows, target._folder("compact", 0))
        return target

    def _current(self, spark, day=None, wanted=None, days=None, before=None) -> DataFrame:
        days = [day] if day is not None else None if days is None else sorted(set(days))
        parts = None
        if days is not None:
            parts = sorted({d[:7] for d in days})
        elif self.buckets and wanted is not None:
            # At most as many rows as there are buckets.
            parts = [r[0] for r in wanted.select(self._part()).distinct().collect()]
        stored = self._stored_rows(spark, parts)
        # A batch has one row per key, so a table of one batch, a merged one say, has
        # nothing to choose from.
        batches = {re.findall(f"/{WRITER}=([^/]*)/{BATCH}=([^/]*)/", f)[-1] for f in stored.inputFiles()}
        if days is not None:
            stored = stored.where(F.col(self.day).isin(days))
        if before is not None:
            writer, batch = before
            stored = stored.where((F.col(WRITER) != writer) | (F.col(BATCH) < batch))
        if wanted is not None:
            stored = stored.join(wanted.select(*self.key), list(self.key), "left_semi")
        if len(batches) < 2:
            return stored
        newest = [F.col(c).desc_nulls_last() for c in (SEQUENCE, WRITTEN, BATCH, WRITER)]
        return first_per_key(stored, self._group(), newest)

    def _stored_rows(self, spark: SparkSession, parts: list[str] | None) -> DataFrame:
        kind = self._stored()
        folders = self.path if parts is None else self._folder("*", "*") + f"/{PART}={{{','.join(parts)}}}"
        if parts == []:
            return spark.createDataFrame([], kind)
        return _read_folders(spark, kind, self.path, folders)

    def _folder(self, writer: str, batch: int | str) -> str:
        return f"{self.path}/{WRITER}={writer}/{BATCH}={batch}"

    def _part(self) -> Column:
        if self.buckets:
            return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("string").alias(PART)
        return F.substring(self.day, 1, 7).alias(PART)

    def _sequence(self, rows: DataFrame, order: Sequence[str]) -> Column:
        """The order of a row as numbers; rows with a null in it come before others."""
        if not order:
            return F.lit(None).cast("array<bigint>").alias(SEQUENCE)
        numbers = []
        for name in order:
            kind = rows.schema[name].dataType
            if isinstance(kind, T.TimestampType):
                numbers.append(F.unix_micros(name))
            elif isinstance(kind, T.IntegralType):
                numbers.append(F.col(name).cast("bigint"))
            else:
                raise ValueError(f"{name} is no time and no whole number")
        return F.array(*numbers).alias(SEQUENCE)

    def _group(self) -> list[str]:
        # With the day in the group, a filter on it reaches the scan.
        extra = [self.day] if self.day and self.day not in self.key else []
        return [*extra, *self.told, *self.key]

    def _stored(self) -> T.StructType:
        more = [
            (SEQUENCE, T.ArrayType(T.LongType())),
            (WRITTEN, T.LongType()),
            (WRITER, T.StringType()),
            (BATCH, T.LongType()),
        ]
        more += [(PART, T.StringType())] if self.day or self.buckets else []
        return T.StructType([*self.schema, *[T.StructField(n, kind) for n, kind in more]])

    def _write(self, rows: DataFrame, folder: str) -> None:
        rows = rows.withColumn(WRITTEN, F.unix_micros(F.current_timestamp()))
        if self.day or self.buckets:
            # Even files: small parts are merged, a part that holds most of the rows is
            # split over several tasks.
            dealt = rows.withColumn(PART, self._part()).hint("rebalance", PART)
            inner = [self.day] if self.day else list(self.key)
            writer = dealt.sortWithinPartitions(PART, *inner).write.partitionBy(PART)
        else:
            writer = rows.hint("rebalance").write
        writer.mode("overwrite").parquet(folder)


@dataclass(frozen=True)
class DatedTargets:
    """Tables named by the day of the run that writes them, and an alias over all of them.

    A document belongs to the target of the run that stored it, whatever day it tells of.
    A later run may store it again; under the alias the newest run's row holds.
    """

    path: str
    prefix: str
    schema: T.StructType
    key: tuple[str, ...]

    TARGET = "target"

    def upsert(self, rows: DataFrame, run_day: str, batch_id: int, writer: str = "batch", order: Sequence[str] = ()) -> None:
        """Write the latest row per key of ``rows`` to the run day's target."""
        name = values.dated_name(self.prefix, F.lit(run_day).cast("date"))
        latest = latest_documents(rows, self.key, order).select(*self.schema.names)
        stamped = latest.withColumns({WRITTEN: F.unix_micros(F.current_timestamp()), self.TARGET: name})
        writing = stamped.hint("rebalance").write.mode("overwrite").partitionBy(self.TARGET)
        writing.parquet(f"{self.path}/{WRITER}={writer}/{BATCH}={batch_id}")

    def alias(self, spark: SparkSession, run_days: Iterable[str] | None = None) -> DataFrame:
        """The newest row of every key over all targets, or over those of some run days.

        Targets of other days are not listed or read.
        """
        more = [(WRITTEN, T.LongType()), (WRITER, T.StringType()), (BATCH, T.LongType()), (self.TARGET, T.StringType())]
        kind = T.StructType([*self.schema, *[T.StructField(n, k) for n, k in more]])
        names = "*" if run_days is None else "{" + ",".join(f"{self.prefix}-{d}" for d in run_days) + "}"
        folders = f"{self.path}/{WRITER}=*/{BATCH}=*/{self.TARGET}={names}"
        stored = _read_folders(spark, kind, self.path, folders)
        newest = [F.col(c).desc() for c in (self.TARGET, WRITTEN, BATCH, WRITER)]
        return first_per_key(stored, list(self.key), newest).select(*self.schema.names, self.TARGET)


def upper_case(rows: DataFrame) -> DataFrame:
    """Rows with their column names in upper case, as the wide tables have them."""
    return rows.toDF(*[name.upper() for name in rows.columns])


def _upper(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name.upper(), f.dataType) for f in schema])


def launch_table(root: str) -> KeyedTable:
    """First launches, one per device and day."""
    return KeyedTable(f"{root}/launches", _upper(schemas.LAUNCH), ("MID", "LOGDATE"), "LOGDATE")


def order_table(root: str) -> KeyedTable:
    """Orders, one per id; an order keeps its day."""
    return KeyedTable(f"{root}/orders", _upper(schemas.ORDER), ("ID",), "CREATE_DATE")


def sale_table(root: str) -> KeyedTable:
    """Sale details, one per order and line, by order day."""
    return KeyedTable(
        f"{root}/sales",
        T.StructType([T.StructField("doc_id", T.StringType()), *schemas.SALE_DETAIL]),
        ("doc_id",),
        "dt",
        told=("order_id",),
    )


def alert_table(root: str) -> KeyedTable:
    """Coupon alerts, one per device and minute, by day."""
    named = [T.StructField("day", T.StringType()), T.StructField("doc_id", T.StringType())]
    return KeyedTable(f"{root}/alerts", T.StructType([*named, *schemas.COUPON_ALERT]), ("doc_id",), "day")


def user_table(root: str, buckets: int = USER_BUCKETS) -> KeyedTable:
    """Users, the latest record per id, in buckets of ids."""
    return KeyedTable(f"{root}/users", schemas.USER, ("id",), buckets=buckets)


def dated_sales(root: str) -> DatedTargets:
    """Sale details by the day of the run."""
    kind = T.StructType([T.StructField("doc_id", T.StringType()), *schemas.SALE_DETAIL])
    return DatedTargets(f"{root}/dated_sales", "sale_detail", kind, ("doc_id",))


def unmatched_table(root: str) -> KeyedTable:
    """Order lines whose order did not come in time, by the line's day."""
    names = ("order_id", "id", "sku_id", "sku_name", "day")
    kind = [T.StructField(n, T.StringType()) for n in names]
    return KeyedTable(f"{root}/unmatched_lines", T.StructType(kind), ("order_id", "id", "sku_id"), "day")


def write_raw_logs(rows: DataFrame, folder: str, batch_id: int, writer: str = "batch") -> None:
    """Land raw log lines, one JSON line per record, in a folder per batch and day.

    A retried batch overwrites its own folder.
    """
    rows.select("value", "log_date").hint("rebalance", "log_date").write.mode("overwrite").partitionBy(
        "log_date"
    ).text(f"{folder}/{WRITER}={writer}/{BATCH}={batch_id}")


def read_raw_logs(spark: SparkSession, folder: str) -> DataFrame:
    """Landed log lines with the day they were received on."""
    kept = spark.read.schema(f"value string, {WRITER} string, {BATCH} long, log_date string").text(folder)
    return kept.select("value", "log_date")
