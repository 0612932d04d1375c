"""Pages of a sorted result of any size, at any depth.

The rows are dealt into ranges of the order and written, each range sorted by itself. The
number of rows of each range then tells which ranges a page lies in, and only those are
read: page 10,000 costs what page 1 costs, and no task ever holds the rows before it.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RANGE = "_range"
PLACE = "_place"


def check_page(number: int, size: int) -> None:
    if number < 1 or size < 1:
        raise ValueError("pages are numbered from 1 and hold at least one row")


@dataclass(frozen=True)
class SortedRows:
    """Written rows, and the number of rows of each range, in order."""

    spark: SparkSession
    path: str
    schema: T.StructType
    counts: tuple[int, ...]

    @property
    def total(self) -> int:
        return sum(self.counts)

    def rows(self) -> DataFrame:
        """All rows, in no order."""
        kind = T.StructType([*self.schema, T.StructField(PLACE, T.LongType()), T.StructField(RANGE, T.IntegerType())])
        return self.spark.read.schema(kind).parquet(self.path)

    def page(self, number: int, size: int) -> DataFrame:
        """Page ``number`` (from 1), in order; the rows' ``_place`` counts from 0 over all."""
        check_page(number, size)
        first, last = (number - 1) * size, number * size
        ends = list(accumulate(self.counts))
        held = [i for i, (n, end) in enumerate(zip(self.counts, ends)) if end > first and end - n < last]
        starts = F.create_map(*[F.lit(x) for i in held for x in (i, ends[i] - self.counts[i])]) if held else None
        chosen = self.rows().where(F.col(RANGE).isin(held) if held else F.lit(False))
        place = F.col(PLACE) + starts[F.col(RANGE)] if held else F.col(PLACE)
        wanted = chosen.withColumn(PLACE, place.cast("long")).where((F.col(PLACE) >= first) & (F.col(PLACE) < last))
        return wanted.select(*self.schema.names, PLACE).orderBy(PLACE)


def sorted_rows(rows: DataFrame, order: Sequence[Column], path: str) -> SortedRows:
    """Sort ``rows`` by ``order`` into a fresh folder ``path``; see :class:`SortedRows`.

    Rows equal in all of ``order`` may come in any order among each other, and may lie in
    one range. Each range's rows carry their place within it.
    """
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    # The upper bits of this number are those of the range, the lower ones count its rows.
    numbered = dealt.withColumn(PLACE, F.monotonically_increasing_id())
    parts = {RANGE: F.shiftright(PLACE, 33).cast("int"), PLACE: F.col(PLACE).bitwiseAND((1 << 33) - 1)}
    numbered.withColumns(parts).write.partitionBy(RANGE).parquet(path)
    found = SortedRows(rows.sparkSession, path, rows.schema, ())
    # One row for each range.
    sizes = {r[0]: r[1] for r in found.rows().groupBy(RANGE).count().collect()}
    counts = tuple(sizes.get(i, 0) for i in range(max(sizes, default=-1) + 1))
    return SortedRows(rows.sparkSession, path, rows.schema, counts)
