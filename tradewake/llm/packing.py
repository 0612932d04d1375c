"""Packing of token pieces into windows by minimum bin slack.

Documents are cut into whole windows and a rest; only the number of rests of each length
matters for the plan, a histogram of at most ``capacity`` rows whatever the input holds.
The longest remaining length opens a window, and a subset-sum dynamic program over
bitsets picks the multiset of remaining lengths that fills it closest to its capacity.
The counts of the multiset are read back from the bitsets, and it is used as often as
the remaining counts allow. Spark numbers the pieces of each length; a piece's number
says which window of which multiset it belongs to.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradewake.llm.shared import Scratch, numbered, read_table, small_batches
from tradewake.llm.tokens import RANKS, VOCABULARY, Encoder

CAPACITY = 2048
END = 1

_RANK_BITS = 44


def fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of lengths, within their counts, whose sum is the closest to room from below.

    Among equal sums, longer lengths are preferred.
    """
    reach, steps = 1, []
    keep = (1 << (room + 1)) - 1
    for length in sorted(counts, reverse=True):
        left = min(counts[length], room // length)
        chunk = 1
        while left > 0:  # 1, 2, 4, ... of the length, together every count up to the limit
            take = min(chunk, left)
            steps.append((length, take, reach))
            reach |= reach << (length * take) & keep
            left -= take
            chunk *= 2
        if reach >> room & 1:
            break
    total = reach.bit_length() - 1
    used: dict[int, int] = {}
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            used[length] = used.get(length, 0) + take
            total -= length * take
    return used


def plan_windows(counts: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """(how many windows, lengths in each with their number) until no length is left."""
    counts = {length: n for length, n in counts.items() if n > 0}
    plan = []
    while counts:
        longest = max(counts)
        counts[longest] -= 1
        used = fill({a: n for a, n in counts.items() if n and a <= capacity - longest}, capacity - longest)
        counts[longest] += 1
        used[longest] = used.get(longest, 0) + 1
        times = min(counts[a] // n for a, n in used.items())
        for a, n in used.items():
            counts[a] -= n * times
            if not counts[a]:
                del counts[a]
        plan.append((times, used))
    return plan


def _slots(plan: list[tuple[int, dict[int, int]]]) -> np.ndarray:
    """Rows (length and first number, number per window, first window, first offset), sorted."""
    rows, taken, window = [], {}, 0
    for times, used in plan:
        offset = 0
        for length in sorted(used, reverse=True):
            first = taken.get(length, 0)
            rows.append((length << _RANK_BITS | first, used[length], window, offset, first))
            taken[length] = first + used[length] * times
            offset += length * used[length]
        window += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def _place(slots: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, number = batch.column("length").to_numpy(), batch.column("number").to_numpy()
            slot = slots[np.searchsorted(slots[:, 0], length << _RANK_BITS | number, "right") - 1]
            within = number - slot[:, 4]
            rest = [c for c in batch.schema.names if c != "number"]
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in rest),
                    pa.array(slot[:, 2] + within // slot[:, 1]),
                    pa.array(slot[:, 3] + within % slot[:, 1] * length),
                ],
                names=[*rest, "sequence_id", "offset"],
            )

    return run


def pack(spark: SparkSession, pieces: DataFrame, order: list[str], capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces with a long ``length`` from 1 to capacity.

    Equal lengths are told apart by ``order``. An empty table stays empty. The driver
    handles one row per length and one per planned multiset; both are bounded by the
    capacity.
    """
    scratch = Scratch(spark)
    rows = numbered(scratch, pieces, ["length"], order, "number", "pieces")
    counts = spark.read.parquet(f"{scratch.folder}/pieces").groupBy("length").count()
    slots = _slots(plan_windows({r["length"]: r["count"] for r in counts.collect()}, capacity))
    kind = pieces.limit(0).select("*", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return rows.select(*pieces.columns, "number").mapInArrow(_place(slots), kind.schema)


def _pieces(vocabulary: str, ranks: str | None, capacity: int, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary, ranks)
        last = np.array([end], "<u4").tobytes()
        for batch in batches:
            doc, start, length, crc, total = [], [], [], [], []
            for i, text in enumerate(batch.column("text")):
                ids = encoder.ids(text.as_py() or "") + last
                for at in range(0, len(ids), 4 * capacity):
                    piece = ids[at : at + 4 * capacity]
                    doc.append(i)
                    start.append(at // 4)
                    length.append(len(piece) // 4)
                    crc.append(zlib.crc32(piece))
                    total.append(len(ids) // 4)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(doc, pa.int64())),
                    *(pa.array(x, pa.int64()) for x in (start, length, crc, total)),
                ],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"],
            )

    return run


def pack_documents(
    spark: SparkSession,
    documents: DataFrame,
    capacity: int = CAPACITY,
    end: int = END,
    vocabulary: str = VOCABULARY,
    ranks: str | None = RANKS,
) -> DataFrame:
    """The pieces of all documents' token ids and their places in sequences.

    Each document's ids are followed by the id ``end`` and cut after every ``capacity``
    ids. A null or empty text is the id ``end`` alone. Repeated rows are packed as often
    as they occur; a null id stays null. Other columns are not read. Returns ``doc_id,
    start, length, ids_crc32, doc_tokens, sequence_id, offset``.
    """
    small_batches(spark)
    pieces = documents.select("doc_id", "text").mapInArrow(
        _pieces(vocabulary, ranks, capacity, end),
        "doc_id long, start long, length long, ids_crc32 long, doc_tokens long",
    )
    # Written first: dealing out by ranges would encode every text twice.
    pieces = Scratch(spark).save(pieces, "encoded")
    return pack(spark, pieces, ["doc_id", "start", "ids_crc32"], capacity)


def op5_minimum_bin_slack(spark: SparkSession, folder: str) -> DataFrame:
    """All documents' tokens in sequences of at most 2048."""
    return pack_documents(spark, read_table(spark, folder, "documents"))
