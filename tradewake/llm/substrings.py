"""Removal of long passages that repeat, by compaction of a token de Bruijn graph.

The graph's edges are the runs of ``span`` words. They are dealt out as paths: a path
is a maximal run of consecutive edges of one document that share their minimizer, the
least hash among the k-mers (``k`` words) of an edge. Equal edges have equal
minimizers, so two copies of an edge always meet under one minimizer, and an edge costs
a few bytes of its path instead of a row of its own.

Compaction is by joins. A minimizer that occurs once holds no repeated edge. One whose
occurrences all lie on the same path does not branch: the path is repeated as a whole.
Only where paths under one minimizer differ, the graph branches; there one source of
each different path is read again at its coordinates, and its edges are compared one by
one. What repeats is carried back to the coordinates of every occurrence.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradewake.llm import words as H
from tradewake.llm.shared import Scratch, read_table, row_mark, small_batches

SPAN = 35
K = 8

_ROW = ["row_id", "row_mark"]
_PATHS = "row_id long, row_mark long, minimizer long, path long, start int, edges int"
_EDGES = "minimizer long, path long, copies long, place int, edge long"


def least(values: np.ndarray, width: int) -> np.ndarray:
    """Where the first least value of every ``width`` consecutive values is."""
    value, place = values, np.arange(len(values))
    size = 1
    while size < width:
        step = min(size, width - size)
        n = max(0, len(value) - step)
        right = value[step : step + n] < value[:n]
        value = np.where(right, value[step : step + n], value[:n])
        place = np.where(right, place[step : step + n], place[:n])
        size += step
    return place


def _paths(span: int, k: int):
    """Documents to the paths of their edges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, bounds = H.word_hashes(batch.column("text"))
            count = np.diff(bounds)
            edges = np.maximum(count - span + 1, 0)
            if not edges.sum():
                continue
            kmers = H.shingle_hashes(words, k)
            place = least(kmers, span - k + 1)
            doc = np.repeat(np.arange(len(count)), edges)
            within = np.arange(edges.sum()) - np.repeat(np.cumsum(edges) - edges, edges)
            at = bounds[doc] + within  # the edge's first word in the batch
            place = place[at]
            first = np.flatnonzero((within == 0) | (place != np.roll(place, 1)))
            n = np.diff(np.append(first, len(at)))
            doc, begin = doc[first], at[first]
            path = H.span_hashes(words, begin, begin + n - 1 + span)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("row_id").take(pa.array(doc)),
                    batch.column("row_mark").take(pa.array(doc)),
                    pa.array(H.as_long(kmers[place[first]])),
                    pa.array(H.as_long(path)),
                    pa.array(within[first].astype(np.int32)),
                    pa.array(n.astype(np.int32)),
                ],
                names=["row_id", "row_mark", "minimizer", "path", "start", "edges"],
            )

    return run


def _edges(span: int):
    """Documents with the coordinates of their source paths to the edges of these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, bounds = H.word_hashes(batch.column("text"))
            sources = batch.column("sources")
            doc = np.repeat(np.arange(batch.num_rows), np.diff(sources.offsets.to_numpy()))
            found = sources.flatten()
            n = found.field("edges").to_numpy()
            if not len(n):
                continue
            which = np.repeat(np.arange(len(n)), n)
            place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            begin = bounds[doc[which]] + found.field("start").to_numpy()[which] + place
            picked = pa.array(which)
            yield pa.RecordBatch.from_arrays(
                [
                    found.field("minimizer").take(picked),
                    found.field("path").take(picked),
                    found.field("copies").take(picked),
                    pa.array(place.astype(np.int32)),
                    pa.array(H.as_long(H.span_hashes(words, begin, begin + span))),
                ],
                names=["minimizer", "path", "copies", "place", "edge"],
            )

    return run


def repeated_edges(scratch: Scratch, documents: DataFrame, span: int = SPAN, k: int = K) -> DataFrame:
    """``row_id, row_mark, repeats``: where each document has edges that occur elsewhere too.

    ``repeats`` lists (start, mask): bit i is set if the edge at word start + i repeats.
    Documents without any are absent. A repeated row counts as another occurrence.
    """
    if not 0 <= span - k < 63:
        raise ValueError("a path must have at most 63 edges, one for each bit of its mask")
    texts = documents.select(*row_mark(), "text")
    paths = scratch.save(texts.mapInArrow(_paths(span, k), _PATHS), "paths")
    # Written, like all sums that are joined back to what they were taken over: a join of
    # two plain shuffles is one that adaptive execution can split at a hot key.
    shared = scratch.save(
        paths.groupBy("minimizer")
        .agg(F.count("*").alias("n"), F.min("path").alias("low"), F.max("path").alias("high"))
        .where("n > 1")
        .select("minimizer", (F.col("low") != F.col("high")).alias("branches")),
        "shared",
    )
    repeated = scratch.save(paths.join(shared, "minimizer"), "repeated")
    scratch.drop("paths")
    branching = repeated.where("branches")

    # Each different path below a branching minimizer, with one place to read it at.
    distinct = branching.groupBy("minimizer", "path").agg(
        F.count("*").alias("copies"), F.min(F.struct(*_ROW, "start", "edges")).alias("source")
    )
    sources = (
        distinct.select("minimizer", "path", "copies", "source.*")
        .groupBy(*_ROW)
        .agg(F.collect_list(F.struct("start", "edges", "minimizer", "path", "copies")).alias("sources"))
    )
    edges = scratch.save(
        texts.join(sources, _ROW).select("sources", "text").mapInArrow(_edges(span), _EDGES), "edges"
    )
    place = F.struct("path", "place")
    twice = (
        edges.groupBy("minimizer", "edge")
        .agg(F.min(place).alias("low"), F.max(place).alias("high"), F.max("copies").alias("copies"))
        .where("low != high or copies > 1")
        .select("minimizer", "edge")
    )
    one = F.lit(1).cast("long")
    masks = (
        edges.join(twice, ["minimizer", "edge"])
        .groupBy("minimizer", "path")
        .agg(F.bit_or(F.call_function("shiftleft", one, F.col("place"))).alias("mask"))
    )
    whole = F.call_function("shiftleft", one, F.col("edges")) - 1
    marks = repeated.where("not branches").select(*_ROW, "start", whole.alias("mask"))
    marks = marks.unionByName(
        branching.join(masks, ["minimizer", "path"]).select(*_ROW, "start", "mask")
    )
    return marks.groupBy(*_ROW).agg(F.collect_set(F.struct("start", "mask")).alias("repeats"))


def covered(n: int, repeats: list[dict] | None, span: int) -> np.ndarray | None:
    """Which of n words lie in a repeated edge; None if none does."""
    if not repeats:
        return None
    start = np.array([r["start"] for r in repeats], np.int64)
    mask = np.array([r["mask"] for r in repeats], np.int64)
    bits = (mask[:, None] >> np.arange(63)) & 1
    first = (start[:, None] + np.arange(63))[bits == 1]
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, first, 1)
    np.add.at(change, first + span, -1)
    return np.cumsum(change[:-1]) > 0


def _digests(span: int):
    """Documents with their repeats to the counts and the digest of what is kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, repeats in zip(batch.column("text"), batch.column("repeats")):
                words = (text.as_py() or "").encode().split()
                gone = covered(len(words), repeats.as_py(), span)
                kept = words if gone is None else list(compress(words, ~gone))
                rows.append((len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
            n, removed, digest = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(n, pa.int64()),
                    pa.array(removed, pa.int64()),
                    pa.array(digest, pa.string()),
                ],
                names=["doc_id", "n_words", "n_removed", "kept_sha256"],
            )

    return run


_TOKEN = re.compile(rb"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+")


def cut(text: str, repeats: list[dict] | None, span: int) -> str:
    """The text without the words of repeated edges and the white space before them."""
    if not repeats:
        return text
    tokens = _TOKEN.findall(text.encode())
    gone = covered(len(tokens), repeats, span)
    return b"".join(compress(tokens, ~gone)).lstrip(H.BLANKS).decode()


def _cut_texts(span: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [
                None if text.as_py() is None else cut(text.as_py(), repeats.as_py(), span)
                for text, repeats in zip(batch.column("text"), batch.column("repeats"))
            ]
            rest = [c for c in batch.schema.names if c not in ("text", "repeats")]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in rest), pa.array(texts, pa.string())], names=[*rest, "text"]
            )

    return run


def _with_repeats(scratch: Scratch, documents: DataFrame, span: int, keep: list[str]) -> DataFrame:
    """The documents' columns ``keep`` and text, with their repeats; null if they have none."""
    repeats = scratch.save(repeated_edges(scratch, documents, span), "repeats")
    scratch.drop("repeated", "edges")
    marked = documents.select(*keep, "text", *row_mark())
    return marked.join(repeats, _ROW, "left").select(*keep, "text", "repeats")


def kept_digests(spark: SparkSession, documents: DataFrame, span: int = SPAN) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` of every document, see ``without_repeats``."""
    small_batches(spark)
    rows = _with_repeats(Scratch(spark), documents, span, ["doc_id"])
    return rows.mapInArrow(
        _digests(span), "doc_id long, n_words long, n_removed long, kept_sha256 string"
    )


def without_repeats(spark: SparkSession, documents: DataFrame, span: int = SPAN) -> DataFrame:
    """The documents, with every word removed that lies in a repeated run of ``span`` words.

    A run repeats if the same words start at any other place, in the same document or in
    another one; all its occurrences go, the first included. Runs are judged on the
    input. White space in front of a removed word goes with it, all other text stays as
    it is. One row per input row and all columns of the input: a null text stays null, a
    text of fewer than ``span`` words stays whole, an emptied text becomes the empty text.
    Of rows that are the same document twice, every run repeats. A null id is a value
    like any other.
    """
    small_batches(spark)
    rest = [c for c in documents.columns if c != "text"]
    rows = documents.select("text", F.col("doc_id"), F.struct(*rest).alias("rest"))
    cut_rows = _with_repeats(Scratch(spark), rows, span, ["rest"])
    kind = documents.select(F.struct(*rest).alias("rest"), "text").schema
    return cut_rows.mapInArrow(_cut_texts(span), kind).select(*[
        F.col("text") if c == "text" else F.col("rest").getField(c).alias(c) for c in documents.columns
    ])


def op10_debruijn_substrings(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's words, how many of them repeat in runs of 35, and what is kept."""
    return kept_digests(spark, read_table(spark, folder, "documents"))
