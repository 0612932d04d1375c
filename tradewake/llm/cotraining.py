"""A quality classifier co-trained on two views of a document.

The content view sees hashed byte trigrams of the text; the metadata view sees language,
source, length and layout. Each is a logistic regression. In each round, all documents
that no label was used of are scored where they lie, and those about which a view is sure
are labelled by it for the other view. They move as sums of features, so their number has
no bound. At last each view is calibrated on labelled documents that it was
not fitted to, and the calibrated views are added up to score every document.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradewake.llm import words as H
from tradewake.llm.shared import Scratch, read_table, small_batches

# Labelled documents that the views are fitted to and calibrated on: those with the least
# hashes of their ids. All documents beside them are scored in each round.
LABELLED = 6000
# One in so many of them calibrates.
CALIBRATES = 5
ROUNDS = 3
# A view labels every document for the other one that it is so sure of. The documents of a
# class are given as the means of CELLS groups of languages and sources, each as heavy as
# it has documents, and together as heavy as GIVEN_WEIGHT times the labelled ones.
SURE = 0.95
CELLS = 64
GIVEN_WEIGHT = 0.3
KEPT_FROM = 0.5

CONTENT_BITS = 11
CONTENT = 1 << CONTENT_BITS
LANGS, SOURCES = 16, 64
LAYOUT = 8
METADATA = LANGS + SOURCES + LAYOUT

_VIEWS = ("content", "metadata")


def _hashed(values: pa.Array, n: int) -> np.ndarray:
    """One-hot rows of hashed values; null is a value of its own."""
    coded = values.fill_null("\0").dictionary_encode()
    names = [sum(b * 31**i for i, b in enumerate(v.encode())) % n for v in coded.dictionary.to_pylist()]
    rows = np.zeros((len(values), n), np.float32)
    rows[np.arange(len(values)), np.array(names, np.int64)[coded.indices.to_numpy()]] = 1
    return rows


def features(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The two views of each row: shares of hashed trigrams, and metadata with layout."""
    data, offsets = H.text_buffer(batch.column("text"))
    size = np.diff(offsets)
    content = np.zeros((len(size), CONTENT), np.float32)
    layout = np.zeros((len(size), LAYOUT), np.float32)
    kinds = np.zeros(256, np.int64)  # other, capital, small, digit, blank, newline, symbol
    kinds[65:91], kinds[97:123], kinds[48:58] = 1, 2, 3
    kinds[[9, 11, 12, 13, 32]] = 4
    kinds[10] = 5
    kinds[np.frombuffer(b"#*$%&|<>", np.uint8)] = 6
    for i, (begin, end) in enumerate(zip(offsets[:-1], offsets[1:])):
        counts = np.zeros(CONTENT)
        kind = np.zeros(7)
        for at in range(begin, end, H.PIECE):  # a long text piece by piece
            piece = data[at : min(end, at + H.PIECE + 2)].astype(np.uint32)
            code = (piece[:-2] | piece[1:-1] << np.uint32(8) | piece[2:] << np.uint32(16)) * np.uint32(0x9E3779B1)
            counts += np.bincount(code >> np.uint32(32 - CONTENT_BITS), minlength=CONTENT)
            kind += np.bincount(kinds[data[at : min(end, at + H.PIECE)]], minlength=7)
        content[i] = np.sqrt(counts / max(1.0, counts.sum()))
        n = max(1, end - begin)
        layout[i, :6] = kind[[1, 2, 3, 4, 5, 6]] / n
        layout[i, 6] = np.log1p(n / (kind[5] + 1))
    layout[:, 7] = np.log1p(batch.column("chars").to_numpy())
    return content, np.hstack([_hashed(batch.column("lang"), LANGS), _hashed(batch.column("source"), SOURCES), layout])


@dataclass
class Logistic:
    """A logistic regression on standardised features, calibrated by a line."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    slope: float = 1.0
    offset: float = 0.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        w = self.weights[:-1] * self.scale
        raw = x @ w + (self.weights[-1] - self.mean @ w)
        return self.slope * raw.astype(np.float64) + self.offset


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, rows: np.ndarray, own: int, ridge: float = 1e-3, steps: int = 150) -> Logistic:
    """Accelerated gradient descent; the classes weigh the same, whatever the weights of their rows.

    Features are scaled by the first ``own`` rows, those of labelled documents: means of
    many documents vary less.
    """
    mean = x[:own].mean(axis=0)
    scale = 1 / (x[:own].std(axis=0) + np.float32(1e-3))
    z = np.hstack([(x - mean) * scale, np.ones((len(x), 1), np.float32)]).astype(np.float32)
    weight = np.where(y == 1, 0.5 / rows[y == 1].sum(), 0.5 / rows[y == 0].sum()) * rows
    v = np.ones(z.shape[1], np.float32)
    for _ in range(20):  # the largest curvature, by power steps
        v = z.T @ (weight * (z @ v)).astype(np.float32)
        norm = float(np.linalg.norm(v))
        v = v / np.float32(norm)
    top = norm / 4 * 1.2 + ridge
    w = ahead = np.zeros(z.shape[1])
    for step in range(steps):
        error = weight * (sigmoid(z @ ahead.astype(np.float32)) - y)
        slope = z.T @ error.astype(np.float32) + ridge * ahead
        new = ahead - slope / top
        ahead = new + step / (step + 3) * (new - w)
        w = new
    return Logistic(mean, scale, w.astype(np.float32))


def calibrate(model: Logistic, x: np.ndarray, y: np.ndarray) -> Logistic:
    """Platt's line through the logits, by Newton steps with softened labels."""
    logit = model.logits(x)
    up, down = y.sum(), len(y) - y.sum()
    target = np.where(y == 1, (up + 1) / (up + 2), 1 / (down + 2))
    design = np.stack([logit, np.ones_like(logit)], axis=1)
    line = np.array([1.0, 0.0])
    for _ in range(50):
        p = sigmoid(design @ line)
        hessian = (design * (p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2)
        move = np.linalg.solve(hessian, design.T @ (p - target) + 1e-3 * (line - [1.0, 0.0]))
        line = line - move
        if np.abs(move).max() < 1e-8:
            break
    return Logistic(model.mean, model.scale, model.weights, float(max(line[0], 1e-3)), float(line[1]))


def _packed(x: np.ndarray) -> pa.Array:
    return pa.array([row.astype("<f2").tobytes() for row in x], pa.binary())


def _unpacked(rows: list, name: str, width: int) -> np.ndarray:
    if not rows:
        return np.zeros((0, width), np.float32)
    return np.stack([np.frombuffer(r[name], "<f2") for r in rows]).astype(np.float32)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        content, metadata = features(batch)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("y"), _packed(content), _packed(metadata)],
            names=["doc_id", "y", *_VIEWS],
        )


_LABELLED = "doc_id long, y int, content binary, metadata binary"


def _cells(batch: pa.RecordBatch) -> np.ndarray:
    """A number below CELLS for each document's language and source."""
    parts = [batch.column(c).fill_null("\0").dictionary_encode() for c in ("lang", "source")]
    codes = [
        np.array([zlib.crc32(v.encode()) for v in x.dictionary.to_pylist()], np.int64)[x.indices.to_numpy()] for x in parts
    ]
    return (codes[0] * 31 + codes[1]) % CELLS


def _sure_sums(models: tuple[Logistic, Logistic], used: np.ndarray):
    """Documents to the sums of the views of all that a view is sure of, by class and cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int, int], list] = {}
        for batch in batches:
            views = features(batch)
            free = batch.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
            free &= ~np.isin(batch.column("doc_id").fill_null(0).to_numpy(), used)
            cells = _cells(batch)
            for by, (model, x) in enumerate(zip(models, views)):
                p = sigmoid(model.logits(x))
                for y, q in ((1, p), (0, 1 - p)):
                    at = np.flatnonzero(free & (q >= SURE))
                    for cell in np.unique(cells[at]):
                        own = at[cells[at] == cell]
                        sums = total.setdefault((by, y, int(cell)), [0, 0.0, 0.0])
                        sums[0] += len(own)
                        sums[1] = sums[1] + views[0][own].sum(axis=0, dtype=np.float64)
                        sums[2] = sums[2] + views[1][own].sum(axis=0, dtype=np.float64)
        yield _sum_rows(total)

    return run


def _sum_rows(total: dict[tuple[int, int, int], list]) -> pa.RecordBatch:
    keys = list(total)
    columns = [pa.array([k[i] for k in keys], pa.int32()) for i in range(3)]
    columns.append(pa.array([total[k][0] for k in keys], pa.int64()))
    columns += [pa.array([total[k][i].tobytes() for k in keys], pa.binary()) for i in (1, 2)]
    return pa.RecordBatch.from_arrays(columns, names=["by", "y", "cell", "n", *_VIEWS])


_SUMS = "by int, y int, cell int, n long, content binary, metadata binary"


def _added_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[tuple[int, int, int], list] = {}
    for batch in batches:
        for row in batch.to_pylist():
            sums = total.setdefault((row["by"], row["y"], row["cell"]), [0, 0.0, 0.0])
            sums[0] += row["n"]
            for i, name in enumerate(_VIEWS, 1):
                sums[i] = sums[i] + np.frombuffer(row[name], np.float64)
    yield _sum_rows(total)


def train(
    scratch: Scratch, documents: DataFrame, labels: DataFrame, label: str, rounds: int = ROUNDS
) -> tuple[Logistic, Logistic, float] | None:
    """The two calibrated views and the labelled documents' log odds; None without both classes."""
    order = [F.xxhash64("doc_id"), "doc_id"]
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1))
    known = known.groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    sample = known.orderBy(*order).limit(LABELLED)
    found = scratch.save(documents.join(sample, "doc_id").mapInArrow(_extract, _LABELLED), "labelled")
    # A repeated document counts once, so the bound holds.
    rows = found.groupBy("doc_id").agg(F.min(F.struct("y", *_VIEWS)).alias("r")).select("doc_id", "r.*")
    rows = sorted(rows.collect(), key=lambda r: r["doc_id"])
    y = np.array([r["y"] for r in rows])
    aside = np.array([i % CALIBRATES == 0 for i in range(len(rows))], bool)
    if len(set(y[~aside])) < 2 or len(set(y[aside])) < 2:
        return None
    x = [_unpacked(rows, "content", CONTENT), _unpacked(rows, "metadata", METADATA)]
    used = np.array([r["doc_id"] for r in rows], np.int64)

    def fitted(given: list) -> tuple[Logistic, Logistic]:
        models = []
        for to, own in enumerate(x):
            a, b, w = [own[~aside]], [y[~aside]], [np.ones((~aside).sum())]
            for value in (0, 1):
                cells = [r for r in given if r["by"] != to and r["y"] == value]
                if cells:
                    n = np.array([r["n"] for r in cells], np.float64)
                    means = [np.frombuffer(r[_VIEWS[to]], np.float64) / r["n"] for r in cells]
                    a.append(np.array(means, np.float32))
                    b.append(np.full(len(cells), value))
                    w.append(n / n.sum() * GIVEN_WEIGHT * (y[~aside] == value).sum())
            model = fit(np.vstack(a), np.concatenate(b), np.concatenate(w), len(a[0]))
            models.append(calibrate(model, own[aside], y[aside]))
        return tuple(models)

    given: list = []
    for round_ in range(rounds):
        sums = documents.mapInArrow(_sure_sums(fitted(given), used), _SUMS)
        added = sums.repartition("by", "y", "cell").mapInArrow(_added_sums, _SUMS)
        # A row for each view, class and cell.
        given = sorted(added.collect(), key=lambda r: (r["by"], r["y"], r["cell"]))
        if not given:
            break
    odds = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    return (*fitted(given), odds)


def _score(models: tuple[Logistic, Logistic, float]):
    content_model, metadata_model, odds = models

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            content, metadata = features(batch)
            a, b = content_model.logits(content), metadata_model.logits(metadata)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(sigmoid(a)),
                    pa.array(sigmoid(b)),
                    pa.array(sigmoid(a + b - odds)),
                ],
                names=["doc_id", "content_score", "metadata_score", "score"],
            )

    return run


def quality_scores(
    spark: SparkSession, documents: DataFrame, labels: DataFrame, label: str = "quality", rounds: int = ROUNDS
) -> DataFrame:
    """``doc_id, content_score, metadata_score, score, kept`` of every document.

    Scores are probabilities of the label 1; ``score`` adds up the views' log odds and
    takes off the labelled documents' own, as for views that are independent given the
    label. Labels other than 0 and 1 and those without an id are ignored; of different
    labels of a document the larger counts. Null texts are empty, null languages and
    sources are values of their own. Without labelled documents of both classes, all
    scores are 0.5 and all documents kept. One row per input row.
    """
    small_batches(spark)
    rows = documents.select(
        "doc_id",
        "text",
        "lang",
        "source",
        F.coalesce(F.char_length("text"), F.lit(0)).cast("double").alias("chars"),
    )
    models = train(Scratch(spark), rows, labels, label, rounds)
    if models is None:
        half = F.lit(0.5)
        scored = rows.select(
            "doc_id", half.alias("content_score"), half.alias("metadata_score"), half.alias("score")
        )
    else:
        scored = rows.mapInArrow(
            _score(models), "doc_id long, content_score double, metadata_score double, score double"
        )
    return scored.withColumn("kept", F.col("score") >= KEPT_FROM)


def op2_cotrained_quality(spark: SparkSession, folder: str) -> DataFrame:
    """The quality of every document."""
    return quality_scores(
        spark, read_table(spark, folder, "documents"), read_table(spark, folder, "labels")
    )
