"""Language proportions of texts by expectation-maximisation over n-gram likelihoods.

Each language is a distribution over hashed byte trigrams of lower-cased letters. A text
is a mixture of languages; expectation-maximisation gives the proportions. Languages
join the mixture one by one, as long as the likelihood gains more than a penalty.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradewake.llm import words as H
from tradewake.llm.shared import Scratch, read_table, small_batches

BUCKET_BITS = 14
BUCKETS = 1 << BUCKET_BITS
UNKNOWN = "und"
HELD_OUT = 2

# Added to each count.
SMOOTH = 0.5
# Overlapping trigrams share their letters, so their log-likelihoods count a third.
OVERLAP = 3
EM_STEPS, EM_CHANGE = 40, 1e-4
# Languages whose counts one task holds before it passes them on.
HELD_LANGUAGES = 64

# Bytes that stay: small letters and all beyond ASCII. Everything else is a gap.
_KEPT = np.zeros(256, np.uint8)
_KEPT[97:123] = np.arange(97, 123)
_KEPT[128:] = np.arange(128, 256)


def trigrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hashed trigrams of all texts, and where each text's begin.

    Runs of other characters count as one gap; a trigram has no two gaps side by side.
    """
    data, offsets = H.text_buffer(pc.utf8_lower(texts.cast(pa.large_string())))
    found, places = [np.zeros(0, np.int16)], [np.zeros(0, np.int64)]
    for at in range(0, len(data), H.PIECE):
        piece = _KEPT[data[at : at + H.PIECE + 2]].astype(np.uint32)
        if len(piece) < 3:
            break
        a, b, c = piece[:-2], piece[1:-1], piece[2:]
        good = ((a | b) > 0) & ((b | c) > 0)
        cut = offsets[(offsets > at) & (offsets < at + len(piece))] - at
        good[np.maximum(cut - 1, 0)[cut - 1 < len(good)]] = False
        good[(cut - 2)[(cut >= 2) & (cut - 2 < len(good))]] = False
        place = np.flatnonzero(good)
        code = (a | b << np.uint32(8) | c << np.uint32(16))[place] * np.uint32(0x9E3779B1)
        found.append((code >> np.uint32(32 - BUCKET_BITS)).astype(np.int16))
        places.append(place + at)
    return np.concatenate(found), np.searchsorted(np.concatenate(places), offsets)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Labelled texts to the counts of each language's trigrams."""
    held: dict[str, np.ndarray] = {}

    def put_out() -> Iterator[pa.RecordBatch]:
        for lang, counts in held.items():
            bucket = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(bucket), pa.string()), pa.array(bucket.astype(np.int32)), pa.array(counts[bucket])],
                names=["lang", "bucket", "n"],
            )
        held.clear()

    for batch in batches:
        gram, bounds = trigrams(batch.column("text"))
        coded = batch.column("lang").dictionary_encode()
        of = np.repeat(coded.indices.to_numpy(), np.diff(bounds))
        for i, lang in enumerate(coded.dictionary.to_pylist()):
            own = np.bincount(gram[of == i], minlength=BUCKETS).astype(np.int64)
            held[lang] = held[lang] + own if lang in held else own
        if len(held) > HELD_LANGUAGES:
            yield from put_out()
    yield from put_out()


def _probabilities(counted: pa.Table) -> pa.Table:
    counts = np.zeros(BUCKETS)
    counts[counted.column("bucket").to_numpy()] = counted.column("n").to_numpy()
    p = (counts + SMOOTH) / (counts.sum() + SMOOTH * BUCKETS)
    return pa.table({"lang": counted.column("lang")[:1], "p": pa.array([p.astype("<f4").tobytes()], pa.binary())})


def learn(scratch: Scratch, labelled: DataFrame) -> dict[str, np.ndarray]:
    """Trigram probabilities of each language, from all of ``lang, text``.

    The model has one row of 64 kB per language and is all that reaches the driver.
    """
    counted = scratch.save(
        labelled.select("lang", "text")
        .mapInArrow(_counts, "lang string, bucket int, n long")
        .groupBy("lang", "bucket")
        .agg(F.sum("n").alias("n")),
        "counts",
    )
    rows = counted.groupBy("lang").applyInArrow(_probabilities, "lang string, p binary").collect()
    return {r["lang"]: np.frombuffer(r["p"], "<f4") for r in sorted(rows, key=lambda r: r["lang"])}


def mixture(p: np.ndarray, counts: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The proportions that maximise the likelihood, and each trigram's probability.

    ``p`` has a row per language and a column per trigram, ``share`` is where to start.
    """
    total = counts.sum()
    for _ in range(EM_STEPS):
        joint = p * share[:, None]
        mixed = joint.sum(axis=0)
        moved = joint @ (counts / mixed) / total
        done = np.abs(moved - share).max() < EM_CHANGE
        share = moved
        if done:
            break
    return share, share @ p


def proportions(p: np.ndarray, counts: np.ndarray) -> dict[int, float]:
    """The languages of a text and their proportions.

    Starts from the likeliest single language. The likelihood is concave in the
    proportions, so its slope towards a language bounds what the language can gain;
    only languages whose bound is above the penalty are tried.
    """
    total = counts.sum()
    penalty = OVERLAP * (0.5 * math.log(total) + 1.0)
    single = np.log(p) @ counts
    chosen = [int(np.argmax(single))]
    share, mixed = np.ones(1), p[chosen[0]]
    likelihood = float(single[chosen[0]])
    while len(chosen) < len(p):
        bound = p @ (counts / mixed) - total
        bound[chosen] = 0
        best = None
        for other in np.flatnonzero(bound > penalty):
            tried = [*chosen, int(other)]
            moved, probability = mixture(p[tried], counts, np.append(share * 0.8, 0.2))
            value = float(np.log(probability) @ counts)
            if best is None or value > best[0]:
                best = (value, tried, moved, probability)
        if best is None or best[0] - likelihood <= penalty:
            break
        likelihood, chosen, share, mixed = best
    return {c: float(s) for c, s in zip(chosen, share)}


def _predict(model: dict[str, np.ndarray]):
    names = list(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.stack(list(model.values())).astype(np.float64) if model else None
        for batch in batches:
            gram, bounds = trigrams(batch.column("text"))
            lettered = batch.column("lettered").to_numpy(zero_copy_only=False)
            found = []
            for i, (begin, end) in enumerate(zip(bounds[:-1], bounds[1:])):
                if table is None or not lettered[i]:
                    found.append([])
                    continue
                bucket, counts = np.unique(gram[begin:end], return_counts=True)
                if len(bucket):
                    own = proportions(table[:, bucket], counts.astype(np.float64))
                else:  # letters, but no trigram: all languages are as likely
                    own = {c: 1 / len(names) for c in range(len(names))}
                found.append(sorted(((names[c], s) for c, s in own.items()), key=lambda x: (-x[1], x[0])))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("held_out"),
                    pa.array([f[0][0] if f else UNKNOWN for f in found], pa.string()),
                    pa.array([min(1.0, f[0][1]) if f else 0.0 for f in found], pa.float64()),
                    pa.array([[x for x, _ in f] for f in found], pa.list_(pa.string())),
                    pa.array([[s for _, s in f] for f in found], pa.list_(pa.float64())),
                ],
                names=["doc_id", "held_out", "lang_pred", "score", "languages", "shares"],
            )

    return run


def identify_languages(spark: SparkSession, documents: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, languages, shares`` of every document.

    Learns from all documents with a lang whose crc32(doc_id as text) mod 4 is not 2;
    a document without an id is not learned from and not held out. ``lang_pred`` is the
    language with the largest share and ``score`` that share; all are in ``languages``
    and ``shares``. A null text, one without a letter, and any text if nothing was
    learned, is ``und`` with score 0. One row per input row; other columns are not read.
    """
    small_batches(spark)
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    labelled = documents.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold != HELD_OUT))
    model = learn(Scratch(spark), labelled)
    rows = documents.select(
        "doc_id",
        F.coalesce(fold == HELD_OUT, F.lit(False)).alias("held_out"),
        F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("lettered"),
        "text",
    )
    return rows.mapInArrow(
        _predict(model),
        "doc_id long, held_out boolean, lang_pred string, score double, "
        "languages array<string>, shares array<double>",
    )


def op6_language_mixtures(spark: SparkSession, folder: str) -> DataFrame:
    """The predicted language of every document."""
    found = identify_languages(spark, read_table(spark, folder, "documents"))
    return found.select("doc_id", "held_out", "lang_pred", "score", "languages")
