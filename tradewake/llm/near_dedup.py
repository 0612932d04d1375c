"""Near-duplicates by MinHash bands and odd sketches, confirmed on whole shingle sets.

1. Texts with the same set of shingles become one node (its smallest document id).
2. MinHash bands put nodes into buckets. Every node is paired with the smallest node of
   each of its buckets, so a bucket costs as many pairs as it has members.
3. An odd sketch (the parity bitmap of all MinHash samples) estimates the similarity of
   a pair from one XOR and a population count; pairs far below the threshold end there.
   A second parity bitmap of the whole set, with which sets of up to some 2,000 shingles
   are told apart more sharply, counts the shingles that only one text has.
4. The rest is decided on the full sets. Confirmed pairs are links, links give components.
5. A bucket whose members are still in more than one component may hold a link that step
   2 did not look at. Blocks of sketches are compared there, first for each node's best
   partner in each other component, and when these are decided, for all that is left.

Steps 2 and 5 together see every pair that shares a bucket, other than pairs already in
one component, and no step gathers a bucket or lists the pairs inside a component.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tradewake.llm import words as H
from tradewake.llm.components import components, extended
from tradewake.llm.shared import Scratch, read_table, row_mark, small_batches

WIDTH = 5
PERCENT = 75

# A pair at the threshold misses all bands with probability (1 - 0.75^4)^32 = 5e-6.
BANDS, BAND_ROWS = 32, 4
SAMPLES = 256
BITS = 512
# Sketches of pairs at the threshold differ by 101 bits, give or take 10. Pairs pass up
# to the distance that stands for this similarity, which is 5 deviations away.
FLOOR = 0.55
LIMIT = int(BITS / 2 * (1 - math.exp(-4 * SAMPLES * (1 - FLOOR) / BITS)))

# Bits of the parity bitmap of the whole set.
SET_BITS = 1024

# Texts compared with one copy of a hub's text, and sketches in a block.
CELL = 256
BLOCK = 2048

_FACTORS = (H._drawn(SAMPLES, 7) & H.U64(0xFFFFFFFF)).astype(np.uint32) | np.uint32(1)
_SALTS = H._drawn(SAMPLES, 8)
_ROW_FACTORS = H._drawn(BAND_ROWS, 9) | H.U64(1)
_BAND_SALTS = H._drawn(BANDS, 10)

SKETCH = [f"s{i}" for i in range(BITS // 64)]
PARITY = [f"p{i}" for i in range(SET_BITS // 64)]
_KNOWN = ["n_shingles", *SKETCH, *PARITY]
_SIGNED = (
    "doc_id long, row_mark long, n_shingles long, high long, low long, "
    + ", ".join(f"{s} long" for s in SKETCH + PARITY)
    + ", bands array<long>"
)


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text.

    A text of one to four words has one shingle, its whole sequence; one without words
    and a null text have none.
    """
    words, bounds = H.word_hashes(texts, lower=True)
    for begin, end in zip(bounds[:-1], bounds[1:]):
        own = words[begin:end]
        if len(own) >= WIDTH:
            yield np.unique(H.shingle_hashes(own, WIDTH))
        elif len(own):
            yield H.span_hashes(own, np.array([0]), np.array([len(own)]))
        else:
            yield own


def samples(shingles: np.ndarray) -> np.ndarray:
    """The MinHash samples of a set that is not empty."""
    x = shingles.astype(np.uint32)
    least = np.full(SAMPLES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 1024):
        np.minimum(least, (_FACTORS[:, None] * x[at : at + 1024]).min(axis=1), out=least)
    return least


def _parity(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Which of ``bits`` bits are set an odd number of times, as 64-bit numbers."""
    bit = (hashes % H.U64(bits)).astype(np.int64)
    return np.packbits((np.bincount(bit, minlength=bits) & 1).astype(np.uint8)).view(np.int64)


def odd_sketch(sampled: np.ndarray) -> np.ndarray:
    return _parity(H.mix(sampled.astype(H.U64) ^ _SALTS), BITS)


def set_parity(shingles: np.ndarray) -> np.ndarray:
    return _parity(shingles >> H.U64(32), SET_BITS)


def set_limit(shingles: np.ndarray) -> np.ndarray:
    """How far set parities of similar sets may differ, for sets of so many shingles in sum.

    At the threshold a seventh of the sum is in one set only; the expected distance for
    so many differences and six deviations.
    """
    share = (100 - PERCENT) / (100 + PERCENT) * shingles
    gone = np.exp(-4 * share / SET_BITS)
    return SET_BITS / 2 * (1 - np.sqrt(gone)) + 6 * np.sqrt(SET_BITS / 4 * (1 - gone) - share * gone) + 2


def band_keys(sampled: np.ndarray) -> np.ndarray:
    rows = sampled[: BANDS * BAND_ROWS].reshape(BANDS, BAND_ROWS).astype(H.U64)
    return H.mix((rows * _ROW_FACTORS).sum(axis=1, dtype=H.U64) ^ _BAND_SALTS)


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = batch.num_rows
        count = np.zeros(n, np.int64)
        digest = np.zeros((n, 2), np.int64)
        sketch = np.zeros((n, len(SKETCH)), np.int64)
        parity = np.zeros((n, len(PARITY)), np.int64)
        bands = []
        for i, shingles in enumerate(shingle_sets(batch.column("text"))):
            count[i] = len(shingles)
            if len(shingles):
                digest[i] = np.frombuffer(hashlib.md5(shingles.tobytes()).digest(), np.int64)
                sampled = samples(shingles)
                sketch[i] = odd_sketch(sampled)
                parity[i] = set_parity(shingles)
                bands.append(band_keys(sampled))
        ends = np.concatenate([[0], np.cumsum(np.where(count > 0, BANDS, 0))]).astype(np.int32)
        flat = H.as_long(np.concatenate(bands)) if bands else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                batch.column("row_mark"),
                pa.array(count),
                *(pa.array(np.ascontiguousarray(c)) for c in digest.T),
                *(pa.array(np.ascontiguousarray(c)) for c in sketch.T),
                *(pa.array(np.ascontiguousarray(c)) for c in parity.T),
                pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)),
            ],
            names=["doc_id", "row_mark", "n_shingles", "high", "low", *SKETCH, *PARITY, "bands"],
        )


def near_sketches(left: str, right: str) -> Column:
    """Whether two nodes' sketches allow that their sets are similar."""

    def differ(columns: list[str]) -> Column:
        bits = [F.bit_count(F.col(f"{left}.{c}").bitwiseXOR(F.col(f"{right}.{c}"))) for c in columns]
        return sum(bits, F.lit(0))

    share = (100 - PERCENT) / (100 + PERCENT) * (F.col(f"{left}.n_shingles") + F.col(f"{right}.n_shingles"))
    gone = F.exp(-4 * share / SET_BITS)
    limit = SET_BITS / 2 * (1 - F.sqrt(gone)) + 6 * F.sqrt(SET_BITS / 4 * (1 - gone) - share * gone) + 2
    return (differ(SKETCH) <= LIMIT) & (differ(PARITY) <= limit)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets reach the similarity."""
    small, large = sorted((len(a), len(b)))
    if 100 * small < PERCENT * large:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= PERCENT * (len(a) + len(b) - both)


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a cell, the hub's first, to the pairs of the hub that are similar."""
    cell, hub = None, []
    for batch in batches:
        left, right = [], []
        place = zip(*(batch.column(c).to_pylist() for c in ("a", "cell", "b", "is_hub")))
        for (a, part, b, is_hub), shingles in zip(place, shingle_sets(batch.column("text"))):
            if (a, part) != cell:
                cell, hub = (a, part), []
            if is_hub:
                if not any(np.array_equal(shingles, h) for h in hub):
                    hub.append(shingles)
            elif any(similar(h, shingles) for h in hub):
                left.append(a)
                right.append(b)
        yield pa.RecordBatch.from_arrays(
            [pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"]
        )


def confirmed(scratch: Scratch, texts: DataFrame, pairs: DataFrame, name: str) -> DataFrame:
    """The pairs (a, b) whose texts' full shingle sets reach the similarity.

    A hub a with many partners is split into cells of bounded size, each with its text.
    """
    cells = scratch.save(pairs.groupBy("a").agg(F.ceil(F.count("*") / CELL).alias("cells")), f"cells_{name}")
    members = pairs.join(cells, "a").select(
        "a", F.expr("pmod(xxhash64(b), cells)").alias("cell"), "b", F.lit(False).alias("is_hub")
    )
    hubs = cells.select(
        "a",
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("cells") - 1)).alias("cell"),
        F.col("a").alias("b"),
        F.lit(True).alias("is_hub"),
    )
    own = texts.withColumnRenamed("doc_id", "b")
    # Written, so that texts are read where they lie if few of them are asked for.
    asked = scratch.save(members.union(hubs), f"asked_{name}")
    rows = asked.join(own, "b").select("a", "cell", "b", "is_hub", "text")
    return (
        rows.repartition("a", "cell")
        .sortWithinPartitions("a", "cell", F.desc("is_hub"))
        .mapInArrow(_confirm, "a long, b long")
    )


def _block_pairs(best_only: bool):
    """Rows of a block pair, those to look up first, to the pairs whose sketches are near."""

    def compare(key: int, u: list, v: list) -> pa.RecordBatch:
        un, uc, us, ub = (np.concatenate(x) for x in zip(*u))
        vn, vc, vs, vb = (np.concatenate(x) for x in zip(*v))
        band = int(np.argmax(ub[0] == key))
        left, right = [], []
        for i in range(len(un)):
            bits = np.bitwise_count((vs[:, 1:] ^ us[i, 1:]).view(np.uint64))
            far = bits[:, : len(SKETCH)].sum(axis=1, dtype=np.int64)
            parity = bits[:, len(SKETCH) :].sum(axis=1, dtype=np.int64)
            limit = set_limit(vs[:, 0] + us[i, 0])
            near = np.flatnonzero((far <= LIMIT) & (parity <= limit) & (vc != uc[i]))
            if best_only and len(near):
                order = near[np.lexsort((vn[near], far[near], vc[near]))]
                near = order[np.unique(vc[order], return_index=True)[1]]
            elif len(near):  # a pair is put out in the first bucket that it shares
                near = near[~(vb[near, :band] == ub[i, :band]).any(axis=1)]
            left.append(np.full(len(near), un[i]))
            right.append(vn[near])
        a, b = np.concatenate(left), np.concatenate(right)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, u, v = None, [], []
        for batch in batches:
            key = np.stack([batch.column(c).to_numpy() for c in ("key", "i", "j")], axis=1)
            node, component = (batch.column(c).to_numpy() for c in ("node", "component"))
            sketch = np.stack([batch.column(c).to_numpy() for c in _KNOWN], axis=1)
            bands = batch.column("bands").flatten().to_numpy().reshape(-1, BANDS)
            asks = batch.column("asks").to_numpy(zero_copy_only=False)
            cut = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
            for begin, end in zip([0, *cut], [*cut, len(key)]):
                if begin == end:
                    continue
                if here is None or (key[begin] != here).any():
                    if u and v:
                        yield compare(here[0], u, v)
                    here, u, v = key[begin].copy(), [], []
                first = begin + int(asks[begin:end].sum())
                for rows, into in ((slice(begin, first), u), (slice(first, end), v)):
                    if rows.start < rows.stop:
                        into.append(tuple(x[rows].copy() for x in (node, component, sketch, bands)))
        if u and v:
            yield compare(here[0], u, v)

    return run


def open_pairs(
    scratch: Scratch, members: DataFrame, labels: DataFrame, nodes: DataFrame, best_only: bool, name: str
) -> tuple[DataFrame, DataFrame]:
    """Pairs of near sketches that share a bucket but not a component, and such buckets' members.

    In a bucket, the members outside its most frequent component are compared with all
    members of other components, block by block; a block pair holds 2 x BLOCK sketches.
    With ``best_only``, each block gives a node's nearest partner in each component.
    """
    owned = members.join(labels, "node", "left").select(
        "key", "node", F.coalesce("component", "node").alias("component")
    )
    mixed = scratch.save(
        owned.groupBy("key", "component")
        .agg(F.count("*").alias("n"))
        .groupBy("key")
        .agg(F.max_by("component", "n").alias("main"), F.sum("n").alias("n"), F.count("*").alias("kinds"))
        .where("kinds > 1")
        .select("key", "main", F.ceil(F.col("n") / BLOCK).alias("blocks")),
        f"mixed_{name}",
    )
    # Written for its size as well: what is still open is mostly little.
    still = scratch.save(owned.join(mixed, "key"), f"open_{name}")
    placed = still.join(nodes.select("node", *_KNOWN, "bands"), "node").withColumn(
        "block", F.expr("pmod(xxhash64(node), blocks)")
    )
    others = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    rest = ["node", "component", *_KNOWN, "bands"]
    asking = placed.where("component != main").select(
        "key", F.col("block").alias("i"), others.alias("j"), *rest, F.lit(True).alias("asks")
    )
    asked = placed.select(
        "key", others.alias("i"), F.col("block").alias("j"), *rest, F.lit(False).alias("asks")
    )
    pairs = (
        asking.union(asked)
        .repartition("key", "i", "j")
        .sortWithinPartitions("key", "i", "j", F.desc("asks"))
        .mapInArrow(_block_pairs(best_only), "a long, b long")
        .distinct()
    )
    return pairs, still.select("key", "node")


def near_duplicates(spark: SparkSession, documents: DataFrame) -> DataFrame:
    """``doc_id, row_mark, n_shingles, component_id, kept`` of every document row.

    Documents are linked if their shingle sets have a Jaccard similarity of 0.75 or
    more; the component is the smallest id that can be reached over links. Words are
    runs without ASCII white space, with A-Z as a-z. A null or wordless text has an
    empty set and no links. Rows that share an id are one document: what one links to,
    they all link to. A row without an id belongs to the component of a row with the
    same set and an id, or to none (null), and is then kept. ``row_mark`` is a hash of the
    text. Other columns are not read.
    """
    small_batches(spark)
    scratch = Scratch(spark)
    texts = documents.select("doc_id", row_mark()[1], "text")
    signed = scratch.save(texts.mapInArrow(_signatures, _SIGNED), "signed")

    filled = signed.where("n_shingles > 0")
    nodes = scratch.save(
        filled.groupBy("high", "low")
        .agg(F.min("doc_id").alias("node"), F.first(F.struct(*_KNOWN, "bands")).alias("x"))
        .select("high", "low", "node", "x.*"),
        "nodes",
    )
    known = nodes.where("node is not null")
    banded = known.select("node", F.explode("bands").alias("key"))
    buckets = banded.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("hub"))
    shared = scratch.save(buckets.where("n > 1").drop("n"), "buckets")
    members = scratch.save(banded.join(shared, "key").select("key", "node", "hub"), "members")
    # Texts that any pair can ask for; their number grows with the input, so both sides
    # are shuffled, once for all that follows.
    asked = members.select(F.col("node").alias("doc_id")).distinct()
    texts = scratch.save(texts.select("doc_id", "text").join(asked.hint("merge"), "doc_id"), "texts")

    # Rows of one document with different texts hold its nodes together.
    differ = F.expr("min(high) != max(high) or min(low) != max(low)").alias("differ")
    torn = signed.where("doc_id is not null").groupBy("doc_id").agg(differ).where("differ").select("doc_id")
    own = signed.join(scratch.save(torn, "torn"), "doc_id").select("doc_id", "n_shingles", "high", "low")
    held = own.join(nodes.select("high", "low", "node"), ["high", "low"], "left").select(
        F.when(F.col("n_shingles") > 0, F.col("node")).otherwise(F.col("doc_id")).alias("a"), F.col("doc_id").alias("b")
    )
    links = scratch.save(held.where("a != b").distinct(), "links_0")

    pairs = members.where("node != hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    sketches = known.select("node", *_KNOWN)
    near = scratch.save(
        pairs.join(sketches.alias("l"), F.col("a") == F.col("l.node"))
        .join(sketches.alias("r"), F.col("b") == F.col("r.node"))
        .where(near_sketches("l", "r"))
        .select("a", "b"),
        "near_0",
    )
    links = links.union(scratch.save(confirmed(scratch, texts, near, "1"), "links_1"))
    labels = scratch.save(components(scratch, links, "components_1"), "labels_1")
    looked_at = near
    # A node's best partner may have been looked at in vain, and another one not at all.
    for step, best_only in ((2, True), (3, False)):
        pairs, members = open_pairs(scratch, members, labels, known, best_only, str(step))
        near = scratch.save(pairs.join(looked_at, ["a", "b"], "left_anti"), f"near_{step}")
        if near.isEmpty():
            continue
        looked_at = looked_at.union(near)
        more = scratch.save(confirmed(scratch, texts, near, str(step)), f"links_{step}")
        if not more.isEmpty():
            labels = extended(scratch, labels, more, f"components_{step}")

    found = (
        signed.select("doc_id", "row_mark", "n_shingles", "high", "low")
        .join(nodes.select("high", "low", "node"), ["high", "low"], "left")
        .withColumn("node", F.when(F.col("n_shingles") > 0, F.col("node")).otherwise(F.col("doc_id")))
        .join(labels, "node", "left")
    )
    component = F.coalesce("component", "node", "doc_id")
    return found.select(
        "doc_id",
        "row_mark",
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, component.isNull()).alias("kept"),
    )


def without_near_duplicates(spark: SparkSession, documents: DataFrame) -> DataFrame:
    """One document of each group of near-duplicates, with all its columns.

    It is the one with the smallest id; of rows that are the same document twice, one
    stays. Rows without an id, whose set no row with an id has, stay.
    """
    key = ["row_id", "row_mark"]
    verdicts = near_duplicates(spark, documents).where("kept")
    kept = verdicts.select(F.coalesce("doc_id", F.lit(-(2**63))).alias("row_id"), "row_mark").distinct()
    rows = documents.select(F.struct(*documents.columns).alias("row"), *row_mark())
    # What is kept grows with the documents, so it is not left to be broadcast.
    one = rows.join(kept.hint("merge"), key).dropDuplicates(key)
    return one.select(*[F.col("row").getField(c).alias(c) for c in documents.columns])


def op3_minhash_odd_sketches(spark: SparkSession, folder: str) -> DataFrame:
    """The near-duplicate component of every document."""
    found = near_duplicates(spark, read_table(spark, folder, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", "kept")
