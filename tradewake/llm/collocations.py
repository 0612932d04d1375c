"""Collocations by stripes: each prefix keys a counter of the words that follow it.

A stripe is a prefix of words with the counts of its next words and, under ``OWN``, of the
prefix itself. Tasks build stripes for what they read, Spark merges equal ones element by
element, and the merged cells give all that is asked for: a cell is the count of an
extension, the ``OWN`` cell the prefix's total, and the greatest cell of a phrase's stripe
(and of the phrases that it ends) says whether a longer phrase subsumes it.

1. Words are counted, by their text. A phrase can only be frequent if its words are.
2. Runs of 2, 3, ... words whose two shorter runs may be frequent are counted by the bits
   of a key. A run cannot be frequent unless all runs with its bits together are.
3. Stripes are built of the runs that are left, by the words themselves.

What may be frequent is told by bitmaps of a bounded size; a wrong yes costs a row and
nothing else, since the stripes count all occurrences of what they hold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tradewake.llm import words as H
from tradewake.llm.shared import Scratch, read_table, small_batches, text_or_empty

LEAST = 100
LONGEST = 5
TOP = 2000
PERCENT = 100

# What ends a piece, and what separates words in it.
PIECE_ENDS = b".,;:!?" + bytes(range(0x0A, 0x0E))
WORD_BLANKS = b"\x20\x09"
NO_LANG = "und"

# The key of a prefix's own count in its stripe; no word has this number.
OWN = 0

# Bits of a bitmap: eight for each member, within these bounds (8 MB at most).
BITS_LEAST, BITS_MOST = 20, 26
# Runs of a range of keys, at most.
RANGE = 1 << 21
# A first word that has at least one in HOT of all words gets SHARDS shards for each of its
# stripes; there are at most HOT such words.
HOT, SHARDS = 2000, 64
# Cells that a task holds before it puts them out.
CELLS = 1 << 20
# Word numbers are drawn anew if a frequent word shares its number with another word.
SEEDS = 4
# Parts in which the phrases of a language are ranked first.
PARTS = 256

_FACTORS = H._drawn(64, 21) | H.U64(1)
# Stripes of a range: their languages, their prefixes one after the other, how many cells
# each has, and all cells.
_PACKED = (
    "range int, size int, langs array<string>, prefixes array<long>, cells array<int>, "
    "next array<long>, n array<long>"
)
_CELL = "lang string, prefix array<long>, next long, n long"


def lang_salts(langs: pa.Array) -> np.ndarray:
    """A number for each language, the same in every task."""
    data, offsets = H.text_buffer(langs)
    return H.span_hashes(H._BYTE[data], offsets[:-1], offsets[1:])


class Reader:
    """Words of batches of texts as numbers, in pieces of bounded size."""

    def __init__(self, seed: int):
        self.byte = H._drawn(256, 1000 + seed)
        self.is_word = H.word_mask(PIECE_ENDS + WORD_BLANKS)
        self.is_end = ~H.word_mask(PIECE_ENDS)
        self.langs: dict[str, int] = {}
        self._salts = np.zeros(0, H.U64)

    def salts(self) -> np.ndarray:
        """A number for each language met so far."""
        if len(self._salts) < len(self.langs):
            self._salts = lang_salts(pa.array(list(self.langs), pa.string()))
        return self._salts

    def read(self, batch: pa.RecordBatch, keep: int) -> Iterator[tuple]:
        """(word numbers, joined, language, how many are old, bytes, begins, ends) by piece.

        ``joined`` says whether a word follows the one before it within its text and piece.
        The last ``keep`` words of a piece come again, as old ones, before the next one's.
        """
        data, offsets = H.text_buffer(batch.column("text"))
        lang = batch.column("lang").dictionary_encode()
        names = [self.langs.setdefault(x, len(self.langs)) for x in lang.dictionary.to_pylist()]
        lang = np.array(names, np.int64)[lang.indices.to_numpy()]
        numbers, joins, langs = np.zeros(0, H.U64), np.zeros(0, bool), np.zeros(0, np.int64)
        last_end, last_text = 0, -1
        for at, begin, end in H.word_pieces(data, offsets, self.is_word):
            if not len(begin):
                continue
            piece = H.lowered(data[at : at + int(end[-1])])
            number = H.span_hashes(self.byte[piece], begin, end)
            number[number == OWN] = 1
            text = np.searchsorted(offsets, begin + at, "right") - 1
            ends = np.concatenate([[0], np.cumsum(self.is_end[piece], dtype=np.int32)])
            joined = np.empty(len(begin), bool)
            joined[1:] = (text[1:] == text[:-1]) & (ends[begin[1:]] == ends[end[:-1]])
            joined[0] = text[0] == last_text and not self.is_end[data[last_end : at + begin[0]]].any()
            last_end, last_text = at + int(end[-1]), text[-1]
            numbers, joins = np.concatenate([numbers, number]), np.concatenate([joins, joined])
            langs = np.concatenate([langs, lang[text]])
            yield numbers, joins, langs, len(numbers) - len(number), piece, begin, end
            numbers, joins, langs = (x[len(x) - keep :] if keep else x[:0] for x in (numbers, joins, langs))


def _slices(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> pa.Array:
    """data[begin:end] of each pair as strings."""
    size = end - begin
    bound = np.concatenate([[0], np.cumsum(size)])
    flat = data[np.repeat(begin - bound[:-1], size) + np.arange(bound[-1])]
    return pa.LargeStringArray.from_buffers(len(begin), pa.py_buffer(bound.astype(np.int64)), pa.py_buffer(flat))


def _table(lang: np.ndarray, number: np.ndarray, word: pa.Array, n: np.ndarray) -> pa.Table:
    return pa.table({"lang": lang, "number": number, "word": word, "n": n})


def _words(seed: int):
    """Texts to (lang, number, word, n), and each language's total under the number OWN."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(seed)
        held: list[pa.Table] = []
        rows = 0

        def merged() -> pa.Table:
            return (
                pa.concat_tables(held)
                .group_by(["lang", "number", "word"])
                .aggregate([("n", "sum")])
                .rename_columns(["lang", "number", "word", "n"])
            )

        for batch in batches:
            for numbers, _, langs, _, data, begin, end in reader.read(batch, 0):
                spelled = _slices(data, begin, end).dictionary_encode()
                keys = langs * len(spelled.dictionary) + spelled.indices.to_numpy()
                _, first, n = np.unique(keys, return_index=True, return_counts=True)
                word = spelled.dictionary.take(spelled.indices.take(pa.array(first)))
                held.append(_table(langs[first], H.as_long(numbers[first]), word, n))
                which, n = np.unique(langs, return_counts=True)
                blank = pa.array([""] * len(n), pa.large_string())
                held.append(_table(which, np.full(len(n), OWN), blank, n))
                rows += len(first)
            if rows > CELLS:
                held = [merged()]
                rows = held[0].num_rows
                if rows > CELLS // 2:
                    yield from _named(held[0], reader.langs)
                    held, rows = [], 0
        if held:
            yield from _named(merged(), reader.langs)

    return run


def _named(table: pa.Table, langs: dict[str, int]) -> Iterator[pa.RecordBatch]:
    """The table with names for the numbers of languages, in bounded batches."""
    names = pa.array(list(langs), pa.string()).take(table.column("lang").combine_chunks())
    table = table.set_column(0, "lang", names)
    table = table.set_column(2, "word", table.column("word").cast(pa.string()))
    yield from table.to_batches(max_chunksize=1 << 16)


class Bitmap:
    """Which keys may be members: one bit for each, found by the key's upper bits."""

    def __init__(self, bits: int, at: np.ndarray, words: np.ndarray):
        self.shift = 64 - bits
        self.words = np.zeros(1 << (bits - 6), H.U64)
        self.words[at] = words

    def holds(self, keys: np.ndarray) -> np.ndarray:
        place = keys >> H.U64(self.shift)
        return (self.words[(place >> H.U64(6)).astype(np.int64)] >> (place & H.U64(63)) & H.U64(1)).astype(bool)


def run_keys(columns: list[np.ndarray], salt: np.ndarray) -> np.ndarray:
    """A key for each run of words (one array of numbers for each place) of a language."""
    total = salt.copy()
    for number, factor in zip(columns, _FACTORS):
        total = H.mix(total * factor + number)
    return total


def runs_at(numbers: np.ndarray, salts: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """The keys of the runs of ``size`` words that end at the given places."""
    return run_keys([numbers[at - size + 1 + i] for i in range(size)], salts[at])


def longer_runs(joined: np.ndarray, fit: np.ndarray) -> np.ndarray:
    """Where a run ends whose two runs of one word less both may be frequent."""
    return np.flatnonzero(joined[1:] & fit[:-1] & fit[1:]) + 1


def likely_runs(numbers: np.ndarray, joined: np.ndarray, salts: np.ndarray, filters: list[Bitmap]) -> list[np.ndarray]:
    """For runs of 1, 2, ... words: whether the one that ends at a place may be frequent."""
    fits: list[np.ndarray] = []
    for size, likely in enumerate(filters, 1):
        at = longer_runs(joined, fits[-1]) if fits else np.arange(len(numbers))
        fit = np.zeros(len(numbers), bool)
        fit[at] = likely.holds(runs_at(numbers, salts, at, size))
        fits.append(fit)
    return fits


def _added(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Equal keys once, in order, with the sums of their counts."""
    key, n = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key)
    key, n = key[order], n[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    return key[first], np.add.reduceat(n, first) if len(first) else n


def _run_counts(seed: int, filters: list[Bitmap], range_bits: int):
    """Texts to counts of runs one word longer than the filters know of.

    A run is told by the upper bits of its key: a range and the 32 bits after it. Counts
    are bytes; a larger one takes several entries.
    """
    size = len(filters) + 1

    def packed(keys: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        entries = (n + 254) // 255
        last = np.cumsum(entries) - 1
        low = np.repeat((keys >> H.U64(32 - range_bits)).astype(np.uint32), entries)
        part = np.full(len(low), 255, np.uint8)
        part[last] = n - 255 * (entries - 1)
        where = np.repeat((keys >> H.U64(64 - range_bits)).astype(np.int32), entries)
        first = np.flatnonzero(np.append(True, where[1:] != where[:-1]))
        bounds = list(zip(first, [*first[1:], len(where)]))
        for begin in range(0, len(bounds), 1 << 12):
            some = bounds[begin : begin + (1 << 12)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(where[[x for x, _ in some]]),
                    pa.array([low[x:y].tobytes() for x, y in some], pa.binary()),
                    pa.array([part[x:y].tobytes() for x, y in some], pa.binary()),
                ],
                names=["range", "low", "n"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(seed)
        keys, counts, rows = [], [], 0
        for batch in batches:
            for numbers, joined, langs, old, *_ in reader.read(batch, size - 1):
                salts = reader.salts()[langs]
                at = longer_runs(joined, likely_runs(numbers, joined, salts, filters)[-1])
                key, n = np.unique(runs_at(numbers, salts, at[at >= old], size), return_counts=True)
                keys.append(key)
                counts.append(n)
                rows += len(key)
            if rows > 2 * CELLS:
                key, n = _added(keys, counts)
                keys, counts, rows = [key], [n], len(key)
                if rows > CELLS:
                    yield from packed(key, n)
                    keys, counts, rows = [], [], 0
        if rows:
            yield from packed(*_added(keys, counts))

    return run


def _frequent(least: int, range_bits: int, bits: int):
    """Counts by range, in order of ranges, to the words of the bitmap of frequent runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            key, n = _added(lows, counts)
            known = H.U64(here) << H.U64(32) | key[n >= least].astype(H.U64)
            place = known >> H.U64(range_bits + 32 - bits)
            at, first = np.unique(place >> H.U64(6), return_index=True)
            bit = H.U64(1) << (place & H.U64(63))
            words = np.bitwise_or.reduceat(bit, first) if len(first) else bit
            return pa.RecordBatch.from_arrays([pa.array(H.as_long(at)), pa.array(H.as_long(words))], names=["at", "word"])

        here, lows, counts, rows, added = None, [], [], 0, 0
        for batch in batches:
            for where, low, n in zip(*(batch.column(c) for c in ("range", "low", "n"))):
                if where.as_py() != here:
                    if lows:
                        yield out()
                    here, lows, counts, rows, added = where.as_py(), [], [], 0, 0
                lows.append(np.frombuffer(low.as_buffer(), np.uint32).copy())
                counts.append(np.frombuffer(n.as_buffer(), np.uint8).astype(np.int64))
                rows += len(lows[-1])
                if rows > 2 * added + CELLS:
                    low, n = _added(lows, counts)
                    lows, counts, rows, added = [low], [n], len(low), len(low)
        if lows:
            yield out()

    return run


def frequent_runs(texts: DataFrame, seed: int, filters: list[Bitmap], least: int, total: int) -> Bitmap:
    """A bitmap of the runs one word longer than the filters know of that are frequent.

    Tasks pack the counts of a range of keys into one row, five bytes for a run, and
    ranges are added up apart. Ranges get smaller as the ``total`` of words grows.
    """
    range_bits = range_bits_of(total)
    bits = bitmap_bits(total // least)
    rows = texts.mapInArrow(_run_counts(seed, filters, range_bits), "range int, low binary, n binary")
    dealt = rows.repartition("range").sortWithinPartitions("range")
    return collected(dealt.mapInArrow(_frequent(least, range_bits, bits), "at long, word long"), bits)


def range_bits_of(total: int) -> int:
    """How many of a key's upper bits name its range, for so many words."""
    return min(24, max(6, (total // RANGE).bit_length()))


def bitmap_bits(members: int) -> int:
    return min(BITS_MOST, max(BITS_LEAST, (8 * members).bit_length()))


def collected(rows: DataFrame, bits: int) -> Bitmap:
    """The bitmap of (at, word) rows: at most one row for each 64 of its bits."""
    words = rows.groupBy("at").agg(F.bit_or("word").alias("word")).toArrow()
    return Bitmap(bits, words.column("at").to_numpy(), words.column("word").to_numpy().view(H.U64))


def _word_bits(bits: int):
    """Rows (lang, number) to the words of the bitmap that they set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lang = batch.column("lang").dictionary_encode()
            salts = lang_salts(lang.dictionary)[lang.indices.to_numpy()]
            place = np.unique(run_keys([batch.column("number").to_numpy().view(H.U64)], salts) >> H.U64(64 - bits))
            at, first = np.unique(place >> H.U64(6), return_index=True)
            words = np.bitwise_or.reduceat(H.U64(1) << (place & H.U64(63)), first)
            yield pa.RecordBatch.from_arrays([pa.array(H.as_long(at)), pa.array(H.as_long(words))], names=["at", "word"])

    return run


def combined(columns: list[np.ndarray], n: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Equal rows of the columns added up. The last column is sorted within the others.

    Rows are brought together by a hash and told apart by their values.
    """
    prefix = run_keys([c.astype(H.U64) for c in columns[:-1]], np.zeros(len(n), H.U64))
    order = np.lexsort((columns[-1], prefix))
    columns = [c[order] for c in columns]
    new = np.ones(len(n), bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    first = np.flatnonzero(new)
    return [c[first] for c in columns], np.add.reduceat(n[order], first)


class Stripes:
    """Cells of stripes whose prefixes have ``size`` words, combined as they come."""

    def __init__(self, size: int, hot: np.ndarray, range_bits: int):
        self.size, self.hot, self.range_bits = size, hot, range_bits
        self.held: list[tuple] = []
        self.rows = 0

    def add(self, lang: np.ndarray, prefix: list[np.ndarray], following: np.ndarray) -> None:
        if len(lang):
            cells = combined([lang, *prefix, following], np.ones(len(lang), np.int64))
            self.held.append(cells)
            self.rows += len(cells[1])

    def combine(self) -> None:
        columns = [np.concatenate(x) for x in zip(*(c for c, _ in self.held))]
        cells = combined(columns, np.concatenate([n for _, n in self.held]))
        self.held, self.rows = [cells], len(cells[1])

    def full(self) -> bool:
        if self.rows > CELLS:
            self.combine()
        return self.rows > CELLS // 2

    def out(self, langs: dict[str, int]) -> Iterator[pa.RecordBatch]:
        """The stripes, packed by ranges of their keys; those of hot first words in shards."""
        if not self.held:
            return
        self.combine()
        ((lang, *prefix, following), n), self.held, self.rows = self.held[0], [], 0
        at = np.minimum(np.searchsorted(self.hot, prefix[0]), max(len(self.hot) - 1, 0))
        is_hot = self.hot[at] == prefix[0] if len(self.hot) else np.zeros(len(n), bool)
        shard = np.where(is_hot, following % H.U64(SHARDS), H.U64(0))
        key = run_keys([*prefix, shard], lang_salts(pa.array(list(langs), pa.string()))[lang])
        where = (key >> H.U64(64 - self.range_bits)).astype(np.int32)
        order = np.lexsort((key, where))
        lang, following, n, key, where = (x[order] for x in (lang, following, n, key, where))
        prefix = [p[order] for p in prefix]
        new = np.append(True, np.any([c[1:] != c[:-1] for c in (key, lang, *prefix)], axis=0))
        stripe = np.flatnonzero(new)  # where each stripe begins
        row = np.flatnonzero(np.append(True, where[1:] != where[:-1]))  # where each range begins
        first = np.searchsorted(stripe, row)  # the first stripe of each range
        length = np.diff(np.append(stripe, len(n)))
        flat = np.stack([H.as_long(p[stripe]) for p in prefix], axis=1).ravel()

        def lists(bounds: np.ndarray, end: int, values: np.ndarray) -> pa.Array:
            return pa.ListArray.from_arrays(pa.array(np.append(bounds, end).astype(np.int32)), pa.array(values))

        named = pa.array(list(langs), pa.string()).take(pa.array(lang[stripe]))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(where[row]),
                pa.array(np.full(len(row), self.size, np.int32)),
                pa.ListArray.from_arrays(pa.array(np.append(first, len(stripe)).astype(np.int32)), named),
                lists(first * self.size, len(flat), flat),
                lists(first, len(stripe), length.astype(np.int32)),
                lists(row, len(n), H.as_long(following)),
                lists(row, len(n), n),
            ],
            names=["range", "size", "langs", "prefixes", "cells", "next", "n"],
        )


def _stripes(seed: int, filters: list[Bitmap], hot: np.ndarray, range_bits: int):
    """Texts to packed stripes; ``filters`` tell which runs of 1, 2, ... words may be frequent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(seed)
        stripes = [Stripes(size, hot, range_bits) for size in range(1, len(filters))]
        for batch in batches:
            for numbers, joined, langs, old, *_ in reader.read(batch, len(stripes)):
                fits = likely_runs(numbers, joined, reader.salts()[langs], filters)
                for stripe, own, longer in zip(stripes, fits, fits[1:]):
                    size = stripe.size
                    at = old + np.flatnonzero(own[old:])
                    prefix = [numbers[at - size + 1 + i] for i in range(size)]
                    stripe.add(langs[at], prefix, np.full(len(at), OWN, H.U64))
                    at = old + np.flatnonzero(longer[old:])
                    prefix = [numbers[at - size + i] for i in range(size)]
                    stripe.add(langs[at], prefix, numbers[at])
            for stripe in stripes:
                if stripe.full():
                    yield from stripe.out(reader.langs)
        for stripe in stripes:
            yield from stripe.out(reader.langs)

    return run


def _merge(least: int):
    """Packed stripes, in order of ranges and sizes, to the cells that reach ``least``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs: dict[str, int] = {}

        def out() -> Iterator[pa.RecordBatch]:
            columns, n = combined([np.concatenate(x) for x in zip(*held)], np.concatenate(counts))
            enough = np.flatnonzero(n >= least)
            lang, *prefix, following = (c[enough] for c in columns)
            flat = np.stack([H.as_long(p) for p in prefix], axis=1).ravel()
            bounds = np.arange(len(enough) + 1, dtype=np.int32) * len(prefix)
            cells = pa.RecordBatch.from_arrays(
                [
                    pa.array(list(langs), pa.string()).take(pa.array(lang)),
                    pa.ListArray.from_arrays(pa.array(bounds), pa.array(flat)),
                    pa.array(H.as_long(following)),
                    pa.array(n[enough]),
                ],
                names=["lang", "prefix", "next", "n"],
            )
            for begin in range(0, cells.num_rows, 1 << 15):
                yield cells.slice(begin, 1 << 15)

        here, held, counts, rows, added = None, [], [], 0, 0
        for batch in batches:
            for i in range(batch.num_rows):
                where, size, named, prefixes, cells, following, n = (batch.column(c)[i] for c in range(7))
                size = size.as_py()
                if (where.as_py(), size) != here:
                    if held:
                        yield from out()
                    here, held, counts, rows, added = (where.as_py(), size), [], [], 0, 0
                named = named.values.dictionary_encode()
                codes = np.array([langs.setdefault(x, len(langs)) for x in named.dictionary.to_pylist()], np.int64)
                length = cells.values.to_numpy()
                parts = prefixes.values.to_numpy().view(H.U64).reshape(-1, size)
                lang = np.repeat(codes[named.indices.to_numpy()], length)
                held.append((lang, *(np.repeat(p, length) for p in parts.T), following.values.to_numpy().view(H.U64).copy()))
                counts.append(n.values.to_numpy().copy())
                rows += len(counts[-1])
                if rows > 2 * added + CELLS:
                    columns, n = combined([np.concatenate(x) for x in zip(*held)], np.concatenate(counts))
                    held, counts, rows, added = [tuple(columns)], [n], len(n), len(n)
        if held:
            yield from out()

    return run


def merged(stripes: DataFrame, least: int) -> DataFrame:
    """``lang, prefix, next, n``: the cells of all stripes that reach ``least``.

    Stripes move whole, many of a range together, and are added up element by element
    where they arrive, a range at a time.
    """
    dealt = stripes.repartition("range").sortWithinPartitions("range", "size")
    return dealt.mapInArrow(_merge(least), _CELL)


def counted_words(scratch: Scratch, texts: DataFrame, least: int) -> tuple[DataFrame, int]:
    """``lang, number, word, n`` of frequent words and, as OWN, of languages; and the seed.

    Words are counted by their text. The seed is one with which no frequent word has the
    number of another word of its language.
    """
    for seed in range(SEEDS):
        counts = texts.mapInArrow(_words(seed), "lang string, number long, word string, n long")
        words = scratch.save(
            counts.groupBy("lang", "number")
            .agg(F.sum("n").alias("n"), F.min("word").alias("word"), F.max("word").alias("other"))
            .where(F.col("n") >= least),
            f"words_{seed}",
        )
        if words.where("word != other").isEmpty():
            return words.drop("other"), seed
    raise RuntimeError("words share their numbers with every seed")


def cells(spark: SparkSession, documents: DataFrame, least: int = LEAST, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """The words and the merged cells of all stripes whose count is at least ``least``."""
    small_batches(spark)
    scratch = Scratch(spark)
    texts = documents.select(F.coalesce("lang", F.lit(NO_LANG)).alias("lang"), text_or_empty().alias("text"))
    words, seed = counted_words(scratch, texts, least)
    single = words.where(F.col("number") != OWN)
    total = words.where(F.col("number") == OWN).agg(F.sum("n")).first()[0] or 0
    # At most HOT words can have so large a share.
    often = single.where(F.col("n") * HOT >= total).select("number").distinct().toArrow()
    hot = np.sort(often.column("number").to_numpy().view(H.U64))
    bits = bitmap_bits(total // least)
    filters = [collected(single.select("lang", "number").mapInArrow(_word_bits(bits), "at long, word long"), bits)]
    while len(filters) < longest:
        filters.append(frequent_runs(texts, seed, filters, least, total))
    stripes = texts.mapInArrow(_stripes(seed, filters, hot, range_bits_of(total)), _PACKED)
    return words, scratch.save(merged(stripes, least), "cells")


def score() -> Column:
    """floor(1000 a n / (l r)), with products of up to 38 digits."""
    a, n, left, right = (f"cast({c} as decimal(38,0))" for c in ("a", "n", "l", "r"))
    return F.expr(f"(1000BD * {a} * {n}) div ({left} * {right})")


def collocations(
    spark: SparkSession,
    documents: DataFrame,
    least: int = LEAST,
    longest: int = LONGEST,
    top: int = TOP,
    percent: int = PERCENT,
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's best phrases.

    Phrases have 2 to ``longest`` (at least 2) words, lie within a piece of text between
    punctuation marks or line ends, and occur at least ``least`` times; A-Z count as a-z.
    The score is floor(1000 a n / (l r)) of the phrase's weakest cut, the first of equal
    ones. A phrase inside a longer candidate with ``percent`` per cent of its occurrences
    or more is left out. Equal scores are ranked by a, then by the phrase's bytes. A null
    lang is ``und``, a null text is empty, repeated rows count as often as they occur; an
    empty table gives no rows. Other columns are not read. Counts are 64-bit, products
    have up to 38 digits.
    """
    scratch = Scratch(spark)
    words, found = cells(spark, documents, least, longest)
    phrase = F.concat("prefix", F.array("next")).alias("phrase")
    candidates = scratch.save(found.where(F.col("next") != OWN).select("lang", phrase, F.col("n").alias("a")), "candidates")
    totals = found.where(F.col("next") == OWN).select("lang", "prefix", "n")

    size = F.size("phrase")
    longer = (
        candidates.where(size > 2)
        .select("lang", F.explode(F.array(F.slice("phrase", 1, size - 1), F.slice("phrase", 2, size - 1))).alias("phrase"), "a")
        .groupBy("lang", "phrase")
        .agg(F.max("a").alias("longer"))
    )
    own = candidates.join(longer, ["lang", "phrase"], "left").where(
        F.col("longer").isNull() | (100 * F.col("longer") < percent * F.col("a"))
    )

    k = F.explode(F.sequence(F.lit(1), size - 1)).alias("k")
    cut = own.select("lang", "phrase", "a", size.alias("size"), k).select(
        "lang", "phrase", "a", "k", F.slice("phrase", 1, F.col("k")).alias("left"),
        F.slice("phrase", F.col("k") + 1, F.col("size") - F.col("k")).alias("right"),
    )
    lefts = totals.select("lang", F.col("prefix").alias("left"), F.col("n").alias("l"))
    rights = totals.select("lang", F.col("prefix").alias("right"), F.col("n").alias("r"))
    langs = words.where(F.col("number") == OWN).select("lang", F.col("n").alias("n"))
    scored = (
        cut.join(lefts, ["lang", "left"])
        .join(rights, ["lang", "right"])
        .join(langs, "lang")
        .withColumn("score", score())
    )
    best = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))
    spelled = (
        best.select("lang", "phrase", "a", "n", "best.score", "best.l", "best.r", F.posexplode("phrase").alias("at", "number"))
        .join(words.select("lang", "number", "word"), ["lang", "number"])
        .groupBy("lang", "phrase", "a", "n", "score", "l", "r")
        .agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("text"))
    )
    # First within parts of a language, so that no task ranks all its phrases.
    order = [F.desc("score"), F.desc("a"), F.asc("text")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS))
    few = spelled.withColumn("part", part).withColumn("rank", F.row_number().over(W.partitionBy("lang", "part").orderBy(*order)))
    ranked = few.where(F.col("rank") <= top).withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)))
    return ranked.where(F.col("rank") <= top).select(
        "lang", F.col("rank").cast("long"), F.col("text").alias("phrase"), "a", "l", "r", "n", F.col("score").cast("long")
    )


def op11_stripe_collocations(spark: SparkSession, folder: str) -> DataFrame:
    """The 2,000 best phrases of each language of all documents."""
    return collocations(spark, read_table(spark, folder, "documents"))
