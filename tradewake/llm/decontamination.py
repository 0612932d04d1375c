"""Benchmark passages in documents, also with other numbers, names and units.

Texts become templates: a number with its separators, a run of names and a unit each turn
into one typed placeholder. Windows of template tokens, and of the words as they are, are
joined by hash: the former find other values, the latter also what is mostly values, and
short items. Evidence is added up along one alignment of a document and an item, and over alignments a few tokens apart.
The placeholders' values must agree there: what stood for a value of the item once, stands
for it each time.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tradewake.llm import words as H
from tradewake.llm.shared import Scratch, read_table, small_batches

WIDTH = 8
# Template tokens of a window that must be no placeholders; windows of words have no such
# bound. A shorter item is one window.
LEAST_PLAIN = 4
# Share of an alignment's placeholder values that must agree.
AGREEMENT = 0.9
# An item is found if so many of its tokens, or so large a share of them, are covered.
COVERED, COVERED_SHARE = 13, 0.5
# One word counts as so many characters of a script without spaces.
CHARACTERS = 2
# Alignments at most so many template tokens apart are added up.
NEIGHBOUR = 8

# Bits of the filter per benchmark window, and at most. It only spares the join rows that
# cannot match, so its bound costs no result.
FILTER_BITS, MOST_BITS = 1024, 1 << 27
_PAGE = 32768

# Units that count as such after a number.
UNITS = (
    "mm cm dm m km in ft yd mi mg g kg t oz lb ml cl l s sec second seconds min minute minutes h "
    "hour hours day days week weeks month months year years ms hz khz mhz ghz w kw mw v a c f k pa "
    "percent usd eur gbp dollar dollars euro euros cent cents mph kph meter meters metre metres "
    "kilometer kilometers mile miles gram grams kilogram kilograms litre litres liter liters"
).split()

_PLAIN_BYTES = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz" + bytes(range(0x80, 0x100))
SEPARATORS = bytes(b for b in range(256) if b not in _PLAIN_BYTES)

_NUMBER, _NAME, _UNIT = (H.U64(x) for x in (3, 5, 7))
# One such byte between two digits belongs to the number, such bytes between names to the run.
_IN_NUMBER, _IN_NAMES = b".,':/-_", b" \t\n\r-'"


def _folded(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes with capital letters (ASCII and Latin-1) as small ones, and which were capital."""
    after_lead = np.zeros(len(data), bool)
    after_lead[1:] = data[:-1] == 0xC3
    wide = after_lead & (data >= 0x80) & (data <= 0x9E) & (data != 0x97)
    capital = ((data >= 65) & (data <= 90)) | wide
    return np.where(capital, data + np.uint8(32), data), capital


def _any_of(data: np.ndarray, listed: bytes) -> np.ndarray:
    return ~H.word_mask(listed)[data]


# Scripts without spaces (Thai, Lao, Myanmar, Khmer, Chinese, Japanese), as code points in
# steps of 64, from and up to; and the punctuation and wide forms among them.
_UNSPACED = ((0x0E00, 0x0F00), (0x1000, 0x10C0), (0x1780, 0x1800), (0x2E80, 0x3130), (0x31C0, 0xA000), (0xF900, 0xFB00), (0xFF40, 0xFFC0))
_POINTS = ((0x3000, 0x3005), (0x3008, 0x3021), (0x3030, 0x3031), (0xFF00, 0xFF10), (0xFF1A, 0xFF21), (0xFF3B, 0xFF41), (0xFF5B, 0xFF66))


def _cut_characters(piece: np.ndarray, is_word: np.ndarray, begin: np.ndarray, end: np.ndarray):
    """Begins and ends with each character of an unspaced script as its own word, and which are such."""
    lead = np.flatnonzero(((piece >= 0xE0) & (piece <= 0xEF)) | (piece == 0xF0))
    lead = lead[lead + 2 < len(piece)]
    a, b, c = (piece[lead + k].astype(np.int64) for k in range(3))
    code = ((a & 15) << 12) | ((b & 63) << 6) | (c & 63)
    wide = a == 0xF0
    alone = (wide & (b >= 0xA0)) | (~wide & np.any([(code >= x) & (code < y) for x, y in _UNSPACED], axis=0))
    point = ~wide & np.any([(code >= x) & (code < y) for x, y in _POINTS], axis=0)
    if not (alone | point).any():
        return begin, end, np.zeros(len(begin), bool)
    inside = is_word[piece]
    for k in range(3):
        inside[lead[point] + k] = False
    starts, single = np.zeros(len(piece) + 1, bool), np.zeros(len(piece) + 1, bool)
    starts[begin] = True
    cut = alone & ~point
    single[lead[cut]] = True
    starts[lead[cut]] = True
    starts[lead[cut] + np.where(wide[cut], 4, 3)] = True
    starts[:-1][1:] |= inside[1:] & ~inside[:-1]
    starts[:-1] &= inside
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | starts[1:-1]
    begin = np.flatnonzero(starts[:-1])
    return begin, np.flatnonzero(ends) + 1, single[begin]


class Templates(NamedTuple):
    """Template tokens of all texts, with their slot values (0 for plain tokens).

    ``begin``: the first word of each token, and the number of words at the end; ``of_word``:
    the token of each word; ``single``: whether a word is one character; ``bounds`` and ``word_bounds``: where each text's begin.
    """

    token: np.ndarray
    slot: np.ndarray
    bounds: np.ndarray
    begin: np.ndarray
    word: np.ndarray
    word_bounds: np.ndarray
    of_word: np.ndarray
    single: np.ndarray


def templates(texts: pa.Array) -> Templates:
    """The template of all texts.

    A word is a run of ASCII letters, digits and all other characters beyond ASCII, or one
    character of a script that has no spaces. One
    that starts with a digit is a number, with those that follow after one separator (or,
    three digits, after a space); one of the units is a unit after a number; words that
    start with a capital and do not end with one are a name, as many as follow each other.
    """
    data, offsets = H.text_buffer(texts)
    is_word = H.word_mask(SEPARATORS)
    empty = np.zeros(0, np.int64)
    hashes, places, stops = [empty.astype(H.U64)], [empty], [empty]
    digit, name, single = [empty.astype(bool)], [empty.astype(bool)], [empty.astype(bool)]
    for at, begin, end in H.word_pieces(data, offsets, is_word):
        piece = data[at : at + (int(end[-1]) if len(end) else 0)]
        small, capital = _folded(piece)
        begin, end, alone = _cut_characters(piece, is_word, begin, end)
        single.append(alone)
        hashes.append(H.span_hashes(H._BYTE[small], begin, end))
        places.append(begin + at)
        stops.append(end + at)
        if not len(begin):
            continue
        digit.append((piece[begin] >= 48) & (piece[begin] <= 57))
        lead = np.minimum(begin + 1, len(piece) - 1)
        first = capital[begin] | ((piece[begin] == 0xC3) & capital[lead])
        name.append(first & ~capital[end - 1] & (end - begin > 1))
    word, digit, name = np.concatenate(hashes), np.concatenate(digit), np.concatenate(name)
    place, stop = np.concatenate(places), np.concatenate(stops)
    word_bounds = np.searchsorted(place, offsets)
    inner = np.ones(len(word), bool)  # not the first word of its text
    starts = word_bounds[:-1]
    inner[starts[starts < len(word)]] = False

    joined = np.zeros(len(word), bool)  # goes with the word before
    if len(word) > 1:
        length = stop - place
        gap, after = place[1:] - stop[:-1], stop[:-1]
        numeric = np.concatenate([[0], np.cumsum(~((data >= 48) & (data <= 57)))])
        all_digits = numeric[stop] == numeric[place]
        one = digit[:-1] & digit[1:] & (gap == 1)
        at_gap = data[np.minimum(after, len(data) - 1)]
        last = data[stop[:-1] - 1]
        one &= (last >= 48) & (last <= 57)
        thousands = (at_gap == 32) & all_digits[:-1] & (length[:-1] <= 3) & all_digits[1:] & (length[1:] == 3)
        other = np.concatenate([[0], np.cumsum(~_any_of(data, _IN_NAMES))])
        named = name[:-1] & name[1:] & (other[place[1:]] == other[after])
        joined[1:] = (one & (_any_of(at_gap, _IN_NUMBER) | thousands)) | named
        joined &= inner
    begin = np.flatnonzero(~joined)
    of_word = np.cumsum(~joined) - 1
    begin = np.append(begin, len(word))
    run = H.span_hashes(word, begin[:-1], begin[1:])
    digit, name = digit[begin[:-1]], name[begin[:-1]]
    after_number = np.zeros(len(digit), bool)
    after_number[1:] = digit[:-1]
    after_number &= inner[begin[:-1]]
    token = word[begin[:-1]]
    unit = after_number & np.isin(token, _unit_hashes()) & (np.diff(begin) == 1)
    slot = digit | unit | name
    kind = np.where(digit, _NUMBER, np.where(unit, _UNIT, _NAME))
    return Templates(
        np.where(slot, kind, token),
        np.where(slot, run, H.U64(0)),
        np.searchsorted(begin[:-1], word_bounds),
        begin,
        word,
        word_bounds,
        of_word,
        np.concatenate(single),
    )


def _unit_hashes() -> np.ndarray:
    return H.word_hashes(pa.array(UNITS), SEPARATORS)[0]


def _lists(values: np.ndarray, width: int) -> pa.ListArray:
    """Rows of ``width`` values each, as lists."""
    return pa.ListArray.from_arrays(
        pa.array((np.arange(len(values) // width + 1) * width).astype(np.int32)), pa.array(values)
    )


def _windows(
    key: list[str], widths: list[tuple[bool, int]], pages: dict[int, bytes] | None, bits: int, whole: bool
):
    """Texts to their windows, each of (words instead of template tokens, how many).

    ``whole``: a text shorter than the greatest width is one window. With ``pages``, only
    windows are put out whose hash the filter knows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None
        if pages is not None:
            known = np.zeros(max(bits // 8, _PAGE // 8), np.uint8)
            for page, content in pages.items():
                known[page * (_PAGE // 8) : (page + 1) * (_PAGE // 8)] = np.frombuffer(content, np.uint8)
        for batch in batches:
            made = templates(batch.column("text"))
            words = np.diff(made.word_bounds)
            plain = np.concatenate([[0], np.cumsum(made.slot == 0)])
            singles = np.concatenate([[0], np.cumsum(made.single)])
            alone = singles[made.word_bounds[1:]] - singles[made.word_bounds[:-1]]
            need = np.where(2 * alone > words, COVERED * CHARACTERS, COVERED)
            for exact, width in widths:
                token, bounds = (made.word, made.word_bounds) if exact else (made.token, made.bounds)
                count = np.diff(bounds)
                doc_of = np.repeat(np.arange(len(count)), count)
                n = len(token) - width + 1
                if n <= 0:
                    continue
                start = np.arange(n)
                fits = start + width <= bounds[1:][doc_of[:n]]
                if whole and width < WIDTH:
                    fits &= count[doc_of[:n]] == width
                if not exact:
                    fits &= plain[start + width] - plain[start] >= LEAST_PLAIN
                hashed = H.mix(H.shingle_hashes(token, width) + H.U64(width + 256 * exact))
                if known is not None:
                    bit = (hashed & H.U64(bits - 1)).astype(np.int64)
                    fits &= (known[bit >> 3] >> (bit & 7).astype(np.uint8) & 1).astype(bool)
                start = np.flatnonzero(fits)
                doc = doc_of[start]
                each = (start[:, None] + np.arange(width)).reshape(-1)
                if exact:
                    # A value counts where the window holds the whole of it.
                    of = made.of_word[each]
                    within = (made.begin[of] == each) & (made.begin[of + 1] <= np.repeat(start + width, width))
                    spots, steps, slots = each, np.ones(len(each)), np.where(within, made.slot[of], H.U64(0))
                    place = made.of_word[start] - made.bounds[doc]
                else:
                    spots, steps, slots = made.begin[each], np.diff(made.begin)[each], made.slot[each]
                    place = start - made.bounds[doc]
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(k).take(pa.array(doc)) for k in key),
                        pa.array(H.as_long(hashed[start])),
                        pa.array(np.full(len(start), exact)),
                        pa.array(place.astype(np.int32)),
                        pa.array(words[doc].astype(np.int32)),
                        pa.array(need[doc].astype(np.int32)),
                        _lists((spots - np.repeat(made.word_bounds[doc], width)).astype(np.int32), width),
                        _lists(steps.astype(np.int32), width),
                        _lists(H.as_long(slots), width),
                    ],
                    names=[*key, "window", "exact", "place", "tokens", "need", "spots", "steps", "slots"],
                )

    return run


_WINDOW = (
    "window long, exact boolean, place int, tokens int, need int, "
    "spots array<int>, steps array<int>, slots array<long>"
)


def _evidence(points: DataFrame, group: list[str]) -> DataFrame:
    """Covered words and agreement of values of each group that suffices for a find."""
    slotted = F.col("of").isNotNull()
    # ``size``: the item's words, and how many of them suffice.
    summed = (
        points.groupBy(*group, "of", "to")
        .agg(F.count("*").alias("n"), F.min(F.struct("word", "begin")).alias("first"), F.max("size").alias("size"))
        .groupBy(*group, "of")
        .agg(
            F.max("n").alias("most"), F.sum("n").alias("all"), F.min("first").alias("first"), F.max("size").alias("size")
        )
        .groupBy(*group)
        .agg(
            F.sum("all").cast("int").alias("covered"),
            (F.sum(F.when(slotted, F.col("most"))) / F.sum(F.when(slotted, F.col("all")))).alias("agreement"),
            F.min("first.begin").alias("begin"),
            F.max("size").alias("size"),
        )
    )
    return (
        summed.select(*_PAIR, "begin", "size.*", "covered", F.coalesce("agreement", F.lit(1.0)).alias("agreement"))
        .where(F.col("agreement") >= AGREEMENT)
        .where((F.col("covered") >= F.col("need")) | (F.col("covered") >= COVERED_SHARE * F.col("tokens")))
    )


_PAIR = ["doc_id", "mark", "item_id"]


def _found(spark: SparkSession, documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Every alignment, or group of neighbouring ones, that shows an item in a document."""
    small_batches(spark)
    scratch = Scratch(spark)
    widths = [(exact, n) for exact in (False, True) for n in range(WIDTH, 0 if exact else LEAST_PLAIN - 1, -1)]
    items = scratch.save(
        benchmark.select("item_id", "text")
        .mapInArrow(_windows(["item_id"], widths, None, 0, True), f"item_id long, {_WINDOW}")
        .withColumn("width", F.size("slots")),
        "items",
    )
    sizes = items.groupBy("exact", "width").count().collect()  # at most one row per kind of window
    n = sum(r["count"] for r in sizes)
    bits = min(MOST_BITS, 1 << max(20, (FILTER_BITS * n - 1).bit_length()))
    place = F.expr(f"window & {bits - 1}")
    filtered = (
        items.select(place.alias("bit"))
        .groupBy(F.expr(f"bit div {_PAGE}").alias("page"))
        .agg(F.bitmap_construct_agg(F.col("bit") % _PAGE).alias("content"))
    )
    # The filter has a fixed greatest size, 16 MB, whatever the tables hold.
    pages = {r["page"]: bytes(r["content"]) for r in filtered.collect()}
    used = sorted(((r["exact"], r["width"]) for r in sizes), reverse=True)
    hits = (
        documents.select("doc_id", F.xxhash64("text").alias("mark"), "text")
        .mapInArrow(_windows(["doc_id", "mark"], used, pages, bits, False), f"doc_id long, mark long, {_WINDOW}")
        .select("doc_id", "mark", "window", F.col("place").alias("at"), F.expr("spots[0]").alias("first"), F.col("slots").alias("own"))
    )
    aligned = [*_PAIR, "shift"]
    # One row for each word of the item that a window covers; a token's value is at its first.
    words = (
        hits.join(items, "window")
        .select(
            *_PAIR,
            (F.col("at") - F.col("place")).alias("shift"),
            (F.col("first") - F.expr("spots[0]")).alias("begin"),
            F.struct("tokens", "need").alias("size"),
            "exact",
            F.explode(F.arrays_zip("spots", "steps", "slots", "own")).alias("v"),
        )
        .select(*aligned, "begin", "size", "exact", "v", F.explode(F.expr("sequence(v.spots, v.spots + v.steps - 1)")).alias("word"))
    )
    valued = (F.col("word") == F.col("v.spots")) & (F.col("v.slots") != 0)
    points = scratch.save(
        words.groupBy(*aligned, "word").agg(
            F.min("begin").alias("begin"),
            F.max("size").alias("size"),
            F.max(F.when(valued, F.col("v.slots"))).alias("of"),
            # Equal words have equal values, whatever stands before or behind them.
            F.coalesce(
                F.max(F.when(valued & F.col("exact"), F.col("v.slots"))),
                F.max(F.when(valued & ~F.col("exact"), F.col("v.own"))),
            ).alias("to"),
        ),
        "points",
    )
    # Alignments a few tokens apart: each word of the item is taken from the one that
    # covers most, so that a text that repeats itself is not aligned with itself.
    near = W.partitionBy(*_PAIR).orderBy("shift")
    apart = F.coalesce(F.col("shift") - F.lag("shift").over(near) > NEIGHBOUR, F.lit(False))
    grouped = (
        points.withColumn("held", F.count("*").over(W.partitionBy(*aligned)))
        .withColumn("apart", apart.cast("int"))
        .withColumn("island", F.sum("apart").over(near))
        .groupBy(*_PAIR, "island", "word")
        .agg(F.max(F.struct("held", "shift", "begin", "size", "of", "to")).alias("p"))
        .select(*_PAIR, "island", "word", "p.begin", "p.size", "p.of", "p.to")
    )
    return _evidence(points, aligned).union(_evidence(grouped, [*_PAIR, "island"]))


def contaminated(spark: SparkSession, documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, item_id`` and the evidence, for each item that a document holds.

    ``tokens`` is the length of the item in words, ``covered`` how many of them the best
    alignment, or group of neighbouring ones, covers, ``agreement`` the share of agreeing placeholder values there,
    ``place`` where the item would begin in the document, in words. Texts without
    words give no row, nor does a benchmark without items. An item of fewer than eight words
    is found wherever all its words follow each other, a single word included; with other
    values, an item needs windows with four plain tokens. Rows with a null id are judged alike and keep
    the null. Repeated rows count once. Other columns are not read.
    """
    best = F.max(F.struct("covered", "agreement", (-F.col("begin")).alias("back"), "tokens"))
    return (
        _found(spark, documents, benchmark)
        .groupBy("doc_id", "item_id")
        .agg(best.alias("b"))
        .select("doc_id", "item_id", "b.tokens", "b.covered", "b.agreement", (-F.col("b.back")).alias("place"))
    )


def without_contaminated(spark: SparkSession, documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no item, with all their columns; see ``contaminated``."""
    leaks = Scratch(spark).save(
        _found(spark, documents, benchmark).select(F.col("doc_id").alias("_id"), "mark").distinct(), "leaks"
    )
    same = F.col("row.doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("row.text") == F.col("mark"))
    rows = documents.select(F.struct(*documents.columns).alias("row")).join(leaks, same, "left_anti")
    return rows.select(*[F.col("row").getField(c).alias(c) for c in documents.columns])


def op9_template_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Every document that holds a benchmark item, with the item."""
    return contaminated(
        spark, read_table(spark, folder, "documents"), read_table(spark, folder, "benchmark")
    )
