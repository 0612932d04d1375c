"""Hashes of words and of runs of words, for whole Arrow batches of texts at once.

A word's hash is a polynomial over its bytes, taken from prefix sums, so a batch costs a
few array operations per byte and no Python loop per word. All arithmetic is modulo 2^64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)

# Bytes looked at in one go; a word is never cut, so a piece can be longer.
PIECE = 1 << 18

BLANKS = bytes([0x20, *range(0x09, 0x0E)])


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of a 64-bit number over all bits (a bijection)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _drawn(n: int, seed: int) -> np.ndarray:
    """n fixed numbers from a rule."""
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=U64) + U64(seed)) * U64(0x9E3779B97F4A7C15))


_BYTE = _drawn(256, 11)
_power: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse; grown by doubling."""
    have = _power.get(0)
    if have is None or len(have[0]) < n:
        size = max(n, PIECE + 4096)
        a = np.full(size, U64(_BASE))
        b = np.full(size, U64(_INVERSE))
        a[0] = b[0] = 1
        have = (np.cumprod(a, dtype=U64), np.cumprod(b, dtype=U64))
        if size <= 1 << 22:  # a longer array is not worth keeping for one long text
            _power[0] = have
    return have[0][:n], have[1][:n]


def span_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of values[start:end] for every span; equal runs have equal hashes."""
    if len(start) == 0:
        return np.zeros(0, U64)
    up, down = powers(len(values) + 1)
    total = np.zeros(len(values) + 1, U64)
    np.cumsum(values * up[:-1], dtype=U64, out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(U64))


def lowered(data: np.ndarray) -> np.ndarray:
    """The bytes with A-Z as a-z."""
    upper = (data >= 65) & (data <= 90)
    return np.where(upper, data + np.uint8(32), data)


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts in a row, and where each begins; null is empty."""
    texts = texts.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_mask(separators: bytes) -> np.ndarray:
    table = np.ones(256, bool)
    table[np.frombuffer(separators, np.uint8)] = False
    return table


def word_pieces(
    data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray
) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Begin and end of every word, piece by piece: (first byte, begins, ends) in the piece."""
    edge = np.unique(offsets)
    at = 0
    while at < len(data):
        stop = min(len(data), at + PIECE)
        while stop < len(data) and is_word[data[stop - 1]]:  # on to the end of the word
            tail = np.flatnonzero(~is_word[data[stop : stop + 4096]])
            stop = stop + int(tail[0]) + 1 if len(tail) else min(len(data), stop + 4096)
        inside = is_word[data[at:stop]]
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        cut = edge[(edge >= at) & (edge < stop)] - at  # a text's first byte begins a word
        begins[cut] = inside[cut]
        cut = cut[cut > 0] - 1
        ends[cut] = inside[cut]
        yield at, np.flatnonzero(begins), np.flatnonzero(ends) + 1
        at = stop


def word_hashes(
    texts: pa.Array, separators: bytes = BLANKS, lower: bool = False
) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word of every text, and where each text's words begin."""
    data, offsets = text_buffer(texts)
    is_word = word_mask(separators)
    hashes, places = [np.zeros(0, U64)], [np.zeros(0, np.int64)]
    for at, begin, end in word_pieces(data, offsets, is_word):
        piece = data[at : at + (int(end[-1]) if len(end) else 0)]
        hashes.append(span_hashes(_BYTE[lowered(piece) if lower else piece], begin, end))
        places.append(begin + at)
    bounds = np.searchsorted(np.concatenate(places), offsets)
    return np.concatenate(hashes), bounds


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """The hash of every run of ``width`` words, at the run's first word."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, U64)
    factor = _drawn(width, 101) | U64(1)
    total = words[:n] * factor[0]
    for k in range(1, width):
        total = total + words[k : k + n] * factor[k]
    return mix(total)


def as_long(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's signed long."""
    return x.view(np.int64)
