"""License notices in documents: MinHash bands over overlapping windows, then exact checks.

A text is cut into blocks of tokens, and every two neighbouring blocks are a window. A
notice of at most a block's length lies in one window as a whole. Each MinHash sample is
a band of its own; a window retrieves a notice if they agree in any band. The share of
the notice's shingles that the window holds decides.

A longer text is cut into overlapping pieces that windows retrieve; once any is, the share
of the whole text's shingles in the document decides. A notice shorter than a shingle is
one shingle of its own length, looked for at every token.
"""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradewake.llm import words as H
from tradewake.llm.decontamination import SEPARATORS
from tradewake.llm.shared import read_table, small_batches

SHINGLE = 5
CONTAINED = 0.75

# Block lengths; a notice belongs to the shortest that holds it. A window of two blocks
# of length c has 2c shingles, so a notice of one shingle agrees with its window of 12 in
# a band with probability 1/12 and is missed by all with (11/12)^128 = 1.5e-5. Notices of
# 7 tokens and more are missed with less than 4e-8, or 1e-5 if a quarter differs.
BLOCKS = (6, 12, 24, 48)
BANDS = 128
# A longer text's pieces are of the greatest length and begin so many tokens apart.
STEP = BLOCKS[-1] // 2

# Notices of common licenses.
NOTICES = {
    "MIT": "Released under the MIT License.",
    "MIT-opening": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-opening": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "BSD-opening": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
}

# Notices of fewer tokens than a shingle.
SHORT_NOTICES = {"All-rights-reserved": "All rights reserved."}


def license_texts() -> dict[str, str]:
    """Whole license texts, by name."""
    folder = Path(__file__).parent / "licenses"
    return {f"{f.stem}-text": f.read_text("utf-8") for f in sorted(folder.glob("*.txt"))}


_FACTORS = (H._drawn(BANDS, 21) & H.U64(0xFFFFFFFF)).astype(np.uint32) | np.uint32(1)
_NONE = np.uint32(0xFFFFFFFF)


def _templates(notices: dict[str, str]) -> tuple[list[dict], list[dict], list[dict]]:
    """Short notices; the others; and the pieces that retrieve those, with their samples."""
    tokens, bounds = H.word_hashes(pa.array(list(notices.values())), SEPARATORS, lower=True)
    short, whole, pieces = [], [], []
    for name, begin, end in zip(notices, bounds[:-1], bounds[1:]):
        n = int(end - begin)
        if n == 0:
            raise ValueError(f"a notice must have a token: {name}")
        if n < SHINGLE:
            short.append({"name": name, "width": n, "hash": H.shingle_hashes(tokens[begin:end], n)[0]})
            continue
        hashed = H.shingle_hashes(tokens[begin:end], SHINGLE)
        long = n > BLOCKS[-1]
        for at in range(0, n - BLOCKS[-1] + STEP, STEP) if long else [0]:
            at = min(at, max(n - BLOCKS[-1], 0))
            own = np.unique(hashed[at : at + BLOCKS[-1] - SHINGLE + 1])
            pieces.append(
                {
                    "of": len(whole),
                    "block": next(b for b in BLOCKS if b >= min(n, BLOCKS[-1])),
                    "samples": (_FACTORS[:, None] * own.astype(np.uint32)).min(axis=1),
                }
            )
        whole.append({"name": name, "shingles": np.unique(hashed), "long": long})
    return short, whole, pieces


def _retrieved(laid: np.ndarray, there: np.ndarray, pieces: list[dict], n_whole: int) -> dict[int, np.ndarray]:
    """For each block length, (window, notice) of all that agree in any band."""
    smallest = BLOCKS[0]
    columns = np.ascontiguousarray(laid.astype(np.uint32).reshape(-1, smallest).T)
    absent = np.ascontiguousarray(~there.reshape(-1, smallest).T)
    sizes = sorted({p["block"] for p in pieces})
    of = {b: np.array([p["of"] for p in pieces if p["block"] == b]) for b in sizes}
    samples = {b: np.array([p["samples"] for p in pieces if p["block"] == b]) for b in sizes}
    met: dict[int, list[np.ndarray]] = {b: [np.zeros(0, np.int64)] for b in sizes}
    for band in range(BANDS):
        value = _FACTORS[band] * columns
        value[absent] = _NONE
        least = {smallest: value.min(axis=0)}
        for block in BLOCKS[1:]:
            half = least[block // 2]
            least[block] = np.minimum(half[0::2], half[1::2])
        for b in sizes:
            window = np.minimum(least[b][:-1], least[b][1:])
            order = np.argsort(samples[b][:, band])
            known = samples[b][order, band]
            low = np.searchsorted(known, window, "left")
            hit = np.flatnonzero(known[np.minimum(low, len(known) - 1)] == window)
            n = np.searchsorted(known, window[hit], "right") - low[hit]
            rank = np.repeat(low[hit], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            met[b].append(np.unique(np.repeat(hit, n) * n_whole + of[b][order[rank]]))
    return {b: np.unique(np.concatenate(met[b])) for b in sizes}


def _scan(notices: dict[str, str], contained: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        short, whole, pieces = _templates(notices)
        for batch in batches:
            tokens, bounds = H.word_hashes(batch.column("text"), SEPARATORS, lower=True)
            hashed = H.shingle_hashes(tokens, SHINGLE)
            count = np.diff(bounds)
            out: list[tuple] = []
            for t in short:
                at = np.flatnonzero(H.shingle_hashes(tokens, t["width"]) == t["hash"])
                which = np.searchsorted(bounds, at, "right") - 1
                for w, place in zip(which, at - bounds[which]):
                    if place + t["width"] <= count[w]:
                        out.append((int(w), t["name"], 1.0, int(place)))
            # Each text is laid out anew, filled up to whole blocks of the greatest length
            # and one block more, so that no window holds shingles of two texts.
            room = -(-count // BLOCKS[-1]) * BLOCKS[-1] + BLOCKS[-1]
            first = np.cumsum(room) - room
            starts = np.maximum(count - SHINGLE + 1, 0)
            doc = np.repeat(np.arange(len(count)), starts)
            within = np.arange(starts.sum()) - np.repeat(np.cumsum(starts) - starts, starts)
            laid = np.zeros(int(room.sum()), H.U64)
            there = np.zeros(len(laid), bool)
            laid[first[doc] + within] = hashed[bounds[doc] + within]
            there[first[doc] + within] = True
            begun: dict[tuple[int, int], int] = {}
            met = _retrieved(laid, there, pieces, len(whole)) if len(doc) and pieces else {}
            for block, pairs in met.items():
                for window, k in zip(*(x.tolist() for x in np.divmod(pairs, len(whole)))):
                    t, begin = whole[k], window * block
                    part = slice(begin, begin + 2 * block)
                    held = np.isin(laid[part], t["shingles"]) & there[part]
                    if not held.any():
                        continue
                    hit = begin + int(np.flatnonzero(held)[0])
                    which = int(np.searchsorted(first, hit, "right") - 1)
                    if t["long"]:
                        begun[which, k] = min(hit, begun.get((which, k), hit))
                        continue
                    share = np.isin(t["shingles"], laid[part][there[part]]).mean()
                    if share >= contained:
                        out.append((which, t["name"], float(share), int(hit - first[which])))
            for (which, k), hit in begun.items():
                own = np.unique(hashed[bounds[which] : bounds[which] + starts[which]])
                share = np.isin(whole[k]["shingles"], own, assume_unique=True).mean()
                if share >= contained:
                    out.append((which, whole[k]["name"], float(share), int(hit - first[which])))
            which, name, share, place = zip(*out) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(which, pa.int64())),
                    pa.array(name, pa.string()),
                    pa.array(share, pa.float64()),
                    pa.array(place, pa.int64()),
                ],
                names=["doc_id", "license", "containment", "place"],
            )

    return run


def license_notices(
    spark: SparkSession,
    documents: DataFrame,
    notices: dict[str, str] | None = None,
    contained: float = CONTAINED,
) -> DataFrame:
    """``doc_id, license, containment, place`` for each notice that a document holds.

    Tokens are runs of ASCII letters and digits, A-Z as a-z, and characters beyond ASCII.
    ``containment`` is the largest share of the notice's 5-token shingles that a window
    holds, ``place`` the first token of such a window that belongs to the notice. For a
    notice of more than 48 tokens it is the share that the document holds. One of fewer
    than five tokens must be there as it is. Texts without tokens give no row. A notice that occurs twice
    gives one row; so do repeated rows. A null id is a document of its own.
    """
    small_batches(spark)
    found = documents.select("doc_id", "text").mapInArrow(
        _scan(notices or NOTICES, contained),
        "doc_id long, license string, containment double, place long",
    )
    best = F.max(F.struct("containment", (-F.col("place")).alias("back"))).alias("b")
    return (
        found.groupBy("doc_id", "license")
        .agg(best)
        .select("doc_id", "license", "b.containment", (-F.col("b.back")).alias("place"))
    )


def op4_license_bands(spark: SparkSession, folder: str) -> DataFrame:
    """The license notices and whole license texts of all documents."""
    notices = NOTICES | SHORT_NOTICES | license_texts()
    return license_notices(spark, read_table(spark, folder, "documents"), notices)
