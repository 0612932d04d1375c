"""Collocations against a brute-force count of all phrases."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import edge_rows, frame_of
from tradewake.llm import collocations
from tradewake.llm import words as H

SF = "/root/testdata/sf0.001"


def brute(rows, least, longest=5, top=2000, percent=100):
    """Rows (lang, text) to all result rows."""
    count, total = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            words = tuple(re.findall(r"[^\x20\x09]+", piece))
            total[lang] += len(words)
            for m in range(1, longest + 1):
                count.update((lang, words[i : i + m]) for i in range(len(words) - m + 1))
    found = {key: a for key, a in count.items() if len(key[1]) > 1 and a >= least}
    covered = Counter()
    for (lang, words), a in found.items():
        for m in range(2, len(words)):
            for i in range(len(words) - m + 1):
                inner = (lang, words[i : i + m])
                covered[inner] = max(covered[inner], a)
    out = []
    for lang in total:
        own = []
        for (of, words), a in found.items():
            if of != lang or 100 * covered[of, words] >= percent * a:
                continue
            cuts = [(count[lang, words[:k]], count[lang, words[k:]], k) for k in range(1, len(words))]
            score, _, left, right = min((1000 * a * total[lang] // (x * y), k, x, y) for x, y, k in cuts)
            own.append((-score, -a, " ".join(words).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(own)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, total[lang], -score))
    return sorted(out)


def spark_rows(frame, **how):
    got = collocations.collocations(frame.sparkSession, frame, **how)
    return sorted(tuple(r) for r in got.collect())


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_all_phrases_of_the_table(documents):
    rows = [(r["lang"], r["text"]) for r in documents.collect()]
    want = brute(rows, 8)
    assert len({r[0] for r in want}) == 4 and len(want) > 400
    assert spark_rows(documents.repartition(3), least=8) == want


def test_fewer_words_rows_and_a_lower_share(documents):
    rows = [(r["lang"], r["text"]) for r in documents.collect()]
    how = {"least": 6, "longest": 3, "top": 50, "percent": 60}
    assert spark_rows(documents, **how) == brute(rows, **how)
    how = {"least": 6, "longest": 2}
    assert spark_rows(documents, **how) == brute(rows, **how)


def test_pieces_shards_and_flushes(documents, monkeypatch):
    """Phrases across the pieces that bytes are read in, sharded stripes, many outputs."""
    monkeypatch.setattr(H, "PIECE", 64)
    monkeypatch.setattr(collocations, "HOT", 10**9)
    monkeypatch.setattr(collocations, "CELLS", 2000)
    monkeypatch.setattr(collocations, "RANGE", 100)
    some = documents.where("doc_id % 4 = 0")
    rows = [(r["lang"], r["text"]) for r in some.collect()]
    assert spark_rows(some, least=4) == brute(rows, 4)


def test_edges(spark, edges, no_documents):
    rows = [(lang, text) for _, text, lang, _ in edge_rows()]
    rows += [rows[3]] * 4 + [(None, "a,b a\tb;A b\x0ba b. a b c"), ("und", "a b"), ("x", "a. b. a. b")]
    more = frame_of(spark, [(100 + i, t, lang, "s") for i, (lang, t) in enumerate(rows[17:])])
    assert spark_rows(edges.union(more), least=2) == brute(rows, 2)
    assert spark_rows(no_documents) == []
    assert spark_rows(edges.withColumn("text", F.lit(None).cast("string")), least=1) == []


def test_products_beyond_64_bits(spark):
    """The score's arithmetic is that of whole numbers of any size."""
    a, n, left, right = 3_000_000_000_123, 88_888_888_888_888_888, 4_000_000_000_001, 5_000_000_000_007
    frame = spark.createDataFrame([(a, n, left, right)], "a long, n long, l long, r long")
    assert frame.select(collocations.score()).first()[0] == 1000 * a * n // (left * right)


def test_counts_of_more_than_a_byte(spark):
    """One phrase occurs far more often than an entry of a packed count can say."""
    text = "hot pair of words here, " * 3000
    frame = spark.createDataFrame([("en", text), (None, text), ("en", "x " * 5000)], "lang string, text string")
    rows = [tuple(r) for r in frame.collect()]
    assert spark_rows(frame) == brute(rows, 100)


def test_numbers_shared_by_words_are_noticed(spark, documents, monkeypatch):
    drawn = H._drawn
    calls = []

    def first_seed_is_bad(n, seed):
        calls.append(seed)
        return drawn(n, seed) if seed != 1000 else drawn(n, seed) * H.U64(0)

    monkeypatch.setattr(H, "_drawn", first_seed_is_bad)
    rows = [(r["lang"], r["text"]) for r in documents.collect()]
    assert spark_rows(documents, least=20) == brute(rows, 20)
