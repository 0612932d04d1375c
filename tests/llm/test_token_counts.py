"""Token counts against the plain call of the library."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm.conftest import edge_rows
from tradewake.llm import token_counts

SF = "/root/testdata/sf0.001"


def plain(texts):
    tokenizer = Tokenizer.from_file(token_counts.VOCABULARY)
    return [len(tokenizer.encode(t or "", add_special_tokens=False)) for t in texts]


# White space, contractions, letters that compose or change with their
# neighbours, digits, special tokens and their parts, scripts without spaces.
PARTS = (
    " ", "\n", "\t", "\x0b", "\x0c", "\r", "\x1c", "\x85", " ", " ", "　", "a", "S", "'s", "'", "́",
    "é", "İ", "Σ", "ς", "9", "٣", "²", "<|endoftext|>", "<|", "|>", "<|startoftext|>", "漢", "字",
    "。", "、", "ｶﾞ", "ﾞ", "각", "ᄀ", "ᅡ", "ᆨ", "!", "'LL", "😀", "‍", "\x00", "_",
)


@pytest.mark.parametrize("step", [1, 3, 1 << 14])
def test_any_mixture_of_parts(step):
    draw = random.Random(step)
    texts = ["".join(draw.choices(PARTS, k=draw.randint(0, 40))) for _ in range(5000)]
    counter = token_counts.Counter(step=step, call_bytes=5000)
    assert counter.of_texts(pa.array(texts)).tolist() == plain(texts)


def test_cuts_keep_the_text():
    long = "12ab。漢字、x" * 5000
    pieces = token_counts.safe_cuts(long, 100)
    assert "".join(pieces) == long and len(pieces) > 300
    assert sum(plain(pieces)) == plain([long])[0]
    assert token_counts.safe_cuts("x" * 1000, 100) == ["x" * 1000]


def test_remembering_ends_without_harm(monkeypatch):
    monkeypatch.setattr(token_counts, "REMEMBERED", 3)
    counter = token_counts.Counter()
    texts = ["one two three four five", "five four three six one"]
    assert counter.of_texts(pa.array(texts)).tolist() == plain(texts)
    assert len(counter.known) == 3


def test_whole_table(spark):
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    rows = documents.collect()
    want = [
        (r["doc_id"], len((r["text"] or "").encode()), n, n > 2048)
        for r, n in zip(rows, plain([r["text"] for r in rows]))
    ]
    assert sorted(tuple(r) for r in token_counts.op13_token_counts(spark, SF).collect()) == sorted(want)


def test_edges(spark, edges, no_documents):
    long = "漢字 " * 300_000 + "x1" * 200_000
    frame = edges.union(edges.limit(1).withColumn("doc_id", F.lit(None)).withColumn("text", F.lit(long)))
    texts = [t for _, t, *_ in edge_rows()]
    got = token_counts.token_counts(spark, frame).collect()
    want = [(i, len((t or "").encode()), n, n > 2048) for (i, t, *_), n in zip(edge_rows(), plain(texts))]
    want.append((None, len(long.encode()), plain([long])[0], True))
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want))
    assert token_counts.token_counts(spark, no_documents).collect() == []


def test_limit_is_exclusive(spark):
    frame = spark.createDataFrame([(1, "a b c"), (2, "a b c d")], "doc_id long, text string")
    got = token_counts.token_counts(spark, frame, limit=3)
    assert {r["doc_id"]: r["over_limit"] for r in got.collect()} == {1: False, 2: True}
