"""Token counts of whole texts, without keeping a single id.

The vocabulary's normaliser turns white space into one space and its pattern drops it, so
a text's count is the sum over its chunks between white space. An Arrow batch is cut into
chunks at once and each distinct chunk is encoded once, in calls of about equal bytes; only
the lengths are kept, and those of short chunks are remembered by the task. A chunk that is
itself long is cut further, where no token, no contraction and no composed character can
span the place.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tradewake.llm.shared import read_table, small_batches

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
LIMIT = 2048

# Bytes of text given to one call of the library.
CALL_BYTES = 1 << 20
# Characters beyond which a chunk is cut further.
STEP = 1 << 14
# Short chunks whose counts a task remembers, some 40 MB at most; others are encoded anew.
REMEMBERED, SHORT = 1 << 18, 40

# A digit is a token of its own, so whatever follows it begins another; marks that end
# Chinese and Japanese clauses are no letters, and no letter joins with them.
_SAFE = re.compile("(?<=[0-9])(?=[A-Za-z0-9])|(?<=[、。，])(?=[一-龥A-Za-z0-9])")


def safe_cuts(chunk: str, step: int = STEP) -> list[str]:
    """The chunk in pieces of at least ``step`` characters whose counts add up to its own."""
    pieces, at = [], 0
    while len(chunk) - at > step and (cut := _SAFE.search(chunk, at + step)):
        pieces.append(chunk[at : cut.start()])
        at = cut.start()
    return [*pieces, chunk[at:]]


class Counter:
    """Counts of the library's plain call, without added special tokens."""

    def __init__(self, vocabulary: str = VOCABULARY, call_bytes: int = CALL_BYTES, step: int = STEP):
        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.call_bytes, self.step = call_bytes, step
        self.known: dict[str, int] = {}

    def of_chunks(self, chunks: list[str]) -> np.ndarray:
        """The number of tokens of each distinct chunk."""
        known = self.known
        count = np.fromiter((known.get(c, -1) for c in chunks), np.int64, len(chunks))
        new = np.flatnonzero(count < 0)
        fresh = [chunks[i] for i in new]
        count[new] = self.encoded(fresh)
        for chunk, n in zip(fresh, count[new].tolist()):
            if len(known) == REMEMBERED:
                break
            if len(chunk) <= SHORT:
                known[chunk] = n
        return count

    def encoded(self, chunks: list[str]) -> np.ndarray:
        """The same by the library, in calls of about ``call_bytes`` bytes."""
        count = np.zeros(len(chunks), np.int64)
        texts, owners, size = [], [], 0

        def encode() -> None:
            encoded = self.tokenizer.encode_batch(texts, add_special_tokens=False)
            np.add.at(count, owners, [len(e) for e in encoded])

        for i, chunk in enumerate(chunks):
            for piece in safe_cuts(chunk, self.step) if len(chunk) > self.step else (chunk,):
                texts.append(piece)
                owners.append(i)
                size += len(piece.encode())
                if size >= self.call_bytes:
                    encode()
                    texts, owners, size = [], [], 0
        if texts:
            encode()
        return count

    def of_texts(self, texts: pa.Array) -> np.ndarray:
        """The number of tokens of each text."""
        lists = pc.ascii_split_whitespace(texts.fill_null("").cast(pa.large_string()))
        ends = lists.offsets.to_numpy()
        chunks = lists.values.slice(ends[0], ends[-1] - ends[0]).dictionary_encode()
        counts = self.of_chunks(chunks.dictionary.to_pylist())
        total = np.concatenate([[0], np.cumsum(counts[chunks.indices.to_numpy()])])
        return np.diff(total[ends - ends[0]])


def _counted(vocabulary: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(vocabulary)
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_bytes"), pa.array(counter.of_texts(batch.column("text")))],
                names=["doc_id", "n_bytes", "n_tokens"],
            )

    return run


def token_counts(
    spark: SparkSession, documents: DataFrame, vocabulary: str = VOCABULARY, limit: int = LIMIT
) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every document row.

    ``n_tokens`` is what the library counts for the whole text, strings of special tokens
    inside it included. A null or empty text has none. One row per input row, repeated
    rows included; a null id stays null. A text of any length is counted whole; one long
    run without white space or another safe place is encoded in one piece. Other columns
    are not read. ``vocabulary`` must be one that drops white space, as the default does.
    """
    small_batches(spark)
    sized = documents.select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    counted = sized.mapInArrow(_counted(vocabulary), "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def op13_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """The token count of every document."""
    return token_counts(spark, read_table(spark, folder, "documents"))
