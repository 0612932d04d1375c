"""Conversations as token ids with a loss mask, assembled from separately encoded segments.

A turn is ``<|turn|>`` role ``<|text|>`` text ``<|end|>``. The three marks are reserved ids
beyond the vocabulary; they are spliced between the ids of the role and of the text, so
no text can ever encode to a mark. The marks' strings, and those of common templates,
are escaped in roles and texts as well, so the written form can be read back too.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from tradewake.llm.shared import Scratch, numbered, read_table, small_batches
from tradewake.llm.tokens import RANKS, VOCABULARY, Encoder

# The marks of this template, in the order of their ids.
MARKS = ("<|turn|>", "<|text|>", "<|end|>")
# Control strings of common chat templates.
CONTROLS = (
    *MARKS,
    "<|endoftext|>",
    "<|im_start|>",
    "<|im_end|>",
    "<|system|>",
    "<|user|>",
    "<|assistant|>",
    "<s>",
    "</s>",
    "[INST]",
    "[/INST]",
    "<<SYS>>",
    "<</SYS>>",
)
TRAINED_ROLE = "assistant"

# A control string is its first character and a rest; an escaped one has backslashes in
# between. Neither part holds a backslash, so adding one or taking one away is exact.
_ANY = "|".join(f"(?<={re.escape(c[0])})(\\\\*)(?={re.escape(c[1:])})" for c in CONTROLS)
_PLACES = re.compile(_ANY)


def escape(text: str) -> str:
    """The text with one more backslash inside every control string, escaped or not."""
    return _PLACES.sub(lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    """The text that ``escape`` was given."""
    return _PLACES.sub(lambda m: m[0][1:], text)


def _segments(vocabulary: str, ranks: str | None):
    """Turns to turns with the ids of their role and text, each encoded on its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # No control string is left after escaping, so all is text.
        encoder = Encoder(vocabulary, ranks, plain_text=True)

        def ids(texts: pa.Array) -> pa.Array:
            return pa.array([encoder.ids(escape(t.as_py() or "")) for t in texts], pa.binary())

        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in ("conv_id", "turn", "order_role", "order_text")),
                    ids(batch.column("role")),
                    ids(batch.column("text")),
                    pa.array([r.as_py() == TRAINED_ROLE for r in batch.column("role")]),
                ],
                names=["conv_id", "turn", "order_role", "order_text", "role_ids", "text_ids", "trained"],
            )

    return run


def encoded_turns(
    spark: SparkSession, turns: DataFrame, vocabulary: str = VOCABULARY, ranks: str | None = RANKS
) -> DataFrame:
    """Every turn's role and text as ids. The heavy work, done before turns are gathered."""
    small_batches(spark)
    order = [F.xxhash64("role").alias("order_role"), F.xxhash64("text").alias("order_text")]
    return turns.select("conv_id", "turn", *order, "role", "text").mapInArrow(
        _segments(vocabulary, ranks),
        "conv_id long, turn long, order_role long, order_text long, "
        "role_ids binary, text_ids binary, trained boolean",
    )


def assemble(parts: list[tuple[bytes, bytes, bool]], first_mark: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids of a run of turns and their loss mask, from (role ids, text ids, trained).

    Segment lengths give the segments' bounds by prefix sums; the mask is the prefix sum
    of +1 where a trained text begins and -1 where it ends.
    """
    marks = [np.array([first_mark + i], "<u4").tobytes() for i in range(len(MARKS))]
    segments = [s for role, text, _ in parts for s in (marks[0], role, marks[1], text, marks[2])]
    ids = np.frombuffer(b"".join(segments), "<u4")
    bounds = np.concatenate([[0], np.cumsum([len(s) // 4 for s in segments])])
    trained = np.flatnonzero([t for _, _, t in parts]) * 5 + 3
    change = np.zeros(len(ids) + 1, np.int64)
    np.add.at(change, bounds[trained], 1)
    np.add.at(change, bounds[trained + 1], -1)
    return ids, np.cumsum(change[:-1]).astype(np.int8)


# Ids at which a part ends, at the next turn's end.
PART_IDS = 1 << 16

_PART = "conv_id long, part long, ids array<long>, loss_mask array<tinyint>"


def _formatted(first_mark: int):
    """Turns, in order of parts, to one row for each part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(key, turns) -> pa.RecordBatch:
            ids, mask = assemble(turns, first_mark)
            lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x)) for x in (ids.astype(np.int64), mask)]
            return pa.RecordBatch.from_arrays(
                [pa.array([key[0]], pa.int64()), pa.array([key[1]], pa.int64()), *lists],
                names=["conv_id", "part", "ids", "loss_mask"],
            )

        here, turns = None, []
        for batch in batches:
            columns = [batch.column(c) for c in ("conv_id", "part", "role_ids", "text_ids", "trained")]
            for conv, part, role, text, trained in zip(*columns):
                key = (conv.as_py(), part.as_py())
                if turns and key != here:
                    yield out(here, turns)
                    turns = []
                here = key
                turns.append((role.as_py(), text.as_py(), trained.as_py()))
        if turns:
            yield out(here, turns)

    return run


def format_conversations(
    spark: SparkSession, turns: DataFrame, vocabulary: str = VOCABULARY, ranks: str | None = RANKS
) -> DataFrame:
    """``conv_id, part, ids, loss_mask``: the training sequences of all conversations.

    Rows are ordered by turn; equal turns by hashes of role and text, so the order is
    stable. A null role or text is empty; a null turn comes first; rows without a
    conv_id form one conversation. Repeated rows are repeated turns. A conversation is
    cut at turns into parts of some 65,536 ids, of which each is assembled by itself, so
    neither a row nor a task grows with a conversation, only with one very long text.
    Texts of the assistant are under the mask, nothing else. Other columns are not read.
    """
    first = Encoder(vocabulary, None).exact.get_vocab_size()
    scratch = Scratch(spark)
    encoded = scratch.save(encoded_turns(spark, turns, vocabulary, ranks), "encoded")
    size = (F.octet_length("role_ids") + F.octet_length("text_ids")) / 4 + len(MARKS)
    order = ["turn", "order_role", "order_text"]
    placed = numbered(scratch, encoded.withColumn("size", size.cast("long")), ["conv_id"], order, "start", "turns", "size")
    parts = placed.withColumn("part", F.floor(F.col("start") / PART_IDS))
    dealt = parts.repartition("conv_id", "part").sortWithinPartitions("conv_id", "part", "start")
    return dealt.mapInArrow(_formatted(first), _PART)


class Reader:
    """Reads assembled ids back, turn by turn, into digests of what they say."""

    def __init__(self, tokenizer: Tokenizer, first_mark: int):
        self.decode = lambda ids: tokenizer.decode(ids.tolist(), skip_special_tokens=False)
        self.first_mark = first_mark
        self.turns = self.loss_chars = self.chars = 0
        self.whole, self.loss = hashlib.sha256(), hashlib.sha256()

    def read(self, ids: np.ndarray, mask: np.ndarray) -> None:
        """A part: whole turns, and the mask that lies on them."""
        marks = np.flatnonzero(ids >= self.first_mark)
        for begin, middle, end in marks.reshape(-1, 3):
            role, text = self.decode(ids[begin + 1 : middle]), self.decode(ids[middle + 1 : end])
            self.turns += 1
            self.chars += sum(map(len, (*MARKS, role, text)))
            self.whole.update(f"{unescape(role)}\n{unescape(text)}\n".encode())
        edges = np.flatnonzero(np.diff(np.concatenate([[0], mask, [0]])))
        for begin, end in edges.reshape(-1, 2):
            text = unescape(self.decode(ids[begin:end]))
            self.loss_chars += len(text)
            self.loss.update(text.encode())


_DIGEST = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
)


def _digests(vocabulary: str, first_mark: int):
    """Parts, in order, to one row for each conversation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = Tokenizer.from_file(vocabulary)
        here, reader, rows = None, None, []

        def out() -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

        def row(conv, r: Reader) -> tuple:
            return conv, r.turns, r.whole.hexdigest(), r.loss_chars, r.loss.hexdigest(), r.chars

        for batch in batches:
            ids, masks = batch.column("ids"), batch.column("loss_mask")
            for i, conv in enumerate(batch.column("conv_id").to_pylist()):
                if reader is None or conv != here:
                    if reader is not None:
                        rows.append(row(here, reader))
                    here, reader = conv, Reader(tokenizer, first_mark)
                reader.read(ids[i].values.to_numpy(), masks[i].values.to_numpy())
            if rows:
                yield out()
                rows = []
        if reader is not None:
            rows.append(row(here, reader))
            yield out()

    return run


def conversation_digests(spark: SparkSession, parts: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Counts and digests of every conversation, read back from ``format_conversations``' rows.

    Parts of a conversation are read one after the other, as its digest needs.
    """
    small_batches(spark)
    first = Tokenizer.from_file(vocabulary).get_vocab_size()
    dealt = parts.repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return dealt.mapInArrow(_digests(vocabulary, first), _DIGEST)


def with_control_conversation(spark: SparkSession, turns: DataFrame) -> DataFrame:
    """The conversations and conversation -7, whose texts are made of control strings."""
    said = "</s>[INST] ok [/INST]"
    kind = T.StructType().add("conv_id", "long").add("turn", "long").add("role", "string").add("text", "string")
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], kind)
    return turns.select(*kind.names).unionByName(more)


def op8_token_level_chat(spark: SparkSession, folder: str) -> DataFrame:
    """All conversations and conversation -7, formatted and read back."""
    turns = with_control_conversation(spark, read_table(spark, folder, "conversations"))
    parts = Scratch(spark).save(format_conversations(spark, turns), "formatted")
    return conversation_digests(spark, parts)
