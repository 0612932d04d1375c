"""Rendezvous hashing of record keys over weighted shards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tradewake.llm.shared import Scratch, numbered, read_table, text_or_empty

SHARDS = 24

# Hex digits of the digest that become the uniform number; 52 bits fit a double.
DIGITS = 13


def _bid(key: Column, shard: int, weight: float) -> Column:
    """A shard's bid for a key: an exponential variate with the weight as its rate.

    The smallest bid wins, which happens with a probability in proportion to the weight.
    """
    digest = F.md5(F.concat(key, F.lit(f":{shard}")).cast("binary"))
    drawn = F.conv(F.substring(digest, 1, DIGITS), 16, 10).cast("double")
    uniform = (drawn + F.lit(0.5)) / F.lit(float(16**DIGITS))
    return -F.log(uniform) / F.lit(float(weight))


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard of a key: ``len(weights)`` shards bid, the smallest bid wins.

    A bid depends on the key, the shard's number and its own weight only. Thus a further
    shard takes over the keys it wins and moves no other one, and a change of one weight
    moves keys between that shard and the others only. Shards of weight 0 get nothing.
    A null key counts as the empty text.
    """
    if not any(w > 0 for w in weights) or any(w < 0 for w in weights):
        raise ValueError("weights must not be negative, and one must be above 0")
    text = F.coalesce(key.cast("string"), F.lit(""))
    bids = [
        F.struct(_bid(text, shard, weight).alias("bid"), F.lit(shard).alias("shard"))
        for shard, weight in enumerate(weights)
        if weight > 0
    ]
    return F.array_min(F.array(*bids))["shard"]


def assign_shards(documents: DataFrame, weights: Sequence[float], grown: Sequence[float]) -> DataFrame:
    """Every document's shard now and with the weights ``grown``, without its text.

    One row per input row, repeated rows included. A null text has no bytes and the
    checksum of the empty text; a null id is hashed as the empty text. Further columns
    of the input are not read. No shuffle: the shard follows from the row itself.
    """
    text = text_or_empty()
    return documents.select(
        "doc_id",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        rendezvous(F.col("doc_id"), weights).alias("shard"),
        rendezvous(F.col("doc_id"), grown).alias("grown_shard"),
    )


def op1_rendezvous_shards(spark: SparkSession, folder: str) -> DataFrame:
    """All documents over 24 shards of equal weight, with their place in the shard."""
    placed = assign_shards(read_table(spark, folder, "documents"), [1.0] * SHARDS, [1.0] * (SHARDS + 1))
    rows = numbered(Scratch(spark), placed, ["shard"], ["doc_id", "text_crc32", "size"], "slot", "placed")
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )
