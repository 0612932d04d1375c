"""The trie of conversation prefixes, built from running digests of the turns.

The first d turns of a conversation are named by the exclusive or of digests of place and
turn, a running value, so equal prefixes get equal names in one pass, whatever their length.
The digests hold a number drawn for each call: no texts can be chosen to make two prefixes
collide.

A node belongs to the smallest conversation that has it. A conversation's own nodes are the
deepest ones of its path, from some depth on. Totals over a subtree are sums over its
members: of what each member adds from that depth to where its own nodes begin (turns that
another conversation has already), and of the leaf that it may own. So every total is one
aggregation by node, and the number of jobs does not depend on the longest conversation.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tradewake.llm.shared import Scratch, numbered, read_table, text_or_empty

# Conversations with the same hundreds share a head of fewer than HEADS turns.
FAMILY, HEADS = 100, 6
# Member ids in one piece of a node's list: those between multiples of this number.
IDS = 4096
# Turns of one conversation that meet in a task.
TURNS = 1024

EMPTY = hashlib.sha256().hexdigest()
_ID = ["depth", "conv_id"]
# A prefix: its depth and the two halves of its name.
_PREFIX = ["depth", "x", "y"]


def rebuilt(scratch: Scratch, turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All conversations ``conv_id, n``, and their rebuilt turns ``conv_id, n, i, name, chars``.

    A turn's name is a digest of its role and text. Turns are numbered from 0 by ranges,
    so no conversation meets in one task.
    """
    role, text = text_or_empty("role"), text_or_empty("text")
    told = turns.where("conv_id is not null").select(
        F.col("conv_id").cast("long"),
        F.col("turn").cast("long"),
        F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text)).alias("name"),
        F.char_length(text).cast("long").alias("chars"),
    )
    own = scratch.save(numbered(scratch, told, ["conv_id"], ["turn", "name"], "i", "dealt"), "own")
    size = own.groupBy("conv_id").agg((F.max("i") + 1).alias("size"))
    head = F.crc32(F.col("conv_id").cast("string")) % HEADS
    sized = size.select("conv_id", "size", head.alias("head"), (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("of"))
    given = size.select(F.col("conv_id").alias("of"), F.col("size").alias("given"))
    taken = F.least("head", F.coalesce("given", F.lit(0).cast("long")))
    left = F.greatest(F.col("size") - F.col("head"), F.lit(0).cast("long"))
    plan = scratch.save(
        sized.join(given, "of", "left").select("conv_id", "of", "head", taken.alias("taken"), (taken + left).alias("n")), "plan"
    )
    later = own.join(plan, "conv_id").where("i >= head").select(
        "conv_id", "n", (F.col("i") - F.col("head") + F.col("taken")).alias("i"), "name", "chars"
    )
    heads = own.where(F.col("i") < HEADS).select(F.col("conv_id").alias("of"), "i", "name", "chars")
    first = plan.where("taken > 0").join(heads, "of").where("i < taken").select("conv_id", "n", "i", "name", "chars")
    return plan.select("conv_id", "n"), first.union(later)


def prefixes(scratch: Scratch, turns: DataFrame, longest: int) -> DataFrame:
    """All prefixes but the empty one: ``conv_id, n, depth, x, y, chars, told``.

    ``chars`` are the code points of the last text, ``told`` those of all texts. A
    conversation is cut every TURNS turns; a part's last row holds what it adds to the
    parts after it.
    """
    digest = F.md5(F.concat_ws(":", F.lit(uuid.uuid4().hex), F.col("i").cast("string"), "name"))
    half = [F.conv(F.substring(digest, k, 15), 16, 10).cast("long").alias(c) for k, c in ((1, "x"), (16, "y"))]
    part = F.expr(f"i div {TURNS}").alias("part")
    within = W.partitionBy("conv_id", "part").orderBy("i").rowsBetween(W.unboundedPreceding, 0)

    def running(over: W) -> list:
        return [F.bit_xor("x").over(over).alias("x"), F.bit_xor("y").over(over).alias("y"), F.sum("told").over(over).alias("told")]

    rows = scratch.save(
        turns.select("conv_id", "n", "i", part, "chars", F.col("chars").alias("told"), *half).select(
            "conv_id", "n", (F.col("i") + 1).alias("depth"), "part", "chars", *running(within)
        ),
        "prefixes_of_parts",
    )
    if longest > TURNS:
        before = rows.where(F.col("depth") % TURNS == 0).select(
            "conv_id", (F.col("part") + 1).alias("part"),
            *running(W.partitionBy("conv_id").orderBy("part").rowsBetween(W.unboundedPreceding, 0)),
        )
        before = before.withColumnsRenamed({c: f"{c}_before" for c in ("x", "y", "told")})
        no = F.lit(0).cast("long")
        rows = scratch.save(
            rows.join(before, ["conv_id", "part"], "left").select(
                "conv_id", "n", "depth", "chars",
                *[F.col(c).bitwiseXOR(F.coalesce(f"{c}_before", no)).alias(c) for c in ("x", "y")],
                (F.col("told") + F.coalesce("told_before", no)).alias("told"),
            ),
            "prefixes",
        )
    return rows.select("conv_id", "n", *_PREFIX, "chars", "told")


def own_paths(scratch: Scratch, convs: DataFrame, rows: DataFrame, root: int) -> DataFrame:
    """Of each conversation ``conv_id, n, own, leaf, upto, at``.

    Its nodes from depth ``own`` on are its own, n + 1 if there are none; ``leaf`` is 1 if
    the last one is a leaf. ``at`` names the node above them, and ``upto`` are the code
    points of all texts to there.
    """
    told = rows.where("depth > 0")
    ends = F.sum((F.col("depth") == F.col("n")).cast("long"))
    # Written, so that joining back can split a prefix that many conversations share.
    nodes = scratch.save(
        told.groupBy(*_PREFIX).agg(F.min("conv_id").alias("least"), (F.count("*") == ends).alias("ended")), "nodes"
    )
    owned = nodes.groupBy(F.col("least").alias("conv_id")).agg(
        F.min("depth").alias("own"), F.max(F.col("ended").cast("long")).alias("leaf")
    )
    paths = convs.join(owned, "conv_id", "left").select(
        "conv_id", F.coalesce("own", F.col("n") + 1).alias("own"), F.coalesce("leaf", F.lit(0).cast("long")).alias("leaf")
    )
    above = scratch.save(
        rows.join(paths, "conv_id")
        .where("depth = own - 1")
        .select("conv_id", "n", "own", "leaf", F.col("told").alias("upto"), *_PREFIX),
        "above",
    )
    columns = ["conv_id", "n", "own", "leaf", "upto"]
    at_root = above.where("depth = 0").select(*columns, F.lit(root).cast("long").alias("at"))
    below = above.where("depth > 0").join(nodes, _PREFIX).select(*columns, F.col("least").alias("at"))
    return scratch.save(at_root.union(below), "paths")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    here, digest = None, None
    for batch in batches:
        done = []
        for depth, conv, ids in zip(*(batch.column(c).to_pylist() for c in ("depth", "conv_id", "ids"))):
            if (depth, conv) == here:
                digest.update(b",")
            else:
                if here is not None:
                    done.append((*here, digest.hexdigest()))
                here, digest = (depth, conv), hashlib.sha256()
            digest.update(ids.encode())
        yield _digest_rows(done)
    if here is not None:
        yield _digest_rows([(*here, digest.hexdigest())])


def _digest_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string())
    columns = list(zip(*rows)) or [(), (), ()]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(columns, kinds)], names=["depth", "conv_id", "ends_sha256"]
    )


def end_digests(members: DataFrame) -> DataFrame:
    """``depth, conv_id, ends_sha256`` of ``depth, conv_id, member`` rows.

    Ids are first joined in pieces of at most IDS; only the digest takes the pieces of a
    node one after the other.
    """
    piece = F.floor(F.col("member") / IDS).alias("piece")
    ids = F.array_join(F.sort_array(F.collect_list("member")).cast("array<string>"), ",").alias("ids")
    pieces = members.groupBy(*_ID, piece).agg(ids)
    return (
        pieces.repartition(*_ID)
        .sortWithinPartitions(*_ID, "piece")
        .select(*_ID, "ids")
        .mapInArrow(_digests, "depth long, conv_id long, ends_sha256 string")
    )


def prefix_trie(spark: SparkSession, turns: DataFrame) -> DataFrame:
    """Every node of the trie of rebuilt conversations.

    Returns ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256``. Turns are ordered by ``turn``, null first; equal turns by
    a digest of role and text, so the order is stable; repeated rows are repeated turns.
    A null role or text is empty. Rows without a ``conv_id`` belong to no conversation
    and are left out. ``conv_id % 100`` has the id's sign, as in SQL. A table without
    conversations gives no rows. Other columns are not read.
    """
    scratch = Scratch(spark)
    convs, turns = rebuilt(scratch, turns)
    root, longest = convs.agg(F.min("conv_id"), F.max("n")).first()
    zero = F.lit(0).cast("long")
    none = [zero.alias(c) for c in (*_PREFIX, "chars", "told")]
    rows = prefixes(scratch, turns, longest or 0).union(convs.select("conv_id", "n", *none))
    paths = own_paths(scratch, convs, rows, root)
    depth, own = F.col("depth"), F.col("own")
    # Of the members of a node, only the smallest has it as its own.
    parent = F.when(own < depth, F.col("conv_id")).when(own == depth, F.col("at"))
    n_children = F.sum(((own <= depth + 1) & (depth < F.col("n"))).cast("long"))
    saved = F.when(depth < own, F.col("upto") - (F.col("told") - F.col("chars"))).otherwise(zero)
    nodes = (
        rows.drop("n")
        .join(paths, "conv_id")
        .groupBy(*_PREFIX)
        .agg(
            F.min("conv_id").alias("conv_id"), F.max(parent).alias("parent_conv_id"), F.count("*").alias("n_convs"),
            n_children.alias("n_children"), F.sum("leaf").alias("n_leaves"), F.sum(saved).alias("saved_tokens"),
        )
    )
    at = F.when(own <= F.col("n"), F.col("conv_id")).otherwise(F.col("at"))
    digests = end_digests(paths.select(F.col("n").alias("depth"), at.alias("conv_id"), F.col("conv_id").alias("member")))
    # A root without children is the only leaf, and nobody's own.
    n_leaves = F.when(F.col("n_children") == 0, F.lit(1).cast("long")).otherwise(F.col("n_leaves"))
    return nodes.join(digests, _ID, "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", n_leaves.alias("n_leaves"), "saved_tokens",
        F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"),
    )


def op12_conversation_trie(spark: SparkSession, folder: str) -> DataFrame:
    """The prefix trie of all conversations."""
    return prefix_trie(spark, read_table(spark, folder, "conversations"))
