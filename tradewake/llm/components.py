"""Connected components by alternating joins, for links of any number and any degree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradewake.llm.shared import Scratch

# Rounds halve the length of chains, so this is out of reach for any real graph.
ROUNDS = 60


def components(scratch: Scratch, links: DataFrame, name: str) -> DataFrame:
    """``node, component`` for the nodes of ``links`` (columns a and b, longs).

    The component is the smallest node that can be reached. Each round hangs every
    node's larger neighbours, then its smaller ones, below the smallest neighbour, until
    nothing moves. A neighbourhood is only ever reduced to its minimum, which combines
    before the shuffle, and joined back, which adaptive execution can split, so a node
    with any number of links is no burden to one task. Links of a node to itself and
    null ends are left out.
    """

    def symmetric(edges: DataFrame) -> DataFrame:
        return edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))

    def smaller_below(edges: DataFrame) -> DataFrame:
        low = edges.groupBy("a").agg(F.min("b").alias("low"))
        moved = edges.join(low, "a").where("b != low")
        return moved.select(F.col("b").alias("a"), F.col("low").alias("b")).union(
            low.select("a", F.col("low").alias("b"))
        )

    ends = links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = scratch.save(ends.distinct(), f"{name}_0")
    for round_ in range(1, ROUNDS):
        both = symmetric(edges)
        # Written, so that the join back, which can meet a hub, starts from plain shuffles.
        around = scratch.save(
            both.groupBy("a").agg(
                F.min(F.least("a", "b")).alias("low"), F.count_if(F.col("b") < F.col("a")).alias("up"), F.count("*").alias("n")
            ),
            f"{name}_{round_}_low",
        )
        # Settled: every node hangs below one node at most, which hangs below none.
        if around.where("up > 1 or up = 1 and n > 1").isEmpty():
            break
        larger = both.where("b > a").join(around.select("a", "low"), "a")
        larger_below = larger.select(F.col("b").alias("a"), F.col("low").alias("b"))
        nearer = smaller_below(larger_below).where("a != b").distinct()
        edges = scratch.save(nearer, f"{name}_{round_}")
        scratch.drop(f"{name}_{round_}_low", f"{name}_{round_ - 1}")
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )


def extended(scratch: Scratch, labels: DataFrame, links: DataFrame, name: str) -> DataFrame:
    """The components (as of :func:`components`) with more links.

    Links are drawn between the components that their ends are in, so what has been found
    is not looked at again, and only components that meet are named anew.
    """
    of_a = labels.select(F.col("node").alias("a"), F.col("component").alias("_a"))
    of_b = labels.select(F.col("node").alias("b"), F.col("component").alias("_b"))
    met = links.join(of_a, "a", "left").join(of_b, "b", "left")
    between = met.select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b")).where("a != b")
    moved = scratch.save(components(scratch, between, name), f"{name}_moved")
    to = moved.select(F.col("node").alias("component"), F.col("component").alias("_to"))
    known = labels.join(to, "component", "left").select("node", F.coalesce("_to", "component").alias("component"))
    new = moved.join(labels.select("node"), "node", "left_anti").select("node", "component")
    return scratch.save(known.union(new), f"{name}_labels")
