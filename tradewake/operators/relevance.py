"""Full-text relevance: postings of words and BM25 scores.

A posting says how often a word occurs in a document of a day and how long the document
is. The postings of a day, sorted by word, are its inverted index: a search reads those
of its own words only. How many documents a word is in follows from its postings; how
many documents a day has, and how long they are together, is stored beside them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradewake.functions import values

# The usual weights of term frequency and document length.
K1, B = 1.2, 0.75
# Decimals of a score. Equal documents score equally whatever the order of the sums.
DIGITS = 6


def postings(documents: DataFrame, text: str = "sku_name") -> DataFrame:
    """``dt, word, doc_id, n, length`` for every word of every document; see ``values.tokens``."""
    words = documents.select("dt", "doc_id", values.tokens(F.col(text)).alias("words"))
    each = words.select("dt", "doc_id", F.size("words").alias("length"), F.explode("words").alias("word"))
    return each.groupBy("dt", "word", "doc_id", "length").agg(F.count(F.lit(1)).alias("n")).select(
        "dt", "word", "doc_id", "n", F.col("length").cast("long").alias("length")
    )


def day_sizes(documents: DataFrame, text: str = "sku_name") -> DataFrame:
    """``dt, docs, words``: the documents of each day and the words in them."""
    n = F.size(values.tokens(F.col(text)))
    return documents.groupBy("dt").agg(F.count(F.lit(1)).alias("docs"), F.sum(n).cast("long").alias("words"))


def _score(df: Column) -> Column:
    """BM25 of one word in one document, from ``n``, ``length``, ``docs`` and ``words``."""
    rarity = F.log(1 + (F.col("docs") - df + 0.5) / (df + 0.5))
    relative = F.col("length") * F.col("docs") / F.col("words")
    return rarity * F.col("n") / (F.col("n") + K1 * (1 - B + B * relative))


def word_scores(found: DataFrame, sizes: DataFrame) -> DataFrame:
    """``dt, word, doc_id, score`` for postings, all of their words; each day by its own figures."""
    # One row for each day and word.
    df = found.groupBy("dt", "word").agg(F.count(F.lit(1)).alias("df"))
    scored = found.join(df, ["dt", "word"]).join(sizes, "dt")
    return scored.select("dt", "word", "doc_id", _score(F.col("df")).alias("score"))


def ranked(found: DataFrame, sizes: DataFrame, keyword: str) -> DataFrame:
    """``dt, doc_id, score`` of the documents that hold every word of the keyword.

    ``found`` has the postings of the keyword's words, all of one or of several days. The
    score is rounded, so that it can be compared.
    """
    wanted = F.array_distinct(values.tokens(F.lit(keyword or "")))
    whole = word_scores(found, sizes).groupBy("dt", "doc_id").agg(
        F.count(F.lit(1)).alias("held"), F.sum("score").alias("score")
    )
    return whole.where(F.col("held") == F.size(wanted)).select("dt", "doc_id", F.round("score", DIGITS).alias("score"))
