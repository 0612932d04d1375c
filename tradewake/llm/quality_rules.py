"""Robust multivariate outliers among documents, in DataFrame operations only.

Each text gives six statistics. Per language and source, the minimum covariance
determinant (MCD) method estimates their centre and covariance from the three quarters of
the documents whose covariance has the least determinant. Four starts, three of them from
the half of the documents that is nearest to the medians by different measures, are
refined: the documents nearest to an estimate give the next one. The start with the least
determinant goes on until its determinant falls no more. A document far from the estimate
in Mahalanobis distance is rejected.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tradewake.llm.shared import Scratch, read_table, text_or_empty

BLANKS = r"[\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"

# Share of the documents that an estimate rests on, and that a start rests on.
CORE = 0.75
FIRST_CORE = 0.5
# By which size of the standardised statistics a start takes the nearest documents.
STARTS = ("all", "euclid", "largest", "sum")
# Steps that all starts take; the best one goes on until the logarithm of its determinant
# falls by less than FALL. A step that makes it fall strictly never repeats a set of
# documents, so it ends; MOST is out of reach.
FIRST_STEPS, MOST, FALL = 2, 100, 1e-9
# Fewer documents than this give no estimate of their own: the language's is taken, or
# that of all documents, or none.
LEAST = 50
# Probability with which a normal document lies beyond the cut.
TAIL = 1e-6

# Statistics and the least standard deviation that each is taken to have. Most of them
# are 0 for most texts, so their plain deviations would vanish. Each is small enough for
# the statistic to reach the cut by itself.
VECTOR = {
    "log_words": 0.5,
    "log_word_length": 0.08,
    "symbol_share": 0.02,
    "dup_line_share": 0.08,
    "repeat_share": 0.07,
    "upper_share": 0.03,
}
P = len(VECTOR)
COUNTS = [
    "n_words",
    "word_chars",
    "n_symbols",
    "n_dup_lines",
    "n_lines",
    "n_repeat_words",
    "n_upper",
    "base_failed",
]
_MEANS = [f"m{i}" for i in range(P)]
_FACTORS = [f"w{i}{j}" for i in range(P) for j in range(i + 1)]


def chi_square_below(x: float, degrees: int) -> float:
    """The chi-square distribution function for an even number of degrees."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(degrees // 2))


def chi_square_quantile(q: float, degrees: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square_below(middle, degrees) < q else (low, middle)
    return low


CUT = chi_square_quantile(1 - TAIL, P)


def consistency(share: float) -> float:
    """By which factor the covariance of the nearest share is too small if documents are normal."""
    return share / chi_square_below(chi_square_quantile(share, P), P + 2)


def _placed(threes: Column) -> Column:
    """The hashes of a text's 3-word windows, sorted, with their places; null if all differ.

    A column of its own, since lambdas that look into an expression compute it each time.
    """
    placed = F.sort_array(F.transform(threes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(threes)) < F.size(threes), placed)


def _repeat_words(placed: Column) -> Column:
    """How many words lie in windows with an equal neighbour in the sorted order."""
    same = F.transform(
        placed,
        lambda x, k: F.when(
            (F.get(placed, k - 1)["h"] == x["h"]) | (F.get(placed, k + 1)["h"] == x["h"]), x["i"]
        ),
    )
    covered = F.flatten(F.transform(F.array_compact(same), lambda i: F.array(i, i + 1, i + 2)))
    return F.coalesce(F.size(F.array_distinct(covered)), F.lit(0))


def with_statistics(documents: DataFrame) -> DataFrame:
    """The columns of ``documents`` in a struct ``row``, and the counts of each text.

    Words are runs without ASCII white space. A null text counts as empty.
    """
    row = F.struct(*documents.columns)
    d = documents.select(row.alias("row"), text_or_empty().alias("t"))
    d = d.select("row", "t", F.array_remove(F.split("t", f"{BLANKS}+"), "").alias("words"))
    threes = F.transform(
        F.slice("words", 1, F.greatest(F.size("words") - 2, F.lit(0))),
        lambda w, i: F.xxhash64(w, F.get("words", i + 1), F.get("words", i + 2)),
    )
    lines = F.filter(F.split("t", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    d = d.select("row", "t", "words", threes.alias("threes"), lines.alias("lines"))
    d = d.select("row", "t", "words", "lines", _placed(F.col("threes")).alias("placed"))
    n = F.size("words").cast("long")
    chars = F.char_length(F.regexp_replace("t", f"{BLANKS}+", "")).cast("long")
    counts = F.struct(
        n.alias("n_words"),
        chars.alias("word_chars"),
        (F.char_length("t") - F.char_length(F.translate("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").cast("long").alias("n_lines"),
        _repeat_words(F.col("placed")).cast("long").alias("n_repeat_words"),
        (F.char_length("t") - F.char_length(F.regexp_replace("t", r"\p{Lu}", ""))).cast("long").alias("n_upper"),
    )
    # Put out by a generator: a later filter would otherwise be pushed below and count
    # everything anew for each of its terms.
    d = d.select("row", F.explode(F.array(counts)).alias("c")).select("row", "c.*")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return d.withColumn("base_failed", failed)


def vector() -> dict[str, Column]:
    """The transformed statistics; only for texts with words."""
    n, chars = F.col("n_words"), F.col("word_chars")
    return {
        "log_words": F.log(n),
        "log_word_length": F.log(F.try_divide(chars, n)),
        "symbol_share": F.try_divide("n_symbols", chars),
        "dup_line_share": F.try_divide("n_dup_lines", "n_lines"),
        "repeat_share": F.try_divide("n_repeat_words", n),
        "upper_share": F.try_divide("n_upper", chars),
    }


def _group(*parts: str) -> Column:
    """A name for a language and source, one for a language, or the one for all."""
    named = [F.coalesce(F.concat(F.lit("="), F.col(p)), F.lit("-")) for p in parts]
    return F.concat_ws("\n", F.lit(str(len(parts))), *named)


def distance() -> Column:
    """The squared Mahalanobis distance of the vector from the estimate."""
    away = [F.col(v) - F.col(m) for v, m in zip(VECTOR, _MEANS)]
    parts = [sum((F.col(f"w{i}{j}") * away[j] for j in range(i + 1)), F.lit(0.0)) for i in range(P)]
    return sum((part * part for part in parts), F.lit(0.0))


def _sized(rows: DataFrame, quartiles: DataFrame) -> DataFrame:
    """Every document for every start, with its size ``d2`` by that start's measure."""
    z = [F.abs((F.col(v) - F.col(f"q_{v}")) / F.col(f"s_{v}")) for v in VECTOR]
    zero = F.lit(0.0)
    size = {"all": zero, "euclid": sum((x * x for x in z), zero), "largest": F.greatest(*z), "sum": sum(z, zero)}
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("start"), size[name].alias("d2")) for name in STARTS]))
    return rows.join(quartiles, "group").select("group", *VECTOR, each.alias("s")).select("group", "s.start", *VECTOR, "s.d2")


def _quartiles(rows: DataFrame) -> DataFrame:
    """Medians and deviations of the groups that are large enough."""
    found = rows.groupBy("group").agg(
        F.count("*").alias("n"), *[F.percentile_approx(v, [0.25, 0.5, 0.75], 10000).alias(f"p_{v}") for v in VECTOR]
    )
    columns = []
    for v, least in VECTOR.items():
        spread = (F.col(f"p_{v}")[2] - F.col(f"p_{v}")[0]) / 1.349
        columns += [F.col(f"p_{v}")[1].alias(f"q_{v}"), F.sqrt(spread * spread + least * least).alias(f"s_{v}")]
    return found.where(F.col("n") >= LEAST).select("group", *columns)


def _whitening(moments: DataFrame) -> DataFrame:
    """Means and covariances c_ij to means, the inverse of the Cholesky factor and the determinant."""
    rows = moments
    for i in range(P):
        for j in range(i + 1):
            rest = F.col(f"c{i}{j}") - sum((F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j)), F.lit(0.0))
            rows = rows.withColumn(f"l{i}{j}", F.sqrt(rest) if i == j else rest / F.col(f"l{j}{j}"))
    for i in range(P):
        for j in range(i + 1):
            if i == j:
                value = 1 / F.col(f"l{i}{i}")
            else:
                value = -sum((F.col(f"l{i}{k}") * F.col(f"w{k}{j}") for k in range(j, i)), F.lit(0.0)) / F.col(f"l{i}{i}")
            rows = rows.withColumn(f"w{i}{j}", value)
    log_det = sum((2 * F.log(F.col(f"l{i}{i}")) for i in range(P)), F.lit(0.0))
    return rows.select("group", "start", *_MEANS, *_FACTORS, log_det.alias("log_det"))


def _of_nearest(scratch: Scratch, measured: DataFrame, share: float, name: str) -> DataFrame:
    """The estimates from the share of each group and start whose ``d2`` is least.

    The radii are written, so that they are broadcast by their size and the sums combine
    before they move.
    """
    key = ["group", "start"]
    radius = F.percentile_approx("d2", share, 10000).alias("radius")
    radii = scratch.save(measured.groupBy(*key).agg(radius), f"radius_{name}")
    core = measured.join(radii, key).where("d2 <= radius")
    names, least = list(VECTOR), list(VECTOR.values())
    means = [F.avg(v).alias(m) for v, m in zip(names, _MEANS)]
    pairs = [(i, j) for i in range(P) for j in range(i + 1)]
    spreads = [F.covar_pop(names[i], names[j]).alias(f"s{i}{j}") for i, j in pairs]
    moments = core.groupBy(*key).agg(*means, *spreads)
    covariances = [
        (consistency(share) * F.col(f"s{i}{j}") + (least[i] ** 2 if i == j else 0.0)).alias(f"c{i}{j}") for i, j in pairs
    ]
    return scratch.save(_whitening(moments.select(*key, *_MEANS, *covariances)), f"estimate_{name}")


def _step(scratch: Scratch, rows: DataFrame, estimate: DataFrame, name: str) -> DataFrame:
    """The estimates from the documents nearest to the given ones."""
    measured = rows.join(estimate, "group").select("group", "start", *VECTOR, distance().alias("d2"))
    return _of_nearest(scratch, measured, CORE, name)


def _least(estimate: DataFrame) -> DataFrame:
    """Of each group the start with the least determinant."""
    best = F.min(F.struct(F.round("log_det", 9).alias("d"), F.col("start").alias("s"))).alias("best")
    chosen = estimate.groupBy("group").agg(best).select("group", F.col("best.s").alias("start"))
    return estimate.join(chosen, ["group", "start"])


def least_determinant(scratch: Scratch, rows: DataFrame) -> DataFrame:
    """The MCD estimate of each group of ``rows`` (group and the vector)."""
    quartiles = scratch.save(_quartiles(rows), "quartiles")
    estimate = _of_nearest(scratch, _sized(rows, quartiles), FIRST_CORE, "0")
    for step in range(1, FIRST_STEPS + 1):
        estimate = _step(scratch, rows, estimate, str(step))
    moving = scratch.save(_least(estimate), "moving_0")
    done = None
    for step in range(1, MOST):
        new = _step(scratch, rows, moving, f"more_{step}").withColumnRenamed("log_det", "new_det")
        met = moving.select("group", F.col("log_det").alias("old_det")).join(new, "group")
        falls = F.col("new_det") < F.col("old_det") - FALL
        lower = scratch.save(met.where(falls).withColumnRenamed("new_det", "log_det").drop("old_det"), f"moving_{step}")
        still = moving.join(lower.select("group"), "group", "left_anti")
        done = still if done is None else done.unionByName(still)
        moving = lower
        if moving.isEmpty():
            break
    return done.unionByName(moving)


def estimates(scratch: Scratch, statistics: DataFrame) -> DataFrame:
    """``lang, source`` and the estimate that holds for them, where there is one.

    ``statistics`` has lang, source and the counts. Documents that fail the base rules
    take no part. Sums and percentile sketches combine before the shuffle, so a source
    with a third of all documents is no burden to one task.
    """
    sound = statistics.where("not base_failed").select("lang", "source", *[c.alias(v) for v, c in vector().items()])
    pairs = scratch.save(sound.groupBy("lang", "source").agg(F.count("*").alias("n")), "pairs")
    langs = pairs.groupBy(F.col("lang").alias("of")).agg(F.sum("n").alias("n_lang"))
    named = pairs.join(langs, F.col("lang").eqNullSafe(F.col("of")))
    own = named.withColumn(
        "group",
        F.when(F.col("n") >= LEAST, _group("lang", "source"))
        .when(F.col("n_lang") >= LEAST, _group("lang"))
        .otherwise(_group()),
    )
    chosen = scratch.save(own.select("lang", "source", "group"), "chosen")
    # Every document takes part in its source, and in wider groups that are asked for.
    wide = chosen.select("group").distinct()
    at = sound.select(
        F.explode(F.array(_group("lang", "source"), _group("lang"), _group())).alias("group"), *VECTOR
    )
    rows = scratch.save(at.join(wide, "group", "left_semi"), "vectors")
    estimate = least_determinant(scratch, rows).drop("start", "log_det")
    return scratch.save(chosen.join(estimate, "group").drop("group"), "estimates")


def verdicts(counted: DataFrame, found: DataFrame) -> DataFrame:
    """``row``, the counts, ``base_failed``, ``distance2`` and ``kept`` of every document."""
    known = found.withColumnsRenamed({"lang": "_lang", "source": "_source"})
    same = F.col("row.lang").eqNullSafe(F.col("_lang")) & F.col("row.source").eqNullSafe(F.col("_source"))
    far = F.coalesce(F.col("distance2") > CUT, F.lit(False))
    return (
        counted.join(known, same, "left")
        .withColumns(vector())
        .withColumn("distance2", F.when(~F.col("base_failed"), distance()))
        .withColumn("kept", ~F.col("base_failed") & ~far)
        .select("row", *COUNTS, "distance2", "kept")
    )


def quality_verdicts(spark: SparkSession, documents: DataFrame) -> DataFrame:
    """``doc_id``, the counts, ``base_failed``, ``distance2`` and ``kept`` of every document.

    One row per input row, repeated rows included. A null text has no words and fails
    the base rules. Null languages and sources are groups of their own. Where no group
    has documents enough for an estimate, the base rules alone decide, and ``distance2``
    is null. Other columns of the input are not read.
    """
    scratch = Scratch(spark)
    counted = with_statistics(documents.select("doc_id", "lang", "source", "text"))
    row = F.struct("row.doc_id", "row.lang", "row.source").alias("row")
    statistics = scratch.save(counted.select(row, *COUNTS), "statistics")
    found = estimates(scratch, statistics.select("row.lang", "row.source", *COUNTS))
    return verdicts(statistics, found).select("row.doc_id", *COUNTS, "distance2", "kept")


def without_outliers(spark: SparkSession, documents: DataFrame) -> DataFrame:
    """The documents that are kept, with all their columns; see ``quality_verdicts``.

    Statistics are taken once for the estimates and again for the verdicts, so that no
    text is shuffled.
    """
    scratch = Scratch(spark)
    counted = with_statistics(documents)
    statistics = scratch.save(counted.select("row.lang", "row.source", *COUNTS), "statistics")
    kept = verdicts(counted, estimates(scratch, statistics)).where("kept")
    return kept.select(*[F.col("row").getField(c).alias(c) for c in documents.columns])


def op7_robust_outliers(spark: SparkSession, folder: str) -> DataFrame:
    """The base counts and the verdict on every document."""
    rows = quality_verdicts(spark, read_table(spark, folder, "documents"))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return rows.select("doc_id", *counts, "base_failed", "kept")
