"""Search over the sale table: filter, page, breakdowns, report."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tradewake import config
from tradewake.functions import values
from tradewake.operators.paging import PLACE, SortedRows, check_page, sorted_rows
from tradewake.schemas import SALE_DETAIL


def hits(sales: DataFrame, day: str, keyword: str = "") -> DataFrame:
    """Sales of a day whose ``sku_name`` holds every word of the keyword.

    Words are matched whole and without case. A keyword without any word sets no
    condition. The day is an exact match on the partition column.
    """
    of_day = sales.where(F.col("dt") == day)
    wanted = values.tokens(F.lit(keyword or ""))
    return of_day.where(F.size(F.array_except(wanted, values.tokens(F.col("sku_name")))) == 0)


def _closeness(keyword: str):
    """Share of the name's words that the keyword names: the order of the hits."""
    name = values.tokens(F.col("sku_name"))
    named = F.size(F.array_intersect(name, values.tokens(F.lit(keyword or ""))))
    return F.coalesce(named / F.nullif(F.size(F.array_distinct(name)), F.lit(0)), F.lit(0.0))


def _hit_order(found: DataFrame, keyword: str):
    ties = [F.col(c) for c in found.columns if c not in ("order_id", "order_detail_id")]
    return [_closeness(keyword).desc(), F.col("order_id"), F.col("order_detail_id"), *ties]


def page(found: DataFrame, keyword: str, number: int, size: int) -> DataFrame:
    """Page ``number`` (from 1) of the hits: best match first, then by ids."""
    check_page(number, size)
    return found.orderBy(*_hit_order(found, keyword)).offset((number - 1) * size).limit(size)


def total(found: DataFrame) -> DataFrame:
    """Number of hits, whatever the page."""
    return found.agg(F.count(F.lit(1)).alias("total"))


def _terms(found: DataFrame, column: str, size: int) -> DataFrame:
    counts = found.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("hits"))
    return counts.orderBy(F.col("hits").desc(), F.col(column)).limit(size)


def age_terms(found: DataFrame, size: int = config.AGE_BUCKETS) -> DataFrame:
    """The most frequent ages with their hits."""
    return _terms(found, "user_age", size)


def gender_terms(found: DataFrame, size: int = config.GENDER_BUCKETS) -> DataFrame:
    """The most frequent genders with their hits; unknown gender has no bucket."""
    return _terms(found, "user_gender", size)


def breakdown(found: DataFrame) -> DataFrame:
    """``user_age, user_gender, kind, hits``: hits by age, by gender and in all, from one pass.

    ``kind`` is 1 for a row of an age, 2 for one of a gender, 3 for the number of all hits,
    which is missing when there are none.
    """
    sets = [["user_age"], ["user_gender"], []]
    hits_ = F.count(F.lit(1)).alias("hits")
    return found.groupingSets(sets, "user_age", "user_gender").agg(F.grouping_id().alias("kind"), hits_)


def _shares(counted: DataFrame) -> DataFrame:
    """One row with the number of hits and all shares, from a :func:`breakdown`."""

    def hits_of(condition: str):
        return F.coalesce(F.sum(F.when(F.expr(condition), F.col("hits"))), F.lit(0).cast("bigint"))

    counts = counted.agg(
        hits_of("kind = 3").alias("total"),
        hits_of("kind = 1 and user_age < 20").alias("_under"),
        hits_of("kind = 1 and user_age >= 30").alias("_from"),
        hits_of("kind = 2 and user_gender = 'M'").alias("_male"),
    )
    shares = counts.select(
        "total",
        values.share_of(F.col("_under"), F.col("total")).alias("under_20"),
        values.share_of(F.col("_from"), F.col("total")).alias("from_30"),
        values.share_of(F.col("_male"), F.col("total")).alias("male"),
    )
    return shares.withColumns(
        {
            "between": values.rest_of_hundred(F.col("under_20"), F.col("from_30")),
            "female": values.rest_of_hundred(F.col("male")),
        }
    )


def _options(**named: str):
    return F.array(
        *[F.struct(F.lit(label).alias("name"), F.col(c).alias("value")) for c, label in named.items()]
    )


_AGE = {"under_20": config.AGE_UNDER_20, "from_30": config.AGE_FROM_30, "between": config.AGE_20_TO_30}
_GENDER = {"male": config.GENDER_MALE, "female": config.GENDER_FEMALE}


def age_share(found: DataFrame) -> DataFrame:
    """Shares of the age bands: ``(name, value)``. Unknown users have age 0.

    The band from 20 to 30 is what the two rounded shares leave of 100.
    """
    return _shares(breakdown(found)).select(F.inline(_options(**_AGE)))


def gender_share(found: DataFrame) -> DataFrame:
    """Share of ``M``, and the rest of 100 for everyone else: ``(name, value)``."""
    return _shares(breakdown(found)).select(F.inline(_options(**_GENDER)))


def breakdowns(
    found: DataFrame, age_size: int = config.AGE_BUCKETS, gender_size: int = config.GENDER_BUCKETS
) -> DataFrame:
    """``part, name, value``: all terms, shares and the total of the hits from one pass over them."""
    # A row for each age and gender, however many hits there are.
    counted = breakdown(found)
    rank = F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("hits"), "user_age", "user_gender"))
    known = counted.where("kind = 1 and user_age is not null or kind = 2 and user_gender is not null or kind = 3")
    size = F.when(F.col("kind") == 1, age_size).when(F.col("kind") == 2, gender_size).otherwise(1)
    part = F.element_at(F.array(F.lit("age"), F.lit("gender"), F.lit("total")), F.col("kind").cast("int"))
    name = F.when(F.col("kind") == 1, F.col("user_age").cast("string")).otherwise(F.col("user_gender"))
    terms = known.withColumn("_rank", rank).where(F.col("_rank") <= size).select(
        part.alias("part"), name.alias("name"), F.col("hits").cast("double").alias("value")
    )
    shares = _shares(counted)
    return (
        terms.union(shares.select(F.lit("age share"), F.inline(_options(**_AGE))))
        .union(shares.select(F.lit("gender share"), F.inline(_options(**_GENDER))))
    )


def stored_hits(found: DataFrame, keyword: str, path: str) -> SortedRows:
    """The hits in their order, written once: every page and breakdown reads them there."""
    return sorted_rows(found, _hit_order(found, keyword), path)


def _stat():
    return F.array(
        F.struct(_options(**_AGE).alias("options"), F.lit(config.AGE_TITLE).alias("title")),
        F.struct(_options(**_GENDER).alias("options"), F.lit(config.GENDER_TITLE).alias("title")),
    )


def report(kept: SortedRows, number: int, size: int) -> DataFrame:
    """The search answer as one JSON text: ``{total, stat, detail}``.

    ``kept`` are the stored hits: the shares come from one pass over them, the documents
    from the ranges that the page lies in. No more than a page is ever gathered.
    """
    documents = F.struct(*SALE_DETAIL.names)
    one_page = kept.page(number, size).agg(F.collect_list(F.struct(F.col(PLACE).alias("p"), documents.alias("doc"))).alias("docs"))
    detail = one_page.select(F.transform(F.array_sort("docs"), lambda d: d["doc"]).alias("detail"))
    counted = _shares(breakdown(kept.rows())).select("total", _stat().alias("stat"))
    merged = counted.unionByName(detail, allowMissingColumns=True).agg(
        F.max("total").alias("total"),
        F.first("stat", ignorenulls=True).alias("stat"),
        F.first("detail", ignorenulls=True).alias("detail"),
    )
    return merged.select(F.to_json(F.struct("total", "stat", "detail")).alias("json"))


def ranked_page(hits_: DataFrame, sales: DataFrame, number: int, size: int, path: str) -> DataFrame:
    """A page of scored hits (``dt, doc_id, score``) with their sales: best first, then by id.

    Only the page's ids are looked up in ``sales``.
    """
    best = sorted_rows(hits_, [F.desc("score"), F.col("doc_id")], path).page(number, size)
    return best.join(sales, ["dt", "doc_id"]).drop(PLACE)
