"""Scalar expressions: masking, numbers, age, shares, ids and search tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NOT_A_WORD = r"[^\p{L}\p{N}]+"


def mask_phone(tel: Column, tail_from: int) -> Column:
    """First four characters, four stars, then everything from ``tail_from`` on.

    The order table keeps the tail from position 7, the sale job from 8. A number
    shorter than that has no tail to keep and gives null rather than leaking.
    """
    masked = F.concat(F.substring(tel, 1, 4), F.lit("****"), F.substr(tel, F.lit(tail_from + 1)))
    return F.when(F.length(tel) >= tail_from, masked)


def mask_order_phone(tel: Column) -> Column:
    return mask_phone(tel, 7)


def mask_sale_phone(tel: Column) -> Column:
    return mask_phone(tel, 8)


def to_number(text: Column) -> Column:
    """Text to double; null when it is not a number."""
    return text.try_cast("double")


def age_in_years(birthday: Column, as_of: Column) -> Column:
    """Whole years of 365 days between the two dates, truncated toward zero."""
    days = F.datediff(as_of.cast("date"), birthday.try_cast("date"))
    return (days / F.lit(365)).cast("int")


def share_of(part: Column, total: Column) -> Column:
    """Percentage with one decimal, halves up; 0 when the total is 0."""
    per_mille = F.floor(part * F.lit(1000.0) / F.nullif(total, F.lit(0)) + F.lit(0.5))
    return F.coalesce(per_mille / F.lit(10.0), F.lit(0.0))


def rest_of_hundred(*shares: Column) -> Column:
    """100 minus shares that are already rounded, kept at one decimal."""
    rest = F.lit(100.0)
    for share in shares:
        rest = rest - share
    return F.floor(rest * F.lit(10.0) + F.lit(0.5)) / F.lit(10.0)


def sale_document_id(order_id: Column, order_detail_id: Column) -> Column:
    return F.concat_ws(":", order_id, order_detail_id)


def alert_document_id(mid: Column, at: Column) -> Column:
    return F.concat_ws("-", mid, F.date_format(at, "HH:mm"))


def dated_name(prefix: str, day: Column) -> Column:
    """Name of the daily index a document belongs to: ``<prefix>-yyyy-MM-dd``."""
    return F.concat_ws("-", F.lit(prefix), F.date_format(day, "yyyy-MM-dd"))


def tokens(text: Column) -> Column:
    """Lower-case words of a text. Letters of any script count, so CJK text survives.

    No text has no words.
    """
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), NOT_A_WORD), "")


def latest_first(entries: Column, name: str) -> Column:
    """Name and place of every entry of an array of structs: by name, later places first."""
    return F.array_sort(F.transform(entries, lambda e, i: F.struct(e[name].alias("name"), (-i).alias("back"))))


def last_of_each(entries: Column, ordered: Column) -> Column:
    """The entries without those whose name is null or comes again later, in order.

    ``ordered`` is the :func:`latest_first` of ``entries``. Both have to be plain columns,
    as they are looked up by place: one sort and one pass, however often names repeat.
    """
    first = F.filter(
        ordered,
        lambda x, k: x["name"].isNotNull() & ~F.coalesce(F.get(ordered, k - 1)["name"] == x["name"], F.lit(False)),
    )
    places = F.array_sort(F.transform(first, lambda x: -x["back"]))
    return F.transform(places, lambda i: F.get(entries, i))


def once(value: Column) -> Column:
    """A value as the output of a generator, for use in ``select``.

    It is computed once per row. A plain column would be computed again for every
    mention in a later filter, because the optimizer moves filters below it.
    """
    return F.explode(F.array(value))
