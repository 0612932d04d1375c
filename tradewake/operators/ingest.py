"""From topic records to typed rows: decode, stamp, route, and the order columns."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tradewake.functions import times, values
from tradewake.schemas import RAW_LOG

PROBLEM = "problem"
_CORRUPT = "_corrupt_record"


def decode(records: DataFrame, schema: T.StructType, required: Iterable[str] = ()) -> DataFrame:
    """Parse the JSON in ``value`` into the columns of ``schema``.

    Producers are loose about quoting: after-images carry numbers as text, the
    logs carry ids as numbers. So every field is read as text and then cast.
    ``problem`` is null for a good row and otherwise says what is wrong: text that
    is no JSON object, a required field that is absent, or a number that is none.
    The other columns of ``records`` (source time, offset) are kept.
    """
    wire = T.StructType([T.StructField(f.name, T.StringType()) for f in schema])
    parsed = F.from_json("value", wire.add(_CORRUPT, T.StringType()), {"mode": "PERMISSIVE"})
    rows = records.select("*", values.once(parsed).alias("_r"))
    checks = [
        F.when(F.col("value").isNull() | F.col(f"_r.{_CORRUPT}").isNotNull(), F.lit("malformed"))
    ]
    fields = []
    for field in schema:
        text = F.col(f"_r.{field.name}")
        if field.name in required:
            checks.append(F.when(text.isNull(), F.lit(f"missing {field.name}")))
        if isinstance(field.dataType, T.StringType):
            fields.append(text.alias(field.name))
        else:
            typed = text.try_cast(field.dataType.simpleString())
            checks.append(F.when(text.isNotNull() & typed.isNull(), F.lit(f"bad {field.name}")))
            fields.append(typed.alias(field.name))
    kept = [c for c in records.columns if c != "value" and c not in schema.names]
    return rows.select(*fields, *kept, F.coalesce(*checks).alias(PROBLEM), "value")


def accepted(decoded: DataFrame) -> DataFrame:
    """The rows without a problem."""
    return decoded.where(F.col(PROBLEM).isNull()).drop(PROBLEM, "value")


def quarantined(decoded: DataFrame) -> DataFrame:
    """The rows with a problem, with the text they came from."""
    return decoded.where(F.col(PROBLEM).isNotNull()).select(PROBLEM, "value")


def flag(decoded: DataFrame, problem: Column, text: str) -> DataFrame:
    """Mark rows that a later step cannot use, unless they are marked already."""
    found = F.when(problem, F.lit(text))
    if PROBLEM in decoded.columns:
        return decoded.withColumn(PROBLEM, F.coalesce(PROBLEM, found))
    return decoded.withColumn(PROBLEM, found)


def with_log_time(rows: DataFrame) -> DataFrame:
    """Set ``logDate`` and ``logHour`` from ``ts``."""
    return rows.withColumns(
        {
            "logDate": times.day_of_millis(F.col("ts")),
            "logHour": times.hour_of_millis(F.col("ts")),
        }
    )


def decode_logs(records: DataFrame, schema: T.StructType, required: Iterable[str]) -> DataFrame:
    """Decode launch or event lines and derive their day and hour."""
    return with_log_time(decode(records, schema, required))


def stamp(records: DataFrame, at_millis: Column | None = None) -> DataFrame:
    """Raw log lines with the time they were received as their ``ts``.

    ``at_millis`` defaults to the clock of the query. Next to the known fields comes
    ``line``, the whole record as JSON: every field the sender gave, with its type,
    but for ``ts``, which is replaced. Lines that are no JSON objects come out with
    a ``problem``.
    """
    now = (at_millis if at_millis is not None else F.unix_millis(F.current_timestamp())).cast("bigint")
    given = F.map_entries(F.from_json("value", "map<string,variant>"))
    fields = F.map_from_entries(values.last_of_each(F.col("_g"), F.col("_o")))
    rows = records.select("*", values.once(given).alias("_g"))
    rows = rows.select("*", values.once(values.latest_first(F.col("_g"), "key")).alias("_o"))
    rows = rows.select("*", values.once(fields).alias("_f"))
    others = F.map_filter("_f", lambda name, _: name != "ts")
    return rows.select(
        *[
            F.try_variant_get(F.col("_f")[name], "$", "string").alias(name)
            for name in RAW_LOG.names
            if name != "ts"
        ],
        now.alias("ts"),
        F.to_json(F.map_concat(others, F.create_map(F.lit("ts"), now.cast("variant")))).alias("line"),
        F.when(F.col("_f").isNull(), F.lit("malformed")).alias(PROBLEM),
        "value",
    )


def is_launch(kind: Column) -> Column:
    """True for launch lines. Never null: a line without a type is an event."""
    return kind.eqNullSafe(F.lit("startup"))


def route_logs(rows: DataFrame, launch_topic: str, event_topic: str) -> DataFrame:
    """Add the ``topic`` a log row belongs to."""
    return rows.withColumn(
        "topic", F.when(is_launch(F.col("type")), F.lit(launch_topic)).otherwise(F.lit(event_topic))
    )


def with_create_time(orders: DataFrame) -> DataFrame:
    """Set ``create_date`` and ``create_hour`` from the text of ``create_time``."""
    return orders.withColumns(
        {
            "create_date": times.day_of_text(F.col("create_time")),
            "create_hour": times.hour_of_text(F.col("create_time")),
        }
    )


def _prepared(orders: DataFrame, masked: Column) -> DataFrame:
    """A phone that is absent or too short to mask becomes null; the order stays."""
    with_time = flag(
        with_create_time(orders),
        F.col("create_date").isNull() | F.col("create_hour").isNull(),
        "bad create_time",
    )
    return with_time.withColumn("consignee_tel", masked)


def prepare_orders(orders: DataFrame) -> DataFrame:
    """Derived date and hour, and the phone mask of the order table."""
    return _prepared(orders, values.mask_order_phone(F.col("consignee_tel")))


def prepare_sale_orders(orders: DataFrame) -> DataFrame:
    """Derived date and hour, and the phone mask of the sale job."""
    return _prepared(orders, values.mask_sale_phone(F.col("consignee_tel")))


def prepare_lines(lines: DataFrame) -> DataFrame:
    """Set ``sku_price`` from the text of ``order_price``; bad prices are flagged."""
    priced = lines.withColumn("sku_price", values.to_number(F.col("order_price")))
    return flag(priced, F.col("sku_price").isNull(), "bad order_price")
