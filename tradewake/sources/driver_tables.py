"""The benchmark tables seen as launches, events, orders, lines, users and changes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tradewake.operators.ingest import prepare_lines, with_create_time, with_log_time
from tradewake.schemas import ORDER

# Which event of the tables stands for which event of the logs.
EVENT_IDS = {
    "purchase": "coupon",
    "click": "clickItem",
    "view": "addCart",
    "error": "addComment",
    "signup": "addFavor",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stream_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The same table as a stream of its files, be it one file or a folder of files."""
    path = f"{folder}/{name}.parquet"
    reader = spark.readStream.schema(table(spark, folder, name).schema)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if files.getFileStatus(at).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder)


Reader = Callable[[SparkSession, str, str], DataFrame]

# First and last day wanted. The bound is set on the stored time, so it reaches the scan.
Days = tuple[str, str]


def _within(rows: DataFrame, time: str, days: Days | None) -> DataFrame:
    if days is None:
        return rows
    first, last = (F.lit(f"{d} 00:00:00").cast("timestamp_ntz") for d in days)
    return rows.where((F.col(time) >= first) & (F.col(time) < last + F.expr("interval 1 day")))


def _millis(at: Column) -> Column:
    # The files hold zone-less times; count from a zone-less epoch.
    return F.timestamp_diff("MILLISECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), at)


def _text(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd HH:mm:ss")


def _keyed_events(
    spark: SparkSession, folder: str, read: Reader = table, days: Days | None = None
) -> DataFrame:
    return _within(read(spark, folder, "events"), "ts", days).select(
        "event_id",
        "event_type",
        "value",
        F.col("user_id").cast("string").alias("mid"),
        F.get_json_object("props", "$.k").alias("uid"),
        _millis(F.col("ts")).alias("ts"),
    )


def launches(spark: SparkSession, folder: str, days: Days | None = None) -> DataFrame:
    """Every event as a launch: ``event_id, mid, uid, ts, logDate, logHour``."""
    return with_log_time(_keyed_events(spark, folder, days=days).select("event_id", "mid", "uid", "ts"))


def logs(spark: SparkSession, folder: str, read: Reader = table) -> DataFrame:
    """Every event as a raw log row; sign-ups are launches."""
    kind = F.when(F.col("event_type") == "signup", "startup").otherwise("event")
    return _keyed_events(spark, folder, read).select(
        "event_id", kind.alias("type"), "mid", "uid", "ts"
    )


def _records(value: Column, timestamp: Column, offset: Column | None = None) -> list[Column]:
    """The columns of topic records."""
    last = offset if offset is not None else F.lit(0).cast("bigint")
    return [value.alias("value"), timestamp.alias("timestamp"), last.alias("offset")]


def log_records(spark: SparkSession, folder: str, read: Reader = table) -> DataFrame:
    """The same rows as topic records with the JSON text of each line."""
    line = F.to_json(F.struct("type", "mid", "uid", "ts"))
    return logs(spark, folder, read).select(*_records(line, F.timestamp_millis("ts"), F.col("event_id")))


def event_records(spark: SparkSession, folder: str, read: Reader = table) -> DataFrame:
    """Every event line as a topic record."""
    line = F.to_json(F.struct("mid", "uid", "evid", "itemid", "ts"))
    return events(spark, folder, read).select(*_records(line, F.col("at"), F.col("event_id")))


def events(spark: SparkSession, folder: str, read: Reader = table) -> DataFrame:
    """Every event as an event line, with its time ``at``."""
    evid = F.coalesce(*[F.when(F.col("event_type") == k, F.lit(v)) for k, v in EVENT_IDS.items()])
    return _keyed_events(spark, folder, read).select(
        "event_id",
        "mid",
        "uid",
        evid.alias("evid"),
        (F.col("event_id") % 50).cast("string").alias("itemid"),
        "ts",
        F.timestamp_millis("ts").alias("at"),
    )


def purchases(spark: SparkSession, folder: str, days: Days | None = None) -> DataFrame:
    """Purchases as orders with a time of day."""
    bought = _keyed_events(spark, folder, days=days).where(F.col("event_type") == "purchase")
    return with_log_time(bought).select(
        F.col("value").alias("total_amount"),
        F.col("logDate").alias("create_date"),
        F.col("logHour").alias("create_hour"),
    )


def raw_orders(
    spark: SparkSession, folder: str, read: Reader = table, days: Days | None = None
) -> DataFrame:
    """Orders as received: all 18 fields, those without a source null, and ``order_at``.

    An order whose customer is unknown stays, without what only the customer tells.
    """
    o = _within(read(spark, folder, "orders"), "o_orderdate", days).join(
        table(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left"
    )
    known = {
        "id": F.col("o_orderkey").cast("string"),
        "province_id": F.col("c_nationkey").cast("string"),
        "consignee": F.col("c_name"),
        "consignee_tel": F.concat(F.lit("138"), F.lpad(F.col("c_custkey").cast("string"), 8, "0")),
        "order_status": F.col("o_orderstatus"),
        "user_id": F.col("o_custkey").cast("string"),
        "total_amount": F.col("o_totalprice"),
        "create_time": _text(F.col("o_orderdate")),
    }
    fields = [
        known.get(f.name, F.lit(None).cast(f.dataType)).alias(f.name)
        for f in ORDER
        if f.name not in ("create_date", "create_hour")
    ]
    at = F.timestamp_millis(_millis(F.col("o_orderdate")))
    return o.select(*fields, at.alias("order_at"))


def order_records(spark: SparkSession, folder: str, read: Reader = table) -> DataFrame:
    """Orders as topic records."""
    rows = raw_orders(spark, folder, read)
    fields = [c for c in rows.columns if c != "order_at"]
    return rows.select(*_records(F.to_json(F.struct(*fields)), F.col("order_at")))


def orders(spark: SparkSession, folder: str, days: Days | None = None) -> DataFrame:
    """Orders with their derived day and hour."""
    return with_create_time(raw_orders(spark, folder, days=days))


def order_heads(spark: SparkSession, folder: str, days: Days | None = None) -> DataFrame:
    """What a sale takes from its order, from the order table alone."""
    o = _within(table(spark, folder, "orders"), "o_orderdate", days)
    made = o.select(
        F.col("o_orderkey").alias("_key"),
        F.col("o_orderstatus").alias("order_status"),
        F.col("o_custkey").cast("string").alias("user_id"),
        _text(F.col("o_orderdate")).alias("create_time"),
    )
    return with_create_time(made).select("_key", "order_status", "create_time", "user_id", "create_date")


def lines_of(spark: SparkSession, folder: str, orders: DataFrame) -> DataFrame:
    """The lines of given orders (their number as ``_key``), with what :func:`lines` gives.

    The lines meet their orders first, where they lie if the orders are few, and only
    what is left is named.
    """
    met = table(spark, folder, "lineitem").join(orders, F.col("l_orderkey") == F.col("_key"))
    named = met.join(table(spark, folder, "part"), F.col("l_partkey") == F.col("p_partkey"), "left")
    key = [F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]
    return named.select(
        F.concat_ws("-", *key).alias("order_detail_id"),
        F.col("l_orderkey").cast("string").alias("order_id"),
        *[c for c in orders.columns if c != "_key"],
        F.col("l_partkey").cast("string").alias("sku_id"),
        F.col("p_name").alias("sku_name"),
        F.col("l_extendedprice").cast("double").alias("sku_price"),
    )


def order_amounts(spark: SparkSession, folder: str, days: Days | None = None) -> DataFrame:
    """The amount and the day and hour of every order, from the order table alone."""
    o = _within(table(spark, folder, "orders"), "o_orderdate", days)
    return with_create_time(
        o.select(F.col("o_totalprice").alias("total_amount"), _text(F.col("o_orderdate")).alias("create_time"))
    )


def raw_lines(spark: SparkSession, folder: str, read: Reader = table) -> DataFrame:
    """Order lines as received, with the part name and the time ``line_at``.

    Order and line number repeat in these tables; with part and supplier they do not. A
    line whose part is unknown stays, without a name.
    """
    l = read(spark, folder, "lineitem").join(
        table(spark, folder, "part"), F.col("l_partkey") == F.col("p_partkey"), "left"
    )
    key = [F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]
    return l.select(
        F.concat_ws("-", *key).alias("id"),
        F.col("l_orderkey").cast("string").alias("order_id"),
        F.col("p_name").alias("sku_name"),
        F.col("l_partkey").cast("string").alias("sku_id"),
        F.col("l_extendedprice").cast("string").alias("order_price"),
        F.col("l_quantity").cast("string").alias("sku_num"),
        F.timestamp_millis(_millis(F.col("l_shipdate"))).alias("line_at"),
    )


def line_records(spark: SparkSession, folder: str, read: Reader = table) -> DataFrame:
    """Order lines as topic records."""
    rows = raw_lines(spark, folder, read)
    fields = [c for c in rows.columns if c != "line_at"]
    return rows.select(*_records(F.to_json(F.struct(*fields)), F.col("line_at")))


def lines(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines with their parsed price."""
    return prepare_lines(raw_lines(spark, folder)).drop("problem")


def users(spark: SparkSession, folder: str, read: Reader = table) -> DataFrame:
    """Customers as users; one in ten has no known gender."""
    key = F.col("c_custkey")
    born = F.date_add(F.lit("1960-01-01").cast("date"), ((key * 37) % 15000).cast("int"))
    return read(spark, folder, "customer").select(
        key.cast("string").alias("id"),
        F.col("c_name").alias("login_name"),
        F.col("c_mktsegment").alias("user_level"),
        F.date_format(born, "yyyy-MM-dd").alias("birthday"),
        F.when(key % 10 == 0, F.lit(None)).when(key % 2 == 0, "M").otherwise("F").alias("gender"),
    )


def user_records(spark: SparkSession, folder: str, read: Reader = table) -> DataFrame:
    """Users as topic records."""
    rows = users(spark, folder, read)
    return rows.select(*_records(F.to_json(F.struct(*rows.columns)), F.timestamp_seconds(F.lit(0))))


def change_records(spark: SparkSession, folder: str, read: Reader = table) -> DataFrame:
    """Changes as topic records."""
    line = F.to_json(F.struct("entry_type", "table", "op", "rows"))
    at = F.timestamp_seconds(F.lit(0))
    return changes(spark, folder, read).select(*_records(line, at))


def changes(spark: SparkSession, folder: str, read: Reader = table) -> DataFrame:
    """Orders, customers and lines as change records of one row each.

    The operation follows the key; one key in eleven is no row data.
    """

    def records(name: str, rows: DataFrame, key: str, **columns: Column) -> DataFrame:
        after = F.array(
            *[F.struct(F.lit(n).alias("name"), c.cast("string").alias("value")) for n, c in columns.items()]
        )
        op = F.element_at(
            F.array(F.lit("INSERT"), F.lit("UPDATE"), F.lit("DELETE")), (F.col(key) % 3 + 1).cast("int")
        )
        return rows.select(
            F.when(F.col(key) % 11 == 0, "TRANSACTIONEND").otherwise("ROWDATA").alias("entry_type"),
            F.lit(name).alias("table"),
            op.alias("op"),
            F.array(after).alias("rows"),
        )

    o, c, l = (read(spark, folder, n) for n in ("orders", "customer", "lineitem"))
    return (
        records("order_info", o, "o_orderkey", id=F.col("o_orderkey"), user_id=F.col("o_custkey"),
                order_status=F.col("o_orderstatus"))
        .unionByName(records("user_info", c, "c_custkey", id=F.col("c_custkey"), login_name=F.col("c_name"),
                             user_level=F.col("c_mktsegment")))
        .unionByName(records("order_detail", l, "l_orderkey", order_id=F.col("l_orderkey"),
                             line=F.col("l_linenumber"), sku_id=F.col("l_partkey")))
    )
