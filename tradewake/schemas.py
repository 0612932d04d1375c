"""Record shapes. Ids are strings at every boundary; ``ts`` is epoch milliseconds."""

from __future__ import annotations

from pyspark.sql import types as T


def _record(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields.items()])


def _strings(*names: str) -> dict[str, T.DataType]:
    return {name: T.StringType() for name in names}


LAUNCH = _record(
    **_strings("mid", "uid", "appid", "area", "os", "ch", "type", "vs", "logDate", "logHour"),
    ts=T.LongType(),
)

EVENT = _record(
    **_strings(
        "mid", "uid", "appid", "area", "os", "type", "evid", "pgid", "npgid", "itemid",
        "logDate", "logHour",
    ),
    ts=T.LongType(),
)

# Every field a launch or an event line can carry when it reaches the collector.
RAW_LOG = _record(
    **_strings(
        "type", "mid", "uid", "appid", "area", "os", "ch", "vs", "evid", "pgid", "npgid", "itemid",
    ),
    ts=T.LongType(),
)

ORDER = _record(
    **_strings(
        "id", "province_id", "consignee", "order_comment", "consignee_tel", "order_status",
        "payment_way", "user_id", "img_url",
    ),
    total_amount=T.DoubleType(),
    **_strings(
        "expire_time", "delivery_address", "create_time", "operate_time", "tracking_no",
        "parent_order_id", "out_trade_no", "trade_body", "create_date", "create_hour",
    ),
)

ORDER_LINE = _record(
    **_strings("id", "order_id", "sku_name", "sku_id", "order_price", "img_url", "sku_num")
)

USER = _record(**_strings("id", "login_name", "user_level", "birthday", "gender"))

SALE_DETAIL = _record(
    **_strings(
        "order_detail_id", "order_id", "order_status", "create_time", "user_id", "sku_id",
        "user_gender",
    ),
    user_age=T.IntegerType(),
    user_level=T.StringType(),
    sku_price=T.DoubleType(),
    **_strings("sku_name", "dt"),
)

COUPON_ALERT = _record(
    mid=T.StringType(),
    uids=T.ArrayType(T.StringType()),
    itemIds=T.ArrayType(T.StringType()),
    # Each event with how often it happened.
    events=T.ArrayType(_record(evid=T.StringType(), n=T.LongType())),
    ts=T.LongType(),
)

CHANGE = T.StructType(
    [
        T.StructField("entry_type", T.StringType()),
        T.StructField("table", T.StringType()),
        T.StructField("op", T.StringType()),
        T.StructField(
            "rows",
            T.ArrayType(T.ArrayType(_record(name=T.StringType(), value=T.StringType()))),
        ),
    ]
)
