"""Coupon-abuse alerts: many accounts claim coupons on one device, nothing is viewed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradewake.functions import times, values
from tradewake.operators.dedup import first_per_key

COUPON = "coupon"
VIEW = "clickItem"


def _check(window_seconds: int, slide_seconds: int) -> None:
    if slide_seconds <= 0 or window_seconds <= 0 or window_seconds % slide_seconds:
        raise ValueError("the window has to be a whole multiple of the slide")


def pane_counts(events: DataFrame, slide_seconds: int, at: str = "at") -> DataFrame:
    """Equal events of a device within one slide, as one row with their number ``n``.

    Account and item matter for coupons only. A device that floods the input is
    combined here before the shuffle, and before the windows multiply its rows.
    """
    coupon = F.col("evid") == COUPON
    return events.groupBy(
        "mid",
        F.window(at, f"{slide_seconds} seconds").alias("pane"),
        "evid",
        F.when(coupon, F.col("uid")).alias("uid"),
        F.when(coupon, F.col("itemid")).alias("itemid"),
    ).agg(F.count(F.lit(1)).alias("n"))


def window_state(
    events: DataFrame, window_seconds: int, slide_seconds: int, at: str = "at"
) -> DataFrame:
    """Per device and sliding window: coupon accounts and items, all events, views.

    ``accounts`` and ``items`` are sets of one-field structs, so that a null
    account counts as a member; ``event_counts`` says how often each event occurs.
    """
    _check(window_seconds, slide_seconds)
    coupon = F.col("evid") == COUPON
    panes = pane_counts(events, slide_seconds, at)
    span = F.window(F.window_time("pane"), f"{window_seconds} seconds", f"{slide_seconds} seconds")
    return panes.groupBy("mid", span.alias("window")).agg(
        F.collect_set(F.when(coupon, F.struct("uid"))).alias("accounts"),
        F.collect_set(F.when(coupon, F.struct("itemid"))).alias("items"),
        F.collect_list(F.struct("evid", "n")).alias("event_counts"),
        F.coalesce(F.max((F.col("evid") == VIEW).cast("int")), F.lit(0)).alias("views"),
    )


def alerting(state: DataFrame, threshold: int) -> DataFrame:
    """Windows with at least ``threshold`` coupon accounts and no view, as alerts.

    ``events`` says of every event of the window how often it happened; a device that
    floods the input has no longer list than others.
    """
    kinds = F.array_sort(F.array_distinct(F.transform("event_counts", lambda e: e["evid"])))
    events = F.transform(
        kinds,
        lambda kind: F.struct(
            kind.alias("evid"),
            F.aggregate(
                F.filter("event_counts", lambda e: e["evid"].eqNullSafe(kind)),
                F.lit(0).cast("bigint"),
                lambda total, e: total + e["n"],
            ).alias("n"),
        ),
    )
    return state.where((F.size("accounts") >= threshold) & (F.col("views") == 0)).select(
        "mid",
        F.array_sort(F.transform("accounts", lambda a: a["uid"])).alias("uids"),
        F.array_sort(F.transform("items", lambda i: i["itemid"])).alias("itemIds"),
        events.alias("events"),
        F.unix_millis(F.col("window.end")).alias("ts"),
    )


def suspect_buckets(
    events: DataFrame, window_seconds: int, threshold: int, at: str = "at"
) -> DataFrame:
    """Devices and buckets of time, ``(_mid, _bucket)``, that can lie in an alerting window.

    Every window lies within two neighbouring tumbling buckets of its length. Where
    such a pair has fewer coupon accounts than the threshold, no window in it can
    alert. Both buckets of every other pair are returned, some of them twice.
    """
    width = window_seconds * 1_000_000
    bucket = times.bucket_start(F.unix_micros(F.col(at)), width)
    pairs = (
        events.where(F.col("evid") == COUPON)
        .select("mid", "uid", F.explode(F.array(bucket - width, bucket)).alias("_pair"))
        .distinct()
        .groupBy("mid", "_pair")
        .agg(F.count(F.lit(1)).alias("_accounts"))
        .where(F.col("_accounts") >= threshold)
    )
    both = F.explode(F.array("_pair", F.col("_pair") + width))
    return pairs.select(F.col("mid").alias("_mid"), both.alias("_bucket"))


def suspects(events: DataFrame, buckets: DataFrame, window_seconds: int, at: str = "at") -> DataFrame:
    """The events that lie in the given buckets: complete for every window that can alert."""
    bucket = times.bucket_start(F.unix_micros(F.col(at)), window_seconds * 1_000_000)
    same = F.col("mid").eqNullSafe(F.col("_mid")) & (bucket == F.col("_bucket"))
    return events.join(buckets, same, "left_semi")


def panes_nearby(panes: DataFrame, window_seconds: int) -> DataFrame:
    """``mid, start, panes``: what a device did in the windows that end in one bucket of time.

    Buckets are as long as the window, so a pane counts in windows that end in its own
    bucket or in the next one, and is sent to these two, not to every window. ``panes``
    lists their end in microseconds, event, account, item and number.
    """
    width = window_seconds * 1_000_000
    end = F.unix_micros("pane.end")
    own = times.bucket_start(end, width)
    dealt = panes.select(
        "mid",
        F.explode(F.array(own, own + width)).alias("start"),
        F.struct(end.alias("end"), "evid", "uid", "itemid", "n").alias("pane"),
    )
    return dealt.groupBy("mid", "start").agg(F.collect_list("pane").alias("panes"))


def last_windows(nearby: DataFrame, window_seconds: int, slide_seconds: int, threshold: int) -> DataFrame:
    """The last alerting window of each minute, as ``mid``, its ``end`` and the panes nearby.

    ``nearby`` comes from :func:`panes_nearby`. Windows are looked at inside its rows, so
    none becomes a row unless it alerts: of up to 12 windows a minute 11 are dropped again.
    """
    width, slide, minute = window_seconds * 1_000_000, slide_seconds * 1_000_000, 60_000_000
    parts = nearby.select(
        "*",
        values.once(F.filter("panes", lambda p: p["evid"] == COUPON)).alias("coupons"),
        values.once(F.filter("panes", lambda p: p["evid"] == VIEW)).alias("seen"),
    ).where(F.size("coupons") >= threshold)

    def alerts(end: Column) -> Column:
        inside = _inside(end, width)
        accounts = F.array_distinct(F.transform(F.filter("coupons", inside), lambda p: p["uid"]))
        return ~F.exists("seen", inside) & (F.size(accounts) >= threshold)

    def last_of(begin: Column) -> Column:
        """The last alerting end from ``begin`` to the end of its minute or of the bucket."""
        until = F.least(begin - F.pmod(begin, F.lit(minute)) + minute, F.col("start") + width) - 1
        return F.array_max(F.filter(F.sequence(begin, until, F.lit(slide)), alerts))

    ends = F.sequence(F.col("start"), F.col("start") + width - slide, F.lit(slide))
    begins = F.filter(ends, lambda e: (e == F.col("start")) | (F.pmod(e, F.lit(minute)) < slide))
    found = F.filter(F.transform(begins, last_of), lambda e: e.isNotNull())
    return parts.select("mid", "panes", F.explode(found).alias("end"))


def _inside(end: Column, width: int) -> Callable[[Column], Column]:
    """Whether a pane lies in the window that ends at ``end``."""
    return lambda pane: (pane["end"] > end - width) & (pane["end"] <= end)


def state_of(windows: DataFrame, window_seconds: int) -> DataFrame:
    """The state (see :func:`window_state`) of windows without views, from the panes nearby."""
    inside = _inside(F.col("end"), window_seconds * 1_000_000)
    whole = windows.select("mid", "end", values.once(F.filter("panes", inside)).alias("panes"))
    coupons = F.filter("panes", lambda p: p["evid"] == COUPON)

    def members(name: str) -> Column:
        each = F.array_distinct(F.transform(coupons, lambda p: p[name]))
        return F.transform(each, lambda x: F.struct(x.alias(name)))

    return whole.select(
        "mid",
        F.struct(F.timestamp_micros("end").alias("end")).alias("window"),
        members("uid").alias("accounts"),
        members("itemid").alias("items"),
        F.transform("panes", lambda p: F.struct(p["evid"].alias("evid"), p["n"].alias("n"))).alias("event_counts"),
        F.lit(0).alias("views"),
    )


def coupon_alerts(
    events: DataFrame,
    window_seconds: int,
    slide_seconds: int,
    threshold: int,
    at: str = "at",
    scratch: str | None = None,
) -> DataFrame:
    """Batch form: all alerts, one per device and minute.

    Only suspect events are counted, the counts of a device are sent to two buckets of
    time, where all sliding windows are looked at, and what happened is listed for the
    last alerting window of each minute only. With ``scratch``, a
    folder all executors share, the list of suspects is written there first. Its
    size is then known when the events are filtered, and as long as it is below
    Spark's broadcast limit the events are filtered where they are read instead of
    being shuffled.
    """
    _check(window_seconds, slide_seconds)
    needed = events.select("mid", "uid", "itemid", "evid", at)
    buckets = suspect_buckets(needed, window_seconds, threshold, at)
    if scratch is not None:
        buckets.write.mode("overwrite").parquet(scratch)
        buckets = events.sparkSession.read.schema(buckets.schema).parquet(scratch)
    panes = pane_counts(suspects(needed, buckets, window_seconds, at), slide_seconds, at)
    last = last_windows(panes_nearby(panes, window_seconds), window_seconds, slide_seconds, threshold)
    return alert_per_minute(alerting(state_of(last, window_seconds), threshold))


def alert_per_minute(alerts: DataFrame) -> DataFrame:
    """Name each alert by device and minute and keep the last evaluation of a minute."""
    at = F.timestamp_millis(F.col("ts"))
    named = alerts.withColumns(
        {
            "doc_id": values.alert_document_id(F.col("mid"), at),
            "day": F.date_format(at, "yyyy-MM-dd"),
        }
    )
    return first_per_key(named, ["day", "doc_id"], [F.col("ts").desc()])
