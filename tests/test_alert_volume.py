"""Alerts: what is shuffled for them, and that results stay whole."""

import random
from collections import defaultdict

from pyspark.sql import functions as F

from tests.test_scale import big_data
from tradewake.operators import alerts


def shuffled_rows(frame):
    """Rows that the shuffles of a run of ``frame`` wrote."""

    def walk(node):
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            return walk(node.executedPlan())
        if name.endswith("QueryStage"):
            return walk(node.plan())
        own = node.metrics().apply("shuffleRecordsWritten").value() if name == "Exchange" else 0
        children = node.children()
        return own + sum(walk(children.apply(i)) for i in range(children.size()))

    frame.collect()
    return walk(frame._jdf.queryExecution().executedPlan())


def brute_alerts(events, window, slide, threshold):
    last = {}
    for mid in {e[0] for e in events}:
        own = [e for e in events if e[0] == mid]
        ends = {(e[4] // slide + 1 + k) * slide for e in own for k in range(window // slide)}
        for end in ends:
            inside = [e for e in own if end - window <= e[4] < end]
            coupons = [e for e in inside if e[3] == "coupon"]
            accounts = {e[1] for e in coupons}
            if len(accounts) < threshold or any(e[3] == "clickItem" for e in inside):
                continue
            counts = defaultdict(int)
            for e in inside:
                counts[e[3]] += 1
            found = (end, sorted(map(str, accounts)), sorted({str(e[2]) for e in coupons}), sorted((str(k), n) for k, n in counts.items()))
            key = (mid, end // 60)
            last[key] = max(last.get(key, found), found)
    return sorted((str(mid), *found) for (mid, _), found in last.items())


def test_alerts_are_those_of_every_window(spark):
    draw = random.Random(5)
    kinds = ["coupon"] * 6 + ["addCart", None] + ["clickItem"]
    for window, slide, threshold in ((300, 5, 1), (300, 5, 3), (280, 7, 2), (90, 45, 2), (7200, 3600, 3), (10, 5, 1)):
        span = 4 * window
        events = [
            (draw.choice(["a", "b", "c", None]), draw.choice(["1", "2", "3", None]), draw.choice(["x", "y", None]), draw.choice(kinds), draw.randrange(-span, span))
            for _ in range(60)
        ]
        rows = spark.createDataFrame(events, "mid string, uid string, itemid string, evid string, s long")
        found = alerts.coupon_alerts(rows.withColumn("at", F.timestamp_seconds("s")), window, slide, threshold)
        got = sorted(
            (str(r.mid), r.ts // 1000, sorted(map(str, r.uids)), sorted(map(str, r.itemIds)), sorted((str(e.evid), e.n) for e in r.events))
            for r in found.where("mid is not null").collect()
        )
        assert got == [w for w in brute_alerts(events, window, slide, threshold) if w[0] != "None"] and got


def test_alert_windows_are_not_shuffled(spark):
    events = spark.range(5_000).select(
        F.col("id").cast("string").alias("mid"), F.lit("u").alias("uid"), F.lit("i").alias("itemid"),
        F.lit("coupon").alias("evid"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") % 3_600).alias("at"),
    )
    with big_data(spark):
        found = alerts.coupon_alerts(events, 300, 5, 1)
        # Each event is in 60 windows of 5 or 6 minutes.
        assert 5_000 < shuffled_rows(found) < 20 * 5_000
        assert found.count() >= 5 * 5_000
