"""First or latest row per key.

``row_number() = 1`` is planned with a per-task limit in front of the shuffle, so
each task sends at most one row per key: a key that holds a third of the input
does not gather in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per_key(rows: DataFrame, keys: Sequence[str | Column], order: Sequence[Column]) -> DataFrame:
    """The row of each key that comes first in ``order``."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def _all_columns(rows: DataFrame, but: Sequence[str] = ()) -> list[Column]:
    return [F.col(c) for c in rows.columns if c not in but]


def first_launch_of_day(launches: DataFrame) -> DataFrame:
    """Earliest launch per device and event day; ties go to the smallest row."""
    keys = ["mid", "logDate"]
    return first_per_key(launches, keys, [F.col("ts"), *_all_columns(launches, [*keys, "ts"])])


def drop_seen(launches: DataFrame, seen: DataFrame) -> DataFrame:
    """Launches of devices that ``seen`` does not list for the same day.

    ``seen`` grows with the devices, so no broadcast is asked for; the measured
    size decides.
    """
    return launches.join(seen.select("mid", "logDate"), ["mid", "logDate"], "left_anti")


def first_launch_not_seen(launches: DataFrame, seen: DataFrame) -> DataFrame:
    """Daily first launches of devices that are new for the day.

    The reduction to one row per device goes first: it leaves the anti join with
    small, even keys that already lie where the join needs them.
    """
    return drop_seen(first_launch_of_day(launches), seen)


def first_launch_stream(launches: DataFrame, at: str, delay: str = "1 day", salts: int = 8) -> DataFrame:
    """Streaming form: the first arriving launch per device and day.

    With ``salts > 1`` a first pass drops repeats per device, day and salt, so a
    device that floods the stream is worked off by several tasks and the second
    pass sees at most ``salts`` rows of it per day.
    """
    timed = launches.withWatermark(at, delay)
    if salts > 1:
        salt = F.pmod(F.xxhash64("ts", "uid"), F.lit(salts))
        timed = (
            timed.withColumn("_salt", salt)
            .dropDuplicatesWithinWatermark(["mid", "logDate", "_salt"])
            .drop("_salt")
        )
    return timed.dropDuplicatesWithinWatermark(["mid", "logDate"])


def latest_users(users: DataFrame, order: Sequence[str] = ("timestamp", "offset")) -> DataFrame:
    """Latest record per user id by source time and offset."""
    newest = [F.col(c).desc_nulls_last() for c in order]
    ties = [F.col(c).desc_nulls_last() for c in users.columns if c != "id" and c not in order]
    return first_per_key(users, ["id"], [*newest, *ties])


def latest_documents(docs: DataFrame, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """Latest row per document key; rows equal in ``order`` go to the largest row."""
    newest = [F.col(c).desc_nulls_last() for c in order]
    ties = [F.col(c).desc_nulls_last() for c in docs.columns if c not in keys and c not in order]
    return first_per_key(docs, list(keys), [*newest, *ties] or [F.col(keys[0])])
