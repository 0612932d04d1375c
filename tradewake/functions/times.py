"""Day and hour columns."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def day_of_millis(ms: Column) -> Column:
    """``yyyy-MM-dd`` of an epoch-millisecond column, in the session zone."""
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd")


def hour_of_millis(ms: Column) -> Column:
    """``HH`` of an epoch-millisecond column, in the session zone."""
    return F.date_format(F.timestamp_millis(ms), "HH")


def day_of_text(create_time: Column) -> Column:
    """Date part of ``yyyy-MM-dd HH:mm:ss``; null when there is no time part."""
    return F.when(F.instr(create_time, " ") > 0, F.substring_index(create_time, " ", 1))


def hour_of_text(create_time: Column) -> Column:
    """Hour part of ``yyyy-MM-dd HH:mm:ss``; null when there is no time part."""
    time = F.split_part(create_time, F.lit(" "), F.lit(2))
    return F.nullif(F.substring_index(time, ":", 1), F.lit(""))


def previous_day(day: str) -> str:
    """The calendar day before ``yyyy-MM-dd``."""
    return (dt.date.fromisoformat(day) - dt.timedelta(days=1)).isoformat()


def hours_of_day() -> list[str]:
    """``00`` to ``23``."""
    return [f"{hour:02d}" for hour in range(24)]


def bucket_start(micros: Column, width: int) -> Column:
    """Start of the bucket of ``width`` microseconds that a time lies in."""
    return micros - F.pmod(micros, F.lit(width))
