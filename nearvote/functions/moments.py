"""Points in time: ISO-8601 in UTC, hours and days, minutes between."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import f32

ISO = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}Z"


def parse_iso(s: Column) -> Column:
    """A timestamp without zone, null where the first twenty characters aren't an existing UTC second."""
    text = F.replace(F.substring(s, 1, 19), F.lit("T"), F.lit(" "))
    return F.when(s.rlike(ISO), text.try_cast("timestamp_ntz"))


def format_iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def epoch_seconds(ts: Column) -> Column:
    return F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.date_trunc("second", ts).cast("timestamp_ntz"))


def minutes_between(now: Column, then: Column) -> Column:
    seconds = epoch_seconds(now) - epoch_seconds(then)
    return (seconds.cast("float") / f32(60.0)).cast("float")
