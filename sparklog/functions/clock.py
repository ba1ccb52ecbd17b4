"""Instants, tolerant event times and time buckets (UTC)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

ISO_INSTANT = r"\A\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{1,9})?(Z|[+-]\d{2}:\d{2})\z"
NUMBER = r"\A-?\d+(\.\d+)?(E[+-]?\d+)?\z"
MINUTE_TEXT = "yyyy-MM-dd'T'HH:mm"
MINUTE_KEY = "yyyyMMddHHmm"
INSTANT_TEXT = "yyyy-MM-dd'T'HH:mm:ss'Z'"

_UNIT_SECONDS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}


def width_seconds(width: str) -> int:
    """Length in seconds of a fixed width such as ``"1 minute"`` or ``"7 days"``."""
    amount, unit = width.split()
    return int(amount) * _UNIT_SECONDS[unit.rstrip("s")]


def instant(value: Column | str | dt.datetime) -> Column:
    """A timestamp column from a column, an ISO text or a datetime (naive values are UTC)."""
    if isinstance(value, Column):
        return value
    if isinstance(value, dt.datetime):
        if value.tzinfo is None:
            value = value.replace(tzinfo=dt.timezone.utc)
        value = value.astimezone(dt.timezone.utc).isoformat()
    elif not value.endswith("Z"):
        value += "Z"
    return F.lit(value).cast("timestamp")


def iso_instant(text: Column) -> Column:
    """ISO instant with a zone, else null. The guard refuses the shorter forms a cast would accept."""
    upper = F.upper(text)
    return F.when(upper.rlike(ISO_INSTANT), upper.try_cast("timestamp"))


def parse_event_time(text: Column, default: Column) -> Column:
    """ISO instant, or epoch seconds with the fraction cut off, or the default."""
    number = F.when(F.upper(text).rlike(NUMBER), text.try_cast("double"))
    epoch = F.when(F.abs(number) < 2.5e11, F.timestamp_seconds(number.try_cast("bigint")))
    return F.coalesce(epoch, iso_instant(text), default)


def bucket_start(ts: Column, width: str) -> Column:
    """Start of the fixed-width bucket, aligned to the epoch."""
    seconds = F.unix_seconds(ts)
    return F.timestamp_seconds(seconds - F.pmod(seconds, F.lit(width_seconds(width))))


def shift(ts: Column, seconds: int | Column) -> Column:
    """The instant moved by whole seconds, microseconds kept."""
    step = F.lit(seconds) if isinstance(seconds, int) else seconds
    return F.timestamp_micros(F.unix_micros(ts) + step.cast("bigint") * 1_000_000)


def bucket_text(ts: Column, pattern: str = MINUTE_TEXT) -> Column:
    return F.date_format(ts, pattern)


def parse_bucket(text: Column, pattern: str = MINUTE_TEXT) -> Column:
    """Back from bucket text; unreadable text gives null."""
    return F.try_to_timestamp(text, F.lit(pattern))


def instant_text(ts: Column) -> Column:
    return F.date_format(ts, INSTANT_TEXT)
