"""Timestamps: parsing, ages and display."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, functions as F

_EPOCH_LIMIT = 250_000_000_000.0  # about the year 9892
_MICROS_PER_DAY = 86_400_000_000


def as_time(value: Column | str | dt.datetime) -> Column:
    """A timestamp column from a column, an ISO string or a datetime (naive means UTC)."""
    if isinstance(value, Column):
        return value.cast("timestamp")
    if isinstance(value, dt.datetime):
        value = value.isoformat()
    return F.lit(value).cast("timestamp")


def parse_time(text: Column) -> Column:
    """ISO text to timestamp; junk and empty text become NULL."""
    return F.try_to_timestamp(text)


def parse_epoch(text: Column) -> Column:
    """Epoch seconds (number or text, with fractions) to timestamp; junk, and what no timestamp can hold, becomes NULL."""
    seconds = text.try_cast("double")
    inside = F.abs(seconds) < _EPOCH_LIMIT  # NaN is larger than every number
    return F.timestamp_micros(F.when(inside, F.round(seconds * 1_000_000)).try_cast("long"))


def age_days(ts: Column, as_of: Column) -> Column:
    """Days from ``ts`` to ``as_of``; negative for times ahead of it."""
    return (F.unix_micros(as_time(as_of)) - F.unix_micros(as_time(ts))) / F.lit(_MICROS_PER_DAY)


def display_minute(ts: Column, raw: Column | None = None) -> Column:
    """``yyyy-MM-dd HH:mm``; falls back to the start of the raw text, then to ``unknown``."""
    fallback = F.lit(None).cast("string") if raw is None else F.nullif(F.substring(raw, 1, 16), F.lit(""))
    return F.coalesce(F.date_format(ts, "yyyy-MM-dd HH:mm"), fallback, F.lit("unknown"))
