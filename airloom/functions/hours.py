"""Hour arithmetic on UTC timestamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hour_index(t: str | Column) -> Column:
    """Whole hours since the epoch, so that hour frames are plain integer ranges."""
    return F.floor(F.unix_seconds(F.col(t) if isinstance(t, str) else t) / F.lit(3600))


def hour_start(index: str | Column) -> Column:
    """Timestamp of an hour index."""
    return F.timestamp_seconds((F.col(index) if isinstance(index, str) else index) * F.lit(3600))


def plus_hours(t: str | Column, hours: str | int | Column) -> Column:
    """`t` moved by a whole number of hours."""
    t = F.col(t) if isinstance(t, str) else t
    if isinstance(hours, str):
        hours = F.col(hours)
    elif isinstance(hours, int):
        hours = F.lit(hours)
    return F.timestamp_seconds(F.unix_seconds(t) + hours * F.lit(3600))


def hours_between(later: str | Column, earlier: str | Column) -> Column:
    """Fractional hours from `earlier` to `later`."""
    later = F.col(later) if isinstance(later, str) else later
    earlier = F.col(earlier) if isinstance(earlier, str) else earlier
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(3_600_000_000)


def floor_hour(t: str | Column) -> Column:
    """Timestamp floored to the hour."""
    return F.date_trunc("hour", t)


def utc_hour(t: str) -> Column:
    """Parse a string or timestamp as UTC and floor it; bad text becomes null."""
    return F.date_trunc("hour", F.expr(f"try_cast({t} AS timestamp)"))
