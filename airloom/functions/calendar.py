"""Calendar and direction encodings."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def cycle(v: Column, period: int) -> tuple[Column, Column]:
    """(sin, cos) of a value on a cycle."""
    angle = v * F.lit(2.0 * math.pi) / F.lit(float(period))
    return F.sin(angle), F.cos(angle)


def direction(degrees: str) -> tuple[Column, Column]:
    """(sin, cos) of a compass direction."""
    angle = F.radians(F.col(degrees))
    return F.sin(angle), F.cos(angle)


def calendar_columns(t: str, prefix: str) -> dict[str, Column]:
    """Hour, weekday (Monday 0) and month of a UTC stamp with their cycles."""
    hour = F.hour(t).cast("double")
    weekday = F.weekday(t).cast("double")
    month = F.month(t).cast("double")
    columns = {f"{prefix}hour": hour, f"{prefix}day_of_week": weekday, f"{prefix}month": month}
    for name, value, period in (
        ("hour", hour, 24),
        ("day_of_week", weekday, 7),
        ("month", month - F.lit(1.0), 12),
    ):
        columns[f"{prefix}{name}_sin"], columns[f"{prefix}{name}_cos"] = cycle(value, period)
    return columns
