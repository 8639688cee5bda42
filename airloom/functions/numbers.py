"""Numeric helpers with results that do not depend on row order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RAW_SCALE = 10_000  # raw readings carry at most four decimals
MEAN_SCALE = 1_000_000  # means over bounded windows


def reading(v: str | Column) -> Column:
    """The value, null where it is NaN or infinite: what cannot be measured is missing."""
    v = F.col(v) if isinstance(v, str) else v
    return F.when(is_finite(v), v)


def fixed_point(v: str | Column, scale: int = MEAN_SCALE) -> Column:
    """Scaled integer of `v`; null for NaN and infinities.

    Sums of these are exact in any order, so a retried task or a different
    partitioning can never flip a truncated concentration.
    """
    return F.floor(reading(v) * F.lit(float(scale)) + F.lit(0.5))


def exact_mean(v: str | Column, scale: int = RAW_SCALE) -> Column:
    """Order-independent mean of the finite values as an aggregate."""
    return F.sum(fixed_point(v, scale)).cast("double") / F.lit(float(scale)) / F.count(reading(v))


def is_finite(v: str | Column) -> Column:
    """Not null, not NaN, not infinite."""
    v = F.col(v) if isinstance(v, str) else v
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf")))


def is_infinite(v: str | Column) -> Column:
    v = F.col(v) if isinstance(v, str) else v
    return F.coalesce(F.abs(v) == F.lit(float("inf")), F.lit(False))


def round_half_up(v: str | Column, digits: int) -> Column:
    """floor(v * 10^d + 0.5) / 10^d in double arithmetic."""
    v = F.col(v) if isinstance(v, str) else v
    scale = float(10**digits)
    return F.floor(v * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def percent_change(candidate: Column, base: Column) -> Column:
    """Percent change from a base; a zero base gives 0 when equal, else infinity."""
    return (
        F.when(base != 0, (candidate - base) / F.abs(base) * F.lit(100.0))
        .when(candidate == 0, F.lit(0.0))
        .when(candidate.isNotNull(), F.lit(float("inf")))
    )
