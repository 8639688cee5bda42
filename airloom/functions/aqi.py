"""Concentration to air-quality-index expressions generated from the breakpoint table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from airloom.functions.numbers import is_infinite

# The public US EPA PM2.5 breakpoint table
# (low, high, index low, index high, category, colour, hex, severity).
BREAKPOINTS = (
    (0.0, 9.0, 0, 50, "Good", "Green", "#00E400", 0),
    (9.1, 35.4, 51, 100, "Moderate", "Yellow", "#FFFF00", 1),
    (35.5, 55.4, 101, 150, "Unhealthy for Sensitive Groups", "Orange", "#FF7E00", 2),
    (55.5, 125.4, 151, 200, "Unhealthy", "Red", "#FF0000", 3),
    (125.5, 225.4, 201, 300, "Very Unhealthy", "Purple", "#8F3F97", 4),
    (225.5, 325.4, 301, 500, "Hazardous", "Maroon", "#7E0023", 5),
)
BEYOND_CATEGORY = "Beyond the AQI"
SCALE_TOP = 500


TENTHS = 3254  # last truncated value of the table, in tenths
BEYOND = len(BREAKPOINTS)  # band code above the table
INVALID = BEYOND + 1  # band code of negative readings; every lookup of it is null


def tenths(v: str | Column) -> Column:
    """Whole tenths of a reading; NaN and infinities have none."""
    v = F.col(v) if isinstance(v, str) else v
    return F.floor(F.when(v < float("inf"), v) * F.lit(10.0))


def truncate_concentration(v: str | Column) -> Column:
    """Cut, not round, to one decimal in binary double arithmetic."""
    v = F.col(v) if isinstance(v, str) else v
    return F.floor(v * F.lit(10.0)) / F.lit(10.0)


def is_invalid(v: str | Column) -> Column:
    """Infinite or negative readings have no index."""
    v = F.col(v) if isinstance(v, str) else v
    return is_infinite(v) | F.coalesce(v < 0, F.lit(False))


def _band_table() -> bytes:
    """One digit per tenth of the scale, preceded by the code of negative readings."""
    codes = [INVALID]
    for code, band in enumerate(BREAKPOINTS):
        codes += [code] * (round(band[1] * 10) + 2 - len(codes))
    return "".join(str(c) for c in [*codes, BEYOND]).encode()


def band_code(k: Column) -> Column:
    """Band of a reading in tenths.

    One access to a constant byte table. A chain of comparisons would repeat its
    input per arm, and filters pushed through several such columns then outgrow
    what the code generator can compile.
    """
    # `least` skips nulls, hence the guard.
    position = F.when(k.isNotNull(), F.greatest(F.least(k, F.lit(TENTHS + 1)), F.lit(-1)) + 2).cast("int")
    digit = F.substring(F.lit(_band_table()), position, F.lit(1)).cast("string")
    return F.ascii(digit) - F.ascii(F.lit("0"))


def _attribute(code: Column, values: Sequence[object]) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), code)


def _column(position: int) -> list:
    """Table column by band; values above the table use the last band."""
    values = [band[position] for band in BREAKPOINTS]
    return [*values, values[-1]]


def index_value(k: Column, code: Column) -> Column:
    """Interpolated index of a reading in tenths, halves rounded up; the last interval extends beyond the table."""
    slopes = [float(b[3] - b[2]) / (b[1] - b[0]) for b in BREAKPOINTS]
    slope = _attribute(code, [*slopes, slopes[-1]])
    low = _attribute(code, _column(0))
    base = _attribute(code, [float(v) for v in _column(2)])
    return F.floor(slope * (k / F.lit(10.0) - low) + base + F.lit(0.5))


def category(code: Column) -> Column:
    return _attribute(code, [*[band[4] for band in BREAKPOINTS], BEYOND_CATEGORY])


def colour_name(code: Column) -> Column:
    return _attribute(code, _column(5))


def colour_hex(code: Column) -> Column:
    return _attribute(code, _column(6))


def severity(code: Column) -> Column:
    return _attribute(code, _column(7))
