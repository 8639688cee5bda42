"""Readers for nested measurement and parallel-array weather payloads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airloom.contracts import WEATHER

# Numbers are read as text first, so that a malformed one is a null and not a lost record.
MEASUREMENT = (
    "value string, summary struct<avg: string>, "
    "period struct<datetimeFrom: struct<utc: string>, datetimeTo: struct<utc: string>>, "
    "datetimeFrom struct<utc: string>, datetimeTo struct<utc: string>, "
    "parameter struct<name: string, units: string>, flagInfo struct<hasFlags: boolean>"
)


def _number(c: Column) -> Column:
    return c.try_cast("double")


def normalize_measurements(df: DataFrame, json_column: str, keep: Sequence[str] = ()) -> DataFrame:
    """Flatten one measurement record per row, with the documented fallbacks."""
    m = F.from_json(json_column, MEASUREMENT)
    return df.withColumn("_m", m).select(
        *keep,
        F.coalesce("_m.period.datetimeFrom.utc", "_m.datetimeFrom.utc").try_cast("timestamp").alias("datetime_utc"),
        F.coalesce("_m.period.datetimeTo.utc", "_m.datetimeTo.utc").try_cast("timestamp").alias("datetime_to_utc"),
        _number(F.coalesce("_m.value", "_m.summary.avg")).alias("pm25_ug_m3_raw"),
        F.col("_m.parameter.name").alias("parameter"),
        F.col("_m.parameter.units").alias("units"),
        F.coalesce("_m.flagInfo.hasFlags", F.lit(False)).alias("has_flags"),
    )


def _hourly_schema(variables: Sequence[str]) -> str:
    fields = ", ".join(["time: array<string>", *[f"{v}: array<string>" for v in variables]])
    return f"hourly struct<{fields}>"


def explode_hourly_arrays(
    df: DataFrame, json_column: str, variables: Sequence[str] = WEATHER, keep: Sequence[str] = ()
) -> DataFrame:
    """Parallel arrays to one row per hour; payloads with unequal or missing arrays or a bad time stamp give no rows.

    A value that is no number becomes null.
    """
    parsed = df.withColumn("_h", F.from_json(json_column, _hourly_schema(variables))["hourly"])
    rows = parsed.filter(arrays_aligned("_h", variables)).select(
        *keep, F.inline(F.arrays_zip(F.col("_h.time").alias("time"), *[F.transform(f"_h.{v}", _number).alias(v) for v in variables]))
    )
    return rows.withColumn("datetime_utc", F.col("time").try_cast("timestamp")).select(*keep, "datetime_utc", *variables)


def arrays_aligned(parsed: str, variables: Sequence[str]) -> Column:
    """Every time stamp is one, and every variable has exactly one value for it."""
    length = F.size(F.col(f"{parsed}.time"))
    test = F.col(f"{parsed}.time").isNotNull() & (length > 0)
    test = test & F.coalesce(F.forall(F.col(f"{parsed}.time"), lambda x: x.try_cast("timestamp").isNotNull()), F.lit(False))
    for v in variables:
        test = test & F.coalesce(F.size(F.col(f"{parsed}.{v}")) == length, F.lit(False))
    return test


def rejected_payloads(df: DataFrame, json_column: str, variables: Sequence[str] = WEATHER, keep: Sequence[str] = ()) -> DataFrame:
    """Payloads refused by `explode_hourly_arrays`."""
    parsed = df.withColumn("_h", F.from_json(json_column, _hourly_schema(variables))["hourly"])
    return parsed.filter(~F.coalesce(arrays_aligned("_h", variables), F.lit(False))).select(*keep)
