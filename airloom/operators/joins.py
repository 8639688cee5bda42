"""Canonical joins, horizon expansion and join guards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airloom.contracts import MAX_HORIZON, TARGET, WEATHER
from airloom.functions.hours import plus_hours
from airloom.operators.clean import dedupe


def canonical(
    pollution: DataFrame, weather: DataFrame, keys: Sequence[str], t: str = "datetime_utc", how: str = "left", order_by: Sequence[str] = ()
) -> DataFrame:
    """Pollution and weather on (key, hour): 'left', 'full' or 'inner'.

    The full join keeps one row an hour, the last by `order_by`: columns of either side that tell the order of
    arrival. They are needed for it and do not appear in its result.
    """
    joined = pollution.join(weather, [*keys, t], how)
    if how != "full":
        return joined
    if not order_by:
        raise ValueError("order_by must name the order of arrival")
    return dedupe(joined, [*keys, t], list(order_by)).drop(*order_by)


def expand_horizons(df: DataFrame, horizons: int = MAX_HORIZON, reference: str = "reference_time") -> DataFrame:
    """One row per horizon 1..n with its target hour; a narrow explode without a shuffle."""
    return df.withColumn("forecast_horizon_hours", F.explode(F.sequence(F.lit(1), F.lit(horizons)))).withColumn(
        "target_time", plus_hours(reference, F.col("forecast_horizon_hours").cast("bigint"))
    )


def attach_targets(
    df: DataFrame, labels: DataFrame, weather: DataFrame, keys: Sequence[str], t: str = "datetime_utc", v: str = "pm25_ug_m3"
) -> DataFrame:
    """Label and target weather by (key, target hour).

    Both sides are first combined per hour, so the expanded rows shuffle once.
    """
    on = [*keys, t]
    per_hour = labels.select(*on, F.col(v).alias(TARGET)).join(
        weather.select(*on, *[F.col(c).alias(f"target_{c}") for c in WEATHER]), on, "full"
    )
    return df.join(per_hour.withColumnRenamed(t, "target_time"), [*keys, "target_time"], "left")


def cardinality_report(right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Keys that break the 'one' side of a join."""
    return right.groupBy(*on).agg(F.count("*").alias("key_rows")).filter("key_rows > 1")


def join_validated(left: DataFrame, right: DataFrame, on: Sequence[str], how: str, validate: str) -> DataFrame:
    """Join that fails at run time when the declared cardinality does not hold.

    The guard rides on the one side's own aggregation by the join key.
    """

    def guard(side: DataFrame, label: str) -> DataFrame:
        rest = [c for c in side.columns if c not in on]
        packed = side.groupBy(*on).agg(F.count("*").alias("_n"), F.first(F.struct(*rest)).alias("_row"))
        checked = packed.withColumn(
            "_row",
            F.when(F.col("_n") == 1, F.col("_row")).otherwise(
                F.raise_error(F.lit(f"duplicate join keys on the {label} side")).cast(packed.schema["_row"].dataType)
            ),
        )
        return checked.select(*on, *[F.col("_row")[c].alias(c) for c in rest])

    if validate not in ("many_to_one", "one_to_one"):
        raise ValueError(f"unknown validation {validate}")
    right = guard(right, "right")
    if validate == "one_to_one":
        left = guard(left, "left")
    return left.join(right, list(on), how)


def replace_features(df: DataFrame, features: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Drop local feature columns and take them from the feature table by reference hour (inner)."""
    order = df.columns
    on = [*keys, "reference_time"]
    kept = df.drop(*columns)
    return kept.join(features.select(*on, *columns), on).select(*order)


def refs_in(df: DataFrame, references: DataFrame, on: Sequence[str]) -> DataFrame:
    return df.join(references.select(*on).distinct(), list(on), "left_semi")


def refs_not_in(df: DataFrame, references: DataFrame, on: Sequence[str]) -> DataFrame:
    return df.join(references.select(*on).distinct(), list(on), "left_anti")


def hours_except(a: DataFrame, b: DataFrame, on: Sequence[str]) -> DataFrame:
    """Hours in `a` but not in `b` (set semantics)."""
    return a.select(*on).subtract(b.select(*on))


def hours_intersect(a: DataFrame, b: DataFrame, on: Sequence[str]) -> DataFrame:
    return a.select(*on).intersect(b.select(*on))
