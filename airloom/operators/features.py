"""Lag, rolling, change, direction and calendar features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from airloom.contracts import CHANGES, LAGS, MAX_HORIZON, MEANS, MODEL_FEATURES, REFERENCE_FEATURES, TARGET_FEATURES, WEATHER
from airloom.functions.calendar import calendar_columns, direction
from airloom.functions.numbers import MEAN_SCALE, fixed_point, reading
from airloom.operators.clean import dedupe
from airloom.operators.joins import expand_horizons
from airloom.operators.series import attach_per_key, halo, hour_window, own_rows


def _at(w: WindowSpec, v: str, hours: int) -> Column:
    """The reading exactly `hours` before, whatever rows lie between."""
    return F.max(v).over(w.rangeBetween(-hours, -hours))


def _lags(w: WindowSpec, v: str, hours: Sequence[int]) -> dict[str, Column]:
    return {f"pm25_lag_{h}h": _at(w, v, h) for h in hours}


def _means(w: WindowSpec, v: str, windows: Sequence[int]) -> dict[str, Column]:
    out = {}
    for n in windows:
        frame = w.rangeBetween(-(n - 1), 0)
        total = F.sum(fixed_point(v)).over(frame).cast("double") / F.lit(float(MEAN_SCALE))
        out[f"pm25_mean_{n}h"] = F.when(F.count(reading(v)).over(frame) == n, total / F.lit(float(n)))
    return out


def _changes(w: WindowSpec, v: str, hours: Sequence[int]) -> dict[str, Column]:
    return {f"pm25_change_{h}h": F.col(v) - _at(w, v, h) for h in hours}


def lag_features(df: DataFrame, keys: Sequence[str], t: str, v: str, hours: Sequence[int] = LAGS) -> DataFrame:
    """Readings exactly n hours earlier; null when that hour is missing."""
    return own_rows(halo(df, keys, t, back=max(hours)).withColumns(_lags(hour_window(keys), v, hours)))


def rolling_means(df: DataFrame, keys: Sequence[str], t: str, v: str, windows: Sequence[int] = MEANS) -> DataFrame:
    """Trailing means including the current hour; null unless every hour is present."""
    return own_rows(halo(df, keys, t, back=max(windows) - 1).withColumns(_means(hour_window(keys), v, windows)))


def change_features(df: DataFrame, keys: Sequence[str], t: str, v: str, hours: Sequence[int] = CHANGES) -> DataFrame:
    """Difference to the reading n hours earlier."""
    return own_rows(halo(df, keys, t, back=max(hours)).withColumns(_changes(hour_window(keys), v, hours)))


def circular_encode(df: DataFrame, column: str, prefix: str) -> DataFrame:
    """Degrees to sine and cosine."""
    sin, cos = direction(column)
    return df.withColumns({f"{prefix}_sin": sin, f"{prefix}_cos": cos})


def calendar_features(df: DataFrame, t: str, prefix: str) -> DataFrame:
    """Hour, weekday and month with their cycles."""
    return df.withColumns(calendar_columns(t, prefix))


def history_columns(w: WindowSpec, v: str) -> dict[str, Column]:
    """All lag, mean and change features over one window spec."""
    return {**_lags(w, v, LAGS), **_means(w, v, MEANS), **_changes(w, v, CHANGES)}


def reference_features(df: DataFrame, keys: Sequence[str], t: str = "datetime_utc", v: str = "pm25_ug_m3") -> DataFrame:
    """Every reference-hour feature of a canonical table: one exchange, one sort."""
    out = halo(df, keys, t, back=max(LAGS)).withColumns(history_columns(hour_window(keys), v))
    out = own_rows(out).withColumn("pm25_current", F.col(v)).withColumn("reference_time", F.col(t))
    out = circular_encode(out, "wind_direction_10m", "wind_direction_10m")
    out = calendar_features(out, "reference_time", "reference_")
    return out.select(*keys, "reference_time", *REFERENCE_FEATURES)


def target_weather_features(df: DataFrame, keys: Sequence[str], t: str = "datetime_utc") -> DataFrame:
    """Weather at a target hour with its encodings, `target_` prefixed; a projection."""
    out = df.select(*keys, F.col(t).alias("target_time"), *[F.col(c).cast("double").alias(f"target_{c}") for c in WEATHER])
    out = circular_encode(out, "target_wind_direction_10m", "target_wind_direction_10m")
    out = calendar_features(out, "target_time", "target_")
    return out.select(*keys, "target_time", *TARGET_FEATURES)


def feature_rows(
    reference: DataFrame,
    target: DataFrame,
    references: DataFrame,
    keys: Sequence[str],
    horizons: int = MAX_HORIZON,
    columns: Sequence[str] = MODEL_FEATURES,
) -> DataFrame:
    """Reference x horizon matrix of the chosen references in exact model column order."""
    chosen = reference.join(references.select(*keys, "reference_time"), [*keys, "reference_time"], "left_semi")
    matrix = expand_horizons(chosen, horizons).join(target, [*keys, "target_time"], "left")
    return matrix.select(*keys, "reference_time", "target_time", *columns)


def complete_feature_rows(
    df: DataFrame, keys: Sequence[str], columns: Sequence[str], order_by: Sequence[str], references: DataFrame | None = None
) -> DataFrame:
    """Rows without a missing feature, up to each key's reference hour, the last one per hour by `order_by`."""
    if not order_by:
        raise ValueError("order_by must name the order of arrival")
    full = df.dropna(subset=list(columns))
    if references is not None:
        limit = references.select(*keys, F.col("reference_time").alias("_limit"))
        full = attach_per_key(full, limit, keys, "reference_time").filter("reference_time <= _limit").drop("_limit")
    return dedupe(full, [*keys, "reference_time"], list(order_by)).drop(*order_by)
