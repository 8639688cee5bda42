"""Which reference hour can safely be forecast, and the input contracts behind it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airloom.functions.hours import hours_between, plus_hours
from airloom.functions.numbers import is_finite
from airloom.operators.series import halo, hour_window, own_rows

# Readiness states.
READY = "READY"
STALE = "STALE_PM25_DATA"
NO_HISTORY = "NOT_READY_INSUFFICIENT_PM25_HISTORY"
NO_WEATHER = "WEATHER_FORECAST_INCOMPLETE"


def readiness_candidates(
    pollution: DataFrame,
    weather: DataFrame,
    keys: Sequence[str],
    as_of: str,
    t: str = "datetime_utc",
    v: str = "pm25_ug_m3",
    freshness: int = 6,
    history: int = 24,
    horizons: int = 72,
) -> DataFrame:
    """Check table of every fresh candidate hour.

    `as_of` is a literal, so both scans are cut to the few hours that matter
    (pushed filters and partition pruning) before any window runs.
    """
    now = F.lit(as_of).cast("timestamp")
    from_hour = plus_hours(now, -(freshness + history))
    fresh = plus_hours(now, -freshness)
    recent = pollution.filter(F.col(t) >= from_hour)
    checked = own_rows(
        halo(recent, keys, t, back=history).withColumn(
            "_present", F.count(v).over(hour_window(keys).rangeBetween(-history, 0))
        )
    ).filter((F.col(v) > 0) & (F.col(t) >= fresh))
    candidates = checked.select(*keys, F.col(t).alias("candidate_reference_time"), "_present")
    # A key has at most `freshness` + 1 candidates, each naming its own weather
    # hours: an equi-join on (key, hour) with a fixed number of rows per key.
    hours = weather.filter(F.col(t) >= fresh).select(*keys, F.col(t).alias("_w")).distinct().withColumn("_hit", F.lit(True))
    rows = (
        candidates.withColumn("_offset", F.explode(F.sequence(F.lit(0), F.lit(horizons))))
        .withColumn("_w", plus_hours("candidate_reference_time", F.col("_offset").cast("bigint")))
        .join(hours, [*keys, "_w"], "left")
        .groupBy(*keys, "candidate_reference_time", "_present")
        .agg(
            F.count_if(F.col("_hit") & (F.col("_offset") > 0)).alias("_ahead"),
            (F.count_if(F.col("_hit") & (F.col("_offset") == 0)) > 0).alias("_at"),
        )
    )
    return rows.select(
        *keys,
        "candidate_reference_time",
        hours_between(now, "candidate_reference_time").alias("candidate_age_hours"),
        F.lit(history + 1).alias("required_pm25_history_rows"),
        (F.lit(history + 1) - F.col("_present")).alias("missing_pm25_history_hours"),
        (F.col("_present") == history + 1).alias("pm25_history_complete"),
        F.col("_at").alias("reference_weather_available"),
        F.lit(horizons).alias("required_target_weather_hours"),
        (F.lit(horizons) - F.col("_ahead")).alias("missing_target_weather_hours"),
        (F.col("_ahead") == horizons).alias("target_weather_complete"),
    )


def reference_readiness(
    pollution: DataFrame,
    weather: DataFrame,
    keys: Sequence[str],
    as_of: str,
    t: str = "datetime_utc",
    v: str = "pm25_ug_m3",
    freshness: int = 6,
    history: int = 24,
    horizons: int = 72,
) -> DataFrame:
    """Newest ready reference hour and state per key; a key that is not ready is a row, not an error."""
    now = F.lit(as_of).cast("timestamp")
    candidates = readiness_candidates(pollution, weather, keys, as_of, t, v, freshness, history, horizons)
    ready = F.col("pm25_history_complete") & F.col("reference_weather_available") & F.col("target_weather_complete")
    summary = candidates.groupBy(*keys).agg(
        F.max(F.when(ready, F.col("candidate_reference_time"))).alias("selected_reference_time"),
        F.bool_or("pm25_history_complete").alias("_history"),
        F.max(F.when(ready, F.col("candidate_reference_time"))).alias("_sel"),
        F.collect_list("candidate_reference_time").alias("_seen"),
    )
    latest = pollution.groupBy(*keys).agg(F.max(F.when(F.col(v) > 0, F.col(t))).alias("latest_valid_pm25_time"))
    age = hours_between(now, "latest_valid_pm25_time")
    stale = age > freshness
    status = (
        F.when(F.col("latest_valid_pm25_time").isNull(), F.lit(NO_HISTORY))
        .when(stale, F.lit(STALE))
        .when(F.col("selected_reference_time").isNotNull(), F.lit(READY))
        .when(F.coalesce("_history", F.lit(False)), F.lit(NO_WEATHER))
        .otherwise(F.lit(NO_HISTORY))
    )
    # At most `freshness` + 1 candidates exist, so `_seen` is a short list.
    inspected = F.when(F.col("_sel").isNotNull(), F.size(F.filter("_seen", lambda c: c >= F.col("_sel")))).otherwise(
        F.coalesce(F.size("_seen"), F.lit(0))
    )
    return latest.join(summary, list(keys), "left").select(
        *keys,
        status.alias("readiness_status"),
        "selected_reference_time",
        "latest_valid_pm25_time",
        age.alias("latest_pm25_age_hours"),
        F.when(F.col("_seen").isNull() | stale, F.lit(0)).otherwise(inspected).alias("inspected_candidates"),
    )


def history_checks(
    pollution: DataFrame,
    weather: DataFrame,
    references: DataFrame,
    keys: Sequence[str],
    weather_columns: Sequence[str],
    t: str = "datetime_utc",
    v: str = "pm25_ug_m3",
    history: int = 24,
    horizons: int = 72,
) -> DataFrame:
    """Input contract of each reference: exact positive history, weather at and after it.

    Each reference names its own hours, so the range join becomes an equi-join
    on (key, hour) with at most 97 hours per reference.
    """
    on = [*keys, "reference_time"]
    wanted = references.select(*on).distinct().withColumn(
        "_offset", F.explode(F.sequence(F.lit(-history), F.lit(horizons)))
    ).withColumn(t, plus_hours("reference_time", F.col("_offset").cast("bigint")))
    complete = F.lit(True)
    for c in weather_columns:
        complete = complete & F.col(c).isNotNull()
    per_pm = pollution.groupBy(*keys, t).agg(
        F.count("*").alias("_p_rows"),
        F.count(v).alias("_p_values"),
        F.bool_and(F.coalesce(is_finite(v), F.lit(False))).alias("_p_finite"),
        F.bool_and(F.coalesce(F.col(v) > 0, F.lit(False))).alias("_p_positive"),
    )
    per_w = weather.groupBy(*keys, t).agg(F.count("*").alias("_w_rows"), F.bool_and(complete).alias("_w_complete"))
    joined = wanted.join(per_pm, [*keys, t], "left").join(per_w, [*keys, t], "left")
    past, ahead = F.col("_offset") <= 0, F.col("_offset") > 0
    out = joined.groupBy(*on).agg(
        F.coalesce(F.sum(F.when(past, F.col("_p_rows"))), F.lit(0)).alias("history_rows"),
        F.count_if(past & F.col("_p_rows").isNotNull()).alias("history_hours"),
        F.count_if(past & (F.col("_p_rows") > F.col("_p_values"))).alias("history_null_hours"),
        F.count_if(past & (F.col("_p_values") > 0) & ~F.col("_p_finite")).alias("history_infinite_hours"),
        F.count_if(past & (F.col("_p_values") > 0) & ~F.col("_p_positive")).alias("history_non_positive_hours"),
        F.count_if((F.col("_offset") == 0) & (F.col("_w_rows") == 1) & F.col("_w_complete")).alias("reference_weather_rows"),
        F.count_if(ahead & (F.col("_w_rows") == 1) & F.col("_w_complete")).alias("target_weather_hours"),
    )
    return out.withColumn(
        "is_valid",
        (F.col("history_rows") == history + 1)
        & (F.col("history_hours") == history + 1)
        & (F.col("history_null_hours") == 0)
        & (F.col("history_infinite_hours") == 0)
        & (F.col("history_non_positive_hours") == 0)
        & (F.col("reference_weather_rows") == 1)
        & (F.col("target_weather_hours") == horizons),
    )
