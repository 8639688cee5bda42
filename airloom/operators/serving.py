"""Queries and checks over published forecasts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airloom.functions.hours import hour_index
from airloom.functions.numbers import is_finite

MASK_BITS = 62


def query_forecast(
    df: DataFrame,
    min_horizon: int | None = None,
    max_horizon: int | None = None,
    categories: Sequence[str] = (),
    levels: Sequence[str] = (),
    alerts_only: bool = False,
) -> DataFrame:
    """Forecast rows by horizon range, category, alert level and activity; plain filters."""
    if min_horizon is not None:
        df = df.filter(F.col("forecast_horizon_hours") >= min_horizon)
    if max_horizon is not None:
        df = df.filter(F.col("forecast_horizon_hours") <= max_horizon)
    if categories:
        df = df.filter(F.col("alert_trigger_category").isin(list(categories)))
    if levels:
        df = df.filter(F.col("alert_level").isin(list(levels)))
    return df.filter("alert_is_active") if alerts_only else df


def display_time(df: DataFrame, t: str, zone: str, name: str = "display_time") -> DataFrame:
    """Wall-clock copy of a UTC stamp."""
    return df.withColumn(name, F.from_utc_timestamp(t, zone).cast("timestamp_ntz"))


def forecast_checks(df: DataFrame, keys: Sequence[str], horizons: int = 72) -> DataFrame:
    """Contract of each published run as boolean columns.

    Rows are first merged per target hour. Which of the horizons 1..n occurred is
    kept as bit masks, 62 horizons a word, so no distinct set is ever collected.
    """
    words = {f"_m{first}": first for first in range(1, horizons + 1, MASK_BITS)}
    h = F.col("forecast_horizon_hours").cast("int")
    p = F.col("predicted_pm25_ug_m3")

    def mask(first: int) -> Column:
        return F.bit_or(F.when(h.between(first, first + MASK_BITS - 1), F.call_function("shiftleft", F.lit(1).cast("bigint"), h - first)))

    per_target = df.groupBy(*keys, "target_time").agg(
        F.count("*").alias("_n"),
        F.min(h).alias("_h_min"),
        F.max(h).alias("_h_max"),
        *[mask(first).alias(name) for name, first in words.items()],
        F.min("reference_time").alias("_r0"),
        F.max("reference_time").alias("_r1"),
        F.min("pipeline_run_id").alias("_i0"),
        F.max("pipeline_run_id").alias("_i1"),
        F.count_if(~(hour_index("target_time") - hour_index("reference_time")).eqNullSafe(h.cast("bigint"))).alias("_off"),
        F.count_if(~F.coalesce(is_finite(p), F.lit(False))).alias("_bad"),
        F.count_if(p < 0).alias("_negative"),
    )
    facts = per_target.groupBy(*keys).agg(
        F.sum("_n").alias("forecast_rows"),
        F.count("target_time").alias("unique_target_times"),
        F.min("_h_min").alias("_h_min"),
        F.max("_h_max").alias("_h_max"),
        sum((F.coalesce(F.bit_count(F.bit_or(name)), F.lit(0)) for name in words), F.lit(0)).alias("_h"),
        F.coalesce(F.min("_r0") == F.max("_r1"), F.lit(False)).alias("_one_ref"),
        F.coalesce(F.min("_i0") == F.max("_i1"), F.lit(False)).alias("_one_run"),
        F.sum("_off").alias("_off"),
        F.sum("_bad").alias("_bad"),
        F.sum("_negative").alias("_negative"),
    )
    out = facts.select(
        *keys,
        "forecast_rows",
        "unique_target_times",
        (F.col("forecast_rows") == horizons).alias("row_count_ok"),
        ((F.col("_h") == horizons) & (F.col("_h_min") == 1) & (F.col("_h_max") == horizons)).alias("horizons_ok"),
        F.col("_one_ref").alias("single_reference"),
        ((F.col("unique_target_times") == horizons) & (F.col("_off") == 0)).alias("target_timeline_ok"),
        (F.col("_bad") == 0).alias("predictions_finite"),
        (F.col("_negative") == 0).alias("predictions_non_negative"),
        F.col("_one_run").alias("single_run_id"),
    )
    checks = ("row_count_ok", "horizons_ok", "single_reference", "target_timeline_ok", "predictions_finite",
              "predictions_non_negative", "single_run_id")
    approved = F.lit(True)
    for c in checks:
        approved = approved & F.col(c)
    return out.withColumn("approved", approved)


def output_checks(df: DataFrame, keys: Sequence[str], horizons: int = 72) -> DataFrame:
    """Counters over the alerted forecast of each run and the overall approval."""
    complete = F.coalesce("rolling_24h_pm25_is_complete", F.lit(False))
    out = df.groupBy(*keys).agg(
        F.count("*").alias("forecast_rows_actual"),
        F.count_distinct("target_time").alias("unique_target_times"),
        F.count_if(F.col("indicative_hourly_pm25_aqi").isNull()).alias("indicative_aqi_missing_values"),
        F.count_if(F.col("rolling_24h_pm25_aqi").isNull()).alias("rolling_aqi_missing_values"),
        F.count_if(complete).alias("complete_rolling_windows"),
        F.count_if(~complete).alias("incomplete_rolling_windows"),
        F.count_if(F.col("alert_level").isNull()).alias("missing_alert_levels"),
        F.count_if(F.col("health_message").isNull()).alias("missing_health_messages"),
        F.count_if(F.col("recommended_action").isNull()).alias("missing_recommended_actions"),
        F.count_if(F.col("predicted_pm25_ug_m3") < 0).alias("negative_operational_pm25"),
    )
    zero = ("indicative_aqi_missing_values", "rolling_aqi_missing_values", "incomplete_rolling_windows",
            "missing_alert_levels", "missing_health_messages", "missing_recommended_actions", "negative_operational_pm25")
    full = ("forecast_rows_actual", "unique_target_times", "complete_rolling_windows")
    approved = F.lit(True)
    for c in full:
        approved = approved & (F.col(c) == horizons)
    for c in zero:
        approved = approved & (F.col(c) == 0)
    return out.withColumn("forecast_rows_expected", F.lit(horizons)).withColumn("approved", approved)


def forecast_summary(df: DataFrame, episodes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per run: range, peak, worst category, active hours, episodes, flags."""
    h = -hour_index("target_time")
    p = F.col("predicted_pm25_ug_m3")
    facts = df.groupBy(*keys).agg(
        F.min("target_time").alias("forecast_start"),
        F.max("target_time").alias("forecast_end"),
        F.count("*").alias("forecast_rows"),
        F.min(p).alias("minimum_predicted_pm25"),
        F.max(p).alias("maximum_predicted_pm25"),
        F.avg(p).alias("average_predicted_pm25"),
        F.max_by("target_time", F.struct(p, h)).alias("peak_pm25_time"),
        F.min("indicative_hourly_pm25_aqi").alias("minimum_indicative_hourly_aqi"),
        F.max("indicative_hourly_pm25_aqi").alias("maximum_indicative_hourly_aqi"),
        F.max(F.when(F.col("rolling_24h_pm25_is_complete"), F.col("rolling_24h_pm25_aqi"))).alias("maximum_rolling_24h_aqi"),
        F.max_by("alert_trigger_category", F.struct("alert_trigger_aqi", h)).alias("worst_aqi_category"),
        F.max_by("alert_level", F.struct("alert_rank", h)).alias("maximum_alert_level"),
        F.max("alert_rank").alias("maximum_alert_rank"),
        F.count_if("alert_is_active").alias("active_alert_hours"),
        F.bool_or("hazardous_alert").alias("hazardous_condition"),
        F.count_if("alert_used_hourly_fallback").alias("hourly_fallback_rows"),
    )
    counts = episodes.groupBy(*keys).agg(F.count("*").alias("alert_episode_count"))
    return facts.join(counts, list(keys), "left").withColumn(
        "alert_episode_count", F.coalesce("alert_episode_count", F.lit(0))
    )
