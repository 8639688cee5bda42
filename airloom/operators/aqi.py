"""Air-quality index columns, trailing 24-hour means and forecast enrichment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airloom.functions import aqi
from airloom.functions.hours import plus_hours
from airloom.functions.numbers import MEAN_SCALE, fixed_point, reading
from airloom.operators.series import halo, hour_window, own_rows


def pm25_to_aqi(df: DataFrame, v: str, names: dict[str, str] | None = None) -> DataFrame:
    """Add truncated value, index, category, colours, severity and beyond flag.

    Missing stays missing. Infinite or negative readings give null here and are
    listed by `invalid_concentrations`. `names` renames the added columns.
    """
    staged = df.withColumn("_k", aqi.tenths(v))
    staged = staged.withColumn("_code", aqi.band_code(F.col("_k")))
    staged = staged.withColumn("_aqi", aqi.index_value(F.col("_k"), F.col("_code")))
    code = F.col("_code")
    columns = {
        "pm25_ug_m3_truncated": F.when(F.col("_k") >= 0, F.col("_k") / F.lit(10.0)),
        "aqi": F.col("_aqi"),
        "aqi_category": aqi.category(code),
        "aqi_color_name": aqi.colour_name(code),
        "aqi_color_hex": aqi.colour_hex(code),
        "aqi_severity_rank": aqi.severity(code),
        "is_beyond_aqi": F.col("_aqi") > aqi.SCALE_TOP,
    }
    names = names or {}
    return staged.withColumns({names.get(k, k): col for k, col in columns.items()}).drop("_k", "_code", "_aqi")


def invalid_concentrations(df: DataFrame, v: str) -> DataFrame:
    """Rows whose reading is infinite or negative."""
    return df.filter(aqi.is_invalid(v))


HOURLY_NAMES = {
    "pm25_ug_m3_truncated": "predicted_pm25_ug_m3_truncated",
    "aqi": "indicative_hourly_pm25_aqi",
    "aqi_category": "indicative_hourly_aqi_category",
    "aqi_color_name": "indicative_hourly_aqi_color_name",
    "aqi_color_hex": "indicative_hourly_aqi_color_hex",
    "aqi_severity_rank": "indicative_hourly_aqi_severity_rank",
    "is_beyond_aqi": "indicative_hourly_is_beyond_aqi",
}
ROLLING_NAMES = {
    "pm25_ug_m3_truncated": "rolling_24h_pm25_ug_m3_truncated",
    "aqi": "rolling_24h_pm25_aqi",
    "aqi_category": "rolling_24h_aqi_category",
    "aqi_color_name": "rolling_24h_aqi_color_name",
    "aqi_color_hex": "rolling_24h_aqi_color_hex",
    "aqi_severity_rank": "rolling_24h_aqi_severity_rank",
    "is_beyond_aqi": "rolling_24h_is_beyond_aqi",
}


def rolling_24h(
    df: DataFrame, keys: Sequence[str], t: str, v: str = "pm25_ug_m3", source: str = "pm25_source", hours: int = 24
) -> DataFrame:
    """Trailing mean over `hours`, null unless every hour is present, with its provenance counts (an hour without a value counts as missing)."""
    frame = hour_window(keys).rangeBetween(-(hours - 1), 0)
    out = halo(df, keys, t, back=hours - 1).withColumns(
        {
            "_present": F.count(reading(v)).over(frame),
            "_sum": F.sum(fixed_point(v)).over(frame),
            "rolling_observed_hour_count": F.count(F.when((F.col(source) == "observed") & reading(v).isNotNull(), 1)).over(frame),
            "rolling_predicted_hour_count": F.count(F.when((F.col(source) == "predicted") & reading(v).isNotNull(), 1)).over(frame),
        }
    )
    out = (
        own_rows(out)
        .withColumn("rolling_24h_pm25_is_complete", F.col("_present") == hours)
        .withColumn(
            "rolling_24h_pm25_ug_m3",
            F.when(F.col("_present") == hours, F.col("_sum").cast("double") / float(MEAN_SCALE) / float(hours)),
        )
        .withColumn("rolling_24h_required_hours", F.lit(hours))
        .withColumn("rolling_24h_missing_hours", F.lit(hours) - F.col("_present"))
    )
    return out.drop("_present", "_sum")


def run_history(
    forecast: DataFrame, observed: DataFrame, keys: Sequence[str], run: Sequence[str], t: str, v: str, hours: int
) -> DataFrame:
    """The observed hours each run's windows can reach: an equi-join on (location, hour)."""
    lags = F.sequence(F.lit(0), F.lit(hours - 2))
    needed = (
        forecast.select(*keys, *run).distinct()
        .withColumn("_lag", F.explode(lags))
        .withColumn("target_time", plus_hours("reference_time", -F.col("_lag").cast("bigint")))
        .drop("_lag")
    )
    values = observed.select(*keys, F.col(t).alias("target_time"), F.col(v).alias("_v"))
    return needed.join(values, [*keys, "target_time"]).withColumn("_source", F.lit("observed"))


def enrich_forecast(
    forecast: DataFrame,
    observed: DataFrame,
    keys: Sequence[str],
    run: Sequence[str] = ("pipeline_run_id", "reference_time"),
    t: str = "datetime_utc",
    v: str = "pm25_ug_m3",
    hours: int = 24,
) -> DataFrame:
    """Hourly and rolling index for every row of every forecast run.

    A run is a group of at most 23 observed and 72 predicted hours, whatever its location.
    """
    names = forecast.columns
    timeline = run_history(forecast, observed, keys, run, t, v, hours).unionByName(
        forecast.withColumn("_v", F.col("predicted_pm25_ug_m3")).withColumn("_source", F.lit("predicted")),
        allowMissingColumns=True,
    )
    rolled = rolling_24h(timeline, [*keys, *run], "target_time", "_v", "_source", hours).filter("_source = 'predicted'")
    hourly = pm25_to_aqi(rolled.drop("_v", "_source"), "predicted_pm25_ug_m3", HOURLY_NAMES)
    out = pm25_to_aqi(hourly, "rolling_24h_pm25_ug_m3", ROLLING_NAMES)
    return out.select(*names, *[c for c in out.columns if c not in names])


def union_last_wins(observed: DataFrame, predicted: DataFrame, keys: Sequence[str], t: str, v: str) -> DataFrame:
    """One timeline of observed and predicted hours; a predicted hour replaces an observed one."""
    on = [*keys, t]
    first = observed.select(*on, v).withColumn("pm25_source", F.lit("observed")).withColumn("_rank", F.lit(1))
    second = predicted.select(*on, v).withColumn("pm25_source", F.lit("predicted")).withColumn("_rank", F.lit(2))
    return (
        first.unionByName(second)
        .groupBy(*on)
        .agg(F.max_by(F.struct(v, "pm25_source"), "_rank").alias("_w"))
        .select(*on, f"_w.{v}", "_w.pm25_source")
    )
