"""Index, alert and serving queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from airloom.functions import aqi as fx
from airloom.functions.hours import hour_index, plus_hours
from airloom.operators import alerts as al
from airloom.operators import aqi as ops
from airloom.operators import serving as sv
from airloom.plans.inputs import (
    EPOCH_HOUR,
    HOURLY_AQI,
    KEY,
    ROLLING_AQI,
    RUN,
    cte,
    events,
    forecast,
    hourly,
    imputed,
    published,
    r,
    sql_aqi_columns,
    sql_alerts,
    sql_episodes,
    sql_rolling,
    sql_truncated,
    with_ctes,
)
from airloom.plans.registry import query

_SEVEN = ("pm25_ug_m3_truncated", "aqi", "aqi_category", "aqi_color_name", "aqi_color_hex", "aqi_severity_rank", "is_beyond_aqi")

# Raw readings with some signs flipped and some infinities, to exercise rejection.
_SIGNED = "CASE WHEN event_type = 'error' AND user_id % 2 = 0 THEN -value WHEN event_type = 'error' AND value > 100 THEN CAST('Infinity' AS DOUBLE) ELSE value END"


def _signed(spark, folder):
    e = events(spark, folder)
    bad = F.col("event_type") == "error"
    return e.withColumn(
        "reading",
        F.when(bad & (F.col("user_id") % 2 == 0), -F.col("value"))
        .when(bad & (F.col("value") > 100), F.lit(float("inf")))
        .otherwise(F.col("value")),
    )


@query("truncate_concentration", f"SELECT event_id, value, {sql_truncated('value')} AS truncated FROM events")
def truncate_concentration(spark, folder):
    return events(spark, folder).select("event_id", "value", fx.truncate_concentration("value").alias("truncated"))


@query(
    "pm25_to_aqi",
    f"""SELECT event_id, reading_text, {sql_aqi_columns('c', _SEVEN)} FROM (
  SELECT event_id, CAST(v < 0 OR isinf(v) AS VARCHAR) AS reading_text, CASE WHEN v < 0 OR isinf(v) THEN NULL ELSE {sql_truncated('v')} END AS c
  FROM (SELECT event_id, {_SIGNED} AS v FROM events))""",
)
def pm25_to_aqi(spark, folder):
    rows = _signed(spark, folder).select("event_id", "reading", fx.is_invalid("reading").cast("string").alias("reading_text"))
    return ops.pm25_to_aqi(rows, "reading").drop("reading")


@query(
    "beyond_scale",
    f"""SELECT event_id, value, {sql_aqi_columns('c', _SEVEN)} FROM (
  SELECT event_id, value, {sql_truncated('value')} AS c FROM events) WHERE c > 325.4""",
)
def beyond_scale(spark, folder):
    rows = ops.pm25_to_aqi(events(spark, folder).select("event_id", "value"), "value")
    return rows.filter(F.col("aqi_category") == fx.BEYOND_CATEGORY)


@query(
    "invalid_concentrations",
    f"SELECT event_id, location_key, CASE WHEN isinf(v) THEN 'infinite' ELSE 'negative' END AS reason FROM (SELECT event_id, event_type AS location_key, {_SIGNED} AS v FROM events) WHERE v < 0 OR isinf(v)",
)
def invalid_concentrations(spark, folder):
    bad = ops.invalid_concentrations(_signed(spark, folder), "reading")
    return bad.select(
        "event_id", F.col("event_type").alias("location_key"),
        F.when(F.abs("reading") == float("inf"), F.lit("infinite")).otherwise(F.lit("negative")).alias("reason"),
    )


cte("observed_series", "SELECT location_key, datetime_utc AS target_time, pm25_ug_m3 AS v, 'observed' AS src FROM imputed_user", "imputed_user")


@query(
    "rolling_24h_provenance",
    with_ctes(
        f"""SELECT location_key, target_time, {r('v')} AS pm25_ug_m3, src AS pm25_source, rolling_24h_pm25_is_complete, {r('rolling_24h_pm25_ug_m3')} AS rolling_24h_pm25_ug_m3,
  rolling_24h_required_hours, rolling_24h_missing_hours, rolling_observed_hour_count, rolling_predicted_hour_count
FROM ({sql_rolling('location_key', 'target_time', 'observed_series')})""",
        "observed_series",
    ),
)
def rolling_24h_provenance(spark, folder):
    series = imputed(spark, folder, "user_id").select(
        *KEY, F.col("datetime_utc").alias("target_time"), "pm25_ug_m3", F.lit("observed").alias("pm25_source")
    )
    return ops.rolling_24h(series, KEY, "target_time")


_FC = "location_key, pipeline_run_id, reference_time, target_time, forecast_horizon_hours"
_FC_SQL = f"{_FC}, {r('predicted_pm25_ug_m3_raw')} AS predicted_pm25_ug_m3_raw, {r('predicted_pm25_ug_m3')} AS predicted_pm25_ug_m3, prediction_was_clipped, prediction_source"
_ROLL_SQL = f"rolling_24h_pm25_is_complete, {r('rolling_24h_pm25_ug_m3')} AS rolling_24h_pm25_ug_m3, rolling_24h_required_hours, rolling_24h_missing_hours, rolling_observed_hour_count, rolling_predicted_hour_count"


@query("enrich_forecast", with_ctes(f"SELECT {_FC_SQL}, {_ROLL_SQL}, {', '.join((*HOURLY_AQI, *ROLLING_AQI))} FROM enriched", "enriched"))
def enrich_forecast(spark, folder):
    runs = forecast(spark, folder).drop("pm25_current", "pm25_lag_24h", "pm25_mean_24h")
    observed = imputed(spark, folder).filter("pm25_ug_m3 IS NOT NULL")
    return ops.enrich_forecast(runs, observed, KEY, RUN)


@query(
    "union_last_wins",
    with_ctes(
        f"""SELECT location_key, datetime_utc, {r('v')} AS pm25_ug_m3, src AS pm25_source FROM (
  SELECT *, row_number() OVER (PARTITION BY location_key, datetime_utc ORDER BY k DESC) AS n FROM (
    SELECT location_key, datetime_utc, pm25_ug_m3 AS v, 'observed' AS src, 1 AS k FROM hourly
    UNION ALL SELECT location_key, target_time, predicted_pm25_ug_m3, 'predicted', 2 FROM (
      SELECT *, row_number() OVER (PARTITION BY location_key, target_time ORDER BY reference_time DESC) AS m FROM forecast) WHERE m = 1))
WHERE n = 1""",
        "hourly", "forecast",
    ),
)
def union_last_wins(spark, folder):
    latest = forecast(spark, folder).groupBy(*KEY, F.col("target_time").alias("datetime_utc")).agg(
        F.max_by("predicted_pm25_ug_m3", "reference_time").alias("pm25_ug_m3")
    )
    return ops.union_last_wins(hourly(spark, folder), latest, KEY, "datetime_utc", "pm25_ug_m3")


_ALERT = "alert_basis, alert_used_hourly_fallback, alert_trigger_aqi, alert_trigger_category, alert_level, alert_rank, alert_is_active, sensitive_groups_alert, general_population_alert, hazardous_alert, health_message, recommended_action, alert_message"


@query("assign_alerts", with_ctes(f"SELECT {_FC}, {_ALERT} FROM published", "published"))
def assign_alerts(spark, folder):
    return published(spark, folder).select(*[c.strip() for c in f"{_FC}, {_ALERT}".split(",")])


@query("alert_episodes", with_ctes("SELECT * FROM episodes", "episodes"))
def alert_episodes(spark, folder):
    return al.alert_episodes(published(spark, folder), [*KEY, *RUN], per_run=True)


# The flagship: a whole repaired series per location, not forecast runs.
cte(
    "series_rolling",
    sql_rolling("location_key", "target_time", "(SELECT location_key, datetime_utc AS target_time, pm25_ug_m3 AS v, 'observed' AS src FROM imputed_all)"),
    "imputed_all",
)
cte(
    "series_enriched",
    f"""SELECT location_key, target_time, CAST(date_diff('hour', TIMESTAMP '2024-01-01', target_time) + 1 AS BIGINT) AS forecast_horizon_hours,
  rolling_24h_pm25_is_complete, {sql_aqi_columns('ct', HOURLY_AQI)}, {sql_aqi_columns('cr', ROLLING_AQI)}
FROM (SELECT *, {sql_truncated('v')} AS ct, {sql_truncated('rolling_24h_pm25_ug_m3')} AS cr FROM series_rolling)""",
    "series_rolling",
)
cte("series_alerts", sql_alerts("series_enriched"), "series_enriched", "alert_config")


def series_alerts(spark, folder, key="all"):
    series = imputed(spark, folder, key).select(
        *KEY, F.col("datetime_utc").alias("target_time"), F.col("pm25_ug_m3").alias("predicted_pm25_ug_m3"),
        F.lit("observed").alias("pm25_source"),
    )
    rolled = ops.rolling_24h(series, KEY, "target_time", "predicted_pm25_ug_m3")
    both = ops.pm25_to_aqi(ops.pm25_to_aqi(rolled, "predicted_pm25_ug_m3", ops.HOURLY_NAMES), "rolling_24h_pm25_ug_m3", ops.ROLLING_NAMES)
    return al.assign_alerts(both.withColumn("forecast_horizon_hours", hour_index("target_time") - EPOCH_HOUR + 1))


@query("alert_episodes_series", with_ctes(sql_episodes("series_alerts", "location_key"), "series_alerts"))
def alert_episodes_series(spark, folder):
    return al.alert_episodes(series_alerts(spark, folder), KEY)


@query(
    "unusable_alert_rows",
    with_ctes("SELECT location_key, target_time, alert_basis FROM series_alerts WHERE alert_trigger_aqi IS NULL OR alert_level IS NULL", "series_alerts"),
)
def unusable_alert_rows(spark, folder):
    return al.unusable_alert_rows(series_alerts(spark, folder)).select(*KEY, "target_time", "alert_basis")


_IMPACT = """SELECT e.location_key, e.pipeline_run_id, e.reference_time, e.alert_episode_id, e.episode_start_time, e.episode_end_time, e.peak_aqi, e.maximum_alert_level,
  COALESCE(bool_or(p.sensitive_groups_alert), FALSE) AS sensitive_groups_affected, COALESCE(bool_or(p.general_population_alert), FALSE) AS general_population_affected,
  COALESCE(bool_or(p.hazardous_alert), FALSE) AS hazardous,
  first(p.recommended_action ORDER BY p.alert_trigger_aqi DESC, p.forecast_horizon_hours) AS recommended_action
FROM episodes e LEFT JOIN published p ON p.pipeline_run_id = e.pipeline_run_id AND p.forecast_horizon_hours BETWEEN e.start_horizon AND e.end_horizon
GROUP BY ALL"""
_IMPACT_COLUMNS = ["alert_episode_id", "episode_start_time", "episode_end_time", "peak_aqi", "maximum_alert_level",
                   "sensitive_groups_affected", "general_population_affected", "hazardous", "recommended_action"]
cte("impact", _IMPACT, "episodes", "published")


def _impact(spark, folder):
    rows = published(spark, folder)
    episodes = al.alert_episodes(rows, [*KEY, *RUN], per_run=True)
    return al.episode_impact(episodes, rows, [*KEY, *RUN]).select(*KEY, *RUN, *_IMPACT_COLUMNS)


@query("episode_impact", with_ctes("SELECT * FROM impact", "impact"))
def episode_impact(spark, folder):
    return _impact(spark, folder)


@query(
    "filter_episodes",
    with_ctes("SELECT * FROM impact WHERE maximum_alert_level IN ('WARNING', 'SEVERE', 'EMERGENCY')", "impact"),
)
def filter_episodes(spark, folder):
    return al.filter_episodes(_impact(spark, folder), "WARNING")


_NOW = "2024-01-20 12:30:00"


@query(
    "active_episodes",
    with_ctes(
        f"""SELECT * EXCLUDE (episode_message), episode_start_time <= TIMESTAMP '{_NOW}' AND TIMESTAMP '{_NOW}' <= episode_end_time AS currently_active, episode_start_time > TIMESTAMP '{_NOW}' AS upcoming
FROM episodes WHERE TIMESTAMP '{_NOW}' <= episode_end_time""",
        "episodes",
    ),
)
def active_episodes(spark, folder):
    episodes = al.alert_episodes(published(spark, folder), [*KEY, *RUN], per_run=True).drop("episode_message")
    return al.active_episodes(episodes, _NOW)


@query(
    "active_episode_counts",
    with_ctes(
        f"""SELECT location_key, COUNT(CASE WHEN episode_start_time <= TIMESTAMP '{_NOW}' THEN 1 END) AS current_count, COUNT(CASE WHEN episode_start_time > TIMESTAMP '{_NOW}' THEN 1 END) AS upcoming_count
FROM episodes WHERE TIMESTAMP '{_NOW}' <= episode_end_time GROUP BY 1""",
        "episodes",
    ),
)
def active_episode_counts(spark, folder):
    episodes = al.alert_episodes(published(spark, folder), [*KEY, *RUN], per_run=True)
    return al.active_counts(al.active_episodes(episodes, _NOW), KEY)


_CATEGORIES = ("Unhealthy", "Very Unhealthy", "Hazardous")


@query(
    "query_forecast",
    with_ctes(
        f"SELECT {_FC}, alert_trigger_aqi, alert_trigger_category, alert_level FROM published WHERE forecast_horizon_hours BETWEEN 1 AND 24 AND alert_trigger_category IN {_CATEGORIES} AND alert_level IN ('WARNING', 'SEVERE', 'EMERGENCY') AND alert_is_active",
        "published",
    ),
)
def query_forecast(spark, folder):
    rows = sv.query_forecast(published(spark, folder), 1, 24, _CATEGORIES, ("WARNING", "SEVERE", "EMERGENCY"), True)
    return rows.select(*[c.strip() for c in _FC.split(",")], "alert_trigger_aqi", "alert_trigger_category", "alert_level")


@query("display_time", "SELECT event_id, ts, ts + INTERVAL 5 HOUR AS display_time FROM events")
def display_time(spark, folder):
    return sv.display_time(events(spark, folder).select("event_id", "ts"), "ts", "Asia/Tashkent")


# Every seventh run stays sound; the others lose a horizon, reach too far, lack or turn round a prediction, repeat a row or name another reference.
_FAULT = "CAST(epoch(reference_time) / 3600 AS BIGINT) % 7"
cte(
    "faulty",
    f"""SELECT * REPLACE (
  CASE WHEN w = 6 AND forecast_horizon_hours = 7 THEN reference_time + INTERVAL 1 HOUR ELSE reference_time END AS reference_time,
  CASE WHEN w = 2 AND forecast_horizon_hours = 72 THEN target_time + INTERVAL 1 HOUR ELSE target_time END AS target_time,
  CASE WHEN w = 2 AND forecast_horizon_hours = 72 THEN 73 ELSE forecast_horizon_hours END AS forecast_horizon_hours,
  CASE WHEN w = 3 AND forecast_horizon_hours = 10 THEN NULL WHEN w = 4 AND forecast_horizon_hours = 3 THEN -1.0 ELSE predicted_pm25_ug_m3 END AS predicted_pm25_ug_m3)
FROM (SELECT *, {_FAULT} AS w FROM forecast UNION ALL SELECT *, {_FAULT} AS w FROM forecast WHERE {_FAULT} = 5 AND forecast_horizon_hours = 1)
WHERE NOT (w = 1 AND forecast_horizon_hours = 5)""",
    "forecast",
)


def _faulty(spark, folder):
    rows = forecast(spark, folder).withColumn("w", hour_index("reference_time") % 7)
    h, w = F.col("forecast_horizon_hours"), F.col("w")
    rows = rows.withColumn("_copy", F.explode(F.array_repeat(F.lit(1), F.when((w == 5) & (h == 1), 2).otherwise(1))))
    far = (w == 2) & (h == 72)
    return rows.filter(~((w == 1) & (h == 5))).withColumns(
        {
            "reference_time": F.when((w == 6) & (h == 7), plus_hours("reference_time", 1)).otherwise(F.col("reference_time")),
            "target_time": F.when(far, plus_hours("target_time", 1)).otherwise(F.col("target_time")),
            "predicted_pm25_ug_m3": F.when((w == 3) & (h == 10), None).when((w == 4) & (h == 3), -1.0).otherwise(F.col("predicted_pm25_ug_m3")),
            "forecast_horizon_hours": F.when(far, 73).otherwise(h),
        }
    )


@query(
    "forecast_contract_checks",
    with_ctes(
        """SELECT location_key, pipeline_run_id, n AS forecast_rows, t AS unique_target_times, n = 72 AS row_count_ok, h = 72 AND h0 = 1 AND h1 = 72 AS horizons_ok,
  refs = 1 AS single_reference, t = 72 AND off = 0 AS target_timeline_ok, bad = 0 AS predictions_finite, neg = 0 AS predictions_non_negative, runs = 1 AS single_run_id,
  n = 72 AND h = 72 AND h0 = 1 AND h1 = 72 AND refs = 1 AND t = 72 AND off = 0 AND bad = 0 AND neg = 0 AND runs = 1 AS approved
FROM (SELECT location_key, pipeline_run_id, COUNT(*) AS n, COUNT(DISTINCT target_time) AS t, COUNT(DISTINCT forecast_horizon_hours) AS h, MIN(forecast_horizon_hours) AS h0, MAX(forecast_horizon_hours) AS h1,
    COUNT(DISTINCT reference_time) AS refs, COUNT(DISTINCT pipeline_run_id) AS runs,
    COUNT(CASE WHEN date_diff('hour', reference_time, target_time) <> forecast_horizon_hours THEN 1 END) AS off,
    COUNT(CASE WHEN predicted_pm25_ug_m3 IS NULL OR NOT isfinite(predicted_pm25_ug_m3) THEN 1 END) AS bad, COUNT(CASE WHEN predicted_pm25_ug_m3 < 0 THEN 1 END) AS neg
  FROM faulty GROUP BY 1, 2)""",
        "faulty",
    ),
)
def forecast_contract_checks(spark, folder):
    """Sound and damaged runs, each judged by its contract."""
    return sv.forecast_checks(_faulty(spark, folder).withColumn("_run", F.col("pipeline_run_id")), [*KEY, "_run"]).withColumnRenamed("_run", "pipeline_run_id")


@query(
    "output_quality_checks",
    with_ctes(
        """SELECT *, forecast_rows_actual = 72 AND unique_target_times = 72 AND complete_rolling_windows = 72 AND indicative_aqi_missing_values = 0 AND rolling_aqi_missing_values = 0
  AND incomplete_rolling_windows = 0 AND missing_alert_levels = 0 AND missing_health_messages = 0 AND missing_recommended_actions = 0 AND negative_operational_pm25 = 0 AS approved
FROM (SELECT location_key, pipeline_run_id, reference_time, COUNT(*) AS forecast_rows_actual, COUNT(DISTINCT target_time) AS unique_target_times,
  COUNT(*) - COUNT(indicative_hourly_pm25_aqi) AS indicative_aqi_missing_values, COUNT(*) - COUNT(rolling_24h_pm25_aqi) AS rolling_aqi_missing_values,
  COUNT(CASE WHEN rolling_24h_pm25_is_complete THEN 1 END) AS complete_rolling_windows, COUNT(CASE WHEN NOT rolling_24h_pm25_is_complete THEN 1 END) AS incomplete_rolling_windows,
  COUNT(*) - COUNT(alert_level) AS missing_alert_levels, COUNT(*) - COUNT(health_message) AS missing_health_messages, COUNT(*) - COUNT(recommended_action) AS missing_recommended_actions,
  COUNT(CASE WHEN predicted_pm25_ug_m3 < 0 THEN 1 END) AS negative_operational_pm25, 72 AS forecast_rows_expected FROM published GROUP BY 1, 2, 3)""",
        "published",
    ),
)
def output_quality_checks(spark, folder):
    return sv.output_checks(published(spark, folder), [*KEY, *RUN])


@query(
    "forecast_summary",
    with_ctes(
        f"""SELECT p.*, COALESCE(e.n, 0) AS alert_episode_count FROM (
  SELECT location_key, pipeline_run_id, reference_time, MIN(target_time) AS forecast_start, MAX(target_time) AS forecast_end, COUNT(*) AS forecast_rows,
    {r('MIN(predicted_pm25_ug_m3)')} AS minimum_predicted_pm25, {r('MAX(predicted_pm25_ug_m3)')} AS maximum_predicted_pm25, {r('AVG(predicted_pm25_ug_m3)')} AS average_predicted_pm25,
    first(target_time ORDER BY predicted_pm25_ug_m3 DESC, target_time) AS peak_pm25_time,
    MIN(indicative_hourly_pm25_aqi) AS minimum_indicative_hourly_aqi, MAX(indicative_hourly_pm25_aqi) AS maximum_indicative_hourly_aqi,
    MAX(CASE WHEN rolling_24h_pm25_is_complete THEN rolling_24h_pm25_aqi END) AS maximum_rolling_24h_aqi,
    first(alert_trigger_category ORDER BY alert_trigger_aqi DESC, target_time) AS worst_aqi_category,
    first(alert_level ORDER BY alert_rank DESC, target_time) AS maximum_alert_level, MAX(alert_rank) AS maximum_alert_rank,
    COUNT(CASE WHEN alert_is_active THEN 1 END) AS active_alert_hours, bool_or(hazardous_alert) AS hazardous_condition,
    COUNT(CASE WHEN alert_used_hourly_fallback THEN 1 END) AS hourly_fallback_rows
  FROM published GROUP BY 1, 2, 3) p LEFT JOIN (SELECT pipeline_run_id, COUNT(*) AS n FROM episodes GROUP BY 1) e USING (pipeline_run_id)""",
        "published", "episodes",
    ),
)
def forecast_summary(spark, folder):
    rows = published(spark, folder)
    keys = [*KEY, *RUN]
    return sv.forecast_summary(rows, al.alert_episodes(rows, keys, per_run=True), keys)
