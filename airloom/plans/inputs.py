"""Inputs derived from the test tables, as Spark frames and as SQL twins.

`events` is the raw feed: its hourly means per location are the concentration
series. Weather is a fixed function of the hour over each location's calendar.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airloom.contracts import WEATHER
from airloom.functions.hours import hour_index, plus_hours
from airloom.functions.numbers import exact_mean
from airloom.operators.alerts import assign_alerts
from airloom.operators.aqi import enrich_forecast
from airloom.operators.evaluate import hybrid_forecast
from airloom.operators.features import reference_features
from airloom.operators.joins import canonical, expand_horizons
from airloom.operators.timeline import hour_range, impute_short_gaps

KEY = ["location_key"]
RUN = ["pipeline_run_id", "reference_time"]
# First and last hour of the event calendar, and the clock used by "as of" queries.
START = "2024-01-01 00:00:00"
END = "2024-01-31 00:00:00"
AS_OF = "2024-01-31 02:00:00"
EPOCH_HOUR = 473352  # 2024-01-01 00:00 in hours since the epoch
WEATHER_AHEAD = 70


@lru_cache(maxsize=64)
def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@lru_cache(maxsize=64)
def events(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@lru_cache(maxsize=64)
def hourly(spark: SparkSession, folder: str, key: str = "event_type") -> DataFrame:
    """Hourly means per location; partial sums collapse raw rows before the shuffle."""
    location = F.lit("all") if key == "all" else F.col(key).cast("string")
    return (
        events(spark, folder)
        .groupBy(location.alias("location_key"), F.date_trunc("hour", "ts").alias("datetime_utc"))
        .agg(exact_mean("value").alias("pm25_ug_m3"), F.count("*").alias("n_events"))
    )


@lru_cache(maxsize=64)
def weather(spark: SparkSession, folder: str, key: str = "event_type") -> DataFrame:
    """Ten weather variables for each location's calendar plus the forecast hours after it."""
    base = hourly(spark, folder, key)
    bounds = base.groupBy(*KEY).agg(F.min("datetime_utc").alias("_a"), plus_hours(F.max("datetime_utc"), WEATHER_AHEAD).alias("_b"))
    ends = bounds.select(*KEY, F.explode(F.array("_a", "_b")).alias("datetime_utc"))
    i = F.col("_i")
    values = {
        "temperature_2m": 10 + (i * 7) % 25,
        "relative_humidity_2m": (i * 13) % 101,
        "dew_point_2m": (i * 5) % 20,
        "surface_pressure": 990 + (i * 3) % 40,
        "precipitation": F.when(i % 17 == 0, 2.5).otherwise(0.0),
        "rain": F.when(i % 17 == 0, 2.5).otherwise(0.0),
        "cloud_cover": (i * 11) % 101,
        "wind_speed_10m": (i * 3) % 30,
        "wind_direction_10m": (i * 37) % 361,
        "wind_gusts_10m": (i * 5) % 45,
    }
    return (
        hour_range(ends, KEY, "datetime_utc")
        .withColumn("_i", hour_index("datetime_utc") - EPOCH_HOUR)
        .select(*KEY, "datetime_utc", *[values[c].cast("double").alias(c) for c in WEATHER])
    )


@lru_cache(maxsize=64)
def imputed(spark: SparkSession, folder: str, key: str = "event_type") -> DataFrame:
    series = hourly(spark, folder, key).select(*KEY, "datetime_utc", "pm25_ug_m3")
    return impute_short_gaps(series, KEY)


@lru_cache(maxsize=64)
def canonical_hours(spark: SparkSession, folder: str, key: str = "event_type") -> DataFrame:
    """Repaired concentration with the weather of the same hour."""
    pm = imputed(spark, folder, key).select(*KEY, "datetime_utc", "pm25_ug_m3")
    return canonical(pm, weather(spark, folder, key), KEY, how="inner")


@lru_cache(maxsize=64)
def references(spark: SparkSession, folder: str, key: str = "event_type") -> DataFrame:
    return reference_features(canonical_hours(spark, folder, key), KEY)


@lru_cache(maxsize=64)
def forecast(spark: SparkSession, folder: str, key: str = "event_type") -> DataFrame:
    """A 72-hour run from every reference hour with full history.

    The 24-hour mean stands in for the trained model beyond the persistence horizons.
    """
    ready = references(spark, folder, key).filter("pm25_current IS NOT NULL AND pm25_mean_24h IS NOT NULL AND pm25_lag_24h IS NOT NULL")
    runs = ready.select(
        *KEY,
        F.concat("location_key", F.lit("_"), F.date_format("reference_time", "yyyyMMddHH")).alias("pipeline_run_id"),
        "reference_time",
        "pm25_current",
        "pm25_lag_24h",
        "pm25_mean_24h",
    )
    return hybrid_forecast(expand_horizons(runs), "pm25_mean_24h", "mean_24h")


@lru_cache(maxsize=64)
def published(spark: SparkSession, folder: str, key: str = "event_type") -> DataFrame:
    """Forecast runs with index and alert columns."""
    runs = forecast(spark, folder, key).drop("pm25_current", "pm25_lag_24h", "pm25_mean_24h")
    observed = imputed(spark, folder, key).filter("pm25_ug_m3 IS NOT NULL")
    return assign_alerts(enrich_forecast(runs, observed, KEY, RUN))


@lru_cache(maxsize=64)
def scored(spark: SparkSession, folder: str, key: str = "event_type") -> DataFrame:
    """Forecast rows whose actual reading is known, one row per prediction candidate."""
    actual = hourly(spark, folder, key).select(
        *KEY, F.col("datetime_utc").alias("target_time"), F.col("pm25_ug_m3").alias("actual_pm25")
    )
    rows = forecast(spark, folder, key).join(actual, [*KEY, "target_time"])
    return rows.select(*KEY, *RUN, "target_time", "forecast_horizon_hours", "actual_pm25", F.inline(F.array(*[
        F.struct(F.lit(name).alias("candidate"), F.col(c).alias("prediction"))
        for name, c in (
            ("hybrid", "predicted_pm25_ug_m3"),
            ("current_value", "pm25_current"),
            ("previous_day", "pm25_lag_24h"),
            ("mean_24h", "pm25_mean_24h"),
        )
    ])))


# --- SQL twins -----------------------------------------------------------------

def r(e: str) -> str:
    """Double at six decimals, the twin of `registry.settle`."""
    return f"(CASE WHEN abs({e}) < 1e12 THEN floor(({e}) * 1000000.0::DOUBLE + 0.50032::DOUBLE) / 1000000.0::DOUBLE ELSE {e} END)"


def sql_mean(v: str) -> str:
    return f"CAST(SUM(CAST(floor({v} * 10000 + 0.5) AS BIGINT)) AS DOUBLE) / 10000.0 / COUNT({v})"


_I = f"CAST(epoch(datetime_utc) / 3600 AS BIGINT) - {EPOCH_HOUR}"

CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, body: str, *needs: str) -> None:
    CTES[name] = (needs, body)


def with_ctes(body: str, *names: str) -> str:
    """`body` preceded by the named input views and what they need, in order."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        for need in CTES[name][0]:
            visit(need)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        visit(name)
    head = ",\n".join(f"{n} AS MATERIALIZED (\n{CTES[n][1]}\n)" for n in ordered)
    return f"WITH {head}\n{body}" if head else body


def _hourly_sql(location: str) -> str:
    return f"""SELECT {location} AS location_key, date_trunc('hour', ts) AS datetime_utc,
       {sql_mean('value')} AS pm25_ug_m3, COUNT(*) AS n_events
FROM events GROUP BY 1, 2"""


def _weather_sql(source: str) -> str:
    return f"""SELECT location_key, datetime_utc,
  CAST(10 + (i * 7) % 25 AS DOUBLE) AS temperature_2m, CAST((i * 13) % 101 AS DOUBLE) AS relative_humidity_2m,
  CAST((i * 5) % 20 AS DOUBLE) AS dew_point_2m, CAST(990 + (i * 3) % 40 AS DOUBLE) AS surface_pressure,
  CASE WHEN i % 17 = 0 THEN 2.5 ELSE 0.0 END::DOUBLE AS precipitation, CASE WHEN i % 17 = 0 THEN 2.5 ELSE 0.0 END::DOUBLE AS rain,
  CAST((i * 11) % 101 AS DOUBLE) AS cloud_cover, CAST((i * 3) % 30 AS DOUBLE) AS wind_speed_10m,
  CAST((i * 37) % 361 AS DOUBLE) AS wind_direction_10m, CAST((i * 5) % 45 AS DOUBLE) AS wind_gusts_10m
FROM (SELECT location_key, datetime_utc, {_I} AS i FROM (
  SELECT location_key, unnest(generate_series(MIN(datetime_utc), MAX(datetime_utc) + INTERVAL {WEATHER_AHEAD} HOUR, INTERVAL 1 HOUR)) AS datetime_utc
  FROM {source} GROUP BY location_key))"""


def _grid_sql(source: str) -> str:
    return f"""SELECT g.location_key, g.datetime_utc, h.pm25_ug_m3
FROM (SELECT location_key, unnest(generate_series(MIN(datetime_utc), MAX(datetime_utc), INTERVAL 1 HOUR)) AS datetime_utc
      FROM {source} GROUP BY location_key) g
LEFT JOIN {source} h ON h.location_key = g.location_key AND h.datetime_utc = g.datetime_utc"""


def _imputed_sql(grid: str) -> str:
    return f"""SELECT location_key, datetime_utc,
  CASE WHEN fill THEN pv + (date_diff('hour', pt, datetime_utc)) * ((nv - pv) / date_diff('hour', pt, nt)) ELSE pm25_ug_m3 END AS pm25_ug_m3,
  COALESCE(fill, FALSE) AS is_imputed, CASE WHEN fill THEN 'linear' END AS imputation_method
FROM (SELECT *, pm25_ug_m3 IS NULL AND pv > 0 AND nv > 0 AND date_diff('hour', pt, nt) - 1 <= 3 AS fill
  FROM (SELECT *,
    last_value(pm25_ug_m3 IGNORE NULLS) OVER b AS pv, first_value(pm25_ug_m3 IGNORE NULLS) OVER a AS nv,
    last_value(CASE WHEN pm25_ug_m3 IS NOT NULL THEN datetime_utc END IGNORE NULLS) OVER b AS pt,
    first_value(CASE WHEN pm25_ug_m3 IS NOT NULL THEN datetime_utc END IGNORE NULLS) OVER a AS nt
  FROM {grid}
  WINDOW b AS (PARTITION BY location_key ORDER BY datetime_utc ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         a AS (PARTITION BY location_key ORDER BY datetime_utc ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)))"""


cte("hourly", _hourly_sql("event_type"))
cte("hourly_user", _hourly_sql("CAST(user_id AS VARCHAR)"))
cte("hourly_all", _hourly_sql("'all'"))
cte("weather", _weather_sql("hourly"), "hourly")
cte("grid", _grid_sql("hourly"), "hourly")
cte("grid_user", _grid_sql("hourly_user"), "hourly_user")
cte("grid_all", _grid_sql("hourly_all"), "hourly_all")
cte("imputed", _imputed_sql("grid"), "grid")
cte("imputed_user", _imputed_sql("grid_user"), "grid_user")
cte("imputed_all", _imputed_sql("grid_all"), "grid_all")
cte(
    "canonical",
    """SELECT p.location_key, p.datetime_utc, p.pm25_ug_m3, w.* EXCLUDE (location_key, datetime_utc)
FROM imputed p JOIN weather w ON w.location_key = p.location_key AND w.datetime_utc = p.datetime_utc""",
    "imputed", "weather",
)


def sql_calendar(t: str, prefix: str) -> str:
    hour, day, month = f"extract('hour' FROM {t})", f"(extract('isodow' FROM {t}) - 1)", f"extract('month' FROM {t})"
    out = [f"CAST({e} AS DOUBLE) AS {prefix}{n}" for n, e in (("hour", hour), ("day_of_week", day), ("month", month))]
    for n, e, p in (("hour", hour, 24), ("day_of_week", day, 7), ("month", f"({month} - 1)", 12)):
        for f in ("sin", "cos"):
            out.append(f"{f}(2 * pi() * {e} / {p}.0) AS {prefix}{n}_{f}")
    return ", ".join(out)


def sql_direction(c: str, prefix: str) -> str:
    return f"sin(radians({c})) AS {prefix}_sin, cos(radians({c})) AS {prefix}_cos"


# The series is gridded, so positional lags are exact in time.
_M = "CAST(SUM(CAST(floor(pm25_ug_m3 * 1000000 + 0.5) AS BIGINT)) OVER w{n} AS DOUBLE) / 1000000.0 / {n}.0"
SQL_LAGS = ", ".join(f"lag(pm25_ug_m3, {h}) OVER w AS pm25_lag_{h}h" for h in (1, 3, 6, 12, 24))
SQL_MEANS = ", ".join(
    f"CASE WHEN COUNT(pm25_ug_m3) OVER w{n} = {n} THEN {_M.format(n=n)} END AS pm25_mean_{n}h" for n in (3, 6, 12, 24)
)
SQL_CHANGES = ", ".join(f"pm25_ug_m3 - lag(pm25_ug_m3, {h}) OVER w AS pm25_change_{h}h" for h in (1, 6, 24))
SQL_WINDOWS = "WINDOW w AS (PARTITION BY location_key ORDER BY datetime_utc), " + ", ".join(
    f"w{n} AS (PARTITION BY location_key ORDER BY datetime_utc ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    for n in (3, 6, 12, 24)
)
cte(
    "refs",
    f"""SELECT location_key, datetime_utc AS reference_time, pm25_ug_m3 AS pm25_current, {SQL_LAGS}, {SQL_MEANS}, {SQL_CHANGES},
  {', '.join(WEATHER)}, {sql_direction('wind_direction_10m', 'wind_direction_10m')}, {sql_calendar('datetime_utc', 'reference_')}
FROM canonical {SQL_WINDOWS}""",
    "canonical",
)
cte(
    "targets",
    f"""SELECT location_key, datetime_utc AS target_time, {', '.join(f'{c} AS target_{c}' for c in WEATHER)},
  {sql_direction('wind_direction_10m', 'target_wind_direction_10m')}, {sql_calendar('datetime_utc', 'target_')}
FROM weather""",
    "weather",
)
cte(
    "forecast",
    """SELECT location_key, location_key || '_' || strftime(reference_time, '%Y%m%d%H') AS pipeline_run_id, reference_time,
  pm25_current, pm25_lag_24h, pm25_mean_24h, h AS forecast_horizon_hours, reference_time + to_hours(h) AS target_time,
  CASE WHEN h <= 12 THEN pm25_current ELSE pm25_mean_24h END AS predicted_pm25_ug_m3_raw,
  CASE WHEN h <= 12 THEN 'current_pm25_persistence' ELSE 'mean_24h' END AS prediction_source,
  greatest(CASE WHEN h <= 12 THEN pm25_current ELSE pm25_mean_24h END, 0.0) AS predicted_pm25_ug_m3,
  CASE WHEN h <= 12 THEN pm25_current ELSE pm25_mean_24h END < 0 AS prediction_was_clipped
FROM refs, generate_series(1, 72) s(h)
WHERE pm25_current IS NOT NULL AND pm25_mean_24h IS NOT NULL AND pm25_lag_24h IS NOT NULL""",
    "refs",
)

_BANDS_SQL = (
    (9.0, 0.0, 0, 50, "Good", "Green", "#00E400", 0),
    (35.4, 9.1, 51, 100, "Moderate", "Yellow", "#FFFF00", 1),
    (55.4, 35.5, 101, 150, "Unhealthy for Sensitive Groups", "Orange", "#FF7E00", 2),
    (125.4, 55.5, 151, 200, "Unhealthy", "Red", "#FF0000", 3),
    (225.4, 125.5, 201, 300, "Very Unhealthy", "Purple", "#8F3F97", 4),
    (325.4, 225.5, 301, 500, "Hazardous", "Maroon", "#7E0023", 5),
)


def sql_truncated(v: str) -> str:
    return f"(floor(({v}) * 10.0::DOUBLE) / 10.0::DOUBLE)"


def _sql_band(c: str, pick, beyond: str) -> str:
    arms = " ".join(f"WHEN {c} <= {b[0]}::DOUBLE THEN {pick(b)}" for b in _BANDS_SQL)
    return f"(CASE WHEN {c} IS NULL THEN NULL {arms} ELSE {beyond} END)"


def sql_aqi(c: str) -> str:
    """Index of a truncated concentration column `c`."""

    def line(b) -> str:
        return (
            f"CAST(floor((({b[3] - b[2]}.0::DOUBLE) / ({b[0]}::DOUBLE - {b[1]}::DOUBLE)) * ({c} - {b[1]}::DOUBLE)"
            f" + {b[2]}.0::DOUBLE + 0.5::DOUBLE) AS BIGINT)"
        )

    return _sql_band(c, line, line(_BANDS_SQL[-1]))


def sql_aqi_columns(c: str, names: tuple[str, ...]) -> str:
    """Truncated value, index, category, colour, hex, severity, beyond flag under the given names."""
    parts = (
        c,
        sql_aqi(c),
        _sql_band(c, lambda b: f"'{b[4]}'", "'Beyond the AQI'"),
        _sql_band(c, lambda b: f"'{b[5]}'", "'Maroon'"),
        _sql_band(c, lambda b: f"'{b[6]}'", "'#7E0023'"),
        _sql_band(c, lambda b: str(b[7]), "5"),
        f"({sql_aqi(c)} > 500)",
    )
    return ", ".join(f"{p} AS {n}" for p, n in zip(parts, names, strict=True))


HOURLY_AQI = (
    "predicted_pm25_ug_m3_truncated", "indicative_hourly_pm25_aqi", "indicative_hourly_aqi_category",
    "indicative_hourly_aqi_color_name", "indicative_hourly_aqi_color_hex", "indicative_hourly_aqi_severity_rank",
    "indicative_hourly_is_beyond_aqi",
)
ROLLING_AQI = (
    "rolling_24h_pm25_ug_m3_truncated", "rolling_24h_pm25_aqi", "rolling_24h_aqi_category",
    "rolling_24h_aqi_color_name", "rolling_24h_aqi_color_hex", "rolling_24h_aqi_severity_rank",
    "rolling_24h_is_beyond_aqi",
)


def sql_rolling(keys: str, t: str, source: str) -> str:
    """Trailing 24-hour statistics of a table with columns v and src; hours may be missing."""
    return f"""SELECT *, n = 24 AS rolling_24h_pm25_is_complete,
  CASE WHEN n = 24 THEN CAST(s AS DOUBLE) / 1000000.0 / 24.0 END AS rolling_24h_pm25_ug_m3,
  24 AS rolling_24h_required_hours, 24 - n AS rolling_24h_missing_hours
FROM (SELECT *, COUNT(v) OVER w AS n, SUM(CAST(floor(v * 1000000 + 0.5) AS BIGINT)) OVER w AS s,
    COUNT(CASE WHEN src = 'observed' AND v IS NOT NULL THEN 1 END) OVER w AS rolling_observed_hour_count,
    COUNT(CASE WHEN src = 'predicted' AND v IS NOT NULL THEN 1 END) OVER w AS rolling_predicted_hour_count
  FROM {source}
  WINDOW w AS (PARTITION BY {keys} ORDER BY {t} RANGE BETWEEN INTERVAL 23 HOUR PRECEDING AND CURRENT ROW))"""


cte(
    "run_timeline",
    """SELECT location_key, pipeline_run_id, reference_time, target_time, forecast_horizon_hours, predicted_pm25_ug_m3_raw,
  predicted_pm25_ug_m3, prediction_was_clipped, prediction_source, predicted_pm25_ug_m3 AS v, 'predicted' AS src FROM forecast
UNION ALL
SELECT f.location_key, f.pipeline_run_id, f.reference_time, i.datetime_utc, NULL, NULL, NULL, NULL, NULL, i.pm25_ug_m3, 'observed'
FROM (SELECT DISTINCT location_key, pipeline_run_id, reference_time FROM forecast) f
JOIN imputed i ON i.location_key = f.location_key AND i.pm25_ug_m3 IS NOT NULL
 AND i.datetime_utc BETWEEN f.reference_time - INTERVAL 22 HOUR AND f.reference_time""",
    "forecast", "imputed",
)
cte("run_rolling", sql_rolling("pipeline_run_id", "target_time", "run_timeline"), "run_timeline")
cte(
    "enriched",
    f"""SELECT * EXCLUDE (v, src, n, s, ct, cr), {sql_aqi_columns('ct', HOURLY_AQI)}, {sql_aqi_columns('cr', ROLLING_AQI)}
FROM (SELECT *, {sql_truncated('predicted_pm25_ug_m3')} AS ct, {sql_truncated('rolling_24h_pm25_ug_m3')} AS cr
      FROM run_rolling WHERE src = 'predicted')""",
    "run_rolling",
)


def _alert_values() -> str:
    from airloom.operators.alerts import ALERT_CONFIG

    rows = []
    for name, c in ALERT_CONFIG.items():
        flags = ", ".join(str(x).upper() for x in c[2:6])
        rows.append(f"('{name}', '{c[0]}', {c[1]}, {flags}, '{c[6]}', '{c[7]}')")
    return "SELECT * FROM (VALUES " + ",\n ".join(rows) + (
        ") t(category, alert_level, alert_rank, alert_is_active, sensitive_groups_alert, general_population_alert,"
        " hazardous_alert, health_message, recommended_action)"
    )


cte("alert_config", _alert_values())


def sql_alerts(source: str) -> str:
    return f"""SELECT e.*, c.* EXCLUDE (category),
  c.alert_level || ': ' || e.alert_trigger_category || ' AQI ' || CAST(e.alert_trigger_aqi AS VARCHAR) || '. ' || c.recommended_action AS alert_message
FROM (SELECT *, NOT ok AS alert_used_hourly_fallback,
    CASE WHEN ok THEN 'rolling_24h_pm25_aqi' ELSE 'indicative_hourly_pm25_aqi' END AS alert_basis,
    CASE WHEN ok THEN rolling_24h_pm25_aqi ELSE indicative_hourly_pm25_aqi END AS alert_trigger_aqi,
    CASE WHEN ok THEN rolling_24h_aqi_category ELSE indicative_hourly_aqi_category END AS alert_trigger_category
  FROM (SELECT *, rolling_24h_pm25_is_complete AND rolling_24h_pm25_aqi IS NOT NULL AS ok FROM {source})) e
LEFT JOIN alert_config c ON c.category = e.alert_trigger_category"""


cte("published", sql_alerts("enriched"), "enriched", "alert_config")


def sql_episodes(source: str, keys: str, t: str = "target_time") -> str:
    return f"""SELECT {keys}, 'alert_episode_' || CASE WHEN k < 1000 THEN lpad(CAST(k AS VARCHAR), 3, '0') ELSE CAST(k AS VARCHAR) END AS alert_episode_id,
  episode_start_time, episode_end_time, date_diff('hour', episode_start_time, episode_end_time) + 1 AS duration_hours,
  start_horizon, end_horizon, peak_aqi, peak_time, maximum_alert_level, maximum_alert_rank, peak_category, alert_basis,
  maximum_alert_level || ' AQI episode from ' || strftime(episode_start_time, '%Y-%m-%d %H:%M:%S') || '+00:00 to '
   || strftime(episode_end_time, '%Y-%m-%d %H:%M:%S') || '+00:00; peak AQI ' || CAST(peak_aqi AS VARCHAR) || ' (' || peak_category || ').' AS episode_message
FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY episode_start_time) AS k FROM (
  SELECT {keys}, MIN({t}) AS episode_start_time, MAX({t}) AS episode_end_time,
    MIN(forecast_horizon_hours) AS start_horizon, MAX(forecast_horizon_hours) AS end_horizon,
    MAX(alert_trigger_aqi) AS peak_aqi,
    first({t} ORDER BY alert_trigger_aqi DESC, {t}) AS peak_time,
    first(alert_level ORDER BY alert_rank DESC, {t}) AS maximum_alert_level, MAX(alert_rank) AS maximum_alert_rank,
    first(alert_trigger_category ORDER BY alert_trigger_aqi DESC, {t}) AS peak_category,
    CASE WHEN COUNT(DISTINCT alert_basis) = 1 THEN MIN(alert_basis) ELSE 'mixed' END AS alert_basis
  FROM (SELECT *, SUM(fresh) OVER (PARTITION BY {keys} ORDER BY {t}) AS run FROM (
    SELECT *, CASE WHEN lag({t}) OVER (PARTITION BY {keys} ORDER BY {t}) = {t} - INTERVAL 1 HOUR THEN 0 ELSE 1 END AS fresh
    FROM {source} WHERE alert_is_active))
  GROUP BY {keys}, run))"""


cte("episodes", sql_episodes("published", "location_key, pipeline_run_id, reference_time"), "published")
cte(
    "scored",
    """SELECT f.location_key, f.pipeline_run_id, f.reference_time, f.target_time, f.forecast_horizon_hours,
  a.pm25_ug_m3 AS actual_pm25, c.candidate, c.prediction
FROM forecast f JOIN hourly a ON a.location_key = f.location_key AND a.datetime_utc = f.target_time,
LATERAL (VALUES ('hybrid', f.predicted_pm25_ug_m3), ('current_value', f.pm25_current), ('previous_day', f.pm25_lag_24h), ('mean_24h', f.pm25_mean_24h)) c(candidate, prediction)""",
    "forecast", "hourly",
)
