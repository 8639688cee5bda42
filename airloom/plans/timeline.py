"""Timeline and gap queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from airloom.functions.hours import plus_hours
from airloom.operators import timeline as tl
from airloom.plans.inputs import END, KEY, START, events, hourly, imputed, r, table, weather, with_ctes
from airloom.plans.registry import query


@query("hourly_grid", with_ctes("SELECT g.location_key, g.datetime_utc, " + r("g.pm25_ug_m3") + " AS pm25_ug_m3 FROM grid_user g", "grid_user"))
def hourly_grid(spark, folder):
    series = hourly(spark, folder, "user_id").select(*KEY, "datetime_utc", "pm25_ug_m3")
    return tl.hourly_grid(series, KEY)


_RANGE = f"unnest(generate_series(TIMESTAMP '{START}', TIMESTAMP '{END}' - INTERVAL 1 HOUR, INTERVAL 1 HOUR))"
_RUNS = """SELECT location_key, MIN(datetime_utc) AS start_time_utc, MAX(datetime_utc) AS end_time_utc, COUNT(*) AS missing_hours
FROM (SELECT location_key, datetime_utc,
        datetime_utc - to_hours(row_number() OVER (PARTITION BY location_key ORDER BY datetime_utc)) AS run FROM missing)
GROUP BY location_key, run"""


@query(
    "detect_gaps",
    with_ctes(
        f"""SELECT * FROM (WITH missing AS (
  SELECT k.location_key, k.datetime_utc FROM (SELECT location_key, {_RANGE} AS datetime_utc FROM (SELECT DISTINCT location_key FROM hourly_user)) k
  WHERE NOT EXISTS (SELECT 1 FROM hourly_user h WHERE h.location_key = k.location_key AND h.datetime_utc = k.datetime_utc))
{_RUNS})""",
        "hourly_user",
    ),
)
def detect_gaps(spark, folder):
    return tl.detect_gaps(hourly(spark, folder, "user_id"), KEY, "datetime_utc", START, "2024-01-30 23:00:00")


@query(
    "gap_summary",
    with_ctes(
        f"SELECT * FROM (WITH missing AS (SELECT * FROM grid_user WHERE pm25_ug_m3 IS NULL) {_RUNS})", "grid_user"
    ),
)
def gap_summary(spark, folder):
    series = hourly(spark, folder, "user_id").select(*KEY, "datetime_utc", "pm25_ug_m3")
    return tl.gap_summary(tl.hourly_grid(series, KEY), KEY, "datetime_utc", "pm25_ug_m3")


@query(
    "longest_missing_run",
    with_ctes(
        f"""SELECT k.location_key, COALESCE(MAX(m.missing_hours), 0) AS longest_gap_hours
FROM (SELECT DISTINCT location_key FROM grid_user) k
LEFT JOIN (WITH missing AS (SELECT * FROM grid_user WHERE pm25_ug_m3 IS NULL) {_RUNS}) m USING (location_key)
GROUP BY 1""",
        "grid_user",
    ),
)
def longest_missing_run(spark, folder):
    series = hourly(spark, folder, "user_id").select(*KEY, "datetime_utc", "pm25_ug_m3")
    return tl.longest_missing_run(tl.hourly_grid(series, KEY), KEY, "datetime_utc", "pm25_ug_m3")


def _h(e: str, d: int) -> str:
    s = 10**d
    return f"(floor({e} * {s}.0::DOUBLE + 0.5::DOUBLE) / {s}.0::DOUBLE)"


COMPLETENESS_SQL = with_ctes(
    f"""SELECT s.location_key, 720 AS expected_hours, raw_records, observed_hours, 720 - observed_hours AS missing_hours,
  {_h('100.0::DOUBLE * observed_hours / 720', 2)} AS completeness_pct,
  COALESCE(g.longest, 0) AS longest_gap_hours, duplicate_hour_rows, negative_values, zero_values,
  {_h('minimum', 3)} AS minimum, {_h('maximum', 3)} AS maximum, {_h('mean', 3)} AS mean, {_h('median', 3)} AS median,
  first_observation, last_observation
FROM (
  SELECT CAST(user_id AS VARCHAR) AS location_key, COUNT(*) AS raw_records, COUNT(DISTINCT date_trunc('hour', ts)) AS observed_hours,
    COUNT(CASE WHEN value < 0 THEN 1 END) AS negative_values, COUNT(CASE WHEN value = 0 THEN 1 END) AS zero_values,
    MIN(value) AS minimum, MAX(value) AS maximum,
    CAST(SUM(CAST(floor(value * 10000 + 0.5) AS BIGINT)) AS DOUBLE) / 10000.0 / COUNT(value) AS mean,
    quantile_cont(value, 0.5) AS median, MIN(ts) AS first_observation, MAX(ts) AS last_observation
  FROM events WHERE ts >= TIMESTAMP '{START}' AND ts < TIMESTAMP '{END}' GROUP BY 1) s
JOIN (SELECT location_key, SUM(CASE WHEN n_events > 1 THEN n_events ELSE 0 END)::BIGINT AS duplicate_hour_rows FROM hourly_user GROUP BY 1) d USING (location_key)
LEFT JOIN (SELECT location_key, MAX(missing_hours) AS longest FROM (WITH missing AS (
  SELECT k.location_key, k.datetime_utc FROM (SELECT location_key, {_RANGE} AS datetime_utc FROM (SELECT DISTINCT location_key FROM hourly_user)) k
  WHERE NOT EXISTS (SELECT 1 FROM hourly_user h WHERE h.location_key = k.location_key AND h.datetime_utc = k.datetime_utc))
  {_RUNS}) GROUP BY 1) g USING (location_key)""",
    "hourly_user",
)


def _completeness(spark, folder):
    raw = events(spark, folder).select(F.col("user_id").cast("string").alias("location_key"), "ts", "value")
    return tl.completeness_report(raw, KEY, "ts", "value", START, END)


@query("completeness_report", COMPLETENESS_SQL)
def completeness_report(spark, folder):
    return _completeness(spark, folder)


@query(
    "sensor_ranking",
    f"""SELECT location_key, completeness_pct, longest_gap_hours, rank() OVER (ORDER BY completeness_pct DESC NULLS LAST) AS completeness_rank
FROM ({COMPLETENESS_SQL})""",
)
def sensor_ranking(spark, folder):
    report = _completeness(spark, folder).select(*KEY, "completeness_pct", "longest_gap_hours")
    return tl.sensor_ranking(report)


@query(
    "impute_short_gaps",
    with_ctes(f"SELECT location_key, datetime_utc, {r('pm25_ug_m3')} AS pm25_ug_m3, is_imputed, imputation_method FROM imputed_user", "imputed_user"),
)
def impute_short_gaps(spark, folder):
    return imputed(spark, folder, "user_id")


@query(
    "window_quality",
    with_ctes(
        """SELECT location_key, datetime_utc AS reference_time, CASE WHEN n > 0 THEN 'DEGRADED' ELSE 'GOOD' END AS quality_status,
  n > 0 AS pm25_imputation_used, CASE WHEN n > 0 THEN 'linear' END AS imputation_method, n AS imputed_hours,
  array_to_string(list_transform(list_sort(a), lambda x: strftime(x, '%Y-%m-%d %H')), ',') AS imputed_timestamps,
  u AS unresolved_hours, array_to_string(list_transform(list_sort(b), lambda x: strftime(x, '%Y-%m-%d %H')), ',') AS unresolved_timestamps
FROM (SELECT *, COUNT(CASE WHEN is_imputed THEN 1 END) OVER w AS n, COUNT(CASE WHEN pm25_ug_m3 IS NULL THEN 1 END) OVER w AS u,
    COALESCE(list(datetime_utc) FILTER (WHERE is_imputed) OVER w, []) AS a, COALESCE(list(datetime_utc) FILTER (WHERE pm25_ug_m3 IS NULL) OVER w, []) AS b
  FROM imputed_user WINDOW w AS (PARTITION BY location_key ORDER BY datetime_utc ROWS BETWEEN 24 PRECEDING AND CURRENT ROW))""",
        "imputed_user",
    ),
)
def window_quality(spark, folder):
    out = tl.window_quality(imputed(spark, folder, "user_id"), KEY, label=F.date_format("datetime_utc", "yyyy-MM-dd HH"))
    # Lists as text, so that the result has only scalar columns.
    for c in ("imputed_timestamps", "unresolved_timestamps"):
        out = out.withColumn(c, F.array_join(c, ","))
    return out


@query(
    "timeline_diff",
    with_ctes(
        f"""SELECT location_key, datetime_utc, 'missing' AS difference FROM (
  (SELECT location_key, {_RANGE} AS datetime_utc FROM (SELECT DISTINCT location_key FROM hourly))
  EXCEPT SELECT location_key, datetime_utc FROM hourly_user_as_type)
UNION ALL
SELECT location_key, datetime_utc, 'unexpected' FROM (SELECT location_key, datetime_utc FROM hourly_user_as_type
  EXCEPT SELECT location_key, {_RANGE} FROM (SELECT DISTINCT location_key FROM hourly))""".replace("hourly_user_as_type", "weather"),
        "hourly", "weather",
    ),
)
def timeline_diff(spark, folder):
    keys = hourly(spark, folder).select(*KEY).distinct()
    fences = keys.withColumn(
        "datetime_utc", F.explode(F.array(F.lit(START).cast("timestamp"), plus_hours(F.lit(END).cast("timestamp"), -1)))
    )
    return tl.timeline_diff(weather(spark, folder), tl.hour_range(fences, KEY, "datetime_utc"), KEY)


@query(
    "forecast_coverage",
    """SELECT o_custkey AS location_key, issued, SUM(n)::BIGINT AS returned_rows, COUNT(*) AS unique_hours, (SUM(n) - COUNT(*))::BIGINT AS duplicate_rows,
  COUNT(CASE WHEN complete THEN 1 END) AS complete_hours, SUM(null_value)::BIGINT AS null_value,
  greatest(COALESCE(MAX(CASE WHEN complete THEN i - COALESCE(prev, 0) - 1 END), 0), 72 - COALESCE(MAX(CASE WHEN complete THEN i END), 0)) AS longest_gap_hours,
  COALESCE(bool_and(step = 1), TRUE) AS hourly_steps, 72 AS expected_hours,
  COUNT(CASE WHEN complete THEN 1 END) = 72 AND SUM(n) = COUNT(*) AND COALESCE(bool_and(step = 1), TRUE) AS is_valid
FROM (SELECT *, MAX(CASE WHEN complete THEN i END) OVER (PARTITION BY o_custkey, issued ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev,
    i - lag(i) OVER (PARTITION BY o_custkey, issued ORDER BY i) AS step
  FROM (SELECT o_custkey, issued, i, COUNT(*) AS n, bool_or(v IS NOT NULL AND i BETWEEN 1 AND 72) AS complete, COUNT(CASE WHEN v IS NULL THEN 1 END) AS null_value
    FROM (SELECT o_custkey, date_trunc('month', CAST(o_orderdate AS TIMESTAMP)) AS issued, 1 + date_diff('day', date_trunc('month', CAST(o_orderdate AS TIMESTAMP)), CAST(o_orderdate AS TIMESTAMP)) AS i,
            CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_totalprice END AS v FROM orders)
    GROUP BY 1, 2, 3))
GROUP BY 1, 2""",
)
def forecast_coverage(spark, folder):
    """Orders stand in for issued forecasts: one issue per customer and month, one lead hour per day of the month."""
    orders = table(spark, folder, "orders")
    issued = F.date_trunc("month", F.col("o_orderdate").cast("timestamp"))
    lead = F.datediff(F.col("o_orderdate"), issued).cast("bigint") + 1
    rows = orders.select(
        F.col("o_custkey").alias("location_key"),
        issued.alias("issued"),
        plus_hours(issued, lead).alias("datetime_utc"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("value"),
    )
    return tl.forecast_coverage(rows, KEY, "issued", "datetime_utc", ["value"])
