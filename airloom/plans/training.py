"""Join, feature and training-table queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from airloom.contracts import LAGS, MODEL_FEATURES, REFERENCE_FEATURES, TARGET, TARGET_FEATURES, WEATHER
from airloom.functions.hours import plus_hours
from airloom.operators import features as ft
from airloom.operators import joins as jn
from airloom.operators import readiness as rd
from airloom.operators import training as tr
from airloom.plans.inputs import (
    AS_OF,
    KEY,
    SQL_CHANGES,
    SQL_LAGS,
    SQL_MEANS,
    SQL_WINDOWS,
    canonical_hours,
    cte,
    events,
    forecast,
    hourly,
    imputed,
    r,
    references,
    scored,
    sql_calendar,
    weather,
    with_ctes,
)
from airloom.plans.registry import query


def _r(columns) -> str:
    return ", ".join(f"{r(c)} AS {c}" for c in columns)


def pollution(spark, folder):
    return imputed(spark, folder).select(*KEY, "datetime_utc", "pm25_ug_m3")


# --- joins ------------------------------------------------------------------------


def _canonical_sql(how: str) -> str:
    return with_ctes(
        f"""SELECT COALESCE(p.location_key, w.location_key) AS location_key, COALESCE(p.datetime_utc, w.datetime_utc) AS datetime_utc, {r('p.pm25_ug_m3')} AS pm25_ug_m3,
  {', '.join(f'w.{c}' for c in WEATHER)} FROM grid p {how} JOIN weather w ON p.location_key = w.location_key AND p.datetime_utc = w.datetime_utc""",
        "grid", "weather",
    )


def _gridded(spark, folder):
    from airloom.operators.timeline import hourly_grid

    return hourly_grid(hourly(spark, folder).drop("n_events"), KEY)


def _twice(df, column):
    """Every row arrives twice: first with a higher value of one column, then as it is."""
    early = df.withColumn(column, F.coalesce(column, F.lit(0.0)) + 1000.0)
    return early.withColumn("sequence", F.lit(1)).unionByName(df.withColumn("sequence", F.lit(2)))


@query("join_canonical_left", _canonical_sql("LEFT"))
def join_canonical_left(spark, folder):
    return jn.canonical(_gridded(spark, folder), weather(spark, folder), KEY, how="left")


@query("join_canonical_outer", _canonical_sql("FULL"))
def join_canonical_outer(spark, folder):
    return jn.canonical(_gridded(spark, folder), _twice(weather(spark, folder), WEATHER[0]), KEY, how="full", order_by=["sequence"])


@query("join_canonical_inner", _canonical_sql("INNER"))
def join_canonical_inner(spark, folder):
    return jn.canonical(_gridded(spark, folder), weather(spark, folder), KEY, how="inner")


@query(
    "expand_horizons",
    with_ctes("SELECT location_key, datetime_utc AS reference_time, h AS forecast_horizon_hours, datetime_utc + to_hours(h) AS target_time FROM hourly, generate_series(1, 72) s(h)", "hourly"),
)
def expand_horizons(spark, folder):
    return jn.expand_horizons(hourly(spark, folder).select(*KEY, F.col("datetime_utc").alias("reference_time")))


@query(
    "attach_targets",
    with_ctes(
        f"""SELECT e.location_key, e.reference_time, e.h AS forecast_horizon_hours, e.reference_time + to_hours(e.h) AS target_time, {r('p.pm25_ug_m3')} AS {TARGET}, {', '.join(f'w.{c} AS target_{c}' for c in WEATHER)}
FROM (SELECT location_key, datetime_utc AS reference_time, h FROM hourly, generate_series(1, 72) s(h)) e
LEFT JOIN hourly p ON p.location_key = e.location_key AND p.datetime_utc = e.reference_time + to_hours(e.h)
LEFT JOIN weather w ON w.location_key = e.location_key AND w.datetime_utc = e.reference_time + to_hours(e.h)""",
        "hourly", "weather",
    ),
)
def attach_targets(spark, folder):
    rows = jn.expand_horizons(hourly(spark, folder).select(*KEY, F.col("datetime_utc").alias("reference_time")))
    return jn.attach_targets(rows, hourly(spark, folder), weather(spark, folder), KEY)


@query("assert_cardinality", "SELECT CAST(user_id AS VARCHAR) AS location_key, date_trunc('hour', ts) AS datetime_utc, COUNT(*) AS key_rows FROM events GROUP BY 1, 2 HAVING COUNT(*) > 1")
def assert_cardinality(spark, folder):
    raw = events(spark, folder).select(F.col("user_id").cast("string").alias("location_key"), F.date_trunc("hour", "ts").alias("datetime_utc"))
    return jn.cardinality_report(raw, [*KEY, "datetime_utc"])


@query(
    "join_validated",
    with_ctes(f"SELECT e.event_id, e.event_type AS location_key, date_trunc('hour', e.ts) AS datetime_utc, {r('h.pm25_ug_m3')} AS pm25_ug_m3 FROM events e LEFT JOIN hourly h ON h.location_key = e.event_type AND h.datetime_utc = date_trunc('hour', e.ts)", "hourly"),
)
def join_validated(spark, folder):
    raw = events(spark, folder).select("event_id", F.col("event_type").alias("location_key"), F.date_trunc("hour", "ts").alias("datetime_utc"))
    return jn.join_validated(raw, hourly(spark, folder).drop("n_events"), [*KEY, "datetime_utc"], "left", "many_to_one")


@query(
    "replace_features",
    with_ctes(
        f"""SELECT f.location_key, f.pipeline_run_id, f.reference_time, f.target_time, f.forecast_horizon_hours, {r('h.pm25_ug_m3')} AS pm25_current
FROM forecast f JOIN hourly h ON h.location_key = f.location_key AND h.datetime_utc = f.reference_time""",
        "forecast", "hourly",
    ),
)
def replace_features(spark, folder):
    """Observed values replace repaired ones as the current reading."""
    rows = forecast(spark, folder).select(*KEY, "pipeline_run_id", "reference_time", "target_time", "forecast_horizon_hours", "pm25_current")
    observed = hourly(spark, folder).select(*KEY, F.col("datetime_utc").alias("reference_time"), F.col("pm25_ug_m3").alias("pm25_current"))
    return jn.replace_features(rows, observed, KEY, ["pm25_current"])


_HOT = "SELECT DISTINCT location_key, datetime_utc FROM hourly WHERE pm25_ug_m3 >= 55.5"


def _hot(spark, folder):
    return hourly(spark, folder).filter("pm25_ug_m3 >= 55.5").select(*KEY, F.col("datetime_utc").alias("reference_time"))


@query(
    "semi_anti_references",
    with_ctes(
        f"""SELECT f.location_key, f.reference_time, f.forecast_horizon_hours, h.datetime_utc IS NOT NULL AS in_set
FROM forecast f LEFT JOIN ({_HOT}) h ON h.location_key = f.location_key AND h.datetime_utc = f.reference_time""",
        "forecast", "hourly",
    ),
)
def semi_anti_references(spark, folder):
    on = [*KEY, "reference_time"]
    rows = forecast(spark, folder).select(*on, "forecast_horizon_hours")
    hot = _hot(spark, folder)
    return jn.refs_in(rows, hot, on).withColumn("in_set", F.lit(True)).unionByName(
        jn.refs_not_in(rows, hot, on).withColumn("in_set", F.lit(False))
    )


@query("set_difference_hours", with_ctes("SELECT location_key, datetime_utc, 'weather_only' AS side FROM (SELECT location_key, datetime_utc FROM weather EXCEPT SELECT location_key, datetime_utc FROM hourly) UNION ALL SELECT location_key, datetime_utc, 'both' FROM (SELECT location_key, datetime_utc FROM weather INTERSECT SELECT location_key, datetime_utc FROM hourly)", "weather", "hourly"))
def set_difference_hours(spark, folder):
    on = [*KEY, "datetime_utc"]
    w, h = weather(spark, folder), hourly(spark, folder)
    return jn.hours_except(w, h, on).withColumn("side", F.lit("weather_only")).unionByName(
        jn.hours_intersect(w, h, on).withColumn("side", F.lit("both"))
    )


# --- features ---------------------------------------------------------------------


def _windowed(columns: str, names) -> str:
    return with_ctes(
        f"SELECT location_key, datetime_utc, {r('pm25_ug_m3')} AS pm25_ug_m3, {_r(names)} FROM (SELECT *, {columns} FROM imputed_user {SQL_WINDOWS})",
        "imputed_user",
    )


def _series(spark, folder):
    return imputed(spark, folder, "user_id").select(*KEY, "datetime_utc", "pm25_ug_m3")


@query("lag_features", _windowed(SQL_LAGS, [f"pm25_lag_{h}h" for h in LAGS]))
def lag_features(spark, folder):
    return ft.lag_features(_series(spark, folder), KEY, "datetime_utc", "pm25_ug_m3")


@query("rolling_means", _windowed(SQL_MEANS, [f"pm25_mean_{h}h" for h in (3, 6, 12, 24)]))
def rolling_means(spark, folder):
    return ft.rolling_means(_series(spark, folder), KEY, "datetime_utc", "pm25_ug_m3")


@query("change_features", _windowed(SQL_CHANGES, [f"pm25_change_{h}h" for h in (1, 6, 24)]))
def change_features(spark, folder):
    return ft.change_features(_series(spark, folder), KEY, "datetime_utc", "pm25_ug_m3")


@query(
    "circular_encode",
    with_ctes(f"SELECT location_key, datetime_utc, wind_direction_10m, {r('sin(radians(wind_direction_10m))')} AS wind_sin, {r('cos(radians(wind_direction_10m))')} AS wind_cos FROM weather", "weather"),
)
def circular_encode(spark, folder):
    return ft.circular_encode(weather(spark, folder).select(*KEY, "datetime_utc", "wind_direction_10m"), "wind_direction_10m", "wind")


_CAL = [c for c in TARGET_FEATURES if not c.startswith("target_wind") and c not in [f"target_{w}" for w in WEATHER]]


@query("calendar_features", f"SELECT event_id, ts, {_r(_CAL)} FROM (SELECT event_id, ts, {sql_calendar('ts', 'target_')} FROM events)")
def calendar_features(spark, folder):
    return ft.calendar_features(events(spark, folder).select("event_id", "ts"), "ts", "target_")


@query("reference_features", with_ctes(f"SELECT location_key, reference_time, {_r(REFERENCE_FEATURES)} FROM refs", "refs"))
def reference_features(spark, folder):
    return references(spark, folder)


@query("target_weather_features", with_ctes(f"SELECT location_key, target_time, {_r(TARGET_FEATURES)} FROM targets", "targets"))
def target_weather_features(spark, folder):
    return ft.target_weather_features(weather(spark, folder), KEY)


@query(
    "feature_rows",
    with_ctes(
        f"""SELECT f.location_key, f.reference_time, f.reference_time + to_hours(h) AS target_time, {', '.join(f'{r("f." + c)} AS {c}' for c in REFERENCE_FEATURES)}, h AS forecast_horizon_hours, {', '.join(f'{r("t." + c)} AS {c}' for c in TARGET_FEATURES)}
FROM (SELECT * FROM refs JOIN (SELECT location_key, MAX(reference_time) AS m FROM refs WHERE pm25_current IS NOT NULL GROUP BY 1) USING (location_key) WHERE reference_time = m) f, generate_series(1, 72) s(h)
LEFT JOIN targets t ON t.location_key = f.location_key AND t.target_time = f.reference_time + to_hours(h)""",
        "refs", "targets",
    ),
)
def feature_rows(spark, folder):
    """The live matrix: 72 rows for the newest reference of every location."""
    refs = references(spark, folder)
    newest = refs.filter("pm25_current IS NOT NULL").groupBy(*KEY).agg(F.max("reference_time").alias("reference_time"))
    return ft.feature_rows(refs, ft.target_weather_features(weather(spark, folder), KEY), newest, KEY)


@query(
    "complete_feature_rows",
    with_ctes(f"SELECT location_key, reference_time, {_r(REFERENCE_FEATURES)} FROM refs WHERE {' AND '.join(f'{c} IS NOT NULL' for c in REFERENCE_FEATURES)} AND reference_time <= TIMESTAMP '2024-01-28 00:00:00'", "refs"),
)
def complete_feature_rows(spark, folder):
    limits = hourly(spark, folder).select(*KEY).distinct().withColumn("reference_time", F.lit("2024-01-28 00:00:00").cast("timestamp"))
    return ft.complete_feature_rows(_twice(references(spark, folder), REFERENCE_FEATURES[0]), KEY, REFERENCE_FEATURES, ["sequence"], limits)


_CANDIDATES = f"""SELECT location_key, datetime_utc AS candidate_reference_time, {r("date_diff('second', datetime_utc, TIMESTAMP '" + AS_OF + "') / 3600.0")} AS candidate_age_hours, 25 AS required_pm25_history_rows,
  25 - n AS missing_pm25_history_hours, n = 25 AS pm25_history_complete, EXISTS (SELECT 1 FROM weather w WHERE w.location_key = c.location_key AND w.datetime_utc = c.datetime_utc) AS reference_weather_available,
  72 AS required_target_weather_hours, 72 - m AS missing_target_weather_hours, m = 72 AS target_weather_complete
FROM (SELECT p.*, (SELECT COUNT(*) FROM weather w WHERE w.location_key = p.location_key AND w.datetime_utc > p.datetime_utc AND w.datetime_utc <= p.datetime_utc + INTERVAL 72 HOUR) AS m
  FROM (SELECT *, COUNT(pm25_ug_m3) OVER (PARTITION BY location_key ORDER BY datetime_utc RANGE BETWEEN INTERVAL 24 HOUR PRECEDING AND CURRENT ROW) AS n FROM imputed) p) c
WHERE pm25_ug_m3 > 0 AND datetime_utc >= TIMESTAMP '{AS_OF}' - INTERVAL 6 HOUR"""
cte("candidates", _CANDIDATES, "imputed", "weather")


@query("readiness_candidates", with_ctes("SELECT * FROM candidates", "candidates"))
def readiness_candidates(spark, folder):
    return rd.readiness_candidates(pollution(spark, folder), weather(spark, folder), KEY, AS_OF)


@query(
    "reference_readiness",
    with_ctes(
        f"""SELECT l.location_key, CASE WHEN l.t IS NULL THEN 'NOT_READY_INSUFFICIENT_PM25_HISTORY' WHEN l.age > 6 THEN 'STALE_PM25_DATA' WHEN c.sel IS NOT NULL THEN 'READY'
  WHEN COALESCE(c.hist, FALSE) THEN 'WEATHER_FORECAST_INCOMPLETE' ELSE 'NOT_READY_INSUFFICIENT_PM25_HISTORY' END AS readiness_status,
  c.sel AS selected_reference_time, l.t AS latest_valid_pm25_time, {r('l.age')} AS latest_pm25_age_hours,
  COALESCE((SELECT COUNT(*) FROM candidates x WHERE x.location_key = l.location_key AND (c.sel IS NULL OR x.candidate_reference_time >= c.sel)), 0) AS inspected_candidates
FROM (SELECT location_key, t, date_diff('second', t, TIMESTAMP '{AS_OF}') / 3600.0 AS age FROM (SELECT location_key, MAX(CASE WHEN pm25_ug_m3 > 0 THEN datetime_utc END) AS t FROM imputed GROUP BY 1)) l
LEFT JOIN (SELECT location_key, MAX(CASE WHEN pm25_history_complete AND reference_weather_available AND target_weather_complete THEN candidate_reference_time END) AS sel, bool_or(pm25_history_complete) AS hist FROM candidates GROUP BY 1) c USING (location_key)""",
        "candidates",
    ),
)
def reference_readiness(spark, folder):
    return rd.reference_readiness(pollution(spark, folder), weather(spark, folder), KEY, AS_OF)


@query(
    "history_contract_checks",
    with_ctes(
        """SELECT *, history_rows = 25 AND history_hours = 25 AND history_null_hours = 0 AND history_infinite_hours = 0 AND history_non_positive_hours = 0 AND reference_weather_rows = 1 AND target_weather_hours = 72 AS is_valid
FROM (SELECT location_key, datetime_utc AS reference_time, COUNT(*) OVER w AS history_rows, COUNT(*) OVER w AS history_hours, COUNT(*) OVER w - COUNT(pm25_ug_m3) OVER w AS history_null_hours, 0 AS history_infinite_hours,
    COUNT(CASE WHEN pm25_ug_m3 <= 0 THEN 1 END) OVER w AS history_non_positive_hours, 1 AS reference_weather_rows,
    least(72, date_diff('hour', datetime_utc, (SELECT MAX(x.datetime_utc) FROM weather x WHERE x.location_key = i.location_key))) AS target_weather_hours
  FROM imputed i WINDOW w AS (PARTITION BY location_key ORDER BY datetime_utc ROWS BETWEEN 24 PRECEDING AND CURRENT ROW))""",
        "imputed", "weather",
    ),
)
def history_contract_checks(spark, folder):
    refs = pollution(spark, folder).select(*KEY, F.col("datetime_utc").alias("reference_time"))
    return rd.history_checks(pollution(spark, folder), weather(spark, folder), refs, KEY, WEATHER)


# --- training tables --------------------------------------------------------------

cte(
    "train_candidates",
    f"""SELECT f.location_key, f.reference_time, f.reference_time + to_hours(h) AS target_time, {', '.join('f.' + c for c in REFERENCE_FEATURES)}, h AS forecast_horizon_hours, {', '.join('t.' + c for c in TARGET_FEATURES)}, p.pm25_ug_m3 AS {TARGET}
FROM refs f JOIN (SELECT location_key, least(MAX(p.datetime_utc), (SELECT MAX(w.datetime_utc) FROM weather w WHERE w.location_key = p.location_key)) - INTERVAL 72 HOUR AS last FROM imputed p GROUP BY 1) e ON e.location_key = f.location_key AND f.reference_time <= e.last
CROSS JOIN generate_series(1, 72) s(h)
LEFT JOIN targets t ON t.location_key = f.location_key AND t.target_time = f.reference_time + to_hours(h)
LEFT JOIN imputed p ON p.location_key = f.location_key AND p.datetime_utc = f.reference_time + to_hours(h)""",
    "refs", "targets", "imputed",
)
# One sum instead of 57 conjuncts, which the SQL engine would plan one by one.
_OK = "(" + " + ".join(f"({c} IS NULL)::INT" for c in [*MODEL_FEATURES, TARGET]) + ") = 0"
cte(
    "train_rows",
    f"SELECT t.* FROM train_candidates t JOIN (SELECT location_key, reference_time FROM train_candidates WHERE {_OK} GROUP BY 1, 2 HAVING COUNT(DISTINCT forecast_horizon_hours) = 72) USING (location_key, reference_time) WHERE {_OK}",
    "train_candidates",
)
cte(
    "train_bounds",
    """SELECT MIN(CASE WHEN k = CAST(floor(n * 0.70::DOUBLE) AS BIGINT) + 1 THEN reference_time END) AS vs,
  MIN(CASE WHEN k = CAST(floor(n * 0.70::DOUBLE) AS BIGINT) + CAST(floor(n * 0.15::DOUBLE) AS BIGINT) + 1 THEN reference_time END) AS ts
FROM (SELECT reference_time, row_number() OVER (ORDER BY reference_time) AS k, COUNT(*) OVER () AS n FROM (SELECT DISTINCT reference_time FROM train_rows))""",
    "train_rows",
)
cte(
    "train_split",
    "SELECT t.*, CASE WHEN reference_time < vs THEN 'train' WHEN reference_time < ts THEN 'validation' ELSE 'test' END AS split, vs, ts FROM train_rows t, train_bounds",
    "train_rows", "train_bounds",
)
cte(
    "train_purged",
    """SELECT * FROM (SELECT *, MAX(target_time) OVER (PARTITION BY reference_time) AS last FROM train_split) WHERE split = 'test' OR (split = 'train' AND last < vs) OR (split = 'validation' AND last < ts)""",
    "train_split",
)
_ID = "location_key, reference_time, target_time, forecast_horizon_hours"
_ALL = [*REFERENCE_FEATURES, *TARGET_FEATURES, TARGET]


def candidates(spark, folder):
    return tr.packed_candidates(references(spark, folder), pollution(spark, folder), weather(spark, folder), KEY)


def split_rows(spark, folder):
    return tr.split_training_set(canonical_hours(spark, folder), KEY, purge=False)


def purged_rows(spark, folder):
    return tr.split_training_set(canonical_hours(spark, folder), KEY)


def split_hours(spark, folder, purge=True):
    return tr.split_references(canonical_hours(spark, folder), KEY, purge=purge)


def _split_ids(references):
    return jn.expand_horizons(references).select(*[c.strip() for c in _ID.split(",")], "split")


@query("training_candidates", with_ctes(f"SELECT {_ID}, {_r(_ALL)} FROM train_candidates", "train_candidates"))
def training_candidates(spark, folder):
    return tr.candidate_rows(candidates(spark, folder), KEY)


@query("complete_training_rows", with_ctes(f"SELECT {_ID}, {_r(_ALL)} FROM train_rows", "train_rows"))
def complete_training_rows(spark, folder):
    return tr.complete_rows(candidates(spark, folder), KEY)


@query("training_set", with_ctes(f"SELECT {_ID}, {_r([*REFERENCE_FEATURES, *TARGET_FEATURES, TARGET])} FROM train_rows", "train_rows"))
def training_set(spark, folder):
    return tr.training_set(canonical_hours(spark, folder), KEY)


_FEATURES_OK = "(" + " + ".join(f"({c} IS NULL)::INT" for c in MODEL_FEATURES) + ") = 0"


@query(
    "rejection_report",
    with_ctes(
        f"""SELECT location_key, COUNT(*) AS candidate_rows, COUNT(CASE WHEN NOT ({_FEATURES_OK}) THEN 1 END) AS missing_feature_rows, COUNT(*) - COUNT({TARGET}) AS missing_target_rows,
  COUNT(CASE WHEN ok THEN 1 END) - COUNT(CASE WHEN ok AND good = 72 THEN 1 END) AS partial_reference_rows_removed, COUNT(CASE WHEN ok AND good = 72 THEN 1 END) AS final_rows
FROM (SELECT *, {_OK} AS ok, COUNT(CASE WHEN {_OK} THEN 1 END) OVER (PARTITION BY location_key, reference_time) AS good FROM train_candidates) GROUP BY 1""",
        "train_candidates",
    ),
)
def rejection_report(spark, folder):
    return tr.rejection_counts(candidates(spark, folder), KEY)


@query("chronological_split", with_ctes(f"SELECT {_ID}, split FROM train_split", "train_split"))
def chronological_split(spark, folder):
    return _split_ids(split_hours(spark, folder, purge=False))


@query("purge_split", with_ctes(f"SELECT {_ID}, split FROM train_purged", "train_purged"))
def purge_split(spark, folder):
    return _split_ids(split_hours(spark, folder))


@query(
    "purge_split_rows",
    with_ctes(f"SELECT {_ID}, split FROM train_split WHERE split = 'test' OR (split = 'train' AND target_time < vs) OR (split = 'validation' AND target_time < ts)", "train_split"),
)
def purge_split_rows(spark, folder):
    split = split_hours(spark, folder, purge=False)
    return tr.purge_split(_split_ids(split), mode="row")


@query(
    "describe_split",
    with_ctes("SELECT split, COUNT(*) AS row_count, COUNT(DISTINCT reference_time) AS reference_count, MIN(reference_time) AS reference_start, MAX(reference_time) AS reference_end, MIN(target_time) AS target_start, MAX(target_time) AS target_end FROM train_purged GROUP BY 1", "train_purged"),
)
def describe_split(spark, folder):
    return tr.describe_references(split_hours(spark, folder))


@query(
    "horizon_coverage",
    with_ctes("SELECT forecast_horizon_hours, COUNT(CASE WHEN split = 'train' THEN 1 END) AS train_rows, COUNT(CASE WHEN split = 'validation' THEN 1 END) AS validation_rows, COUNT(CASE WHEN split = 'test' THEN 1 END) AS test_rows FROM train_purged GROUP BY 1", "train_purged"),
)
def horizon_coverage(spark, folder):
    return tr.reference_coverage(split_hours(spark, folder))


@query(
    "retraining_eligibility",
    with_ctes(
        """SELECT location_key, COALESCE(n >= 168, FALSE) AS eligible, FALSE AS forced, latest_reference_time, production_training_end, CASE WHEN production_training_end IS NULL THEN 0 ELSE n END AS new_labeled_hours, 168 AS minimum_required_hours,
  CASE WHEN production_training_end IS NULL THEN 'Production metadata does not contain a usable training-end timestamp.' WHEN n >= 168 THEN 'Enough new labeled reference hours exist.' ELSE 'Not enough new labeled reference hours are available.' END AS reason
FROM (SELECT t.location_key, e.production_training_end, MAX(reference_time) AS latest_reference_time, COUNT(DISTINCT CASE WHEN reference_time > production_training_end THEN reference_time END) AS n
  FROM train_rows t LEFT JOIN (SELECT location_key, CASE WHEN location_key <> 'error' THEN date_trunc('hour', MIN(reference_time) + to_hours(CASE WHEN location_key = 'view' THEN 700 ELSE 400 END)) END AS production_training_end FROM train_rows GROUP BY 1) e USING (location_key) GROUP BY 1, 2)""",
        "train_rows",
    ),
)
def retraining_eligibility(spark, folder):
    rows = tr.complete_references(canonical_hours(spark, folder), KEY)
    offset = F.when(F.col("location_key") == "view", 700).otherwise(400).cast("bigint")
    ends = rows.groupBy(*KEY).agg(F.min("reference_time").alias("_m")).select(
        *KEY, F.when(F.col("location_key") != "error", plus_hours("_m", offset)).alias("production_training_end")
    )
    return tr.retraining_eligibility(rows, KEY, ends)


@query(
    "training_frame_checks",
    with_ctes("SELECT split, COUNT(*) AS row_count, 0 AS duplicate_keys, 0 AS missing_feature_values, 0 AS missing_targets, '' AS missing_columns FROM train_split GROUP BY 1", "train_split"),
)
def training_frame_checks(spark, folder):
    return tr.training_frame_checks(split_rows(spark, folder), KEY)


@query(
    "top_k",
    with_ctes(f"SELECT location_key, reference_time, target_time, forecast_horizon_hours, {r('prediction')} AS prediction, {r('abs(actual_pm25 - prediction)')} AS absolute_error FROM scored WHERE candidate = 'hybrid' ORDER BY abs(actual_pm25 - prediction) DESC, location_key, reference_time, forecast_horizon_hours LIMIT 25", "scored"),
)
def top_k(spark, folder):
    rows = scored(spark, folder).filter("candidate = 'hybrid'").withColumn("absolute_error", F.abs(F.col("actual_pm25") - F.col("prediction")))
    return tr.top_k(rows, "absolute_error", 25, ["location_key", "reference_time", "forecast_horizon_hours"]).select(
        *KEY, "reference_time", "target_time", "forecast_horizon_hours", "prediction", "absolute_error"
    )
