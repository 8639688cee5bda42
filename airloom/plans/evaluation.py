"""Scoring, comparison and model queries."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import functions as F

from airloom.contracts import MODEL_FEATURES, TARGET
from airloom.operators import evaluate as ev
from airloom.operators import models as md
from airloom.operators import trees as tr
from airloom.plans.inputs import KEY, cte, forecast, r, scored, with_ctes
from airloom.plans.registry import query
from airloom.plans.training import purged_rows
from airloom.session import scratch_path
from airloom.sources.artifacts import read_snapshot, write_snapshot

Y, P, BY = "actual_pm25", "prediction", ["candidate"]
_METRICS = f"COUNT(*) AS sample_count, {r('AVG(abs(actual_pm25 - prediction))')} AS mae, {r('sqrt(AVG((actual_pm25 - prediction) * (actual_pm25 - prediction)))')} AS rmse, {r('CASE WHEN var_pop(actual_pm25) > 0 THEN 1 - AVG((actual_pm25 - prediction) * (actual_pm25 - prediction)) / var_pop(actual_pm25) END')} AS r2"
_PLAIN = "COUNT(*) AS sample_count, AVG(abs(actual_pm25 - prediction)) AS mae, sqrt(AVG((actual_pm25 - prediction) * (actual_pm25 - prediction))) AS rmse, 1 - AVG((actual_pm25 - prediction) * (actual_pm25 - prediction)) / var_pop(actual_pm25) AS r2"
_GROUP = "CASE WHEN forecast_horizon_hours <= 6 THEN '1_6' WHEN forecast_horizon_hours <= 12 THEN '7_12' WHEN forecast_horizon_hours <= 24 THEN '13_24' WHEN forecast_horizon_hours <= 48 THEN '25_48' ELSE '49_72' END"
cte(
    "errors",
    """SELECT *, abs(residual) AS absolute_error, residual * residual AS squared_error, CASE WHEN actual_pm25 >= 1 THEN abs(residual) / actual_pm25 * 100.0 END AS percentage_error,
  CASE WHEN residual > 0 THEN 'underprediction' WHEN residual < 0 THEN 'overprediction' ELSE 'exact' END AS prediction_bias_direction
FROM (SELECT *, actual_pm25 - prediction AS residual FROM scored)""",
    "scored",
)


def errors(spark, folder):
    return ev.error_table(scored(spark, folder), Y, P)


@query("persistence_baselines", with_ctes(f"SELECT location_key, reference_time, forecast_horizon_hours, {r('pm25_current')} AS current_value_prediction, {r('pm25_lag_24h')} AS previous_day_prediction FROM forecast", "forecast"))
def persistence_baselines(spark, folder):
    rows = ev.persistence_baselines(forecast(spark, folder))
    return rows.select(*KEY, "reference_time", "forecast_horizon_hours", "current_value_prediction", "previous_day_prediction")


_HYBRID = ["predicted_pm25_ug_m3_raw", "predicted_pm25_ug_m3"]


@query("hybrid_forecast", with_ctes(f"SELECT location_key, reference_time, forecast_horizon_hours, {r(_HYBRID[0])} AS {_HYBRID[0]}, {r(_HYBRID[1])} AS {_HYBRID[1]}, prediction_was_clipped, prediction_source FROM forecast", "forecast"))
def hybrid_forecast(spark, folder):
    return forecast(spark, folder).select(*KEY, "reference_time", "forecast_horizon_hours", *_HYBRID, "prediction_was_clipped", "prediction_source")


@query("regression_metrics", with_ctes(f"SELECT candidate, {_METRICS} FROM scored GROUP BY 1", "scored"))
def regression_metrics(spark, folder):
    return ev.regression_metrics(scored(spark, folder), Y, P, BY)


@query("horizon_group_metrics", with_ctes(f"SELECT candidate, {_GROUP} AS horizon_group, {_METRICS} FROM scored GROUP BY 1, 2", "scored"))
def horizon_group_metrics(spark, folder):
    return ev.horizon_group_metrics(scored(spark, folder), Y, P, BY)


@query("per_horizon_metrics", with_ctes(f"SELECT candidate, forecast_horizon_hours, {_METRICS} FROM scored GROUP BY 1, 2", "scored"))
def per_horizon_metrics(spark, folder):
    return ev.per_horizon_metrics(scored(spark, folder), Y, P, BY)


@query("learned_region_metrics", with_ctes(f"SELECT candidate, {_METRICS} FROM scored WHERE forecast_horizon_hours > 12 GROUP BY 1", "scored"))
def learned_region_metrics(spark, folder):
    return ev.learned_region_metrics(scored(spark, folder), Y, P, BY)


@query("severe_metrics", with_ctes(f"SELECT candidate, {_METRICS} FROM scored WHERE actual_pm25 >= 55.5 GROUP BY 1", "scored"))
def severe_metrics(spark, folder):
    return ev.severe_metrics(scored(spark, folder), Y, P, BY)


_ERR = ["residual", "absolute_error", "squared_error", "percentage_error"]


@query("error_table", with_ctes(f"SELECT candidate, location_key, reference_time, forecast_horizon_hours, {', '.join(f'{r(c)} AS {c}' for c in _ERR)} FROM errors", "errors"))
def error_table(spark, folder):
    return errors(spark, folder).select(*BY, *KEY, "reference_time", "forecast_horizon_hours", *_ERR)


_RATES = ", ".join(f"{r(f'AVG(CAST(prediction_bias_direction = {chr(39)}{d}{chr(39)} AS INT))')} AS {d}_rate" for d in ("underprediction", "overprediction"))


@query(
    "band_metrics",
    with_ctes(
        f"""SELECT candidate, CASE WHEN actual_pm25 < 12 THEN 'low' WHEN actual_pm25 < 35.5 THEN 'moderate' WHEN actual_pm25 < 55.5 THEN 'high' ELSE 'extreme' END AS pollution_band, COUNT(*) AS row_count,
  {r('AVG(actual_pm25)')} AS actual_pm25_mean, {r('AVG(prediction)')} AS predicted_pm25_mean, {r('AVG(absolute_error)')} AS mae, {r('sqrt(AVG(squared_error))')} AS rmse, {r('AVG(residual)')} AS mean_residual, {_RATES} FROM errors GROUP BY 1, 2""",
        "errors",
    ),
)
def band_metrics(spark, folder):
    return ev.band_metrics(errors(spark, folder), Y, P, BY)


@query(
    "bias_summary",
    with_ctes(
        f"""SELECT candidate, COUNT(*) AS row_count, {r('AVG(actual_pm25)')} AS mean_actual_pm25, {r('AVG(prediction)')} AS mean_predicted_pm25, {r('AVG(residual)')} AS mean_residual, {_RATES},
  {r("AVG(CAST(prediction_bias_direction = 'exact' AS INT))")} AS exact_prediction_rate, {r('quantile_cont(residual, 0.5)')} AS median_residual FROM errors GROUP BY 1""",
        "errors",
    ),
)
def bias_summary(spark, folder):
    return ev.bias_summary(errors(spark, folder), Y, P, BY)


@query("error_by_hour", with_ctes(f"SELECT candidate, extract('hour' FROM target_time) AS target_hour, COUNT(*) AS row_count, {r('AVG(absolute_error)')} AS mae, {r('AVG(residual)')} AS mean_residual FROM errors GROUP BY 1, 2", "errors"))
def error_by_hour(spark, folder):
    return ev.error_by(errors(spark, folder), F.hour("target_time"), "target_hour", BY)


@query(
    "error_distribution",
    with_ctes(
        f"""SELECT candidate, COUNT(*) AS row_count, {r('AVG(-residual)')} AS mean_signed_error, {r('AVG(absolute_error)')} AS mean_absolute_error, {r('quantile_cont(absolute_error, 0.5)')} AS median_absolute_error,
  {r('quantile_cont(absolute_error, 0.9)')} AS p90_absolute_error, {r('quantile_cont(absolute_error, 0.95)')} AS p95_absolute_error, {r('quantile_cont(absolute_error, 0.99)')} AS p99_absolute_error FROM errors GROUP BY 1""",
        "errors",
    ),
)
def error_distribution(spark, folder):
    return ev.error_distribution(errors(spark, folder), BY)


@query(
    "chronological_stability",
    with_ctes(
        f"SELECT candidate, 'block_' || CAST(b AS VARCHAR) AS validation_block, {_METRICS} FROM scored JOIN (SELECT reference_time, ntile(3) OVER (ORDER BY reference_time) AS b FROM (SELECT DISTINCT reference_time FROM scored)) USING (reference_time) GROUP BY 1, 2",
        "scored",
    ),
)
def chronological_stability(spark, folder):
    return ev.chronological_stability(scored(spark, folder), Y, P, BY)


# A linear extrapolation of the last day's change: it goes negative and is clipped.
_EXTRA = "(pm25_current + (pm25_current - pm25_lag_24h) * forecast_horizon_hours / 24.0)"


@query(
    "prediction_validity",
    with_ctes(
        f"""SELECT location_key, COUNT(*) AS prediction_count, 0 AS raw_nan_count, 0 AS raw_inf_count, COUNT(CASE WHEN x < 0 THEN 1 END) AS negative_raw_count, COUNT(CASE WHEN x < 0 THEN 1 END) AS clipped_prediction_count,
  {r('MIN(x)')} AS raw_min, {r('MAX(x)')} AS raw_max, {r('MIN(greatest(x, 0.0))')} AS operational_min, {r('MAX(greatest(x, 0.0))')} AS operational_max FROM (SELECT location_key, {_EXTRA} AS x FROM forecast) GROUP BY 1""",
        "forecast",
    ),
)
def prediction_validity(spark, folder):
    rows = forecast(spark, folder).withColumn("x", F.expr(_EXTRA)).withColumn("o", F.greatest("x", F.lit(0.0)))
    return ev.prediction_validity(rows, "x", "o", KEY)


_BASE = "(SELECT * FROM m WHERE candidate = 'current_value')"


@query(
    "leaderboard",
    with_ctes(
        f"""SELECT m.candidate, m.sample_count, {r('m.mae')} AS mae, {r('m.rmse')} AS rmse, {r('m.r2')} AS r2, {r('(b.mae - m.mae) / abs(b.mae) * 100.0')} AS mae_improvement_pct, {r('(b.rmse - m.rmse) / abs(b.rmse) * 100.0')} AS rmse_improvement_pct,
  row_number() OVER (ORDER BY m.rmse, m.candidate) AS leaderboard_rank FROM (SELECT candidate, {_PLAIN} FROM scored GROUP BY 1) m, (SELECT {_PLAIN} FROM scored WHERE candidate = 'current_value') b""",
        "scored",
    ),
)
def leaderboard(spark, folder):
    return ev.leaderboard(ev.regression_metrics(scored(spark, folder), Y, P, BY), "current_value")


@query(
    "horizon_wins",
    with_ctes(
        f"""SELECT candidate, COUNT(*) AS total_learned_horizons, COUNT(CASE WHEN r > 0 THEN 1 END) AS rmse_horizons_improved, COUNT(CASE WHEN e > 0 THEN 1 END) AS mae_horizons_improved,
  {r('quantile_cont(r, 0.5)')} AS median_rmse_improvement_pct, {r('quantile_cont(e, 0.5)')} AS median_mae_improvement_pct, {r('MIN(r)')} AS worst_rmse_regression_pct, {r('MIN(e)')} AS worst_mae_regression_pct
FROM (SELECT m.candidate, (b.rmse - m.rmse) / abs(b.rmse) * 100.0 AS r, (b.mae - m.mae) / abs(b.mae) * 100.0 AS e FROM (SELECT candidate, forecast_horizon_hours AS h, {_PLAIN} FROM scored WHERE forecast_horizon_hours > 12 AND candidate <> 'current_value' GROUP BY 1, 2) m
  JOIN (SELECT forecast_horizon_hours AS h, {_PLAIN} FROM scored WHERE forecast_horizon_hours > 12 AND candidate = 'current_value' GROUP BY 1) b USING (h)) GROUP BY 1""",
        "scored",
    ),
)
def horizon_wins(spark, folder):
    return ev.horizon_wins(ev.per_horizon_metrics(scored(spark, folder), Y, P, BY), "current_value")


_GATE_NAMES = ["overall_mae", "overall_rmse", *[f"horizon_{g[0]}_mae" for g in ev.HORIZON_GROUPS], "severe_pm25_metrics"]


@query(
    "promotion_gates",
    with_ctes(
        f"""SELECT candidate, severe_samples, bool_and(passed) OVER (PARTITION BY candidate) AS approved, gate, {r('change_pct')} AS change_pct, passed FROM (
SELECT x.candidate, least(s.n, t.n) AS severe_samples, x.gate, (x.v - b.v) / abs(b.v) * 100.0 AS change_pct, COALESCE((x.v - b.v) / abs(b.v) * 100.0 <= CASE WHEN x.gate LIKE 'overall%' THEN 0.0 ELSE 5.0 END, x.gate = 'severe_pm25_metrics') AS passed
FROM g x JOIN g b ON b.gate = x.gate AND b.candidate = 'current_value'
JOIN (SELECT candidate, COUNT(CASE WHEN actual_pm25 >= 55.5 THEN 1 END) AS n FROM scored GROUP BY 1) s ON s.candidate = x.candidate, (SELECT COUNT(*) AS n FROM scored WHERE actual_pm25 >= 55.5 AND candidate = 'current_value') t
WHERE x.candidate <> 'current_value')""".replace(" g x ", " gate_values x ").replace(" g b ", " gate_values b "),
        "scored",
    ).replace(
        "\nSELECT candidate, severe_samples",
        f""", gate_values AS (SELECT candidate, 'overall_mae' AS gate, AVG(abs(actual_pm25 - prediction)) AS v FROM scored GROUP BY 1
UNION ALL SELECT candidate, 'overall_rmse', sqrt(AVG((actual_pm25 - prediction) * (actual_pm25 - prediction))) FROM scored GROUP BY 1
UNION ALL SELECT candidate, 'horizon_' || {_GROUP} || '_mae', AVG(abs(actual_pm25 - prediction)) FROM scored GROUP BY 1, 2
UNION ALL SELECT DISTINCT candidate, 'severe_pm25_metrics', CAST(NULL AS DOUBLE) FROM scored)
SELECT candidate, severe_samples""",
        1,
    ),
)
def promotion_gates(spark, folder):
    return ev.promotion_gates(scored(spark, folder), Y, P, "current_value")


# --- models (results depend on the learner, so these have no SQL twin) --------------


@lru_cache(maxsize=8)
def training_table(spark, folder):
    """Training rows as a stored snapshot: learners pass over them many times, so they are computed once."""
    root = scratch_path(spark, "training")
    write_snapshot(purged_rows(spark, folder), root, "training", "1")
    return read_snapshot(spark, root, "training", "1")


@query("stratified_sample")
def stratified_sample(spark, folder):
    rows = training_table(spark, folder).withColumn("horizon_group", ev.horizon_group())
    ids = [*KEY, "reference_time", "forecast_horizon_hours"]
    return ev.stratified_sample(rows, ["horizon_group"], 200, 42, ids).select(*ids, "horizon_group", TARGET)


@query("fit_ridge")
def fit_ridge(spark, folder):
    rows = training_table(spark, folder)
    model = md.fit_ridge(rows.filter("split = 'train'"), MODEL_FEATURES, TARGET)
    return ev.regression_metrics(md.score(model, rows), TARGET, "prediction", ["split"])


@lru_cache(maxsize=8)
def _boosted(spark, folder):
    rows = training_table(spark, folder).filter("forecast_horizon_hours > 12")
    return rows, md.fit_boosted_trees(rows, MODEL_FEATURES, TARGET, rounds=4, depth=4)


@query("fit_boosted_trees")
def fit_boosted_trees(spark, folder):
    rows, model = _boosted(spark, folder)
    return ev.regression_metrics(md.score(model, rows), TARGET, "prediction", ["split"])


@query("fit_random_forest")
def fit_random_forest(spark, folder):
    rows = training_table(spark, folder).filter("forecast_horizon_hours > 12")
    model = md.fit_random_forest(rows.filter("split = 'train'"), MODEL_FEATURES, TARGET, trees=4, depth=5)
    return ev.regression_metrics(md.score(model, rows), TARGET, "prediction", ["split"])


@query("gain_importance")
def gain_importance(spark, folder):
    return md.gain_importance(spark, _boosted(spark, folder)[1], MODEL_FEATURES)


@query("fit_absolute_trees")
def fit_absolute_trees(spark, folder):
    """Boosting for the absolute error, over all horizons."""
    rows = training_table(spark, folder)
    model = tr.fit_absolute_trees(rows, MODEL_FEATURES, TARGET, rounds=5, depth=4)
    return ev.regression_metrics(tr.score_trees(model, rows), TARGET, "prediction", ["split"])


def _permutation(spark, folder):
    """Over all test rows, five repeats."""
    rows, model = _boosted(spark, folder)
    ids = [*KEY, "reference_time", "forecast_horizon_hours"]
    trees = tr.ensemble(model, MODEL_FEATURES)
    return model, tr.permutation_importance_by_paths(rows.filter("split = 'test'"), trees, TARGET, ids, repeats=5, seed=42)


@query("permutation_importance")
def permutation_importance(spark, folder):
    return _permutation(spark, folder)[1]


@query("importance_ranks")
def importance_ranks(spark, folder):
    model, permuted = _permutation(spark, folder)
    return md.importance_ranks(md.gain_importance(spark, model, MODEL_FEATURES), permuted)
