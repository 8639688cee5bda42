"""Forecast baselines, hybrid predictions, error metrics, comparison and promotion."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from airloom.functions.numbers import is_infinite, percent_change
from airloom.operators.quantiles import exact_quantiles
from airloom.operators.series import numbered_hours
from airloom.session import materialized

# Horizon groups (name, first, last) and the severe threshold.
HORIZON_GROUPS = (("1_6", 1, 6), ("7_12", 7, 12), ("13_24", 13, 24), ("25_48", 25, 48), ("49_72", 49, 72))
SEVERE = 55.5
PERSISTENCE_MAX = 12
# Concentration bands (name, exclusive upper bound).
BANDS = (("low", 12.0), ("moderate", 35.5), ("high", 55.5), ("extreme", float("inf")))


def persistence_baselines(df: DataFrame) -> DataFrame:
    """Predict the current value, and the value 24 hours before the reference."""
    return df.withColumns(
        {"current_value_prediction": F.col("pm25_current"), "previous_day_prediction": F.col("pm25_lag_24h")}
    )


def hybrid_forecast(df: DataFrame, model_column: str, model_name: str, max_horizon: int = PERSISTENCE_MAX) -> DataFrame:
    """Persistence up to `max_horizon`, the model beyond; raw value kept, negatives clipped and flagged."""
    near = F.col("forecast_horizon_hours") <= max_horizon
    raw = F.col("predicted_pm25_ug_m3_raw")
    return df.withColumns(
        {
            "predicted_pm25_ug_m3_raw": F.when(near, F.col("pm25_current")).otherwise(F.col(model_column)).cast("double"),
            "prediction_source": F.when(near, F.lit("current_pm25_persistence")).otherwise(F.lit(model_name)),
        }
    ).withColumns({"predicted_pm25_ug_m3": F.when(raw.isNotNull(), F.greatest(raw, F.lit(0.0))), "prediction_was_clipped": raw < 0})


def horizon_group(h: str = "forecast_horizon_hours") -> Column:
    chain = None
    for name, first, last in HORIZON_GROUPS:
        test = F.col(h).between(first, last)
        chain = F.when(test, F.lit(name)) if chain is None else chain.when(test, F.lit(name))
    return chain


def regression_metrics(df: DataFrame, y: str, p: str, by: Sequence[str] = ()) -> DataFrame:
    """MAE, RMSE and R2 by any grouping in one pass of partial sums, over rows with both values.

    Constant actuals have no variance to explain: R2 is 1 for a perfect prediction, else 0.
    """
    e = F.col(y) - F.col(p)
    known = F.when(e.isNotNull(), F.col(y))
    error = F.avg(e * e)
    return df.groupBy(*by).agg(
        F.count(e).alias("sample_count"),
        F.avg(F.abs(e)).alias("mae"),
        F.sqrt(error).alias("rmse"),
        F.when(F.max(known) > F.min(known), F.lit(1.0) - error / F.var_pop(known)).when(error == 0, F.lit(1.0)).when(error > 0, F.lit(0.0)).alias("r2"),
    )


def horizon_group_metrics(df: DataFrame, y: str, p: str, by: Sequence[str] = ()) -> DataFrame:
    """Metrics per horizon group; groups without rows report count 0 and null metrics."""
    grouped = regression_metrics(df.withColumn("horizon_group", horizon_group()), y, p, [*by, "horizon_group"])
    names = F.array(*[F.lit(g[0]) for g in HORIZON_GROUPS])
    owners = grouped.select(*by).distinct() if by else grouped.agg(F.count("*").alias("_n")).drop("_n")
    frame = owners.withColumn("horizon_group", F.explode(names))
    return frame.join(grouped, [*by, "horizon_group"], "left").withColumn(
        "sample_count", F.coalesce("sample_count", F.lit(0))
    )


def per_horizon_metrics(df: DataFrame, y: str, p: str, by: Sequence[str] = ()) -> DataFrame:
    return regression_metrics(df, y, p, [*by, "forecast_horizon_hours"])


def learned_region_metrics(df: DataFrame, y: str, p: str, by: Sequence[str] = (), max_horizon: int = PERSISTENCE_MAX) -> DataFrame:
    return regression_metrics(df.filter(F.col("forecast_horizon_hours") > max_horizon), y, p, by)


def severe_metrics(df: DataFrame, y: str, p: str, by: Sequence[str] = (), threshold: float = SEVERE) -> DataFrame:
    return regression_metrics(df.filter(F.col(y) >= threshold), y, p, by)


def error_table(df: DataFrame, y: str, p: str) -> DataFrame:
    """Residual, absolute, squared and percent error (actual >= 1) and the bias direction."""
    residual = F.col(y) - F.col(p)
    return df.withColumn("residual", residual).withColumns(
        {
            "absolute_error": F.abs("residual"),
            "squared_error": F.col("residual") * F.col("residual"),
            "percentage_error": F.when(F.col(y) >= 1.0, F.abs("residual") / F.col(y) * 100.0),
            "prediction_bias_direction": F.when(F.col("residual") > 0, F.lit("underprediction"))
            .when(F.col("residual") < 0, F.lit("overprediction"))
            .otherwise(F.lit("exact")),
        }
    )


def _rate(direction: str) -> Column:
    return F.avg((F.col("prediction_bias_direction") == direction).cast("double"))


def band_metrics(errors: DataFrame, y: str, p: str, by: Sequence[str] = ()) -> DataFrame:
    """Metrics per concentration band of the actual value."""
    band = None
    for name, upper in BANDS:
        test = F.col(y) < upper
        band = F.when(test, F.lit(name)) if band is None else band.when(test, F.lit(name))
    return errors.withColumn("pollution_band", band).groupBy(*by, "pollution_band").agg(
        F.count("*").alias("row_count"),
        F.avg(y).alias("actual_pm25_mean"),
        F.avg(p).alias("predicted_pm25_mean"),
        F.avg("absolute_error").alias("mae"),
        F.sqrt(F.avg("squared_error")).alias("rmse"),
        F.avg("residual").alias("mean_residual"),
        _rate("underprediction").alias("underprediction_rate"),
        _rate("overprediction").alias("overprediction_rate"),
    )


def bias_summary(errors: DataFrame, y: str, p: str, by: Sequence[str]) -> DataFrame:
    """Mean and exact median residual with the direction rates."""
    errors = materialized(errors.select(*by, y, p, "residual", "prediction_bias_direction"), "errors")
    rates = errors.groupBy(*by).agg(
        F.count("*").alias("row_count"),
        F.avg(y).alias("mean_actual_pm25"),
        F.avg(p).alias("mean_predicted_pm25"),
        F.avg("residual").alias("mean_residual"),
        _rate("underprediction").alias("underprediction_rate"),
        _rate("overprediction").alias("overprediction_rate"),
        _rate("exact").alias("exact_prediction_rate"),
    )
    return rates.join(exact_quantiles(errors, by, "residual", {"median_residual": 0.5}), list(by), "left")


def error_by(errors: DataFrame, column: Column | str, name: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows, MAE and mean residual by horizon, target hour or any other column, within `by`."""
    column = F.col(column) if isinstance(column, str) else column
    return errors.groupBy(*by, column.alias(name)).agg(
        F.count("*").alias("row_count"), F.avg("absolute_error").alias("mae"), F.avg("residual").alias("mean_residual")
    )


def error_distribution(errors: DataFrame, by: Sequence[str]) -> DataFrame:
    """Mean signed error and exact median, p90, p95, p99 of the absolute error."""
    errors = materialized(errors.select(*by, "residual", "absolute_error"), "errors")
    quantiles = exact_quantiles(
        errors, by, "absolute_error",
        {"median_absolute_error": 0.5, "p90_absolute_error": 0.9, "p95_absolute_error": 0.95, "p99_absolute_error": 0.99},
    )
    means = errors.groupBy(*by).agg(
        F.count("*").alias("row_count"),
        F.avg(-F.col("residual")).alias("mean_signed_error"),
        F.avg("absolute_error").alias("mean_absolute_error"),
    )
    return means.join(quantiles, list(by), "left")


def chronological_blocks(df: DataFrame, n: int = 3, t: str = "reference_time") -> DataFrame:
    """Distinct reference hours cut into n blocks; the first (count mod n) blocks hold one more."""
    ranked = numbered_hours(df.select(t).distinct(), [], t, total="_total")
    size, extra = F.floor(F.col("_total") / F.lit(n)), F.col("_total") % F.lit(n)
    k = F.col("_number") - 1
    wide = extra * (size + 1)
    block = F.when(k < wide, F.floor(k / (size + 1))).otherwise(extra + F.floor((k - wide) / F.greatest(size, F.lit(1))))
    return ranked.withColumn("validation_block", F.concat(F.lit("block_"), (block + 1).cast("string"))).drop("_number", "_total")


def chronological_stability(df: DataFrame, y: str, p: str, by: Sequence[str] = (), n: int = 3) -> DataFrame:
    """Metrics per block: only the block limits, one row each, meet the large table."""
    limits = chronological_blocks(df, n).groupBy("validation_block").agg(F.min("reference_time").alias("_from"))
    starts = limits.agg(F.array_sort(F.collect_list(F.struct("_from", "validation_block"))).alias("_b")).scalar()
    blocked = df.withColumn("_b", starts).withColumn(
        "validation_block",
        F.element_at(F.filter("_b", lambda b: b["_from"] <= F.col("reference_time")), -1)["validation_block"],
    )
    return regression_metrics(blocked, y, p, [*by, "validation_block"])


def prediction_validity(df: DataFrame, raw: str, operational: str, by: Sequence[str] = ()) -> DataFrame:
    """NaN, infinite, negative and clipped counts with the value ranges."""
    r, o = F.col(raw), F.col(operational)
    is_nan = F.coalesce(F.isnan(r), F.lit(False)) | r.isNull()
    return df.groupBy(*by).agg(
        F.count("*").alias("prediction_count"),
        F.count_if(is_nan).alias("raw_nan_count"),
        F.count_if(is_infinite(raw)).alias("raw_inf_count"),
        F.count_if(r < 0).alias("negative_raw_count"),
        F.count_if(is_nan | ~r.eqNullSafe(o)).alias("clipped_prediction_count"),
        F.min(F.when(~is_nan, r)).alias("raw_min"),
        F.max(F.when(~is_nan, r)).alias("raw_max"),
        F.min(o).alias("operational_min"),
        F.max(o).alias("operational_max"),
    )


def _improvement(champion: Column, candidate: Column) -> Column:
    """Positive when lower; undefined (null) for a zero champion."""
    return F.when(champion != 0, (champion - candidate) / F.abs(champion) * 100.0)


def leaderboard(metrics: DataFrame, champion: str, candidate: str = "candidate") -> DataFrame:
    """Candidates with their improvement over the champion, ranked by RMSE.

    One row per candidate model: its champion row is broadcast by AQE, its rank is over the candidates.
    """
    base = metrics.filter(F.col(candidate) == champion).select(
        F.lit(1).alias("_one"), *[F.col(m).alias(f"_{m}") for m in ("mae", "rmse")]
    )
    joined = metrics.withColumn("_one", F.lit(1)).join(base, "_one").drop("_one")
    return joined.select(
        candidate,
        "sample_count",
        "mae",
        "rmse",
        "r2",
        _improvement(F.col("_mae"), F.col("mae")).alias("mae_improvement_pct"),
        _improvement(F.col("_rmse"), F.col("rmse")).alias("rmse_improvement_pct"),
        F.row_number().over(Window.orderBy("rmse", candidate)).alias("leaderboard_rank"),
    )


def horizon_wins(metrics: DataFrame, champion: str, candidate: str = "candidate", max_horizon: int = PERSISTENCE_MAX) -> DataFrame:
    """Horizons won and median / worst change per candidate; at most 72 rows per candidate."""
    h = "forecast_horizon_hours"
    learned = metrics.filter(F.col(h) > max_horizon)
    base = learned.filter(F.col(candidate) == champion).select(h, F.col("mae").alias("_mae"), F.col("rmse").alias("_rmse"))
    joined = learned.filter(F.col(candidate) != champion).join(base, h)
    mae, rmse = _improvement(F.col("_mae"), F.col("mae")), _improvement(F.col("_rmse"), F.col("rmse"))
    staged = joined.select(candidate, mae.alias("_m"), rmse.alias("_r"))
    return staged.groupBy(candidate).agg(
        F.count("*").alias("total_learned_horizons"),
        F.count_if(F.col("_r") > 0).alias("rmse_horizons_improved"),
        F.count_if(F.col("_m") > 0).alias("mae_horizons_improved"),
        F.percentile("_r", 0.5).alias("median_rmse_improvement_pct"),
        F.percentile("_m", 0.5).alias("median_mae_improvement_pct"),
        F.min("_r").alias("worst_rmse_regression_pct"),
        F.min("_m").alias("worst_mae_regression_pct"),
    )


# Promotion limits in percent and the severe sample minimum.
MAX_MAE_PCT = 0.0
MAX_RMSE_PCT = 0.0
MAX_GROUP_MAE_PCT = 5.0
MIN_SEVERE = 20


def promotion_gates(
    df: DataFrame,
    y: str,
    p: str,
    champion: str,
    candidate: str = "candidate",
    max_mae: float = MAX_MAE_PCT,
    max_rmse: float = MAX_RMSE_PCT,
    max_group: float = MAX_GROUP_MAE_PCT,
    min_severe: int = MIN_SEVERE,
) -> DataFrame:
    """One row per challenger and gate with its percent change, verdict and the overall approval.

    Every gate is derived from one pass over the scored rows: a grouping by
    (candidate, horizon group, severe) whose handful of sums is combined afterwards.
    """
    e = F.col(y) - F.col(p)
    cells = df.groupBy(
        F.col(candidate).alias("candidate"), horizon_group().alias("_g"), (F.col(y) >= SEVERE).alias("_severe")
    ).agg(F.count("*").alias("_n"), F.sum(F.abs(e)).alias("_a"), F.sum(e * e).alias("_q"))
    g = F.col("_g")
    overall = cells.groupBy("candidate").agg(
        (F.sum("_a") / F.sum("_n")).alias("overall_mae"),
        F.sqrt(F.sum("_q") / F.sum("_n")).alias("overall_rmse"),
        *[
            (F.sum(F.when(g == name, F.col("_a"))) / F.sum(F.when(g == name, F.col("_n")))).alias(f"horizon_{name}_mae")
            for name, _, _ in HORIZON_GROUPS
        ],
        F.coalesce(F.sum(F.when(F.col("_severe"), F.col("_n"))), F.lit(0)).alias("_severe_n"),
    )
    base = overall.filter(F.col("candidate") == champion)
    one = F.lit(1).alias("_one")
    left = overall.filter(F.col("candidate") != champion).select("candidate", F.struct("*").alias("c"), one)
    pairs = left.join(base.select(F.struct("*").alias("b"), one), "_one")
    limits = [("overall_mae", max_mae), ("overall_rmse", max_rmse)] + [
        (f"horizon_{name}_mae", max_group) for name, _, _ in HORIZON_GROUPS
    ]
    gates = []
    for name, limit in limits:
        change = percent_change(F.col("c")[name], F.col("b")[name])
        gates.append(
            F.struct(
                F.lit(name).alias("gate"),
                change.alias("change_pct"),
                F.coalesce(change <= limit, F.lit(False)).alias("passed"),
            )
        )
    # With enough shared samples both sides must have severe metrics; below that the gate only informs.
    shared = F.least(F.col("c._severe_n"), F.col("b._severe_n"))
    gates.append(
        F.struct(
            F.lit("severe_pm25_metrics").alias("gate"), F.lit(None).cast("double").alias("change_pct"),
            ((shared < min_severe) | (shared > 0)).alias("passed"),
        )
    )
    listed = pairs.select("candidate", shared.alias("severe_samples"), F.array(*gates).alias("_gates")).withColumn(
        "approved", F.forall("_gates", lambda x: x["passed"])
    )
    return listed.select("candidate", "severe_samples", "approved", F.inline("_gates"))


def stratified_sample(df: DataFrame, group: Sequence[str], n: int, seed: int, ids: Sequence[str]) -> DataFrame:
    """At most n rows per group, chosen by a seeded hash; a sampling operator.

    A first pass keeps the n smallest hashes of each of many slices of a group,
    so that no task ranks a whole group.
    """
    hashed = df.withColumn("_h", F.xxhash64(F.lit(seed), *ids)).withColumn("_slice", F.pmod(F.col("_h"), F.lit(64)))
    order = [F.col("_h"), *[F.col(c) for c in ids]]
    local = Window.partitionBy(*group, "_slice").orderBy(*order)
    few = hashed.withColumn("_r", F.row_number().over(local)).filter(F.col("_r") <= n)
    return (
        few.withColumn("_r", F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
        .filter(F.col("_r") <= n)
        .drop("_h", "_slice", "_r")
    )
