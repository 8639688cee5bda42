"""Alert assignment, alert episodes and the queries served from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airloom.functions.hours import hour_index
from airloom.operators.series import numbered_hours

# Alert configuration per index category
# (level, rank, active, sensitive groups, general population, hazardous, message, action).
ALERT_CONFIG = {
    "Good": (
        "NORMAL", 0, False, False, False, False,
        "Air quality is satisfactory and poses little or no expected health risk.",
        "Normal outdoor activities may continue.",
    ),
    "Moderate": (
        "NORMAL", 0, False, False, False, False,
        "Air quality is generally acceptable, although unusually sensitive people may be affected.",
        "Most people may continue normal activities. Unusually sensitive people should monitor symptoms.",
    ),
    "Unhealthy for Sensitive Groups": (
        "ADVISORY", 1, True, True, False, False,
        "Sensitive groups may experience health effects.",
        "Sensitive groups should reduce prolonged or heavy outdoor activity.",
    ),
    "Unhealthy": (
        "WARNING", 2, True, True, True, False,
        "Some members of the general public may experience health effects, with greater risk for sensitive groups.",
        "Reduce prolonged or heavy outdoor activity. Sensitive groups should avoid strenuous outdoor activity.",
    ),
    "Very Unhealthy": (
        "SEVERE", 3, True, True, True, False,
        "The risk of health effects is increased for everyone.",
        "Avoid prolonged or strenuous outdoor activity and reduce exposure.",
    ),
    "Hazardous": (
        "EMERGENCY", 4, True, True, True, True,
        "Emergency health conditions are possible and everyone is more likely to be affected.",
        "Avoid outdoor physical activity and minimize exposure to outdoor air.",
    ),
    "Beyond the AQI": (
        "EMERGENCY", 4, True, True, True, True,
        "Pollution exceeds the standard AQI reporting scale and represents emergency conditions.",
        "Avoid outdoor exposure and follow instructions from local health and emergency authorities.",
    ),
}
CONFIG_COLUMNS = (
    ("alert_level", "string"),
    ("alert_rank", "int"),
    ("alert_is_active", "boolean"),
    ("sensitive_groups_alert", "boolean"),
    ("general_population_alert", "boolean"),
    ("hazardous_alert", "boolean"),
    ("health_message", "string"),
    ("recommended_action", "string"),
)
LEVEL_RANK = {"NORMAL": 0, "ADVISORY": 1, "WARNING": 2, "SEVERE": 3, "EMERGENCY": 4}


def _config(category: Column, position: int, kind: str) -> Column:
    """One constant-map access; null for a category without configuration."""
    pairs = [x for name, values in ALERT_CONFIG.items() for x in (F.lit(name), F.lit(values[position]).cast(kind))]
    return F.try_element_at(F.create_map(*pairs), category)


def assign_alerts(df: DataFrame) -> DataFrame:
    """Trigger basis, level, flags and texts per forecast row.

    The seven-row configuration is folded into the projection, so no join is
    needed. Rows without any usable index keep null alert columns; see
    `unusable_alert_rows`.
    """
    rolling = (
        F.coalesce(F.col("rolling_24h_pm25_is_complete"), F.lit(False))
        & F.col("rolling_24h_pm25_aqi").isNotNull()
        & F.col("rolling_24h_aqi_category").isNotNull()
    )
    out = df.withColumn("_rolling", rolling).withColumns(
        {
            "alert_basis": F.when(F.col("_rolling"), F.lit("rolling_24h_pm25_aqi")).otherwise(
                F.lit("indicative_hourly_pm25_aqi")
            ),
            "alert_used_hourly_fallback": ~F.col("_rolling"),
            "alert_trigger_aqi": F.when(F.col("_rolling"), F.col("rolling_24h_pm25_aqi")).otherwise(
                F.col("indicative_hourly_pm25_aqi")
            ),
            "alert_trigger_category": F.when(F.col("_rolling"), F.col("rolling_24h_aqi_category")).otherwise(
                F.col("indicative_hourly_aqi_category")
            ),
        }
    ).drop("_rolling")
    out = out.withColumns(
        {name: _config(F.col("alert_trigger_category"), i, kind) for i, (name, kind) in enumerate(CONFIG_COLUMNS)}
    )
    return out.withColumn(
        "alert_message",
        F.concat(
            "alert_level", F.lit(": "), "alert_trigger_category", F.lit(" AQI "),
            F.col("alert_trigger_aqi").cast("string"), F.lit(". "), "recommended_action",
        ),
    )


def unusable_alert_rows(df: DataFrame) -> DataFrame:
    """Rows for which no alert can be raised because neither index is known."""
    return df.filter(F.col("alert_trigger_aqi").isNull() | F.col("alert_level").isNull())


def alert_episodes(df: DataFrame, keys: Sequence[str], t: str = "target_time", per_run: bool = False) -> DataFrame:
    """Group active hours exactly one hour apart; severity may change inside an episode.

    Set `per_run` when the keys name one forecast run (72 rows) rather than a whole series.
    """
    keys = list(keys)
    h = hour_index(t)
    runs = numbered_hours(df.filter("alert_is_active"), keys, t, per_run=per_run).withColumn("_run", h - F.col("_number"))
    # Highest index first, earliest hour first among equals.
    order = F.struct(F.col("alert_trigger_aqi"), -h)
    level_order = F.struct(F.col("alert_rank"), -h)
    episodes = runs.groupBy(*keys, "_run").agg(
        F.min(t).alias("episode_start_time"),
        F.max(t).alias("episode_end_time"),
        F.min("forecast_horizon_hours").alias("start_horizon"),
        F.max("forecast_horizon_hours").alias("end_horizon"),
        F.max_by(F.struct("alert_trigger_aqi", t, "alert_trigger_category"), order).alias("_peak"),
        F.max_by("alert_level", level_order).alias("maximum_alert_level"),
        F.max("alert_rank").alias("maximum_alert_rank"),
        F.min("alert_basis").alias("_basis_min"),
        F.max("alert_basis").alias("_basis_max"),
    )
    listed = numbered_hours(episodes, keys, "episode_start_time", "_episode", per_run=per_run)
    stamp = "yyyy-MM-dd HH:mm:ss"
    return listed.select(
        *keys,
        F.concat(
            F.lit("alert_episode_"),
            F.when(F.col("_episode") < 1000, F.lpad(F.col("_episode").cast("string"), 3, "0")).otherwise(
                F.col("_episode").cast("string")
            ),
        ).alias("alert_episode_id"),
        "episode_start_time",
        "episode_end_time",
        (hour_index("episode_end_time") - hour_index("episode_start_time") + 1).alias("duration_hours"),
        "start_horizon",
        "end_horizon",
        F.col("_peak.alert_trigger_aqi").alias("peak_aqi"),
        F.col(f"_peak.{t}").alias("peak_time"),
        "maximum_alert_level",
        "maximum_alert_rank",
        F.col("_peak.alert_trigger_category").alias("peak_category"),
        F.when(F.col("_basis_min") == F.col("_basis_max"), F.col("_basis_min")).otherwise(F.lit("mixed")).alias("alert_basis"),
        F.concat(
            "maximum_alert_level", F.lit(" AQI episode from "),
            F.date_format("episode_start_time", stamp), F.lit("+00:00 to "),
            F.date_format("episode_end_time", stamp), F.lit("+00:00; peak AQI "),
            F.col("_peak.alert_trigger_aqi").cast("string"), F.lit(" ("), F.col("_peak.alert_trigger_category"), F.lit(")."),
        ).alias("episode_message"),
    )


DEFAULT_ACTION = "Follow the health guidance for the reported AQI category."


def episode_impact(episodes: DataFrame, alerted: DataFrame, keys: Sequence[str], t: str = "target_time") -> DataFrame:
    """Affected groups and the action at the peak, from the hours each episode spans.

    Episodes of one run never overlap, so expanding an episode to its horizons
    makes this an equi-join on (run, horizon) instead of a range join.
    """
    keys = list(keys)
    spans = episodes.withColumn("forecast_horizon_hours", F.explode(F.sequence("start_horizon", "end_horizon")))
    hours = alerted.select(
        *keys, F.col("forecast_horizon_hours").cast("int").alias("forecast_horizon_hours"), "sensitive_groups_alert",
        "general_population_alert", "hazardous_alert", "alert_trigger_aqi", "recommended_action",
    )
    joined = spans.withColumn("forecast_horizon_hours", F.col("forecast_horizon_hours").cast("int")).join(
        hours, [*keys, "forecast_horizon_hours"], "left"
    )
    group = [c for c in episodes.columns]
    return joined.groupBy(*group).agg(
        F.coalesce(F.bool_or("sensitive_groups_alert"), F.lit(False)).alias("sensitive_groups_affected"),
        F.coalesce(F.bool_or("general_population_alert"), F.lit(False)).alias("general_population_affected"),
        F.coalesce(F.bool_or("hazardous_alert"), F.lit(False)).alias("hazardous"),
        F.coalesce(
            F.max_by("recommended_action", F.struct("alert_trigger_aqi", -F.col("forecast_horizon_hours"))),
            F.lit(DEFAULT_ACTION),
        ).alias("recommended_action"),
    )


def filter_episodes(episodes: DataFrame, minimum_level: str | None = None, hazardous_only: bool = False) -> DataFrame:
    """Episodes at or above a level, optionally hazardous ones only."""
    if minimum_level is not None:
        allowed = [name for name, rank in LEVEL_RANK.items() if rank >= LEVEL_RANK[minimum_level]]
        episodes = episodes.filter(F.col("maximum_alert_level").isin(allowed))
    return episodes.filter("hazardous") if hazardous_only else episodes


def active_episodes(episodes: DataFrame, as_of: str, include_upcoming: bool = True) -> DataFrame:
    """Current and, if wanted, upcoming episodes at a point in time."""
    now = F.lit(as_of).cast("timestamp")
    current = (F.col("episode_start_time") <= now) & (now <= F.col("episode_end_time"))
    upcoming = F.col("episode_start_time") > now
    keep = current | upcoming if include_upcoming else current
    return episodes.filter(keep).withColumn("currently_active", current).withColumn("upcoming", upcoming)


def active_counts(active: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Current and upcoming episode counts per key."""
    return active.groupBy(*keys).agg(
        F.count_if("currently_active").alias("current_count"), F.count_if("upcoming").alias("upcoming_count")
    )
