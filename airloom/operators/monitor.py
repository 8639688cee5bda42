"""Freshness, component status, incidents and pending notifications."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airloom.functions.hours import hours_between
from airloom.functions.numbers import round_half_up
from airloom.operators.series import attach_per_key, fill_forward, numbered_hours, with_previous

# Status severities, mildest first.
SEVERITY = {"HEALTHY": 0, "UNKNOWN": 1, "WARNING": 2, "CRITICAL": 3}


def classify_age(age: Column, warn: float, crit: float, inclusive: bool = False) -> Column:
    """Status of an age in hours: strict limits for health, inclusive ones for served artefacts."""
    if inclusive:
        return (
            F.when(age.isNull(), F.lit("UNKNOWN")).when(age >= crit, F.lit("STALE")).when(age >= warn, F.lit("AGING"))
            .otherwise(F.lit("FRESH"))
        )
    return (
        F.when(age.isNull(), F.lit("UNKNOWN")).when(age > crit, F.lit("CRITICAL")).when(age > warn, F.lit("WARNING"))
        .otherwise(F.lit("HEALTHY"))
    )


def freshness(
    df: DataFrame, keys: Sequence[str], t: str, as_of: str, warn: float, crit: float, inclusive: bool = False
) -> DataFrame:
    """Newest stamp, age and status per key; future stamps have age 0.

    The strict (health) form classifies the age rounded to three decimals, the
    inclusive (serving) form the exact age.
    """
    now = F.lit(as_of).cast("timestamp")
    latest = df.groupBy(*keys).agg(F.max(t).alias("latest_timestamp_utc"))
    raw = F.when(F.col("latest_timestamp_utc").isNotNull(), F.greatest(hours_between(now, "latest_timestamp_utc"), F.lit(0.0)))
    staged = latest.withColumn("_age", raw).withColumn("age_hours", round_half_up("_age", 3))
    judged = F.col("_age") if inclusive else F.col("age_hours")
    return staged.withColumn("status", classify_age(judged, warn, crit, inclusive)).drop("_age")


def _severity(status: Column) -> Column:
    chain = None
    for name, rank in SEVERITY.items():
        chain = F.when(status == name, F.lit(rank)) if chain is None else chain.when(status == name, F.lit(rank))
    return F.coalesce(chain, F.lit(SEVERITY["UNKNOWN"]))


def worst_status(df: DataFrame, keys: Sequence[str], status: str = "status") -> DataFrame:
    """Most severe status per key; unknown texts count as UNKNOWN, no status at all is UNKNOWN."""
    rank = F.max(F.when(F.col(status).isNotNull(), _severity(F.col(status))))
    worst = df.groupBy(*keys).agg(rank.alias("_rank"), F.count(status).alias("component_count"))
    name = F.lit("UNKNOWN")
    for text, value in SEVERITY.items():
        name = F.when(F.col("_rank") == value, F.lit(text)).otherwise(name)
    return worst.withColumn("worst_status", name).withColumn(
        "report_status",
        F.when(F.col("worst_status") == "HEALTHY", F.lit("PRODUCTION_HEALTHY")).otherwise(
            F.concat(F.lit("PRODUCTION_HEALTH_"), F.col("worst_status"))
        ),
    ).drop("_rank")


def incident_fingerprint(components: DataFrame, run: Sequence[str], observed: str = "observed_at") -> DataFrame:
    """One row per health run: sorted unhealthy set and its SHA-256, null when all are healthy.

    A run lists each monitored component once, so its set has the size of the
    component catalogue, not of the data.
    """
    unhealthy = F.col("status").isin("WARNING", "CRITICAL", "UNKNOWN")
    # Keys in alphabetical order and no spaces, as a canonical JSON text.
    part = F.to_json(F.struct("category", "name", "status"), {"ignoreNullFields": "false"})
    runs = components.groupBy(*run).agg(
        F.max(observed).alias(observed),
        F.array_sort(
            F.collect_set(F.when(unhealthy, F.struct("category", "name", "status", part.alias("json"))))
        ).alias("_set"),
    )
    text = F.concat(F.lit("["), F.array_join(F.transform("_set", lambda x: x["json"]), ","), F.lit("]"))
    return runs.select(
        *run,
        observed,
        F.size("_set").alias("unhealthy_count"),
        F.when(F.size("_set") > 0, F.sha2(text, 256)).alias("fingerprint"),
    )


def incident_lifecycle(
    runs: DataFrame,
    keys: Sequence[str],
    observed: str = "observed_at",
    previous_state: DataFrame | None = None,
) -> DataFrame:
    """What each run does to the active incident: opened, still active, changed, resolved or nothing.

    The state before a run is exactly the fingerprint of the run before it, so
    the fold becomes a link to the previous row. Occurrence counts are positions
    since the run that opened the incident. `previous_state` (keys, fingerprint,
    incident_opened_at, occurrence_count) continues earlier batches.
    """
    keys = list(keys)
    linked = with_previous(runs, keys, observed, ["fingerprint"])
    linked = numbered_hours(linked, keys, observed, "_n")
    if previous_state is None:
        linked = linked.withColumn("_state", F.lit(None).cast("struct<fp:string,opened:timestamp,seen:bigint>"))
    else:
        state = previous_state.select(
            *keys,
            F.struct(
                F.col("fingerprint").alias("fp"),
                F.col("incident_opened_at").alias("opened"),
                F.col("occurrence_count").cast("bigint").alias("seen"),
            ).alias("_state"),
        )
        linked = attach_per_key(linked, state, keys, observed, "left")
    before = F.when(F.col("_n") == 1, F.col("_state.fp")).otherwise(F.col("prev_fingerprint"))
    acted = linked.withColumn("action", incident_action(F.col("fingerprint"), before))
    starts = F.col("action").isin("INCIDENT_OPENED", "INCIDENT_CHANGED")
    marked = acted.withColumn("_mark", F.when(starts, F.struct(F.col(observed).alias("opened"), F.col("_n").alias("n"))))
    filled = fill_forward(marked, keys, observed, "_mark", "_start")
    active = F.col("fingerprint").isNotNull()
    seen = F.when(F.col("_start").isNotNull(), F.col("_n") - F.col("_start.n") + 1).otherwise(
        F.coalesce(F.col("_state.seen"), F.lit(0)) + F.col("_n")
    )
    return filled.select(
        *runs.columns,
        "action",
        F.when(active, F.coalesce(F.col("_start.opened"), F.col("_state.opened"))).alias("incident_opened_at"),
        F.when(active, seen).otherwise(F.lit(0)).cast("bigint").alias("occurrence_count"),
        F.col("action").isin("INCIDENT_OPENED", "INCIDENT_CHANGED", "INCIDENT_RESOLVED").alias("notification_required"),
    )


def incident_action(now: Column, before: Column) -> Column:
    """What a run does, given its fingerprint and the active one."""
    return (
        F.when(now.isNull() & before.isNull(), F.lit("NO_ACTIVE_INCIDENT"))
        .when(now.isNull(), F.lit("INCIDENT_RESOLVED"))
        .when(before.isNull(), F.lit("INCIDENT_OPENED"))
        .when(now == before, F.lit("INCIDENT_STILL_ACTIVE"))
        .otherwise(F.lit("INCIDENT_CHANGED"))
    )


def notification_id(kind: str = "notification_type", incident: str = "incident_id", path: str = "history_path") -> Column:
    """Stable id of one notification: its type and a hash of its canonical JSON."""
    named = F.struct(F.col(path).alias("history_path"), F.col(incident).alias("incident_id"), F.col(kind).alias("notification_type"))
    text = F.to_json(named, {"ignoreNullFields": "false"})
    return F.concat(F.lower(kind), F.lit("_"), F.substring(F.sha2(text, 256), 1, 20))


def pending_notifications(events: DataFrame, outbox: DataFrame, receipts: DataFrame) -> DataFrame:
    """Events neither queued nor delivered yet, one row per notification id."""
    named = events.withColumn("notification_id", notification_id()).dropDuplicates(["notification_id"])
    for known in (outbox, receipts):
        named = named.join(known.select("notification_id").distinct(), "notification_id", "left_anti")
    return named
