"""Continuous versions of the hourly reduction, deduplication, upsert, rolling mean, alerts and incidents."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airloom.contracts import Contract
from airloom.functions.numbers import MEAN_SCALE, exact_mean, fixed_point
from airloom.operators.monitor import incident_lifecycle
from airloom.session import remove_path
from airloom.sources.tables import apply_upsert

LATENESS = "30 hours"  # the overlap a late correction may reach back


def watermarked(stream: DataFrame, t: str, lateness: str = LATENESS) -> DataFrame:
    """Event time as a zoned timestamp (watermarks refuse the zone-free type) with the lateness bound."""
    return stream.withColumn(t, F.col(t).cast("timestamp")).withWatermark(t, lateness)


def stream_hourly(stream: DataFrame, keys: Sequence[str], t: str, v: str, lateness: str = LATENESS) -> DataFrame:
    """Tumbling hourly mean, last value and count per key; `window` carries the event time on."""
    return (
        watermarked(stream, t, lateness)
        .groupBy(*keys, F.window(t, "1 hour"))
        .agg(exact_mean(v).alias("mean_value"), F.max_by(v, t).alias("last_value"), F.count("*").alias("readings"))
    )


def stream_dedupe(stream: DataFrame, keys: Sequence[str], t: str, order_by: Sequence[str], lateness: str = LATENESS) -> DataFrame:
    """The last delivery of each logical key, by `order_by`, once its hour is closed.

    Corrections replace earlier deliveries until the watermark passes the hour; the state is bounded by `lateness`.
    """
    rest = [c for c in stream.columns if c not in keys]
    last = F.max_by(F.struct(*rest), F.struct(*order_by)).alias("_last")
    closed = watermarked(stream, t, lateness).groupBy(*keys, F.window(t, "1 hour")).agg(last)
    return closed.select(*keys, "_last.*")


def stream_rolling_24h(hourly: DataFrame, keys: Sequence[str], hours: int = 24) -> DataFrame:
    """Trailing mean of closed hours over sliding windows, null while hours are missing."""
    total = F.sum(fixed_point("mean_value")).cast("double") / F.lit(float(MEAN_SCALE))
    return (
        hourly.groupBy(*keys, F.window(F.window_time("window"), f"{hours} hours", "1 hour").alias("span"))
        .agg(F.count("*").alias("hours_present"), total.alias("_total"))
        .withColumn("rolling_mean", F.when(F.col("hours_present") == hours, F.col("_total") / F.lit(float(hours))))
        .drop("_total")
    )


def stream_alert_sessions(hourly: DataFrame, keys: Sequence[str], threshold: float) -> DataFrame:
    """Runs of consecutive active hours, emitted as they close.

    A 90 minute gap joins neighbouring hours and separates hours with one missing between them.
    """
    return (
        hourly.filter(F.col("mean_value") >= threshold)
        .groupBy(*keys, F.session_window(F.window_time("window"), "90 minutes").alias("session"))
        .agg(
            F.count("*").alias("duration_hours"),
            F.max("mean_value").alias("peak_value"),
            F.min("window.start").alias("episode_start_time"),
            F.max("window.start").alias("episode_end_time"),
        )
        .drop("session")
    )


def upsert_sink(path: str, contract: Contract, order_by: Sequence[str]) -> Callable[[DataFrame, int], None]:
    """foreachBatch sink that merges a micro-batch and rewrites only the days it changes.

    Replaying a batch finds its rows unchanged, so a retry is harmless.
    """

    def write(batch: DataFrame, _: int) -> None:
        apply_upsert(batch.sparkSession, path, batch, contract, order_by)

    return write


COMPACT_EVERY = 16  # batches between two whole copies of the incident state
_STATE = ("fingerprint", "incident_opened_at", "occurrence_count")


def incident_state(spark: SparkSession, path: str, keys: Sequence[str], batch_id: int, compact_every: int = COMPACT_EVERY) -> DataFrame | None:
    """Active incidents before a batch: the last whole copy and the changes written since; None before the first batch.

    At most `compact_every` changes are read, and a system's last one wins; a change without fingerprint ends its incident.
    """
    base = batch_id // compact_every * compact_every - 1
    parts = [(base, f"{path}/base/batch_id={base}")] if base >= 0 else []
    parts += [(i, f"{path}/state/batch_id={i}") for i in range(base + 1, batch_id)]
    state = None
    for i, part in parts:
        rows = spark.read.parquet(part).select(*keys, F.struct(F.lit(i).alias("batch"), *_STATE).alias("_s"))
        state = rows if state is None else state.unionByName(rows)
    if state is None:
        return None
    last = state.groupBy(*keys).agg(F.max_by("_s", "_s.batch").alias("_s"))
    return last.filter("_s.fingerprint IS NOT NULL").select(*keys, *[F.col(f"_s.{c}").alias(c) for c in _STATE])


def incident_sink(
    path: str, keys: Sequence[str], observed: str = "observed_at", compact_every: int = COMPACT_EVERY
) -> Callable[[DataFrame, int], None]:
    """foreachBatch sink: continue each system's incident from the stored state.

    A batch writes its events and, for the systems it saw, their new state; every `compact_every` batches the active
    incidents are written whole, resolved ones leave, and changes older than the copy before are removed. All is
    written per batch id from earlier ids only, so a replayed batch overwrites its own output with the same rows.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        state = incident_state(spark, path, keys, batch_id, compact_every)
        events = incident_lifecycle(batch, keys, observed, state)
        events.write.mode("overwrite").parquet(f"{path}/events/batch_id={batch_id}")
        done = spark.read.schema(events.schema).parquet(f"{path}/events/batch_id={batch_id}")
        last = done.groupBy(*keys).agg(F.max_by(F.struct(*_STATE), observed).alias("_s")).select(*keys, "_s.*")
        last.write.mode("overwrite").parquet(f"{path}/state/batch_id={batch_id}")
        if (batch_id + 1) % compact_every == 0:
            whole = _active(spark, path, keys, batch_id, compact_every)
            whole.write.mode("overwrite").parquet(f"{path}/base/batch_id={batch_id}")
            before = batch_id - compact_every
            for i in range(before - compact_every + 1, before + 1):
                remove_path(spark, f"{path}/state/batch_id={i}")
            remove_path(spark, f"{path}/base/batch_id={before - compact_every}")

    return write


def _active(spark: SparkSession, path: str, keys: Sequence[str], batch_id: int, compact_every: int) -> DataFrame:
    """Active incidents after the last batch before a whole copy: the state before it, continued by its own changes."""
    new = spark.read.parquet(f"{path}/state/batch_id={batch_id}")
    old = incident_state(spark, path, keys, batch_id, compact_every)
    if old is not None:
        new = new.unionByName(old.join(new.select(*keys), list(keys), "left_anti").select(*keys, *_STATE))
    return new.filter("fingerprint IS NOT NULL")


def run_available(stream: DataFrame, path: str) -> DataFrame:
    """Process everything available into Parquet at a fresh path and read it back."""
    query = (
        stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{path}/checkpoint")
        .option("path", f"{path}/data").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/data")


def run_sink(stream: DataFrame, sink: Callable[[DataFrame, int], None], path: str) -> None:
    query = (
        stream.writeStream.foreachBatch(sink).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    )
    query.awaitTermination()


def file_stream(spark: SparkSession, folder: str, pattern: str, schema, per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.parquet(folder)
