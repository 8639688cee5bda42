"""Snapshot and run-output queries: written to a fresh shared path and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from airloom.plans.inputs import KEY, forecast, hourly, r, references, with_ctes
from airloom.plans.registry import query
from airloom.plans.training import purged_rows
from airloom.session import scratch_path
from airloom.sources import artifacts as ar

_ID = [*KEY, "reference_time", "target_time", "forecast_horizon_hours", "split"]


@query("write_snapshot", with_ctes(f"SELECT {', '.join(_ID)} FROM train_purged", "train_purged"))
def write_snapshot(spark, folder):
    root = scratch_path(spark, "snapshot")
    ar.write_snapshot(purged_rows(spark, folder), root, "training", "1")
    return ar.read_snapshot(spark, root, "training", "1").select(*_ID)


_RUN = [*KEY, "pipeline_run_id", "reference_time", "target_time", "forecast_horizon_hours"]


@query("write_run_outputs", with_ctes(f"SELECT {', '.join(_RUN)}, {r('predicted_pm25_ug_m3')} AS predicted_pm25_ug_m3 FROM forecast", "forecast"))
def write_run_outputs(spark, folder):
    rows = forecast(spark, folder).select(*_RUN, "predicted_pm25_ug_m3")
    path = ar.write_run({"forecast": rows}, scratch_path(spark, "runs"), "run-1", csv=["forecast"])
    return spark.read.schema(rows.schema).option("header", True).csv(f"{path}/forecast.csv")


@query("committed_runs", with_ctes(
    " UNION ALL ".join(f"SELECT 'run-1' AS run_id, '{name}' AS name, '{kind}' AS format, COUNT(*) AS row_count FROM {table}" for name, kind, table in (
        ("forecast", "parquet", "forecast"), ("forecast", "csv", "forecast"), ("features", "parquet", "refs"), ("inputs", "parquet", "hourly"),
    )),
    "forecast", "refs", "hourly",
))
def committed_runs(spark, folder):
    """What a run left: forecast (also CSV), feature matrix and hourly inputs under one manifest."""
    root = scratch_path(spark, "runs")
    outputs = {"forecast": forecast(spark, folder), "features": references(spark, folder), "inputs": hourly(spark, folder)}
    ar.commit_run(outputs, root, "run-1", {"source": folder}, csv=["forecast"])
    return ar.committed_runs(spark, root).select("run_id", F.inline("tables")).select("run_id", "name", "format", "row_count")
