"""Stored tables and incident state: what a delivery reads and writes, replays, forecasts of any length."""

from datetime import datetime, timedelta
from pathlib import Path

import pyspark.sql.functions as F
import pytest

from airloom.contracts import VALUE
from airloom.operators.monitor import incident_lifecycle
from airloom.operators.serving import forecast_checks
from airloom.sources.tables import apply_upsert, read_days, read_table, write_table
from airloom.streaming import jobs as st

START = datetime(2024, 1, 1)


def stored(spark, path):
    rows = [("a", START + timedelta(hours=h), float(h)) for h in range(24 * 10)]
    write_table(spark.createDataFrame(rows, VALUE.schema), path, VALUE)


def files(path):
    return {p.parent.name: sorted(x.name for x in p.parent.glob("*.parquet")) for p in Path(path).glob("event_date=*/*.parquet")}


def test_upsert_touches_only_the_days_of_the_delivery(spark, tmp_path):
    path = str(tmp_path / "table")
    stored(spark, path)
    before = files(path)
    rows = [("a", START + timedelta(hours=5), 99.0, 1), ("a", START + timedelta(days=9, hours=30), 7.0, 2), ("a", START + timedelta(days=3), 72.0, 3)]
    incoming = spark.createDataFrame(rows, "location_key string, datetime_utc timestamp, value double, sequence int")
    apply_upsert(spark, path, incoming, VALUE, ["sequence"])
    after = files(path)
    changed = {d for d in after if after[d] != before.get(d)}
    assert changed == {"event_date=2024-01-01", "event_date=2024-01-11"}  # the row of the fourth day brought nothing new
    assert read_table(spark, path, VALUE).count() == 241
    apply_upsert(spark, path, incoming, VALUE, ["sequence"])
    assert files(path) == after


def test_days_between_are_not_read(spark, tmp_path):
    path = str(tmp_path / "table")
    stored(spark, path)
    read = read_days(spark, path, VALUE, [START.date(), (START + timedelta(days=9)).date()])
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [event_date" in plan and "IN" in plan
    assert {Path(f).parent.name for f in read.select(F.input_file_name().alias("f")).distinct().toPandas()["f"]} == {"event_date=2024-01-01", "event_date=2024-01-10"}


RUNS = "system string, observed_at timestamp, fingerprint string"


def batches():
    """Systems that open, change, rest and resolve incidents over eleven batches; most batches see few of them."""
    plan = [
        {"x": "f", "y": "g", "z": None}, {"x": "f"}, {"y": None}, {"x": "h"}, {"z": "k"}, {}, {"x": None, "z": "k"}, {"y": "g"}, {"y": "g"}, {"z": None}, {"y": "q", "x": "f"},
    ]
    return [[(s, START + timedelta(hours=i), f) for s, f in seen.items()] for i, seen in enumerate(plan)]


@pytest.mark.parametrize("every", [3, 16])
def test_incident_state_by_changes_equals_one_pass(spark, tmp_path, every):
    path = str(tmp_path)
    sink = st.incident_sink(path, ["system"], compact_every=every)
    for i, rows in enumerate(batches()):
        batch = spark.createDataFrame(rows, RUNS)
        sink(batch, i)
        sink(batch, i)  # a replay
        seen = spark.read.parquet(f"{path}/state/batch_id={i}")
        assert {r.system for r in seen.collect()} == {r[0] for r in rows}
    want = incident_lifecycle(spark.createDataFrame([r for b in batches() for r in b], RUNS), ["system"])
    got = spark.read.parquet(f"{path}/events").drop("batch_id")
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))
    active = st.incident_state(spark, path, ["system"], len(batches()), every)
    assert {r.system: r.fingerprint for r in active.collect()} == {"y": "q", "x": "f"}
    if every == 3:
        assert not (tmp_path / "state" / "batch_id=0").exists() and (tmp_path / "base" / "batch_id=8").exists()


def run(horizons, **change):
    out = []
    for h in range(1, horizons + 1):
        row = {"k": "a", "pipeline_run_id": "r", "reference_time": START, "target_time": START + timedelta(hours=h), "forecast_horizon_hours": h, "predicted_pm25_ug_m3": 1.0}
        if h == change.get("at"):
            row |= change["row"]
        out.append(row)
    return out


@pytest.mark.parametrize("horizons", [1, 24, 62, 63, 72, 96, 200])
def test_forecasts_of_any_length(spark, horizons):
    schema = "k string, pipeline_run_id string, reference_time timestamp, target_time timestamp, forecast_horizon_hours int, predicted_pm25_ug_m3 double"
    good = forecast_checks(spark.createDataFrame(run(horizons), schema), ["k"], horizons).first()
    assert good["approved"] and good["horizons_ok"]
    bad = forecast_checks(spark.createDataFrame(run(horizons, at=horizons, row={"forecast_horizon_hours": horizons + 1}), schema), ["k"], horizons).first()
    assert not bad["horizons_ok"] and not bad["approved"]
