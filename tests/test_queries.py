"""Queries against their SQL twins, and facts about their plans."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from tests.compare import compare, connect

FOLDER = "/root/testdata/sf0.001"
SAMPLE = (
    "impute_short_gaps", "detect_gaps", "completeness_report", "alert_episodes_series", "dedupe_keep_last", "redact_fields",
    "upsert", "incident_lifecycle", "dataset_digest", "error_by_hour", "stream_hourly", "stream_incidents",
)


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", SAMPLE)
def test_matches_sql(spark, con, name):
    ok, note = compare(spark, con, name, entry.queries()[name], entry.oracle_sql().get(name), FOLDER)
    assert ok, note


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["training_set", "alert_episodes", "upsert", "per_horizon_metrics", "error_distribution"])
def test_plans_stay_in_the_engine(spark, name):
    plan = entry.queries()[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    for banned in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "ArrowEvalPython", "BatchEvalPython"):
        assert banned not in plan


def test_range_read_reaches_the_scan(spark):
    plan = entry.queries()["scan_range"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "GreaterThanOrEqual(ts" in plan
