"""Packed training references against the expanded rows they stand for, and the plans of both."""

import random
import re
from datetime import datetime, timedelta

import pyspark.sql.functions as F
import pytest

from airloom.contracts import MODEL_FEATURES, TARGET, WEATHER
from airloom.operators import training as tr
from airloom.operators.features import reference_features, target_weather_features
from airloom.operators.joins import canonical, expand_horizons
from airloom.plans import training as plans
from airloom.plans.inputs import KEY
from airloom.plans.training import candidates, split_hours

H = 6
START = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def tables(spark):
    """Two series with missing rows, null values and null weather; one has no weather at all at its end."""
    rng = random.Random(4)
    pm, sky = [], []
    for key, hours in (("a", 400), ("b", 120)):
        for i in range(hours):
            t = START + timedelta(hours=i)
            if rng.random() > 0.004:
                pm.append((key, t, None if rng.random() < 0.004 else rng.random() * 50))
            if rng.random() > 0.004 and (key == "a" or i < 90):
                sky.append((key, t, *[None if rng.random() < 0.0006 else float(rng.randint(0, 90)) for _ in WEATHER]))
    pm.append(("only", START, 1.0))
    return (
        spark.createDataFrame(pm, "location_key string, datetime_utc timestamp, pm25_ug_m3 double").cache(),
        spark.createDataFrame(sky, "location_key string, datetime_utc timestamp, " + ", ".join(f"{c} double" for c in WEATHER)).cache(),
    )


@pytest.fixture(scope="module")
def packed(tables):
    pm, sky = tables
    refs = reference_features(canonical(pm, sky, KEY, how="left"), KEY)
    return refs.cache(), tr.packed_candidates(refs, pm, sky, KEY, horizons=H).cache()


def plain_candidates(refs, pm, sky):
    """The same rows by expanding first and joining afterwards."""
    ends = pm.groupBy(*KEY).agg(F.max("datetime_utc").alias("p")).join(sky.groupBy(*KEY).agg(F.max("datetime_utc").alias("w")), KEY)
    rows = expand_horizons(refs.join(ends, KEY).filter(F.expr(f"reference_time <= least(p, w) - interval {H} hours")), H)
    labels = pm.select(*KEY, F.col("datetime_utc").alias("target_time"), F.col("pm25_ug_m3").alias(TARGET))
    on = [*KEY, "target_time"]
    out = rows.join(labels, on, "left").join(target_weather_features(sky, KEY), on, "left")
    return out.select(*KEY, "reference_time", "target_time", *MODEL_FEATURES, TARGET)


def rows_of(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def test_candidates_equal_expand_then_join(tables, packed):
    refs, some = packed
    plain = plain_candidates(refs, *tables).cache()
    assert plain.filter(F.col(TARGET).isNull()).count() > 0 and plain.filter(F.col("target_rain").isNull()).count() > 0
    assert rows_of(tr.candidate_rows(some, KEY, H)) == rows_of(plain)


def test_complete_rows_and_report_equal_row_level_versions(tables, packed):
    refs, some = packed
    plain = plain_candidates(refs, *tables).cache()
    assert rows_of(tr.complete_rows(some, KEY, H)) == rows_of(tr.complete_training_rows(plain, KEY, horizons=H))
    report = rows_of(tr.rejection_counts(some, KEY, H))
    assert report == rows_of(tr.rejection_report(plain, KEY, horizons=H))
    assert re.search(r"partial_reference_rows_removed=[1-9]", "".join(report))


def test_complete_references_are_those_of_the_training_set(tables):
    pm, sky = tables
    hours = canonical(pm, sky, KEY, how="inner")
    want = tr.labelled_references(hours, KEY, horizons=H).select(*KEY, "reference_time")
    assert rows_of(tr.complete_references(hours, KEY, horizons=H)) == rows_of(want) != []


def test_split_reports_equal_row_level_versions(tables):
    pm, sky = tables
    hours = canonical(pm, sky, KEY, how="inner")
    split = tr.split_references(hours, KEY, horizons=H)
    rows = tr.split_training_set(hours, KEY, horizons=H)
    assert rows_of(tr.describe_references(split, H)) == rows_of(tr.describe_split(rows))
    assert rows_of(tr.reference_coverage(split, H)) == rows_of(tr.horizon_coverage(rows))
    assert tr.reference_coverage(split.filter("false"), H).count() == 0


def test_no_exchange_carries_expanded_rows(spark):
    folder = "/root/testdata/sf0.001"
    some = candidates(spark, folder)
    for rows in (tr.candidate_rows(some, KEY), tr.complete_rows(some, KEY), plans._split_ids(split_hours(spark, folder))):
        plan = rows._jdf.queryExecution().executedPlan().toString().split("Subquery")[0]
        assert "Generate" in plan and plan.index("Generate") < plan.index("Exchange") if "Exchange" in plan else "Generate" in plan
    report = tr.rejection_counts(some, KEY)._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in report and "inline" not in report


def test_split_plan_is_small(spark):
    rows = plans._split_ids(split_hours(spark, "/root/testdata/sf0.001"))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= 15
