"""Pinned single-operator facts on small literal frames."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from airloom.contracts import ENGINEERED, MODEL_FEATURES, PM25, VALUE, WEATHER_TABLE
from airloom.operators.alerts import alert_episodes, assign_alerts
from airloom.operators.aqi import enrich_forecast, invalid_concentrations, pm25_to_aqi, rolling_24h
from airloom.operators.evaluate import stratified_sample
from airloom.operators.features import lag_features
from airloom.operators.joins import join_validated
from airloom.operators.monitor import classify_age, worst_status
from airloom.operators.quantiles import exact_quantiles
from airloom.operators.series import numbered_hours, with_previous
from airloom.operators.tables import classify_changes, upsert
from airloom.operators.timeline import detect_gaps, impute_short_gaps

T0 = datetime(2024, 1, 1)
SERIES = "location_key string, datetime_utc timestamp, pm25_ug_m3 double"


def series(spark, values, key="a"):
    rows = [(key, T0 + timedelta(hours=h), v) for h, v in values]
    return spark.createDataFrame(rows, SERIES)


def test_contracts_are_sound():
    for contract in (PM25, WEATHER_TABLE, ENGINEERED, VALUE):
        assert contract.problems() == []
    assert len(MODEL_FEATURES) == 56


def test_index_boundaries(spark):
    pairs = [(0.0, 0), (9.0, 50), (9.1, 51), (35.4, 100), (35.5, 101), (55.5, 151), (125.5, 201), (225.5, 301), (325.4, 500)]
    pairs += [(325.5, 500), (325.6, 500), (325.7, 501), (9.09, 50), (35.49, 100)]
    df = pm25_to_aqi(spark.createDataFrame([(v,) for v, _ in pairs], "v double"), "v")
    got = {row["v"]: row for row in df.collect()}
    assert {v: got[v]["aqi"] for v, _ in pairs} == dict(pairs)
    assert got[9.09]["pm25_ug_m3_truncated"] == 9.0
    assert got[35.49]["pm25_ug_m3_truncated"] == 35.4
    assert got[325.5]["aqi_category"] == "Beyond the AQI" and got[325.5]["is_beyond_aqi"] is False
    assert got[325.7]["is_beyond_aqi"] is True


def test_invalid_and_missing_readings(spark):
    df = spark.createDataFrame([(-1.0,), (float("inf"),), (float("-inf"),), (None,), (float("nan"),), (5.0,)], "v double")
    assert invalid_concentrations(df, "v").count() == 3
    assert pm25_to_aqi(df, "v").filter("aqi IS NOT NULL").count() == 1


@pytest.mark.parametrize(("gap", "filled"), [(1, 1), (3, 3), (4, 0)])
def test_short_gaps_only(spark, gap, filled):
    df = series(spark, [(0, 10.0), (gap + 1, 20.0)])
    out = impute_short_gaps(df, ["location_key"]).orderBy("datetime_utc").collect()
    assert sum(r["is_imputed"] for r in out) == filled
    if filled:
        assert [r["pm25_ug_m3"] for r in out] == pytest.approx(list(np.linspace(10.0, 20.0, gap + 2)))
    off = impute_short_gaps(df, ["location_key"], enabled=False)
    assert off.filter("is_imputed").count() == 0


def test_no_repair_beside_non_positive_readings(spark):
    df = series(spark, [(0, 0.0), (2, 20.0), (4, None), (5, 7.0), (6, None)])
    out = {r["datetime_utc"].hour: r for r in impute_short_gaps(df, ["location_key"]).collect()}
    assert out[1]["pm25_ug_m3"] is None
    assert out[3]["is_imputed"] and out[4]["is_imputed"]
    assert out[6]["pm25_ug_m3"] is None  # trailing gap


def test_gaps_at_both_ends_and_across_buckets(spark):
    hours = [5, 6, 900]
    df = series(spark, [(h, 1.0) for h in hours])
    out = detect_gaps(df, ["location_key"], "datetime_utc", "2024-01-01 00:00:00", str(T0 + timedelta(hours=902)))
    assert sorted(r["missing_hours"] for r in out.collect()) == [2, 5, 893]


def _run(spark, predicted=20.0):
    rows = [("a", "run", T0, T0 + timedelta(hours=h), h, predicted) for h in range(1, 73)]
    return spark.createDataFrame(
        rows,
        "location_key string, pipeline_run_id string, reference_time timestamp, target_time timestamp, "
        "forecast_horizon_hours int, predicted_pm25_ug_m3 double",
    )


@pytest.mark.parametrize(("dropped", "complete", "missing"), [(None, True, 0), (-10, False, 1)])
def test_first_rolling_window_mixes_observed_and_predicted(spark, dropped, complete, missing):
    observed = series(spark, [(h, 10.0) for h in range(-24, 1) if h != dropped])
    out = enrich_forecast(_run(spark), observed, ["location_key"]).orderBy("forecast_horizon_hours").collect()
    assert len(out) == 72
    first = out[0]
    assert first["rolling_24h_pm25_is_complete"] is complete
    assert first["rolling_24h_missing_hours"] == missing
    assert first["rolling_observed_hour_count"] == 23 - missing
    assert first["rolling_predicted_hour_count"] == 1
    assert out[-1]["rolling_24h_pm25_ug_m3"] == 20.0


def test_episodes(spark):
    active = [False, True, True, False, True, True]
    index = [80, 120, 175, 90, 250, 350]
    rows = [("a", T0 + timedelta(hours=i), i + 1, True, v, v) for i, v in enumerate(index)]
    names = {80: "Moderate", 120: "Unhealthy for Sensitive Groups", 175: "Unhealthy", 90: "Moderate", 250: "Very Unhealthy", 350: "Hazardous"}
    df = spark.createDataFrame(
        [(k, t, h, c, r, names[v]) for k, t, h, c, r, v in rows],
        "location_key string, target_time timestamp, forecast_horizon_hours int, rolling_24h_pm25_is_complete boolean, "
        "rolling_24h_pm25_aqi bigint, rolling_24h_aqi_category string",
    ).withColumn("indicative_hourly_pm25_aqi", F.lit(None).cast("bigint")).withColumn("indicative_hourly_aqi_category", F.lit(None).cast("string"))
    alerted = assign_alerts(df)
    assert [r["alert_is_active"] for r in alerted.orderBy("target_time").collect()] == active
    for per_run in (True, False):
        out = alert_episodes(alerted, ["location_key"], per_run=per_run).orderBy("episode_start_time").collect()
        assert [r["duration_hours"] for r in out] == [2, 2]
        assert [r["peak_aqi"] for r in out] == [175, 350]
        assert [r["maximum_alert_level"] for r in out] == ["WARNING", "EMERGENCY"]


def test_upsert_and_change_classes(spark):
    def rows(*pairs):
        return spark.createDataFrame([("a", T0 + timedelta(hours=h), v) for h, v in pairs], VALUE.schema)

    old = rows((0, 1.0), (1, 2.0))
    new = rows((1, 99.0), (2, 3.0), (3, 5.0)).withColumn("n", F.lit(1)).unionByName(rows((1, 1.5), (3, None)).withColumn("n", F.lit(2)))
    out = {r["datetime_utc"].hour: r["value"] for r in upsert(old, new, VALUE, ["n"]).collect()}
    assert out == {0: 1.0, 1: 1.5, 2: 3.0, 3: None}
    with pytest.raises(ValueError):
        upsert(old, new, VALUE, [])
    classes = classify_changes(rows((0, 1.0 + 1e-12), (1, None), (2, 3.0)), old, VALUE)
    assert {r["datetime_utc"].hour: r["change"] for r in classes.collect()} == {0: "unchanged", 1: "updated", 2: "inserted"}


def test_worst_status_and_limits(spark):
    df = spark.createDataFrame(
        [("x", "HEALTHY"), ("x", "UNKNOWN"), ("y", "WARNING"), ("y", "CRITICAL"), ("z", None)], "k string, status string"
    )
    got = {r["k"]: r["worst_status"] for r in worst_status(df, ["k"]).collect()}
    assert got == {"x": "UNKNOWN", "y": "CRITICAL", "z": "UNKNOWN"}
    ages = spark.createDataFrame([(3.0,), (3.001,), (6.0,), (6.5,), (None,)], "a double")
    strict = [r[0] for r in ages.select(classify_age(F.col("a"), 3, 6)).collect()]
    assert strict == ["HEALTHY", "WARNING", "WARNING", "CRITICAL", "UNKNOWN"]
    assert ages.select(classify_age(F.col("a"), 3, 6, True)).first()[0] == "AGING"


def test_bucketed_helpers_equal_plain_order(spark):
    hours = sorted(random.Random(7).sample(range(3000), 700))
    df = series(spark, [(h, float(h)) for h in hours])
    ranked = {r["pm25_ug_m3"]: r["_number"] for r in numbered_hours(df, ["location_key"], "datetime_utc").collect()}
    assert ranked == {float(h): i + 1 for i, h in enumerate(hours)}
    linked = {r["pm25_ug_m3"]: r["prev_pm25_ug_m3"] for r in with_previous(df, ["location_key"], "datetime_utc", ["pm25_ug_m3"]).collect()}
    assert linked == {float(h): (float(hours[i - 1]) if i else None) for i, h in enumerate(hours)}
    lags = {r["pm25_ug_m3"]: r["pm25_lag_24h"] for r in lag_features(df, ["location_key"], "datetime_utc", "pm25_ug_m3").collect()}
    assert lags == {float(h): (float(h - 24) if h - 24 in hours else None) for h in hours}


def test_exact_quantiles_match_numpy(spark):
    rng = random.Random(3)
    rows = [("hot", float(rng.choice([1, 2, 2, 2, 3]))) for _ in range(3000)] + [("rare", rng.random()) for _ in range(501)] + [("one", 4.0)]
    out = exact_quantiles(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", {"p50": 0.5, "p99": 0.99})
    for r in out.collect():
        values = [v for k, v in rows if k == r["k"]]
        assert r["p50"] == pytest.approx(np.percentile(values, 50), abs=1e-12)
        assert r["p99"] == pytest.approx(np.percentile(values, 99), abs=1e-12)


def test_join_guard_fails_on_duplicates(spark):
    left = spark.createDataFrame([(1,)], "k int")
    right = spark.createDataFrame([(1, 2), (1, 3)], "k int, v int")
    with pytest.raises(Exception, match="duplicate join keys"):
        join_validated(left, right, ["k"], "left", "many_to_one").collect()


def test_sample_size_per_group(spark):
    df = spark.range(1000).withColumn("g", F.col("id") % 2)
    out = stratified_sample(df, ["g"], 40, 1, ["id"]).groupBy("g").count().collect()
    assert {r["count"] for r in out} == {40}


def test_rolling_mean_needs_every_hour(spark):
    df = series(spark, [(h, 2.0) for h in range(30) if h != 3]).withColumn("pm25_source", F.lit("observed"))
    out = rolling_24h(df, ["location_key"], "datetime_utc")
    assert out.filter("rolling_24h_pm25_is_complete").count() == 3


def test_nan_and_infinity_are_missing(spark):
    from airloom.operators.clean import clean_measurements, range_violations
    from airloom.operators.features import rolling_means

    nan, inf = float("nan"), float("inf")
    df = series(spark, enumerate([10.0, nan, 20.0, 30.0, inf, inf, 1.0]))
    means = {r["datetime_utc"].hour: r["pm25_mean_3h"] for r in rolling_means(df, ["location_key"], "datetime_utc", "pm25_ug_m3", windows=(3,)).collect()}
    assert all(v is None for v in means.values())
    filled = {r["datetime_utc"].hour: r["pm25_ug_m3"] for r in impute_short_gaps(series(spark, [(0, 10.0), (1, nan), (2, 20.0)]), ["location_key"]).collect()}
    assert filled == {0: 10.0, 1: 15.0, 2: 20.0}
    clean = clean_measurements(df, "pm25_ug_m3").collect()
    assert sorted(r["pm25_ug_m3"] for r in clean if r["pm25_ug_m3"]) == [1.0, 10.0, 20.0, 30.0]
    rules = [("too_low", "pm25_ug_m3", "< 0"), ("too_high", "pm25_ug_m3", "> 500")]
    counted = range_violations(series(spark, [(0, nan), (1, 5.0), (2, inf)]), ["location_key"], "datetime_utc", ["pm25_ug_m3"], rules).first()
    assert (counted["null_values"], counted["infinite_values"], counted["too_high"], counted["too_low"]) == (1, 1, 1, 0)


def test_redaction_reaches_every_depth(spark):
    from airloom.operators.clean import redact_fields

    deep = "x"
    for _ in range(9):
        deep = '{"a":[[' + (deep if deep != "x" else '{"pass\\u0077ord":"LEAK","y":1}') + "]]}"
    texts = [deep, "plain password: LEAK-free", None, '{"secret":{"a":"LEAK"},"b":[1,"}"]}', '["token", {"Access-Token" : ["LEAK"]}]', "{}", '{"password":"LEAK']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    out = [r["t"] for r in redact_fields(df, "t").orderBy("i").collect()]
    assert "LEAK" not in out[0] and '"y":1' in out[0]
    assert out[1] == texts[1] and out[2] is None
    assert out[3] == '{"secret":"[REDACTED]","b":[1,"}"]}'
    assert out[4] == '["token",{"Access-Token":"[REDACTED]"}]'
    assert out[5] == "{}"


def test_constant_actuals(spark):
    from airloom.operators.evaluate import regression_metrics

    df = spark.createDataFrame([("same", 5.0, 5.0), ("same", 5.0, 5.0), ("off", 5.0, 6.0), ("off", 5.0, None), ("off", 5.0, 5.0)], "k string, y double, p double")
    out = {r["k"]: r for r in regression_metrics(df, "y", "p", ["k"]).collect()}
    assert out["same"]["r2"] == 1.0 and out["off"]["r2"] == 0.0 and out["off"]["sample_count"] == 2


def test_digest_tells_rows_apart(spark):
    from airloom.operators.tables import row_digest

    rows = [("x|y", T0, 1.0), ("x", T0, 1.0), (None, T0, 1.0), ("~", T0, 1.0), ("<null>", T0, 1.0), ("x", T0, 1e19), ("x", T0, float("nan")), ("x", T0, None)]
    df = spark.createDataFrame(rows, VALUE.schema)
    assert df.select(row_digest(VALUE).alias("h")).distinct().count() == len(rows)


def test_hourly_payloads(spark):
    from airloom.sources.payloads import explode_hourly_arrays, rejected_payloads

    texts = ['{"hourly":{"time":["2024-01-01T00:00","2024-01-01T01:00"],"v":[1.5,"bad"]}}', '{"hourly":{"time":["2024-01-01T00:00","never"],"v":[1,2]}}', '{"hourly":{"time":["2024-01-01T00:00"],"v":[1,2]}}', "broken", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    assert [(r["i"], r["v"]) for r in explode_hourly_arrays(df, "t", ["v"], ["i"]).orderBy("datetime_utc").collect()] == [(0, 1.5), (0, None)]
    assert [r["i"] for r in rejected_payloads(df, "t", ["v"], ["i"]).orderBy("i").collect()] == [1, 2, 3, 4]
