"""Window quality: lists of a window against plain Python, and what a window may cost."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from airloom.operators import timeline as tl
from airloom.plans.timeline import window_quality

START = datetime(2024, 1, 14, 20)  # the window crosses bucket edges
KEY = ["location_key"]


def _rows():
    """Two series with imputed and missing hours; one hour comes twice, one reading lies inside its hour."""
    rows = []
    for key, n in (("a", 60), ("b", 400)):
        for i in range(n):
            missing = i % 3 == 1
            rows.append((key, START + timedelta(hours=i), None if missing else float(i), i % 5 == 0))
    rows.append(("a", START + timedelta(hours=7), None, True))
    rows.append(("a", START + timedelta(hours=30, minutes=20), None, True))
    return rows


def _hour(t):
    return t.replace(minute=0)


def test_lists_of_windows(spark):
    rows = _rows()
    df = spark.createDataFrame(rows, "location_key string, datetime_utc timestamp, pm25_ug_m3 double, is_imputed boolean")
    plain = []
    for key, t, _, _ in rows:
        near = [r for r in rows if r[0] == key and timedelta(0) <= _hour(t) - _hour(r[1]) <= timedelta(hours=24)]
        plain.append((key, t, sorted(r[1] for r in near if r[3]), sorted(r[1] for r in near if r[2] is None)))
    columns = ["location_key", "reference_time", "imputed_timestamps", "unresolved_timestamps"]
    found = tl.window_quality(df, KEY).select(*columns).collect()
    assert sorted(tuple(r) for r in found) == sorted(plain)
    named = tl.window_quality(df, KEY, label=F.date_format("datetime_utc", "yyyy-MM-dd HH")).select(*columns).collect()
    text = [(k, t, [f"{x:%Y-%m-%d %H}" for x in a], [f"{x:%Y-%m-%d %H}" for x in b]) for k, t, a, b in plain]
    assert sorted(tuple(r) for r in named) == sorted(text)


def test_query_formats_an_hour_once(spark, tmp_path):
    """Neither sorting by an interpreted comparator nor a format for each entry of each window."""
    rows = [(i % 3, START + timedelta(hours=i), 1.0) for i in range(0, 90, 2)]
    spark.createDataFrame(rows, "user_id long, ts timestamp, value double").write.parquet(f"{tmp_path}/events.parquet")
    out = window_quality(spark, str(tmp_path))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan
    hours = [[i for i in range(0, 90, 2) if i % 3 == u] for u in range(3)]
    assert out.count() == sum(max(h) - min(h) + 1 for h in hours)
