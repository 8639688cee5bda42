"""Streaming queries: run over everything available, then read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from airloom.contracts import VALUE
from airloom.plans.inputs import KEY, cte, r, table, with_ctes
from airloom.plans.registry import query
from airloom.plans.tables import deliveries, health_runs, stored
from airloom.session import scratch_path
from airloom.sources.tables import read_table, write_table
from airloom.streaming import jobs as st

# Batch twins hold the windows the final watermark has closed.
cte("mark", "SELECT MAX(ts) - INTERVAL 30 HOUR AS w FROM events")
cte(
    "closed",
    """SELECT h.location_key, h.datetime_utc, h.pm25_ug_m3 AS mean_value, h.n_events AS readings, h.datetime_utc + INTERVAL 1 HOUR AS window_end
FROM hourly h, mark WHERE h.datetime_utc + INTERVAL 1 HOUR <= w""",
    "hourly", "mark",
)


def _source(spark, folder):
    schema = table(spark, folder, "events").schema
    return st.file_stream(spark, folder, "events.parquet", schema).withColumnRenamed("event_type", "location_key")


def _hourly(spark, folder):
    return st.stream_hourly(_source(spark, folder), KEY, "ts", "value")


@query(
    "stream_hourly",
    with_ctes(
        f"""SELECT c.location_key, c.datetime_utc, {r('c.mean_value')} AS mean_value, {r('l.value')} AS last_value, c.readings FROM closed c
JOIN (SELECT event_type AS location_key, date_trunc('hour', ts) AS datetime_utc, arg_max(value, ts) AS value FROM events GROUP BY 1, 2) l USING (location_key, datetime_utc)""",
        "closed",
    ),
)
def stream_hourly(spark, folder):
    out = st.run_available(_hourly(spark, folder), scratch_path(spark, "stream-hourly"))
    return out.select(*KEY, F.col("window.start").alias("datetime_utc"), "mean_value", "last_value", "readings")


@query(
    "stream_dedupe",
    with_ctes(
        f"""SELECT user_id, datetime_utc, {r('value')} AS value FROM (
  SELECT user_id, date_trunc('hour', ts) AS datetime_utc, value, row_number() OVER (PARTITION BY user_id, date_trunc('hour', ts) ORDER BY ts DESC, event_id DESC) AS n FROM events), mark
WHERE n = 1 AND datetime_utc + INTERVAL 1 HOUR <= w""",
        "mark",
    ),
)
def stream_dedupe(spark, folder):
    rows = _source(spark, folder).withColumn("datetime_utc", F.date_trunc("hour", F.col("ts").cast("timestamp")))
    kept = st.stream_dedupe(rows, ["user_id", "datetime_utc"], "ts", ["ts", "event_id"])
    return st.run_available(kept.select("user_id", "datetime_utc", "value"), scratch_path(spark, "stream-dedupe"))


@query(
    "stream_upsert",
    with_ctes(
        f"SELECT location_key, datetime_utc, {r('value')} AS value FROM (SELECT * FROM incoming UNION ALL SELECT s.* FROM stored s ANTI JOIN incoming USING (location_key, datetime_utc))",
        "incoming", "stored",
    ),
)
def stream_upsert(spark, folder):
    path = scratch_path(spark, "stream-upsert")
    write_table(stored(spark, folder), f"{path}/table", VALUE)
    rows = deliveries(spark, folder)
    rows.write.parquet(f"{path}/feed")
    feed = st.file_stream(spark, f"{path}/feed", "*.parquet", rows.schema)
    st.run_sink(feed, st.upsert_sink(f"{path}/table", VALUE, ["sequence"]), path)
    return read_table(spark, f"{path}/table", VALUE).drop("event_date")


@query(
    "stream_rolling_24h",
    with_ctes(
        f"""SELECT location_key, e AS window_end, COUNT(*) AS hours_present, {r('CASE WHEN COUNT(*) = 24 THEN CAST(SUM(CAST(floor(mean_value * 1000000 + 0.5) AS BIGINT)) AS DOUBLE) / 1000000.0 / 24.0 END')} AS rolling_mean
FROM (SELECT location_key, mean_value, window_end + to_hours(k) AS e FROM closed, generate_series(0, 23) s(k)), mark WHERE e <= w GROUP BY 1, 2""",
        "closed", "mark",
    ),
)
def stream_rolling_24h(spark, folder):
    rolled = st.stream_rolling_24h(_hourly(spark, folder), KEY)
    out = st.run_available(rolled, scratch_path(spark, "stream-rolling"))
    return out.select(*KEY, F.col("span.end").alias("window_end"), "hours_present", "rolling_mean")


@query(
    "stream_alert_sessions",
    with_ctes(
        f"""SELECT location_key, duration_hours, {r('peak_value')} AS peak_value, episode_start_time, episode_end_time FROM (
  SELECT location_key, COUNT(*) AS duration_hours, MAX(mean_value) AS peak_value, MIN(datetime_utc) AS episode_start_time, MAX(datetime_utc) AS episode_end_time
  FROM (SELECT *, datetime_utc - to_hours(row_number() OVER (PARTITION BY location_key ORDER BY datetime_utc)) AS run FROM closed WHERE mean_value >= 35.5) GROUP BY location_key, run), mark
WHERE episode_end_time + INTERVAL 150 MINUTE <= w""",
        "closed", "mark",
    ),
)
def stream_alert_sessions(spark, folder):
    sessions = st.stream_alert_sessions(_hourly(spark, folder), KEY, 35.5)
    return st.run_available(sessions, scratch_path(spark, "stream-alerts"))


@query("stream_incidents", with_ctes("SELECT * FROM lifecycle", "lifecycle"))
def stream_incidents(spark, folder):
    """Health runs arrive in three deliveries, so the stored state carries incidents from batch to batch."""
    path = scratch_path(spark, "stream-incidents")
    runs = health_runs(spark, folder)
    limits = [None, "2024-01-11", "2024-01-21", None]
    for first, last in zip(limits[:-1], limits[1:], strict=True):
        part = runs
        if first:
            part = part.filter(F.col("observed_at") >= F.lit(first).cast("timestamp"))
        if last:
            part = part.filter(F.col("observed_at") < F.lit(last).cast("timestamp"))
        part.write.mode("append").parquet(f"{path}/feed")
        feed = st.file_stream(spark, f"{path}/feed", "*.parquet", runs.schema)
        st.run_sink(feed, st.incident_sink(path, ["system"]), path)
    return spark.read.parquet(f"{path}/events").drop("batch_id")
