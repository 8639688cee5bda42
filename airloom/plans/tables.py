"""Incremental table and monitoring queries."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import functions as F

from airloom.contracts import REFERENCE_FEATURES, VALUE
from airloom.operators import monitor as mo
from airloom.operators import tables as tb
from airloom.plans.inputs import AS_OF, KEY, cte, events, hourly, r, references, with_ctes
from airloom.plans.registry import query
from airloom.session import scratch_path
from airloom.sources.tables import latest_stored, write_table

# The stored table ends five days early; the new delivery overlaps it by 30 hours
# and corrects the hours that saw several events.
STORED_END = "2024-01-25 00:00:00"
_VALUE = "SELECT location_key, datetime_utc, pm25_ug_m3 AS value FROM hourly"
cte("stored", f"{_VALUE} WHERE datetime_utc <= TIMESTAMP '{STORED_END}'", "hourly")
cte("local_rows", "SELECT location_key, datetime_utc, CASE WHEN n_events > 3 THEN pm25_ug_m3 + 0.5 ELSE pm25_ug_m3 END AS value FROM hourly", "hourly")
cte(
    "starts",
    """SELECT l.location_key, l.a AS local_start, l.b AS local_end, s.m AS latest_stored,
  greatest(l.a, CASE WHEN s.m IS NOT NULL THEN s.m - INTERVAL 30 HOUR ELSE l.b - INTERVAL 167 HOUR END) AS start_time
FROM (SELECT location_key, MIN(datetime_utc) AS a, MAX(datetime_utc) AS b FROM local_rows GROUP BY 1) l LEFT JOIN (SELECT location_key, MAX(datetime_utc) AS m FROM stored GROUP BY 1) s USING (location_key)""",
    "stored", "local_rows",
)
cte("incoming", "SELECT l.* FROM local_rows l JOIN starts USING (location_key) WHERE l.datetime_utc >= start_time", "local_rows", "starts")
cte(
    "changes",
    """SELECT i.*, CASE WHEN s.location_key IS NULL THEN 'inserted' WHEN (i.value IS NULL AND s.value IS NULL) OR abs(i.value - s.value) <= 1e-9 THEN 'unchanged' ELSE 'updated' END AS change
FROM incoming i LEFT JOIN stored s USING (location_key, datetime_utc)""",
    "incoming", "stored",
)


@lru_cache(maxsize=8)
def stored(spark, folder):
    return hourly(spark, folder).filter(F.col("datetime_utc") <= F.lit(STORED_END).cast("timestamp")).select(
        *KEY, "datetime_utc", F.col("pm25_ug_m3").alias("value")
    )


@lru_cache(maxsize=8)
def local_rows(spark, folder):
    v = F.when(F.col("n_events") > 3, F.col("pm25_ug_m3") + 0.5).otherwise(F.col("pm25_ug_m3"))
    return hourly(spark, folder).select(*KEY, "datetime_utc", v.alias("value"))


@lru_cache(maxsize=8)
def incoming(spark, folder):
    return tb.sync_candidates(local_rows(spark, folder), stored(spark, folder), VALUE, KEY)


def deliveries(spark, folder):
    """Every hour arrives twice: a higher value first, then the right one."""
    rows = incoming(spark, folder)
    early = rows.withColumn("value", F.coalesce("value", F.lit(0.0)) + 1000.0)
    return early.withColumn("sequence", F.lit(1)).unionByName(rows.withColumn("sequence", F.lit(2)))


@query("incremental_start", with_ctes("SELECT * FROM starts", "starts"))
def incremental_start(spark, folder):
    return tb.incremental_start(stored(spark, folder), local_rows(spark, folder), KEY, "datetime_utc")


@query(
    "upsert",
    with_ctes(
        f"SELECT location_key, datetime_utc, {r('value')} AS value FROM (SELECT * FROM incoming UNION ALL SELECT s.* FROM stored s ANTI JOIN incoming USING (location_key, datetime_utc))",
        "incoming", "stored",
    ),
)
def upsert(spark, folder):
    return tb.upsert(stored(spark, folder), deliveries(spark, folder), VALUE, ["sequence"])


@query("classify_changes", with_ctes(f"SELECT location_key, datetime_utc, {r('value')} AS value, change FROM changes", "changes"))
def classify_changes(spark, folder):
    return tb.classify_changes(incoming(spark, folder), stored(spark, folder), VALUE)


@query(
    "sync_report",
    with_ctes(
        """SELECT location_key, COUNT(*) AS candidate_rows, COUNT(CASE WHEN change = 'inserted' THEN 1 END) AS inserted_rows, COUNT(CASE WHEN change = 'updated' THEN 1 END) AS updated_rows,
  COUNT(CASE WHEN change = 'unchanged' THEN 1 END) AS unchanged_rows, COUNT(*) - COUNT(DISTINCT datetime_utc) AS duplicate_rows, MIN(datetime_utc) AS first_candidate, MAX(datetime_utc) AS last_candidate,
  (SELECT COUNT(*) FROM stored s WHERE s.location_key = c.location_key) AS existing_rows FROM changes c GROUP BY location_key""",
        "changes", "stored",
    ),
)
def sync_report(spark, folder):
    return tb.sync_report(local_rows(spark, folder), stored(spark, folder), VALUE, KEY)


@query("latest_event_time", "SELECT event_type AS location_key, MAX(ts) AS latest_event_time FROM events GROUP BY 1")
def latest_event_time(spark, folder):
    return tb.latest_event_time(events(spark, folder).withColumnRenamed("event_type", "location_key"), KEY, "ts")


@query("latest_stored_time", "SELECT event_type AS location_key, MAX(ts) AS latest_event_time FROM events GROUP BY 1")
def latest_stored_time(spark, folder):
    """The events as a stored table by type and day; only the newest day of each type is read back."""
    rows = events(spark, folder).select(F.col("event_type").alias("location_key"), F.col("ts").alias("datetime_utc"), "value")
    path = scratch_path(spark, "events-by-day")
    write_table(rows, path, VALUE, KEY)
    return latest_stored(spark, path, VALUE, KEY)


_A, _B = "2024-01-20 00:00:00", "2024-01-28 23:00:00"


@query(
    "backfill_report",
    with_ctes(
        f"""SELECT c.location_key, COUNT(*) AS candidate_rows, COUNT(CASE WHEN s.location_key IS NULL THEN 1 END) AS inserted_rows, COUNT(CASE WHEN abs(c.value - s.value) > 1e-9 THEN 1 END) AS updated_rows,
  COUNT(CASE WHEN abs(c.value - s.value) <= 1e-9 THEN 1 END) AS unchanged_rows, COALESCE(any_value(g.n), 0) AS missing_intervals, COALESCE(any_value(g.h), 0)::BIGINT AS missing_hours, COALESCE(any_value(g.x), 0) AS longest_gap_hours
FROM local_rows c LEFT JOIN stored s USING (location_key, datetime_utc)
LEFT JOIN (SELECT location_key, COUNT(*) AS n, SUM(c) AS h, MAX(c) AS x FROM (SELECT location_key, COUNT(*) AS c FROM (
    SELECT location_key, t, t - to_hours(row_number() OVER (PARTITION BY location_key ORDER BY t)) AS run FROM (
      SELECT location_key, unnest(generate_series(TIMESTAMP '{_A}', TIMESTAMP '{_B}', INTERVAL 1 HOUR)) AS t FROM (SELECT DISTINCT location_key FROM local_rows)
      EXCEPT SELECT location_key, datetime_utc FROM local_rows)) GROUP BY location_key, run) GROUP BY 1) g ON g.location_key = c.location_key
WHERE c.datetime_utc BETWEEN TIMESTAMP '{_A}' AND TIMESTAMP '{_B}' GROUP BY c.location_key""",
        "local_rows", "stored",
    ),
)
def backfill_report(spark, folder):
    return tb.backfill_report(local_rows(spark, folder), stored(spark, folder), VALUE, KEY, _A, _B)


@query(
    "dataset_parity",
    with_ctes(
        f"""SELECT 'value' AS column_name, COUNT(CASE WHEN a.location_key IS NOT NULL AND b.location_key IS NOT NULL AND abs(a.value - b.value) > 1e-8 + 1e-8 * abs(b.value) THEN 1 END) AS mismatched_rows,
  {r('COALESCE(MAX(abs(a.value - b.value)), 0.0)')} AS max_abs_difference, COUNT(a.location_key) AS left_rows, COUNT(b.location_key) AS right_rows,
  COUNT(CASE WHEN b.location_key IS NULL THEN 1 END) AS left_only_keys, COUNT(CASE WHEN a.location_key IS NULL THEN 1 END) AS right_only_keys, 0 AS duplicate_keys, '' AS missing_columns, '' AS additional_columns, FALSE AS matches
FROM stored a FULL JOIN local_rows b ON a.location_key = b.location_key AND a.datetime_utc = b.datetime_utc""",
        "stored", "local_rows",
    ),
)
def dataset_parity(spark, folder):
    return tb.dataset_parity(stored(spark, folder), local_rows(spark, folder), [*KEY, "datetime_utc"])


def _parity_sql(name: str) -> str:
    c = f"CAST({name} AS DOUBLE)"
    b = f"CASE WHEN location_key = 'error' THEN {c} + 0.25 ELSE {c} END" if name == "pm25_current" else c
    return f"SELECT COUNT(*) AS compared_rows, '{name}' AS feature, COALESCE(bool_and(COALESCE(abs({c} - ({b})) <= 1e-8 + 1e-7 * abs({c}), TRUE)), TRUE) AS matches, {r(f'COALESCE(MAX(abs({c} - ({b}))), 0.0)')} AS max_abs_difference, {r(f'COALESCE(AVG(abs({c} - ({b}))), 0.0)')} AS mean_abs_difference FROM refs"


@query("feature_parity", with_ctes(" UNION ALL ".join(_parity_sql(c) for c in REFERENCE_FEATURES), "refs"))
def feature_parity(spark, folder):
    refs = references(spark, folder).select(*KEY, "reference_time", *REFERENCE_FEATURES)
    shifted = refs.withColumn("pm25_current", F.when(F.col("location_key") == "error", F.col("pm25_current") + 0.25).otherwise(F.col("pm25_current")))
    return tb.feature_parity(refs, shifted, [*KEY, "reference_time"], REFERENCE_FEATURES)


@query("dataset_digest", with_ctes(
    "SELECT location_key, COUNT(*) AS row_count, sha256(concat_ws('|', CAST(COUNT(*) AS VARCHAR), "
    + ", ".join(f"CAST(SUM(CAST(('0x' || substr(h, {1 + 15 * i}, 15)) AS BIGINT)::HUGEINT) AS VARCHAR)" for i in range(4))
    + ")) AS content_sha256 FROM (SELECT location_key, sha256(length(location_key) || ':' || location_key || '19:' || strftime(datetime_utc, '%Y-%m-%dT%H:%M:%S') || coalesce(length(CAST(CAST(value AS DECIMAL(28,10)) AS VARCHAR)) || ':' || CAST(CAST(value AS DECIMAL(28,10)) AS VARCHAR), '~')) AS h FROM tenths) GROUP BY 1".replace("tenths", "(SELECT location_key, datetime_utc, floor(value * 100000000.0::DOUBLE + 0.5::DOUBLE) / 100000000.0::DOUBLE AS value FROM local_rows)"),
    "local_rows",
))
def dataset_digest(spark, folder):
    # At eight decimals both engines print the same ten; a raw double may lie on the edge of two.
    rows = local_rows(spark, folder).withColumn("value", F.floor(F.col("value") * 1e8 + 0.5) / F.lit(1e8))
    return tb.dataset_digest(rows, VALUE, KEY)


@query(
    "migration_checks",
    with_ctes(
        """SELECT unnest(['row_count_matches', 'columns_match', 'logical_keys_match', 'event_time_range_matches', 'source_has_no_duplicate_keys', 'target_has_no_duplicate_keys', 'content_digest_matches']) AS check_name,
  unnest([a.n = b.n, TRUE, a.n = b.n AND k.d = 0, a.x = b.x AND a.y = b.y, a.n = a.u, b.n = b.u, a.n = b.n AND k.d = 0 AND k.v = 0]) AS passed
FROM (SELECT COUNT(*) AS n, COUNT(DISTINCT (location_key, datetime_utc)) AS u, MIN(datetime_utc) AS x, MAX(datetime_utc) AS y FROM hourly) a,
  (SELECT COUNT(*) AS n, COUNT(DISTINCT (location_key, datetime_utc)) AS u, MIN(datetime_utc) AS x, MAX(datetime_utc) AS y FROM local_rows) b,
  (SELECT COUNT(CASE WHEN h.location_key IS NULL OR l.location_key IS NULL THEN 1 END) AS d, COUNT(CASE WHEN h.pm25_ug_m3 <> l.value THEN 1 END) AS v FROM hourly h FULL JOIN local_rows l ON h.location_key = l.location_key AND h.datetime_utc = l.datetime_utc) k""",
        "hourly", "local_rows",
    ),
)
def migration_checks(spark, folder):
    source = hourly(spark, folder).select(*KEY, "datetime_utc", F.col("pm25_ug_m3").alias("value"))
    return tb.migration_checks(source, local_rows(spark, folder), VALUE)


# --- monitoring -------------------------------------------------------------------


def _age(e: str) -> str:
    return f"greatest(date_diff('microsecond', {e}, TIMESTAMP '{AS_OF}') / 3600000000.0::DOUBLE, 0.0::DOUBLE)"


_LATEST = "SELECT CAST(user_id AS VARCHAR) AS location_key, MAX(ts) AS latest_timestamp_utc FROM events GROUP BY 1"


def _users(spark, folder):
    return events(spark, folder).select(F.col("user_id").cast("string").alias("location_key"), "ts")


@query(
    "freshness_status",
    f"""SELECT location_key, latest_timestamp_utc, age_hours, CASE WHEN age_hours > 6 THEN 'CRITICAL' WHEN age_hours > 3 THEN 'WARNING' ELSE 'HEALTHY' END AS status
FROM (SELECT *, floor({_age('latest_timestamp_utc')} * 1000.0::DOUBLE + 0.5::DOUBLE) / 1000.0::DOUBLE AS age_hours FROM ({_LATEST}))""",
)
def freshness_status(spark, folder):
    return mo.freshness(_users(spark, folder), KEY, "ts", AS_OF, 3, 6)


@query(
    "freshness_status_inclusive",
    f"""SELECT location_key, latest_timestamp_utc, floor(a * 1000.0::DOUBLE + 0.5::DOUBLE) / 1000.0::DOUBLE AS age_hours, CASE WHEN a >= 13 THEN 'STALE' WHEN a >= 7 THEN 'AGING' ELSE 'FRESH' END AS status
FROM (SELECT *, {_age('latest_timestamp_utc')} AS a FROM ({_LATEST}))""",
)
def freshness_status_inclusive(spark, folder):
    return mo.freshness(_users(spark, folder), KEY, "ts", AS_OF, 7, 13, inclusive=True)


# One health run per hour for each of two systems (user ranges); event types are the components.
_STATUS = "CASE WHEN v >= 55.5 THEN 'CRITICAL' WHEN v >= 35.5 THEN 'WARNING' ELSE 'HEALTHY' END"
cte(
    "components",
    f"""SELECT CASE WHEN user_id < 50 THEN 'north' ELSE 'south' END AS system, date_trunc('hour', ts) AS observed_at, 'feed' AS category, event_type AS name, {_STATUS.replace('v ', 'MAX(value) ')} AS status
FROM events GROUP BY 1, 2, 4""",
)
cte(
    "runs",
    """SELECT system, observed_at, COUNT(j) AS unhealthy_count, CASE WHEN COUNT(j) > 0 THEN sha256('[' || string_agg(j, ',' ORDER BY category, name, status) || ']') END AS fingerprint
FROM (SELECT *, CASE WHEN status <> 'HEALTHY' THEN '{"category":"' || category || '","name":"' || name || '","status":"' || status || '"}' END AS j FROM components) GROUP BY 1, 2""",
    "components",
)
cte(
    "lifecycle",
    """SELECT system, observed_at, unhealthy_count, fingerprint, action, CASE WHEN fingerprint IS NOT NULL THEN MIN(observed_at) OVER g END AS incident_opened_at,
  CASE WHEN fingerprint IS NOT NULL THEN row_number() OVER (PARTITION BY system, stretch ORDER BY observed_at) ELSE 0 END AS occurrence_count,
  action IN ('INCIDENT_OPENED', 'INCIDENT_CHANGED', 'INCIDENT_RESOLVED') AS notification_required
FROM (SELECT *, SUM(CASE WHEN action IN ('INCIDENT_STILL_ACTIVE', 'NO_ACTIVE_INCIDENT') THEN 0 ELSE 1 END) OVER (PARTITION BY system ORDER BY observed_at) AS stretch FROM (
  SELECT *, CASE WHEN fingerprint IS NULL AND p IS NULL THEN 'NO_ACTIVE_INCIDENT' WHEN fingerprint IS NULL THEN 'INCIDENT_RESOLVED' WHEN p IS NULL THEN 'INCIDENT_OPENED'
    WHEN fingerprint = p THEN 'INCIDENT_STILL_ACTIVE' ELSE 'INCIDENT_CHANGED' END AS action
  FROM (SELECT *, lag(fingerprint) OVER (PARTITION BY system ORDER BY observed_at) AS p FROM runs)))
WINDOW g AS (PARTITION BY system, stretch)""",
    "runs",
)


@lru_cache(maxsize=8)
def components(spark, folder):
    v = F.max("value")
    return events(spark, folder).groupBy(
        F.when(F.col("user_id") < 50, F.lit("north")).otherwise(F.lit("south")).alias("system"),
        F.date_trunc("hour", "ts").alias("observed_at"),
        F.lit("feed").alias("category"),
        F.col("event_type").alias("name"),
    ).agg(F.when(v >= 55.5, F.lit("CRITICAL")).when(v >= 35.5, F.lit("WARNING")).otherwise(F.lit("HEALTHY")).alias("status"))


@lru_cache(maxsize=8)
def health_runs(spark, folder):
    rows = components(spark, folder).withColumn("run_at", F.col("observed_at"))
    return mo.incident_fingerprint(rows, ["system", "run_at"]).drop("run_at")


@lru_cache(maxsize=8)
def lifecycle(spark, folder):
    return mo.incident_lifecycle(health_runs(spark, folder), ["system"])


@query(
    "worst_status",
    with_ctes(
        """SELECT system, observed_at, COUNT(*) AS component_count, w AS worst_status, 'PRODUCTION_' || CASE WHEN w = 'HEALTHY' THEN 'HEALTHY' ELSE 'HEALTH_' || w END AS report_status
FROM (SELECT *, CASE MAX(CASE status WHEN 'HEALTHY' THEN 0 WHEN 'WARNING' THEN 2 ELSE 3 END) OVER (PARTITION BY system, observed_at) WHEN 0 THEN 'HEALTHY' WHEN 2 THEN 'WARNING' ELSE 'CRITICAL' END AS w FROM components) GROUP BY ALL""",
        "components",
    ),
)
def worst_status(spark, folder):
    return mo.worst_status(components(spark, folder), ["system", "observed_at"])


@query("incident_fingerprint", with_ctes("SELECT * FROM runs", "runs"))
def incident_fingerprint(spark, folder):
    return health_runs(spark, folder)


@query("incident_lifecycle", with_ctes("SELECT * FROM lifecycle", "lifecycle"))
def incident_lifecycle(spark, folder):
    return lifecycle(spark, folder)


def _notices(spark, folder):
    return lifecycle(spark, folder).filter("notification_required").select(
        F.col("action").alias("notification_type"),
        F.concat("system", F.lit("_"), F.date_format("observed_at", "yyyyMMddHH")).alias("incident_id"),
        F.when(F.col("action") != "INCIDENT_RESOLVED", F.concat(F.lit("history/"), "fingerprint")).alias("history_path"),
        "system",
        "observed_at",
    )


@query(
    "pending_notifications",
    with_ctes(
        """SELECT lower(action) || '_' || substr(sha256('{"history_path":' || COALESCE('"history/' || fingerprint || '"', 'null') || ',"incident_id":"' || system || '_' || strftime(observed_at, '%Y%m%d%H') || '","notification_type":"' || action || '"}'), 1, 20) AS notification_id,
  action AS notification_type, system || '_' || strftime(observed_at, '%Y%m%d%H') AS incident_id, 'history/' || fingerprint AS history_path, system, observed_at
FROM lifecycle WHERE notification_required AND observed_at >= TIMESTAMP '2024-01-15' AND NOT (action = 'INCIDENT_RESOLVED' AND system = 'north')""",
        "lifecycle",
    ),
)
def pending_notifications(spark, folder):
    """Older notices were delivered; the resolved ones of one system are queued already."""
    rows = _notices(spark, folder)
    named = rows.withColumn("notification_id", mo.notification_id())
    receipts = named.filter(F.col("observed_at") < F.lit("2024-01-15").cast("timestamp"))
    outbox = named.filter("notification_type = 'INCIDENT_RESOLVED' AND system = 'north'")
    return mo.pending_notifications(rows, outbox, receipts)
