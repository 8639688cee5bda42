"""Source, cleaning and contract queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from airloom.contracts import PM25, VALUE, WEATHER, WEATHER_ALIASES, Contract
from airloom.operators import clean as cl
from airloom.plans.inputs import KEY, cte, events, forecast, hourly, r, table, weather, with_ctes
from airloom.plans.registry import query
from airloom.sources import artifacts as ar
from airloom.sources import catalog as ct
from airloom.sources import payloads as pl
from airloom.sources.tables import scan, scan_range

# Every raw event is one delivery of its (user, hour) value; later deliveries win.
_DELIVERIES = "SELECT CAST(user_id AS VARCHAR) AS location_key, date_trunc('hour', ts) AS datetime_utc, value, ts, event_id FROM events"


def deliveries(spark, folder):
    return events(spark, folder).select(
        F.col("user_id").cast("string").alias("location_key"), F.col("ts").alias("datetime_utc"), "value", "ts", "event_id"
    )


@query(
    "scan_table",
    f"SELECT location_key, datetime_utc, value FROM (SELECT *, row_number() OVER (PARTITION BY location_key, datetime_utc ORDER BY ts DESC, event_id DESC) AS n FROM ({_DELIVERIES})) WHERE n = 1",
)
def scan_table(spark, folder):
    return scan(deliveries(spark, folder), VALUE, ["ts", "event_id"])


@query(
    "scan_range",
    "SELECT event_id, ts, event_type, value FROM events WHERE ts >= TIMESTAMP '2024-01-10 00:00:00' AND ts < TIMESTAMP '2024-01-12 00:00:00'",
)
def scan_range_query(spark, folder):
    rows = scan_range(table(spark, folder, "events"), "ts", "2024-01-10 00:00:00", "2024-01-12 00:00:00")
    return rows.select("event_id", "ts", "event_type", "value")


def measurement_payloads(spark, folder):
    """Events as nested measurement records; fields move around as real feeds do."""
    e = events(spark, folder)
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    third, fifth = F.col("event_id") % 3 == 0, F.col("event_id") % 5 == 0
    value = F.when(F.col("event_type") == "error", F.lit("n/a")).otherwise(F.col("value").cast("string"))
    record = F.to_json(
        F.struct(
            F.when(~third, value).alias("value"),
            F.struct(F.when(third, value).alias("avg")).alias("summary"),
            F.when(~fifth, F.struct(F.struct(iso.alias("utc")).alias("datetimeFrom"))).alias("period"),
            F.when(fifth, F.struct(iso.alias("utc"))).alias("datetimeFrom"),
            F.struct(F.col("event_type").alias("name"), F.lit("ug/m3").alias("units")).alias("parameter"),
            F.when(third, F.struct(F.lit(True).alias("hasFlags"))).alias("flagInfo"),
        )
    )
    return e.select("event_id", record.alias("payload"))


@query(
    "normalize_measurements",
    f"""SELECT event_id, date_trunc('second', ts) AS datetime_utc, CAST(NULL AS TIMESTAMP) AS datetime_to_utc, {r("CASE WHEN event_type <> 'error' THEN value END")} AS pm25_ug_m3_raw,
  event_type AS parameter, 'ug/m3' AS units, event_id % 3 = 0 AS has_flags FROM events""",
)
def normalize_measurements(spark, folder):
    return pl.normalize_measurements(measurement_payloads(spark, folder), "payload", ["event_id"])


def weather_payloads(spark, folder):
    """One parallel-array payload per location and day; 'error' payloads lose their last gust value."""
    day = F.date_format("datetime_utc", "yyyy-MM-dd")
    rows = weather(spark, folder).groupBy("location_key", day.alias("day")).agg(
        F.array_sort(F.collect_list(F.struct("datetime_utc", *WEATHER))).alias("_rows")
    )
    arrays = [F.col(f"_rows.{c}").alias(c) for c in WEATHER[:-1]]
    gusts = F.col(f"_rows.{WEATHER[-1]}")
    cut = F.when(F.col("location_key") == "error", F.slice(gusts, F.lit(1), F.size(gusts) - 1)).otherwise(gusts)
    time = F.transform("_rows", lambda x: F.date_format(x["datetime_utc"], "yyyy-MM-dd'T'HH:mm")).alias("time")
    payload = F.to_json(F.struct(F.struct(time, *arrays, cut.alias(WEATHER[-1])).alias("hourly")))
    return rows.select("location_key", "day", payload.alias("payload"))


@query(
    "explode_hourly_arrays",
    with_ctes(f"SELECT location_key, datetime_utc, {', '.join(WEATHER)} FROM weather WHERE location_key <> 'error'", "weather"),
)
def explode_hourly_arrays(spark, folder):
    return pl.explode_hourly_arrays(weather_payloads(spark, folder), "payload", WEATHER, KEY)


@query(
    "rejected_payloads",
    with_ctes("SELECT DISTINCT location_key, strftime(datetime_utc, '%Y-%m-%d') AS day FROM weather WHERE location_key = 'error'", "weather"),
)
def rejected_payloads(spark, folder):
    return pl.rejected_payloads(weather_payloads(spark, folder), "payload", WEATHER, ["location_key", "day"])


def sites(spark, folder):
    """Nations as monitoring sites and their suppliers as sensors, through JSON: payloads with a page of at most 50 sensors."""
    s = table(spark, folder, "supplier")
    n = table(spark, folder, "nation").withColumnRenamed("n_nationkey", "s_nationkey")
    names = F.get(F.array(*[F.lit(x) for x in ("pm25", "PM10", "o3", "no2")]), (F.col("s_suppkey") % 4).cast("int"))
    sensor = F.struct(
        F.col("s_suppkey").cast("bigint").alias("id"),
        F.col("s_name").alias("name"),
        F.struct(names.alias("name"), F.lit("ug/m3").alias("units")).alias("parameter"),
    )
    page = F.floor(F.col("s_suppkey") / 50).alias("_page")
    grouped = s.select("s_nationkey", page, sensor.alias("_s")).groupBy("s_nationkey", "_page").agg(F.collect_list("_s").alias("sensors"))
    site = F.to_json(
        F.struct(
            F.col("s_nationkey").cast("bigint").alias("id"),
            F.col("n_name").alias("name"),
            (F.col("n_regionkey") == 1).alias("isMonitor"),
            F.struct((F.col("s_nationkey") * 1.5).alias("latitude")).alias("coordinates"),
            "sensors",
        )
    )
    return ct.parse_sites(n.join(grouped, "s_nationkey", "left").select(site.alias("payload")), "payload")


_SENSOR_NAMES = "['pm25', 'pm10', 'o3', 'no2'][s_suppkey % 4 + 1]"


@query(
    "site_catalog",
    f"""SELECT n_nationkey AS location_id, n_name AS name, CAST(NULL AS VARCHAR) AS provider, n_regionkey = 1 AS is_reference_monitor, FALSE AS is_mobile, n_nationkey * 1.5::DOUBLE AS latitude,
  CAST(NULL AS DOUBLE) AS longitude, CAST(NULL AS VARCHAR) AS timezone, CAST(NULL AS VARCHAR) AS datetime_first_utc, CAST(NULL AS VARCHAR) AS datetime_last_utc,
  COALESCE(string_agg(DISTINCT p, ', ' ORDER BY p), '') AS pollutants, COUNT(s_suppkey) AS sensor_count
FROM nation LEFT JOIN (SELECT *, {_SENSOR_NAMES} AS p FROM supplier) ON s_nationkey = n_nationkey GROUP BY ALL""",
)
def site_catalog(spark, folder):
    return ct.site_catalog(sites(spark, folder))


@query(
    "sensor_candidates",
    f"""SELECT n_nationkey AS location_id, n_name AS location_name, 'Unknown provider' AS provider_name, n_regionkey = 1 AS is_reference_monitor, n_nationkey * 1.5::DOUBLE AS latitude,
  CAST(NULL AS DOUBLE) AS longitude, CAST(NULL AS VARCHAR) AS location_first_utc, CAST(NULL AS VARCHAR) AS location_last_utc, s_suppkey AS sensor_id, s_name AS sensor_name,
  p AS parameter_name, p AS parameter_display_name, 'ug/m3' AS units
FROM nation JOIN (SELECT *, {_SENSOR_NAMES} AS p FROM supplier) ON s_nationkey = n_nationkey WHERE p IN ('pm25', 'pm10')""",
)
def sensor_candidates(spark, folder):
    return ct.sensor_candidates(sites(spark, folder), ["pm25", "pm10"])


# Documents stand in for stored artefacts: name, size and checksum of their whole text.
_MANIFEST = "SELECT 'documents/' || CAST(doc_id AS VARCHAR) AS relative_path, octet_length(CAST(text AS BLOB)) AS size_bytes, sha256(text) AS sha256 FROM documents"


def _manifest(spark, folder):
    name = F.concat(F.lit("documents/"), F.col("doc_id").cast("string"))
    return ar.manifest_from(table(spark, folder, "documents"), name, F.col("text"))


@query("artifact_manifest", _MANIFEST.replace("octet_length(CAST(text AS BLOB))", "strlen(text)"))
def artifact_manifest(spark, folder):
    return _manifest(spark, folder)


@query("artifact_files")
def artifact_files(spark, folder):
    """The table files themselves through the binary source."""
    return ar.artifact_manifest(spark, folder, "*.parquet")


_ACTUAL = "SELECT 'documents/' || CAST(doc_id AS VARCHAR) AS relative_path, strlen(t) AS size_bytes, sha256(t) AS sha256 FROM (SELECT doc_id, CASE WHEN toxic = 1 THEN text || '!' WHEN quality = 0 THEN upper(text) ELSE text END AS t FROM documents JOIN labels USING (doc_id))"


@query(
    "verify_manifest",
    f"""SELECT COALESCE(e.relative_path, a.relative_path) AS relative_path, e.size_bytes AS expected_size, a.size_bytes AS actual_size,
  CASE WHEN a.relative_path IS NULL THEN 'MISSING' WHEN e.relative_path IS NULL THEN 'UNEXPECTED' WHEN e.size_bytes <> a.size_bytes THEN 'SIZE_MISMATCH' WHEN e.sha256 <> a.sha256 THEN 'CHECKSUM_MISMATCH' ELSE 'OK' END AS status
FROM ({_MANIFEST.replace("octet_length(CAST(text AS BLOB))", "strlen(text)")}) e FULL JOIN ({_ACTUAL.replace("upper(text)", "'x' || substr(text, 2)")}) a ON e.relative_path = a.relative_path""",
)
def verify_manifest(spark, folder):
    """Labelled documents stand for what was found later: some grew, some changed, unlabelled ones are gone."""
    found = table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id")
    body = F.when(F.col("toxic") == 1, F.concat("text", F.lit("!"))).when(
        F.col("quality") == 0, F.concat(F.lit("x"), F.expr("substring(text, 2)"))
    ).otherwise(F.col("text"))
    actual = ar.manifest_from(found, F.concat(F.lit("documents/"), F.col("doc_id").cast("string")), body)
    return ar.verify_manifest(_manifest(spark, folder), actual)


@query(
    "latest_run",
    """SELECT o_custkey, o_orderkey AS run_id, CAST(o_orderdate AS TIMESTAMP) AS created_at, o_orderstatus AS status FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders WHERE o_orderstatus = 'F') WHERE n = 1""",
)
def latest_run(spark, folder):
    runs = table(spark, folder, "orders").select(
        "o_custkey", F.col("o_orderkey").alias("run_id"), F.col("o_orderdate").cast("timestamp").alias("created_at"),
        F.col("o_orderstatus").alias("status"),
    )
    return ar.latest_run(runs, ["o_custkey"], approved=["F"])


@query("normalize_hours", "SELECT DISTINCT event_type, date_trunc('hour', ts) AS datetime_utc FROM events WHERE event_type <> 'error'")
def normalize_hours(spark, folder):
    text = F.when(F.col("event_type") == "error", F.lit("not a time")).otherwise(F.col("ts").cast("string"))
    return cl.normalize_hours(events(spark, folder).withColumn("stamp", text), "stamp", ["event_type"])


def _dedupe_sql(direction: str) -> str:
    return f"SELECT location_key, datetime_utc, value, event_id FROM (SELECT *, row_number() OVER (PARTITION BY location_key, datetime_utc ORDER BY ts {direction}, event_id {direction}) AS n FROM ({_DELIVERIES})) WHERE n = 1"


@query("dedupe_keep_last", _dedupe_sql("DESC"))
def dedupe_keep_last(spark, folder):
    rows = deliveries(spark, folder).withColumn("datetime_utc", F.date_trunc("hour", "ts"))
    return cl.dedupe(rows, [*KEY, "datetime_utc"], ["ts", "event_id"]).drop("ts")


@query("dedupe_keep_first", _dedupe_sql("ASC"))
def dedupe_keep_first(spark, folder):
    rows = deliveries(spark, folder).withColumn("datetime_utc", F.date_trunc("hour", "ts"))
    return cl.dedupe(rows, [*KEY, "datetime_utc"], ["ts", "event_id"], keep="first").drop("ts")


_RAW = "CASE WHEN event_type = 'error' AND value < 20 THEN 0 WHEN event_type = 'error' THEN -value ELSE value END"


def raw_readings(spark, folder):
    """Readings with zeros and negatives among the 'error' events."""
    bad = F.col("event_type") == "error"
    v = F.when(bad & (F.col("value") < 20), 0.0).when(bad, -F.col("value")).otherwise(F.col("value"))
    return events(spark, folder).select("event_id", F.col("event_type").alias("location_key"), "ts", "user_id", v.alias("raw"))


@query(
    "clean_measurements",
    f"SELECT event_id, location_key, {r('raw')} AS raw, raw = 0 AS pm25_zero_flag, raw < 0 AS pm25_negative_flag, {r('CASE WHEN raw > 0 THEN raw END')} AS pm25_ug_m3 FROM (SELECT event_id, event_type AS location_key, {_RAW} AS raw FROM events)",
)
def clean_measurements(spark, folder):
    return cl.clean_measurements(raw_readings(spark, folder).drop("ts", "user_id"), "raw")


@query("unexpected_values", "SELECT DISTINCT event_type FROM events WHERE event_type NOT IN ('view', 'click')")
def unexpected_values(spark, folder):
    return cl.unexpected_values(events(spark, folder), "event_type", ["view", "click"])


def _fetched():
    return F.lit("2024-02-01 00:00:00").cast("timestamp")


_PM25_SQL = f"""SELECT location_key, user_id AS location_id, user_id * 10 AS sensor_id, date_trunc('hour', ts) AS datetime_utc, {r('CASE WHEN raw > 0 THEN raw END')} AS pm25_ug_m3,
  CASE WHEN raw > 0 THEN 'VALID' ELSE 'MISSING' END AS pm25_quality_status, NOT (raw > 0) AS pm25_is_missing, 'feed' AS source, TIMESTAMP '2024-02-01' AS retrieved_at_utc,
  'run-1' AS pipeline_run_id, 'v1' AS source_data_version FROM (SELECT *, event_type AS location_key, {_RAW} AS raw FROM events)"""


def pm25_rows(spark, folder):
    rows = raw_readings(spark, folder).withColumnsRenamed({"ts": "datetime_utc", "raw": "value"})
    return cl.prepare_pm25_rows(rows, F.col("user_id"), F.col("user_id") * 10, "run-1", "v1", "feed", _fetched())


@query("prepare_pm25_rows", _PM25_SQL)
def prepare_pm25_rows(spark, folder):
    return pm25_rows(spark, folder)


@query(
    "prepare_weather_rows",
    with_ctes(
        "SELECT location_key, datetime_utc, "
        + ", ".join(f"{names[1]} AS {out}" for out, names in WEATHER_ALIASES.items())
        + ", 'forecast' AS source, TIMESTAMP '2024-02-01' AS retrieved_at_utc, 'run-1' AS pipeline_run_id, 'v1' AS source_data_version FROM weather",
        "weather",
    ),
)
def prepare_weather_rows(spark, folder):
    return cl.prepare_weather_rows(weather(spark, folder), "run-1", "v1", "forecast", _fetched())


@query(
    "prepare_engineered_rows",
    with_ctes(
        "SELECT DISTINCT location_key, reference_time, " + ", ".join(f"{r(c)} AS {c}" for c in ("pm25_current", "pm25_lag_24h", "pm25_mean_24h")) + " FROM forecast",
        "forecast",
    ),
)
def prepare_engineered_rows(spark, folder):
    return cl.prepare_engineered_rows(forecast(spark, folder), KEY, ["pm25_current", "pm25_lag_24h", "pm25_mean_24h"])


_PROPS = Contract(
    "event_text", 1, ("location_key",), "datetime_utc",
    (("location_key", "string", False), ("reading", "bigint", False), ("datetime_utc", "timestamp", False), ("amount", "double", True), ("flagged", "boolean", True)),
)


@query(
    "coerce_to_contract",
    f"""SELECT event_type AS location_key, CASE WHEN event_type = 'error' THEN NULL ELSE user_id END AS reading, ts AS datetime_utc, {r("CASE WHEN event_type <> 'view' THEN value END")} AS amount,
  CASE WHEN event_type = 'click' THEN TRUE WHEN event_type = 'view' THEN NULL ELSE FALSE END AS flagged,
  (event_type = 'error')::INT + (event_type = 'view')::INT + (event_type = 'view')::INT AS _coercion_errors FROM events""",
)
def coerce_to_contract(spark, folder):
    kind = F.col("event_type")
    text = events(spark, folder).select(
        kind.alias("location_key"),
        F.when(kind == "error", F.lit("unknown")).otherwise(F.col("user_id").cast("string")).alias("reading"),
        F.col("ts").cast("string").alias("datetime_utc"),
        F.when(kind == "view", F.lit("12,5")).otherwise(F.col("value").cast("string")).alias("amount"),
        F.when(kind == "click", F.lit("true")).when(kind == "view", F.lit("maybe")).otherwise(F.lit("false")).alias("flagged"),
    )
    return cl.coerce(text, _PROPS)


@query(
    "contract_violations",
    """SELECT location_key, SUM(n)::BIGINT AS row_count, COALESCE(SUM(CASE WHEN sensor_id IS NULL THEN n END), 0)::BIGINT AS null_key_rows, SUM(n - 1)::BIGINT AS duplicate_key_rows,
  'location_id, pm25_quality_status, pm25_is_missing, source, retrieved_at_utc, pipeline_run_id, source_data_version' AS missing_columns, 'event_id' AS additional_columns
FROM (SELECT location_key, sensor_id, datetime_utc, COUNT(*) AS n FROM (
  SELECT event_type AS location_key, CASE WHEN event_type = 'error' THEN NULL ELSE user_id END AS sensor_id, date_trunc('hour', ts) AS datetime_utc FROM events) GROUP BY 1, 2, 3) GROUP BY 1""",
)
def contract_violations(spark, folder):
    rows = events(spark, folder).select(
        "event_id",
        F.col("event_type").alias("location_key"),
        F.when(F.col("event_type") != "error", F.col("user_id")).alias("sensor_id"),
        F.date_trunc("hour", "ts").alias("datetime_utc"),
        F.col("value").alias("pm25_ug_m3"),
    )
    return cl.contract_violations(rows, PM25, KEY)


# Weather pushed out of its physical ranges by the readings of the same hour.
cte(
    "bad_weather",
    """SELECT w.* REPLACE (relative_humidity_2m + h.pm25_ug_m3 - 20 AS relative_humidity_2m, rain - CASE WHEN h.n_events % 2 = 0 THEN 1 ELSE 0 END AS rain,
  CASE WHEN h.n_events > 4 THEN NULL ELSE surface_pressure - h.pm25_ug_m3 * 20 END AS surface_pressure,
  CASE WHEN h.n_events = 1 THEN CAST('Infinity' AS DOUBLE) ELSE wind_gusts_10m END AS wind_gusts_10m)
FROM weather w JOIN hourly h USING (location_key, datetime_utc)""",
    "weather", "hourly",
)


def bad_weather(spark, folder):
    rows = weather(spark, folder).join(hourly(spark, folder), [*KEY, "datetime_utc"])
    v, n = F.col("pm25_ug_m3"), F.col("n_events")
    return rows.withColumns(
        {
            "relative_humidity_2m": F.col("relative_humidity_2m") + v - 20,
            "rain": F.col("rain") - F.when(n % 2 == 0, 1).otherwise(0),
            "surface_pressure": F.when(n <= 4, F.col("surface_pressure") - v * 20),
            "wind_gusts_10m": F.when(n == 1, F.lit(float("inf"))).otherwise(F.col("wind_gusts_10m")),
        }
    )


_RULES_SQL = ", ".join(f"COUNT(CASE WHEN {c} {t} THEN 1 END) AS {n}" for n, c, t in cl.RANGE_RULES)
_RULES_SUM = " + ".join(f"COUNT(CASE WHEN {c} {t} THEN 1 END)" for _, c, t in cl.RANGE_RULES)


@query(
    "range_violations",
    with_ctes(
        f"""SELECT location_key, COUNT(*) AS row_count, {_RULES_SQL}, SUM({' + '.join(f'({c} IS NULL)::INT' for c in WEATHER)})::BIGINT AS null_values,
  SUM({' + '.join(f'COALESCE(isinf({c}), FALSE)::INT' for c in WEATHER)})::BIGINT AS infinite_values, COUNT(*) - COUNT(DISTINCT datetime_utc) AS duplicate_rows,
  date_diff('hour', MIN(datetime_utc), MAX(datetime_utc)) + 1 - COUNT(DISTINCT datetime_utc) AS missing_hours, {_RULES_SUM} AS range_violations FROM bad_weather GROUP BY 1""",
        "bad_weather",
    ),
)
def range_violations(spark, folder):
    return cl.range_violations(bad_weather(spark, folder), KEY, "datetime_utc", WEATHER)


@query(
    "filter_hours_inclusive",
    with_ctes(f"SELECT location_key, datetime_utc, {r('pm25_ug_m3')} AS pm25_ug_m3 FROM hourly WHERE datetime_utc BETWEEN TIMESTAMP '2024-01-05 06:00:00' AND TIMESTAMP '2024-01-09 18:00:00'", "hourly"),
)
def filter_hours_inclusive(spark, folder):
    return cl.between_hours(hourly(spark, folder).drop("n_events"), "datetime_utc", "2024-01-05 06:00:00", "2024-01-09 18:00:00")


@query(
    "observed_window",
    with_ctes(
        "SELECT w.* FROM weather w JOIN (SELECT location_key, MAX(datetime_utc) AS m FROM hourly GROUP BY 1) h USING (location_key) WHERE w.datetime_utc <= h.m",
        "weather", "hourly",
    ),
)
def observed_window(spark, folder):
    refs = hourly(spark, folder).groupBy(*KEY).agg(F.max("datetime_utc").alias("reference_time"))
    return cl.observed_window(weather(spark, folder), refs, KEY, "datetime_utc")


def _profile_sql(c: str) -> str:
    fin = f"CASE WHEN isfinite({c}) THEN {c} END"
    return f"""SELECT location_key, '{c}' AS column_name, COUNT(*) AS row_count, COUNT(*) - COUNT({c}) AS null_count, COUNT(CASE WHEN isinf({c}) THEN 1 END) AS infinite_count,
  COUNT(CASE WHEN {c} = 0 THEN 1 END) AS zero_count, COUNT(CASE WHEN {c} < 0 THEN 1 END) AS negative_count, {r(f'MIN({fin})')} AS minimum, {r(f'MAX({fin})')} AS maximum,
  {r(f'AVG({fin})')} AS mean, {r(f'quantile_cont({fin}, 0.5)')} AS median FROM bad_weather GROUP BY 1"""


@query("column_profile", with_ctes(" UNION ALL ".join(_profile_sql(c) for c in WEATHER), "bad_weather"))
def column_profile(spark, folder):
    return cl.column_profile(bad_weather(spark, folder), KEY, WEATHER)


@query(
    "redact_fields",
    """SELECT event_id, CASE WHEN event_id % 4 = 1 THEN 'plain text, password unknown'
  WHEN event_id % 4 = 2 THEN '{"a":[[{"b":{"c":{"d":[{"e":{"Refresh-Token":"[REDACTED]","n":' || CAST(user_id AS VARCHAR) || '}}]}}}]]}'
  WHEN event_id % 4 = 3 THEN '{"password":"[REDACTED]","password":"[REDACTED]","note":"a \\" {password: 1}"}'
  ELSE '{"user":' || CAST(user_id AS VARCHAR) || ',"Api-Key":"[REDACTED]","nested":{"name":"' || event_type || '","client_secret":"[REDACTED]"},"list":[{"password":"[REDACTED]","x":' || CAST(user_id AS VARCHAR) || '}]}' END AS payload FROM events""",
)
def redact_fields(spark, folder):
    """Secrets at several depths, plain text, repeated names and names inside texts."""
    e = events(spark, folder)
    flat = F.to_json(
        F.struct(
            F.col("user_id").alias("user"),
            F.lit("k-123").alias("Api-Key"),
            F.struct(F.col("event_type").alias("name"), F.col("value").alias("client_secret")).alias("nested"),
            F.array(F.struct(F.lit("p").alias("password"), F.col("user_id").alias("x"))).alias("list"),
        )
    )
    deep = F.concat(F.lit('{"a": [[{"b": {"c": {"d": [{"e": {"Refresh-Token": {"x": [1, "]"]}, "n": '), F.col("user_id").cast("string"), F.lit("}}]}}}]]}"))
    twice = F.lit('{"password": 1, "password": [{"k": "}"}], "note": "a \\" {password: 1}"}')
    kind = F.col("event_id") % 4
    payload = F.when(kind == 1, F.lit("plain text, password unknown")).when(kind == 2, deep).when(kind == 3, twice).otherwise(flat)
    return cl.redact_fields(e.select("event_id", payload.alias("payload")), "payload")
