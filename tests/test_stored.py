"""Stored tables and catalogue: newest times from partitions, bucketed checks, pages of sensors, long payloads."""

import json
import time
from datetime import datetime, timedelta
from pathlib import Path

import pytest
import pyspark.sql.functions as F

from airloom.contracts import VALUE
from airloom.operators.clean import redact_fields
from airloom.operators.tables import dataset_parity, migration_checks
from airloom.sources import catalog as ct
from airloom.sources import tables as tables
from airloom.sources.tables import latest_stored, write_bucketed, write_table

START = datetime(2024, 1, 1)


def values(spark, rows):
    return spark.createDataFrame(rows, VALUE.schema)


def hours(key, first, last):
    return [(key, START + timedelta(hours=h), float(h)) for h in range(first, last)]


def spoil(path, but):
    """Zero all data pages outside the partitions `but`; footers stay."""
    spoilt = 0
    for file in Path(path).rglob("*.parquet"):
        if str(file.parent.relative_to(path)) not in but:
            raw = file.read_bytes()
            footer = len(raw) - 8 - int.from_bytes(raw[-8:-4], "little")
            file.write_bytes(raw[:4] + bytes(footer - 4) + raw[footer:])
            (file.parent / f".{file.name}.crc").unlink()
            spoilt += 1
    return spoilt


def test_newest_time_reads_the_newest_partition_only(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "by_key")
    write_table(values(spark, hours("007", 0, 240) + hours("b", 0, 50) + [("c", None, 1.0)]), path, VALUE, ["location_key"])
    want = {"007": START + timedelta(hours=239), "b": START + timedelta(hours=49)}
    out = latest_stored(spark, path, VALUE, ["location_key"])
    spoilt = spoil(path, {"location_key=007/event_date=2024-01-10", "location_key=b/event_date=2024-01-03"})
    assert spoilt >= 11
    assert {r[0]: r[1] for r in out.collect()} == want
    with pytest.raises(Exception):
        spark.read.schema(VALUE.schema).parquet(path).agg(F.sum("value")).collect()


def test_newest_time_of_very_many_groups(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "by_key")
    write_table(values(spark, hours("007", 0, 240) + hours("b", 0, 50)), path, VALUE, ["location_key"])
    want = {"007": START + timedelta(hours=239), "b": START + timedelta(hours=49)}
    monkeypatch.setattr(tables, "PARTITIONS", 1)
    assert {r[0]: r[1] for r in latest_stored(spark, path, VALUE, ["location_key"]).collect()} == want


def test_newest_time_overall_and_of_nothing(spark, tmp_path):
    path = str(tmp_path / "days")
    write_table(values(spark, hours("a", 0, 100)), path, VALUE)
    assert latest_stored(spark, path, VALUE).first()[0] == START + timedelta(hours=99)
    empty = str(tmp_path / "empty")
    values(spark, []).withColumn("event_date", F.to_date("datetime_utc")).write.parquet(empty)
    assert [r[0] for r in latest_stored(spark, empty, VALUE).collect()] == [None]
    assert latest_stored(spark, empty, VALUE, ["location_key"]).count() == 0


def test_migration_checks_name_each_fault(spark):
    rows = hours("a", 0, 30)

    def failed(source, target):
        return {r[0] for r in migration_checks(values(spark, source), values(spark, target), VALUE).collect() if not r[1]}

    assert failed(rows, rows) == set() and failed([], []) == set()
    assert failed(rows, rows[:-1]) == {"row_count_matches", "logical_keys_match", "event_time_range_matches", "content_digest_matches"}
    assert failed(rows, rows[:-1] + [rows[-1][:2] + (5.5,)]) == {"content_digest_matches"}
    twice = failed(rows, rows + rows[:1])
    assert twice == {"row_count_matches", "logical_keys_match", "target_has_no_duplicate_keys", "content_digest_matches"}
    assert failed(rows, []) >= {"row_count_matches", "event_time_range_matches"}


def test_bucketed_tables_meet_without_a_shuffle(spark, tmp_path):
    a, b = values(spark, hours("a", 0, 200)), values(spark, hours("a", 1, 201))
    write_bucketed(a, "bucketed_a", VALUE, 4, str(tmp_path / "a"))
    write_bucketed(b, "bucketed_b", VALUE, 4, str(tmp_path / "b"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        left, right = spark.table("bucketed_a"), spark.table("bucketed_b")
        for out, plain in (
            (migration_checks(left, right, VALUE), migration_checks(a, b, VALUE)),
            (dataset_parity(left, right, VALUE.logical_key), dataset_parity(a, b, VALUE.logical_key)),
        ):
            plan = out._jdf.queryExecution().executedPlan().toString()
            assert "hashpartitioning" not in plan and plan.count("FileScan") == 2
            assert sorted(map(str, out.collect())) == sorted(map(str, plain.collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.sql("DROP TABLE bucketed_a")
        spark.sql("DROP TABLE bucketed_b")


def test_sites_come_in_pages(spark):
    def payload(sensors, **more):
        return json.dumps({"id": 1, "name": "x", "sensors": sensors, **more})

    def sensor(i, name):
        return {"id": i, "parameter": {"name": name}}

    pages = [payload([sensor(1, "PM25"), sensor(2, "o3")]), payload([sensor(3, "pm25"), sensor(4, "")]), payload(None), json.dumps({"id": 2})]
    sites = ct.parse_sites(spark.createDataFrame([(p,) for p in pages], "payload string"), "payload")
    out = {r["location_id"]: (r["pollutants"], r["sensor_count"]) for r in ct.site_catalog(sites).collect()}
    assert out == {1: ("o3, pm25", 4), 2: ("", 0)}


def test_redaction_of_long_payloads(spark):
    def payload(n):
        return json.dumps({"rows": [{"id": i, "note": "n" * 20, "api_key": {"v": [i]}} for i in range(n)]}, separators=(",", ":"))

    def run(n):
        text, begun = payload(n), time.time()
        out = redact_fields(spark.createDataFrame([(text,)], "t string"), "t").first()[0]
        return json.loads(out), time.time() - begun, len(text)

    run(100)
    out, seconds, size = run(100_000)
    assert size > 5_000_000 and seconds < 60
    assert len(out["rows"]) == 100_000 and all(r["api_key"] == "[REDACTED]" for r in out["rows"]) and out["rows"][7]["id"] == 7
