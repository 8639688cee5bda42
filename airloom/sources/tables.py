"""Feature-table reads and partitioned writes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airloom.contracts import Contract
from airloom.operators.clean import dedupe
from airloom.operators.tables import classify_changes, last_deliveries, normalize_keys

DATE = "event_date"


def scan(df: DataFrame, contract: Contract, order_by: Sequence[str]) -> DataFrame:
    """Contract columns only, event hour normalised, last delivery per logical key."""
    extra = [c for c in order_by if c not in contract.names]
    wanted = normalize_keys(df.select(*contract.names, *extra), contract)
    return dedupe(wanted, contract.logical_key, order_by).select(*contract.names)


def scan_table(spark: SparkSession, path: str, contract: Contract, order_by: Sequence[str]) -> DataFrame:
    """Read one Parquet table with its declared schema and apply `scan`."""
    return scan(spark.read.schema(contract.schema).parquet(path), contract, order_by)


def scan_range(df: DataFrame, t: str, start: str, end: str) -> DataFrame:
    """Half-open `[start, end)` read.

    Literal bounds reach the Parquet scan; a table laid out by `event_date` also
    skips whole partitions.
    """
    first, last = F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")
    if dict(df.dtypes).get(t) == "timestamp_ntz":
        first, last = F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")
    out = df.filter((F.col(t) >= first) & (F.col(t) < last))
    if DATE in df.columns:
        out = out.filter(F.col(DATE).between(F.to_date(F.lit(start)), F.to_date(F.lit(end))))
    return out


def write_table(df: DataFrame, path: str, contract: Contract, by: Sequence[str] = ()) -> None:
    """Write a feature table partitioned by event day (below the columns `by`); rows of a day stay in one task only while small."""
    dated = df.withColumn(DATE, F.to_date(contract.event_time))
    # Rebalance splits a large day over several files and merges small days.
    dated.hint("rebalance", *by, DATE).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by, DATE).parquet(path)


def read_table(spark: SparkSession, path: str, contract: Contract) -> DataFrame:
    return spark.read.parquet(path).select(*contract.names, DATE)


def read_days(spark: SparkSession, path: str, contract: Contract, days: Sequence) -> DataFrame:
    """Rows of the named days only: literal days select the stored partitions, whatever lies between them."""
    return read_table(spark, path, contract).filter(F.col(DATE).isin(list(days)))


PARTITIONS = 10_000  # newest partitions named as literals; more are found by a join


def latest_stored(spark: SparkSession, path: str, contract: Contract, by: Sequence[str] = ()) -> DataFrame:
    """Newest event time of a stored table, overall or for each value of its partition columns `by`.

    The newest days come from folder names: that step asks for no stored column, so it opens footers and no data.
    Then only the newest partition (of each group) is read. Beyond `PARTITIONS` groups all partitions since the oldest
    of the newest days are read and joined. Null times have no day and do not count; an empty table gives null
    overall and no group.
    """
    stored = spark.read.schema(contract.schema.add(DATE, "date")).parquet(path)
    newest = stored.groupBy(*by).agg(F.max(DATE).alias(DATE)).filter(F.col(DATE).isNotNull())
    name = F.to_json(F.struct(*by, DATE))
    found = [r[0] for r in newest.select(name).limit(PARTITIONS + 1).collect()]
    if len(found) <= PARTITIONS:
        # Without groups the day alone; the test reads folder names only, so it selects partitions before any file is opened.
        rows = stored.filter(name.isin(found))
    else:
        oldest = newest.agg(F.min(DATE)).first()[0]
        rows = stored.filter(F.col(DATE) >= F.lit(oldest)).join(newest, [*by, DATE], "left_semi")
    return rows.groupBy(*by).agg(F.max(contract.event_time).alias("latest_event_time"))


def write_bucketed(df: DataFrame, name: str, contract: Contract, buckets: int, path: str | None = None) -> None:
    """Catalogue table bucketed and sorted by the logical key, one file a bucket: parity and migration checks of two
    such tables with equal bucket counts need no shuffle."""
    key = contract.logical_key
    writer = df.repartition(buckets, *key).write.mode("errorifexists").bucketBy(buckets, *key).sortBy(*key)
    (writer.option("path", path) if path else writer).saveAsTable(name)


def _days(df: DataFrame, t: str) -> list:
    """Distinct event days, at most one value per day of the calendar that a delivery names."""
    return [r["day"] for r in df.select(F.to_date(t).alias("day")).distinct().collect()]


def apply_upsert(spark: SparkSession, path: str, incoming: DataFrame, contract: Contract, order_by: Sequence[str]) -> None:
    """Upsert into a stored table, rewriting only the days that changed; the last delivery by `order_by` wins.

    Changed rows are written to the shared folder first: they are read twice (touched days, merge) and must not depend
    on the files being replaced. Stored rows are read for the days of the delivery, then for the days that change, so
    one old correction among new rows costs one more day. What was staged is removed at the end.
    """
    from airloom.session import remove_path, scratch_path

    key = contract.logical_key
    fresh = last_deliveries(incoming, contract, order_by)
    delivered = _days(fresh, contract.event_time)
    if not delivered:
        return
    stored = read_days(spark, path, contract, delivered)
    changes = classify_changes(fresh, stored.drop(DATE), contract).filter("change <> 'unchanged'").select(*contract.names)
    staged_path = scratch_path(spark, "upsert")
    changes.write.parquet(f"{staged_path}/changes")
    changed = spark.read.schema(contract.schema).parquet(f"{staged_path}/changes")
    touched = read_days(spark, path, contract, _days(changed, contract.event_time))
    kept = normalize_keys(touched.drop(DATE), contract).join(changed.select(*key), key, "left_anti")
    merged = kept.select(*contract.names).unionByName(changed)
    merged.withColumn(DATE, F.to_date(contract.event_time)).write.parquet(f"{staged_path}/merged")
    ready = spark.read.parquet(f"{staged_path}/merged").select(*contract.names)
    write_table(ready, path, contract)
    remove_path(spark, staged_path)
