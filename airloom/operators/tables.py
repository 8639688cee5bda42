"""Incremental feature tables: upsert, change classes, sync, parity and digests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airloom.contracts import Contract
from airloom.functions.hours import floor_hour, hour_index, plus_hours
from airloom.functions.numbers import reading
from airloom.operators.clean import dedupe
from airloom.operators.series import attach_per_key
from airloom.operators.timeline import detect_gaps

LINEAGE = ("pipeline_run_id", "retrieved_at_utc")
TOLERANCE = 1e-9


def normalize_keys(df: DataFrame, contract: Contract) -> DataFrame:
    """Trimmed string keys, integer ids, event time floored to the hour."""
    kinds = {n: k for n, k, _ in contract.columns}
    columns = {}
    for name in contract.primary_key:
        columns[name] = F.col(name).cast("bigint") if kinds[name] == "bigint" else F.trim(F.col(name).cast("string"))
    columns[contract.event_time] = floor_hour(contract.event_time)
    return df.withColumns(columns)


def upsert(existing: DataFrame, incoming: DataFrame, contract: Contract, order_by: Sequence[str]) -> DataFrame:
    """Existing rows not redelivered plus the incoming rows, the last delivery of each key by `order_by` winning.

    `order_by` names columns of `incoming` that tell the order of arrival, such as a sequence number; a value never
    decides which delivery is the last, so a correction downwards or to null holds.

    The stored table is unique by contract, so it needs no re-sort: an anti-join
    against the incoming keys is enough, and AQE broadcasts that side when small.
    """
    key = contract.logical_key
    fresh = last_deliveries(incoming, contract, order_by)
    kept = normalize_keys(existing, contract).select(*contract.names).join(fresh.select(*key), key, "left_anti")
    return kept.unionByName(fresh)


def last_deliveries(incoming: DataFrame, contract: Contract, order_by: Sequence[str]) -> DataFrame:
    """Contract columns of the last delivery of each key."""
    if not order_by:
        raise ValueError("order_by must name the order of arrival")
    fresh = normalize_keys(incoming.select(*contract.names, *[c for c in order_by if c not in contract.names]), contract)
    return dedupe(fresh, contract.logical_key, list(order_by)).select(*contract.names)


def _changed(kind: str, a: Column, b: Column) -> Column:
    if kind == "double":
        both_null = a.isNull() & b.isNull()
        return ~both_null & ~F.coalesce(F.abs(a - b) <= TOLERANCE, F.lit(False))
    return ~a.eqNullSafe(b)


def classify_changes(candidate: DataFrame, existing: DataFrame, contract: Contract) -> DataFrame:
    """Candidate rows with `change` = inserted / updated / unchanged.

    Lineage columns are ignored, two nulls are equal, doubles may differ by 1e-9.
    """
    key = contract.logical_key
    compared = [(n, k) for n, k, _ in contract.columns if n not in key and n not in LINEAGE]
    c, e = normalize_keys(candidate, contract), normalize_keys(existing, contract)
    stored = e.select(*key, F.struct(*[n for n, _ in compared]).alias("_old"))
    changed = F.lit(False)
    for name, kind in compared:
        changed = changed | _changed(kind, F.col(name), F.col("_old")[name])
    joined = c.join(stored, key, "left")
    return joined.withColumn(
        "change",
        F.when(F.col("_old").isNull(), F.lit("inserted")).when(changed, F.lit("updated")).otherwise(F.lit("unchanged")),
    ).drop("_old")


def incremental_start(
    stored: DataFrame, local: DataFrame, keys: Sequence[str], t: str, overlap: int = 30, lookback: int = 168
) -> DataFrame:
    """Inclusive start per key: the stored end minus the overlap, or a first-load lookback."""
    bounds = local.groupBy(*keys).agg(F.min(floor_hour(t)).alias("local_start"), F.max(floor_hour(t)).alias("local_end"))
    last = stored.groupBy(*keys).agg(F.max(floor_hour(t)).alias("latest_stored"))
    start = F.when(F.col("latest_stored").isNotNull(), plus_hours("latest_stored", -overlap)).otherwise(
        plus_hours("local_end", -(lookback - 1))
    )
    return bounds.join(last, list(keys), "left").select(
        *keys, "local_start", "local_end", "latest_stored", F.greatest("local_start", start).alias("start_time")
    )


def sync_candidates(local: DataFrame, stored: DataFrame, contract: Contract, keys: Sequence[str], overlap: int = 30, lookback: int = 168) -> DataFrame:
    """Local rows from each key's incremental start on."""
    t = contract.event_time
    start = incremental_start(stored, local, keys, t, overlap, lookback).select(*keys, "start_time")
    return attach_per_key(local, start, keys, t).filter(F.col(t) >= F.col("start_time")).drop("start_time")


def sync_report(
    local: DataFrame, existing: DataFrame, contract: Contract, keys: Sequence[str], overlap: int = 30, lookback: int = 168
) -> DataFrame:
    """Candidate, existing and change counts per key of one incremental run."""
    t = contract.event_time
    candidates = sync_candidates(local, existing, contract, keys, overlap, lookback)
    classes = classify_changes(candidates, existing, contract)
    per_key = classes.groupBy(*contract.logical_key).agg(
        F.count("*").alias("_n"),
        *[F.count_if(F.col("change") == c).alias(f"_{c}") for c in ("inserted", "updated", "unchanged")],
    )
    report = per_key.groupBy(*keys).agg(
        F.sum("_n").alias("candidate_rows"),
        F.sum("_inserted").alias("inserted_rows"),
        F.sum("_updated").alias("updated_rows"),
        F.sum("_unchanged").alias("unchanged_rows"),
        F.sum(F.col("_n") - 1).alias("duplicate_rows"),
        F.min(t).alias("first_candidate"),
        F.max(t).alias("last_candidate"),
    )
    stored = existing.groupBy(*keys).agg(F.count("*").alias("existing_rows"))
    return report.join(stored, list(keys), "left").withColumn("existing_rows", F.coalesce("existing_rows", F.lit(0)))


def latest_event_time(df: DataFrame, keys: Sequence[str], t: str) -> DataFrame:
    """Newest event hour per key by one partial aggregate."""
    return df.groupBy(*keys).agg(F.max(t).alias("latest_event_time"))


def backfill_report(
    candidate: DataFrame, existing: DataFrame, contract: Contract, keys: Sequence[str], start: str, end: str
) -> DataFrame:
    """Change counts and missing intervals per key over an inclusive range."""
    t = contract.event_time
    inside = F.col(t).between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp"))
    rows = candidate.filter(inside)
    classes = classify_changes(rows, existing.filter(inside), contract).groupBy(*keys).agg(
        F.count("*").alias("candidate_rows"),
        *[F.count_if(F.col("change") == c).alias(f"{c}_rows") for c in ("inserted", "updated", "unchanged")],
    )
    gaps = detect_gaps(rows, keys, t, start, end).groupBy(*keys).agg(
        F.count("*").alias("missing_intervals"),
        F.sum("missing_hours").alias("missing_hours"),
        F.max("missing_hours").alias("longest_gap_hours"),
    )
    filled = ("missing_intervals", "missing_hours", "longest_gap_hours")
    return classes.join(gaps, list(keys), "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in filled})


def dataset_parity(a: DataFrame, b: DataFrame, keys: Sequence[str], tolerance: float = 1e-8) -> DataFrame:
    """One row per shared column: mismatching rows and largest difference, plus table-level facts.

    Tables bucketed by the key (`write_bucketed`) meet without a shuffle.
    A single full outer join on the key feeds one wide aggregate that is then unpivoted. Repeated keys of either side
    count as duplicates; the largest difference is over finite ones.
    """
    shared = [c for c in a.columns if c in b.columns and c not in keys]
    kinds = dict(a.dtypes)
    numeric = ("double", "float", "int", "bigint", "smallint", "tinyint")
    left = a.groupBy(*keys).agg(F.count("*").alias("_n"), F.max(F.struct(*shared)).alias("_a"))
    right = b.groupBy(*keys).agg(F.count("*").alias("_m"), F.max(F.struct(*shared)).alias("_b"))
    joined = left.join(right, list(keys), "full")
    both = F.col("_n").isNotNull() & F.col("_m").isNotNull()
    parts = []
    for c in shared:
        x, y = F.col("_a")[c], F.col("_b")[c]
        if kinds[c] in numeric:
            difference = F.abs(x.cast("double") - y.cast("double"))
            close = difference <= F.lit(tolerance) + F.lit(tolerance) * F.abs(y.cast("double"))
            same = (x.isNull() & y.isNull()) | x.eqNullSafe(y) | (reading(difference).isNotNull() & F.coalesce(close, F.lit(False)))
            worst = F.coalesce(F.max(F.when(both, reading(difference))), F.lit(0.0))
        else:
            same, worst = x.eqNullSafe(y), F.lit(0.0)
        parts.append(
            F.struct(
                F.lit(c).alias("column_name"),
                F.count_if(both & ~same).alias("mismatched_rows"),
                worst.alias("max_abs_difference"),
            )
        )
    facts = joined.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("left_rows"),
        F.coalesce(F.sum("_m"), F.lit(0)).alias("right_rows"),
        F.count_if(F.col("_m").isNull()).alias("left_only_keys"),
        F.count_if(F.col("_n").isNull()).alias("right_only_keys"),
        (F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)) + F.coalesce(F.sum(F.col("_m") - 1), F.lit(0))).alias("duplicate_keys"),
        F.array(*parts).alias("_columns"),
    )
    missing = ", ".join(c for c in a.columns if c not in b.columns)
    extra = ", ".join(c for c in b.columns if c not in a.columns)
    out = facts.withColumn("_c", F.explode("_columns")).drop("_columns")
    matches = (
        (F.col("left_rows") == F.col("right_rows"))
        & (F.col("left_only_keys") == 0)
        & (F.col("right_only_keys") == 0)
        & (F.col("duplicate_keys") == 0)
        & (F.col("_c.mismatched_rows") == 0)
        & F.lit(not missing and not extra)
    )
    return out.select(
        "_c.column_name", "_c.mismatched_rows", "_c.max_abs_difference", "left_rows", "right_rows",
        "left_only_keys", "right_only_keys", "duplicate_keys",
        F.lit(missing).alias("missing_columns"), F.lit(extra).alias("additional_columns"), matches.alias("matches"),
    )


def feature_parity(
    expected: DataFrame, generated: DataFrame, keys: Sequence[str], columns: Sequence[str], rtol: float = 1e-7, atol: float = 1e-8
) -> DataFrame:
    """Per feature: do training and serving agree, with largest and mean difference."""
    right = generated.select(*keys, F.struct(*columns).alias("_g"))
    joined = expected.select(*keys, *columns).join(right, list(keys))
    parts = []
    for c in columns:
        x, y = F.col(c).cast("double"), F.col("_g")[c].cast("double")
        difference = F.abs(x - y)
        close = (x.isNull() & y.isNull()) | F.coalesce(difference <= F.lit(atol) + F.lit(rtol) * F.abs(x), F.lit(False))
        parts.append(
            F.struct(
                F.lit(c).alias("feature"),
                F.coalesce(F.bool_and(close), F.lit(True)).alias("matches"),
                F.coalesce(F.max(difference), F.lit(0.0)).alias("max_abs_difference"),
                F.coalesce(F.avg(difference), F.lit(0.0)).alias("mean_abs_difference"),
            )
        )
    return joined.agg(F.count("*").alias("compared_rows"), F.array(*parts).alias("_f")).select(
        "compared_rows", F.inline("_f")
    )


def row_digest(contract: Contract) -> Column:
    """SHA-256 of a row's canonical text: doubles at ten decimals, times in ISO form.

    Every part is led by its length and a null is a bare mark, so no text can stand for another row. Doubles that
    ten decimals cannot hold, NaN and infinities appear as Spark prints them.
    """
    texts = []
    for name, kind, _ in contract.columns:
        c = F.col(name)
        if kind == "double":
            c = F.when(F.abs(c) < 1e17, c.try_cast("decimal(28,10)").cast("string")).otherwise(c.cast("string"))
        elif kind == "timestamp":
            c = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
        else:
            c = c.cast("string")
        texts.append(F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), c), F.lit("~")))
    return F.sha2(F.concat(*texts), 256)


def _digest_words() -> list[Column]:
    return [F.conv(F.substring("_h", 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)").alias(f"_w{i}") for i in range(4)]


def dataset_digest(df: DataFrame, contract: Contract, by: Sequence[str] = ()) -> DataFrame:
    """Order-independent content digest, overall or per group.

    Row hashes are added as four 60-bit words, so the digest is a plain sum:
    partial aggregation does the work and no group is ever gathered or sorted.
    """
    sums = df.withColumn("_h", row_digest(contract)).select(*by, *_digest_words()).groupBy(*by).agg(
        F.count("*").alias("row_count"), *[F.sum(f"_w{i}").alias(f"_w{i}") for i in range(4)]
    )
    text = F.concat_ws("|", F.col("row_count").cast("string"), *[
        F.coalesce(F.col(f"_w{i}").cast("string"), F.lit("0")) for i in range(4)
    ])
    return sums.select(*by, "row_count", F.sha2(text, 256).alias("content_sha256"))


def migration_checks(source: DataFrame, target: DataFrame, contract: Contract) -> DataFrame:
    """Seven checks of a copied table, one row each: a side is read once and reduced to one row a key, then both meet.

    Count, time range and digest words of a key travel together, so one key join and one aggregate give all seven.
    Tables bucketed by the logical key (`write_bucketed`) meet without a shuffle. The content digests are equal if the
    row counts and the four digest sums are.
    """
    key, t = contract.logical_key, contract.event_time

    def side(df: DataFrame, p: str) -> DataFrame:
        hashed = df.withColumn("_h", row_digest(contract)).select(*key, F.col(t).alias("_t"), *_digest_words())
        return hashed.groupBy(*key).agg(
            F.count("*").alias(f"{p}n"), F.min("_t").alias(f"{p}min"), F.max("_t").alias(f"{p}max"),
            *[F.sum(f"_w{i}").alias(f"{p}w{i}") for i in range(4)],
        )

    def total(c: Column) -> Column:
        return F.coalesce(F.sum(c), F.lit(0))

    joined = side(source, "s").join(side(target, "t"), key, "full").agg(
        *[total(F.col(f"{p}n")).alias(f"{p}_rows") for p in "st"],
        *[total(F.col(f"{p}n") - 1).alias(f"{p}_dup") for p in "st"],
        *[F.min(f"{p}min").alias(f"{p}_min") for p in "st"],
        *[F.max(f"{p}max").alias(f"{p}_max") for p in "st"],
        F.count_if(~F.col("sn").eqNullSafe(F.col("tn"))).alias("_d"),
        *[F.array(*[total(F.col(f"{p}w{i}")) for i in range(4)]).alias(f"{p}_words") for p in "st"],
    )
    checks = {
        "row_count_matches": F.col("s_rows") == F.col("t_rows"),
        "columns_match": F.lit(source.columns == target.columns),
        "logical_keys_match": F.col("_d") == 0,
        "event_time_range_matches": F.col("s_min").eqNullSafe(F.col("t_min")) & F.col("s_max").eqNullSafe(F.col("t_max")),
        "source_has_no_duplicate_keys": F.col("s_dup") == 0,
        "target_has_no_duplicate_keys": F.col("t_dup") == 0,
        "content_digest_matches": (F.col("s_rows") == F.col("t_rows")) & (F.col("s_words") == F.col("t_words")),
    }
    listed = F.array(*[F.struct(F.lit(n).alias("check_name"), c.alias("passed")) for n, c in checks.items()])
    return joined.select(F.inline(listed))
