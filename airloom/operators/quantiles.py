"""Exact quantiles of groups of any size by selection: counts first, then only values near a wanted rank move."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from airloom.session import materialized

OCTAVE = 64  # first slices per doubling of 1 + |value|
PARTS = 1024  # second slices, of equal width, in a first slice that holds a wanted rank
BROADCAST_ROWS = 200_000  # wanted slices are broadcast up to so many, joined beyond
_BEYOND = 1 << 20


def _slice(v: Column) -> Column:
    """Order-preserving coarse slice of any double; infinities and NaN have slices of their own."""
    size = F.floor(F.log2(F.lit(1.0) + F.abs(v)) * F.lit(float(OCTAVE)))
    return (
        F.when(F.isnan(v), F.lit(_BEYOND + 1))
        .when(F.abs(v) == F.lit(float("inf")), F.when(v > 0, F.lit(_BEYOND)).otherwise(F.lit(-_BEYOND)))
        .otherwise(F.when(v >= 0, size).otherwise(-1 - size))
        .cast("int")
    )


def _part(v: Column) -> Column:
    """Order-preserving part of a first slice between its least and greatest value."""
    share = (v - F.col("_low")) / (F.col("_high") - F.col("_low"))
    return F.when(F.col("_high") > F.col("_low"), F.floor(share * F.lit(float(PARTS))).cast("int")).otherwise(0)


def _holding(counts: DataFrame, group: Sequence[str], inner: Sequence[str], order: str, probabilities: Sequence[float]) -> DataFrame:
    """Slices that hold a wanted rank; `_before` becomes the number of values below the slice in its group."""
    running = Window.partitionBy(*group, *inner).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    placed = counts.withColumn("_before", F.col("_before") + F.coalesce(F.sum("_n").over(running), F.lit(0)))
    test = F.lit(False)
    for p in probabilities:
        at = F.lit(float(p)) * (F.col("_total") - 1)
        test = test | ((F.ceil(at) >= F.col("_before")) & (F.floor(at) < F.col("_before") + F.col("_n")))
    return placed.filter(test)


def _bounded(wanted: DataFrame) -> DataFrame:
    return F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted


def exact_quantiles(df: DataFrame, by: Sequence[str], v: str, probabilities: Mapping[str, float]) -> DataFrame:
    """Linear-interpolated quantiles per group, without gathering a group in one task.

    1. partial aggregation counts the values of each coarse slice; running counts name the slices that hold a
       wanted rank, at most two per quantile and group;
    2. those slices are cut into parts of equal width and counted again;
    3. only values of parts that hold a wanted rank are merged, shuffled and put in order.

    `df` is read three times, so callers store what is dear to derive. Nulls do not count, NaN is the greatest value.
    """
    group = [*by, "_all"]
    values = df.filter(F.col(v).isNotNull()).select(*by, F.lit(0).alias("_all"), F.col(v).cast("double").alias("_v"))
    values = values.withColumn("_slice", _slice(F.col("_v")))
    ranks = list(probabilities.values())
    counts = values.groupBy(*group, "_slice").agg(F.count("*").alias("_n"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    counts = counts.withColumns({"_total": F.sum("_n").over(Window.partitionBy(*group)), "_before": F.lit(0)})
    slices = materialized(_holding(counts, group, [], "_slice", ranks).drop("_n"), "wanted-slices")
    near = values.join(_bounded(slices), [*group, "_slice"]).withColumn("_part", _part(F.col("_v")))
    same = [*group, "_slice"]
    counts = near.groupBy(*same, "_part").agg(F.count("*").alias("_n"), *[F.first(c).alias(c) for c in ("_total", "_before", "_low", "_high")])
    parts = materialized(_holding(counts, group, ["_slice"], "_part", ranks).drop("_n"), "wanted-parts")
    wanted = parts.groupBy(*same, "_total", "_low", "_high").agg(F.map_from_entries(F.collect_list(F.struct("_part", "_before"))).alias("_parts"))
    held = values.join(_bounded(wanted), same).withColumn("_part", _part(F.col("_v"))).withColumn("_before", F.col("_parts")[F.col("_part")])
    merged = held.filter("_before IS NOT NULL").groupBy(*same, "_part", "_total", "_before", "_v").agg(F.count("*").alias("_n"))
    inside = Window.partitionBy(*same, "_part").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    placed = merged.withColumn("_rank", F.col("_before") + F.coalesce(F.sum("_n").over(inside), F.lit(0)))

    def order_statistic(rank: Column) -> Column:
        return F.max(F.when((rank >= F.col("_rank")) & (rank < F.col("_rank") + F.col("_n")), F.col("_v")))

    columns = []
    for name, p in probabilities.items():
        at = F.lit(float(p)) * (F.col("_total") - 1)
        columns += [order_statistic(F.floor(at)).alias(f"_low_{name}"), order_statistic(F.ceil(at)).alias(f"_high_{name}")]
    ends = placed.groupBy(*group, "_total").agg(*columns)
    return ends.select(
        *by,
        *[
            F.when(F.col(f"_low_{name}") == F.col(f"_high_{name}"), F.col(f"_low_{name}"))
            .otherwise(F.col(f"_low_{name}") + (F.col(f"_high_{name}") - F.col(f"_low_{name}")) * (F.lit(float(p)) * (F.col("_total") - 1) - F.floor(F.lit(float(p)) * (F.col("_total") - 1))))
            .alias(name)
            for name, p in probabilities.items()
        ],
    )
