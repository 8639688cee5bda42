"""Windows over long series without a single task per key.

A location may own a third of all rows, so no window is partitioned by the key
alone. Time is cut into buckets:

* bounded frames (lags, rolling means, look-ahead) copy the few rows near a
  bucket edge into the neighbour bucket (`halo`) and window over (key, bucket);
* running numbers (`numbered`) are local numbers plus the prefix sum of the
  bucket counts, which is one small row per bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from airloom.functions.hours import hour_index

HOUR = "_hour"
BUCKET = "_bucket"
BUCKET_HOURS = 14 * 24
SALTS = 32


def bucket_of(hour: Column, bucket_hours: int = BUCKET_HOURS) -> Column:
    return F.floor(hour / F.lit(bucket_hours))


def halo(
    df: DataFrame, keys: Sequence[str], t: str, back: int = 0, ahead: int = 0, bucket_hours: int = BUCKET_HOURS
) -> DataFrame:
    """Add `_hour` and `_bucket`; a row appears in each bucket whose frames can see it.

    The result is partitioned by (keys, bucket), which is the one exchange the
    windows on it need. Stating it also spreads inputs that arrive as one file.
    """
    if back + ahead >= bucket_hours:
        bucket_hours = back + ahead + 1
    hour = F.col(HOUR)
    first, last = bucket_of(hour - ahead, bucket_hours), bucket_of(hour + back, bucket_hours)
    return (
        df.withColumn(HOUR, hour_index(t))
        .withColumn(BUCKET, F.explode(F.sequence(first, last)))
        .withColumn("_home", F.col(BUCKET) == bucket_of(hour, bucket_hours))
        .repartition(*keys, BUCKET)
    )


def own_rows(df: DataFrame) -> DataFrame:
    """Drop the copies made by `halo`."""
    return df.filter("_home").drop("_home", HOUR, BUCKET)


def hour_window(keys: Sequence[str]) -> WindowSpec:
    """The one window spec shared by a chain: a single exchange and a single sort."""
    return Window.partitionBy(*keys, BUCKET).orderBy(HOUR)


def numbered(
    df: DataFrame, keys: Sequence[str], order: Column, bucket: Column, name: str = "_number", total: str | None = None
) -> DataFrame:
    """1-based position of each row within its key, ordered by (`bucket`, `order`).

    `bucket` must not decrease along `order`. Only the bucket counts meet in one
    task per key; they also give the number of rows of the key, added as `total` if named.
    """
    keys = list(keys)
    cut = df.withColumn("_cut", bucket)
    counts = cut.groupBy(*keys, "_cut").agg(F.count("*").alias("_rows"))
    before = Window.partitionBy(*keys).orderBy("_cut").rowsBetween(Window.unboundedPreceding, -1)
    extra = [F.sum("_rows").over(Window.partitionBy(*keys)).alias(total)] if total else []
    offsets = counts.select(*keys, "_cut", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"), *extra)
    local = cut.withColumn("_local", F.row_number().over(Window.partitionBy(*keys, "_cut").orderBy(order)))
    return (
        local.join(offsets, [*keys, "_cut"])
        .withColumn(name, F.col("_local") + F.col("_offset"))
        .drop("_cut", "_local", "_offset")
    )


def numbered_hours(
    df: DataFrame, keys: Sequence[str], t: str, name: str = "_number", per_run: bool = False, total: str | None = None
) -> DataFrame:
    """`numbered` along an hourly time column.

    `per_run` says that the keys name one forecast run, whose rows the output
    contract bounds, so one plain window does.
    """
    if per_run:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(t)))
    return numbered(df, keys, F.col(t), bucket_of(hour_index(t)), name, total)


def with_previous(df: DataFrame, keys: Sequence[str], t: str, carry: Sequence[str], prefix: str = "prev_") -> DataFrame:
    """Values of the previous row of the same key, however far back it lies.

    Inside a bucket this is `lag`; the first row of a bucket takes the last row
    of the nearest earlier bucket, found among one summary row per bucket.
    """
    keys = list(keys)
    packed = F.struct(*carry)
    cut = df.withColumn("_cut", bucket_of(hour_index(t)))
    last = cut.groupBy(*keys, "_cut").agg(F.max_by(packed, F.col(t)).alias("_last"))
    edges = last.select(
        *keys, "_cut", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_cut")).alias("_edge")
    )
    inside = cut.withColumn("_prev", F.lag(packed).over(Window.partitionBy(*keys, "_cut").orderBy(t)))
    joined = inside.join(edges, [*keys, "_cut"], "left").withColumn("_prev", F.coalesce("_prev", "_edge"))
    return joined.select(*df.columns, *[F.col(f"_prev.{c}").alias(prefix + c) for c in carry])


def attach_per_key(df: DataFrame, per_key: DataFrame, keys: Sequence[str], spread_on: str, how: str = "inner") -> DataFrame:
    """Join one row per key onto many rows per key without piling a hot key on one task.

    The many side is salted by `spread_on`, the one side is repeated per salt.
    AQE may still broadcast the one side when its measured size allows it.
    """
    salted = df.withColumn("_salt", F.pmod(F.hash(spread_on), F.lit(SALTS)))
    repeated = per_key.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(repeated, [*keys, "_salt"], how).drop("_salt")


def fill_forward(df: DataFrame, keys: Sequence[str], t: str, value: str, name: str) -> DataFrame:
    """Last non-null `value` at or before each row of the same key.

    Local fill inside a bucket, then the nearest earlier bucket that has one.
    """
    keys = list(keys)
    cut = df.withColumn("_cut", bucket_of(hour_index(t)))
    known = F.when(F.col(value).isNotNull(), F.col(t))
    tails = cut.groupBy(*keys, "_cut").agg(F.max_by(value, known).alias("_tail"))
    before = Window.partitionBy(*keys).orderBy("_cut").rowsBetween(Window.unboundedPreceding, -1)
    edges = tails.select(*keys, "_cut", F.last("_tail", ignorenulls=True).over(before).alias("_edge"))
    inside = Window.partitionBy(*keys, "_cut").orderBy(t).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = cut.withColumn(name, F.last(value, ignorenulls=True).over(inside))
    return filled.join(edges, [*keys, "_cut"], "left").withColumn(name, F.coalesce(name, "_edge")).drop("_cut", "_edge")
