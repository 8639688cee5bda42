"""Registry of runnable queries with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
PLAIN: dict[str, Query] = {}  # the same queries before `present`
SQL: dict[str, str] = {}
SCALE = 1_000_000.0
WIDE = 16
NUDGE = 0.50032  # off the decimal midpoints, so that summation noise cannot flip a digit


def settle(c: Column) -> Column:
    """Double at six decimals by plain arithmetic that any engine repeats exactly."""
    return F.when(F.abs(c) < 1e12, F.floor(c * F.lit(SCALE) + F.lit(NUDGE)) / F.lit(SCALE)).otherwise(c)



def present(df: DataFrame) -> DataFrame:
    """Uniform result types: 64-bit integers, doubles at six decimals, zone-free UTC stamps.

    Wide results settle their doubles inside one array, because dozens of
    copies of the rounding outgrow what the JIT compiles in one method.
    """
    doubles = [name for name, kind in df.dtypes if kind in ("double", "float")]
    packed = {}
    if len(doubles) > WIDE:
        df = df.withColumn("_settled", F.transform(F.array(*[F.col(f"`{n}`").cast("double") for n in doubles]), settle))
        packed = {n: F.get("_settled", F.lit(i)) for i, n in enumerate(doubles)}
    columns = []
    for name, kind in df.dtypes:
        if name == "_settled":
            continue
        c = F.col(f"`{name}`")
        if kind == "timestamp":
            c = c.cast("timestamp_ntz")
        elif kind in ("int", "smallint", "tinyint"):
            c = c.cast("bigint")
        elif kind == "array<timestamp>":
            c = c.cast("array<timestamp_ntz>")
        elif kind.startswith("decimal"):
            c = c.cast("double") if not kind.endswith(",0)") else c.cast("bigint")
        elif kind in ("double", "float"):
            c = packed.get(name, settle(c))
        columns.append(c.alias(name))
    return df.select(*columns)


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; the SQL twin computes the same result independently."""

    def add(build: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        def plain(spark: SparkSession, folder: str) -> DataFrame:
            # Every stamp is UTC, whatever session the caller brings.
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return build(spark, folder)

        PLAIN[name] = plain
        QUERIES[name] = lambda spark, folder: present(plain(spark, folder))
        if sql is not None:
            SQL[name] = sql
        return build

    return add
