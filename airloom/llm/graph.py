"""Connected components by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airloom.llm.common import discard, reread

LINKS_A_TASK = 250_000


def _state(edges: DataFrame):
    return edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum")).first()


def components(edges: DataFrame) -> DataFrame:
    """Rows (id, component) for every node of the links (a, b): the smallest node reachable.

    Each round hooks the larger neighbours of a node, then the smaller ones, to its smallest; the number of
    rounds grows with the logarithm of the longest path. Nodes meet their minimum in a plain join, which
    adaptive execution splits where a node has very many links. Every round is written to the shared folder,
    and read in as many tasks as its links fill: a few links need no shuffle.
    """
    spark = edges.sparkSession
    high, low = F.greatest("a", "b"), F.least("a", "b")
    now = reread(spark, edges.filter("a <> b").select(high.alias("a"), low.alias("b")).distinct(), "links")
    before = None
    while (state := _state(now)) != before:
        before = state
        links = now.coalesce(-(-state["n"] // LINKS_A_TASK) or 1)
        both = links.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.*")
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        large = reread(spark, large, "links")
        links = large.coalesce(-(-state["n"] // LINKS_A_TASK) or 1)
        least = links.groupBy("a").agg(F.min("b").alias("m"))
        small = links.join(least, "a").select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("e"))
        following = reread(spark, small.select(F.col("e.b").alias("a"), F.col("e.m").alias("b")).filter("a <> b").distinct(), "links")
        discard(now, large)
        now = following
    # Every link now joins a node with its component.
    tops = now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(tops)
