"""Approximate nearest neighbours with a hash-prefix forest.

Every tree keeps the vectors' 64-bit hash strings (sides of random hyperplanes) in one sorted array.
A query descends each tree by binary search to its longest matching prefix, then all trees ascend
together, one bit at a time, until the prefixes that still match hold enough distinct candidates;
these get exact distances. Large tables are cut into blocks by a hash of the id: each block is a
forest of its own, every query visits every block, and the best of all blocks win.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BITS = 64
TREES = 32
# The ascent stops when the matching entries of all trees reach this multiple of the block's rows. Near
# isotropic vectors (nearest neighbours hardly nearer than the rest) need as much for a recall of 0.95;
# clustered ones reach it with a hundredth.
SHARE = 0.8
BLOCK_ROWS = 20_000
QUERY_ROWS = 5_000
SAMPLE_ROWS = 2_048  # rows that place the hyperplanes; every row is indexed
SEED = 7


def planes(dim: int, trees: int) -> np.ndarray:
    """Unit normals, trees x BITS x dim, the same in every task."""
    a = np.random.default_rng(SEED).standard_normal((trees * BITS, dim))
    return a / np.linalg.norm(a, axis=1, keepdims=True)


def hash_strings(x: np.ndarray, normals: np.ndarray, offsets: np.ndarray, trees: int) -> np.ndarray:
    """Hash strings (rows x trees, first plane in the highest bit)."""
    bits = (x @ normals.T > offsets).astype(np.uint8).reshape(len(x), trees, BITS)
    return np.packbits(bits, axis=2).view(">u8").astype(np.uint64)[:, :, 0]


def search_block(x: np.ndarray, codes: np.ndarray, q: np.ndarray, q_codes: np.ndarray, enough: int) -> list[np.ndarray]:
    """Rows of `x` that each query should be compared with."""
    trees = codes.shape[1]
    order = [np.argsort(codes[:, t], kind="stable") for t in range(trees)]
    arrays = [codes[order[t], t] for t in range(trees)]
    low, high = np.zeros((len(q), trees), np.int64), np.zeros((len(q), trees), np.int64)
    open_ = np.ones(len(q), bool)
    for depth in range(BITS, -1, -1):
        # At full depth only equal strings match; each step up frees one more low bit in all trees.
        free = np.uint64(0xFFFFFFFFFFFFFFFF) if depth == 0 else np.uint64((1 << (BITS - depth)) - 1)
        at = np.flatnonzero(open_)
        for t in range(trees):
            c = q_codes[at, t]
            low[at, t] = np.searchsorted(arrays[t], c & ~free, "left")
            high[at, t] = np.searchsorted(arrays[t], c | free, "right")
        open_[at] = (high[at] - low[at]).sum(axis=1) < enough
        if not open_.any():
            break
    return [np.unique(np.concatenate([order[t][low[i, t] : high[i, t]] for t in range(trees)])) for i in range(len(q))]


def first_of_ids(ids: np.ndarray, distances: np.ndarray) -> np.ndarray:
    """The smallest distance of every distinct id."""
    order = np.argsort(ids, kind="stable")
    starts = np.flatnonzero(np.diff(ids[order], prepend=ids[order[0]] - 1))
    return np.minimum.reduceat(distances[order], starts)


def _usable(vector: str) -> F.Column:
    v = F.col(vector)
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & ~F.coalesce(bad, F.lit(True)) & F.exists(v, lambda c: c != 0)


def _smallest(df: DataFrame, k: int) -> DataFrame:
    """At most the k smallest ids of every distinct vector; first within slices, so no vector fills a task."""
    sliced = df.withColumn("_slice", F.pmod(F.xxhash64("id"), F.lit(64)))
    for keys in (["v", "_slice"], ["v"]):
        sliced = sliced.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("id"))).filter(F.col("_n") <= k)
    return sliced.select("id", "v")


def nearest(
    vectors: DataFrame,
    is_query: F.Column,
    k: int = 10,
    key: str = "vec_id",
    vector: str = "embedding",
    trees: int = TREES,
    share: float = SHARE,
) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): the k nearest found of each query, smallest Euclidean distance first.

    Vectors that are null, empty, all zero, or hold a null, NaN or infinity take no part, nor do null ids.
    Vectors of another length than the most frequent one take no part either. Ties go to the smaller id; an id with
    several vectors is one candidate, as near as the nearest of them, and asks with each of them; a query never
    meets its own id; a table with fewer than k other ids gives them all; an empty table gives no rows. Other
    columns are ignored, whatever their names. Of equal vectors only the k + 1 smallest ids are indexed: no answer can
    name another one.
    """
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    rows = vectors.withColumn("_q", is_query).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), F.col("_q").alias("q"))
    rows = rows.filter(F.col("id").isNotNull() & _usable("v"))
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], schema)
    dim = sizes[0]["d"]
    rows = rows.filter(F.size("v") == dim)
    total = int(sizes[0]["count"])
    sample = rows.select(F.xxhash64("id").alias("h"), "v").orderBy("h").limit(SAMPLE_ROWS).collect()
    normals = planes(dim, trees)
    offsets = np.median(np.array([r["v"] for r in sample]) @ normals.T, axis=0)
    blocks = -(-total // BLOCK_ROWS)
    queries = rows.filter("q").select("id", "v").dropDuplicates(["id", "v"])
    parts = -(-max(queries.count(), 1) // QUERY_ROWS)
    # Replicas: an index block meets each part of the queries, a query each block.
    indexed = _smallest(rows.select("id", "v").dropDuplicates(["id", "v"]), k + 1)
    indexed = indexed.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    asked = queries.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def search(index: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple[int, int, float]] = []
        if len(index) and len(asked):
            ids, x = index["id"].to_numpy(), np.stack(index["v"].to_numpy())
            q = np.stack(asked["v"].to_numpy())
            codes, q_codes = hash_strings(x, normals, offsets, trees), hash_strings(q, normals, offsets, trees)
            enough = max(int(share * len(ids)), (k + 1) * trees)
            squares = (x * x).sum(axis=1)
            repeated = len(np.unique(ids)) < len(ids)
            for query, own, near in zip(asked["id"], q, search_block(x, codes, q, q_codes, enough)):
                near = near[ids[near] != query]
                if repeated and len(np.unique(ids[near])) < k:
                    near = np.flatnonzero(ids != query)
                if len(near) > k:
                    # A quick form of the distance keeps all that can be among the k nearest.
                    rough = squares[near] - 2 * (x[near] @ own)
                    best = first_of_ids(ids[near], rough) if repeated else rough
                    if len(best) > k:
                        near = near[rough <= np.partition(best, k - 1)[k - 1] + 1e-9 * (1 + squares.max() + own @ own)]
                # Component by component, so that equal vectors have equal sums in every block.
                total = np.zeros(len(near))
                for j in range(dim):
                    total += (x[near, j] - own[j]) ** 2
                best = np.lexsort((ids[near], total))
                if repeated:  # the nearest vector of each id
                    best = best[np.sort(np.unique(ids[near[best]], return_index=True)[1])]
                best = best[:k]
                found += zip([query] * len(best), ids[near[best]].tolist(), np.sqrt(total[best]).tolist())
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"])

    near = indexed.groupBy("block", "part").cogroup(asked.groupBy("block", "part")).applyInPandas(search, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return near.groupBy("query_id", "vec_id").agg(F.min("score").alias("score")).withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def divisible(key: str, by: int) -> F.Column:
    return F.coalesce(F.col(key) % by == 0, F.lit(False))


def exact_rows(ids: Sequence[int], x: np.ndarray, queries: Sequence[int], k: int) -> dict[int, list[int]]:
    """Brute force on one machine, for tests and for measuring recall."""
    ids = np.asarray(ids)
    out = {}
    for query in queries:
        own = x[np.flatnonzero(ids == query)[0]]
        d = np.sqrt(((x - own) ** 2).sum(axis=1))
        order = [i for i in np.lexsort((ids, d)) if ids[i] != query][:k]
        out[int(query)] = [int(ids[i]) for i in order]
    return out
