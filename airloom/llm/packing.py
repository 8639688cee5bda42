"""Packing into length buckets.

The lengths of all sequences form one histogram, whose size is bounded by the longest sequence allowed.
Dynamic programming over it finds the bucket boundaries with the least padding; inside a bucket every
sequence is padded to the boundary, so a batch holds a fixed number of them under the token budget.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from airloom.llm.common import reread

MAX_LENGTH = 4_096
BUCKETS = 16
BUDGET = 65_536
SLICE_ROWS = 20_000


def n_words(text) -> F.Column:
    """Words `[^\\x20\\x09-\\x0D]+`; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def boundaries(lengths: list[int], counts: list[int], buckets: int) -> list[int]:
    """Upper bounds of at most `buckets` buckets with the least total padding; ties to the smaller last cut."""
    order = np.argsort(lengths)
    b, c = np.asarray(lengths, np.float64)[order], np.asarray(counts, np.float64)[order]
    n = len(b)
    if not n:
        return []
    cum, total = np.concatenate([[0], np.cumsum(c)]), np.concatenate([[0], np.cumsum(b * c)])
    # best[j]: least padding of the first j distinct lengths; cost of (i, j]: all padded to b[j - 1].
    best = np.concatenate([[0], b * cum[1:] - total[1:]])
    cuts = [np.zeros(n + 1, np.int64)]
    for _ in range(1, min(buckets, n)):
        nxt, cut = np.zeros(n + 1), np.zeros(n + 1, np.int64)
        for j in range(1, n + 1):
            cost = best[:j] + b[j - 1] * (cum[j] - cum[:j]) - (total[j] - total[:j])
            cut[j] = int(np.argmin(cost))
            nxt[j] = cost[cut[j]]
        cuts.append(cut)
        best = nxt
    found, j = [], n
    for cut in reversed(cuts):
        if j == 0:
            break
        found.append(int(b[j - 1]))
        j = int(cut[j])
    return found[::-1]


def segments(lengths: DataFrame, key: str, length: str, max_length: int) -> DataFrame:
    """Rows (key, segment, start, length): texts over the limit are cut into full segments and a rest; none is lost."""
    last = F.greatest(F.ceil(F.col(length) / max_length).cast("int") - 1, F.lit(0))
    cut = lengths.select(F.col(key), F.col(length).alias("_n"), F.explode(F.sequence(F.lit(0), last)).alias("segment"))
    start = F.col("segment").cast("long") * max_length
    return cut.select(key, "segment", start.alias("start"), F.least(F.col("_n") - start, F.lit(max_length)).cast("long").alias("length"))


def pack(lengths: DataFrame, key: str = "doc_id", length: str = "n_words", max_length: int = MAX_LENGTH, buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """Rows (key, segment, start, length, bucket, batch, slot): where each sequence goes.

    `bucket` is the padded length; batches are numbered from 0 in each bucket and hold `budget // bucket`
    sequences, the last one of a bucket maybe fewer. Sequences of length 0 (null or empty texts) need no place:
    bucket, batch and slot are null. Null lengths count as 0; repeated rows are sequences of their own; an empty
    table gives no rows. A length over `max_length` becomes several segments.
    A bucket may hold any share of the rows: ranks come from slices of bounded size and their running counts.
    """
    if not 0 < max_length <= budget:
        raise ValueError("max_length must be positive and fit into the budget")
    spark = lengths.sparkSession
    plain = lengths.select(key, F.coalesce(F.col(length), F.lit(0)).cast("long").alias(length))
    rows = reread(spark, segments(plain, key, length, max_length), "segments")
    histogram = rows.filter("length > 0").groupBy("length").count().collect()  # at most max_length rows
    bounds = boundaries([r["length"] for r in histogram], [r["count"] for r in histogram], buckets)
    slices = -(-sum(r["count"] for r in histogram) // SLICE_ROWS) or 1
    bucket = F.lit(None).cast("long")
    for b in reversed(bounds):
        bucket = F.when(F.col("length") <= b, F.lit(b)).otherwise(bucket)
    placed = rows.withColumn("bucket", F.when(F.col("length") > 0, bucket.cast("long"))).withColumn("_slice", F.pmod(F.xxhash64(key, "segment"), F.lit(slices)))
    used = placed.filter("bucket is not null")
    counts = used.groupBy("bucket", "_slice").count()
    before = F.coalesce(F.sum("count").over(Window.partitionBy("bucket").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select(F.col("bucket").alias("_b"), F.col("_slice").alias("_s"), before.alias("_before"))
    local = F.row_number().over(Window.partitionBy("bucket", "_slice").orderBy("length", key, "segment"))
    ranked = used.withColumn("_local", local).join(offsets, (F.col("bucket") == F.col("_b")) & (F.col("_slice") == F.col("_s")))
    rank, room = F.col("_local") - 1 + F.col("_before"), F.floor(F.lit(budget) / F.col("bucket")).cast("long")
    full = ranked.withColumn("batch", F.floor(rank / room).cast("long")).withColumn("slot", (rank % room).cast("long"))
    columns = [key, "segment", "start", "length", "bucket", "batch", "slot"]
    rest = placed.filter("bucket is null").withColumn("batch", F.lit(None).cast("long")).withColumn("slot", F.lit(None).cast("long"))
    return full.select(*columns).unionByName(rest.select(*columns))
