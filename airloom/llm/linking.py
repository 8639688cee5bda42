"""From lists of members that may be alike to links that are, without all pairs of a list.

Every member of a list is first compared with the list's leader, the member whose own lists are the largest: of a
group of edited copies that is one near the original, to which most of the others are linked. A second round
compares, in each list that still holds several components, the members outside the list's largest component with all
members of other components. Members that are already connected are never compared, so the components are those
of all pairs.

Members outside a large component meet its members, cut into slices of bounded size, inside one task a slice: a
member is compared with those it shares a list with until one is alike. All other pairs go through a join that looks
at sketches and lets a pair out once, for its smallest common list, and only if the sketches agree as often as
those of a pair at the threshold do, five standard deviations less.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airloom.llm import shingles as sh
from airloom.llm.common import discard, release, reread
from airloom.llm.graph import components

Batches = Iterator[pa.RecordBatch]
SKETCH_BITS = 1_024
LARGE = 16  # members of one component in a list, from which its outside members meet it by slices
SLICE_VALUES = 2_000_000


def sketches(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One bit of each of `SKETCH_BITS` MinHash values, packed into longs (units x 16)."""
    low = (sh.coordinates(values, at, SKETCH_BITS) >> np.uint64(17)) & np.uint64(1)
    return np.packbits(low.astype(np.uint8), axis=1).view(np.uint64)


def agreements(percent: int) -> int:
    """Equal sketch bits that a pair at the threshold has, less five standard deviations."""
    equal = (1 + percent / 100) / 2
    return math.floor(SKETCH_BITS * equal - 5 * math.sqrt(SKETCH_BITS * equal * (1 - equal)))


def _agree(left: str, right: str, percent: int) -> F.Column:
    apart = F.lit(0)
    for i in range(SKETCH_BITS // 64):
        apart = apart + F.bit_count(F.get(left, F.lit(i)).bitwiseXOR(F.get(right, F.lit(i))))
    return apart <= SKETCH_BITS - agreements(percent)


def verified(pairs: DataFrame, sets: DataFrame, percent: int, matches: int = 0) -> DataFrame:
    """The pairs (a, b) whose full sets (id, set, and signature if `matches` is given) reach the similarity.

    With `matches`, pairs with fewer equal signature coordinates are dropped before their sets are compared.
    """
    columns = ["id", "set", *(["signature"] if matches else [])]
    left = sets.select(*[F.col(c).alias(f"{c}_a") for c in columns])
    right = sets.select(*[F.col(c).alias(f"{c}_b") for c in columns])
    rows = pairs.join(left, F.col("a") == F.col("id_a")).join(right, F.col("b") == F.col("id_b"))
    n_a, n_b = F.size("set_a"), F.size("set_b")
    rows = rows.filter(F.least(n_a, n_b) * 100 >= F.greatest(n_a, n_b) * percent)
    if matches:
        equal = F.aggregate(F.zip_with("signature_a", "signature_b", lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda s, x: s + x)
        rows = rows.filter(equal >= matches)
    rows = rows.withColumn("common", F.size(F.array_intersect("set_a", "set_b")))
    return rows.filter(F.col("common") * 100 >= (n_a + n_b - F.col("common")) * percent).select("a", "b")


def links(lists: DataFrame, sets: DataFrame, percent: int, matches: int = 0) -> DataFrame:
    """Links (a, b) between the members of the lists (key, id) that connect all that is alike; kept in the shared folder.

    `sets` holds (id, sketch, set, and signature if `matches` is given) of every member.
    """
    spark = lists.sparkSession
    sized = lists.join(lists.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "key")
    own = sized.groupBy("id").agg(F.sum("n").alias("weight"), F.sort_array(F.collect_list("key")).alias("keys"))  # a signature's worth of keys
    own = reread(spark, own, "members")
    leaders = lists.join(own.select("id", "weight"), "id").groupBy("key").agg(F.max_by("id", F.struct("weight", "id")).alias("a"))
    stars = lists.join(leaders, "key").filter("a <> id").select("a", F.col("id").alias("b")).distinct()
    first = reread(spark, verified(stars, sets, percent, matches), "links")
    labels = components(first)
    release(spark)
    named = lists.join(labels, "id", "left").select("key", "id", F.coalesce("component", "id").alias("component"))
    named = reread(spark, named, "named")
    held = named.groupBy("key", "component").count().groupBy("key")
    held = held.agg(F.max_by("component", F.struct("count", "component")).alias("largest"), F.max("count").alias("most"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    rest = reread(spark, named.join(held.select("key", "largest", "most"), "key"), "rest")
    outside = rest.filter("component <> largest")
    large = F.col("most") >= LARGE
    joined, used = _against_component(outside.filter(large).select("largest", "id").distinct(), labels, own, sets, percent)
    # Rows of a large component have met the outside members already.
    small = rest.filter(~large | (F.col("component") != F.col("largest"))).join(own.select("id", "keys"), "id").join(sets.select("id", "sketch"), "id")
    small = reread(spark, small, "small")
    left = small.filter("component <> largest").select(*[F.col(c).alias(f"x_{c}") for c in ("key", "id", "component", "keys", "sketch")])
    other = (F.col("component") != F.col("x_component")) & ((F.col("component") == F.col("largest")) | (F.col("id") < F.col("x_id")))
    once = F.get(F.array_intersect("keys", "x_keys"), F.lit(0)) == F.col("key")
    crossing = left.join(small, (F.col("x_key") == F.col("key")) & other & _agree("sketch", "x_sketch", percent) & once)
    pairs = crossing.select(F.least("x_id", "id").alias("a"), F.greatest("x_id", "id").alias("b")).distinct()
    second = reread(spark, verified(pairs, sets, percent, matches).unionByName(joined), "links")
    discard(own, named, rest, small, *used)
    release(spark)
    return first.unionByName(second)


def _against_component(outside: DataFrame, labels: DataFrame, own: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, tuple[DataFrame, DataFrame]]:
    """Links (a, b) of outside members (largest, id) with members of that component (one a slice is enough), and tables to discard."""
    whole = own.select("id", "keys").join(sets.select("id", "set"), "id")
    inside = labels.join(outside.select("largest").distinct(), F.col("component") == F.col("largest")).select("largest", "id").join(whole, "id")
    guests = outside.join(whole, "id")

    def slices(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("largest").agg((F.floor(F.sum(F.size("set")) / SLICE_VALUES) + 1).cast("int").alias(name))

    counts = slices(inside, "xs").join(slices(guests, "zs"), "largest")
    deal = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    inside = inside.join(counts, "largest").withColumn("x", deal("xs")).withColumn("z", each("zs")).drop("xs", "zs")
    guests = guests.join(counts, "largest").withColumn("z", deal("zs")).withColumn("x", each("xs")).drop("xs", "zs")

    def compare(members: pd.DataFrame, guests: pd.DataFrame) -> pd.DataFrame:
        lists: dict[int, list[int]] = {}
        for i, keys in enumerate(members["keys"]):
            for k in keys.tolist():
                lists.setdefault(k, []).append(i)
        held, ids, found = members["set"].tolist(), members["id"].tolist(), []
        for guest, keys, own in zip(guests["id"], guests["keys"], guests["set"]):
            shared = Counter(i for k in keys.tolist() for i in lists.get(k, ()))
            # Those that share most lists first.
            for i, _ in shared.most_common():
                n, m = len(own), len(held[i])
                if min(n, m) * 100 < max(n, m) * percent:
                    continue
                common = len(np.intersect1d(own, held[i], assume_unique=True))
                if common * 100 >= (n + m - common) * percent:
                    found.append((min(guest, ids[i]), max(guest, ids[i])))
                    break
        return pd.DataFrame(found, columns=["a", "b"])

    inside, guests = reread(sets.sparkSession, inside, "inside"), reread(sets.sparkSession, guests, "guests")
    found = inside.groupBy("largest", "x", "z").cogroup(guests.groupBy("largest", "x", "z")).applyInPandas(compare, "a long, b long")
    return found, (inside, guests)


def flagged(df: DataFrame, on: F.Column, ids: DataFrame, column: str, name: str) -> DataFrame:
    """`df` with a boolean column `name`: true for every row whose `on` is among the ids, and for few others while the ids are few.

    A bitmap of 2**26 places, as a table of at most 2**20 words that is broadcast. Only a saving: whatever passes is
    joined with the ids afterwards, so a full bitmap costs time, not rows.
    """
    place = lambda c: F.shiftrightunsigned(F.xxhash64(c), 38)
    words = ids.select(place(column).alias("p")).groupBy(F.expr("p div 64").alias("_bitmap_word"))
    words = words.agg(F.expr("bit_or(shiftleft(1L, cast(p % 64 as int)))").alias("_bitmap_bits"))
    words = reread(df.sparkSession, words, "bitmap")
    rows = df.withColumn("_bitmap_place", place(on)).join(F.broadcast(words), F.expr("_bitmap_place div 64 = _bitmap_word"), "left")
    held = F.expr("coalesce(shiftrightunsigned(_bitmap_bits, cast(_bitmap_place % 64 as int)) & 1L = 1L, false)")
    return rows.withColumn(name, held).drop("_bitmap_place", "_bitmap_word", "_bitmap_bits")


def longs(rows: list[np.ndarray]) -> pa.ListArray:
    """Rows of 64-bit values as an Arrow list of signed longs."""
    at = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    flat = np.concatenate(rows) if rows else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(flat.view(np.int64)))

