"""URL rules and an exact block list in a cascade of Bloom filters.

The first filter encodes the listed keys. The keys of the corpus that it takes for listed although they are not
fill the second filter, the listed keys that the second takes for unlisted the third, and so on until no
key of the complete universe is mistaken. A key is listed if it passes an odd number of levels in a row.
The answer is exact for every key of the universe, and no page is joined with anything.

Keys are dealt to shards by hash and every shard has its own cascade. Shards are packed into groups of at most
`GROUP_BYTES`; a group is what one task holds. With more groups than one, pages pass as often as there are
groups, each pass with the pages of its own group.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airloom.llm.common import reread
from airloom.llm.shingles import mix

SHARD_KEYS = 100_000  # listed keys of a shard, about
GROUP_BYTES = 64 << 20  # largest broadcast
FIRST_BITS, LATER_BITS = 10, 3  # bits a key; the first level meets the whole universe, later ones only mistakes
HASHES_FIRST, HASHES_LATER = 7, 2
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    """From the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty for null or without `://`."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(rest, F.lit("")), UPPER, LOWER)


def path(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


@dataclass(frozen=True)
class Rule:
    """A rule fits its host and all subdomains where the path starts with the rule's."""

    action: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def fitting_rule(rules: Sequence[Rule], host: str = "host", path: str = "path") -> Column:
    """struct(rule, action) of the longest fitting rule (host and path together; ties by name), else null."""
    out = F.lit(None).cast("struct<rule:string,action:string>")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((F.col(host) == r.host) | F.endswith(F.col(host), F.lit("." + r.host))) & F.startswith(F.col(path), F.lit(r.path))
        out = F.when(fits, F.struct(F.lit(r.name).alias("rule"), F.lit(r.action).alias("action"))).otherwise(out)
    return out


class Cascade:
    """The filters of one group of shards: for each level, bit words and the place of each shard in them."""

    def __init__(self, shards: int):
        self.shards = shards
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, int]] = []  # words, first word and bits by shard, hashes

    def add(self, words: np.ndarray, first: np.ndarray, bits: np.ndarray, hashes: int) -> None:
        self.levels.append((words, first, bits, hashes))

    @property
    def nbytes(self) -> int:
        return sum(w.nbytes + f.nbytes + b.nbytes for w, f, b, _ in self.levels)

    def holds(self, level: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        words, first, bits, hashes = self.levels[level]
        shard = shard_of(a, self.shards)
        n = bits[shard]
        out = n > 0
        for i in range(hashes):
            at = np.flatnonzero(out)
            bit = positions(a[at], b[at], level, i, n[at])
            out[at] = (words[first[shard[at]] + (bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) == 1
        return out

    def listed(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        passed = np.zeros(len(a), np.int64)
        at = np.arange(len(a))
        for level in range(len(self.levels)):
            at = at[self.holds(level, a[at], b[at])]
            passed[at] += 1
        return passed % 2 == 1


def shard_of(a: np.ndarray, shards: int) -> np.ndarray:
    return ((a >> np.uint64(33)) % np.uint64(shards)).astype(np.int64)


def positions(a: np.ndarray, b: np.ndarray, level: int, i: int, bits: np.ndarray) -> np.ndarray:
    """The i-th bit of a key in a filter of so many bits. Every level hashes anew, so that keys taken for each
    other at one level part at another."""
    return mix(mix(a + np.uint64(level * 16 + i)) ^ b) % bits.astype(np.uint64)


def _hashes(key: Column) -> tuple[Column, Column]:
    """Two 64-bit hashes; two keys that share both would count as one."""
    return F.xxhash64(key), F.xxhash64(key, F.lit("second"))


def _unsigned(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)


def _bit_rows(keys: DataFrame, bits: np.ndarray, shards: int, level: int, hashes: int) -> DataFrame:
    """Rows (shard, word, bits): the filter words of each shard, combined in every task before they move."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = _unsigned(batch.column(0)), _unsigned(batch.column(1))
            shard = shard_of(a, shards)
            for i in range(hashes):
                yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(positions(a, b, level, i, bits[shard]).astype(np.int64))], ["shard", "bit"])

    rows = keys.select("a", "b").mapInArrow(run, "shard long, bit long")
    word = F.expr("bit_or(shiftleft(1L, cast(bit % 64 as int)))")
    return rows.groupBy("shard", F.expr("bit div 64").alias("word")).agg(word.alias("bits"))


def _level(keys: DataFrame, level: int, shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """One level over all shards of a group: its words (bounded by the group) come to the driver."""
    per_key, hashes = (FIRST_BITS, HASHES_FIRST) if level == 0 else (LATER_BITS, HASHES_LATER)
    counts = keys.groupBy("shard").agg((F.ceil(F.count(F.lit(1)) * per_key / 64) * 64).cast("long").alias("bits"))
    bits = np.zeros(shards, np.int64)
    for r in counts.collect():
        bits[r["shard"]] = r["bits"]
    first = np.concatenate([[0], np.cumsum(bits // 64)[:-1]]).astype(np.int64)
    words = np.zeros(max(int(bits.sum()) // 64, 1), np.uint64)
    table = _bit_rows(keys, bits, shards, level, hashes).toArrow()
    at = first[table["shard"].to_numpy()] + table["word"].to_numpy()
    words[at] = table["bits"].to_numpy().astype(np.int64).view(np.uint64)
    return words, first, bits, hashes


def _passing(keys: DataFrame, cascade: Cascade, level: int) -> DataFrame:
    """The keys that the given level of the cascade takes for its own."""
    shared = keys.sparkSession.sparkContext.broadcast(cascade)

    @F.arrow_udf("boolean")
    def holds(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array(shared.value.holds(level, _unsigned(a), _unsigned(b)))

    return keys.filter(holds("a", "b"))


def build(universe: DataFrame, listed: DataFrame, shard_keys: int = SHARD_KEYS, group_bytes: int = GROUP_BYTES) -> list[tuple[int, int, int, Cascade]]:
    """Cascades (first shard, end shard, all shards, filters) for the keys of two one-column tables.

    Listed keys that no page has are encoded too. Null keys are in neither table; repeated keys count once;
    an empty list gives cascades that hold nothing.
    """
    spark = universe.sparkSession
    name_u, name_l = universe.columns[0], listed.columns[0]
    both = universe.select(F.col(name_u).alias("key"), F.lit(False).alias("listed")).unionByName(listed.select(F.col(name_l).alias("key"), F.lit(True).alias("listed")))
    a, b = _hashes(F.col("key"))
    keys = both.filter("key is not null").groupBy("key").agg(F.max("listed").alias("listed")).select(a.alias("a"), b.alias("b"), "listed")
    keys = reread(spark, keys, "url-keys")
    n_listed = keys.filter("listed").count()
    shards = max(-(-n_listed // shard_keys), 1)
    shard = F.expr(f"cast(shiftrightunsigned(a, 33) % {shards} as int)")
    keys = keys.withColumn("shard", shard)
    # A shard takes some 12 bits a listed key over all its levels, plus the mistakes of the first filter.
    width = max(int(group_bytes // max(shard_keys * 4, 1)), 1)
    out = []
    for start in range(0, shards, width):
        end = min(start + width, shards)
        own = keys.filter(F.col("shard").between(start, end - 1))
        cascade = Cascade(shards)
        inside, outside = own.filter("listed"), own.filter("not listed")
        n, level = n_listed, 0
        while n:
            cascade.add(*_level(inside, level, shards))
            mistaken = reread(spark, _passing(outside, cascade, level), "url-mistakes")
            inside, outside, level = mistaken, inside, level + 1
            n = mistaken.count()
        out.append((start, end, shards, cascade))
    return out


def _listed(shared):
    @F.arrow_udf("boolean")
    def listed(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array(shared.value.listed(_unsigned(a), _unsigned(b)))

    return listed


def mark(pages: DataFrame, key: Column, cascades: Sequence[tuple[int, int, int, Cascade]], name: str = "listed") -> DataFrame:
    """`pages` with a boolean column: is the key listed? Exact for keys of the universe; null keys are not listed."""
    a, b = _hashes(key)
    rows = pages.withColumn("_a", F.when(key.isNotNull(), a)).withColumn("_b", b)
    parts = []
    for start, end, shards, cascade in cascades:
        shared = pages.sparkSession.sparkContext.broadcast(cascade)

        own = rows
        if len(cascades) > 1:
            own = rows.filter(F.expr(f"shiftrightunsigned(_a, 33) % {shards}").between(start, end - 1))
        test = _listed(shared)(F.coalesce("_a", F.lit(0).cast("long")), F.col("_b"))
        parts.append(own.withColumn(name, test & F.col("_a").isNotNull()))
    if len(cascades) > 1:
        parts.append(rows.filter("_a is null").withColumn(name, F.lit(False)))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.drop("_a", "_b")


def judge(pages: DataFrame, rules: Sequence[Rule], listed: DataFrame, key: Column, url: str = "url", **sizes) -> DataFrame:
    """`pages` with host, path, rule (or null) and verdict (allow or block).

    The longest fitting rule decides; without one, a page is blocked if its key (an expression over host and
    path) is in the one-column table `listed`. Null urls and urls without `://` have empty host and path and no
    key. Every row is answered, repeated ones too; an empty table gives no rows; columns of the input named like
    the new ones are replaced.
    """
    split = pages.drop("host", "path", "rule", "verdict", "_key", "_fit", "_listed").withColumn("host", host(F.col(url))).withColumn("path", path(F.col(url)))
    split = split.withColumn("_key", F.when(F.col("host") != "", key))
    cascades = build(split.select("_key"), listed, **sizes)
    marked = mark(split.withColumn("_fit", fitting_rule(rules)), F.col("_key"), cascades, "_listed")
    verdict = F.coalesce(F.col("_fit.action"), F.when(F.col("_listed"), F.lit("block")).otherwise(F.lit("allow")))
    return marked.withColumn("rule", F.col("_fit.rule")).withColumn("verdict", verdict).drop("_key", "_fit", "_listed")
