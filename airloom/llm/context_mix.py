"""Language-model scores by logistic mixing of hashed-context bit predictors.

Texts are modelled as lower-cased bytes and an end mark, bit by bit. For contexts of the last 0 to 5 bytes, hashed
tables hold how often each bit came as 0 and as 1 after the same context and the same leading bits of the byte. The
log odds of all contexts are mixed by weights that a gate selects (place in the byte, longest context
known and how well it is known); the weights are learned online, batch by batch, in parallel shards whose results are averaged between
rounds. A last map from gate and mixed odds to what really came refines the probability.

Spark counts the six-byte windows of the whole training text, so what is gathered grows with the corpus; the tables
built from them have a fixed size and are what every task holds. Weights and refinement are learned from the
same windows, each with its own occurrence taken out of the tables. A text costs the sum over its windows; equal windows of
a slice are scored once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airloom.llm import shingles as sh
from airloom.llm.common import encoded, reread, sliced

ORDER = 5
SLOTS = 1 << 21  # of each longer context's table
SIZES = (1 << 8, 1 << 16, *[SLOTS] * (ORDER - 1))
PRIOR = 0.05
GATES = 8 * (ORDER + 2) * 3
BUCKETS = 49  # of the refinement, three to a unit of log odds
ROUNDS = 3
RATE = 0.1  # of a diagonal Newton step
BATCH = 8_192
END = 0xFF  # never a byte of UTF-8
FREQUENT = 500_000  # words whose counts every task holds; the others are joined
FOLDS = 10
SLICE = 1 << 20  # bytes of text scored at a time


def windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Six bytes ending at each byte of each text and its end mark, packed; and the first window of each text."""
    pad = bytes([END]) * ORDER
    data = np.frombuffer(pad + (bytes([END]) + pad).join(texts).lower() + bytes([END]), np.uint8)
    packed = np.zeros(len(data) - ORDER, np.int64)
    for i in range(ORDER + 1):
        packed = (packed << 8) | data[i : len(packed) + i]
    lengths = np.array([len(t) + 1 for t in texts], np.int64)
    at = np.concatenate([[0], np.cumsum(lengths)])
    return packed[np.arange(at[-1]) + np.repeat(np.arange(len(texts)) * ORDER, lengths)], at


def slots(grams: np.ndarray, order: int, bit: int) -> np.ndarray:
    """Place in the table of one order for one bit (0 is the highest) of each window's last byte."""
    node = (grams & 0xFF | 0x100) >> (8 - bit)
    context = (grams >> 8) & ((1 << (8 * order)) - 1)
    if order < 2:
        return context << 8 | node
    return (sh.mix((context << 8 | node).astype(np.uint64) + np.uint64(order)) % np.uint64(SIZES[order])).astype(np.int64)


@dataclass
class Model:
    counts: list[np.ndarray]  # by order: slots x 2, how often the bit was 0 and 1
    weights: np.ndarray  # gates x inputs
    refined: np.ndarray | None = None  # gates x 256 nodes folded to places x buckets

    def inputs(self, grams: np.ndarray, bit: int, without: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log odds by context, gate and the bit itself; `without` takes one occurrence of the window out."""
        real = (grams >> (7 - bit)) & 1
        odds = np.empty((len(grams), ORDER + 2), np.float64)
        known, seen = np.zeros(len(grams), np.int64), np.zeros(len(grams), np.int64)
        for order in range(ORDER + 1):
            n = self.counts[order][slots(grams, order, bit)].astype(np.float64)
            if without:
                n[np.arange(len(grams)), real] = np.maximum(n[np.arange(len(grams)), real] - 1, 0)
            odds[:, order] = np.log((n[:, 1] + PRIOR) / (n[:, 0] + PRIOR))
            total = n.sum(axis=1)
            known[total > 0] = order + 1
            seen = np.where(total > 0, (total > 1).astype(np.int64) + (total > 4), seen)
        odds[:, ORDER + 1] = 0.3
        return odds, (bit * (ORDER + 2) + known) * 3 + seen, real

    def mixed(self, odds: np.ndarray, gate: np.ndarray) -> np.ndarray:
        return np.clip((odds * self.weights[gate]).sum(axis=1), -8, 8)

    def probability(self, grams: np.ndarray, bit: int) -> np.ndarray:
        """Of the bit that really comes."""
        odds, gate, real = self.inputs(grams, bit, False)
        x = self.mixed(odds, gate)
        p = 1 / (1 + np.exp(-x))
        if self.refined is not None:
            p = (p + self.refined[gate, bucket(x)]) / 2
        return np.where(real == 1, p, 1 - p)

    def cost(self, grams: np.ndarray) -> np.ndarray:
        """Bits of the last byte of each window after the others."""
        return -sum(np.log2(self.probability(grams, bit)) for bit in range(8))


def bucket(x: np.ndarray) -> np.ndarray:
    return np.rint(x * 3).astype(np.int64) + BUCKETS // 2


def _merge(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    found, where = np.unique(np.concatenate(keys), return_inverse=True)
    return found, np.bincount(where, np.concatenate(counts), len(found)).astype(np.int64)


def corpus_counts(texts: DataFrame) -> DataFrame:
    """Rows (kind, key, n) over one text column: `w` word hashes and `g` windows; a task sends each key once in a while."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[list, list]] = {"w": ([], []), "g": ([], [])}

        def flush(kind: str) -> Iterator[pa.RecordBatch]:
            if held[kind][0]:
                keys, n = _merge(*held[kind])
                held[kind] = ([keys], [n])
                for i in range(0, len(keys), 1 << 16):
                    part = slice(i, i + (1 << 16))
                    yield pa.RecordBatch.from_arrays([pa.array([kind] * len(keys[part])), pa.array(keys[part]), pa.array(n[part])], ["kind", "key", "n"])
                held[kind] = ([], [])

        for batch in sliced(batches, 0, SLICE):
            raw = encoded(batch.column(0))
            for kind, keys in (("w", sh.words(raw)[0].view(np.int64)), ("g", windows(raw)[0])):
                found, n = np.unique(keys, return_counts=True)
                held[kind][0].append(found)
                held[kind][1].append(n)
                if sum(map(len, held[kind][0])) > 2_000_000:
                    keys, n = _merge(*held[kind])
                    held[kind] = ([keys], [n])
                    if len(keys) > 1_200_000:
                        yield from flush(kind)
        yield from flush("w")
        yield from flush("g")

    counted = texts.mapInArrow(run, "kind string, key long, n long")
    return counted.groupBy("kind", "key").agg(F.sum("n").alias("n"))


def _tables(grams: DataFrame) -> list[np.ndarray]:
    """The predictors' tables: fixed in size, summed by Spark."""
    first = np.concatenate([[0], np.cumsum(SIZES)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for bit in range(8):
                real = (keys >> (7 - bit)) & 1
                for order in range(ORDER + 1):
                    at, where = np.unique((slots(keys, order, bit) + first[order]) * 2 + real, return_inverse=True)
                    total = np.bincount(where, n, len(at)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total)], ["at", "n"])

    summed = grams.select("key", "n").mapInArrow(run, "at int, n long").groupBy("at").agg(F.sum("n").cast("float").alias("n"))
    table = summed.toArrow()  # at most 2 * sum(SIZES) rows
    flat = np.zeros(2 * int(first[-1]), np.float32)
    flat[table["at"].to_numpy()] = table["n"].to_numpy()
    # Half precision keeps the tables small; very frequent slots are scaled, which keeps their odds.
    pairs = flat.reshape(-1, 2)
    pairs /= np.maximum(pairs.max(axis=1, keepdims=True) / 60_000, 1)
    return [pairs[a:b].astype(np.float16) for a, b in zip(first[:-1], first[1:])]


def _round(grams: DataFrame, shared) -> np.ndarray:
    """Weights after one online pass of every shard, averaged by what each shard has seen."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, seen = None, np.zeros(GATES)
        for batch in batches:
            if model is None:
                model = Model(shared.value.counts, shared.value.weights.copy())
            for i in range(0, batch.num_rows, BATCH):
                part = batch.slice(i, BATCH)
                keys, n = part.column(0).to_numpy(), part.column(1).to_numpy().astype(np.float64)
                for bit in range(8):
                    odds, gate, real = model.inputs(keys, bit, True)
                    p = 1 / (1 + np.exp(-model.mixed(odds, gate)))
                    slope = np.stack([np.bincount(gate, n * (real - p) * odds[:, j], GATES) for j in range(ORDER + 2)], axis=1)
                    curve = np.stack([np.bincount(gate, n * (p * (1 - p) + 0.001) * odds[:, j] ** 2, GATES) for j in range(ORDER + 2)], axis=1)
                    total = np.bincount(gate, n, GATES)
                    # Gates met a few times take small steps.
                    model.weights += np.clip(RATE * slope / (curve + 1), -0.05, 0.05)
                    seen += total
        if model is not None:
            rows = [(g, model.weights[g].tolist(), float(seen[g])) for g in range(GATES) if seen[g]]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), (pa.int32(), pa.list_(pa.float64()), pa.float64()))], ["gate", "w", "seen"])

    seen = grams.select("key", "n").mapInArrow(run, "gate int, w array<double>, seen double")
    each = seen.select("gate", "seen", F.posexplode("w").alias("j", "x")).groupBy("gate", "j").agg((F.sum(F.col("x") * F.col("seen")) / F.sum("seen")).alias("x"))
    weights = shared.value.weights.copy()
    for r in each.collect():  # gates x inputs
        weights[r["gate"], r["j"]] = r["x"]
    return weights


def _refinement(grams: DataFrame, shared) -> np.ndarray:
    """What really came, by gate and bucket of the mixed odds; the bucket's own odds count like 20 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, ones = np.zeros(GATES * BUCKETS), np.zeros(GATES * BUCKETS)
        for batch in batches:
            keys, n = batch.column(0).to_numpy(), batch.column(1).to_numpy().astype(np.float64)
            for bit in range(8):
                odds, gate, real = shared.value.inputs(keys, bit, True)
                at = gate * BUCKETS + bucket(shared.value.mixed(odds, gate))
                total += np.bincount(at, n, len(total))
                ones += np.bincount(at, n * real, len(ones))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at]), pa.array(ones[at])], ["at", "n", "ones"])

    prior = 1 / (1 + np.exp(-(np.arange(BUCKETS) - BUCKETS // 2) / 3))
    total, ones = np.full(GATES * BUCKETS, 20.0), np.tile(prior * 20, GATES)
    summed = grams.select("key", "n").mapInArrow(run, "at int, n double, ones double").groupBy("at").agg(F.sum("n").alias("n"), F.sum("ones").alias("ones"))
    for r in summed.collect():  # gates x buckets
        total[r["at"]] += r["n"]
        ones[r["at"]] += r["ones"]
    return (ones / total).reshape(GATES, BUCKETS)


def train(counts: DataFrame, rounds: int = ROUNDS) -> Model:
    """A model from `corpus_counts`; without training text every bit costs one."""
    spark = counts.sparkSession
    # Shards meet the windows in an order without meaning.
    grams = counts.filter("kind = 'g'").select("key", "n")
    model = Model(_tables(grams), np.zeros((GATES, ORDER + 2)))
    model.weights[:, : ORDER + 1] = 0.3
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(model)
        model = Model(model.counts, _round(grams, shared))
        shared.destroy()
    shared = spark.sparkContext.broadcast(model)
    model.refined = _refinement(grams, shared)
    shared.destroy()
    return model


def held_out(key: str) -> Column:
    """crc32 of the key as text, modulo 10, is 0; a null key counts as empty text, whose remainder is 0."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def frequent(vocabulary: DataFrame, most: int = FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes and counts of the words above the smallest count that at most `most` words reach."""
    by_count = vocabulary.groupBy("n").count().orderBy(F.desc("n"))
    at_least, held = None, 0
    for r in by_count.toLocalIterator():
        if held + r["count"] > most:
            break
        held += r["count"]
        at_least = r["n"]
    if at_least is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    table = vocabulary.filter(F.col("n") >= at_least).select("key", "n").toArrow()
    keys, n = table["key"].to_numpy(), table["n"].to_numpy()
    order = np.argsort(keys)
    return keys[order], n[order]


class Costs:
    """Costs of windows, remembered between slices as sorted arrays; the limit bounds memory, never the result."""

    def __init__(self, model: Model, limit: int = 1_500_000):
        self.model, self.limit = model, limit
        self.keys, self.bits = np.zeros(0, np.int64), np.zeros(0)

    def of(self, found: np.ndarray) -> np.ndarray:
        """Costs of sorted distinct windows."""
        at = np.searchsorted(self.keys, found)
        known = np.zeros(len(found), bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == found[inside]
        out = np.empty(len(found))
        out[known] = self.bits[at[known]]
        new = np.flatnonzero(~known)
        for i in range(0, len(new), 1 << 16):
            part = new[i : i + (1 << 16)]
            out[part] = self.model.cost(found[part])
        if len(self.keys) + len(new) > self.limit:
            self.keys, self.bits = found, out
        elif len(new):
            self.keys, self.bits = np.insert(self.keys, at[new], found[new]), np.insert(self.bits, at[new], out[new])
        return out


def _score(shared, end_count: int):
    """Per text: tokens, known ones and their log sum, words left to join, and the model's bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, keys, counts = shared.value
        logs, costs = np.log10(counts + 0.1), Costs(model)
        for batch in sliced(batches, 1, SLICE):
            raw = encoded(batch.column(1))
            grams, at = windows(raw)
            found, where = np.unique(grams, return_inverse=True)
            bits = np.add.reduceat(costs.of(found)[where], at[:-1])
            hashes, starts, offsets, _ = sh.words(raw)
            first = np.searchsorted(starts, offsets)
            n_words = np.diff(first)
            words, where = np.unique(hashes.view(np.int64), return_inverse=True)
            place = np.minimum(np.searchsorted(keys, words), max(len(keys) - 1, 0))
            hit = keys[place] == words if len(keys) else np.zeros(len(words), bool)
            value = np.where(hit, logs[place] if len(keys) else 0.0, 0.0)
            sums = lambda x: np.diff(np.concatenate([[0.0], np.cumsum(x[where])])[first])
            one = lambda x: np.array([x[where[a:b]].sum() for a, b in zip(first[:-1], first[1:])])
            known = sums(hit.astype(np.float64)).astype(np.int64) + (end_count > 0)
            rare = np.flatnonzero(~hit[where])
            cuts = np.searchsorted(rare, first).astype(np.int32)
            left = pa.ListArray.from_arrays(pa.array(cuts), pa.array(words[where[rare]]))
            columns = [pa.array(n_words + 1), pa.array(known), pa.array(one(value) + np.log10(end_count + 0.1)), left, pa.array(-bits * np.log10(2)), pa.array([len(t) for t in raw])]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "n_tokens", "known", "logs", "rare", "score", "n_bytes"])

    return run


def score(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte), one per row of `docs`.

    The model learns from the rows that are not held out. Null and empty texts are one end token; repeated rows are
    all counted and answered; a null key is held out; an empty table gives no rows; without any training
    text the base is uniform over one unknown token and every bit costs one. Other columns are ignored.
    bits_per_byte counts the end mark as a byte.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("doc_id"), text)
    learned = rows.filter(~held_out("doc_id")).select(text)
    counts = reread(spark, corpus_counts(learned), "lm-counts")
    vocabulary = counts.filter("kind = 'w'").select("key", "n")
    size = vocabulary.agg(F.count(F.lit(1)).alias("v"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    ends = learned.count()
    total, distinct = size["n"] + ends, size["v"] + (ends > 0)
    shared = spark.sparkContext.broadcast((train(counts), *frequent(vocabulary)))
    schema = "doc_id " + dict(rows.dtypes)["doc_id"] + ", n_tokens long, known long, logs double, rare array<long>, score double, n_bytes long"
    found = rows.mapInArrow(_score(shared, ends), schema).withColumn("row", F.monotonically_increasing_id())
    found = reread(spark, found, "lm-scores")
    shared.destroy()
    rare = found.select("row", F.explode("rare").alias("key")).groupBy("row", "key").agg(F.count(F.lit(1)).alias("times"))
    joined = rare.join(vocabulary, "key", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    more = joined.groupBy("row").agg(F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("more_known"), F.sum(F.col("times") * F.log10(F.col("n") + 0.1)).alias("more_logs"))
    out = found.drop("rare").join(more, "row", "left")
    whole = F.lit(float(np.log10(total + 0.1 * (distinct + 1))))
    return out.select(
        F.col("doc_id").alias(key),
        held_out("doc_id").alias("held_out"),
        "n_tokens",
        (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("logs") + F.coalesce("more_logs", F.lit(0.0)) - F.col("n_tokens") * whole).alias("base_score"),
        "score",
        (-F.col("score") / float(np.log10(2)) / (F.col("n_bytes") + 1)).alias("bits_per_byte"),
    )
