"""Quality scores of whole texts from random-indexing word vectors and a small network.

Every word has a sparse random index vector; a word's vector is the sum of the index vectors around all its occurrences
in the corpus, counted in integers by Spark. A document is the pool of its words' vectors: mean, mean square and mean
product of neighbours. A two-layer network on numpy is fitted to a bounded sample of labelled pools, and one temperature,
fitted to labelled rows that the weights never saw, makes its outputs probabilities.

Words with less than SHARE of all words are seen by their shape (letters, digits and marks, runs made one), so there are
at most 1 / SHARE word vectors and SHAPES more, whatever the corpus.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airloom.llm.common import discard, encoded, reread, sliced

SHARE = 1 / 200_000
SHAPES = 4096
SIZE, ENTRIES, WINDOW = 32, 4, 2  # numbers of a vector, those of an index vector that are not 0, words on each side
FIT_ROWS = 20_000  # labelled documents that the network is fitted to, at most
HIDDEN, EPOCHS, BATCH, RATE, DECAY = 32, 40, 256, 3e-3, 1e-4
BLOCK = 1 << 16  # words pooled at a time
THRESHOLD = 0.3
SPACE = r"[\x20\x09-\x0D]+"
FEATURES = 3 * SIZE + 1


def fold(key):
    """crc32 of the id as text, modulo 5; a null id counts as empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % 5


KINDS = bytes(97 if 97 <= c <= 122 or c >= 128 else 65 if 65 <= c <= 90 else 48 if 48 <= c <= 57 else c for c in range(256))
RUNS = re.compile(rb"(.)\1+", re.S).sub


@lru_cache(1 << 15)
def _bucket(kinds: bytes) -> int:
    return zlib.crc32(RUNS(rb"\1", kinds)) % SHAPES


def shape(word: bytes) -> int:
    """Bucket of a word's shape: `Th33###` is `Aa0#`; all letters beyond ASCII count as small ones."""
    return _bucket(word.translate(KINDS))


class Words(dict):
    """Row of each word in the table of vectors; rare words get that of their shape and are remembered for a while."""

    def __init__(self, words: list[bytes]):
        super().__init__(zip(words, range(len(words))))
        self.known = len(words)
        self.rare: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        if len(self.rare) > 200_000:
            for w in self.rare:
                del self[w]
            self.rare.clear()
        self.rare.append(word)
        row = self[word] = self.known + shape(word)
        return row


def index_vectors(hashes: np.ndarray) -> np.ndarray:
    """Sparse random vectors of +1 and -1 from 64-bit hashes."""
    bits = hashes.astype(np.int64).view(np.uint64)
    out = np.zeros((len(bits), SIZE), np.int32)
    for k in range(ENTRIES):
        at = (bits >> np.uint64(8 * k)) % np.uint64(SIZE)
        sign = ((bits >> np.uint64(40 + k)) & np.uint64(1)).astype(np.int32) * 2 - 1
        np.add.at(out, (np.arange(len(bits)), at.astype(np.int64)), sign)
    return out


def _mixed(numbers: np.ndarray) -> np.ndarray:
    x = (numbers.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)).view(np.int64)


def frequent_words(docs: DataFrame, text: str = "text", share: float = SHARE) -> DataFrame:
    """Rows (word, hash) of the words that make up at least `share` of all words: at most 1 / share rows."""
    words = docs.select(F.explode(F.split(F.col(text), SPACE)).alias("word")).filter("word <> ''")
    counts = reread(docs.sparkSession, words.groupBy("word").count(), "word-counts")
    total = counts.agg(F.sum("count").alias("total"))
    return counts.filter(F.col("count") >= F.lit(share) * total.select("total").scalar()).select("word", F.xxhash64("word").alias("hash"))


_TABLES: dict = {}


def _words(vocabulary) -> Words:
    """One table per worker process and vocabulary."""
    name, words, _ = vocabulary.value
    if name not in _TABLES:
        _TABLES.clear()
        _TABLES[name] = Words(words.to_pylist())
    return _TABLES[name]


def _rows(table: Words, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of all words end to end, and where each text begins and the last ends."""
    cut = [t.split() for t in texts]
    bounds = np.concatenate([[0], np.cumsum([len(c) for c in cut])]).astype(np.int64)
    return np.fromiter(map(table.__getitem__, chain.from_iterable(cut)), np.int64, int(bounds[-1])), bounds


def _around(index: np.ndarray, rows: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of the index vectors within WINDOW words of each word, inside its text."""
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    own, out = index[rows].astype(np.int8), np.zeros((len(rows), SIZE), np.int8)
    for k in range(1, WINDOW + 1):
        same = (doc[k:] == doc[:-k])[:, None]
        out[k:] += own[:-k] * same
        out[:-k] += own[k:] * same
    return out


def word_vectors(docs: DataFrame, vocabulary, rows: int, text: str = "text") -> DataFrame:
    """Rows (row, n, s0, s1, ...): occurrences and summed surroundings of every row of the table of vectors."""
    names = [f"s{k}" for k in range(SIZE)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, index = _words(vocabulary), vocabulary.value[2]
        sums, n = np.zeros((rows, SIZE), np.int64), np.zeros(rows, np.int64)
        for batch in sliced(batches, 0, 1 << 20):
            found, bounds = _rows(table, encoded(batch.column(0)))
            if not len(found):
                continue
            order = np.argsort(found, kind="stable")
            distinct, first = np.unique(found[order], return_index=True)
            sums[distinct] += np.add.reduceat(_around(index, found, bounds)[order], first, axis=0, dtype=np.int32)
            n += np.bincount(found, minlength=rows)
        seen = np.flatnonzero(n)
        for start in range(0, len(seen), 1 << 14):
            part = seen[start : start + (1 << 14)]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(n[part]), *[pa.array(sums[part, k]) for k in range(SIZE)]], ["row", "n", *names])

    each = docs.select(text).mapInArrow(run, "row long, n long, " + ", ".join(f"{s} long" for s in names))
    return each.groupBy("row").agg(*[F.sum(c).alias(c) for c in ("n", *names)])


def _table(vectors: DataFrame, index: np.ndarray) -> np.ndarray:
    """Vectors of all rows: the direction of the surroundings without what all words share, and half the own index vector."""
    found = vectors.toArrow()
    sums = np.zeros(index.shape)
    at = found.column("row").to_numpy()
    sums[at] = np.stack([found.column(f"s{k}").to_numpy() for k in range(SIZE)], axis=1)
    sums /= np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
    if len(at):
        sums[at] -= np.average(sums[at], axis=0, weights=found.column("n").to_numpy())
    return (sums + index / (2 * np.sqrt(ENTRIES))).astype(np.float32)


def _pooled(vectors: np.ndarray, rows: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Mean, mean square, mean product of neighbours, and the logarithm of the length; zeros without words."""
    sums = np.zeros((len(bounds) - 1, 3 * SIZE))
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    for start in range(0, len(rows), BLOCK):
        part, of = vectors[rows[start : start + BLOCK + 1]], doc[start : start + BLOCK + 1]
        own = part[:BLOCK]
        after = np.zeros_like(own)
        after[: len(part) - 1] = own[: len(part) - 1] * part[1:] * (of[1:] == of[:-1])[:, None]
        texts, first = np.unique(of[:BLOCK], return_index=True)
        for k, part in enumerate((own, own * own, after)):
            sums[texts, k * SIZE : (k + 1) * SIZE] += np.add.reduceat(part, first, axis=0)
    n = np.diff(bounds)[:, None]
    return np.concatenate([sums / np.maximum(n, 1), np.log1p(n)], axis=1).astype(np.float32)


def pools(docs: DataFrame, vocabulary, vectors, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, pool array<float>): the pooled vectors of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _words(vocabulary)
        for batch in sliced(batches, 1, 1 << 20):
            flat = _pooled(vectors.value, *_rows(table, encoded(batch.column(1))))
            cuts = pa.array(np.arange(0, flat.size + 1, FEATURES), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(cuts, pa.array(flat.ravel()))], [key, "pool"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {dict(docs.dtypes)[key]}, pool array<float>")


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    """Two layers on standardised pools, fitted by Adam on the logistic loss; outputs are divided by a temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        rng = np.random.default_rng(1)
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-3
        self.w = [rng.normal(0, FEATURES**-0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
        self.temperature = 1.0
        x = self._standard(x)
        first, second = ([np.zeros_like(w) for w in self.w] for _ in range(2))
        step = 0
        for _ in range(EPOCHS):
            for at in np.array_split(rng.permutation(len(x)), max(1, len(x) // BATCH)):
                step += 1
                h = np.tanh(x[at] @ self.w[0] + self.w[1])
                error = (_sigmoid(h @ self.w[2] + self.w[3]) - y[at]) / len(at)
                back = np.outer(error, self.w[2]) * (1 - h * h)
                slopes = [x[at].T @ back + DECAY * self.w[0], back.sum(0), h.T @ error + DECAY * self.w[2], error.sum(keepdims=True)]
                for w, g, m, v in zip(self.w, slopes, first, second):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    w -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)

    def _standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -10, 10)

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(self._standard(x) @ self.w[0] + self.w[1]) @ self.w[2] + self.w[3]

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        """The temperature with the least logistic loss on rows kept from the fit."""
        logits, grid = self.logits(x), np.exp(np.linspace(-1.5, 3, 181))
        loss = [np.logaddexp(0, np.where(y > 0, -logits, logits) / t).mean() for t in grid]
        self.temperature = float(grid[int(np.argmin(loss))])

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.logits(x) / self.temperature)


class Constant:
    """Where labels of one kind only, or none, are known: their share, drawn towards a half."""

    def __init__(self, y: np.ndarray):
        self.share = (y.sum() + 1) / (len(y) + 2)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), self.share)


def fit(x: np.ndarray, y: np.ndarray, kept: np.ndarray) -> Network | Constant:
    """A network from labelled pools; rows marked `kept` only set its temperature."""
    if len(np.unique(y[~kept])) < 2:
        return Constant(y)
    network = Network(x[~kept], y[~kept])
    if len(np.unique(y[kept])) == 2:
        network.calibrate(x[kept], y[kept])
    return network


def _sample(labels: DataFrame, key: str, rows: int) -> DataFrame:
    """At most `rows` labelled ids outside the held-out fold, by hash; an id with as many labels 0 as 1 teaches nothing."""
    votes = labels.filter(F.col(key).isNotNull() & F.col("quality").isin(0, 1)).groupBy(F.col(key).alias("_id")).agg(F.sum(F.col("quality") * 2 - 1).alias("vote"))
    known = votes.filter("vote <> 0").select("_id", (F.col("vote") > 0).cast("int").alias("label"), fold(F.col("_id")).alias("fold"))
    return known.filter("fold <> 0").orderBy(F.xxhash64("_id"), "_id").limit(rows)


def score(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", fit_rows: int = FIT_ROWS, share: float = SHARE) -> DataFrame:
    """Rows (key, held_out, score, predicted) of every document.

    `labels` has the key and quality (0 or 1; others and nulls are passed over). Ids with crc32 modulo 5 of 0 are held
    out: their labels are never used; modulo 1 sets the temperature, the others the weights. Vectors come from all
    texts. Null and empty texts pool to zeros and are scored like any other; repeated rows stay; a null id is held out;
    without labels of both kinds every score is their share. An empty table gives no rows; other columns are ignored,
    whatever their names. A task holds one table of vectors (at most 1 / share + SHAPES rows) and a slice of texts.
    """
    spark = docs.sparkSession
    words = frequent_words(docs, text, share).orderBy("word").toArrow()
    rows = words.num_rows + SHAPES
    index = index_vectors(np.concatenate([words.column("hash").to_numpy(), _mixed(np.arange(SHAPES))]))
    vocabulary = spark.sparkContext.broadcast((uuid.uuid4().hex, words.column("word").cast(pa.large_binary()).combine_chunks(), index))
    vectors = spark.sparkContext.broadcast(_table(word_vectors(docs, vocabulary, rows, text), index))
    pooled = reread(spark, pools(docs, vocabulary, vectors, key, text), "pools")
    vectors.destroy()
    vocabulary.destroy()
    chosen = reread(spark, _sample(labels, key, fit_rows), "labelled")
    taught = pooled.join(F.broadcast(chosen), F.col(key) == F.col("_id")).groupBy("_id", "label", "fold").agg(F.min("pool").alias("pool"))
    taught = taught.orderBy(F.xxhash64("_id"), "_id").toArrow()
    x = taught.column("pool").combine_chunks().flatten().to_numpy().reshape(-1, FEATURES).astype(np.float64)
    network = fit(x, taught.column("label").to_numpy().astype(np.float64), taught.column("fold").to_numpy() == 1)
    discard(chosen)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy().reshape(-1, FEATURES).astype(np.float64)
            p = network.probabilities(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32))], [key, "score", "predicted"])

    scored = pooled.mapInArrow(run, f"`{key}` {dict(docs.dtypes)[key]}, score double, predicted int")
    return scored.select(key, (fold(F.col(key)) == 0).alias("held_out"), "score", "predicted")
