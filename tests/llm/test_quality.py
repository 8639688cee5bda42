"""Quality classifier: vectors and pools against plain loops, folds, held-out accuracy, odd inputs."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pyspark.sql.functions as F
import pytest

from airloom.llm import quality_classifier as qc
from airloom.llm.queries import QUERIES


def words_of(text):
    return [w for w in (text or "").encode().split()]


@pytest.fixture(scope="module")
def texts(corpus):
    return [r.text for r in corpus.select("text").collect()]


def test_frequent_words_by_share(corpus, texts):
    count = Counter(w for t in texts for w in words_of(t))
    total = sum(count.values())
    got = {r.word.encode() for r in qc.frequent_words(corpus, share=0.001).collect()}
    assert got == {w for w, n in count.items() if n >= 0.001 * total} and 0 < len(got) <= 1000


def test_word_vectors_equal_a_plain_loop(spark, corpus, texts):
    vocabulary = sorted({w for t in texts for w in words_of(t)}, key=lambda w: zlib.crc32(w))[:300]
    table = qc.Words(vocabulary)
    index = qc.index_vectors(qc._mixed(np.arange(len(vocabulary) + qc.SHAPES)))
    import pyarrow as pa

    held = spark.sparkContext.broadcast(("plain", pa.array(vocabulary, pa.large_binary()), index))
    sums, n = defaultdict(lambda: np.zeros(qc.SIZE, np.int64)), Counter()
    for t in texts:
        rows = [table[w] for w in words_of(t)]
        for i, r in enumerate(rows):
            n[r] += 1
            for j in range(max(0, i - qc.WINDOW), min(len(rows), i + qc.WINDOW + 1)):
                if i != j:
                    sums[r] += index[rows[j]]
    got = qc.word_vectors(corpus, held, len(index)).collect()
    assert {r.row: r.n for r in got} == dict(n)
    for r in got:
        assert [r[f"s{k}"] for k in range(qc.SIZE)] == sums[r.row].tolist()


@pytest.mark.parametrize("block", [3, 1 << 16])
def test_pools_equal_a_plain_loop(block, monkeypatch):
    monkeypatch.setattr(qc, "BLOCK", block)
    rng = np.random.default_rng(0)
    vectors = rng.normal(size=(20, qc.SIZE)).astype(np.float32)
    docs = [rng.integers(0, 20, n) for n in (0, 1, 2, 7, 0, 3, 40, 1)]
    bounds = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    got = qc._pooled(vectors, np.concatenate(docs), bounds)
    for d, row in zip(docs, got):
        v = vectors[d]
        want = np.zeros(qc.FEATURES)
        if len(d):
            want[: qc.SIZE], want[qc.SIZE : 2 * qc.SIZE] = v.mean(0), (v * v).mean(0)
            want[2 * qc.SIZE : -1] = (v[1:] * v[:-1]).sum(0) / len(d)
        want[-1] = np.log1p(len(d))
        np.testing.assert_allclose(row, want, rtol=1e-4, atol=1e-5)


def test_temperature_brings_confidence_down_to_the_truth():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, qc.FEATURES))
    y = (rng.random(3000) < qc._sigmoid(2 * x[:, 0])).astype(float)
    network = qc.fit(x, y, np.arange(3000) % 3 == 0)
    fresh = rng.normal(size=(4000, qc.FEATURES))
    p, true = network.probabilities(fresh), qc._sigmoid(2 * fresh[:, 0])
    assert network.temperature > 1.2 and abs(p.mean() - true.mean()) < 0.05
    sure = p > 0.9
    assert true[sure].mean() > 0.8


def test_held_out_labels_teach_nothing_and_junk_is_told(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    first = {r.doc_id: r for r in QUERIES["op11_quality_classifier"](spark, folder).collect()}
    assert len(first) == docs.count()
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    other = {r.doc_id: r.score for r in qc.score(docs, flipped).collect()}
    truth = {r.doc_id: r.quality for r in labels.collect()}
    right = []
    for i, r in first.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) and abs(r.score - other[i]) < 1e-9
        if r.held_out and i in truth:
            right.append(r.predicted == truth[i])
    assert len(right) > 50 and np.mean(right) > 0.9


def test_odd_rows_and_labels(spark, corpus, clashing, empty):
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(5, 0), (5, 1), (None, 1), (7, None), (8, 3)], "doc_id long, quality int")
    got = qc.score(corpus, labels).collect()
    assert len(got) == corpus.count() and all(r.score is not None for r in got)
    by = defaultdict(set)
    for r in got:
        by[r.doc_id].add(r.held_out)
    assert by[None] == {True}
    again = qc.score(clashing, labels).collect()
    assert sorted((str(r.doc_id), r.score) for r in got) == sorted((str(r.doc_id), r.score) for r in again)
    ones = labels.filter("quality = 1")
    assert len({r.score for r in qc.score(corpus, ones).collect()}) == 1
    assert {r.score for r in qc.score(corpus, labels.filter("false")).collect()} == {0.5}
    assert qc.score(empty, labels).count() == 0
