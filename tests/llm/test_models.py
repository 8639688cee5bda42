"""Perplexity rules, language-model scores and the pipeline against plain versions."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from airloom.llm import context_mix, ngram_model, paragraphs, secret_scan
from airloom.llm.common import reread
from tests.llm.test_groups import plain_components, plain_repeats


def plain_base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen, twice = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            twice += line in seen
            seen.add(line)
    windows = Counter(zip(words, words[1:], words[2:]))
    marked = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    failed = len(words) < 50 or 100 * len(marked) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), twice, len(marked), failed


class PlainKneserNey:
    """Modified Kneser-Ney of folded characters, by dictionaries."""

    def __init__(self, texts):
        size = ngram_model.ORDER
        self.counts = {size: Counter()}
        for t in texts:
            folded = self.fold(t)
            for i in range(size - 1, len(folded)):
                self.counts[size][tuple(folded[i - size + 1 : i + 1])] += 1
        for k in range(size - 1, 0, -1):
            self.counts[k] = Counter(g[1:] for g in self.counts[k + 1])
        self.discounts, self.contexts = {}, {}
        for k, table in self.counts.items():
            t = [sum(n == i for n in table.values()) for i in range(5)]
            y = t[1] / (t[1] + 2 * t[2]) if t[1] else 0.5
            d = [0.0]
            for i in (1, 2, 3):
                x = i - (i + 1) * y * t[i + 1] / max(t[i], 1)
                d.append(x if t[i] and 0 < x < i else 0.5)
            self.discounts[k] = d
            held = self.contexts[k] = {}
            for g, n in table.items():
                total, freed = held.get(g[:-1], (0, 0.0))
                held[g[:-1]] = (total + n, freed + min(d[min(n, 3)], n))

    @staticmethod
    def fold(text):
        table = ngram_model._fold_table()
        return [0] * (ngram_model.ORDER - 1) + [int(table[ord(c)]) if ord(c) < 65536 else 63 for c in text]

    def p(self, gram):
        if not gram:
            return 1 / 64
        lower = self.p(gram[1:])
        k = len(gram)
        if gram[:-1] not in self.contexts[k]:
            return lower
        total, freed = self.contexts[k][gram[:-1]]
        n = self.counts[k][gram]
        return max(n - self.discounts[k][min(n, 3)], 0) / total + freed / total * lower

    def bits(self, text):
        folded, size = self.fold(text), ngram_model.ORDER
        return -sum(math.log2(self.p(tuple(folded[i - size + 1 : i + 1]))) for i in range(size - 1, len(folded))) / len(text)


def language(lang):
    return lang.lower() if lang and re.fullmatch("[a-zA-Z]{2}", lang) else "und"


def plain_verdicts(rows):
    """(kept, bits) of each row."""
    by = {}
    for r in rows:
        by.setdefault(language(r["lang"]), []).append(r["text"] or "")
    models = {k: PlainKneserNey(v) for k, v in by.items()}
    base = [plain_base(r["text"]) for r in rows]
    bits = [models[language(r["lang"])].bits(r["text"]) if r["text"] else None for r in rows]
    bands = {}
    for k in by:
        fit = {r["text"]: b for r, b, f in zip(rows, bits, base) if language(r["lang"]) == k and not f[5]}
        if fit:
            quantile = lambda values, q: sorted(values)[max(math.ceil(len(values) * q), 1) - 1]
            median = (quantile([math.floor(b * 1000) for b in fit.values()], 0.5) + 0.5) / 1000
            off = [math.floor((b - median) * math.sqrt(len(t)) * 100) for t, b in fit.items()]
            bands[k] = (median, max((quantile(off, 0.75) + 1 - quantile(off, 0.25)) / 100, ngram_model.LEAST_DISTANCE))
    out = []
    for r, b, f in zip(rows, bits, base):
        kept = not f[5]
        if kept:
            median, distance = bands[language(r["lang"])]
            root = math.sqrt(len(r["text"]))
            kept = median - distance * ngram_model.LOW_FENCE / root <= b <= median + ngram_model.HIGH_BITS + distance * ngram_model.HIGH_FENCE / root
        out.append((kept, b))
    return out


@pytest.fixture(scope="module")
def rows(corpus):
    # The plain model is slow on the very long text.
    return [r for r in corpus.collect() if not r["text"] or len(r["text"]) < 20_000]


def test_quality(spark, corpus, clashing, empty, rows):
    out = ngram_model.judge(clashing.filter("text is null or length(text) < 20000").drop("text").withColumn("text", F.lit(None).cast("string"))).count()
    assert out == len(rows)
    docs = corpus.filter("text is null or length(text) < 20000")
    got = ngram_model.judge(docs).collect()
    want = Counter((r["doc_id"], r["text"], *plain_base(r["text"]), kept) for r, (kept, _) in zip(rows, plain_verdicts(rows)))
    assert Counter((r["doc_id"], r["text"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"], r["kept"]) for r in got) == want
    bits = {(r["doc_id"], r["text"]): r["bits"] for r in got}
    for r, (_, b) in zip(rows, plain_verdicts(rows)):
        assert (bits[r["doc_id"], r["text"]] is None) if b is None else abs(bits[r["doc_id"], r["text"]] - b) < 1e-9
    assert ngram_model.judge(empty).count() == 0
    assert not any(r["kept"] for r in got if r["text"] and "###" in r["text"] and r["n_words"] > 50 and r["bits"] > r["high"])


def test_probabilities_sum_to_one(spark, corpus):
    counts = ngram_model.count_ngrams(corpus.filter("lang = 'fr'"))
    table = ngram_model.model(counts).filter("lang = 'fr'").toArrow()
    scorer = ngram_model.Scorer(table)
    for context in ngram_model.codes([b"the", b"zqx", b"an "])[0][[2, 5, 8]] & 0x3FFFF:
        p = scorer.probabilities((int(context) << 6 | np.arange(64)).astype(np.int32))
        assert abs(p.sum() - 1) < 1e-9


def test_language_model(spark, corpus, empty, clashing):
    data = corpus.collect()
    learned = [r for r in data if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 10]
    counts = Counter()
    for r in learned:
        counts.update((r["text"] or "").encode().lower().split())
        counts[None] += 1
    total, distinct = sum(counts.values()), len(counts)
    want = Counter()
    sums = {}
    for r in data:
        tokens = (r["text"] or "").encode().lower().split() + [None]
        key = (r["doc_id"], len(tokens), sum(counts[t] > 0 for t in tokens))
        want[key] += 1
        sums.setdefault(key, []).append(sum(math.log10((counts[t] + 0.1) / (total + 0.1 * (distinct + 1))) for t in tokens))
    got = context_mix.score(clashing.drop("score", "n_tokens")).collect()
    assert Counter((r["doc_id"], r["n_tokens"], r["n_known"]) for r in got) == want
    for r in got:
        assert r["train_tokens"] == total
        assert any(abs(r["base_score"] - x) < 1e-6 * max(1, abs(x)) for x in sums[r["doc_id"], r["n_tokens"], r["n_known"]])
        assert r["held_out"] == (zlib.crc32(("" if r["doc_id"] is None else str(r["doc_id"])).encode()) % 10 == 0)
        assert r["score"] < 0
    # Better than a byte model without context on what it has not seen.
    unseen = [(r["text"] or "").lower().encode() for r in data if r["doc_id"] is not None and not zlib.crc32(str(r["doc_id"]).encode()) % 10]
    letters = Counter(b for r in learned for b in (r["text"] or "").lower().encode())
    n = sum(letters.values())
    plain = sum(math.log10((letters[b] + 1) / (n + 256)) for t in unseen for b in t)
    assert sum(r["score"] for r in got if r["held_out"] and r["doc_id"] is not None) > 0.75 * plain
    assert context_mix.score(empty).count() == 0
    nothing = context_mix.score(corpus.filter("doc_id is null")).collect()
    assert all(r["n_known"] == 0 and r["train_tokens"] == 0 and abs(r["bits_per_byte"] - 8) < 0.5 for r in nothing)


def test_bits_sum_over_windows():
    grams, at = context_mix.windows([b"AB", b"", "é".encode()])
    assert at.tolist() == [0, 3, 4, 7]
    assert [int(g) & 0xFF for g in grams] == [0x61, 0x62, 0xFF, 0xFF, 0xC3, 0xA9, 0xFF]
    assert int(grams[3]) == int.from_bytes(b"\xff" * 6, "big")
    model = context_mix.Model([np.random.default_rng(0).random((n, 2), np.float32) * 9 for n in context_mix.SIZES], np.full((context_mix.GATES, context_mix.ORDER + 2), 0.2))
    all_bytes = (int(grams[1]) >> 8 << 8) | np.arange(256, dtype=np.int64)
    assert abs((2.0 ** -model.cost(all_bytes)).sum() - 1) < 1e-9


def test_pipeline(spark, corpus, rows):
    """Every stage against a plain version on its own input."""
    docs = reread(spark, corpus.filter("text is null or length(text) < 20000"), "input")
    stages = dict(corpus_pipeline.STAGES)
    seen = lambda df: Counter((r["doc_id"], r["text"]) for r in df.collect())
    kept = reread(spark, stages["quality_rules"](spark, docs, ""), "kept")
    data = docs.collect()
    assert kept.dtypes == docs.dtypes
    assert seen(kept) == Counter((r["doc_id"], r["text"]) for r, (k, _) in zip(data, plain_verdicts(data)) if k)
    single = reread(spark, stages["minhash_near_dedup"](spark, kept, ""), "single")
    part = plain_components(kept.collect())
    # Of rows that share an id stays the one with the smallest digest of its text; rows without an id all stay.
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want, nameless = {}, Counter()
    for r in kept.collect():
        if r["doc_id"] is None:
            nameless[(None, r["text"])] += 1
        elif part[r["doc_id"]] == r["doc_id"]:
            want[r["doc_id"]] = min(want.get(r["doc_id"], r["text"]), r["text"], key=digest)
    assert single.dtypes == docs.dtypes and seen(single) == Counter(want.items()) + nameless
    cut = reread(spark, stages["substring_dedup"](spark, single, ""), "cut")
    places = plain_repeats(single.collect())
    gone = {a for a, first in places.items() if a != first}
    assert gone and cut.dtypes == docs.dtypes
    short = lambda r: "\n".join(x for i, x in enumerate(r["text"].split("\n")) if (r["doc_id"], i) not in gone)
    assert seen(cut) == Counter((r["doc_id"], short(r)) for r in single.collect())
    clean = reread(spark, stages["secret_scans"](spark, cut, ""), "clean")
    spans = {r["doc_id"]: [s for s in r["spans"] if s["live"]] for r in secret_scan.find(cut).collect()}
    before = {r["doc_id"]: r["text"] for r in cut.collect()}
    for r in clean.collect():
        assert r["n_chars"] == len(r["text"])
        live = [before[r["doc_id"]][s["start"] : s["end"]] for s in spans[r["doc_id"]]]
        assert not any(x in r["text"] for x in live) and (live or r["text"] == before[r["doc_id"]])
    packed = stages["length_packing"](spark, clean, "").collect()
    assert sum(r["length"] for r in packed) == sum(len(r["text"].encode().split()) for r in clean.collect())


def test_pipeline_runs_on_a_folder(spark):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "minhash_near_dedup", "substring_dedup", "secret_scans", "length_packing"]
    assert paragraphs.MIN_WORDS == 50
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.count() > 100
