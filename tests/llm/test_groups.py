"""Duplicates, neighbours and URL filters against brute force."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest

from airloom.llm import graph, near_dup, neighbours, paragraphs, queries, url_filter
from tests.compare import compare, connect
from tests.llm.conftest import SCHEMA, prose


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(zip(*[w[i:] for i in range(5)])) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def alike(a, b, percent=75):
    return 100 * len(a & b) >= percent * len(a | b)


class Groups:
    def __init__(self):
        self.up = {}

    def find(self, a):
        self.up.setdefault(a, a)
        while self.up[a] != a:
            a = self.up[a]
        return a

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def plain_components(rows):
    """{doc_id: smallest linked id} over all pairs of rows."""
    groups = Groups()
    sets = [(r["doc_id"], shingles(r["text"])) for r in rows if r["doc_id"] is not None]
    for i, (a, x) in enumerate(sets):
        groups.find(a)
        for b, y in sets[:i]:
            if x and y and alike(x, y):
                groups.join(a, b)
    return {a: groups.find(a) for a, _ in sets}


def test_near_duplicates(spark, corpus, empty, clashing):
    rows = corpus.collect()
    part = plain_components(rows)
    want = Counter((r["doc_id"], len(shingles(r["text"])), part.get(r["doc_id"]), r["doc_id"] is None or part[r["doc_id"]] == r["doc_id"]) for r in rows)
    out = near_dup.near_duplicates(clashing).collect()
    assert Counter(tuple(r) for r in out) == want
    assert near_dup.near_duplicates(empty).count() == 0


def test_hot_group_of_edited_copies(spark):
    """Copies of one text whose pairs lie on both sides of the threshold, and chains of edits."""
    rng = random.Random(5)
    base = prose(rng, 160).split()
    texts = []
    for _ in range(120):
        w = base[:]
        for _ in range(rng.choice((0, 1, 2, 4, 6, 8))):
            w[rng.randrange(len(w))] = prose(rng, 1) + "x"
        texts.append(" ".join(w))
    step = base[:]
    for i in range(0, 60, 4):
        step[i] = f"chain{i}"
        texts.append(" ".join(step))
    rng.shuffle(texts)
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], SCHEMA)
    want = plain_components(docs.collect())
    got = {r["doc_id"]: r["component_id"] for r in near_dup.near_duplicates(docs).collect()}
    assert got == want


def test_components_of_paths_and_stars(spark):
    rng = random.Random(1)
    ids = rng.sample(range(10_000), 400)
    edges = list(zip(ids[:150], ids[1:150])) + [(ids[200], x) for x in ids[201:300]] + [(ids[300], ids[300])]
    groups = Groups()
    for a, b in edges:
        groups.join(a, b)
    got = {r["id"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {a: groups.find(a) for a in got} and len(got) == 250
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_repeats(rows, percent=75):
    """{(doc_id, line): (keep, removed)} of repeated paragraphs by all pairs."""
    found = {}
    for r in rows:
        if r["doc_id"] is not None and r["text"]:
            for i, line in enumerate(r["text"].split("\n")):
                if len(line.encode().split()) >= paragraphs.MIN_WORDS:
                    found.setdefault((r["doc_id"], i), []).append(shingles(line))
    groups, places = Groups(), sorted(found)
    for i, a in enumerate(places):
        groups.find(a)
        for b in places[:i]:
            if any(alike(x, y, percent) for x in found[a] for y in found[b]):
                groups.join(a, b)
    size = Counter(groups.find(a) for a in places)
    return {a: groups.find(a) for a in places if size[groups.find(a)] > 1}


def test_paragraphs(spark, corpus, empty, clashing):
    assert paragraphs.tuned(0.75, 0.999, 20) == (19, 4)
    unique = corpus.filter("doc_id is null or doc_id <> 5")
    rows = unique.collect()
    want = plain_repeats(rows)
    out = paragraphs.repeated(clashing.filter("doc_id is null or doc_id <> 5")).collect()
    assert {(r["doc_id"], r["line"]): (r["keep_id"], r["keep_line"]) for r in out} == want
    texts = {r["doc_id"]: r["text"] for r in rows}
    for r in out:
        assert texts[r["doc_id"]][r["start"] : r["end"]] == texts[r["doc_id"]].split("\n")[r["line"]]
        assert r["removed"] == ((r["doc_id"], r["line"]) != (r["keep_id"], r["keep_line"]))
    assert {20, 21, 22, 23, 24, 25} <= {r["doc_id"] for r in out}
    gone = {}
    for r in out:
        if r["removed"]:
            gone.setdefault(r["doc_id"], set()).add(r["line"])
    edited = lambda i, t: t if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone.get(i, ()))
    kept = paragraphs.remove(unique)
    assert Counter((r["doc_id"], r["text"]) for r in kept.collect()) == Counter((r["doc_id"], edited(r["doc_id"], r["text"])) for r in rows)
    assert paragraphs.repeated(empty).count() == 0 and paragraphs.remove(empty).count() == 0


def test_passages_inside_and_across_lines(spark):
    """Passages planted inside lines, across line ends, in short lines, twice in a text; loops and short runs are none."""
    from airloom.llm import passages

    assert passages.WORDS == paragraphs.MIN_WORDS
    rng = random.Random(8)
    passage = [f"é{prose(rng, 1)}{i}" for i in range(65)]
    short = [f"k{i}" for i in range(49)]
    own = lambda n: " ".join(f"{prose(rng, 1)}{rng.random()}" for _ in range(n))
    line, wrapped = " ".join(passage), "\n".join(" ".join(passage[i : i + 9]) for i in range(0, 65, 9))
    texts = [f"{own(200)} {line} {own(120)}", f"{own(90)}\n{own(30)} {wrapped} {own(9)}\n\n{own(8)}", f"{own(300)} {line.upper().replace('É', 'é')} {own(80)} {line} {own(99)}"]
    texts += [f"{own(90)} {' '.join(short)} {own(90)}" for _ in range(2)] + [" ".join(["same words again"] * 80)]
    edited = [own(7) for _ in range(20)]
    texts += ["\n".join(edited), own(60) + "\n" + "\n".join([*edited[:12], own(7), *edited[13:]])]
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([*rows, rows[1], (None, texts[0], "en", "s", 1)], SCHEMA)
    out = [r for r in paragraphs.repeated(docs).collect()]
    shown = lambda r: texts[r["doc_id"]][r["start"] : r["end"]].lower().split()
    inside = [r for r in out if r["doc_id"] < 6]
    assert Counter((r["doc_id"], r["removed"]) for r in inside) == Counter({(0, False): 1, (1, True): 1, (2, True): 2})
    assert all(shown(r) == line.lower().split() and r["n_words"] == 65 and (r["keep_id"], r["keep_line"]) == (0, 0) for r in inside)
    assert [r["line"] for r in inside if r["doc_id"] == 1] == [1]
    assert {(r["doc_id"], r["line"], r["removed"]) for r in out if r["doc_id"] >= 6} == {(6, 0, False), (7, 1, True)}
    got = {r["doc_id"]: r["text"] for r in paragraphs.remove(docs).filter("doc_id is not null").collect()}
    assert [got[i] for i in (0, 3, 4, 5, 6)] == [texts[i] for i in (0, 3, 4, 5, 6)]
    assert got[1].split() == texts[1].replace(wrapped, "").split() and got[1].count("\n") == 3
    assert got[2].split() == [w for w in texts[2].split() if w.lower() not in set(line.lower().split())]
    assert got[7] == texts[7].split("\n")[0]


def plain_windows(texts):
    """Words of each text in a window of 50 that occurs in an earlier place; texts without loops."""
    seen, gone = set(), [set() for _ in texts]
    for i, text in enumerate(texts):
        w = text.split()
        for p in range(len(w) - 49):
            window = tuple(w[p : p + 50])
            if window in seen:
                gone[i].update(range(p, p + 50))
            seen.add(window)
    return gone


def test_passages_equal_brute_force(spark):
    rng = random.Random(9)
    pool = [f"w{i}" for i in range(4_000)]
    texts = []
    for i in range(40):
        w = [rng.choice(pool) for _ in range(150)]
        for _ in range(3):
            if texts:
                source = rng.choice(texts).split()
                a = rng.randrange(len(source) - 40)
                b, at = a + rng.randrange(30, 90), rng.randrange(len(w))
                w[at:at] = source[a:b]
        texts.append(" ".join(w))
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], SCHEMA)
    out = paragraphs.repeated(docs, percent=99)
    gone = [set() for _ in texts]
    for r in out.filter("removed").collect():
        first = len(texts[r["doc_id"]][: r["start"]].split())
        gone[r["doc_id"]].update(range(first, first + r["n_words"]))
    assert gone == plain_windows(texts) and sum(map(len, gone)) > 500


def test_neighbours(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((3_000, 16)).astype(np.float32)
    x[7] = x[8] = x[1_000] = x[2_000]
    rows = [(i, v.tolist(), "n") for i, v in enumerate(x)]
    rows += [(5_000, None, ""), (5_001, [0.0] * 16, ""), (5_002, [float("nan")] * 16, ""), (5_003, [None] + [1.0] * 15, ""), (None, [1.0] * 16, ""), (5_100, [1.0, 2.0], ""), rows[3], (100, None, "")]
    schema = "vec_id long, embedding array<float>, score string"
    table = spark.createDataFrame(rows, schema)
    out = neighbours.nearest(table, neighbours.divisible("vec_id", 100))
    got = {}
    for r in out.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r)
    ids, points = np.arange(3_000), x.astype(np.float64)
    want = neighbours.exact_rows(ids, points, [i for i in range(0, 3_000, 100)], 10)
    assert set(got) == set(want) and all([r["rank"] for r in rs] == list(range(1, 11)) for rs in got.values())
    hits = sum(len({r["vec_id"] for r in got[q]} & set(want[q])) for q in want)
    assert hits / (10 * len(want)) >= 0.9
    assert [r["vec_id"] for r in got[1_000]][:3] == [7, 8, 2_000] and got[1_000][0]["score"] == 0.0
    for q, rs in got.items():
        assert all(abs(r["score"] - np.sqrt(((points[q] - points[r["vec_id"]]) ** 2).sum())) < 1e-12 for r in rs)
    assert neighbours.nearest(spark.createDataFrame([], schema), neighbours.divisible("vec_id", 100)).count() == 0
    few = neighbours.nearest(spark.createDataFrame(rows[:3], schema), neighbours.divisible("vec_id", 100)).collect()
    assert [r["vec_id"] for r in sorted(few, key=lambda r: r["rank"])] and len(few) == 2


def test_neighbours_of_ids_with_several_vectors(spark):
    """An id with two vectors is one candidate and asks with both: nearest by any, nothing lost."""
    rng = np.random.default_rng(4)
    x = rng.standard_normal((12, 8))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(3, (x[0] + 0.01).tolist()), (3, x[5].tolist()), (0, (x[7] + 0.5).tolist())]
    out = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), neighbours.divisible("vec_id", 100)).orderBy("rank").collect()
    own = [np.array(v) for i, v in rows if i == 0]
    best = {}
    for i, v in rows:
        if i:
            best[i] = min([best.get(i, np.inf), *[float(np.sqrt(((np.array(v) - o) ** 2).sum())) for o in own]])
    want = sorted((d, i) for i, d in best.items())[:10]
    assert [r["vec_id"] for r in out] == [i for _, i in want] and [r["rank"] for r in out] == list(range(1, 11))
    assert all(abs(r["score"] - d) < 1e-12 for r, (d, _) in zip(out, want))


def test_recall_on_the_given_vectors(spark):
    folder = "/root/testdata/sf0.1"
    table = spark.read.parquet(f"{folder}/embeddings.parquet").toPandas()
    x = np.stack(table["embedding"].to_numpy()).astype(np.float64)
    ids = table["vec_id"].to_numpy()
    want = neighbours.exact_rows(ids, x, [i for i in ids if i % 100 == 0], 10)
    hits = sum(r["vec_id"] in want[r["query_id"]] for r in queries.QUERIES["op8_neighbours"](spark, folder).collect())
    assert hits >= 0.9 * sum(map(len, want.values()))


URLS = ["http://A.Example.ORG/es/x?y#z", "https://example.org/en/12", "https://example.org/en/2", "ftp://x.com/fr/1", "//nothing", None, "", "http://", "http://x.com", "http://x.com/de/?://a", "http://notexample.org.net/es/", "http://ads.x.net/p", "http://x.net/p", "a://b://c/d", "http://x.net?q=/es/"]


def test_url_rules_and_list(spark):
    from pyspark.sql import functions as F

    table = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(URLS + URLS[:3])], "page_id long, url string, verdict string")
    listed = spark.createDataFrame([("ads.x.net/p",), (None,), ("never.seen/",), ("ads.x.net/p",)], "key string")
    out = {r["page_id"]: r for r in url_filter.judge(table, queries.RULES, listed, F.concat("host", "path")).collect()}
    pick = lambda i: tuple(out[i][c] for c in ("host", "path", "rule", "verdict"))
    assert pick(0) == ("a.example.org", "/es/x", "example.org/es/", "block") == pick(15)
    assert pick(1)[2:] == ("example.org/en/1", "block") and pick(2)[2:] == ("org/", "allow")
    assert pick(3)[2:] == ("com/fr/", "allow") and pick(9)[1:] == ("/de/", "com/de/", "block")
    assert pick(4) == pick(5) == pick(6) == pick(7) == ("", "", None, "allow")
    assert pick(8) == ("x.com", "", None, "allow") and pick(10)[2:] == (None, "allow")
    assert pick(11)[2:] == (None, "block") and pick(12)[2:] == (None, "allow")
    assert pick(13)[:2] == ("b:", "//c/d") and pick(14)[:2] == ("x.net", "")
    assert url_filter.judge(table.limit(0), queries.RULES, listed, F.concat("host", "path")).count() == 0
    assert url_filter.judge(table, queries.RULES, listed.limit(0), F.concat("host", "path")).filter("verdict = 'block'").count() == 5


@pytest.mark.parametrize("sizes", [{}, {"shard_keys": 40, "group_bytes": 400}])
def test_cascade_is_exact(spark, sizes):
    """Every key of the universe, with one group and with passes over several."""
    from pyspark.sql import functions as F

    universe = spark.range(4_000).select(F.concat(F.lit("k"), F.col("id")).alias("key"))
    listed = universe.filter(F.expr("pmod(hash(key), 13) = 0"))
    cascades = url_filter.build(universe, listed, **sizes)
    assert (len(cascades) > 1) == bool(sizes)
    marked = url_filter.mark(universe.withColumn("want", F.expr("pmod(hash(key), 13) = 0")), F.col("key"), cascades)
    assert marked.count() == 4_000 and marked.filter("want <> listed").count() == 0


def test_url_query_equals_sql(spark):
    folder = "/root/testdata/sf0.01"
    ok, note = compare(spark, connect(folder), "op6_url_filter", queries.QUERIES["op6_url_filter"], queries.SQL["op6_url_filter"], folder)
    assert ok, note
