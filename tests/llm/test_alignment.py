"""Token alignment against a plain version that tokenizes whole texts."""

import hashlib
from collections import Counter

import numpy as np
import pytest

from airloom.llm import alignment
from airloom.llm.bpe import byte_letters
from airloom.llm.queries import QUERIES, vocabulary

A, B = vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")
COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def plain(rows):
    """Digest rows of (doc_id, text) by the words of the contract."""
    import sentencepiece
    from tokenizers import Tokenizer

    tok, sp = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    tok.encode_special_tokens = True
    letter = {c: b for b, c in enumerate(byte_letters())}
    docs, count = [], Counter()
    for doc_id, text in rows:
        a, b, sides = [], [], []
        if text:
            a = tok.encode(" " + text, add_special_tokens=False).ids
            b = sp.encode(text)
            sides = [[bytes(letter[c] for c in tok.id_to_token(i)) for i in a]]
            sides.append([bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in b])
            if any(b"".join(s) != (" " + text).encode() for s in sides):
                a, b, sides = [], [], []
        ends = [dict(zip(np.cumsum([len(x) for x in s]).tolist(), range(len(s)))) for s in sides]
        common = sorted(set(ends[0]) & set(ends[1])) if sides else []
        links = [(a[ends[0][e]], b[ends[1][e]]) for e in common]
        count.update(links)
        groups, i, j = [], 0, 0
        for e in common:
            to_i, to_j = ends[0][e] + 1, ends[1][e] + 1
            groups.append(",".join(map(str, a[i:to_i])) + "|" + ",".join(map(str, b[j:to_j])))
            i, j = to_i, to_j
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        docs.append((doc_id, len(a), len(b), len(groups), links, digest))
    best = {}
    for (_, b), n in count.items():
        best[b] = max(best.get(b, 0), n)
    return sorted(
        [(i, na, nb, g, len(links), sum(count[p] == best[p[1]] for p in links), sum(count[p] for p in links), d) for i, na, nb, g, links, d in docs],
        key=str,
    )


def found(df):
    return sorted([tuple(r[c] for c in ("doc_id", *COLUMNS)) for r in df.collect()], key=str)


ODD = [
    "a  b", " lead", "tail ", "  ", " ", "\n", "a \n  b\n\nc", "tab\tx \t y", "under▁score", "a <s> </s><unk> <|endoftext|> <0x41>", "é é ﻿　x y",
    "😀👍🏽 漢字かな", "it's don't 'll", "x" * 3000, "1234567 8,9", "\x00\x1c\x1d a", "w\n" * 500, "ÀÉ z", "...!!!  ???",
    "if (x) {\r\n  y();\r\n}\r\n\r\n", "a,\r b \r\r c\r", "\r", "\r\rx", "\n\r \r\n z",
]


@pytest.fixture(scope="module")
def rows(corpus):
    base = [(r.doc_id, r.text) for r in corpus.select("doc_id", "text").collect()]
    return base + [(1000 + i, t) for i, t in enumerate(ODD)]


def test_equals_plain_version(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert found(alignment.link_counts(df, A, B)) == plain(rows)


def test_rare_pairs_go_through_the_join(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for bound in (0, 40):
        assert found(alignment.link_counts(df, A, B, hot_pairs=bound)) == plain(rows)


def test_small_memory_and_lanes(spark, rows, monkeypatch):
    for name, value in (("LANE", 7), ("MEMO", 20_000), ("SLICE", 2000)):
        monkeypatch.setattr(alignment, name, value)
    pair = alignment.Pair(A, B)
    texts = [(t or "").encode() for _, t in rows]
    for i in range(0, len(texts), 9):
        got = alignment.Aligned(pair, texts[i : i + 9])
        want = plain([(k, t.decode()) for k, t in enumerate(texts[i : i + 9])])
        assert dict(enumerate(got.digests())) == {w[0]: w[-1] for w in want}


def test_cuts_give_back_the_groups(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = []
    for r in alignment.align(df, A, B).collect():
        groups, i, j = [], 0, 0
        for ci, cj in zip(r.a_cuts, r.b_cuts):
            groups.append(",".join(map(str, r.a_ids[i:ci])) + "|" + ",".join(map(str, r.b_ids[j:cj])))
            i, j = ci, cj
        got.append((r.doc_id, hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""))
    assert sorted(got, key=str) == sorted([(w[0], w[-1]) for w in plain(rows)], key=str)


def test_empty_table_and_clashing_columns(spark, empty, clashing):
    assert alignment.link_counts(empty, A, B).count() == 0
    base = [(r.doc_id, r.text) for r in clashing.select("doc_id", "text").collect()]
    assert found(alignment.link_counts(clashing, A, B)) == plain(base)


def test_query_equals_plain_version(spark):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    assert found(QUERIES["op12_alignment"](spark, folder)) == plain(rows)
