"""Conversation repair against exhaustive search and against itself on long conversations."""

import hashlib
import itertools
import random
import re
import zlib

import pyspark.sql.functions as F
import pytest

from airloom.llm import conversation_repair as cr

SCHEMA = "conv_id long, turn long, role string, text string"


def plain_damage(rows):
    """{conv: rows after damage, in order} by the words of the contract."""
    out = {}
    for conv, turn, role, text in rows:
        kept = out.setdefault(conv, [])
        way = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if way == 1 else re.sub("[.!?]", "", text) if way == 2 else text
        role = "user" if way == 4 else role
        kept += [(turn is not None, turn or 0, role, text)] * (0 if way == 0 else 2 if way == 3 else 1)
    return {conv: sorted(kept) for conv, kept in out.items()}


def exhaustive(turns):
    """Cheapest (cost, audit, repaired) over every sequence of edits with at most four insertions."""
    best = None
    choices = []
    seen = set()
    for _, _, role, text in turns:
        body = text.strip(" \t\n\x0b\x0c\r")
        must = not body or (role, text) in seen
        late = 0 if must or body[-1] in ".!?" else 5
        seen.add((role, text))
        choices.append([("D", 2, None)] + ([] if must else [("K", late, (role, text)), ("R", 1 + late, ("user", text)), ("R", 1 + late, ("assistant", text))]))
    inserts = [c for n in range(5) for c in itertools.product(("user", "assistant"), repeat=n) if n < 3 or len(turns) < 3]
    for made in itertools.product(*choices):
        for ins in inserts:
            for places in itertools.combinations_with_replacement(range(len(turns) + 1), len(ins)):
                edits = []
                for i in range(len(turns) + 1):
                    edits += [("I", 5, (r, "")) for r, p in zip(ins, places) if p == i]
                    edits += [made[i]] if i < len(turns) else []
                given = [e[2] for e in edits if e[2]]
                if re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in given)) and all(r for r, _ in given):
                    found = sum(e[1] for e in edits), "".join(e[0] for e in edits), "\n".join(f"{r}:{t}" for r, t in given)
                    best = found if best is None or found[:2] < best[:2] else best
    return best


def rows_of(rng, conv, n):
    texts = ["Hello there.", "no end", "What?", "", " \t", "Fine!", "same.", None]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", None, ""]
    return [(conv, rng.choice([i, i, i + 2, None]), rng.choice(roles), rng.choice(texts)) for i in range(n)]


@pytest.fixture(scope="module")
def small():
    rng = random.Random(11)
    rows = [r for conv in range(150) for r in rows_of(rng, conv, rng.randint(1, 4))]
    rows += [(None, 0, "user", "Hi."), (None, 1, "assistant", "Yes."), (900, None, "user", "x. "), (901, 2, "assistant", "Only this.")]
    return rows


def expected(rows):
    out = {}
    for conv, turns in plain_damage(rows).items():
        cost, audit, text = exhaustive(turns)
        known = {t[1] for t in turns if t[0]}
        seen, faults = set(), []
        for _, _, role, body in turns:
            tail = body.strip(" \t\n\x0b\x0c\r")[-1:]
            faults.append("b" if not tail else "d" if (role, body) in seen else "" if tail in ".!?" else "t")
            seen.add((role, body))
        pairs = [a[2][:1] + b[2][:1] for a, b in zip(turns, turns[1:])]
        gaps = max(known) - min(known) + 1 - len(known) if known else 0
        out[conv] = (gaps, *[faults.count(f) for f in "bdt"], sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


def found(df):
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    rows = df.collect()
    assert len({r.conv_id for r in rows}) == len(rows)
    return {r.conv_id: tuple(r[n] for n in names) for r in rows}


def test_equals_exhaustive_search(spark, small):
    want = expected(small)
    rows = cr.damage(spark.createDataFrame(small, SCHEMA).repartition(3))
    assert found(cr.repair(rows)) == want


def test_long_way_equals_short_way(spark, small):
    want = expected(small)
    rows = cr.damage(spark.createDataFrame(small, SCHEMA).repartition(3).withColumns({n: F.lit("x") for n in ("conv", "large", "n", "size", "place", "copies")}))
    assert found(cr.repair(rows, max_rows=1)) == want


def test_conversation_over_many_blocks(spark):
    rng = random.Random(5)
    rows = [(7, i if rng.random() < 0.95 else None, rng.choice(("user", "assistant", "assistant", "system")), rng.choice(("", "Yes.", f"No {i}.", f"open {i}"))) for i in range(2500)] + [(8, 0, "user", "Hi.")]
    turns = plain_damage(rows)[7]
    df = cr.damage(spark.createDataFrame(rows, SCHEMA).repartition(5))
    got, plain = found(cr.repair(df)), found(cr.repair(df, max_rows=10**6, max_bytes=10**9))
    assert got == plain and len(got[7][6]) >= len(turns) > 2000


def test_repaired_turns_have_the_digest(spark, small):
    df = cr.damage(spark.createDataFrame(small, SCHEMA).repartition(3))
    repairs = cr.repair(df)
    texts = {}
    for r in sorted(cr.repaired_turns(df, repairs).collect(), key=lambda r: r.place):
        texts.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    for r in repairs.collect():
        assert r.repaired_sha256 == hashlib.sha256("\n".join(texts.get(r.conv_id, [])).encode()).hexdigest()


def test_empty_table(spark):
    assert cr.repair(cr.damage(spark.createDataFrame([], SCHEMA))).count() == 0


def test_query_covers_all_conversations(spark):
    from airloom.llm.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = found(QUERIES["op13_conversation_repair"](spark, folder))
    assert set(got) == {r[0] for r in rows}
    small = [r for r in rows if sum(x[0] == r[0] for x in rows) < 5]
    want = expected(small)
    assert {k: got[k] for k in want} == want
