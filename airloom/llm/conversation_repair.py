"""Repair of conversations by lightest derivations.

An item `(i, state)` says that the first i turns have been edited and the roles given so far lead to `state` of the
role grammar. Each edit is a deduction whose antecedents are an item and, unless it inserts, the next turn. The agenda
pops items by (cost, audit) and never reopens one: an edit adds a cost of at least 0 and one letter, so a conclusion is
never less than its antecedent, and of two equally dear audits of one item neither begins with the other (an insertion
more would cost more), so appending a letter keeps their order. The first goal item popped is the cheapest repair.

Conversations of up to MAX_ROWS turns and MAX_BYTES of text are one task's row each. Longer ones are put in order by
a range partitioning, cut into blocks and reduced to one small table per block (from each state to each state); the
tables are joined from block to block. Only the digest of a repaired conversation, one SHA-256 by definition, reads
its text in order, as a stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airloom.llm.common import reread

MAX_ROWS, MAX_BYTES, BLOCK_BITS = 512, 4 << 20, 9
BLANK = " \t\n\x0b\x0c\r"
# Fixed values of the contract: cost of each edit, cost of a truncated turn that stays, adjacent initials allowed.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
LEGAL = ("su", "ua", "au")
# The grammar (s?(ua)+)? as states: 0 nothing yet, 1 after s, 2 after u, 3 after a.
STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
WANTED = ("u", "u", "a", "u")  # the user or assistant turn that each state awaits
GOALS = (0, 3)
NAMES = {"u": "user", "a": "assistant"}


def damage(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, copies) damaged by crc32 of `conv_id:turn`, modulo 20; a null counts as one space.

    copies is 0 for a dropped row and 2 for a repeated one.
    """

    def plain(name):
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    way = F.crc32(F.concat_ws(":", plain("conv_id"), plain("turn"))) % 20
    text = F.when(way == 1, F.lit("")).when(way == 2, F.regexp_replace(plain("text"), "[.!?]", "")).otherwise(plain("text"))
    return rows.select(
        "conv_id",
        "turn",
        F.when(way == 4, F.lit("user")).otherwise(plain("role")).alias("role"),
        text.alias("text"),
        F.when(way == 0, 0).when(way == 3, 2).otherwise(1).alias("copies"),
    )


def lightest(turns: list[tuple[str, str]], start: int | None = None) -> dict[int, tuple[int, str]]:
    """Cheapest (cost, audit) over turns of (initial, fault).

    From the beginning of a conversation (`start` None) to the first goal; else from state `start` to every state.
    Faults: "x" must go, "t" is truncated.
    """
    n, ended = len(turns), {}
    agenda, done = [(0, "", 0, start or 0)], set()
    while agenda:
        cost, audit, i, q = heappop(agenda)
        if (i, q) in done:
            continue
        done.add((i, q))
        if i == n:
            ended[q] = cost, audit
            if start is None and q in GOALS or len(ended) == 4:
                break
        else:
            initial, fault = turns[i]
            heappush(agenda, (cost + DELETE, audit + "D", i + 1, q))
            if fault != "x":
                stay = cost + TRUNCATED if fault == "t" else cost
                if (to := STEP.get((q, initial))) is not None:
                    heappush(agenda, (stay + KEEP, audit + "K", i + 1, to))
                heappush(agenda, (stay + REROLE, audit + "R", i + 1, STEP[q, WANTED[q]]))
        to = STEP[q, WANTED[q]]
        if (i, to) not in done:
            heappush(agenda, (cost + INSERT, audit + "I", i, to))
    return ended


def _goal(ended: dict[int, tuple[int, str]]) -> tuple[int, str]:
    return min(ended[q] for q in GOALS if q in ended)


def edited(audit: str, turns: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str]]:
    """The (role, text) turns that an audit makes of the given ones."""
    q, turns = 0, iter(turns)
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(turns)
        if edit == "D":
            continue
        if edit != "K":
            role = NAMES[WANTED[q]]
        q = STEP[q, role[:1]]
        yield role, text


def _digest(turns: Iterator[tuple[str, str]]) -> str:
    h, first = hashlib.sha256(), True
    for role, text in turns:
        h.update(f"{'' if first else chr(10)}{role}:{text}".encode())
        first = False
    return h.hexdigest()


def _illegal(initials: list[str]) -> int:
    return sum(a + b not in LEGAL for a, b in zip(initials, initials[1:]))


FACTS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _one(turns: list[dict]) -> tuple:
    """Facts and repair of a conversation held whole."""
    seen, coded, counts = set(), [], {"b": 0, "d": 0, "t": 0, "": 0}
    rows = [(t["role"], t["text"], t["tail"]) for t in turns for _ in range(t["copies"])]
    for role, text, tail in rows:
        fault = "b" if not tail else "d" if (role, text) in seen else "" if tail in ".!?" else "t"
        seen.add((role, text))
        counts[fault] += 1
        coded.append((role[:1], "x" if fault in ("b", "d") else fault))
    known = {t["turn"] for t in turns if t["turn"] is not None}
    gaps = max(known) - min(known) + 1 - len(known) if known else 0
    cost, audit = _goal(lightest(coded))
    digest = _digest(edited(audit, ((r, t) for r, t, _ in rows)))
    return gaps, counts["b"], counts["d"], counts["t"], _illegal([c[0] for c in coded]), cost, audit, digest


def _short(rows: DataFrame, kind: str) -> DataFrame:
    turn = F.when(F.col("copies") > 0, F.struct("turn", "role", "text", "copies", "tail"))
    grouped = rows.groupBy("conv").agg(F.sort_array(F.collect_list(turn)).alias("turns"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                made = list(zip(*map(_one, part.column(1).to_pylist())))
                types = [*[pa.int64()] * 6, pa.string(), pa.string()]
                arrays = [pa.array(c, t) for c, t in zip(made, types)]
                yield pa.RecordBatch.from_arrays([part.column(0), *arrays], ["conv", *[f.split()[0] for f in FACTS.split(", ")]])

    return grouped.mapInArrow(run, f"conv {kind}, {FACTS}")


MATRIX = "array<struct<start: int, end: int, cost: long, audit: string>>"


def _tables(kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entry = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
        for batch in batches:
            codes = batch.column(2).to_pylist()
            out, illegal = [], []
            for rows in codes:
                turns = [(r["initial"], r["fault"]) for r in rows]
                out.append([{"start": s, "end": e, "cost": c, "audit": a} for s in range(4) for e, (c, a) in lightest(turns, s).items()])
                illegal.append(_illegal([t[0] for t in turns]))
            ends = [pa.array([r[k]["initial"] for r in codes], pa.string()) for k in (0, -1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, entry), pa.array(illegal, pa.int64()), *ends], ["conv", "block", "table", "illegal", "first", "last"])

    return run, f"conv {kind}, block long, table {MATRIX}, illegal long, first string, last string"


def _joined(kind: str):
    """Repairs of long conversations from the tables of their blocks, which arrive in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def result():
            cost, audit = min((state[q][0], "".join(settled + state[q][1])) for q in GOALS if q in state)
            return pa.RecordBatch.from_arrays([now, pa.array([cost], pa.int64()), pa.array([audit]), pa.array([illegal], pa.int64())], ["conv", "cost", "audit", "illegal"])

        now, key, state, settled, illegal, last = None, None, {}, [], 0, None
        for batch in batches:
            for i in range(batch.num_rows):
                conv = batch.column(0).slice(i, 1)
                if now is None or conv[0].as_py() != key:
                    if now is not None:
                        yield result()
                    now, key, state, settled, illegal, last = conv, conv[0].as_py(), {0: (0, [])}, [], 0, None
                best: dict[int, tuple[int, list[str]]] = {}
                for t in batch.column(2)[i].as_py():
                    if t["start"] in state:
                        cost, pieces = state[t["start"]]
                        new = cost + t["cost"], [*pieces, t["audit"]]
                        known = best.get(t["end"])
                        if known is None or (new[0], "".join(new[1])) < (known[0], "".join(known[1])):
                            best[t["end"]] = new
                state = best
                # What all states begin with is settled, so the lists stay short.
                while all(len(p) > 1 and p[0] == state[min(state)][1][0] for _, p in state.values()):
                    settled.append([p.pop(0) for _, p in state.values()][0])
                first, end = batch.column(4)[i].as_py(), batch.column(5)[i].as_py()
                illegal += batch.column(3)[i].as_py() + (last is not None and last + first not in LEGAL)
                last = end
        if now is not None:
            yield result()

    return run, f"conv {kind}, cost long, audit string, illegal long"


def _hashed(kind: str):
    """Digests of long conversations as a stream: the row with place -1 holds the audit, then the turns in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                for i in range(batch.num_rows):
                    yield batch.column(0).slice(i, 1), batch.column(1)[i].as_py(), batch.column(2)[i].as_py(), batch.column(3)[i].as_py()

        stream = rows()
        for conv, place, _, audit in stream:
            assert place == -1
            needed = len(audit) - audit.count("I")
            turns = ((role, text) for _, (_, _, role, text) in zip(range(needed), stream))
            digest = _digest(edited(audit, turns))
            for _ in turns:
                pass
            yield pa.RecordBatch.from_arrays([conv, pa.array([digest])], ["conv", "repaired_sha256"])

    return run, f"conv {kind}, repaired_sha256 string"


def _long(rows: DataFrame, kind: str) -> DataFrame:
    spark = rows.sparkSession
    rows = rows.filter("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    # Equal rows may be dealt to several ranges: `scan`, fixed by the scan, tells them apart.
    ordered = rows.repartitionByRange("conv", "turn", "role", "text", "scan", "copy")
    ordered = ordered.sortWithinPartitions("conv", "turn", "role", "text", "scan", "copy").withColumn("place", F.monotonically_increasing_id())
    ordered = reread(spark, ordered.select("conv", "turn", "role", "text", "tail", "place"), "turns")
    content = F.sha2(F.concat_ws(":", F.length("role").cast("string"), "role", "text"), 256)
    first = ordered.filter("tail <> ''").groupBy("conv", content.alias("content")).agg(F.min("place").alias("place")).select("place", F.lit(True).alias("first"))
    fault = (
        F.when(F.col("tail") == "", "b")
        .when(F.col("first").isNull(), "d")
        .when(F.col("tail").isin(".", "!", "?"), "")
        .otherwise("t")
    )
    coded = ordered.select("conv", "turn", "role", "tail", "place").join(first, "place", "left").select("conv", "turn", "place", F.substring("role", 1, 1).alias("initial"), fault.alias("fault"))
    coded = reread(spark, coded, "turn-codes")
    turns = coded.groupBy("conv", "turn").agg(*[F.count_if(F.col("fault") == f).alias(f) for f in "bdt"])
    facts = turns.groupBy("conv").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps"),
        *[F.sum(f).alias(name) for f, name in zip("bdt", ("blank", "duplicate", "truncated"))],
    )
    code = F.struct("place", "initial", F.when(F.col("fault").isin("b", "d"), "x").otherwise(F.col("fault")).alias("fault"))
    # Places are partition and row within it, so a block is a run of neighbours whatever lies between partitions.
    blocks = coded.groupBy("conv", F.shiftright("place", BLOCK_BITS).alias("block")).agg(F.sort_array(F.collect_list(code)).alias("codes"))
    tables = blocks.mapInArrow(*_tables(kind))
    repaired = tables.repartition("conv").sortWithinPartitions("conv", "block").mapInArrow(*_joined(kind))
    repaired = reread(spark, repaired, "repairs")
    heads = repaired.select("conv", F.lit(-1).cast("long").alias("place"), F.lit("").alias("role"), F.col("audit").alias("text"))
    stream = ordered.select("conv", "place", "role", "text").unionByName(heads)
    digests = stream.repartition("conv").sortWithinPartitions("conv", "place").mapInArrow(*_hashed(kind))
    out = repaired.join(facts.withColumnRenamed("conv", "conv_f"), F.col("conv").eqNullSafe(F.col("conv_f")))
    out = out.join(digests.withColumnRenamed("conv", "conv_h"), F.col("conv").eqNullSafe(F.col("conv_h")))
    return out.select("conv", *[f.split()[0] for f in FACTS.split(", ")])


def repair(rows: DataFrame, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> DataFrame:
    """One row per conversation of `rows` (conv_id, turn, role, text and, if given, copies): its faults and cheapest repair.

    Columns: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256. Turns are taken by
    turn (nulls first), role, text; equal turns are thus neighbours. A null role or text counts as one space, a null
    conv_id is a conversation of its own; an empty role fits no place, so such a turn is given another role or deleted.
    A conversation all of whose rows have copies 0 has zeros, an empty audit and the digest of nothing. An empty table
    gives no rows; other columns are ignored, whatever their names. `max_rows` and `max_bytes` only choose the way.
    """
    kind = dict(rows.dtypes)["conv_id"]
    copies = F.col("copies") if "copies" in rows.columns else F.lit(1)
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    rows = rows.select(
        F.col("conv_id").alias("conv"),
        "turn",
        role.alias("role"),
        text.alias("text"),
        copies.cast("int").alias("copies"),
        F.substring(F.rtrim(text, F.lit(BLANK)), -1, 1).alias("tail"),
        F.monotonically_increasing_id().alias("scan"),
    )
    sizes = rows.groupBy("conv").agg(F.sum("copies").alias("n"), F.sum(F.col("copies") * F.octet_length("text")).alias("size"))
    large = sizes.filter((F.col("n") > max_rows) | (F.col("size") > max_bytes)).select(F.col("conv").alias("large"))
    large = reread(rows.sparkSession, large, "large-conversations")
    short = rows
    if large.isEmpty():
        found = _short(rows, kind)
    else:
        on = F.col("conv").eqNullSafe(F.col("large"))
        short = rows.join(large, on, "left_anti")
        found = _short(short, kind).unionByName(_long(rows.join(large, on, "left_semi"), kind))
    return found.withColumnRenamed("conv", "conv_id")


def repaired_turns(rows: DataFrame, repairs: DataFrame) -> DataFrame:
    """Rows (conv_id, place, role, text): the turns as the audits of `repairs` leave them, place counting from 1.

    Conversations stream through their task in order; only an audit is held.
    """
    kind = dict(rows.dtypes)["conv_id"]
    copies = F.col("copies") if "copies" in rows.columns else F.lit(1)
    turns = rows.select(
        F.col("conv_id").alias("conv"), F.lit(1).alias("kind"), "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), F.explode(F.array_repeat(F.lit(1), copies.cast("int"))).alias("copy")
    ).drop("copy")
    heads = repairs.select(F.col("conv_id").alias("conv"), F.lit(0).alias("kind"), F.lit(None).cast(dict(rows.dtypes)["turn"]).alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text"))
    ordered = heads.unionByName(turns).repartition("conv").sortWithinPartitions("conv", "kind", "turn", "role", "text").select("conv", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def stream():
            for batch in batches:
                for i in range(batch.num_rows):
                    yield batch.column(0).slice(i, 1), batch.column(1)[i].as_py(), batch.column(2)[i].as_py()

        source = stream()
        for conv, _, audit in source:
            needed = len(audit) - audit.count("I")
            given = ((role, text) for _, (_, role, text) in zip(range(needed), source))
            for place, (role, text) in enumerate(edited(audit, given), 1):
                yield pa.RecordBatch.from_arrays([conv, pa.array([place], pa.int64()), pa.array([role]), pa.array([text])], ["conv_id", "place", "role", "text"])
            for _ in given:
                pass

    return ordered.mapInArrow(run, f"conv_id {kind}, place long, role string, text string")
