"""Repeated passages: near copies by MinHash banding of paragraphs, then copies word for word anywhere.

A paragraph is a line of at least `MIN_WORDS` words, or a block of successive shorter lines that together have as many
(a blank line ends a block once it has them). Equal word sets are one class; a class is posted under the keys
of its bands, whose number and width are tuned so that a pair at the threshold meets with the wanted recall.
Colliding classes are compared on their full shingle sets (exact Jaccard), links become components, and of
each component the first occurrence stays while all others are removals. What is left is searched for passages of
`MIN_WORDS` words that occur word for word inside or across lines (`passages`).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from airloom.llm import shingles as sh
from airloom.llm.common import discard, encoded, release, reread, sliced, tidy
from airloom.llm.graph import components
from airloom.llm.linking import Batches, flagged, links, longs, sketches
from airloom.llm.passages import mark, passages

MIN_WORDS = 50
PERCENT = 75
RECALL = 0.999
MOST_BANDS = 20
SLICE = 1 << 20


def tuned(threshold: float, recall: float = RECALL, most: int = MOST_BANDS) -> tuple[int, int]:
    """(bands, rows): the widest bands, at most `most`, with 1 - (1 - threshold**rows)**bands >= recall."""
    best = (most, 1)
    for rows in range(1, 20):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))
        if bands > most:
            break
        best = (bands, rows)
    return best


def _units(text: str) -> list[tuple[int, int, int, int]]:
    """First and last line, start and end (code points) of the paragraphs of a text."""
    found, at, block, held = [], 0, None, 0
    for line, part in enumerate(text.split("\n")):
        end = at + len(part)
        n = len(part.encode().split()) if part else 0
        if n >= MIN_WORDS or (n == 0 and held >= MIN_WORDS):
            if held >= MIN_WORDS:
                found.append(block)
            block, held = None, 0
        if n >= MIN_WORDS:
            found.append((line, line, at, end))
        elif n:
            block = (line, line, at, end) if block is None else (block[0], line, block[2], end)
            held += n
        at = end + 1
    if held >= MIN_WORDS:
        found.append(block)
    return found


def _paragraphs(batch: pa.RecordBatch) -> tuple[list[int], list[int], list[int], list[int], list[int], np.ndarray, np.ndarray, list[int]]:
    """Row, first and last line, start and end of each paragraph of the texts in column 1; shingles, their bounds, words."""
    rows, lines, lasts, starts, ends, texts = [], [], [], [], [], []
    for row, raw in enumerate(encoded(batch.column(1))):
        text = raw.decode()
        for line, last, start, end in _units(text):
            rows.append(row)
            lines.append(line)
            lasts.append(last)
            starts.append(start)
            ends.append(end)
            texts.append(text[start:end].encode())
    hashes, first_byte, offsets, _ = sh.words(texts)
    first = np.searchsorted(first_byte, offsets)
    n = np.diff(first)
    keep = np.flatnonzero(n >= MIN_WORDS)
    values, at = sh.shingles(hashes, first)
    # Shingles of the kept paragraphs only, close together.
    inside = np.repeat(n >= MIN_WORDS, np.diff(at))
    bounds = np.concatenate([[0], np.cumsum(np.diff(at)[keep])])
    pick = lambda x: [x[i] for i in keep]
    return pick(rows), pick(lines), pick(lasts), pick(starts), pick(ends), values[inside], bounds, n[keep].tolist()


def _scan(bands: int, rows_: int):
    @tidy
    def run(batches: Batches) -> Batches:
        for batch in sliced(batches, 1, SLICE):
            rows, lines, lasts, starts, ends, values, at, n = _paragraphs(batch)
            if not rows:
                continue
            signature = sh.coordinates(values, at, bands * rows_).reshape(len(rows), bands, rows_)
            keys = np.zeros((len(rows), bands), np.uint64) + np.arange(bands, dtype=np.uint64)
            for i in range(rows_):
                keys = sh.mix(keys * np.uint64(3) + signature[:, :, i])
            ids = [sh.digest(s) for s in sh.sets(values, at)]
            columns = [pa.array(x, t) for x, t in ((lines, pa.int32()), (lasts, pa.int32()), (starts, pa.int32()), (ends, pa.int32()), (n, pa.int32()), (ids, pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), *columns, longs(list(keys))], ["doc_id", "line", "last", "start", "end", "n_words", "id", "keys"])

    return run


@tidy
def _sets(batches: Batches) -> Batches:
    for batch in sliced(batches, 1, SLICE):
        rows, *_, values, at, _ = _paragraphs(batch)
        if rows:
            sets = sh.sets(values, at)
            ids = pa.array([sh.digest(s) for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([ids, longs(list(sketches(values, at))), longs(sets)], ["id", "sketch", "set"])


def _repeated_paragraphs(rows: DataFrame, percent: int, recall: float) -> DataFrame:
    """Rows (doc_id, line, last, start, end, n_words, cluster, keep, removed): every occurrence of a repeated paragraph."""
    spark = rows.sparkSession
    schema = "doc_id long, line int, last int, start int, end int, n_words int, id long, keys array<long>"
    scanned = reread(spark, rows.mapInArrow(_scan(*tuned(percent / 100, recall)), schema), "paragraphs")
    place = F.struct("doc_id", "line")
    classes = scanned.groupBy("id").agg(F.min(place).alias("first"), F.max(place).alias("final"), F.first("keys").alias("keys"))
    classes = reread(spark, classes, "paragraph-classes")
    posted = classes.select("id", F.explode("keys").alias("key"))
    shared = posted.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key")
    lists = reread(spark, posted.join(shared, "key", "left_semi"), "bands")
    release(spark)
    wanted = reread(spark, classes.select("id", F.col("first.doc_id").alias("rep")).join(lists.select("id").distinct(), "id", "left_semi"), "wanted")
    full = flagged(rows, F.col("doc_id"), wanted, "rep", "_maybe").filter("_maybe").select("doc_id", "text").mapInArrow(_sets, "id long, sketch array<long>, set array<long>")
    full = reread(spark, full.join(wanted.select("id"), "id", "left_semi").dropDuplicates(["id"]), "sets")
    labels = components(links(lists, full, percent))
    discard(lists, wanted, full)
    release(spark)
    named = classes.select("id", "first", "final").join(labels, "id", "left").withColumn("cluster", F.coalesce("component", "id"))
    clusters = named.groupBy("cluster").agg(F.min("first").alias("keep"), F.max("final").alias("final")).filter("keep <> final")
    members = named.select("id", "cluster").join(clusters.select("cluster", "keep"), "cluster")
    # The paragraph that half the rows share meets its label in a join that adaptive execution can split.
    out = scanned.drop("keys").join(members, "id")
    removed = (F.col("doc_id") != F.col("keep.doc_id")) | (F.col("line") != F.col("keep.line"))
    return out.select("doc_id", "line", "last", "start", "end", "n_words", "cluster", "keep", removed.alias("removed")).distinct()


def _found(docs: DataFrame, key: str, text: str, percent: int = PERCENT, recall: float = RECALL) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Repeated paragraphs, the removed lines (doc_id, lines), and the repeated passages of what these leave."""
    spark = docs.sparkSession
    rows = docs.filter(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    whole = reread(spark, _repeated_paragraphs(rows, percent, recall), "repeated")
    lines = whole.filter("removed").select("doc_id", F.explode(F.sequence("line", "last")).alias("line"))
    gone = reread(spark, lines.groupBy("doc_id").agg(F.collect_set("line").alias("lines")), "removals")
    return whole, gone, passages(rows, gone)


def repeated(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT, recall: float = RECALL) -> DataFrame:
    """Rows (key, line, start, end, n_words, cluster, keep_id, keep_line, removed): every occurrence of a repeated passage.

    Paragraphs are alike if their shingle sets have a Jaccard similarity of `percent` hundredths; `cluster` numbers the
    components. keep_id and keep_line name the occurrence with the smallest (key, line), which alone is not removed.
    In the text without removed paragraphs, passages that occur word for word earlier, inside or across lines, are
    removed too; their rows name the line in which they start, and rows of one text may overlap: what any row removes goes.
    start and end are code points, end exclusive. Passages that occur once, null and empty texts give no rows; equal
    rows with the same key are one document and are told alike; rows with a null key take no part; an empty table
    gives no rows; other columns are ignored.
    """
    whole, _, parts = _found(docs, key, text, percent, recall)
    whole = whole.select("doc_id", "line", "start", "end", "n_words", "cluster", F.col("keep.doc_id").alias("keep_id"), F.col("keep.line").alias("keep_line"), "removed")
    return whole.unionByName(parts.drop("mark").distinct()).withColumnRenamed("doc_id", key)


def without(text: str, lines: list[int], spans: list[tuple[int, int]]) -> str:
    """The text without these lines and these spans of code points; a line end inside a span goes with it."""
    gone, spans, out, at, glued = set(lines), sorted(spans), [], 0, False
    for i, part in enumerate(text.split("\n")):
        end = at + len(part)
        if i not in gone:
            left, done = [], at
            for a, b in spans:
                if a < end and b > at:
                    left.append(text[done : max(done, a)])
                    done = min(end, max(done, b))
            left = "".join([*left, text[done:end]])
            if glued and out:
                out[-1] += left
            else:
                out.append(left)
            glued = any(a <= end < b for a, b in spans)
        at = end + 1
    return "\n".join(out)


@F.arrow_udf(T.StringType())
def _without(texts: pa.Array, lines: pa.Array, starts: pa.Array, ends: pa.Array) -> pa.Array:
    rows = zip(texts.to_pylist(), lines.to_pylist(), starts.to_pylist(), ends.to_pylist())
    return pa.array([without(text, gone or [], list(zip(a or [], b or []))) for text, gone, a, b in rows], pa.string())


def remove(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """`docs` without the removed passages; all rows and columns stay, and texts without a removal stay as they are.

    A text that was nothing but a removal becomes empty. Rows with the same key and different texts lose the lines
    found in any of them, but only their own passages. Only texts with a removal meet their lines in a join.
    """
    spark = docs.sparkSession
    _, gone, parts = _found(docs, key, text, **options)
    parts = parts.filter("removed").groupBy("doc_id", "mark").agg(F.collect_list(F.struct("start", "end")).alias("_spans"))
    parts = reread(spark, parts.withColumnsRenamed({"doc_id": "_key", "mark": "_mark"}), "passages")
    gone = gone.withColumnsRenamed({"doc_id": "_key", "lines": "_lines"})
    columns = docs.columns
    marked = flagged(docs, F.col(key).cast("long"), gone.select("_key").unionByName(parts.select("_key")), "_key", "_test")
    marked = marked.withColumn("_test", F.col("_test") & F.col(text).isNotNull())
    joined = marked.filter("_test").withColumn("_id", F.col(key).cast("long")).withColumn("_own", mark(text))
    joined = joined.join(gone, F.col("_id") == F.col("_key"), "left").drop("_key")
    joined = joined.join(parts, (F.col("_id") == F.col("_key")) & (F.col("_own") == F.col("_mark")), "left")
    hit = F.col("_lines").isNotNull() | F.col("_spans").isNotNull()
    edited = joined.filter(hit).withColumn(text, _without(F.col(text), F.col("_lines"), F.col("_spans.start"), F.col("_spans.end"))).select(*columns)
    return marked.filter("not _test").select(*columns).unionByName(joined.filter(~hit).select(*columns)).unionByName(edited)
