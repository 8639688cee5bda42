"""Repeated passages word for word, wherever they lie: inside a line, across line ends, in lines of any length.

Of the hashes of all runs of `GRAM` words every text is indexed under the smallest of each `WORDS - GRAM + 1`
successive ones, so two places that share `WORDS` words share an indexed run. Only around indexed runs that occur twice are
all windows of `WORDS` words compared, by 64-bit hashes. A window that has an earlier equal one is removed, its words
then lie in the earlier place; windows of a text that overlap an equal one (a loop) are one occurrence.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from airloom.llm import shingles as sh
from airloom.llm.common import discard, encoded, release, reread, sliced, tidy
from airloom.llm.linking import Batches, flagged

WORDS = 50
GRAM = 25
SLICE = 1 << 20
_NONE = np.uint64(2**64 - 1)


class _Stream:
    """The words of many texts: hash, text, line and code points (end exclusive) of each."""

    def __init__(self, texts: list[bytes]):
        self.hashes, starts, offsets, data = sh.words(texts)
        self.first = np.searchsorted(starts, offsets)
        self.text = np.repeat(np.arange(len(texts)), np.diff(self.first))
        blank = np.flatnonzero(sh._BLANK[data])
        ends = blank[np.searchsorted(blank, starts)]
        before = lambda hit: np.concatenate([[0], np.cumsum(hit)])
        lines, points = before(data == 10), before((data & 0xC0) != 0x80)
        base = offsets[self.text]
        self.line = lines[starts] - lines[base]
        self.start, self.end = points[starts] - points[base], points[ends] - points[base]

    def windows(self, size: int, masked: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the window of `size` words from each word on, and whether it lies in one text without masked words."""
        n = len(self.hashes)
        if n < size:
            return np.zeros(0, np.uint64), np.zeros(0, bool)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.hashes * sh._power("up", n), out=sums[1:])
        whole = self.text[: n - size + 1] == self.text[size - 1 :]
        if masked is not None:
            bad = np.concatenate([[0], np.cumsum(masked)])
            whole &= bad[size:] == bad[: n - size + 1]
        return sh.mix((sums[size:] - sums[:-size]) * sh._power("down", n)[: n - size + 1]), whole


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the first smallest of each `width` successive values, without a table of all windows."""
    n = len(values) - width + 1
    least, place = values[:n].copy(), np.arange(n)
    for i in range(1, width):
        lower = values[i : i + n] < least
        least[lower] = values[i : i + n][lower]
        place[lower] = np.flatnonzero(lower) + i
    return place


@tidy
def _grams(batches: Batches) -> Batches:
    """Rows (doc_id, mark, gram, at, line) of the indexed runs of the texts in column 2."""
    for batch in sliced(batches, 2, SLICE):
        s = _Stream(encoded(batch.column(2)))
        values, whole = s.windows(GRAM)
        width = WORDS - GRAM + 1
        if len(values) < width:
            continue
        values = np.where(whole, values, _NONE)
        picked = np.unique(_least(values, width))
        picked = picked[whole[picked]]
        text = s.text[picked]
        rows = pa.array(text)
        at, line = (picked - s.first[text]).astype(np.int32), s.line[picked].astype(np.int32)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(values[picked].view(np.int64)), pa.array(at), pa.array(line)], ["doc_id", "mark", "gram", "at", "line"])


@tidy
def _occurrences(batches: Batches) -> Batches:
    """Rows of the windows near the word numbers in column 3, without words on the lines in column 4; loops once."""
    for batch in sliced(batches, 2, SLICE):
        s = _Stream(encoded(batch.column(2)))
        n = len(s.hashes)
        masked = np.zeros(n, bool)
        edges = np.zeros(n + 2, np.int64)
        for row, (near, lines) in enumerate(zip(batch.column(3).to_pylist(), batch.column(4).to_pylist())):
            a, b = s.first[row], s.first[row + 1]
            if lines:
                masked[a:b] = np.isin(s.line[a:b], lines)
            places = a + np.asarray(near, np.int64)
            np.add.at(edges, np.maximum(places - (WORDS - GRAM), a), 1)
            np.add.at(edges, places + 1, -1)
        values, whole = s.windows(WORDS, masked)
        p = np.flatnonzero(whole & (np.cumsum(edges)[: len(values)] > 0))
        if not len(p):
            continue
        p = p[np.lexsort((p, values[p], s.text[p]))]
        new = np.ones(len(p), bool)
        new[1:] = (s.text[p[1:]] != s.text[p[:-1]]) | (values[p[1:]] != values[p[:-1]]) | (p[1:] - p[:-1] >= WORDS)
        heads = np.flatnonzero(new)
        last = p[np.append(heads[1:], len(p)) - 1]
        p = p[heads]
        rows, base = pa.array(s.text[p]), s.first[s.text[p]]
        numbers = [x.astype(np.int32) for x in (p - base, last - base, s.line[p], s.start[p], s.end[last + WORDS - 1])]
        yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(values[p].view(np.int64)), *map(pa.array, numbers)], ["doc_id", "mark", "window", "p", "last", "line", "start", "end"])


def mark(text: str) -> F.Column:
    """Tells apart different texts of one key."""
    return F.xxhash64(text)


def passages(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows (doc_id, mark, line, start, end, n_words, cluster, keep_id, keep_line, removed) of the texts (doc_id, text).

    Lines in `gone` (doc_id, lines) are removed already and take no part. A removed row is a longest run of windows
    that follows one earlier place; the part of that place which such runs have is its row with `removed` false.
    """
    spark = rows.sparkSession
    rows = rows.filter("text is not null").select("doc_id", mark("text").alias("mark"), "text")
    grams = reread(spark, rows.mapInArrow(_grams, "doc_id long, mark long, gram long, at int, line int"), "grams")
    marked = flagged(grams, F.col("doc_id"), gone, "doc_id", "cut")
    left = marked.filter("cut").join(gone.select("doc_id", F.explode("lines").alias("line")), ["doc_id", "line"], "left_anti")
    left = left.select(*grams.columns).unionByName(marked.filter("not cut").select(*grams.columns))
    shared = left.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("gram")
    near = left.join(shared, "gram", "left_semi").groupBy("doc_id", "mark").agg(F.collect_set("at").alias("near"))
    near = reread(spark, near.join(gone, "doc_id", "left").select("doc_id", "mark", "near", "lines"), "near")
    release(spark)
    maybe = flagged(rows, F.col("mark"), near, "mark", "_maybe").filter("_maybe").drop("_maybe")
    texts = maybe.join(near, ["doc_id", "mark"]).select("doc_id", "mark", "text", "near", "lines")
    found = reread(spark, texts.mapInArrow(_occurrences, "doc_id long, mark long, window long, p int, last int, line int, start int, end int"), "windows")
    place = F.struct("doc_id", "mark", "p", "line", "start", F.col("end").alias("end"))
    firsts = found.groupBy("window").agg(F.min(place).alias("first"), F.max(place).alias("final")).filter("first <> final").drop("final")
    same = (F.col("doc_id") == F.col("first.doc_id")) & (F.col("mark") == F.col("first.mark")) & (F.col("p") == F.col("first.p"))
    later = reread(spark, found.join(firsts, "window").filter(~same).distinct(), "later")
    by = Window.partitionBy("doc_id", "mark").orderBy("p")
    follows = F.col("p") <= F.lag("last").over(by) + 1
    for name in ("doc_id", "mark"):
        follows &= F.col(f"first.{name}") == F.lag(f"first.{name}").over(by)
    follows &= F.col("first.p") - F.col("p") == F.lag(F.col("first.p") - F.col("p")).over(by)
    steps = later.withColumn("new", F.when(follows, 0).otherwise(1))
    pieces = steps.withColumn("piece", F.sum("new").over(by)).groupBy("doc_id", "mark", "piece")
    pieces = pieces.agg(
        F.min_by("line", "p").alias("line"),
        F.min("start").alias("start"),
        F.max("end").alias("end"),
        (F.max("last") + WORDS - F.min("p")).alias("n_words"),
        F.min("first").alias("keep"),
        F.max("first.end").alias("keep_end"),
        (F.max("first.p") + WORDS - F.min("first.p")).alias("keep_words"),
    )
    pieces = reread(spark, pieces.withColumn("cluster", F.xxhash64("keep.doc_id", "keep.mark", "keep.p")), "pieces")
    discard(grams, near, found, later)
    release(spark)
    named = [F.col("keep.doc_id").alias("keep_id"), F.col("keep.line").alias("keep_line")]
    removed = pieces.select("doc_id", "mark", "line", "start", "end", "n_words", "cluster", *named, F.lit(True).alias("removed"))
    kept = pieces.groupBy("cluster", "keep.doc_id", "keep.mark", "keep.line", "keep.start").agg(F.max("keep_end").alias("end"), F.max("keep_words").alias("n_words"))
    kept = kept.select("doc_id", "mark", "line", "start", "end", "n_words", "cluster", F.col("doc_id").alias("keep_id"), F.col("line").alias("keep_line"), F.lit(False).alias("removed"))
    return removed.unionByName(kept)
