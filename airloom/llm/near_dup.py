"""MinHash near-duplicates by an inverted join over signature coordinates.

Every distinct shingle set is posted under its coordinate-value pairs. Pairs that only one set has are dropped; a
set whose remaining postings cannot reach the match threshold is skipped; of the others, only the prefix of its
rarest postings is kept, since two sets with enough collisions must share one there (all sets order postings
the same way, by frequency and key). Lists of the prefix propose pairs, whose collisions over the whole
signature are counted; pairs above the threshold are confirmed on the full sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from airloom.llm import shingles as sh
from airloom.llm.common import discard, encoded, release, reread, sliced, tidy
from airloom.llm.graph import components
from airloom.llm.linking import Batches, flagged, links, longs, sketches

COORDINATES = 64
# A pair with similarity 0.75 misses 30 of 64 collisions once in ten million times, and seldom above.
MATCHES = 30
PERCENT = 75
SLICE = 1 << 20


def _units(batch: pa.RecordBatch):
    """Rows of the texts in column 1 that have words; their sets, signatures, shingles and where these begin."""
    hashes, starts, offsets, _ = sh.words(encoded(batch.column(1)))
    first = np.searchsorted(starts, offsets)
    values, at = sh.shingles(hashes, first)
    rows = np.flatnonzero(np.diff(at))
    ends = np.concatenate([at[rows], [at[-1]]])
    return rows, sh.sets(values, ends), (sh.coordinates(values, ends, COORDINATES) if len(rows) else np.zeros((0, COORDINATES), np.uint64)), values, ends


@tidy
def _scan(batches: Batches) -> Batches:
    """(doc_id, n_shingles, id of the set, signature) per row; id and signature are null without words."""
    for batch in sliced(batches, 1, SLICE):
        rows, sets, signatures, *_ = _units(batch)
        n, ids, place = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64), np.full(batch.num_rows, -1)
        n[rows], ids[rows], place[rows] = [len(s) for s in sets], [sh.digest(s) for s in sets], np.arange(len(rows))
        posted = longs(list(signatures)).take(pa.array(place, mask=place < 0))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(ids, mask=place < 0), posted], ["doc_id", "n_shingles", "id", "signature"])


@tidy
def _sets(batches: Batches) -> Batches:
    for batch in sliced(batches, 1, SLICE):
        rows, sets, signatures, values, at = _units(batch)
        if len(rows):
            ids = pa.array([sh.digest(s) for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([ids, longs(list(signatures)), longs(list(sketches(values, at))), longs(sets)], ["id", "signature", "sketch", "set"])


def prefix_lists(classes: DataFrame) -> DataFrame:
    """Posting lists (key, id) of the prefixes, from (id, signature)."""
    posted = classes.select("id", F.posexplode("signature").alias("at", "value")).select("id", F.xxhash64("at", "value").alias("key"))
    shared = posted.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    own = Window.partitionBy("id")
    # With s shared postings a set has 64 - s that nobody else has; they fill the prefix first.
    ranked = posted.join(shared, "key").withColumn("s", F.count(F.lit(1)).over(own)).withColumn("r", F.row_number().over(own.orderBy("n", "key")))
    kept = ranked.filter(F.col("r") <= F.col("s") - (MATCHES - 1)).select("key", "id")
    alone = kept.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key")
    return kept.join(alone, "key", "left_semi")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """Rows (key, n_shingles, component_id, kept), one per row of `docs`.

    Texts are linked if their shingle sets have a Jaccard similarity of `percent` hundredths or more; component_id
    is the smallest key reachable. Texts without words (null, empty, blank) have no shingle, are linked with
    nothing and are kept. Rows with one key are one document: their sets share a component; repeated rows are
    all answered alike. A null key is linked with nothing: component_id is null, the row is kept. An empty
    table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), text)
    scanned = reread(spark, rows.mapInArrow(_scan, "doc_id long, n_shingles long, id long, signature array<long>"), "signatures")
    usable = scanned.filter("id is not null and doc_id is not null")
    classes = reread(spark, usable.groupBy("id").agg(F.min("doc_id").alias("rep"), F.first("signature").alias("signature")), "classes")
    lists = reread(spark, prefix_lists(classes.select("id", "signature")), "lists")
    release(spark)
    # Full sets only of those that are in a list: one text of each, found by its smallest key.
    wanted = reread(spark, classes.select("id", "rep").join(lists.select("id").distinct(), "id", "left_semi"), "wanted")
    maybe = flagged(rows.filter("doc_id is not null"), F.col("doc_id"), wanted, "rep", "_maybe").filter("_maybe")
    full = maybe.select("doc_id", text).mapInArrow(_sets, "id long, signature array<long>, sketch array<long>, set array<long>")
    full = reread(spark, full.join(wanted.select("id"), "id", "left_semi").dropDuplicates(["id"]), "sets")
    found = links(lists, full, percent, MATCHES)
    discard(lists, wanted, full)
    reps = classes.select("id", "rep")
    named = found.join(reps.select(F.col("id").alias("a"), F.col("rep").alias("ra")), "a").join(reps.select(F.col("id").alias("b"), F.col("rep").alias("rb")), "b")
    # Rows of one key with different texts tie their sets together.
    owned = usable.select("doc_id", "id").distinct().join(reps, "id").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    several = owned.groupBy("a").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("a")
    ties = owned.join(several, "a")
    labels = components(named.select(F.col("ra").alias("a"), F.col("rb").alias("b")).unionByName(ties))
    release(spark)
    of_class = reps.join(labels.withColumnRenamed("id", "rep"), "rep", "left").select("id", F.coalesce("component", "rep").alias("component_id"))
    # A class that half the rows share meets its label in a join that adaptive execution can split.
    out = scanned.select("doc_id", "n_shingles", "id").join(of_class, "id", "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("component_id", "doc_id"))
    out = out.select("doc_id", "n_shingles", component.alias("component_id"))
    return out.select(F.col("doc_id").alias(key), "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
