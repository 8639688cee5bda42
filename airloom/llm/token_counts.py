"""Token counts through a digest cache.

The cache is a Parquet table of (tokenizer, digest, n_tokens). Texts are normalised, digested and
reduced to distinct digests before anything is encoded; digests that the cache holds for the same
tokenizer version are joined, the others are encoded once and appended.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airloom.llm.common import encoded, sliced

CACHE = "tokenizer string, digest string, n_tokens long"
MEMO_WORDS = 600_000  # bounds a worker's memory, never the result
SPECIAL = b"<|"


def version(path: str) -> str:
    """Digest of the vocabulary file: another vocabulary or setting is another version."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def normalised(text):
    """Null is empty; runs of ASCII white space count as one blank, none at the ends.

    The supported tokenizers drop white space, so the count is a function of this form.
    """
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " "))


class Counter:
    """Token counts with the tokenizers library, remembering blank-free pieces.

    White space is a boundary for this tokenizer, so a text's count is the sum over its pieces.
    ASCII case is folded first unless the text may hold a special token, whose match is exact.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.memo: dict[bytes, int] = {}

    def count(self, text: bytes) -> int:
        words = (text if SPECIAL in text else text.lower()).split()
        missing = list(set(words).difference(self.memo))
        if missing:
            if len(self.memo) + len(missing) > MEMO_WORDS:
                self.memo.clear()
                missing = list(set(words))
            found = self.tokenizer.encode_batch_fast([w.decode() for w in missing], add_special_tokens=False)
            self.memo.update(zip(missing, map(len, found)))
        return sum(map(self.memo.__getitem__, words))


_COUNTERS: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """One per worker process, kept between tasks."""
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(path)
    return _COUNTERS[path]


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path).count
        for batch in sliced(batches, 1):
            n = pa.array([count(t) for t in encoded(batch.column(1))], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), n], ["digest", "n_tokens"])

    return run


def read_cache(spark: SparkSession, cache: str, tokenizer: str) -> DataFrame:
    """Stored counts of one tokenizer version; a digest appended twice by parallel runs counts once."""
    found = spark.read.schema(CACHE).parquet(cache).filter(F.col("tokenizer") == tokenizer)
    return found.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def create_cache(spark: SparkSession, cache: str) -> None:
    spark.createDataFrame([], CACHE).write.mode("append").parquet(cache)


def count_tokens(docs: DataFrame, cache: str, path: str, text: str = "text") -> DataFrame:
    """Add n_bytes (UTF-8) and n_tokens to every row of `docs`, filling the cache at `cache` first.

    Null and empty texts have 0 tokens; equal texts, repeated rows included, are encoded once; an
    empty table gives no rows. Columns named n_bytes, n_tokens or _digest are replaced.
    Texts shuffle by digest once, after each task has reduced its own copies, so a text that a third of
    the rows share is one row per task; afterwards only digests and counts move.
    """
    spark = docs.sparkSession
    tokenizer = version(path)
    keyed = docs.drop("n_bytes", "n_tokens", "_digest").withColumn("_digest", F.sha2(normalised(F.col(text)), 256))
    distinct = keyed.select(F.col("_digest").alias("digest"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    distinct = distinct.groupBy("digest").agg(F.first("text").alias("text"))
    misses = distinct.join(read_cache(spark, cache, tokenizer), "digest", "left_anti")
    counts = misses.mapInArrow(_encode(path), "digest string, n_tokens long")
    counts.select(F.lit(tokenizer).alias("tokenizer"), "digest", "n_tokens").write.mode("append").parquet(cache)
    held = read_cache(spark, cache, tokenizer).withColumnRenamed("digest", "_digest")
    sized = keyed.withColumn("n_bytes", F.coalesce(F.octet_length(text), F.lit(0)).cast("long"))
    return sized.join(held, "_digest", "left").drop("_digest")
