"""The training-data pipeline over `documents`: five stages, each one operator of `airloom.llm`.

Every stage takes what its predecessor kept and returns the columns of `documents`, the last one the packing.
Each judges its own input: counts, statistics and candidates come from all rows it gets. Null ids pass the
filtering stages by the verdict of their own text; null texts have no words and fall to the quality rules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airloom.llm import near_dup, ngram_model, packing, paragraphs, secret_scan
from airloom.llm.common import read, reread
from airloom.llm.linking import flagged


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and lie in the perplexity band of their language."""
    return ngram_model.judge(docs).filter("kept").select(*docs.columns)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component: that with the smallest id.

    Rows that share an id are one document; of them stays the row whose text has the smallest SHA-256 (then the one
    whose whole row has the smallest hash), so that a retried task chooses the same.
    """
    found = near_dup.near_duplicates(docs)
    dropped = reread(spark, found.filter("not kept").select(F.col("doc_id").alias("_dropped")).distinct(), "dropped")
    repeated = docs.filter("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("doc_id")
    marked = flagged(docs, F.col("doc_id"), dropped.unionByName(repeated.withColumnRenamed("doc_id", "_dropped")), "_dropped", "_maybe")
    marked = marked.withColumn("_maybe", F.col("_maybe") & F.col("doc_id").isNotNull())
    # Only rows that may be dropped or repeated move; the others pass.
    judged = marked.filter("_maybe").join(dropped, F.col("doc_id") == F.col("_dropped"), "left_anti")
    hashed = [f"`{name}`" for name, kind in docs.dtypes if "map<" not in kind]
    first = F.struct(F.sha2("text", 256).alias("text"), F.xxhash64(*hashed).alias("row"))
    judged = judged.groupBy("doc_id").agg(F.min_by(F.struct("*"), first).alias("_row")).select("_row.*")
    return marked.filter("not _maybe").unionByName(judged).select(*docs.columns)


def _resized(docs: DataFrame) -> DataFrame:
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars")))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the paragraphs that an earlier document, or an earlier place, already has."""
    return _resized(paragraphs.remove(docs)).select(*docs.columns)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose live secrets are replaced; a document stands for a repository, its source for the owner."""
    return _resized(secret_scan.redact(docs)).select(*docs.columns)


def length_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each sequence of words goes: bucket, batch and slot."""
    return packing.pack(docs.select("doc_id", packing.n_words(F.col("text")).alias("n_words")))


STAGES = [
    ("quality_rules", quality_rules),
    ("minhash_near_dedup", minhash_near_dedup),
    ("substring_dedup", substring_dedup),
    ("secret_scans", secret_scans),
    ("length_packing", length_packing),
]

# Perplexity, MinHash components and the packing program are beyond SQL; tests/llm holds brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each result written to the shared folder and read back."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = reread(spark, stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
