"""Secret scan with corpus-wide ownership.

Every text is scanned once for candidates. The hashes of their values are counted over the whole corpus:
in how many repositories and with how many owners does a value occur? A value that many owners, by their share of all
owners, have in texts of their own is a copied example; exact copies of one text speak for one owner, unless more than
half of all owners hold them. A value that is no example and that looks random is taken for live. Only hashes leave the
task that read a text, never a value.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from airloom.llm.common import reread

EXAMPLE_OWNERS = 3  # a value with fewer distinct owners is never a copied example
EXAMPLE_SHARE = 0.001  # nor is one with a smaller share of all owners
MIN_ENTROPY = 2.8  # bits a character of a value that looks random
KINDS = ("assign", "access", "hex", "owned")  # the order of spans that start together
# The patterns of the base kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
# A long token of mixed letters and digits outside any base span; it counts only if its owner is specific.
OWNED = re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{20,}(?![A-Za-z0-9_-])")
# Cheap test that no text with a candidate fails; the patterns above decide.
MAY_HOLD = r"(?i:password|passwd|secret|token|api_?key)|AKIA[A-Z0-9]{14}|[0-9a-f]{16}|[A-Za-z0-9_-]{20}"
CANDIDATES = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("value", T.StringType()), T.StructField("random", T.BooleanType())]))
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.string()), ("random", pa.bool_())]))


NO_DIGIT = ("assign", "access")  # their names or prefixes tell enough; a value of letters alone may be live


def looks_random(value: str, digit: bool = True) -> bool:
    """Letters and (unless `digit` is false) digits, many different ones: not a word, a number or a filler."""
    n = len(value)
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(value).values())
    return entropy >= MIN_ENTROPY and (not digit or any(c.isdigit() for c in value)) and any(c.isalpha() for c in value)


def candidates(text: str) -> list[dict]:
    """Candidates of one text, code point offsets, end exclusive."""
    found: list[tuple[int, int, str, str]] = []
    found += [(m.start(), m.end(), "assign", m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [(m.start(), m.end(), "access", m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 18]
    found += [(m.start(), m.end(), "hex", m[0]) for m in HEX.finditer(text) if len(m[0]) >= 16]
    base = sorted(found)
    for m in OWNED.finditer(text):
        v = m[0]
        mixed = any(c.isupper() for c in v) and any(c.islower() for c in v) and sum(c.isdigit() for c in v) >= 3
        if mixed and looks_random(v) and not any(s < m.end() and m.start() < e for s, e, _, _ in base):
            found.append((m.start(), m.end(), "owned", v))
    found.sort(key=lambda x: (x[0], KINDS.index(x[2])))
    return [dict(kind=k, start=s, end=e, value=hashlib.sha256(v.encode()).hexdigest(), random=looks_random(v, k not in NO_DIGIT)) for s, e, k, v in found]


@F.arrow_udf(CANDIDATES)
def _scan(texts: pa.Array) -> pa.Array:
    may = pc.fill_null(pc.match_substring_regex(texts, MAY_HOLD), False).to_pylist()
    return pa.array([candidates(texts[i].as_py()) if m else [] for i, m in enumerate(may)], _ARROW)


def scan(docs: DataFrame, key: str, text: str, repo: str, owner: str) -> DataFrame:
    """Rows (key, repo, owner, digest of the text, candidates), one per row of `docs`; kept in the shared folder."""
    whole = F.coalesce(F.col(text), F.lit(""))
    found = docs.select(F.col(key).alias("key"), F.col(repo).alias("repo"), F.col(owner).alias("owner"), F.sha2(whole, 256).alias("digest"), _scan(whole).alias("found"))
    return reread(docs.sparkSession, found, "secret-scan")


def _distinct(held: DataFrame, column: str, name: str) -> DataFrame:
    """Rows (value, distinct values of the column). Pairs become distinct in each task before they move; a null counts as one."""
    return held.select("value", column).distinct().groupBy("value").agg(F.count(F.lit(1)).alias(name))


def ownership(scanned: DataFrame) -> DataFrame:
    """Rows (value, n_repos, n_owners, n_apart): owners that hold it; repositories and owners over distinct texts.

    Each distinct text is held by its first (owner, repository) alone in n_repos and n_apart.
    """
    rows = scanned.filter(F.size("found") > 0)
    held = rows.select("owner", F.explode(F.array_distinct("found.value")).alias("value"))
    once = rows.groupBy("digest").agg(F.first("found").alias("found"), F.min(F.struct("owner", "repo")).alias("by"))
    once = once.select(F.col("by.owner").alias("owner"), F.col("by.repo").alias("repo"), F.explode(F.array_distinct("found.value")).alias("value"))
    return _distinct(once, "repo", "n_repos").join(_distinct(held, "owner", "n_owners"), "value").join(_distinct(once, "owner", "n_apart"), "value")


def judged(scanned: DataFrame, example_owners: int = EXAMPLE_OWNERS, example_share: float = EXAMPLE_SHARE) -> DataFrame:
    """Rows (digest, spans): the judged spans of each distinct text that has any, in order.

    A span is `live` if its value looks random and is no copied example. Spans of kind `owned` are
    kept only where live; the base kinds always stay.
    """
    texts = scanned.filter(F.size("found") > 0).groupBy("digest").agg(F.first("found").alias("found"))
    spans = texts.select("digest", F.posexplode("found").alias("at", "s")).join(ownership(scanned).withColumnRenamed("value", "v"), F.col("s.value") == F.col("v"))
    spans = spans.crossJoin(scanned.select("owner").distinct().agg(F.count(F.lit(1)).alias("all_owners")))
    apart = F.col("n_apart") >= F.greatest(F.lit(example_owners), F.ceil(F.col("all_owners") * example_share))
    copied = apart | ((F.col("n_owners") >= example_owners) & (F.col("n_owners") * 2 > F.col("all_owners")))
    span = F.struct("at", "s.kind", "s.start", "s.end", "n_repos", "n_owners", copied.alias("example"), (F.col("s.random") & ~copied).alias("live"))
    spans = spans.select("digest", span.alias("s")).filter((F.col("s.kind") != "owned") | F.col("s.live"))
    # One text's spans are bounded by the text.
    return spans.groupBy("digest").agg(F.array_sort(F.collect_list("s")).alias("spans"))


def find(docs: DataFrame, key: str = "doc_id", text: str = "text", repo: str = "doc_id", owner: str = "source", **limits) -> DataFrame:
    """Rows (key, spans), one per row of `docs`; spans (at, kind, start, end, n_repos, n_owners, example, live).

    Null and empty texts have no spans (an empty list); repeated rows are each answered; null keys, repositories
    and owners are values like any other; an empty table gives no rows; other columns are ignored.
    """
    scanned = scan(docs, key, text, repo, owner)
    out = scanned.select("key", "digest").join(judged(scanned, **limits), "digest", "left")
    none = F.array().cast(out.schema["spans"].dataType)
    return out.select(F.col("key").alias(key), F.coalesce("spans", none).alias("spans"))


@F.arrow_udf(T.StringType())
def _blank(texts: pa.Array, starts: pa.Array, ends: pa.Array, kinds: pa.Array) -> pa.Array:
    out = []
    for text, s, e, k in zip(texts.to_pylist(), starts.to_pylist(), ends.to_pylist(), kinds.to_pylist()):
        done, parts = 0, []
        for start, end, kind in sorted(zip(s, e, k)):
            if end > done:
                parts += [text[done : max(start, done)], f"[{kind} secret]" if start >= done else ""]
                done = end
        out.append("".join(parts) + text[done:])
    return pa.array(out, pa.string())


def redact(docs: DataFrame, key: str = "doc_id", text: str = "text", repo: str = "doc_id", owner: str = "source", **limits) -> DataFrame:
    """`docs` with every live span replaced by its kind in brackets; copied examples and all else stay as they are.

    All rows and columns are kept; overlapping spans become one replacement; rows with null text stay null.
    Only texts with candidates meet their spans in a join; all others pass straight through.
    """
    scanned = scan(docs, key, text, repo, owner)
    live = judged(scanned, **limits).select("digest", F.filter("spans", lambda s: s["live"]).alias("spans")).filter(F.size("spans") > 0)
    may = F.coalesce(F.regexp(F.col(text), F.lit(MAY_HOLD)), F.lit(False))
    columns = docs.columns
    right = live.select(F.col("digest").alias("_digest"), F.col("spans").alias("_spans"))
    marked = docs.filter(may).withColumn("_digest", F.sha2(F.col(text), 256)).join(right, "_digest", "left")
    blanked = _blank(F.col(text), F.col("_spans.start"), F.col("_spans.end"), F.col("_spans.kind"))
    hit = marked.filter(F.col("_spans").isNotNull()).withColumn(text, blanked).select(*columns)
    clean = marked.filter(F.col("_spans").isNull()).select(*columns)
    return docs.filter(~may).unionByName(clean).unionByName(hit)
