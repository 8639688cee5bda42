"""The queries of this subpackage, each applying one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from airloom.llm import alignment, bpe, context_mix, conversation_repair, near_dup, neighbours, ngram_model, packing, paragraphs, quality_classifier, secret_scan, token_counts, url_filter
from airloom.llm.common import read
from airloom.session import scratch_path

QUERIES: dict = {}
SQL: dict[str, str] = {}
VOCABULARY = "word_bpe_49k.json"
TOKEN_LIMIT = 2048


def query(build):
    QUERIES[build.__name__] = build
    return build


def vocabulary(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op5_token_counts(spark, sf_dir):
    """Token counts of all documents through a new digest cache in the shared folder."""
    cache = scratch_path(spark, "token-cache")
    token_counts.create_cache(spark, cache)
    out = token_counts.count_tokens(read(spark, sf_dir, "documents").select("doc_id", "text"), cache, vocabulary())
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))


@query
def op9_bpe(spark, sf_dir):
    """Ids of all documents and the texts decoded from them, as digests."""
    out = bpe.round_trip(read(spark, sf_dir, "documents"), vocabulary())
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def judged_spans(spans: str, kinds: tuple[str, ...]):
    """`kind:start:end` of the spans of these kinds, in order, joined by commas."""
    wanted = F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(wanted, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


@query
def op3_secret_scan(spark, sf_dir):
    """Spans of all documents; a document stands for a repository, its source for the owner."""
    out = secret_scan.find(read(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    base = secret_scan.KINDS[:3]

    def count(test):
        return F.size(F.filter("spans", test)).cast("long")

    def of(kind):
        return lambda s: s["kind"] == kind

    return out.select(
        "doc_id",
        *[count(of(kind)).alias(f"n_{kind}") for kind in base],
        F.sha2(judged_spans("spans", base), 256).alias("base_sha256"),
        judged_spans("spans", secret_scan.KINDS).alias("spans"),
        count(lambda s: s["live"]).alias("n_live"),
        count(lambda s: s["example"]).alias("n_example"),
    )


RULES = (
    url_filter.Rule("allow", "org", "/"),
    url_filter.Rule("block", "example.org", "/es/"),
    url_filter.Rule("block", "example.org", "/en/1"),
    url_filter.Rule("allow", "com", "/fr/"),
    url_filter.Rule("block", "com", "/de/"),
)
# Labels of hosts whose addresses make up the block list of the query.
LISTED_HOSTS = r"(^|[.-])(ads|adult|bets|casino|pills|spam)([.-]|$)"


@query
def op6_url_filter(spark, sf_dir):
    """All pages by the rules, else by the exact list of addresses (host and path) on listed hosts."""
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    address = F.concat(url_filter.host(F.col("url")), url_filter.path(F.col("url")))
    listed = pages.filter(F.regexp(url_filter.host(F.col("url")), F.lit(LISTED_HOSTS))).select(address.alias("key"))
    out = url_filter.judge(pages, RULES, listed, F.concat("host", "path"))
    return out.select("page_id", "host", "path", "rule", "verdict")


SQL["op6_url_filter"] = f"""
WITH cut AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages
), split AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(rest, '^[^/?#]*'), '{url_filter.UPPER}', '{url_filter.LOWER}'), '') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM cut
), fit AS (
  SELECT *, CASE
    WHEN ('.' || host) LIKE '%.example.org' AND path LIKE '/en/1%' THEN 'example.org/en/1'
    WHEN ('.' || host) LIKE '%.example.org' AND path LIKE '/es/%' THEN 'example.org/es/'
    WHEN ('.' || host) LIKE '%.com' AND path LIKE '/fr/%' THEN 'com/fr/'
    WHEN ('.' || host) LIKE '%.com' AND path LIKE '/de/%' THEN 'com/de/'
    WHEN ('.' || host) LIKE '%.org' AND path LIKE '/%' THEN 'org/' END AS rule
  FROM split
)
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN regexp_matches(host, '{LISTED_HOSTS}') THEN 'block' ELSE 'allow' END AS verdict
FROM fit
"""


@query
def op8_neighbours(spark, sf_dir):
    """Ten nearest of every vector whose id is divisible by 100, among all."""
    vectors = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return neighbours.nearest(vectors, neighbours.divisible("vec_id", 100))


@query
def op10_packing(spark, sf_dir):
    """All documents as sequences of words in length buckets and batches."""
    docs = read(spark, sf_dir, "documents").select("doc_id", packing.n_words(F.col("text")).alias("n_words"))
    return packing.pack(docs)


@query
def op2_near_dup(spark, sf_dir):
    """Near-duplicate components of all documents."""
    return near_dup.near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op1_quality_rules(spark, sf_dir):
    """Base figures, perplexity and verdict of all documents."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return ngram_model.judge(docs, keep_text=False).drop("lang")


@query
def op7_context_mix(spark, sf_dir):
    """Scores of all documents under a model of the nine tenths not held out."""
    return context_mix.score(read(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op4_paragraph_dedup(spark, sf_dir):
    """Every occurrence of a paragraph that repeats in the documents, the first one kept."""
    return paragraphs.repeated(read(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op13_conversation_repair(spark, sf_dir):
    """Faults and cheapest repairs of all conversations after damage."""
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return conversation_repair.repair(conversation_repair.damage(rows))


@query
def op12_alignment(spark, sf_dir):
    """Groups and links of the two tokenizations of all documents."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return alignment.link_counts(docs, vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))


@query
def op11_quality_classifier(spark, sf_dir):
    """Quality scores of all documents, learned from the labels outside the held-out fifth."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_classifier.score(docs, read(spark, sf_dir, "labels").select("doc_id", "quality"))
