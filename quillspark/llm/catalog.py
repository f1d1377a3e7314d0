"""Registered queries of the corpus operators, with checking SQL where SQL can express the work."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from quillspark.llm.adapt_join import near_duplicates
from quillspark.llm.brown_lm import held_out_scores
from quillspark.llm.curriculum import plan
from quillspark.llm.dual_tree import rank
from quillspark.llm.html_template import extract
from quillspark.llm.inner_top import search
from quillspark.llm.lsi import contaminated
from quillspark.llm.order_minhash import fingerprints
from quillspark.llm.quality import THRESHOLD, classify
from quillspark.llm.tables import END_ID, table, tokenizer_path
from quillspark.llm.token_count import count_tokens
from quillspark.llm.token_files import token_files
from quillspark.llm.url_filter import LIMIT, RULES, VOCABULARY, filter_urls
from quillspark.llm.whitening import whiten

CONTEXT = 2048  # tokens

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL judged by the rules, else by the vocabulary."""
    judged = filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"))
    return judged.select("page_id", "host", "path", "rule", "verdict", "strict_hits", "soft_hits", "weight")


def _rows(values) -> str:
    return ", ".join("(" + ", ".join(repr(v) for v in row) + ")" for row in values)


ORACLES["op1_url_filter"] = f"""
WITH rules(rule, rule_verdict) AS (VALUES {_rows(RULES)}),
terms(term, weight) AS (VALUES {_rows(VOCABULARY.items())}),
cut AS (
  SELECT page_id, url,
    CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
parts AS (
  SELECT page_id, url,
    translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
    translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low
  FROM cut),
fitting AS (
  SELECT page_id, p.url, max_by(rule, length(rule)) AS rule, max_by(rule_verdict, length(rule)) AS rule_verdict
  FROM parts p JOIN rules r
    ON (host = split_part(rule, '/', 1) OR ends_with(host, '.' || split_part(rule, '/', 1)))
   AND starts_with(path, substr(rule, strpos(rule, '/')))
  GROUP BY page_id, p.url),
found AS (
  SELECT page_id, p.url, CAST(count(*) FILTER (weight >= {LIMIT}) AS INT) AS strict_hits,
    CAST(count(*) FILTER (weight < {LIMIT}) AS INT) AS soft_hits, CAST(sum(weight) AS INT) AS weight
  FROM (SELECT DISTINCT page_id, url, low FROM parts) p JOIN terms
    ON regexp_matches(low, '(^|[^a-z0-9])' || term || '($|[^a-z0-9])')
  GROUP BY page_id, p.url)
SELECT p.page_id, host, path, rule,
  coalesce(rule_verdict, CASE WHEN coalesce(weight, 0) >= {LIMIT} THEN 'block' ELSE 'allow' END) AS verdict,
  coalesce(strict_hits, 0) AS strict_hits, coalesce(soft_hits, 0) AS soft_hits, coalesce(weight, 0) AS weight
FROM parts p
LEFT JOIN fitting f ON f.page_id = p.page_id AND f.url = p.url
LEFT JOIN found h ON h.page_id = p.page_id AND h.url = p.url
"""


@query
def op8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words taken from every document, and the training position of its first use."""
    planned = plan(table(spark, sf_dir, "documents"))
    first = F.get("positions", F.lit(0)).alias("position")
    return planned.select("doc_id", "size", "source_size", "target", "taken", first).orderBy("position", "doc_id")


@query
def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learned from labels outside the held-out fold."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = classify(docs, table(spark, sf_dir, "labels"))
    predicted = (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    return scored.select("doc_id", "held_out", "score", predicted)


@query
def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids written to Parquet in id order, described as read back."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_files(spark, docs, tokenizer_path(), END_ID)


@query
def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose five-word shingle sets are alike by 0.8."""
    return near_duplicates(table(spark, sf_dir, "documents"))


@query
def op3_html_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract(pages).select("page_id", "url", "text", "n_chars")


@query
def op9_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    return fingerprints(table(spark, sf_dir, "documents"))


@query
def op2_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, and whether it is over the limit of a context."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = count_tokens(docs, tokenizer_path())
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")
    return counted.select("doc_id", size, "n_tokens", (F.col("n_tokens") > CONTEXT).alias("over_limit"))


@query
def op5_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of every document under classes learned outside the held-out fold."""
    scored = held_out_scores(table(spark, sf_dir, "documents"))
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query
def op6_latent_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark items, copied or paraphrased."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op11_inner_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten highest integer inner products of every hundredth vector with all others."""
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


ORACLES["op11_inner_top"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda c: floor(1024 * CAST(c AS DOUBLE))) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.x, c.x) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
ranked AS (
  SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM scored)
SELECT query_id, CAST(n AS INT) AS rank, vec_id, score FROM ranked WHERE n <= 10
"""


@query
def op12_dual_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifty documents of highest score for every benchmark item."""
    return rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS = r"""unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))"""

ORACLES["op12_dual_tree"] = f"""
WITH words AS (SELECT doc_id, {_TERMS} AS term FROM documents),
asked AS (SELECT DISTINCT item_id, {_TERMS} AS term FROM benchmark),
counted AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY doc_id, term),
lengths AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM counted GROUP BY doc_id),
total AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM lengths),
spread AS (SELECT term, count(*) AS df FROM counted GROUP BY term),
scored AS (
  SELECT item_id, doc_id, CAST(sum(
      CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT)
      * ((1000000000 * tf) // (1000 * tf + 20 * (50 + ((50 * n * n_docs) // n_terms))))) AS BIGINT) AS score
  FROM asked JOIN counted USING (term) JOIN spread USING (term) JOIN lengths USING (doc_id), total
  GROUP BY item_id, doc_id),
ranked AS (
  SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS n
  FROM scored WHERE score > 0)
SELECT item_id, CAST(n AS INT) AS rank, doc_id, score FROM ranked WHERE n <= 50
"""


@query
def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector on the first eight components, each brought to variance one."""
    return whiten(table(spark, sf_dir, "embeddings"))


@query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages of corpus_pipeline.py over all documents."""
    return corpus_pipeline.run(spark, sf_dir)


if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
