"""The opN queries and the SQL they are compared with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import load
from .contamination import leaked_items
from .html import extract
from .licences import scan_licences
from .nearest import nearest
from .packing import pack
from .pii import digests, find_private
from .quality import score_quality
from .simhash import simhash_components
from .toxicity import score_toxicity
from .urls import judge_urls

#: Action, host and path of the rules of op7.
URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of 4-word shingles, linked at 4 or fewer differing bits."""
    found = simhash_components(load(spark, sf_dir, "documents"), width=4, radius=4, seed=42)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces and their places in sequences of 1024 tokens."""
    return pack(load(spark, sf_dir, "documents"), capacity=1024, end_id=2)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pattern spans and the terms near them that disclose them."""
    return digests(find_private(load(spark, sf_dir, "documents")))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's main text."""
    return extract(load(spark, sf_dir, "pages"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold 0.8 or more of a benchmark item's 5-word shingles."""
    return leaked_items(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every twentieth."""
    return nearest(load(spark, sf_dir, "embeddings"), every=20, k=20)


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's rule and verdict."""
    return judge_urls(load(spark, sf_dir, "pages"), URL_RULES)


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality score; predicted at 0.3."""
    return score_quality(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"), decision=0.3)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity score; predicted at 0.5."""
    return score_toxicity(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op10_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's licence labels."""
    return scan_licences(load(spark, sf_dir, "documents")).drop("expressions")


def queries() -> dict:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}


_SHINGLES = r"""SELECT DISTINCT {id}, unnest(list_transform(range(1, greatest(len(w) - 3, 1)), lambda i: array_to_string(w[i:i + 4], ' '))) AS h
 FROM (SELECT {id}, list_filter(string_split_regex(lower(text), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS w FROM {table})"""

_RULE = """CASE WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'allow example.net/en/'
 WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'block example.com/de/'
 WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'allow org/fr/'
 WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'block net/' END"""


def oracle_sql() -> dict[str, str]:
    """SQL for the queries that SQL can express; the others are tested against brute force."""
    return {
        "op5_decontamination": f"""WITH d AS ({_SHINGLES.format(id="doc_id", table="documents")}), i AS ({_SHINGLES.format(id="item_id", table="benchmark")}),
 n AS (SELECT item_id, count(*) AS n_shingles FROM i GROUP BY item_id), f AS (SELECT doc_id, item_id, count(*) AS n_found FROM d JOIN i USING (h) GROUP BY ALL)
 SELECT doc_id, item_id, n_shingles, n_found, round(n_found / n_shingles, 6) AS containment FROM f JOIN n USING (item_id) WHERE n_found >= ceil(0.8 * n_shingles - 1e-9)""",
        "op6_nearest_neighbours": """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
 s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
 r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
 SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""",
        "op7_url_filters": rf"""WITH RECURSIVE p AS (SELECT page_id, html, url, CASE WHEN contains(url, '://') THEN translate(regexp_extract(url, '^(?s:.)*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
  coalesce(regexp_extract(url, '^(?s:.)*?://[^/?#]*([^?#]*)', 1), '') AS path, coalesce(regexp_extract(url, '^(?s:.)*?://[^/?#]*[^?#]*(\?[^#]*)', 1), '') AS tail FROM pages),
 k AS (SELECT *, {_RULE} AS fit, host || path || tail AS node FROM p),
 e AS (SELECT node AS a, regexp_replace(regexp_extract(html, '(?is)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*\bhref\s*=\s*["'']?[a-z]+://([^"''\s>#]+)', 1), '#.*$', '') AS b FROM k WHERE regexp_matches(html, '(?is)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*\bhref')),
 sym AS (SELECT a, b FROM e UNION SELECT b, a FROM e), reach AS (SELECT a, b FROM sym UNION SELECT r.a, o.b FROM reach r JOIN sym o ON r.b = o.a),
 said AS (SELECT r.a AS node, bool_or(starts_with(k.fit, 'allow')) AS allowed, bool_or(starts_with(k.fit, 'block')) AS blocked FROM reach r JOIN k ON k.node = r.b GROUP BY r.a)
 SELECT page_id, host, path, substr(fit, 7) AS rule, coalesce(substr(fit, 1, 5), CASE WHEN blocked AND NOT allowed THEN 'block' END, 'allow') AS verdict FROM k LEFT JOIN said USING (node)""",
    }
