"""Registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from labelops.llm import (
    bpe,
    byte_classifier,
    decontaminate,
    fingerprints,
    jaccard_join,
    license_scan,
    line_templates,
    oracles,
    page_wrappers,
    phrase_trees,
    secret_scan,
    token_files,
    url_rules,
    vector_codes,
)

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
# The rules of the query.
URL_RULES = [
    url_rules.Rule("allow", "org", "/"),
    url_rules.Rule("block", "example.org", "/es/"),
    url_rules.Rule("block", "example.org", "/en/1"),
    url_rules.Rule("allow", "com", "/fr/"),
    url_rules.Rule("block", "com", "/de/"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_templates.drop_recurring_lines(table(spark, sf_dir, "documents")).select("doc_id", "text")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_and_decode(table(spark, sf_dir, "documents"), BYTE_BPE)


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = token_files.new_folder(spark)
    token_files.write_tokens(table(spark, sf_dir, "documents"), target, BYTE_BPE)
    return token_files.read_digests(spark, target)


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_join(table(spark, sf_dir, "documents"))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_with_edits(table(spark, sf_dir, "documents"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.filter_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_wrappers.extract_pages(table(spark, sf_dir, "pages"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    network = byte_classifier.fit(documents, table(spark, sf_dir, "labels"))
    scored = byte_classifier.score_table(documents, network)
    return scored.withColumn("held_out", byte_classifier.fold() == 2).select("doc_id", "held_out", "score", "predicted")


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_secrets(table(spark, sf_dir, "documents"))


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_digest(table(spark, sf_dir, "documents"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(table(spark, sf_dir, "embeddings"))


def op13_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_trees.mine_phrases(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_line_dedup,
        op2_decontaminate,
        op3_bpe,
        op4_token_files,
        op5_jaccard_join,
        op6_fingerprints,
        op7_url_filter,
        op8_html_extraction,
        op9_quality_classifier,
        op10_secret_scan,
        op11_license_scan,
        op12_vector_codes,
        op13_phrase_mining,
    )
}

OP7_SQL = r"""
WITH RECURSIVE parts AS (
  SELECT page_id, html, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), split AS (
  SELECT page_id, html, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(rest, '^[^/?#]*([^#]*)', 1) AS tail FROM parts
), rules(rank, verdict, host, path) AS (
  VALUES (1, 'block', 'example.org', '/en/1'), (2, 'block', 'example.org', '/es/'), (3, 'allow', 'com', '/fr/'), (4, 'block', 'com', '/de/'), (5, 'allow', 'org', '/')
), links AS (
  SELECT host || tail AS a, replace(regexp_extract(tag, '(?i)\bhref\s*=\s*["'']?\s*([^"''\s>]+)', 1), '&amp;', '&') AS target, host, path
  FROM (SELECT *, unnest(regexp_extract_all(html, '(?i)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>')) AS tag FROM split)
  UNION ALL
  SELECT host || tail, replace(regexp_extract(tag, '(?i)\burl\s*=\s*["'']?\s*([^"''\s>;]+)', 1), '&amp;', '&'), host, path
  FROM (SELECT *, unnest(regexp_extract_all(html, '(?i)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>')) AS tag FROM split)
), rests AS (
  SELECT a, CASE WHEN strpos(target, '://') > 0 THEN substr(target, strpos(target, '://') + 3) WHEN starts_with(target, '//') THEN substr(target, 3)
    WHEN starts_with(target, '/') THEN host || target WHEN target[1] IN ('?', '#') THEN host || path || target
    ELSE host || coalesce(nullif(regexp_extract(path, '^.*/'), ''), '/') || target END AS rest FROM links WHERE target <> ''
), edges AS (
  SELECT a, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || regexp_extract(rest, '^[^/?#]*([^#]*)', 1) AS b
  FROM rests WHERE a <> '' AND rest <> ''
), both_ways AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges), reach(a, b) AS (
  SELECT a, b FROM both_ways UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a
), ends AS (
  SELECT b AS node, regexp_extract(b, '^[^/?#]*') AS host, regexp_extract(b, '^[^/?#]*([^?#]*)', 1) AS path FROM (SELECT DISTINCT b FROM both_ways)
), end_verdicts AS (
  SELECT e.node, arg_min(r.verdict, r.rank) AS verdict FROM ends e JOIN rules r
    ON (e.host = r.host OR ends_with(e.host, '.' || r.host)) AND starts_with(e.path, r.path) GROUP BY e.node
), aliases AS (
  SELECT reach.a AS node FROM reach JOIN end_verdicts v ON v.node = reach.b GROUP BY reach.a
  HAVING bool_or(v.verdict = 'block') AND NOT bool_or(v.verdict = 'allow')
), own AS (
  SELECT s.page_id, arg_min(r.host || r.path, r.rank) AS rule, arg_min(r.verdict, r.rank) AS verdict FROM split s JOIN rules r
    ON (s.host = r.host OR ends_with(s.host, '.' || r.host)) AND starts_with(s.path, r.path) GROUP BY s.page_id
)
SELECT s.page_id, s.host, s.path, o.rule,
  coalesce(o.verdict, CASE WHEN s.host || s.tail IN (SELECT node FROM aliases) THEN 'block' ELSE 'allow' END) AS verdict
FROM split s LEFT JOIN own o USING (page_id)
"""

ORACLE = {
    "op7_url_filter": OP7_SQL,
    "op11_license_scan": oracles.licenses(),
    "op12_vector_codes": oracles.vector_rounds(),
    "op13_phrase_mining": oracles.phrases(),
}
