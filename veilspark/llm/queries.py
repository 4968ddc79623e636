"""The registered queries of the corpus operators, with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import embeddings, html_pages, html_text, lines, mixing, neardup, quality, tokens, toxicity, urls

#: host, path, verdict.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urls.filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


OP1_SQL = r"""
WITH u AS (
  SELECT page_id, CASE WHEN url IS NULL OR strpos(url, '://') = 0 THEN '' ELSE substr(url, strpos(url, '://') + 3) END AS rest FROM pages
), p AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u
), r(rule_host, rule_path, said) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
), m AS (
  SELECT page_id, host, path, rule_host || rule_path AS rule, said,
         row_number() OVER (PARTITION BY page_id ORDER BY length(rule_host || rule_path) DESC NULLS LAST) AS k
  FROM p LEFT JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
)
SELECT page_id, host, path, rule, coalesce(said, 'allow') AS verdict FROM m WHERE k = 1
"""


def op2_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_vectors(table(spark, sf_dir, "embeddings"), cosine=0.95)


OP2_SQL = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
), good AS MATERIALIZED (
  SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v
  WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), links AS MATERIALIZED (
  SELECT a.vec_id AS u, b.vec_id AS v FROM good a JOIN good b ON a.vec_id <> b.vec_id
  WHERE CASE WHEN len(a.e) = len(b.e) THEN list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.95 END
), reach(node, seen) AS (
  SELECT vec_id, vec_id FROM v
  UNION
  SELECT r.node, l.v FROM reach r JOIN links l ON l.u = r.seen
), least AS (
  SELECT node, min(seen) AS component_id FROM reach GROUP BY node
)
SELECT v.vec_id, (SELECT count(*) FROM links l WHERE l.u = v.vec_id) AS n_links, component_id, v.vec_id = component_id AS kept
FROM v JOIN least ON node = v.vec_id
"""


def op3_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_texts(table(spark, sf_dir, "pages"), html_pages.trained())


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.quality_report(docs, quality.learn(quality.labelled(docs, table(spark, sf_dir, "labels"))))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), limit=512)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), counts=("n_lines", "n_removed"))


def op8_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), length=5, percent=85)


OP8_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))) END AS shingles FROM w
), n AS (
  SELECT doc_id, len(shingles)::BIGINT AS n_shingles FROM s
), one AS (
  SELECT doc_id, len(shingles) AS size, unnest(shingles) AS shingle FROM s
), numbered AS MATERIALIZED (
  SELECT doc_id, size, dense_rank() OVER (ORDER BY shingle) AS shingle FROM one
), shared AS (
  SELECT a.doc_id AS u, b.doc_id AS v FROM numbered a JOIN numbered b ON a.shingle = b.shingle AND a.doc_id < b.doc_id
  WHERE 100 * least(a.size, b.size) >= 85 * greatest(a.size, b.size)
  GROUP BY a.doc_id, b.doc_id, a.size, b.size HAVING 100 * count(*) >= 85 * (a.size + b.size - count(*))
), links AS MATERIALIZED (
  SELECT u, v FROM shared UNION ALL SELECT v, u FROM shared
), reach(node, seen) AS (
  SELECT doc_id, doc_id FROM n
  UNION
  SELECT r.node, l.v FROM reach r JOIN links l ON l.u = r.seen
), least AS (
  SELECT node, min(seen) AS component_id FROM reach GROUP BY node
)
SELECT doc_id, n_shingles, component_id, doc_id = component_id AS kept FROM n JOIN least ON node = doc_id
"""


def op9_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode_digests(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.toxicity_report(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


QUERIES = {
    "op1_url_filter": op1_url_filter,
    "op2_embedding_neardup": op2_embedding_neardup,
    "op3_mix": op3_mix,
    "op4_html_extraction": op4_html_extraction,
    "op5_quality_rules": op5_quality_rules,
    "op6_token_counts": op6_token_counts,
    "op7_line_dedup": op7_line_dedup,
    "op8_minhash_neardup": op8_minhash_neardup,
    "op9_bpe_round_trip": op9_bpe_round_trip,
    "op10_toxicity": op10_toxicity,
}
SQL = {"op1_url_filter": OP1_SQL, "op2_embedding_neardup": OP2_SQL, "op8_minhash_neardup": OP8_SQL}
