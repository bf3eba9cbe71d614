"""The queries of this subpackage: one for each operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import align, bpe, decontaminate, lang_id, licenses, minhash, runs, secret_scan, suffix_dedup, token_counts, topk, url_filters, warc
from graphloom.llm.common import table

VOCABULARY, OTHER_VOCABULARY = "byte_bpe_50k.json", "piece_bpe_32k.model"

#: The rules of op9.
URL_RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_table(spark, table(spark, sf_dir, "pages"))


def base32_sql(hex_digest: str) -> str:
    """DuckDB SQL for the base32 of a 40-digit hex string: 5 hex digits are 20 bits are 4 letters."""
    part = f"CAST('0x' || substr({hex_digest}, 5 * CAST(i AS BIGINT) + 1, 5) AS BIGINT)"
    letters = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(({part} >> {s}) & 31 AS BIGINT) + 1, 1)" for s in (15, 10, 5, 0))
    return f"array_to_string(list_transform(range(8), lambda i: {letters}), '')"


OP2_SQL = f"""
WITH owners AS (SELECT coalesce(html, '') AS payload, max(page_id) AS owner FROM pages GROUP BY 1)
SELECT page_id, octet_length(encode(payload)) AS payload_bytes, {base32_sql("sha1(payload)")} AS payload_digest,
       CASE WHEN page_id = owner THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = owner THEN NULL ELSE owner END AS refers_to
FROM (SELECT page_id, coalesce(html, '') AS payload FROM pages) JOIN owners USING (payload)
"""


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.exact_topk(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


OP5_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id)
SELECT * FROM (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored)
WHERE rank <= 5
"""


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.roundtrip_digests(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), limit=1024)


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), words=2, percent=80)


OP7_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN w
         ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s
  FROM words),
classes AS (SELECT list_sort(s) AS s, min(doc_id) AS rep, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY 1, 3),
posted AS (SELECT rep, n, unnest(s) AS shingle FROM classes),
links AS (
  SELECT a.rep AS a, b.rep AS b FROM posted a JOIN posted b ON a.shingle = b.shingle AND a.rep < b.rep AND a.n * 100 >= b.n * 80 AND b.n * 100 >= a.n * 80
  GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
either AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(node, found) AS (
  SELECT DISTINCT a, a FROM either UNION SELECT r.node, e.b FROM reach r JOIN either e ON r.found = e.a),
components AS (SELECT node, min(found) AS component FROM reach GROUP BY node)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, coalesce(component, rep, s.doc_id) AS component_id, s.doc_id = coalesce(component, rep, s.doc_id) AS kept
FROM sets s LEFT JOIN classes c ON c.s = list_sort(s.s) AND len(s.s) > 0 LEFT JOIN components ON rep = node
"""


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, url_filters.RULE_SCHEMA)
    return url_filters.filter_urls(table(spark, sf_dir, "pages"), rules, default="allow")


OP9_SQL = """
WITH rest AS (
  SELECT page_id, CASE WHEN url IS NOT NULL AND strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
hosts AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM rest),
parts AS (
  SELECT row_number() OVER () AS row_id, page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path
  FROM hosts),
rules(rule_host, rule_path, rule_action) AS (VALUES
  ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'block'),
  ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
best AS (
  SELECT row_id, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
         arg_max(rule_action, length(rule_host || rule_path)) AS rule_action
  FROM parts JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY row_id)
SELECT page_id, host, path, rule, coalesce(rule_action, 'allow') AS verdict
FROM parts LEFT JOIN best USING (row_id)
"""


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = lang_id.train(docs.filter(~lang_id.held_out("doc_id")))
    out = lang_id.identify(docs, model)
    return out.select("doc_id", lang_id.held_out("doc_id").alias("held_out"), "lang_pred", "score")


def op11_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secret_scan.scan_secrets(docs, secret_scan.train(docs))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.run_digests(table(spark, sf_dir, "documents"), plant=True)


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.alignment_digests(table(spark, sf_dir, "documents"), *map(public_tokenizers.path, (VOCABULARY, OTHER_VOCABULARY)))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_licenses": op1_licenses,
        "op2_warc": op2_warc,
        "op3_bpe": op3_bpe,
        "op4_suffix_dedup": op4_suffix_dedup,
        "op5_topk": op5_topk,
        "op6_token_counts": op6_token_counts,
        "op7_minhash": op7_minhash,
        "op8_decontamination": op8_decontamination,
        "op9_url_filters": op9_url_filters,
        "op10_language_id": op10_language_id,
        "op11_secrets": op11_secrets,
        "op12_periodic_runs": op12_periodic_runs,
        "op13_token_alignment": op13_token_alignment,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_licenses": licenses.scan_sql(), "op2_warc": OP2_SQL, "op5_topk": OP5_SQL, "op7_minhash": OP7_SQL, "op9_url_filters": OP9_SQL}
