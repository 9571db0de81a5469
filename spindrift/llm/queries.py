"""Queries of the training-data operators over the synthetic tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from spindrift.llm import bpe, decontaminate, exact_dedup, language_id, line_dedup, lm, ngram_join, passages, toxicity, url_filter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


URL_RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_table(spark, sf_dir, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


OP1_SQL = r"""
WITH p AS (
  SELECT page_id,
         CASE WHEN strpos(url, '://') > 0 THEN translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
         CASE WHEN strpos(url, '://') > 0 THEN regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) ELSE '' END AS path,
         row_number() OVER () AS rid
  FROM pages),
r AS (SELECT * FROM (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')) v(rh, rp, verdict)),
m AS (
  SELECT p.rid, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(verdict, length(rh || rp)) AS verdict
  FROM p JOIN r ON (p.host = rh OR suffix(p.host, '.' || rh)) AND starts_with(p.path, rp) GROUP BY p.rid)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN m USING (rid)
"""


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return lm.score(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated(_table(spark, sf_dir, "documents"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicate(_table(spark, sf_dir, "documents"))


OP6_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t)
"""


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return language_id.predict(docs, language_id.train(docs))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.drop_boilerplate(_table(spark, sf_dir, "documents")).select("doc_id", "source", "n_lines", "n_dropped", "text")


OP8_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, text, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT rid, source, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM d WHERE text IS NOT NULL),
totals AS (SELECT source, count(*) AS total FROM d GROUP BY source),
counts AS (SELECT source, trim(line) AS line, count(DISTINCT rid) AS pages FROM l WHERE trim(line) <> '' GROUP BY ALL),
bad AS (SELECT c.source, c.line FROM counts c JOIN totals t ON c.source IS NOT DISTINCT FROM t.source WHERE pages >= {line_dedup.MIN_PAGES} AND pages > {line_dedup.RATIO}::DOUBLE * total),
k AS (
  SELECT l.rid, count(*) AS n_lines, count(bad.line) AS n_dropped, string_agg(l.line, chr(10) ORDER BY pos) FILTER (bad.line IS NULL) AS kept
  FROM l LEFT JOIN bad ON l.source IS NOT DISTINCT FROM bad.source AND trim(l.line) = bad.line GROUP BY l.rid)
SELECT doc_id, source, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped,
       CASE WHEN text IS NULL THEN NULL ELSE coalesce(kept, '') END AS text
FROM d LEFT JOIN k USING (rid)
"""


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(_table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, _table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select("doc_id", "held_out", "score", "predicted")


_QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "op1_url_filters": (op1_url_filters, OP1_SQL),
    "op2_decontamination": (op2_decontamination, None),
    "op3_lm_scoring": (op3_lm_scoring, None),
    "op4_byte_bpe": (op4_byte_bpe, None),
    "op5_substring_dedup": (op5_substring_dedup, None),
    "op6_exact_dedup": (op6_exact_dedup, OP6_SQL),
    "op7_language_id": (op7_language_id, None),
    "op8_line_dedup": (op8_line_dedup, OP8_SQL),
    "op9_ngram_jaccard_join": (op9_ngram_jaccard_join, None),
    "op10_toxicity": (op10_toxicity, None),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: fn for name, (fn, _) in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _QUERIES.items() if sql is not None}
