"""The operators applied, with production parameters, to whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trendloom.llm.common import table
from trendloom.llm.decontaminate import contaminated
from trendloom.llm.exact_substrings import remove_repeated_bytes
from trendloom.llm.hard_negatives import mine_hard_negatives
from trendloom.llm.html_extract import extract_text
from trendloom.llm.language_id import identify_languages
from trendloom.llm.licence_scan import oracle_sql as licence_sql
from trendloom.llm.licence_scan import scan_licences
from trendloom.llm.near_dedup import near_duplicates
from trendloom.llm.packing import pack_documents
from trendloom.llm.passage_dedup import remove_repeated_passages
from trendloom.llm.personal_data import personal_data
from trendloom.llm.quality import document_statistics, quality_rules
from trendloom.llm.token_counts import token_counts
from trendloom.llm.whitening import whiten


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_passages(table(spark, sf_dir, "documents"))


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_bytes(table(spark, sf_dir, "documents"))


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=2, percent=80)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def quality_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the base rules of the quality operator count in every document."""
    stats = document_statistics(table(spark, sf_dir, "documents"), "doc_id", "text", [])
    return stats.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(table(spark, sf_dir, "documents"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licences(table(spark, sf_dir, "documents"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.pmod("vec_id", F.lit(7)) == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine_hard_negatives(rows.withColumn("label", label), F.pmod("id", F.lit(50)) == 0)


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_html_extraction": op1_html_extraction,
    "op2_quality_rules": op2_quality_rules,
    "quality_statistics": quality_statistics,
    "op3_language_id": op3_language_id,
    "op4_license_scan": op4_license_scan,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_suffix_array_dedup": op7_suffix_array_dedup,
    "op8_benchmark_decontamination": op8_benchmark_decontamination,
    "op9_minhash_near_dedup": op9_minhash_near_dedup,
    "op10_token_counts": op10_token_counts,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_personal_data": op12_personal_data,
    "op13_embedding_whitening": op13_embedding_whitening,
}

HARD_NEGATIVES_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, r.vec_id AS row_id, a.label = r.label AS same, CAST(list_inner_product(a.q, r.q) AS BIGINT) AS score
  FROM v a JOIN v r ON a.vec_id <> r.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, row_id) AS k FROM s WHERE same) t WHERE k <= 5),
n AS (
  SELECT p.anchor_id, p.row_id AS positive_id, s.row_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, p.row_id ORDER BY s.score DESC, s.row_id) AS k
  FROM p JOIN s ON s.anchor_id = p.anchor_id WHERE NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT anchor_id, positive_id, CAST(k AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE k <= 3
"""

QUALITY_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS l, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
g AS (SELECT r, i, l[i] || chr(10) || l[i + 1] || chr(10) || l[i + 2] AS k FROM (SELECT r, l, unnest(range(1, len(l) - 1)) AS i FROM w WHERE len(l) > 2) x),
c AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS n FROM g) y WHERE n > 1),
p AS (SELECT r, count(DISTINCT i + s) AS n FROM c, (SELECT unnest([0, 1, 2]) AS s) z GROUP BY r),
f AS (
  SELECT doc_id, CAST(len(l) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(p.n, 0) AS n_repeat_words FROM w LEFT JOIN p ON p.r = w.r)
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f
"""

ORACLE_SQL: dict[str, str] = {"quality_statistics": QUALITY_SQL, "op4_license_scan": licence_sql(), "op11_hard_negatives": HARD_NEGATIVES_SQL}
