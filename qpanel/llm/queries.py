"""The registered queries of the document operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import centroids, exact_dedup, language, licenses, mixing, packing, pieces, quality, simhash, suffix_dedup, tokens, toxicity, whitening
from .shared import documents

#: Word characters as in shared.WORD, for DuckDB.
WORD_SQL = r"[^\x20\x09-\x0D]+"


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scanned(documents(spark, sf_dir))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.predicted(documents(spark, sf_dir))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_strings(documents(spark, sf_dir))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(documents(spark, sf_dir))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.content_sort(documents(spark, sf_dir), keep="max")


OP6_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(documents(spark, sf_dir))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(documents(spark, sf_dir))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(documents(spark, sf_dir))


OP10_SQL = f"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS t, len(regexp_extract_all(coalesce(text, ''), '{WORD_SQL}')) AS size FROM documents
), k AS (
  SELECT doc_id, source, size,
         -ln((CAST('0x' || substr(md5('mix-0:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) + 1.0::DOUBLE) / 4503599627370496.0::DOUBLE)
         / (1.0::DOUBLE - 0.75::DOUBLE * least(1.0::DOUBLE, len(regexp_extract_all(t, '[#*$%&|<>!]'))::DOUBLE / greatest(size, 1)::DOUBLE)) AS key
  FROM d
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, [3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w FROM d GROUP BY source
), r AS (
  SELECT *, 2 * source_size AS cap, (2 * source_size)::DOUBLE / w AS full_at FROM s
), l AS (
  SELECT *, row_number() OVER o AS place,
         (1.5::DOUBLE * (SELECT sum(source_size) FROM s)::DOUBLE
          - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
         / (sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
  FROM r WINDOW o AS (ORDER BY full_at, source NULLS LAST)
), f AS (SELECT min_by(level, place) AS level FROM l WHERE level <= full_at
), p AS (
  SELECT source, source_size, coalesce(least(cap::DOUBLE, f.level * w), cap::DOUBLE) AS target FROM l CROSS JOIN f
), q AS (
  SELECT k.*, p.source_size, p.target, floor(p.target + 0.5)::BIGINT AS goal,
         sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM k JOIN p ON k.source IS NOT DISTINCT FROM p.source
)
SELECT doc_id, size::BIGINT AS size, source_size, target,
       CAST(CASE WHEN source_size = 0 THEN 0 ELSE (goal // source_size) * size
            + greatest(0, least(size, goal - (goal // source_size) * source_size - (upto - size))) END AS BIGINT) AS taken
FROM q
"""


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.clustered(documents(spark, sf_dir, "embeddings"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(documents(spark, sf_dir, "embeddings"))


def op13_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trips(documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_license_scan": op1_license_scan,
        "op2_language_id": op2_language_id,
        "op3_simhash": op3_simhash,
        "op4_suffix_dedup": op4_suffix_dedup,
        "op5_token_counts": op5_token_counts,
        "op6_exact_dedup": op6_exact_dedup,
        "op7_quality_rules": op7_quality_rules,
        "op8_packing": op8_packing,
        "op9_toxicity": op9_toxicity,
        "op10_mixing": op10_mixing,
        "op11_centroids": op11_centroids,
        "op12_whitening": op12_whitening,
        "op13_pieces": op13_pieces,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_license_scan": licenses.oracle(), "op6_exact_dedup": OP6_SQL, "op10_mixing": OP10_SQL, "op11_centroids": centroids.oracle()}
