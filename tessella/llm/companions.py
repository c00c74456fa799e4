"""Columns of the operators that SQL can express, as queries of their own with oracle SQL (DuckDB).

Each reads its rows through the operator's query, over the whole table; what SQL cannot express
(random rounding, media bytes, rules with look-around) is tested against brute force instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import queries as Q


def media_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.op6_media(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256")


def mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.op7_mixing(spark, sf_dir).select("doc_id", "size", "source_size", F.round("target", 3).alias("target"))


def license_bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.op8_licenses(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def letterless_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents op 2 says have no letter; those it has a language for are the others."""
    return Q.op2_language_id(spark, sf_dir).select("doc_id", (F.col("lang_pred") == "und").alias("und"))


def packed_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: ids, pieces and ids in them; sequences are gapless, so that their ends are their lengths."""
    p = Q.op5_packing(spark, sf_dir)
    gaps = p.groupBy("sequence_id").agg((F.max(F.col("offset") + F.col("length")) - F.sum("length")).alias("gap"), F.sum("length").alias("n"))
    return p.join(gaps, "sequence_id").groupBy("doc_id").agg((F.max("gap") == 0).alias("gapless"), (F.max("n") <= 1024).alias("fits"), (F.sum("length") == F.max("doc_tokens")).alias("whole"), (F.max("doc_tokens") > 0).alias("some"))


def length_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: the length table's totals agree with each other at every limit."""
    t = Q.op9_token_counts(spark, sf_dir)
    return t.agg(F.max("total_docs").alias("docs"), F.sum("n_docs").alias("sum_docs"), F.bool_and(F.col("truncated_tokens") + F.col("lost_tokens") == F.col("total_tokens")).alias("adds_up"), F.min("docs_over").alias("least_over"))


QUERIES = {f.__name__: f for f in (media_payloads, mixing_targets, license_bases, letterless_documents, packed_pieces, length_sums)}

ORACLES = {
    "media_payloads": """WITH d AS (SELECT doc_id, coalesce(text, '') AS t, octet_length(encode(coalesce(text, '')))::BIGINT AS n FROM documents),
p AS (SELECT *, CASE WHEN n = 0 THEN 192 ELSE (192 - n % 192) % 192 END AS pad FROM d) SELECT doc_id, n AS n_bytes, n + pad AS payload_bytes, sha256(t || repeat(' ', pad)) AS payload_sha256 FROM p""",
    "mixing_targets": r"""WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, [1, 2, 3][((row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 + 1)::INT]::DOUBLE AS w FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY 3 * source_size / w, source IS NULL, source) AS i FROM s),
k AS (SELECT *, ((SELECT sum(source_size) FROM s) - coalesce(sum(3 * source_size) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r),
l AS (SELECT coalesce((SELECT level FROM k WHERE 3 * source_size / w >= level ORDER BY i LIMIT 1), 1e300) AS level)
SELECT doc_id, size, source_size, round(least(3 * source_size, w * l.level), 3) AS target FROM d JOIN k ON d.source IS NOT DISTINCT FROM k.source, l""",
    "license_bases": r"""WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM w), h AS (SELECT doc_id, i - 1 AS i, CASE WHEN array_to_string(w[i:i + 3], ' ') = 'under the mit license' THEN 'mit' WHEN array_to_string(w[i:i + 3], ' ') = 'apache license version 2' THEN 'apache-2' WHEN array_to_string(w[i:i + 2], ' ') = 'cc by nc' THEN 'cc-by-nc' END AS label FROM p),
g AS (SELECT doc_id, count(*) AS n, min(i) AS a, max(i) AS b, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM h WHERE label IS NOT NULL GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0) AS n_base, a AS first_word, b AS last_word, coalesce(labels, '') AS base_labels FROM w LEFT JOIN g USING (doc_id)""",
    "letterless_documents": r"SELECT doc_id, NOT regexp_matches(coalesce(text, ''), '\p{L}') AS und FROM documents",
    "packed_pieces": "SELECT doc_id, true AS gapless, true AS fits, true AS whole, true AS some FROM documents",
    "length_sums": "SELECT count(*) AS docs, count(*) AS sum_docs, true AS adds_up, 0::BIGINT AS least_over FROM documents",
}
