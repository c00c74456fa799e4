"""The queries of this subpackage and their oracle SQL (DuckDB)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, exact_dedup, jaccard_join, language_id, licenses, media, mixing, packing, suffix_dedup, token_counts
from .common import conversations, documents


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(documents(spark, sf_dir).select("doc_id", "text"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    rows = docs.select("doc_id", "text", language_id.held_out(F.col("doc_id")).alias("held_out"))
    return language_id.identify(rows, language_id.learn(docs)).drop("text")


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "n_shingles", "component_id", "class_id", "n_links")


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(conversations(spark, sf_dir))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir).select("doc_id", "text"))


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(documents(spark, sf_dir).select("doc_id", "text"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(documents(spark, sf_dir).select("doc_id", "text", "source"))
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies")


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir).select("doc_id", "text"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.length_table(token_counts.encoded_lengths(documents(spark, sf_dir).select("text")))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(documents(spark, sf_dir), columns=["doc_id"])


REPEATS_SQL = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT doc_id, p, substr(h, 2 * p + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(0, n - 49)) AS p FROM d)),
m AS (SELECT s, min(doc_id) AS least FROM w GROUP BY s),
f AS (SELECT doc_id, p, coalesce(p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) > 50, true) AS new FROM w JOIN m USING (s) WHERE least < doc_id),
r AS (SELECT doc_id, p, sum(new::INT) OVER (PARTITION BY doc_id ORDER BY p ROWS UNBOUNDED PRECEDING) AS run FROM f),
s AS (SELECT doc_id, min(p) AS a, max(p) + 50 AS b FROM r GROUP BY doc_id, run),
k AS (SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS before FROM s),
g AS (SELECT doc_id, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS head, max(b) AS last, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans FROM k JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id)
"""
JACCARD_SQL = r"""
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS g FROM t),
n AS (SELECT doc_id, len(g) AS n FROM s),
x AS (SELECT doc_id, unnest(g) AS g FROM s),
b AS (SELECT p.doc_id AS i, q.doc_id AS j, count(*) AS shared FROM x p JOIN x q ON p.g = q.g AND p.doc_id < q.doc_id GROUP BY ALL),
l AS (SELECT i, j FROM b JOIN n a ON a.doc_id = i JOIN n c ON c.doc_id = j WHERE 100 * shared >= 75 * (a.n + c.n - shared)),
e AS (SELECT i, j FROM l UNION SELECT j, i FROM l),
r AS (SELECT i, j FROM e UNION SELECT r.i, e.j FROM r JOIN e ON r.j = e.i),
c AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY list_sort(g), CASE WHEN len(g) = 0 THEN doc_id END) AS class_id FROM s),
k AS (SELECT e.i, count(DISTINCT b.class_id) AS n_links FROM e JOIN c a ON a.doc_id = e.i JOIN c b ON b.doc_id = e.j WHERE a.class_id <> b.class_id GROUP BY e.i),
o AS (SELECT n.doc_id, n.n AS n_shingles, least(n.doc_id, coalesce(min(r.j), n.doc_id)) AS component_id FROM n LEFT JOIN r ON r.i = n.doc_id GROUP BY n.doc_id, n.n)
SELECT o.doc_id, n_shingles, component_id, class_id, coalesce(n_links, 0) AS n_links FROM o JOIN c USING (doc_id) LEFT JOIN k ON k.i = o.doc_id
"""

EXACT_SQL = r"""
WITH n AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY text_sha256) AS kept, text_sha256
FROM n
"""

QUERIES = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_language_id": op2_language_id,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_chat_format": op4_chat_format,
    "op5_packing": op5_packing,
    "op6_media": op6_media,
    "op7_mixing": op7_mixing,
    "op8_licenses": op8_licenses,
    "op9_token_counts": op9_token_counts,
    "op10_exact_dedup": op10_exact_dedup,
}

ORACLES = {"op1_suffix_dedup": REPEATS_SQL, "op3_jaccard_join": JACCARD_SQL, "op4_chat_format": chat.FORMAT_SQL, "op10_exact_dedup": EXACT_SQL}
