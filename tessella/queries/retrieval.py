"""Queries on embeddings and sparse vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vector as V
from ..operators import retrieval as R

WORDS = r"[^a-z]+"


def _emb(spark, d):
    return spark.read.parquet(f"{d}/embeddings.parquet")


def _queries(spark, d):
    return _emb(spark, d).where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


def _r(c, name, places=5):
    return F.round(c, places).alias(name)


def dense_scores(spark, d):
    docs = _emb(spark, d).select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    return R.dense_scores(_queries(spark, d), docs).select("query_id", "doc_id", _r(F.col("score"), "score"))


def dense_topk(spark, d):
    docs = _emb(spark, d).select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    s = R.dense_scores(_queries(spark, d), docs).withColumn("score", F.round("score", 5))
    return R.top_k(s, 10).select("query_id", "doc_id", "score", F.col("rank").cast("long").alias("rank"))


def colbert_rerank(spark, d):
    q = _emb(spark, d).where("vec_id % 100 = 0").select(F.lit(0).alias("query_id"), F.col("vec_id").alias("token"), F.col("embedding").alias("vector"))
    docs = _emb(spark, d).select(F.col("label").alias("doc_id"), F.col("embedding").alias("vector"))
    s = R.colbert_scores(q, docs).withColumn("score", F.round("score", 5))
    return R.top_k(s, 10).select("doc_id", "score", F.col("rank").cast("long").alias("rank"))


def max_sim_in_row(spark, d):
    """Every 16 vectors are one document's tokens; documents of an id divisible by 100 are the queries."""
    groups = _emb(spark, d).groupBy(F.floor(F.col("vec_id") / 16).alias("doc_id")).agg(F.sort_array(F.collect_list(F.struct("vec_id", "embedding"))).alias("g"))
    groups = groups.select("doc_id", F.transform("g", lambda s: s["embedding"]).alias("vector"))
    q = groups.where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), F.col("vector").alias("q"))
    out = R._in_blocks(q, 16 * 1024, lambda block: groups.join(block).select("query_id", "doc_id", V.max_sim(F.col("q"), F.col("vector")).alias("score")))
    return out.select("query_id", "doc_id", _r(F.col("score"), "score"))


def cosine_scores(spark, d):
    q = _queries(spark, d).select("query_id", F.col("vector").alias("q"))
    return R._in_blocks(q, 1024, lambda block: _emb(spark, d).join(block).select("query_id", F.col("vec_id").alias("doc_id"), _r(V.cosine(F.col("q"), F.col("embedding")), "score")))


def l2_normalize(spark, d):
    v = V.l2_normalize(F.transform("embedding", lambda x: x.cast("double") * (F.col("vec_id") % 7)))
    return _emb(spark, d).select("vec_id", F.posexplode(v).alias("dim", "x")).select("vec_id", F.col("dim").cast("long").alias("dim"), _r(F.col("x"), "x"))


def _pool(kind):
    def run(spark, d):
        t = _emb(spark, d).select(F.col("label").alias("id"), F.col("vec_id").alias("pos"), F.col("embedding").alias("vector"), (F.col("vec_id") % 3 != 0).alias("mask"))
        p = R.pool(t, kind).select("id", F.posexplode("vector").alias("dim", "x"))
        return p.select("id", F.col("dim").cast("long").alias("dim"), _r(F.col("x").cast("double"), "x"))

    return run


def _terms(spark, d, table, key):
    t = spark.read.parquet(f"{d}/{table}.parquet").select(F.col(key).alias("id"), F.explode(F.split(F.lower("text"), WORDS)).alias("term")).where("term <> ''")
    return t.groupBy("id", "term").agg(F.count(F.lit(1)).alias("x"))


def _weights(spark, d, table, key, name):
    return R.log_weights(_terms(spark, d, table, key), "id").withColumnRenamed("id", name)


def sparse_dot(spark, d):
    s = R.sparse_scores(_weights(spark, d, "benchmark", "item_id", "query_id").where("query_id % 100 = 0"), _weights(spark, d, "documents", "doc_id", "doc_id"))
    return s.select("query_id", "doc_id", _r(F.col("score"), "score", 4))


def sparse_with_zeros(spark, d):
    q = _weights(spark, d, "benchmark", "item_id", "query_id").where("query_id % 100 = 0")
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id")
    ids = spark.read.parquet(f"{d}/benchmark.parquet").where("item_id % 100 = 0").select(F.col("item_id").alias("query_id"))
    pairs = R._in_blocks(ids, 64, lambda block: docs.join(block))
    return R.with_zero_scores(pairs, R.sparse_scores(q, _weights(spark, d, "documents", "doc_id", "doc_id"))).select("query_id", "doc_id", _r(F.col("score"), "score", 4))


def splade_weights(spark, d):
    return _weights(spark, d, "documents", "doc_id", "doc_id").select("doc_id", "term", _r(F.col("weight"), "weight"))


def lexical_weights(spark, d):
    t = _terms(spark, d, "documents", "doc_id").withColumn("x", F.col("x") - 1)
    return R.lexical_weights(t, "id").select(F.col("id").alias("doc_id"), "term", _r(F.col("weight"), "weight"))


def sparse_topk(spark, d):
    w = _weights(spark, d, "documents", "doc_id", "doc_id").withColumn("weight", F.round("weight", 5))
    v = w.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("term", "weight"))).alias("v"))
    top = v.select("doc_id", F.posexplode(V.sparse_top(F.col("v"), 8)).alias("pos", "e"))
    return top.select("doc_id", F.col("e.term").alias("term"), F.col("e.weight").alias("weight"))


def sparse_dot_in_row(spark, d):
    v = lambda t, k: _weights(spark, d, t, k, "id").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("term", "weight"))).alias("v"))
    q = v("benchmark", "item_id").where("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("v").alias("q"))
    docs = v("documents", "doc_id")
    return R._in_blocks(q, 1 << 16, lambda block: docs.join(block).select("query_id", F.col("id").alias("doc_id"), _r(V.sparse_dot(F.col("q"), F.col("v")), "score", 4)))


def rerank_order(spark, d):
    from pyspark.sql.window import Window

    s = _emb(spark, d).select("label", "vec_id", F.round(V.total(F.col("embedding")), 2).alias("score"))
    by = Window.partitionBy("label").orderBy(F.desc("score"), F.asc("vec_id"))
    return s.select("label", "vec_id", "score", F.row_number().over(by).cast("long").alias("rank"))


def softmax_confidence(spark, d):
    v = F.slice("embedding", 1, 32)
    e = _emb(spark, d)
    return e.select(
        "vec_id", V.argmax_first(v).cast("long").alias("best"), V.argmax_last(v).cast("long").alias("best_last"),
        _r(V.class_confidence(v, V.argmax_first(v)), "confidence"), _r(F.element_at(V.log_softmax(v), 1), "log_p0"),
        _r(V.yes_no_score(v[0], v[1]), "yes_no"), _r(V.relative_l2_error(F.slice("embedding", 33, 32), v), "error"),
    )


def ctc_probe(spark, d):
    """Dimension check: rows whose width is not the configured one."""
    v = _emb(spark, d).select(F.col("vec_id").alias("id"), F.when(F.col("vec_id") % 10 == 0, F.slice("embedding", 1, 60)).otherwise(F.col("embedding")).alias("vector"))
    return R.finalize_dense(v, True, 64).select("id", "ok", F.size("vector").cast("long").alias("width"))


QUERIES = {
    "dense_scores": dense_scores, "dense_topk": dense_topk, "colbert_rerank": colbert_rerank, "max_sim": max_sim_in_row, "cosine_scores": cosine_scores,
    "l2_normalize": l2_normalize, "pool_mean": _pool("mean"), "pool_max": _pool("max"), "pool_cls": _pool("cls"), "pool_last": _pool("last"),
    "sparse_dot": sparse_dot, "sparse_with_zeros": sparse_with_zeros, "sparse_dot_in_row": sparse_dot_in_row, "splade_weights": splade_weights, "lexical_weights": lexical_weights,
    "sparse_topk": sparse_topk, "rerank_order": rerank_order, "softmax_confidence": softmax_confidence, "dimension_check": ctc_probe,
}

_IP = "list_inner_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[])"
_TERMS = """
bt AS (SELECT item_id AS id, unnest(list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda x: x <> '')) AS term FROM benchmark),
dt AS (SELECT doc_id AS id, unnest(list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda x: x <> '')) AS term FROM documents),
bw AS (SELECT id, term, ln(1 + count(*)) AS w FROM bt GROUP BY id, term),
dw AS (SELECT id, term, ln(1 + count(*)) AS w, count(*) AS n FROM dt GROUP BY id, term)"""
_POOL = """WITH t AS (SELECT label, vec_id, embedding, vec_id % 3 <> 0 AS mask FROM embeddings),
u AS (SELECT label, vec_id, mask, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS dim FROM t)"""
_PICK = """SELECT label AS id, generate_subscripts(v, 1) - 1 AS dim, round(unnest(v)::DOUBLE, 5) AS x FROM (SELECT label, {} AS v FROM t GROUP BY label)"""

ORACLES = {
    "dense_scores": f"SELECT q.vec_id AS query_id, e.vec_id AS doc_id, round({_IP}, 5) AS score FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0",
    "dense_topk": f"""WITH s AS (SELECT q.vec_id AS query_id, e.vec_id AS doc_id, round({_IP}, 5) AS score FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 10""",
    "colbert_rerank": f"""WITH p AS (SELECT e.label, q.vec_id AS t, max({_IP}) AS s FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0 GROUP BY ALL),
s AS (SELECT label AS doc_id, round(sum(s), 5) AS score FROM p GROUP BY label)
SELECT * FROM (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 10""",
    "max_sim": f"""WITH s AS (SELECT *, vec_id // 16 AS g FROM embeddings),
p AS (SELECT q.g AS query_id, e.g AS doc_id, q.vec_id AS t, max({_IP}) AS s FROM s e, s q WHERE q.g % 100 = 0 GROUP BY ALL) SELECT query_id, doc_id, round(sum(s), 5) AS score FROM p GROUP BY ALL""",
    "cosine_scores": f"SELECT q.vec_id AS query_id, e.vec_id AS doc_id, round({_IP} / sqrt(list_inner_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])) / sqrt(list_inner_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])), 5) AS score FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0",
    "l2_normalize": """WITH t AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE * (vec_id % 7)) AS v FROM embeddings), n AS (SELECT *, sqrt(list_inner_product(v, v)) AS n FROM t)
SELECT vec_id, generate_subscripts(v, 1) - 1 AS dim, round(unnest(CASE WHEN n > 1e-12 THEN list_transform(v, lambda x: x / n) ELSE v END), 5) + 0.0 AS x FROM n""",
    "pool_mean": _POOL + "SELECT label AS id, dim, round(coalesce(avg(x) FILTER (WHERE mask), 0), 5) AS x FROM u GROUP BY label, dim",
    "pool_max": _POOL + "SELECT label AS id, dim, round(coalesce(max(x) FILTER (WHERE mask), 0), 5) AS x FROM u GROUP BY label, dim",
    "pool_cls": _POOL + _PICK.format("arg_min(embedding, vec_id)"),
    "pool_last": _POOL + _PICK.format("coalesce(arg_max(embedding, vec_id) FILTER (WHERE mask), arg_max(embedding, vec_id))"),
    "sparse_dot": f"WITH {_TERMS} SELECT b.id AS query_id, d.id AS doc_id, round(sum(b.w * d.w), 4) AS score FROM bw b JOIN dw d USING (term) WHERE b.id % 100 = 0 GROUP BY ALL",
    "sparse_with_zeros": f"""WITH {_TERMS}, s AS (SELECT b.id AS query_id, d.id AS doc_id, round(sum(b.w * d.w), 4) AS score FROM bw b JOIN dw d USING (term) WHERE b.id % 100 = 0 GROUP BY ALL)
SELECT item_id AS query_id, documents.doc_id, coalesce(score, 0) AS score FROM documents, benchmark LEFT JOIN s ON s.query_id = item_id AND s.doc_id = documents.doc_id WHERE item_id % 100 = 0""",
    "sparse_dot_in_row": f"""WITH {_TERMS}, s AS (SELECT b.id AS query_id, d.id AS doc_id, round(sum(b.w * d.w), 4) AS score FROM bw b JOIN dw d USING (term) WHERE b.id % 100 = 0 GROUP BY ALL),
q AS (SELECT DISTINCT id AS query_id FROM bw WHERE id % 100 = 0), dd AS (SELECT DISTINCT id AS doc_id FROM dw)
SELECT query_id, doc_id, coalesce(score, 0) AS score FROM (SELECT * FROM q, dd) LEFT JOIN s USING (query_id, doc_id)""",
    "splade_weights": f"WITH {_TERMS} SELECT id AS doc_id, term, round(w, 5) AS weight FROM dw",
    "lexical_weights": f"WITH {_TERMS} SELECT id AS doc_id, term, (n - 1)::DOUBLE AS weight FROM dw WHERE n > 1",
    "sparse_topk": f"WITH {_TERMS} SELECT doc_id, term, weight FROM (SELECT id AS doc_id, term, round(w, 5) AS weight, row_number() OVER (PARTITION BY id ORDER BY round(w, 5) DESC, term) AS r FROM dw) WHERE r <= 8",
    "rerank_order": "WITH s AS (SELECT label, vec_id, round(list_sum(embedding::DOUBLE[]), 2) + 0.0 AS score FROM embeddings) SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS rank FROM s",
    "softmax_confidence": """WITH t AS (SELECT vec_id, embedding[1:32] AS f, embedding[1:32]::DOUBLE[] AS v, embedding[33:64]::DOUBLE[] AS c FROM embeddings),
e AS (SELECT *, list_transform(v, lambda x: exp(x - list_max(v))) AS e FROM t)
SELECT vec_id, (list_position(f, list_max(f)) - 1)::BIGINT AS best, (32 - list_position(list_reverse(f), list_max(f)))::BIGINT AS best_last, round(CASE WHEN abs(list_sum(v) - 1) < 0.05 AND list_min(v) >= -0.01 AND list_max(v) <= 1.01 THEN list_max(v) ELSE list_max(e) / list_sum(e) END, 5) AS confidence,
round(v[1] - list_max(v) - ln(list_sum(e)), 5) AS log_p0, round(1 / (1 + exp(v[2] - v[1])), 5) AS yes_no,
round(sqrt(list_sum(list_transform(list_zip(c, v), lambda p: (p[1] - p[2]) ^ 2))) / greatest(sqrt(list_inner_product(v, v)), 1e-6), 5) AS error FROM e""",
    "dimension_check": "SELECT vec_id AS id, vec_id % 10 <> 0 AS ok, CASE WHEN vec_id % 10 = 0 THEN 60 ELSE 64 END::BIGINT AS width FROM embeddings",
}
