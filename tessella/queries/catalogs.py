"""Queries on model catalogs, made of the suppliers, and on the runtime's aliases."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vector as V
from ..operators import catalog as C
from ..plans.runtime import Runtime

#: (task, provider, options as JSON) of a supplier's spec, by its key's last digit.
_KINDS = [
    ("embed", "remote/openai", '{"embedding_dimensions":8.0}'), ("embed", "remote/openai", '{"embedding_dimensions":8}'), ("embed", "remote/openai", '{"style":"x"}'),
    ("rerank", "remote/openai", None), ("embed", "local/candle", None), ("rerank", "local/onnx", '{"max_seq_len":0,"pooling":"cls"}'), ("embed", "remote/llamacpp", '{"base_url":"http://u:p@h:1/v1?k=1"}'),
    ("nlp", "local/onnx", '{"onnx_path":"p","variant":"v"}'), ("embed", "third/party", '{"anything":true}'), ("embed", "remote/llamacpp", '{"base_url":"ftp://x","embedding_dimensions":4,"max_input_tokens":2}'),
]


def _specs(spark, d):
    """(nation, key, text): each supplier's spec as a JSON object."""
    s = spark.read.parquet(f"{d}/supplier.parquet").select(F.col("s_nationkey").alias("nation"), F.col("s_suppkey").alias("key"))
    kind = (F.col("key") % 10).cast("int")
    pick = lambda i: F.get(F.array(*[F.lit(k[i]) for k in _KINDS]), kind)
    alias = F.concat(F.when(kind == 4, "plain").otherwise(F.concat(pick(0), F.lit("/s"))), (F.col("key") - F.when(F.col("key") % 40 == 11, 10).otherwise(0)).cast("string"))
    text = F.concat(
        F.lit('{"alias":"'), alias, F.lit('","task":"'), pick(0), F.lit('","provider_id":"'), pick(1), F.lit('","model_id":"m'), (F.col("key") % 7).cast("string"), F.lit('"'),
        F.when(kind == 6, ',"timeout":0').otherwise(""), F.when(kind == 3, ',"warmup":"eager","required":true').otherwise(""), F.coalesce(F.concat(F.lit(',"options":'), pick(2)), F.lit("")), F.lit("}"),
    )
    return s.select("nation", "key", text.alias("text"))


def _catalog(spark, d):
    """One JSON array a nation, read back as specs."""
    arrays = _specs(spark, d).groupBy("nation").agg(F.concat(F.lit("["), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("key", "text"))), lambda x: x["text"]), ","), F.lit("]")).alias("text"))
    return C.catalog_from_text(arrays)


_SHOWN = ["alias", "task", "provider_id", "model_id", "warmup", "required", "timeout"]


def catalog_from_str(spark, d):
    return _catalog(spark, d).select(*_SHOWN, F.get_json_object("options", "$.embedding_dimensions").cast("double").alias("dimensions"))


def spec_from_json(spark, d):
    return C.spec_from_text(_specs(spark, d)).select(*_SHOWN, F.get_json_object("options", "$.embedding_dimensions").cast("double").alias("dimensions"))


def validate_catalog(spark, d):
    return C.validate_catalog(_catalog(spark, d))


def shared_models(spark, d):
    s = C.shared_models(_catalog(spark, d).where("provider_id = 'remote/openai' and options like '%dimensions%'"))
    return s.select("runtime_key.provider_id", "runtime_key.model_id", F.array_join("aliases", ",").alias("aliases"))


def option_table(spark, d):
    return C.option_keys(spark)


def snapshots(spark, d):
    """Aliases with the state of their latest load and what their verification found."""
    s = C.spec_from_text(_specs(spark, d)).dropDuplicates(["alias"])
    key = F.regexp_extract("alias", "([0-9]+)$", 1).cast("long")
    loads = s.where(key % 3 == 0).select("alias", F.when(key % 2 == 0, "loaded").otherwise("failed").alias("state"))
    checks = s.where(key % 5 == 0).select("alias", (key % 2 == 1).alias("ok"))
    return C.snapshots(s, loads, checks).select("alias", "provider_id", "base_url", "state", "verified")


def resolve_aliases(spark, d):
    """Requests for every supplier's alias, some of them misspelt."""
    s = C.spec_from_text(_specs(spark, d)).dropDuplicates(["alias"])
    r = _specs(spark, d).select("key", F.concat(F.when(F.col("key") % 6 == 0, "no/").otherwise(""), F.get_json_object("text", "$.alias")).alias("alias"))
    return C.resolve(r, s).select("key", "alias", "provider_id", "error")


RUNTIME = [{"alias": "hybrid/x", "task": "embed_hybrid", "provider_id": "local/deterministic", "model_id": "h"}, {"alias": "rerank/x", "task": "rerank", "provider_id": "local/deterministic", "model_id": "r"}]


def hybrid_embed(spark, d):
    """Three heads of all benchmark texts from one pass of the built-in (synthetic) provider."""
    r = Runtime.build(RUNTIME)
    h = spark.read.parquet(f"{d}/benchmark.parquet").select("item_id", r.hybrid("hybrid/x", F.col("text")).alias("h"))
    return h.select("item_id", F.size("h.dense").alias("dense"), F.size("h.sparse").alias("sparse"), F.size("h.multi_vector").alias("multi_vector"), F.round(V.norm(F.col("h.dense")), 4).alias("norm"))


QUERIES = {f.__name__: f for f in (catalog_from_str, spec_from_json, validate_catalog, shared_models, option_table, snapshots, resolve_aliases, hybrid_embed)}

_S = f"""WITH k AS (SELECT s_suppkey AS key, s_suppkey % 10 AS kind, {[k[0] for k in _KINDS]}[(s_suppkey % 10 + 1)::INT] AS task, {[k[1] for k in _KINDS]}[(s_suppkey % 10 + 1)::INT] AS provider_id FROM supplier),
s AS (SELECT *, CASE WHEN kind = 4 THEN 'plain' ELSE task || '/s' END || (key - CASE WHEN key % 40 = 11 THEN 10 ELSE 0 END) AS alias, 'm' || key % 7 AS model_id FROM k)"""
_ROWS = _S + """ SELECT alias, task, provider_id, model_id, CASE WHEN kind = 3 THEN 'eager' ELSE 'lazy' END AS warmup, kind = 3 AS required, CASE WHEN kind = 6 THEN 0::BIGINT END AS timeout,
CASE WHEN kind < 2 THEN 8::DOUBLE WHEN kind = 9 THEN 4::DOUBLE END AS dimensions FROM s"""
_D = _S + ", u AS (SELECT alias, any_value(kind) AS kind, any_value(provider_id) AS provider_id FROM s GROUP BY alias)"
_OPTIONS = ", ".join(f"('{p}', '{t}', '{k}', '{C.STYLES.get(t, 'string') if k == 'style' else C.OPTION_TYPES.get(k, 'string')}')" for p, (common, tasks) in C.PROVIDERS.items() for t, own in tasks.items() for k in (*common, *own))

ORACLES = {
    "catalog_from_str": _ROWS,
    "spec_from_json": _ROWS,
    "validate_catalog": _S + """, p AS (SELECT alias, unnest(CASE kind WHEN 2 THEN ['unknown option style'] WHEN 3 THEN ['unsupported task rerank'] WHEN 4 THEN ['alias is not task/name']
 WHEN 5 THEN ['option max_seq_len: not positive', 'option pooling belongs to embed'] WHEN 6 THEN ['timeout is zero', 'missing option embedding_dimensions', 'missing option max_input_tokens'] WHEN 7 THEN ['options of two generations']
 WHEN 9 THEN ['option base_url: not http_url', 'option max_input_tokens: not at_least_3'] ELSE [] END) AS problem FROM s)
SELECT alias, problem FROM p UNION ALL SELECT alias, 'duplicate alias' FROM s GROUP BY alias HAVING count(*) > 1""",
    "shared_models": _S + " SELECT provider_id, model_id, string_agg(DISTINCT alias, ',' ORDER BY alias) AS aliases FROM s WHERE kind < 2 GROUP BY provider_id, model_id",
    "option_table": f"SELECT * FROM (VALUES {_OPTIONS}) AS t(provider_id, task, key, type)",
    "snapshots": _D + """, n AS (SELECT *, regexp_extract(alias, '([0-9]+)$', 1)::BIGINT AS n FROM u)
SELECT alias, provider_id, CASE kind WHEN 6 THEN 'http://h:1/v1' WHEN 9 THEN 'ftp://x' END AS base_url, CASE WHEN n % 3 > 0 THEN 'registered' WHEN n % 2 = 0 THEN 'loaded' ELSE 'failed' END AS state, CASE WHEN n % 5 = 0 THEN n % 2 = 1 END AS verified FROM n""",
    "resolve_aliases": _D + """, r AS (SELECT key, CASE WHEN key % 6 = 0 THEN 'no/' ELSE '' END || alias AS alias FROM s)
SELECT key, r.alias, u.provider_id, CASE WHEN u.provider_id IS NULL THEN 'alias_not_found' WHEN u.provider_id = 'third/party' THEN 'provider_not_found' END AS error FROM r LEFT JOIN u USING (alias)""",
    "hybrid_embed": r"""WITH w AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM benchmark)
SELECT item_id, 32 AS dense, len(list_distinct(w)) AS sparse, len(w) AS multi_vector, CASE WHEN len(w) > 0 THEN 1::DOUBLE ELSE 0::DOUBLE END AS norm FROM w""",
}
