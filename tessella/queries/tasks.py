"""Queries that run each model task on the built-in provider, whose results are synthetic."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vector as V
from ..plans.runtime import Runtime
from ..sources import audio as A

_TASKS = ("raw", "embed_image", "embed_audio", "embed_multimodal", "document_extract", "transcribe", "ocr", "nlp", "generate", "embed_sparse", "embed_multi_vector")


def _runtime() -> Runtime:
    return Runtime.build([{"alias": f"{t}/x", "task": t, "provider_id": "local/deterministic", "model_id": t, "timeout": 600} for t in _TASKS])


def _bench(spark, d):
    return spark.read.parquet(f"{d}/benchmark.parquet").select("item_id", "text")


def _docs(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")


def raw_tensors(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", F.create_map(F.lit("x"), F.transform("embedding", lambda v: v.cast("double"))).alias("t"))
    r = e.select("vec_id", _runtime().raw("raw/x", F.col("t"))["x"].alias("x"))
    return r.select("vec_id", F.size("x").cast("long").alias("n"), F.round(V.total(F.col("x")), 4).alias("total"))


def media_vectors(spark, d):
    """Equal bytes give equal vectors: images, sounds and mixed inputs of the passages."""
    r, raw = _runtime(), F.col("text").cast("binary")
    block = F.array(F.struct(F.lit("image").alias("kind"), F.lit(None).cast("string").alias("text"), raw.alias("image"), F.lit("image/png").alias("media_type"), F.lit(None).cast("string").alias("url")))
    v = _bench(spark, d).select("item_id", r.embed_image("embed_image/x", raw).alias("a"), r.embed_audio("embed_audio/x", raw).alias("b"), r.embed_multimodal("embed_multimodal/x", block).alias("c"))
    same = lambda c: F.round(V.cosine(F.col("a"), F.col(c)), 4) == 1.0
    return v.select("item_id", F.size("a").cast("long").alias("width"), F.round(V.norm(F.col("a")), 4).alias("norm"), same("b").alias("audio"), same("c").alias("mixed"))


def document_blocks(spark, d):
    b = _docs(spark, d).select("doc_id", F.explode(_runtime().document_extract("document_extract/x", F.col("text").cast("binary"))).alias("b"))
    return b.select("doc_id", F.col("b.reading_order").cast("long").alias("reading_order"), "b.kind", "b.content")


def ocr_lines(spark, d):
    o = _docs(spark, d).select("doc_id", _runtime().ocr("ocr/x", F.col("text").cast("binary")).alias("o"))
    return o.select("doc_id", F.size("o.blocks").cast("long").alias("lines"), F.md5(F.col("o.text").cast("binary")).alias("md5"))


def transcripts(spark, d):
    """Vectors repeated to more than a second of sound, as WAV."""
    x = F.flatten(F.array_repeat(F.transform("embedding", lambda v: v.cast("double")), 300))
    t = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", F.explode(_runtime().transcribe("transcribe/x", A.pcm_to_wav(x))).alias("s"))
    return t.select("vec_id", "s.start_ms", "s.end_ms")


def generated(spark, d):
    return _bench(spark, d).select("item_id", F.md5(_runtime().generate("generate/x", F.col("text")).cast("binary")).alias("md5"))


def sparse_and_ragged(spark, d):
    r = _runtime()
    v = _bench(spark, d).select("item_id", r.embed_sparse("embed_sparse/x", F.col("text")).alias("s"), r.embed_multi_vector("embed_multi_vector/x", F.col("text")).alias("m"))
    return v.select("item_id", F.size("s").cast("long").alias("terms"), F.round(F.aggregate("s", F.lit(0.0), lambda a, x: a + x["weight"]), 3).alias("weight"), F.size("m").cast("long").alias("vectors"))


def analysed_texts(spark, d):
    """Tokens, sentences, acts and roots of all passages (the whole chain: sentences, words, windows, flat view)."""
    n = _bench(spark, d).select("item_id", _runtime().nlp("nlp/x", F.col("text")).alias("n"))
    return n.select("item_id", F.size("n.tokens").cast("long").alias("tokens"), F.size("n.sentences").cast("long").alias("sentences"), F.size("n.acts").cast("long").alias("acts"), F.size(F.filter("n.tokens", lambda t: t["head"].isNull())).cast("long").alias("roots"))


QUERIES = {f.__name__: f for f in (raw_tensors, media_vectors, document_blocks, ocr_lines, transcripts, generated, sparse_and_ragged, analysed_texts)}

_LINES = "list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')"
ORACLES = {
    "raw_tensors": "SELECT vec_id, 64 AS n, round(2 * list_sum(embedding::DOUBLE[]), 4) AS total FROM embeddings",
    "media_vectors": "SELECT item_id, 32 AS width, 1::DOUBLE AS norm, true AS audio, true AS mixed FROM benchmark",
    "document_blocks": f"SELECT doc_id, generate_subscripts({_LINES}, 1) - 1 AS reading_order, 'text' AS kind, unnest({_LINES}) AS content FROM documents",
    "ocr_lines": f"SELECT doc_id, len({_LINES}) AS lines, md5(array_to_string({_LINES}, chr(10))) AS md5 FROM documents",
    "transcripts": "SELECT vec_id, unnest([0, 1000])::BIGINT AS start_ms, unnest([1000, 1200])::BIGINT AS end_ms FROM embeddings",
    "generated": "SELECT item_id, md5('echo: ' || text) AS md5 FROM benchmark",
    "sparse_and_ragged": r"""WITH w AS (SELECT item_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS w FROM benchmark), t AS (SELECT item_id, w, count(*) AS n FROM w GROUP BY ALL)
SELECT item_id, count(*) AS terms, round(sum(ln(1 + n)), 3) AS weight, sum(n)::BIGINT AS vectors FROM t GROUP BY item_id""",
}
