"""Queries on bytes, requests and pages: images, audio, multimodal shapes, sizes, page budgets."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import http_shapes as H
from ..functions import image as I
from ..functions import vector as V
from ..operators import pages as P
from ..operators import retrieval as R
from ..sources import audio as A
from .text import _GARBLE, _PG, _V, _WS, _pages


def _emb(spark, d):
    return spark.read.parquet(f"{d}/embeddings.parquet")


def wav_samples(spark, d):
    """Vectors as sound: clamped, cut to 16 bits, written as WAV and read back; two channels averaged first."""
    x = F.transform("embedding", lambda v: v.cast("double") * 8)
    mono = A.mono(x, F.when(F.col("vec_id") % 2 == 0, 1).otherwise(2))
    back = _emb(spark, d).select("vec_id", A.decode_wav(A.pcm_to_wav(mono)).alias("w"))
    return back.select("vec_id", F.posexplode("w.samples").alias("pos", "x")).select("vec_id", F.col("pos").cast("long").alias("pos"), F.round(F.col("x").cast("double") * 32767).cast("long").alias("sample"))


def _png(column):
    def run(v: pd.Series) -> pd.Series:
        return v.map(lambda x: I.write_png(np.minimum(np.abs(np.asarray(x, np.float64)) * 255, 255).astype(np.uint8).reshape(8, 8)))

    return F.pandas_udf(run, "binary")(column)


def image_input(spark, d):
    """Vectors as 8 x 8 grey images in PNG bytes, as a model's normalised tensor."""
    t = _emb(spark, d).select("vec_id", I.model_input(_png("embedding"), 8, 8, "imagenet").alias("t"))
    return t.select("vec_id", F.posexplode("t").alias("pos", "x")).select("vec_id", F.col("pos").cast("long").alias("pos"), F.round(F.col("x").cast("double"), 3).alias("x"))


def image_decode(spark, d):
    """Grey images read back as three channels; every seventh file is none."""
    f = _emb(spark, d).select("vec_id", I.decode(F.when(F.col("vec_id") % 7 == 3, F.lit("no image").cast("binary")).otherwise(_png("embedding"))).alias("i"))
    return f.select("vec_id", F.col("i.rows").cast("long").alias("rows"), F.col("i.columns").cast("long").alias("columns"), F.lower(F.hex("i.pixels")).alias("pixels"), "i.error")


def patch_mean(spark, d):
    run = F.pandas_udf(lambda m: m.map(lambda x: I.patch_mean([list(map(float, r)) for r in x]).tolist()), "array<double>")
    rows = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice("embedding", i * 8 + 1, 8))
    return _emb(spark, d).select("vec_id", F.posexplode(run(rows)).alias("dim", "x")).select("vec_id", F.col("dim").cast("long").alias("dim"), F.round("x", 5).alias("x"))


def line_batches(spark, d):
    """Parts as text lines of an image, put together by aspect ratio."""
    lines = spark.read.parquet(f"{d}/part.parquet").select((F.col("p_partkey") % 50).alias("image"), F.col("p_partkey").alias("pos"), (F.col("p_partkey") % 37 + 1).alias("width"), F.col("p_size").alias("height"))
    return R.ratio_batches(lines, 6).select("image", "pos", "batch")


def detector_sizes(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", (F.col("p_partkey") % 3000 + 20).alias("w"), (F.col("p_size") * 31).alias("h"))
    s = G.detector_size(F.col("w"), F.col("h"), 960)
    return p.select("p_partkey", s["w"].cast("long").alias("w"), s["h"].cast("long").alias("h"), F.round(s["scale_x"], 5).alias("scale_x"), F.round(s["scale_y"], 5).alias("scale_y"))


def confidences(spark, d):
    """Confidence of deterministic, measured and derived outputs of the parts."""
    p = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", (F.col("p_partkey") % 10 / 10.0).alias("a"), (F.col("p_size") / 50.0).alias("b"), (F.col("p_partkey") % 2 == 0).alias("clean"), F.when(F.col("p_partkey") % 4 > 0, F.col("p_size") / 15.0).alias("ratio"))
    derived = V.derived_confidence(F.col("clean"), F.col("a"), F.col("b"), F.col("ratio"))
    kind = F.element_at(F.array(F.lit("deterministic"), F.lit("measured"), F.lit("derived")), (F.col("p_partkey") % 3 + 1).cast("int"))
    return p.select("p_partkey", F.round(V.confidence_score(kind, F.when(kind == "measured", F.col("a")).otherwise(derived)), 6).alias("confidence"))


def _blocks(kinds):
    b = lambda kind, text, image, media, url: F.struct(F.lit(kind).alias("kind"), text.cast("string").alias("text"), image.cast("binary").alias("image"), F.lit(media).cast("string").alias("media_type"), url.cast("string").alias("url"))
    none = F.lit(None)
    made = {"text": b("text", F.col("text"), none, None, none), "link": b("image", none, none, None, F.col("url")), "bytes": b("image", none, F.col("text"), "image/png", none), "audio": b("audio", none, F.col("text"), "audio/wav", none)}
    return F.array(*[made[k] for k in kinds])


def _multimodal(spark, d):
    return spark.read.parquet(f"{d}/benchmark.parquet").select("item_id", "text", F.concat(F.lit("http://h/"), F.col("item_id").cast("string")).alias("url"))


def cohere_inputs(spark, d):
    b = F.when(F.col("item_id") % 3 == 2, _blocks(["text", "audio"])).otherwise(_blocks(["text", "link", "bytes"]))
    c = _multimodal(spark, d).select("item_id", H.cohere_input(b).alias("c"))
    parts = F.from_json("c.content", "struct<content:array<struct<type:string,text:string,image_url:struct<url:string>>>>")["content"]
    return c.select("item_id", "c.error", F.array_join(F.transform(parts, lambda p: F.concat(p["type"], F.lit("="), F.coalesce(p["text"], p["image_url"]["url"]))), " ").alias("parts"))


def gemini_inputs(spark, d):
    g = _multimodal(spark, d).select("item_id", H.gemini_parts(_blocks(["text", "link", "bytes", "audio"])).alias("g"))
    p = F.from_json("g", "array<struct<text:string,file_data:struct<file_uri:string>,inline_data:struct<mime_type:string,data:string>>>")
    return g.select("item_id", F.array_join(F.transform(p, lambda x: F.coalesce(x["text"], x["file_data"]["file_uri"], F.concat(x["inline_data"]["mime_type"], F.lit("="), x["inline_data"]["data"]))), " ").alias("parts"))


def _vector_json():
    return F.concat(F.lit("["), F.array_join(F.transform("embedding", lambda x: x.cast("double").cast("string")), ","), F.lit("]"))


def predictions(spark, d):
    """One prediction an answer in one of three shapes, a fourth without any vector; counts in the first."""
    v, kind = _vector_json(), F.col("vec_id") % 4
    item = (
        F.when(kind == 0, F.concat(F.lit('{"embeddings":{"values":'), v, F.lit(',"statistics":{"token_count":'), (F.col("vec_id") % 50).cast("string"), F.lit("}}}")))
        .when(kind == 1, F.concat(F.lit('{"embeddings":'), v, F.lit("}"))).when(kind == 2, F.concat(F.lit('{"values":'), v, F.lit("}"))).otherwise(F.lit('{"other":1}'))
    )
    p = _emb(spark, d).select("vec_id", H.parse_predictions(F.concat(F.lit('{"predictions":['), item, F.lit(","), item, F.lit("]}"))).alias("p"))
    return p.select("vec_id", "p.tokens", "p.error", F.size(F.coalesce("p.vectors", F.array().cast("array<array<double>>"))).cast("long").alias("n"), F.round(V.total(F.element_at("p.vectors", -1)), 4).alias("total"))


def lenient_embeddings(spark, d):
    """Answers with a good item, one without a vector, and one with an element that is no number."""
    v = _vector_json()
    body = F.concat(F.lit('{"data":[{"embedding":'), v, F.lit('},{"x":1},{"embedding":["a",'), F.col("vec_id").cast("string"), F.lit("]}]}"))
    e = _emb(spark, d).select("vec_id", H.parse_embeddings_leniently(body).alias("v"))
    return e.select("vec_id", F.posexplode("v").alias("pos", "x")).select("vec_id", F.col("pos").cast("long").alias("pos"), F.size("x").cast("long").alias("width"), F.round(V.total(F.col("x")), 4).alias("total"))


def answer_dimensions(spark, d):
    """Answers of four vectors, some of which are too short: which one is named."""
    e = _emb(spark, d).select(F.floor(F.col("vec_id") / 4).alias("call"), "vec_id", F.when(F.col("vec_id") % 11 == 0, F.slice("embedding", 1, 60)).otherwise(F.col("embedding")).alias("v"))
    g = e.groupBy("call").agg(F.transform(F.sort_array(F.collect_list(F.struct("vec_id", "v"))), lambda x: x["v"]).alias("v"))
    return g.select("call", H.dimension_error(F.col("v"), 64).alias("error"))


def tokenizer_bases(spark, d):
    u = spark.read.parquet(f"{d}/pages.parquet").select("page_id", F.concat("url", F.element_at(F.array(F.lit(""), F.lit("/v1"), F.lit("/v1/"), F.lit("/")), (F.col("page_id") % 4 + 1).cast("int"))).alias("url"))
    return u.select("page_id", H.tokenizer_base(F.col("url")).alias("base"))


def page_range(spark, d):
    return P.page_range(_pages(spark, d), 100, 600).select("doc", "page")


def _reader(how):
    return lambda pages: pages.withColumn("out_text", F.concat(F.lit(how), F.regexp_replace("native_text", "�", "")))


def _extracted(pages):
    return pages.select("doc", "page", "tier", F.md5(F.col("text").cast("binary")).alias("md5"), F.array_join(F.transform("climbs", lambda c: F.concat_ws(">", c["from"], c["to"], c["reason"])), " ").alias("climbs"))


def budget_pages(spark, d):
    """All pages for the costly tier, four a document; the others keep their text layer, as the policy allows no other tier."""
    return _extracted(P.extract_pages(_pages(spark, d), P.Policy("fixed", "native", "vlm", max_vlm_pages=4), _reader("ocr:"), _reader("vlm:")))


def structured_pages(spark, d):
    """Structure wanted of all pages, four a document; the others go to the second tier."""
    return _extracted(P.extract_pages(_pages(spark, d), P.Policy("auto", "native", "vlm", True, 4), _reader("ocr:"), _reader("vlm:")))


QUERIES = {f.__name__: f for f in (
    wav_samples, image_input, image_decode, patch_mean, line_batches, detector_sizes, confidences, cohere_inputs, gemini_inputs, predictions, lenient_embeddings, answer_dimensions,
    tokenizer_bases, page_range, budget_pages, structured_pages,
)}

_U = "SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings"
_PIXEL = "least(abs(x) * 255, 255)::DOUBLE"
_REP = f"""w AS (SELECT *, list_filter(regexp_split_to_array(shown, '{_WS}+'), lambda x: x <> '') AS w FROM o),
rep AS (SELECT *, CASE WHEN len(w) < 3 THEN 0 ELSE 1 - len(list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i:i + 2]))) / (len(w) - 2)::DOUBLE END AS rep FROM w)"""

ORACLES = {
    "extract_pages": _PG + f""", o AS (SELECT doc, page, text AS native, ocr_reason, CASE WHEN ocr_reason IS NULL THEN text ELSE replace(text, chr(65533), '') END AS shown FROM r), {_REP}
SELECT doc, page, CASE WHEN ocr_reason IS NULL THEN 'native' ELSE 'ocr' END AS tier, md5(shown) AS md5, 0::DOUBLE AS divergence,
round(CASE WHEN ocr_reason IS NULL THEN 1 ELSE CASE WHEN regexp_replace(shown, '{_WS}', '', 'g') <> '' THEN 1 ELSE 0.5 END * (1 - rep) * CASE WHEN length(native) = 0 OR length(shown) / length(native)::DOUBLE BETWEEN 0.5 AND 2 THEN 1 ELSE 0.7 END END, 6) AS confidence FROM rep""",
    "wav_samples": f"""WITH u AS ({_U}), m AS (SELECT vec_id, i AS pos, x * 8 AS x FROM u WHERE vec_id % 2 = 0 UNION ALL SELECT vec_id, i // 2, avg(x * 8) FROM u WHERE vec_id % 2 = 1 GROUP BY vec_id, i // 2)
SELECT vec_id, pos, trunc(greatest(least(x, 1), -1) * 32767)::BIGINT AS sample FROM m""",
    "image_input": f"""WITH u AS ({_U}), c AS (SELECT vec_id, i, floor({_PIXEL}) / 255 AS v, unnest([0, 1, 2]) AS c FROM u)
SELECT vec_id, c * 64 + i AS pos, round((v - [0.485, 0.456, 0.406][c + 1]::DOUBLE) / [0.229, 0.224, 0.225][c + 1]::DOUBLE, 3) AS x FROM c""",
    "image_decode": f"""WITH u AS ({_U}), p AS (SELECT vec_id, string_agg(repeat(printf('%02x', floor({_PIXEL})::INT), 3), '' ORDER BY i) AS pixels FROM u GROUP BY vec_id)
SELECT vec_id, CASE WHEN vec_id % 7 <> 3 THEN 8 END AS "rows", CASE WHEN vec_id % 7 <> 3 THEN 8 END AS "columns", CASE WHEN vec_id % 7 <> 3 THEN pixels END AS pixels, CASE WHEN vec_id % 7 = 3 THEN 'not a PNG' END AS error FROM p""",
    "patch_mean": f"WITH u AS ({_U}) SELECT vec_id, i % 8 AS dim, round(avg(x), 5) AS x FROM u GROUP BY vec_id, i % 8",
    "line_batches": "SELECT p_partkey % 50 AS image, p_partkey AS pos, (row_number() OVER (PARTITION BY p_partkey % 50 ORDER BY (p_partkey % 37 + 1) / greatest(p_size, 1)::DOUBLE, p_partkey) - 1) // 6 AS batch FROM part",
    "detector_sizes": """WITH p AS (SELECT p_partkey, p_partkey % 3000 + 20 AS w, p_size * 31 AS h FROM part), r AS (SELECT *, CASE WHEN greatest(w, h) > 960 THEN 960::DOUBLE / greatest(w, h) ELSE 1::DOUBLE END AS r FROM p),
s AS (SELECT p_partkey, w, h, greatest((round(w * r)::BIGINT + 16) // 32 * 32, 32)::BIGINT AS dw, greatest((round(h * r)::BIGINT + 16) // 32 * 32, 32)::BIGINT AS dh FROM r) SELECT p_partkey, dw AS w, dh AS h, round(dw / w::DOUBLE, 5) AS scale_x, round(dh / h::DOUBLE, 5) AS scale_y FROM s""",
    "confidences": """WITH p AS (SELECT p_partkey, p_partkey % 10 / 10.0::DOUBLE AS a, p_size / 50.0::DOUBLE AS b, CASE WHEN p_partkey % 4 > 0 THEN p_size / 15.0::DOUBLE END AS ratio FROM part)
SELECT p_partkey, round(CASE p_partkey % 3 WHEN 0 THEN 1 WHEN 1 THEN a ELSE CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE 0.5 END * (1 - a) * (1 - b) * CASE WHEN ratio IS NULL OR ratio BETWEEN 0.5 AND 2 THEN 1 ELSE 0.7 END END, 6) AS confidence FROM p""",
    "cohere_inputs": """SELECT item_id, CASE WHEN item_id % 3 = 2 THEN 'audio is not supported' END AS error, CASE WHEN item_id % 3 <> 2 THEN 'text=' || text || ' image_url=http://h/' || item_id || ' image_url=data:image/png;base64,' || base64(encode(text)) END AS parts FROM benchmark""",
    "gemini_inputs": "SELECT item_id, text || ' http://h/' || item_id || ' image/png=' || base64(encode(text)) || ' audio/wav=' || base64(encode(text)) AS parts FROM benchmark",
    "predictions": """SELECT vec_id, CASE WHEN vec_id % 4 = 0 THEN 2 * (vec_id % 50) END AS tokens, CASE WHEN vec_id % 4 = 3 THEN 'invalid embedding format' END AS error, CASE WHEN vec_id % 4 = 3 THEN 0 ELSE 2 END AS n, CASE WHEN vec_id % 4 <> 3 THEN round(list_sum(embedding::DOUBLE[]), 4) END AS total FROM embeddings""",
    "lenient_embeddings": "SELECT vec_id, 0 AS pos, 64 AS width, round(list_sum(embedding::DOUBLE[]), 4) AS total FROM embeddings UNION ALL SELECT vec_id, 1, 1, vec_id::DOUBLE FROM embeddings",
    "answer_dimensions": "SELECT vec_id // 4 AS call, 'embedding ' || min(vec_id % 4) FILTER (WHERE vec_id % 11 = 0) || ' has 60 dimensions, not 64' AS error FROM embeddings GROUP BY vec_id // 4",
    "tokenizer_bases": r"SELECT page_id, regexp_replace(regexp_replace(url || ['', '/v1', '/v1/', '/'][(page_id % 4 + 1)::INT], '/+$', ''), '/v1$', '') AS base FROM pages",
    "page_range": "SELECT source AS doc, doc_id AS page FROM documents WHERE doc_id BETWEEN 100 AND 600",
    "budget_pages": _PG + """, b AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY page) <= 4 AS granted FROM r)
SELECT doc, page, CASE WHEN granted THEN 'vlm' ELSE 'native' END AS tier, md5(CASE WHEN granted THEN 'vlm:' || replace(text, chr(65533), '') ELSE text END) AS md5, CASE WHEN granted THEN '' ELSE 'vlm>native>budget_exhausted' END AS climbs FROM b""",
    "structured_pages": _PG + """, b AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY page) <= 4 AS granted FROM r)
SELECT doc, page, CASE WHEN granted THEN 'vlm' ELSE 'ocr' END AS tier, md5(CASE WHEN granted THEN 'vlm:' ELSE 'ocr:' END || replace(text, chr(65533), '')) AS md5,
concat_ws(' ', 'native>ocr>' || coalesce(ocr_reason, 'structure_requested'), 'ocr>vlm>structure_requested', CASE WHEN NOT granted THEN 'vlm>ocr>budget_exhausted' END) AS climbs FROM b""",
}
