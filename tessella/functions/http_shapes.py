"""Requests to and answers from model servers: the pure halves, as Column expressions over JSON.

Messages are array<struct<role,content:array<struct<kind,text,image,media_type,url>>>>; simple
chats may use array<struct<role,text>> through as_messages().
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .base import let

CONTENT = "struct<kind:string,text:string,image:binary,media_type:string,url:string>"


def as_messages(turns: Column) -> Column:
    """array<struct<role,text>> as messages of one text block each."""
    block = lambda t: F.struct(F.lit("text").alias("kind"), t["text"].alias("text"), F.lit(None).cast("binary").alias("image"), F.lit(None).cast("string").alias("media_type"), F.lit(None).cast("string").alias("url"))
    return F.transform(turns, lambda t: F.struct(t["role"].alias("role"), F.array(block(t)).alias("content")))


def message_text(content: Column) -> Column:
    """Text blocks joined by one blank."""
    return F.array_join(F.transform(F.filter(content, lambda b: b["kind"] == "text"), lambda b: b["text"]), " ")


def _text_part(b: Column) -> Column:
    return F.to_json(F.struct(F.lit("text").alias("type"), b["text"].alias("text")))


def data_url(data: Column, media_type: Column) -> Column:
    return F.concat(F.lit("data:"), media_type, F.lit(";base64,"), F.regexp_replace(F.base64(data), "[\r\n]", ""))


def _image_part(b: Column) -> Column:
    url = F.coalesce(b["url"], data_url(b["image"], b["media_type"]))
    return F.to_json(F.struct(F.lit("image_url").alias("type"), F.struct(url.alias("url")).alias("image_url")))


def _json_string(s: Column) -> Column:
    """s as a JSON string literal."""
    return F.regexp_extract(F.to_json(F.struct(s.alias("s"))), r'(?s)^\{"s":(.*)\}$', 1)


def _json_array(parts: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(parts, ","), F.lit("]"))


def openai_messages(messages: Column) -> Column:
    """JSON array: a string as content, or typed parts where a message has an image."""

    def one(m: Column) -> Column:
        parts = F.transform(m["content"], lambda b: F.when(b["kind"] == "text", _text_part(b)).otherwise(_image_part(b)))
        content = F.when(F.exists(m["content"], lambda b: b["kind"] == "image"), _json_array(parts)).otherwise(_json_string(message_text(m["content"])))
        return F.concat(F.lit('{"role":'), _json_string(m["role"]), F.lit(',"content":'), content, F.lit("}"))

    return _json_array(F.transform(messages, one))


def _object(*fields: tuple[str, Column]) -> Column:
    """JSON object of (name, JSON text); null values are left out."""
    given = F.filter(F.array(*[F.concat(F.lit(f'"{k}":'), v) for k, v in fields]), lambda x: x.isNotNull())
    return F.concat(F.lit("{"), F.array_join(given, ","), F.lit("}"))


def _number(x) -> Column:
    return (x if isinstance(x, Column) else F.lit(x)).cast("string")


def chat_payload(model: Column, messages: Column, max_tokens=None, temperature=None, top_p=None) -> Column:
    """OpenAI-style chat request that is not streamed."""
    return _object(
        ("model", _json_string(model)), ("messages", openai_messages(messages)), ("stream", F.lit("false")),
        ("max_tokens", _number(max_tokens)), ("temperature", _number(temperature)), ("top_p", _number(top_p)),
    )


def _system(messages: Column) -> Column:
    return F.filter(messages, lambda m: m["role"] == "system")


def google_payload(messages: Column, temperature=None, top_p=None, max_tokens=None) -> Column:
    """System messages joined in system_instruction; the assistant is "model"."""

    def one(m: Column) -> Column:
        role = F.when(m["role"] == "assistant", F.lit('"model"')).otherwise(F.lit('"user"'))
        return F.concat(F.lit('{"role":'), role, F.lit(',"parts":[{"text":'), _json_string(message_text(m["content"])), F.lit("}]}"))

    config = _object(("temperature", _number(temperature)), ("topP", _number(top_p)), ("maxOutputTokens", _number(max_tokens)))
    system = F.array_join(F.transform(_system(messages), lambda m: message_text(m["content"])), "\n")
    return _object(
        ("contents", _json_array(F.transform(F.filter(messages, lambda m: m["role"] != "system"), one))),
        ("system_instruction", F.when(F.size(_system(messages)) > 0, F.concat(F.lit('{"parts":[{"text":'), _json_string(system), F.lit("}]}")))),
        ("generationConfig", F.when(config != "{}", config)),
    )


def anthropic_payload(model: Column, messages: Column, max_tokens=None, temperature=None, top_p=None) -> Column:
    """max_tokens defaults to 1024; system text stands apart."""
    rest = F.transform(F.filter(messages, lambda m: m["role"] != "system"), lambda m: F.concat(F.lit('{"role":'), _json_string(m["role"]), F.lit(',"content":'), _json_string(message_text(m["content"])), F.lit("}")))
    system = F.array_join(F.transform(_system(messages), lambda m: message_text(m["content"])), "\n")
    return _object(
        ("model", _json_string(model)), ("max_tokens", F.coalesce(_number(max_tokens), F.lit("1024"))), ("messages", _json_array(rest)),
        ("system", F.when(F.size(_system(messages)) > 0, _json_string(system))), ("temperature", _number(temperature)), ("top_p", _number(top_p)),
    )


USAGE = "struct<prompt_tokens:bigint,completion_tokens:bigint,total_tokens:bigint>"


def parse_usage(body: Column) -> Column:
    """(prompt, completion, total); the total defaults to the sum; null without a usage object."""
    u = F.from_json(F.get_json_object(body, "$.usage"), USAGE)
    p, c = F.coalesce(u["prompt_tokens"], F.lit(0)), F.coalesce(u["completion_tokens"], F.lit(0))
    return F.when(F.get_json_object(body, "$.usage").isNotNull(), F.struct(p.alias("prompt"), c.alias("completion"), F.coalesce(u["total_tokens"], p + c).alias("total")))


def parse_chat(body: Column) -> Column:
    """(text, error): null content is empty text; no choice, or content that is no string, is an error."""
    choice = F.get_json_object(body, "$.choices[0]")
    raw = F.from_json(choice, "struct<message:struct<content:variant>>")["message"]["content"]
    kind = F.schema_of_variant(raw)
    null = raw.isNull() | (kind == "VOID")
    error = F.when(choice.isNull(), "missing choices").when(~null & (kind != "STRING"), "content is no string")
    return F.struct(F.when(error.isNull(), F.when(null, "").otherwise(F.try_variant_get(raw, "$", "string"))).alias("text"), error.alias("error"))


def parse_embeddings(body: Column, expected: Column) -> Column:
    """(vectors in input order, error). Items go by their index if all have one, else by place."""
    data = F.from_json(body, "struct<data:array<struct<index:int,embedding:array<double>>>>")["data"]

    def read(d: Column) -> Column:
        indexed = F.forall(d, lambda x: x["index"].isNotNull())
        bad = F.exists(d, lambda x: x["embedding"].isNull() | F.exists(x["embedding"], lambda v: v.isNull()))
        out = F.exists(d, lambda x: (x["index"] < 0) | (x["index"] >= expected))
        twice = F.size(F.array_distinct(F.transform(d, lambda x: x["index"]))) < F.size(d)
        error = (
            F.when(d.isNull(), "missing data").when(F.size(d) != expected, "wrong number of embeddings").when(bad, "malformed item")
            .when(indexed & out, "index out of range").when(indexed & twice, "duplicate index")
        )
        ordered = F.when(indexed, F.transform(F.array_sort(F.transform(d, lambda x: F.struct(x["index"], x["embedding"]))), lambda x: x["embedding"])).otherwise(F.transform(d, lambda x: x["embedding"]))
        return F.struct(F.when(error.isNull(), ordered).alias("vectors"), error.alias("error"))

    return let(data, read)


def parse_rerank(body: Column, expected: Column) -> Column:
    """(scored (index, score) by falling score, error); a bare array, or one under "results"."""
    item = "array<struct<index:int,relevance_score:double,score:double>>"
    rows = F.when(F.ltrim(body).startswith("["), F.from_json(body, item)).otherwise(F.from_json(F.get_json_object(body, "$.results"), item))

    def read(d: Column) -> Column:
        s = F.transform(d, lambda x: F.struct(x["index"].alias("index"), F.coalesce(x["relevance_score"], x["score"]).alias("score")))
        error = (
            F.when(d.isNull(), "no results").when(F.exists(s, lambda x: x["index"].isNull() | x["score"].isNull()), "malformed result")
            .when(F.size(s) != expected, "wrong number of results").when(F.exists(s, lambda x: (x["index"] < 0) | (x["index"] >= expected)), "index out of range")
            .when(F.size(F.array_distinct(F.transform(s, lambda x: x["index"]))) < F.size(s), "duplicate index")
        )
        by = F.array_sort(F.transform(s, lambda x, i: F.struct((-x["score"]).alias("o"), i.alias("i"), x["index"].alias("index"), x["score"].alias("score"))))
        return F.struct(F.when(error.isNull(), F.transform(by, lambda x: F.struct(x["index"], x["score"]))).alias("scored"), error.alias("error"))

    return let(rows, read)


def http_status_error(status: Column) -> Column:
    """The error class of a status; null for success."""
    return (
        F.when(status.between(200, 299), F.lit(None).cast("string")).when(status == 429, "rate_limited").when(status.isin(401, 403), "unauthorized")
        .when(status.between(500, 599), "unavailable").otherwise("api_error")
    )


def verify_status(status: Column, on_400: str = "config", error_code: Column | None = None, unsupported: tuple[str, ...] = ()) -> Column:
    """What a verification request's status says; on_400 is the class that a provider's 400 has.

    "verified" takes 400 and 422 for an answer, as the request was understood, unless the error
    code of its body is one of unsupported: then the alias's task is not served ("config").
    """
    first = F.when(status.between(200, 299), "verified")
    if on_400 == "verified":
        code = F.coalesce(error_code if error_code is not None else F.lit(None).cast("string"), F.lit(""))
        first = first.when(status.isin(400, 422), F.when(code.isin(*unsupported), "config").otherwise("verified"))
    else:
        first = first.when(status == 400, on_400)
    return (
        first.when(status.isin(401, 403), "unauthorized").when(status == 404, "not_found")
        .when(status == 429, "rate_limited").when(status.between(500, 599), "unavailable").otherwise("other")
    )


def error_message(body: Column) -> Column:
    return F.coalesce(F.get_json_object(body, "$.error.message"), F.substring(body, 1, 200))


def classify_error(body: Column) -> Column:
    """input_too_large, exceeds_context, not_supported or other, by message and type."""
    low, kind = F.lower(error_message(body)), F.coalesce(F.get_json_object(body, "$.error.type"), F.lit(""))
    return (
        F.when(low.contains("too large to process"), "input_too_large")
        .when((kind == "exceed_context_size") | low.contains("exceeds the available context size"), "exceeds_context")
        .when((kind == "not_supported_error") | low.contains("does not support"), "not_supported").otherwise("other")
    )


def tokenizer_base(url: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(url, "/+$", ""), "/v1$", "")


def cohere_input(blocks: Column) -> Column:
    """(content, error) of array<struct<kind,text,image,media_type,url>>: typed parts as JSON; audio is an error."""
    parts = F.transform(blocks, lambda b: F.when(b["kind"] == "text", _text_part(b)).otherwise(_image_part(b)))
    audio = F.exists(blocks, lambda b: b["kind"] == "audio")
    return F.struct(F.when(~audio, F.concat(F.lit('{"content":'), _json_array(parts), F.lit("}"))).alias("content"), F.when(audio, "audio is not supported").alias("error"))


def gemini_parts(blocks: Column) -> Column:
    """JSON parts of the same blocks: text, file_data for a URL, inline_data for bytes (of audio too)."""
    inline = lambda b: F.concat(F.lit('{"inline_data":{"mime_type":'), _json_string(b["media_type"]), F.lit(',"data":"'), F.regexp_replace(F.base64(b["image"]), "[\r\n]", ""), F.lit('"}}'))
    linked = lambda b: F.concat(F.lit('{"file_data":{"file_uri":'), _json_string(b["url"]), F.lit("}}"))
    text = lambda b: F.concat(F.lit('{"text":'), _json_string(b["text"]), F.lit("}"))
    return _json_array(F.transform(blocks, lambda b: F.when(b["kind"] == "text", text(b)).when(b["url"].isNotNull(), linked(b)).otherwise(inline(b))))


def parse_embeddings_leniently(body: Column) -> Column:
    """Vectors in answer order, without a stated number: items that have none, and elements that are no numbers, are skipped."""
    data = F.from_json(body, "struct<data:array<struct<embedding:array<variant>>>>")["data"]
    numbers = lambda e: F.filter(F.transform(e, lambda v: F.when(F.schema_of_variant(v).rlike("^(BIGINT|DECIMAL|DOUBLE)"), F.try_variant_get(v, "$", "double"))), lambda x: x.isNotNull())
    found = F.transform(F.filter(data, lambda x: x["embedding"].isNotNull()), lambda x: numbers(x["embedding"]))
    return F.coalesce(found, F.array().cast("array<array<double>>"))


def parse_predictions(body: Column) -> Column:
    """(vectors, tokens, error) of predictions in any of three shapes; tokens is null where none is reported."""
    whole = "struct<predictions:array<struct<embeddings:variant,values:array<double>>>>"
    items = F.from_json(body, whole)["predictions"]

    def read(d: Column) -> Column:
        vector = lambda x: F.coalesce(F.try_variant_get(x["embeddings"], "$.values", "array<double>"), F.try_variant_get(x["embeddings"], "$", "array<double>"), x["values"])
        vectors, counts = F.transform(d, vector), F.transform(d, lambda x: F.try_variant_get(x["embeddings"], "$.statistics.token_count", "bigint"))
        error = F.when(d.isNull(), "missing predictions").when(F.exists(vectors, lambda v: v.isNull()), "invalid embedding format")
        tokens = F.when(F.exists(counts, lambda c: c.isNotNull()), F.aggregate(counts, F.lit(0).cast("long"), lambda s, c: s + F.coalesce(c, F.lit(0).cast("long"))))
        return F.struct(F.when(error.isNull(), vectors).alias("vectors"), F.when(error.isNull(), tokens).alias("tokens"), error.alias("error"))

    return let(items, read)


def dimension_error(vectors: Column, dimensions: int) -> Column:
    """null if all vectors have the configured width, else which one has not."""
    bad = F.array_position(F.transform(vectors, lambda v: F.size(v) != dimensions), True)
    return F.when(bad > 0, F.concat(F.lit("embedding "), (bad - 1).cast("string"), F.lit(" has "), F.size(F.get(vectors, (bad - 1).cast("int"))).cast("string"), F.lit(f" dimensions, not {dimensions}")))
