"""Queries on calls, chats, catalogs, tags and models."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ..functions import decode as DEC
from ..functions import geometry as G
from ..functions import http_shapes as H
from ..functions import segment as S
from ..functions import vector as V
from ..operators import reliability as R
from ..operators import retrieval
from ..operators import tags as T
from ..plans.runtime import Runtime
from .catalogs import RUNTIME


def _events(spark, d):
    return spark.read.parquet(f"{d}/events.parquet")


def _calls(spark, d):
    """Each user's events as calls to one provider; every error and every other view is a failure; a day is a second."""
    ts = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 / 86400.0
    return _events(spark, d).select(F.col("user_id").alias("key"), F.col("event_id").alias("event"), ts.alias("ts"), (~((F.col("event_type") == "error") | ((F.col("event_type") == "view") & (F.col("event_id") % 2 == 0)))).alias("ok"))


def circuit_breaker(spark, d):
    return R.circuit_breaker(_calls(spark, d), 3, 1.0).select("key", "event", "ok", "admitted", "state", F.col("failures").cast("long").alias("failures"))


def failure_runs(spark, d):
    return R.failure_runs(_calls(spark, d)).select("key", "event", "ok", "in_a_row")


def backoff(spark, d):
    e = _events(spark, d).select("event_id", (F.col("event_id") % 6 + 1).alias("attempt"))
    return e.select("event_id", "attempt", V.backoff_ms(F.lit(100), F.col("attempt")).alias("ms"))


def retry_plan(spark, d):
    errors = F.array(*map(F.lit, ["timeout", "rate_limited", "unauthorized", "unavailable", "config"]))
    e = _events(spark, d).select(F.col("event_id").alias("call"), (F.col("event_id") % 4 + 1).alias("attempt"), F.element_at(errors, (F.col("event_id") % 5 + 1).cast("int")).alias("error"))
    return R.retry_plan(e).withColumn("wait_ms", F.coalesce("wait_ms", F.lit(0).cast("long")))


def http_status(spark, d):
    codes = F.array(*map(F.lit, [200, 204, 400, 401, 403, 404, 422, 429, 500, 503]))
    e = _events(spark, d).select("event_id", F.element_at(codes, (F.col("event_id") % 10 + 1).cast("int")).cast("long").alias("status"))
    return e.select("event_id", "status", H.http_status_error(F.col("status")).alias("error"), H.verify_status(F.col("status"), "unauthorized").alias("verified"), H.verify_status(F.col("status"), "verified", F.when(F.col("event_id") % 3 == 0, "not_served"), ("not_served",)).alias("answered"))


_ERRORS = [
    '{"error":{"code":500,"message":"input is too large to process","type":"server_error"}}', '{"error":{"message":"no","type":"exceed_context_size"}}',
    '{"error":{"message":"This model does not support embeddings","type":"x"}}', "plain text", '{"error":{"message":"the request exceeds the available context size","type":""}}',
]


def error_class(spark, d):
    e = _events(spark, d).select("event_id", F.element_at(F.array(*map(F.lit, _ERRORS)), (F.col("event_id") % 5 + 1).cast("int")).alias("body"))
    return e.select("event_id", H.classify_error(F.col("body")).alias("kind"), H.error_message(F.col("body")).alias("message"))


def provider_health(spark, d):
    own = F.when(F.col("user_id") % 7 == 0, "degraded").when(F.col("user_id") % 7 == 1, "lost").when(F.col("user_id") % 7 > 2, "healthy")
    ok = F.when(F.col("event_type").isin("error", "purchase"), F.col("event_type") == "purchase")
    return R.provider_health(_events(spark, d).select(F.col("user_id").alias("provider"), ok.alias("ok"), own.alias("own")))


def call_metrics(spark, d):
    e = _events(spark, d).select((F.col("user_id") % 5).alias("alias"), F.lit("embed").alias("task"), F.lit("local/onnx").alias("provider"), F.when(F.col("event_type") == "error", "error").otherwise("ok").alias("status"), F.col("value").alias("ms"))
    return R.call_metrics(e).select("alias", "status", "calls", F.round("total_ms", 2).alias("total_ms"), F.round("mean_ms", 4).alias("mean_ms"), "p50", "p95")


def load_states(spark, d):
    e = _events(spark, d).select(F.col("user_id").alias("alias"), F.col("event_type").alias("state"), "ts", F.col("event_id").alias("event"))
    return R.load_states(e)


def usage_totals(spark, d):
    e = _events(spark, d).select((F.col("user_id") % 11).alias("alias"), (F.col("event_id") % 97).alias("prompt"), (F.col("event_id") % 13).alias("completion"), F.when(F.col("event_id") % 3 == 0, F.col("event_id") % 200).alias("total"))
    return R.usage_totals(e)


def _chats(spark, d):
    return spark.read.parquet(f"{d}/conversations.parquet")


def speaker_turns(spark, d):
    c = _chats(spark, d).select(F.col("conv_id").alias("seq"), F.col("turn").alias("pos"), F.when(F.col("turn") % 3 == 2, "user").otherwise(F.col("role")).alias("speaker"))
    return T.speaker_turns(c).select("seq", "pos", "speaker")


def participants(spark, d):
    c = _chats(spark, d).select(F.col("conv_id").alias("seq"), F.col("turn").alias("pos"), F.col("role").alias("speaker"))
    return T.participants(c).select("seq", F.array_join("speakers", ",").alias("speakers"))


def _messages(spark, d):
    g = _chats(spark, d).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    return g.select("conv_id", H.as_messages(F.transform("turns", lambda t: F.struct(t["role"], t["text"]))).alias("m"))


def chat_payload(spark, d):
    """What was put in, read back from the request: the texts and roles of each message."""
    p = _messages(spark, d).select("conv_id", H.chat_payload(F.lit("m"), F.col("m"), 64, 0.5).alias("p"))
    back = F.from_json("p", "struct<model:string,messages:array<struct<role:string,content:string>>,stream:boolean,max_tokens:int,temperature:double>")
    p = p.withColumn("b", back)
    return p.select("conv_id", F.posexplode("b.messages").alias("pos", "x"), "b.max_tokens", "b.stream").select("conv_id", F.col("pos").cast("long").alias("pos"), "x.role", F.col("x.content").alias("content"), F.col("max_tokens").cast("long").alias("max_tokens"), "stream")


def google_payload(spark, d):
    p = _messages(spark, d).select("conv_id", H.google_payload(F.col("m"), 0.5).alias("p"))
    b = F.from_json("p", "struct<contents:array<struct<role:string,parts:array<struct<text:string>>>>,system_instruction:struct<parts:array<struct<text:string>>>>")
    p = p.withColumn("b", b)
    return p.select("conv_id", F.size("b.contents").cast("long").alias("n"), F.coalesce(F.col("b.system_instruction.parts")[0]["text"], F.lit("")).alias("system"), F.array_join(F.transform("b.contents", lambda c: c["role"]), ",").alias("roles"))


def anthropic_payload(spark, d):
    p = _messages(spark, d).select("conv_id", H.anthropic_payload(F.lit("m"), F.col("m")).alias("p"))
    b = F.from_json("p", "struct<max_tokens:int,system:string,messages:array<struct<role:string,content:string>>>")
    p = p.withColumn("b", b)
    return p.select("conv_id", F.col("b.max_tokens").cast("long").alias("max_tokens"), F.coalesce("b.system", F.lit("")).alias("system"), F.array_join(F.transform("b.messages", lambda c: c["content"]), "\n").alias("text"))


def embeddings_parse(spark, d):
    """Answers made of embeddings by fours, in reversed order with their index; every ninth lies about one."""
    e = spark.read.parquet(f"{d}/embeddings.parquet").select(F.floor(F.col("vec_id") / 4).alias("call"), (F.col("vec_id") % 4).cast("int").alias("i"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    item = F.to_json(F.struct(F.when(F.col("call") % 9 == 8, F.lit(1)).otherwise(F.col("i")).alias("index"), F.col("v").alias("embedding")))
    a = e.groupBy("call").agg(F.reverse(F.array_sort(F.collect_list(F.struct("i", item.alias("item"))))).alias("items"), F.count(F.lit(1)).cast("int").alias("n"))
    body = F.concat(F.lit('{"data":['), F.array_join(F.transform("items", lambda s: s["item"]), ","), F.lit("]}"))
    p = a.select("call", H.parse_embeddings(body, F.col("n")).alias("p"))
    return p.select("call", "p.error", F.posexplode_outer("p.vectors").alias("pos", "v")).select("call", "error", F.coalesce("pos", F.lit(-1)).cast("long").alias("pos"), F.coalesce(F.round(V.total(F.col("v")), 4), F.lit(0.0)).alias("total"))


def rerank_parse(spark, d):
    e = _events(spark, d).select(F.floor(F.col("event_id") / 5).alias("call"), (F.col("event_id") % 5).cast("int").alias("index"), "value")
    item = F.when(F.col("call") % 2 == 0, F.to_json(F.struct("index", F.col("value").alias("relevance_score")))).otherwise(F.to_json(F.struct("index", F.col("value").alias("score"))))
    a = e.groupBy("call").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("index", item.alias("item")))), lambda s: s["item"]), ",").alias("items"), F.count(F.lit(1)).cast("int").alias("n"))
    body = F.when(F.col("call") % 2 == 0, F.concat(F.lit('{"results":['), "items", F.lit("]}"))).otherwise(F.concat(F.lit("["), "items", F.lit("]")))
    p = a.select("call", H.parse_rerank(body, F.col("n")).alias("p"))
    return p.select("call", F.posexplode("p.scored").alias("rank", "s")).select("call", F.col("rank").cast("long").alias("rank"), F.col("s.index").cast("long").alias("index"), F.col("s.score").alias("score"))


def chat_parse(spark, d):
    kinds = F.when(F.col("conv_id") % 4 == 0, F.to_json(F.struct(F.col("text").alias("s")))).when(F.col("conv_id") % 4 == 1, F.lit('{"s":null}')).when(F.col("conv_id") % 4 == 2, F.lit('{"s":[1]}'))
    content = F.regexp_extract(kinds, r'(?s)^\{"s":(.*)\}$', 1)
    body = F.when(F.col("conv_id") % 4 == 3, F.lit('{"choices":[]}')).otherwise(F.concat(F.lit('{"choices":[{"message":{"content":'), content, F.lit('}}],"usage":{"prompt_tokens":3,"completion_tokens":4}}')))
    c = _chats(spark, d).select("conv_id", "turn", body.alias("b"))
    return c.select("conv_id", "turn", H.parse_chat(F.col("b")).alias("p"), H.parse_usage(F.col("b")).alias("u")).select("conv_id", "turn", F.coalesce("p.text", F.lit("")).alias("text"), "p.error", F.coalesce("u.total", F.lit(-1)).cast("long").alias("total"))


def _tagged(spark, d):
    """Every word of the benchmark with a tag by its length; other prefixes than B and I open."""
    t = spark.read.parquet(f"{d}/benchmark.parquet").select(F.col("item_id").alias("seq"), F.posexplode(F.split("text", " ")).alias("pos", "w"))
    names = F.array(*map(F.lit, ["O", "B-PER", "I-PER", "I-PER", "B-ORG", "I-ORG", "O", "I-ORG"]))
    return t.select("seq", F.col("pos").cast("long").alias("pos"), F.element_at(names, (F.length("w") % 8 + 1).cast("int")).alias("tag"), F.length("w").alias("len"))


def bio_spans(spark, d):
    return T.bio_spans(_tagged(spark, d)).select("seq", "label", "start", "end")


def ner_merge(spark, d):
    return T.merged_spans(_tagged(spark, d)).select("seq", "label", "start", "end")


def ctc_collapse(spark, d):
    t = _tagged(spark, d).select("seq", "pos", (F.col("len") % 4).alias("cls"), (F.col("len") / 20.0).alias("p"))
    return T.ctc_collapse(t).select("seq", F.array_join("classes", ",").alias("classes"), F.round("confidence", 5).alias("confidence"))


def word_index(spark, d):
    return T.word_index(_tagged(spark, d).withColumn("boundary", ~F.col("tag").startswith("I-") | (F.col("pos") == 0))).select("seq", "pos", "word")


def sentence_of(spark, d):
    t = _tagged(spark, d)
    starts = t.where("len % 5 = 0 or pos = 0").select("seq", F.col("pos").alias("start"), (F.col("pos") * 10).alias("sentence"))
    return T.sentence_of(t, starts)


def span_candidates(spark, d):
    t = _tagged(spark, d).select("seq", "pos", F.floor(F.col("pos") / 15).alias("sentence"), (F.col("len") > 2).alias("ok"))
    return T.span_candidates(t, 4)


def entity_pairs(spark, d):
    return T.ordered_pairs(_tagged(spark, d).where("tag like 'B-%'").select("seq", F.col("pos").alias("entity")))


def type_votes(spark, d):
    return T.type_votes(_tagged(spark, d).select(F.col("seq").alias("entity"), F.col("tag").alias("type"), "pos"))


def fact_margins(spark, d):
    """Margins of ordered pairs of label groups: a first embedding's numbers stand in for logits."""
    e = spark.read.parquet(f"{d}/embeddings.parquet").select((F.col("vec_id") % 5).alias("window_id"), F.col("label").alias("head"), F.floor(F.col("vec_id") / 50).alias("tail"), F.posexplode("embedding").alias("relation", "logit"), "vec_id")
    m = e.where("head <> tail").groupBy("window_id", "head", "tail", "relation").agg(F.round(F.max(F.col("logit").cast("double")), 6).alias("logit"))
    m = m.withColumn("margin", F.round(V.fact_margin(F.col("logit"), F.lit(0.1), F.lit(0.02), F.lit(0.0)), 6))
    return retrieval.top_per_pair(m, 4).select("window_id", "head", "tail", F.col("relation").cast("long").alias("relation"), "margin", F.col("rank").cast("long").alias("rank"))


def geometry(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", (F.col("p_partkey") % 40).cast("double").alias("x"), (F.col("p_size") * 1.0).alias("h"))
    x, h = F.col("x"), F.col("h")
    u = G.unclip(x, h, x + 20, h + 8, 1.5, F.lit(64.0), F.lit(64.0))
    s = G.scale_to(x + 0.3, h + 0.3, x + 20.2, h + 8.2, F.lit(0.5), F.lit(2.0), F.lit(100.0), F.lit(40.0))
    r = lambda c, n: F.round(c, 5).alias(n)
    return p.select("p_partkey", *(r(b[k], n + k) for b, n in ((u, "u"), (s, "s")) for k in ("x0", "y0", "x1", "y1")), G.aspect_width(F.col("p_partkey"), h, 48, 320).cast("long").alias("aw"), G.round_to_32(F.col("p_partkey")).cast("long").alias("r32"))


def tokenize(spark, d):
    t = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", S.tokenize(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").alias("n"), F.md5(F.array_join(F.transform("t", lambda x: x["text"]), "\n").cast("binary")).alias("md5"))


def split_sentences(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.inline(S.split_sentences(F.col("text"))))


def prose_windows(spark, d):
    w = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.explode(S.prose_windows(F.col("text"))).alias("w"))
    return w.select("doc_id", "w.window", F.size("w.tokens").alias("tokens"), F.size("w.sentences").alias("sentences"))


def chat_windows(spark, d):
    g = _chats(spark, d).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    w = g.select("conv_id", F.explode(S.chat_windows(F.transform("t", lambda t: F.struct(t["role"].alias("speaker"), t["text"].alias("text"))))).alias("w"))
    return w.select("conv_id", "w.window", F.size("w.tokens").alias("tokens"), F.size("w.sentences").alias("sentences"))


def _matrix(rows: int, cols: int):
    return F.transform(F.sequence(F.lit(0), F.lit(rows - 1)), lambda i: F.slice("embedding", i * cols + 1, cols))


def _decoded(spark, d, rows, cols, schema, fn):
    run = F.pandas_udf(lambda m: m.map(lambda x: fn([list(map(float, r)) for r in x])), schema)
    return spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", run(_matrix(rows, cols).cast("array<array<double>>")).alias("out"))


def dependency_trees(spark, d):
    return _decoded(spark, d, 7, 8, "array<int>", lambda m: DEC.sentence_trees(m, [0] * 7, [True] * 7))


def text_boxes(spark, d):
    return _decoded(spark, d, 8, 8, "array<array<double>>", lambda m: [list(map(float, b)) for b in DEC.reading_order(DEC.text_boxes(m, 0.0, 0.01, 1.5, 1), 1.0)])


def retrieve_and_rerank(spark, d):
    """Benchmark passages of ids divisible by 100 as queries: dense scores over all documents, the best reranked."""
    r = Runtime.build([*RUNTIME, {"alias": "embed/x", "task": "embed", "provider_id": "local/deterministic", "model_id": "e"}])
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")
    q = spark.read.parquet(f"{d}/benchmark.parquet").where("item_id % 100 = 0").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    s = retrieval.dense_scores(q.select("query_id", r.embed("embed/x", F.col("query")).alias("vector")), docs.select("doc_id", r.embed("embed/x", F.col("text")).alias("vector")))
    best = retrieval.top_k(s, 50).drop("rank", "score").join(docs, "doc_id").join(q, "query_id")
    scored = best.select("query_id", "doc_id", F.round(r.rerank("rerank/x", F.col("query"), F.col("text")), 6).alias("score"))
    return retrieval.top_k(scored, 10)


QUERIES = {f.__name__: f for f in (
    circuit_breaker, failure_runs, backoff, retry_plan, http_status, error_class, provider_health, call_metrics, load_states, usage_totals, speaker_turns, participants, chat_payload,
    google_payload, anthropic_payload, embeddings_parse, rerank_parse, chat_parse, bio_spans, ner_merge, ctc_collapse, word_index, sentence_of, span_candidates, entity_pairs, type_votes,
    fact_margins, geometry, tokenize, split_sentences, prose_windows, chat_windows, dependency_trees, text_boxes, retrieve_and_rerank,
)}

_OK = "NOT (event_type = 'error' OR (event_type = 'view' AND event_id % 2 = 0))"
_TAG = """WITH w AS (SELECT item_id AS seq, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) - 1 AS pos FROM benchmark),
t AS (SELECT seq, pos, length(w) AS len, ['O', 'B-PER', 'I-PER', 'I-PER', 'B-ORG', 'I-ORG', 'O', 'I-ORG'][(length(w) % 8 + 1)::INT] AS tag FROM w)"""
_E = "['" + "', '".join(e.replace("'", "''") for e in _ERRORS) + "']"
_SYS = "coalesce(string_agg(text, chr(10) ORDER BY turn) FILTER (WHERE role = 'system'), '') AS system"

ORACLES = {
    "circuit_breaker": f"""WITH RECURSIVE c AS (SELECT user_id AS key, event_id AS event, epoch_us(ts) / 1e6::DOUBLE / 86400.0::DOUBLE AS ts, {_OK} AS ok, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
r AS (SELECT key, 0::BIGINT AS i, 0::BIGINT AS event, true AS ok, true AS admitted, 'closed' AS state, 0::BIGINT AS failures, 0::DOUBLE AS last FROM (SELECT DISTINCT key FROM c)
UNION ALL SELECT c.key, c.i, c.event, c.ok, a.ad,
 CASE WHEN NOT a.ad THEN r.state WHEN c.ok THEN 'closed' WHEN r.state = 'open' OR r.failures + 1 >= 3 THEN 'open' ELSE 'closed' END,
 CASE WHEN NOT a.ad THEN r.failures WHEN c.ok THEN 0 ELSE r.failures + 1 END, CASE WHEN a.ad AND NOT c.ok THEN c.ts ELSE r.last END
 FROM r JOIN c ON c.key = r.key AND c.i = r.i + 1, LATERAL (SELECT r.state <> 'open' OR c.ts - r.last >= 1 AS ad) a)
SELECT key, event, ok, admitted, state, failures FROM r WHERE i > 0""",
    "failure_runs": f"""WITH c AS (SELECT user_id AS key, event_id AS event, ts, {_OK} AS ok FROM events), r AS (SELECT *, sum(ok::INT) OVER (PARTITION BY key ORDER BY ts, event ROWS UNBOUNDED PRECEDING) AS run FROM c)
SELECT key, event, ok, sum((NOT ok)::INT) OVER (PARTITION BY key, run ORDER BY ts, event ROWS UNBOUNDED PRECEDING)::BIGINT AS in_a_row FROM r""",
    "backoff": "SELECT event_id, event_id % 6 + 1 AS attempt, (100 * 2 ** (event_id % 6))::BIGINT AS ms FROM events",
    "retry_plan": """WITH e AS (SELECT event_id AS call, event_id % 4 + 1 AS attempt, ['timeout', 'rate_limited', 'unauthorized', 'unavailable', 'config'][(event_id % 5 + 1)::INT] AS error FROM events),
r AS (SELECT *, error IN ('timeout', 'rate_limited', 'unavailable') AND attempt < 3 AS retry FROM e) SELECT *, CASE WHEN retry THEN (100 * 2 ** (attempt - 1))::BIGINT ELSE 0 END AS wait_ms FROM r""",
    "http_status": """WITH e AS (SELECT event_id, [200, 204, 400, 401, 403, 404, 422, 429, 500, 503][(event_id % 10 + 1)::INT]::BIGINT AS status FROM events)
SELECT *, CASE WHEN status < 300 THEN NULL WHEN status = 429 THEN 'rate_limited' WHEN status IN (401, 403) THEN 'unauthorized' WHEN status >= 500 THEN 'unavailable' ELSE 'api_error' END AS error,
CASE WHEN status < 300 THEN 'verified' WHEN status IN (400, 401, 403) THEN 'unauthorized' WHEN status = 404 THEN 'not_found' WHEN status = 429 THEN 'rate_limited' WHEN status >= 500 THEN 'unavailable' ELSE 'other' END AS verified,
CASE WHEN status < 300 THEN 'verified' WHEN status IN (400, 422) THEN CASE WHEN event_id % 3 = 0 THEN 'config' ELSE 'verified' END WHEN status IN (401, 403) THEN 'unauthorized' WHEN status = 404 THEN 'not_found' WHEN status = 429 THEN 'rate_limited' WHEN status >= 500 THEN 'unavailable' ELSE 'other' END AS answered FROM e""",
    "error_class": f"""WITH e AS (SELECT event_id, {_E}[(event_id % 5 + 1)::INT] AS body FROM events)
SELECT event_id, ['input_too_large', 'exceeds_context', 'not_supported', 'other', 'exceeds_context'][(event_id % 5 + 1)::INT] AS kind, CASE WHEN json_valid(body) THEN json_extract_string(body, '$.error.message') ELSE body END AS message FROM e""",
    "provider_health": """WITH g AS (SELECT user_id AS provider, count(*) FILTER (WHERE event_type = 'purchase') AS verified, count(*) FILTER (WHERE event_type = 'error') AS failed FROM events GROUP BY user_id),
r AS (SELECT *, CASE WHEN failed = 0 THEN 0 WHEN verified = 0 THEN 2 ELSE 1 END AS seen, CASE provider % 7 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 0 END AS own FROM g)
SELECT provider, verified, failed, CASE WHEN own >= seen THEN ['healthy', 'degraded', 'lost'][(own + 1)::INT] WHEN seen = 2 THEN 'unhealthy' ELSE 'degraded' END AS health FROM r""",
    "call_metrics": "SELECT user_id % 5 AS alias, CASE WHEN event_type = 'error' THEN 'error' ELSE 'ok' END AS status, count(*) AS calls, round(sum(value), 2) AS total_ms, round(avg(value), 4) AS mean_ms, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY ALL",
    "load_states": "SELECT user_id AS alias, arg_max(event_type, row(ts, event_id)) AS state FROM events GROUP BY user_id",
    "usage_totals": "SELECT user_id % 11 AS alias, sum(event_id % 97)::BIGINT AS prompt, sum(event_id % 13)::BIGINT AS completion, sum(CASE WHEN event_id % 3 = 0 THEN event_id % 200 ELSE event_id % 97 + event_id % 13 END)::BIGINT AS total FROM events GROUP BY ALL",
    "speaker_turns": """WITH c AS (SELECT conv_id AS seq, turn AS pos, CASE WHEN turn % 3 = 2 THEN 'user' ELSE role END AS speaker FROM conversations), l AS (SELECT *, lag(speaker) OVER (PARTITION BY seq ORDER BY pos) AS was, row_number() OVER (PARTITION BY seq ORDER BY pos) AS i FROM c)
SELECT seq, pos, speaker FROM l WHERE i = 1 OR was IS DISTINCT FROM speaker""",
    "participants": "WITH f AS (SELECT conv_id AS seq, role, min(turn) AS t FROM conversations GROUP BY ALL) SELECT seq, string_agg(role, ',' ORDER BY t) AS speakers FROM f GROUP BY seq",
    "chat_payload": "SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos, role, text AS content, 64::BIGINT AS max_tokens, false AS stream FROM conversations",
    "google_payload": f"SELECT conv_id, count(*) FILTER (WHERE role <> 'system') AS n, {_SYS}, coalesce(string_agg(CASE role WHEN 'assistant' THEN 'model' ELSE 'user' END, ',' ORDER BY turn) FILTER (WHERE role <> 'system'), '') AS roles FROM conversations GROUP BY conv_id",
    "anthropic_payload": f"SELECT conv_id, 1024::BIGINT AS max_tokens, {_SYS}, coalesce(string_agg(text, chr(10) ORDER BY turn) FILTER (WHERE role <> 'system'), '') AS text FROM conversations GROUP BY conv_id",
    "embeddings_parse": """SELECT vec_id // 4 AS call, NULL::VARCHAR AS error, vec_id % 4 AS pos, round(list_sum(embedding::DOUBLE[]), 4) AS total FROM embeddings WHERE (vec_id // 4) % 9 <> 8
UNION ALL SELECT DISTINCT vec_id // 4, 'duplicate index', -1::BIGINT, 0::DOUBLE FROM embeddings WHERE (vec_id // 4) % 9 = 8""",
    "rerank_parse": 'SELECT event_id // 5 AS call, row_number() OVER (PARTITION BY event_id // 5 ORDER BY value DESC, event_id) - 1 AS rank, event_id % 5 AS "index", value AS score FROM events',
    "chat_parse": "SELECT conv_id, turn, CASE WHEN conv_id % 4 = 0 THEN text ELSE '' END AS text, CASE conv_id % 4 WHEN 2 THEN 'content is no string' WHEN 3 THEN 'missing choices' END AS error, CASE WHEN conv_id % 4 < 3 THEN 7 ELSE -1 END::BIGINT AS total FROM conversations",
    "bio_spans": _TAG + """, o AS (SELECT *, tag LIKE 'B-%' OR (tag LIKE 'I-%' AND coalesce(lag(tag) OVER (PARTITION BY seq ORDER BY pos), 'O') = 'O') AS opens FROM t),
r AS (SELECT *, sum(opens::INT) OVER (PARTITION BY seq ORDER BY pos ROWS UNBOUNDED PRECEDING) AS run FROM o) SELECT seq, arg_min(tag, pos)[3:] AS label, min(pos) AS start, max(pos) + 1 AS "end" FROM r WHERE tag <> 'O' GROUP BY seq, run""",
    "ner_merge": _TAG + """, l AS (SELECT *, lag(tag) OVER (PARTITION BY seq ORDER BY pos) AS was FROM t), o AS (SELECT *, tag <> 'O' AND NOT (tag LIKE 'I-%' AND coalesce(was, 'O') <> 'O' AND coalesce(was, 'O')[3:] = tag[3:]) AS opens FROM l),
r AS (SELECT *, sum(opens::INT) OVER (PARTITION BY seq ORDER BY pos ROWS UNBOUNDED PRECEDING) AS run FROM o) SELECT seq, tag[3:] AS label, min(pos) AS start, max(pos) + 1 AS "end" FROM r WHERE tag <> 'O' GROUP BY seq, run, tag[3:]""",
    "ctc_collapse": _TAG + """, c AS (SELECT seq, pos, len % 4 AS cls, len / 20.0 AS p, lag(len % 4) OVER (PARTITION BY seq ORDER BY pos) AS was FROM t)
SELECT seq, coalesce(string_agg(cls::VARCHAR, ',' ORDER BY pos) FILTER (WHERE cls <> 0 AND cls IS DISTINCT FROM was), '') AS classes, round(coalesce(avg(p::DOUBLE) FILTER (WHERE cls <> 0 AND cls IS DISTINCT FROM was), 0), 5) AS confidence FROM c GROUP BY seq""",
    "word_index": _TAG + " SELECT seq, pos, (sum((tag NOT LIKE 'I-%' OR pos = 0)::INT) OVER (PARTITION BY seq ORDER BY pos ROWS UNBOUNDED PRECEDING) - 1)::BIGINT AS word FROM t",
    "sentence_of": _TAG + " SELECT a.seq, a.pos, max(b.pos) * 10 AS sentence FROM t a JOIN t b ON b.seq = a.seq AND b.pos <= a.pos AND (b.len % 5 = 0 OR b.pos = 0) GROUP BY a.seq, a.pos",
    "span_candidates": _TAG + ' SELECT a.seq, a.pos AS start, b.pos + 1 AS "end" FROM t a JOIN t b ON b.seq = a.seq AND b.pos BETWEEN a.pos AND a.pos + 3 AND a.pos // 15 = b.pos // 15 WHERE a.len > 2 AND b.len > 2',
    "entity_pairs": _TAG + " SELECT a.seq, a.pos AS head, b.pos AS tail FROM t a JOIN t b ON a.seq = b.seq AND a.pos <> b.pos WHERE a.tag LIKE 'B-%' AND b.tag LIKE 'B-%'",
    "type_votes": _TAG + ", n AS (SELECT seq AS entity, tag AS type, count(*) AS n, min(pos) AS seen FROM t GROUP BY ALL) SELECT entity, arg_max(type, row(n, seen)) AS type FROM n GROUP BY entity",
    "fact_margins": """WITH e AS (SELECT vec_id % 5 AS window_id, label AS head, vec_id // 50 AS tail, generate_subscripts(embedding, 1) - 1 AS relation, unnest(embedding)::DOUBLE AS logit FROM embeddings),
m AS (SELECT window_id, head, tail, relation, round(round(max(logit), 6) - 0.12::DOUBLE, 6) AS margin FROM e WHERE head <> tail GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY window_id, head, tail ORDER BY margin DESC, relation) AS rank FROM m) SELECT * FROM r WHERE rank <= 4 AND margin > 0""",
    "geometry": """WITH p AS (SELECT p_partkey, (p_partkey % 40)::DOUBLE AS x, p_size::DOUBLE AS h FROM part), d AS (SELECT *, 20 * 8 * 1.5::DOUBLE / 56 AS d FROM p)
SELECT p_partkey, round(least(greatest(x - d, 0), 64), 5) AS ux0, round(least(greatest(h - d, 0), 64), 5) AS uy0, round(least(greatest(x + 20 + d, 0), 64), 5) AS ux1, round(least(greatest(h + 8 + d, 0), 64), 5) AS uy1,
least(greatest(floor((x + 0.3::DOUBLE) / 0.5::DOUBLE), 0), 100) AS sx0, least(greatest(floor((h + 0.3::DOUBLE) / 2), 0), 40) AS sy0, least(greatest(ceil((x + 20.2::DOUBLE) / 0.5::DOUBLE), 0), 100) AS sx1, least(greatest(ceil((h + 8.2::DOUBLE) / 2), 0), 40) AS sy1,
least(greatest(CASE WHEN h > 0 THEN ceil(p_partkey * 48 / h) ELSE 1 END, 1), 320)::BIGINT AS aw, greatest(((p_partkey + 16) // 32) * 32, 32)::BIGINT AS r32 FROM d""",
}
