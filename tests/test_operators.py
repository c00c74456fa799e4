"""Operators, sources, providers and plans on small inputs."""

import glob
import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tessella.operators import catalog, pages, reliability, retrieval, tags
from tessella.plans import prefetch
from tessella.plans.runtime import CatalogError, Runtime
from tessella.providers import base, onnx
from tessella.sources import audio, corpus
from tessella.streaming import breaker


def test_pooling(spark):
    t = spark.createDataFrame([(1, 0, [1.0, 5.0], False), (1, 1, [3.0, 1.0], True), (1, 2, [5.0, 3.0], True), (2, 0, [7.0, 7.0], False)], "id int, pos int, vector array<double>, mask boolean")
    got = {k: {r.id: list(r.vector) for r in retrieval.pool(t, k).collect()} for k in ("mean", "max", "cls", "last")}
    assert got == {"mean": {1: [4, 2], 2: [0, 0]}, "max": {1: [5, 3], 2: [0, 0]}, "cls": {1: [1, 5], 2: [7, 7]}, "last": {1: [5, 3], 2: [7, 7]}}


def test_queries_in_blocks_are_all_scored(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "QUERY_BYTES", 2048)
    q = spark.createDataFrame([(i, [float(i)]) for i in range(9)], "query_id int, vector array<double>")
    d = spark.createDataFrame([(j, [2.0]) for j in range(3)], "doc_id int, vector array<double>")
    assert sorted((r.query_id, r.doc_id, r.score) for r in retrieval.dense_scores(q, d).collect()) == [(i, j, 2.0 * i) for i in range(9) for j in range(3)]
    top = retrieval.top_k(retrieval.dense_scores(q, d), 2).collect()
    assert sorted((r.query_id, r.doc_id, r["rank"]) for r in top) == [(i, j, j + 1) for i in range(9) for j in (0, 1)]


def test_spans(spark):
    def rows(*t):
        return spark.createDataFrame([(0, i, x) for i, x in enumerate(t)], "seq int, pos int, tag string")

    got = lambda f, *t: sorted((r.start, r.end, r.label) for r in f(rows(*t)).collect())
    assert got(tags.bio_spans, "O", "B-PER", "I-PER", "O", "B-ORG", "B-ORG") == [(1, 3, "PER"), (4, 5, "ORG"), (5, 6, "ORG")]
    assert got(tags.bio_spans, "I-PER", "I-PER") == [(0, 2, "PER")]
    assert got(tags.bio_spans, "B-PER", "I-ORG") == [(0, 2, "PER")]
    assert got(tags.merged_spans, "B-PER", "I-ORG", "LOC") == [(0, 1, "PER"), (1, 2, "ORG"), (2, 3, "LOC")]


POLICIES = {"auto": pages.Policy(), "structure": pages.Policy(structure=True), "ocr": pages.Policy("ceiling", "native", "ocr", True), "fixed": pages.Policy("fixed", "native", "vlm")}


@pytest.mark.parametrize("text,policy,target,reasons", [
    ("x" * 900, "auto", "native", []), ("", "auto", "ocr", ["no_text_layer"]), ("short", "auto", "ocr", ["low_coverage"]), ("�" * 300, "auto", "ocr", ["garbled_text"]),
    ("x" * 900, "structure", "vlm", ["structure_requested"] * 2), ("x" * 900, "ocr", "ocr", ["structure_requested"]), ("", "fixed", "vlm", []),
])
def test_plan_tier(spark, text, policy, target, reasons):
    p = pages.page_signals(spark.createDataFrame([(text,)], "native_text string")).withColumn("looks_structured", F.lit(True))
    r = pages.plan_tier(p, POLICIES[policy]).first()
    assert r.target == target and [c["reason"] for c in r.climbs] == reasons


def test_extract_pages(spark):
    rows = [("d", 1, "word " * 300), ("d", 2, ""), ("d", 3, ""), ("e", 1, "")]
    p = spark.createDataFrame(rows, "doc string, page int, native_text string")
    ocr = lambda x: x.withColumn("out_text", F.when(F.col("page") == 3, "").otherwise("seen"))
    vlm = lambda x: x.withColumn("out_text", F.lit("read"))
    got = {(r.doc, r.page): (r.tier, r.text) for r in pages.extract_pages(p, pages.Policy(max_vlm_pages=1), ocr, vlm).collect()}
    assert got == {("d", 1): ("native", "word " * 300), ("d", 2): ("ocr", "seen"), ("d", 3): ("vlm", "read"), ("e", 1): ("ocr", "seen")}
    with pytest.raises(ValueError):
        pages.extract_pages(p, pages.Policy("fixed", "native", "vlm"), ocr)


def test_breaker_batch_and_stream_agree(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(int(k), i, float(i), bool(ok)) for i, (k, ok) in enumerate(zip(rng.integers(0, 3, 200), rng.random(200) < 0.4))]
    calls = spark.createDataFrame(rows, "key long, event long, ts double, ok boolean")
    batch = sorted(map(tuple, reliability.circuit_breaker(calls, 3, 5.0).collect()))
    assert {r[5] for r in batch} == {"open", "closed"} and not all(r[4] for r in batch)
    out = str(tmp_path)
    for part in (0, 1):  # a batch that is run again changes nothing
        for _ in range(2 - part):
            breaker.process_batch(calls.where(f"int(event / 100) = {part}"), part, out, 3, 5.0)
    parts = spark.read.parquet(f"{out}/calls/0").unionByName(spark.read.parquet(f"{out}/calls/1"))
    assert sorted(map(tuple, parts.select(*reliability.circuit_breaker(calls).columns).collect())) == batch
    last = {r[0]: (r[5], r[6]) for r in sorted(batch, key=lambda r: r[2])}
    assert {r.key: (r.state, r.failures) for r in spark.read.parquet(f"{out}/state/1").collect()} == last


def test_breaker_stream(spark, tmp_path):
    spark.createDataFrame([(1, i, float(i), False) for i in range(4)], "key long, event long, ts double, ok boolean").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("key long, event long, ts double, ok boolean").parquet(str(tmp_path / "in"))
    q = breaker.start_breaker(stream, str(tmp_path / "out"), 3, 10.0, availableNow=True)
    assert q.awaitTermination(60)
    assert [(r.admitted, r.state) for r in sorted(spark.read.parquet(str(tmp_path / "out/calls/0")).collect(), key=lambda r: r.event)] == [(True, "closed"), (True, "closed"), (True, "open"), (False, "open")]


def test_budget_falls_to_the_tier_that_the_policy_allows(spark):
    p = spark.createDataFrame([("d", 1, "word " * 300), ("d", 2, "word " * 300), ("d", 3, "")], "doc string, page int, native_text string")
    seen = []

    def ocr(x):
        seen.append(x)
        return x.withColumn("out_text", F.lit("seen"))

    vlm = lambda x: x.withColumn("out_text", F.lit("read"))
    got = {r.page: r for r in pages.extract_pages(p, pages.Policy("fixed", "native", "vlm", max_vlm_pages=1), ocr, vlm).collect()}
    assert [got[k].tier for k in (1, 2, 3)] == ["vlm", "native", "native"] and got[2].text == "word " * 300
    assert [(c["from"], c["to"], c["reason"]) for c in got[2].climbs] == [("vlm", "native", "budget_exhausted")] and got[1].climbs == []
    got = {r.page: r for r in pages.extract_pages(p, pages.Policy("auto", "vlm", "vlm", max_vlm_pages=2), ocr, vlm).collect()}
    assert [got[k].tier for k in (1, 2, 3)] == ["vlm", "vlm", "native"]
    got = {r.page: r for r in pages.extract_pages(p, pages.Policy("auto", "native", "vlm", True, 1), ocr, vlm).collect()}
    assert [(got[k].tier, got[k].text) for k in (1, 2, 3)] == [("vlm", "read"), ("ocr", "seen"), ("ocr", "seen")]


def test_health_of_unknown_states_and_unchecked_providers(spark):
    v = spark.createDataFrame([("a", None, "degraded"), ("b", True, "lost"), ("c", False, "lost"), ("d", None, None)], "provider string, ok boolean, own string")
    assert {r.provider: r.health for r in reliability.provider_health(v).collect()} == {"a": "degraded", "b": "lost", "c": "lost", "d": "healthy"}


def test_percentiles_of_calls_are_exact(spark, monkeypatch):
    """More different times than an approximate percentile tells apart, ties, nulls in times and keys."""
    monkeypatch.setattr(reliability, "RANGES", 8, raising=False)
    few = {("b", "ok"): [3.0, 1.0, None, 2.0], (None, "ok"): [5.0], ("b", "error"): [None, None], ("c", "ok"): [7.0] * 39 + [9.0] * 2, ("d", "ok"): [float(i) for i in range(100)]}
    rows = [(a, "t", None, s, x) for (a, s), xs in few.items() for x in xs]
    keys = F.lit("a").alias("alias"), F.lit("t").alias("task"), F.lit(None).cast("string").alias("provider"), F.lit("ok").alias("status")
    many = spark.range(40001).select(*keys, (F.col("id") * 12343 % 40001).cast("double").alias("ms"))
    got = reliability.call_metrics(many.union(spark.createDataFrame(rows, "alias string, task string, provider string, status string, ms double"))).collect()
    assert {(r.alias, r.status): (r.calls, r.p50, r.p95) for r in got} == {
        ("a", "ok"): (40001, 20000.0, 38000.0), ("b", "ok"): (4, 2.0, 3.0), (None, "ok"): (1, 5.0, 5.0), ("b", "error"): (2, None, None),
        ("c", "ok"): (41, 7.0, 7.0), ("d", "ok"): (100, 49.0, 94.0),
    }
    assert reliability.call_metrics(many.limit(0)).count() == 0


def test_any_prefix_before_the_first_hyphen(spark):
    t = spark.createDataFrame([(0, i, x) for i, x in enumerate(["E-PER", "I-PER", "I-A-B", "I-A-B", "", "PER"])], "seq long, pos long, tag string")
    assert sorted((r.start, r.end, r.label) for r in tags.merged_spans(t).collect()) == [(0, 2, "PER"), (2, 4, "A-B"), (5, 6, "PER")]


def test_health(spark):
    v = spark.createDataFrame([("a", True, "healthy"), ("a", False, "healthy"), ("b", False, "healthy"), ("c", True, "degraded"), ("d", True, "healthy")], "provider string, ok boolean, own string")
    assert {r.provider: r.health for r in reliability.provider_health(v).collect()} == {"a": "degraded", "b": "unhealthy", "c": "degraded", "d": "healthy"}


def test_catalog(spark, tmp_path):
    spec = {"alias": "embed/a", "task": "embed", "provider_id": "local/onnx", "model_id": "m", "options": {"pooling": "max", "dimensions": 8.0}}
    (tmp_path / "c.json").write_text(json.dumps([spec, {**spec, "alias": "embed/b", "options": {"dimensions": 8, "pooling": "max"}}, {**spec, "alias": "embed/c", "options": {"pooling": "sum"}}]))
    got = catalog.read_catalog(spark, str(tmp_path / "c.json"))
    assert [(r.alias, r.problem) for r in catalog.validate_catalog(got).collect()] == [("embed/c", "option pooling: not one of cls, mean, max, last-token")]
    assert sorted(r.aliases for r in catalog.shared_models(got).collect()) == [["embed/a", "embed/b"], ["embed/c"]]
    assert catalog.normalize_whole_floats({"a": [1.0, 1.5, {"b": -2.0}], "c": 1e300}) == {"a": [1, 1.5, {"b": -2}], "c": 1e300}
    assert catalog.cache_dir("p", "a/b c", {}, "NO_SUCH_VARIABLE") == os.path.join(".model_cache", "p", "a--bc")
    with pytest.raises(ValueError):
        catalog.select_artifact(["a.onnx", "b.onnx"])


def test_runtime(spark, tmp_path):
    r = Runtime.build([{"alias": f"h/{k}", "task": "embed_hybrid", "provider_id": "local/deterministic", "model_id": "m", "warmup": "eager"} for k in "ab"])
    assert list(r.shared().values()) == [["h/a", "h/b"]]
    df = spark.createDataFrame([("one two one",), (None,), ("",)], "t string")
    rows = df.select(r.hybrid("h/a", F.col("t")).alias("h"), r.embed("h/b", F.col("t")).alias("e"), r.hybrid("h/a", F.col("t"), ("sparse",)).alias("s")).collect()
    assert len(rows[0].h.sparse) == 2 and len(rows[0].h.multi_vector) == 3 and rows[0].s.dense is None and np.isclose(np.linalg.norm(rows[0].e), 1)
    assert rows[1].h.multi_vector == [] and rows[2].e == [0.0] * 32
    some = r.only_where(df, F.length("t") > 0, "v", lambda: r.embed("h/a", F.col("t"))).collect()
    assert sorted(x.v is None for x in some) == [False, True, True]
    for bad in ({"alias": "x"}, {"alias": "a/b", "provider_id": "none"}, {"alias": "a/b", "timeout": 0}):
        with pytest.raises(CatalogError):
            Runtime.build([{"task": "embed", "provider_id": "local/deterministic", "model_id": "m"} | bad])
    (tmp_path / "c.json").write_text(json.dumps([{"alias": "e/x", "task": "embed", "provider_id": "local/deterministic", "model_id": "m"}, {"alias": "e/y", "task": "embed", "provider_id": "remote/openai", "model_id": "m"}]))
    assert prefetch.main([str(tmp_path / "c.json")]) == 0
    assert base.provider("local/onnx").tasks == ("raw",) and onnx.TYPES


def test_audio(spark):
    x = np.array([0.0, 0.5, -0.5, 2.0, -2.0])
    raw = audio.write_wav(x)
    assert np.allclose(audio.read_wav(raw), np.clip(x, -1, 1), atol=1e-4)
    odd = raw[:36] + b"LIST" + (3).to_bytes(4, "little") + b"abc\0" + raw[36:]
    assert np.allclose(audio.read_wav(odd), np.clip(x, -1, 1), atol=1e-4)
    got = spark.createDataFrame([(bytearray(raw),), (bytearray(b"no"),)], "b binary").select(audio.decode_wav(F.col("b")).alias("w")).collect()
    assert len(got[0].w.samples) == 5 and got[1].w.error == "not a WAV file"
    assert spark.range(1).select(audio.mono(F.array(*map(F.lit, [1.0, 3.0, 5.0, 7.0])), F.lit(2)).alias("m")).first().m == [2, 6]


def test_sources(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"id":1,"text":"a"}\n\n{"id":2,"text":"b"}\n')
    assert sorted((r.id, r.text) for r in corpus.read_corpus(spark, str(tmp_path / "c.jsonl")).collect()) == [(1, "a"), (2, "b")]
    (tmp_path / "bad.jsonl").write_text('{"id":1,"text":"a"}\nnope\n')
    with pytest.raises(Exception):
        corpus.read_corpus(spark, str(tmp_path / "bad.jsonl")).collect()
    docs = [[[1.0, 2.0]], [], [[3.0, 4.0], [5.0, 6.0]]]
    assert corpus.read_mvec(corpus.mvec_bytes(docs, 2)) == docs
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "x.bin").write_bytes(b"p1|p2|p3")
    got = corpus.read_pages(spark, str(tmp_path / "d"), lambda b: b.decode().split("|"), 2, 3).collect()
    assert [(r.page, r.native_text) for r in got] == [(2, "p2"), (3, "p3")]


def test_golden_windows_of_own_rules():
    from tessella.functions import segment

    units = [("Ann", "I don't know. Ask Dr. Lee."), ("Bob", "  "), ("Bob", "OK!")]
    (w,) = segment.windows([u for u in units if u[1].strip()])
    assert w["tokens"] == ["I", "do", "n't", "know", ".", "Ask", "Dr.", "Lee", ".", "OK", "!"]
    assert [(s["start"], s["end"], s["speaker"]) for s in w["sentences"]] == [(0, 5, "Ann"), (5, 9, "Ann"), (9, 11, "Bob")]


def test_entry_registers_every_query_with_known_oracles():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 70
    assert "colbert_rerank" in q


@pytest.mark.skipif(not glob.glob("/root/testdata/sf0.001/*.parquet"), reason="no test tables")
def test_flagship(spark):
    rows = entry.entry(spark).collect()
    assert [r["rank"] for r in sorted(rows, key=lambda r: r["rank"])] == list(range(1, len(rows) + 1)) and rows
