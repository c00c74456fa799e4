"""Column functions against stated values and plain Python."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessella.functions import decode, docparse, geometry, http_shapes, segment
from tessella.functions import text as T
from tessella.functions import vector as V


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def vec(*xs):
    return F.array(*[F.lit(float(x)) for x in xs])


def test_max_sim_and_empty_side(spark):
    a, b = F.array(vec(1, 0), vec(0, 1)), F.array(vec(1, 0), vec(0.5, 0.5))
    none = F.array().cast("array<array<double>>")
    assert one(spark, V.max_sim(a, b)) == 1.5
    assert one(spark, V.max_sim(a, none)) == 0.0 and one(spark, V.max_sim(none, a)) == 0.0


@pytest.mark.parametrize("a,b,want", [({1: 0.5, 4: 2}, {4: 1, 9: 3}, 2.0), ({1: 1}, {2: 1}, 0.0), ([(4, 1), (4, 1)], [(4, 3)], 6.0)])
def test_sparse_dot(spark, a, b, want):
    col = lambda v: F.array(*[F.struct(F.lit(t).alias("term"), F.lit(float(w)).alias("weight")) for t, w in (v.items() if isinstance(v, dict) else v)])
    assert one(spark, V.sparse_dot(col(a), col(b))) == want


def test_dot_takes_the_shared_prefix_and_zero_vectors_stay(spark):
    assert one(spark, V.dot(vec(1, 2, 3), vec(4, 5))) == 14
    assert one(spark, V.l2_normalize(vec(0, 0))) == [0, 0]
    assert one(spark, V.l2_normalize(vec(3, 4))) == [0.6, 0.8]


def test_softmax_rows(spark):
    got = one(spark, V.log_softmax(vec(1, 2, 3)))
    assert np.allclose(got, decode.log_softmax(np.array([[1, 2, 3.0]]))[0])
    assert np.isclose(sum(one(spark, V.softmax(vec(5, 1, -3)))), 1)
    assert one(spark, V.log_softmax(vec(float("-inf"), float("-inf")))) == [0, 0]
    assert one(spark, V.class_confidence(vec(0.2, 0.8), F.lit(1))) == 0.8
    assert one(spark, V.argmax_first(vec(1, 2, 2))) == 1 and one(spark, V.argmax_last(vec(1, 2, 2))) == 2


def test_confidence_and_backoff(spark):
    c = lambda *a: one(spark, V.derived_confidence(*[F.lit(x) for x in a]))
    assert c(True, 0.0, 0.0, 1.0) > 0.99 and c(True, 0.9, 0.0, 1.0) < 0.2 and c(False, 0.0, 0.0, 1.0) == 0.5 and c(True, 0.0, 0.8, 1.0) < 0.25
    assert [one(spark, V.backoff_ms(F.lit(100), F.lit(k))) for k in (0, 1, 2, 4)] == [100, 100, 200, 800]


@pytest.mark.parametrize("gen,known,want", [("Sum 7,310.25 paid", "Sum 7,130.25 paid", [7310.25]), ("8,800", "8800", []), ("55,60", "55,61", [5560.0]), ("v1.2.3 build 42/99", "42", [99.0]), ("2.0.", "", [])])
def test_numeric_guard(spark, gen, known, want):
    assert one(spark, T.unmatched_numbers(F.lit(gen), F.lit(known))) == want


def test_text_measures(spark):
    r = lambda t: one(spark, T.repetition_ratio(F.lit(t)))
    assert r("dig dig dig dig dig dig") > 0.5 and r("a b c d e f g") == 0 and r("a b") == 0 and r("") == 0
    assert one(spark, T.is_garbled(F.lit("�" * 5 + "abc"))) and not one(spark, T.is_garbled(F.lit("plain\ttext\n")))
    assert one(spark, T.text_coverage(F.lit("x" * 900))) == 0.5
    assert [(p.offset, p.text) for p in one(spark, T.paragraphs(F.lit("é\n\n \n\nb")))] == [(0, "é"), (7, "b")]


@pytest.mark.parametrize("tok,want", [("don't", ["do", "n't"]), ("'s", ["'s"]), ("I'd've", ["I'd", "'ve"]), ("cat", ["cat"]), ("IT'S", ["IT", "'S"])])
def test_split_clitic(spark, tok, want):
    assert one(spark, T.split_clitic(F.lit(tok))) == want


@pytest.mark.parametrize("w,s,want", [("Moved", "l|2|e", "move"), ("Lisbon", "|0|", "Lisbon"), ("ab", "l|9|x", "x"), ("word", "bad", "word")])
def test_lemma_script(spark, w, s, want):
    assert one(spark, T.apply_lemma_script(F.lit(w), F.lit(s))) == want


def test_names(spark):
    c = lambda a, b: one(spark, T.names_compatible(F.split(F.lit(a), " "), F.split(F.lit(b), " ")))
    for a, b, want in (("Obama", "Barack Obama", True), ("UN", "United Nations", True), ("the", "the", False), ("Ann", "Bob", False), ("U.N.", "United Nations", True)):
        assert c(a, b) is want and decode.same_name(a.split(), b.split()) is want


@pytest.mark.parametrize("url,want", [("https://u:p@h/a?q#f", "https://h/a"), ("u@h", "h"), ("http://h", "http://h"), ("http://a:x?y#z@h/p", "http://h/p")])
def test_redact_url(spark, url, want):
    assert one(spark, T.redact_url(F.lit(url))) == want


def test_geometry(spark):
    assert [one(spark, geometry.round_to_32(F.lit(n))) for n in (0, 15, 47, 48, 100)] == [32, 32, 32, 64, 96]
    assert one(spark, geometry.aspect_width(F.lit(100), F.lit(0), 48, 320)) == 1


def test_doctags_and_markdown(spark):
    page = '<heading loc="0.1,0.1,0.9,0.2">T</heading>\n<text>body</text><formula>x</formula>tail <zzz>u</zzz><table/>'
    got = docparse.tagged_blocks(page)
    assert [(b["kind"], b["content"]) for b in got] == [("heading", "T"), ("text", "body"), ("formula", "x"), ("text", "tail"), ("text", "u"), ("table", "")]
    assert got[0]["bbox"] == [0.1, 0.1, 0.9, 0.2]
    assert docparse.tagged_blocks("<text>open") == [{"kind": "text", "content": "open", "bbox": None, "reading_order": 0}] and docparse.tagged_blocks("<text") == []
    md = "# Title\n\npara\n\n$$\nE\n$$\n\n| a |\n| b |\n\n![A cat](cat.png)\n\n- x\n\n3 y. z"
    kinds = [(b.kind, b.content) for b in one(spark, docparse.parse_markdown(F.lit(md)))]
    assert kinds == [("heading", "Title"), ("text", "para"), ("formula", "E"), ("table", "| a |\n| b |"), ("figure", "A cat"), ("list", "- x"), ("list", "3 y. z")]


def test_sentences_and_tokens():
    assert [s for _, s in segment.sentences("It rained. Stop! Who goes?")] == ["It rained.", "Stop!", "Who goes?"]
    assert [s for _, s in segment.sentences("v1.2 shipped")] == ["v1.2 shipped"]
    assert [s for _, s in segment.sentences("Prof. Ada K. Brown left early.")] == ["Prof. Ada K. Brown left early."]
    assert [w for _, w in segment.tokens("2.75 or 6,400 or 12%")] == ["2.75", "or", "6,400", "or", "12%"]
    assert [w for _, w in segment.tokens("hm... so what?!")] == ["hm", "...", "so", "what", "?", "!"]
    assert segment.windows([]) == [] and len(segment.windows([(None, "a " * 600)])[0]["tokens"]) == 512


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=80))
def test_tokens_are_slices(text):
    assert all(text[a:a + len(w)] == w for a, w in segment.tokens(text))


def test_viterbi_and_spans():
    assert decode.viterbi([[1, 0, 0.9], [0, 0, 5]], ["O", "B-PER", "I-PER"]) == [1, 2]
    assert decode.greedy_spans([[0, 2], [0, 3], [0, -1]], [(0, 2), (1, 3), (3, 4)]) == [(1, 3, 0)]
    assert decode.clusters([(1, 2), (2, 3), (7, 7)]) == [[1, 2, 3]]
    assert decode.vote(["A", "B"]) == "B" and decode.vote(["A", "A", "B"]) == "A"


def test_text_boxes():
    p = np.zeros((10, 12))
    p[2:7, 3:9] = 0.9
    x0, y0, x1, y1, score = decode.text_boxes(p, ratio=0.0)[0]
    assert (x0, y0, x1, y1) == (3, 2, 9, 7) and math.isclose(score, 0.9)
    q = np.zeros((8, 8))
    q[0:3, 0:3] = q[3:6, 3:6] = 0.7
    assert len(decode.text_boxes(q)) == 2 and decode.text_boxes(np.zeros((0, 0))) == []
    assert len(decode.text_boxes(np.full((3, 3), 0.3), least_score=0.0)) == 1


def test_entities():
    tokens = "Ann Lee met Bob . Ann left Acme".split()
    got = decode.build_entities(tokens, [(0, 5), (5, 8)], [("PERSON", 0, 2), ("PER", 3, 4), ("PERSON", 5, 6), ("ORG", 7, 8), ("CARDINAL", 4, 5)], [[(0, 1), (5, 5)]])
    assert [[m["name"] for m in e] for e in got] == [["Ann Lee", "Ann"], ["Bob"], ["Acme"]]
    assert decode.build_entities(tokens, [(0, 8)], [("PER", 0, 1)], []) == []


def test_payloads(spark):
    m = http_shapes.as_messages(F.array(F.struct(F.lit("system").alias("role"), F.lit("be\n\"good\"").alias("text")), F.struct(F.lit("assistant").alias("role"), F.lit("é").alias("text"))))
    import json

    g = json.loads(one(spark, http_shapes.google_payload(m, 0.5)))
    assert g["system_instruction"]["parts"][0]["text"] == 'be\n"good"' and g["contents"] == [{"role": "model", "parts": [{"text": "é"}]}] and g["generationConfig"] == {"temperature": 0.5}
    c = json.loads(one(spark, http_shapes.chat_payload(F.lit("x"), m, 5)))
    assert c["stream"] is False and c["max_tokens"] == 5 and c["messages"][0] == {"role": "system", "content": 'be\n"good"'}
    image = F.array(F.struct(F.lit("user").alias("role"), F.array(F.struct(F.lit("image").alias("kind"), F.lit(None).cast("string").alias("text"), F.lit(b"ab").cast("binary").alias("image"), F.lit("image/png").alias("media_type"), F.lit(None).cast("string").alias("url"))).alias("content")))
    assert json.loads(one(spark, http_shapes.openai_messages(image)))[0]["content"][0]["image_url"]["url"] == "data:image/png;base64,YWI="
    a = json.loads(one(spark, http_shapes.anthropic_payload(F.lit("x"), m)))
    assert a["max_tokens"] == 1024 and a["system"] == 'be\n"good"'


def test_response_errors(spark):
    e = lambda b, n: one(spark, http_shapes.parse_embeddings(F.lit(b), F.lit(n)))
    assert e('{"data":[{"index":1,"embedding":[2]},{"index":0,"embedding":[1]}]}', 2).vectors == [[1], [2]]
    assert e('{"data":[{"index":1,"embedding":[2]},{"embedding":[1]}]}', 2).vectors == [[2], [1]]
    assert e('{"data":[{"index":5,"embedding":[2]}]}', 1).error == "index out of range" and e("{}", 1).error == "missing data"
    r = lambda b, n: one(spark, http_shapes.parse_rerank(F.lit(b), F.lit(n)))
    assert [s["index"] for s in r('[{"index":0,"score":1},{"index":1,"score":2}]', 2).scored] == [1, 0]
    assert r('{"results":[{"index":0,"relevance_score":1},{"index":0,"score":2}]}', 2).error == "duplicate index"


def test_words_and_offsets_do_not_depend_on_what_is_kept():
    texts = ["", "Größe x's don't", "a\x1cb été. \U0001f600 Then. (More)", "U.S. mail@host.org, 1,5% of it's", "w" * 50 + "'s end"]
    for t in texts:
        assert segment.tokens(t) == [(m.start() + a, w) for m in segment._CHUNK.finditer(t) for a, w in segment._cut(m[0])]
        found = segment.sentences(t)
        assert segment.in_bytes(t, found) == [(len(t[:a].encode()), part) for a, part in found]


def test_sentences_of_a_text_of_initials_take_linear_time():
    text = "A. " * 200_000 + "End. Next one."
    assert [len(s) for _, s in segment.sentences(text)] == [600_004, 9]
