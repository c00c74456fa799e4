"""Window analysis, images and the runtime's tasks against stated values and plain Python."""

import itertools
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.functions import image as I
from tessella.functions import nlp as N
from tessella.functions.base import places_below, running_sums
from tessella.functions.decode import FORBIDDEN
from tessella.plans.runtime import CallTimeout, Runtime, _within
from tessella.providers import base
from tessella.queries.analysis import pieces


def test_alignment_of_cut_encodings():
    words = ["seven", "é", "wizardly", "", "ox"]
    a = N.align(words, pieces, 64, 2)
    assert a.ids == [1, 14, 11, 12, 14, 14, 12, 2] and a.first == [1, 3, 4, -1, 6] and a.limit == 5
    assert a.analysed() == [True, True, True, False, True] and a.ends() == [3, 4, 6, 1, 7]
    cut = N.align(words, pieces, 5, 99)
    assert cut.ids == [1, 14, 11, 12, 99] and cut.limit == 2 and cut.first == [1, 3]
    assert N.align([], pieces, 5, 9).ids == [1, 2]


def test_labels_are_cut_and_padded():
    ids, mask = N.encode_labels(["a", "abcd " * 60], pieces, 0, 8)
    assert [len(r) for r in ids] == [8, 8] and sum(mask[0]) == 3 and ids[1][-1] == 2 and ids[0][3:] == [0] * 5
    assert N.encode_labels([], pieces, 0) == ([], [])


def test_markers_around_mentions_and_turns():
    tokens = ["I", "met", "Bob", "Lee", "."]
    words, spoken, at = N.marked_words(tokens, [[(2, 4)], [(0, 1)]], [(0, 0)], ["Ann"])
    assert words == ["*", "Ann", "*", ":", "*", "I", "*", "met", "*", "Bob", "Lee", "*", "."] and spoken == [[0]] and at == [[8], [4]]
    ids, places = N.marker_input(tokens, [[(2, 4)], [(0, 1)]], [(0, 0)], ["Ann"], pieces, 2, 8)
    assert len(ids) == 8 and places == [[1], [-1], [5]]


def test_calibration_and_overrides():
    c = N.Calibration.load({"rel_offset": 0.5, "rel_offsets": {"b": -1, "x": "bad"}, "rel_top": 2, "unseen_offset": 0.25}, ["a", "b"])
    assert (c.relation_offset("a"), c.relation_offset("b"), c.relation_offset("z"), c.rel_top, c.entity_coref) == (0.5, -1.0, -0.25, 2, "all")
    d = c.merged(rel_offsets={"a": 0.0}, span_offset=None, coref_link_bias=0.1, entity_coref="none")
    assert d.rel_offsets == {"a": 0.0, "b": -1.0} and d.coref_link_bias == 0.1 and d.entity_coref == "none" and c.rel_offsets["a"] == 0.5
    assert N.Calibration.load({}).rel_top == 4


def best_path(lp, tags):
    allowed = lambda p: all(not t.startswith("I-") or (i and p[i - 1][2:] == t[2:] and p[i - 1] != "O") for i, t in enumerate(p))
    paths = [p for p in itertools.product(range(len(tags)), repeat=len(lp)) if allowed([tags[k] for k in p])]
    return list(max(paths, key=lambda p: sum(lp[i][k] for i, k in enumerate(p))))


def test_paths_are_the_best_allowed_ones():
    rng, tags = np.random.default_rng(4), ["O", "B-X", "I-X", "B-Y", "I-Y"]
    for _ in range(20):
        lp = rng.normal(size=(5, 5))
        assert N.viterbi_of(lp, tags) == best_path(lp, tags)


def test_frames_keep_the_predicate_and_its_sentence():
    tags = ["O", "V", "B-A0", "I-A0"]
    hot = {0: 2, 1: 3, 2: 0, 3: 2, 4: 3}
    scores = np.full((5, 4), -5.0)
    for w, k in hot.items():
        scores[w, k] = 5
    frames = N.role_frames([[0, 1], [1, 0], [0, 1], [1, 0], [1, 0]], lambda p, a, b: scores[a:b], [0, 0, 0, 1, 1], [True] * 5, tags)
    assert [f["predicate"] for f in frames] == [0, 2] and frames[1]["args"] == [("A0", 0, 2)] and frames[0]["args"] == []
    assert N.role_frames([[1, 0]] * 5, None, [0] * 5, [True] * 5, tags) == []


def test_flat_frames():
    place = [None, 0, 1, 2, 3, 4, 5]
    assert N.flat_frame(3, ["O", "B-A", "I-A", "V", "I-B", "I-C", "E-C"], place) == {"predicate": 2, "roles": [("A", 0, 1), ("B", 3, 3), ("C", 4, 4)]}
    assert N.flat_frame(0, ["A"], [None]) is None and N.flat_frame(1, ["O", "O"], [None, 0]) is None


def test_chains_and_bias():
    scores = np.full((4, 4), -1.0)
    scores[:, 0] = 0
    scores[2, 1], scores[3, 2] = 0.5, 0.5  # 2 to 0, 3 to 1
    near = lambda heads: ([[h - 1, h, h + 1] for h in heads], [[3, 1, 9]] * len(heads), [[9, 1, 0.5]] * len(heads))
    candidates = [[0, 1, -1]] * 4
    assert N.chains(scores, candidates, near) == [[(0, 0), (1, 2)], [(0, 1), (2, 3)]]
    assert N.chains(scores, candidates, near, 1.0) == []


def test_nodes_facts_and_attributes():
    tokens = "Ann saw Bob Lee in Rome".split()
    typed = N.group_entities(tokens, [(0, 6)], [("PERSON", 2, 4), ("GPE", 5, 6)], [], "all", {(5, 6): "city"})
    assert [(e["type"], e["mentions"][0]["name"]) for e in typed] == [("PER", "Bob Lee"), ("city", "Rome")]
    nodes = N.entity_nodes(tokens, typed, [(0, 0)], ["Ann", "Silent"], [True] * 6)
    assert [(n["type"], n["text"], n["speaker"]) for n in nodes] == [("speaker", "Ann", True), ("PER", "Bob Lee", False), ("city", "Rome", False)]
    logits = np.zeros((2, 3))
    logits[0] = [1.0, 1.5, 1.2]
    f = N.facts(logits, 2, ["r", "s"], N.Calibration(offset=0.1, rel_top=1))
    assert [(x["head"], x["tail"], x["relation"], round(x["margin"], 6)) for x in f] == [(0, 1, "r", 0.4)]
    assert N.attributes([0, 1], [0, 0, 3, 0, 0, 0], [1, 0], [0, 1]) == {"polarity": "negative", "modality": "planned", "holder": None, "time": 0}


def test_default_and_schema_heads():
    tags = ["O", "B-X", "I-X"]
    scores = np.array([[0, 4, 0], [0, 0, 4], [0, 0, 4], [4, 0, 0.0]])
    assert N.tagged_spans(scores, [(0, 2), (2, 4)], tags) == [("X", 0, 2)]
    assert N.tagged_spans(scores, [(0, 2), (2, 4)], tags, 50.0) == []
    logits = np.array([[0, 2.0], [0, 1.0], [0, 3.0]])
    assert N.schema_spans(logits, [(0, 1), (0, 2), (1, 3)], [(0, 2)], 0.0) == [(0, 1, 0)]
    assert N.schema_spans(logits, [(0, 1), (0, 2), (1, 3)], [(0, 3)], 0.0) == [(0, 1, 0), (1, 3, 0)]


def test_flat_view_over_windows():
    words = [("Bob", 0, 3), ("ran", 4, 7)]
    flat = N.flatten([{"words": words, "sentences": [(0, 2), (2, 2)]}] * 2, [{"heads": [2, 0], "ner": [("PER", 0, 1)], "acts": [([], [0.2, 0.4]), ([], [])], "frames": [{"predicate": 1, "args": [("A0", 0, 1)]}]}] * 2)
    assert [t["head"] for t in flat["tokens"]] == [1, None, 3, None] and [t["word"] for t in flat["tokens"]] == [0, 1, 2, 3]
    assert flat["acts"] == [{"sentence": k, "label": "NONE", "confidence": 0.4, "scores": [0.2, 0.4]} for k in (0, 1)]
    assert flat["frames"][1] == {"predicate": 3, "roles": [("A0", 2, 2)]} and flat["entities"][1]["first"] == 2 and flat["sentences"][1] == {"first": 2, "last": 3, "start": 0, "end": 7}


def filtered_png(pixels, kind):
    """A PNG whose rows are all coded by one filter."""
    import struct
    import zlib

    rows, columns, channels = pixels.shape
    p = np.zeros((rows + 1, columns + 1, channels), int)
    p[1:, 1:] = pixels
    lines = b""
    for y in range(1, rows + 1):
        row = []
        for x, c in itertools.product(range(1, columns + 1), range(channels)):
            left, up, corner = p[y, x - 1, c], p[y - 1, x, c], p[y - 1, x - 1, c]
            guess = left + up - corner
            paeth = min((left, up, corner), key=lambda v: abs(guess - v))
            row.append((p[y, x, c] - (0, left, up, (left + up) // 2, paeth)[kind]) % 256)
        lines += bytes([kind, *row])
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", columns, rows, 8, {1: 0, 3: 2, 4: 6}[channels], 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


@pytest.mark.parametrize("kind,channels", list(itertools.product(range(5), (1, 3, 4))))
def test_png_filters(kind, channels):
    pixels = np.random.default_rng(kind).integers(0, 256, (5, 7, channels))
    got = I.read_png(filtered_png(pixels, kind))
    assert (got == (np.repeat(pixels, 3, 2) if channels == 1 else pixels[..., :3])).all()
    assert (I.read_png(I.write_png(pixels)) == got).all()


def test_resizing_and_packing():
    flat = np.full((10, 20, 3), 77, np.uint8)
    assert (I.resize(flat, 4, 33) == 77).all() and I.resize(flat, 10, 20) is flat
    ramp = np.repeat(np.linspace(0, 240, 64).astype(np.uint8)[None, :, None], 3, 2).repeat(8, 0)
    small = I.resize(ramp, 8, 16)[0, :, 0].astype(int)
    assert (np.diff(small) > 0).all() and abs(small[8] - ramp[0, 34, 0]) <= 4
    lines = I.text_lines([flat, flat[:, :5]], 10, 40)
    assert lines.shape == (2, 3, 10, 40) and (lines[0, :, :, 20:] == 0).all() and (lines[1, :, :, 5:] == 0).all() and np.allclose(lines[0, :, :, :20], (77 / 255 - 0.5) / 0.5)
    assert I.patch_mean([[1, 3], [3, 5]]).tolist() == [2, 4]
    with pytest.raises(ValueError):
        I.read_png(b"GIF89a")


def test_running_sums_and_places(spark):
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 9, 50):
        x, v = rng.integers(0, 9, n).tolist(), rng.integers(0, 9, 7).tolist()
        row = spark.createDataFrame([(x, sorted(x), v)], "x array<bigint>, a array<bigint>, v array<bigint>")
        got = row.select(running_sums(F.col("x")).alias("s"), places_below(F.col("a"), F.col("v")).alias("p")).first()
        assert got.s == [sum(x[:i]) for i in range(n)] and got.p == [sum(a < y for a in x) for y in v]


class Slow(base.Provider):
    provider_id = "local/slow"
    tasks = ("embed",)

    def load(self, task, model_id, options):
        return self

    def run(self, batch):
        time.sleep(float(batch[0]))
        return [[1.0]] * len(batch)

    def verify(self):
        if self.refuse:
            raise PermissionError("refused")
        time.sleep(0.2)

    refuse = False


def test_verification_is_bounded_and_ordered():
    slow = base.register(Slow())
    r = Runtime.build([{"alias": f"embed/s{k}", "task": "embed", "provider_id": "local/slow", "model_id": f"v{k}"} for k in range(16)])
    t = time.perf_counter()
    out = r.verify()
    assert out == [(a, None) for a in r.aliases()] and 0.3 < time.perf_counter() - t < 2.5
    assert r.verify("embed/s3", most=0.05) == [("embed/s3", "timeout")]
    assert r.providers() == [("local/slow", 16, "degraded")]
    slow.refuse = True
    assert r.verify("embed/none", "embed/s1")[0][1] == "no alias embed/none" and r.verify("embed/s1") == [("embed/s1", "refused")]


def test_calls_time_out():
    assert _within(None, lambda: 5) == 5 and _within(2, lambda: 6) == 6
    with pytest.raises(CallTimeout):
        _within(0.05, lambda: time.sleep(1))


def test_forbidden_rows_do_not_spread():
    assert N.viterbi_of(np.full((3, 2), FORBIDDEN), ["O", "B-X"]) == [0, 0, 0]
