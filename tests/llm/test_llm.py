"""Every operator against a brute-force version on a small table with the odd cases."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessella.llm import chat, common, exact_dedup, jaccard_join, language_id, licenses, media, mixing, packing, queries, shingles, suffix_dedup, suffix_sort, token_counts, tokens
from tessella.llm.graph import components
from tessella.llm.license_rules import rules

SPACE = r"[\x20\x09-\x0D]+"


def key(r):
    return tuple((x is None, str(x)) for x in r)


def norm(t):
    return re.sub(SPACE, " ", t or "")


# 1 ---------------------------------------------------------------------------------------------


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=40))
def test_suffix_array(x):
    x = [*x, 0]
    assert suffix_sort.suffix_array(np.array(x)) == sorted(range(len(x)), key=lambda i: x[i:])


def removed(rows):
    first = {}
    texts = [(i, (t or "").encode()) for i, t in rows]
    for i, b in texts:
        for s in {b[k:k + 50] for k in range(len(b) - 49)} if i is not None else ():
            first[s] = min(first.get(s, i), i)
    for i, b in texts:
        gone = bytearray(len(b))
        for k in range(len(b) - 49) if i is not None else ():
            if first[b[k:k + 50]] < i:
                gone[k:k + 50] = b"\1" * 50
        spans = sum(1 for k in range(len(gone)) if gone[k] and not (k and gone[k - 1]))
        yield i, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()


def test_suffix_dedup(spark, docs, rows, none):
    got = suffix_dedup.remove_repeats(docs).collect()
    want = list(removed([(r[0], r[1]) for r in rows]))
    assert sorted(map(key, got)) == sorted(map(key, want)) and sum(w[2] for w in want) > 5000
    assert suffix_dedup.remove_repeats(none).count() == 0


def test_suffix_dedup_of_texts_that_share_an_id(spark):
    a, b = "x1" * 40 + "q" * 70, "y2" * 50
    rows = [(1, a), (1, a + b), (2, b + a), (0, "zz" + b[:60]), (2, a)]
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), keep_text=True).collect()
    assert sorted(map(key, (r[:5] for r in got))) == sorted(map(key, removed(rows)))


def test_long_texts_meet_over_pieces(spark, monkeypatch):
    from tessella.llm import anchors

    rng = np.random.default_rng(5)
    text = "".join(map(chr, rng.integers(97, 123, 5000)))
    monkeypatch.setattr(anchors, "PIECE", 700)
    raw, at = np.frombuffer((text + text[100:]).encode(), np.uint8), np.array([0, 5000, 9900])
    doc, start, length, *_ = anchors.anchors(raw, at)
    for d, n in ((0, 5000), (1, 4900)):
        covered = np.zeros(n, bool)
        for s, k in zip(start[doc == d], length[doc == d]):
            covered[s:s + k] = True
        assert covered.all()


# 2 ---------------------------------------------------------------------------------------------


def test_language_id(spark, docs, none):
    rng = np.random.default_rng(0)
    letters = {"aa": "abcdefgh", "bb": "efghijklmn", "cc": "éàüßñopqr"}
    rows = [(i, " ".join("".join(rng.choice(list(letters[lang]), rng.integers(2, 8))) for _ in range(30)), lang) for i in range(240) for lang in [list(letters)[i % 3]]]
    table = spark.createDataFrame([*rows, (900, None, "aa"), (901, "12 ..", None), (902, rows[0][1], None)], "doc_id long, text string, lang string")
    out = {r.doc_id: r for r in table.withColumn("held_out", language_id.held_out(F.col("doc_id"))).transform(lambda t: language_id.identify(t, language_id.learn(table))).collect()}
    held = [r for r in out.values() if r.held_out and r.doc_id < 240]
    assert len(held) > 30 and np.mean([r.lang_pred == r.lang for r in held]) > 0.97
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in out.items())
    assert out[900].lang_pred == out[901].lang_pred == "und" and out[900].score == 0
    assert out[902].lang_pred == out[0].lang_pred and out[902].score == out[0].score
    assert all(0 <= r.score <= 1 for r in out.values())
    learned = language_id.learn(table)
    kept = language_id.accepted(table, learned, 0.05)
    assert kept.columns == table.columns and {r.doc_id for r in kept.collect()} == {i for i, r in out.items() if r.lang_pred != "und" and r.score >= 0.05}
    assert language_id.learn(none) == {} and language_id.identify(none, learned).count() == 0
    assert {r.lang_pred for r in language_id.identify(docs, {}).collect()} == {"und"}


def test_vectors_are_bundles_of_bound_letters():
    s = language_id.Space(64)
    v = lambda t: s.bundle([t])[0]
    grams = ["".join(g) for g in zip(" ab", "abc", "bc ")]
    grams = [" ab", "abc", "bc "]
    want = sum(np.prod([np.roll(s.letter(ord(c)), k) for k, c in enumerate(g)], axis=0).astype(float) for g in grams)
    assert np.allclose(v("abc"), want / np.linalg.norm(want), atol=1e-6) and np.allclose(v("abc"), v("--ABC!"))


# 3 ---------------------------------------------------------------------------------------------


def shingle_set(t, n=5):
    w = (t or "").encode().lower().split()
    return frozenset(tuple(w[i:i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def jaccard_brute(rows):
    sets = [(r[0], shingle_set(r[1])) for r in rows]
    label = list(range(len(sets)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            both = len(a & b)
            if a and b and 100 * both >= 75 * (len(a) + len(b) - both):
                label[root(i)] = root(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(sets):
        least[root(i)].append(d)
    return [(d, len(s), d if not s else min((x for x in least[root(i)] if x is not None), default=None)) for i, (d, s) in enumerate(sets)]


def test_jaccard(docs, rows, none):
    got = [tuple(r)[:3] for r in jaccard_join.jaccard_components(docs).collect()]
    assert sorted(map(key, got)) == sorted(map(key, jaccard_brute(rows)))
    kept = jaccard_join.representatives(docs)
    assert kept.columns == docs.columns
    gone = {d for d, _, c in jaccard_brute(rows) if d is not None and d != c}
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r[0] for r in rows if r[0] not in gone)
    assert jaccard_join.jaccard_components(none).count() == 0


def test_jaccard_chains_and_frequent_shingles(spark, monkeypatch):
    """Chains of edits around the threshold, all on frequent shingles, in lists cut to blocks."""
    import random

    monkeypatch.setattr(jaccard_join, "MEMBERS", 16)
    r = random.Random(3)
    words = [f"w{k}" for k in range(60)]
    rows = []
    for i in range(150):
        w = list(words)
        for _ in range(r.choice([1, 2, 3])):
            w[r.randrange(60)] = f"e{r.randrange(30)}"
        rows.append((i, " ".join(w[:r.choice([60, 60, 50])])))
    got = [tuple(x)[:3] for x in jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got) == sorted(jaccard_brute(rows)) and 1 < len({g[2] for g in got}) < 150


def test_shingle_sets_match_python():
    import pyarrow as pa

    texts = ["", " ", "A b", "a  B", "x y z u v w", "X\tY Z U V W x y z u v w", "\x1cfoo bar", "é É é É é"]
    tokens_, at = shingles.shingle_sets(pa.array(texts))
    ids = [frozenset(tokens_[a:b].tolist()) for a, b in zip(at[:-1], at[1:])]
    want = [shingle_set(t) for t in texts]
    assert [len(x) for x in ids] == [len(x) for x in want]
    assert all((ids[i] == ids[j]) == (want[i] == want[j]) for i in range(len(texts)) for j in range(len(texts)))
    big = pa.array(["q " * 3000 + "end"])
    small = shingles.PIECE
    try:
        shingles.PIECE = 64
        pieces = shingles.shingle_sets(big)[0]
    finally:
        shingles.PIECE = small
    assert (pieces == shingles.shingle_sets(big)[0]).all()


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 2**48 - 1), max_size=30))
def test_packing_of_hashes(xs):
    x = np.array(sorted(set(xs)), np.uint64)
    assert (shingles.unpack48(shingles.pack48(x)) == x).all() and (shingles.unpack_sorted(shingles.pack_sorted(x)) == x).all()


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}


# 4 ---------------------------------------------------------------------------------------------


def test_chat(spark):
    rows = [
        (1, 0, "user", "a", 9), (1, 1, "assistant", "b", 9), (2, 0, "user", "a", 9), (3, 0, "user", "a", 9), (3, 1, "assistant", "b", 9), (3, 2, "user", "c", 9), (4, 0, "user", "a", 9),
        (4, 1, "assistant", "x", 9), (5, 0, " User ", "a", 9), (5, 1, "assistant", "x", 9), (6, 0, None, None, 9), (None, 0, "user", "lone", 9), (None, 0, "user", "lone", 9),
        (None, 3, "user", "other", 9), (7, None, "user", "z", 9), (7, 1, "user", "y", 9), (8, 0, "user", "b", 9), (8, 0, "user", "b", 9),
    ]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, n long")
    got = {r.rendered: (r.conv_id, r.n_turns, r.n_equal, r.n_assistant) for r in chat.format_chats(table).collect()}
    block = lambda *t: "".join(f"<|im_start|>{r}\n{x}<|im_end|>\n" for r, x in t)
    assert got == {
        block(("user", "a"), ("assistant", "b"), ("user", "c")): (3, 3, 1, 1), block(("user", "a"), ("assistant", "x")): (4, 2, 2, 1), block(("user", "")): (6, 1, 1, 0),
        block(("user", "lone")): (None, 1, 1, 0), block(("user", "other")): (None, 1, 1, 0), block(("user", "y"), ("user", "z")): (7, 2, 1, 0), block(("user", "b")): (8, 1, 1, 0),
    }
    assert chat.format_chats(table.limit(0)).count() == 0


# 5 ---------------------------------------------------------------------------------------------


def test_token_ids_are_those_of_the_tokenizers_file():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    enc = tokens.encoder(tokens.default_vocabulary())
    texts = ["", " ", "Hello  world\n\n x", "<|endoftext|>", "é́ ñ 漢字 🙂 ​\x00", "don't   WE'LL 123abc", "\r\n\t a", "a" * 500, "word one " * 9000]
    assert [tokens.encode(enc, x) for x in texts] == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 50), max_size=30))
def test_plan_holds_every_piece_once(hist):
    plan = packing.plan_packs(hist, 64)
    used = Counter()
    for pattern, n in plan:
        assert sum(pattern) <= 64 and n > 0
        for length in pattern:
            used[length] += n
    assert used == Counter(hist)
    total = sum(k * v for k, v in hist.items())
    assert sum(n for _, n in plan) <= 2 * -(-total // 64)


def test_packing(docs, rows, none):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = packing.pack(docs, max_len=256).collect()
    ids = [(r[0], [*t.encode(r[1] or "", add_special_tokens=False).ids, 0]) for r in rows]
    want = Counter((d, a, min(256, len(x) - a), zlib.crc32(np.array(x[a:a + 256], "<u4").tobytes()), len(x)) for d, x in ids for a in range(0, len(x), 256))
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == want
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 256
    assert sorted(by) == list(range(len(by)))
    assert packing.pack(none).count() == 0


# 6 ---------------------------------------------------------------------------------------------


def test_media(docs, rows, none):
    got = media.media_columns(docs, keep_media=True).collect()
    assert len(got) == len(rows)
    payloads = Counter(hashlib.sha256(media.payload_of(r[1] or "")[1]).hexdigest() for r in rows)
    assert Counter(r.payload_sha256 for r in got) == payloads
    for r in got[:12]:
        starts, sizes, per_frame = media.read_index(bytes(r.media))
        back = b"".join(media.decode_grey(bytes(r.media[a:a + n])).tobytes() for a, n in list(zip(starts, sizes))[:20])
        whole = media.decode_frames(np.frombuffer(bytes(r.media), np.uint8), starts, sizes).tobytes()
        assert whole.startswith(back) and len(whole) == r.payload_bytes and len(whole) % 192 == 0 and zlib.crc32(whole[-16:]) == r.tail_crc32
        assert hashlib.sha256(bytes(r.media)).hexdigest() == r.media_sha256 and len(r.media) == r.media_bytes
        assert r.clips[0].first_frame == 0 and r.clips[-1].end_ms == r.payload_bytes // 192 * per_frame // 1000
    assert media.media_columns(none).count() == 0


def test_shots_are_cut_where_the_grey_changes():
    quiet = np.tile(np.arange(192, dtype=np.uint8) % 16 + 64, (6, 1))
    loud = np.tile(np.arange(192, dtype=np.uint8) % 16 + 160, (4, 1))
    assert media.shots(np.concatenate([quiet, loud])) == [(0, 6), (6, 10)] and media.shots(quiet[:1]) == [(0, 1)]
    assert media.clips(media.to_avi(np.concatenate([quiet, loud]).tobytes()))[1]["start_ms"] == 240


@settings(max_examples=30, deadline=None)
@given(st.binary(min_size=192, max_size=192))
def test_frames_are_lossless(raw):
    assert media.decode_grey(media.encode_frames(np.frombuffer(raw, np.uint8).reshape(1, 192))[0].tobytes()).tobytes() == raw


# 7 ---------------------------------------------------------------------------------------------


def targets_brute(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    fixed, total = set(), sum(sizes.values())
    while True:
        left = total - sum(3 * sizes[s] for s in fixed)
        share = sum(w[s] for s in order if s not in fixed)
        t = {s: 3 * sizes[s] if s in fixed else left * w[s] / share for s in order} if share else {s: 3 * sizes[s] for s in fixed}
        above = {s for s in order if s not in fixed and t[s] > 3 * sizes[s]}
        if not above:
            return t
        fixed |= above


def test_mixing(spark, docs, rows, none):
    got = mixing.mix(docs).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert Counter((r.id, r.source, r.size) for r in got) == Counter((r[0], r[3], size(r[1])) for r in rows)
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += size(r[1])
    want = targets_brute(dict(sizes))
    taken, most = Counter(), Counter()
    for r in got:
        assert np.isclose(r.target, want[r.source]) and r.source_size == sizes[r.source] and 0 <= r.copies <= 3 and (r.size or not r.copies)
        taken[r.source] += r.copies * r.size
        most[r.source] = max(most[r.source], r.size)
    assert all(abs(taken[s] - want[s]) <= most[s] for s in want)
    again = mixing.mix(docs.repartition(3)).collect()
    assert Counter((r.id, r.size, r.copies) for r in got) == Counter((r.id, r.size, r.copies) for r in again)
    out = mixing.mixed_rows(common.written(docs))
    assert out.columns == docs.columns and sum(size(r.text) for r in out.collect()) == sum(taken.values())
    assert mixing.mix(none).count() == 0


def test_rounding_is_unbiased_and_keeps_words_over_a_tree(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 8)
    monkeypatch.setattr(mixing, "FAN", 4)
    table = spark.createDataFrame([(i, "w " * (1 + i % 5), "abc"[i % 3]) for i in range(300)], "doc_id long, text string, source string")
    got = mixing.mix(table).collect()
    for s in "abc":
        mine = [r for r in got if r.source == s]
        assert abs(sum(r.copies * r.size for r in mine) - mine[0].target) <= 5 and {r.copies for r in mine} <= {int(mine[0].target / mine[0].source_size), int(mine[0].target / mine[0].source_size) + 1}


# 8 ---------------------------------------------------------------------------------------------


def scan_brute(t):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    text, at, base, found = " ".join(["", *w, ""]), [], set(), set()
    for phrase, label in licenses.BASE.items():
        p = phrase.split()
        places = [i for i in range(len(w)) if w[i:i + len(p)] == p]
        at, base = at + places, base | {label} if places else base
    for label, regex, _, priority in rules():
        for m in re.finditer(rf"(?<= ){regex}(?= )", text):
            a = text[:m.start()].count(" ") - 1
            found.add((label, priority, a, a + m[0].count(" ") + 1))
    kept = {d for d in found if not any(e[2] <= d[2] and e[3] >= d[3] and e[1] >= d[1] and (e[2:] != d[2:] or e[1] > d[1]) for e in found)}
    score = 1.0 if base else max((licenses.CONFIDENCE[d[1]] for d in kept), default=0.0)
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(base | {d[0] for d in kept})), score


LICENCES = [
    "GNU General Public License version 2 or (at your option) any later version; CC BY-NC 4.0 cc by nc", "Copyright (c) 2020 X. All rights reserved. 3-clause BSD license, SPDX-License-Identifier: MIT",
    "GPLv3 gpl 3 only; lgpl 2.1", "CC0 1.0 Universal public domain dedication", "the unlicense; creative commons attribution share alike 3.0", "under the mit license under the mit license",
]


def test_licences(spark, docs, rows, none):
    assert len(rules()) > 300
    got = Counter(tuple(r) for r in licenses.scan(docs).collect())
    assert got == Counter((r[0], *scan_brute(r[1])) for r in rows)
    more = spark.createDataFrame(list(enumerate(LICENCES)), "doc_id long, text string")
    assert sorted(map(tuple, licenses.scan(more).collect())) == [(i, *scan_brute(t)) for i, t in enumerate(LICENCES)]
    assert licenses.scan(none).count() == 0


# 9 ---------------------------------------------------------------------------------------------


def test_token_counts(docs, rows, none):
    enc = tokens.encoder(tokens.default_vocabulary())
    n = sorted(len(tokens.encode(enc, r[1] or "")) for r in rows)
    table = token_counts.length_table(token_counts.encoded_lengths(docs))
    got = {r.context_limit: r for r in table.collect()}
    assert sorted(got) == sorted(set(n))
    for limit, r in got.items():
        over = [x for x in n if x > limit]
        cut = sum(min(x, limit) for x in n)
        assert (r.n_docs, r.docs_over, r.tokens_over, r.total_docs, r.total_tokens, r.truncated_tokens, r.lost_tokens) == (n.count(limit), len(over), sum(over), len(n), sum(n), cut, sum(n) - cut)
        assert np.isclose(r.quantile, 1 - len(over) / len(n))
    for limit in (0, 3, 1024, 10**6):
        assert token_counts.truncated_total(table, limit) == sum(min(x, limit) for x in n)
    assert token_counts.quantile(table, 0.5) == n[-(-len(n) // 2) - 1]
    assert token_counts.length_table(token_counts.encoded_lengths(none)).count() == 0


# 10 --------------------------------------------------------------------------------------------


def test_exact_dedup(docs, rows, none):
    out = exact_dedup.exact_dedup(docs)
    groups = defaultdict(list)
    for r in rows:
        groups[norm(r[1])].append(r[0])
    got = out.collect()
    want = Counter((r[0], min((x for x in groups[norm(r[1])] if x is not None), default=None), len(groups[norm(r[1])]), hashlib.sha256(norm(r[1]).encode()).hexdigest()) for r in rows)
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    kept = Counter(norm(r.text) for r in got if r.kept)
    assert set(kept.values()) == {1} and set(kept) == set(groups)
    assert all(r.doc_id == r.keep_id for r in got if r.kept)
    assert exact_dedup.exact_dedup(none).count() == 0


def test_a_full_filter_still_gives_exact_groups(docs, rows, monkeypatch):
    monkeypatch.setattr(exact_dedup, "MIN_BITS", 13)
    monkeypatch.setattr(exact_dedup, "MAX_BITS", 13)
    monkeypatch.setattr(exact_dedup, "_cells", lambda h, bits: (h.astype(np.uint64)[:, None] % np.uint64(3)) + np.arange(exact_dedup.PROBES, dtype=np.uint64)[None])
    got = exact_dedup.exact_dedup(docs).collect()
    assert Counter(r.group_size for r in got) == Counter(Counter(norm(x[1]) for x in rows)[norm(r[1])] for r in rows)


# all -------------------------------------------------------------------------------------------


def test_every_operator_is_registered_once():
    numbers = [int(re.match(r"op(\d+)_", q)[1]) for q in queries.QUERIES]
    assert sorted(numbers) == list(range(1, 11)) and set(queries.ORACLES) <= set(queries.QUERIES)


def test_shared_folder_is_the_sessions(spark):
    class Session:
        class conf:
            get = staticmethod(lambda name, other=None: {"spark.checkpoint.dir": "viewfs://store/shared/"}.get(name, other))

    assert common.shared_dir(Session) == "viewfs://store/shared"
    assert common.written(spark.range(3), "t").count() == 3


def test_pipeline(spark, docs, rows):
    pipeline = pytest.importorskip("corpus_pipeline")
    table = docs.select("doc_id", "text", "lang", "source", "n_chars").transform(common.written)
    seen = {}
    for name, stage in pipeline.STAGES:
        before, table = table, common.written(stage(spark, table, ""), "stage")
        seen[name] = (before, table)
        if name != "packing":
            assert table.columns == before.columns
    rejected = seen["language id"][0].exceptAll(seen["language id"][1]).collect()
    assert {r.doc_id for r in rejected} >= {3, 4, 5, 8}
    texts = [norm(r.text) for r in seen["exact dedup"][1].collect()]
    assert len(texts) == len(set(texts)) and set(texts) == {norm(r.text) for r in seen["exact dedup"][0].collect()}
    into = [(r.doc_id, r.text) for r in seen["n-gram jaccard join"][0].collect()]
    keep = Counter(d for d, _, c in jaccard_brute(into) if d == c or d is None)
    assert Counter(r.doc_id for r in seen["n-gram jaccard join"][1].collect()) == keep
    mixed = Counter(r.text for r in seen["mixing"][1].collect())
    assert set(mixed) <= {r.text for r in seen["mixing"][0].collect()} and max(mixed.values()) <= 3
    assert seen["packing"][1].where("start = 0").count() == sum(mixed.values())


def test_pipeline_keeps_short_clean_documents(spark):
    """One to four words have a low cosine in any language; long texts like no language still go."""
    pipeline = pytest.importorskip("corpus_pipeline")
    rng = np.random.default_rng(1)
    words = ["".join(rng.choice(list("etaoinshrdlu"), rng.integers(2, 8))) for _ in range(400)]
    learnt = [(i, " ".join(rng.choice(words, 60)), "en") for i in range(120)]
    short = [(200 + i, t, "en") for i, t in enumerate(["Avec.", "A.", "Gym by wyvern.", "A.\nAll rights reserved.", "Zephyr", "Re."])]
    other = [(300, "".join(map(chr, rng.integers(0x4E00, 0x9000, 2000))), None), (301, "12 ..", None), (302, None, None)]
    table = common.written(spark.createDataFrame([*learnt, *short, *other], "doc_id long, text string, lang string"))
    kept = {r.doc_id for r in pipeline.known_language(spark, table, "").collect()}
    assert kept == {r[0] for r in [*learnt, *short]}
    scores = {r.doc_id: r.score for r in language_id.identify(table, language_id.learn(table)).collect()}
    assert min(scores[r[0]] for r in short) < 0.15


def test_added_tokens_are_those_of_the_tokenizers_file(spark, monkeypatch):
    """Texts that hold <|endoftext|>, by the file as it is: ids, packing's digests and token counts."""
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert {x.content: i for i, x in t.get_added_tokens_decoder().items()} == tokens.ADDED
    end = "<|endoftext|>"
    texts = [f"one{end}two", f"a {end} b\n\n{end}", end * 3, "<|endoftext|", f"<|endof{end}text|>", f"{'word one ' * 9000}{end}{'tail ' * 20000}", "none", ""]
    want = [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
    enc = tokens.encoder(tokens.default_vocabulary())
    assert want[0] == [505, 50256, 11545] and [tokens.encode_whole(enc, x) for x in texts] == want
    monkeypatch.setattr(tokens, "SLICE", 16)
    assert [tokens.encode_whole(enc, x) for x in texts] == want
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.doc_id, r.start): (r.doc_tokens, r.ids_crc32) for r in packing.pack(table).collect()}
    ids = [[*x, 0] for x in want]
    assert got == {(i, a): (len(x), zlib.crc32(np.array(x[a:a + 1024], "<u4").tobytes())) for i, x in enumerate(ids) for a in range(0, len(x), 1024)}
    assert Counter(r.n_tokens for r in token_counts.encoded_lengths(table).collect()) == Counter(map(len, want))


@pytest.mark.parametrize("block", [1024, 16])
def test_jaccard_counts_every_link(spark, docs, rows, monkeypatch, block):
    """A large group of near copies, chains around the threshold and the odd rows: links of every class."""
    import random

    monkeypatch.setattr(jaccard_join, "COUNT_MEMBERS", block)
    monkeypatch.setattr(jaccard_join, "COUNT_STEP", 64)
    r = random.Random(5)
    base, more = [f"w{k}" for k in range(60)], []
    for i in range(120):
        w = list(base)
        for _ in range(r.choice([0, 1, 1, 2, 3])):
            w[r.randrange(60)] = f"e{r.randrange(30)}"
        more.append((1000 + i, " ".join(w[:r.choice([60, 60, 50])])))
    table = docs.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string"))
    every = [(x[0], shingle_set(x[1])) for x in [*rows, *more]]
    similar = lambda a, b: a != b and 4 * len(a & b) >= 3 * len(a | b)
    classes = {s for d, s in every if s}
    want = Counter((d, sum(similar(s, x) for x in classes) if s else 0) for d, s in every)
    got = jaccard_join.jaccard_components(table).collect()
    known = {x[0] for x in rows} - {None}
    assert Counter((x.doc_id, x.n_links) for x in got if x.doc_id is not None) == Counter({k: v for k, v in want.items() if k[0] is not None})
    assert max(x.n_links for x in got) > 30 and known < {x.doc_id for x in got}


def test_representatives_of_rows_that_share_an_id(spark):
    """A clean row stays though another row of its id goes; of near copies with one smallest id one stays."""
    w = [f"w{k}" for k in range(60)]
    near = lambda k, at=30: " ".join([*w[:at], f"e{k}", *w[at + 1:]])
    other = [" ".join(f"{c}{k}" for k in range(60)) for c in "xyz"]
    rows = [(1, near(0)), (5, near(1)), (5, other[0]), (5, ""), (2, other[1]), (2, other[1] + " tail"), (2, None), (7, other[2]), (7, other[2]), (None, near(2))]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter(map(tuple, jaccard_join.representatives(table).collect()))
    one = [x for x in got if x[0] == 2 and x[1]]
    assert len(one) == 1 and one[0] in rows and got[one[0]] == 1
    del got[one[0]]
    assert got == Counter([(1, near(0)), (5, other[0]), (5, ""), (2, None), (7, other[2]), (7, other[2]), (None, near(2))])


def test_a_shot_may_end_after_the_first_frame():
    a, b = np.zeros((1, 192), np.uint8), np.full((1, 192), 255, np.uint8)
    assert media.shots(np.concatenate([a, b])) == [(0, 1), (1, 2)] and media.shots(np.concatenate([a, b, b, b])) == [(0, 1), (1, 4)]
    assert media.shots(np.concatenate([a, a, b, b])) == [(0, 2), (2, 4)] and media.shots(np.concatenate([a, a])) == [(0, 2)]
    assert [c["frames"] for c in media.stored("a" * 192 + "\x01" * 192)["clips"]] == [1, 1]


def test_jaccard_links_through_a_text_without_an_id(spark):
    w = [f"w{k}" for k in range(60)]
    cut = lambda a, b: " ".join(w[a:b])
    rows = [(1, cut(0, 50)), (None, cut(5, 55)), (2, cut(10, 60)), (None, "alone " + " ".join(f"z{k}" for k in range(20)))]
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((key(x[:3]) for x in got)) == sorted(map(key, jaccard_brute(rows)))
    assert {x.component_id for x in got if x.doc_id} == {1} and max(x.n_links for x in got) == 2


def jpeg_of(planes, factors, restart=0):
    """A baseline JPEG made bit by bit, with AC coefficients, by flat 8-bit Huffman codes."""
    import struct

    rows, cols = planes[0].shape
    most_h, most_v = max(h for h, _ in factors), max(v for _, v in factors)
    basis = media._cosines()
    flat = lambda k: bytes([k, *[0] * 7, 255, *[0] * 8]) + bytes(range(255))  # noqa: E731  symbol s has the code s, 8 bits
    head = b"\xff\xd8" + media._segment(0xDB, b"\x00" + bytes([2] * 64)) + media._segment(0xC4, flat(0)) + media._segment(0xC4, flat(0x10))
    head += media._segment(0xC0, struct.pack(">BHHB", 8, rows, cols, len(planes)) + b"".join(bytes([k + 1, h << 4 | v, 0]) for k, (h, v) in enumerate(factors)))
    head += media._segment(0xDD, struct.pack(">H", restart)) if restart else b""
    head += media._segment(0xDA, bytes([len(planes), *(x for k in range(len(planes)) for x in (k + 1, 0)), 0, 63, 0]))
    across, down = -(-cols // (8 * most_h)), -(-rows // (8 * most_v))
    out, bits, last, marker = b"", "", [0] * len(planes), 0

    def number(v):
        s = abs(v).bit_length()
        return s, f"{(v if v > 0 else v + (1 << s) - 1):0{s}b}" if s else ""

    def flush():
        nonlocal bits
        bits += "1" * (-len(bits) % 8)
        raw = int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\x00") if bits else b""
        bits = ""
        return raw

    for unit in range(across * down):
        if restart and unit and unit % restart == 0:
            out += flush() + bytes([0xFF, 0xD0 + marker % 8])
            marker, last = marker + 1, [0] * len(planes)
        r, c = divmod(unit, across)
        for k, (h, v) in enumerate(factors):
            small = planes[k].reshape(rows // (most_v // v), most_v // v, cols // (most_h // h), most_h // h)[:, 0, :, 0].astype(float)
            small = np.pad(small, ((0, down * v * 8 - small.shape[0]), (0, across * h * 8 - small.shape[1])), mode="edge")
            for y in range(v):
                for x in range(h):
                    a, b = (r * v + y) * 8, (c * h + x) * 8
                    q = np.rint(basis.T @ (small[a:a + 8, b:b + 8] - 128) @ basis / 2).astype(int).ravel()[list(media.ZIGZAG)]
                    s, e = number(int(q[0]) - last[k])
                    last[k] = int(q[0])
                    bits += f"{s:08b}{e}"
                    zeros = 0
                    for i in range(1, 64):
                        if not q[i:].any():
                            bits += f"{0:08b}"
                            break
                        if q[i] == 0:
                            zeros += 1
                            continue
                        while zeros > 15:
                            bits, zeros = bits + f"{0xF0:08b}", zeros - 16
                        s, e = number(int(q[i]))
                        bits, zeros = bits + f"{zeros << 4 | s:08b}{e}", 0
    return head + out + flush() + b"\xff\xd9"


@pytest.mark.parametrize("factors,restart", [([(1, 1)], 0), ([(1, 1)], 3), ([(2, 2), (1, 1), (1, 1)], 0), ([(2, 1), (1, 1), (1, 1)], 2)])
def test_any_baseline_jpeg_is_decoded(factors, restart):
    rng = np.random.default_rng(7)
    smooth = lambda: (np.add.outer(np.arange(48) * 3, np.arange(64) * 2) + rng.integers(0, 40, (48, 64))) % 256
    most_h, most_v = max(h for h, _ in factors), max(v for _, v in factors)
    planes = [smooth()[::most_v // v, ::most_h // h].repeat(most_v // v, 0).repeat(most_h // h, 1) for h, v in factors]
    got = media.decode_jpeg(jpeg_of(planes, factors, restart))
    assert len(got) == len(planes) and all(np.abs(a.astype(int) - b).max() <= 5 for a, b in zip(got, planes))


def test_foreign_frames_and_absolute_indexes_are_read():
    rng = np.random.default_rng(8)
    frames = rng.integers(0, 256, (3, 96, 128))
    jpegs = [np.frombuffer(jpeg_of([f], [(1, 1)]), np.uint8) for f in frames]
    avi = bytearray(media.write_avi(np.concatenate(jpegs), np.array([len(j) for j in jpegs])))
    starts, sizes, _ = media.read_index(avi)
    means = media.decode_frames(np.frombuffer(avi, np.uint8), starts, sizes)
    assert np.abs(means - frames.reshape(3, 12, 8, 16, 8).mean(axis=(2, 4)).reshape(3, -1)).max() <= 2
    at = avi.index(b"idx1") + 8
    for k in range(3):  # the same index, counted from the start of the file
        avi[at + 16 * k + 8:at + 16 * k + 12] = (int(starts[k]) - 8).to_bytes(4, "little")
    assert media.read_index(avi)[0].tolist() == starts.tolist()


def test_media_of_a_long_text_is_made_in_blocks(monkeypatch):
    text = "".join(chr(97 + i % 23) for i in range(100_000))
    whole = media.stored(text)
    monkeypatch.setattr(media, "BLOCK", 7)
    assert media.stored(text) == whole and whole["payload_sha256"] == hashlib.sha256(media.payload_of(text)[1]).hexdigest()


def shots_brute(frames):
    """The rule of cuts, frame by frame."""
    hist = [Counter(int(x) >> 4 for x in f) for f in frames]
    d = [sum(abs(hist[i + 1][k] - hist[i][k]) for k in range(16)) for i in range(len(frames) - 1)]
    edges = [0]
    for i, x in enumerate(d):
        before = d[max(0, i - media.MEMORY):i]
        if x >= media.FLOOR and (not before or x * len(before) > media.FACTOR * sum(before)):
            edges.append(i + 1)
    return list(zip(edges, [*edges[1:], len(frames)]))


def test_shots_by_brute_force():
    rng = np.random.default_rng(9)
    for _ in range(30):
        levels = np.repeat(rng.integers(0, 240, 6), rng.integers(1, 14, 6))
        frames = np.clip(levels[:, None] + rng.integers(0, rng.integers(2, 60), (len(levels), 192)), 0, 255).astype(np.uint8)
        assert media.shots(frames) == shots_brute(frames)
        rows = media.clips(media.to_avi(frames.tobytes()))
        assert [(r["first_frame"], r["first_frame"] + r["frames"]) for r in rows] == shots_brute(frames)
        assert [r["mean_grey"] for r in rows] == [int(frames[a:b].sum()) // ((b - a) * 192) for a, b in shots_brute(frames)]


def test_a_shared_folder_is_needed_on_a_cluster():
    class Session:
        class conf:
            get = staticmethod(lambda name, other=None: other)

        class sparkContext:
            master = "spark://host:7077"
            getConf = staticmethod(lambda: {})
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.shared_dir(Session)


def test_scratch_tables_are_removed(spark):
    with common.scratch(spark):
        path = common.written(spark.range(3), "gone").inputFiles()[0]
        assert __import__("os").path.exists(path.removeprefix("file://"))
    assert not __import__("os").path.exists(path.removeprefix("file://"))


def shortest(pattern):
    """A short text that a rule's regex matches."""
    from re import _constants as C
    from re import _parser as P

    def of(items):
        out = ""
        for op, arg in items:
            if op is C.LITERAL:
                out += chr(arg)
            elif op is C.IN:
                kind, x = arg[0]
                out += chr(x) if kind is C.LITERAL else chr(x[0]) if kind is C.RANGE else {C.CATEGORY_DIGIT: "7", C.CATEGORY_NOT_SPACE: "x"}[x]
            elif op is C.MAX_REPEAT:
                out += of(arg[2]) * arg[0]
            elif op is C.SUBPATTERN:
                out += of(arg[3])
            elif op is C.BRANCH:
                out += of(arg[1][0])
            else:
                raise AssertionError(op)
        return out

    return of(P.parse(pattern))


def test_every_rule_is_found_behind_its_keyword(spark):
    """A text for each rule, as written and hidden in longer words: gate, keywords and rules agree with a plain scan."""
    from tessella.llm import license_rules as L

    assert len({r[1] for r in [*L.NAMED, *L.WORDING]} | set(L.TAGGED)) >= 250
    samples = [shortest(r[1]) for r in rules()]
    for (label, regex, keyword, _), t in zip(rules(), samples):
        assert re.fullmatch(regex, t), (label, regex, t)
        assert re.search(rf"(?:^| )(?:{keyword})", t), (label, regex, keyword)
    texts = [f"Some words, {t.upper() if k % 2 else t}. And x{t}" for k, t in enumerate(samples)]
    got = sorted(map(tuple, licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()))
    assert got == [(i, *scan_brute(t)) for i, t in enumerate(texts)]


def test_predictions_by_brute_force(spark):
    """Languages and scores of every text from vectors made letter by letter, ties and odd texts included."""
    rng = np.random.default_rng(2)
    letters = {"aa": "abcdefgh", "bb": "efghijkl", "cc": "éàüßñop"}
    text = lambda lang, n: " ".join("".join(rng.choice(list(letters[lang]), rng.integers(1, 7))) for _ in range(n))
    rows = [(i, text(list(letters)[i % 3], 1 + i % 12), list(letters)[i % 3]) for i in range(90)] + [(90, None, "aa"), (91, "...", "bb"), (92, "A-b  É\n1", None), (93, "", None)]
    space = language_id.Space()

    def vector(t):
        c = "".join(x if x.isalpha() else " " for x in (t or "").lower())
        c = re.sub(" +", " ", f" {c} ")
        v = np.zeros(language_id.DIM)
        for g in zip(c, c[1:], c[2:]):
            v += np.prod([np.roll(space.letter(ord(x)).astype(float), k) for k, x in enumerate(g)], axis=0)
        n = np.linalg.norm(v)
        return v / n if n and any(x.isalpha() for x in c) else np.zeros(language_id.DIM)

    known = [(vector(t), lang) for i, t, lang in rows if t is not None and lang and zlib.crc32(str(i).encode()) % 4 != 2]
    sums = {lang: sum(v for v, x in known if x == lang) for lang in letters}
    prototypes = {lang: v / np.linalg.norm(v) for lang, v in sums.items()}
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language_id.identify(table, language_id.learn(table)).collect()}
    for i, t, _ in rows:
        v = vector(t)
        cos = {lang: float(v @ p) for lang, p in prototypes.items()}
        best = max(cos, key=cos.get)
        assert got[i].lang_pred == (best if v.any() else "und") and abs(got[i].score - (max(0.0, cos[best]) if v.any() else 0)) < 2e-5


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), max_size=20))
def test_plan_is_shortest_pack_first(hist):
    """Loads of the packs that single pieces make, longest first, each into the pack with the most room that has enough."""
    loads: list[int] = []
    for length in sorted((n for n, c in hist.items() for _ in range(c)), reverse=True):
        k = min(range(len(loads)), key=loads.__getitem__, default=None)
        if k is None or loads[k] + length > 40:
            loads.append(length)
        else:
            loads[k] += length
    plan = packing.plan_packs(hist, 40)
    assert Counter(loads) == Counter({load: sum(n for p, n in plan if sum(p) == load) for load in {sum(p) for p, _ in plan}})


def test_very_long_texts(spark):
    """A text of two megabytes, its copy with a tail, and a short one, through every operator that reads whole texts."""
    rng = np.random.default_rng(3)
    words = np.array(["".join(chr(97 + x) for x in rng.integers(0, 26, 5)) for _ in range(5000)])
    long = " ".join(words[rng.integers(0, 5000, 350_000)])
    rows = [(1, long, "en", "a"), (2, long + " tail", "en", "b"), (3, "short one", "en", "b")]
    table = common.written(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
    one = {r.doc_id: r for r in suffix_dedup.remove_repeats(table).collect()}
    assert (one[1].n_removed, one[2].n_removed, one[2].n_spans) == (0, len(long), 1)
    three = {r.doc_id: r for r in jaccard_join.jaccard_components(table).collect()}
    assert three[1].n_shingles == len(shingle_set(long)) and three[2].component_id == 1 and (three[1].n_links, three[2].class_id) == (1, 2)
    assert {r.lang_pred for r in language_id.identify(table, language_id.learn(table)).collect()} == {"en"}
    assert {r.doc_id: r.payload_bytes for r in media.media_columns(table).collect()}[1] == -(-len(long) // 192) * 192
    assert {r.id: r.size for r in mixing.mix(table).collect()}[2] == 350_001
    assert {r.doc_id: r.n_words for r in licenses.scan(table).collect()}[1] == 350_000
    assert len({r.keep_id for r in exact_dedup.exact_dedup(table).collect()}) == 3
    enc = tokens.encoder(tokens.default_vocabulary())
    n = len(enc.encode_ordinary(long))
    assert max(r.n_tokens for r in token_counts.encoded_lengths(table).where("n_tokens > 9").collect()) >= n
    assert packing.pack(table).where("doc_id = 1").agg(F.sum("length")).first()[0] == n + 1


def test_only_windows_that_documents_share_are_sorted(monkeypatch):
    """Lines between different neighbours, and two passages that differ at their ends: the sort gets what several documents may have."""
    import random

    r = random.Random(8)
    word = lambda n: "".join(r.choice("abcdefghijkl") for _ in range(n))
    lines, passage = [word(30) for _ in range(20)], word(90)
    rows = [(i, "".join(f"{word(30)}{x}{word(30)}" for x in lines) + (f"{word(9)}{passage[i % 3:90 - i % 5]}{word(9)}" if i < 9 else "")) for i in range(40)]
    sizes = []
    sort = suffix_sort.suffix_array
    monkeypatch.setattr(suffix_sort, "suffix_array", lambda x: sizes.append(len(x)) or sort(x))
    ids, segs, texts = pa.array([i for i, _ in rows], pa.int64()), pa.array([0] * len(rows), pa.int64()), pa.array([t for _, t in rows])
    frame = lambda batches: pa.Table.from_batches(list(batches)).to_pandas()
    dealt = frame(suffix_dedup._dealt(4)([pa.record_batch([ids, segs, texts], ["doc_id", "seg", "text"])]))
    found = pd.concat([suffix_dedup._compare(4)(g) for _, g in dealt.groupby("part")])
    asked = found[found["asked"]].groupby("doc")["raw"].agg(list)
    batch = pa.record_batch([ids, segs, texts, pa.array([asked.get(i, []) for i, _ in rows], pa.list_(pa.binary()))], ["doc_id", "seg", "text", "asked"])
    more = pd.concat([suffix_dedup._resolve(g) for _, g in frame(suffix_dedup._fetch(4)([batch])).groupby("part")])
    spans = pd.concat([found[~found["asked"].astype(bool)], more]).groupby("doc")["raw"].agg(list)
    got = [suffix_dedup._cut(0, t, spans.get(i)) for i, t in rows]
    assert [(len(t), n, k, hashlib.sha256(left).hexdigest()) for (_, t), (left, _, n, k, _) in zip(rows, got)] == [w[1:] for w in removed(rows)]
    assert 0 < sum(sizes) < 2000 and sum(n for _, _, n, _, _ in got) > 500


def test_a_hot_gram_is_dealt_by_windows(spark, monkeypatch):
    """One line between different neighbours in every document: more stretches than a task takes."""
    import random

    monkeypatch.setattr(suffix_dedup, "HOT", 5)
    r = random.Random(6)
    line = "the one line that all of these documents have in common"
    near = lambda: "".join(r.choice("xy") for _ in range(r.randrange(3, 30)))
    rows = [(i, f"{near()} {line} {near()}\n{near()}{line[:30]}{near()}") for i in range(60)]
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()
    want = list(removed(rows))
    assert sorted(map(key, got)) == sorted(map(key, want)) and sum(w[2] for w in want) > 2000


def test_pipeline_on_an_empty_table(spark, docs):
    pipeline = pytest.importorskip("corpus_pipeline")
    table = docs.select("doc_id", "text", "lang", "source", "n_chars").limit(0).transform(common.written)
    for name, stage in pipeline.STAGES:
        before, table = table, common.written(stage(spark, table, ""), "stage")
        assert table.count() == 0 and (name == "packing" or table.columns == before.columns)
