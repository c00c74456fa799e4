"""Queries on analysed windows: alignment, decoding of heads, calibration, facts, flat views.

Score matrices are cut out of the embeddings, whole; windows are benchmark passages.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ..functions import decode as DEC
from ..functions import nlp as N
from ..functions import text as T
from ..functions import vector as V
from ..operators import retrieval as R
from ..operators import tags as G


def _emb(spark, d):
    return spark.read.parquet(f"{d}/embeddings.parquet")


def _bench(spark, d):
    return spark.read.parquet(f"{d}/benchmark.parquet").select("item_id", F.split("text", " ").alias("words"))


def _rows(first: int, rows: int, cols: int):
    """rows x cols of the embedding, from a place on."""
    return F.transform(F.sequence(F.lit(0), F.lit(rows - 1)), lambda i: F.slice("embedding", first + 1 + i * cols, cols))


def pieces(text: str, size: int = 4):
    """A stand-in subword encoder: a marker, words in pieces of size bytes, a marker."""
    ids, ranges, at = [1], [(0, 0)], 0
    for w in text.split(" "):
        n = len(w.encode())
        for a in range(0, n, size):
            ids.append(10 + min(size, n - a))
            ranges.append((at + a, at + min(n, a + size)))
        at += n + 1
    return [*ids, 2], [*ranges, (0, 0)]


def align_words(spark, d):
    """First subword and subword end of every word of a passage that 40 subwords leave room for."""

    @F.pandas_udf("limit int, ids int, first array<int>, ends array<int>")
    def run(words: pd.Series) -> pd.DataFrame:
        a = [N.align(list(w), pieces, 40, 2) for w in words]
        return pd.DataFrame({"limit": [x.limit for x in a], "ids": [len(x.ids) for x in a], "first": [x.first for x in a], "ends": [x.ends() for x in a]})

    a = _bench(spark, d).select("item_id", run("words").alias("a"))
    flat = a.select("item_id", "a.limit", "a.ids", F.posexplode(F.arrays_zip(F.col("a.first"), F.col("a.ends").alias("end"))).alias("word", "x"))
    return flat.select("item_id", F.col("limit").cast("long").alias("limit"), F.col("ids").cast("long").alias("ids"), F.col("word").cast("long").alias("word"), F.col("x.first").cast("long").alias("first"), F.col("x.end").cast("long").alias("end"))


def subword_words(spark, d):
    """The word of every subword, as of the last word that starts before the subword ends."""
    w = _bench(spark, d).select("item_id", F.posexplode("words").alias("pos", "w")).withColumn("n", F.octet_length("w"))
    from pyspark.sql.window import Window

    at = F.sum(F.col("n") + 1).over(Window.partitionBy("item_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1))
    w = w.withColumn("at", F.coalesce(at, F.lit(0)))
    tokens = w.where("n > 0").select(F.col("item_id").alias("seq"), F.explode(F.transform(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / 4).cast("int")), lambda k: F.col("at") + F.least((k + 1) * 4, F.col("n")))).alias("end"))
    starts = w.select(F.col("item_id").alias("seq"), (F.col("at") + 1).alias("start"), F.col("pos").alias("sentence"))
    return G.sentence_of(tokens.select("seq", F.col("end").alias("pos")), starts).select("seq", F.col("pos").alias("end"), F.col("sentence").alias("word"))


def encode_labels(spark, d):
    """Label texts of four passages at once, as padded ids."""

    @F.pandas_udf("rows array<int>, width int, padding int")
    def run(texts: pd.Series) -> pd.DataFrame:
        out = [N.encode_labels(list(t), pieces, 0) for t in texts]
        return pd.DataFrame({"rows": [[sum(m) for m in mask] for _, mask in out], "width": [len(ids[0]) for ids, _ in out], "padding": [sum(x == 0 for r in ids for x in r) for ids, _ in out]})

    b = spark.read.parquet(f"{d}/benchmark.parquet").select("item_id", T.labelled("relation", F.col("text"), F.when(F.col("item_id") % 2 == 0, "known")).alias("t"))
    g = b.groupBy(F.floor(F.col("item_id") / 4).alias("call")).agg(F.transform(F.sort_array(F.collect_list(F.struct("item_id", "t"))), lambda s: s["t"]).alias("t"))
    r = g.select("call", run("t").alias("r"))
    return r.select("call", F.array_join(F.transform("r.rows", lambda x: x.cast("string")), ",").alias("sizes"), F.col("r.width").cast("long").alias("width"), F.col("r.padding").cast("long").alias("padding"))


def marker_words(spark, d):
    """Passages with a mention at every seventh word and a turn at every twentieth, rewritten with markers."""

    @F.pandas_udf("words string, at array<int>")
    def run(words: pd.Series) -> pd.DataFrame:
        out = []
        for w in words:
            out.append(N.marked_words(list(w), [[(i, i + 1)] for i in range(0, len(w), 7)], [(i, (i // 20) % 2) for i in range(0, len(w), 20)], ["Ann", "Bob"]))
        return pd.DataFrame({"words": [" ".join(x[0]) for x in out], "at": [[a for m in x[2] for a in m] for x in out]})

    r = _bench(spark, d).select("item_id", run("words").alias("r"))
    return r.select("item_id", "r.words", F.array_join(F.transform("r.at", lambda x: x.cast("string")), ",").alias("at"))


ACTS = ("question", "answer", "order", "claim", "thanks", "other")


def dialog_acts(spark, d):
    """Acts of ten sentences a row by independent logits, and the best one alone."""
    run = F.pandas_udf(lambda m: m.map(lambda x: [",".join(N.labels_above(r, ACTS)[0]) for r in x]), "array<string>")
    e = _emb(spark, d).select("vec_id", F.posexplode(F.arrays_zip(run(_rows(0, 10, 6)).alias("acts"), F.transform(_rows(0, 10, 6), V.argmax_first).alias("best"))).alias("sentence", "x"))
    return e.select("vec_id", F.col("sentence").cast("long").alias("sentence"), "x.acts", T.label_at(F.array(*map(F.lit, ACTS[:5])), F.col("x.best")).alias("best"))


def sentiment(spark, d):
    run = F.pandas_udf(lambda m: m.map(lambda x: [N.best_label(r, ["negative", "neutral", "positive"]) for r in x]), "array<string>")
    return _emb(spark, d).select("vec_id", F.posexplode(run(_rows(0, 16, 4))).alias("sentence", "label")).select("vec_id", F.col("sentence").cast("long").alias("sentence"), "label")


def token_dependencies(spark, d):
    """Four tokens a row: the best head of each (the last of equals), and the best relation at (token, head)."""
    heads = F.transform(_rows(0, 4, 4), V.argmax_last)
    e = _emb(spark, d).select("vec_id", "embedding", F.posexplode(heads).alias("token", "head"))
    relation = V.argmax_last(F.slice("embedding", 17 + F.col("token") * 12 + F.col("head") * 3, F.lit(3)))
    return e.select("vec_id", F.col("token").cast("long").alias("token"), F.when(F.col("head") != F.col("token"), F.col("head")).cast("long").alias("head"), relation.cast("long").alias("relation"))


def greedy_decode(spark, d):
    ids = V.greedy_ids(_rows(0, 8, 8), 3, 7)
    return _emb(spark, d).select("vec_id", F.array_join(F.transform(ids, lambda x: x.cast("string")), ",").alias("ids"))


_TAGS = ["O", "B-PER", "I-PER", "B-ORG", "I-ORG"]


def viterbi(spark, d):
    run = F.pandas_udf(lambda m: m.map(lambda x: DEC.viterbi([list(map(float, r)) for r in x], _TAGS)), "array<int>")
    return _emb(spark, d).select("vec_id", F.array_join(F.transform(run(_rows(0, 12, 5)), lambda x: x.cast("string")), ",").alias("path"))


def tagged_entities(spark, d):
    """Typed spans of the default head over two sentences of six words."""

    @F.pandas_udf("array<struct<label:string,start:int,end:int>>")
    def run(m: pd.Series) -> pd.Series:
        return m.map(lambda x: [dict(zip(("label", "start", "end"), s)) for s in N.tagged_spans([list(map(float, r)) for r in x], [(0, 6), (6, 12)], _TAGS, 0.1)])

    return _emb(spark, d).select("vec_id", F.inline(run(_rows(0, 12, 5)))).select("vec_id", "label", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


def decode_spans(spark, d):
    """Greedy spans of one or two words by margin; four types."""
    spans = [(i, i + k) for i in range(6) for k in (1, 2)]
    run = F.pandas_udf(lambda m: m.map(lambda x: [",".join(map(str, s)) for s in DEC.greedy_spans([list(map(float, r)) for r in x], spans)]), "array<string>")
    return _emb(spark, d).select("vec_id", F.array_join(run(_rows(0, 12, 5)), ";").alias("spans"))


def coref_chains(spark, d):
    """Eight words, each with up to seven antecedents; a chain's spans reach one word to each side."""

    @F.pandas_udf("array<string>")
    def run(m: pd.Series) -> pd.Series:
        def one(x):
            wide = lambda heads: ([[max(h - 1, 0), h, h + 1] for h in heads], [[2.0, 1.0, 5.0]] * len(heads), [[5.0, 1.0, 2.0]] * len(heads))
            return [";".join(f"{a}-{b}" for a, b in c) for c in N.chains([list(map(float, r)) for r in x], [[w - 1 - k for k in range(7)] for w in range(8)], wide, 0.05)]

        return m.map(one)

    return _emb(spark, d).select("vec_id", F.array_sort(run(_rows(0, 8, 8))).alias("chains")).select("vec_id", F.array_join("chains", "|").alias("chains"))


_ROLES = ["O", "V", "B-A0", "I-A0"]


def role_frames(spark, d):
    """Six words, whose first twelve numbers say which are predicates; the rest are role scores, the same for each predicate."""

    @F.pandas_udf("array<struct<predicate:int,args:string>>")
    def run(v: pd.Series) -> pd.Series:
        def one(x):
            x = [float(a) for a in x]
            scores = [x[12 + 8 * i:16 + 8 * i] for i in range(6)]
            frames = N.role_frames([x[2 * i:2 * i + 2] for i in range(6)], lambda p, a, b: scores[a:b], [0, 0, 0, 1, 1, 1], [True] * 6, _ROLES)
            return [{"predicate": f["predicate"], "args": ";".join(f"{n}:{a}-{b}" for n, a, b in f["args"])} for f in frames]

        return v.map(one)

    return _emb(spark, d).select("vec_id", F.inline(run("embedding"))).select("vec_id", F.col("predicate").cast("long").alias("predicate"), "args")


def relation_facts(spark, d):
    """Facts of three entities (six ordered pairs) and nine relations by calibrated margins, the best two a pair."""
    calibration = N.Calibration.load({"rel_offset": 0.02, "rel_offsets": {"r1": -0.05}, "unseen_offset": 0.03, "offset": 0.01}, ["r0", "r1", "r2"]).merged(rel_offsets={"r8": 0.04}, unseen_offset=0.02)

    @F.pandas_udf("array<struct<head:int,tail:int,relation:string,margin:double>>")
    def run(m: pd.Series) -> pd.Series:
        return m.map(lambda x: [{k: f[k] for k in ("head", "tail", "relation", "margin")} for f in N.facts([list(map(float, r)) for r in x], 3, [f"r{k}" for k in range(9)], calibration, 2)])

    f = _emb(spark, d).select("vec_id", F.inline(run(_rows(0, 6, 10))))
    return f.select("vec_id", F.col("head").cast("long").alias("head"), F.col("tail").cast("long").alias("tail"), "relation", F.round("margin", 5).alias("margin"))


def relation_offsets(spark, d):
    """Relation names of a schema against the calibrated ones: a default where there is none."""
    part = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", F.col("p_brand").alias("name"))
    known = part.where("p_partkey % 3 = 0").groupBy("name").agg((F.max("p_partkey") / 1000.0).alias("offset"))
    # one row a brand, of which there are few
    return part.join(known, "name", "left").select("p_partkey", "name", F.round(F.coalesce("offset", F.lit(-0.5)), 6).alias("offset"))


def fact_attributes(spark, d):
    """Polarity, modality, holder and time of a fact from four rows of scores."""

    @F.pandas_udf("polarity string, modality string, holder int, time int")
    def run(v: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([N.attributes(x[0:2], x[2:8], x[8:36], x[36:64]) for x in v], columns=["polarity", "modality", "holder", "time"]).astype({"holder": "Int32", "time": "Int32"})

    a = _emb(spark, d).select("vec_id", run("embedding").alias("a")).select("vec_id", "a.*")
    return a.select("vec_id", "polarity", "modality", F.col("holder").cast("long").alias("holder"), F.col("time").cast("long").alias("time"))


def flat_tokens(spark, d):
    """Passages as two windows each, with a head of the word before and an entity at every fifth word, flattened."""

    @F.pandas_udf("array<struct<start:int,end:int,ner:string,head:int,word:int>>")
    def run(words: pd.Series) -> pd.Series:
        def one(w):
            placed, at = [], 0
            for x in w:
                placed.append((x, at, at + len(x.encode())))
                at += len(x.encode()) + 1
            parts = [p for p in (placed[:10], placed[10:]) if p]
            windows = [{"words": p, "sentences": [(0, len(p))]} for p in parts]
            results = [{"heads": list(range(len(p))), "ner": [("X", a, min(a + 2, len(p))) for a in range(0, len(p), 5)]} for p in parts]
            return [{k: t[k] for k in ("start", "end", "ner", "head", "word")} for t in N.flatten(windows, results)["tokens"]]

        return words.map(one)

    f = _bench(spark, d).select("item_id", F.inline(run("words")))
    return f.select("item_id", F.col("word").cast("long").alias("word"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "ner", F.col("head").cast("long").alias("head"))


def surfaces(spark, d):
    """The bytes of a passage's second to fourth word, or the words where the place is beyond its end."""
    b = spark.read.parquet(f"{d}/benchmark.parquet").select("item_id", "text", F.split("text", " ").alias("w"))
    start = F.octet_length(F.get("w", 0)) + 1 + F.when(F.col("item_id") % 4 == 3, 1 << 20).otherwise(0)
    some = F.slice("w", 2, 3)
    return b.select("item_id", T.surface(F.col("text"), start, start + F.octet_length(F.array_join(some, " ")), some).alias("surface"))


def space_class(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", (F.col("p_partkey") % 5 + 95).alias("classes"), F.lit(96).alias("dictionary"))
    s = T.space_class(F.col("classes"), F.col("dictionary"))
    return p.select("p_partkey", s["has_space"].alias("has_space"), s["error"].alias("error"))


def special_tokens(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select("event_id", (F.col("event_id") % 110).alias("token_id"))
    return R.without_special(e)


def chunks(spark, d):
    c = spark.read.parquet(f"{d}/conversations.parquet").select(F.col("conv_id").alias("seq"), F.col("turn").alias("pos"))
    return G.chunked(c, 2).select("seq", "pos", F.col("chunk").cast("long").alias("chunk"))


def mean_normalized(spark, d):
    t = _emb(spark, d).select(F.col("label").alias("id"), "vec_id", F.col("embedding").alias("vector"), (F.col("vec_id") % 3 != 0).alias("mask"))
    p = R.mean_normalized(t).select("id", F.posexplode("vector").alias("dim", "x"))
    return p.select("id", F.col("dim").cast("long").alias("dim"), F.round("x", 5).alias("x"))


def output_selection(spark, d):
    """Named outputs by name, and by a place that some rows do not have."""
    o = _emb(spark, d).select(F.col("vec_id").alias("id"), F.slice(F.transform(F.sequence(F.lit(0), F.lit(2)), lambda k: F.struct(F.concat(F.lit("out"), k.cast("string")).alias("name"), F.get("embedding", k).alias("value"))), F.lit(1), (F.col("vec_id") % 3 + 1).cast("int")).alias("outputs"))
    by_name, by_place = R.select_output(o, "out1").withColumn("how", F.lit("name")), R.select_output(o, index=2).withColumn("how", F.lit("place"))
    return by_name.unionByName(by_place).select("id", "how", F.round(F.col("value").cast("double"), 5).alias("value"), "error")


def probe_agreement(spark, d):
    rows = lambda c: F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice(c, i * 8 + 1, 8))
    e = _emb(spark, d).withColumn("other", F.transform("embedding", lambda x, i: x.cast("double") * (1 + (F.col("vec_id") % 5) * 0.06 * (i % 2))))
    return e.select("vec_id", V.probe_agrees(rows("other"), rows("embedding")).alias("agrees"))


def nan_order(spark, d):
    """Scores by falling total order, in which no number is above NaN."""
    from pyspark.sql.window import Window

    s = _emb(spark, d).select("label", "vec_id", F.when(F.col("vec_id") % 9 == 0, float("nan")).otherwise(F.round(F.get("embedding", 0).cast("double"), 3)).alias("score"))
    return s.select("label", "vec_id", F.row_number().over(Window.partitionBy("label").orderBy(F.desc("score"), "vec_id")).cast("long").alias("rank"))


QUERIES = {f.__name__: f for f in (
    align_words, subword_words, encode_labels, marker_words, dialog_acts, sentiment, token_dependencies, greedy_decode, viterbi, tagged_entities, decode_spans, coref_chains, role_frames,
    relation_facts, relation_offsets, fact_attributes, flat_tokens, surfaces, space_class, special_tokens, chunks, mean_normalized, output_selection, probe_agreement, nan_order,
)}

_W = """WITH w AS (SELECT item_id, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) - 1 AS word FROM benchmark),
b AS (SELECT *, octet_length(encode(w)) AS n, coalesce(sum(octet_length(encode(w)) + 1) OVER (PARTITION BY item_id ORDER BY word ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS ofs FROM w)"""
_ALIGN = _W + """, p AS (SELECT *, (n + 3) // 4 AS k FROM b),
f AS (SELECT *, 1 + coalesce(sum(k) OVER (PARTITION BY item_id ORDER BY word ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS t, (2 + sum(k) OVER (PARTITION BY item_id))::BIGINT AS total FROM p),
g AS (SELECT *, CASE WHEN k > 0 THEN t ELSE -1 END AS first, least(total, 40) AS ids FROM f),
l AS (SELECT *, CASE WHEN total > 40 THEN coalesce(min(CASE WHEN first >= 39 THEN word END) OVER (PARTITION BY item_id), max(word) OVER (PARTITION BY item_id) + 1) ELSE max(word) OVER (PARTITION BY item_id) + 1 END AS "limit" FROM g),
v AS (SELECT *, coalesce(min(CASE WHEN first >= 0 THEN first END) OVER (PARTITION BY item_id ORDER BY word ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), ids - 1) AS following FROM l WHERE word < "limit")"""
_M = "list_transform(range(0, {0}), lambda i: embedding[(i * {1} + 1)::INT:(i * {1} + {1})::INT]::DOUBLE[])"
_BEST = "list_transform({}, lambda r: list_position(r, list_max(r)) - 1)"
#: Viterbi by a recursive table: the scores and the paths of the five tags at each word.
_VITERBI = """, t AS (SELECT vec_id, part, s, m FROM x), lp AS (SELECT vec_id, part, s, list_transform(m, lambda r: list_transform(r, lambda v: v - ln(list_sum(list_transform(r, lambda u: exp(u))))  )) AS lp FROM t),
b AS (SELECT vec_id, part, s, list_transform(lp, lambda r: [r[1] + {bias}, r[2], r[3], r[4], r[5]]) AS lp FROM lp),
v(vec_id, part, s, i, lp, best, path) AS (SELECT vec_id, part, s, 1, lp, [lp[1][1], lp[1][2], lp[1][3] - 1e9, lp[1][4], lp[1][5] - 1e9], [[0], [1], [2], [3], [4]] FROM b
UNION ALL SELECT vec_id, part, s, i + 1, lp, [list_max(best) + lp[i + 1][1], list_max(best) + lp[i + 1][2], greatest(best[2], best[3]) + lp[i + 1][3], list_max(best) + lp[i + 1][4], greatest(best[4], best[5]) + lp[i + 1][5]],
 [path[list_position(best, list_max(best))] || [0], path[list_position(best, list_max(best))] || [1], path[CASE WHEN best[2] >= best[3] THEN 2 ELSE 3 END] || [2], path[list_position(best, list_max(best))] || [3], path[CASE WHEN best[4] >= best[5] THEN 4 ELSE 5 END] || [4]]
 FROM v WHERE i < len(lp)),
z AS (SELECT vec_id, part, s, path[list_position(best, list_max(best))] AS path FROM v WHERE i = len(lp))"""

ORACLES = {
    "align_words": _ALIGN + """ SELECT item_id, "limit", ids, word, first, CASE WHEN first >= 0 AND first < following THEN following ELSE least(greatest(first, 0) + 1, ids) END AS "end" FROM v""",
    "subword_words": _W + ', k AS (SELECT *, unnest(range(0, (n + 3) // 4)) AS k FROM b WHERE n > 0) SELECT item_id AS seq, ofs + least((k + 1) * 4, n) AS "end", word FROM k',
    "encode_labels": """WITH t AS (SELECT item_id, item_id // 4 AS call, 'relation: ' || text || CASE WHEN item_id % 2 = 0 THEN '. known' ELSE '' END AS t FROM benchmark),
n AS (SELECT item_id, call, least(2 + list_sum(list_transform(string_split(t, ' '), lambda w: (octet_length(encode(w)) + 3) // 4)), 48)::BIGINT AS n FROM t)
SELECT call, string_agg(n::VARCHAR, ',' ORDER BY item_id) AS sizes, max(n) AS width, (max(n) * count(*) - sum(n))::BIGINT AS padding FROM n GROUP BY call""",
    "marker_words": """WITH w AS (SELECT item_id, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) - 1 AS i FROM benchmark),
m AS (SELECT *, CASE WHEN i % 20 = 0 THEN CASE WHEN i // 20 % 2 = 0 THEN '* Ann * : ' ELSE '* Bob * : ' END ELSE '' END || CASE WHEN i % 7 = 0 THEN '* ' || w || ' *' ELSE w END AS m FROM w)
SELECT item_id, string_agg(m, ' ' ORDER BY i) AS words, string_agg((i + (i // 20 + 1) * 4 + i // 7 * 2)::VARCHAR, ',' ORDER BY i) FILTER (WHERE i % 7 = 0) AS at FROM m GROUP BY item_id""",
    "dialog_acts": f"""WITH m AS (SELECT vec_id, {_M.format(10, 6)} AS m FROM embeddings), r AS (SELECT vec_id, unnest(m) AS r, generate_subscripts(m, 1) - 1 AS sentence FROM m)
SELECT vec_id, sentence, array_to_string(list_transform(list_filter(list_zip(r, {list(ACTS)}), lambda p: p[1] > 0), lambda p: p[2]), ',') AS acts, {[*ACTS[:5], 'UNK_5']}[list_position(r, list_max(r))] AS best FROM r""",
    "sentiment": f"""WITH m AS (SELECT vec_id, {_M.format(16, 4)} AS m FROM embeddings), r AS (SELECT vec_id, unnest(m) AS r, generate_subscripts(m, 1) - 1 AS sentence FROM m)
SELECT vec_id, sentence, ['negative', 'neutral', 'positive', 'UNK_3'][list_position(r, list_max(r))] AS label FROM r""",
    "token_dependencies": f"""WITH m AS (SELECT vec_id, embedding::DOUBLE[] AS e, {_M.format(4, 4)} AS m FROM embeddings), r AS (SELECT vec_id, e, unnest(m) AS r, generate_subscripts(m, 1) - 1 AS token FROM m),
h AS (SELECT *, 4 - list_position(list_reverse(r), list_max(r)) AS head FROM r), l AS (SELECT *, e[(17 + token * 12 + head * 3)::INT:(19 + token * 12 + head * 3)::INT] AS l FROM h)
SELECT vec_id, token, CASE WHEN head <> token THEN head END::BIGINT AS head, (3 - list_position(list_reverse(l), list_max(l)))::BIGINT AS relation FROM l""",
    "greedy_decode": f"""WITH b AS (SELECT vec_id, {_BEST.format(_M.format(7, 8))} AS b FROM embeddings) SELECT vec_id, array_to_string(CASE WHEN list_contains(b, 3) THEN b[1:list_position(b, 3)] ELSE b END, ',') AS ids FROM b""",
    "viterbi": f"WITH RECURSIVE x AS (SELECT vec_id, 0 AS part, 0 AS s, {_M.format(12, 5)} AS m FROM embeddings)" + _VITERBI.format(bias="0") + " SELECT vec_id, array_to_string(path, ',') AS path FROM z",
    "tagged_entities": f"WITH RECURSIVE y AS (SELECT vec_id, {_M.format(12, 5)} AS m FROM embeddings), x AS (SELECT vec_id, 0 AS part, 0 AS s, m[1:6] AS m FROM y UNION ALL SELECT vec_id, 1, 6, m[7:12] FROM y)" + _VITERBI.format(bias="0.1::DOUBLE") + """,
g AS (SELECT vec_id, part, s + generate_subscripts(path, 1) - 1 AS i, unnest(path) AS k FROM z), o AS (SELECT *, sum((k IN (1, 3))::INT) OVER (PARTITION BY vec_id, part ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM g)
SELECT vec_id, CASE WHEN min(k) < 3 THEN 'PER' ELSE 'ORG' END AS label, min(i)::BIGINT AS start, (max(i) + 1)::BIGINT AS "end" FROM o WHERE k > 0 GROUP BY vec_id, part, run""",
    "decode_spans": f"""WITH RECURSIVE m AS (SELECT vec_id, {_M.format(12, 5)} AS m FROM embeddings), r AS (SELECT vec_id, generate_subscripts(m, 1) - 1 AS k, unnest(m) AS r FROM m),
g AS (SELECT vec_id, k // 2 AS a, k // 2 + k % 2 + 1 AS b, k, list_transform(r[2:5], lambda v: v - r[1]) AS g FROM r),
o AS (SELECT *, list_max(g) AS best, list_position(g, list_max(g)) - 1 AS t, row_number() OVER (PARTITION BY vec_id ORDER BY list_max(g) DESC, k) AS i FROM g),
f(vec_id, i, taken, found) AS (SELECT DISTINCT vec_id, 0::BIGINT, []::BIGINT[], []::VARCHAR[] FROM o
UNION ALL SELECT f.vec_id, o.i, CASE WHEN o.best > 0 AND NOT list_has_any(taken, range(a, b)) THEN taken || range(a, b) ELSE taken END, CASE WHEN o.best > 0 AND NOT list_has_any(taken, range(a, b)) THEN found || [a || ',' || b || ',' || t] ELSE found END
 FROM f JOIN o ON o.vec_id = f.vec_id AND o.i = f.i + 1)
SELECT vec_id, array_to_string(list_sort(found), ';') AS spans FROM f WHERE i = 12""",
    "relation_offsets": "WITH k AS (SELECT p_brand, max(p_partkey) / 1000.0::DOUBLE AS o FROM part WHERE p_partkey % 3 = 0 GROUP BY p_brand) SELECT p_partkey, part.p_brand AS name, round(coalesce(o, -0.5), 6) AS \"offset\" FROM part LEFT JOIN k USING (p_brand)",
    "relation_facts": f"""WITH m AS (SELECT vec_id, {_M.format(6, 10)} AS m FROM embeddings), r AS (SELECT vec_id, generate_subscripts(m, 1) - 1 AS pair, unnest(m) AS r FROM m),
o AS (SELECT vec_id, pair, unnest(range(0, 9)) AS k, r FROM r), g AS (SELECT vec_id, pair, k, r[(k + 2)::INT] - (r[1] + 0.01::DOUBLE) + CASE k WHEN 0 THEN 0.02::DOUBLE WHEN 1 THEN -0.05::DOUBLE WHEN 2 THEN 0.02::DOUBLE WHEN 8 THEN 0.04::DOUBLE ELSE -0.02::DOUBLE END AS margin FROM o),
n AS (SELECT *, row_number() OVER (PARTITION BY vec_id, pair ORDER BY margin DESC, k) AS place FROM g)
SELECT vec_id, [0, 0, 1, 1, 2, 2][(pair + 1)::INT]::BIGINT AS head, [1, 2, 0, 2, 0, 1][(pair + 1)::INT]::BIGINT AS tail, 'r' || k AS relation, round(margin, 5) AS margin FROM n WHERE place <= 2 AND margin > 0""",
    "fact_attributes": f"""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), b AS (SELECT vec_id, list_position(e[1:2], list_max(e[1:2])) AS p, list_position(e[3:8], list_max(e[3:8])) AS m, list_position(e[9:36], list_max(e[9:36])) - 1 AS h, list_position(e[37:64], list_max(e[37:64])) - 1 AS t FROM e)
SELECT vec_id, {list(N.POLARITIES)}[p] AS polarity, {list(N.MODALITIES)}[m] AS modality, CASE WHEN h > 0 THEN h - 1 END::BIGINT AS holder, CASE WHEN t > 0 THEN t - 1 END::BIGINT AS time FROM b""",
    "flat_tokens": _W + """, x AS (SELECT item_id, word, ofs AS start, ofs + n AS "end", CASE WHEN word < 10 THEN 0 ELSE 10 END AS base FROM b)
SELECT item_id, word, start, "end", CASE (word - base) % 5 WHEN 0 THEN 'B-X' WHEN 1 THEN 'I-X' END AS ner, CASE WHEN word > base THEN word - 1 END AS head FROM x""",
    "surfaces": "SELECT item_id, array_to_string(string_split(text, ' ')[2:4], ' ') AS surface FROM benchmark",
    "space_class": "SELECT p_partkey, p_partkey % 5 = 3 AS has_space, CASE WHEN p_partkey % 5 NOT IN (2, 3) THEN 'classes do not fit the dictionary' END AS error FROM part",
    "special_tokens": "SELECT event_id, event_id % 110 AS token_id FROM events WHERE event_id % 110 NOT IN (0, 1, 2, 100, 101, 102, 103)",
    "chunks": "SELECT conv_id AS seq, turn AS pos, turn // 2 AS chunk FROM conversations",
    "mean_normalized": """WITH u AS (SELECT label AS id, vec_id % 3 <> 0 AS mask, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings),
m AS (SELECT id, dim, sum(CASE WHEN mask THEN x ELSE 0 END) / greatest(count(*) FILTER (WHERE mask), 1e-9::DOUBLE) AS x FROM u GROUP BY id, dim)
SELECT id, dim, round(x / greatest(sqrt(sum(x * x) OVER (PARTITION BY id)), 1e-12::DOUBLE), 5) AS x FROM m""",
    "output_selection": """SELECT vec_id AS id, 'name' AS how, CASE WHEN vec_id % 3 >= 1 THEN round(embedding[2]::DOUBLE, 5) END AS value, CASE WHEN vec_id % 3 < 1 THEN 'no output out1' END AS error FROM embeddings
UNION ALL SELECT vec_id, 'place', CASE WHEN vec_id % 3 = 2 THEN round(embedding[3]::DOUBLE, 5) END, CASE WHEN vec_id % 3 < 2 THEN 'output_index 2 out of range' END FROM embeddings""",
    "probe_agreement": f"""WITH m AS (SELECT vec_id, unnest({_M.format(8, 8)}) AS r FROM embeddings),
e AS (SELECT vec_id, sqrt(list_sum(list_transform(range(1, 9), lambda i: CASE WHEN i % 2 = 0 THEN (r[i::INT] * (vec_id % 5) * 0.06::DOUBLE) ^ 2 ELSE 0 END))) / greatest(sqrt(list_inner_product(r, r)), 1e-6) AS e FROM m)
SELECT vec_id, max(e) <= 0.2 AS agrees FROM e GROUP BY vec_id""",
    "nan_order": "WITH s AS (SELECT label, vec_id, CASE WHEN vec_id % 9 = 0 THEN 'nan'::DOUBLE ELSE round(embedding[1]::DOUBLE, 3) + 0.0 END AS score FROM embeddings) SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS rank FROM s",
}
