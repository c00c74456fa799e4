"""Queries on texts, numbers, names, pages of markup and page tiers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import docparse as D
from ..functions import text as T
from ..operators import pages as P


def _docs(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text", "source")


def _doubled(spark, d):
    return _docs(spark, d).withColumn("text", F.replace("text", F.lit("\n"), F.lit("\n\n")))


def text_quality(spark, d):
    t = F.col("text")
    r = lambda c, n: F.round(c, 6).alias(n)
    return _docs(spark, d).select("doc_id", r(T.text_coverage(t), "coverage"), r(T.garble_ratio(t), "garble"), T.is_usable(t).alias("usable"))


def repetition_ratio(spark, d):
    return _docs(spark, d).select("doc_id", F.round(T.repetition_ratio(F.col("text")), 6).alias("ratio"))


def paragraphs(spark, d):
    return _doubled(spark, d).select("doc_id", F.inline(T.paragraphs(F.col("text"))))


def trimmed_paragraphs(spark, d):
    return _doubled(spark, d).select("doc_id", F.posexplode(T.trimmed_paragraphs(F.col("text"))).alias("pos", "p")).select("doc_id", F.col("pos").cast("long").alias("pos"), "p")


def parse_numbers(spark, d):
    return _docs(spark, d).select("doc_id", F.posexplode(T.number_strings(F.col("text"))).alias("pos", "s")).select("doc_id", F.col("pos").cast("long").alias("pos"), "s", T.number_value(F.col("s")).alias("value"))


def numeric_guard(spark, d):
    """A document's numbers against its neighbour's; every other neighbour quotes the document."""
    docs = _docs(spark, d).select("doc_id", "text")
    near = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("near"))
    known = F.when(F.col("doc_id") % 2 == 0, F.concat_ws(" ", "near", "text")).otherwise(F.coalesce("near", F.lit("")))
    j = docs.join(near, "doc_id", "left").withColumn("known", known)
    t, k = F.col("text"), F.col("known")
    return j.select("doc_id", F.size(T.numbers(t)).cast("long").alias("n"), F.size(T.unmatched_numbers(t, k)).cast("long").alias("unmatched"), F.round(T.divergence(t, k), 6).alias("divergence"))


def split_clitics(spark, d):
    """Every word of the benchmark with a clitic by its length, split again."""
    w = spark.read.parquet(f"{d}/benchmark.parquet").select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("w")).where("w <> ''").distinct()
    tails = F.array(F.lit(""), *map(F.lit, T.CLITICS), F.lit("'S"), F.lit("N'T"))
    w = w.select(F.concat("w", F.element_at(tails, (F.length("w") % 10 + 1).cast("int"))).alias("token"))
    p = T.split_clitic(F.col("token"))
    return w.select("token", p[0].alias("stem"), F.coalesce(F.get(p, F.lit(1)), F.lit("")).alias("clitic"))


def lemma_scripts(spark, d):
    w = spark.read.parquet(f"{d}/benchmark.parquet").select(F.explode(F.split("text", "[^A-Za-z]+")).alias("w")).where("w <> ''").distinct()
    scripts = F.array(*map(F.lit, ["l|2|e", "|0|", "l|9|x", "|1|ing", "bad", "|x|s"]))
    w = w.withColumn("script", F.element_at(scripts, (F.length("w") % 6 + 1).cast("int")))
    return w.select("w", "script", T.apply_lemma_script(F.col("w"), F.col("script")).alias("lemma"))


def names_compatible(spark, d):
    """Part names with their neighbours' and with an acronym of their own."""
    p = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", F.split(F.initcap("p_name"), " ").alias("a"))
    q = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("a").alias("b"))
    j = p.join(q, "p_partkey").withColumn("b", F.when(F.col("p_partkey") % 3 == 0, F.array(F.array_join(F.transform("a", lambda t: F.substring(t, 1, 1)), "."))).when(F.col("p_partkey") % 3 == 1, F.slice("a", 2, 1)).otherwise(F.col("b")))
    return j.select("p_partkey", T.names_compatible(F.col("a"), F.col("b")).alias("compatible"))


def redact_url(spark, d):
    u = spark.read.parquet(f"{d}/pages.parquet").select("page_id", F.when(F.col("page_id") % 2 == 0, F.replace("url", F.lit("://"), F.lit("://user:p@ss@"))).otherwise(F.col("url")).alias("url"))
    return u.select("page_id", T.redact_url(F.col("url")).alias("url"))


def sanitize_model_name(spark, d):
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", T.safe_name(F.col("url")).alias("name"))


def plan_input(spark, d):
    t = _docs(spark, d).select("doc_id", F.split("text", " ").alias("w"), "text")
    p = T.plan_input(F.col("w"), 64)
    return t.select("doc_id", T.needs_tokenizing(F.col("text"), 512).alias("tokenize"), F.size(p).cast("long").alias("n"), F.element_at(p, -1).alias("last"))


def rerank_prompt(spark, d):
    q = F.lit("Is this a licence?")
    return _docs(spark, d).select("doc_id", F.md5(T.rerank_prompt("Answer yes or no.", F.lit("Judge."), q, F.col("text")).cast("binary")).alias("md5"))


_MARKS = ["", "# ", "## ", "- ", "| ", "![", "$$", "1. ", "#"]


def _marked(spark, d):
    p = _docs(spark, d).select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "p"))
    mark = F.element_at(F.array(*map(F.lit, _MARKS)), ((F.col("doc_id") + F.col("pos")) % len(_MARKS) + 1).cast("int"))
    return p.select("doc_id", "pos", F.concat(mark, "p", F.when(mark == "$$", "$$").when(mark == "![", "](x.png)").otherwise("")).alias("p"))


def md_blocks(spark, d):
    pages = _marked(spark, d).groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "p"))), lambda s: s["p"]), "\n\n").alias("md"))
    b = pages.select("doc_id", F.inline(D.parse_markdown(F.col("md"))))
    return b.select("doc_id", F.col("reading_order").cast("long").alias("reading_order"), "kind", "content")


def render_markdown(spark, d):
    pages = _marked(spark, d).groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "p"))), lambda s: s["p"]), "\n\n").alias("md"))
    return pages.select("doc_id", F.md5(D.markdown_of(D.parse_markdown(F.col("md"))).cast("binary")).alias("md5"))


def doctags_blocks(spark, d):
    """Every line of a document in a tag of its own, with a place; read back as blocks."""
    tags = ["heading", "text", "list", "table", "figure", "formula", "caption", "footer", "header", "title", "x"]
    line = F.regexp_replace("p", "[<>]", "")
    p = _docs(spark, d).select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "p")).withColumn("tag", F.element_at(F.array(*map(F.lit, tags)), (F.col("pos") % len(tags) + 1).cast("int")))
    tagged = F.concat(F.lit("<"), "tag", F.lit(' loc="0,'), "pos", F.lit(',10,20.5">'), line, F.lit("</"), "tag", F.lit(">"))
    pages = p.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", tagged.alias("t")))), lambda s: s["t"]), "\n").alias("page"))
    b = pages.select("doc_id", F.inline(D.parse_doctags(F.col("page"))))
    return b.select("doc_id", F.col("reading_order").cast("long").alias("reading_order"), "kind", "content", F.col("bbox")[1].alias("y"))


def _pages(spark, d):
    native = F.when(F.col("doc_id") % 11 == 0, "").when(F.col("doc_id") % 13 == 0, F.concat(F.repeat(F.lit("�"), 400), "text")).otherwise(F.col("text"))
    return _docs(spark, d).select(F.col("source").alias("doc"), F.col("doc_id").alias("page"), native.alias("native_text"))


def plan_tier(spark, d):
    p = P.page_signals(_pages(spark, d)).withColumn("looks_structured", F.col("page") % 5 == 0)
    planned = P.plan_tier(p, P.Policy("auto", "native", "vlm", structure=True))
    return planned.select("doc", "page", "ocr_reason", "target", F.array_join(F.transform("climbs", lambda c: c["reason"]), ",").alias("reasons"))


def vlm_budget(spark, d):
    p = P.page_signals(_pages(spark, d)).withColumn("wants_vlm", F.col("ocr_reason").isNotNull())
    return P.vlm_budget(p, 3).select("doc", "page", "wants_vlm", "granted")


def escalate(spark, d):
    p = _pages(spark, d).select("doc", "page", F.element_at(F.array(F.lit("native"), F.lit("ocr"), F.lit("vlm")), (F.col("page") % 3 + 1).cast("int")).alias("tier"), (F.length("native_text") == 0).alias("empty"), (~F.col("native_text").contains("\n")).alias("flat"))
    return P.escalate(p, P.Policy("ceiling", "native", "vlm", structure=True)).select("doc", "page", "tier", "next_tier", "next_reason")


def extract_pages(spark, d):
    """Native text where it will do; a stand-in reader of pixels (the clean text) elsewhere."""
    clean = lambda pages: pages.withColumn("out_text", F.regexp_replace("native_text", "�", ""))
    out = P.extract_pages(_pages(spark, d), P.Policy(), ocr=clean)
    return out.select("doc", "page", "tier", F.md5(F.col("text").cast("binary")).alias("md5"), "divergence", "confidence")


QUERIES = {f.__name__: f for f in (
    text_quality, repetition_ratio, paragraphs, trimmed_paragraphs, parse_numbers, numeric_guard, split_clitics, lemma_scripts, names_compatible, redact_url,
    sanitize_model_name, plan_input, rerank_prompt, md_blocks, render_markdown, doctags_blocks, plan_tier, vlm_budget, escalate, extract_pages,
)}

_WS = r"[\s\x0B\x{85}\p{Z}]"
_V = rf"regexp_replace(text, '{_WS}', '', 'g')"
_GARBLE = rf"CASE WHEN length({_V}) > 0 THEN length(regexp_replace({_V}, '[^\x{{FFFD}}\p{{Cc}}]', '', 'g')) / length({_V})::DOUBLE ELSE 0 END"
_PARTS = "SELECT doc_id, unnest(string_split(replace(text, chr(10), chr(10) || chr(10)), chr(10) || chr(10))) AS p, generate_subscripts(string_split(replace(text, chr(10), chr(10) || chr(10)), chr(10) || chr(10)), 1) AS i FROM documents"
_TRIM = rf"regexp_replace(p, '^{_WS}+|{_WS}+$', '', 'g')"
_NUMS = r"list_filter(list_transform(regexp_extract_all({}, '[-+]?[0-9][0-9,._]*'), lambda s: CASE WHEN length(s) - length(replace(s, '.', '')) <= 1 THEN try_cast(regexp_replace(regexp_replace(s, '[,_]', '', 'g'), '\.$', '') AS DOUBLE) END), lambda x: x IS NOT NULL)"
_CL = "(n''t|''s|''re|''ve|''ll|''d|''m)"
_MARK = "['', '# ', '## ', '- ', '| ', '![', '$$', '1. ', '#']"
_MD = rf"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS p, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents),
m AS (SELECT doc_id, i, {_MARK}[((doc_id + i) % 9 + 1)::INT] AS m, p FROM l),
q AS (SELECT doc_id, i, regexp_replace(m || p || CASE m WHEN '$$' THEN '$$' WHEN '![' THEN '](x.png)' ELSE '' END, '^{_WS}+|{_WS}+$', '', 'g') AS p FROM m),
k AS (SELECT *, regexp_replace(p, '^{_WS}+', '') AS f, CASE WHEN p LIKE '$$%$$' AND length(p) >= 4 THEN 'formula' WHEN p LIKE '![%' THEN 'figure' WHEN p LIKE '|%' THEN 'table' WHEN regexp_matches(p, '^#[# ]') THEN 'heading'
 WHEN p LIKE '- %' OR p LIKE '* %' OR (regexp_matches(p, '^[0-9]') AND p LIKE '%. %') THEN 'list' ELSE 'text' END AS kind FROM q WHERE p <> ''),
b AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS reading_order, kind, CASE kind WHEN 'formula' THEN regexp_replace(p[3:-3], '^{_WS}+|{_WS}+$', '', 'g') WHEN 'figure' THEN regexp_extract(p, '^!\[([^\]]*)\]', 1)
 WHEN 'heading' THEN regexp_replace(p, '^#+{_WS}*', '') ELSE p END AS content FROM k)"""
_PG = rf"""WITH g AS (SELECT source AS doc, doc_id AS page, CASE WHEN doc_id % 11 = 0 THEN '' WHEN doc_id % 13 = 0 THEN repeat(chr(65533), 400) || text ELSE text END AS text FROM documents),
s AS (SELECT *, {_V} AS v, {_GARBLE} AS garble FROM g),
r AS (SELECT *, CASE WHEN v = '' THEN 'no_text_layer' WHEN garble > 0.2 THEN 'garbled_text' WHEN least(length(v) / 1800.0, 1) < 0.05 THEN 'low_coverage' END AS ocr_reason FROM s)"""

ORACLES = {
    "text_quality": f"SELECT doc_id, round(least(length({_V}) / 1800.0::DOUBLE, 1), 6) AS coverage, round({_GARBLE}, 6) AS garble, {_GARBLE} <= 0.2 AND length({_V}) > 0 AS usable FROM documents",
    "repetition_ratio": f"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '{_WS}+'), lambda x: x <> '') AS w FROM documents)
SELECT doc_id, round(CASE WHEN len(w) < 3 THEN 0 ELSE 1 - len(list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i:i + 2]))) / (len(w) - 2)::DOUBLE END, 6) AS ratio FROM w""",
    "paragraphs": f"""WITH p AS ({_PARTS}), o AS (SELECT doc_id, p AS text, sum(octet_length(encode(p)) + 2) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) - octet_length(encode(p)) - 2 AS offset FROM p)
SELECT doc_id, "offset"::BIGINT AS "offset", text FROM o WHERE {_V} <> ''""",
    "trimmed_paragraphs": f"WITH p AS ({_PARTS}), t AS (SELECT doc_id, i, {_TRIM} AS p FROM p) SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS pos, p FROM t WHERE p <> ''",
    "parse_numbers": r"""WITH n AS (SELECT doc_id, regexp_extract_all(text, '[-+]?[0-9][0-9,._]*') AS a FROM documents), u AS (SELECT doc_id, unnest(a) AS s, generate_subscripts(a, 1) - 1 AS pos FROM n)
SELECT doc_id, pos, s, CASE WHEN length(s) - length(replace(s, '.', '')) <= 1 THEN try_cast(regexp_replace(regexp_replace(s, '[,_]', '', 'g'), '\.$', '') AS DOUBLE) END AS value FROM u""",
    "numeric_guard": f"""WITH j AS (SELECT a.doc_id, a.text, CASE WHEN a.doc_id % 2 = 0 THEN concat_ws(' ', b.text, a.text) ELSE coalesce(b.text, '') END AS known FROM documents a LEFT JOIN documents b ON b.doc_id = a.doc_id + 1),
n AS (SELECT doc_id, {_NUMS.format('text')} AS g, {_NUMS.format('known')} AS k FROM j),
u AS (SELECT doc_id, len(g) AS n, len(list_filter(g, lambda x: len(list_filter(k, lambda y: abs(y - x) <= 1e-6 * greatest(abs(x), abs(y), 1))) = 0)) AS unmatched FROM n)
SELECT doc_id, n, unmatched, round(CASE WHEN n > 0 THEN unmatched / n::DOUBLE ELSE 0 END, 6) AS divergence FROM u""",
    "split_clitics": f"""WITH w AS (SELECT DISTINCT unnest(list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda x: x <> '')) AS w FROM benchmark),
t AS (SELECT w || ['', 'n''t', '''s', '''re', '''ve', '''ll', '''d', '''m', '''S', 'N''T'][(length(w) % 10 + 1)::INT] AS token FROM w), c AS (SELECT token, regexp_extract(token, '(?i)^.+?{_CL}$', 1) AS clitic FROM t)
SELECT token, token[1:length(token) - length(clitic)] AS stem, clitic FROM c""",
    "lemma_scripts": """WITH w AS (SELECT DISTINCT unnest(list_filter(regexp_split_to_array(text, '[^A-Za-z]+'), lambda x: x <> '')) AS w FROM benchmark),
s AS (SELECT w, ['l|2|e', '|0|', 'l|9|x', '|1|ing', 'bad', '|x|s'][(length(w) % 6 + 1)::INT] AS script FROM w)
SELECT w, script, CASE script WHEN 'l|2|e' THEN lower(w)[1:greatest(length(w) - 2, 0)] || 'e' WHEN '|0|' THEN w WHEN 'l|9|x' THEN CASE WHEN length(w) > 9 THEN lower(w)[1:length(w) - 9] ELSE '' END || 'x'
 WHEN '|1|ing' THEN w[1:length(w) - 1] || 'ing' WHEN 'bad' THEN w ELSE w || 's' END AS lemma FROM s""",
    "names_compatible": r"""WITH p AS (SELECT p_partkey, list_transform(string_split(p_name, ' '), lambda x: upper(x[1]) || lower(x[2:])) AS a FROM part),
j AS (SELECT p.p_partkey, p.a, CASE p.p_partkey % 3 WHEN 0 THEN [array_to_string(list_transform(p.a, lambda x: x[1]), '.')] WHEN 1 THEN p.a[2:2] ELSE q.a END AS b FROM p JOIN p q ON q.p_partkey = p.p_partkey + 1)
SELECT p_partkey, p_partkey % 3 < 2 OR list_has_all(a, b) AS compatible FROM j""",
    "redact_url": "SELECT page_id, regexp_extract(url, '^(.*?://)', 1) || regexp_replace(url[length(regexp_extract(url, '^(.*?://)', 1)) + 1:], '[?#].*$', '') AS url FROM pages",
    "sanitize_model_name": r"SELECT page_id, regexp_replace(replace(url, '/', '--'), '[^\p{L}\p{N}\-_.]', '', 'g') AS name FROM pages",
    "plan_input": "WITH w AS (SELECT doc_id, text, string_split(text, ' ') AS w FROM documents) SELECT doc_id, length(text) > 510 AS tokenize, least(len(w), 64) AS n, w[len(w)] AS last FROM w",
    "rerank_prompt": """SELECT doc_id, md5('<|im_start|>system' || chr(10) || 'Answer yes or no.<|im_end|>' || chr(10) || '<|im_start|>user' || chr(10) || '<Instruct>: Judge.' || chr(10) || chr(10) || '<Query>: Is this a licence?' || chr(10) || chr(10)
|| '<Document>: ' || text || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) || '<think>' || chr(10) || chr(10) || '</think>' || chr(10)) AS md5 FROM documents""",
    "md_blocks": _MD + " SELECT * FROM b",
    "render_markdown": _MD + """ SELECT doc_id, md5(coalesce(string_agg(CASE kind WHEN 'heading' THEN '## ' || content WHEN 'list' THEN '- ' || content WHEN 'formula' THEN '$$' || chr(10) || content || chr(10) || '$$' ELSE content END, chr(10) ORDER BY reading_order) FILTER (WHERE content <> ''), '')) AS md5
FROM documents LEFT JOIN b USING (doc_id) GROUP BY doc_id""",
    "doctags_blocks": r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS p, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents)
SELECT doc_id, i AS reading_order, ['heading', 'text', 'list', 'table', 'figure', 'formula', 'caption', 'footer', 'header', 'heading', 'text'][(i % 11 + 1)::INT] AS kind, trim(regexp_replace(p, '[<>]', '', 'g')) AS content, i::DOUBLE AS y FROM l""",
    "plan_tier": _PG + """ SELECT doc, page, ocr_reason, CASE WHEN page % 5 = 0 THEN 'vlm' WHEN ocr_reason IS NOT NULL THEN 'ocr' ELSE 'native' END AS target,
concat_ws(',', CASE WHEN ocr_reason IS NOT NULL THEN ocr_reason WHEN page % 5 = 0 THEN 'structure_requested' END, CASE WHEN page % 5 = 0 THEN 'structure_requested' END) AS reasons FROM r""",
    "vlm_budget": _PG + """, w AS (SELECT doc, page, ocr_reason IS NOT NULL AS wants_vlm FROM r)
SELECT doc, page, wants_vlm, wants_vlm AND row_number() OVER (PARTITION BY doc, wants_vlm ORDER BY page) <= 3 AS granted FROM w""",
    "escalate": _PG + """, t AS (SELECT doc, page, ['native', 'ocr', 'vlm'][(page % 3 + 1)::INT] AS tier, length(text) = 0 AS empty, text NOT LIKE '%' || chr(10) || '%' AS flat FROM g)
SELECT doc, page, tier, CASE WHEN tier = 'native' AND empty THEN 'ocr' WHEN tier = 'ocr' AND (empty OR flat) THEN 'vlm' END AS next_tier,
CASE WHEN tier IN ('native', 'ocr') AND empty THEN 'empty_output' WHEN tier = 'ocr' AND flat THEN 'flat_where_structure_expected' END AS next_reason FROM t""",
}
