"""Licence scans by ordered signature rules, with DataFrame functions alone.

A text is lower-cased (A-Z) and becomes its words with one blank between them. A keyword
prefilter says which texts can match at all, once: what passes is stored, and its keywords say
which rules are worth running on it. Rules are literal patterns, so that none is compiled twice.
Of overlapping detections, one that lies within another of no smaller priority goes. Labels of
the contract's base phrases always stay.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.base import let, running_sums
from .common import as_text, written
from .license_rules import rules

#: Base phrases (their words with one blank between) and labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
CONFIDENCE = {3: 1.0, 2: 0.8, 1: 0.5}


def n_words(text: Column) -> Column:
    return F.regexp_count(as_text(text), F.lit(WORD)).cast("long")


def normalised(text: Column) -> Column:
    """Lower-case words with one blank before, between and after them."""
    return F.regexp_replace(F.concat(F.lit(" "), F.translate(as_text(text), UPPER, LOWER), F.lit(" ")), BETWEEN, " ")


def _blanks(c: Column) -> Column:
    return (F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))).cast("long")


def _rule_table(table) -> tuple[list[tuple[str, str, str, int]], list[str]]:
    """Rules with one plain keyword each, and all keywords."""
    rows = []
    for label, regex, keyword, priority in table:
        for k in keyword.removeprefix("(?:").removesuffix(")").split("|"):
            rows.append((label, rf"(?<= ){regex}(?= )", k, priority))
    return rows, sorted({r[2] for r in rows}, key=lambda k: (-len(k), k))


def _trie(words: list[str]) -> str:
    """A regex that matches what starts with one of the words, a letter at a time."""
    if "" in words:
        return ""
    by: dict[str, list[str]] = {}
    for w in words:
        by.setdefault(w[0], []).append(w[1:])
    parts = [first + _trie(rest) for first, rest in sorted(by.items())]
    return parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})"


def gate(words: list[str]) -> str:
    """The prefilter's regex over raw texts: a keyword at the start of a word, in any case."""
    return rf"(?i)(?<![A-Za-z0-9]){_trie(words)}"


def _sql(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _matches(rows: list[tuple[str, str, str, int]]) -> str:
    """SQL: (label, priority, regex) of the rules of a keyword that match norm."""
    by: dict[str, list[str]] = {}
    for label, regex, keyword, priority in rows:
        r = _sql(regex)
        hit = f"named_struct('label', {_sql(label)}, 'priority', {priority}, 'regex', {r})"
        by.setdefault(keyword, []).append(f"if(norm rlike {r}, {hit}, null)")
    # in a lambda, branches are evaluated and not compiled: together they are too long for one method
    branches = " ".join(f"WHEN {_sql(k)} THEN filter(array({', '.join(hits)}), h -> h is not null)" for k, hits in sorted(by.items()))
    return f"transform(array(keyword), w -> CASE w {branches} END)[0]"


def detections(texts: DataFrame, table=None) -> DataFrame:
    """(keys..., label, priority, start, end): what every rule finds, by words, before suppression.

    texts has the column norm (normalised text) and key columns; end is the word after the last.
    """
    keys = [c for c in texts.columns if c != "norm"]
    rows, words = _rule_table(table or rules())
    seen = F.array_distinct(F.regexp_extract_all("norm", F.lit(rf"(?<= )({'|'.join(words)})"), F.lit(1)))
    # a longer keyword may start with a shorter one: both count
    longer = {k: [s for s in words if k.startswith(s)] for k in words}
    starts = F.create_map(*[x for k, v in longer.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    found = texts.withColumn("keyword", F.explode(F.array_distinct(F.flatten(F.transform(seen, lambda k: F.element_at(starts, k))))))
    hits = found.select(*keys, "norm", F.inline(F.expr(_matches(rows))))
    # only rules that match are compiled from here on
    hits = hits.select(*keys, "label", "priority", F.expr("split(norm, regex, -1)").alias("parts"), F.expr("regexp_extract_all(norm, regex, 0)").alias("texts"))
    # blanks before match k: those of parts 0..k and of matches 0..k-1
    both = F.zip_with("texts", "parts", lambda t, p: F.struct(_blanks(p).alias("before"), _blanks(t).alias("inside")))
    both = F.filter(both, lambda x: x["inside"].isNotNull())
    spans = let(both, lambda b: F.zip_with(b, running_sums(F.transform(b, lambda x: x["before"] + x["inside"])), lambda x, at: F.struct((at + x["before"] - 1).alias("start"), (at + x["before"] + x["inside"]).alias("end"))))
    return hits.select(*keys, "label", "priority", F.explode(spans).alias("span")).select(*keys, "label", "priority", "span.start", "span.end").distinct()


def unsuppressed(found: DataFrame, keys: list[str]) -> DataFrame:
    """Detections that lie in no other one of the same text whose priority is no smaller.

    Of those with equal words, the higher priority stays, then all labels of that priority.
    """
    by = Window.partitionBy(*keys).orderBy("start", F.desc("end"), F.desc("priority"))
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    same = Window.partitionBy(*keys, "start", "end")
    out = found.withColumn("best", F.max("priority").over(same))
    # the farthest end of earlier detections with that priority or more, and where it starts
    widest = [F.max(F.when((F.col("priority") >= p), F.struct("end", (-F.col("start")).alias("back")))).over(before) for p in (1, 2, 3)]
    held = reduce(lambda acc, p: F.when(F.col("priority") == p, F.struct(widest[p - 1]["end"].alias("end"), (-widest[p - 1]["back"]).alias("start"))).otherwise(acc), (1, 2, 3), F.lit(None))
    out = out.withColumn("held", held)
    within = F.coalesce((F.col("held.end") > F.col("end")) | ((F.col("held.end") == F.col("end")) & (F.col("held.start") < F.col("start"))), F.lit(False))
    return out.where((F.col("priority") == F.col("best")) & ~within).drop("best", "held")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", table=None) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every row.

    Null and empty texts have no words; first_word and last_word are null without a base phrase;
    labels are empty strings where there are none; the score is the best detection's confidence
    (1 for a base phrase). Of detections with the same words (ties) all labels of the highest
    priority stay. Repeated rows give repeated results, each from its own text, null ids stay
    null, a very long text is scanned as a whole by one task, other columns are ignored, whatever
    their names, and an empty table gives an empty result.
    """
    _, words = _rule_table(table or rules())
    text = F.col(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), n_words(text).alias("n_words"), F.when(as_text(text).rlike(gate(words)), normalised(text)).alias("norm"))
    # every text is gated and normalised once; a row's number is the same wherever it is read
    rows = written(rows.withColumn("rid", F.monotonically_increasing_id()), "gated")
    places = {p: F.split("norm", rf"(?<= ){p}(?= )", -1) for p in BASE}
    for k, (phrase, label) in enumerate(BASE.items()):
        seen, size = F.col("norm").contains(f" {phrase} "), len(phrase.split())
        rows = rows.withColumn(f"p{k}", F.when(seen, places[phrase]))
        rows = rows.withColumn(f"b{k}", F.when(seen, F.struct(
            F.lit(label).alias("label"), (F.size(f"p{k}") - 1).cast("long").alias("n"), (_blanks(F.col(f"p{k}")[0]) - 1).alias("first"),
            (F.col("n_words") - _blanks(F.element_at(f"p{k}", -1)) + 1 - size).alias("last"),
        ))).drop(f"p{k}")
    base = F.filter(F.array(*[f"b{k}" for k in range(len(BASE))]), lambda b: b.isNotNull())
    rows = rows.withColumn("base", base).drop(*[f"b{k}" for k in range(len(BASE))])
    found = detections(rows.where("norm is not null").select("rid", "norm"), table)
    found = written(found, "detections")  # few rows, and the rules' long plan ends here
    kept = unsuppressed(found, ["rid"]).groupBy("rid").agg(F.collect_set("label").alias("more"), F.max("priority").alias("best"))
    out = rows.drop("norm").join(kept, "rid", "left")
    labels = F.transform("base", lambda b: b["label"])
    none = F.array().cast("array<string>")
    sure = reduce(lambda acc, x: F.when(F.col("best") == x[0], F.lit(x[1])).otherwise(acc), CONFIDENCE.items(), F.lit(0.0))
    return out.select(
        "doc_id", "n_words", F.aggregate("base", F.lit(0).cast("long"), lambda a, b: a + b["n"]).alias("n_base"),
        F.array_min(F.transform("base", lambda b: b["first"])).alias("first_word"), F.array_max(F.transform("base", lambda b: b["last"])).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(labels)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(labels, F.coalesce("more", none))), ",").alias("labels"),
        F.when(F.size("base") > 0, 1.0).otherwise(sure).alias("score"),
    )
