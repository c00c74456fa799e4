"""Runs of tags, turns and classes: gaps-and-islands over window functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Every table here is (seq, pos, ...): positions of one sequence are ordered by pos.


def _by(*keys: str):
    return Window.partitionBy(*keys).orderBy("pos")


def _runs(rows: DataFrame, opens, keys=("seq",)) -> DataFrame:
    run = F.sum(F.when(opens, 1).otherwise(0)).over(_by(*keys).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumn("run", run)


def bio_spans(tags: DataFrame) -> DataFrame:
    """(seq, label, start, end): "B-X" opens, any "I-" goes on (or opens where nothing is open); half open."""
    inside, begins = F.col("tag").startswith("I-"), F.col("tag").startswith("B-")
    before = F.coalesce(F.lag("tag").over(_by("seq")), F.lit("O"))
    opens = begins | (inside & ~before.rlike("^[BI]-"))
    rows = _runs(tags.withColumn("opens", opens), F.col("opens")).where(inside | begins)
    return rows.groupBy("seq", "run").agg(F.min_by(F.substring("tag", 3, 1 << 20), "pos").alias("label"), F.min("pos").alias("start"), (F.max("pos") + 1).alias("end")).drop("run")


def merged_spans(tags: DataFrame) -> DataFrame:
    """(seq, label, start, end): like bio_spans, but a change of label closes, and a bare tag opens like "B-".

    What stands before a tag's first hyphen is its prefix, whatever it is: only "I" goes on.
    """
    at = F.instr("tag", "-")
    label = F.when(at > 0, F.substring(F.col("tag"), at + 1, F.length("tag"))).otherwise(F.col("tag"))
    rows = tags.withColumn("label", label).withColumn("inside", F.col("tag").startswith("I-")).withColumn("out", F.col("tag").isin("O", ""))
    w = _by("seq")
    joins = F.col("inside") & ~F.coalesce(F.lag("out").over(w), F.lit(True)) & (F.col("label") == F.lag("label").over(w))
    rows = _runs(rows.withColumn("opens", ~F.col("out") & ~F.coalesce(joins, F.lit(False))), F.col("opens")).where(~F.col("out"))
    return rows.groupBy("seq", "run", "label").agg(F.min("pos").alias("start"), (F.max("pos") + 1).alias("end")).drop("run")


def speaker_turns(rows: DataFrame) -> DataFrame:
    """First row of each run of one speaker (null is a speaker like others)."""
    w = _by("seq")
    return rows.where("speaker is not null or pos >= 0").withColumn("new", (F.row_number().over(w) == 1) | ~F.col("speaker").eqNullSafe(F.lag("speaker").over(w))).where("new").drop("new")


def ctc_collapse(steps: DataFrame, blank: int = 0) -> DataFrame:
    """(seq, classes, confidence): repeats of (seq, pos, cls, p) count once, blanks not at all; mean p of what is left."""
    kept = steps.withColumn("was", F.lag("cls").over(_by("seq"))).withColumn("kept", (F.col("cls") != blank) & ~F.col("cls").eqNullSafe(F.col("was")))
    some = F.when(F.col("kept"), F.struct("pos", "cls"))
    return kept.groupBy("seq").agg(F.transform(F.array_sort(F.collect_list(some)), lambda s: s["cls"]).alias("classes"), F.coalesce(F.avg(F.when(F.col("kept"), F.col("p"))), F.lit(0.0)).alias("confidence"))


def word_index(rows: DataFrame) -> DataFrame:
    """Dense index (from 0) that grows at every word boundary."""
    return _runs(rows, F.col("boundary")).withColumn("word", F.col("run") - 1).drop("run")


def chunked(rows: DataFrame, length: int) -> DataFrame:
    """Consecutive chunks of length positions."""
    return rows.withColumn("chunk", F.floor(F.col("pos") / length))


def sentence_of(positions: DataFrame, sentences: DataFrame) -> DataFrame:
    """The sentence (seq, start, sentence) that each position (seq, pos) is in: the last that starts no later.

    Both are put in one order and the last start is carried along, so that no pairs are made.
    """
    p = positions.select("seq", F.col("pos").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("sentence"))
    s = sentences.select("seq", F.col("start").alias("at"), F.lit(0).alias("kind"), F.col("sentence").cast("long"))
    w = Window.partitionBy("seq").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = p.unionByName(s).withColumn("sentence", F.last("sentence", ignorenulls=True).over(w))
    return both.where("kind = 1").select("seq", F.col("at").alias("pos"), "sentence")


def span_candidates(words: DataFrame, width: int = 12) -> DataFrame:
    """(seq, start, end): spans of up to width words of one sentence that start and end on an analysed word.

    Words carry their sentence; each start meets the words of the next width positions by
    position, never the whole sequence.
    """
    ok = words.where("ok and sentence >= 0")
    starts = ok.select("seq", "sentence", F.col("pos").alias("start"), F.explode(F.sequence(F.col("pos"), F.col("pos") + (width - 1))).alias("last"))
    ends = ok.select("seq", "sentence", F.col("pos").alias("last"))
    return starts.join(ends, ["seq", "sentence", "last"]).select("seq", "start", (F.col("last") + 1).alias("end"))


def ordered_pairs(entities: DataFrame) -> DataFrame:
    """(seq, head, tail) of every two different entities of a window; the table holds few entities a window."""
    h = entities.select("seq", F.col("entity").alias("head"))
    return h.join(entities.select("seq", F.col("entity").alias("tail")), "seq").where("head <> tail")


def type_votes(spans: DataFrame) -> DataFrame:
    """(entity, type): the most frequent type; of equals the one first seen last."""
    n = spans.groupBy("entity", "type").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("seen"))
    return n.groupBy("entity").agg(F.max_by("type", F.struct("n", "seen")).alias("type"))


def participants(turns: DataFrame) -> DataFrame:
    """(seq, speakers) in order of first appearance."""
    first = turns.where("speaker is not null").groupBy("seq", "speaker").agg(F.min("pos").alias("pos"))
    return first.groupBy("seq").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "speaker"))), lambda s: s["speaker"]).alias("speakers"))
