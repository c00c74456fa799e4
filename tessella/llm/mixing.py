"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source is wanted target/size times; the whole part is sure, the rest is a
probability. Pairs of documents of a source trade expected words, at random and without bias,
until one of the two holds a whole number of copies. A bucket of documents ends with one open
document a source at most; open documents meet again in ever fewer buckets (a reduction tree
of fan-in FAN) until one is left a source, which is rounded. Words of a source are kept in
every trade, so that they miss the target by less than one document's words.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import as_text, checked_join, local_names, written

WEIGHTS = (1, 2, 3)
STOP = 3
BUCKET_ROWS, FAN = 8192, 64
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.regexp_count(as_text(text), F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, stop: float = STOP) -> DataFrame:
    """(source, source_size, weight, target) of a table (source, size).

    Weights repeat over the sources by code point, null last. Targets share all words by
    weight; one that reaches stop times its source's words is fixed there, and what is over is
    shared anew, until none is above. Only sums go to the driver.
    """
    sums = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).sort(F.col("source").isNull(), "source")
    # ranks in two steps, as sources may be many: within a range of them, then ranges by their number
    ranged = written(sums.withColumn("range", F.spark_partition_id()), "ranges")
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranged.groupBy("range").agg(F.count(F.lit(1)).alias("n")).select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("range").orderBy(F.col("source").isNull(), "source")
    rank = F.row_number().over(within) - 1 + F.col("before")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (rank % len(weights) + 1).cast("int"))
    table = written(ranged.join(counts, "range").withColumn("weight", w).drop("range", "before"), "sources")
    total = table.agg(F.sum("source_size")).first()[0] or 0
    level, fixed = 0.0, -1
    while True:
        at = F.col("source_size") * float(stop) <= F.col("weight") * level if fixed >= 0 else F.lit(False)
        n, held, open_w = table.agg(F.count_if(at), F.sum(F.when(at, F.col("source_size") * float(stop))), F.sum(F.when(~at, F.col("weight")))).first()
        if n == fixed or not open_w:
            break
        fixed, level = n, (total - (held or 0.0)) / open_w
    return table.withColumn("target", F.least(F.col("source_size") * float(stop), F.col("weight") * level))


def _random(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + b.astype(np.uint64)
        for s, m in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(s))) * np.uint64(m)
        return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / 2.0**53


def _trade(last: bool, seed: int):
    """One bucket: copies of all rows but one a source, which stays open (or is rounded)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["source", "key", "size", "rid"], na_position="last", kind="stable").reset_index(drop=True)
        size, copies, part = pdf["size"].to_numpy(np.float64), pdf["copies"].to_numpy(np.int64).copy(), pdf["part"].to_numpy(np.float64).copy()
        draw, again = (_random(pdf["key"].to_numpy(), np.full(len(pdf), x, np.int64)) for x in (seed, seed + (1 << 40)))
        code = pdf["code"].to_numpy()
        held, eps = -1, 1e-9
        for i in range(len(pdf)):
            if held >= 0 and code[held] != code[i]:
                if last:
                    copies[held] += again[held] < part[held]
                    part[held] = 0
                held = -1
            p = part[i]
            if p < eps or p > 1 - eps or not size[i]:
                copies[i] += p > 0.5 and size[i] > 0
                part[i] = 0
                continue
            if held < 0:
                held = i
                continue
            # words that may go from the open one to this one, and back
            up, down = min(part[held] * size[held], (1 - p) * size[i]), min((1 - part[held]) * size[held], p * size[i])
            d = up if draw[i] * (up + down) < down else -down
            part[held] -= d / size[held]
            part[i] += d / size[i]
            for j in (held, i):
                if part[j] < eps or part[j] > 1 - eps:
                    copies[j] += part[j] > 0.5
                    part[j] = 0
            held = held if part[held] else (i if part[i] else -1)
        if last and held >= 0:
            copies[held] += again[held] < part[held]
            part[held] = 0
        return pdf.assign(copies=copies, part=part, open=part > 0)[["rid", "key", "id", "source", "code", "size", "source_size", "target", "copies", "part", "open"]]

    return run


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, stop: float = STOP, seed: int = 17) -> DataFrame:
    """(rid, id, source, size, source_size, target, copies) of every row of docs.

    rid is the row's monotonically_increasing_id in docs. Sizes are words of the whole text,
    however long; null and empty texts have 0 and get no copies. Rows are dealt to buckets by a
    hash of id and size, and ordered by it there, so that runs agree; ties are rows of one id and
    size, which are alike, and which of them gets a copy more does not matter. Null ids, repeated
    rows and null sources (a source of its own, last) are rows like others. An empty table gives
    an empty result; other columns are ignored, whatever their names.
    """
    base = docs.select(
        F.monotonically_increasing_id().alias("rid"), F.col(id_col).cast("long").alias("id"), F.col(source_col).cast("string").alias("source"), n_words(F.col(text_col)).alias("size")
    )
    base = written(base.withColumn("key", F.xxhash64("id", "size", F.lit(seed))), "mix")
    targets = source_targets(base.select("source", "size"), weights, stop)
    rows = base.count()
    ratio = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(stop)))).otherwise(0.0)
    # one row a source; Spark broadcasts it only under its own size threshold
    wanted = base.join(targets.select(F.col("source").alias("s"), "source_size", "target"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    whole = F.floor(ratio + F.lit(1e-12)).cast("long")
    wanted = wanted.withColumn("copies", F.when(F.col("size") > 0, whole).otherwise(0)).withColumn(
        "part", F.when(F.col("size") > 0, F.greatest(ratio - whole, F.lit(0.0))).otherwise(0.0)
    ).withColumn("code", F.xxhash64("source", F.col("source").isNull()))
    schema = "rid long, key long, id long, source string, code long, size long, source_size long, target double, copies long, part double, open boolean"
    buckets, table, done = max(1, -(-rows // BUCKET_ROWS)), wanted, []
    while True:
        last = buckets == 1
        dealt = table.withColumn("bucket", F.pmod(F.col("key"), F.lit(buckets)))
        out = written(dealt.groupBy("bucket").applyInPandas(_trade(last, seed + buckets), schema), "trade")
        done.append(out.where(~F.col("open")))
        if last:
            break
        table, buckets = out.where("open"), max(1, buckets // FAN)
    whole_table = done[0]
    for d in done[1:]:
        whole_table = whole_table.unionByName(d)
    return whole_table.select("rid", "id", "source", "size", "source_size", "target", "copies")


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """docs with every row as often as the mix takes it; other columns as they are.

    Rows are found again by their place, so docs has to be a stored table (or another plan that
    gives its rows in the same order each time); written() makes one.
    """
    rid, copies, nth = local_names(docs, "rid", "copies", "nth")
    taken = written(mix(docs, **options).where("copies > 0").select(F.col("rid").alias(rid), F.col("copies").cast("int").alias(copies)), "copies")
    rows = checked_join(docs.withColumn(rid, F.monotonically_increasing_id()), taken, rid, "inner", 24)
    return rows.withColumn(nth, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*docs.columns)
