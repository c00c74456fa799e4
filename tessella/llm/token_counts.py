"""Token counts by an exact length histogram.

Every document is encoded once and leaves one number; the histogram has a row for each
distinct encoded length. Suffix sums over it give, for any context limit, the documents and
tokens above it, the tokens that remain after truncation, and the exact quantile it is.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import as_text, written
from .tokens import default_vocabulary, encode_whole, encoder

#: Lengths that one window partition of the suffix sums covers.
SPAN = 1024


def encoded_lengths(docs: DataFrame, text_col: str = "text", vocabulary: str | None = None, end_of_text: int = 0) -> DataFrame:
    """One column n_tokens: ids of every whole text plus end_of_text; null counts as empty.

    Repeated rows count again; a very long text is encoded slice by slice in one task; an empty
    table gives an empty result; other columns are ignored, whatever their names.
    """
    path = vocabulary or default_vocabulary()

    def count(batches):
        enc = encoder(path)
        for pdf in batches:
            yield pd.DataFrame({"n_tokens": pd.Series([len(encode_whole(enc, t)) + end_of_text for t in pdf["text"]], dtype="int64")})

    return docs.select(as_text(F.col(text_col)).alias("text")).mapInPandas(count, "n_tokens long")


def length_table(lengths: DataFrame) -> DataFrame:
    """A row for each distinct length (taken as context limit), from a one-column table n_tokens.

    n_docs of that length; docs_over and tokens_over of the longer ones; truncated_tokens, what
    is left if every document is cut to the limit; lost_tokens; docs_within and quantile, the
    share of documents that fit. An empty table gives an empty result; null lengths are no rows.
    Sums run in two steps (within spans of SPAN lengths, then over spans), so that no task holds
    the whole histogram.
    """
    hist = lengths.where("n_tokens is not null").groupBy(F.col("n_tokens").alias("context_limit")).agg(F.count(F.lit(1)).alias("n_docs"))
    hist = written(hist, "lengths")  # read twice: texts are encoded once
    hist = hist.withColumn("span", F.floor(F.col("context_limit") / SPAN))
    tokens = F.col("context_limit") * F.col("n_docs")
    spans = hist.groupBy("span").agg(F.sum("n_docs").alias("d"), F.sum(tokens).alias("t"))
    above = Window.orderBy(F.desc("span")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(1))
    spans = spans.select("span", F.coalesce(F.sum("d").over(above), F.lit(0)).alias("d_above"), F.coalesce(F.sum("t").over(above), F.lit(0)).alias("t_above"), F.sum("d").over(every).alias("all_d"), F.sum("t").over(every).alias("all_t"))
    inside = Window.partitionBy("span").orderBy(F.desc("context_limit")).rowsBetween(Window.unboundedPreceding, -1)
    out = hist.join(spans, "span")
    over_d = F.coalesce(F.sum("n_docs").over(inside), F.lit(0)) + F.col("d_above")
    over_t = F.coalesce(F.sum(tokens).over(inside), F.lit(0)) + F.col("t_above")
    out = out.withColumn("docs_over", over_d).withColumn("tokens_over", over_t)
    cut = F.col("all_t") - F.col("tokens_over") + F.col("docs_over") * F.col("context_limit")
    within = F.col("all_d") - F.col("docs_over")
    return out.select(
        "context_limit", "n_docs", "docs_over", "tokens_over", F.col("all_d").alias("total_docs"), F.col("all_t").alias("total_tokens"),
        cut.alias("truncated_tokens"), (F.col("all_t") - cut).alias("lost_tokens"), within.alias("docs_within"), (within / F.col("all_d")).alias("quantile"),
    )


def truncated_total(table: DataFrame, limit: int) -> int:
    """Tokens left if every document is cut to any limit, of a length_table: read off one of its rows.

    Of the longest length within the limit, shorter documents keep all and longer ones have the
    limit's tokens; below the shortest length every document has.
    """
    row = table.where(F.col("context_limit") <= limit).agg(F.max_by(F.struct("total_tokens", "tokens_over", "docs_over"), "context_limit").alias("r")).first().r
    if row is None:
        return int(limit * (table.agg(F.max("total_docs")).first()[0] or 0))
    return int(row.total_tokens - row.tokens_over + row.docs_over * limit)


def quantile(table: DataFrame, q: float) -> int | None:
    """The smallest length within which a share q of the documents lies, of a length_table."""
    return table.where(F.col("quantile") >= q).agg(F.min("context_limit")).first()[0]
