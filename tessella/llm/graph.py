"""Connected components of an edge table, by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every end of (a, b): label is the smallest node of its component.

    Each round takes the smallest label among neighbours, then the label's own label, and writes
    a table; rounds grow with the logarithm of the longest path, not with the size.
    """
    both = edges.where("a <> b")
    both = written(both.union(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        own = labels.join(near, "node").select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("n"), F.col("label").alias("next"))
        out = own.join(jump, F.col("label") == F.col("n")).select("node", "was", F.least("label", "next").alias("label"))
        out = written(out, "labels")
        changed = out.where("was <> label").limit(1).count()
        labels = out.select("node", "label")
        if not changed:
            return labels
