"""Scoring and ranking of documents for queries: dense, sparse, late interaction, pooling."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import vector as V

#: Queries are broadcast in blocks of at most this many bytes.
QUERY_BYTES = 32 << 20


def _in_blocks(queries: DataFrame, row_bytes: int, score) -> DataFrame:
    """score(block) of every block of the query table, put together; blocks are bounded, their number grows."""
    blocks = max(1, -(-queries.count() * row_bytes // QUERY_BYTES))
    parts = [score(F.broadcast(queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == k))) for k in range(blocks)]
    return reduce(DataFrame.unionByName, parts)


def dense_scores(queries: DataFrame, docs: DataFrame, row_bytes: int = 1024) -> DataFrame:
    """(query_id, doc_id, score) of a stated query table (query_id, vector) against all docs (doc_id, vector)."""
    q = queries.select("query_id", F.col("vector").alias("q"))
    return _in_blocks(q, row_bytes, lambda block: docs.join(block).select("query_id", "doc_id", V.dot(F.col("q"), F.col("vector")).alias("score")))


def top_k(scores: DataFrame, k: int) -> DataFrame:
    """The k best of every query with their rank; ties go to the lower doc_id.

    Ranks are cut in two steps (within a hash bucket of documents, then over what is left), so
    that no task sorts all documents of a query.
    """
    order = (F.desc("score"), F.asc("doc_id"))
    near = scores.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(64)))
    near = near.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "bucket").orderBy(*order))).where(F.col("rank") <= k)
    return near.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= k).drop("bucket")


def colbert_scores(queries: DataFrame, docs: DataFrame) -> DataFrame:
    """(query_id, doc_id, score): sum over query tokens of their best match among a document's tokens.

    queries (query_id, token, vector) goes to every task in blocks of bounded size; documents'
    tokens (doc_id, vector) stay where they are, and one maximum for each query token, document
    and task is shuffled.
    """
    q = queries.select("query_id", "token", F.col("vector").alias("q"))

    def score(block: DataFrame) -> DataFrame:
        pairs = docs.join(block).select("query_id", "token", "doc_id", V.dot(F.col("q"), F.col("vector")).alias("s"))
        best = pairs.groupBy("query_id", "doc_id", "token").agg(F.max("s").alias("s"))
        return best.groupBy("query_id", "doc_id").agg(F.sum("s").alias("score"))

    return _in_blocks(q, 1024, score)


def sparse_scores(queries: DataFrame, docs: DataFrame) -> DataFrame:
    """(query_id, doc_id, score) of exploded sparse vectors (id, term, weight), for pairs with a common term.

    Terms join; repeated terms add up. A term of many documents is one of many rows on one side
    only (the other is a query's), which the adaptive join can split.
    """
    q = queries.select("query_id", "term", F.col("weight").cast("double").alias("qw"))
    d = docs.select("doc_id", "term", F.col("weight").cast("double").alias("dw"))
    return d.join(q, "term").groupBy("query_id", "doc_id").agg(F.sum(F.col("qw") * F.col("dw")).alias("score"))


def with_zero_scores(candidates: DataFrame, scores: DataFrame) -> DataFrame:
    """Scores of the stated candidate pairs (query_id, doc_id); 0 where they have no common term."""
    return candidates.join(scores, ["query_id", "doc_id"], "left").select("query_id", "doc_id", F.coalesce("score", F.lit(0.0)).alias("score"))


def log_weights(tokens: DataFrame, *keys: str) -> DataFrame:
    """Activations (keys..., term, x) pooled to max ln(1 + relu(x)), positive ones kept."""
    w = tokens.groupBy(*keys, "term").agg(F.max(F.log1p(F.greatest(F.col("x").cast("double"), F.lit(0.0)))).alias("weight"))
    return w.where("weight > 0")


def lexical_weights(tokens: DataFrame, *keys: str) -> DataFrame:
    """Token weights (keys..., term, x) pooled to max relu(x), positive ones kept."""
    return tokens.groupBy(*keys, "term").agg(F.max(F.greatest(F.col("x").cast("double"), F.lit(0.0))).alias("weight")).where("weight > 0")


#: Ids of padding and markers in two common vocabularies.
SPECIAL_TOKENS = (0, 1, 2, 100, 101, 102, 103)


def without_special(tokens: DataFrame, column: str = "token_id") -> DataFrame:
    return tokens.where(~F.col(column).isin(*SPECIAL_TOKENS))


def pool(tokens: DataFrame, kind: str) -> DataFrame:
    """(id, vector): token vectors (id, pos, vector, mask) pooled by "mean", "max", "cls" or "last".

    mean and max look at unmasked tokens; cls takes the first token, masked or not; last the last
    unmasked one, or the last of all where all are masked. Dimensions are aggregated one by one,
    so that a long sequence is never collected.
    """
    if kind == "cls":
        return tokens.groupBy("id").agg(F.min_by("vector", "pos").alias("vector"))
    if kind == "last":
        unmasked = F.when(F.col("mask"), F.col("pos"))
        last = F.coalesce(F.max_by("vector", unmasked), F.max_by("vector", "pos"))
        return tokens.groupBy("id").agg(last.alias("vector"))
    how = {"mean": F.sum("x") / F.greatest(F.count("x"), F.lit(V.MASK_FLOOR)), "max": F.max("x")}[kind]
    dims = tokens.select("id", F.posexplode("vector").alias("dim", "v")).withColumn("x", F.col("v").cast("double")) if "mask" not in tokens.columns else tokens.select("id", "mask", F.posexplode("vector").alias("dim", "v")).withColumn("x", F.when(F.col("mask"), F.col("v").cast("double")))
    per_dim = dims.groupBy("id", "dim").agg(F.coalesce(how, F.lit(0.0)).alias("x"))
    vector = F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda s: s["x"])
    return per_dim.groupBy("id").agg(vector.alias("vector"))


def mean_normalized(tokens: DataFrame, mask_floor: float = 1e-9, norm_floor: float = 1e-12) -> DataFrame:
    """(id, vector): masked means over max(mask, mask_floor), then over max(norm, norm_floor): a zero row stays zero."""
    dims = tokens.select("id", F.col("mask").cast("double").alias("m"), F.posexplode("vector").alias("dim", "v"))
    mean = dims.groupBy("id", "dim").agg((F.sum(F.col("v") * F.col("m")) / F.greatest(F.sum("m"), F.lit(mask_floor))).alias("x"))
    rows = mean.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda s: s["x"]).alias("v"), F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("n"))
    return rows.select("id", F.transform("v", lambda x: x / F.greatest(F.col("n"), F.lit(norm_floor))).alias("vector"))


def select_output(outputs: DataFrame, name: str | None = None, index: int | None = None) -> DataFrame:
    """(id, value, error) of named outputs (id, outputs array<struct<name,value>>): by name, else by place (the first)."""
    by_name = F.get(F.filter("outputs", lambda o: o["name"] == name), 0) if name is not None else F.get("outputs", F.lit(index or 0))
    missing = f"no output {name}" if name is not None else f"output_index {index or 0} out of range"
    return outputs.select("id", by_name["value"].alias("value"), F.when(by_name.isNull(), missing).alias("error"))


def ratio_batches(lines: DataFrame, size: int, by: str = "image") -> DataFrame:
    """lines (width, height, pos) with batch: size lines each, by aspect ratio (ties by pos), so that batches pad little."""
    order = Window.partitionBy(by).orderBy(F.col("width") / F.greatest(F.col("height"), F.lit(1)), "pos")
    return lines.withColumn("batch", F.floor((F.row_number().over(order) - 1) / size))


def finalize_dense(vectors: DataFrame, normalize: bool = True, dimensions: int | None = None) -> DataFrame:
    """(id, vector, ok): normalised where asked; ok says whether the width is the configured one."""
    v = V.l2_normalize(F.col("vector")) if normalize else V.as_doubles(F.col("vector"))
    ok = F.size("vector") == dimensions if dimensions is not None else F.lit(True)
    return vectors.select("id", v.alias("vector"), ok.alias("ok"))


def top_per_pair(margins: DataFrame, top: int) -> DataFrame:
    """Per ordered pair (head, tail of a window): the top relations by margin (ties by index) that are positive."""
    by = Window.partitionBy("window_id", "head", "tail").orderBy(F.desc("margin"), F.asc("relation"))
    return margins.withColumn("rank", F.row_number().over(by)).where((F.col("rank") <= top) & (F.col("margin") > 0))
