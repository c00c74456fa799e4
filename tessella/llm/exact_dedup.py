"""Exact dedup: a two-pass Bloom filter finds hashes that may repeat; only their rows shuffle.

Pass one builds two bit planes over the 64-bit hashes of all texts: "set once" and "set
again". Each task counts its hashes' cells, cells travel as small packed blocks, and blocks
are merged by position. A text can repeat only if all of its cells were set again. Pass two
tests every row against that plane: rows that fail are unique and pass straight through,
the rest are grouped by their SHA-256.

The plane that is broadcast has at most 2**MAX_BITS bits (32 MB), whatever the input. With
PROBES cells a row and 16 cells a row at least, about one unique row in a hundred shuffles
for nothing; past 16 million rows that share rises, and results stay exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_text, checked_join, local_names, written

PROBES = 3
MIN_BITS, MAX_BITS, BLOCK_BITS = 16, 28, 13


def normalised(text: Column) -> Column:
    return F.regexp_replace(as_text(text), r"[\x20\x09-\x0D]+", " ")


def _cells(h: np.ndarray, bits: int) -> np.ndarray:
    """PROBES cells of each 64-bit hash, by double hashing; shape (n, PROBES)."""
    h = h.astype(np.uint64, copy=False)
    with np.errstate(over="ignore"):
        step = ((h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)) | np.uint64(1)
        k = np.arange(PROBES, dtype=np.uint64)
        return (h[:, None] + k[None, :] * step[:, None]) >> np.uint64(64 - bits)


def _partial_planes(bits: int, flush: int = 1 << 20):
    """Cells of a task's hashes as rows (block, once, again): positions in a block, packed."""

    def emit(hashes: list[np.ndarray]):
        cells, n = np.unique(_cells(np.concatenate(hashes), bits).ravel(), return_counts=True)
        block, at = cells >> np.uint64(BLOCK_BITS), (cells & np.uint64((1 << BLOCK_BITS) - 1)).astype("<u2")
        first = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
        last = np.r_[first[1:], len(block)]
        yield pd.DataFrame({
            "block": block[first].astype(np.int64),
            "once": [at[a:b][n[a:b] == 1].tobytes() for a, b in zip(first, last)],
            "again": [at[a:b][n[a:b] > 1].tobytes() for a, b in zip(first, last)],
        })

    def run(batches):
        held, n = [], 0
        for pdf in batches:
            if len(pdf):
                held.append(pdf["h"].to_numpy())
                n += len(pdf)
            if n >= flush:
                yield from emit(held)
                held, n = [], 0
        if n:
            yield from emit(held)

    return run


def _merge(key: tuple[Any, ...], batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The "set again" plane of one block, from any number of partial rows, streamed."""
    count = np.zeros(1 << BLOCK_BITS, np.uint8)
    for pdf in batches:
        for once, again in zip(pdf["once"], pdf["again"]):
            at = np.frombuffer(once, "<u2")
            count[at] = np.minimum(count[at] + 1, 2)
            count[np.frombuffer(again, "<u2")] = 2
    yield pd.DataFrame({"block": [key[0]], "plane": [np.packbits(count > 1).tobytes()]})


def repeated_plane(hashes: DataFrame) -> tuple[int, np.ndarray]:
    """(bits, plane) of a one-column table h of 64-bit hashes; the plane is bounded by MAX_BITS."""
    n = hashes.count()
    bits = min(MAX_BITS, max(MIN_BITS, int(16 * n).bit_length()))
    partial = hashes.mapInPandas(_partial_planes(bits), "block long, once binary, again binary")
    planes = partial.groupBy("block").applyInPandas(_merge, "block long, plane binary")
    whole = np.zeros((1 << bits) // 8, np.uint8)
    size = (1 << BLOCK_BITS) // 8
    for row in planes.where(F.length("plane") > 0).toLocalIterator(prefetchPartitions=True):
        whole[row.block * size:(row.block + 1) * size] = np.frombuffer(row.plane, np.uint8)
    return bits, whole


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", columns: list[str] | None = None) -> DataFrame:
    """All rows of docs and its columns (or the given ones), with keep_id, group_size, kept and text_sha256.

    Texts are equal when identical after each run of ASCII white space became one space; null
    counts as empty. Of equal texts the smallest id stays; null ids come last; of rows that
    also share that id (repeated rows, ties), one stays. A very long text is hashed as a whole by
    one task and is not shuffled. Columns of docs that have an output's name are replaced, others
    stay. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    names = [c for c in (docs.columns if columns is None else columns) if c not in ("keep_id", "group_size", "kept", "text_sha256")]
    rid, norm, may, best, key = local_names(docs, "rid", "norm", "may", "best", "key")
    bits, plane = repeated_plane(docs.select(F.xxhash64(normalised(F.col(text_col))).alias("h")))
    shared = spark.sparkContext.broadcast(plane)

    @F.pandas_udf("boolean")
    def may_repeat(h: pd.Series) -> pd.Series:
        cells = _cells(h.to_numpy(), bits).astype(np.int64)
        bit = (shared.value[cells >> 3] >> (7 - (cells & 7)).astype(np.uint8)) & 1
        return pd.Series(bit.all(axis=1))

    rows = docs.select(*names, F.col(id_col).alias(key), normalised(F.col(text_col)).alias(norm))
    rows = rows.withColumn("text_sha256", F.sha2(F.col(norm).cast("binary"), 256)).withColumn(may, may_repeat(F.xxhash64(norm))).drop(norm)
    unique = rows.where(~F.col(may)).select(*names, F.col(key).alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    # stored, so that a row's number is the same wherever it is read
    repeated = written(rows.where(F.col(may)).drop(may).withColumn(rid, F.monotonically_increasing_id()), "repeated")
    first = F.min(F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("id"), F.col(rid).alias("rid")))
    groups = written(repeated.groupBy("text_sha256").agg(first.alias(best), F.count(F.lit(1)).alias("group_size")), "groups")
    resolved = checked_join(repeated, groups, "text_sha256", "inner", 128).select(
        *names, F.col(f"{best}.id").alias("keep_id"), "group_size", (F.col(rid) == F.col(f"{best}.rid")).alias("kept"), "text_sha256"
    )
    return unique.unionByName(resolved)
