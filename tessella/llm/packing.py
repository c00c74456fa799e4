"""Packing by shortest-pack-first over the length histogram.

Documents are cut into whole sequences and a rest. Rests are never seen one by one when packs
are planned: lengths go longest first, each into the shortest pack that still has room, whole
counts at a time, so that the plan works on at most max_len lengths. Pieces of a length are
then ranked, and the rank says which pack of which pattern, and which place in it, is theirs.
"""

from __future__ import annotations

import bisect
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import as_text, written
from .tokens import default_vocabulary, encode_whole, encoder

MAX_LEN = 1024
RANK_ROWS = 100_000


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, max_len: int = MAX_LEN, keep_ids: bool = False) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens[, ids]): every document with its final id 0, cut at max_len."""
    path = vocabulary or default_vocabulary()

    def cut(batches):
        enc = encoder(path)
        for pdf in batches:
            rows = []
            for doc, text in zip(pdf["doc_id"], pdf["text"]):
                ids = np.array([*encode_whole(enc, text), 0], "<u4")
                raw, doc = ids.tobytes(), None if pd.isna(doc) else int(doc)
                for a in range(0, len(ids), max_len):
                    n = min(max_len, len(ids) - a)
                    rows.append((doc, a, n, zlib.crc32(raw[4 * a:4 * (a + n)]), len(ids), *([ids[a:a + n].tolist()] if keep_ids else [])))
            out = pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", *["ids"] * keep_ids])
            yield out.astype({"doc_id": "Int64"})

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<long>" * keep_ids
    # a document's id travels as text, so that a batch with null ids keeps its 64 bits
    return docs.select(F.col(id_col).cast("string").alias("doc_id"), as_text(F.col(text_col)).alias("text")).mapInPandas(cut, schema)


def plan_packs(histogram: dict[int, int], max_len: int = MAX_LEN) -> list[tuple[tuple[int, ...], int]]:
    """[(lengths in a pack, longest first; number of such packs)] of {length: count}.

    Open packs are kept by the room they have; a length goes to those with the most room.
    """
    room: dict[int, list[tuple[tuple[int, ...], int]]] = {max_len: []}
    rooms: list[int] = []  # rooms of open packs, ascending
    for length in sorted((n for n, c in histogram.items() if c), reverse=True):
        left = histogram[length]
        while left:
            most = rooms[-1] if rooms and rooms[-1] >= length else None
            if most is None:
                each = max_len // length  # an empty pack is the shortest there is, until it is full
                packs = [((length,) * k, c) for k, c in ((each, left // each), (left % each, 1)) if k and c]
                left = 0
                for p in packs:
                    _put(room, rooms, max_len - length * len(p[0]), p)
                continue
            else:
                pattern, count = room[most].pop()
                if not room[most]:
                    rooms.pop()
                used = min(count, left)
                if used < count:
                    _put(room, rooms, most, (pattern, count - used))
                packs, new_room, left = [((*pattern, length), used)], most - length, left - used
            for p in packs:
                _put(room, rooms, new_room, p)
    merged: dict[tuple[int, ...], int] = {}
    for packs in room.values():
        for p, c in packs:
            merged[p] = merged.get(p, 0) + c
    return sorted(merged.items(), reverse=True)


def _put(room: dict, rooms: list[int], space: int, pack) -> None:
    if not room.setdefault(space, []):
        at = bisect.bisect_left(rooms, space)
        if at == len(rooms) or rooms[at] != space:
            rooms.insert(at, space)
    room[space].append(pack)


def _places(plan, length_of_ranks: dict) -> pd.DataFrame:
    """Rows (length, first rank, copies in a pack, first sequence, offset): where ranks of a length go."""
    rows, used, sequence = [], {}, 0
    for pattern, count in plan:
        offset = 0
        for length in dict.fromkeys(pattern):
            m = pattern.count(length)
            rows.append((length, used.get(length, 0), m, sequence, offset))
            used[length] = used.get(length, 0) + m * count
            offset += m * length
        sequence += count
    assert used == length_of_ranks
    return pd.DataFrame(rows, columns=["length", "rank", "m", "sequence", "offset"]).sort_values(["length", "rank"])


def pack(docs: DataFrame, max_len: int = MAX_LEN, **options) -> DataFrame:
    """pieces() of every document with sequence_id and offset: gapless sequences of at most max_len.

    Null and empty texts are one id (0); rows that share an id, repeated rows and null ids are
    packed like others; ties are pieces of one length, dealt by content and id, and pieces alike
    in both may change places. A very long text is encoded slice by slice in one task and cut to
    many pieces. An empty table gives an empty result; other columns are ignored, whatever their
    names. Only the histogram of at most max_len lengths
    goes to the driver, and only the plan made of it comes back.
    """
    table = written(pieces(docs, max_len=max_len, **options), "pieces")
    n = table.count()
    buckets = max(1, -(-n // RANK_ROWS))
    # content decides the bucket; a bucket of a length is bounded, however common the length is
    table_b = table.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(buckets)))
    counts = table_b.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    histogram = {r.length: r.n for r in table.groupBy("length").agg(F.count(F.lit(1)).alias("n")).toLocalIterator()}
    plan = plan_packs(histogram, max_len)
    at = _places(plan, histogram)
    # searched by length and rank at once: a length's ranks follow those of shorter lengths
    shift = np.cumsum([0, *[histogram.get(k, 0) for k in range(1, max_len + 1)]])
    key = at["rank"].to_numpy(np.int64) + shift[at["length"].to_numpy(np.int64) - 1]
    m, seq, off, first = (at[c].to_numpy(np.int64) for c in ("m", "sequence", "offset", "rank"))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        length, rank = length.to_numpy(np.int64), rank.to_numpy(np.int64)
        p = np.searchsorted(key, rank + shift[length - 1], "right") - 1
        r = rank - first[p]
        return pd.DataFrame({"sequence_id": seq[p] + r // m[p], "offset": off[p] + (r % m[p]) * length})

    by = Window.partitionBy("length", "bucket").orderBy(F.col("doc_id").asc_nulls_last(), "start", "ids_crc32", "doc_tokens")
    ranked = table_b.withColumn("local", F.row_number().over(by) - 1).join(counts.drop("n"), ["length", "bucket"])
    placed = ranked.withColumn("place", place("length", F.col("local") + F.col("before")))
    return placed.select(*table.columns, "place.sequence_id", "place.offset")
