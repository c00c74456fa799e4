"""Suffix-array dedup: bytes of passages that a document with a smaller id has too.

Every WINDOW-byte string belongs to the anchor gram it holds (see anchors.py). Stretches of
text around equal grams meet in one task, as hashes first: of equal stretches (112 bits of
hashes) the smallest document keeps its own and the others lose all of theirs; copies within a
task are settled before the shuffle, and spans of one document merged. Stretches around a gram
that differ are fetched and cut down to the windows that several documents may have; of equal
ones the smallest document keeps its own again, and what differs is sorted by a suffix array
(suffix_sort.py), in which equal windows stand next to each other and the smallest document of
each run is read off. A gram with more than HOT different stretches is dealt by its windows, so
that no task gets all of them. What is to go is merged for each document and cut out of its text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import GRAM, WINDOW, anchors
from .common import as_text, checked_join, release, shuffle_parts, written
from .shingles import BITS, MASK, PIECE, U, _P, _P_INV, _power, by_part, mix, pack48, pack_sorted, runs, text_bytes, unpack48, unpack_sorted

HELD = 1 << 19
PART_ANCHORS = 1 << 19
STEP = 2048
#: Symbols that one suffix array holds, unless a single gram's stretches are more.
SORTED = 1 << 15
#: Different stretches of one gram that meet in one task; windows of a gram with more are dealt one by one.
HOT = 4096
#: Fetched stretches that are dealt at once.
FETCHED = 1 << 15
#: Settled spans of a packed row.
SETTLED = 1 << 15
#: Texts that share an id are parts of one document, so many bytes apart.
SEGMENT = 40


def _narrow(x: np.ndarray) -> bytes:
    """Whole numbers as differences from the smallest, in as few bytes as they need."""
    low = int(x.min()) if len(x) else 0
    d = (x - low).astype(np.uint64)
    width = next(w for w in (1, 2, 4, 8) if w == 8 or not len(d) or int(d.max()) < 1 << (8 * w))
    return bytes([width]) + low.to_bytes(8, "little", signed=True) + d.astype(f"<u{width}").tobytes()


def _wide(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"<u{raw[0]}", offset=9).astype(np.int64) + int.from_bytes(raw[1:9], "little", signed=True)


def _maximal(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, start, end) of the maximal runs of documents' spans."""
    if not len(doc):
        return doc, start, end
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    by_end = np.lexsort((end, doc))
    rank = np.empty(len(doc), np.int64)
    rank[by_end] = np.arange(len(doc))
    reach = end[by_end[np.maximum.accumulate(rank)]]
    first = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (start[1:] > reach[:-1])])
    return doc[first], start[first], reach[np.r_[first[1:], len(doc)] - 1]


def _of_docs(doc: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """(documents, their rows of columns as packed 64-bit numbers)."""
    order = np.argsort(doc, kind="stable")
    doc, table = doc[order], np.stack([c[order] for c in columns], axis=1).astype("<i8")
    first, n = runs(doc)
    return doc[first], [table[a:a + k].tobytes() for a, k in zip(first, n)]


FIELDS = ["keys", "whole", "doc", "start", "length", "at"]


def _dealt(bits: int):
    """Anchors of a task's texts, dealt by their gram's hash, as packed rows.

    Of equal stretches in a task only those of the smallest document go on; the others are
    settled, and travel as merged spans under part numbers of 2**bits and more.
    """

    def emit(held):
        key, whole, doc, start, length, at = (np.concatenate(x) for x in zip(*held))
        order = np.lexsort((doc, whole, key))
        key, whole, doc, start, length, at = (x[order] for x in (key, whole, doc, start, length, at))
        new = np.r_[True, (key[1:] != key[:-1]) | (whole[1:] != whole[:-1])]
        gone = doc > doc[np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))]
        d, s, e = _maximal(doc[gone], start[gone], start[gone] + length[gone])
        key, whole, doc, start, length, at = (x[~gone] for x in (key, whole, doc, start, length, at))
        part, a, b = by_part(key, bits)
        cols = [[pack_sorted(key[i:j]), whole[i:j].astype("<u8").tobytes(), _narrow(doc[i:j]), _narrow(start[i:j]), _narrow(length[i:j]), at[i:j].tobytes()] for i, j in zip(a, b)]
        settled = range(0, len(d), SETTLED)
        cols += [[pack_sorted(key[:0]), b"", *(_narrow(x[i:i + SETTLED]) for x in (d, s, e - s)), b""] for i in settled]
        part = np.concatenate([part, [(1 << bits) + int(d[i]) * 0x9E3779B1 % (1 << bits) for i in settled]]).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), *(pa.array([c[k] for c in cols], pa.binary()) for k in range(6))], ["part", *FIELDS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for whole in batches:
            for i in range(0, whole.num_rows, STEP):
                b = whole.slice(i, STEP)
                doc, start, length, at, gram, around = anchors(*text_bytes(b.column(2)))
                ids = b.column(0).to_numpy(zero_copy_only=False)[doc]
                seg = b.column(1).to_numpy(zero_copy_only=False)[doc].astype(np.int64) << SEGMENT
                held.append((gram & MASK, around, ids.astype(np.int64), start + seg, length.astype(np.uint8), at.astype(np.uint8)))
                n += len(doc)
                if n >= HELD:
                    yield emit(held)
                    held, n = [], 0
        if n:
            yield emit(held)
        release()

    return run


def _opened(pdf: pd.DataFrame) -> list[np.ndarray]:
    key, doc, start, length = (np.concatenate([f(x) for x in pdf[c]]) for c, f in (("keys", unpack_sorted), ("doc", _wide), ("start", _wide), ("length", _wide)))
    whole, at = (np.frombuffer(b"".join(pdf[c]), t) for c, t in (("whole", "<u8"), ("at", np.uint8)))
    return [key, whole, doc, start, length, at.astype(np.int64)]


FOUND = "doc long, asked boolean, raw binary"
#: A stretch to fetch; the key's bits from BITS on say whether its gram is hot.
ASKED = np.dtype([("start", "<i8"), ("key", "<u8"), ("length", "u1"), ("at", "u1")])


def _found(doc, asked: bool, *columns) -> pd.DataFrame:
    docs, raw = _of_docs(doc, *columns)
    return pd.DataFrame({"doc": docs, "asked": np.full(len(docs), asked), "raw": pd.Series(raw, dtype=object)})


def _requests(doc, *columns) -> pd.DataFrame:
    order = np.argsort(doc, kind="stable")
    table = np.empty(len(doc), ASKED)
    for name, c in zip(ASKED.names, columns):
        table[name] = c[order]
    first, n = runs(doc[order])
    raw = [table[a:a + k].tobytes() for a, k in zip(first, n)]
    return pd.DataFrame({"doc": doc[order][first], "asked": np.full(len(first), True), "raw": pd.Series(raw, dtype=object)})


def _compare(bits: int):
    """Per document of a part: spans that go (start, end), and asked stretches (ASKED)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        key, whole, doc, start, length, at = _opened(pdf)
        if pdf["part"].iat[0] >> bits:
            return _found(doc, False, start, start + length)
        order = np.lexsort((doc, whole, key))
        key, whole, doc, start, length, at = (x[order] for x in (key, whole, doc, start, length, at))
        k_first, k_n = runs(key)
        several = np.minimum.reduceat(doc, k_first) < np.maximum.reduceat(doc, k_first)
        keep = np.repeat(several, k_n)
        key, whole, doc, start, length, at = (x[keep] for x in (key, whole, doc, start, length, at))
        if not len(key):
            return _found(doc, False, start, start)
        c_first = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (whole[1:] != whole[:-1])])
        c_n = np.diff(np.r_[c_first, len(key)])
        mine = doc == np.repeat(doc[c_first], c_n)  # of the smallest document with that stretch
        k_first, k_n = runs(key[c_first])
        stretches = np.repeat(np.repeat(k_n, k_n), c_n)
        ask = mine & (stretches > 1)
        d, s, e = _maximal(doc[~mine], start[~mine], start[~mine] + length[~mine])
        out = [_found(d, False, s, e), _requests(doc[ask], *(x[ask] for x in (start, key | ((stretches > HOT).astype(np.uint64) << U(BITS)), length, at)))]
        return pd.concat([x for x in out if len(x)] or out[:1])

    return run


def _gathered(raw: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """raw[start:start + length] of all, one behind the other."""
    out = [raw[:0]]
    for i in range(0, len(start), STEP):
        a, n = start[i:i + STEP], length[i:i + STEP]
        out.append(raw[np.repeat(a - np.cumsum(n) + n, n) + np.arange(int(n.sum()))])
    return np.concatenate(out)


STRETCHES = ["keys", "doc", "start", "length", "at", "raw"]


def _packed(part, key, doc, start, length, at, raw) -> pa.RecordBatch:
    """Stretches with their bytes, one row for each part."""
    order = np.argsort(part, kind="stable")
    begin = (np.cumsum(length) - length)[order]
    part, key, doc, start, length, at = (x[order] for x in (part, key, doc, start, length, at))
    raw = _gathered(raw, begin, length)
    ends = np.r_[0, np.cumsum(length)]
    first, n = runs(part)
    cols = [[pack48(key[i:j]), _narrow(doc[i:j]), _narrow(start[i:j]), length[i:j].astype(np.uint8).tobytes(), at[i:j].astype(np.uint8).tobytes(), raw[ends[i]:ends[j]].tobytes()] for i, j in zip(first, first + n)]
    return pa.RecordBatch.from_arrays([pa.array(part[first].astype(np.int64), pa.int64()), *(pa.array([c[k] for c in cols], pa.binary()) for k in range(6))], ["part", *STRETCHES])


def _fetch(bits: int):
    """Asked stretches of each text, with their bytes; those of a hot gram as single windows, dealt by their bytes."""

    def stretches(raw, key, doc, at_text, start, length, at):
        """Held columns of some stretches; at_text is where they start in raw."""
        hot = key >> U(BITS) > 0
        key = key & MASK
        cold = ~hot
        yield key[cold] >> U(BITS - bits), key[cold], doc[cold], start[cold], length[cold], at[cold], _gathered(raw, at_text[cold], length[cold])
        for k in np.flatnonzero(hot).tolist():
            o = np.arange(length[k] - WINDOW + 1)
            windows = raw[at_text[k] + o[:, None] + np.arange(WINDOW)]
            with np.errstate(over="ignore"):
                h = mix((windows.astype(np.uint64) * _power(_P, WINDOW)[:WINDOW]).sum(axis=1) + key[k])
            yield h >> U(64 - bits), np.full(len(o), key[k]), np.full(len(o), doc[k]), start[k] + o, np.full(len(o), WINDOW), at[k] - o, windows.ravel()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            raw, offsets = text_bytes(b.column(2))
            ids, segs = (b.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            asked = [np.frombuffer(b"".join(x), ASKED) for x in b.column(3).to_pylist()]
            row = np.repeat(np.arange(len(asked)), [len(x) for x in asked])
            asked = np.concatenate(asked)
            here = asked["start"] >> SEGMENT == segs[row]
            asked, row = asked[here], row[here]
            for i in range(0, len(asked), FETCHED):
                x, r = asked[i:i + FETCHED], row[i:i + FETCHED]
                at_text = offsets[r] + (x["start"] & ((1 << SEGMENT) - 1))
                for columns in stretches(raw, x["key"], ids[r].astype(np.int64), at_text, x["start"], x["length"].astype(np.int64), x["at"].astype(np.int64)):
                    held.append(columns)
                    n += len(columns[0])
                    if n >= FETCHED:
                        yield _packed(*(np.concatenate(c) for c in zip(*held)))
                        held, n = [], 0
        if n:
            yield _packed(*(np.concatenate(c) for c in zip(*held)))
        release()

    return run


def _shared(doc: np.ndarray, length: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(stretch, start, end) of runs of windows that stretches of several documents may have: all that do, by a 64-bit hash."""
    begin, n = np.cumsum(length) - length, length - WINDOW + 1
    of = np.repeat(np.arange(len(n)), n)
    offset = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    m = len(raw)
    with np.errstate(over="ignore"):
        total = np.zeros(m + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + U(1)) * _power(_P, m)[:m], out=total[1:])
        at = begin[of] + offset
        h = (total[at + WINDOW] - total[at]) * _power(_P_INV, m + 1)[at]
    order = np.argsort(h)
    first = np.flatnonzero(np.r_[True, np.diff(h[order]) != 0])
    docs = doc[of[order]]
    several = np.minimum.reduceat(docs, first) < np.maximum.reduceat(docs, first)
    shared = np.zeros(len(of), bool)
    shared[order] = np.repeat(several, np.diff(np.r_[first, len(of)]))
    of, offset = of[shared], offset[shared]
    if not len(of):
        return of, offset, offset
    new = np.flatnonzero(np.r_[True, (of[1:] != of[:-1]) | (offset[1:] != offset[:-1] + 1)])
    return of[new], offset[new], offset[np.r_[new[1:], len(of)] - 1] + WINDOW


def _sorted_windows(keys, docs, ats, raws) -> tuple[np.ndarray, np.ndarray]:
    """(stretch, offset) of windows that a smaller document has too, by one suffix array.

    A stretch is its bytes with the gram as one symbol of its own, and an end; windows that hold
    the gram are equal iff so many symbols are.
    """
    from .suffix_sort import suffix_array

    n_symbols = WINDOW - GRAM + 1
    grams = [(k, r[at:at + GRAM]) for k, at, r in zip(keys, ats, raws)]
    names = {g: 257 + i for i, g in enumerate(dict.fromkeys(grams))}
    lens = np.array([len(r) - GRAM + 2 for r in raws])
    begin = np.cumsum(lens) - lens
    text = np.ones(int(lens.sum()) + 1, np.int64)
    for b, n, g, at, r in zip(begin.tolist(), lens.tolist(), grams, ats, raws):
        x = np.frombuffer(r, np.uint8)
        text[b:b + at] = x[:at] + 2
        text[b + at] = names[g] + 2
        text[b + at + 1:b + n - 1] = x[at + GRAM:] + 2
    text[-1] = 0
    order = np.array(suffix_array(text))
    of = np.repeat(np.arange(len(lens)), lens)
    order = order[order < len(of)]
    s = of[order]
    offset = order - begin[s]
    ok = (offset <= np.asarray(ats)[s]) & (offset + n_symbols < lens[s])
    order, s, offset = order[ok], s[ok], offset[ok]
    if not len(order):
        return s, offset
    windows = text[order[:, None] + np.arange(n_symbols)]
    first = np.flatnonzero(np.r_[True, (windows[1:] != windows[:-1]).any(axis=1)])
    doc = np.asarray(docs)[s]
    least = np.repeat(np.minimum.reduceat(doc, first), np.diff(np.r_[first, len(doc)]))
    go = doc > least
    return s[go], offset[go]


def _resolve(pdf: pd.DataFrame) -> pd.DataFrame:
    """Spans that go of all asked stretches of a part, by blocks of grams.

    Stretches are first cut down to the windows that another document may have. Of equal ones
    (by their bytes) the smallest document keeps its own; what differs within a gram is sorted.
    """
    key, doc, start, length, at = (np.concatenate([f(x) for x in pdf[c]]) for c, f in (("keys", unpack48), ("doc", _wide), ("start", _wide), ("length", _bytes), ("at", _bytes)))
    raw = np.frombuffer(b"".join(pdf["raw"]), np.uint8)
    order = np.lexsort((start, doc, key))
    begin = (np.cumsum(length) - length)[order]
    key, doc, start, length, at = (x[order] for x in (key, doc, start, length, at))
    grams, _ = runs(key)
    ends = np.cumsum(length)
    ends = ends[np.r_[grams[1:], len(key)] - 1]  # bytes up to each gram's end
    out = [np.zeros((0, 3), np.int64)]
    g = 0
    while g < len(grams):
        to = max(g + 1, int(np.searchsorted(ends, (ends[g - 1] if g else 0) + PIECE, "right")))
        a, b = grams[g], grams[to] if to < len(grams) else len(key)
        out += _settled(key[a:b], doc[a:b], start[a:b], length[a:b], at[a:b], _gathered(raw, begin[a:b], length[a:b]))
        g = to
    doc, start, length = np.concatenate(out).T
    doc, start, end = _maximal(doc, start, start + length)
    return _found(doc, False, start, end)


def _bytes(x: bytes) -> np.ndarray:
    return np.frombuffer(x, np.uint8).astype(np.int64)


def _settled(key, doc, start, length, at, raw) -> list[np.ndarray]:
    """(doc, start, length) rows that go of stretches in the order of grams and documents."""
    s, low, high = _shared(doc, length, raw)
    begin, whole = (np.cumsum(length) - length)[s], raw.tobytes()
    raws = [whole[i:j] for i, j in zip((begin + low).tolist(), (begin + high).tolist())]
    keys, docs = key[s].tolist(), doc[s].tolist()
    starts, ats = (start[s] + low).tolist(), (at[s] - low).tolist()
    owner: dict[tuple[int, bytes], int] = {}
    kinds: dict[int, int] = {}
    gone, left = [], []
    for i, k in enumerate(zip(keys, raws)):
        d = owner.get(k)
        if d is None:
            owner[k] = docs[i]
            kinds[k[0]] = kinds.get(k[0], 0) + 1
        elif docs[i] > d:
            gone.append((docs[i], starts[i], len(raws[i])))
            continue
        left.append(i)
    left = [i for i in left if kinds[keys[i]] > 1]
    out = [np.array(gone, np.int64).reshape(-1, 3)]
    keys, docs, starts, ats, raws = ([x[i] for i in left] for x in (keys, docs, starts, ats, raws))
    a = 0
    while a < len(keys):
        b, size = a, 0
        while b < len(keys) and (size < SORTED or keys[b] == keys[b - 1]):
            size += len(raws[b]) - GRAM + 2
            b += 1
        s, offset = _sorted_windows(keys[a:b], docs[a:b], ats[a:b], raws[a:b])
        order = np.lexsort((offset, s))
        s, offset = s[order], offset[order]
        if len(s):
            first = np.flatnonzero(np.r_[True, (s[1:] != s[:-1]) | (offset[1:] != offset[:-1] + 1)])
            last = np.r_[first[1:], len(s)] - 1
            out.append(np.stack([np.array(docs[a:b])[s[first]], np.array(starts[a:b])[s[first]] + offset[first], offset[last] - offset[first] + WINDOW], axis=1))
        a = b
    return out


def _cut(seg: int, text: str, spans: list[bytes] | None) -> tuple[bytes, int, int, int, bytes]:
    """(what is left, bytes, bytes removed, runs removed, those runs) of one text."""
    raw = text.encode()
    x = np.frombuffer(b"".join(spans or []), "<i8").reshape(-1, 2)
    x = x[(x[:, 0] >> SEGMENT) == seg] & ((1 << SEGMENT) - 1)
    _, start, end = _maximal(np.zeros(len(x), np.int64), x[:, 0], x[:, 1])
    left, at = [], 0
    for a, b in zip(start.tolist(), end.tolist()):
        left.append(raw[at:a])
        at = b
    left.append(raw[at:])
    return b"".join(left), len(raw), int((end - start).sum()), len(start), np.stack([start, end], axis=1).astype("<i8").tobytes()


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept, spans]) of every row of docs.

    A byte goes if a WINDOW-byte string over it starts in a document with a smaller id, too;
    strings are those of the input. Null and empty texts have no bytes. Rows with a null id are
    smaller than none and larger than none: they lose nothing. Rows that share an id are one
    document: none is smaller than the other, so that repeated rows keep what only they have.
    Ties need no rule, as ids differ. A very long text is read in pieces of bounded size, and
    is one row of one task. An empty table gives an empty result; other columns are ignored,
    whatever their names. kept is what is left (binary), spans the removed [start, end) bytes.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), as_text(F.col(text_col)).alias("text"))
    same = written(rows.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id"), "same")
    seg = F.lit(0).cast("long")
    if not same.isEmpty():
        ids = checked_join(rows, same, "doc_id", "left_semi", 24).select("doc_id", F.xxhash64("text").alias("th"))
        twice = written(ids.groupBy("doc_id").agg(F.array_sort(F.collect_set("th")).alias("ths")), "twice")
        rows = checked_join(rows, twice, "doc_id", "left", 64)
        seg = F.coalesce(F.array_position("ths", F.xxhash64("text")) - 1, F.lit(0).cast("long"))
    rows = rows.select("doc_id", seg.alias("seg"), "text")
    volume = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(4, int(max(4 * shuffle_parts(spark), volume // 12 // PART_ANCHORS)).bit_length())
    dealt = rows.where("doc_id is not null").mapInArrow(_dealt(bits), "part long, " + ", ".join(f"{f} binary" for f in FIELDS))
    found = written(dealt.groupBy("part").applyInPandas(_compare(bits), FOUND), "found")
    asked = found.where("asked").groupBy(F.col("doc").alias("doc_id")).agg(F.collect_list("raw").alias("asked"))
    # requests and spans grow with the input: texts are shuffled to them at every size
    fetched = rows.join(asked.hint("merge"), "doc_id").select("doc_id", "seg", "text", "asked").mapInArrow(_fetch(bits), "part long, " + ", ".join(f"{f} binary" for f in STRETCHES))
    more = fetched.groupBy("part").applyInPandas(_resolve, FOUND)
    spans = found.where("not asked").union(more).groupBy(F.col("doc").alias("doc_id")).agg(F.collect_list("raw").alias("spans"))
    spans = written(spans, "spans")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cut = [_cut(*x) for x in zip(*(b.column(k).to_pylist() for k in (1, 2, 3)))]
            cols = [b.column(0), *(pa.array([c[k] for c in cut], pa.int64()) for k in (1, 2, 3)), pa.array([hashlib.sha256(c[0]).hexdigest() for c in cut], pa.string())]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if keep_text:
                cols, names = [*cols, pa.array([c[0] for c in cut], pa.binary()), pa.array([c[4] for c in cut], pa.binary())], [*names, "kept", "spans"]
            yield pa.RecordBatch.from_arrays(cols, names)
        release()

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary, spans binary" * keep_text
    return rows.join(spans.hint("merge"), "doc_id", "left").select("doc_id", "seg", "text", "spans").mapInArrow(finish, schema)
