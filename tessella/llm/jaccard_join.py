"""N-gram Jaccard join by grouped prefixes.

Shingles have one global order: those of few documents first, by hash, then frequent ones by
the logarithm of their number of documents. Two sets with a Jaccard similarity of t share one
of the first n - ceil(t n) + 1 shingles of each. Documents whose prefix and size are equal are
one group; an inverted index over the prefixes holds groups, not documents, and equal posting
lists count once. Lists are filtered as wholes (sizes, then parity bitmaps, whose Hamming
distance never exceeds the symmetric difference), expanded to members (distinct sets, so that
copies are one member), and pairs that pass are verified on the sets.

Texts are shingled once: their sets are stored, six bytes a shingle, and all later passes read
those. Pairs are not all listed: the first round verifies every member with its most alike earlier
member of a list; the second verifies what else passes and is not yet in one component. Links
are then counted, not listed: every two sets of a component whose links are not all found yet
meet once, in blocks, and each block gives a number a set. That work grows with the square of
a component, as its links do.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_text, checked_join, local_names, release, shuffle_parts, written
from .graph import components
from .shingles import by_part, mix, pack48, pack_sorted, runs, shingle_sets, unpack48, unpack_sorted

#: Similarity as a fraction; shingles of at least 2**FREQUENT documents go last, FREQUENT_MOST of them at most.
NUM, DEN = 3, 4
FREQUENT, FREQUENT_MOST, LEVELS = 3, 2_000_000, 40
#: Shingles that a task holds before it deals them out; members of a list that meet in one task.
HELD, MEMBERS = 1 << 19, 2048
#: Members of many lists that one call works on.
BUCKET_MEMBERS = 1 << 15
STEP = 1024
PART_TOKENS = 1 << 20
#: Sets, and bytes of sets, of a component's block when links are counted; bytes of sets a call; shingles compared at once.
COUNT_MEMBERS, COUNT_BYTES, COUNT_CALL, COUNT_STEP = 1024, 4 << 20, 8 << 20, 1024


def prefix_size(n):
    """How many of a set's first shingles a similar set must share one of."""
    return n - (NUM * n + DEN - 1) // DEN + 1


def most_apart(a, b):
    """The largest symmetric difference that sets of these sizes may have (negative: none)."""
    least = (NUM * (a + b) + NUM + DEN - 1) // (NUM + DEN)
    return np.where(DEN * np.minimum(a, b) >= NUM * np.maximum(a, b), a + b - 2 * least, -1)


def _sets(batches: Iterator[pa.RecordBatch], size: int):
    for whole in batches:
        for a in range(0, whole.num_rows, STEP):
            b = whole.slice(a, STEP)
            yield (b, *shingle_sets(b.column(b.schema.get_field_index("text")), size))
    release()


def _stored(batches: Iterator[pa.RecordBatch]):
    """(batch, shingles, offsets) of stored sets (tokens), a bounded number of rows at once."""
    for whole in batches:
        for a in range(0, whole.num_rows, STEP):
            b = whole.slice(a, STEP)
            column = b.column(b.schema.get_field_index("tokens")).cast(pa.large_binary())
            _, offsets, data = column.buffers()
            at = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
            raw = data[int(at[0]):int(at[-1])] if data is not None else b""
            yield b, unpack48(raw), (at - at[0]) // 6
    release()


def shingle_table(texts: DataFrame, size: int) -> DataFrame:
    """(doc_id, cid, tokens): the set of every text (doc_id, text), stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, tokens, at in _sets(batches, size):
            packed = pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer((at * 6).astype(np.int64)), pa.py_buffer(pack48(tokens))])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(_class_ids(tokens, at).view(np.int64)), packed.cast(pa.binary())], ["doc_id", "cid", "tokens"])

    return written(texts.mapInArrow(run, "doc_id long, cid long, tokens binary"), "shingles")


def _class_ids(tokens: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 64-bit id of each set, from its members and its size; 0 where it is empty."""
    return _sums(mix(tokens, 3), at, salt=11)


def _sums(mixed: np.ndarray, at: np.ndarray, salt: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed, dtype=np.uint64)])
        n = np.diff(at).astype(np.uint64)
        h = mix(total[at[1:]] - total[at[:-1]] + mix(n, salt), salt + 1)
    return np.where(n > 0, h, 0).astype(np.uint64)


def frequent_shingles(sets: DataFrame, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingles, ascending; their level) of the most frequent ones: a table of bounded size.

    All shingles of the stored sets are counted; a level is the logarithm of the count. The lowest
    level that is told apart rises until FREQUENT_MOST shingles are left, which changes how
    much work the join does, never its result.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def emit():
            tokens, c = np.unique(np.concatenate(held), return_counts=True)
            part, a, b = by_part(tokens, bits)
            c = np.minimum(c, 65535).astype("<u2")
            return pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([pack_sorted(tokens[i:j]) for i, j in zip(a, b)], pa.binary()), pa.array([c[i:j].tobytes() for i, j in zip(a, b)], pa.binary())], ["part", "tokens", "counts"])

        for _, tokens, _ in _stored(batches):
            held.append(tokens)
            n += len(tokens)
            if n >= HELD:
                yield emit()
                held, n = [], 0
        if n:
            yield emit()

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        tokens = np.concatenate([unpack_sorted(x) for x in pdf["tokens"]])
        counts = np.concatenate([np.frombuffer(x, "<u2") for x in pdf["counts"]]).astype(np.int64)
        order = np.argsort(tokens, kind="stable")
        tokens, counts = tokens[order], counts[order]
        first, _ = runs(tokens)
        total = np.add.reduceat(counts, first)
        level = np.floor(np.log2(total)).astype(np.uint8)
        keep = level >= FREQUENT
        return pd.DataFrame({"part": pdf["part"][:1], "tokens": [tokens[first][keep].astype("<u8").tobytes()], "levels": [level[keep].tobytes()], "n": [np.bincount(level[keep], minlength=LEVELS)[:LEVELS].tolist()]})

    counted = sets.select("tokens").mapInArrow(count, "part long, tokens binary, counts binary")
    table = written(counted.groupBy("part").applyInPandas(merge, "part long, tokens binary, levels binary, n array<long>"), "frequent")
    per_level = table.agg(*[F.sum(F.col("n")[k]).alias(f"n{k}") for k in range(LEVELS)]).first()
    per_level = np.array([x or 0 for x in per_level])
    over = per_level[::-1].cumsum()[::-1]
    least = next(k for k in range(FREQUENT, LEVELS) if over[k] <= FREQUENT_MOST)
    tokens, levels = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint8)]
    for row in table.where("length(levels) > 0").orderBy("part").toLocalIterator():
        level = np.frombuffer(row.levels, np.uint8)
        keep = level >= least
        tokens.append(np.frombuffer(row.tokens, "<u8")[keep])
        levels.append(level[keep])
    return np.concatenate(tokens), np.concatenate(levels)


def _bitmaps(tokens: np.ndarray, at: np.ndarray) -> list[bytes]:
    """Parity bitmaps of 256 to 4096 bits, two or more bits a shingle where they can."""
    n = np.diff(at)
    width = np.clip(2 ** np.ceil(np.log2(np.maximum(n, 1) * 2)).astype(np.int64), 256, 4096)
    out = []
    for a in range(0, len(n), 256):
        b = min(len(n), a + 256)
        doc = np.repeat(np.arange(b - a), n[a:b])
        bit = (mix(tokens[at[a]:at[b]], 5) & (width[a:b][doc] - 1).astype(np.uint64)).astype(np.int64)
        packed = np.packbits((np.bincount(doc * 4096 + bit, minlength=(b - a) * 4096) & 1).astype(np.uint8).reshape(-1, 4096), axis=1)
        out += [packed[i, :w // 8].tobytes() for i, w in enumerate(width[a:b])]
    return out


class _Bitmaps:
    """Bitmaps of several widths; folded (by xor) to any width that they have or exceed."""

    def __init__(self, bitmaps: list[bytes]):
        self.width = np.array([len(x) for x in bitmaps])
        self.raw, self.at = np.frombuffer(b"".join(bitmaps), np.uint8), np.r_[0, np.cumsum(self.width)][:-1]
        self.folded: dict[int, np.ndarray] = {}

    def of(self, width: int) -> np.ndarray:
        if width not in self.folded:
            out = np.zeros((len(self.width), width), np.uint8)
            for w in np.unique(self.width[self.width >= width]):
                rows = np.flatnonzero(self.width == w)
                out[rows] = np.bitwise_xor.reduce(self.raw[self.at[rows][:, None] + np.arange(w)].reshape(len(rows), -1, width), axis=1)
            self.folded[width] = out.view(np.uint64)
        return self.folded[width]

    def hamming(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i), np.int64)
        narrow = np.minimum(self.width[i], self.width[j])
        for w in np.unique(narrow):
            at, rows = np.flatnonzero(narrow == w), self.of(int(w))
            for a in range(0, len(at), 1 << 15):
                k = at[a:a + (1 << 15)]
                out[k] = np.bitwise_count(rows[i[k]] ^ rows[j[k]]).sum(axis=1)
        return out


def _near_pairs(lists: np.ndarray, n: np.ndarray, label: np.ndarray | None, bitmaps: _Bitmaps) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(earlier, later, Hamming distance) of members of one list that may be similar.

    Members are ordered by list and size. The k-th pass pairs each member with the one k places
    on; a pair out of reach by size ends that member's passes.
    """
    out, live, k = [(np.zeros(0, np.int64),) * 3], np.arange(len(n) - 1), 1
    while len(live):
        live = live[live + k < len(n)]
        live = live[(lists[live] == lists[live + k]) & (DEN * n[live] >= NUM * n[live + k])]
        i, j = live, live + k
        if label is not None:
            apart = label[i] != label[j]
            i, j = i[apart], j[apart]
        far = bitmaps.hamming(i, j)
        ok = far <= most_apart(n[i], n[j])
        out.append((i[ok], j[ok], far[ok]))
        k += 1
    return tuple(np.concatenate(x) for x in zip(*out))


def _pairs_of_lists(everything: bool):
    """Pairs (a, b) of the members of a bucket's lists that may be similar, a < b.

    everything: all pairs of different labels. Else each member with its most alike earlier
    member, and (a, a) for every member that has a pair.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        lid, i, j, n, cid, label = (pdf[c].to_numpy(np.int64) for c in ("lid", "i", "j", "n", "cid", "label"))
        order = np.lexsort((cid, n, j, i, lid))
        lid, i, j, n, cid, label = (x[order] for x in (lid, i, j, n, cid, label))
        same = lambda x: x[1:] == x[:-1]
        lists = np.r_[0, np.cumsum(~(same(lid) & same(i) & same(j)))]
        new = np.r_[True, ~(same(lists) & same(cid))]
        lists, n, cid, label, order = (x[new] for x in (lists, n, cid, label, order))
        bitmaps = _Bitmaps([pdf["bitmap"].iat[k] for k in order])
        a, b, far = _near_pairs(lists, n, label if everything else None, bitmaps)
        if not everything and len(a):
            by = np.lexsort((far, b))
            a, b = a[by], b[by]
            used = np.unique(np.concatenate([a, b]))
            first = np.r_[True, b[1:] != b[:-1]]
            a, b = np.concatenate([a[first], used]), np.concatenate([b[first], used])
        pairs = np.unique(np.sort(np.stack([cid[a], cid[b]], axis=1), axis=1), axis=0)
        del bitmaps
        release()
        return pd.DataFrame(pairs, columns=["a", "b"])

    return run


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough."""

    @F.pandas_udf("boolean")
    def similar(x: pd.Series, y: pd.Series) -> pd.Series:
        out = []
        for p, q in zip(x, y):
            p, q = unpack48(p), unpack48(q)
            both = len(np.intersect1d(p, q, assume_unique=True))
            out.append(DEN * both >= NUM * (len(p) + len(q) - both))
        return pd.Series(out, dtype=bool)

    left = sets.select(F.col("cid").alias("a"), F.col("tokens").alias("x"))
    right = sets.select(F.col("cid").alias("b"), F.col("tokens").alias("y"))
    return pairs.where("a <> b").join(left, "a").join(right, "b").where(similar("x", "y")).select("a", "b")


def _shared(sets: list[np.ndarray], p: int) -> np.ndarray:
    """How many shingles each of the first p sets shares with each of the others (of all, if p is all)."""
    n = np.array([len(x) for x in sets])
    _, token, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    doc = np.repeat(np.arange(len(sets)), n)
    column = np.cumsum(times > 1) - 1
    doc, token = doc[times[token] > 1], column[token[times[token] > 1]]
    order = np.argsort(token, kind="stable")
    doc, token = doc[order], token[order]
    rest = 0 if p == len(sets) else p
    out = np.zeros((p, len(sets) - rest), np.float32)
    for c in range(0, int(token[-1]) + 1 if len(token) else 0, COUNT_STEP):
        a, b = np.searchsorted(token, [c, c + COUNT_STEP])
        has = np.zeros((len(sets), COUNT_STEP), np.float32)
        has[doc[a:b], token[a:b] - c] = 1
        out += has[:p] @ has[rest:].T
    return out.astype(np.int64)


def _count_links(pdf: pd.DataFrame) -> pd.DataFrame:
    """(cid, n_links): links of each set within its block, or between two blocks, of one component."""
    cids, counts = [], []
    for (_, i, j), part in pdf.groupby(["label", "i", "j"], sort=False):
        part = part.sort_values("block", kind="stable")
        sets = [unpack48(x) for x in part["tokens"]]
        n = np.array([len(x) for x in sets])
        p = len(sets) if i == j else int((part["block"] == i).sum())
        if not p or (i != j and p == len(sets)):
            continue  # one of the two blocks is empty
        rest = 0 if i == j else p
        both = _shared(sets, p)
        linked = DEN * both >= NUM * (n[:p, None] + n[None, rest:] - both)
        if i == j:
            np.fill_diagonal(linked, False)
            counts.append(linked.sum(axis=1))
        else:
            counts.append(np.concatenate([linked.sum(axis=1), linked.sum(axis=0)]))
        cids.append(part["cid"].to_numpy(np.int64))
    release()
    if not cids:
        return pd.DataFrame({"cid": np.zeros(0, np.int64), "n_links": np.zeros(0, np.int64)})
    cid, at = np.unique(np.concatenate(cids), return_inverse=True)
    return pd.DataFrame({"cid": cid, "n_links": np.bincount(at, np.concatenate(counts), len(cid)).astype(np.int64)})


def _all_links(links: DataFrame, labels: DataFrame, sets: DataFrame) -> DataFrame:
    """(cid, n_links) of every linked set, from the links found (a, b), components (node, label) and sets.

    Two sets that are similar are in one component; a component of k sets whose k(k-1)/2 links
    were all found is done, the sets of any other are compared in blocks, every two blocks once.
    """
    spark = links.sparkSession
    found = links.join(labels, links["a"] == labels["node"]).groupBy("label").agg(F.count(F.lit(1)).alias("m"))
    size = labels.groupBy("label").agg(F.count(F.lit(1)).alias("k"))
    todo = size.join(found, "label").where("2 * m < k * (k - 1)").select("label")
    ends = links.select(F.explode(F.array("a", "b")).alias("cid")).groupBy("cid").agg(F.count(F.lit(1)).alias("n_links"))
    todo = labels.join(todo, "label").select(F.col("node").alias("cid"), "label")
    members = written(todo.join(sets, "cid"), "open")
    bytes_of = F.sum(F.octet_length("tokens").cast("long"))
    blocks = members.groupBy("label").agg(F.ceil(F.greatest(F.count(F.lit(1)) / COUNT_MEMBERS, bytes_of / COUNT_BYTES)).alias("blocks"), bytes_of.alias("bytes"))
    blocks = written(blocks, "blocks")
    volume = blocks.agg(F.sum(F.col("bytes") * F.col("blocks"))).first()[0] or 0
    members = members.join(blocks.drop("bytes"), "label").withColumn("block", F.pmod("cid", "blocks"))
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    members = members.select("label", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "cid", "tokens")
    buckets = max(4 * shuffle_parts(spark), -(-volume // COUNT_CALL))
    bucket = F.pmod(F.xxhash64("label", "i", "j"), F.lit(buckets)).alias("bucket")
    counted = members.groupBy(bucket).applyInPandas(_count_links, "cid long, n_links long").groupBy("cid").agg(F.sum("n_links").alias("n_links"))
    return ends.join(todo, "cid", "left_anti").unionByName(counted)


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, count: bool = True) -> DataFrame:
    """(doc_id, n_shingles, component_id, class_id, class_hash[, n_links]) of every row of docs.

    component_id is the smallest doc_id that links reach; class_id the smallest doc_id with an
    equal set, class_hash that set's hash; n_links, if count, the number of all other classes
    that are similar to the row's class. Null, empty and blank texts have 0 shingles and are
    linked with nothing: their component and class are their own doc_id. Rows with a null doc_id
    take part, and have a null component or class if all of its ids are null; repeated rows and
    equal sets (ties) are members of one class. A very long text is shingled in pieces, and its
    set is one row. An empty table gives an empty result; other columns are ignored, whatever
    their names.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), as_text(F.col(text_col)).alias("text"))
    stored = shingle_table(texts, size)
    volume = (stored.agg(F.sum(F.octet_length("tokens"))).first()[0] or 0) // 6
    bits = max(4, int(max(4 * shuffle_parts(spark), volume // PART_TOKENS)).bit_length())
    frequent = spark.sparkContext.broadcast(frequent_shingles(stored, bits))

    def levels(tokens: np.ndarray) -> np.ndarray:
        hot, level = frequent.value
        if not len(hot):
            return np.zeros(len(tokens), np.uint8)
        i = np.minimum(np.searchsorted(hot, tokens), len(hot) - 1)
        return np.where(hot[i] == tokens, level[i], 0).astype(np.uint8)

    def prefixes(tokens: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each set's prefix, and its offsets."""
        n = np.diff(at)
        doc = np.repeat(np.arange(len(n)), n)
        order = np.argsort(doc * 64 + levels(tokens), kind="stable")
        rank = np.arange(len(tokens)) - at[doc]
        keep = rank < prefix_size(n)[doc]
        return tokens[order][keep], np.r_[0, np.cumsum(np.where(n > 0, prefix_size(n), 0))]

    def group_ids(prefix: np.ndarray, at: np.ndarray, p_at: np.ndarray) -> np.ndarray:
        """A 64-bit id of each set's prefix and size."""
        with np.errstate(over="ignore"):
            return _sums(mix(prefix, 1) + np.repeat(mix(np.diff(at).astype(np.uint64), 2), np.diff(p_at)), p_at, 21)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, tokens, at in _stored(batches):
            prefix, p_at = prefixes(tokens, at)
            group = group_ids(prefix, at, p_at)
            yield pa.RecordBatch.from_arrays([
                b.column(0), pa.array(np.diff(at)), b.column(1), pa.array(group.view(np.int64)), pa.array(_bitmaps(tokens, at), pa.binary()),
            ], ["doc_id", "n", "cid", "gid", "bitmap"])

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, groups, n = [], [], 0

        def emit():
            t, g = np.concatenate(held), np.concatenate(groups)
            order = np.lexsort((g, t))
            t, g = t[order], g[order]
            new = np.r_[True, (t[1:] != t[:-1]) | (g[1:] != g[:-1])]
            t, g = t[new], g[new]
            part, a, b = by_part(t, bits)
            return pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([pack_sorted(t[i:j]) for i, j in zip(a, b)], pa.binary()), pa.array([g[i:j].astype("<u8").tobytes() for i, j in zip(a, b)], pa.binary())], ["part", "tokens", "groups"])

        for _, tokens, at in _stored(batches):
            prefix, p_at = prefixes(tokens, at)
            group = group_ids(prefix, at, p_at)
            held.append(prefix)
            groups.append(np.repeat(group, np.diff(p_at)))
            n += len(prefix)
            if n >= HELD:
                yield emit()
                held, groups, n = [], [], 0
        if n:
            yield emit()

    def lists(pdf: pd.DataFrame) -> pd.DataFrame:
        t = np.concatenate([unpack_sorted(x) for x in pdf["tokens"]])
        g = np.concatenate([np.frombuffer(x, "<u8") for x in pdf["groups"]])
        order = np.lexsort((g, t))
        t, g = t[order], g[order]
        new = np.r_[True, (t[1:] != t[:-1]) | (g[1:] != g[:-1])]
        t, g = t[new], g[new]
        first, length = runs(t)
        many = length > 1
        first, length = first[many], length[many]
        with np.errstate(over="ignore"):
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(g, 4), dtype=np.uint64)])
            sign = total[first + length] - total[first]
        sign, at = np.unique(sign, return_index=True)
        found = [g[first[i]:first[i] + length[i]].view(np.int64).tolist() for i in at]
        return pd.DataFrame({"lid": sign.view(np.int64), "groups": pd.Series(found, dtype=object)})

    rows = written(stored.mapInArrow(describe, "doc_id long, n long, cid long, gid long, bitmap binary"), "sets")
    classes = written(rows.where("n > 0").groupBy("cid", "gid", "n").agg(F.min("doc_id").alias("rep"), F.first("bitmap").alias("bitmap")), "classes")
    posted = stored.select("tokens").mapInArrow(post, "part long, tokens binary, groups binary")
    listed = posted.groupBy("part").applyInPandas(lists, "lid long, groups array<long>").dropDuplicates(["lid"])
    entries = listed.select("lid", F.explode("groups").alias("gid"))
    # a group of several distinct sets is a list of its own
    several = classes.groupBy("gid").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    entries = written(entries.union(several.select(F.col("gid").alias("lid"), "gid")), "entries")
    members = entries.join(classes.select("gid", "cid", "n", "bitmap"), "gid")
    # lists longer than MEMBERS are cut in blocks by the class id, and every two blocks meet
    blocks = entries.join(classes.groupBy("gid").agg(F.count(F.lit(1)).alias("k")), "gid").groupBy("lid").agg(F.ceil(F.sum("k") / MEMBERS).alias("blocks"))
    members = members.join(blocks, "lid").withColumn("block", F.pmod("cid", "blocks"))
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    members = members.select("lid", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "cid", "n", "bitmap")
    members = written(members, "members")
    by = ["lid", "i", "j"]
    buckets = max(4 * shuffle_parts(spark), -(-members.count() // BUCKET_MEMBERS))
    bucket = F.pmod(F.xxhash64(*by), F.lit(buckets)).alias("bucket")
    near = written(members.withColumn("label", F.lit(0).cast("long")).groupBy(bucket).applyInPandas(_pairs_of_lists(False), "a long, b long").distinct(), "near")

    wanted = written(near.select(F.explode(F.array("a", "b")).alias("cid")).distinct().join(classes.select("cid", "rep"), "cid").select("cid", "rep").distinct(), "wanted")

    # one document of each class gives its set; classes whose documents all lack an id are found by class
    ids = wanted.where("rep is not null").select(F.col("rep").alias("doc_id"), "cid")
    sets = checked_join(stored, ids, ["doc_id", "cid"], "left_semi", 32).select("cid", "tokens")
    without = wanted.where("rep is null").select("cid")
    if not without.isEmpty():
        sets = sets.unionByName(checked_join(stored.where("doc_id is null"), without, "cid", "left_semi", 24).select("cid", "tokens"))
    sets = written(sets.dropDuplicates(["cid"]), "tokens")
    links = written(_verified(near, sets), "links")
    labels = components(links)
    # what passes and is not yet joined
    label = F.coalesce("label", F.col("cid"))
    labelled = members.join(labels.select(F.col("node").alias("cid"), "label"), "cid", "left").withColumn("label", label)
    open_lists = labelled.groupBy(*by).agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select(*by)
    rest = labelled.join(open_lists, by).groupBy(bucket).applyInPandas(_pairs_of_lists(True), "a long, b long").distinct()
    more = written(_verified(rest.join(near, ["a", "b"], "left_anti"), sets), "links")
    links = written(links.union(more).distinct(), "links")
    labels = components(links)
    reps = classes.join(labels.select(F.col("node").alias("cid"), "label"), "cid", "left").select("cid", "rep", F.coalesce("label", F.col("cid")).alias("label"))
    least = reps.groupBy("label").agg(F.min("rep").alias("component_id"))
    of_class = reps.join(least, "label").select("cid", "component_id", "rep")
    if count:
        links_of = _all_links(links, written(labels, "labels"), sets)
        of_class = of_class.join(links_of, "cid", "left").withColumn("n_links", F.coalesce("n_links", F.lit(0)).cast("long"))
    out = checked_join(rows.select("doc_id", "n", "cid"), written(of_class, "components"), "cid", "left", 56)
    own = lambda c: F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col(c))
    n_links = [F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")] * count
    return out.select("doc_id", F.col("n").alias("n_shingles"), own("component_id").alias("component_id"), own("rep").alias("class_id"), F.col("cid").alias("class_hash"), *n_links)


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5) -> DataFrame:
    """The rows of docs, as they are, that are the smallest id of their component (or have no id).

    Rows are told apart by their id and class: of several classes of a component that have its
    smallest id, one stays. Texts are shingled again only where an id has rows of both kinds.
    """
    joined = jaccard_components(docs, id_col, text_col, size, count=False).where("doc_id is not null").groupBy("doc_id", "class_hash")
    joined = written(joined.agg(F.first("component_id").alias("component_id"), F.max("n_shingles").alias("n")), "joined")
    least = joined.where("n > 0 and doc_id = component_id").groupBy("doc_id").agg(F.min("class_hash").alias("least"))
    stays = F.coalesce((F.col("doc_id") == F.col("component_id")) & ((F.col("n") == 0) | (F.col("class_hash") == F.col("least"))), F.lit(False))
    rows = joined.join(least, "doc_id", "left").withColumn("stays", stays)
    ids = rows.groupBy("doc_id").agg(F.min("stays").alias("all"), F.max("stays").alias("any"))
    gone = written(ids.where("not all").select(F.col("doc_id").alias(id_col), "any"), "gone")
    out = checked_join(docs, gone.select(id_col), id_col, "left_anti", 24)
    both = gone.where("any").select(id_col)
    if both.isEmpty():
        return out

    @F.pandas_udf("long")
    def class_of(text: pd.Series) -> pd.Series:
        found = [_class_ids(*shingle_sets(pa.array(text[a:a + STEP], pa.string()), size)).view(np.int64) for a in range(0, len(text), STEP)]
        return pd.Series(np.concatenate(found) if found else np.zeros(0, np.int64))

    (name,) = local_names(docs, "class_hash")
    kept = written(rows.where("stays").select(F.col("doc_id").alias(id_col), F.col("class_hash").alias(name)).join(both, id_col, "left_semi"), "kept")
    mixed = checked_join(docs, both, id_col, "left_semi", 24).withColumn(name, class_of(as_text(F.col(text_col))))
    return out.unionByName(checked_join(mixed, kept, [id_col, name], "left_semi", 32).select(*docs.columns))
