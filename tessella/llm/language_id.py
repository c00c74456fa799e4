"""Language identification by hyperdimensional profiles.

Every letter owns a random vector of +1 and -1. A letter n-gram is bound from its letters'
vectors, each rotated by its place, and a text is the bundle (sum) of its n-grams' vectors.
A language's prototype bundles the unit vectors of its sample; a text gets the language whose
prototype has the largest cosine with its own vector.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checked_join, release, written

DIM, GRAM = 1024, 3
#: At most about so many labelled documents a language are learned from, drawn by a hash of the id.
SAMPLE = 4000
SEED = 20_011
UNKNOWN = "und"


@functools.lru_cache(maxsize=1)
def _is_letter() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "replace"), "<u4")


def _letters(text: str) -> np.ndarray:
    """Lower-case letters' code points; every run of anything else is one 32, at both ends too."""
    c = _codes(text)
    c = np.where(_is_letter()[c], c, 32)
    c = np.concatenate([[32], c, [32]]).astype(np.int64)
    return c[np.r_[True, (c[1:] != 32) | (c[:-1] != 32)]]


class Space:
    """Random letter vectors, and the n-gram vectors bound from them; bounded memory."""

    def __init__(self, dim: int = DIM, gram: int = GRAM, keep: int = 20_000):
        self.dim, self.gram, self.keep = dim, gram, keep
        self.of_letter: dict[int, np.ndarray] = {}
        self.row: dict[int, int] = {}
        self.rows = np.empty((0, dim), np.int8)

    def letter(self, code: int) -> np.ndarray:
        v = self.of_letter.get(code)
        if v is None:
            v = np.random.default_rng((SEED, code)).integers(0, 2, self.dim, np.int8) * 2 - 1
            if len(self.of_letter) < self.keep:
                self.of_letter[code] = v
        return v

    def bind(self, key: int) -> np.ndarray:
        """The vector of one n-gram, from the key that packs its code points 21 bits each."""
        v = np.ones(self.dim, np.int8)
        for k in range(self.gram):
            v = v * np.roll(self.letter((key >> (21 * k)) & 0x1FFFFF), k)
        return v

    def vectors(self, keys: np.ndarray) -> np.ndarray:
        new = [k for k in keys.tolist() if k not in self.row]
        if new:
            if len(self.row) + len(new) > self.keep:
                self.row, self.rows, new = {}, np.empty((0, self.dim), np.int8), keys.tolist()
            self.row.update({k: len(self.row) + i for i, k in enumerate(new)})
            self.rows = np.concatenate([self.rows, np.stack([self.bind(k) for k in new])])
        return self.rows[[self.row[k] for k in keys.tolist()]]

    def bundle(self, texts: list[str], step: int = 32) -> np.ndarray:
        """Unit vectors of texts, by rows; zero where a text has no letter."""
        out = np.zeros((len(texts), self.dim), np.float32)
        for a in range(0, len(texts), step):
            grams, docs = [], []
            for i, t in enumerate(texts[a:a + step]):
                c = _letters(t)
                if len(c) >= self.gram:
                    k = sum(c[j:len(c) - self.gram + 1 + j] << (21 * j) for j in range(self.gram))
                    grams.append(k)
                    docs.append(np.full(len(k), i))
            if not grams:
                continue
            keys, at = np.unique(np.concatenate(grams), return_inverse=True)
            n = np.bincount(np.concatenate(docs) * len(keys) + at, minlength=min(step, len(texts) - a) * len(keys)).reshape(-1, len(keys))
            for b in range(0, len(keys), self.keep):
                out[a:a + step] += n[:, b:b + self.keep].astype(np.float32) @ self.vectors(keys[b:b + self.keep]).astype(np.float32)
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, norm, out=np.zeros_like(out), where=norm > 0)


@functools.lru_cache(maxsize=2)
def _space(dim: int, gram: int) -> Space:
    return Space(dim, gram)


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from learning: crc32 of its id as text, mod 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, dim: int = DIM, gram: int = GRAM) -> dict[str, np.ndarray]:
    """{language: unit prototype} of the labelled documents that are not held out.

    Every language is learned from all its documents, or from about sample of them, drawn by a
    hash of the id; what reaches the driver is one vector a language and task at most.
    """
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out(F.col(id_col)))
    known = known.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    share = F.least(F.lit(1.0), F.lit(float(sample)) / F.count(F.lit(1)))
    shares = written(known.groupBy(F.col("lang").alias("l")).agg(share.alias("share")), "shares")
    draw = F.pmod(F.xxhash64("i", F.lit(SEED)), F.lit(1 << 30)) / float(1 << 30)
    drawn = checked_join(known.withColumn("l", F.col("lang")), shares, "l", "inner", 64).where(draw < F.col("share")).select("lang", "text")

    def bundle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        space, sums = _space(dim, gram), {}
        for pdf in batches:
            v = space.bundle(list(pdf["text"]))
            for lang in pdf["lang"].unique():
                sums[lang] = sums.get(lang, 0) + v[(pdf["lang"] == lang).to_numpy()].sum(axis=0, dtype=np.float64)
        yield pd.DataFrame({"lang": list(sums), "v": [x.astype("<f8").tobytes() for x in sums.values()]}, dtype=object)

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        # in the order of their bytes, so that runs add up alike
        return pd.DataFrame({"lang": pdf["lang"][:1], "v": [np.sum([np.frombuffer(x, "<f8") for x in sorted(pdf["v"])], axis=0).tobytes()]})

    out = {}
    sums = drawn.mapInPandas(bundle, "lang string, v binary").groupBy("lang").applyInPandas(merge, "lang string, v binary")
    for row in sums.toLocalIterator():
        v = np.frombuffer(row.v, "<f8")
        if (size := np.linalg.norm(v)) > 0:
            out[row.lang] = (v / size).astype(np.float32)
    return dict(sorted(out.items()))


def _scored(texts: list[str | None], langs: list[str], matrix: np.ndarray, dim: int, gram: int) -> tuple[list[str], np.ndarray]:
    v = _space(dim, gram).bundle([t or "" for t in texts])
    some = v.any(axis=1)
    if not langs:
        return [UNKNOWN] * len(texts), np.zeros(len(texts))
    cos = np.round(v @ matrix.T, 6)  # equal to six places: the first language by code point
    best = cos.argmax(axis=1)
    return [langs[b] if s else UNKNOWN for b, s in zip(best, some)], np.where(some, np.clip(cos.max(axis=1), 0, 1), 0.0).astype(np.float64)


def identify(docs: DataFrame, prototypes: dict[str, np.ndarray], text_col: str = "text", dim: int = DIM, gram: int = GRAM) -> DataFrame:
    """docs with lang_pred and score (the cosine, 0 to 1) of every whole text.

    "und" with score 0 where a text is null or has no letter, or nothing was learned. Scores that
    are equal to six places (ties) go to the first language by code point; repeated rows get equal
    results; a very long text is bundled as a whole in one task. Columns of docs that have an
    output's name are replaced, others stay; an empty table gives an empty result.
    """
    docs = docs.drop("lang_pred", "score")
    langs = list(prototypes)
    matrix = np.stack(list(prototypes.values())) if langs else np.zeros((0, dim), np.float32)

    @F.pandas_udf("lang_pred string, score double")
    def predict(text: pd.Series) -> pd.DataFrame:
        lang, score = _scored(list(text), langs, matrix, dim, gram)
        return pd.DataFrame({"lang_pred": pd.Series(lang, dtype=object), "score": score})

    return docs.withColumn("lang_pred", predict(F.col(text_col).cast("string"))).select(*docs.columns, F.col("lang_pred.lang_pred").alias("lang_pred"), F.col("lang_pred.score").alias("score"))


def distinct_grams(text: str, gram: int = GRAM) -> int:
    """How many different letter n-grams a text has."""
    c = _letters(text)
    return len(np.unique(np.lib.stride_tricks.sliding_window_view(c, gram), axis=0)) if len(c) >= gram else 0


def accepted(docs: DataFrame, prototypes: dict[str, np.ndarray], least: float, text_col: str = "text", dim: int = DIM, gram: int = GRAM, enough: int = 0) -> DataFrame:
    """The rows of docs, as they are, whose text is in a learned language with a score of least or more.

    A text of fewer than enough different n-grams has a low cosine in any language: it stays
    whatever its score, unless it is "und" (null, empty, without letters, or nothing was learned).
    Each row is judged by its whole text alone, however long, so repeated rows stay or go
    together; columns keep their names, types and order; an empty table gives an empty result.
    """
    langs = list(prototypes)
    matrix = np.stack(list(prototypes.values())) if langs else np.zeros((0, dim), np.float32)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(at).to_pylist()
            lang, score = _scored(texts, langs, matrix, dim, gram)
            yield b.filter(pa.array([x != UNKNOWN and (s >= least or distinct_grams(t, gram) < enough) for t, x, s in zip(texts, lang, score)], pa.bool_()))
        release()

    return docs.mapInArrow(run, docs.schema)
