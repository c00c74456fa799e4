"""Sources and sinks of texts, pages and vectors."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """(id, text) of JSON lines; blank lines are skipped, malformed ones are an error."""
    return spark.read.schema("id long, text string").option("mode", "FAILFAST").json(path)


def read_binary(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(path, content) of whole files: images, audio, documents."""
    r = spark.read.format("binaryFile")
    return (r.option("pathGlobFilter", glob) if glob else r).load(path).select("path", "content")


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """(line, entry) of a file with one entry a line, as one row of text split up."""
    return spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.regexp_replace("value", "\r?\n$", ""), "\r?\n")).alias("line", "entry"))


def read_pages(spark: SparkSession, path: str, extract, first: int | None = None, last: int | None = None) -> DataFrame:
    """(path, page, native_text) of documents; extract(bytes) gives the pages' texts.

    A page that cannot be read is an empty text, a document that cannot has no pages; the range
    (from 1, inclusive) is applied before pages become rows.
    """

    def pages(batches):
        for pdf in batches:
            rows = []
            for name, content in zip(pdf["path"], pdf["content"]):
                try:
                    texts = list(extract(content))
                except Exception:
                    texts = []
                rows += [(name, i, t or "") for i, t in enumerate(texts, 1) if (first or 1) <= i <= (last or i)]
            yield pd.DataFrame(rows, columns=["path", "page", "native_text"]).astype({"path": object, "page": "int32", "native_text": object})

    return read_binary(spark, path).mapInPandas(pages, "path string, page int, native_text string")


def rendered_pages(pages: DataFrame) -> DataFrame:
    """Pages that come as (doc, page, image[, native_text]), which need no parsing."""
    return pages if "native_text" in pages.columns else pages.withColumn("native_text", F.lit(None).cast("string"))


#: Head of a multi-vector file: magic, width and number of documents follow.
MVEC = b"MVEC"


def mvec_bytes(vectors: list[list[list[float]]], dim: int) -> bytes:
    """A multi-vector file of ragged documents: for each a count, then little-endian floats."""
    out = [MVEC, struct.pack("<II", dim, len(vectors))]
    for doc in vectors:
        flat = [x for v in doc for x in v]
        out += [struct.pack("<I", len(doc)), struct.pack(f"<{len(flat)}f", *flat)]
    return b"".join(out)


def read_mvec(raw: bytes) -> list[list[list[float]]]:
    if raw[:4] != MVEC:
        raise ValueError("no multi-vector file")
    dim, n = struct.unpack_from("<II", raw, 4)
    at, out = 12, []
    for _ in range(n):
        (k,) = struct.unpack_from("<I", raw, at)
        flat = struct.unpack_from(f"<{k * dim}f", raw, at + 4)
        out.append([list(flat[i * dim:(i + 1) * dim]) for i in range(k)])
        at += 4 + 4 * k * dim
    return out


def mvec_column(vectors: Column, dim: int) -> Column:
    """One document's vectors as a file of its own; Parquet holds them natively as array<array<float>>."""

    @F.pandas_udf("binary")
    def run(docs: pd.Series) -> pd.Series:
        return docs.map(lambda d: None if d is None else mvec_bytes([[list(v) for v in d]], dim))

    return run(vectors)


def write_vectors(df: DataFrame, path: str) -> None:
    df.write.parquet(path)
