"""From documents to packed training sequences, stage by stage.

Each stage gets what the one before it kept, and all but the last return rows of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessella.llm import exact_dedup, jaccard_join, language_id, mixing, packing
from tessella.llm.common import documents, written

#: Chance: the cosine of unrelated trigrams with a language has a deviation of DIM**-0.5, whatever
#: their number. Only texts of ENOUGH different trigrams are rejected for being no nearer than that,
#: as the cosine of a short text in a language may be as low.
CHANCE, ENOUGH = 3 / language_id.DIM**0.5, 100


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language; those without letters (null and empty texts too), or long and like none, go.

    Languages are learned from the rows of docs itself; of an empty table, or one without labels,
    every document is of no learned language and goes. Repeated rows stay or go together.
    """
    return language_id.accepted(docs, language_id.learn(docs), CHANCE, enough=ENOUGH)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the smallest id; of rows that share it, one.

    Null and empty texts are one group. Columns of docs stay as they are; an empty table stays empty.
    """
    return exact_dedup.exact_dedup(docs).where("kept").select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar texts: five-word shingles, similarity 0.75.

    The smallest id of a component stays, and rows without an id; texts without words are similar
    to none; of an id's rows only those in the component go. An empty table stays empty.
    """
    return jaccard_join.representatives(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them: rows are left out or repeated, never changed.

    Texts without words are never taken; null sources are one source; an empty table stays empty.
    """
    return mixing.mixed_rows(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their place in sequences; each taken copy of a document is packed for itself.

    Null and empty texts are one id; a very long text is many pieces; an empty table gives no piece.
    """
    return packing.pack(docs)


STAGES = [
    ("language id", known_language),
    ("exact dedup", exact_copies),
    ("n-gram jaccard join", near_copies),
    ("mixing", mixture),
    ("packing", packed),
]

#: Language profiles, shingle joins, random rounding and token ids have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
