"""A corpus from raw documents to training sequences, in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and gives a DataFrame, which is written
as Parquet and read again as the next one's ``docs``.  All stages but the last give
the columns of ``documents``.

Cases.  A text that is null, empty or without letters goes in the first stage, with its row.
A null id is an id of its own: it loses against others in exact dedup, and such a document
is not compared for near copies.  Rows that repeat an id and a text are one document after
exact dedup.  A null source is the last one in mixing.  Long texts are read whole.  Other
columns are carried through, whatever their names.  Ties go to the smallest id.  An empty
table gives no pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillon.llm import exact_dedup, language_id, mixing, packing, simhash
from quillon.llm.queries import tokenizer_path
from quillon.storage import stash


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language, or in none that owns half of their letters, go."""
    return language_id.keep_known(docs)


def no_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the longest original, then the smallest doc_id, stays."""
    return exact_dedup.drop_copies(docs)


def no_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of links (similarity of five-word shingles at least 0.8) the smallest doc_id stays."""
    return simhash.keep_one(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights; a document comes as often as the mix takes it."""
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("language_id", known_language),
    ("exact_dedup", no_copies),
    ("simhash_dedup", no_near_copies),
    ("mixing", mixed),
    ("packing", packed),
]

#: Language models, fingerprints and tokens have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
