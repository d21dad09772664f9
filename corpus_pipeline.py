"""A training corpus from raw documents: quality, exact and near copies, mixture, sequences.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from usagelens.llm import exact_dedup, mixing, near_dedup, packing, quality
from usagelens.llm.queries import BATCHES, CAPACITY, END_OF_TEXT, REPETITION, fresh_index, vocabulary, words_of
from usagelens.llm.tables import read, stored


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base limits pass and the weighted rules make good."""
    return quality.judged(docs, prefix="__q_").where("__q_kept").select(*docs.columns)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text that is equal but for white space."""
    return exact_dedup.deduplicate(docs, fresh_index(spark), batches=BATCHES)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group at a similarity of 0.8 on five-word shingles."""
    return near_dedup.drop_near_duplicates(docs, near_dedup.Settings(words=5))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once, those of small sources up to ``REPETITION`` times as often."""
    return mixing.mix(docs, mixing.Target(repetition=REPETITION), words_of("text"), prefix="__m_").select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, with their places in sequences."""
    return packing.pack(docs.select("doc_id", "text"), vocabulary(), CAPACITY, END_OF_TEXT)


STAGES = [
    ("quality rules", good_documents),
    ("exact dedup", without_copies),
    ("near dedup", without_near_copies),
    ("source mixing", mixed),
    ("best-fit packing", packed),
]

#: Neither the estimated rule weights nor the packing can be put as SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
