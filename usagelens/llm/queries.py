"""The operators applied to the test tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    conversations, exact_dedup, langid, mixing, near_dedup, packing, quality, secrets, suffix_dedup, token_counts,
    token_store, warc, whitening,
)
from .oracle_sql import ORACLE_SQL  # noqa: F401
from .tables import SPACE, new_path, read, text_of

CAPACITY = 4096
END_OF_TEXT = 1
#: The vocabulary's own end of a document, which no text can spell.
SEPARATOR = 49407
#: Bytes of a record of a page; longer pages are several records, as ordinary ones are.
SEGMENT_BYTES = 1 << 12
#: Parts in which documents meet the digest index, so that later ones are held against stored digests.
BATCHES = 3
#: How often a document of a small source may repeat for each time one of a large source appears.
REPETITION = 2.0


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def words_of(column: str):
    """Number of words, the unit in which sources are weighed."""
    return F.regexp_count(text_of(column), F.lit(SPACE.replace("[", "[^") + "+")).cast("long")


def fresh_index(spark: SparkSession) -> exact_dedup.DigestIndex:
    """An empty digest index, with as many buckets as a shuffle has partitions."""
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return exact_dedup.DigestIndex(spark, new_path(spark, "digest-index"), buckets)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack(docs, vocabulary(), CAPACITY, END_OF_TEXT)


def op2_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    docs = docs.select("doc_id", "source", words_of("text").alias("n_words"))
    target = mixing.Target(repetition=REPETITION)
    mixed = mixing.mix(docs, target, F.col("n_words"))
    return mixed.select(
        "doc_id", "source", "n_words",
        F.col("mix_block").alias("block"), F.col("mix_position").alias("position"),
        F.col("mix_weight").alias("weight"), F.col("mix_epochs").alias("epochs"),
    )


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.judged(docs, keep=["doc_id"]).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality",
    )


def op4_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return near_dedup.find_groups(docs, near_dedup.Settings(words=4)).withColumnRenamed("id", "doc_id")


def op5_kneser_ney_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    found = langid.identify(docs, ~held_out).withColumnRenamed("id", "doc_id")
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "entropy", "rejected")


def op6_suffix_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix_dedup.remove_repeats(docs).withColumnRenamed("id", "doc_id")


def op7_entropy_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return secrets.digests(secrets.scan(docs)).withColumnRenamed("id", "doc_id")


def op8_digest_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_dedup.classify(docs, fresh_index(spark), batches=BATCHES).withColumnRenamed("id", "doc_id")


def op9_warc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(read(spark, sf_dir, "pages"), new_path(spark, "warc"), SEGMENT_BYTES)


def op10_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "token-files")
    token_counts.write_token_files(read(spark, sf_dir, "documents"), path, vocabulary(), SEPARATOR)
    return token_counts.count_tokens(spark, path, SEPARATOR)


def op11_chebyshev_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op12_branch_and_bound_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = conversations.damaged(read(spark, sf_dir, "conversations"))
    return conversations.repair_conversations(rows).withColumnRenamed("conv", "conv_id")


def op13_range_coder(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return token_store.round_trip(docs, new_path(spark, "token-store"), vocabulary("byte_bpe_50k.json"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_best_fit_packing,
        op2_temperature_mixing,
        op3_quality_rules,
        op4_circulant_minhash,
        op5_kneser_ney_language,
        op6_suffix_groups,
        op7_entropy_secrets,
        op8_digest_index,
        op9_warc_segments,
        op10_separator_scan,
        op11_chebyshev_whitening,
        op12_branch_and_bound_repair,
        op13_range_coder,
    )
}
