"""Exact deduplication against a persistent digest index.

The index is a Parquet table of digests, bucketed and sorted by digest.  A batch is reduced to one row
per digest, sort-merge anti-joined with the index without moving it, and what is new is appended.
"""

from __future__ import annotations

import re
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import SPACE, stored, text_of

INDEX_SCHEMA = "digest BINARY, keep_id BIGINT"


def text_digest(column: str) -> Column:
    """SHA-256 (binary) of a text without its white space; NULL counts as empty."""
    return F.unhex(F.sha2(F.regexp_replace(text_of(column), f"{SPACE}+", ""), 256))


def _stored_buckets(spark: SparkSession, path: str) -> int | None:
    """Number of buckets of the index under ``path``, None if there is none yet."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(root):
        return None
    found = [re.fullmatch("buckets-([0-9]+)", s.getPath().getName()) for s in files.listStatus(root)]
    counts = [int(m[1]) for m in found if m]
    if len(counts) > 1:
        raise ValueError(f"{path} holds indexes with {sorted(counts)} buckets")
    return counts[0] if counts else None


class DigestIndex:
    """Digests of all texts seen so far, with the id of the row that stays for each.

    ``path`` may hold an index from an earlier application.  The number of buckets is part of its folder's
    name and is read back from there, so ``buckets`` only says how a new index is to be laid out.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int) -> None:
        self.spark = spark
        self.buckets = buckets = _stored_buckets(spark, path) or buckets
        self.table = f"digest_index_{uuid.uuid4().hex}"
        spark.sql(
            f"CREATE TABLE {self.table} ({INDEX_SCHEMA}) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS "
            f"LOCATION '{path}/buckets-{buckets}'"
        )

    def read(self) -> DataFrame:
        return self.spark.table(self.table).hint("merge")

    def close(self) -> None:
        """Forget the table's name; the index stays at its path."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")

    def append(self, groups: DataFrame) -> None:
        """Add the digests of ``groups`` that the index lacks; each bucket is written by one task."""
        fresh = groups.join(self.read(), "digest", "left_anti")
        fresh.select("digest", "keep_id").repartition(self.buckets, "digest").write.insertInto(self.table)
        self.spark.catalog.refreshTable(self.table)


def _groups(digests: DataFrame) -> DataFrame:
    """One row per digest: its best row and its number of rows, combined before the shuffle."""
    best = F.min(F.struct((-F.col("n_chars")).alias("shortness"), F.col("id").isNull().alias("unnamed"), "id"))
    return (
        digests.groupBy("digest")
        .agg(best.alias("best"), F.count("*").alias("group_size"))
        .select("digest", F.col("best.id").alias("keep_id"), "group_size")
    )


def _digested(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    return docs.select(
        F.col(id_column).alias("id"),
        text_digest(text_column).alias("digest"),
        F.length(text_of(text_column)).cast("long").alias("n_chars"),
    )


def _by_length(digests: DataFrame, batches: int) -> list[DataFrame]:
    """The rows in about equal batches, those of the longest texts first; equal lengths stay together."""
    if batches == 1:
        return [digests]
    shares = ", ".join(f"{k / batches}D" for k in range(1, batches))
    cuts = digests.agg(F.expr(f"percentile_approx(n_chars, array({shares}))").alias("cuts")).first()["cuts"]
    ends = [None, *sorted(set(cuts or ()), reverse=True), None]
    found = []
    for above, least in zip(ends, ends[1:]):
        rows = digests if above is None else digests.where(F.col("n_chars") <= above)
        found.append(rows if least is None else rows.where(F.col("n_chars") > least))
    return found


def ingest(
    docs: DataFrame, index: DigestIndex, id_column: str = "doc_id", text_column: str = "text", batches: int = 1
) -> tuple[DataFrame, DataFrame]:
    """Deduplicate documents within themselves and against the index, and append what is new.

    Returns the rows (``id``, ``digest``, ``n_chars``) and their groups (``digest``, ``group_size``,
    ``keep_id``), both stored.  Texts are equal when they are identical without white space; NULL counts
    as empty.  Of a new group the row with the most code points in its original text stays, then the
    smallest id (NULL last).  Of a group the index knows, the known id stays, so the documents may safely
    be ingested again after a failure.

    With ``batches`` they go to the index in that many parts, longest texts first, each anti-joined with
    what the index holds by then.  The row that stays is in the first part that has its text, so the
    number of parts changes no result; it bounds the rows that one append sorts.

    Rows that agree in id and text are one row to the index.  No column but the two named is read.
    """
    digests = stored(_digested(docs, id_column, text_column), "digests")
    parts = []
    for batch in _by_length(digests, batches):
        groups = stored(_groups(batch), "digest-groups")
        index.append(groups)
        parts.append(groups.drop("keep_id"))
    groups = reduce(DataFrame.unionByName, parts)
    if len(parts) > 1:
        groups = groups.groupBy("digest").agg(F.sum("group_size").alias("group_size"))
    return digests, stored(groups.join(index.read(), "digest"), "digest-resolved")


def classify(
    docs: DataFrame, index: DigestIndex, id_column: str = "doc_id", text_column: str = "text", batches: int = 1
) -> DataFrame:
    """One row per document: ``id``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    ``kept`` tells whether the row is the one that stays; repeated rows (same id, same text) agree.
    A group whose ids are all NULL keeps its rows.  An empty table gives an empty result.
    """
    digests, resolved = ingest(docs, index, id_column, text_column, batches)
    # Both sides are plain stored tables, so a large group's rows are split by the skew join.
    return digests.join(resolved, "digest").select(
        "id",
        "keep_id",
        "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def deduplicate(
    docs: DataFrame, index: DigestIndex, id_column: str = "doc_id", text_column: str = "text", batches: int = 1
) -> DataFrame:
    """The documents that stay, with all their columns: one row per text, also of repeated rows.

    The rows are found by digest and id together, which spreads a large group of copies.
    """
    _, resolved = ingest(docs, index, id_column, text_column, batches)
    key = f"__digest_{uuid.uuid4().hex}"
    names = [key, f"{key}_id", f"{key}_unnamed"]

    def of(digest: Column, name: Column) -> list[Column]:
        found = (digest, F.coalesce(name.cast("long"), F.lit(0)), name.isNull())
        return [c.alias(n) for c, n in zip(found, names)]

    keys = resolved.select(*of(F.col("digest"), F.col("keep_id")))
    marked = docs.select("*", *of(text_digest(text_column), F.col(id_column)))
    # Plain equalities of columns that are never NULL: the window then finds its rows where the join left
    # them, and texts are shuffled once.
    first = F.row_number().over(Window.partitionBy(*names).orderBy(F.lit(0)))
    found = marked.join(keys, names).withColumn(f"{key}_n", first)
    return found.where(F.col(f"{key}_n") == 1).select(*docs.columns)
