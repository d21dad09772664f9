"""Folders of staged files, read file by file as they come in."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .versioned import VersionedTable

MANIFEST = T.StructType([
    T.StructField("relative_path", T.StringType()),
    T.StructField("modified", T.TimestampType()),
    T.StructField("length", T.LongType()),
])


@dataclass(frozen=True)
class Changes:
    """What a folder holds that the manifest did not know.

    ``files`` are the new and the changed files with ``status`` and ``content``, ``deleted`` the names of those
    that are gone.  ``commit`` makes this listing the manifest, once the files have been worked on.
    """

    files: DataFrame
    deleted: DataFrame
    listing: DataFrame
    manifest: VersionedTable

    def commit(self) -> None:
        self.manifest.replace(self.listing)
        self.manifest.vacuum(keep=2)


class StagedFolder:
    """Files under ``root``, with a manifest of those already read in ``manifest_path`` (outside of ``root``).

    A file is told by its path in the folder; one of the same path is changed if its length or its time
    of change is another.  A run that ends before ``commit`` reads the same files again next time.
    """

    def __init__(self, spark: SparkSession, root: str, manifest_path: str, pattern: str = "*") -> None:
        self.spark, self.root, self.pattern = spark, root.rstrip("/"), pattern
        self.manifest = VersionedTable(spark, manifest_path, MANIFEST)

    def _read(self, paths: list[str] | None = None) -> DataFrame:
        reader = self.spark.read.format("binaryFile")
        if paths is None:
            reader = reader.option("recursiveFileLookup", "true").option("pathGlobFilter", self.pattern)
        folder = self.root.split(":", 1)[-1].lstrip("/")
        relative = F.substring_index(F.col("path"), f"{folder}/", -1)
        return reader.load(self.root if paths is None else paths).select(
            "path", relative.alias("relative_path"), F.col("modificationTime").alias("modified"), "length", "content"
        )

    def changes(self) -> Changes:
        """New, changed and deleted files.

        The folder is listed once.  Contents are read when ``files`` is, and of these files only: their
        paths go into the scan, whose file index is on the driver in any case.  Files that come in
        meanwhile are new to the next call.
        """
        known = self.manifest.read()
        # Marked, so that a listing kept by an earlier call is not taken for this one.
        listing = self._read().drop("content").withColumn("call", F.lit(uuid.uuid4().hex)).persist().drop("call")
        a, b = listing.alias("a"), known.alias("b")
        same = (F.col("a.modified") == F.col("b.modified")) & (F.col("a.length") == F.col("b.length"))
        status = F.when(F.col("b.relative_path").isNull(), "new").when(~same, "changed")
        fresh = a.join(b, F.col("a.relative_path") == F.col("b.relative_path"), "left").select("a.path", status.alias("status"))
        found = [(r["path"], r["status"]) for r in fresh.where("status IS NOT NULL").collect()]
        if found:
            told = self.spark.createDataFrame(found, "path string, status string")
            files = self._read([path for path, _ in found]).join(told, "path").drop("path")
        else:
            files = listing.limit(0).selectExpr("* EXCEPT (path)", "CAST(NULL AS BINARY) AS content", "CAST(NULL AS STRING) AS status")
        deleted = known.join(listing, "relative_path", "left_anti").select("relative_path")
        return Changes(files, deleted, listing.drop("path"), self.manifest)
