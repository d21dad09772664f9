"""Session settings and stored intermediate tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

#: Settings the reports are planned for.  A cluster's own values for sizes and counts stay in force.
REPORT_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # HotSpot leaves methods over 8000 bytes interpreted; Spark then splits the stage instead.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def build_session(
    app_name: str = "usagelens",
    master: str | None = None,
    settings: Mapping[str, str] | None = None,
) -> SparkSession:
    """A session with the report settings and the caller's own."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**REPORT_SETTINGS, **(settings or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str | None:
    """Folder all executors can reach, as the cluster names it in ``spark.checkpoint.dir``."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/") if folder else None


def hadoop_path(spark: SparkSession, path: str):
    """A path and its file system, on the JVM side."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark._jsc.hadoopConfiguration())


def delete_at_end(spark: SparkSession, path: str) -> None:
    """Make the folder ``path`` and delete it, with all in it, when the application ends."""
    found, files = hadoop_path(spark, path)
    files.mkdirs(found)
    files.deleteOnExit(found)


@dataclass(frozen=True)
class Settled:
    """A stored intermediate table, and how to drop it."""

    df: DataFrame
    drop: Callable[[], None]


def settle(df: DataFrame, name: str) -> Settled:
    """Work ``df`` out once and keep the rows.

    With ``spark.checkpoint.dir`` they are written to a table there, which cuts the lineage and
    survives the loss of executors; otherwise they are persisted, with the lineage to work lost blocks
    out again.  Either way the planner knows their size, so it broadcasts them in later joins only
    while they are under ``spark.sql.autoBroadcastJoinThreshold``.  What is not dropped goes with the
    application.
    """
    spark = df.sparkSession
    folder = shared_folder(spark)
    if folder is None:
        kept = df.persist()
        kept.count()
        return Settled(kept, lambda: kept.unpersist() and None)
    path = f"{folder}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    delete_at_end(spark, f"{folder}/{spark.sparkContext.applicationId}")
    df.write.parquet(path)

    def drop() -> None:
        found, files = hadoop_path(spark, path)
        files.delete(found, True)

    return Settled(spark.read.schema(df.schema).parquet(path), drop)
