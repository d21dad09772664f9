"""Reading the corpus tables and storing intermediate ones."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the only separators of words.
SPACE = r"[ \t-\r]"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_of(column: str) -> Column:
    """The text of a column, NULL as the empty text."""
    return F.coalesce(F.col(column), F.lit(""))


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, as ``spark.checkpoint.dir`` names it.

    Only a local session, whose executors are the driver, may do without the setting.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="corpus-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder; it goes when the application ends."""
    folder = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(hadoop)
    files.deleteOnExit(hadoop)
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read from there.

    This cuts the lineage, so that lost executors cost no more than their running tasks, and tells
    the planner the true size: joins broadcast the table only below
    ``spark.sql.autoBroadcastJoinThreshold`` and shuffle it beyond.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    result = spark.read.schema(df.schema).parquet(path)
    result.stored_at = path
    return result


def discard(*tables: DataFrame) -> None:
    """Delete stored tables that nothing will read again, and let Spark delete the shuffle files of
    finished steps, which it does once nothing refers to them."""
    for table in tables:
        context = table.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(table.stored_at)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
    gc.collect()
    tables[0].sparkSession.sparkContext._jvm.System.gc()


_shipped: set[str] = set()


def map_batches(df: DataFrame, function, schema: str) -> DataFrame:
    """``mapInArrow`` with this package sent along, so that executors need no copy of it installed."""
    context = df.sparkSession.sparkContext
    if context.applicationId not in _shipped:
        package = Path(__file__).resolve().parent.parent
        folder = tempfile.mkdtemp(prefix="code-")  # the driver serves the file from there
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        target = Path(folder) / f"{package.name}-code.zip"
        with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as archive:
            for file in sorted(package.rglob("*.py")):
                archive.write(file, file.relative_to(package.parent))
        context.addPyFile(str(target))
        _shipped.add(context.applicationId)
    return df.mapInArrow(function, schema)
