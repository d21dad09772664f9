"""Readers for stored account-usage tables and document folders."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.period import PARTITION_COLUMN
from . import schemas


@dataclass(frozen=True)
class UsageTables:
    """The four inputs of the reports, as lazy DataFrames."""

    query_history: DataFrame
    warehouse_metering_history: DataFrame
    query_acceleration_eligible: DataFrame
    warehouses: DataFrame

    def register_views(self) -> None:
        """Expose the tables to ``spark.sql`` under their own names."""
        for name in self.__dataclass_fields__:
            getattr(self, name).createOrReplaceTempView(name)


def read_table(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet") -> DataFrame:
    """Read with a declared schema: no inference pass, and only the asked columns are decoded."""
    return spark.read.schema(schema).format(fmt).load(path)


def _by_day(schema: T.StructType, by_day: bool) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField(PARTITION_COLUMN, T.DateType())]) if by_day else schema


def read_query_history(spark: SparkSession, path: str, by_day: bool = False) -> DataFrame:
    """Query history; ``by_day`` says that it is stored in ``start_date=…`` folders (UTC days)."""
    return read_table(spark, path, _by_day(schemas.QUERY_HISTORY, by_day))


def read_usage_tables(spark: SparkSession, root: str, by_day: bool = False) -> UsageTables:
    """All four tables from ``root/<table name>``; ``by_day`` holds for all but the warehouses."""
    return UsageTables(
        query_history=read_query_history(spark, f"{root}/query_history", by_day),
        warehouse_metering_history=read_table(
            spark, f"{root}/warehouse_metering_history", _by_day(schemas.WAREHOUSE_METERING_HISTORY, by_day)
        ),
        query_acceleration_eligible=read_table(
            spark, f"{root}/query_acceleration_eligible", _by_day(schemas.QUERY_ACCELERATION_ELIGIBLE, by_day)
        ),
        warehouses=read_table(spark, f"{root}/warehouses", schemas.WAREHOUSES),
    )


def read_document_folder(spark: SparkSession, root: str) -> DataFrame:
    """Files under ``root`` as ``relative_path`` and ``content`` (binary), one row per file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    folder = root.rstrip("/").split(":", 1)[-1].lstrip("/")
    relative = F.substring_index(F.col("path"), f"{folder}/", -1)
    return files.select(relative.alias("relative_path"), "content")
