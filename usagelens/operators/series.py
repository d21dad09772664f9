"""Chart-ready frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .base import GROUP_KEYS


def histogram_series(histogram: DataFrame, range_column: str) -> DataFrame:
    """A histogram with the share as a number and its ranges in bucket order.

    The share text loses its ``%`` and becomes ``percent_value``; the count stays as it is.
    """
    ordinal = F.substring_index(F.col(range_column), ":", 1).cast("int")
    share = F.rtrim(F.col("percent_sql_count"), F.lit("%")).cast("double")
    return (
        histogram.withColumn("bucket_ordinal", ordinal)
        .withColumn("percent_value", share)
        .orderBy(*GROUP_KEYS, "bucket_ordinal")
    )


def statement_result(
    spark: SparkSession, statement: str, args: dict | None = None, **tables: DataFrame
) -> DataFrame:
    """Rows of a SQL statement; values go in as ``:name`` parameters, never by text.

    ``tables`` are named in the statement as ``{name}``; no view of them outlives the call.
    """
    return spark.sql(statement, args=args, **tables)


def chart_series(result: DataFrame) -> DataFrame:
    """Long form for line and bar charts: the first column is the key, every other number a series.

    A single column is a series without a key.  Texts besides the key cannot be drawn; they stay as
    labels of their rows.  A result without any number to draw is an error.
    """
    key, *others = result.columns if len(result.columns) > 1 else [None, *result.columns]
    numbers = [name for name in others if isinstance(result.schema[name].dataType, T.NumericType)]
    if not numbers:
        raise ValueError("a chart needs at least one series of numbers")
    quoted = lambda name: F.col("`" + name.replace("`", "``") + "`")
    kept = [quoted(name) for name in ([key] if key else []) + [name for name in others if name not in numbers]]
    drawn = [quoted(name).cast("double").alias(name) for name in numbers]
    return result.select(*kept, *drawn).unpivot(kept, [quoted(name) for name in numbers], "series", "value")


def has_chart(rows: list) -> bool:
    """A result is charted if it has more than one row; ``rows`` are those the caller has fetched."""
    return len(rows) > 1
