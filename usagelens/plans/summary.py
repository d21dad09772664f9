"""Summary of all warehouses with their cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fixed_point import (
    GB,
    MS_PER_SECOND,
    count_where,
    exact_sum,
    human_bytes,
    percent_text,
    scaled_total,
)
from ..functions.period import Period
from ..operators.base import GROUP_KEYS, size_rank, successful_queries


def credits_per_warehouse(metering: DataFrame, period: Period) -> DataFrame:
    """Credits used per warehouse, to one decimal, over the days of the window (see ``days_of``)."""
    return (
        period.days_of(metering)
        .groupBy(F.col("warehouse_name").cast("string").alias("warehouse_name"))
        .agg(F.round(F.sum("credits_used"), 1).alias("credits_used"))
    )


#: Queries that the summary counts.
EXECUTED = "bytes_scanned > 0 AND total_elapsed_time > 0"


def summary_counters(within: str = "TRUE") -> list[Column]:
    """Additive figures of the summary, over the rows of a group that meet ``within``."""
    large = f"{within} AND bytes_scanned > {GB}"
    small = f"{within} AND NOT bytes_scanned > {GB}"
    return [
        F.expr(f"{count_where(within)} AS count_queries"),
        F.expr(f"{count_where(large)} AS count_large"),
        F.expr(f"{count_where(small)} AS count_small"),
        F.expr(f"{exact_sum(f'CASE WHEN {large} THEN bytes_scanned END')} AS large_bytes"),
        F.expr(f"{exact_sum(f'CASE WHEN {large} THEN total_elapsed_time END')} AS large_elapsed_ms"),
        F.expr(f"{exact_sum(f'CASE WHEN {within} THEN execution_time END')} AS execution_ms"),
        F.expr(f"count(CASE WHEN {within} THEN execution_time END) AS count_executed"),
    ]


def executed_queries(history: DataFrame, period: Period) -> DataFrame:
    """Queries of all warehouses that scanned data and took time."""
    return successful_queries(history, period).where(EXECUTED)


def warehouse_summary(history: DataFrame, metering: DataFrame, period: Period) -> DataFrame:
    """Large (over 1 GB) and small queries, mean times and credits per warehouse and size.

    The time of large queries is their elapsed time, that of all queries their execution time.
    Warehouses without credits in the window are left out.  Credits belong to the warehouse: when it
    ran in several sizes they repeat on every row and must not be added up.
    """
    queries = executed_queries(history, period).groupBy(*GROUP_KEYS).agg(*summary_counters())
    return summary_of(queries, metering, period)


def summary_of(queries: DataFrame, metering: DataFrame, period: Period) -> DataFrame:
    """The summary from one row of ``summary_counters`` per warehouse and size."""
    large_time = scaled_total("large_elapsed_ms", f"count_large * {MS_PER_SECOND}L", 0)
    all_time = scaled_total("execution_ms", f"count_executed * {MS_PER_SECOND}L", 0)
    return (
        queries.join(credits_per_warehouse(metering, period), "warehouse_name")
        .orderBy(F.expr(size_rank("warehouse_size")).desc(), F.col("credits_used").desc(), *GROUP_KEYS)
        .selectExpr(
            *GROUP_KEYS,
            f"{percent_text('count_large', 'count_queries', 0)} AS percent_large",
            f"{percent_text('count_small', 'count_queries', 0)} AS percent_small",
            f"{human_bytes('large_bytes', 'count_large')} AS avg_bytes_large",
            f"{large_time} AS `AVG_LARGE_EXE_TIME(s)`",
            f"{all_time} AS `AVG_ALL_EXE_TIME(s)`",
            "count_queries",
            # Rounded a second time; the order above uses the figure with one decimal.
            "round(credits_used, 0) AS credits_used",
            f"'{period.label}' AS `DATE PERIOD`",
        )
    )
