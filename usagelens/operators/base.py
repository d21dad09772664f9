"""The row filter shared by all history reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.period import Period

GROUP_KEYS = ("warehouse_name", "warehouse_size")


def successful_queries(history: DataFrame, period: Period, warehouse: str | None = None) -> DataFrame:
    """Succeeded queries that ran on a warehouse in the window; ``None`` means all warehouses.

    All predicates compare a stored column with a constant, so they reach the scan.
    """
    return period.rows_of(of_warehouse(ran(history), warehouse))


def ran(history: DataFrame) -> DataFrame:
    """Succeeded queries that ran on a warehouse."""
    return history.where((F.col("execution_status") == "SUCCESS") & F.col("warehouse_size").isNotNull())


def of_warehouse(rows: DataFrame, warehouse: str | None) -> DataFrame:
    """Rows of one warehouse or of all; a row without a warehouse belongs to no report."""
    return rows.where(F.col("warehouse_name").isNotNull()) if warehouse is None else rows.where(F.col("warehouse_name") == F.lit(warehouse))


# The known sizes, smallest first.
KNOWN_SIZES = ("X-Small", "Small", "Medium", "Large", "X-Large", "2X-Large", "3X-Large", "4X-Large")


def size_rank(size: str) -> str:
    """Rank of a warehouse size for ordering; unknown sizes rank above all known ones."""
    ranks = " ".join(f"WHEN '{name}' THEN {position}" for position, name in enumerate(KNOWN_SIZES, start=1))
    return f"CASE {size} {ranks} ELSE {len(KNOWN_SIZES) + 1} END"
