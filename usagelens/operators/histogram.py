"""Bucket histograms: one scan, one aggregate, one row per group and bucket."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.buckets import BucketFamily
from ..functions.fixed_point import count_where, percent_text


@dataclass(frozen=True)
class Histogram:
    """What a histogram counts: rows that meet ``where``, by the bucket of ``value``."""

    family: BucketFamily
    value: str
    where: str
    range_column: str
    digits: int

    def shares(self, counts: DataFrame, keys: Sequence[str]) -> DataFrame:
        """One row per bucket from groups with ``total_count_sql`` and a counter named after each bucket."""
        unpivoted = counts.unpivot(
            [*keys, "total_count_sql"], [f"`{label}`" for label in self.family.labels], self.range_column, "sql_count"
        )
        return unpivoted.selectExpr(
            "*", f"{percent_text('sql_count', 'total_count_sql', self.digits)} AS percent_sql_count"
        )


def histogram(rows: DataFrame, keys: Sequence[str], of: Histogram) -> DataFrame:
    """Count rows per bucket for every group of ``keys``.

    Buckets are counted as conditional aggregates and unpivoted afterwards, so empty buckets stay
    with count 0, and the total includes rows outside all buckets.  The map side reduces every group
    to a single row of counters before the shuffle, however large the group is.
    """
    counters = [
        F.expr(f"{count_where(condition)} AS `{label}`")
        for condition, label in zip(of.family.conditions("bucket_value"), of.family.labels)
    ]
    counts = (
        rows.where(of.where)
        .selectExpr(*keys, f"{of.value} AS bucket_value")
        .groupBy(*keys)
        .agg(F.expr("count(*) AS total_count_sql"), *counters)
    )
    return of.shares(counts, keys)
