"""Window reports over years: additive figures per day, warehouse and size, and the rows of the edges alone.

A finished day is counted once, by one scan for all reports, and stored as one row of counters per
warehouse and size.  A report adds up the stored days that its window holds whole and reads from the
history only what is left: the two edge days, and days that are not stored yet.

Days are those of UTC, so windows of every zone can use them.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime, timedelta, timezone
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.fixed_point import count_where
from ..functions.period import PARTITION_COLUMN, Period
from ..operators.base import GROUP_KEYS, of_warehouse, ran
from ..operators.histogram import Histogram
from . import reports
from .summary import EXECUTED, summary_counters, summary_of

#: Report -> what it counts.
HISTOGRAMS: dict[str, Histogram] = {
    "local_spill_histogram": reports.LOCAL_SPILL,
    "remote_spill_histogram": reports.REMOTE_SPILL,
    "queue_histogram": reports.QUEUED,
    "txblock_histogram": reports.TXBLOCKED,
    "elapsed_histogram": reports.ELAPSED,
    "scan_size_histogram": reports.SCAN_SIZE,
    "prune_ratio_histogram": reports.PRUNED,
}
DAY = "stored_day"
_MICROS_A_DAY = 86_400_000_000
_SUMMARY = (
    "count_queries", "count_large", "count_small", "large_bytes", "large_elapsed_ms", "execution_ms", "count_executed",
)


def _names(report: str) -> list[str]:
    """Columns of a histogram: its rows, then its buckets in order."""
    return [f"{report}_{i}" for i in range(len(HISTOGRAMS[report].family.labels) + 1)]


def _counters(report: str) -> list[Column]:
    of = HISTOGRAMS[report]
    conditions = ["TRUE", *of.family.conditions(f"({of.value})")]
    return [
        F.expr(f"{count_where(f'({of.where}) AND ({c})')} AS {name}") for name, c in zip(_names(report), conditions)
    ]


def _summary() -> list[Column]:
    return summary_counters(f"({EXECUTED})")


def _utc_day(history: DataFrame) -> Column:
    if isinstance(history.schema["start_time"].dataType, T.TimestampNTZType):
        return F.col("start_time").cast("date")
    micros = "unix_micros(start_time)"
    return F.expr(f"date_from_unix_date(CAST(({micros} - pmod({micros}, {_MICROS_A_DAY}L)) div {_MICROS_A_DAY}L AS INT))")


def daily_partials(history: DataFrame) -> DataFrame:
    """Counters per day, warehouse and size: one scan, one aggregate; days without such queries have no row."""
    counters = [c for report in HISTOGRAMS for c in _counters(report)] + _summary()
    rows = of_warehouse(ran(history), None)
    return rows.withColumn(DAY, _utc_day(history)).groupBy(DAY, *GROUP_KEYS).agg(*counters)


def store_days(history: DataFrame, path: str) -> None:
    """Count the days that ``history`` holds and store them under ``path``, one folder each.

    Days that are stored already are replaced, others stay, so a load may be repeated.  ``history`` holds
    finished days, each whole, and loads follow one another without a gap.
    """
    parts = daily_partials(history).repartition(DAY)
    parts.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(DAY).parquet(path)


def _utc(local: datetime, zone: str) -> datetime:
    return local.replace(tzinfo=ZoneInfo(zone)).astimezone(timezone.utc).replace(tzinfo=None)


@dataclass(frozen=True)
class WholeDays:
    """Days from ``first`` up to ``end`` without it; none where ``first >= end``."""

    first: date
    end: date

    @classmethod
    def within(cls, period: Period) -> WholeDays:
        """The days of UTC of which the window, which holds both its ends, has every instant."""
        low, high = _utc(period.begin, period.zone), _utc(period.end, period.zone)
        return cls((low + timedelta(days=1, microseconds=-1)).date(), (high + timedelta(microseconds=1)).date())

    def stored(self, days: DataFrame) -> WholeDays:
        """Those of them that the store reaches, by the names of its folders."""
        found = days.where(self.holds(DAY)).agg(F.min(DAY).alias("first"), F.max(DAY).alias("last")).first()
        if found["first"] is None:
            return WholeDays(self.first, self.first)
        return WholeDays(found["first"], found["last"] + timedelta(days=1))

    def holds(self, column: str) -> Column:
        return (F.col(column) >= F.lit(self.first)) & (F.col(column) < F.lit(self.end))

    def rest_of(self, history: DataFrame) -> DataFrame:
        """Rows of the other days."""
        if self.first >= self.end:
            return history
        if isinstance(history.schema["start_time"].dataType, T.TimestampNTZType):
            first, end = (F.lit(day.isoformat()).cast("timestamp_ntz") for day in (self.first, self.end))
        else:
            epoch = date(1970, 1, 1)
            first, end = (F.expr(f"timestamp_seconds({(day - epoch).days * 86_400})") for day in (self.first, self.end))
        rest = history.where((F.col("start_time") < first) | (F.col("start_time") >= end))
        if PARTITION_COLUMN in history.columns:
            # Days of storage may be of another zone, which is less than a day away.
            slack = timedelta(days=1)
            day = F.col(PARTITION_COLUMN)
            rest = rest.where((day <= F.lit(self.first + slack)) | (day >= F.lit(self.end - slack)))
        return rest


def _added(
    days: DataFrame, history: DataFrame, period: Period, warehouse: str | None, names: list[str], counters: list[Column]
) -> DataFrame:
    """The window's counters per warehouse and size, from stored days and the rows of the rest."""
    whole = WholeDays.within(period).stored(days)
    rest = period.rows_of(of_warehouse(ran(whole.rest_of(history)), warehouse))
    edges = rest.groupBy(*GROUP_KEYS).agg(*counters)
    stored = of_warehouse(days.where(whole.holds(DAY)), warehouse).select(*GROUP_KEYS, *names)
    return stored.unionByName(edges).groupBy(*GROUP_KEYS).agg(*[F.sum(n).alias(n) for n in names])


def histogram_of_days(
    report: str, days: DataFrame, history: DataFrame, period: Period, warehouse: str | None = None
) -> DataFrame:
    """The histogram ``report``; ``days`` is the table that ``store_days`` wrote."""
    of, names = HISTOGRAMS[report], _names(report)
    counts = _added(days, history, period, warehouse, names, _counters(report)).where(f"{names[0]} > 0")
    labelled = [F.col(n).alias(label) for n, label in zip(names, ("total_count_sql", *of.family.labels))]
    return of.shares(counts.select(*GROUP_KEYS, *labelled), GROUP_KEYS)


def summary_of_days(days: DataFrame, history: DataFrame, metering: DataFrame, period: Period) -> DataFrame:
    """The summary of all warehouses; ``days`` is the table that ``store_days`` wrote."""
    counts = _added(days, history, period, None, list(_SUMMARY), _summary()).where("count_queries > 0")
    return summary_of(counts, metering, period)


def read_days(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
