"""Wide profile of all warehouses: 101 columns per warehouse and size."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import buckets
from ..functions.buckets import BucketFamily
from ..functions.fixed_point import (
    GB,
    MICROS_PER_PERCENT,
    MS_PER_HOUR,
    MS_PER_SECOND,
    percent_text,
    scaled_total,
)
from ..functions.period import Period
from ..operators.base import GROUP_KEYS, size_rank
from ..operators.counters import Measure, in_bucket, rows_where, total_where, with_medians
from .reports import PRUNE_RATIO, QUEUED_RATIO, TXBLOCKED_RATIO
from .summary import credits_per_warehouse, executed_queries


@dataclass(frozen=True)
class Statistic:
    """A measured column and how its statistics are shown."""

    measure: str
    shown: str
    unit_name: str
    unit: int


STATISTICS = (
    Statistic("bytes_scanned", "SCAN_SIZE", "GB", GB),
    Statistic("bytes_spilled_to_local_storage", "LOCAL_SPILLED_SIZE", "GB", GB),
    Statistic("bytes_spilled_to_remote_storage", "REMOTE_SPILLED_SIZE", "GB", GB),
    Statistic("total_elapsed_time", "ELAPSED_TIME", "s", MS_PER_SECOND),
    Statistic("queued_overload_time", "QUEUED_TIME", "s", MS_PER_SECOND),
    Statistic("transaction_blocked_time", "TXBLOCKED_TIME", "s", MS_PER_SECOND),
    Statistic("prune_ratio", "SCAN_PARTITION_RATIO", "%", MICROS_PER_PERCENT),
)

#: Bucket families counted in the profile, with the measure they apply to, in output order.
FAMILIES: tuple[tuple[str, BucketFamily], ...] = (
    ("bytes_scanned", buckets.SCAN_SIZE),
    ("bytes_spilled_to_local_storage", buckets.LOCAL_SPILL),
    ("bytes_spilled_to_remote_storage", buckets.REMOTE_SPILL),
    ("total_elapsed_time", buckets.ELAPSED),
    ("queued_ratio", buckets.QUEUED_RATIO),
    ("txblocked_ratio", buckets.TXBLOCKED_RATIO),
    ("prune_ratio", buckets.PRUNE_RATIO),
)

MEASURES = tuple(s.measure for s in STATISTICS)
ELIGIBLE_SECONDS = "eligible_query_acceleration_time"


def _measured(history: DataFrame, period: Period) -> DataFrame:
    """Grouping keys and measures; no wide column is read.

    Queries without a warehouse have no credits to join and are left out.
    """
    return executed_queries(history, period).where("warehouse_name IS NOT NULL").selectExpr(
        *GROUP_KEYS,
        *[m for m in MEASURES if m != "prune_ratio"],
        f"{PRUNE_RATIO} AS prune_ratio",
        f"{QUEUED_RATIO} AS queued_ratio",
        f"{TXBLOCKED_RATIO} AS txblocked_ratio",
    )


def _history_measures() -> list[tuple[int, Measure]]:
    """Numbered measures of the history: those with statistics, then the ratios that are only bucketed."""
    bounds = dict((m, family.bounds) for m, family in FAMILIES)
    names = [*MEASURES, *[m for m, _ in FAMILIES if m not in MEASURES]]
    return [
        (i, Measure(f"m_{m}", m, bounds.get(m, ()), "total_elapsed_time" if m == "bytes_scanned" else None, m in MEASURES))
        for i, m in enumerate(names)
    ]


#: Numbers of the measures of eligible queries: their seconds, and the rows themselves.
ELIGIBLE_MEASURES = [
    (20, Measure(f"m_{ELIGIBLE_SECONDS}", ELIGIBLE_SECONDS)),
    (21, Measure("m_eligible_row", "0L", median=False)),
]


def _group_aggregates() -> list[str]:
    """Everything the profile needs of a group, from its counters."""
    number = {m.value: i for i, m in _history_measures()}
    aggregates = [f"{rows_where(number['bytes_scanned'])} AS count_total_sql"]
    for m, i in [*[(m, number[m]) for m in MEASURES], (ELIGIBLE_SECONDS, ELIGIBLE_MEASURES[0][0])]:
        aggregates += [
            f"max(CASE WHEN measure = {i} THEN largest END) AS {m}__max",
            f"{total_where(i)} AS {m}__sum",
            f"{rows_where(i)} AS {m}__count",
        ]
    for m, family in FAMILIES:
        aggregates += [f"{rows_where(number[m], in_bucket(k))} AS {m}__n{k}" for k in family.ordinals]
    scanned, elapsed = number["bytes_scanned"], number["total_elapsed_time"]
    for k in buckets.SCAN_SIZE.ordinals:
        aggregates += [
            f"{total_where(scanned, in_bucket(k), 'beside')} AS scan__elapsed{k}",
            f"{total_where(scanned, in_bucket(k))} AS scan__bytes{k}",
        ]
    aggregates += [f"{total_where(elapsed, in_bucket(k))} AS elapsed__elapsed{k}" for k in buckets.ELAPSED.ordinals]
    aggregates.append(f"nullif({rows_where(ELIGIBLE_MEASURES[1][0])}, 0) AS total_eligible_qas_sql_count")
    return aggregates


def _statistic_columns(s: Statistic) -> list[str]:
    total, count = f"{s.measure}__sum", f"{s.measure}__count"
    mean = scaled_total(total, f"{count} * {s.unit}L", 2)
    median = scaled_total(_twice_median(s.measure), 2 * s.unit, 2)
    columns = [f"{mean} AS `AVG_{s.shown}({s.unit_name})`", f"{median} AS `MDN_{s.shown}({s.unit_name})`"]
    if s.unit_name == "%":
        return columns
    columns.append(f"{scaled_total(total, s.unit, 2)} AS `SUM_{s.shown}({s.unit_name})`")
    if s.measure == "total_elapsed_time":
        columns.append(f"{scaled_total(total, MS_PER_HOUR, 2)} AS `SUM_{s.shown}(h)`")
    columns.append(f"{scaled_total(f'{s.measure}__max', s.unit, 2)} AS `MAX_{s.shown}({s.unit_name})`")
    return columns


def _profile_columns() -> list[str]:
    columns = [column for s in STATISTICS for column in _statistic_columns(s)]
    columns.append("count_total_sql")
    for m, family in FAMILIES:
        columns += [f"{m}__n{i} AS `CNTSQL: {text}`" for i, text in zip(family.ordinals, family.texts)]
    # Empty buckets: 0 for a sum, NULL for a mean.
    scan = list(zip(buckets.SCAN_SIZE.ordinals, buckets.SCAN_SIZE.texts))
    elapsed = list(zip(buckets.ELAPSED.ordinals, buckets.ELAPSED.texts))
    columns += [
        f"{scaled_total(f'coalesce(scan__elapsed{i}, 0)', MS_PER_HOUR, 1)} AS `SUM_ELAPSED_TIME(h): {text}`"
        for i, text in scan
    ]
    columns += [
        f"{scaled_total(f'scan__elapsed{i}', f'bytes_scanned__n{i} * {MS_PER_SECOND}L', 1)}"
        f" AS `AVG_ELAPSED_TIME(s): {text}`"
        for i, text in scan
    ]
    columns += [
        f"{scaled_total(f'scan__bytes{i}', f'bytes_scanned__n{i} * {GB}L', 2)} AS `AVG_SCAN_SIZE(GB): {text}`"
        for i, text in scan
    ]
    columns += [
        f"{scaled_total(f'coalesce(elapsed__elapsed{i}, 0)', MS_PER_HOUR, 1)} AS `SUM_ELAPSED_TIME(h): {text}`"
        for i, text in elapsed
    ]
    return columns


def _twice_median(measure: str) -> str:
    return f"m_{measure}__twice_median"


def _acceleration_columns() -> list[str]:
    """Statistics of eligible acceleration seconds; NULL for a group without eligible queries."""
    m = ELIGIBLE_SECONDS
    return [
        "total_eligible_qas_sql_count",
        f"{scaled_total(f'{m}__sum', f'{m}__count', 2)} AS `avg_{m}(s)`",
        f"{scaled_total(_twice_median(m), 2, 2)} AS `mdn_{m}(s)`",
        f"CAST({m}__sum AS DECIMAL(38,0)) AS `sum_{m}(s)`",
        f"{m}__max AS `max_{m}(s)`",
    ]


def query_profile(history: DataFrame, period: Period, eligible: DataFrame | None = None) -> DataFrame:
    """Statistics, bucket counts and bucketed times per warehouse and size, with acceleration statistics if
    ``eligible`` queries are given."""
    sources = [(_measured(history, period), _history_measures())]
    columns = _profile_columns()
    if eligible is not None:
        # Eligible rows without a warehouse or size have no counterpart in the profile.
        seconds = period.rows_of(eligible).select(*GROUP_KEYS, ELIGIBLE_SECONDS).dropna(subset=list(GROUP_KEYS))
        sources.append((seconds, ELIGIBLE_MEASURES))
        columns += _acceleration_columns()
    groups = with_medians(sources, GROUP_KEYS, _group_aggregates()).where("count_total_sql > 0")
    return groups.selectExpr(*GROUP_KEYS, *columns)


def warehouse_detail(
    history: DataFrame,
    metering: DataFrame,
    eligible: DataFrame,
    period: Period,
) -> DataFrame:
    """Profile of every warehouse and size with its cost and its acceleration statistics.

    Warehouses without credits in the window are left out; groups without eligible queries have NULL
    acceleration statistics.  Credits repeat on every size of a warehouse and must not be added up.

    Unlike the other reports this one runs jobs while it is built: it counts the slices of all measures, and
    reads the rows of the middle ones again (see ``with_medians``).
    """
    profile = query_profile(history, period, eligible)
    credits = credits_per_warehouse(metering, period)
    shares = [
        f"{percent_text(f'`CNTSQL: {text}`', 'count_total_sql', 0)} AS `%CNTSQL: {text}`"
        for text in buckets.SCAN_SIZE.texts
    ]
    keys = list(GROUP_KEYS)
    profiled = [f"`{name}`" for name in profile.columns if name not in keys]
    return (
        profile.join(credits, "warehouse_name")
        .orderBy(F.expr(size_rank("warehouse_size")).desc(), F.col("credits_used").desc(), *keys)
        .selectExpr(
            *keys,
            f"'{period.label}' AS `DATE PERIOD`",
            "credits_used",
            *shares,
            *profiled,
        )
    )
