"""Reports on one or all warehouses: histograms and ranked query lists.

Every report takes a fact table, a window and a warehouse name, and returns a lazy DataFrame.
``warehouse=None`` reports on all warehouses at once.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame

from ..functions import buckets
from ..functions.fixed_point import (
    GB,
    MS_PER_SECOND,
    as_decimal,
    divide_half_up,
    largest_raw_rounding_to,
    percent_text,
    ratio_micros,
    scaled,
    smallest_raw_rounding_above,
)
from ..functions.period import Period
from ..operators.base import GROUP_KEYS, of_warehouse, successful_queries
from ..operators.detail import Page, RawBound, ranked
from ..operators.histogram import Histogram, histogram

QUERY_COLUMNS = (*GROUP_KEYS, "query_id", "query_text")


QUEUED_RATIO = ratio_micros("queued_overload_time", "total_elapsed_time")
TXBLOCKED_RATIO = ratio_micros("transaction_blocked_time", "total_elapsed_time")
PRUNE_RATIO = ratio_micros("partitions_scanned", "partitions_total")


def warehouse_list(warehouses: DataFrame) -> DataFrame:
    """Names of all warehouses, in order."""
    return warehouses.select("name").distinct().orderBy("name")


def shared_warehouse_list(warehouses: DataFrame, view: str = "warehouse_list") -> DataFrame:
    """The warehouse list, kept after its first use and readable as a view.

    For callers that offer the same choice of warehouses many times.  The list is as small as the
    number of warehouses; a lost block is computed again.
    """
    listed = warehouse_list(warehouses).persist()
    listed.createOrReplaceTempView(view)
    return listed


# --- Histograms -----------------------------------------------------------------------------------


LOCAL_SPILL = Histogram(
    buckets.LOCAL_SPILL, "bytes_spilled_to_local_storage", "bytes_scanned > 0", "local_spilled_size_range", 2
)
REMOTE_SPILL = Histogram(
    buckets.REMOTE_SPILL, "bytes_spilled_to_remote_storage", "bytes_scanned > 0", "remote_spilled_size_range", 2
)
QUEUED = Histogram(buckets.QUEUED_RATIO, QUEUED_RATIO, "TRUE", "queued_percent_range", 2)
TXBLOCKED = Histogram(buckets.TXBLOCKED_RATIO, TXBLOCKED_RATIO, "TRUE", "txblocked_percent_range", 2)
ELAPSED = Histogram(buckets.ELAPSED, "total_elapsed_time", "total_elapsed_time > 0", "elapsed_time_range", 3)
SCAN_SIZE = Histogram(buckets.SCAN_SIZE, "bytes_scanned", "bytes_scanned > 0", "scan_size_range", 1)
PRUNED = Histogram(buckets.PRUNE_RATIO, PRUNE_RATIO, "partitions_total > 0", "scan_partition_ratio_range", 1)


def local_spill_histogram(history: DataFrame, period: Period, warehouse: str | None = None) -> DataFrame:
    """Queries per size of data spilled to local storage; only queries that scanned data."""
    return histogram(successful_queries(history, period, warehouse), GROUP_KEYS, LOCAL_SPILL)


def remote_spill_histogram(history: DataFrame, period: Period, warehouse: str | None = None) -> DataFrame:
    """Queries per size of data spilled to remote storage; only queries that scanned data."""
    return histogram(successful_queries(history, period, warehouse), GROUP_KEYS, REMOTE_SPILL)


def queue_histogram(history: DataFrame, period: Period, warehouse: str | None = None) -> DataFrame:
    """Queries per share of elapsed time spent in the queue."""
    return histogram(successful_queries(history, period, warehouse), GROUP_KEYS, QUEUED)


def txblock_histogram(history: DataFrame, period: Period, warehouse: str | None = None) -> DataFrame:
    """Queries per share of elapsed time blocked by transactions."""
    return histogram(successful_queries(history, period, warehouse), GROUP_KEYS, TXBLOCKED)


def elapsed_histogram(history: DataFrame, period: Period, warehouse: str | None = None) -> DataFrame:
    """Queries per elapsed time."""
    return histogram(successful_queries(history, period, warehouse), GROUP_KEYS, ELAPSED)


def scan_size_histogram(history: DataFrame, period: Period, warehouse: str | None = None) -> DataFrame:
    """Queries per scanned size."""
    return histogram(successful_queries(history, period, warehouse), GROUP_KEYS, SCAN_SIZE)


def prune_ratio_histogram(history: DataFrame, period: Period, warehouse: str | None = None) -> DataFrame:
    """Queries per share of partitions scanned; a share of exactly 0 is in no bucket."""
    return histogram(successful_queries(history, period, warehouse), GROUP_KEYS, PRUNED)


def local_spill_histogram_by_start(
    history: DataFrame, period: Period, warehouse: str | None = None
) -> DataFrame:
    """The local-spill histogram per start time (stored and local)."""
    per_start = histogram(successful_queries(history, period, warehouse), ("start_time", *GROUP_KEYS), LOCAL_SPILL)
    # The local time follows from the stored one, so it need not be a grouping key.
    return per_start.selectExpr(
        "start_time",
        f"{period.local_time(per_start)} AS conv_strtime",
        *GROUP_KEYS,
        "total_count_sql",
        "local_spilled_size_range",
        "sql_count",
        "percent_sql_count AS `%sql_count`",
    )


# --- Ranked lists ---------------------------------------------------------------------------------


def _rounded(column: str, unit: int, digits: int) -> RawBound:
    """The stored column behind a figure that is rounded to ``digits`` of ``unit``."""
    return RawBound(column, lambda figure: largest_raw_rounding_to(str(Decimal(figure).scaleb(-digits)), unit, digits))


def _spill_top(
    history: DataFrame, period: Period, warehouse: str | None, measure: str, limit: int | None, page: Page | None
) -> DataFrame:
    rows = successful_queries(history, period, warehouse).where(f"{measure} > 0")
    local, remote = "bytes_spilled_to_local_storage", "bytes_spilled_to_remote_storage"
    columns = (
        *QUERY_COLUMNS,
        f"{period.local_time(rows)} AS start_time",
        local,
        f"{scaled(local, GB, 2)} AS {local}_gb",
        remote,
        f"{scaled(remote, GB, 2)} AS {remote}_gb",
    )
    return ranked(rows, columns, [measure], limit, page, RawBound(measure))


def local_spill_top(
    history: DataFrame,
    period: Period,
    warehouse: str | None = None,
    limit: int | None = None,
    page: Page | None = None,
) -> DataFrame:
    """Queries that spilled to local storage, largest first.  Unscanned queries are included."""
    return _spill_top(history, period, warehouse, "bytes_spilled_to_local_storage", limit, page)


def remote_spill_top(
    history: DataFrame,
    period: Period,
    warehouse: str | None = None,
    limit: int | None = None,
    page: Page | None = None,
) -> DataFrame:
    """Queries that spilled to remote storage, largest first.  Unscanned queries are included."""
    return _spill_top(history, period, warehouse, "bytes_spilled_to_remote_storage", limit, page)


def _wait_top(
    history: DataFrame,
    period: Period,
    warehouse: str | None,
    measure: str,
    names: tuple[str, str],
    limit: int | None,
    page: Page | None,
) -> DataFrame:
    # Listed are queries whose wait, rounded to 0.01 s, is over 0.
    shortest = smallest_raw_rounding_above(0, MS_PER_SECOND, 2)
    rows = successful_queries(history, period, warehouse).where(f"{measure} >= {shortest}")
    seconds, percent = names
    columns = (
        *QUERY_COLUMNS,
        f"{period.local_time(rows)} AS start_time",
        f"{scaled('total_elapsed_time', MS_PER_SECOND, 2)} AS elapsed_time_s",
        f"{scaled(measure, MS_PER_SECOND, 2)} AS {seconds}",
        f"{percent_text(measure, 'total_elapsed_time', 2)} AS {percent}",
    )
    return ranked(rows, columns, [divide_half_up(measure, MS_PER_SECOND, 2)], limit, page, _rounded(measure, MS_PER_SECOND, 2))


def queue_top(
    history: DataFrame,
    period: Period,
    warehouse: str | None = None,
    limit: int | None = None,
    page: Page | None = None,
) -> DataFrame:
    """Queries that waited in the queue, longest first."""
    names = ("queued_time_s", "percent_queued")
    return _wait_top(history, period, warehouse, "queued_overload_time", names, limit, page)


def txblock_top(
    history: DataFrame,
    period: Period,
    warehouse: str | None = None,
    limit: int | None = None,
    page: Page | None = None,
) -> DataFrame:
    """Queries blocked by transactions, longest first."""
    names = ("txblocked_time_s", "percent_txblocked")
    return _wait_top(history, period, warehouse, "transaction_blocked_time", names, limit, page)


def elapsed_top(
    history: DataFrame,
    period: Period,
    warehouse: str | None = None,
    limit: int | None = None,
    page: Page | None = None,
) -> DataFrame:
    """Queries by elapsed time, longest first; those that round to 0.0 s are left out."""
    shortest = smallest_raw_rounding_above(0, MS_PER_SECOND, 1)
    rows = successful_queries(history, period, warehouse).where(f"total_elapsed_time >= {shortest}")
    columns = (
        *QUERY_COLUMNS,
        f"{period.local_time(rows)} AS start_time",
        f"{scaled('total_elapsed_time', MS_PER_SECOND, 1)} AS total_elapsed_time_s",
    )
    return ranked(rows, columns, [divide_half_up("total_elapsed_time", MS_PER_SECOND, 1)], limit, page, _rounded("total_elapsed_time", MS_PER_SECOND, 1))


def scan_size_range(
    history: DataFrame,
    period: Period,
    warehouse: str | None = None,
    min_gb: float | str = 0,
    max_gb: float | str = 10,
    limit: int | None = None,
    page: Page | None = None,
) -> DataFrame:
    """Queries whose scanned size in GB, rounded to 0.01, is in ``(min_gb, max_gb]``, largest first."""
    smallest = smallest_raw_rounding_above(min_gb, GB, 2)
    largest = largest_raw_rounding_to(max_gb, GB, 2)
    rows = successful_queries(history, period, warehouse).where(
        f"bytes_scanned >= {smallest}L AND bytes_scanned <= {largest}L"
    )
    columns = (
        *QUERY_COLUMNS,
        f"CAST({scaled('bytes_scanned', GB, 2)} AS DECIMAL(10,2)) AS bytes_scanned_gb",
        f"CAST({scaled('total_elapsed_time', MS_PER_SECOND, 2)} AS DECIMAL(10,2)) AS total_elapsed_time_s",
    )
    return ranked(rows, columns, [divide_half_up("bytes_scanned", GB, 2)], limit, page, _rounded("bytes_scanned", GB, 2))


def prune_ratio_detail(
    history: DataFrame,
    period: Period,
    warehouse: str | None = None,
    limit: int | None = None,
    page: Page | None = None,
) -> DataFrame:
    """Queries that scanned 90 to 100 % of the partitions (rounded to 0.01 %), largest share first."""
    # The ratio in hundredths of a percent.
    points = divide_half_up(PRUNE_RATIO, 100)
    rows = (
        successful_queries(history, period, warehouse)
        .where("partitions_total > 0")
        .selectExpr("*", f"{points} AS points")
        .where("points BETWEEN 9000 AND 10000")
    )
    columns = (
        *QUERY_COLUMNS,
        f"{as_decimal('points', 2)} AS `%scan_partition_ratio`",
        "partitions_scanned",
        "partitions_total",
        f"{scaled('bytes_scanned', GB, 2)} AS bytes_scanned_gb",
        f"{scaled('total_elapsed_time', MS_PER_SECOND, 2)} AS total_elapsed_time_s",
    )
    return ranked(rows, columns, ["points", "partitions_scanned"], limit, page)


def accel_eligible(
    eligible: DataFrame,
    period: Period,
    warehouse: str | None = None,
    limit: int | None = None,
    page: Page | None = None,
) -> DataFrame:
    """Queries eligible for acceleration, most eligible seconds first."""
    rows = period.rows_of(of_warehouse(eligible, warehouse))
    columns = ("query_id", "query_text", "eligible_query_acceleration_time", "upper_limit_scale_factor")
    return ranked(rows, columns, ["eligible_query_acceleration_time"], limit, page, RawBound("eligible_query_acceleration_time"))
