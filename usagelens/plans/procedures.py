"""The reports as SQL table functions: ``SELECT * FROM queue_histogram('WH_1', '2024-01-05 00:00:00', '2024-01-20 23:59:00')``.

Functions are SQL themselves, so Spark puts their text into the query that calls them: constant arguments
become constant bounds of stored columns, which reach the scan, and a caller's own filters and columns
pass through.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..functions import buckets
from ..functions.buckets import BucketFamily
from ..functions.fixed_point import (
    GB,
    MS_PER_SECOND,
    count_where,
    divide_half_up,
    percent_text,
    scaled,
    smallest_raw_rounding_above,
)
from ..functions.period import REPORT_ZONE
from ..operators.base import GROUP_KEYS
from .reports import PRUNE_RATIO, QUERY_COLUMNS, QUEUED_RATIO, TXBLOCKED_RATIO

#: Arguments of every function; ``warehouse`` NULL means all warehouses, times are report wall clock.
ARGUMENTS = "warehouse STRING, begin_time STRING, end_time STRING"

#: Function -> rows it counts, bucket family, bucketed value, name of the range, decimals of the share.
HISTOGRAMS: dict[str, tuple[str, BucketFamily, str, str, int]] = {
    "local_spill_histogram": (
        "bytes_scanned > 0", buckets.LOCAL_SPILL, "bytes_spilled_to_local_storage", "local_spilled_size_range", 2),
    "remote_spill_histogram": (
        "bytes_scanned > 0", buckets.REMOTE_SPILL, "bytes_spilled_to_remote_storage", "remote_spilled_size_range", 2),
    "queue_histogram": ("true", buckets.QUEUED_RATIO, QUEUED_RATIO, "queued_percent_range", 2),
    "txblock_histogram": ("true", buckets.TXBLOCKED_RATIO, TXBLOCKED_RATIO, "txblocked_percent_range", 2),
    "elapsed_histogram": ("total_elapsed_time > 0", buckets.ELAPSED, "total_elapsed_time", "elapsed_time_range", 3),
    "scan_size_histogram": ("bytes_scanned > 0", buckets.SCAN_SIZE, "bytes_scanned", "scan_size_range", 1),
    "prune_ratio_histogram": ("partitions_total > 0", buckets.PRUNE_RATIO, PRUNE_RATIO, "scan_partition_ratio_range", 1),
}


def _window(instants: bool) -> str:
    """Stored rows of the window, with the zone applied to the arguments and never to the column."""
    def bound(name: str) -> str:
        wall = f"to_timestamp_ntz({name}, 'yyyy-MM-dd HH:mm:ss')"
        if instants:
            return f"CAST(convert_timezone('{REPORT_ZONE}', current_timezone(), {wall}) AS TIMESTAMP)"
        return f"convert_timezone('{REPORT_ZONE}', 'UTC', {wall})"

    return f"start_time >= {bound('begin_time')} AND start_time <= {bound('end_time')}"


def _base(view: str, instants: bool, where: str) -> str:
    return (
        f"FROM {view} WHERE execution_status = 'SUCCESS' AND warehouse_size IS NOT NULL AND warehouse_name IS NOT NULL "
        f"AND (warehouse IS NULL OR warehouse_name = warehouse) AND {_window(instants)} AND {where}"
    )


def _histogram(view: str, instants: bool, name: str) -> str:
    where, family, value, range_column, digits = HISTOGRAMS[name]
    keys = ", ".join(GROUP_KEYS)
    counters = ", ".join(f"{count_where(c)} AS `{label}`" for c, label in zip(family.conditions("bucket_value"), family.labels))
    labels = ", ".join(f"`{label}`" for label in family.labels)
    return (
        f"SELECT *, {percent_text('sql_count', 'total_count_sql', digits)} AS percent_sql_count FROM ("
        f"SELECT {keys}, count(*) AS total_count_sql, {counters} "
        f"FROM (SELECT {keys}, {value} AS bucket_value {_base(view, instants, where)}) GROUP BY {keys}) "
        f"UNPIVOT (sql_count FOR {range_column} IN ({labels}))"
    )


def _ranked(view: str, instants: bool, columns: Sequence[str], where: str, order: str) -> str:
    return f"SELECT {', '.join(columns)} {_base(view, instants, where)} ORDER BY {order} DESC, query_id"


def _lists(view: str, instants: bool) -> dict[str, str]:
    """Function -> its SELECT, for the ranked lists without further arguments."""
    zone = "current_timezone()" if instants else "'UTC'"
    start = f"convert_timezone({zone}, '{REPORT_ZONE}', CAST(start_time AS TIMESTAMP_NTZ)) AS start_time"
    found = {}
    local, remote = "bytes_spilled_to_local_storage", "bytes_spilled_to_remote_storage"
    sizes = [c for m in (local, remote) for c in (m, f"{scaled(m, GB, 2)} AS {m}_gb")]
    for name, measure in (("local_spill_top", local), ("remote_spill_top", remote)):
        found[name] = _ranked(view, instants, [*QUERY_COLUMNS, start, *sizes], f"{measure} > 0", measure)
    shortest = smallest_raw_rounding_above(0, MS_PER_SECOND, 2)
    for name, measure, what in (
        ("queue_top", "queued_overload_time", "queued"), ("txblock_top", "transaction_blocked_time", "txblocked")
    ):
        columns = [
            *QUERY_COLUMNS, start, f"{scaled('total_elapsed_time', MS_PER_SECOND, 2)} AS elapsed_time_s",
            f"{scaled(measure, MS_PER_SECOND, 2)} AS {what}_time_s",
            f"{percent_text(measure, 'total_elapsed_time', 2)} AS percent_{what}",
        ]
        found[name] = _ranked(
            view, instants, columns, f"{measure} >= {shortest}", divide_half_up(measure, MS_PER_SECOND, 2)
        )
    columns = [*QUERY_COLUMNS, start, f"{scaled('total_elapsed_time', MS_PER_SECOND, 1)} AS total_elapsed_time_s"]
    least = smallest_raw_rounding_above(0, MS_PER_SECOND, 1)
    found["elapsed_top"] = _ranked(
        view, instants, columns, f"total_elapsed_time >= {least}", divide_half_up("total_elapsed_time", MS_PER_SECOND, 1)
    )
    return found


def _size_range(view: str, instants: bool) -> str:
    """Rounded to 0.01 GB, a size is over a bound from half a hundredth above the bound's hundredths on."""
    above = lambda g: f"CAST(ceil((2 * floor({g} * 100) + 1) * {GB}BD / 200) AS BIGINT)"
    columns = [
        *QUERY_COLUMNS, f"CAST({scaled('bytes_scanned', GB, 2)} AS DECIMAL(10,2)) AS bytes_scanned_gb",
        f"CAST({scaled('total_elapsed_time', MS_PER_SECOND, 2)} AS DECIMAL(10,2)) AS total_elapsed_time_s",
    ]
    where = f"bytes_scanned >= {above('min_gb')} AND bytes_scanned < {above('max_gb')}"
    return _ranked(view, instants, columns, where, divide_half_up("bytes_scanned", GB, 2))


def register_procedures(spark: SparkSession, history: DataFrame, view: str = "query_history", prefix: str = "") -> list[str]:
    """Make the reports on ``history`` temporary table functions of the session; gives their names.

    ``history`` becomes the temporary view ``view``.  Registering again replaces both.  Result columns and
    their types are those of the reports; rows of a ranked list come in its order where nothing follows.
    """
    history.createOrReplaceTempView(view)
    instants = isinstance(history.schema["start_time"].dataType, T.TimestampType)
    bodies = {name: (ARGUMENTS, _histogram(view, instants, name)) for name in HISTOGRAMS}
    bodies |= {name: (ARGUMENTS, body) for name, body in _lists(view, instants).items()}
    sized = f"{ARGUMENTS}, min_gb DECIMAL(18,6) DEFAULT 0, max_gb DECIMAL(18,6) DEFAULT 10"
    bodies["scan_size_range"] = (sized, _size_range(view, instants))
    for name, (arguments, body) in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({arguments}) RETURNS TABLE RETURN {body}")
    return [f"{prefix}{name}" for name in bodies]
