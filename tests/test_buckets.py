"""Bucket bounds: zero, every bound, one unit above it, NULL and a zero divisor."""

from __future__ import annotations

import pytest
from helpers import GB, counts, history

from usagelens.functions import buckets
from usagelens.functions.period import Period
from usagelens.plans import reports

PERIOD = Period.of("2024-01-01 00:00:00", "2024-01-31 23:59:00")
MB = 1 << 20
TB = 1 << 40

SPILL_VALUES = [0, 1, MB, MB + 1, GB, GB + 1, 10 * GB, 10 * GB + 1, 100 * GB, 100 * GB + 1, TB, TB + 1, None]
SPILL_COUNTS = {0: 1, 1: 2, 2: 2, 3: 2, 4: 2, 5: 2, 6: 1}
# Elapsed 1,000,000 ms: a millisecond is one millionth.
WAIT_VALUES = [0, 1, 10_000, 10_001, 50_000, 50_001, 200_000, 200_001, 500_000, 500_001, 1_000_000, None]
WAIT_COUNTS = {0: 1, 1: 2, 2: 2, 3: 2, 4: 2, 5: 2}


@pytest.mark.parametrize(
    "report, range_column, column",
    [
        (reports.local_spill_histogram, "local_spilled_size_range", "bytes_spilled_to_local_storage"),
        (reports.remote_spill_histogram, "remote_spilled_size_range", "bytes_spilled_to_remote_storage"),
    ],
)
def test_spill(spark, report, range_column, column):
    rows = [{column: v} for v in SPILL_VALUES] + [{column: 5, "bytes_scanned": 0}]
    result = report(history(spark, rows), PERIOD)
    assert counts(result, range_column) == SPILL_COUNTS
    # NULL counts in the total, a query without scanned data does not.
    assert {r["total_count_sql"] for r in result.collect()} == {len(SPILL_VALUES)}


@pytest.mark.parametrize(
    "report, range_column, column",
    [
        (reports.queue_histogram, "queued_percent_range", "queued_overload_time"),
        (reports.txblock_histogram, "txblocked_percent_range", "transaction_blocked_time"),
    ],
)
def test_waits(spark, report, range_column, column):
    rows = [{column: v, "total_elapsed_time": 1_000_000} for v in WAIT_VALUES]
    rows.append({column: 0, "total_elapsed_time": 0})
    result = report(history(spark, rows), PERIOD)
    assert counts(result, range_column) == WAIT_COUNTS
    # The zero divisor is in the total and in no bucket.
    assert {r["total_count_sql"] for r in result.collect()} == {len(WAIT_VALUES) + 1}


def test_wait_ratio_is_rounded_to_six_decimals(spark):
    rows = [
        {"queued_overload_time": 1, "total_elapsed_time": 2_000_001},  # 0.0000004999… -> 0
        {"queued_overload_time": 1, "total_elapsed_time": 2_000_000},  # 0.0000005 -> 0.000001
        {"queued_overload_time": 100_004, "total_elapsed_time": 10_000_000},  # 0.0100004 -> 0.01
        {"queued_overload_time": 100_005, "total_elapsed_time": 10_000_000},  # 0.0100005 -> 0.010001
    ]
    result = reports.queue_histogram(history(spark, rows), PERIOD)
    assert counts(result, "queued_percent_range") == {0: 1, 1: 2, 2: 1, 3: 0, 4: 0, 5: 0}


def test_elapsed(spark):
    bounds = [1_000, 10_000, 60_000, 600_000, 3_600_000]
    values = [0, 1, *[b + d for b in bounds for d in (0, 1)], None]
    result = reports.elapsed_histogram(history(spark, [{"total_elapsed_time": v} for v in values]), PERIOD)
    assert counts(result, "elapsed_time_range") == {1: 2, 2: 2, 3: 2, 4: 2, 5: 2, 6: 1}
    assert {r["total_count_sql"] for r in result.collect()} == {11}


def test_scan_size(spark):
    values = [0, 1, GB, GB + 1, 20 * GB, 20 * GB + 1, 50 * GB, 50 * GB + 1, None]
    result = reports.scan_size_histogram(history(spark, [{"bytes_scanned": v} for v in values]), PERIOD)
    assert counts(result, "scan_size_range") == {1: 2, 2: 2, 3: 2, 4: 1}


def test_prune_ratio(spark):
    values = [0, 1, 10_000, 10_001, 100_000, 100_001, 300_000, 300_001, 600_000, 600_001, 900_000, 900_001, None]
    rows = [{"partitions_scanned": v, "partitions_total": 1_000_000} for v in values]
    rows.append({"partitions_scanned": 0, "partitions_total": 0})
    result = reports.prune_ratio_histogram(history(spark, rows), PERIOD)
    # A ratio of exactly zero is in no bucket but in the total; zero partitions are filtered out.
    assert counts(result, "scan_partition_ratio_range") == {1: 2, 2: 2, 3: 2, 4: 2, 5: 2, 6: 1}
    assert {r["total_count_sql"] for r in result.collect()} == {len(values)}


def test_empty_buckets_stay_and_empty_groups_do_not(spark):
    result = reports.scan_size_histogram(history(spark, [{"bytes_scanned": 1}]), PERIOD).collect()
    assert [(r["sql_count"], r["percent_sql_count"]) for r in sorted(result, key=lambda r: r["scan_size_range"])] == [
        (1, "100.0%"), (0, "0.0%"), (0, "0.0%"), (0, "0.0%")
    ]
    assert reports.scan_size_histogram(history(spark, [{"warehouse_size": None}]), PERIOD).count() == 0


def test_share_has_fixed_decimals(spark):
    rows = [{"total_elapsed_time": 1}] * 2 + [{"total_elapsed_time": 5_000}]
    shares = {r["percent_sql_count"] for r in reports.elapsed_histogram(history(spark, rows), PERIOD).collect()}
    assert shares == {"66.667%", "33.333%", "0.000%"}


def test_families_have_a_text_per_bucket():
    with pytest.raises(ValueError):
        buckets.BucketFamily(bounds=(1, 2), texts=("a", "b"), has_zero_bucket=False)
    assert buckets.LOCAL_SPILL.labels[0] == "0: LOCAL_SPILLED_SIZE = 0B"
    assert buckets.PRUNE_RATIO.labels[-1] == "6: 90% < SCAN_P_RATIO"
