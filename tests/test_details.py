"""Ranked lists: rounding before filtering, order, limits."""

from __future__ import annotations

from decimal import Decimal

from helpers import GB, history, query_ids

from usagelens.functions.fixed_point import largest_raw_rounding_to, smallest_raw_rounding_above
from usagelens.functions.period import Period
from usagelens.plans import reports

PERIOD = Period.of("2024-01-01 00:00:00", "2024-01-31 23:59:00")


def test_queue_filter_uses_the_rounded_time(spark):
    rows = [{"queued_overload_time": v, "total_elapsed_time": 1000} for v in (0, 4, 5, 14, 15, None)]
    result = reports.queue_top(history(spark, rows), PERIOD).collect()
    assert [(r["query_id"], r["queued_time_s"], r["percent_queued"]) for r in result] == [
        ("q004", Decimal("0.02"), "1.50%"),
        ("q002", Decimal("0.01"), "0.50%"),
        ("q003", Decimal("0.01"), "1.40%"),
    ]


def test_queue_percent_of_zero_elapsed_is_null(spark):
    result = reports.queue_top(history(spark, [{"queued_overload_time": 9, "total_elapsed_time": 0}]), PERIOD)
    assert result.first()["percent_queued"] is None


def test_txblock_top(spark):
    rows = [{"transaction_blocked_time": v} for v in (4, 145, 500)]
    result = reports.txblock_top(history(spark, rows), PERIOD).collect()
    assert [(r["query_id"], r["txblocked_time_s"]) for r in result] == [
        ("q002", Decimal("0.50")), ("q001", Decimal("0.15"))
    ]


def test_elapsed_filter_uses_the_rounded_time(spark):
    rows = [{"total_elapsed_time": v} for v in (0, 49, 50, 149, 150)]
    result = reports.elapsed_top(history(spark, rows), PERIOD).collect()
    assert [(r["query_id"], r["total_elapsed_time_s"]) for r in result] == [
        ("q004", Decimal("0.2")), ("q002", Decimal("0.1")), ("q003", Decimal("0.1"))
    ]


def test_spill_lists_keep_unscanned_queries(spark):
    rows = [
        {"bytes_spilled_to_local_storage": GB, "bytes_scanned": 0},
        {"bytes_spilled_to_local_storage": 3 * GB // 2, "bytes_spilled_to_remote_storage": 1},
        {},
    ]
    table = history(spark, rows)
    assert query_ids(reports.local_spill_top(table, PERIOD)) == ["q001", "q000"]
    assert query_ids(reports.remote_spill_top(table, PERIOD)) == ["q001"]
    first = reports.local_spill_top(table, PERIOD, limit=1).collect()
    assert [r["bytes_spilled_to_local_storage_gb"] for r in first] == [Decimal("1.50")]
    assert str(first[0]["start_time"]) == "2024-01-10 21:00:00"


def test_scan_size_range_bounds(spark):
    # 0.005 GB rounds up to 0.01, 10.005 GB up to 10.01.
    low = smallest_raw_rounding_above(0, GB, 2)
    high = largest_raw_rounding_to(10, GB, 2)
    values = [0, low - 1, low, GB, high, high + 1]
    result = reports.scan_size_range(history(spark, [{"bytes_scanned": v} for v in values]), PERIOD)
    assert [(r["query_id"], r["bytes_scanned_gb"]) for r in result.collect()] == [
        ("q004", Decimal("10.00")), ("q003", Decimal("1.00")), ("q002", Decimal("0.01"))
    ]
    assert result.schema["bytes_scanned_gb"].dataType.simpleString() == "decimal(10,2)"


def test_raw_bounds_agree_with_rounding():
    for unit, digits in ((1000, 2), (1000, 1), (GB, 2)):
        for minimum in (0, "0.5", "1.25", 10):
            raw = smallest_raw_rounding_above(minimum, unit, digits)

            def rounded(x):
                return (2 * x * 10**digits + unit) // (2 * unit)

            threshold = Decimal(str(minimum)) * 10**digits
            assert rounded(raw) > threshold >= rounded(raw - 1)


def test_prune_ratio_detail_uses_the_rounded_ratio(spark):
    scanned = (899_944, 899_950, 900_000, 1_000_000)
    rows = [{"partitions_scanned": v, "partitions_total": 1_000_000} for v in scanned]
    rows += [{"partitions_scanned": 0, "partitions_total": 0}, {"partitions_scanned": 95, "partitions_total": 100}]
    result = reports.prune_ratio_detail(history(spark, rows), PERIOD).collect()
    assert [(r["query_id"], r["%scan_partition_ratio"]) for r in result] == [
        ("q003", Decimal("100.00")),
        ("q005", Decimal("95.00")),
        ("q002", Decimal("90.00")),
        ("q001", Decimal("90.00")),
    ]


def test_warehouse_and_status_filters(spark):
    rows = [
        {"warehouse_name": "A"},
        {"warehouse_name": "B"},
        {"warehouse_name": "A", "execution_status": "FAIL"},
        {"warehouse_name": "A", "warehouse_size": None},
    ]
    table = history(spark, rows)
    assert query_ids(reports.elapsed_top(table, PERIOD, "A")) == ["q000"]
    assert query_ids(reports.elapsed_top(table, PERIOD)) == ["q000", "q001"]
