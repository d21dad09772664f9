"""Summary and profile: joins, empty buckets, ordering, agreement with the histograms."""

from __future__ import annotations

from datetime import datetime
from decimal import Decimal

from helpers import GB, history

from usagelens.functions import buckets
from usagelens.functions.period import Period, default_period
from usagelens.plans.profile import FAMILIES, query_profile, warehouse_detail
from usagelens.plans.summary import executed_queries, warehouse_summary
from usagelens.sources import schemas
from usagelens.sources.testdata import usage_tables

PERIOD = Period.of("2024-01-01 00:00:00", "2024-01-31 23:59:00")


def metering(spark, credits):
    rows = [(name, datetime(2024, 1, 10, 5), Decimal(used)) for name, used in credits.items()]
    return spark.createDataFrame(rows, schemas.WAREHOUSE_METERING_HISTORY)


def eligible(spark, rows):
    full = [(f"e{i}", "text", name, size, datetime(2024, 1, 10), s, 2) for i, (name, size, s) in enumerate(rows)]
    return spark.createDataFrame(full, schemas.QUERY_ACCELERATION_ELIGIBLE)


def test_summary(spark):
    rows = [
        {"warehouse_name": "A", "warehouse_size": "Small", "bytes_scanned": 3 * GB, "total_elapsed_time": 10_499},
        {"warehouse_name": "A", "warehouse_size": "Small", "bytes_scanned": GB, "execution_time": 4000},
        {"warehouse_name": "A", "warehouse_size": "Small", "bytes_scanned": 1, "execution_time": 4000},
        {"warehouse_name": "A", "warehouse_size": "Large", "bytes_scanned": 5 << 40},
        {"warehouse_name": "B", "warehouse_size": "6X-Large", "bytes_scanned": 1},
        {"warehouse_name": "C", "bytes_scanned": 1},
        {"warehouse_name": "A", "bytes_scanned": 0},
        {"warehouse_name": "A", "total_elapsed_time": 0},
    ]
    table = history(spark, rows)
    result = warehouse_summary(table, metering(spark, {"A": "1.45", "B": "7.00"}), PERIOD).collect()
    # C has no credits.  Unknown sizes come first, then by size.
    assert [(r[0], r[1]) for r in result] == [("B", "6X-Large"), ("A", "Large"), ("A", "Small")]
    small = result[2].asDict()
    assert small["percent_large"] == "33%" and small["percent_small"] == "67%"
    assert small["avg_bytes_large"] == "3.0 GB"
    assert small["AVG_LARGE_EXE_TIME(s)"] == 10 and small["AVG_ALL_EXE_TIME(s)"] == 3
    # 1.45 is rounded to 1.5 and then to 2; the credits repeat on every size.
    assert [r["credits_used"] for r in result] == [7, 2, 2]
    assert result[1]["avg_bytes_large"] == "5.0 TB"
    assert result[0]["avg_bytes_large"] is None and result[0]["AVG_LARGE_EXE_TIME(s)"] is None
    assert small["DATE PERIOD"] == "2024-01-01 - 2024-01-31"


def test_detail_of_empty_buckets_and_missing_acceleration(spark):
    rows = [{"warehouse_name": "A", "bytes_scanned": 2 * GB}, {"warehouse_name": "B", "partitions_total": 0}]
    result = warehouse_detail(
        history(spark, rows), metering(spark, {"A": "1.00", "B": "2.00"}), eligible(spark, [("A", "Small", 7)]), PERIOD
    ).collect()
    assert [r["warehouse_name"] for r in result] == ["B", "A"]
    b, a = (r.asDict() for r in result)
    assert a["CNTSQL: 1GB < SCAN_SIZE <= 20GB"] == 1 and a["%CNTSQL: 1GB < SCAN_SIZE <= 20GB"] == "100%"
    assert a["SUM_ELAPSED_TIME(h): 50GB < SCAN_SIZE"] == 0 and a["AVG_ELAPSED_TIME(s): 50GB < SCAN_SIZE"] is None
    assert a["AVG_ELAPSED_TIME(s): 1GB < SCAN_SIZE <= 20GB"] == 1
    assert a["avg_eligible_query_acceleration_time(s)"] == 7
    assert b["total_eligible_qas_sql_count"] is None and b["max_eligible_query_acceleration_time(s)"] is None
    # No partitions: no ratio, in no bucket.
    assert b["AVG_SCAN_PARTITION_RATIO(%)"] is None and b["MDN_SCAN_PARTITION_RATIO(%)"] is None


def test_byte_totals_pass_the_range_of_bigint(spark):
    huge = 3 << 60
    rows = [{"bytes_scanned": huge, "bytes_spilled_to_local_storage": huge}] * 4
    result = query_profile(history(spark, rows), PERIOD).first()
    assert result["SUM_SCAN_SIZE(GB)"] == 12 << 30
    assert result["AVG_SCAN_SIZE(GB)"] == result["MDN_SCAN_SIZE(GB)"] == 3 << 30
    assert result["SUM_LOCAL_SPILLED_SIZE(GB)"] == 12 << 30


def test_profile_agrees_with_its_own_histograms(spark):
    tables = usage_tables(spark, "/root/testdata/sf0.01")
    period = default_period(datetime(2024, 1, 1).date())
    profile = {(r[0], r[1]): r for r in query_profile(tables.query_history, period).collect()}
    totals = {
        (r[0], r[1]): r["count"]
        for r in executed_queries(tables.query_history, period).groupBy("warehouse_name", "warehouse_size").count().collect()
    }
    summary = warehouse_summary(tables.query_history, tables.warehouse_metering_history, period).collect()
    assert {(r[0], r[1]): r["count_queries"] for r in summary} == totals
    for key, row in profile.items():
        assert row["count_total_sql"] == totals[key]
        for _, family in FAMILIES:
            counted = sum(row[f"CNTSQL: {text}"] for text in family.texts)
            assert counted <= totals[key]
            if family in (buckets.SCAN_SIZE, buckets.ELAPSED, buckets.LOCAL_SPILL):
                assert counted == totals[key]
