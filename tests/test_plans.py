"""Physical plans: what reaches the scan, how many shuffles there are."""

from __future__ import annotations

from helpers import history

from usagelens.functions.period import Period
from usagelens.plans import reports
from usagelens.plans.summary import credits_per_warehouse
from usagelens.sources.tables import read_query_history, read_usage_tables
from usagelens.sources.testdata import usage_tables

PERIOD = Period.of("2024-01-05 00:00:00", "2024-01-20 23:59:00")


def plan(df) -> str:
    """The physical plan with its details, each on a line of its own."""
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def detail(text: str, name: str) -> str:
    return next(line for line in text.splitlines() if line.startswith(name))


def stored(spark, tmp_path):
    path = str(tmp_path / "query_history")
    history(spark, [{}]).write.parquet(path)
    return read_query_history(spark, path)


def test_histogram_pushes_all_filters_and_shuffles_once(spark, tmp_path):
    text = plan(reports.scan_size_histogram(stored(spark, tmp_path), PERIOD, "WH"))
    pushed = detail(text, "PushedFilters")
    assert "GreaterThanOrEqual(start_time,2024-01-04T15:00)" in pushed
    assert "LessThanOrEqual(start_time,2024-01-20T14:59)" in pushed
    assert "EqualTo(warehouse_name,WH)" in pushed and "GreaterThan(bytes_scanned,0)" in pushed
    assert "EqualTo(execution_status,SUCCESS)" in pushed and "IsNotNull(warehouse_size)" in pushed
    assert text.count("Arguments: hashpartitioning") == 1
    assert "query_text" not in detail(text, "ReadSchema")


def test_rounded_filters_reach_the_scan(spark, tmp_path):
    table = stored(spark, tmp_path)
    assert "GreaterThanOrEqual(queued_overload_time,5)" in detail(plan(reports.queue_top(table, PERIOD)), "PushedFilters")
    size = detail(plan(reports.scan_size_range(table, PERIOD)), "PushedFilters")
    assert "GreaterThanOrEqual(bytes_scanned,5368710)" in size and "LessThanOrEqual(bytes_scanned,10742786" in size


def test_limit_needs_no_global_sort(spark, tmp_path):
    table = stored(spark, tmp_path)
    assert "TakeOrderedAndProject" in plan(reports.elapsed_top(table, PERIOD, limit=10))
    assert "rangepartitioning" in plan(reports.elapsed_top(table, PERIOD))


def test_days_prune_partitions(spark, tmp_path):
    path = str(tmp_path / "by_day")
    by_day = history(spark, [{}]).selectExpr("*", "CAST(start_time AS DATE) AS start_date")
    by_day.write.partitionBy("start_date").parquet(path)
    result = reports.elapsed_top(read_query_history(spark, path, by_day=True), PERIOD)
    filters = detail(plan(result), "PartitionFilters")
    assert "2024-01-04" in filters and "2024-01-21" in filters
    assert result.count() == 1


def test_days_prune_every_table(spark, tmp_path):
    tables = usage_tables(spark, "/root/testdata/sf0.001")
    for name in ("query_history", "warehouse_metering_history", "query_acceleration_eligible"):
        by_day = getattr(tables, name).selectExpr("*", "CAST(start_time AS DATE) AS start_date")
        by_day.write.partitionBy("start_date").parquet(str(tmp_path / name))
    tables.warehouses.write.parquet(str(tmp_path / "warehouses"))
    stored = read_usage_tables(spark, str(tmp_path), by_day=True)
    for df in (
        reports.accel_eligible(stored.query_acceleration_eligible, PERIOD),
        credits_per_warehouse(stored.warehouse_metering_history, PERIOD),
    ):
        filters = detail(plan(df), "PartitionFilters")
        assert "2024-01-04" in filters and "2024-01-21" in filters
    expected = credits_per_warehouse(tables.warehouse_metering_history, PERIOD).collect()
    assert sorted(credits_per_warehouse(stored.warehouse_metering_history, PERIOD).collect()) == sorted(expected)
