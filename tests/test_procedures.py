"""Reports called from SQL: the same rows as the DataFrame reports, and the same filters at the scan."""

from __future__ import annotations

import pytest
from test_plans import detail, plan

from usagelens.functions.period import Period
from usagelens.plans import reports
from usagelens.plans.procedures import register_procedures
from usagelens.sources.tables import read_query_history
from usagelens.sources.testdata import query_history

WINDOW = ("2024-01-05 00:00:00", "2024-01-20 23:59:00")
PERIOD = Period.of(*WINDOW)


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("procedures") / "query_history")
    query_history(spark, "/root/testdata/sf0.001").write.parquet(path)
    return read_query_history(spark, path)


@pytest.fixture(scope="module")
def names(spark, stored):
    return register_procedures(spark, stored, "procedure_history")


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_every_procedure_is_its_report(spark, stored, names):
    assert len(names) == 13
    for name in names:
        for warehouse in ("WH_1", None):
            expected = getattr(reports, name)(stored, PERIOD, warehouse)
            found = spark.sql(f"SELECT * FROM {name}(:w, :b, :e)", {"w": warehouse, "b": WINDOW[0], "e": WINDOW[1]})
            assert found.columns == expected.columns and found.dtypes == expected.dtypes, name
            assert rows(found) == rows(expected) != [], name


def test_bounds_of_the_size_range(spark, stored, names):
    for least, most in ((0, 10), (0.005, 1.25), (3, 3)):
        expected = reports.scan_size_range(stored, PERIOD, "WH_1", least, most)
        found = spark.sql(f"SELECT * FROM scan_size_range('WH_1', '{WINDOW[0]}', '{WINDOW[1]}', {least}, {most})")
        assert rows(found) == rows(expected)


def test_filters_reach_the_scan(spark, names):
    pushed = detail(plan(spark.sql(f"SELECT * FROM queue_histogram('WH_1', '{WINDOW[0]}', '{WINDOW[1]}')")), "PushedFilters")
    for part in (
        "GreaterThanOrEqual(start_time,2024-01-04T15:00)", "LessThanOrEqual(start_time,2024-01-20T14:59)",
        "EqualTo(warehouse_name,WH_1)", "EqualTo(execution_status,SUCCESS)", "IsNotNull(warehouse_size)",
    ):
        assert part in pushed
    sized = detail(plan(spark.sql(f"SELECT * FROM scan_size_range('WH_1', '{WINDOW[0]}', '{WINDOW[1]}')")), "PushedFilters")
    assert "GreaterThanOrEqual(bytes_scanned,5368710)" in sized and "LessThan(bytes_scanned,10742786" in sized


def test_procedures_compose(spark, names):
    found = spark.sql(
        f"SELECT warehouse_name, sum(sql_count) AS n FROM queue_histogram(NULL, '{WINDOW[0]}', '{WINDOW[1]}') "
        "WHERE warehouse_size = 'Small' GROUP BY ALL"
    ).collect()
    assert found and all(r["n"] > 0 for r in found)


def test_instants(spark, stored):
    history = stored.selectExpr("* EXCEPT (start_time)", "CAST(start_time AS TIMESTAMP) AS start_time").select(stored.columns)
    (name,) = [n for n in register_procedures(spark, history, "instant_history", "instant_") if n == "instant_elapsed_top"]
    found = spark.sql(f"SELECT * FROM {name}('WH_1', '{WINDOW[0]}', '{WINDOW[1]}')")
    assert rows(found) == rows(reports.elapsed_top(history, PERIOD, "WH_1")) != []
