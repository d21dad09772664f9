"""Every registered query against its SQL twin, and the reports for other windows and warehouses."""

from __future__ import annotations

import pytest
from conftest import SF_DIR

from __spark_entry__ import CORPUS_QUERIES, HISTORY_REPORTS, PERIOD as WHOLE_PERIOD, _comparable, entry, oracle_sql, queries
from check_oracle import differences
from oracle.duckdb_sql import Oracle
from usagelens.functions.period import Period
from usagelens.plans import reports
from usagelens.plans.profile import warehouse_detail
from usagelens.plans.summary import warehouse_summary
from usagelens.sources.testdata import usage_tables

BEGIN, END = "2024-01-05 00:00:00", "2024-01-20 23:59:00"
PERIOD = Period.of(BEGIN, END)


def test_every_query_has_a_twin():
    assert set(queries()) - set(CORPUS_QUERIES) == set(oracle_sql()) - set(CORPUS_QUERIES)


def test_the_period_covers_all_events(spark):
    times = usage_tables(spark, SF_DIR).query_history
    assert WHOLE_PERIOD.rows_of(times).count() == times.count() > 0


@pytest.mark.parametrize("name", [name for name in queries() if name not in CORPUS_QUERIES])
def test_registered_query(spark, duck, name):
    rows, difference = differences(queries()[name](spark, SF_DIR), duck, oracle_sql()[name])
    assert difference is None
    assert rows > 0


@pytest.mark.parametrize("name", list(HISTORY_REPORTS))
def test_one_warehouse_in_a_window(spark, duck, name):
    result = getattr(reports, name)(usage_tables(spark, SF_DIR).query_history, PERIOD, "WH_1")
    rows, difference = differences(_comparable(result), duck, Oracle(BEGIN, END, "WH_1").all()[name])
    assert difference is None
    assert rows > 0


def test_joined_reports_in_a_window(spark, duck):
    tables = usage_tables(spark, SF_DIR)
    oracle = Oracle(BEGIN, END)
    summary = warehouse_summary(tables.query_history, tables.warehouse_metering_history, PERIOD)
    assert differences(_comparable(summary), duck, oracle.warehouse_summary())[1] is None
    detail = warehouse_detail(
        tables.query_history, tables.warehouse_metering_history, tables.query_acceleration_eligible, PERIOD
    )
    assert len(detail.columns) == 101
    assert differences(_comparable(detail), duck, oracle.warehouse_detail())[1] is None


def test_acceleration_of_one_warehouse(spark, duck):
    result = reports.accel_eligible(usage_tables(spark, SF_DIR).query_acceleration_eligible, PERIOD, "WH_2")
    assert differences(result, duck, Oracle(BEGIN, END, "WH_2").accel_eligible())[1] is None


def test_entry(spark):
    assert entry(spark).count() > 0
