from __future__ import annotations

from datetime import date, datetime

from helpers import history, query_ids

from usagelens.functions.period import Period, default_period
from usagelens.plans import reports
from usagelens.plans.summary import credits_per_warehouse
from usagelens.sources import schemas


def test_both_ends_are_inclusive_and_in_report_time(spark):
    period = Period.of("2024-01-05 00:00:00", "2024-01-20 23:59:00")
    times = [
        datetime(2024, 1, 4, 14, 59, 59, 999999),
        datetime(2024, 1, 4, 15, 0),  # Tokyo 2024-01-05 00:00:00
        datetime(2024, 1, 20, 14, 59),  # Tokyo 2024-01-20 23:59:00
        datetime(2024, 1, 20, 14, 59, 0, 1),
    ]
    table = history(spark, [{"start_time": t} for t in times])
    assert query_ids(period.rows_of(table).orderBy("query_id")) == ["q001", "q002"]


def test_instants_follow_the_same_window_in_any_session_zone(spark):
    period = Period.of("2024-01-05 00:00:00", "2024-01-20 23:59:00")
    times = ["2024-01-04 14:59:59", "2024-01-04 15:00:00", "2024-01-20 14:59:00", "2024-01-20 14:59:01"]
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        rows = history(spark, [{}] * 4).drop("start_time")
        stored = spark.createDataFrame([(f"q{i:03d}", f"{t}+00:00") for i, t in enumerate(times)], "query_id string, t string")
        table = rows.join(stored.selectExpr("query_id", "CAST(t AS TIMESTAMP) AS start_time"), "query_id")
        result = reports.elapsed_top(table, period).collect()
        assert [(r["query_id"], str(r["start_time"])) for r in result] == [
            ("q001", "2024-01-05 00:00:00"), ("q002", "2024-01-20 23:59:00")
        ]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_credit_window_is_the_dates_in_stored_time(spark):
    period = Period.of("2024-01-05 10:00:00", "2024-01-06 23:59:00")
    times = [
        datetime(2024, 1, 4, 23), datetime(2024, 1, 5, 0), datetime(2024, 1, 5, 9),
        datetime(2024, 1, 6, 0), datetime(2024, 1, 6, 1),
    ]
    from decimal import Decimal

    rows = [("WH", t, Decimal(f"{10**i}.25")) for i, t in enumerate(times)]
    metering = spark.createDataFrame(rows, schemas.WAREHOUSE_METERING_HISTORY)
    assert [r["credits_used"] for r in credits_per_warehouse(metering, period).collect()] == [Decimal("1110.8")]


def test_default_period():
    period = default_period(date(2024, 2, 17))
    assert period == Period.of("2024-02-01 00:00:00", "2024-02-29 23:59:00")
    assert default_period(date(2023, 12, 31)).end == datetime(2023, 12, 31, 23, 59)
    assert period.label == "2024-02-01 - 2024-02-29"
