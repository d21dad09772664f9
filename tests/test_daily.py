"""Reports from stored days equal the direct ones."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from helpers import GB, history
from test_plans import detail, plan

from usagelens.functions.period import Period
from usagelens.plans import daily, reports
from usagelens.plans.summary import warehouse_summary
from usagelens.sources.tables import read_query_history

START = datetime(2024, 1, 1)
SECONDS = 12 * 86_400


def random_rows(random_source, n):
    edges = [START + timedelta(days=d, seconds=s) for d in range(12) for s in (0, 86_399)]
    return [
        {
            "start_time": random_source.choice(edges + [START + timedelta(seconds=random_source.randrange(SECONDS))] * 40),
            "warehouse_name": random_source.choice(["A", "A", "A", "B", None]),
            "warehouse_size": random_source.choice(["Small", "Large", None]),
            "execution_status": random_source.choice(["SUCCESS", "SUCCESS", "FAIL"]),
            "total_elapsed_time": random_source.choice([None, 0, 999, 60_000, 10**7]),
            "execution_time": random_source.choice([None, 5, 10**6]),
            "queued_overload_time": random_source.choice([None, 0, 500]),
            "bytes_scanned": random_source.choice([None, 0, 5, 3 * GB, 2**62]),
            "bytes_spilled_to_local_storage": random_source.choice([None, 0, 2 * GB]),
            "partitions_total": random_source.choice([None, 0, 8]),
        }
        for _ in range(n)
    ]


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("daily")
    history(spark, random_rows(random.Random(5), 900)).write.parquet(str(folder / "history"))
    table = read_query_history(spark, str(folder / "history"))
    # Day 12 is not stored yet; days 4 and 5 are loaded twice.
    for first, end in ((1, 6), (4, 12)):
        days = table.where(f"start_time >= '2024-01-{first:02d}' AND start_time < '2024-01-{end:02d}'")
        daily.store_days(days, str(folder / "days"))
    return table, daily.read_days(spark, str(folder / "days"))


def rows_of(df):
    return sorted(map(str, df.collect()))


def windows():
    rng = random.Random(9)
    found = [
        Period.of("2024-01-01 00:00:00", "2024-01-12 23:59:00", "UTC"),
        Period.of("2024-01-03 00:00:00", "2024-01-03 00:00:00", "UTC"),
        Period.of("2024-01-05 06:00:00", "2024-01-05 18:00:00", "America/New_York"),
        Period.of("2025-01-05 06:00:00", "2025-01-25 18:00:00", "UTC"),
    ]
    for zone in ("Asia/Tokyo", "America/New_York", "Asia/Kolkata"):
        begin, end = sorted(START + timedelta(seconds=rng.randrange(SECONDS)) for _ in range(2))
        found.append(Period(begin, end, zone))
    return found


@pytest.mark.parametrize("period", windows(), ids=str)
def test_histograms_equal_the_direct_ones(stored, period):
    table, days = stored
    for name in daily.HISTOGRAMS:
        for warehouse in (None, "A"):
            direct = getattr(reports, name)(table, period, warehouse)
            assert rows_of(daily.histogram_of_days(name, days, table, period, warehouse)) == rows_of(direct)


def test_summary_equals_the_direct_one(spark, stored):
    table, days = stored
    metering = spark.createDataFrame(
        [(w, START + timedelta(days=d), 1.5) for w in "AB" for d in range(12)],
        "warehouse_name string, start_time timestamp_ntz, credits_used double",
    )
    for period in windows():
        direct = warehouse_summary(table, metering, period)
        assert rows_of(daily.summary_of_days(days, table, metering, period)) == rows_of(direct)


def test_instants_have_the_same_days(spark, stored):
    table, days = stored
    instants = table.withColumn("start_time", table.start_time.cast("timestamp"))
    assert rows_of(daily.daily_partials(instants)) == rows_of(daily.daily_partials(table))
    for period in windows()[-3:]:
        found = daily.histogram_of_days("elapsed_histogram", days, instants, period)
        assert rows_of(found) == rows_of(reports.elapsed_histogram(table, period))


def test_empty_history(spark, stored):
    table, days = stored
    period = windows()[0]
    assert daily.histogram_of_days("queue_histogram", days.limit(0), table.limit(0), period).count() == 0


def test_only_the_edges_are_read(stored):
    table, days = stored
    period = Period.of("2024-01-02 12:00:00", "2024-01-10 12:00:00", "UTC")
    text = plan(daily.histogram_of_days("elapsed_histogram", days, table, period))
    scans = [line for line in text.splitlines() if line.startswith("PushedFilters")]
    assert any("Or(LessThan(start_time,2024-01-03T00:00),GreaterThanOrEqual(start_time,2024-01-10T00:00))" in s for s in scans)
    assert "stored_day" in detail(text, "PartitionFilters")
    reads = [line for line in text.splitlines() if line.startswith("ReadSchema")]
    assert not any("queue_histogram" in line for line in reads)
