"""Medians and statistics from counters against exact ones computed in plain Python."""

from __future__ import annotations

import random
import statistics

import pytest
from pyspark.sql import functions as F

from usagelens import session
from usagelens.functions.period import Period
from usagelens.operators import counters
from usagelens.operators.counters import Measure, exact_medians, rows_where, total_where, with_medians
from usagelens.plans.profile import warehouse_detail
from usagelens.sources.tables import read_usage_tables
from usagelens.sources.testdata import usage_tables


def frame(spark, groups):
    rows = [(k, a, b) for k, values in groups.items() for a, b in values]
    return spark.createDataFrame(rows, "k string, a bigint, b bigint").repartition(3)


def twice_medians(spark, groups, slices, distinct_limit, monkeypatch=None):
    if monkeypatch:
        monkeypatch.setattr(counters, "SLICES", slices)
    result = exact_medians(frame(spark, groups), ["k"], ["a", "b"], distinct_limit).collect()
    return {r["k"]: tuple(None if r[m] is None else int(r[m]) for m in ("a", "b")) for r in result}


def expected(groups):
    def twice(values):
        present = [v for v in values if v is not None]
        return statistics.median_low(present) + statistics.median_high(present) if present else None

    return {k: (twice([a for a, _ in v]), twice([b for _, b in v])) for k, v in groups.items()}


def generated(seed):
    draw = random.Random(seed)
    groups = {}
    for g in range(5):
        size = draw.choice([1, 2, 7, 100, 401])
        kind = draw.choice(["small", "wide", "tied"])
        values = []
        for _ in range(size):
            a = {"small": draw.randrange(5), "wide": draw.randrange(1 << 45), "tied": draw.choice([0, 0, 7, 1 << 40])}[kind]
            values.append((a, draw.choice([None, draw.randrange(1 << 20)])))
        groups[f"g{g}"] = values
    return groups


@pytest.mark.parametrize("slices, distinct_limit", [(4, 1), (16, 8), (4096, 1 << 16)])
@pytest.mark.parametrize("seed", [1, 2])
def test_random_groups(spark, seed, slices, distinct_limit, monkeypatch):
    groups = generated(seed)
    assert twice_medians(spark, groups, slices, distinct_limit, monkeypatch) == expected(groups)


def test_middle_ranks_in_different_slices(spark):
    groups = {"gap": [(1, 0), (2, 0), (1_000_000, 0), (1_000_001, 0)], "one": [(5, None)]}
    assert twice_medians(spark, groups, 4, 1) == {"gap": (1_000_002, 0), "one": (10, None)}


def test_hot_group_with_few_distinct_values(spark):
    groups = {"hot": [(v, 3) for v in [0] * 2000 + [9] * 2001], "cold": [(4, 1)]}
    assert twice_medians(spark, groups, 4, 1) == {"hot": (18, 6), "cold": (8, 2)}


def test_mostly_zero(spark):
    groups = {"odd": [(0, 0)] * 3 + [(8, 5)] * 2, "even": [(0, 4)] * 2 + [(8, 4)] * 2, "zero": [(0, 0)] * 4}
    assert twice_medians(spark, groups, 4, 1) == {"odd": (0, 0), "even": (8, 8), "zero": (0, 0)}


def test_values_beyond_doubles(spark):
    odd, top = (1 << 53) + 1, (1 << 63) - 1
    groups = {"odd": [(odd, top)] * 3, "sum": [(odd, top), (odd + 1, top - 1)], "far": [(0, 1), (1 << 62, odd)]}
    assert twice_medians(spark, groups, 4, 1) == expected(groups)
    assert expected(groups)["odd"] == (18014398509481986, 2 * top)


@pytest.fixture
def no_broadcast(spark):
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_without_broadcast(spark, no_broadcast):
    groups = generated(3)
    assert twice_medians(spark, groups, 16, 8) == expected(groups)


def test_hot_group_is_joined_and_counted_in_many_tasks(spark, no_broadcast):
    groups = {"hot": [(v * 977, v) for v in range(5000)], "cold": [(v, v) for v in range(50)]}
    rows, measures = frame(spark, groups), [(0, Measure("m", "a"))]
    state = counters.group_statistics(counters.count_slices([(rows, measures)], ["k"]), ["k"], ["count(*) AS c"], [0])
    ranges = state.selectExpr("*", f"explode(sequence(0, {counters.SALTS - 1})) AS salt")
    values = counters._inside(rows, ["k"], measures, ranges).groupBy("k", "measure", "value").count()
    lines = values._jdf.queryExecution().executedPlan().toString().replace("#", " ").splitlines()
    # From the top: the values' own shuffle lies between their final count and the salted join.
    final = next(i for i, line in enumerate(lines) if "Aggregate(keys=[k" in line and ", value" in line)
    join = next(i for i, line in enumerate(lines) if "SortMergeJoin" in line and "salt" in line)
    assert any("Exchange hashpartitioning(k" in line and ", value" in line for line in lines[final:join])
    salt = F.expr(f"CAST(pmod(xxhash64(a), {counters.SALTS}) AS INT)")
    dealt = rows.where("k = 'hot'").groupBy(salt.alias("salt")).count().collect()
    assert len(dealt) == counters.SALTS and max(r["count"] for r in dealt) < 3 * 5000 / counters.SALTS


def test_only_middle_slices_are_read_again(spark):
    """Of values over many powers of two, few distinct ones are stored."""
    draw = random.Random(7)
    groups = {"g": [(1 << draw.randrange(40) | draw.randrange(1 << 20), draw.randrange(9)) for _ in range(3000)]}
    sizes = []
    distinct = counters._distinct_values
    counters._distinct_values = lambda *args: sizes.append((found := distinct(*args))[1]) or found
    try:
        assert twice_medians(spark, groups, 4096, 1 << 16) == expected(groups)
    finally:
        counters._distinct_values = distinct
    assert sizes[0] < 300


def test_statistics_with_the_medians(spark):
    rows = frame(spark, {"x": [(0, 5), (3, 7), (1 << 62, 1), ((1 << 62) + 1, None)], "y": [(9, None)]})
    other = spark.createDataFrame([("x", 4), ("z", 6)], "k string, c bigint")
    sources = [(rows, [(0, Measure("ma", "a", (2, 10), "b")), (1, Measure("mb", "b"))]), (other, [(2, Measure("mc", "c"))])]
    aggregates = [
        f"{rows_where(0)} AS n", f"{total_where(0)} AS total", f"{total_where(0, counters.in_bucket(3), 'beside')} AS beside",
        f"{rows_where(0, counters.in_bucket(0))} AS zeros", f"{rows_where(0, counters.in_bucket(2))} AS to_ten",
    ]
    found = {r["k"]: tuple(r)[1:] for r in with_medians(sources, ["k"], aggregates).collect()}
    whole = lambda row: tuple(None if x is None else int(x) for x in row)
    assert whole(found["x"]) == (4, (1 << 63) + 4, 1, 1, 1, (1 << 62) + 3, 10, 8)
    assert whole(found["y"]) == (1, 9, None, 0, 1, 18, None, None)
    assert whole(found["z"])[-1] == 12 and found["z"][0] == 0


def test_scans_and_jobs_of_the_profile(spark, tmp_path):
    """At most three scans of the history and 16 jobs, whatever they contain."""
    tables = usage_tables(spark, "/root/testdata/sf0.001")
    for name in ("query_history", "warehouse_metering_history", "query_acceleration_eligible", "warehouses"):
        getattr(tables, name).write.parquet(str(tmp_path / name))
    stored = read_usage_tables(spark, str(tmp_path))
    scans = []
    settle = counters.settle
    counters.settle = lambda df, name: scans.append(df) or settle(df, name)
    spark.sparkContext.setJobGroup("profile", "")
    try:
        report = warehouse_detail(stored.query_history, stored.warehouse_metering_history,
                                  stored.query_acceleration_eligible, Period.of("2024-01-01 00:00:00", "2024-01-31 23:59:00"))
        assert report.count() > 0
    finally:
        counters.settle = settle
        spark.sparkContext.setJobGroup("others", "")
    of_history = [f for df in [*scans, report] for f in set(df.inputFiles()) if "/query_history/part" in f]
    assert len(of_history) <= 3 * len(stored.query_history.inputFiles())
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("profile")) <= 16


def test_nothing_is_left_behind(spark, tmp_path, monkeypatch):
    groups = generated(4)
    monkeypatch.setattr(session, "shared_folder", lambda spark: str(tmp_path))
    assert twice_medians(spark, groups, 4, 1) == expected(groups)
    # Only the statistics and the last values are kept, until the end of the application.
    assert len(list(tmp_path.glob("*/median-values-*"))) == 1 and not list(tmp_path.glob("*/slice-counters-*"))
