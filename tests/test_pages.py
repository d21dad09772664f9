"""Ranked lists page by page: together the whole list, and no page reads what lies before it."""

from __future__ import annotations

import re
from datetime import datetime

import pytest
from conftest import SF_DIR
from test_plans import plan

from __spark_entry__ import PERIOD
from usagelens.operators.detail import CURSOR, Page, RawBound, next_page, ranked
from usagelens.plans import reports
from usagelens.sources import testdata


def all_pages(report, size):
    """Rows of every page, and how many pages there were."""
    page, rows, pages = Page(size), [], 0
    while page:
        listed = report(page)
        rows += [tuple(r) for r in listed.drop(CURSOR).collect()]
        page, pages = next_page(listed, page), pages + 1
    return rows, pages


@pytest.mark.parametrize("name", ["elapsed_top", "queue_top", "prune_ratio_detail"])
def test_pages_are_the_list(spark, name):
    history = testdata.query_history(spark, SF_DIR).where("warehouse_name = 'WH_1'").persist()
    report = getattr(reports, name)
    whole = [tuple(r) for r in report(history, PERIOD).collect()]
    rows, pages = all_pages(lambda page: report(history, PERIOD, page=page), len(whole) // 3 + 1)
    assert pages == 3
    assert rows == whole
    history.unpersist()


def test_ties_and_awkward_ids(spark):
    ids = ['a"b', "a\nb", "a,b", "[x]", "é", "", None, "a'b", "\\"]
    rows = [(i, figure) for i in ids for figure in (7, 5)]
    table = spark.createDataFrame(rows, "query_id string, figure long").repartition(3)
    whole = [tuple(r) for r in ranked(table, ["query_id", "figure"], ["figure"]).collect()]
    for size in (1, 4, 18, 19):
        found, pages = all_pages(lambda page: ranked(table, ["query_id", "figure"], ["figure"], page=page, raw=RawBound("figure")), size)
        assert found == whole
        # A full last page is followed by an empty one.
        assert pages == len(rows) // size + 1
    assert next_page(ranked(table.limit(0), ["query_id"], ["figure"], page=Page(3)), Page(3)) is None


def test_misuse(spark):
    table = spark.createDataFrame([("q", 1)], "query_id string, figure long")
    with pytest.raises(ValueError, match="limit or"):
        ranked(table, ["query_id"], ["figure"], limit=1, page=Page(1))
    with pytest.raises(ValueError, match="another list"):
        ranked(table, ["query_id"], ["figure"], page=Page(1, '[1,2,"q"]'))
    with pytest.raises(ValueError, match="at least one"):
        Page(0)


def test_cursor_reaches_the_scan(spark, tmp_path):
    """The figure 12.3 s is made of 12,250 to 12,349 ms; what lies above is skipped by the scan."""
    path = str(tmp_path / "history")
    start = datetime(2024, 1, 10)
    rows = [(f"q{i}", "text", start, "WH_1", "Small", "SUCCESS", i * 10) for i in range(3000)]
    columns = (
        "query_id string, query_text string, start_time timestamp_ntz, warehouse_name string, warehouse_size string, "
        "execution_status string, total_elapsed_time long"
    )
    spark.createDataFrame(rows, columns).write.parquet(path)
    history = spark.read.parquet(path)
    listed = reports.elapsed_top(history, PERIOD, page=Page(50, '[123,"q1230"]'))
    physical = plan(listed)
    assert re.search(r"PushedFilters: \[[^\]]*LessThanOrEqual\(total_elapsed_time,12349\)", physical)
    assert "TakeOrderedAndProject" in physical and "rangepartitioning" not in physical
    expected = sorted(((-((ms + 50) // 100), q) for q, *_, ms in rows), key=lambda x: x)
    behind = [q for figure, q in expected if (figure, q) > (-123, "q1230")][:50]
    assert [r.query_id for r in listed.collect()] == behind
