"""Series, statements, accounts, documents, readers."""

from __future__ import annotations

import json
from decimal import Decimal

import pytest
from helpers import GB, history

from usagelens.functions.fixed_point import percent_text
from usagelens.functions.period import Period
from usagelens.operators.accounts import accounts_view, load_accounts
from usagelens.operators.extract import document_extract, document_predict
from usagelens.operators.series import chart_series, has_chart, histogram_series, statement_result
from usagelens.plans import reports
from usagelens.plans.summary import warehouse_summary
from usagelens import session
from usagelens.session import settle
from usagelens.sources import schemas
from usagelens.sources.tables import read_document_folder, read_usage_tables
from usagelens.sources.testdata import usage_tables

PERIOD = Period.of("2024-01-01 00:00:00", "2024-01-31 23:59:00")


def test_series_is_in_bucket_order_and_keeps_the_count(spark):
    rows = [{"bytes_scanned": 1}] * 3 + [{"bytes_scanned": 2 << 30}]
    histogram = reports.scan_size_histogram(history(spark, rows), PERIOD)
    result = histogram_series(histogram, "scan_size_range").collect()
    assert [(r["bucket_ordinal"], r["sql_count"], r["percent_value"]) for r in result] == [
        (1, 3, 75.0), (2, 1, 25.0), (3, 0, 0.0), (4, 0, 0.0)
    ]


def test_statement_parameters_are_bound(spark):
    rows = history(spark, [{"warehouse_name": "it's"}, {}])
    before = {t.name for t in spark.catalog.listTables()}
    statement = "SELECT count(*) AS n FROM {h} WHERE warehouse_name = :name"
    result = statement_result(spark, statement, {"name": "it's"}, h=rows)
    assert [r["n"] for r in result.collect()] == [1]
    assert {t.name for t in spark.catalog.listTables()} == before


def test_chart_series(spark):
    result = spark.createDataFrame([("a", 1, 2.5), ("b", 3, None)], "k string, `n x` int, v double")
    assert has_chart(result.collect())
    assert not has_chart(result.limit(1).collect())
    assert sorted(map(tuple, chart_series(result).collect()), key=str) == [
        ("a", "n x", 1.0), ("a", "v", 2.5), ("b", "n x", 3.0), ("b", "v", None)
    ]
    assert sorted(map(tuple, chart_series(result.select("v")).collect()), key=str) == [("v", 2.5), ("v", None)]
    mixed = spark.createDataFrame([(1, "text", 5)], "k int, t string, `n``m` int")
    assert chart_series(mixed).columns == ["k", "t", "series", "value"]
    assert [tuple(r) for r in chart_series(mixed).collect()] == [(1, "text", "n`m", 5.0)]
    for silent in (result.select("k"), mixed.select("k", "t")):
        with pytest.raises(ValueError):
            chart_series(silent)


ROWS = [(1, "Ada", "North"), (2, "Ben", "North"), (3, "Cleo", "East"), (4, "Dan", "South")]


def test_accounts_load_replaces_the_rows(spark, tmp_path):
    path = str(tmp_path / "accounts")
    others = spark.createDataFrame([(9, "Old", "West")], schemas.ACCOUNTS)
    load_accounts(others, path)
    for _ in range(2):
        accounts = load_accounts(spark.createDataFrame(ROWS, schemas.ACCOUNTS), path)
    assert sorted(map(tuple, accounts.collect())) == ROWS
    with pytest.raises(ValueError):
        load_accounts(accounts.where("id > 1"), path)
    assert accounts.count() == 4
    view = accounts_view(accounts, "accounts_view")
    assert view.columns == ["id", "name", "value"]
    assert spark.sql("SELECT count(*) FROM accounts_view").first()[0] == 4
    spark.catalog.dropTempView("accounts_view")
    before = len(spark.catalog.listTables())
    assert accounts_view(accounts).count() == 4 and len(spark.catalog.listTables()) == before


def test_document_extract_searches_whole_texts(spark):
    html = "x" * 100_000 + '<html lang="de"><title>A "b" & c</title>'
    docs = spark.createDataFrame([("u1", html), ("u2", "none")], "url string, html string")
    result = {r["file_name"]: json.loads(r["json_content"]) for r in document_extract(docs, "url", "html").collect()}
    assert result == {"u1": {"title": 'A "b" & c', "lang": "de"}, "u2": {"title": "", "lang": ""}}


def test_document_folder_and_model(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_bytes(b"<title>one</title>")
    (tmp_path / "sub" / "b.txt").write_bytes(b"four")
    files = read_document_folder(spark, str(tmp_path))
    extracted = document_extract(files, "relative_path", "content", {"title": "<title>([^<]*)</title>"})
    assert sorted(map(tuple, extracted.collect())) == [
        ("a.txt", '{"title":"one"}'), ("sub/b.txt", '{"title":""}')
    ]

    def load_model(version):
        return lambda contents: contents.map(lambda c: json.dumps({"version": version, "bytes": len(c)}))

    predicted = document_predict(files, "relative_path", "content", load_model, version=1)
    assert sorted(map(tuple, predicted.collect())) == [
        ("a.txt", '{"version": 1, "bytes": 18}'), ("sub/b.txt", '{"version": 1, "bytes": 4}')
    ]


def test_stored_tables_give_the_same_reports(spark, tmp_path):
    tables = usage_tables(spark, "/root/testdata/sf0.001")
    for name in ("query_history", "warehouse_metering_history", "query_acceleration_eligible", "warehouses"):
        getattr(tables, name).write.parquet(str(tmp_path / name))
    stored = read_usage_tables(spark, str(tmp_path))
    expected = sorted(map(tuple, reports.queue_histogram(tables.query_history, PERIOD).collect()))
    assert sorted(map(tuple, reports.queue_histogram(stored.query_history, PERIOD).collect())) == expected
    summaries = [
        [tuple(r) for r in warehouse_summary(t.query_history, t.warehouse_metering_history, PERIOD).collect()]
        for t in (tables, stored)
    ]
    assert summaries[0] == summaries[1] != []
    listed = reports.shared_warehouse_list(stored.warehouses)
    assert [r["name"] for r in listed.collect()] == ["WH_0", "WH_1", "WH_2", "WH_3"]
    assert spark.table("warehouse_list").count() == 4
    listed.unpersist()


def test_settled_tables(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "shared_folder", lambda spark: None)
    kept = settle(spark.range(3).toDF("n"), "numbers")
    assert kept.df.count() == 3 and kept.df.storageLevel.useMemory
    kept.drop()
    assert not kept.df.storageLevel.useMemory
    monkeypatch.setattr(session, "shared_folder", lambda spark: str(tmp_path))
    written = settle(spark.range(3).toDF("n"), "numbers")
    assert written.df.count() == 3 and str(tmp_path) in written.df.inputFiles()[0]
    written.drop()
    assert not list(tmp_path.glob("*/numbers-*"))


def test_declared_types(spark):
    tables = usage_tables(spark, "/root/testdata/sf0.001")
    kinds = lambda df: {f.name: f.dataType.simpleString() for f in df.schema}
    text = ("warehouse_name", "warehouse_size", "query_id", "query_text", "percent_sql_count", "percent_queued")
    for report, numbers in (
        (reports.local_spill_histogram, {"total_count_sql": "bigint", "sql_count": "bigint"}),
        (reports.local_spill_top, {"start_time": "timestamp_ntz"}),
        (reports.queue_top, {"start_time": "timestamp_ntz"}),
        (reports.scan_size_range, {"bytes_scanned_gb": "decimal(10,2)", "total_elapsed_time_s": "decimal(10,2)"}),
    ):
        found = kinds(report(tables.query_history, PERIOD))
        assert {name: found[name] for name in numbers} == numbers
        for name, kind in found.items():
            if name in text:
                assert kind == "string", name
            elif name not in numbers:
                assert kind in ("bigint", "string") or kind.startswith("decimal(1"), (name, kind)


def test_rows_without_a_warehouse_belong_to_no_report(spark):
    rows = history(spark, [{"warehouse_name": None, "bytes_scanned": 5}, {"bytes_scanned": 5}])
    histogram = reports.scan_size_histogram(rows, PERIOD).collect()
    assert {r["warehouse_name"] for r in histogram} == {"WH"} and {r["total_count_sql"] for r in histogram} == {1}
    assert reports.elapsed_top(rows, PERIOD).count() == 1


def test_figures_of_any_size(spark):
    top = (1 << 63) - 1
    rows = [{"bytes_spilled_to_local_storage": top, "bytes_scanned": top, "total_elapsed_time": top}]
    listed = reports.local_spill_top(history(spark, rows), PERIOD).first().asDict()
    assert Decimal(8589934592) in [v for v in listed.values() if isinstance(v, Decimal)]
    # Its column is declared with eight digits before the point; larger sizes are outside of any range.
    sizes = history(spark, [*rows, {"bytes_scanned": 10**7 * GB, "total_elapsed_time": 10**10}])
    shown = reports.scan_size_range(sizes, PERIOD, max_gb=99_999_999).collect()
    assert [r["bytes_scanned_gb"] for r in shown] == [10**7]
    part, whole = "CAST(2 AS BIGINT) * 1000000000000", "CAST(10000000000000 AS BIGINT)"
    assert spark.sql(f"SELECT {percent_text(part, whole, 2)} AS p").first()["p"] == "20.00%"
