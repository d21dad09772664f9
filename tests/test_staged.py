"""Replacing tables at once, and reading staged files once."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from usagelens.sources.staged import StagedFolder
from usagelens.sources.versioned import ConcurrentReplace, VersionedTable

SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.StringType())])


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_versions(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"), SCHEMA)
    assert table.version() == 0 and rows(table.read()) == []
    first = table.replace(spark.createDataFrame([(1, "a")], SCHEMA))
    table.replace(table.read().union(spark.createDataFrame([(2, "b")], SCHEMA)))  # rows of the table itself
    assert rows(table.read()) == [(1, "a"), (2, "b")] and rows(first) == [(1, "a")] == rows(table.read(1))
    table.vacuum()
    assert table.version() == 2 and rows(table.read()) == [(1, "a"), (2, "b")]
    with pytest.raises(ValueError):
        table.read(1)


def test_a_failed_load_leaves_the_rows_before(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"), SCHEMA)
    table.replace(spark.createDataFrame([(1, "a")], SCHEMA))
    failing = spark.range(100).select("id", F.expr("CASE WHEN id < 99 THEN 'x' ELSE raise_error('half-way') END").alias("name"))
    with pytest.raises(Exception, match="half-way"):
        table.replace(failing)
    assert table.version() == 1 and rows(table.read()) == [(1, "a")]
    table.replace(spark.createDataFrame([(2, "b")], SCHEMA))
    table.vacuum()
    assert rows(table.read()) == [(2, "b")] and len(list((tmp_path / "t").glob("[!.]*"))) == 2


def test_of_two_loads_one_succeeds(spark, tmp_path, monkeypatch):
    one, two = (VersionedTable(spark, str(tmp_path / "t"), SCHEMA) for _ in range(2))
    loaded = spark.createDataFrame([(1, "a")], SCHEMA)
    before = one.version

    def late():
        monkeypatch.setattr(one, "version", before)
        two.replace(spark.createDataFrame([(2, "b")], SCHEMA))
        return 0

    monkeypatch.setattr(one, "version", late)
    with pytest.raises(ConcurrentReplace):
        one.replace(loaded)
    assert rows(two.read()) == [(2, "b")] and two.version() == 1


def changed(folder):
    changes = folder.changes()
    files = sorted((r["relative_path"], r["status"], bytes(r["content"]).decode()) for r in changes.files.collect())
    return changes, files, sorted(r[0] for r in changes.deleted.collect())


def test_new_changed_and_deleted_files(spark, tmp_path):
    root = tmp_path / "stage"
    (root / "sub").mkdir(parents=True)
    (root / "a.txt").write_text("one")
    (root / "sub" / "b.txt").write_text("two")
    (root / "skip.bin").write_text("other")
    folder = StagedFolder(spark, str(root), str(tmp_path / "manifest"), "*.txt")
    changes, files, deleted = changed(folder)
    assert files == [("a.txt", "new", "one"), ("sub/b.txt", "new", "two")] and deleted == []
    # Not committed: the same files again.
    changes, files, _ = changed(folder)
    assert len(files) == 2
    changes.commit()
    assert changed(folder)[1:] == ([], [])
    (root / "a.txt").write_text("one more")
    (root / "c.txt").write_text("three")
    (root / "sub" / "b.txt").unlink()
    changes, files, deleted = changed(folder)
    assert files == [("a.txt", "changed", "one more"), ("c.txt", "new", "three")] and deleted == ["sub/b.txt"]
    assert len(changes.files.inputFiles()) == 2  # known files are not read
    changes.commit()
    assert changed(folder)[1:] == ([], [])
