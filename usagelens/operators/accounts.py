"""The accounts table: idempotent load and view."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from ..session import hadoop_path
from ..sources import schemas
from ..sources.versioned import VersionedTable


def load_accounts(accounts: DataFrame, path: str) -> DataFrame:
    """Create the table at ``path`` if missing, replace its rows, and return it.

    Running the load again leaves the same rows.  They are replaced at once: readers see the rows before
    until all new ones are there, also if a load fails half-way.  The version before is kept for those
    who still read it.  Rows that are read from ``path`` itself are rejected.
    """
    spark = accounts.sparkSession
    target, files = hadoop_path(spark, path)
    folder = files.makeQualified(target).toUri().getPath().rstrip("/")
    sources = [spark._jvm.org.apache.hadoop.fs.Path(f).toUri().getPath() for f in accounts.inputFiles()]
    if any(source.startswith(f"{folder}/") for source in sources):
        raise ValueError(f"the rows come from {path}, which they are to replace")
    table = VersionedTable(spark, path, schemas.ACCOUNTS)
    loaded = table.replace(accounts)
    table.vacuum(keep=2)
    return loaded


def accounts_view(accounts: DataFrame, name: str | None = None) -> DataFrame:
    """The projection of the accounts table as a view; registered under ``name`` if one is given."""
    projected = accounts.select("id", "name", "value")
    view = name or f"accounts_{uuid.uuid4().hex}"
    projected.createOrReplaceTempView(view)
    result = accounts.sparkSession.table(view)
    if name is None:
        accounts.sparkSession.catalog.dropTempView(view)
    return result
