"""Tables whose rows are replaced all at once.

A version is a folder of its own.  It becomes the current one when a small marker file, which names the
folder, is renamed to the next number: until then readers see the version before, and a load that fails
half-way leaves nothing but a folder that no marker names.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..session import hadoop_path

_MARKER = re.compile(r"current-(\d{12})-([0-9a-f]{32})").fullmatch


class ConcurrentReplace(RuntimeError):
    """Another load has replaced the table in the meantime."""


class VersionedTable:
    """The table under ``path``; its versions are numbered from 1."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType) -> None:
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def _found(self) -> dict[int, str]:
        """Folder names by version."""
        root, files = hadoop_path(self.spark, self.path)
        if not files.exists(root):
            return {}
        names = [_MARKER(status.getPath().getName()) for status in files.listStatus(root)]
        # Should two loads claim a number at once, the first name has it for all who look.
        return {int(m[1]): m[2] for m in sorted((m for m in names if m), key=lambda m: m[0], reverse=True)}

    def version(self) -> int:
        """Number of the current version, 0 if there is none yet."""
        return max(self._found(), default=0)

    def read(self, version: int | None = None) -> DataFrame:
        """Rows of the current version, or of another that is still there; an empty table before the first."""
        found = self._found()
        if version is None and not found:
            return self.spark.createDataFrame([], self.schema)
        wanted = max(found) if version is None else version
        if wanted not in found:
            raise ValueError(f"{self.path} has no version {wanted}")
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/{found[wanted]}")

    def replace(self, rows: DataFrame) -> DataFrame:
        """Make ``rows`` the current version; they may be read from the table itself.

        Of two loads that began at the same version one succeeds; the other one raises ``ConcurrentReplace``.
        """
        before, name = self.version(), uuid.uuid4().hex
        columns = [rows[f.name].cast(f.dataType).alias(f.name) for f in self.schema]
        rows.select(*columns).write.parquet(f"{self.path}/{name}")
        # One empty file, renamed into place: its name says which version is which folder.
        draft, files = hadoop_path(self.spark, f"{self.path}/draft-{name}")
        files.create(draft).close()
        if self.version() != before:
            files.delete(draft, False)
            raise ConcurrentReplace(f"{self.path} has got version {self.version()} after {before}")
        marker = hadoop_path(self.spark, f"{self.path}/current-{before + 1:012d}-{name}")[0]
        files.rename(draft, marker)
        if self._found().get(before + 1, name) != name:
            files.delete(marker, False)
            raise ConcurrentReplace(f"{self.path} has got version {before + 1} from another load")
        return self.read(before + 1)

    def vacuum(self, keep: int = 1) -> None:
        """Delete all but the last ``keep`` versions, and what failed loads left."""
        root, files = hadoop_path(self.spark, self.path)
        kept = dict(sorted(self._found().items())[-keep:])
        for status in list(files.listStatus(root)):
            name = status.getPath().getName()
            marker = _MARKER(name)
            if (int(marker[1]) not in kept) if marker else name not in kept.values():
                files.delete(status.getPath(), True)
