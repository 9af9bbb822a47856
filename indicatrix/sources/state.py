"""State between batch runs: a folder of numbered versions of one table, switched by marker files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


class VersionedTable:
    """Versions of a table below one folder of a file system that all executors share.

    A version is written to a folder of its own and becomes the newest one when its marker file is created, which either happens or not. A run that breaks off while it writes
    leaves a folder without a marker: readers still see the version before, and the next commit takes a new number. Two runs that commit at once cannot
    both create the same marker; the second one fails and changes nothing.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        path = self._path("markers")
        self._fs = path.getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _numbers(self, name: str) -> list[int]:
        path = self._path(name)
        names = [s.getPath().getName() for s in self._fs.listStatus(path)] if self._fs.exists(path) else []
        return sorted(int(n) for n in names if n.isdigit())

    def versions(self) -> list[int]:
        """Complete versions, oldest first."""
        return self._numbers("markers")

    def read(self, version: int | None = None) -> DataFrame | None:
        """The newest complete version, or a given one; None before the first commit."""
        known = self.versions()
        if not known or (version is not None and version not in known):
            return None
        return self.spark.read.parquet(f"{self.folder}/data/{known[-1] if version is None else version}")

    def commit(self, table: DataFrame) -> int:
        """Write a table as the next version and switch to it."""
        number = max([0, *self._numbers("data"), *self.versions()]) + 1
        table.write.mode("errorifexists").parquet(f"{self.folder}/data/{number}")
        self._fs.mkdirs(self._path("markers"))
        self._fs.create(self._path(f"markers/{number}"), False).close()
        return number
