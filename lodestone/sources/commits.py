"""Several tables that change as one.

A commit writes every table anew under its own name and then one list of them;
readers follow the last whole list, so a commit that fails half-way changes
nothing. One writer at a time.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from .storage import document, write_document

_LISTED = "name string, path string, ddl string"


class Tables:
    """Tables in a folder of shared storage, by name."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _listed(self) -> dict:
        return {r.name: r for r in document(self.spark, f"{self.folder}/list", _LISTED).collect()}

    def names(self) -> list[str]:
        return sorted(self._listed())

    def read(self, name: str) -> DataFrame:
        row = self._listed()[name]
        return self.spark.read.schema(row.ddl).parquet(row.path)

    def commit(self, **tables: DataFrame) -> None:
        """Put new versions of these tables in force, all or none; the others stay. Versions before the last are deleted."""
        now, fresh = self._listed(), {}
        for name, rows in tables.items():
            path = f"{self.folder}/{name}-{uuid.uuid4().hex}"
            rows.write.parquet(path)
            fresh[name] = (name, path, ", ".join(f"`{c}` {t}" for c, t in rows.dtypes))
        listed = [tuple(r) for n, r in now.items() if n not in fresh] + list(fresh.values())
        write_document(self.spark.createDataFrame(listed, _LISTED).coalesce(1), f"{self.folder}/list")
        self._sweep({r.path for r in now.values()} | {path for _, path, _ in listed})

    def _sweep(self, alive: set[str]) -> None:
        """Delete what neither the last list nor the one before names; what a failed commit left goes too."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        files = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        for status in files.listStatus(at):
            name = status.getPath().getName()
            if name != "list" and f"{self.folder}/{name}" not in alive:
                files.delete(status.getPath(), True)
