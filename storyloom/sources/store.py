"""Append-only parquet tables whose batches can be replayed."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Store:
    """Tables under one folder, each a set of ``batch_id=`` directories.

    A batch overwrites only its own directory and reads only earlier batches,
    so running one again replaces its output instead of adding to it.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def write(self, table: str, batch_id: int, rows: DataFrame) -> None:
        rows.drop("batch_id").write.mode("overwrite").parquet(
            f"{self.root}/{table}/batch_id={batch_id}"
        )

    def read(
        self,
        table: str,
        schema: T.StructType,
        before: int | None = None,
        only: int | Iterable[int] | None = None,
    ) -> DataFrame:
        """All rows of a table, those of earlier batches, or those of some batches."""
        return self._rows(table, schema, before, only).drop("batch_id")

    def _rows(self, table, schema, before=None, only=None) -> DataFrame:
        full = T.StructType([*schema.fields, T.StructField("batch_id", T.LongType())])
        path = f"{self.root}/{table}"
        if not self._exists(path):
            return self.spark.createDataFrame([], full)
        rows = self.spark.read.schema(full).option("basePath", path).parquet(path)
        if before is not None:
            rows = rows.filter(F.col("batch_id") < before)
        if only is not None:
            rows = rows.filter(F.col("batch_id").isin([only] if isinstance(only, int) else list(only)))
        return rows

    def finished(self, table: str) -> set[int]:
        """Batches whose rows of this table were written to the end."""
        path = f"{self.root}/{table}"
        if not self._exists(path):
            return set()
        marks = self._files(path).globStatus(self._path(f"{path}/batch_id=*/_SUCCESS"))
        names = [mark.getPath().getParent().getName() for mark in marks]
        return {int(n.removeprefix("batch_id=")) for n in names}

    def latest(
        self, table: str, schema: T.StructType, key: str, before: int | None = None, counted: str | None = None
    ) -> DataFrame:
        """The newest row per key: the last snapshot before a batch and the rows written since.

        The work is that of a snapshot and at most as many batches as lie between two.
        With ``counted``, batches that did not finish that table do not count.
        """
        snapshots = [n for n in self.finished(f"{table}_snapshot") if before is None or n < before]
        rows = self._rows(table, schema, before, only=self.finished(counted) if counted else None)
        if snapshots:
            rows = rows.filter(F.col("batch_id") > max(snapshots)).unionByName(
                self._rows(f"{table}_snapshot", schema, only=max(snapshots))
            )
        newest = rows.groupBy(key).agg(F.max("batch_id").alias("batch_id"))
        return rows.join(newest, [key, "batch_id"]).select(*schema.fieldNames())

    def snapshot(self, table: str, schema: T.StructType, key: str, batch_id: int, counted: str | None = None) -> None:
        """Write the newest row per key up to a batch as one table."""
        self.write(f"{table}_snapshot", batch_id, self.latest(table, schema, key, batch_id + 1, counted))

    def _path(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _files(self, path: str):
        return self._path(path).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _exists(self, path: str) -> bool:
        return self._files(path).exists(self._path(path))
