"""A table by key in hash buckets of which a merge reads and writes only those that its rows fall into.

Folders under the path: ``rows/version=N/bucket=B``, and ``manifest/version=N`` with the version in
which each bucket was last written; the manifest comes last and makes a version count. A merge that
runs again under its number starts from the manifest before it and overwrites its own files, so it
makes the same rows. Buckets should be as many as keep one of them to a task's work.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "bucket int, written long, version long"


@dataclass(frozen=True)
class Buckets:
    """A table of ``schema`` by the column ``key``, at a path that all executors see."""

    spark: SparkSession
    path: str
    schema: str
    key: str = "id"
    count: int = 64

    def number(self):
        return F.pmod(F.xxhash64(F.col(self.key)), F.lit(self.count)).cast("int").alias("bucket")

    def manifest(self, before: int | None = None) -> dict[int, int]:
        """The version in which each bucket was last written, as of the last version (``before`` a number): at most ``count`` entries."""
        try:
            rows = self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest")
        except Exception as missing:
            if "PATH_NOT_FOUND" not in str(missing):
                raise
            return {}
        rows = rows if before is None else rows.where(F.col("version") < before)
        last = rows.agg(F.max("version")).first()[0]
        return {} if last is None else {r["bucket"]: r["written"] for r in rows.where(F.col("version") == last).collect()}

    def read(self, before: int | None = None, touched: list[int] | None = None) -> DataFrame:
        """The rows of all buckets, or of those ``touched``; others aren't opened."""
        held = self.manifest(before)
        paths = [f"{self.path}/rows/version={v}/bucket={b}" for b, v in sorted(held.items()) if touched is None or b in touched]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def merge(self, version: int, batch: DataFrame, put: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
        """Version ``version``: ``put`` turns the rows of the touched buckets and the batch into what these buckets hold now, with columns of its own if it likes; all of that is returned, read back."""
        touched = sorted(r[0] for r in batch.select(self.number()).distinct().collect())  # ``count`` at most
        path = f"{self.path}/judged/version={version}"
        put(self.read(version, touched), batch).withColumn("bucket", self.number()).write.mode("overwrite").parquet(path)
        judged = self.spark.read.parquet(path)
        columns = self.spark.createDataFrame([], self.schema).columns
        judged.select(*columns, "bucket").repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/rows/version={version}")
        filled = {r[0] for r in judged.select("bucket").distinct().collect()}
        held = {b: v for b, v in self.manifest(version).items() if b not in touched} | dict.fromkeys(filled, version)
        self.spark.createDataFrame([(b, v) for b, v in sorted(held.items())], "bucket int, written long").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/version={version}")
        return judged.drop("bucket")
