"""Versions of a graph in a shared folder: all tables of a version first, the pointer to it last."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _pointers(spark: SparkSession, root: str) -> DataFrame:
    try:
        return spark.read.schema("version long").parquet(f"{root}/published")
    except Exception as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return spark.createDataFrame([], "version long")


def latest(spark: SparkSession, root: str) -> int | None:
    return _pointers(spark, root).agg(F.max("version")).first()[0]


def publish(tables: dict[str, DataFrame], root: str) -> int:
    """Writes ``tables`` as the next version and publishes it; a version that fails halfway is never seen and is overwritten by the next attempt."""
    spark = next(iter(tables.values())).sparkSession
    version = (latest(spark, root) or 0) + 1
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{root}/version={version}/{name}")
    spark.range(1).select(F.lit(version).cast("long").alias("version")).coalesce(1).write.mode("append").parquet(f"{root}/published")
    return version


def load(spark: SparkSession, root: str, names: list[str], version: int | None = None) -> dict[str, DataFrame]:
    """The tables of a version, the latest by default."""
    version = latest(spark, root) if version is None else version
    if version is None:
        raise ValueError(f"nothing is published under {root}")
    return {n: spark.read.parquet(f"{root}/version={version}/{n}") for n in names}
