"""Helpers of the graph operators."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def scratch(spark: SparkSession) -> str:
    """A new folder under that of ``spark.checkpoint.dir``; only a local session may do without that setting."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{(root or os.path.join(tempfile.gettempdir(), 'noema-checkpoints')).rstrip('/')}/noema/{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """A table written to a ``scratch`` folder, read back.

    Unlike a checkpoint, what is read back has the size of its files: in loops of joins, estimates that
    are carried along square each round and would stop the driver.
    """
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def running_sums(rows: DataFrame, order: list[str], values: dict[str, str]) -> DataFrame:
    """``rows`` with sums over all rows before each in an order that tells them apart: ``values`` maps new columns to the columns summed.

    Sums inside of the parts of a range-partitioned table, and one row of totals a part from the driver: no task sorts or sums everything.
    """
    spark = rows.sparkSession
    placed = checkpointed(rows.orderBy(*order).withColumn("part_", F.spark_partition_id()).withColumn("place_", F.monotonically_increasing_id()))
    kinds = {n: placed.agg(F.sum(c).alias(n)).schema[n].dataType.simpleString() for n, c in values.items()}
    totals = placed.groupBy("part_").agg(*(F.sum(c).alias(n) for n, c in values.items())).orderBy("part_").collect()
    base, table = dict.fromkeys(values, None), []
    for row in totals:
        table.append((row["part_"], *base.values()))
        # a sum of 0.0 stays a double: the table's columns have the kinds of the sums
        base = {n: b if row[n] is None else row[n] if b is None else b + row[n] for n, b in base.items()}
    bases = F.broadcast(spark.createDataFrame(table, ", ".join(["part_ int", *(f"base_{n} {k}" for n, k in kinds.items())])))
    before = Window.partitionBy("part_").orderBy("place_").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0)
    summed = placed.join(bases, "part_").withColumns({n: F.coalesce(F.sum(c).over(before), zero) + F.coalesce(f"base_{n}", zero) for n, c in values.items()})
    return summed.select(*rows.columns, *values)


def both_ends(edges: DataFrame) -> DataFrame:
    """Every edge seen from either end: id, other, kind. An OR-join on both ends becomes an equi-join with this."""
    return edges.select(F.col("from_id").alias("id"), F.col("to_id").alias("other"), "kind").unionAll(edges.select(F.col("to_id").alias("id"), F.col("from_id").alias("other"), "kind"))


def lookup(rows: DataFrame, table: DataFrame, keys: list[str], how: str = "left", least: int = 1000, most: int = 10_000) -> DataFrame:
    """``rows`` joined to a table with one line a key, however often a key is in ``rows``.

    A key with more than a ``most``-th of the rows (and than ``least``) is heavy: there can't be more than ``most``
    of those, so their lines are broadcast and their rows stay where they are. All others meet in a shuffle.
    ``rows`` is read several times; null keys find nothing.
    """
    limit = max(least, rows.count() // most)
    heavy = rows.groupBy(*keys).count().where(F.col("count") > limit).select(*keys)
    heavy = checkpointed(heavy.join(table, keys, "inner"))
    known = F.broadcast(heavy)
    few = rows.join(known.select(*keys), keys, "left_anti").join(table, keys, how)
    return few.unionByName(rows.join(known, keys, "inner").select(*few.columns))
