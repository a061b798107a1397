"""A stored index of vectors in two levels: coarse groups, and lists inside of each; single vectors come and go without a new fit.

Folders under the index's path: ``coarse`` and ``lists`` (centres), ``probes``
(how many to ask), and by generation ``vectors`` (by bucket of the list) and
``changed`` (the ids that a generation replaces), which is written last and
makes the generation count. The number of groups is bounded and their centres
travel with the tasks; lists are fitted inside of each group by one task and
stay a table, so that their number follows the rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from noema.operators import vectors as V
from noema.operators.common import checkpointed

#: Groups at most, vectors from which they (and each group's lists) are learned, and rows of a list that are aimed at.
GROUPS, SAMPLE, SIZE = 1000, 20_000, 512
VECTOR = "id {0}, coarse int, list long, vector array<double>, bucket int, gen long"
CENTRE = "list long, coarse int, centre array<double>"


def _stack(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return V._units(np.stack(column.to_numpy(zero_copy_only=False)) if isinstance(column, pa.Array) else np.stack(column.to_numpy()))


def _lists(rows: np.ndarray) -> pa.Array:
    return pa.array(list(rows), pa.list_(pa.float64()))


@dataclass(frozen=True)
class VectorIndex:
    """An index at a path that all executors see; ``kind`` is the type of its ids."""

    spark: SparkSession
    path: str
    kind: str = "long"
    buckets: int = 64

    def _table(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def _rows(self, vectors: DataFrame) -> DataFrame:
        return vectors.where("id is not null and vector is not null").select("id", F.col("vector").cast("array<double>").alias("vector"))

    def build(self, vectors: DataFrame, share: float = 0.97, k: int = 10, queries: int = 256) -> VectorIndex:
        """Fits groups and lists, takes ``vectors`` (id, vector) in, and finds out how many groups and lists hold ``share`` of the ``k`` true neighbours of ``queries`` of them. Samples are the vectors of smallest hash; everything else covers all rows."""
        rows = checkpointed(self._rows(vectors))
        n = rows.count()
        order = [F.xxhash64("vector"), F.col("vector")]
        some = rows.select("vector").distinct().orderBy(*order).limit(SAMPLE).toArrow().column("vector")
        groups = min(GROUPS, max(1, math.isqrt(n // SIZE + 1)), max(1, len(some) // 8))
        means = V.spherical(_stack(some), groups) if len(some) else np.zeros((1, 1))
        centres = self.spark.createDataFrame(pa.table({"coarse": pa.array(np.arange(len(means)), pa.int32()), "centre": _lists(means)}))
        centres.write.mode("overwrite").parquet(f"{self.path}/coarse")
        placed = checkpointed(self._grouped(rows, 1))
        sizes = placed.groupBy("coarse").agg(F.count("*").alias("n"))
        first = placed.withColumn("place", F.row_number().over(W.partitionBy("coarse").orderBy(*order))).where(F.col("place") <= SAMPLE).join(sizes, "coarse")

        def fit(key: tuple, table: pa.Table) -> pa.Table:
            units, group = _stack(table.column("vector")), key[0].as_py()
            found = V.spherical(units, max(1, min(len(units) // 8, -(-table.column("n")[0].as_py() // SIZE))))
            # a list's number names its group as well
            return pa.table({"list": pa.array(group * (1 << 32) + np.arange(len(found)), pa.int64()), "coarse": pa.array([group] * len(found), pa.int32()), "centre": _lists(found)})

        first.select("coarse", "vector", "n").groupBy("coarse").applyInArrow(fit, CENTRE).write.mode("overwrite").parquet(f"{self.path}/lists")
        self._write(0, self._listed(placed, 1, keep=True), rows.select("id").limit(0))
        asked = checkpointed(rows.orderBy(F.xxhash64("vector"), "id").limit(queries))
        self._calibrate(asked, V.nearest(asked, rows, k, others=True), share)
        return self

    def _calibrate(self, asked: DataFrame, true: DataFrame, share: float) -> None:
        homes = self.live().select(F.col("id").alias("other"), "coarse", "list")
        at = true.select("id", "other").join(homes, "other")
        groups = self._grouped(asked, None).join(at, ["id", "coarse"]).agg(F.percentile("place", F.lit(share)).alias("p")).first()[0]
        p1 = max(1, math.ceil(groups or 1))
        all_lists = self._asked(self._grouped(asked, p1), None)
        lists = all_lists.join(at.select("id", "list"), ["id", "list"]).agg(F.percentile("place", F.lit(share)).alias("p")).first()[0]
        self.spark.createDataFrame([(p1, max(1, math.ceil(lists or 1)))], "p1 int, p2 int").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/probes")

    def probes(self) -> tuple[int, int]:
        return tuple(self._table("probes", "p1 int, p2 int").first())

    def _grouped(self, rows: DataFrame, most: int | None) -> DataFrame:
        """Rows with their nearest groups, ``most`` of them: id, vector, coarse, place (from 1)."""
        table = self._table("coarse", "coarse int, centre array<double>").orderBy("coarse").toArrow()  # GROUPS rows at most
        numbers, means = table.column("coarse").to_numpy(), _stack(table.column("centre"))
        count = min(most or len(means), len(means))

        def run(batches):
            for batch in batches:
                if batch.num_rows:
                    near = np.argsort(-(_stack(batch.column(1)) @ means.T), axis=1, kind="stable")[:, :count]
                    take = pa.array(np.repeat(np.arange(batch.num_rows), count))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(numbers[near.ravel()], pa.int32()), pa.array(np.tile(np.arange(1, count + 1), batch.num_rows), pa.int32())], ["id", "vector", "coarse", "place"])

        return rows.select("id", "vector").mapInArrow(run, f"id {self.kind}, vector array<double>, coarse int, place int")

    def _listed(self, grouped: DataFrame, most: int | None, keep: bool = False) -> DataFrame:
        """Rows (id, vector, coarse) with the nearest lists of their group, ``most`` of them: id, vector (null unless ``keep``), coarse, list, similarity. A group's rows meet its centres in blocks."""
        grouped = checkpointed(grouped.select("id", "vector", "coarse"))
        blocks = grouped.groupBy("coarse").agg(F.ceil(F.count("*") / V.BLOCK).cast("int").alias("blocks"))  # a row a group
        left = grouped.join(F.broadcast(blocks), "coarse").select("id", "vector", "coarse", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"))
        centres = self._table("lists", CENTRE).join(F.broadcast(blocks), "coarse").select("coarse", "list", "centre", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))

        def near(x: pa.Table, y: pa.Table) -> pa.Table:
            if not x.num_rows or not y.num_rows:
                return pa.table({"id": x.column("id").slice(0, 0), "vector": x.column("vector").slice(0, 0), "coarse": pa.array([], pa.int32()), "list": pa.array([], pa.int64()), "similarity": pa.array([], pa.float64())})
            y = y.sort_by("list")
            sims, names = _stack(x.column("vector")) @ _stack(y.column("centre")).T, y.column("list").to_numpy()
            count = min(most or len(names), len(names))
            order = np.argsort(-sims, axis=1, kind="stable")[:, :count]
            take = pa.array(np.repeat(np.arange(x.num_rows), count))
            return pa.table({"id": x.column("id").take(take), "vector": x.column("vector").take(take) if keep else pa.nulls(len(take), pa.list_(pa.float64())), "coarse": x.column("coarse").take(take), "list": pa.array(names[order.ravel()], pa.int64()), "similarity": pa.array(np.take_along_axis(sims, order, axis=1).ravel())})

        return left.groupBy("coarse", "block").cogroup(centres.groupBy("coarse", "block")).applyInArrow(near, f"id {self.kind}, vector array<double>, coarse int, list long, similarity double")

    def _asked(self, grouped: DataFrame, most: int | None) -> DataFrame:
        """The nearest lists of queries over all their groups: id, list, place. No vectors: queries ask many lists."""
        order = W.partitionBy("id").orderBy(F.desc("similarity"), "list")
        found = self._listed(grouped, most).select("id", "list", "similarity").withColumn("place", F.row_number().over(order))
        return (found if most is None else found.where(F.col("place") <= most)).select("id", "list", "place")

    def _bucket(self, column: Column) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(self.buckets)).cast("int")

    def _write(self, gen: int, listed: DataFrame, changed: DataFrame) -> None:
        rows = listed.select("id", "coarse", "list", "vector", self._bucket(F.col("list")).alias("bucket"))
        rows.repartition("bucket").sortWithinPartitions("bucket", "list").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/vectors/gen={gen}")
        mark = self.spark.range(1).select(F.lit(None).cast(self.kind).alias("id"))
        changed.select("id").distinct().unionAll(mark).write.mode("overwrite").parquet(f"{self.path}/changed/gen={gen}")

    def live(self, read: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
        """Vectors that hold: id, coarse, list, vector; ``read`` may choose rows by their bucket and list before anything else."""
        changed = self._table("changed", f"id {self.kind}, gen long")
        done = changed.agg(F.max("gen")).first()[0]
        last = changed.where("id is not null").groupBy("id").agg(F.max("gen").alias("last"))
        rows = read(self._table("vectors", VECTOR.format(self.kind)).where(F.col("gen") <= done))
        return rows.join(last, "id", "left").where("last is null or gen >= last").select("id", "coarse", "list", "vector")

    def update(self, vectors: DataFrame, removed: DataFrame | None = None) -> int:
        """Takes new and changed vectors (id, vector) in and ids in ``removed`` out; a null vector goes out as well. Nothing is fitted anew, and work follows the rows given."""
        gen = self._table("changed", f"id {self.kind}, gen long").agg(F.max("gen")).first()[0] + 1
        touched = vectors.select("id").where("id is not null")
        touched = touched if removed is None else touched.unionAll(removed.select("id"))
        self._write(gen, self._listed(self._grouped(self._rows(vectors), 1), 1, keep=True), touched)
        return gen

    def search(self, queries: DataFrame, k: int, least: float | None = None, allowed: DataFrame | None = None, others: bool = False) -> DataFrame:
        """The nearest vectors of every query (id, vector) in the lists that it asks: id, other, similarity, rank. Only ids in ``allowed`` count, where it is given; with ``others`` a query's own id doesn't.

        Similarities are exact; a neighbour in a list that isn't asked is missed. Up to 64 queries
        read their lists' buckets alone. A list of very many rows is compared in blocks.
        """
        p1, p2 = self.probes()
        rows = checkpointed(self._rows(queries).select("id", "vector"))
        lists = checkpointed(self._asked(self._grouped(rows, p1), p2).groupBy("id").agg(F.collect_set("list").alias("lists")))
        asked = rows.join(lists, "id")
        few = lists.select(F.explode("lists").alias("list")).select("list", self._bucket(F.col("list")).alias("b")).distinct().limit(64 * p2 + 1).collect() if queries.limit(65).count() <= 64 else []
        targets = self.live((lambda df: df.where(F.col("bucket").isin(*{r["b"] for r in few}) & F.col("list").isin(*{r["list"] for r in few}))) if few else (lambda df: df))
        if allowed is not None:
            targets = targets.join(allowed.select("id").distinct(), "id", "left_semi")
        return V.compared_in_lists(asked, checkpointed(targets.select("id", "list", "vector")), k, least, others)

    def neighbours(self, k: int, least: float | None = None) -> DataFrame:
        """Nearest others of every vector of the index."""
        return self.search(self.live(), k, least, others=True)
