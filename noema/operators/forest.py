"""Maximum spanning forests of weighted pairs, and the components at every threshold that they hold."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noema.operators import vectors as V
from noema.operators.common import checkpointed


def kruskal(low: Sequence, high: Sequence, order: np.ndarray) -> np.ndarray:
    """Places of the edges that a forest takes, going through them in ``order``."""
    number: dict = {}
    ends = [[number.setdefault(x, len(number)) for x in side] for side in (low, high)]
    root = list(range(len(number)))

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    kept = []
    for k in order.tolist():
        a, b = top(ends[0][k]), top(ends[1][k])
        if a != b:
            root[max(a, b)] = min(a, b)
            kept.append(k)
    return np.array(kept, np.int64)


def spanning(pairs: DataFrame, small: int = V.SMALL) -> DataFrame:
    """The maximum spanning forest of pairs (id, other, similarity): low, high, similarity. Of equal similarities the smaller ends are taken.

    Boruvka rounds: every tree takes its best edge outwards, joined trees become one, and of the edges
    between two trees the best is left. A round at least halves the trees; what is left of at most
    ``small`` edges is finished by one task. Null ends and loops are no edges.
    """
    named = pairs.where("id is not null and other is not null and id <> other and similarity is not null").groupBy(F.least("id", "other").alias("low"), F.greatest("id", "other").alias("high")).agg(F.max("similarity").alias("similarity"))
    better = F.struct((-F.col("similarity")).alias("s"), "low", "high")  # the least is the best
    edges = checkpointed(named.select("low", "high", "similarity", F.col("low").alias("x"), F.col("high").alias("y")))
    kept = []
    while (left := edges.limit(small + 1).count()) > small:
        ends = edges.select(F.col("x").alias("tree"), better.alias("e")).unionAll(edges.select("y", better.alias("e")))
        best = checkpointed(ends.groupBy("tree").agg(F.min("e").alias("e")).select("e.low", "e.high").distinct().join(edges, ["low", "high"]))
        kept.append(best.select("low", "high", "similarity"))
        roots = V.components(best, "x", "y", small=small)
        for end in ("x", "y"):
            edges = edges.join(roots.select(F.col("node").alias(end), F.col("component").alias(f"{end}_root")), end, "left").withColumn(end, F.coalesce(f"{end}_root", end)).drop(f"{end}_root")
        ahead = edges.where("x <> y").groupBy(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).agg(F.min(better).alias("e"))
        edges = checkpointed(ahead.select("e.low", "e.high", (-F.col("e.s")).alias("similarity"), "x", "y"))

    def finish(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("similarity", "descending"), ("low", "ascending"), ("high", "ascending")])
        at = kruskal(table.column("x").to_pylist(), table.column("y").to_pylist(), np.arange(table.num_rows))
        return table.take(pa.array(at)).select(["low", "high", "similarity"])

    if left:
        kind = edges.schema["low"].dataType.simpleString()
        kept.append(edges.withColumn("all", F.lit(True)).groupBy("all").applyInArrow(finish, f"low {kind}, high {kind}, similarity double"))
    out = kept[0] if kept else edges.select("low", "high", "similarity")
    for more in kept[1:]:
        out = out.unionByName(more)
    return checkpointed(out)


def cuts(forest: DataFrame, thresholds: Sequence[float], small: int = V.SMALL) -> DataFrame:
    """Components of a forest (low, high, similarity) at every threshold in one run of components: level (place of the threshold, from 1), node, component. A node without an edge at a level is alone and has no row."""
    levels = F.explode(F.filter(F.array(*(F.struct(F.lit(k + 1).alias("level"), F.lit(float(t)).alias("least")) for k, t in enumerate(thresholds))), lambda x: F.col("similarity") >= x["least"]))
    rows = forest.select("low", "high", "similarity", levels.alias("at"))
    keyed = rows.select(F.struct(F.col("at.level").alias("level"), F.col("low").alias("node")).alias("id"), F.struct(F.col("at.level").alias("level"), F.col("high").alias("node")).alias("other"))
    return V.components(keyed, small=small).select("node.level", "node.node", F.col("component.node").alias("component"))
