"""Neighbours and components kept up to date as vectors come, change and go: work follows the changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from noema.operators import vectors as V
from noema.operators.common import checkpointed


def updated_neighbours(pairs: DataFrame, before: DataFrame, after: DataFrame, k: int, least: float | None = None) -> tuple[DataFrame, DataFrame]:
    """``vectors.neighbours`` of ``after`` from that of ``before`` (id, vector): pairs, and the ids (id, gone) of vectors that are new, other or gone.

    Who has lost a neighbour, and what is new or other, looks for neighbours among all; everybody
    else only hears of what is new. So changed rows are compared with all, not all with all.
    """
    old, new = (df.where("id is not null and vector is not null").select("id", F.col("vector").cast("array<double>").alias(n)) for df, n in ((before, "was"), (after, "now")))
    changed = checkpointed(old.join(new, "id", "full_outer").where("not (was <=> now)").select("id", F.col("now").isNull().alias("gone")))
    rows = new.withColumnRenamed("now", "vector")
    left = pairs.join(changed.select("id"), "id", "left_anti").select("id", "other", "similarity", "rank")
    lost = left.join(changed.select(F.col("id").alias("other")), "other", "left_semi").select("id").distinct()
    asking = checkpointed(lost.unionAll(changed.where("not gone").select("id")).distinct())
    fresh = V.nearest(rows.join(asking, "id", "left_semi"), rows, k, least, others=True)
    kept = checkpointed(left.join(asking, "id", "left_anti").select("id", "other", "similarity"))
    told = V.nearest(rows.join(asking, "id", "left_anti"), rows.join(changed.where("not gone"), "id", "left_semi"), k, least, others=True)
    both = kept.unionByName(told.select("id", "other", "similarity"))
    ranked = both.withColumn("rank", F.row_number().over(W.partitionBy("id").orderBy(F.desc("similarity"), "other"))).where(F.col("rank") <= k)
    return checkpointed(fresh.select("id", "other", "similarity", "rank").unionByName(ranked)), changed


def updated_components(labels: DataFrame, before: DataFrame, after: DataFrame, a: str = "id", b: str = "other", small: int = V.SMALL) -> DataFrame:
    """``vectors.components`` of the pairs ``after``, given those of ``before`` (``labels``: node, component).

    A component is redone if it has an end of a pair that came or went; the others stay. Pairs
    that came may join components, pairs that went may split one.
    """
    links = [df.select(F.least(a, b).alias("x"), F.greatest(a, b).alias("y")).where("x is not null and y is not null").distinct() for df in (before, after)]
    came, went = links[1].join(links[0], ["x", "y"], "left_anti"), links[0].join(links[1], ["x", "y"], "left_anti")
    moved = came.unionAll(went)
    ends = checkpointed(moved.select(F.col("x").alias("node")).unionAll(moved.select("y")).distinct())
    stale = checkpointed(labels.join(ends, "node").select("component").distinct())
    redone = labels.join(stale, "component", "left_semi").select("node").unionAll(ends.select("node")).distinct()
    # both ends of a pair lie in one component afterwards, so one end says whether it is redone
    again = links[1].join(redone.withColumnRenamed("node", "x"), "x", "left_semi").select("x", "y")
    return labels.join(stale, "component", "left_anti").select("node", "component").unionByName(V.components(again, "x", "y", small=small))
