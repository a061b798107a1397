"""Connected components of an edge table, without bringing edges to the driver."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noema.llm.frames import cut


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, smallest node of its component) of the graph of the edges a-b: at most one for each node."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[left], label[right])
        new = label.copy()
        for side in (left, right):
            np.minimum.at(new, label[side], low)
            np.minimum.at(new, side, low)
        while (jump := new[new]).tolist() != new.tolist():
            new = jump
        if (new == label).all():
            break
        label = new
    member = label != np.arange(len(nodes))
    return nodes[member], nodes[label[member]]


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Stars of the components of ``edges`` (a, b: long): node, root; root is the component's smallest node and has no row of its own.

    Large and small stars in turn: every round links each node's larger
    neighbours, then its smaller ones, to the smallest it knows, until nothing
    changes; each round is checkpointed. A node with very many edges meets
    joins that can be split, and sums that are combined before the shuffle.
    """
    star = cut(edges.where("a != b").select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("root")).distinct())
    before = None
    for _ in range(rounds):
        both = star.select(F.col("node").alias("u"), F.col("root").alias("v")).unionAll(star.select(F.col("root").alias("u"), F.col("node").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("node"), F.col("m").alias("root")).where("node != root").distinct()
        lowest = large.groupBy("node").agg(F.min("root").alias("m"))
        small = large.join(lowest, "node")
        star = cut(small.select(F.col("node"), F.col("m").alias("root")).unionAll(small.select(F.col("root").alias("node"), F.col("m").alias("root"))).where("node != root").distinct())
        now = tuple(star.agg(F.count("*"), F.bit_xor(F.xxhash64("node", "root"))).first())
        if now == before:
            return star
        before = now
    raise RuntimeError("components did not settle")
