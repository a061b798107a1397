"""Traversal over all stores with hops, a node limit and ranking. A node is a store and an id: equal ids of two stores are two nodes."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noema.operators.common import checkpointed

MAX_HOPS, MAX_NODES = 5, 400
NODE = "store string, id string, hops int"
KEY = ["from_store", "from_id", "to_store", "to_id", "kind"]


class Reach(NamedTuple):
    """``nodes``: store, id, hops; ``edges``: those met on the way; ``truncated``: whether the limit kept a node out."""

    nodes: DataFrame
    edges: DataFrame
    truncated: bool


def _filtered(edges: DataFrame, kinds: Sequence[str], stores: Sequence[str], start: DataFrame) -> DataFrame:
    """Edges of some kinds between some stores, among which those of the start always are; a join, as the start may have any number of them."""
    if kinds:
        edges = edges.where(F.col("kind").isin(*kinds))
    if stores:
        named = edges.sparkSession.createDataFrame([(s,) for s in stores], "store string")
        entered = named.unionAll(start.select("store")).distinct()
        for end in ("from_store", "to_store"):
            edges = edges.join(entered.withColumnRenamed("store", end), end, "left_semi").select(*edges.columns)
    return edges


def _touching(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with an end in ``nodes`` (store, id), each once for each end in there: two equi-joins in place of an OR."""
    ends = [edges.join(nodes.select(F.col("store").alias(f"{e}_store"), F.col("id").alias(f"{e}_id")), [f"{e}_store", f"{e}_id"], "left_semi").select(*edges.columns) for e in ("from", "to")]
    return ends[0].unionAll(ends[1])


def _first_met(edges: DataFrame) -> DataFrame:
    """Both ends of edges with the place at which a node is first met, in the order of stores, then starts, kinds and ends: store, id, place."""
    place = lambda end: F.concat_ws("\x01", "from_store", "from_id", "kind", "to_id", F.lit(end))
    ends = edges.select(F.col("from_store").alias("store"), F.col("from_id").alias("id"), place("0").alias("place")).unionAll(edges.select("to_store", "to_id", place("1")))
    return ends.groupBy("store", "id").agg(F.min("place").alias("place"))


def expand(edges: DataFrame, start: DataFrame, hops: int = 2, max_nodes: int | None = MAX_NODES, kinds: Sequence[str] = (), stores: Sequence[str] = ()) -> Reach:
    """Nodes within ``hops`` steps of ``start`` (store, id) in either direction.

    Filters of kinds and stores hold while the search expands; stores of the start are always
    entered. At ``max_nodes`` no new node is taken and the search ends with its hop; nodes that are
    met first are taken first. With a limit, which the starts may not exceed, the nodes so far are a
    small table from the driver and a hop is one job; without one, each hop is written.
    """
    if not 0 <= hops <= MAX_HOPS:
        raise ValueError(f"hops must lie between 0 and {MAX_HOPS}")
    spark = edges.sparkSession
    bounded = max_nodes is not None
    seen = start.select("store", "id", F.lit(0).alias("hops")).distinct()
    if bounded:
        rows = seen.limit(max_nodes + 1).collect()
        if len(rows) > max_nodes:
            raise ValueError(f"more than {max_nodes} starts")
        seen = spark.createDataFrame(rows, NODE)
    else:
        seen = checkpointed(seen)
    edges = _filtered(edges, kinds, stores, seen)
    held, frontier, inner, truncated = seen.count() if bounded else 0, seen, seen, False
    for hop in range(1, hops + 1):
        inner = seen  # nodes whose edges have been met
        new = _first_met(_touching(edges, F.broadcast(frontier) if bounded else frontier)).join(F.broadcast(seen) if bounded else seen, ["store", "id"], "left_anti")
        if bounded:
            left = max(0, max_nodes - held)
            rows = new.orderBy("place").limit(left + 1).collect()  # max_nodes + 1 at most
            truncated = len(rows) > left
            frontier = spark.createDataFrame([(r["store"], r["id"], hop) for r in rows[:left]], NODE)
            held += len(rows[:left])
            seen = spark.createDataFrame([*seen.collect(), *frontier.collect()], NODE)
            if truncated or not rows:
                break
        else:
            frontier = checkpointed(new.select("store", "id", F.lit(hop).alias("hops")))
            seen = seen.unionAll(frontier)
    met = _touching(edges, F.broadcast(inner) if bounded else inner).dropDuplicates(KEY) if hops else edges.limit(0)
    return Reach(seen, met, truncated)


def reach(edges: DataFrame, start: DataFrame, hops: int = 2, max_nodes: int | None = MAX_NODES, kinds: Sequence[str] = (), stores: Sequence[str] = ()) -> DataFrame:
    """``expand``'s nodes: store, id, hops."""
    return expand(edges, start, hops, max_nodes, kinds, stores).nodes


def neighbours(edges: DataFrame, start: DataFrame, max_nodes: int | None = MAX_NODES) -> Reach:
    """What one hop reaches."""
    return expand(edges, start, 1, max_nodes)


def density(edges: DataFrame, depth: int) -> DataFrame:
    """How many personal nodes reach each node along ``edges`` at a cost of at most ``depth``; a step of membership costs nothing and a node doesn't count itself: store, id, density."""
    end = lambda e: F.struct(F.col(f"{e}_store").alias("store"), F.col(f"{e}_id").alias("id"))
    step = checkpointed(edges.groupBy(end("from").alias("a"), end("to").alias("b")).agg(F.min(F.when(F.col("kind") == "member", 0).otherwise(1)).alias("price")))
    best = step.where("a.store = 'personal'").select(F.col("a").alias("origin"), F.col("a").alias("at"), F.lit(0).alias("cost")).distinct()
    before = None
    while True:  # shortest paths by relaxation: every round either lowers a cost or is the last
        further = best.join(step, best["at"] == step["a"]).select("origin", F.col("b").alias("at"), (F.col("cost") + F.col("price")).alias("cost")).where(F.col("cost") <= depth)
        best = checkpointed(best.unionAll(further).groupBy("origin", "at").agg(F.min("cost").alias("cost")))
        now = best.agg(F.count("*"), F.sum("cost")).first()
        if now == before:
            break
        before = now
    return best.where("origin <> at").groupBy("at").agg(F.count("*").alias("density")).select("at.store", "at.id", "density")


def score(hops: Column, density_: Column, largest: Column, updated_at: Column, now: str, weights: tuple[float, float, float] = (0.5, 0.3, 0.2), half_life: float = 90.0) -> Column:
    """Nearness 1 / (1 + hops), density over the largest, and 2 to the power of minus age over half-life, weighted."""
    age = F.greatest(F.lit(0.0), (F.unix_micros(F.to_timestamp(F.lit(now))) - F.unix_micros(updated_at)) / F.lit(86_400e6))
    share = F.when(largest > 0, density_ / largest).otherwise(0.0)
    fresh = F.coalesce(F.pow(F.lit(2.0), -age / half_life), F.lit(0.0))
    return F.round(F.lit(weights[0]) / (1 + hops) + F.lit(weights[1]) * share + F.lit(weights[2]) * fresh, 9)


def traverse(concepts: DataFrame, edges: DataFrame, start: DataFrame, now: str, hops: int = 2, max_nodes: int | None = MAX_NODES, weights: tuple[float, float, float] = (0.5, 0.3, 0.2), half_life: float = 90.0, tombstones: bool = False, kinds: Sequence[str] = (), stores: Sequence[str] = ()) -> Reach:
    """Ranked nodes around ``start`` (store, id), with the edges met: nodes are store, id, type, hops, density, score; highest score first, then by id.

    Density counts over the edges met and is set against the largest of the nodes shown. A start of
    which no concept exists is an error; tombstones are left out unless asked for.
    """
    found = expand(edges, start, hops, max_nodes, kinds, stores)
    nodes = F.broadcast(found.nodes) if max_nodes is not None else found.nodes
    known = concepts.select("store", "id", "type", "status", "updated_at").join(nodes, ["store", "id"])
    met = checkpointed(found.edges.select(*KEY))
    shown = known if tombstones else known.where("status <> 'tombstone'")
    rows = checkpointed(shown.join(density(met, hops), ["store", "id"], "left").withColumn("density", F.coalesce("density", F.lit(0))))
    if rows.isEmpty() and known.where("hops = 0").isEmpty():
        raise LookupError("no start of the traversal exists")
    largest = F.lit(rows.agg(F.coalesce(F.max("density"), F.lit(0))).first()[0])
    ranked = rows.select("store", "id", "type", "hops", "density", score(F.col("hops"), F.col("density"), largest, F.col("updated_at"), now, weights, half_life).alias("score"))
    return Reach(ranked.orderBy(F.desc("score"), "id", "store"), met, found.truncated)
