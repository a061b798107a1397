"""Clustering runs: splitting, continuing earlier clusters, stable memberships, titles and related clusters."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from noema.operators import vectors as V
from noema.operators.common import checkpointed
from noema.operators.forest import cuts, spanning

CANDIDATE = "concept_id string, cluster_id string, score double, seen int, last_run string, excluded boolean"


def narrowed(groups: DataFrame, pairs: DataFrame, most: int = 25, base: float = 0.55, levels: int = 10) -> DataFrame:
    """Groups (node, component) of at most ``most`` nodes.

    Larger ones fall apart along pairs at ever higher similarity, a quarter nearer to 1 at each
    level, and a part is done at the first level at which it is small enough. All levels are read
    from one maximum spanning forest of the pairs inside of groups. What holds together to the last
    level is cut into chunks of sorted ids.
    """
    sized = checkpointed(groups.withColumn("size", F.count("*").over(W.partitionBy("component"))))
    large = sized.where(F.col("size") > most).select("node", F.col("component").alias("group"))
    ends = [large.select(F.col("node").alias(n), F.col("group").alias(f"{n}_group")) for n in ("id", "other")]
    inside = pairs.select("id", "other", "similarity").join(ends[0], "id").join(ends[1], "other").where("id_group = other_group")
    thresholds = [1 - (1 - base) * 0.75**level for level in range(1, levels + 1)]
    parts = checkpointed(cuts(spanning(inside), thresholds).withColumn("size", F.count("*").over(W.partitionBy("level", "component"))))
    # the levels at which a node's part is too large come first; after them it is small, or alone
    held = parts.where(F.col("size") > most).groupBy("node").agg(F.max("level").alias("held"))
    after = large.join(held, "node", "left").withColumn("level", F.least(F.coalesce("held", F.lit(0)) + 1, F.lit(levels)))
    found = after.join(parts.select("node", "level", "component"), ["node", "level"], "left").select("node", F.coalesce("component", "node").alias("component"))
    return V.split_large(checkpointed(sized.where(F.col("size") <= most).select("node", "component").unionAll(found)), most)


def continued(groups: DataFrame, members: DataFrame) -> DataFrame:
    """The earlier cluster that each group continues: component, cluster_id (null for a new one).

    Larger groups choose first (then by smallest node), each the free cluster with the largest
    overlap (then the smallest id). That is a stable matching in which all clusters rank groups
    alike, so rounds of proposals give the same result as one choice after another: in a round all
    groups ask their best cluster and each cluster turns away all but the first in line.
    """
    line = groups.groupBy("component").agg(F.count("*").alias("size"), F.min("node").alias("first"))
    earlier = members.select(F.col("concept_id").alias("node"), "cluster_id").distinct()
    asks = groups.join(earlier, "node").groupBy("component", "cluster_id").agg(F.count("*").alias("shared")).join(line, "component")
    asks = checkpointed(asks)
    while True:
        best = asks.withColumn("choice", F.row_number().over(W.partitionBy("component").orderBy(F.desc("shared"), "cluster_id"))).where("choice = 1")
        place = F.row_number().over(W.partitionBy("cluster_id").orderBy(F.desc("size"), "first"))
        placed = checkpointed(best.withColumn("place", place))
        refused = placed.where("place > 1").select("component", "cluster_id")
        if refused.isEmpty():
            return line.select("component").join(placed.select("component", "cluster_id"), "component", "left")
        asks = checkpointed(asks.join(refused, ["component", "cluster_id"], "left_anti"))


def observed(candidates: DataFrame, seen: DataFrame, run: str) -> DataFrame:
    """Candidates after a run: pairs seen in it (concept_id, cluster_id, score) count one more, once a run; others expire unless they are excluded, and excluded ones don't count."""
    key = ["concept_id", "cluster_id"]
    now = seen.groupBy(*key).agg(F.max("score").alias("new_score")).withColumn("now", F.lit(True))
    both = candidates.join(now, key, "full_outer").withColumn("excluded", F.coalesce("excluded", F.lit(False)))
    counts = F.col("now").isNotNull() & ~F.col("excluded")
    more = F.when(F.col("last_run").eqNullSafe(F.lit(run)), F.col("seen")).otherwise(F.coalesce("seen", F.lit(0)) + 1)
    rows = both.where(F.col("now").isNotNull() | F.col("excluded") | (F.col("last_run") == run))
    return rows.select(*key, F.when(counts, F.col("new_score")).otherwise(F.col("score")).alias("score"), F.when(counts, more).otherwise(F.col("seen")).alias("seen"), F.when(counts, F.lit(run)).otherwise(F.col("last_run")).alias("last_run"), "excluded")


def exclude(candidates: DataFrame, pairs: DataFrame) -> DataFrame:
    """Candidates with ``pairs`` (concept_id, cluster_id) barred for good, also where they were no candidates."""
    key = ["concept_id", "cluster_id"]
    barred = pairs.select(*key).distinct().withColumn("barred", F.lit(True))
    both = candidates.join(barred, key, "full_outer")
    return both.select(*key, F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("seen", F.lit(0)).alias("seen"), "last_run", F.coalesce("barred", "excluded").alias("excluded"))


def include(candidates: DataFrame, pairs: DataFrame) -> DataFrame:
    """Candidates without the barred ``pairs``; they start from nothing."""
    return candidates.join(pairs.select("concept_id", "cluster_id"), ["concept_id", "cluster_id"], "left_anti")


def member_change(old: DataFrame, new: DataFrame) -> DataFrame:
    """How many members of each earlier cluster came or went, in whole percent of its old size: cluster_id, percent."""
    key = ["cluster_id", "concept_id"]
    both = old.select(*key).distinct().withColumn("was", F.lit(1)).join(new.select(*key).distinct().withColumn("now", F.lit(1)), key, "full_outer")
    sums = both.groupBy("cluster_id").agg(F.count("was").alias("size"), F.count_if(F.col("was").isNull() | F.col("now").isNull()).alias("moved"))
    return sums.where("size > 0").select("cluster_id", F.expr("moved * 100 div size").alias("percent"))


def titles(members: DataFrame, concepts: DataFrame) -> DataFrame:
    """A title without a model: the three most frequent words of more than three letters in members' titles, ties by word; cluster_id, title."""
    named = members.select("cluster_id", F.col("concept_id").alias("id")).join(concepts.select("id", "title"), "id", "left")
    sizes = named.groupBy("cluster_id").agg(F.count("*").alias("size"))
    words = named.select("cluster_id", F.explode(F.split("title", r"\s+")).alias("word")).select("cluster_id", F.lower(F.regexp_replace("word", r"^[.,;:()\[\]]+|[.,;:()\[\]]+$", "")).alias("word")).where(F.length("word") > 3)
    counted = words.groupBy("cluster_id", "word").agg(F.count("*").alias("n"))
    top = counted.withColumn("rank", F.row_number().over(W.partitionBy("cluster_id").orderBy(F.desc("n"), "word"))).where("rank <= 3")
    joined = top.groupBy("cluster_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "word"))), lambda x: x["word"]), " / ").alias("title"))
    return sizes.join(joined, "cluster_id", "left").select("cluster_id", F.coalesce("title", F.concat(F.lit("Group of "), "size", F.lit(" concepts"))).alias("title"))


def previews(members: DataFrame, concepts: DataFrame, most: int = 15) -> DataFrame:
    """The titles of each cluster's most central members, heaviest first: cluster_id, members, preview."""
    order = W.partitionBy("cluster_id").orderBy(F.desc_nulls_last("weight"), "concept_id")
    ranked = members.withColumn("rank", F.row_number().over(order)).withColumn("members", F.count("*").over(W.partitionBy("cluster_id"))).where(F.col("rank") <= most)
    named = ranked.join(concepts.select(F.col("id").alias("concept_id"), "title"), "concept_id", "left")
    return named.groupBy("cluster_id").agg(F.max("members").alias("members"), F.transform(F.array_sort(F.collect_list(F.struct("rank", "title"))), lambda x: x["title"]).alias("preview"))


class Run(NamedTuple):
    """Result of a clustering run."""

    groups: DataFrame  # component, node, cluster_id, score
    candidates: DataFrame
    members: DataFrame  # cluster_id, concept_id, weight
    centroids: DataFrame  # component, size, vector
    related: DataFrame  # id, other, similarity, rank (ids are components)
    relabel: DataFrame  # cluster_id, percent


def run(vectors: DataFrame, members: DataFrame, candidates: DataFrame, name: str, *, k: int = 8, least: float = 0.55, smallest: int = 3, largest: int = 25, stable: int = 2, related: int = 3, relabel: int = 20) -> Run:
    """A clustering run over ``vectors`` (id, vector), given members (cluster_id, concept_id) and candidates so far.

    Neighbours, components, splitting, matching with earlier clusters, stable memberships,
    centroids and related clusters. A concept becomes a member once it has been seen in ``stable``
    runs, or stays one. The id of a new cluster follows from the run and its smallest node, so a
    run that is repeated after a failure makes the same clusters.
    """
    pairs = checkpointed(V.neighbours(vectors, k, least))
    groups = narrowed(V.components(pairs), pairs, largest, least)
    groups = checkpointed(groups.withColumn("size", F.count("*").over(W.partitionBy("component"))).where(F.col("size") >= smallest).select("node", "component"))
    known = members.select("concept_id", "cluster_id").unionAll(candidates.where("not excluded").select("concept_id", "cluster_id"))
    ids = continued(groups, known)
    fresh = F.concat(F.lit("cluster:"), F.substring(F.sha2(F.concat_ws("/", F.lit(name), F.col("component").cast("string")), 256), 1, 16))
    ids = ids.select("component", F.coalesce("cluster_id", fresh).alias("cluster_id"))
    scores = V.mean_similarity(groups, pairs).select("node", F.col("similarity").alias("score"))
    grouped = checkpointed(groups.join(ids, "component").join(scores, "node", "left").select("component", "node", "cluster_id", F.coalesce("score", F.lit(0.0)).alias("score")))
    seen = grouped.select(F.col("node").cast("string").alias("concept_id"), "cluster_id", "score")
    after = checkpointed(observed(candidates, seen, name))
    was = members.select("concept_id", "cluster_id").distinct().withColumn("was", F.lit(True))
    standing = seen.join(after.select("concept_id", "cluster_id", "seen", "excluded"), ["concept_id", "cluster_id"]).join(was, ["concept_id", "cluster_id"], "left")
    now = standing.where((F.col("seen") >= stable) | F.col("was")).where("not excluded").select("cluster_id", "concept_id", F.col("score").alias("weight"))
    centers = checkpointed(V.centroids(vectors, groups))
    near = V.neighbours(centers.select(F.col("component").alias("id"), "vector"), related)
    moved = member_change(members.join(ids.select("cluster_id"), "cluster_id", "left_semi"), seen).where(F.col("percent") >= relabel)
    return Run(grouped, after, now, centers, near, moved)
