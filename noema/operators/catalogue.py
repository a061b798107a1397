"""Catalogue queries: facets, pages, neighbourhoods, counts and queues."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from noema.operators.common import both_ends


def faceted(concepts: DataFrame, edges: DataFrame, *, scope: str | None = None, types: Sequence[str] = (), status: Sequence[str] = (), source: str | None = None, curated: bool | None = None, unverified_only: bool = False, text: str | None = None, cluster: str | None = None, orphan: bool | None = None, tombstones: bool = False) -> DataFrame:
    """Concepts under up to ten facets, all of which must hold. A concept is a store and an id, and clusters are those of its store. ``text`` is a literal part of title or description, in any case; orphans are in no cluster; unverified ones are generated (``generated_by``) and neither curated nor verified."""
    out = concepts if tombstones else concepts.where("status <> 'tombstone'")
    if unverified_only:
        out = out.where("generated_by is not null and not curated and verified_at is null")
    for name, value in (("scope", scope), ("source_name", source), ("curated", curated)):
        if value is not None:
            out = out.where(F.col(name) == value)
    if types:
        out = out.where(F.col("type").isin(*types))
    if status:
        out = out.where(F.col("status").isin(*status))
    if text:
        part = text.lower()
        out = out.where(F.lower("title").contains(part) | F.coalesce(F.lower("description").contains(part), F.lit(False)))
    members = edges.where("kind = 'member' and from_store = to_store").select("from_id", F.col("to_store").alias("store"), F.col("to_id").alias("id"))
    if cluster is not None:
        out = out.join(members.where(F.col("from_id") == cluster), ["store", "id"], "left_semi")
    if orphan is not None:
        out = out.join(members, ["store", "id"], "left_anti" if orphan else "left_semi")
    return out.select(*concepts.columns)


def in_scope(concepts: DataFrame, scope: str, concept_type: str | None = None) -> DataFrame:
    """Living concepts of a scope by id."""
    out = concepts.where((F.col("scope") == scope) & (F.col("status") != "tombstone"))
    return (out if concept_type is None else out.where(F.col("type") == concept_type)).orderBy("id")


def page(df: DataFrame, limit: int, cursor: str | None = None) -> DataFrame:
    """A page in the order of ids after ``cursor``, with the cursor of the next page on every row (null on the last page)."""
    rows = (df if cursor is None else df.where(F.col("id") > cursor)).orderBy("id").limit(limit + 1)
    numbered = rows.withColumn("n", F.row_number().over(W.orderBy("id"))).withColumn("all", F.count("*").over(W.partitionBy()))
    last = F.max(F.when(F.col("n") == limit, F.col("id"))).over(W.partitionBy())
    return numbered.withColumn("next_cursor", F.when(F.col("all") > limit, last)).where(F.col("n") <= limit).drop("n", "all")


def induced(edges: DataFrame, ids: DataFrame, kinds: Sequence[str] = ()) -> DataFrame:
    """Edges of one store with both ends in ``ids``."""
    out = edges.where("from_store = to_store")
    if kinds:
        out = out.where(F.col("kind").isin(*kinds))
    return out.join(ids.select(F.col("id").alias("from_id")), "from_id", "left_semi").join(ids.select(F.col("id").alias("to_id")), "to_id", "left_semi")


def graph_map(concepts: DataFrame, edges: DataFrame) -> DataFrame:
    """Concepts of a page with their degree inside of the page."""
    ends = both_ends(induced(edges, concepts)).groupBy("id").count()
    return concepts.join(ends, "id", "left").withColumn("degree", F.coalesce("count", F.lit(0))).drop("count")


def neighbourhood(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges that touch one of ``ids`` at either end, each once."""
    one = edges.join(ids.select(F.col("id").alias("from_id")), "from_id", "left_semi").select(*edges.columns)
    two = edges.join(ids.select(F.col("id").alias("to_id")), "to_id", "left_semi").select(*edges.columns)
    return one.unionAll(two).dropDuplicates(["from_store", "from_id", "to_store", "to_id", "kind"])


def bridges_into(edges: DataFrame, store: str, ids: DataFrame) -> DataFrame:
    """Edges of other stores into concepts of ``store``."""
    return edges.where((F.col("to_store") == store) & (F.col("from_store") != store)).join(ids.select(F.col("id").alias("to_id")), "to_id", "left_semi")


def foreign_targets(edges: DataFrame) -> DataFrame:
    return edges.where("from_store <> to_store").select("to_store", "to_id").distinct()


def kinds_between(edges: DataFrame) -> DataFrame:
    """Kinds of edges between two concepts, whatever their direction: low, high, kinds (sorted)."""
    return edges.groupBy(F.least("from_id", "to_id").alias("low"), F.greatest("from_id", "to_id").alias("high")).agg(F.array_sort(F.collect_set("kind")).alias("kinds"))


def degrees(edges: DataFrame) -> DataFrame:
    """Edges other than memberships at each concept: store, id, n. An edge from a concept to itself counts once."""
    ends = edges.where("kind <> 'member'").select(F.explode(F.array_distinct(F.array(*(F.struct(F.col(f"{e}_store").alias("store"), F.col(f"{e}_id").alias("id")) for e in ("from", "to"))))).alias("end"))
    return ends.groupBy("end.store", "end.id").agg(F.count("*").alias("n"))


def loose(concepts: DataFrame, edges: DataFrame, threshold: int = 1, scope: str | None = None) -> DataFrame:
    """Living concepts, clusters aside, with fewer than ``threshold`` edges other than memberships: store, id, semantic_degree. A concept is a store and an id."""
    out = concepts.where("status <> 'tombstone' and type <> 'Cluster'")
    out = out if scope is None else out.where(F.col("scope") == scope)
    return out.join(degrees(edges), ["store", "id"], "left").select("store", "id", F.coalesce("n", F.lit(0)).alias("semantic_degree")).where(F.col("semantic_degree") < threshold)


def counts(concepts: DataFrame) -> DataFrame:
    return concepts.groupBy("scope", "type", "status").agg(F.count("*").alias("n"))


def stats(concepts: DataFrame) -> DataFrame:
    """Numbers of concepts of each store: in all, by scope, by type and by status, in one pass."""
    return concepts.groupingSets([["store"], ["store", "scope"], ["store", "type"], ["store", "status"]], "store", "scope", "type", "status").agg(F.count("*").alias("n"))


def unverified(edges: DataFrame, limit: int, kinds: Sequence[str] = ()) -> DataFrame:
    """Generated edges that nobody has curated or verified: highest confidence first (unknown last), then the newest."""
    out = edges.where("generated and not curated and verified_at is null")
    if kinds:
        out = out.where(F.col("kind").isin(*kinds))
    return out.orderBy(F.desc_nulls_last("confidence"), F.desc_nulls_last("created_at"), "from_store", "from_id", "to_store", "to_id", "kind").limit(limit)


def member_counts(concepts: DataFrame, edges: DataFrame) -> DataFrame:
    """Living clusters with their number of members: store, id, title, members."""
    n = edges.where("kind = 'member'").groupBy(F.col("from_store").alias("store"), F.col("from_id").alias("id")).agg(F.count("*").alias("members"))
    return concepts.where("type = 'Cluster' and status <> 'tombstone'").join(n, ["store", "id"], "left").select("store", "id", "title", F.coalesce("members", F.lit(0)).alias("members"))


def resolution(concepts: DataFrame, edges: DataFrame) -> DataFrame:
    """Whether each edge's target is a living concept: kind, resolved, n."""
    living = concepts.where("status <> 'tombstone'").select(F.col("id").alias("to_id"), F.col("store").alias("to_store"), F.lit(True).alias("there"))
    return edges.join(living, ["to_store", "to_id"], "left").groupBy("kind", F.coalesce("there", F.lit(False)).alias("resolved")).agg(F.count("*").alias("n"))


def usage(calls: DataFrame) -> DataFrame:
    """Model calls by task: number, cache hits, failures, cost."""
    return calls.groupBy("task").agg(F.count("*").alias("calls"), F.count_if("cache_hit").alias("cache_hits"), F.count_if(~F.col("status").isin("ok", "cache_hit")).alias("failures"), F.coalesce(F.sum("cost"), F.lit(0.0)).alias("cost"))


def spent(calls: DataFrame) -> DataFrame:
    """Cost of successful calls by run."""
    return calls.where("status = 'ok'").groupBy("run").agg(F.count("*").alias("calls"), F.coalesce(F.sum("cost"), F.lit(0.0)).alias("cost"))


def detail(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """What surrounds each concept (store, id), over both stores: store, id, role (outgoing, incoming, cluster), other_store, other, kind. One row an edge, so that a hub is no long list; membership also names the cluster."""
    out = edges.select(F.col("from_store").alias("store"), F.col("from_id").alias("id"), F.lit("outgoing").alias("role"), F.col("to_store").alias("other_store"), F.col("to_id").alias("other"), "kind")
    into = edges.select(F.col("to_store").alias("store"), F.col("to_id").alias("id"), F.explode(F.when(F.col("kind") == "member", F.array(F.lit("incoming"), F.lit("cluster"))).otherwise(F.array(F.lit("incoming")))).alias("role"), F.col("from_store").alias("other_store"), F.col("from_id").alias("other"), "kind")
    return out.unionAll(into).join(ids.select("store", "id").distinct(), ["store", "id"], "left_semi")


def curation_queue(concepts: DataFrame, edges: DataFrame, limit: int, kinds: Sequence[str] = ()) -> DataFrame:
    """The edges to be looked at with the titles of both ends (null where there is no concept)."""
    queue = unverified(edges, limit, kinds)
    for end in ("from", "to"):
        queue = queue.join(concepts.select(F.col("store").alias(f"{end}_store"), F.col("id").alias(f"{end}_id"), F.col("title").alias(f"{end}_title")), [f"{end}_store", f"{end}_id"], "left")
    return queue


def cluster_detail(concepts: DataFrame, edges: DataFrame, store: str, cluster: str) -> DataFrame:
    """Members and related clusters of a cluster of a store: role (member, related), store, id, title, weight."""
    ends = edges.where((F.col("from_store") == store) & (F.col("from_id") == cluster) & F.col("kind").isin("member", "related")).select(F.col("kind").alias("role"), F.col("to_store").alias("store"), F.col("to_id").alias("id"), "weight")
    return ends.join(concepts.select("store", "id", "title"), ["store", "id"], "left").select("role", "store", "id", "title", "weight")


def boundary_violations(edges: DataFrame) -> DataFrame:
    """Edges that leave a store other than the personal one, by stores: from_store, to_store, n."""
    return edges.where("from_store <> to_store and from_store <> 'personal'").groupBy("from_store", "to_store").agg(F.count("*").alias("n"))


def overview(concepts: DataFrame, edges: DataFrame, scope: str | None = None, limit: int = 50, cursor: str | None = None) -> DataFrame:
    """A page of a scope's living clusters with their number of members."""
    return page(member_counts(concepts if scope is None else concepts.where(F.col("scope") == scope), edges), limit, cursor)


def map_page(concepts: DataFrame, edges: DataFrame, store: str, limit: int = 200, cursor: str | None = None, kinds: Sequence[str] = (), **facets) -> tuple[DataFrame, DataFrame]:
    """A page of a store's concepts under facets with their degree inside of the page, and the edges between them."""
    shown = page(faceted(concepts.where(F.col("store") == store), edges, **facets), limit, cursor)
    inside = induced(edges.where(F.col("from_store") == store), shown, kinds)
    degree = both_ends(inside).groupBy("id").count()
    return shown.join(degree, "id", "left").withColumn("degree", F.coalesce("count", F.lit(0))).drop("count"), inside


def store_totals(concepts: DataFrame, edges: DataFrame, threshold: int = 1) -> DataFrame:
    """For each store: living concepts, clusters, loose concepts and edges."""
    living = concepts.where("status <> 'tombstone'").groupBy("store").agg(F.count("*").alias("concepts"), F.count_if(F.col("type") == "Cluster").alias("clusters"))
    single = loose(concepts, edges, threshold).groupBy("store").agg(F.count("*").alias("loose"))
    links = edges.groupBy(F.col("from_store").alias("store")).agg(F.count("*").alias("edges"))
    return living.join(single, "store", "left").join(links, "store", "left").select("store", "concepts", "clusters", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("loose", "edges")))
