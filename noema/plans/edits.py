"""Queries of curation: edits of the whole graph with their journal, each with the DuckDB text that it is held against."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noema.operators import curation
from noema.operators.common import checkpointed
from noema.plans import graph
from noema.plans.registration import query

REGISTERED = True
WHEN = {"actor": "editor", "now": "1999-01-01 00:00:00"}
_EDGES = "from_store, from_id, to_store, to_id, kind, curated, verified_at IS NOT NULL AS verified"


def _state(spark: SparkSession, sf_dir: str) -> curation.State:
    """The graph as a state that nobody has edited yet."""
    concepts, edges = graph.load(spark, sf_dir)
    bare = curation.empty(spark)
    missing = {f.name: F.lit(None).cast(f.dataType).alias(f.name) for f in bare.concepts.schema}
    concepts = concepts.select(*(F.col(c) if c in concepts.columns else missing[c] for c in bare.concepts.columns))
    edges = edges.withColumn("verified", F.col("verified_at").isNotNull()).select(*bare.edges.columns)
    return curation.State(concepts, edges, bare.rejections, bare.candidates, bare.journal)


def _written(state: curation.State, *names: str) -> curation.State:
    """The state with its tables (or those named) written, so that edits don't pile up in a plan."""
    return replace(state, **{n: checkpointed(getattr(state, n)) for n in names or ("concepts", "edges", "rejections", "candidates", "journal")})


def _key(from_id: str, to_id: str, kind: str, from_store: str = "shared", to_store: str = "shared") -> dict[str, str]:
    return {"from_store": from_store, "from_id": from_id, "to_store": to_store, "to_id": to_id, "kind": kind}


#: An edge for each kind of edit: a new one, and ones that the graph derives from its first rows.
NEW, SUPPLIED, BOUGHT = _key("customer:1", "part:1", "related", "personal"), "supplier:1", "customer:2"


def _first(state: curation.State, from_id: str, kind: str) -> dict[str, str]:
    return state.edges.where((F.col("from_id") == from_id) & (F.col("kind") == kind)).select(*curation.KEY).first().asDict()


def _edge_rows(state: curation.State) -> DataFrame:
    return state.edges.select(*curation.KEY, "curated", "verified")


def _edited(spark: SparkSession, sf_dir: str) -> curation.State:
    """Entries 1 to 4: an edge added, one verified, one rejected, and a concept whose status changes."""
    state = curation.add_edge(_state(spark, sf_dir), NEW, **WHEN)
    state = curation.verify_edge(state, _first(state, SUPPLIED, "related"), **WHEN)
    state = curation.reject_edge(state, _first(state, BOUGHT, "references"), "wrong", **WHEN)
    return curation.patch_concept(state, "region:1", {"status": "archived"}, **WHEN)


_ADDED = "SELECT 'personal', 'customer:1', 'shared', 'part:1', 'related', TRUE, TRUE"


@query(f" SELECT {_EDGES} FROM edges WHERE NOT (from_id = 'supplier:1' AND kind = 'related') AND NOT (from_id = 'customer:2' AND kind = 'references') UNION ALL SELECT from_store, from_id, to_store, to_id, kind, TRUE, TRUE FROM edges WHERE from_id = 'supplier:1' AND kind = 'related' UNION ALL {_ADDED}")
def curated_edges(spark, sf_dir):
    return _edge_rows(_edited(spark, sf_dir))


@query(" SELECT from_id, to_id, kind, 'wrong' AS reason FROM edges WHERE from_id = 'customer:2' AND kind = 'references'")
def noted_rejections(spark, sf_dir):
    return _edited(spark, sf_dir).rejections.select("from_id", "to_id", "kind", "reason")


@query(" SELECT * FROM (VALUES (4, 'status_changed', 'region:1', 'active'), (3, 'rejected', 'customer:2', NULL), (2, 'verified', 'supplier:1', NULL), (1, 'edge_added', 'customer:1', NULL)) t(entry, change, concept_id, previous)")
def edit_history(spark, sf_dir):
    return curation.history(_edited(spark, sf_dir).journal).select("entry", "change", "concept_id", F.col("detail")["previous_status"].alias("previous"))


@query(f" SELECT {_EDGES} FROM edges WHERE NOT (from_id = 'supplier:1' AND kind = 'related') UNION ALL SELECT from_store, from_id, to_store, to_id, kind, TRUE, FALSE FROM edges WHERE from_id = 'supplier:1' AND kind = 'related'")
def undone_edits(spark, sf_dir):
    """All edits of edges taken back; an edge that was verified stays curated."""
    state = _edited(spark, sf_dir)
    for entry in (3, 2, 1):
        state = curation.undo(state, entry, **WHEN)
    return _edge_rows(state)


@query(f" SELECT {_EDGES} FROM edges WHERE kind <> 'member' UNION ALL SELECT from_store, from_id, to_store, to_id, kind, TRUE, TRUE FROM edges WHERE kind = 'member'")
def undone_at_once(spark, sf_dir):
    """All members of all regions taken out, and all of these entries taken back in one join."""
    state = _written(_state(spark, sf_dir))
    every = checkpointed(state.edges.where("kind = 'member'").select("from_id", F.col("to_id").alias("id")))
    for k in range(5):
        members = every.where(f"from_id = 'region:{k}'").select("id")
        # edges stay one table without the members of each edit, which are tables of their own
        state = _written(curation.remove_members(state, f"region:{k}", "shared", members, **WHEN), "candidates", "journal")
    return _edge_rows(curation.undo_all(state, state.journal.where("change = 'cluster_removed'").select("entry"), **WHEN))


@query(" SELECT id, type, status, curated FROM concepts")
def undone_statuses(spark, sf_dir):
    """A status put back, and a concept that was created gone again."""
    state = curation.create_concept(_edited(spark, sf_dir), "note:1", "sales", "Note", "a note", **WHEN)
    return curation.undo(curation.undo(state, 5, **WHEN), 4, **WHEN).concepts.select("id", "type", "status", "curated")


@query(f" SELECT {_EDGES} FROM edges WHERE NOT (from_id = 'supplier:1' AND kind = 'related')")
def deleted_edges(spark, sf_dir):
    state = _state(spark, sf_dir)
    return _edge_rows(curation.delete_edge(state, _first(state, SUPPLIED, "related"), **WHEN))


@query(" SELECT id, store, type, title, status, curated FROM concepts UNION ALL SELECT 'note:1', 'personal', 'Note', 'a note', 'active', TRUE")
def created_concepts(spark, sf_dir):
    return curation.create_concept(_state(spark, sf_dir), "note:1", "sales", "Note", "a note", **WHEN).concepts.select("id", "store", "type", "title", "status", "curated")


@query(" SELECT id, CASE WHEN id = 'region:1' THEN 'renamed' ELSE title END AS title, CASE WHEN id = 'region:1' THEN 'new,old' END AS tags, curated FROM concepts")
def patched_concepts(spark, sf_dir):
    state = curation.patch_concept(_state(spark, sf_dir), "region:1", {"title": "renamed", "tags": ["new", "old"]}, **WHEN)
    return state.concepts.select("id", "title", F.array_join("tags", ",").alias("tags"), "curated")


@query(" SELECT id, CASE WHEN id = 'region:2' THEN 'two' ELSE title END AS title, CASE WHEN id = 'region:2' THEN 'about two' ELSE description END AS description FROM concepts WHERE type <> 'Order'")
def renamed_clusters(spark, sf_dir):
    state = curation.rename_cluster(_state(spark, sf_dir), "region:2", "two", "about two", **WHEN)
    return state.concepts.where("type <> 'Order'").select("id", "title", "description")


_SUPPLIERS = "SELECT id FROM concepts WHERE type = 'Supplier'"


@query(f" SELECT from_id, to_id FROM edges WHERE kind = 'member' UNION SELECT 'region:1', id FROM ({_SUPPLIERS})")
def added_members(spark, sf_dir):
    """All suppliers as members by hand, in one go."""
    state = _state(spark, sf_dir)
    state = curation.add_members(state, "region:1", "shared", state.concepts.where("type = 'Supplier'").select("id"), **WHEN)
    return state.edges.where("kind = 'member'").select("from_id", "to_id")


_NATIONS = "SELECT id FROM concepts WHERE type = 'Nation'"


@query(f" SELECT 'member' AS what, from_id AS cluster_id, to_id AS concept_id FROM edges WHERE kind = 'member' AND from_id <> 'region:1' UNION ALL SELECT 'barred', 'region:1', id FROM ({_NATIONS}) UNION ALL SELECT 'cluster_removed', 'region:1', id FROM ({_NATIONS})")
def removed_members(spark, sf_dir):
    """All nations out of a cluster: members left, pairs barred and entries of the journal."""
    state = _state(spark, sf_dir)
    state = curation.remove_members(state, "region:1", "shared", state.concepts.where("type = 'Nation'").select("id"), **WHEN)
    members = state.edges.where("kind = 'member'").select(F.lit("member").alias("what"), F.col("from_id").alias("cluster_id"), F.col("to_id").alias("concept_id"))
    barred = state.candidates.where("excluded").select(F.lit("barred"), "cluster_id", "concept_id")
    return members.unionAll(barred).unionAll(state.journal.select("change", F.col("detail")["from_id"], "concept_id"))


@query(" SELECT CASE WHEN from_id = 'region:1' AND to_id IN (SELECT id FROM concepts WHERE curated) THEN 'cluster:new' ELSE from_id END AS from_id, to_id FROM edges WHERE kind = 'member'")
def split_clusters(spark, sf_dir):
    """The curated members of a cluster as a cluster of their own."""
    state = _state(spark, sf_dir)
    part = state.edges.where("kind = 'member' and from_id = 'region:1'").select(F.col("to_id").alias("id")).join(state.concepts.where("curated").select("id"), "id", "left_semi")
    return curation.split_cluster(state, "region:1", "cluster:new", "shared", part, "split", **WHEN).edges.where("kind = 'member'").select("from_id", "to_id")


@query(", m AS (SELECT from_store, CASE WHEN from_id = 'region:1' THEN 'region:2' ELSE from_id END AS from_id, to_store, CASE WHEN to_id = 'region:1' THEN 'region:2' ELSE to_id END AS to_id, kind FROM edges) SELECT DISTINCT * FROM m WHERE from_id <> to_id OR from_store <> to_store")
def merged_clusters(spark, sf_dir):
    return curation.merge_clusters(_state(spark, sf_dir), "shared", "region:1", "region:2", **WHEN).edges.select(*curation.KEY)
