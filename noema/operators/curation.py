"""Curation: edits of concepts, edges and clusters with a journal, and their undoing.

The state is a set of DataFrames; every edit gives a new state, which ``noema.sources.snapshots``
publishes. A dry run is a state that nobody writes.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from noema.functions.scalars import content_hash
from noema.operators import clusters
from noema.operators.common import checkpointed
from noema.operators.records import appended

KEY = ["from_store", "from_id", "to_store", "to_id", "kind"]
EDGE = "from_store string, from_id string, to_store string, to_id string, kind string, weight double, confidence double, generated boolean, curated boolean, verified boolean"
CONCEPT = "id string, store string, scope string, type string, title string, description string, body string, resource string, tags array<string>, status string, curated boolean, source_name string, content_hash string, updated_at timestamp"
REJECTION = "from_store string, from_id string, to_store string, to_id string, kind string, reason string, rejected_at timestamp"
JOURNAL = "entry long, change string, concept_id string, detail map<string,string>, actor string, changed_at timestamp"
#: Fields that belong to the source of a concept, and those that a patch may change at all.
SOURCE_FIELDS, PATCHABLE = ("title", "description", "body", "resource"), ("title", "description", "body", "resource", "tags", "status", "scope", "type")


class CurationError(ValueError):
    """An edit that the rules forbid, or that finds nothing to change."""


@dataclass(frozen=True)
class State:
    concepts: DataFrame
    edges: DataFrame
    rejections: DataFrame
    candidates: DataFrame
    journal: DataFrame

    @property
    def spark(self) -> SparkSession:
        return self.concepts.sparkSession


def empty(spark: SparkSession) -> State:
    return State(*(spark.createDataFrame([], s) for s in (CONCEPT, EDGE, REJECTION, clusters.CANDIDATE, JOURNAL)))


def _is(values: dict[str, str]) -> Column:
    return reduce(lambda a, b: a & b, (F.col(k) == v for k, v in values.items()))


def _noted(state: State, change: str, concept_id: str | None, detail: dict, actor: str, now: str) -> State:
    last = state.journal.agg(F.max("entry")).first()[0] or 0
    row = [(last + 1, change, concept_id, {k: str(v) for k, v in detail.items() if v is not None}, actor, now)]
    new = state.spark.createDataFrame(row, JOURNAL.replace("timestamp", "string")).withColumn("changed_at", F.to_timestamp("changed_at"))
    return replace(state, journal=state.journal.unionByName(new))


def _one(df: DataFrame, what: str):
    row = df.first()
    if row is None:
        raise CurationError(f"{what} doesn't exist")
    return row


def create_concept(state: State, concept_id: str, scope: str, kind: str, title: str, description: str | None = None, body: str | None = None, tags: tuple[str, ...] = (), *, actor: str, now: str) -> State:
    """A curated concept of the personal store; its id must be new."""
    if not state.concepts.where(F.col("id") == concept_id).isEmpty():
        raise CurationError(f"{concept_id} exists")
    row = state.spark.range(1).select(*(F.lit(v).cast("string").alias(c) for c, v in {"id": concept_id, "store": "personal", "scope": scope, "type": kind, "title": title, "description": description, "body": body, "resource": None}.items()), F.array(*map(F.lit, tags)).cast("array<string>").alias("tags"), F.lit("active").alias("status"), F.lit(True).alias("curated"), F.lit(None).cast("string").alias("source_name"))
    row = row.withColumn("content_hash", content_hash(F.col("title"), F.col("description"), F.col("body"))).withColumn("updated_at", F.to_timestamp(F.lit(now)))
    return _noted(replace(state, concepts=state.concepts.unionByName(row)), "created", concept_id, {}, actor, now)


def patch_concept(state: State, concept_id: str, changes: dict, *, actor: str, now: str) -> State:
    """Changes of fields; content that a source owns and unknown fields are refused. The journal keeps names of fields, and of a mere change of status the one before."""
    old = _one(state.concepts.where(F.col("id") == concept_id).select("source_name", "status"), concept_id)
    if unknown := set(changes) - set(PATCHABLE):
        raise CurationError(f"unknown fields: {sorted(unknown)}")
    if old["source_name"] is not None and (locked := set(changes) & set(SOURCE_FIELDS)):
        raise CurationError(f"the source owns {sorted(locked)}")
    here = F.col("id") == concept_id
    out = state.concepts
    for name, value in changes.items():
        new = F.array(*map(F.lit, value)).cast("array<string>") if name == "tags" else F.lit(value).cast("string")
        out = out.withColumn(name, F.when(here, new).otherwise(F.col(name)))
    out = out.withColumn("content_hash", F.when(here, content_hash(F.col("title"), F.col("description"), F.col("body"))).otherwise(F.col("content_hash")))
    out = out.withColumn("curated", here | F.col("curated")).withColumn("updated_at", F.when(here, F.to_timestamp(F.lit(now))).otherwise(F.col("updated_at")))
    only_status = set(changes) == {"status"}
    return _noted(replace(state, concepts=out), "status_changed" if only_status else "updated", concept_id, {"previous_status": old["status"]} if only_status else {"fields": ",".join(sorted(changes))}, actor, now)


def locked_fields(concepts: DataFrame) -> DataFrame:
    """id, locked: the fields that only the source may change."""
    return concepts.select("id", F.when(F.col("source_name").isNotNull(), F.array(*map(F.lit, SOURCE_FIELDS))).otherwise(F.array().cast("array<string>")).alias("locked"))


def source_deleted(concepts: DataFrame, deleted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Concepts with those of ``deleted`` (id) as tombstones, curated ones too, and the ids that changed; edges stay."""
    gone = deleted.select("id").distinct().withColumn("gone", F.lit(True))
    marked = concepts.join(gone.hint("merge"), "id", "left")
    changed = marked.where("gone and status <> 'tombstone'").select("id")
    return marked.withColumn("status", F.when(F.col("gone"), F.lit("tombstone")).otherwise(F.col("status"))).select(*concepts.columns), changed


def add_edge(state: State, key: dict[str, str], *, actor: str, now: str) -> State:
    """A curated, verified edge; it takes back a rejection. Loops, doubles and edges from other stores into the personal one are refused."""
    if key["from_id"] == key["to_id"] and key["from_store"] == key["to_store"]:
        raise CurationError("an edge needs two ends")
    if key["from_store"] != key["to_store"] and key["from_store"] != "personal":
        raise CurationError("only personal concepts may point at another store")
    if not state.edges.where(_is(key)).isEmpty():
        raise CurationError("the edge exists")
    row = state.spark.range(1).select(*(F.lit(key[k]).alias(k) for k in KEY), F.lit(None).cast("double").alias("weight"), F.lit(None).cast("double").alias("confidence"), F.lit(False).alias("generated"), F.lit(True).alias("curated"), F.lit(True).alias("verified"))
    out = replace(state, edges=state.edges.unionByName(row), rejections=state.rejections.where(~_is(key)))
    return _noted(out, "edge_added", key["from_id"], key, actor, now)


def delete_edge(state: State, key: dict[str, str], *, actor: str, now: str, change: str = "edge_removed") -> State:
    """Without an edge; the journal keeps its fields."""
    row = _one(state.edges.where(_is(key)), "the edge")
    return _noted(replace(state, edges=state.edges.where(~_is(key))), change, key["from_id"], row.asDict(), actor, now)


def verify_edge(state: State, key: dict[str, str], *, actor: str, now: str) -> State:
    _one(state.edges.where(_is(key)), "the edge")
    out = state.edges
    for name in ("curated", "verified"):
        out = out.withColumn(name, F.when(_is(key), F.lit(True)).otherwise(F.col(name)))
    return _noted(replace(state, edges=out), "verified", key["from_id"], key, actor, now)


def reject_edge(state: State, key: dict[str, str], reason: str | None = None, *, actor: str, now: str) -> State:
    """Without an edge, and with a note that keeps runs from making it again."""
    out = delete_edge(state, key, actor=actor, now=now, change="rejected")
    note = state.spark.range(1).select(*(F.lit(key[k]).alias(k) for k in KEY), F.lit(reason).cast("string").alias("reason"), F.to_timestamp(F.lit(now)).alias("rejected_at"))
    return replace(out, rejections=state.rejections.where(~_is(key)).unionByName(note))


def retarget(edges: DataFrame, store: str, source: str, target: str, kind: str | None = None) -> DataFrame:
    """Edges of one concept moved to another at either end; loops go, and of equal triples the one that was there stays."""
    of_kind = F.lit(True) if kind is None else F.col("kind") == kind
    start, end = ((F.col(f"{e}_store") == store) & (F.col(f"{e}_id") == source) & of_kind for e in ("from", "to"))
    moved = edges.withColumn("moved", start | end).withColumn("from_id", F.when(start, F.lit(target)).otherwise(F.col("from_id"))).withColumn("to_id", F.when(end, F.lit(target)).otherwise(F.col("to_id")))
    rest = [c for c in edges.columns if c not in KEY]
    kept = moved.where("not moved or from_id <> to_id or from_store <> to_store").groupBy(*KEY).agg(F.min_by(F.struct(*rest), "moved").alias("r"))
    return kept.select(*KEY, "r.*").select(*edges.columns)


def _member(cluster: str, store: str, ids: DataFrame) -> DataFrame:
    return ids.select(F.lit(store).alias("from_store"), F.lit(cluster).alias("from_id"), F.lit(store).alias("to_store"), "to_id", F.lit("member").alias("kind"), F.lit(None).cast("double").alias("weight"), F.lit(None).cast("double").alias("confidence"), F.lit(False).alias("generated"), F.lit(True).alias("curated"), F.lit(True).alias("verified"))


def _pairs(cluster: str, ids: DataFrame) -> DataFrame:
    return ids.select(F.col("to_id").alias("concept_id"), F.lit(cluster).alias("cluster_id"))


def _noted_all(state: State, change: str, cluster: str, store: str, ids: DataFrame, actor: str, now: str) -> State:
    """One entry for each member, numbered on together."""
    detail = F.create_map(*(x for k, v in {"from_store": F.lit(store), "from_id": F.lit(cluster), "to_store": F.lit(store), "to_id": F.col("to_id"), "kind": F.lit("member")}.items() for x in (F.lit(k), v)))
    rows = ids.select("to_id").distinct().select(F.lit(change).alias("change"), F.col("to_id").alias("concept_id"), detail.alias("detail"), F.lit(actor).alias("actor"), F.to_timestamp(F.lit(now)).alias("changed_at"))
    return replace(state, journal=appended(state.journal, rows, "entry", ["concept_id"]))


def _member_ids(concept_ids: list[str] | DataFrame, spark: SparkSession) -> DataFrame:
    """Ids as a table: of a list, or of a table with the column id."""
    return concept_ids.select(F.col("id").alias("to_id")).distinct() if isinstance(concept_ids, DataFrame) else spark.createDataFrame([(i,) for i in concept_ids], "to_id string").distinct()


def add_members(state: State, cluster: str, store: str, concept_ids: list[str] | DataFrame, *, actor: str, now: str) -> State:
    """Members by hand, as many as there are in one go; that lifts their exclusion."""
    ids = _member_ids(concept_ids, state.spark)
    new = _member(cluster, store, ids).join(state.edges.select(*KEY), KEY, "left_anti")
    out = replace(state, edges=state.edges.unionByName(new), candidates=clusters.include(state.candidates, _pairs(cluster, ids)))
    return _noted_all(out, "cluster_assigned", cluster, store, ids, actor, now)


def remove_members(state: State, cluster: str, store: str, concept_ids: list[str] | DataFrame, *, actor: str, now: str) -> State:
    """Members out, and barred for later runs, also those that were none."""
    # written, so that Spark sees how few they are and leaves the edges where they are
    ids = checkpointed(_member_ids(concept_ids, state.spark))
    gone = _member(cluster, store, ids).select(*KEY)
    out = replace(state, edges=state.edges.join(gone, KEY, "left_anti").select(*state.edges.columns), candidates=clusters.exclude(state.candidates, _pairs(cluster, ids)))
    return _noted_all(out, "cluster_removed", cluster, store, ids, actor, now)


def create_cluster(state: State, cluster: str, store: str, scope: str, title: str, concept_ids: list[str] | DataFrame, description: str | None = None, *, actor: str, now: str) -> State:
    """A curated cluster, whose title no run changes."""
    out = create_concept(state, cluster, scope, "Cluster", title, description, actor=actor, now=now)
    out = replace(out, concepts=out.concepts.withColumn("store", F.when(F.col("id") == cluster, F.lit(store)).otherwise(F.col("store"))))
    return add_members(out, cluster, store, concept_ids, actor=actor, now=now)


def split_cluster(state: State, source: str, target: str, store: str, concept_ids: list[str] | DataFrame, title: str, *, actor: str, now: str) -> State:
    """A new curated cluster of some members of ``source``, which leave it."""
    ids = _member_ids(concept_ids, state.spark)
    found = state.edges.where((F.col("from_id") == source) & (F.col("kind") == "member")).join(ids, "to_id", "left_semi").count()
    if found != ids.count():
        raise CurationError("only members can be split off")
    scope = _one(state.concepts.where(F.col("id") == source).select("scope"), source)["scope"]
    out = create_cluster(state, target, store, scope, title, concept_ids, actor=actor, now=now)
    return remove_members(out, source, store, concept_ids, actor=actor, now=now)


def merge_clusters(state: State, store: str, source: str, target: str, *, actor: str, now: str) -> State:
    """All edges of ``source`` at ``target``, and ``source`` gone for good."""
    if source == target:
        raise CurationError("a cluster can't be merged with itself")
    for name in (source, target):
        _one(state.concepts.where((F.col("id") == name) & (F.col("type") == "Cluster")), name)
    out = replace(state, edges=retarget(state.edges, store, source, target), concepts=state.concepts.where(F.col("id") != source))
    return _noted(out, "clusters_merged", target, {"source": source}, actor, now)


def rename_cluster(state: State, cluster: str, title: str, description: str | None = None, *, actor: str, now: str) -> State:
    """Another title (and description, where one is given); the cluster counts as curated and keeps its hash."""
    here = F.col("id") == cluster
    _one(state.concepts.where(here & (F.col("type") == "Cluster")), cluster)
    out = state.concepts.withColumn("title", F.when(here, F.lit(title)).otherwise(F.col("title"))).withColumn("curated", here | F.col("curated"))
    if description is not None:
        out = out.withColumn("description", F.when(here, F.lit(description)).otherwise(F.col("description")))
    return _noted(replace(state, concepts=out), "updated", cluster, {"fields": "title" if description is None else "title,description"}, actor, now)


def undo(state: State, entry: int, *, actor: str, now: str) -> State:
    """Takes one journal entry back: edges added or removed, rejections, verifications, memberships, creations and changes of status. Content and merges stay, as the journal has no texts."""
    row = _one(state.journal.where(F.col("entry") == entry), f"entry {entry}")
    change, detail, concept = row["change"], row["detail"], row["concept_id"]
    key = {k: detail[k] for k in KEY} if all(k in detail for k in KEY) else None
    here = F.col("id") == concept
    if change in ("edge_added", "cluster_assigned") and key:
        _one(state.edges.where(_is(key)), "the edge")
        out, note, extra = replace(state, edges=state.edges.where(~_is(key))), "edge_removed", key
    elif change in ("edge_removed", "rejected", "cluster_removed") and key:
        if not state.edges.where(_is(key)).isEmpty():
            raise CurationError("the edge exists")
        number = lambda c: F.lit(detail.get(c)).cast("double").alias(c)
        flag = lambda c: F.lit(detail.get(c, "True") == "True" if c != "generated" else detail.get(c) == "True").alias(c)
        back = state.spark.range(1).select(*(F.lit(v).alias(k) for k, v in key.items()), number("weight"), number("confidence"), flag("generated"), flag("curated"), flag("verified"))
        barred = _pairs(key["from_id"], _member_ids([key["to_id"]], state.spark))
        lifted = clusters.include(state.candidates, barred) if change == "cluster_removed" else state.candidates
        out = replace(state, edges=state.edges.unionByName(back), rejections=state.rejections.where(~_is(key)), candidates=lifted)
        note, extra = "edge_added", key
    elif change == "verified" and key:
        _one(state.edges.where(_is(key)), "the edge")
        out = replace(state, edges=state.edges.withColumn("verified", F.col("verified") & ~_is(key)))
        note, extra = "verification_removed", key
    elif change == "created":
        _one(state.concepts.where(here), concept)
        out, note, extra = replace(state, concepts=state.concepts.where(~here)), "status_changed", {"deleted": True}
    elif change == "status_changed" and "previous_status" in detail:
        now_status = _one(state.concepts.where(here).select("status"), concept)["status"]
        out = replace(state, concepts=state.concepts.withColumn("status", F.when(here, F.lit(detail["previous_status"])).otherwise(F.col("status"))))
        note, extra = "status_changed", {"previous_status": now_status}
    else:
        raise CurationError(f"a change of kind {change} can't be taken back")
    return _noted(out, note, concept, extra | {"undo_of": entry}, actor, now)


#: Entries that made an edge, and those that took one away.
MADE, TAKEN = ("edge_added", "cluster_assigned"), ("edge_removed", "rejected", "cluster_removed")


def undo_all(state: State, entries: DataFrame, *, actor: str, now: str, noted: bool = True) -> State:
    """Takes many journal entries (``entry``) back at once, as ``undo`` does from the newest to the oldest; one join for all of them.

    Whether an edge is there in the end, and with which fields, follows from its oldest entry that made
    or removed it, as that one is undone last. Entries of one edge have to fit each other and what is
    there now. Contents, merges and whatever else ``undo`` refuses are refused here, and nothing is undone.
    The journal gets an entry for each, unless it is not ``noted``.
    """
    asked = entries.select("entry").distinct()
    found = checkpointed(state.journal.join(asked, "entry"))
    keyed = reduce(lambda a, b: a & b, (F.col("detail")[k].isNotNull() for k in KEY))
    made, taken = F.col("change").isin(*MADE) & keyed, F.col("change").isin(*TAKEN) & keyed
    verified, created = (F.col("change") == "verified") & keyed, F.col("change") == "created"
    status = (F.col("change") == "status_changed") & F.col("detail")["previous_status"].isNotNull()
    wrong = found.where(~F.coalesce(made | taken | verified | created | status, F.lit(False))).agg(F.count("*"), F.min("change")).first()
    if asked.count() != found.count() or wrong[0]:
        raise CurationError(f"a change of kind {wrong[1]} can't be taken back" if wrong[0] else "an entry doesn't exist")

    # edges: places of entries on the way back, and whether the edge is there before each of them is undone
    on_edges = found.where(made | taken | verified).select(*(F.col("detail")[k].alias(k) for k in KEY), "entry", "detail", made.alias("goes"), taken.alias("comes"))
    there = state.edges.select(*KEY).join(on_edges.select(*KEY).distinct(), KEY, "left_semi").distinct().withColumn("now", F.lit(True))
    back = Window.partitionBy(*KEY).orderBy(F.desc("entry"))
    steps = on_edges.join(there, KEY, "left").withColumn("present", F.coalesce(F.last(F.when(F.col("goes"), False).when(F.col("comes"), True), True).over(back.rowsBetween(Window.unboundedPreceding, -1)), "now", F.lit(False)))
    if not steps.where(F.col("present") == F.col("comes")).isEmpty():
        raise CurationError("an edge that should be there is missing, or one that shouldn't be is there")
    ends = checkpointed(steps.groupBy(*KEY).agg(
        F.min(F.when(F.col("goes") | F.col("comes"), F.col("entry"))).alias("oldest"),
        F.min_by(F.struct("comes", "detail"), F.when(F.col("goes") | F.col("comes"), F.col("entry"))).alias("to"),
        F.min(F.when(~F.col("goes") & ~F.col("comes"), F.col("entry"))).alias("unverified"),
    ))
    number = lambda c: F.col("to.detail")[c].cast("double").alias(c)
    flag = lambda c, d: (F.coalesce(F.col("to.detail")[c], F.lit(d)) == "True").alias(c)
    still = F.col("unverified").isNull() | (F.col("unverified") > F.col("oldest"))
    new = ends.where("to.comes").select(*KEY, number("weight"), number("confidence"), flag("generated", "False"), flag("curated", "True"), (flag("verified", "True") & still).alias("verified"))
    kept = state.edges.join(ends.select(*KEY, "oldest", "unverified"), KEY, "left").where("oldest is null").withColumn("verified", F.col("verified") & F.col("unverified").isNull())
    returned = on_edges.where("comes").select(*KEY).distinct()
    lifted = on_edges.where("comes").join(found.where("change = 'cluster_removed'").select("entry"), "entry", "left_semi").select(F.col("to_id").alias("concept_id"), F.col("from_id").alias("cluster_id")).distinct()

    # concepts: those that were made go, a status is that before its oldest change
    gone = found.where(created).select(F.col("concept_id").alias("id")).distinct()
    before = found.where(status).groupBy(F.col("concept_id").alias("id")).agg(F.min_by(F.col("detail")["previous_status"], "entry").alias("was"))
    named = gone.unionAll(before.select("id")).distinct()
    if not named.join(state.concepts.select("id"), "id", "left_anti").isEmpty():
        raise CurationError("a concept doesn't exist")
    concepts = state.concepts.join(gone, "id", "left_anti").join(before, "id", "left").withColumn("status", F.coalesce("was", "status")).select(*state.concepts.columns)
    out = replace(state, concepts=concepts, edges=kept.select(*state.edges.columns).unionByName(new.select(*state.edges.columns)), rejections=state.rejections.join(returned, KEY, "left_anti").select(*state.rejections.columns), candidates=clusters.include(state.candidates, lifted).select(*state.candidates.columns))
    if not noted:
        return out
    note = F.when(F.col("change").isin(*MADE), "edge_removed").when(F.col("change").isin(*TAKEN), "edge_added").when(F.col("change") == "verified", "verification_removed").otherwise("status_changed")
    later = F.last("was", ignorenulls=True).over(Window.partitionBy("concept_id").orderBy(F.desc("entry")).rowsBetween(Window.unboundedPreceding, -1))
    statuses = found.withColumn("was", F.when(status, F.col("detail")["previous_status"])).join(state.concepts.groupBy(F.col("id").alias("concept_id")).agg(F.min("status").alias("current")), "concept_id", "left").withColumn("then", F.when(status, F.coalesce(later, "current")))
    of = F.create_map(F.lit("undo_of"), F.col("entry").cast("string"))
    edge = F.map_filter("detail", lambda k, _: k.isin(*KEY))
    detail = F.when(F.col("change") == "created", F.map_concat(of, F.create_map(F.lit("deleted"), F.lit("True")))).when(F.col("then").isNotNull(), F.map_concat(of, F.create_map(F.lit("previous_status"), F.col("then")))).otherwise(F.map_concat(of, edge))
    rows = statuses.select(F.lit(0).cast("long").alias("entry"), note.alias("change"), "concept_id", detail.alias("detail"), F.lit(actor).alias("actor"), F.to_timestamp(F.lit(now)).alias("changed_at"))
    return replace(out, journal=appended(state.journal, rows, "entry", [F.col("detail")["undo_of"].cast("long").desc()]))


def as_of(state: State, entry: int) -> State:
    """The state after ``entry``: all later ones taken back, of which nothing is noted and which the journal no longer has."""
    later = state.journal.where(F.col("entry") > entry).select("entry")
    return replace(undo_all(state, later, actor="", now="1970-01-01", noted=False), journal=state.journal.where(F.col("entry") <= entry))


def history(journal: DataFrame, concept_id: str | None = None, limit: int = 100) -> DataFrame:
    """Entries of a concept or of all, newest first."""
    rows = journal if concept_id is None else journal.where(F.col("concept_id") == concept_id)
    return rows.orderBy(F.desc("changed_at"), F.desc("entry")).limit(limit)


def attach(edges: DataFrame, store: str, found: DataFrame) -> DataFrame:
    """Open edges pointed at the store in which their target (id) has turned up, unless the same edge is there already. Only personal edges may leave their store, so those of other stores stay as they are."""
    there = found.select(F.col("id").alias("to_id")).distinct().withColumn("there", F.lit(True))
    move = ~F.col("resolved") & (F.col("to_store") != store) & F.col("from_store").isin("personal", store) & F.coalesce("there", F.lit(False))
    marked = edges.join(there.hint("merge"), "to_id", "left").withColumn("moved", move).withColumn("to_store", F.when(F.col("moved"), F.lit(store)).otherwise(F.col("to_store"))).withColumn("resolved", F.col("resolved") | F.col("moved"))
    rest = [c for c in edges.columns if c not in KEY]
    return marked.groupBy(*KEY).agg(F.min_by(F.struct(*rest), "moved").alias("r")).select(*KEY, "r.*").select(*edges.columns)
