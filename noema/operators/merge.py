"""Keyed merges: concepts from drafts, edges from references, and the journal of what changed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noema.functions.scalars import content_hash

#: Fields that a source owns.
CONTENT = ("title", "description", "body", "tags")


def reconcile(current: DataFrame, wanted: DataFrame, rejected: DataFrame | None = None) -> DataFrame:
    """Edges to add, keep and remove so that ``current`` becomes ``wanted``: from_id, to_id, kind, action. Generated edges that were rejected are not added; curated edges are not removed."""
    key = ["from_id", "to_id", "kind"]
    want = wanted.where("from_id <> to_id").select(*key).distinct()
    if rejected is not None:
        want = want.join(rejected.select(*key).distinct(), key, "left_anti")
    both = current.select(*key, F.col("curated")).withColumn("here", F.lit(True)).join(want.withColumn("asked", F.lit(True)), key, "full_outer")
    action = F.when(F.col("here").isNull(), "add").when(F.col("asked").isNotNull() | F.col("curated"), "keep").otherwise("remove")
    return both.select(*key, action.alias("action"))


def resolve_targets(references: DataFrame, concepts: DataFrame, priority: list[str]) -> DataFrame:
    """The store of each referenced id: own store first, then in the order of ``priority``; without a living concept the own store, unresolved: from_store, to_id, to_store, resolved."""
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, priority)), F.col("store")), F.lit(0))
    living = concepts.where("status <> 'tombstone'").select(F.col("id").alias("to_id"), "store")
    found = references.join(living.hint("merge"), "to_id", "left").withColumn("order", F.when(F.col("store") == F.col("from_store"), 0).when(rank > 0, rank).otherwise(len(priority) + 1))
    may = F.col("store").isNull() | (F.col("store") == F.col("from_store")) | (F.col("from_store") == "personal")
    found = found.withColumn("store", F.when(may, F.col("store")))
    best = found.groupBy("from_store", "to_id").agg(F.min_by("store", F.when(F.col("store").isNotNull(), F.col("order"))).alias("store"))
    return best.select("from_store", "to_id", F.coalesce("store", "from_store").alias("to_store"), F.col("store").isNotNull().alias("resolved"))


def cursor_filter(documents: DataFrame, since: str | None) -> DataFrame:
    """Documents changed after the cursor; those without a time always pass."""
    return documents if since is None else documents.where(F.col("updated_at").isNull() | (F.col("updated_at") > F.to_timestamp(F.lit(since))))


def merged(existing: DataFrame, drafts: DataFrame, now: str, mirrored: bool = False) -> DataFrame:
    """Concepts after a merge of drafts: every column of ``existing``, and outcome (created, unchanged, updated, conflict; null for concepts without a draft), held_back, verification_reset.

    Both sides: id, store, scope, type, title, description, body, resource, tags, status, source_name;
    ``existing`` also curated, verified, content_hash, updated_at. Of several drafts of one id the
    first by content hash counts. Content that hasn't changed changes nothing, unless a source
    brings a tombstone back. Content of a curated concept is held back from a source that isn't
    mirrored; a tombstone always wins, another status only over what isn't curated; tags are the
    union in order. A row of which nothing changes keeps its time. One equi-join on id.
    """
    fields = ["store", "scope", "type", "title", "description", "body", "resource", "tags", "status", "source_name"]
    own = [*fields, "curated", "verified", "content_hash", "updated_at"]
    hashed = drafts.select("id", *fields, content_hash(F.col("title"), F.col("description"), F.col("body")).alias("content_hash"))
    new = hashed.groupBy("id").agg(F.min_by(F.struct(*fields, "content_hash"), F.struct("content_hash", F.struct(*fields))).alias("n"))
    rows = existing.select("id", F.struct(*own).alias("o")).join(new, "id", "full_outer")
    o, n = (lambda c: F.col(f"o.{c}")), (lambda c: F.col(f"n.{c}"))
    there, asked, sourced = F.col("o").isNotNull(), F.col("n").isNotNull(), n("source_name").isNotNull()
    back = (o("status") == "tombstone") & sourced & (n("status") != "tombstone")
    same = there & asked & (o("content_hash") == n("content_hash")) & ~back
    guard = there & o("curated") & sourced & F.lit(not mirrored)
    stays = (n("status") != "tombstone") & (o("status") != n("status")) & o("curated") & sourced
    touched = there & asked & ~same
    held = F.array_compact(F.array(*(F.when(guard & ~o(c).eqNullSafe(n(c)), F.lit(c)) for c in ("title", "description", "body", "resource")), F.when(stays, F.lit("status"))))
    pick = lambda c, keep: F.when(touched & ~keep, n(c)).when(there, o(c)).otherwise(n(c))
    rows = rows.withColumn("held", F.when(touched, held).otherwise(F.array().cast("array<string>")))
    values = {c: pick(c, guard) for c in fields}
    values["store"] = F.coalesce(o("store"), n("store"))
    values["source_name"] = F.when(touched, n("source_name")).otherwise(F.when(there, o("source_name")).otherwise(n("source_name")))
    values["status"] = pick("status", stays)
    values["tags"] = F.when(touched, F.array_distinct(F.concat(F.coalesce(o("tags"), F.array().cast("array<string>")), F.coalesce(n("tags"), F.array().cast("array<string>"))))).when(there, o("tags")).otherwise(n("tags"))
    values["curated"] = F.coalesce(o("curated"), F.lit(False))
    values["content_hash"] = pick("content_hash", guard)
    reset = touched & F.coalesce(o("verified"), F.lit(False)) & ~guard & (o("content_hash") != n("content_hash"))
    values["verified"] = F.coalesce(o("verified"), F.lit(False)) & ~reset
    outcome = F.when(~asked, F.lit(None)).when(~there, "created").when(same, "unchanged").when(F.size("held") > 0, "conflict").otherwise("updated")
    rows = rows.select("id", "o", *(v.alias(c) for c, v in values.items()), outcome.alias("outcome"), F.col("held").alias("held_back"), reset.alias("verification_reset"))
    differs = F.lit(False)
    for c in values:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"o.{c}"))
    return rows.withColumn("updated_at", F.when(differs, F.to_timestamp(F.lit(now))).otherwise(F.col("o.updated_at"))).select("id", *own, "outcome", "held_back", F.coalesce("verification_reset", F.lit(False)).alias("verification_reset"))
