"""Small reads: concepts, edges, vectors and candidates by key, in their orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noema.operators import vectors as V


def many(concepts: DataFrame, ids: DataFrame) -> DataFrame:
    """Concepts with one of ``ids`` (id), in no order; a tombstone is one too."""
    return concepts.join(ids.select("id").distinct(), "id", "left_semi")


def existing(concepts: DataFrame, ids: DataFrame) -> DataFrame:
    """Those of ``ids`` that concepts have, tombstones as well."""
    return ids.select("id").distinct().join(concepts.select("id"), "id", "left_semi")


def resolvable(concepts: DataFrame, ids: DataFrame) -> DataFrame:
    """Those of ``ids`` that living concepts have."""
    return existing(concepts.where("status <> 'tombstone'"), ids)


def without(concepts: DataFrame, ids: DataFrame) -> DataFrame:
    """Concepts without ``ids``: a hard delete."""
    return concepts.join(ids.select("id"), "id", "left_anti")


def outgoing(edges: DataFrame, store: str, concept_id: str) -> DataFrame:
    return edges.where((F.col("from_store") == store) & (F.col("from_id") == concept_id)).orderBy("kind", "to_id")


def incoming(edges: DataFrame, store: str, concept_id: str) -> DataFrame:
    """Edges of a store into one of its own concepts; those of other stores are bridges."""
    return edges.where((F.col("from_store") == store) & (F.col("to_store") == store) & (F.col("to_id") == concept_id)).orderBy("kind", "from_id")


def edge_counts(edges: DataFrame) -> DataFrame:
    """Number of edges of each store: store, n."""
    return edges.groupBy(F.col("from_store").alias("store")).agg(F.count("*").alias("n"))


def vector_counts(embeddings: DataFrame, concepts: DataFrame) -> DataFrame:
    """Number of vectors by model and scope, those of tombstones too: model_key, scope, n."""
    return embeddings.join(concepts.select("id", "scope"), "id").groupBy("model_key", "scope").agg(F.count("*").alias("n"))


def vector_of(embeddings: DataFrame, concept_id: str, model: str) -> list[float] | None:
    row = embeddings.where((F.col("id") == concept_id) & (F.col("model_key") == model)).select("vector").first()
    return None if row is None else list(row[0])


def centroid_list(centroids: DataFrame, model: str) -> DataFrame:
    return centroids.where(F.col("model_key") == model).orderBy("cluster_id")


def candidates(pairs: DataFrame, least: int = 1) -> DataFrame:
    """Candidates of memberships that were seen in ``least`` runs: most seen first, then by score."""
    return pairs.where((F.col("seen") >= least) & ~F.col("excluded")).orderBy(F.desc("seen"), F.desc("score"), "concept_id", "cluster_id")


def exclusions(pairs: DataFrame) -> DataFrame:
    return pairs.where("excluded").select("concept_id", "cluster_id").distinct()


def near(embeddings: DataFrame, concepts: DataFrame, vector: list[float], model: str, limit: int = 20, scope: str | None = None, exclude: DataFrame | None = None, least: float | None = None) -> DataFrame:
    """Living concepts by their vectors of one model, in a scope and without some ids: the ``limit`` nearest, of which those at ``least`` or more: id, similarity."""
    living = concepts.where("status <> 'tombstone'")
    if scope is not None:
        living = living.where(F.col("scope") == scope)
    rows = embeddings.where(F.col("model_key") == model).select("id", "vector").join(living.select("id"), "id", "left_semi")
    if exclude is not None:
        rows = rows.join(exclude.select("id"), "id", "left_anti")
    return V.search(rows, vector, limit, least)


def similar(embeddings: DataFrame, concepts: DataFrame, concept_id: str, model: str, limit: int = 20) -> DataFrame:
    """The concepts nearest to one, itself left out; none without a vector."""
    own = vector_of(embeddings, concept_id, model)
    alone = concepts.sparkSession.createDataFrame([(concept_id,)], "id string")
    return near(embeddings, concepts, own or [0.0], model, limit if own else 0, exclude=alone)


def _json(rows: DataFrame, leave: tuple[str, ...] = ()) -> Column:
    """All columns but some as JSON, nulls too; times as ISO texts in UTC and decimals as numbers."""
    kinds = dict(rows.dtypes)
    fields = [F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias(c) if kinds[c] == "timestamp" else F.col(c).cast("double").alias(c) if kinds[c].startswith("decimal") else F.col(c) for c in rows.columns if c not in leave]
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("json")


def serialised(concepts: DataFrame) -> DataFrame:
    """Concepts as JSON for an answer, without bodies: id, json."""
    return concepts.select("id", _json(concepts, ("body",)))


def serialised_edges(edges: DataFrame) -> DataFrame:
    """Edges as JSON for an answer: their key, json."""
    key = ("from_store", "from_id", "to_store", "to_id", "kind")
    return edges.select(*key, _json(edges))


def serialised_entries(journal: DataFrame) -> DataFrame:
    """Entries of a journal as JSON for an answer: entry, json. Their details stay an object."""
    return journal.select("entry", _json(journal))
