"""Lexical, vector and hybrid search with reciprocal rank fusion."""

from __future__ import annotations

import unicodedata
from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from noema.functions.scalars import text_rank, text_words, trigram_similarity, trigrams
from noema.operators import text_index
from noema.operators import vectors as V
from noema.operators.text_index import TextIndex


def query_words(query: str) -> list[str]:
    """Different words of a query, cut as those of texts: runs of letters and digits."""
    return sorted({"".join(run) for letters, run in groupby(query.lower(), lambda c: unicodedata.category(c)[0] in "LN") if letters})


def full_text(concepts: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """Living concepts whose title, description and body (if there is one) have all words of the query: id, score, rank. The score is ``scalars.text_rank``; every text is read, where ``text_index`` reads the entries of the query's words."""
    wanted = query_words(query)
    words = text_words(F.concat_ws(" ", *(c for c in ("title", "description", "body") if c in concepts.columns)))
    rows = concepts.where("status <> 'tombstone'").withColumn("words", words)
    for word in wanted:
        rows = rows.where(F.array_contains("words", word))
    if not wanted:
        rows = rows.limit(0)
    at = F.transform("words", lambda w, k: F.struct(w.alias("w"), F.least(k + 1, F.lit(text_index.LAST)).alias("k")))
    places = F.array(*(_places(at, word) for word in wanted or [""]))
    best = rows.select("id", text_rank(places).alias("score")).orderBy(F.desc("score"), "id").limit(limit)
    return best.withColumn("rank", F.row_number().over(W.orderBy(F.desc("score"), "id")))


def _places(at: Column, word: str) -> Column:
    return F.slice(F.array_distinct(F.transform(F.filter(at, lambda x: x["w"] == word), lambda x: x["k"])), 1, text_index.PLACES)


def by_trigrams(concepts: DataFrame, query: str, limit: int = 20, least: float = 0.3) -> DataFrame:
    """Living concepts with a title like the query: id, similarity, rank."""
    rows = concepts.where("status <> 'tombstone'").select("id", trigram_similarity(trigrams(F.col("title")), trigrams(F.lit(query))).alias("similarity"))
    best = rows.where(F.col("similarity") >= least).orderBy(F.desc("similarity"), "id").limit(limit)
    return best.withColumn("rank", F.row_number().over(W.orderBy(F.desc("similarity"), "id")))


def fused(lists: list[DataFrame], limit: int = 20, k: int = 60) -> DataFrame:
    """Ranked lists (id, rank) of bounded length as one: id, score (the sum of 1 / (k + rank))."""
    rows = lists[0].select("id", "rank")
    for other in lists[1:]:
        rows = rows.unionAll(other.select("id", "rank"))
    return rows.groupBy("id").agg(F.round(F.sum(F.lit(1.0) / (F.lit(k) + F.col("rank"))), 9).alias("score")).orderBy(F.desc("score"), "id").limit(limit)


def query_grams(query: str) -> list[str]:
    """Trigrams of a query, cut as those of titles."""
    return sorted({f"  {w} "[k : k + 3] for w in query_words(query) for k in range(len(w) + 1)})


def lexical(concepts: DataFrame, query: str, limit: int = 20, index: TextIndex | None = None) -> DataFrame:
    """Full text and trigrams fused; a blank query finds nothing. With an ``index`` (of the same concepts), only its entries for the query are read."""
    if index is not None:
        return fused([index.search(query_words(query), limit), index.similar(query_grams(query), limit=limit)], limit)
    return fused([full_text(concepts, query, limit), by_trigrams(concepts, query, limit)], limit)


def hybrid(concepts: DataFrame, vectors: DataFrame, query: str, vector: list[float], limit: int = 20, index: TextIndex | None = None) -> DataFrame:
    """Lexical and vector search fused by their ranks: id, score."""
    found = lexical(concepts, query, limit, index)
    words = found.withColumn("rank", F.row_number().over(W.orderBy(F.desc("score"), "id")))
    near = V.search(vectors.join(concepts.where("status <> 'tombstone'").select("id"), "id", "left_semi"), vector, limit)
    return fused([words, near.withColumn("rank", F.row_number().over(W.orderBy(F.desc("similarity"), "id")))], limit)


def staged(concepts: DataFrame, vectors: DataFrame, centroids: DataFrame, query: str, vector: list[float] | None, limit: int = 20, granularity: str | None = None, least: float = 0.7, index: TextIndex | None = None) -> DataFrame:
    """Clusters if the query lies near enough to a centroid (id, vector), else concepts: stage, id, score. Without a vector the search is lexical; ``granularity`` (cluster, concept) forces a stage, and that of clusters finds nothing where none is near enough."""
    if vector is None:
        return lexical(concepts, query, limit, index).select(F.lit("lexical").alias("stage"), "id", "score")
    if granularity != "concept":
        near = V.search(centroids, vector, limit, least)
        if granularity == "cluster" or not near.isEmpty():
            return near.select(F.lit("cluster").alias("stage"), "id", F.round("similarity", 9).alias("score"))
    return hybrid(concepts, vectors, query, vector, limit, index).select(F.lit("concept").alias("stage"), "id", "score")
