"""The eight tools of an agent over a graph: bounded answers as dictionaries."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noema.operators import catalogue, clusters, curation, search, text_index, traverse

#: Fields that a shortened answer keeps, and characters counted as a token.
KEPT, TOKEN = ("id", "store", "scope", "type"), 4


def capped(answer: dict, tokens: int = 4000) -> dict:
    """An answer of at most ``tokens``: lists lose their tails (one item stays), then texts are cut to one common length; what names a concept stays. A shortened answer says ``truncated``."""
    most = tokens * TOKEN
    size = lambda a: len(json.dumps(a, ensure_ascii=False, default=str))
    if size(answer) <= most:
        return answer
    out = dict(answer)
    for name in [k for k, v in out.items() if isinstance(v, list) and len(v) > 1]:
        items, low, high = out[name], 1, len(out[name])
        while low < high:  # the longest head that fits
            middle = (low + high + 1) // 2
            low, high = (middle, high) if size(out | {name: items[:middle]}) <= most else (low, middle - 1)
        out[name] = items[:low]
    texts = {k: len(v) for k, v in out.items() if isinstance(v, str) and k not in KEPT}
    room = most - size(out | dict.fromkeys(texts, ""))
    return out | {k: out[k][: _level(list(texts.values()), room)] for k in texts} | {"truncated": True}


def _level(lengths: list[int], room: int) -> int:
    """The largest common length at which texts of these lengths, each cut to it, take no more than ``room``."""
    left, open_ = max(0, room), len(lengths)
    for n in sorted(lengths):
        if n * open_ > left:
            return left // open_
        left, open_ = left - n, open_ - 1
    return max(lengths, default=0)


@dataclass
class Service:
    """Tools over a state; edits replace the state, reads collect at most a page."""

    state: curation.State
    vectors: DataFrame | None = None
    tokens: int = 4000
    page: int = 50
    kinds: tuple[str, ...] = field(default=("member", "related", "references", "depends_on", "implements"))
    stores: tuple[str, ...] = ("shared", "personal")
    #: The store of each scope, and the types that may be written.
    scopes: dict[str, str] = field(default_factory=dict)
    types: tuple[str, ...] = ()
    #: What turns a query into a vector, the clusters' centroids (id, vector), and a stored index of words.
    embed: Callable[[str], list[float]] | None = None
    centroids: DataFrame | None = None
    index: text_index.TextIndex | None = None

    def _answer(self, **values) -> dict:
        return capped(values, self.tokens)

    def _rows(self, df: DataFrame) -> list[dict]:
        return [r.asDict(True) for r in df.collect()]

    def graph_schema(self) -> dict:
        """The rules: stores and who may write them, scopes with their store, kinds of edges (those that aren't semantic are structural), types, limits, and what there is of each."""
        counts = catalogue.counts(self.state.concepts).orderBy("scope", "type", "status").limit(self.page)
        stores = [{"name": s, "writable": s == "personal"} for s in self.stores]
        scopes = [{"name": n, "store": s} for n, s in sorted(self.scopes.items())]
        kinds = [{"name": k, "structural": k in ("member", "related")} for k in self.kinds]
        return self._answer(stores=stores, scopes=scopes, types=list(self.types), kinds=kinds, counts=self._rows(counts), max_hops=traverse.MAX_HOPS, max_nodes=traverse.MAX_NODES, tokens=self.tokens)

    def graph_overview(self, cursor: str | None = None) -> dict:
        rows = self._rows(catalogue.page(catalogue.member_counts(self.state.concepts, self.state.edges), self.page, cursor))
        following = rows[0]["next_cursor"] if rows else None
        return self._answer(clusters=[{k: v for k, v in r.items() if k != "next_cursor"} for r in rows], next_cursor=following)

    def graph_traverse(self, start: str, now: str, hops: int = 1, store: str = "personal") -> dict:
        one = self.state.spark.createDataFrame([(store, start)], "store string, id string")
        try:
            found = traverse.traverse(self.state.concepts, self.state.edges, one, now, hops)
        except LookupError as missing:
            raise curation.CurationError(f"{start} doesn't exist in {store}") from missing
        return self._answer(hops=hops, limited=found.truncated, nodes=self._rows(found.nodes), edges=self._rows(found.edges))

    def graph_search(self, query: str, limit: int = 20, *, scope: str | None = None, store: str | None = None, granularity: str | None = None) -> dict:
        """Search in two stages over a store, that of ``scope`` if one is named, or over all: clusters near the query, else concepts; by words alone where nothing turns a query into a vector."""
        if granularity not in (None, "cluster", "concept"):
            raise curation.CurationError(f"unknown granularity {granularity}")
        if scope is not None:
            if scope not in self.scopes:
                raise curation.CurationError(f"unknown scope {scope}")
            store = self.scopes[scope]
        concepts = self.state.concepts if store is None else self.state.concepts.where(F.col("store") == store)
        vector = self.embed(query) if self.embed is not None and self.vectors is not None else None
        nothing = self.state.spark.createDataFrame([], "id string, vector array<double>")
        centroids, vectors = (nothing if df is None else df if store is None else df.join(concepts.select("id"), "id", "left_semi") for df in (self.centroids, self.vectors))
        index = self.index if store is None else None  # the index is over all stores
        hits = self._rows(search.staged(concepts, vectors, centroids, query, vector, limit, granularity, index=index))
        stage = hits[0]["stage"] if hits else granularity or "lexical"
        more = {"next_step": "no cluster is near enough; ask again with granularity concept"} if not hits and granularity == "cluster" else {}
        return self._answer(query=query, store=store, stage=stage, hits=hits, **more)

    def concept_get(self, store: str, concept_id: str) -> dict:
        found = self.state.concepts.where((F.col("store") == store) & (F.col("id") == concept_id)).limit(1)
        row = found.first()
        if row is None:
            raise curation.CurationError(f"{concept_id} doesn't exist")
        edges = catalogue.detail(self.state.edges, found).orderBy("role", "kind", "other").limit(self.page)
        return self._answer(**row.asDict(True), edges=self._rows(edges.select("role", "kind", "other_store", "other")))

    def concept_upsert(self, concept_id: str, scope: str, kind: str, title: str, *, actor: str, now: str, **more) -> dict:
        here = self.state.concepts.where(F.col("id") == concept_id).select("store").first()
        if here is None:
            self.state = curation.create_concept(self.state, concept_id, scope, kind, title, actor=actor, now=now, **more)
        elif here["store"] != "personal":
            raise curation.CurationError("only personal concepts may be written")
        else:
            self.state = curation.patch_concept(self.state, concept_id, {"title": title, **more}, actor=actor, now=now)
        return self._answer(id=concept_id, outcome="created" if here is None else "updated")

    def link_add(self, from_id: str, to_id: str, kind: str, to_store: str = "shared", *, actor: str, now: str) -> dict:
        if kind not in self.kinds:
            raise curation.CurationError(f"unknown kind {kind}")
        key = {"from_store": "personal", "from_id": from_id, "to_store": to_store, "to_id": to_id, "kind": kind}
        self.state = curation.add_edge(self.state, key, actor=actor, now=now)
        return self._answer(**key)

    def cluster_project(self, scope: str, name: str) -> dict:
        """A clustering run over a scope's vectors; its groups by size, memberships unwritten."""
        inside = self.vectors.join(catalogue.in_scope(self.state.concepts, scope).where("type <> 'Cluster'").select("id"), "id", "left_semi")
        members = self.state.edges.where("kind = 'member'").select(F.col("from_id").alias("cluster_id"), F.col("to_id").alias("concept_id"))
        found = clusters.run(inside, members, self.state.candidates, name)
        sizes = found.groups.groupBy("cluster_id").agg(F.count("*").alias("size")).orderBy(F.desc("size"), "cluster_id").limit(self.page)
        return self._answer(scope=scope, clusters=self._rows(sizes))
