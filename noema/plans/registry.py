"""The registered queries of the knowledge-graph engine, each with the DuckDB text that it is held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noema.functions import scalars
from noema.operators import catalogue, incremental, merge, search, text_index, traverse, vector_index, vectors
from noema.operators.common import checkpointed, scratch
from noema.plans import edits, graph, runs, tables
from noema.plans.registration import ORACLES, QUERIES, Query, query

NOW = "1998-08-02 00:00:00"


@query(" SELECT scope, type, status, count(*) AS n FROM concepts GROUP BY ALL")
def inventory_counts(spark, sf_dir):
    return catalogue.counts(graph.load(spark, sf_dir)[0])


@query(" SELECT store, scope, type, status, count(*) AS n FROM concepts GROUP BY GROUPING SETS ((store), (store, scope), (store, type), (store, status))")
def store_stats(spark, sf_dir):
    return catalogue.stats(graph.load(spark, sf_dir)[0])


@query(" SELECT id, type, title FROM concepts c WHERE status <> 'tombstone' AND scope = 'catalog' AND type = 'Part' AND curated AND (contains(lower(title), 'a') OR contains(lower(coalesce(description, '')), 'a'))")
def faceted_filter(spark, sf_dir):
    c, e = graph.load(spark, sf_dir)
    return catalogue.faceted(c, e, scope="catalog", types=["Part"], curated=True, text="A").select("id", "type", "title")


@query(" SELECT id, title FROM concepts WHERE status <> 'tombstone' AND scope = 'geo' AND id IN (SELECT to_id FROM edges WHERE kind = 'member' AND from_id = 'region:1')")
def cluster_facet(spark, sf_dir):
    c, e = graph.load(spark, sf_dir)
    return catalogue.faceted(c, e, scope="geo", cluster="region:1").select("id", "title")


@query(" SELECT scope, type, count(*) AS n FROM concepts WHERE status <> 'tombstone' AND id NOT IN (SELECT to_id FROM edges WHERE kind = 'member') GROUP BY ALL")
def orphan_facet(spark, sf_dir):
    c, e = graph.load(spark, sf_dir)
    return catalogue.faceted(c, e, orphan=True).groupBy("scope", "type").agg(F.count("*").alias("n"))


@query(" SELECT id, title FROM concepts WHERE scope = 'geo' AND status <> 'tombstone' AND type = 'Nation'")
def scope_scan(spark, sf_dir):
    return catalogue.in_scope(graph.load(spark, sf_dir)[0], "geo", "Nation").select("id", "title")


@query(", p AS (SELECT id, title FROM concepts WHERE scope = 'catalog' AND status <> 'tombstone' AND id > 'part:2' ORDER BY id LIMIT 51), k AS (SELECT *, row_number() OVER (ORDER BY id) AS n, count(*) OVER () AS a FROM p) SELECT id, title, CASE WHEN a > 50 THEN max(CASE WHEN n = 50 THEN id END) OVER () END AS next_cursor FROM k QUALIFY n <= 50")
def keyset_page(spark, sf_dir):
    c, _ = graph.load(spark, sf_dir)
    return catalogue.page(catalogue.in_scope(c, "catalog"), 50, "part:2").select("id", "title", "next_cursor")


@query(", p AS (SELECT id FROM concepts WHERE scope IN ('geo', 'catalog') AND status <> 'tombstone'), i AS (SELECT * FROM edges WHERE from_store = to_store AND from_id IN (SELECT id FROM p) AND to_id IN (SELECT id FROM p)), d AS (SELECT id, count(*) AS n FROM (SELECT from_id AS id FROM i UNION ALL SELECT to_id FROM i) GROUP BY id) SELECT p.id, coalesce(n, 0) AS degree FROM p LEFT JOIN d USING (id)")
def map_degrees(spark, sf_dir):
    c, e = graph.load(spark, sf_dir)
    return catalogue.graph_map(c.where("scope in ('geo', 'catalog') and status <> 'tombstone'"), e).select("id", "degree")


@query(" SELECT from_id, to_id, kind FROM edges WHERE from_id IN ('part:1', 'part:2', 'nation:3') OR to_id IN ('part:1', 'part:2', 'nation:3')")
def neighbourhood_edges(spark, sf_dir):
    _, e = graph.load(spark, sf_dir)
    ids = spark.createDataFrame([("part:1",), ("part:2",), ("nation:3",)], "id string")
    return catalogue.neighbourhood(e, ids).select("from_id", "to_id", "kind")


@query(" SELECT to_id, count(*) AS n FROM edges WHERE to_store = 'shared' AND from_store <> 'shared' AND to_id IN (SELECT id FROM concepts WHERE scope = 'geo') GROUP BY to_id")
def bridge_edges(spark, sf_dir):
    c, e = graph.load(spark, sf_dir)
    return catalogue.bridges_into(e, "shared", c.where("scope = 'geo'")).groupBy("to_id").agg(F.count("*").alias("n"))


@query(" SELECT DISTINCT to_store, to_id FROM edges WHERE from_store <> to_store")
def foreign_targets(spark, sf_dir):
    return catalogue.foreign_targets(graph.load(spark, sf_dir)[1])


@query(" SELECT least(from_id, to_id) AS low, greatest(from_id, to_id) AS high, array_to_string(list_sort(list_distinct(list(kind))), ',') AS kinds FROM edges WHERE kind <> 'depends_on' GROUP BY ALL")
def kinds_between(spark, sf_dir):
    return catalogue.kinds_between(graph.load(spark, sf_dir)[1].where("kind <> 'depends_on'")).withColumn("kinds", F.array_join("kinds", ","))


@query(", d AS (SELECT id, count(*) AS n FROM (SELECT from_id AS id FROM edges WHERE kind <> 'member' UNION ALL SELECT to_id FROM edges WHERE kind <> 'member') GROUP BY id) SELECT c.store, c.id, coalesce(n, 0) AS semantic_degree FROM concepts c LEFT JOIN d ON c.id = d.id WHERE status <> 'tombstone' AND type <> 'Cluster' AND coalesce(n, 0) < 2")
def loose_concepts(spark, sf_dir):
    return catalogue.loose(*graph.load(spark, sf_dir), threshold=2)


@query(" SELECT from_id, to_id, kind, confidence FROM edges WHERE generated AND NOT curated AND verified_at IS NULL ORDER BY confidence DESC NULLS LAST, created_at DESC NULLS LAST, from_store, from_id, to_store, to_id, kind LIMIT 100")
def unverified_queue(spark, sf_dir):
    return catalogue.unverified(graph.load(spark, sf_dir)[1], 100).select("from_id", "to_id", "kind", "confidence")


@query(" SELECT store, id, title, (SELECT count(*) FROM edges WHERE kind = 'member' AND from_store = c.store AND from_id = c.id) AS members FROM concepts c WHERE type = 'Cluster' AND status <> 'tombstone'")
def cluster_overview(spark, sf_dir):
    return catalogue.member_counts(*graph.load(spark, sf_dir))


@query(" SELECT kind, c.id IS NOT NULL AS resolved, count(*) AS n FROM edges e LEFT JOIN concepts c ON c.id = e.to_id AND c.store = e.to_store AND c.status <> 'tombstone' GROUP BY ALL")
def edge_resolution(spark, sf_dir):
    return catalogue.resolution(*graph.load(spark, sf_dir))


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("event_id") % 11 == 0, "error").when(F.col("event_id") % 7 == 0, "cache_hit").otherwise("ok")
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_type").alias("task"), F.col("user_id").alias("run"), status.alias("status"), (status == "cache_hit").alias("cache_hit"), F.col("value").alias("cost"), "ts", "props")


_CALLS = "WITH calls AS (SELECT event_type AS task, user_id AS run, CASE WHEN event_id % 11 = 0 THEN 'error' WHEN event_id % 7 = 0 THEN 'cache_hit' ELSE 'ok' END AS status, value AS cost FROM events) "


@query(_CALLS + "SELECT task, count(*) AS calls, count(*) FILTER (status = 'cache_hit') AS cache_hits, count(*) FILTER (status NOT IN ('ok', 'cache_hit')) AS failures, round(coalesce(sum(cost), 0), 3) AS cost FROM calls GROUP BY task", on_graph=False)
def model_usage(spark, sf_dir):
    return catalogue.usage(_calls(spark, sf_dir)).withColumn("cost", F.round("cost", 3))


@query(_CALLS + "SELECT run, count(*) AS calls, round(coalesce(sum(cost), 0), 3) AS cost FROM calls WHERE status = 'ok' GROUP BY run", on_graph=False)
def run_spend(spark, sf_dir):
    return catalogue.spent(_calls(spark, sf_dir)).withColumn("cost", F.round("cost", 3))


@query("SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1", on_graph=False)
def journal_json(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet").groupBy(F.get_json_object("props", "$.k").cast("long").alias("k")).agg(F.count("*").alias("n"))


_TWINS = ", twice AS (SELECT store, id, type, status, updated_at FROM concepts UNION ALL SELECT 'personal', id, 'Note', 'active', NULL FROM concepts WHERE type = 'Nation'), links AS (SELECT from_store, from_id, to_store, to_id, kind FROM edges UNION ALL SELECT 'personal', id, 'shared', 'region:1', 'references' FROM concepts WHERE type = 'Nation'), loops AS (SELECT * FROM links UNION ALL SELECT store, id, store, id, 'related' FROM twice WHERE type = 'Note' AND id LIKE '%3')"


def _twins(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The graph with a personal note for every nation, of the same id."""
    concepts, edges = graph.load(spark, sf_dir)
    columns = ("store", "id", "type", "status", "updated_at")
    notes = concepts.where("type = 'Nation'").select(F.lit("personal").alias("store"), "id", F.lit("Note").alias("type"), F.lit("active").alias("status"), F.lit(None).cast("timestamp").alias("updated_at"))
    ends = notes.select(F.col("store").alias("from_store"), F.col("id").alias("from_id"), F.lit("shared").alias("to_store"), F.lit("region:1").alias("to_id"), F.lit("references").alias("kind"))
    return concepts.select(*columns).unionAll(notes), edges.select(*traverse.KEY).unionAll(ends)


def _loops(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """``_twins`` with edges from some notes to themselves."""
    concepts, edges = _twins(spark, sf_dir)
    loops = concepts.where("type = 'Note' and id like '%3'").select(F.col("store").alias("from_store"), F.col("id").alias("from_id"), F.col("store").alias("to_store"), F.col("id").alias("to_id"), F.lit("related").alias("kind"))
    return concepts.withColumn("scope", F.lit("all")), edges.unionAll(loops)


_LOOSE = _TWINS + ", ends AS (SELECT from_store AS store, from_id AS id FROM loops WHERE kind <> 'member' UNION ALL SELECT to_store, to_id FROM loops WHERE kind <> 'member' AND (from_store, from_id) <> (to_store, to_id)), d AS (SELECT store, id, count(*) AS n FROM ends GROUP BY ALL)"


@query(_LOOSE + " SELECT c.store, c.id, coalesce(n, 0) AS semantic_degree FROM twice c LEFT JOIN d ON d.store = c.store AND d.id = c.id WHERE status <> 'tombstone' AND type <> 'Cluster' AND coalesce(n, 0) < 3")
def loose_twins(spark, sf_dir):
    """Equal ids in two stores are two concepts, and an edge to itself counts once."""
    return catalogue.loose(*_loops(spark, sf_dir), threshold=3)


@query(_LOOSE + " SELECT c.store, count(*) AS concepts, count(*) FILTER (type = 'Cluster') AS clusters, count(*) FILTER (type <> 'Cluster' AND coalesce(n, 0) < 2) AS loose, (SELECT count(*) FROM loops WHERE from_store = c.store) AS edges FROM twice c LEFT JOIN d ON d.store = c.store AND d.id = c.id WHERE status <> 'tombstone' GROUP BY c.store")
def twin_totals(spark, sf_dir):
    return catalogue.store_totals(*_loops(spark, sf_dir), threshold=2)


@query(_TWINS + ", members AS (SELECT from_store AS store, to_id AS id FROM links WHERE kind = 'member' AND from_store = to_store) SELECT store, type, count(*) AS n FROM twice c WHERE status <> 'tombstone' AND NOT EXISTS (SELECT 1 FROM members m WHERE m.store = c.store AND m.id = c.id) GROUP BY ALL")
def orphan_twins(spark, sf_dir):
    c, e = _twins(spark, sf_dir)
    return catalogue.faceted(c, e, orphan=True).groupBy("store", "type").agg(F.count("*").alias("n"))


def _start(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("shared", "nation:3")], "store string, id string")


def _touching(nodes: str) -> str:
    return f"SELECT * FROM links l WHERE EXISTS (SELECT 1 FROM {nodes} n WHERE n.store = l.from_store AND n.id = l.from_id) OR EXISTS (SELECT 1 FROM {nodes} n WHERE n.store = l.to_store AND n.id = l.to_id)"


def _met(hop: int, most: int | None) -> str:
    """Nodes first met in a hop, in the order of stores, starts, kinds and ends."""
    place = "from_store || chr(1) || from_id || chr(1) || kind || chr(1) || to_id || chr(1)"
    ends = f"SELECT from_store AS store, from_id AS id, {place} || '0' AS place FROM t{hop} UNION ALL SELECT to_store, to_id, {place} || '1' FROM t{hop}"
    left = "" if most is None else f" WHERE n <= {most} - (SELECT count(*) FROM s{hop - 1})"
    return f", t{hop} AS ({_touching(f's{hop - 1}')}), m{hop} AS (SELECT store, id, row_number() OVER (ORDER BY min(place)) AS n FROM ({ends}) e WHERE NOT EXISTS (SELECT 1 FROM s{hop - 1} s WHERE s.store = e.store AND s.id = e.id) GROUP BY store, id), s{hop} AS (SELECT * FROM s{hop - 1} UNION ALL SELECT store, id, {hop} FROM m{hop}{left})"


def _reached(most: int | None) -> str:
    return _TWINS + ", s0 AS (SELECT 'shared' AS store, 'nation:3' AS id, 0 AS hops)" + _met(1, most) + _met(2, most)


@query(_reached(None) + " SELECT store, id, hops FROM s2")
def reach_two_hops(spark, sf_dir):
    return traverse.reach(_twins(spark, sf_dir)[1], _start(spark), 2, None)


@query(_reached(300) + " SELECT store, id, hops FROM s2")
def reach_limited(spark, sf_dir):
    return traverse.reach(_twins(spark, sf_dir)[1], _start(spark), 2, 300)


@query((_TWINS + ", k0 AS (SELECT 'shared' AS store, 'nation:3' AS id), k1 AS (SELECT * FROM links l WHERE from_store = 'shared' AND to_store = 'shared'), r1 AS (SELECT from_store AS store, from_id AS id FROM k1 WHERE to_id = 'nation:3' UNION SELECT to_store, to_id FROM k1 WHERE from_id = 'nation:3'), r2 AS (SELECT from_store AS store, from_id AS id FROM k1 WHERE to_id IN (SELECT id FROM r1) UNION SELECT to_store, to_id FROM k1 WHERE from_id IN (SELECT id FROM r1)) SELECT store, id FROM k0 UNION SELECT * FROM r1 UNION SELECT * FROM r2"))
def reach_in_store(spark, sf_dir):
    """Two hops that may not leave the store of the start, although only another one is named."""
    return traverse.reach(_twins(spark, sf_dir)[1], _start(spark), 2, None, stores=["archive"]).select("store", "id")


@query(_TWINS + ", s0 AS (SELECT 'shared' AS store, 'nation:3' AS id) SELECT from_store, from_id, to_store, to_id, kind FROM (" + _touching("s0") + ")")
def neighbour_edges(spark, sf_dir):
    return traverse.neighbours(_twins(spark, sf_dir)[1], _start(spark), None).edges


@query(_reached(300).replace("FROM edges UNION ALL", "FROM edges WHERE kind IN ('references', 'member') UNION ALL") + " SELECT store, id, hops FROM s2")
def reach_by_kinds(spark, sf_dir):
    return traverse.reach(_twins(spark, sf_dir)[1], _start(spark), 2, 300, ["references", "member"])


_RANKED = ", path(o_store, o_id, store, id, cost) AS (SELECT DISTINCT from_store, from_id, from_store, from_id, 0 FROM t2 WHERE from_store = 'personal' UNION SELECT p.o_store, p.o_id, e.to_store, e.to_id, p.cost + CASE WHEN e.kind = 'member' THEN 0 ELSE 1 END FROM path p JOIN t2 e ON e.from_store = p.store AND e.from_id = p.id WHERE p.cost + CASE WHEN e.kind = 'member' THEN 0 ELSE 1 END <= 2), dense AS (SELECT store, id, count(DISTINCT o_store || o_id) AS density FROM path WHERE o_store <> store OR o_id <> id GROUP BY ALL), shown AS (SELECT s.store, s.id, s.hops, c.type, c.updated_at, coalesce(density, 0) AS density FROM s2 s JOIN twice c ON c.store = s.store AND c.id = s.id AND c.status <> 'tombstone' LEFT JOIN dense d ON d.store = s.store AND d.id = s.id) SELECT id, type, store, hops, density, round(0.5 / (1 + hops) + 0.3 * CASE WHEN max(density) OVER () > 0 THEN density::DOUBLE / max(density) OVER () ELSE 0 END + 0.2 * coalesce(power(2.0, -greatest(0.0, (epoch_us(TIMESTAMP '" + NOW + "') - epoch_us(updated_at)) / 86400e6) / 90.0), 0.0), 9) AS score, (SELECT count(*) FROM m1) > 399 OR (SELECT count(*) FROM m2) > 400 - (SELECT count(*) FROM s1) AS truncated FROM shown"
# where the first hop is cut, the second doesn't take place
_RANKED = ", t3 AS (SELECT * FROM t2 WHERE (SELECT count(*) FROM m1) <= 399 UNION ALL SELECT * FROM t1 WHERE (SELECT count(*) FROM m1) > 399)" + _RANKED.replace("FROM t2 ", "FROM t3 ").replace("JOIN t2 ", "JOIN t3 ")


@query(_reached(400) + _RANKED)
def traverse_ranked(spark, sf_dir):
    found = traverse.traverse(*_twins(spark, sf_dir), _start(spark), NOW)
    return found.nodes.withColumn("truncated", F.lit(found.truncated))


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"))


_KNN = "WITH v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS vector FROM embeddings), pairs AS (SELECT a.id, b.id AS other, list_cosine_similarity(a.vector, b.vector) AS similarity FROM v a JOIN v b ON a.id <> b.id), knn AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY similarity DESC, other) AS rank FROM pairs QUALIFY rank <= 8) "


@query(_KNN + "SELECT id, other, rank, round(similarity, 9) AS similarity FROM knn", on_graph=False)
def vector_neighbours(spark, sf_dir):
    return vectors.neighbours(_vectors(spark, sf_dir), 8).select("id", "other", "rank", F.round("similarity", 9).alias("similarity"))


@query(None, on_graph=False)
def near_vectors(spark, sf_dir):
    """Neighbours by the inverted file; tests hold their recall against all pairs."""
    return vectors.approximate(_vectors(spark, sf_dir), 8)


@query(None, on_graph=False)
def indexed_vectors(spark, sf_dir):
    """Neighbours by the stored index, of which a fifth of the vectors came after the fit; tests hold its recall against all pairs."""
    v = _vectors(spark, sf_dir)
    index = vector_index.VectorIndex(spark, scratch(spark)).build(v.where("id % 5 <> 0"))
    index.update(v.where("id % 5 = 0"))
    return index.neighbours(8)


@query("WITH q AS (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 1), s AS (SELECT vec_id AS id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), q) AS similarity FROM embeddings, q ORDER BY similarity DESC, id LIMIT 20) SELECT id, round(similarity, 9) AS similarity FROM s WHERE similarity >= 0.2", on_graph=False)
def vector_search(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return vectors.search(v, v.where("id = 1").first()["vector"], 20, 0.2).withColumn("similarity", F.round("similarity", 9))


@query(_KNN + "SELECT id, other, CASE WHEN similarity >= 0.4 THEN 'edge' ELSE 'candidate' END AS band FROM knn WHERE similarity >= 0.3", on_graph=False)
def proximity_bands(spark, sf_dir):
    return vectors.bands(vectors.neighbours(_vectors(spark, sf_dir), 8), 0.3, 0.4).select("id", "other", "band")


_COMPONENTS = _KNN.replace("WITH v", "WITH RECURSIVE v") + ", links AS (SELECT id AS x, other AS y FROM knn WHERE similarity >= 0.35 UNION SELECT other, id FROM knn WHERE similarity >= 0.35), walk(node, seen) AS (SELECT x, x FROM links UNION SELECT w.node, l.y FROM walk w JOIN links l ON l.x = w.seen), groups AS (SELECT node, min(seen) AS component FROM walk GROUP BY node) "


@query(_COMPONENTS + "SELECT node, component FROM groups", on_graph=False)
def knn_components(spark, sf_dir):
    return vectors.components(vectors.neighbours(_vectors(spark, sf_dir), 8, 0.35))


@query(_COMPONENTS + ", cells AS (SELECT component, unnest(vector) AS value, generate_subscripts(vector, 1) AS place FROM groups JOIN v ON v.id = node) SELECT component, place - 1 AS place, round(avg(value), 6) AS mean, count(*) AS size FROM cells GROUP BY ALL", on_graph=False)
def cluster_centroids(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    found = vectors.centroids(v, vectors.components(vectors.neighbours(v, 8, 0.35)))
    return found.select("component", F.posexplode("vector").alias("place", "mean"), "size").withColumn("mean", F.round("mean", 6))


@query(_COMPONENTS + ", ends AS (SELECT id AS node, other AS peer, similarity FROM knn WHERE similarity >= 0.35 UNION ALL SELECT other, id, similarity FROM knn WHERE similarity >= 0.35) SELECT e.node, g.component, round(avg(similarity), 9) AS similarity FROM ends e JOIN groups g ON g.node = e.node JOIN groups h ON h.node = e.peer AND h.component = g.component GROUP BY ALL", on_graph=False)
def member_similarity(spark, sf_dir):
    pairs = vectors.neighbours(_vectors(spark, sf_dir), 8, 0.35)
    return vectors.mean_similarity(vectors.components(pairs), pairs).withColumn("similarity", F.round("similarity", 9))


@query(_COMPONENTS + ", chunks AS (SELECT node, component, (row_number() OVER (PARTITION BY component ORDER BY node) - 1) // 25 AS chunk FROM groups) SELECT node, min(node) OVER (PARTITION BY component, chunk) AS component FROM chunks", on_graph=False)
def component_chunks(spark, sf_dir):
    return vectors.split_large(vectors.components(vectors.neighbours(_vectors(spark, sf_dir), 8, 0.35)), 25)


@query(_COMPONENTS.replace("FROM embeddings)", "FROM embeddings WHERE vec_id % 11 <> 3)", 1) + "SELECT node, component FROM groups", on_graph=False)
def updated_components(spark, sf_dir):
    """Components after every eleventh vector has gone and another has changed back from other values, from those before."""
    after = _vectors(spark, sf_dir).where("id % 11 <> 3")
    before = _vectors(spark, sf_dir).where("id % 13 <> 1").withColumn("vector", F.when(F.col("id") % 11 == 5, F.reverse("vector")).otherwise(F.col("vector")))
    pairs = checkpointed(vectors.neighbours(before, 8, 0.35))
    new, _ = incremental.updated_neighbours(pairs, before, after, 8, 0.35)
    return incremental.updated_components(vectors.components(pairs), pairs, new)


_TRIGRAMS = "list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower({0}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda k: substring('  ' || w || ' ', k, 3)))))"
_SIMILAR = ", t AS (SELECT id, " + _TRIGRAMS.format("title") + " AS a, " + _TRIGRAMS.format("'red widgets'") + " AS b FROM concepts WHERE status <> 'tombstone'), s AS (SELECT id, len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b))) AS similarity FROM t WHERE len(list_concat(a, b)) > 0), g AS (SELECT id, similarity, row_number() OVER (ORDER BY similarity DESC, id) AS rank FROM s WHERE similarity >= 0.3 QUALIFY rank <= 20)"
_PLACES = "list_filter(range(1, len(words) + 1), lambda k: words[k] = {0})[1:255]"
_ALONE = "round(list_sum(list_transform(range(1, len({0}) + 1), lambda k: 1.0::DOUBLE / (k * k))) * 0.1 / 1.64493406685, 9)"
_WORDS = ", w AS (SELECT id, list_filter(regexp_split_to_array(lower(concat_ws(' ', title, description)), '[^\\p{L}\\p{N}]+'), lambda w: w <> '') AS words FROM concepts WHERE status <> 'tombstone'), f AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM (SELECT id, " + _ALONE.format(_PLACES.format("'hot'")) + " AS score FROM w WHERE list_contains(words, 'hot')) QUALIFY rank <= 20)"


@query(_SIMILAR + " SELECT id, rank, round(similarity, 9) AS similarity FROM g")
def trigram_search(spark, sf_dir):
    return search.by_trigrams(graph.load(spark, sf_dir)[0], "red widgets").withColumn("similarity", F.round("similarity", 9))


@query(_WORDS + " SELECT id, score, rank FROM f")
def full_text_search(spark, sf_dir):
    return search.full_text(graph.load(spark, sf_dir)[0], "hot")


@query(_SIMILAR + _WORDS.replace("'hot'", "'red'") + " SELECT id, round(sum(1.0 / (60 + rank)), 9) AS score FROM (SELECT id, rank FROM f UNION ALL SELECT id, rank FROM g) GROUP BY id ORDER BY score DESC, id LIMIT 20")
def fused_search(spark, sf_dir):
    concepts, _ = graph.load(spark, sf_dir)
    return search.fused([search.full_text(concepts, "red"), search.by_trigrams(concepts, "red widgets")])


_PAIR = "round(1 - list_product(list_transform({0}, lambda p: list_product(list_transform({1}, lambda q: 1 - 0.1 * sqrt(CASE WHEN abs(p - q) > 100 THEN 1e-30 ELSE 1 / (1.005 + 0.05 * exp(abs(p - q) / 1.5 - 2)) END))))), 9)"


@query(
    "WITH w AS (SELECT CAST(doc_id AS VARCHAR) AS id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda w: w <> '') AS words FROM documents WHERE doc_id % 11 <> 0), t AS (SELECT id, "
    + _PLACES.format("'example'") + " AS a, " + _PLACES.format("'token'") + " AS b FROM w), s AS (SELECT 'example' AS query, id, " + _ALONE.format("a")
    + " AS score FROM t WHERE len(a) > 0 UNION ALL SELECT 'Token, example', id, greatest(" + _PAIR.format("a", "b")
    + ", 1e-20::DOUBLE) FROM t WHERE len(a) > 0 AND len(b) > 0) SELECT query, id, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM s QUALIFY rank <= 50",
    on_graph=False,
)
def ranked_search(spark, sf_dir):
    """Full text by a stored index of all documents: built, updated with other texts for some, with some taken out, and compacted."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.lit("shared").alias("store"), F.col("doc_id").cast("string").alias("id"), F.lit("active").alias("status"), F.col("text").alias("body"), "doc_id")
    index = text_index.TextIndex(spark, scratch(spark))
    index.update(docs.withColumn("body", F.when(F.col("doc_id") % 7 == 0, F.lit("token example")).otherwise(F.col("body"))).drop("doc_id").withColumn("title", F.lit("")))
    index.update(docs.where("doc_id % 7 = 0 and doc_id % 11 <> 0").withColumn("title", F.lit("")), docs.where("doc_id % 11 = 0"))
    index.compact()
    found = [index.search(search.query_words(q), 50).select(F.lit(q).alias("query"), "id", "score", "rank") for q in ("example", "Token, example")]
    return found[0].unionByName(found[1])


@query(_SIMILAR + " SELECT id, rank, round(similarity, 9) AS similarity FROM g")
def indexed_trigrams(spark, sf_dir):
    """As ``trigram_search``, from a stored index of all titles."""
    index = text_index.TextIndex(spark, scratch(spark))
    index.update(graph.load(spark, sf_dir)[0])
    return index.similar(search.query_grams("red widgets")).select("id", "rank", F.round("similarity", 9).alias("similarity"))


_TITLES = "WITH t AS (SELECT 'part:' || p_partkey AS id, list_sort(" + _TRIGRAMS.format("p_name || ' ' || p_type || ' ' || p_brand") + ") AS grams FROM part), c AS (SELECT grams, min(id) AS class FROM t GROUP BY grams), x AS (SELECT a.class AS a, b.class AS b, len(list_intersect(a.grams, b.grams))::DOUBLE AS n, len(a.grams) + len(b.grams) AS m FROM c a JOIN c b ON a.class < b.class)"


def _titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(F.lit("shared").alias("store"), F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("id"), F.lit("active").alias("status"), F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("title"))


@query(_TITLES + " SELECT a, b, round(n / (m - n), 9) AS similarity FROM x WHERE n / (m - n) >= 0.8", on_graph=False)
def similar_titles(spark, sf_dir):
    return text_index.similar_titles(_titles(spark, sf_dir), 0.8)[0].withColumn("similarity", F.round("similarity", 9))


@query(_TITLES + " SELECT id, class FROM t JOIN c USING (grams)", on_graph=False)
def title_classes(spark, sf_dir):
    return text_index.title_classes(_titles(spark, sf_dir)).select("id", "class")


_STAGED = (
    _SIMILAR.replace("'red widgets'", "'red'") + _WORDS.replace("'hot'", "'red'")
    + ", lex AS (SELECT id, round(sum(1.0 / (60 + rank)), 9) AS score FROM (SELECT id, rank FROM f UNION ALL SELECT id, rank FROM g) GROUP BY id ORDER BY score DESC, id LIMIT 20), l AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank FROM lex)"
    + ", q AS (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 1), n AS (SELECT id, row_number() OVER (ORDER BY similarity DESC, id) AS rank FROM (SELECT 'part:' || vec_id AS id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), q) AS similarity FROM embeddings, q WHERE 'part:' || vec_id IN (SELECT id FROM concepts WHERE status <> 'tombstone')) QUALIFY rank <= 20)"
    + " SELECT 'concept' AS stage, id, round(sum(1.0 / (60 + rank)), 9) AS score FROM (SELECT id, rank FROM l UNION ALL SELECT id, rank FROM n) GROUP BY id ORDER BY score DESC, id LIMIT 20"
)


@query(_STAGED)
def staged_concepts(spark, sf_dir):
    """The second stage: no centroid is near enough, so words and vectors of concepts are fused."""
    concepts, _ = graph.load(spark, sf_dir)
    v = _vectors(spark, sf_dir).withColumn("id", F.concat(F.lit("part:"), F.col("id").cast("string")))
    return search.staged(concepts, v, v.where("id = 'part:2'"), "red", v.where("id = 'part:1'").first()["vector"], least=0.999)


@query("SELECT p_partkey, sha256(coalesce(p_name, '') || chr(30) || coalesce(p_type, '') || chr(30) || '') AS content_hash FROM part", on_graph=False)
def content_hashes(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", scalars.content_hash(F.col("p_name"), F.col("p_type"), F.lit(None).cast("string")).alias("content_hash"))


@query("SELECT o_orderkey, 'order:' || o_orderkey || ',part:' || (o_custkey % 7) AS refs FROM orders", on_graph=False)
def body_references(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    body = F.concat(F.lit("see [[ order:"), F.col("o_orderkey").cast("string"), F.lit(" ]], [[Not an id]] and [[part:"), (F.col("o_custkey") % 7).cast("string"), F.lit("]] [[order:"), F.col("o_orderkey").cast("string"), F.lit("]]"))
    return orders.select("o_orderkey", F.array_join(scalars.references(body), ",").alias("refs"))


@query("SELECT p_partkey, trim(p_name) || chr(10) || chr(10) || trim(p_type) AS text FROM part", on_graph=False)
def embedding_texts(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", scalars.embedding_text(F.col("p_name"), F.col("p_type")).alias("text"))


@query("WITH d AS (SELECT p_partkey AS k, p_name, CASE WHEN p_partkey % 3 = 0 THEN p_type || '!' ELSE p_type END AS t, p_type, p_partkey % 5 = 0 AS c, p_partkey % 2 = 0 AS v, p_partkey % 4 <> 0 AS here FROM part) SELECT 'part:' || k AS id, CASE WHEN NOT here THEN 'created' WHEN t = p_type THEN 'unchanged' WHEN c THEN 'conflict' ELSE 'updated' END AS outcome, CASE WHEN here AND t <> p_type AND c THEN 'description' ELSE '' END AS held_back, here AND t <> p_type AND NOT c AND v AS verification_reset FROM d", on_graph=False)
def upsert_outcomes(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    key = F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("id")
    null = F.lit(None).cast("string")
    rest = [key, F.lit("shared").alias("store"), F.lit("catalog").alias("scope"), F.lit("Part").alias("type"), F.col("p_name").alias("title"), null.alias("body"), null.alias("resource"), F.array().cast("array<string>").alias("tags"), F.lit("active").alias("status"), F.lit("erp").alias("source_name")]
    new = part.select(*rest, F.when(F.col("p_partkey") % 3 == 0, F.concat("p_type", F.lit("!"))).otherwise(F.col("p_type")).alias("description"))
    old = part.where("p_partkey % 4 <> 0").select(*rest, F.col("p_type").alias("description"), (F.col("p_partkey") % 5 == 0).alias("curated"), (F.col("p_partkey") % 2 == 0).alias("verified"), scalars.content_hash(F.col("p_name"), F.col("p_type"), null).alias("content_hash"), F.to_timestamp(F.lit("2020-01-01")).alias("updated_at"))
    return merge.merged(old, new, "2021-01-01").select("id", "outcome", F.array_join("held_back", ",").alias("held_back"), "verification_reset")


@query(", cur AS (SELECT from_id, to_id, kind, confidence > 0.5 AS curated FROM edges WHERE kind = 'implements' AND confidence < 0.9), want AS (SELECT from_id, to_id, kind FROM edges WHERE kind = 'implements' AND confidence > 0.2 AND confidence <> 0.33) SELECT coalesce(c.from_id, w.from_id) AS from_id, coalesce(c.to_id, w.to_id) AS to_id, coalesce(c.kind, w.kind) AS kind, CASE WHEN c.kind IS NULL THEN 'add' WHEN w.kind IS NOT NULL OR c.curated THEN 'keep' ELSE 'remove' END AS action FROM cur c FULL JOIN want w ON c.from_id = w.from_id AND c.to_id = w.to_id AND c.kind = w.kind")
def edge_reconcile(spark, sf_dir):
    _, e = graph.load(spark, sf_dir)
    e = e.where("kind = 'implements'")
    return merge.reconcile(e.where("confidence < 0.9").withColumn("curated", F.col("confidence") > 0.5), e.where("confidence > 0.2"), e.where("confidence = 0.33"))


@query(" SELECT from_store, e.to_id, coalesce(CASE WHEN c.store = from_store OR from_store = 'personal' THEN c.store END, from_store) AS to_store, max(CASE WHEN c.id IS NOT NULL AND (c.store = from_store OR from_store = 'personal') THEN 1 ELSE 0 END) = 1 AS resolved FROM edges e LEFT JOIN concepts c ON c.id = e.to_id AND c.status <> 'tombstone' GROUP BY ALL")
def reference_targets(spark, sf_dir):
    c, e = graph.load(spark, sf_dir)
    return merge.resolve_targets(e.select("from_store", "to_id").distinct(), c, ["shared", "personal"])


assert edits.REGISTERED and runs.REGISTERED and tables.REGISTERED  # their queries register on import


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: the ranked traversal of two hops around a nation."""
    return traverse_ranked(spark, sf_dir)


def queries() -> dict[str, Query]:
    return QUERIES


def oracle_sql() -> dict[str, str]:
    return ORACLES
