"""Queries of reads, writers and records, each on whole tables, with the DuckDB text that it is held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noema.functions import markup, scalars
from noema.operators import catalogue, curation, merge, reads, records
from noema.operators import edges as E
from noema.plans import graph
from noema.plans.registration import query
from noema.sources import mapping

REGISTERED = True


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids that edges point at, as a set to look up."""
    return graph.load(spark, sf_dir)[1].where("kind = 'references'").select(F.col("to_id").alias("id"))


@query(" SELECT id, title, status FROM concepts WHERE id IN (SELECT to_id FROM edges WHERE kind = 'references')")
def concepts_by_id(spark, sf_dir):
    return reads.many(graph.load(spark, sf_dir)[0], _ids(spark, sf_dir)).select("id", "title", "status")


@query(" SELECT DISTINCT to_id AS id FROM edges WHERE kind = 'references' AND to_id IN (SELECT id FROM concepts)")
def existing_ids(spark, sf_dir):
    return reads.existing(graph.load(spark, sf_dir)[0], _ids(spark, sf_dir))


@query(" SELECT DISTINCT to_id AS id FROM edges WHERE kind = 'references' AND to_id IN (SELECT id FROM concepts WHERE status <> 'tombstone')")
def resolvable_ids(spark, sf_dir):
    return reads.resolvable(graph.load(spark, sf_dir)[0], _ids(spark, sf_dir))


@query(" SELECT type, count(*) AS n FROM concepts WHERE id NOT IN (SELECT to_id FROM edges WHERE kind = 'references') GROUP BY type")
def hard_deletes(spark, sf_dir):
    return reads.without(graph.load(spark, sf_dir)[0], _ids(spark, sf_dir)).groupBy("type").agg(F.count("*").alias("n"))


@query(" SELECT to_id, kind FROM edges WHERE from_store = 'shared' AND from_id = 'part:1'")
def outgoing_edges(spark, sf_dir):
    return reads.outgoing(graph.load(spark, sf_dir)[1], "shared", "part:1").select("to_id", "kind")


@query(" SELECT from_id, kind FROM edges WHERE from_store = 'shared' AND to_store = 'shared' AND to_id = 'nation:3'")
def incoming_edges(spark, sf_dir):
    return reads.incoming(graph.load(spark, sf_dir)[1], "shared", "nation:3").select("from_id", "kind")


@query(" SELECT from_store AS store, count(*) AS n FROM edges GROUP BY 1")
def edge_counts(spark, sf_dir):
    return reads.edge_counts(graph.load(spark, sf_dir)[1])


_VECTORS = ", v AS (SELECT 'part:' || vec_id AS id, 'm' || (vec_id % 2) AS model_key, CAST(embedding AS DOUBLE[]) AS vector, vec_id FROM embeddings)"


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "embeddings").select(F.concat(F.lit("part:"), "vec_id").alias("id"), F.concat(F.lit("m"), F.col("vec_id") % 2).alias("model_key"), F.col("embedding").cast("array<double>").alias("vector"), "vec_id")


@query(_VECTORS + " SELECT model_key, scope, count(*) AS n FROM v JOIN concepts USING (id) GROUP BY ALL")
def vector_counts(spark, sf_dir):
    return reads.vector_counts(_vectors(spark, sf_dir), graph.load(spark, sf_dir)[0])


@query(_VECTORS + ", q AS (SELECT vector AS q FROM v WHERE id = 'part:1') SELECT id, round(list_cosine_similarity(vector, q), 9) AS similarity FROM v JOIN concepts USING (id), q WHERE model_key = 'm1' AND status <> 'tombstone' AND id <> 'part:1' ORDER BY list_cosine_similarity(vector, q) DESC, id LIMIT 20")
def similar_concepts(spark, sf_dir):
    return reads.similar(_vectors(spark, sf_dir), graph.load(spark, sf_dir)[0], "part:1", "m1").withColumn("similarity", F.round("similarity", 9))


@query(_VECTORS + ", q AS (SELECT vector AS q FROM v WHERE id = 'part:1') SELECT * FROM (SELECT id, round(list_cosine_similarity(vector, q), 9) AS similarity FROM v JOIN concepts USING (id), q WHERE model_key = 'm0' AND scope = 'catalog' AND status <> 'tombstone' AND vec_id % 10 <> 0 ORDER BY list_cosine_similarity(vector, q) DESC, id LIMIT 30) WHERE similarity >= 0.2")
def scoped_vector_search(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return reads.near(v, graph.load(spark, sf_dir)[0], reads.vector_of(v, "part:1", "m1"), "m0", 30, "catalog", v.where("vec_id % 10 = 0"), 0.2).withColumn("similarity", F.round("similarity", 9))


_MARKED = ", marked AS (SELECT *, coalesce(confidence, 0) > 0.5 AS resolved FROM edges), j AS (SELECT m.*, c.id IS NOT NULL AS there FROM marked m LEFT JOIN concepts c ON c.id = m.to_id AND c.store = m.to_store AND c.status <> 'tombstone')"


def _marked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    concepts, edges = graph.load(spark, sf_dir)
    return concepts, edges.withColumn("resolved", F.coalesce("confidence", F.lit(0.0)) > 0.5)


@query(_MARKED + " SELECT kind, CASE WHEN from_store = to_store THEN there ELSE resolved END AS resolved, from_store = to_store AND there <> resolved AS changed, count(*) AS n FROM j GROUP BY ALL")
def resolved_edges(spark, sf_dir):
    concepts, edges = _marked(spark, sf_dir)
    return E.resolved(edges, concepts, across=False).groupBy("kind", "resolved", "changed").agg(F.count("*").alias("n"))


@query(_MARKED + " SELECT kind, CASE WHEN from_store <> to_store THEN there ELSE resolved END AS resolved, from_store <> to_store AND there <> resolved AS changed, count(*) AS n FROM j GROUP BY ALL")
def resolved_bridges(spark, sf_dir):
    concepts, edges = _marked(spark, sf_dir)
    return E.resolved(edges, concepts, across=True).groupBy("kind", "resolved", "changed").agg(F.count("*").alias("n"))


@query(_MARKED + " SELECT DISTINCT to_store, to_id FROM j WHERE NOT there")
def unresolved_targets(spark, sf_dir):
    concepts, edges = _marked(spark, sf_dir)
    return E.unresolved_targets(E.resolved(edges, concepts).drop("changed"))


_IMPLEMENTS = ", e AS (SELECT * FROM edges WHERE kind = 'implements'), d AS (SELECT *, CAST(split_part(to_id, ':', 2) AS INT) AS k FROM e)"
_TRIPLE = "from_store, from_id, to_store, to_id, kind"


def _implements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.load(spark, sf_dir)[1].where("kind = 'implements'").withColumn("k", F.split_part("to_id", F.lit(":"), F.lit(2)).cast("int"))


@query(_IMPLEMENTS + " SELECT " + _TRIPLE + ", CASE WHEN k % 3 = 0 THEN 9.0 ELSE weight END AS weight FROM d WHERE k % 2 = 0 OR k % 3 = 0")
def edges_added(spark, sf_dir):
    d = _implements(spark, sf_dir)
    new = d.where("k % 3 = 0 or k % 4 = 0").withColumn("weight", F.lit(9.0))
    return E.added(d.where("k % 2 = 0 and k % 3 <> 0").drop("k"), new.drop("k")).select(*E.KEY, "weight")


@query(_IMPLEMENTS + ", x AS (SELECT *, k % 2 = 0 AS here, k % 3 = 0 AS want, CAST(split_part(from_id, ':', 2) AS INT) % 5 <> 0 AS asked, k % 7 = 0 AS other FROM d) SELECT " + _TRIPLE + ", CASE WHEN NOT here THEN 'insert' WHEN NOT asked THEN 'keep' WHEN curated OR other THEN CASE WHEN want THEN 'foreign' ELSE 'keep' END WHEN NOT want THEN 'delete' WHEN weight <> 2.0 THEN 'update' ELSE 'keep' END AS action, CASE WHEN NOT here OR (asked AND want AND NOT curated AND NOT other) THEN 2.0 ELSE weight END AS weight FROM x WHERE here OR (want AND asked)")
def edges_replaced(spark, sf_dir):
    d = _implements(spark, sf_dir)
    now = d.where("k % 2 = 0").withColumn("generated_by", F.when(F.col("k") % 7 == 0, "somebody").otherwise("relations"))
    new = d.where("k % 3 = 0").withColumn("weight", F.lit(2.0))
    starts = d.where("cast(split_part(from_id, ':', 2) as int) % 5 <> 0")
    columns = [c for c in d.columns if c not in ("k", "confidence")]
    return E.replaced(now.select(*columns), new.select(*E.KEY, "weight", F.lit("relations").alias("generated_by")), starts, ["relations"]).select(*E.KEY, "action", "weight")


@query(_IMPLEMENTS + " SELECT " + _TRIPLE + ", curated OR k % 5 = 0 AS curated, CASE WHEN k % 5 = 0 THEN 'me' END AS verified_by FROM d")
def verified_edges(spark, sf_dir):
    d = _implements(spark, sf_dir)
    return E.verified(d.withColumn("verified_by", F.lit(None).cast("string")), d.where("k % 5 = 0"), "me", "2021-01-01").select(*E.KEY, "curated", "verified_by")


@query(_IMPLEMENTS + " SELECT " + _TRIPLE + ", CASE WHEN k % 3 = 0 THEN 'new' WHEN k % 4 = 0 THEN 'old' END AS reason, k % 3 <> 0 AS there FROM d")
def rejected_edges(spark, sf_dir):
    d = _implements(spark, sf_dir)
    old = d.where("k % 4 = 0").select(*E.KEY, F.lit("old").alias("reason"), F.to_timestamp(F.lit("2020-01-01")).alias("rejected_at"))
    left, memo = E.rejected(d, old, d.where("k % 3 = 0").select(*E.KEY, F.lit("new").alias("reason")), "2021-01-01")
    rows = d.select(*E.KEY).join(memo.select(*E.KEY, "reason"), E.KEY, "left").join(left.select(*E.KEY, F.lit(True).alias("t")), E.KEY, "left")
    return rows.select(*E.KEY, "reason", F.coalesce("t", F.lit(False)).alias("there"))


@query(_IMPLEMENTS + " SELECT " + _TRIPLE + " FROM d WHERE k % 3 <> 0")
def withdrawn_rejections(spark, sf_dir):
    d = _implements(spark, sf_dir).select(*E.KEY, "k")
    return E.removed(d, d.where("k % 3 = 0")).select(*E.KEY)


@query(", o AS (SELECT 'order:' || o_orderkey AS id, 'customer:' || o_custkey AS c, 'part:' || (o_orderkey % 300) AS p, o_orderkey FROM orders), r AS (SELECT id, c AS t, 'references' AS kind, 'body_ref' AS g FROM o UNION ALL SELECT id, p, 'references', 'source_ref' FROM o UNION ALL SELECT id, p, 'depends_on', 'source_ref' FROM o) SELECT r.id AS from_id, coalesce(k.store, 'personal') AS to_store, t AS to_id, kind, k.id IS NOT NULL AS resolved, g AS generated_by FROM r LEFT JOIN concepts k ON k.id = t AND k.status <> 'tombstone'")
def reference_edges(spark, sf_dir):
    concepts, _ = graph.load(spark, sf_dir)
    order, customer, part = (F.concat(F.lit(p), x.cast("string")) for p, x in (("order:", F.col("o_orderkey")), ("customer:", F.col("o_custkey")), ("part:", F.col("o_orderkey") % 300)))
    ref = lambda t, k: F.struct(t.alias("target"), F.lit(k).alias("kind"))
    rows = _table(spark, sf_dir, "orders").select(F.lit("personal").alias("store"), order.alias("id"), F.concat(F.lit("for [["), customer, F.lit("]] by [["), order, F.lit("]]")).alias("body"), F.array(ref(customer, "references"), ref(part, "references"), ref(part, "depends_on"), ref(order, "related"), ref(part, "depends_on")).alias("references"))
    ids = rows.select(F.lit("personal").alias("from_store"), F.explode(F.concat(scalars.references(F.col("body")), F.transform("references", lambda r: r["target"]))).alias("to_id")).distinct()
    return E.reference_drafts(rows, merge.resolve_targets(ids, concepts, ["shared", "personal"])).drop("from_store")


_SCOPES = ", s AS (SELECT 'geo' AS scope, 'shared' AS home UNION ALL SELECT 'catalog', 'shared' UNION ALL SELECT 'sales', 'personal')"


@query(_SCOPES + " SELECT reason, type, count(*) AS n FROM (SELECT type, CASE WHEN home IS NULL THEN 'unknown scope' WHEN home <> store THEN 'scope of another store' WHEN type NOT IN ('Nation', 'Part', 'Order') THEN 'unknown type' WHEN type = 'Order' AND store <> 'shared' THEN 'type not in this store' END AS reason FROM (SELECT type, store, CASE WHEN type = 'Supplier' THEN 'odd' WHEN type = 'Customer' THEN 'geo' ELSE scope END AS scope FROM concepts) LEFT JOIN s USING (scope)) GROUP BY ALL")
def admitted_drafts(spark, sf_dir):
    concepts, _ = graph.load(spark, sf_dir)
    scope = F.when(F.col("type") == "Supplier", "odd").when(F.col("type") == "Customer", "geo").otherwise(F.col("scope"))
    scopes = spark.createDataFrame([("geo", "shared"), ("catalog", "shared"), ("sales", "personal")], "scope string, store string")
    types = spark.createDataFrame([("Nation", "shared"), ("Part", "shared"), ("Part", "personal"), ("Order", "shared")], "type string, store string")
    return mapping.admitted(concepts.select("type", "store", scope.alias("scope")), scopes, types).groupBy("reason", "type").agg(F.count("*").alias("n"))


@query("SELECT 'ev:' || event_id AS id, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS title, CASE WHEN event_id % 2 = 0 THEN 'user:' || user_id ELSE 'ev:' || user_id END AS target FROM events", on_graph=False)
def source_drafts(spark, sf_dir):
    ref = F.struct(F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("user:"), "user_id")).otherwise(F.col("user_id").cast("string")).alias("target"), F.lit("references").alias("kind"))
    null = F.lit(None).cast("string")
    docs = _table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("external_id"), F.lit("none").alias("title"), null.alias("description"), null.alias("body"), null.alias("url"), F.array().cast("array<string>").alias("tags"), F.col("ts").alias("updated_at"), F.array(ref).alias("references"), "props")
    made = mapping.drafts(mapping.mapped(docs, "props", {"title": "$.k"}), source="log", prefix="ev", scope="sales", kind="Event", store="personal", known=["ev", "user"])
    return made.select("id", "title", F.col("references")[0]["target"].alias("target"))


_HREF = "CASE o_orderkey % 5 WHEN 0 THEN 'http://w/pages/viewpage.action?pageId=' || o_orderkey WHEN 1 THEN '/spaces/E/pages/' || o_orderkey || '/T' WHEN 2 THEN 'http://w/display/E/T' || o_orderkey || '?pageId=1' WHEN 3 THEN 'http://w/q?x=1&pageId=' || o_orderkey ELSE 'http://o/' || o_orderkey END"


@query(f"SELECT o_orderkey, {_HREF} AS href, CASE WHEN o_orderkey % 5 IN (0, 1, 3) THEN CAST(o_orderkey AS VARCHAR) END AS page, CASE WHEN o_orderkey % 5 = 2 THEN 'E' END AS space, CASE WHEN o_orderkey % 5 = 2 THEN 'T' || o_orderkey END AS title, CASE WHEN o_orderkey % 5 IN (0, 1, 3) THEN 'http://w/pages/viewpage.action?pageId=' || o_orderkey ELSE {_HREF} END AS url, CASE WHEN o_orderkey % 5 IN (0, 1, 3) THEN 'wiki:' || o_orderkey END AS target FROM orders", on_graph=False)
def classified_links(spark, sf_dir):
    rows = _table(spark, sf_dir, "orders").select("o_orderkey", F.expr(_HREF.replace("VARCHAR", "STRING")).alias("href"))
    parts = markup.link_parts(F.col("href"))
    rows = rows.select("*", *(v.alias(k) for k, v in parts.items()))
    return rows.select("*", *(v.alias(k) for k, v in markup.link_target(F.col("href"), F.col("page"), "wiki", "http://w/").items()))


@query("SELECT 'ab:' || p_name AS id, CASE WHEN p_name NOT LIKE '% %' THEN 'ab' END AS prefix, CASE WHEN p_name NOT LIKE '% %' THEN p_name END AS local FROM part", on_graph=False)
def concept_ids(spark, sf_dir):
    made = _table(spark, sf_dir, "part").select(F.concat(F.lit("ab:"), "p_name").alias("id"))
    return made.select("id", scalars.id_prefix(F.col("id")).alias("prefix"), scalars.id_local(F.col("id")).alias("local"))


_RUNS = "WITH runs AS (SELECT 'run:' || event_id AS run_id, CASE WHEN event_id % 3 = 0 THEN 'personal' ELSE 'shared' END AS store, CASE event_type WHEN 'view' THEN 'sync' ELSE 'embed' END AS kind, CASE event_id % 5 WHEN 0 THEN 'queued' WHEN 1 THEN 'running' WHEN 2 THEN 'failed' ELSE 'succeeded' END AS status, user_id % 4 AS source, CASE WHEN event_id % 50 <> 0 THEN ts END AS started_at, event_id FROM events) "


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    null, status = F.lit(None).cast("string"), F.element_at(F.array(*map(F.lit, ("queued", "running", "failed", "succeeded", "succeeded"))), (F.col("event_id") % 5 + 1).cast("int"))
    return _table(spark, sf_dir, "events").select(F.concat(F.lit("run:"), "event_id").alias("run_id"), F.when(F.col("event_id") % 3 == 0, "personal").otherwise("shared").alias("store"), F.when(F.col("event_type") == "view", "sync").otherwise("embed").alias("kind"), F.lit("sales").alias("scope"), status.alias("status"), F.concat(F.lit('{"source": "s'), F.col("user_id") % 4, F.lit('"}')).alias("params"), null.alias("stats"), null.alias("error"), F.when(F.col("event_id") % 50 != 0, F.col("ts").cast("timestamp")).alias("started_at"), F.lit(None).cast("timestamp").alias("finished_at"))


@query(_RUNS + "SELECT run_id, status FROM runs WHERE kind = 'sync' AND status IN ('queued', 'running') AND source = 2", on_graph=False)
def open_runs(spark, sf_dir):
    return records.open_runs(_runs(spark, sf_dir), "s2").select("run_id", "status")


@query(_RUNS + "SELECT run_id FROM runs WHERE kind = 'embed' ORDER BY started_at DESC NULLS FIRST, run_id LIMIT 100", on_graph=False)
def recent_runs(spark, sf_dir):
    return records.recent(_runs(spark, sf_dir), "embed", 100).select("run_id")


@query(_RUNS + "SELECT run_id, store, kind, status FROM runs WHERE run_id = 'run:7'", on_graph=False)
def run_lookup(spark, sf_dir):
    return records.run_anywhere(_runs(spark, sf_dir), "run:7").select("run_id", "store", "kind", "status")


@query(_RUNS + "SELECT run_id, kind, CASE WHEN event_id % 4 = 0 THEN 'cancelled' ELSE status END AS status FROM runs WHERE event_id % 2 = 0 UNION ALL SELECT run_id, 'relate', 'cancelled' FROM runs WHERE event_id % 4 = 1", on_graph=False)
def saved_runs(spark, sf_dir):
    runs = _runs(spark, sf_dir)
    k = F.split_part("run_id", F.lit(":"), F.lit(2)).cast("int")
    new = runs.where(k % 4 < 2).withColumn("kind", F.lit("relate")).withColumn("status", F.lit("cancelled"))
    return records.save_runs(runs.where(k % 2 == 0), new).select("run_id", "kind", "status")


@query("SELECT 's' || c_custkey AS source_name, CASE WHEN c_custkey % 2 = 0 THEN 'new' ELSE 'old' END AS cursor, c_custkey % 4 = 0 OR c_custkey % 3 = 0 AS had_full FROM customer WHERE c_custkey <> 5", on_graph=False)
def saved_cursors(spark, sf_dir):
    k = F.col("c_custkey")
    table = _table(spark, sf_dir, "customer")
    when = F.to_timestamp(F.lit("2020-01-01"))
    row = lambda text, full: (F.concat(F.lit("s"), k).alias("source_name"), F.lit(text).alias("cursor"), when.alias("last_sync"), F.when(full, when).alias("last_full_sync"))
    after = records.save_cursors(table.select(*row("old", k % 3 == 0)), table.where(k % 2 == 0).select(*row("new", k % 4 == 0)))
    return records.forget_cursor(after, "s5").select("source_name", "cursor", F.col("last_full_sync").isNotNull().alias("had_full"))


@query(_VECTORS + " SELECT id, model_key, CASE WHEN vec_id % 3 = 0 THEN 'new' ELSE 'old' END AS source_hash FROM v")
def saved_vectors(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    row = lambda df, text: df.select("id", "model_key", "vector", F.lit(text).alias("source_hash"))
    return records.save_vectors(row(v.where("vec_id % 2 = 0 or vec_id % 3 <> 0"), "old"), row(v.where("vec_id % 3 = 0"), "new")).select("id", "model_key", "source_hash")


@query("SELECT 'c' || label AS cluster_id, CASE WHEN label % 2 = 0 THEN count(*) ELSE 0 END AS members FROM embeddings GROUP BY label", on_graph=False)
def saved_centroids(spark, sf_dir):
    groups = _table(spark, sf_dir, "embeddings").groupBy("label").agg(F.count("*").alias("members"))
    row = lambda df, n: df.select(F.concat(F.lit("c"), "label").alias("cluster_id"), F.lit("m").alias("model_key"), n.alias("members"))
    after = records.save_centroids(row(groups, F.lit(0).cast("long")), row(groups.where("label % 2 = 0"), F.col("members")))
    return reads.centroid_list(after, "m").select("cluster_id", "members")


@query(" SELECT id, CASE WHEN CAST(split_part(id, ':', 2) AS INT) % 2 = 0 THEN title || '!' ELSE title END AS title, CASE WHEN CAST(split_part(id, ':', 2) AS INT) % 3 <> 0 THEN 'first' ELSE 'second' END AS created FROM concepts WHERE type = 'Part' AND (CAST(split_part(id, ':', 2) AS INT) % 3 <> 0 OR CAST(split_part(id, ':', 2) AS INT) % 2 = 0)")
def saved_concepts(spark, sf_dir):
    parts = graph.load(spark, sf_dir)[0].where("type = 'Part'").select("id", "title", F.split_part("id", F.lit(":"), F.lit(2)).cast("int").alias("k"))
    old = parts.where("k % 3 <> 0").select("id", "title", F.lit("first").alias("created_at"))
    new = parts.where("k % 2 = 0").select("id", F.concat("title", F.lit("!")).alias("title"), F.lit("second").alias("created_at"))
    return records.save_concepts(old, new).select("id", "title", F.col("created_at").alias("created"))


@query("SELECT event_id, event_id + 1 AS call_id FROM events", on_graph=False)
def appended_calls(spark, sf_dir):
    """A log of the first ten events with all others put behind, numbered on by event."""
    rows = _table(spark, sf_dir, "events").select((F.col("event_id") + 1).alias("call_id"), "event_id")
    return records.appended(rows.where("event_id < 10"), rows.where("event_id >= 10"), "call_id", ["event_id"])


@query("SELECT concept_id, source_hash FROM (SELECT DISTINCT 'c:' || user_id AS concept_id, json_extract_string(props, '$.k') AS source_hash FROM events) EXCEPT SELECT 'c:' || user_id, json_extract_string(props, '$.k') FROM events WHERE event_type = 'error'", on_graph=False)
def new_conflicts(spark, sf_dir):
    rows = _table(spark, sf_dir, "events").select(F.concat(F.lit("c:"), "user_id").alias("concept_id"), F.get_json_object("props", "$.k").alias("source_hash"), "event_type")
    journal = rows.select("concept_id", F.when(F.col("event_type") == "error", "conflict").otherwise("updated").alias("change"), F.to_json(F.struct("source_hash")).alias("detail"))
    return records.new_conflicts(rows.select("concept_id", "source_hash").distinct(), journal)


@query("SELECT event_id AS entry FROM events WHERE json_extract_string(props, '$.k') = '7' ORDER BY ts DESC, event_id DESC LIMIT 50", on_graph=False)
def journal_of_edge(spark, sf_dir):
    journal = _table(spark, sf_dir, "events").select(F.col("event_id").alias("entry"), F.col("ts").alias("changed_at"), F.to_json(F.struct(F.get_json_object("props", "$.k").alias("edge"))).alias("detail"))
    return records.entries(journal, 50, "7").select("entry")


@query("SELECT event_type AS task, 'p' || (user_id % 2) AS provider, 'm' || (user_id % 3) AS model, count(*) AS calls, count(*) FILTER (event_id % 7 = 0 AND event_id % 11 <> 0) AS cache_hits, count(*) FILTER (event_id % 11 = 0) AS failures, sum(user_id) AS tokens_in, sum(user_id % 10) AS tokens_out, CAST(sum(CAST((user_id * 2 + (user_id % 10) * 3) AS DECIMAL(18, 5)) / 1000) AS DOUBLE) AS cost FROM events GROUP BY ALL", on_graph=False)
def model_costs(spark, sf_dir):
    user, status = F.col("user_id"), F.when(F.col("event_id") % 11 == 0, "error").when(F.col("event_id") % 7 == 0, "cache_hit").otherwise("ok")
    calls = _table(spark, sf_dir, "events").select(F.col("event_type").alias("task"), F.concat(F.lit("p"), user % 2).alias("provider"), F.concat(F.lit("m"), user % 3).alias("model"), status.alias("status"), (status == "cache_hit").alias("cache_hit"), user.alias("tokens_in"), (user % 10).alias("tokens_out"), scalars.cost(user, user % 10, 2.0, 3.0).alias("cost"))
    return records.usage(calls).withColumn("cost", F.col("cost").cast("double"))


@query("SELECT 'x:' || event_id AS concept_id, 'c:' || user_id AS cluster_id FROM events WHERE event_id % 10 = 0", on_graph=False)
def exclusion_list(spark, sf_dir):
    return reads.exclusions(_table(spark, sf_dir, "events").select(F.concat(F.lit("x:"), "event_id").alias("concept_id"), F.concat(F.lit("c:"), "user_id").alias("cluster_id"), (F.col("event_id") % 10 == 0).alias("excluded")))


@query("SELECT 'x:' || event_id AS concept_id, 'c:' || user_id AS cluster_id, event_id % 4 AS seen FROM events WHERE event_id % 10 <> 0 AND event_id % 4 >= 2", on_graph=False)
def candidate_list(spark, sf_dir):
    rows = _table(spark, sf_dir, "events").select(F.concat(F.lit("x:"), "event_id").alias("concept_id"), F.concat(F.lit("c:"), "user_id").alias("cluster_id"), (F.col("event_id") % 4).alias("seen"), F.col("value").alias("score"), (F.col("event_id") % 10 == 0).alias("excluded"))
    return reads.candidates(rows, 2).drop("score", "excluded")


@query(" SELECT id, title, (SELECT count(*) FROM edges WHERE kind = 'member' AND from_id = c.id) AS members FROM concepts c WHERE type = 'Cluster' AND status <> 'tombstone' AND scope = 'geo' AND id > 'region:1' ORDER BY id LIMIT 2")
def cluster_page(spark, sf_dir):
    return catalogue.overview(*graph.load(spark, sf_dir), "geo", 2, "region:1").select("id", "title", "members")


@query(", p AS (SELECT id FROM concepts WHERE store = 'shared' AND scope = 'catalog' AND status <> 'tombstone' AND curated ORDER BY id LIMIT 120), i AS (SELECT * FROM edges WHERE from_store = 'shared' AND to_store = 'shared' AND kind = 'implements' AND from_id IN (SELECT id FROM p) AND to_id IN (SELECT id FROM p)), d AS (SELECT id, count(*) AS n FROM (SELECT from_id AS id FROM i UNION ALL SELECT to_id FROM i) GROUP BY id) SELECT p.id, coalesce(n, 0) AS degree FROM p LEFT JOIN d USING (id)")
def map_page(spark, sf_dir):
    return catalogue.map_page(*graph.load(spark, sf_dir), "shared", 120, kinds=["implements"], scope="catalog", curated=True)[0].select("id", "degree")


@query(", ends AS (SELECT from_id AS id FROM edges WHERE kind <> 'member' UNION SELECT to_id FROM edges WHERE kind <> 'member') SELECT store, count(*) AS concepts, count(*) FILTER (type = 'Cluster') AS clusters, count(*) FILTER (type <> 'Cluster' AND id NOT IN (SELECT id FROM ends)) AS loose, (SELECT count(*) FROM edges WHERE from_store = c.store) AS edges FROM concepts c WHERE status <> 'tombstone' GROUP BY store")
def store_totals(spark, sf_dir):
    return catalogue.store_totals(*graph.load(spark, sf_dir))


@query(", c AS (SELECT id, CASE WHEN source_name IS NOT NULL THEN 'title,description,body,resource' ELSE '' END AS locked FROM concepts) SELECT id, locked FROM c")
def locked_fields(spark, sf_dir):
    return curation.locked_fields(graph.load(spark, sf_dir)[0]).withColumn("locked", F.array_join("locked", ","))
