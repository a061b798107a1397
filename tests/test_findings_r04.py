"""What the review of the fourth round found, each as a small case."""

import json
import os
from pathlib import Path

import duckdb
import numpy as np
from pyspark.sql import functions as F

from noema.operators import models, records, relations, vectors
from noema.plans import pipelines, registry

DATA = Path("/root/testdata/sf0.001")


def _beside(tmp_path, spark, vectors) -> str:
    """The smallest tables with other vectors (vec_id, embedding, label)."""
    for file in DATA.glob("*.parquet"):
        if file.stem != "embeddings":
            os.symlink(file, tmp_path / file.name)
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    return str(tmp_path)


def _sql(name: str, sf_dir: str) -> list[tuple]:
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf_dir}/embeddings.parquet/*.parquet'")
    return con.execute(registry.oracle_sql()[name]).fetchall()


def test_no_cluster_is_near(spark, tmp_path):
    """where no centroid is near enough, the stage of clusters finds nothing, as its SQL does; it answered with concepts."""
    sf_dir = _beside(tmp_path, spark, [(1, [1.0, 0.0], 0), (2, [-1.0, 0.1], 0), (3, [-1.0, 0.2], 1), (4, [0.0, 1.0], 2)])
    assert _sql("staged_search", sf_dir) == []
    assert registry.queries()["staged_search"](spark, sf_dir).collect() == []


def test_centroids_of_rows(spark, tmp_path):
    """a centroid is the mean of the rows of its label, also of those whose number repeats or is missing."""
    sf_dir = _beside(tmp_path, spark, [(1, [1.0, 0.5], 0), (2, [1.0, 0.0], 0), (2, [0.0, 1.0], 1), (None, [1.0, 1.0], 1), (5, [3.0, -1.0], 2)])
    assert list(map(tuple, registry.queries()["staged_search"](spark, sf_dir).collect())) == _sql("staged_search", sf_dir)


def test_components_of_long_ways(spark):
    """ways through all nodes, in an order that no round of labels follows far, settle in few rounds; so do loops, stars and pairs of structs."""
    rng = np.random.default_rng(3)
    order = rng.permutation(6000).tolist()
    links = [*zip(order[:3000], order[1:3000], strict=False), *zip(order[3000:], order[3001:], strict=False)]
    links += [(7000, 7000), *((k, 9999) for k in range(9000, 9400)), (8000, 8001), (8001, 8000)]
    want = {n: min(side) for side in (order[:3000], order[3000:], [7000], [*range(9000, 9400), 9999], [8000, 8001]) for n in side}
    pairs = spark.createDataFrame(links, "id long, other long").unionAll(spark.createDataFrame([(None, 1), (2, None)], "id long, other long"))
    assert dict(map(tuple, vectors.components(pairs, small=100, rounds=20).collect())) == want
    keyed = pairs.select(F.struct(F.lit(1).alias("level"), F.col("id").alias("node")).alias("id"), F.struct(F.lit(1).alias("level"), F.col("other").alias("node")).alias("other")).where("id.node is not null and other.node is not null")
    assert {r["node"]["node"]: r["component"]["node"] for r in vectors.components(keyed, small=100, rounds=20).collect()} == want


def test_pairs_are_never_sent(spark):
    """pairs of the query aren't shuffled, neither to edges nor to vectors; only members, their vectors and counts are."""
    plan = registry.queries()["relation_prefilter"](spark, str(DATA))._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(low" not in plan and "hashpartitioning(a_" not in plan
    assert plan.count("Exchange hashpartitioning(cluster_id") <= 9


def _cell(row):
    return tuple("-" if x is None else repr(x) for x in row)


def test_blocks_of_pairs_give_the_prefilter(spark, monkeypatch):
    """blocks give the rows of the prefilter of all pairs, with members in several clusters, missing and repeated vectors, edges from outside, and text ids; counted, they give the open ones and how many others there are."""
    monkeypatch.setattr(relations, "CHUNK", 7)
    monkeypatch.setattr(relations, "TASK_PAIRS", 100)
    rng = np.random.default_rng(8)
    members = spark.createDataFrame([(f"c{k % 3}", f"v{k}") for k in range(60)] + [(f"c{k % 2}", f"v{k}") for k in range(0, 60, 7)] + [(None, "v1"), ("c1", None), ("c9", "alone")], "cluster_id string, concept_id string").withColumn("weight", F.lit(1.0))
    held = [(f"v{k}", rng.normal(size=5).tolist()) for k in range(55)] + [("v3", [1.0] * 5), ("v57", None), ("v58", [1.0] * 3), ("v59", [0.0] * 5), ("alone", [1.0] * 5), ("v2", [1.0, None, 2.0, 3.0, 4.0])]
    v = spark.createDataFrame(held, "id string, vector array<double>")
    edges = spark.createDataFrame([(f"v{a}", f"v{b}", "k") for a, b in rng.integers(0, 60, (300, 2)).tolist()] + [("x", "v1", "k"), ("v3", "v0", "other")], "from_id string, to_id string, kind string")
    refused = spark.createDataFrame([(f"v{a}", f"v{b}", "k") for a, b in rng.integers(0, 60, (300, 2)).tolist()], "from_id string, to_id string, kind string")
    want = sorted(map(_cell, relations.prefilter(relations.pairs_inside(members), v, edges, refused, ["k"], 0.1).collect()))
    assert sorted(map(_cell, relations.judged_inside(members, v, edges, refused, ["k"], 0.1).collect())) == want
    related = spark.createDataFrame([("c9", "c0")], "a string, b string")
    every = relations.prefilter(relations.candidate_pairs(members, related), v, edges, refused, ["k"], 0.1)
    got = relations.judged(members, related, v, edges, refused, ["k"], 0.1)
    assert dict(map(tuple, got.groupBy("reason").agg(F.sum("n")).collect())) == dict(map(tuple, every.groupBy("reason").count().collect()))
    assert sorted(map(_cell, got.where("reason = 'open'").drop("n").collect())) == sorted(map(_cell, every.where("reason = 'open'").collect()))


def test_requests_travel_once(spark):
    """requests meet by key once and are written with their answers; those of a key are asked once, whatever the cache and the budget say."""
    key = F.sha2(F.col("prompt").cast("binary"), 256)
    asked = spark.createDataFrame([(k, f"p{k % 7}") for k in range(40)], "n long, prompt string").select("n", key.alias("key"), "prompt")
    names = {r["key"]: r["prompt"] for r in asked.collect()}
    cache = spark.createDataFrame([("p1", "{}"), ("p1", "{}")], "prompt string, answer string").select(key.alias("key"), "answer")
    over = spark.createDataFrame([("p2",)], "prompt string").select(key.alias("key"))
    seen = spark.sparkContext.accumulator(0)

    def ask(prompt):
        seen.add(1)
        return json.dumps({"said": prompt}) if not prompt.startswith("p3") else "nothing"

    got = models.replied(asked, cache, over, ask, wait=0.0)
    rows = got.collect()
    assert seen.value == 4 + 2  # an answer that can't be used is asked for once more, and reading asks nobody
    assert got.columns == ["n", "key", "first", "status", "answer", "attempts", "error", "log"]
    assert sorted(r["n"] for r in rows) == list(range(40)) and sum(r["first"] for r in rows) == 7
    status = {"p1": "cache_hit", "p2": "over_budget", "p3": "invalid_output"}
    assert all(r["status"] == status.get(names[r["key"]], "ok") for r in rows)
    assert all(json.loads(r["answer"]) == {"said": names[r["key"]]} for r in rows if r["status"] == "ok")
    assert {names[r["key"]]: len(r["log"]) for r in rows if r["log"] is not None} == {"p0": 1, "p3": 2, "p4": 1, "p5": 1, "p6": 1}


def test_a_run_writes_little(spark, tmp_path, monkeypatch):
    """of 120 pairs those that aren't open are counted, and no table of requests is written beside that of answers."""
    written = []
    for module in (relations, models, pipelines, records):
        real = module.checkpointed
        monkeypatch.setattr(module, "checkpointed", lambda df, real=real: written.append((out := real(df)).columns) or out)
    sf_dir = _beside(tmp_path, spark, [(k, [float(k % 3), 1.0, float(k % 5)], k % 2) for k in range(40)])
    got = sorted(map(tuple, registry.queries()["relation_run"](spark, sf_dir).collect()))
    assert got == sorted(_sql("relation_run", sf_dir)) and got
    assert not any("prompt" in columns for columns in written)
    assert sum("key" in columns for columns in written) == 1
