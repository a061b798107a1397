"""Operators on small literal rows."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from noema.functions import scalars
from noema.operators import catalogue, search, traverse, vectors
from noema.sources import readers
from noema.streaming import ingest

EDGE = "from_store string, from_id string, to_store string, to_id string, kind string, weight double, confidence double, generated boolean"


def test_node_limit_keeps_what_is_met_first(spark):
    edges = spark.createDataFrame([("s", "a:0", "s", f"a:{k}", "related", 1.0, None, False) for k in range(1, 9)], EDGE)
    start = spark.createDataFrame([("s", "a:0")], "store string, id string")
    found = traverse.expand(edges, start, 3, 4)
    assert sorted(r["id"] for r in found.nodes.collect()) == ["a:0", "a:1", "a:2", "a:3"]
    assert found.truncated and found.edges.count() == 8
    whole = traverse.expand(edges, start, 3, 9)
    assert not whole.truncated and whole.nodes.count() == 9
    assert traverse.reach(edges, start, 0).count() == 1


def test_equal_ids_of_two_stores_are_two_nodes(spark):
    edges = spark.createDataFrame([("x", "n:1", "x", "n:2", "related", 1.0, None, False), ("y", "n:2", "y", "n:3", "related", 1.0, None, False)], EDGE)
    start = spark.createDataFrame([("x", "n:1")], "store string, id string")
    for most in (None, 10):
        assert sorted((r["store"], r["id"], r["hops"]) for r in traverse.reach(edges, start, 3, most).collect()) == [("x", "n:1", 0), ("x", "n:2", 1)]


def test_filters_hold_while_expanding(spark):
    edges = spark.createDataFrame([("s", "a:0", "s", "a:1", "x", 1.0, None, False), ("s", "a:1", "s", "a:2", "y", 1.0, None, False), ("t", "b:1", "s", "a:0", "y", 1.0, None, False)], EDGE)
    start = spark.createDataFrame([("s", "a:0")], "store string, id string")
    assert {r["id"] for r in traverse.reach(edges, start, 2, kinds=["y"]).collect()} == {"a:0", "b:1"}
    assert {r["id"] for r in traverse.reach(edges, start, 2, stores=["u"]).collect()} == {"a:0", "a:1", "a:2"}
    assert {r["id"] for r in traverse.reach(edges, start, 1, stores=["t"]).collect()} == {"a:0", "a:1", "b:1"}


def test_density_counts_membership_as_free(spark):
    edges = spark.createDataFrame([("personal", "p:1", "s", "c:1", "references", 1.0, None, False), ("s", "c:1", "s", "n:1", "member", 1.0, None, False)], EDGE)
    got = {r["id"]: r["density"] for r in traverse.density(edges, 1).collect()}
    assert got == {"c:1": 1, "n:1": 1}


def test_traverse_of_nothing(spark):
    concepts = spark.createDataFrame([], "store string, id string, type string, status string, updated_at timestamp")
    with pytest.raises(LookupError):
        traverse.traverse(concepts, spark.createDataFrame([], EDGE), spark.createDataFrame([("s", "a")], "store string, id string"), "2026-01-01")


def test_unverified_leaves_out_what_was_looked_at(spark):
    rows = [("s", "a:1", "s", f"b:{k}", "related", 1.0, 0.5, True, c, v, t) for k, (c, v, t) in enumerate([(False, None, "2020"), (True, None, "2020"), (False, "2021", "2020"), (False, None, "2022")])]
    edges = spark.createDataFrame(rows, EDGE + ", curated boolean, verified string, created string").withColumns({"verified_at": F.to_timestamp("verified"), "created_at": F.to_timestamp("created")})
    assert [r["to_id"] for r in catalogue.unverified(edges, 9).collect()] == ["b:3", "b:0"]


def test_words_of_a_query_are_cut_as_those_of_texts(spark):
    concepts = spark.createDataFrame([("a", "foo-bar thing", None, "active"), ("b", "foo", None, "active")], "id string, title string, description string, status string")
    assert [r["id"] for r in search.full_text(concepts, "Foo-Bar").collect()] == ["a"]
    assert search.full_text(concepts, " - ").isEmpty() and search.lexical(concepts, "  ").isEmpty()


def test_page_cursor(spark):
    df = spark.createDataFrame([(f"a:{k}",) for k in range(5)], "id string")
    assert [tuple(r) for r in catalogue.page(df, 2, "a:0").collect()] == [("a:1", "a:2"), ("a:2", "a:2")]
    assert [r["next_cursor"] for r in catalogue.page(df, 9).collect()] == [None] * 5


def test_cosine_of_zero_vector(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 0.0]), ([3.0, 4.0], [3.0, 4.0])], "a array<double>, b array<double>")
    assert [r[0] for r in df.select(vectors.cosine(F.col("a"), F.col("b"))).collect()] == [0.0, 1.0]


def test_scalars(spark):
    df = spark.createDataFrame([("# Head\n\nFirst \\*prose\\* line\nhere.\n\nMore", "noise {\"a\": {\"b\": 1}} end", "BQADBg")], "body string, model string, tiny string")
    got = df.select(scalars.teaser(F.col("body")), scalars.json_part(F.col("model")), scalars.unique_strings(F.array(F.lit(" a"), F.lit("b"), F.lit("a"), F.lit(""))), scalars.tiny_link_id(F.col("tiny"))).first()
    assert got[0] == "First *prose* line here." and json.loads(got[1]) == {"a": {"b": 1}} and got[2] == ["a", "b"]
    assert got[3] == int.from_bytes(bytes([5, 0, 3, 6]), "little")


def test_readers(spark, tmp_path):
    page = {"id": "1", "type": "page", "title": "T", "space": {"key": "E", "name": "n"}, "excerpt": "x", "body": {"storage": {"value": "<p>b</p>"}}, "version": {"number": 1, "when": "2026-03-02T10:00:00.000Z"}, "links": {"webui": "/x"}}
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "1.json").write_text(json.dumps(page | {"metadata": {"labels": [{"name": "a"}]}}))
    (tmp_path / "p" / "2.json").write_text(json.dumps(page | {"id": "2", "metadata": {"labels": {"results": [{"name": "b"}]}}}))
    got = {r["external_id"]: r["tags"] for r in readers.wiki_pages(spark, str(tmp_path / "p")).collect()}
    assert got == {"1": ["a"], "2": ["b"]}
    issue = {"key": "K-1", "references": ["page:1"], "fields": {"summary": "s", "description": "d", "labels": [], "updated": "2026-03-02T10:00:00.000Z", "status": {"name": "Open"}, "project": {"key": "K"}, "parent": {"key": "K-0"}}}
    (tmp_path / "i").mkdir()
    (tmp_path / "i" / "1.json").write_text(json.dumps(issue))
    row = readers.issues(spark, str(tmp_path / "i")).first()
    assert [(x["target"], x["kind"]) for x in row["references"]] == [("issue:K-0", "related"), ("page:1", "references")] and row["body"] == "d" and row["description"] is None


DRAFT = "id string, store string, scope string, type string, title string, description string, body string, resource string, tags array<string>, status string, source_name string, updated_at timestamp"


def test_streaming_ingest(spark, tmp_path):
    source, state = str(tmp_path / "in"), str(tmp_path / "state")

    def draft(key, title, tags=("t",), status="active", day="2026-01-01"):
        return (key, "shared", "s", "Page", title, None, None, None, list(tags), status, "wiki", datetime.fromisoformat(day))

    def run(*rows):
        spark.createDataFrame(rows, DRAFT).coalesce(1).write.mode("append").parquet(source)
        ingest.ingest(spark.readStream.schema(DRAFT).parquet(source), state, str(tmp_path / "check")).awaitTermination()

    run(draft("a", "t"))
    run(draft("a", "u", ("v",), day="2026-02-01"), draft("a", "u", ("v",), day="2026-02-01"), draft("b", "x"))
    run(draft("b", "x"), draft("c", "gone", status="tombstone"))
    got = {r["id"]: r for r in ingest.current(spark, state).collect()}
    assert {k: (r["title"], r["tags"], r["status"]) for k, r in got.items()} == {"a": ("u", ["t", "v"], "active"), "b": ("x", ["t"], "active"), "c": ("gone", ["t"], "tombstone")}
    assert got["a"]["updated_at"].month == 2
    assert sorted((r["batch"], r["id"], r["outcome"]) for r in spark.read.parquet(state + "/journal").collect()) == [(0, "a", "created"), (1, "a", "updated"), (1, "b", "created"), (2, "b", "unchanged"), (2, "c", "created")]
    again = {r["id"]: r["title"] for r in ingest.current(spark, state, 1).collect()}
    assert again == {"a": "t"}


def test_stores_of_any_number_of_starts_are_entered(spark):
    from noema.operators import traverse

    edges = spark.createDataFrame([(f"s{k}", "a", "s0", f"b{k}", "references") for k in range(150)], "from_store string, from_id string, to_store string, to_id string, kind string")
    start = spark.createDataFrame([(f"s{k}", "a") for k in range(150)], "store string, id string")
    assert traverse.reach(edges, start, 1, None, stores=["s0"]).count() == 300
    assert traverse.reach(edges, start, 1, 400, stores=["s0"]).count() == 300
    with pytest.raises(ValueError):
        traverse.reach(edges, start, 1, 149)


def test_attached_edges_keep_to_the_rule_of_stores(spark):
    from noema.operators import curation

    schema = "from_store string, from_id string, to_store string, to_id string, kind string, resolved boolean"
    edges = spark.createDataFrame([("shared", "a", "shared", "x", "references", False), ("personal", "a", "personal", "x", "references", False)], schema)
    found = spark.createDataFrame([("x",)], "id string")
    moved = {s: sorted((r["from_store"], r["to_store"]) for r in curation.attach(edges, s, found).collect()) for s in ("personal", "shared")}
    assert moved["personal"] == [("personal", "personal"), ("shared", "shared")]
    assert moved["shared"] == [("personal", "shared"), ("shared", "shared")]


def test_neighbours_of_null_and_equal_vectors(spark):
    rows = spark.createDataFrame([(k, [1.0, 0.5]) for k in range(40)] + [(50, None), (None, [1.0, 0.5]), (60, [0.0, 0.0])], "id long, vector array<double>")
    got = {}
    for r in vectors.neighbours(rows, 3).collect():
        got.setdefault(r["id"], []).append((r["rank"], r["other"]))
    assert set(got) == {*range(40), 60} and sorted(got[5]) == [(1, 0), (2, 1), (3, 2)] and sorted(got[1]) == [(1, 0), (2, 2), (3, 3)]


def test_a_merge_touches_only_its_buckets(spark, tmp_path):
    from noema.sources.buckets import Buckets

    table = Buckets(spark, str(tmp_path / "state"), "id string, n long", count=16)
    put = lambda before, batch: before.unionByName(batch).groupBy("id").agg(F.max("n").alias("n"))
    batch = lambda rows: spark.createDataFrame(rows, "id string, n long")
    table.merge(0, batch([(f"k{k}", 0) for k in range(200)]), put)
    first = table.manifest()
    assert set(first.values()) == {0} and len(first) == 16
    for _ in range(2):  # a batch that runs again makes the same rows
        table.merge(1, batch([("k1", 5), ("new", 6), ("k1", 3)]), put)
        now = table.manifest()
        assert 1 <= sum(v == 1 for v in now.values()) <= 2
        opened = table.read(1, [b for b, v in now.items() if v == 1]).inputFiles()
        assert len({f.split("bucket=")[1].split("/")[0] for f in opened}) == sum(v == 1 for v in now.values())
        assert {r["id"]: r["n"] for r in table.read().collect()} == {f"k{k}": 0 for k in range(200)} | {"k1": 5, "new": 6}
    assert table.read(1).count() == 200 and table.merge(2, batch([]), put).count() == 0 and table.read().count() == 201


def test_rows_as_json(spark):
    from noema.operators import curation, reads

    concepts = spark.createDataFrame([("a", "long", None, datetime(2026, 1, 2, 3, 4, 5), ["x"])], "id string, body string, title string, updated_at timestamp, tags array<string>")
    assert json.loads(reads.serialised(concepts).first()["json"]) == {"id": "a", "title": None, "updated_at": "2026-01-02T03:04:05Z", "tags": ["x"]}
    edges = spark.createDataFrame([("s", "a", "s", "b", "related", 0.5, None)], "from_store string, from_id string, to_store string, to_id string, kind string, weight double, verified_at timestamp")
    row = reads.serialised_edges(edges).first()
    assert (row["from_id"], row["kind"]) == ("a", "related") and json.loads(row["json"])["weight"] == 0.5 and json.loads(row["json"])["verified_at"] is None
    journal = curation.create_concept(curation.empty(spark), "note:a", "s", "Note", "t", actor="me", now="2026-01-02 03:04:05").journal
    got = json.loads(reads.serialised_entries(journal).first()["json"])
    assert (got["entry"], got["change"], got["changed_at"]) == (1, "created", "2026-01-02T03:04:05Z") and isinstance(got["detail"], dict)
