"""Tools of an agent, and merges by field."""

import json

import pytest

from noema.operators import curation, merge
from noema.plans.service import Service, capped
from pyspark.sql import functions as F

WHEN = {"actor": "me", "now": "2026-01-02 03:04:05"}


def test_capped():
    long = {"id": "x" * 90, "body": "b" * 900, "hits": [{"n": k, "t": "y" * 20} for k in range(50)]}
    got = capped(long, 100)
    assert got["id"] == long["id"] and got["truncated"] and len(got["hits"]) == 1
    assert len(json.dumps(got | {"truncated": 0})) <= 430
    assert capped({"id": "a"}, 10) == {"id": "a"}


def test_tools(spark):
    tools = Service(curation.empty(spark))
    assert tools.concept_upsert("note:a", "s", "Note", "Red thing", **WHEN)["outcome"] == "created"
    assert tools.concept_upsert("note:a", "s", "Note", "Red house", **WHEN)["outcome"] == "updated"
    tools.link_add("note:a", "part:1", "references", **WHEN)
    got = tools.concept_get("personal", "note:a")
    assert got["title"] == "Red house" and [e["other"] for e in got["edges"]] == ["part:1"]
    assert tools.graph_search("house")["hits"][0]["id"] == "note:a"
    assert [n["id"] for n in tools.graph_traverse("note:a", WHEN["now"])["nodes"]] == ["note:a"]
    assert tools.graph_overview()["clusters"] == [] and tools.graph_schema()["counts"][0]["n"] == 1
    with pytest.raises(curation.CurationError):
        tools.graph_traverse("note:z", WHEN["now"])
    with pytest.raises(curation.CurationError):
        tools.link_add("note:a", "part:1", "likes", **WHEN)


def test_merged_without_change_keeps_time(spark):
    fields = "id string, store string, scope string, type string, title string, description string, body string, resource string, tags array<string>, status string, source_name string"
    row = ("a", "s", "x", "T", "t", None, None, None, ["k"], "active", "wiki")
    new = spark.createDataFrame([row[:4] + ("other",) + row[5:], ("b",) + row[1:]], fields)
    old = spark.createDataFrame([row, ("c",) + row[1:]], fields).withColumns({"curated": F.lit(True), "verified": F.lit(True), "content_hash": F.lit("h"), "updated_at": F.to_timestamp(F.lit("2020-01-01"))})
    got = {r["id"]: r for r in merge.merged(old, new, "2021-01-01").collect()}
    assert (got["a"]["outcome"], got["a"]["title"], got["a"]["held_back"], got["a"]["updated_at"].year, got["a"]["verified"]) == ("conflict", "t", ["title"], 2020, True)
    assert got["b"]["outcome"] == "created" and got["c"]["outcome"] is None and got["c"]["updated_at"].year == 2020
    mirrored = {r["id"]: r for r in merge.merged(old, new, "2021-01-01", True).collect()}["a"]
    assert (mirrored["outcome"], mirrored["title"], mirrored["verification_reset"], mirrored["updated_at"].year) == ("updated", "other", True, 2021)


def test_texts_share_what_room_there_is():
    got = capped({"a": "x" * 1000, "b": "y" * 50, "c": "z" * 700}, 100)
    assert len(got["a"]) == len(got["c"]) > len(got["b"]) == 50 and got["truncated"]
    assert 380 <= len(json.dumps(got)) <= 425
    assert capped({"a": "x" * 1000, "b": ""}, 1)["a"] == ""


def test_search_in_two_stages_and_scopes(spark):
    one = lambda i, store, scope, title, kind="Note": (i, store, scope, kind, title, None, None, None, [], "active", False, None, "h", None)
    concepts = spark.createDataFrame([one("c:1", "shared", "docs", "Group", "Cluster"), one("a", "shared", "docs", "red house"), one("b", "personal", "notes", "red boat")], curation.CONCEPT)
    state = curation.empty(spark)
    tools = Service(curation.State(concepts, state.edges, state.rejections, state.candidates, state.journal), scopes={"docs": "shared", "notes": "personal"}, types=("Note",))
    assert tools.graph_search("red", scope="docs") | {"hits": 0} == {"query": "red", "store": "shared", "stage": "lexical", "hits": 0}
    assert [h["id"] for h in tools.graph_search("red", scope="docs")["hits"]] == ["a"] and [h["id"] for h in tools.graph_search("red", store="personal")["hits"]] == ["b"]
    assert sorted(h["id"] for h in tools.graph_search("red")["hits"]) == ["a", "b"]
    vector = "id string, vector array<double>"
    tools.vectors, tools.centroids = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], vector), spark.createDataFrame([("c:1", [1.0, 0.1])], vector)
    tools.embed = lambda q: [1.0, 0.0] if q == "red" else [-1.0, 0.0]
    assert [(h["stage"], h["id"]) for h in tools.graph_search("red")["hits"]] == [("cluster", "c:1")]
    assert tools.graph_search("boat")["stage"] == "concept" and tools.graph_search("boat")["hits"][0]["id"] == "b"
    assert tools.graph_search("red", granularity="concept", scope="docs")["hits"][0]["id"] == "a"
    nothing = tools.graph_search("red", granularity="cluster", store="personal")
    assert nothing["hits"] == [] and "next_step" in nothing
    for wrong in ({"scope": "none"}, {"granularity": "page"}):
        with pytest.raises(curation.CurationError):
            tools.graph_search("red", **wrong)
    rules = tools.graph_schema()
    assert rules["stores"][1] == {"name": "personal", "writable": True} and rules["scopes"][0] == {"name": "docs", "store": "shared"} and rules["types"] == ["Note"] and rules["kinds"][0]["structural"]


def test_cluster_project_shows_groups_and_writes_nothing(spark):
    one = lambda k: (f"n:{k}", "personal", "s", "Note", f"t{k}", None, None, None, [], "active", False, None, "h", None)
    state = curation.empty(spark)
    tools = Service(curation.State(spark.createDataFrame([one(k) for k in range(6)], curation.CONCEPT), state.edges, state.rejections, state.candidates, state.journal))
    tools.vectors = spark.createDataFrame([(f"n:{k}", [1.0, 0.01 * k] if k < 4 else [0.0, -1.0 - k]) for k in range(6)], "id string, vector array<double>")
    assert [c["size"] for c in tools.cluster_project("s", "run")["clusters"]] == [4]
    assert tools.state.edges.isEmpty()
