"""Readers and mappings on small files."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from noema.sources import mapping, readers

VALUE = {"a": {"b": [{"n": 1}, {"n": 2}], "odd key": "x", "none": None}, "list": [1, 2, 3], "s": "t"}


@pytest.mark.parametrize(
    ("path", "want"),
    [("$", [VALUE]), ("$.s", ["t"]), ("$.a['odd key']", ["x"]), ('$["a"].none', [None]), ("$.list[0]", [1]), ("$.list[-1]", [3]), ("$.list[9]", []), ("$.list[*]", [1, 2, 3]), ("$.a.b[*].n", [1, 2]), ("$.a[*]", [[{"n": 1}, {"n": 2}], "x", None]), ("$.no.way", []), ("$.s.x", []), (" $.list[ 1 ] ", [2])],
)
def test_paths(spark, path, want):
    assert mapping.find(VALUE, mapping.steps(path)) == want
    df = spark.createDataFrame([(json.dumps(VALUE),), (None,), ("no json",)], "raw string")
    assert [[json.loads(x) for x in r[0]] for r in df.select(mapping.json_find(F.col("raw"), path)).collect()] == [want, [], []]


@pytest.mark.parametrize("path", ["", "a", "$.", "$.1", "$[", "$['a", "$[x]", "$a", "$[1--2]"])
def test_paths_that_are_none(path):
    with pytest.raises(mapping.PathError):
        mapping.steps(path)


def test_mapping(spark):
    docs = spark.createDataFrame([(json.dumps({"t": {"x": "new"}, "l": [{"n": "p"}, {"n": None}, {"n": 7}], "d": "2026-01-02"}), "old", ["q"]), (json.dumps({"t": {"x": {"deep": 1}}}), "old", ["q"]), (None, "old", None)], "raw string, title string, tags array<string>")
    got = mapping.mapped(docs, "raw", {"title": "$.t.x", "tags": "$.l[*].n", "updated_at": "$.d"}).collect()
    assert [(r["title"], r["tags"], r["error"]) for r in got] == [("new", ["p", "7"], None), ("old", ["q"], "title names a nested value"), ("old", None, None)]
    assert got[0]["updated_at"].day == 2
    with pytest.raises(mapping.PathError):
        mapping.mapped(docs, "raw", {"colour": "$.t"})


def test_drafts_and_admission(spark):
    docs = spark.createDataFrame([("1", "t", None, None, None, ["a"], None, None, [("2", "references"), ("issue:K-1", "related"), ("odd:thing", "related")])], "external_id string, title string, description string, body string, url string, tags array<string>, updated_at timestamp, type_hint string, references array<struct<target:string,kind:string>>")
    got = mapping.drafts(docs, source="w1", prefix="wiki", scope="eng", kind="Page", store="shared", known=["issue", "wiki"])
    row = got.first()
    assert (row["id"], row["type"], row["source_name"], [r["target"] for r in row["references"]]) == ("wiki:1", "Page", "w1", ["wiki:2", "issue:K-1", "wiki:odd:thing"])
    scopes = spark.createDataFrame([("eng", "shared"), ("own", "personal")], "scope string, store string")
    types = spark.createDataFrame([("Page", "shared"), ("Note", "personal")], "type string, store string")
    tried = [got, got.withColumn("scope", F.lit("x")), got.withColumn("scope", F.lit("own")), got.withColumn("type", F.lit("x")), got.withColumn("type", F.lit("Note"))]
    assert [mapping.admitted(t, scopes, types).first()["reason"] for t in tried] == [None, "unknown scope", "scope of another store", "unknown type", "type not in this store"]


def page(n, title, body, labels=(), space="E", when="2026-03-02T10:00:00.000Z"):
    return {"id": str(n), "type": "page", "title": title, "space": {"key": space, "name": "n"}, "excerpt": "x", "body": {"storage": {"value": body}}, "version": {"number": 1, "when": when}, "metadata": {"labels": [{"name": x} for x in labels]}, "links": {"webui": f"/p/{n}"}}


def test_wiki_pages(spark, tmp_path):
    link = '<ac:link><ri:page {}ri:content-title="{}"/></ac:link>'
    pages = [page(1, "A", link.format("", "B") + link.format('ri:space-key="F" ', "C") + link.format("", "Z") + '<a href="/x/BA">s</a><a href="/display/E/B">d</a>'), page(2, "B", "b", ["draft"]), page(3, "C", "c", space="F"), page(4, "D", "d", when="2026-01-01T00:00:00Z")]
    for p in pages:
        (tmp_path / f"{p['id']}.json").write_text(json.dumps(p))
    got = {r["external_id"]: r for r in readers.wiki_pages(spark, str(tmp_path), web="http://w/").collect()}
    assert [x["target"] for x in got["1"]["references"]] == ["page:2", "page:3", "page:4"] and got["1"]["url"] == "http://w/p/1" and got["2"]["references"] == []
    ids = lambda **k: sorted(r["external_id"] for r in readers.wiki_pages(spark, str(tmp_path), **k).collect())
    assert ids(spaces=["F"]) == ["3"] and ids(exclude_tags=["draft"]) == ["1", "3", "4"] and ids(since="2026-02-01") == ["1", "2", "3"]


def test_issues(spark, tmp_path):
    def issue(key, **fields):
        base = {"summary": "s", "description": "d", "labels": [], "updated": "2026-03-02T10:00:00.000Z", "status": {"name": "Open"}, "project": {"key": key.split("-")[0]}}
        (tmp_path / f"{key}.json").write_text(json.dumps({"key": key, "references": [], "fields": base | fields}))

    issue("AB-1", issuelinks=[{"type": {"name": "Blocks"}, "inwardIssue": {"key": "AB-2"}}, {"type": {"name": "Blocks"}, "outwardIssue": {"key": "AB-3"}}, {"type": {"name": "Cloners"}, "outwardIssue": {"key": "AB-4"}}], subtasks=[{"key": "AB-5"}], remotelinks=[{"globalId": "appId=1&pageId=77"}, {"globalId": "x", "object": {"url": "http://w/x/AQ"}}, {"object": {"url": "http://o/"}}])
    issue("CD-1", status={"name": "Done"}, labels=["old"])
    row = readers.issues(spark, str(tmp_path), pages="page", projects=["AB"]).first()
    assert [(x["target"], x["kind"]) for x in row["references"]] == [("issue:AB-5", "member"), ("issue:AB-2", "depends_on"), ("issue:AB-4", "related"), ("page:77", "references"), ("page:1", "references")]
    ids = lambda **k: sorted(r["external_id"] for r in readers.issues(spark, str(tmp_path), **k).collect())
    assert ids(statuses=["Done"]) == ["CD-1"] and ids(exclude_tags=["old"]) == ["AB-1"] and ids(since="2026-04-01") == []


def test_files(spark, tmp_path):
    texts = {"a/one.md": "<!-- doc0123456789ab -->\n# One \\(1\\)\n\nFirst prose. See [two](../b/two.md#x), [out](../../c.md), [web](http://x/y.md).", "b/two.md": "no heading", "b/index.md": "[a](../a/one.md)", "top.md": "# Top\n\n[i](b/index.md)"}
    for name, text in texts.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        Path(tmp_path / name).write_text(text)
    rows = {r["external_id"]: r for r in readers.files(spark, str(tmp_path), marker="doc", web="http://d").collect()}
    assert sorted(rows) == ["0123456789ab", "b/index.md", "b/two.md", "top.md"]
    one = rows["0123456789ab"]
    assert (one["title"], one["description"][:12], one["tags"], one["url"], [r["target"] for r in one["references"]]) == ("One (1)", "First prose.", ["a"], "http://d/a/one.md", ["b/two.md"])
    assert rows["b/two.md"]["title"] == "two" and rows["top.md"]["tags"] == [] and [r["target"] for r in rows["b/index.md"]["references"]] == ["0123456789ab"]
    ids = lambda **k: sorted(r["external_id"] for r in readers.files(spark, str(tmp_path), **k).collect())
    assert ids(folders=["b"]) == ["b/index.md", "b/two.md"] and ids(exclude=["*index.md"]) == ["a/one.md", "b/two.md", "top.md"] and ids(limit=2) == ["a/one.md", "b/index.md"]


def test_json_documents(spark, tmp_path):
    (tmp_path / "x.json").write_text(json.dumps([{"external_id": "1", "title": "t", "tags": ["a"], "references": ["2"], "more": {"deep": 5}}, {"external_id": "2", "references": [{"target": "1", "kind": "related"}]}]))
    got = {r["external_id"]: r for r in readers.json_documents(spark, str(tmp_path), ['{"external_id": "3", "more": {"deep": "in"}}'], {"title": "$.more.deep"}).collect()}
    assert sorted(got) == ["1", "2", "3"]
    assert (got["1"]["title"], got["1"]["tags"], json.loads(got["1"]["extra"]), got["3"]["title"]) == ("5", ["a"], {"more": {"deep": 5}}, "in")
    assert [(x["target"], x["kind"]) for k in "12" for x in got[k]["references"]] == [("2", "references"), ("1", "related")]
