"""Runs and curation against brute force on small rows."""

import itertools
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from noema.operators.common import checkpointed
from noema.operators import clusters, curation, models, relations, vectors
from noema.sources import snapshots

PAIRS = "id int, other int, similarity double"
WHEN = {"actor": "me", "now": "2026-01-02 03:04:05"}


def parts(nodes, pairs):
    left, out = set(nodes), []
    near = {n: set() for n in nodes}
    for a, b, _ in pairs:
        if a in near and b in near:
            near[a].add(b)
            near[b].add(a)
    while left:
        todo, seen = [left.pop()], set()
        while todo:
            n = todo.pop()
            seen.add(n)
            todo += [m for m in near[n] if m not in seen]
        left -= seen
        out.append(seen)
    return out


def cut(group, pairs, most, base):
    if len(group) <= most:
        return [group]
    least = base
    for _ in range(10):
        least += (1 - least) / 4
        kept = [p for p in pairs if p[2] >= least]
        found = parts(group, kept)
        if len(found) > 1:
            return [g for part in found for g in cut(part, kept, most, base)]
    ordered = sorted(group)
    return [set(ordered[k : k + most]) for k in range(0, len(ordered), most)]


def test_narrowed_as_by_recursion(spark):
    dice = random.Random(5)
    pairs = [(a, b, round(dice.uniform(0.55, 1), 3)) for a, b in itertools.combinations(range(40), 2) if dice.random() < 0.08]
    pairs += [(a, b, 0.999) for a, b in itertools.combinations(range(50, 58), 2)]
    df = spark.createDataFrame(pairs, PAIRS)
    got: dict[int, set[int]] = {}
    for r in clusters.narrowed(vectors.components(df), df, 5).collect():
        got.setdefault(r["component"], set()).add(r["node"])
    linked = {n for p in pairs for n in p[:2]}
    want = [g for part in parts(linked, pairs) for g in cut(part, pairs, 5, 0.55)]
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want))


def test_continued_as_by_turns(spark):
    dice = random.Random(9)
    groups = [(n, f"g{dice.randrange(12):02}") for n in range(120)]
    earlier = [(n, f"c{dice.randrange(9)}") for n in range(0, 120, 2)]
    by = {}
    for n, g in groups:
        by.setdefault(g, set()).add(n)
    taken, want = set(), {}
    for g in sorted(by, key=lambda g: (-len(by[g]), min(by[g]))):
        best = None
        for c in sorted({c for _, c in earlier} - taken):
            shared = len(by[g] & {n for n, x in earlier if x == c})
            if shared and (best is None or shared > best[0]):
                best = (shared, c)
        want[g] = best and best[1]
        taken |= {want[g]} - {None}
    got = clusters.continued(spark.createDataFrame(groups, "node int, component string"), spark.createDataFrame(earlier, "concept_id int, cluster_id string"))
    assert {r["component"]: r["cluster_id"] for r in got.collect()} == want


def test_members_after_two_runs(spark):
    dice = np.random.default_rng(1)
    centers = np.eye(8)[:3]
    rows = [(f"n{k:02}", (centers[k % 3] + dice.normal(0, 0.05, 8)).tolist()) for k in range(24)]
    v = spark.createDataFrame(rows, "id string, vector array<double>")
    members, candidates = spark.createDataFrame([], "cluster_id string, concept_id string"), spark.createDataFrame([], clusters.CANDIDATE)
    first = clusters.run(v, members, candidates, "one")
    assert first.members.isEmpty() and first.candidates.count() == 24
    barred = clusters.exclude(first.candidates, first.candidates.where("concept_id = 'n00'"))
    second = clusters.run(v, members, barred, "two")
    assert second.members.count() == 23 and second.members.where("concept_id = 'n00'").isEmpty()
    ids = lambda r: sorted(x["cluster_id"] for x in r.candidates.select("cluster_id").distinct().collect())
    assert ids(first) == ids(second) and len(ids(first)) == 3
    assert second.centroids.count() == 3 and second.related.count() == 6


def test_repeated_run_counts_once(spark):
    seen = spark.createDataFrame([("a", "c", 0.5)], "concept_id string, cluster_id string, score double")
    once = clusters.observed(spark.createDataFrame([], clusters.CANDIDATE), seen, "r")
    twice = clusters.observed(once, seen, "r")
    assert twice.first()["seen"] == 1 and clusters.observed(twice, seen.limit(0), "s").isEmpty()


def test_pairs_of_a_large_cluster(spark, monkeypatch):
    monkeypatch.setattr(relations, "CHUNK", 4)
    members = spark.createDataFrame([("c", f"{k:02}") for k in range(19)], "cluster_id string, concept_id string")
    got = [tuple(r) for r in relations.pairs_inside(members).collect()]
    assert sorted(got) == list(itertools.combinations(sorted(f"{k:02}" for k in range(19)), 2))


def test_answers_repair_retry_and_cache(spark):
    def model(prompt):
        if "down" in prompt:
            raise OSError("no provider")
        if "bad" in prompt:
            return "nothing"
        if "mend" in prompt and "could not be used" not in prompt:
            return "{}"
        return 'so {"title": "x"}'

    asked = spark.createDataFrame([("1", "plain"), ("1", "plain"), ("2", "bad"), ("3", "mend"), ("4", "down"), ("5", "known")], "key string, prompt string")
    cache = spark.createDataFrame([("5", '{"title": "k"}')], "key string, answer string")
    got = {r["key"]: (r["status"], r["attempts"]) for r in models.answered(asked, cache, model, ("title",), 1, 0.0).collect()}
    assert got == {"1": ("ok", 1), "2": ("invalid_output", 2), "3": ("ok", 2), "4": ("error", 2), "5": ("cache_hit", 0)}
    assert models.within_budget(asked, 9, 0.0, 10).count() == 1 and models.within_budget(asked, 0, 5.0).isEmpty()


def test_hashed_vectors(spark):
    got = models.embedded(spark.createDataFrame([(1, "Red red"), (2, "..."), (3, ""), (4, None)], "id int, text string"), 16)
    rows = {r["id"]: r["vector"] for r in got.collect()}
    assert sorted(rows) == [1, 2] and rows[2] == [1.0] + [0.0] * 15 and sorted(map(abs, rows[1])) == [0.0] * 15 + [1.0]


def key(a, b, kind="related", store="personal", other="personal"):
    return {"from_store": store, "from_id": a, "to_store": other, "to_id": b, "kind": kind}


@pytest.fixture
def state(spark):
    out = curation.empty(spark)
    for k in "ab":
        out = curation.create_concept(out, f"note:{k}", "s", "Note", k, **WHEN)
    return out


def edges(state):
    return sorted((r["from_id"], r["to_id"], r["kind"]) for r in state.edges.collect())


def test_edges_and_their_undoing(state):
    one = curation.add_edge(state, key("note:a", "note:b"), **WHEN)
    with pytest.raises(curation.CurationError):
        curation.add_edge(one, key("note:a", "note:b"), **WHEN)
    with pytest.raises(curation.CurationError):
        curation.add_edge(one, key("x:a", "note:b", store="shared"), **WHEN)
    two = curation.reject_edge(one, key("note:a", "note:b"), "wrong", **WHEN)
    assert edges(two) == [] and two.rejections.count() == 1
    three = curation.undo(two, 4, **WHEN)
    assert edges(three) == edges(one) and three.rejections.isEmpty() and three.edges.first()["verified"]
    assert edges(curation.undo(three, 3, **WHEN)) == []
    assert curation.history(three.journal).first()["detail"]["undo_of"] == "4"


def test_patch_and_status(state):
    one = curation.patch_concept(state, "note:a", {"status": "archived"}, **WHEN)
    back = curation.undo(one, 3, **WHEN)
    assert back.concepts.where("id = 'note:a'").first()["status"] == "active"
    two = curation.patch_concept(state, "note:a", {"title": "z", "tags": ["t"]}, **WHEN)
    row = two.concepts.where("id = 'note:a'").first()
    assert (row["title"], row["tags"]) == ("z", ["t"]) and row["content_hash"] != state.concepts.where("id = 'note:a'").first()["content_hash"]
    with pytest.raises(curation.CurationError):
        curation.undo(two, 3, **WHEN)
    with pytest.raises(curation.CurationError):
        curation.patch_concept(state, "note:a", {"colour": "red"}, **WHEN)
    owned = curation.State(state.concepts.withColumn("source_name", F.lit("wiki")), state.edges, state.rejections, state.candidates, state.journal)
    with pytest.raises(curation.CurationError):
        curation.patch_concept(owned, "note:a", {"title": "z"}, **WHEN)


def test_clusters_split_and_merge(state):
    one = curation.create_cluster(state, "cluster:1", "personal", "s", "C", ["note:a", "note:b"], **WHEN)
    two = curation.split_cluster(one, "cluster:1", "cluster:2", "personal", ["note:b"], "D", **WHEN)
    assert edges(two) == [("cluster:1", "note:a", "member"), ("cluster:2", "note:b", "member")]
    assert [r["concept_id"] for r in two.candidates.where("excluded").collect()] == ["note:b"]
    three = curation.merge_clusters(two, "personal", "cluster:2", "cluster:1", **WHEN)
    assert edges(three) == [("cluster:1", "note:a", "member"), ("cluster:1", "note:b", "member")]
    assert three.concepts.where("id = 'cluster:2'").isEmpty()
    with pytest.raises(curation.CurationError):
        curation.split_cluster(two, "cluster:1", "cluster:3", "personal", ["note:z"], "E", **WHEN)


def test_snapshots(spark, state, tmp_path):
    root = str(tmp_path / "graph")
    with pytest.raises(ValueError):
        snapshots.load(spark, root, ["concepts"])
    assert snapshots.publish({"concepts": state.concepts}, root) == 1
    assert snapshots.publish({"concepts": state.concepts.limit(1)}, root) == 2
    assert snapshots.load(spark, root, ["concepts"])["concepts"].count() == 1
    assert snapshots.load(spark, root, ["concepts"], 1)["concepts"].count() == 2
    assert json.dumps(snapshots.latest(spark, root)) == "2"


@pytest.mark.parametrize("grouped", [True, False])
def test_approximate_neighbours(spark, grouped):
    rng = np.random.default_rng(3)
    rows = rng.normal(size=(20, 16))[rng.integers(0, 20, 600)] + 0.2 * rng.normal(size=(600, 16)) if grouped else rng.normal(size=(600, 16))
    rows[:200] = rows[0]
    rows[200:203] = 0
    df = spark.createDataFrame([(i, v) for i, v in enumerate(rows.tolist())] + [(600, None), (None, rows[0].tolist())], "id long, vector array<double>")
    found = {(r["id"], r["rank"]): (r["other"], r["similarity"]) for r in vectors.approximate(df, 4).collect()}
    units = rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-300)
    sims = units @ units.T
    np.fill_diagonal(sims, -np.inf)
    best = np.sort(sims, axis=1)[:, ::-1][:, :4]
    assert len(found) == 600 * 4
    assert all(i != other and abs(sims[i, other] - s) < 1e-9 for (i, _), (other, s) in found.items())
    assert [found[0, r][0] for r in (1, 2, 3, 4)] == [1, 2, 3, 4] and [found[150, r][0] for r in (1, 2, 3, 4)] == [0, 1, 2, 3]
    assert np.mean([s >= best[i, r - 1] - 1e-9 for (i, r), (_, s) in found.items()]) >= 0.9


def test_approximate_neighbours_of_little(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0])], "id long, vector array<double>")
    assert vectors.approximate(df, 3).count() == 0
    assert vectors.approximate(df.limit(0), 3).columns == vectors.approximate(df, 3).columns


def _whole(state):
    columns = [c for c in state.edges.columns]
    notes = sorted((r["change"], r["concept_id"], tuple(sorted(r["detail"].items()))) for r in state.journal.collect())
    return sorted(map(tuple, state.edges.select(*columns).collect()), key=str), sorted((r["id"], r["status"]) for r in state.concepts.collect()), sorted(map(str, state.rejections.collect())), sorted((r["concept_id"], r["excluded"]) for r in state.candidates.collect()), notes


def test_many_undone_at_once_as_one_by_one(state, spark):
    one = curation.add_edge(state, key("note:a", "note:b"), **WHEN)  # 3
    one = curation.verify_edge(one, key("note:a", "note:b"), **WHEN)  # 4
    one = curation.reject_edge(one, key("note:a", "note:b"), "no", **WHEN)  # 5
    one = curation.patch_concept(one, "note:a", {"status": "archived"}, **WHEN)  # 6
    one = curation.add_edge(one, key("note:a", "note:b"), **WHEN)  # 7
    one = curation.patch_concept(one, "note:a", {"status": "active"}, **WHEN)  # 8
    one = curation.create_concept(one, "note:c", "s", "Note", "c", **WHEN)  # 9
    one = curation.State(*(checkpointed(df) for df in (one.concepts, one.edges, one.rejections, one.candidates, one.journal)))
    for chosen in ([7, 5], [9, 8, 7, 6, 5, 4, 3], [8], [8, 7, 6]):
        slow = one
        for entry in sorted(chosen, reverse=True):
            slow = curation.undo(slow, entry, **WHEN)
        fast = curation.undo_all(one, spark.createDataFrame([(e,) for e in chosen], "entry long"), **WHEN)
        a, b = _whole(fast), _whole(slow)
        assert a[:4] == b[:4]
        assert sorted(set(a[4]) ^ set(b[4])) == []
    early = curation.as_of(one, 2)
    assert _whole(early) == _whole(state) and early.journal.count() == 2
    for wrong in ([5], [77], [9, 77]):
        with pytest.raises(curation.CurationError):
            curation.undo_all(one, spark.createDataFrame([(e,) for e in wrong], "entry long"), **WHEN)
    two = curation.patch_concept(one, "note:a", {"title": "other"}, **WHEN)
    with pytest.raises(curation.CurationError):
        curation.as_of(two, 3)


def test_heavy_tokens_as_memberships(spark):
    from noema.operators import relations

    rows = [(f"c{k}", f"KEY-1 and KEY-{k % 7 + 10}") for k in range(150)]
    concepts = spark.createDataFrame(rows, "id string, body string")
    loose = concepts.where("id < 'c3'").select("id")
    names = [r["id"] for r in loose.collect()]
    pairs, heavy = relations.text_links(loose, concepts, [r"KEY-\d+"], most=30)
    assert pairs.count() < heavy.count() * 22 and heavy.count() == 150 and heavy.where("asks").count() == len(names)
    want = {(a, b) for a in names for b, _ in rows if a != b}
    assert {tuple(r) for r in relations.expanded(heavy).collect()} == want
    assert {tuple(r) for r in relations.text_matches(loose, concepts, [r"KEY-\d+"], most=30).collect()} == want == {tuple(r) for r in relations.text_matches(loose, concepts, [r"KEY-\d+"]).collect()}
    # in a hot token, the rows grow as the concepts do
    assert relations.text_links(loose, concepts.where("id <> 'c149'"), [r"KEY-\d+"], most=30)[1].count() == 149
