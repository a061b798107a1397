"""The stored index against reading every text, and titles against all pairs."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from noema.functions import scalars
from noema.operators import search, text_index
from noema.operators.common import lookup

WORDS = "red green blue house boat tree Haus übung 東京 a1 b-2".split()


def concepts(spark, n, seed, words=8):
    dice = random.Random(seed)
    rows = [(("shared", "personal")[k % 3 == 0], f"c{k}", "tombstone" if k % 17 == 5 else "active", " ".join(dice.choices(WORDS, k=dice.randrange(0, 4))) or None, None if k % 5 == 0 else " ".join(dice.choices(WORDS, k=dice.randrange(words)))) for k in range(n)]
    return spark.createDataFrame(rows, "store string, id string, status string, title string, body string")


def rank(places):
    """As the formula reads, over places by word."""
    if len(places) == 1:
        return 0.1 * sum(1 / (k + 1) ** 2 for k in range(len(places[0]))) / 1.64493406685
    none, out = 1.0, 1e-20
    for a in range(len(places)):
        for b in range(a):
            for p in places[a]:
                for q in places[b]:
                    if p != q:
                        near = 1e-30 if abs(p - q) > 100 else 1 / (1.005 + 0.05 * math.exp(abs(p - q) / 1.5 - 2))
                        none *= 1 - math.sqrt(0.01 * near)
    return max(out, round(1 - none, 9))


def by_reading(rows, query):
    wanted = search.query_words(query)
    out = []
    for r in rows:
        words = [w for w in re.split(r"[\W_]+", f"{r['title'] or ''} {r['body'] or ''}".lower()) if w]
        places = [[k + 1 for k, w in enumerate(words) if w == q][:255] for q in wanted]
        if wanted and r["status"] != "tombstone" and all(places):
            out.append((-round(rank(places), 9), r["id"], r["store"]))
    return [(i, s, -v) for v, i, s in sorted(out)]


@pytest.fixture
def index(spark, tmp_path):
    return text_index.TextIndex(spark, str(tmp_path / "index"), 8)


def found(index, query):
    return [(r["id"], r["store"], pytest.approx(r["score"], abs=1e-9)) for r in index.search(search.query_words(query), 1000).orderBy("rank").collect()]


def test_rank_by_the_formula(spark, index):
    rows = concepts(spark, 120, 1)
    index.update(rows)
    for query in ("red", "house red", "red blue green", "b-2", "東京 übung", "nothing", "", "red red"):
        want = by_reading(rows.collect(), query)
        assert found(index, query) == want
        assert [r["id"] for r in search.full_text(rows, query, 1000).orderBy("rank").collect()] == [w[0] for w in want]


def test_far_and_many_places(spark, index):
    rows = spark.createDataFrame([("s", "far", "active", None, "red " + "x " * 20_000 + "blue"), ("s", "many", "active", None, "red " * 300 + "blue"), ("s", "end", "active", None, "y " * 17_000 + "red red blue")], "store string, id string, status string, title string, body string")
    index.update(rows)
    got = {r["id"]: r["score"] for r in index.search(["blue", "red"]).collect()}
    assert got["far"] == got["end"] == 1e-20  # beyond the last place all words are at one
    assert {r["id"]: len(r["places"]) for r in index.live("words", text_index.WORD, ["red"]).collect()} == {"far": 1, "many": 255, "end": 1}


def test_updates_removals_and_compaction(spark, index):
    rows = concepts(spark, 90, 2)
    index.update(concepts(spark, 90, 3))
    index.update(rows, spark.createDataFrame([("shared", "gone")], "store string, id string"))
    index.update(rows.where("id = 'c1'").withColumn("body", F.lit("red house red")), rows.where("id in ('c2', 'c4')"))
    now = [r for r in rows.where("id not in ('c1', 'c2', 'c4')").unionByName(rows.where("id = 'c1'").withColumn("body", F.lit("red house red"))).collect()]
    assert found(index, "red house") == by_reading(now, "red house")
    index.compact()
    assert found(index, "red house") == by_reading(now, "red house") and index.generation() == 3


def test_an_unfinished_generation_is_not_seen(spark, index):
    rows = concepts(spark, 30, 4)
    index.update(rows)
    before = found(index, "red")
    text_index.word_entries(rows.withColumn("body", F.lit("red"))).withColumn("bucket", F.lit(1)).write.partitionBy("bucket").parquet(f"{index.path}/words/gen=1")
    assert found(index, "red") == before
    index.update(rows.withColumn("body", F.lit("red")).withColumn("title", F.lit("")))
    assert len(found(index, "red")) == rows.where("status = 'active'").count()


def test_only_the_querys_buckets_are_read(spark, index, capsys):
    index.update(concepts(spark, 60, 5))
    index.live("words", text_index.WORD, ["house"]).explain(mode="formatted")
    plan = capsys.readouterr().out
    assert re.search(r"PartitionFilters: \[.*bucket#\d+ = \d+", plan) and "EqualTo(term,house)" in plan


def test_similar_titles_to_a_query(spark, index):
    rows = concepts(spark, 80, 6)
    index.update(rows)
    for query in ("red house", "hous", "übungen", ""):
        want = [(r["id"], r["rank"], round(r["similarity"], 9)) for r in search.by_trigrams(rows, query, 1000).collect()]
        got = [(r["id"], r["rank"], round(r["similarity"], 9)) for r in index.similar(search.query_grams(query), limit=1000).collect()]
        assert sorted(got) == sorted(want)
    assert [r["id"] for r in search.lexical(rows, "red", 20, index).collect()] == [r["id"] for r in search.lexical(rows, "red").collect()]


@pytest.mark.parametrize("least", [0.3, 0.6, 0.8, 1.0])
def test_similar_titles_by_all_pairs(spark, least):
    dice = random.Random(7)
    titles = ["".join(dice.choices("abc ", k=dice.randrange(1, 14))) for _ in range(120)] + ["order number 12", "order number 13"] * 5 + [None, "", "--"]
    rows = spark.createDataFrame([("s", f"{k:03}", "active", t) for k, t in enumerate(titles)], "store string, id string, status string, title string")
    sets = {r["id"]: frozenset(r["g"]) for r in rows.select("id", scalars.trigrams(F.coalesce("title", F.lit(""))).alias("g")).collect()}
    classes = {}
    for i in sorted(sets):
        if sets[i]:
            classes.setdefault(sets[i], i)
    want = {(a, b) for s, a in classes.items() for t, b in classes.items() if a < b and len(s & t) >= (least - 1e-12) * len(s | t)}
    pairs, members = text_index.similar_titles(rows, least)
    assert {(r["a"], r["b"]) for r in pairs.collect()} == want
    assert {r["id"]: r["class"] for r in members.collect()} == {i: classes[s] for i, s in sets.items() if s}
    looked_at = text_index.title_candidates(text_index.title_classes(rows).select("class", "set").distinct(), least).count()
    assert len(want) <= looked_at <= len(classes) * (len(classes) - 1) / 2 * (1.01 - least / 2)


def test_lookup_of_heavy_and_light_keys(spark):
    rows = spark.range(400).select((F.col("id") % 5).alias("key"), "id").unionAll(spark.range(300).select(F.lit(1).cast("long").alias("key"), F.col("id") + 1000))
    table = spark.createDataFrame([(0, "a"), (1, "b"), (9, "c")], "key long, word string")
    want = sorted((r["id"], {0: "a", 1: "b"}.get(r["key"])) for r in rows.collect())
    for most in (3, 10_000):
        assert sorted((r["id"], r["word"]) for r in lookup(rows, table, ["key"], least=0, most=most).collect()) == want
