"""Spanning forests, components and cuts against one task's work and against walks."""

import random

import pytest

from noema.operators import forest, vectors

PAIR = "id long, other long, similarity double"


def graph(n, edges, seed):
    dice = random.Random(seed)
    return [(dice.randrange(n), dice.randrange(n), dice.choice([0.5, 0.6, 0.7, 0.75, 0.9, dice.random()])) for _ in range(edges)]


def joined(rows, least=0.0):
    label = {}
    for a, b, s in rows:
        for x in (a, b):
            label.setdefault(x, x)
    changed = True
    while changed:
        changed = False
        for a, b, s in rows:
            if s >= least and label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                changed = True
    return label


@pytest.mark.parametrize("small", [0, 20, 100_000])
def test_forest_and_its_cuts(spark, small):
    rows = graph(60, 110, 1) + [(100, 101, 0.8), (101, 100, 0.9), (102, 102, 1.0)]
    found = forest.spanning(spark.createDataFrame(rows + [(None, 1, 0.5)], PAIR), small)
    kept = [(r["low"], r["high"], r["similarity"]) for r in found.collect()]
    best = {}
    for a, b, s in rows:
        if a != b:
            best[min(a, b), max(a, b)] = max(s, best.get((min(a, b), max(a, b)), 0))
    order = sorted((-s, a, b) for (a, b), s in best.items())
    at = forest.kruskal([o[1] for o in order], [o[2] for o in order], __import__("numpy").arange(len(order)))
    assert sorted(kept) == sorted((order[k][1], order[k][2], -order[k][0]) for k in at)
    levels = [0.55, 0.7, 0.89]
    got = {(r["level"], r["node"]): r["component"] for r in forest.cuts(found, levels, small).collect()}
    for level, least in enumerate(levels, 1):
        want = joined([(a, b, s) for (a, b), s in best.items()], least)
        assert {n: got.get((level, n), n) for n in want} == want


@pytest.mark.parametrize("small", [0, 100_000])
def test_components_either_way(spark, small):
    rows = graph(40, 30, 2)
    assert {r["node"]: r["component"] for r in vectors.components(spark.createDataFrame(rows, PAIR), small=small).collect()} == joined(rows)
    assert vectors.components(spark.createDataFrame([], PAIR), small=small).collect() == []
    assert forest.spanning(spark.createDataFrame([], PAIR), small).collect() == []
