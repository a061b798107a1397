"""Kept neighbours and components against a rebuild, over random edits."""

import numpy as np
import pytest

from noema.operators import incremental, vectors

VECTOR = "id long, vector array<double>"


def edited(dice, rows):
    out = {k: v for k, v in rows.items() if dice.random() > 0.05}
    for k in list(out):
        if dice.random() < 0.05:
            out[k] = dice.normal(size=3).tolist()
    return out | {int(k): dice.normal(size=3).tolist() for k in dice.integers(1000, 2000, 6)}


@pytest.mark.parametrize("least", [None, 0.995])
def test_over_random_edits(spark, least):
    dice = np.random.default_rng(3)
    rows = {k: dice.normal(size=3).tolist() for k in range(90)}
    frame = lambda r: spark.createDataFrame(list(r.items()) + [(-1, None)], VECTOR)
    pairs = vectors.neighbours(frame(rows), 4, least)
    labels = vectors.components(pairs)
    for step in range(2):
        after = edited(dice, rows)
        new, changed = incremental.updated_neighbours(pairs, frame(rows), frame(after), 4, least)
        want = vectors.neighbours(frame(after), 4, least)
        shown = lambda df: sorted((r["id"], r["other"], r["rank"], round(r["similarity"], 12)) for r in df.collect())
        assert shown(new) == shown(want)
        assert {r["id"] for r in changed.where("gone").collect()} == set(rows) - set(after)
        labels = incremental.updated_components(labels, pairs, new, small=(0, 100_000)[step])
        assert sorted(map(tuple, labels.select("node", "component").collect())) == sorted(map(tuple, vectors.components(want).select("node", "component").collect()))
        rows, pairs = after, new


def test_only_touched_components_are_redone(spark):
    link = lambda rows: spark.createDataFrame(rows, "id long, other long")
    before = [(1, 2), (2, 3), (10, 11), (20, 21)]
    labels = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (10, 999), (11, 999), (20, 20), (21, 20)], "node long, component long")
    got = incremental.updated_components(labels, link(before), link([(1, 2), (20, 21), (21, 3), (10, 11)]))
    # (2, 3) went and (21, 3) came; the component of 10 keeps whatever it was called
    assert sorted(map(tuple, got.select("node", "component").collect())) == [(1, 1), (2, 1), (3, 3), (10, 999), (11, 999), (20, 3), (21, 3)]
    assert incremental.updated_components(labels.limit(0), link([]), link([])).collect() == []
