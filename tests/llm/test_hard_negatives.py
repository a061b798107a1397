"""Hard negatives by radix selection against sorting everything."""

import math
import random

import numpy as np
import pytest

from noema.llm import hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int, score long, anchor long, window long, v string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 1, 1, "x") for r in rows], SCHEMA).repartition(3)


def by_definition(rows, every=100):
    kept = []
    for i, v, label in rows:
        if i is not None and v is not None and label is not None and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, (label + 1) % 10 if i % 7 == 0 else label, tuple(math.floor(256 * float(np.float32(x))) for x in v)))
    out = []
    for i, label, v in {r for r in kept if r[0] % every == 0}:
        scored = sorted(((-sum(a * b for a, b in zip(v, w)), j, m) for j, m, w in kept), key=lambda x: x[:2])
        for s, p, _ in [x for x in scored if x[2] == label and x[1] != i][:5]:
            fit = [(j, -t) for t, j, m in scored if m != label and 30 * -s <= 100 * -t <= 90 * -s][:10]
            out += [(i, p, rank + 1, j, -s, t) for rank, (j, t) in enumerate(fit)]
    return sorted(out)


def got(df):
    return sorted(map(tuple, df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()))


def vectors(n, hot):
    dice = np.random.default_rng(n)
    rows = [(k * 5, [float(x) for x in dice.normal(0.2, 0.4, 6)], int(dice.integers(0, 4))) for k in range(n)]
    same = [0.5, 0.25, 0.0, 0.1, 0.3, 0.2]
    return rows + [(10_001 + 3 * k, same, k % 3) for k in range(hot)]


@pytest.mark.parametrize("buckets, few, rows_a_block", [(1024, 64, 4096), (4, 3, 64)])
def test_by_sorting(spark, monkeypatch, buckets, few, rows_a_block):
    """Small digits refine scores and then ids over several rounds; a third of the rows are one vector."""
    for name, value in (("BUCKETS", buckets), ("FEW", few), ("ROWS", rows_a_block)):
        monkeypatch.setattr(hard_negatives, name, value)
    rows = vectors(200, 90)
    rows += rows[:2] + rows[3:4] * 14  # repeated, one of them an anchor
    rows += [(None, [1.0] * 6, 1), (900_000, None, 1), (900_100, [1.0] * 6, None), (900_200, [1.0, None], 1), (900_300, [float("nan")] * 6, 1), (900_400, [float("inf")] * 6, 1), (900_500, [], 2), (900_600, [0.4, 0.4], 1), (-100, [0.3] * 6, 1), (7, [-0.01] * 6, 3)]
    assert got(hard_negatives.mine(frame(spark, rows))) == by_definition(rows)


def test_large_components_stay_exact(spark):
    dice = random.Random(4)
    rows = [(k * 50, [dice.uniform(-3e5, 3e5) for _ in range(4)], k % 3) for k in range(40)] + [(1, [1e6, 1.0, 1.0, 1.0], 1), (2, [-1e6, 1.0, 1.0, 1.0], 2)]
    assert got(hard_negatives.mine(frame(spark, rows))) == by_definition(rows)


@pytest.mark.parametrize("rows", [[], [(100, [1.0], 1)], [(100, [1.0], 1), (101, [1.0], 1)], [(100, [0.0], 1), (101, [0.0], 1), (102, [0.0], 2)]])
def test_few_rows(spark, rows):
    assert got(hard_negatives.mine(frame(spark, rows))) == by_definition(rows)


def test_products_beyond_a_double():
    big = np.array([[2.0**30, 1.0, 3.0]])
    assert hard_negatives.products(big, big)[0, 0] == 2**60 + 10
    with pytest.raises(OverflowError):
        hard_negatives.products(big * 8, big)
