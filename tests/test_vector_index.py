"""The stored index of vectors against all pairs."""

import numpy as np
import pytest

from noema.operators import vector_index, vectors

VECTOR = "id long, vector array<double>"


def frame(spark, ids, seed=1, groups=40, size=8):
    dice = np.random.default_rng(seed)
    middles = dice.normal(size=(groups, size))
    return spark.createDataFrame([(int(k), (middles[k % groups] + 0.4 * np.random.default_rng(int(k) + 7 * seed).normal(size=size)).tolist()) for k in ids], VECTOR)


def pairs(df):
    return {(r["id"], r["other"]) for r in df.collect()}


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(vector_index, "SIZE", 16)
    monkeypatch.setattr(vectors, "BLOCK", 64)


@pytest.fixture
def index(spark, tmp_path, small):
    return vector_index.VectorIndex(spark, str(tmp_path / "index"), buckets=8).build(frame(spark, range(0, 900)), queries=100)


def test_recall_after_updates_without_a_fit(spark, index):
    index.update(frame(spark, range(900, 1200)))
    # others in the place of some, some gone, one without a vector
    index.update(frame(spark, range(0, 100), seed=2).unionAll(spark.createDataFrame([(101, None)], VECTOR)), spark.createDataFrame([(k,) for k in (100, 1100, 5000)], "id long"))
    now = frame(spark, [k for k in range(100, 1200) if k not in (100, 101, 1100)]).unionAll(frame(spark, range(0, 100), seed=2))
    assert index.live().count() == now.count() == len({r["id"] for r in index.live().select("id").collect()})
    want = pairs(vectors.neighbours(now, 5))
    assert len(pairs(index.neighbours(5)) & want) >= 0.95 * len(want)
    lists = index._table("lists", vector_index.CENTRE).count()
    assert lists > 20 and index.probes()[1] < lists / 2  # what is compared is a part of all pairs


def test_filters_queries_and_thresholds(spark, index):
    asked = frame(spark, [3, 5]).unionAll(spark.createDataFrame([(-1, [0.0] * 8), (-2, None)], VECTOR))
    allowed = spark.createDataFrame([(k,) for k in range(0, 900, 2)], "id long")
    got = index.search(asked, 3, allowed=allowed).collect()
    assert all(r["other"] % 2 == 0 for r in got) and {r["id"] for r in got} == {3, 5, -1}
    assert [r["other"] for r in index.search(frame(spark, [3]), 1).collect()] == [3] and index.search(frame(spark, [3]), 1, others=True).first()["other"] != 3
    assert all(r["similarity"] >= 0.9 for r in index.search(asked, 50, least=0.9).collect())


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 0.0])], [(1, [0.0, 0.0]), (2, None)]])
def test_few_vectors(spark, tmp_path, rows):
    index = vector_index.VectorIndex(spark, str(tmp_path / "few")).build(spark.createDataFrame(rows, VECTOR))
    assert index.neighbours(3).collect() == []
    index.update(spark.createDataFrame([(7, [1.0, 0.1]), (8, [1.0, 0.2])] if rows else [], VECTOR))
    assert {(7, 8), (8, 7)} <= pairs(index.neighbours(3)) or not rows
