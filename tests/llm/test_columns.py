"""Stages of the pipeline keep columns of any name, nulls, and empty tables."""

import pytest

from noema.llm import decontaminate, quality, simhash, substring_dedup

COLUMNS = "doc_id long, text string, n_chars long, __hash string, __low string, __declared string, __id string, __name string, hash string, low string, id string, name string, declared string, begins string, spans string, fp string, node string"


@pytest.fixture(scope="module")
def docs(spark):
    run = " ".join(f"v{k}" for k in range(60))
    texts = [f"a {run} b", f"c {run} d", None, "", "alone here", "alone here", run.upper()]
    return spark.createDataFrame([(k if k != 4 else None, t, None, *(f"{c}{k}" for c in "abcdefghijklmn")) for k, t in enumerate(texts)], COLUMNS).repartition(2)


def stages(spark):
    model = quality.train(spark.createDataFrame([(k, "w " * k) for k in range(9)], "doc_id long, text string"), spark.range(9).selectExpr("id as doc_id", "1 as quality"))
    items = spark.createDataFrame([(1, " ".join(f"v{k}" for k in range(20, 40)).upper())], "item_id long, text string")
    return {"quality": lambda d: quality.accepted(d, model), "copies": simhash.representatives, "substrings": substring_dedup.rewrite, "benchmark": lambda d: decontaminate.clean(d, items)}


@pytest.mark.parametrize("name", ["quality", "copies", "substrings", "benchmark"])
def test_stages(spark, docs, name):
    stage = stages(spark)[name]
    given = {r["__name"]: r for r in docs.collect()}
    kept = stage(docs)
    assert kept.columns == docs.columns
    rows = kept.collect()
    for r in rows:
        before = given[r["__name"]].asDict() | {"text": r["text"], "n_chars": r["n_chars"]}
        assert r.asDict() == before
    assert len(rows) == {"quality": 7, "copies": 3, "substrings": 7, "benchmark": 4}[name]
    nothing = stage(docs.limit(0))
    assert nothing.columns == docs.columns and nothing.count() == 0


def test_fan_out_of_covers():
    assert simhash.Cover(4, 3).copies() < 60 and simhash.Cover(4, 2).copies() > 400
