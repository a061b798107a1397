"""Frequent pairs of bytes are split over shards without a change of any score."""

import numpy as np
import pytest

from noema.llm import ctw, lm_score


@pytest.mark.parametrize("heavy", [1, 30, 100_000])
def test_scores_with_pairs_split(spark, monkeypatch, heavy):
    monkeypatch.setattr(lm_score, "HEAVY", heavy)
    texts = ["the cat and the hen then went there", "a the the the", "", "Été über", None] * 3
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    pairs = lm_score.frequent_pairs(docs, 6)
    assert len(pairs) == 0 if heavy == 1 else len(pairs) > 0
    rows = {r["doc_id"]: r for r in lm_score.score(docs).collect()}
    train = [(t or "").encode() for k, t in enumerate(texts) if not rows[k]["held_out"]]
    keys, n = np.unique(ctw.gram_keys(train, 6), return_counts=True)
    tree = ctw.Tree(keys, n, 6)
    for k, t in enumerate(texts):
        want = tree.log_probability(ctw.gram_keys([(t or "").encode()], 6)).sum() / np.log(10)
        assert rows[k]["score"] == pytest.approx(want, rel=1e-4)


def test_shards_of_a_frequent_pair():
    grams = ctw.gram_keys([b"then there these they" * 20], 6)
    pair = grams >> np.uint64(40)
    both = np.unique(pair)[:1]
    one, many = lm_score.Deal(6, 64, np.zeros(0, np.uint64)), lm_score.Deal(6, 64, np.unique(pair))
    assert len(np.unique(one.shard_of(grams[pair == both[0]], lm_score.GRAMS))) == 1
    assert len(np.unique(many.shard_of(grams, lm_score.GRAMS))) >= len(np.unique(one.shard_of(grams, lm_score.GRAMS)))
