"""The bounded sample of labels leaves the share of the labels as it is in the whole table."""

import numpy as np

from noema.llm import quality


def test_bound_keeps_the_share_of_labels(spark):
    docs = spark.range(2000).selectExpr("id as doc_id", "'the same words in every text' as text")
    labels = spark.range(2000).selectExpr("id as doc_id", "cast(id % 10 > 0 as int) as quality")
    whole, bounded, between = (quality.score(docs.limit(1), quality.train(docs, labels, sample=n)).first()["score"] for n in (4000, 100, 400))
    assert abs(whole - 0.9) < 0.05
    assert np.allclose([bounded, between], whole, atol=0.06)
