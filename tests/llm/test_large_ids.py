"""Ids beyond 32 bits."""

from noema.llm import substring_dedup


def test_substring_dedup_of_large_ids(spark):
    run = " ".join(f"v{k}" for k in range(80))
    rows = [(7, f"a {run} b"), (7 + (1 << 32), f"c {run} d"), ((1 << 63) - 1, "alone"), (-(1 << 63), None), (None, f"e {run}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = substring_dedup.brute_force([r[1] for r in rows])
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup.dedup(docs).collect()}
    assert got == {r[0]: w for r, w in zip(rows, want, strict=True)}
    kept = {r["doc_id"]: r["text"] for r in substring_dedup.rewrite(docs).collect()}
    assert (kept[7], kept[7 + (1 << 32)], kept[(1 << 63) - 1], kept[None]) == ("a b", "c d", "alone", "e")
