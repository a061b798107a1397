"""The whole pipeline against its stages by definition."""

import hashlib
import random

import corpus_pipeline
import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

from noema.llm import byte_bpe, decontaminate, quality, substring_dedup

RNG = random.Random(21)
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(n):
    return " ".join(f"w{RNG.randrange(4000)}" for _ in range(n))


def texts():
    shared, item = prose(50), prose(20)
    good = [prose(RNG.choice([40, 90, 200])) for _ in range(60)]
    near = [g.rsplit(" ", 1)[0] + f" z{k}" for k, g in enumerate(good[:12]) if len(g.split()) > 60]
    passages = [f"{prose(15)} {shared} {prose(15)}" for _ in range(4)]
    leaks = [f"{prose(20)} {item.upper()} {prose(10)}" for _ in range(3)]
    bad = ["!!! " + " ".join(RNG.choice(["BUY", "NOW", "WIN", "$$$"]) + "!!" for _ in range(60)) for _ in range(60)]
    return [*good, *good[:5], *near, *passages, *leaks, *bad, None, "", " "], item


def linked(kept):
    """The smallest id of each group of near copies: Jaccard of 0.8 or more of five-word shingles."""
    sets, first = {}, {}
    for k, t in kept:
        parts = (t or "").lower().split()
        sets[k] = {tuple(parts[i : i + 5]) for i in range(max(1, len(parts) - 4))} if parts else set()
    label = {k: k for k, _ in kept}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and label[a] != label[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                old, new = max(label[a], label[b]), min(label[a], label[b])
                label = {k: new if v == old else v for k, v in label.items()}
    for k in sorted(label):
        first.setdefault(label[k], k)
    return set(first.values())


def test_run_by_definition(spark, tmp_path):
    rows, item = texts()
    docs = spark.createDataFrame([(k, t, "en", "s", None if t is None else len(t)) for k, t in enumerate(rows)], DOCUMENTS)
    labels = docs.where("doc_id % 2 = 0 and text is not null").select("doc_id", F.when(F.col("text").startswith("!!!"), 0).otherwise(1).alias("quality"), F.lit(0).alias("toxic"))
    items = spark.createDataFrame([(1, item), (None, "never there"), (2, None)], "item_id long, text string")
    for name, table in (("documents", docs.repartition(3)), ("labels", labels), ("benchmark", items)):
        table.write.parquet(f"{tmp_path}/{name}.parquet")
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}

    model = quality.train(docs, labels)
    kept = sorted((r["doc_id"], r["text"]) for r in quality.accepted(docs, model).collect())
    assert not any((t or "").startswith("!!!") for _, t in kept) and len(kept) > 60
    chosen = linked(kept)
    left = [(k, t) for k, t in kept if k in chosen]
    cut = substring_dedup.brute_force([t for _, t in left])
    assert sum(c[1] for c in cut) > 0
    texts_left = {}
    for (k, t), (_, gone, digest) in zip(left, cut, strict=True):
        texts_left[k] = (t, None) if not gone else (None, digest)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    want = {}
    stage = {r["doc_id"]: r["text"] for r in substring_dedup.rewrite(docs.where(F.col("doc_id").isin(*chosen))).collect()}
    for k, (t, digest) in texts_left.items():
        text = stage[k]
        assert text == t if digest is None else hashlib.sha256(text.encode()).hexdigest() == digest
        if not decontaminate.brute_force(text, [(1, item), (None, "never there")])[1]:
            ids = library.encode_ordinary(text or "")
            want[k] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())
    assert {k: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for k, r in got.items()} == want
    assert len(want) == len(left) - sum(1 for k, _ in left if decontaminate.brute_force(stage[k], [(1, item)])[1])


def test_stages_of_an_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], DOCUMENTS)
    for name, table in (("documents", docs), ("labels", spark.createDataFrame([], "doc_id long, quality int, toxic int")), ("benchmark", spark.createDataFrame([], "item_id long, text string"))):
        table.write.parquet(f"{tmp_path}/{name}.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
