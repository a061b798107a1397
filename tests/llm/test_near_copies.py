"""Groups of near copies in the pipeline: five-word shingles, Jaccard of 0.8 or more, against all pairs."""

import itertools
import random

import pytest

from noema.llm import simhash

RNG = random.Random(11)


def altered(text: str, n: int) -> str:
    """The text with its last ``n`` words replaced: Jaccard about (1 - share) / (1 + share)."""
    parts = text.split()
    return " ".join(parts[: len(parts) - n] + [f"z{RNG.randrange(10**6)}" for _ in range(n)])


def groups(texts: list[str | None]) -> set[int]:
    """The first text of each group, by the definition."""
    split = [(t or "").lower().split() for t in texts]
    sets = [{tuple(p[i : i + 5]) for i in range(max(1, len(p) - 4))} if p else set() for p in split]
    label = list(range(len(texts)))
    for i, j in itertools.combinations(range(len(texts)), 2):
        if label[i] != label[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
            old, new = max(label[i], label[j]), min(label[i], label[j])
            label = [new if x == old else x for x in label]
    return set(label)


@pytest.mark.parametrize(("crowd", "chars"), [(4096, 2_000_000), (2, 3000)])
def test_representatives_by_all_pairs(spark, crowd, chars):
    texts: list[str | None] = [None, "", " "]
    for k in range(40):
        base = " ".join(f"w{RNG.randrange(3000)}" for _ in range(RNG.choice([60, 150, 400])))
        # 4 to 10 % replaced: near copies; 13 to 30 %: not
        texts += [base, altered(base, len(base.split()) * (4 + k % 7) // 100), altered(base, len(base.split()) * (13 + k % 17) // 100)]
    texts += [altered(texts[3], 2) for _ in range(12)]
    rows = [(k, t) for k, t in enumerate(texts)]
    got = [r["doc_id"] for r in simhash.representatives(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), crowd=crowd, chars=chars).collect()]
    assert len(got) == len(set(got)) and set(got) == groups(texts)
