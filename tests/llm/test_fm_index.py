"""The FM-index and its part in substring dedup."""

import random

import numpy as np
import pytest

from noema.llm import fm_index, substring_dedup

RNG = random.Random(3)


def test_counts_by_definition():
    dice = np.random.default_rng(1)
    text = np.append(dice.integers(1, 6, 500), 0).astype(np.uint16)
    index = fm_index.FmIndex(text)
    for n in (1, 2, 5, 9):
        for at in dice.integers(0, 480, 20):
            pattern = text[at : at + n]
            assert index.count(pattern) == sum((text[k : k + n] == pattern).all() for k in range(len(text) - n))


def test_repeated_windows_by_definition():
    dice = np.random.default_rng(2)
    for window in (4, 7, 35):
        parts = [dice.integers(1, 4000, 60).astype(np.uint16) for _ in range(12)]
        parts += [np.concatenate([dice.integers(1, 4000, 9), p[5:50], dice.integers(1, 4000, 3)]).astype(np.uint16) for p in parts[:6]] + [np.full(60, 7, np.uint16)]
        text = np.concatenate([np.append(p, 0) for p in parts]).astype(np.uint16)
        end = np.cumsum([len(p) + 1 for p in parts]) - 1
        begin = end - [len(p) for p in parts]
        got = fm_index.repeated_windows(fm_index.FmIndex(text), text, begin, end, window)
        places = [k for b, e in zip(begin, end, strict=True) for k in range(b, e - window + 1)]
        seen: dict[bytes, int] = {}
        for k in places:
            seen[text[k : k + window].tobytes()] = seen.get(text[k : k + window].tobytes(), 0) + 1
        assert np.flatnonzero(got).tolist() == [k for k in places if seen[text[k : k + window].tobytes()] > 1]
    with pytest.raises(ValueError):
        fm_index.repeated_windows(fm_index.FmIndex(text), text, begin, end, 64)


def records(texts, window=35, shards=1):
    """What ``_send`` packs, without Spark."""

    class Frame:
        def select(self, *names):
            return self

    class Hot:
        value = np.zeros(0, np.uint64)

    import pyarrow as pa

    held = {}
    real = substring_dedup.map_batches
    substring_dedup.map_batches = lambda df, run, schema: held.update(run=run)
    try:
        substring_dedup._send(Frame(), shards, window, 8, Hot)
    finally:
        substring_dedup.map_batches = real
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array([0] * len(texts), pa.int32()), pa.array(texts)], ["hash", "low", "text"])
    return held["run"](batch).to_pylist()


def removed(texts, window=35):
    name, begin, end = substring_dedup._search(records(texts), window)
    gone = [set() for _ in texts]
    for d, a, b in zip(name["hash"].tolist(), begin.tolist(), end.tolist(), strict=True):
        gone[d].update(range(a, b))
    return [len(g) for g in gone]


@pytest.fixture(scope="module")
def texts():
    base = [" ".join(f"w{RNG.randrange(5000)}" for _ in range(120)) for _ in range(30)]
    edited = []
    for t in base[:20] * 20:
        parts = t.split()
        parts[RNG.randrange(20, 100)] = f"z{RNG.randrange(10**6)}"
        edited.append(" ".join(parts))
    return base + edited + base[:3] + [" ".join(["a b c"] * 40)]


def test_index_and_check_both_decide(texts, monkeypatch):
    want = [w[1] for w in substring_dedup.brute_force(texts)]
    assert removed(texts) == want
    with monkeypatch.context() as m:  # an index that finds nothing, and one that finds everything
        m.setattr(substring_dedup, "repeated_windows", lambda index, text, begin, end, window: np.zeros(len(text), bool))
        assert sum(removed(texts)) == 0
        m.setattr(substring_dedup, "repeated_windows", lambda index, text, begin, end, window: np.ones(len(text), bool))
        everything = removed(texts)
    monkeypatch.setattr(substring_dedup, "_confirmed", lambda marked, check, times: marked)
    index_alone = removed(texts)
    assert all(a >= b for a, b in zip(everything, want, strict=True)) and all(a >= b for a, b in zip(index_alone, want, strict=True))
    assert sum(a != b for a, b in zip(index_alone, want, strict=True)) <= 3
