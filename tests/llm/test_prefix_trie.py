"""The prefix tree of conversations against a walk over all prefixes."""

import hashlib
import random
import re
import zlib

import pytest

from noema.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth long, kx long, rank long, words long"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 7, 7, 7, 7) for r in rows], SCHEMA).repartition(3)


def by_definition(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts, key=lambda t: t[:2])] for c, ts in own.items()}
    again = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        again[c] = tuple(own.get(c - c % 20, [])[:h] + turns[h:])
    nodes = {}
    for c, turns in again.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(turns[:d], []).append(c)
    children = {n: 0 for n in nodes}
    leaves, saved = dict.fromkeys(nodes, 0), dict.fromkeys(nodes, 0)
    for n, members in nodes.items():
        if n:
            children[n[:-1]] += 1
    for n, members in nodes.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", n[-1][1])) if n else 0
        for d in range(len(n) + 1):
            saved[n[:d]] += (len(members) - 1) * words
            leaves[n[:d]] += children[n] == 0
    out = []
    for n, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(members) if again[c] == n)
        out.append((min(members), len(n), min(nodes[n[:-1]]) if n else None, len(members), children[n], leaves[n], saved[n], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted(map(tuple, df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()), key=str)


def conversations(n, hot=0):
    dice = random.Random(n)
    rows = []
    for c in range(n):
        for turn in range(dice.randrange(1, 6)):
            rows.append((c * dice.choice([1, 1, 3]) if turn == 0 else rows[-1][0], turn, dice.choice(["user", "assistant", None]) if dice.random() < 0.2 else "user", dice.choice(["a b", "a  b", "c", "", None, "d\x1ee f"])))
    seen = set()
    rows = [r for r in rows if (r[0], r[1]) not in seen and not seen.add((r[0], r[1]))]
    return rows + [(100_000 + 20 * k + j, t, "u", f"hot {t} words") for k in range(hot) for j in (0, 7) for t in range(5)]


@pytest.mark.parametrize("span, ids", [(4096, 256), (2, 3)])
def test_by_definition(spark, monkeypatch, span, ids):
    """Also with conversations that are ordered and summed by parts, and ids joined by short ranges."""
    monkeypatch.setattr(prefix_trie, "SPAN", span)
    monkeypatch.setattr(prefix_trie, "IDS", ids)
    rows = conversations(150, 40) + [(None, 1, "user", "nobody"), (20_001, None, "u", "first"), (20_001, -5, "u", "second"), (20_001, 9, None, None), (-40, 0, "u", "minus"), (-40, 1, "u", "minus")]
    rows += [(60_000, t, "u", f"turn {t}") for t in range(300)]  # a long one, alone in its group of twenty
    assert got(prefix_trie.trie(frame(spark, rows))) == by_definition(rows)


def test_conversations_without_turns_are_members_of_the_root(spark):
    short = next(c for c in range(1000, 2000) if c % 20 and zlib.crc32(str(c).encode()) % 4 == 3)
    rows = [(short, 0, "u", "only one turn")]
    assert got(prefix_trie.trie(frame(spark, rows))) == by_definition(rows) == [(short, 0, None, 1, 0, 1, 0, hashlib.sha256(str(short).encode()).hexdigest())]


def test_repeated_rows_are_turns(spark):
    rows = [(40, 1, "u", "same")] * 3 + [(60, 1, "u", "same")]
    assert got(prefix_trie.trie(frame(spark, rows))) == by_definition(rows)


def test_no_rows(spark):
    assert prefix_trie.trie(frame(spark, [])).collect() == []
    assert prefix_trie.trie(frame(spark, [(None, 1, "u", "t")])).collect() == []
