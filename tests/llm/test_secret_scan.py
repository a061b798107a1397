"""Secret scans against a walk with Python's own pattern matcher, and ownership by hand."""

import hashlib
import random
import re

import pytest

from noema.llm import secret_scan

SCHEMA = "doc_id long, text string, source string, row long, h string, spans string, base string"
HEX = "0123456789abcdef"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", "y", "z") for r in rows], SCHEMA).repartition(3)


def found(text):
    out = []
    kinds = {**secret_scan.BASE, **secret_scan.WIDER}
    for k, (name, kind) in enumerate(kinds.items()):
        pattern = {"access": "AKIA[A-Z0-9]+", "hex": "[0-9a-f]+"}.get(name, kind.pattern)  # as the kinds are defined
        for m in re.finditer(pattern, text or "", re.ASCII):
            if len(m[kind.group]) >= kind.least and all(re.search(n, m[kind.group]) for n in kind.needs):
                out.append((m.start(), k, m.end(), name, m[kind.group]))
    return sorted(out)


def by_definition(rows):
    held = {}
    for _, text, source in rows:
        for *_, value in found(text):
            held.setdefault(value, set()).add(source or "")
    out = []
    for doc_id, text, _ in rows:
        spans = found(text)
        base = [f"{n}:{s}:{e}" for s, k, e, n, _ in spans if k < 3]
        kept = [f"{n}:{s}:{e}" for s, k, e, n, v in spans if k < 3 or len(held[v]) == 1]
        counts = [sum(k == n for _, k, *_ in spans) for n in range(3)]
        out.append((doc_id, *counts, hashlib.sha256(",".join(base).encode()).hexdigest(), ",".join(kept)))
    return sorted(out, key=str)


def texts():
    dice = random.Random(3)
    pieces = ["password", "PassWd", "secret", "Token", "api_key", "apikey", "API_KEY", "AKIA", "=", ":", " ", "  ", '"', "'", "abc", "abcdef", "Zz9_", "=", "é", "日本", "\n", "\t", "\x0b", "\x00", "ſecret=longenough", "toKen=longenough", "eyJ", ".", "://", "@", "u:pw", "https", "ghp_"]
    for _ in range(300):
        yield "".join(dice.choice([*pieces, "".join(dice.choices(HEX, k=dice.choice([5, 23, 24, 40]))), "".join(dice.choices("ABCXYZ0189", k=dice.choice([3, 15, 16, 30]))), "".join(dice.choices("abXY09_+-", k=24))]) for _ in range(dice.randrange(0, 30)))
    yield from [None, "", " \n", 'token=token"=abcdefgh', "token==x secret", "token=" + "a1" * 40_000, "deadbeef" * 3 + " " + "token=abcdef, " * 3000, "-----BEGIN RSA PRIVATE KEY-----\n" + "aZ09+/=\n" * 40 + "-----END RSA", "eyJhbGciOi.eyJzdWIiOi.SflKxwRJ-_"]


def test_by_definition(spark):
    rows = [(k if k != 5 else None, t, f"s{k % 4}" if k % 9 else None) for k, t in enumerate(texts())]
    rows += rows[-6:] + rows[:3]
    got = sorted(((r["doc_id"], r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"], r["spans"]) for r in secret_scan.scan(frame(spark, rows)).collect()), key=str)
    assert got == by_definition(rows)


def test_owners_tell_examples_from_live_ones(spark):
    example, mine, two = "Aa0_" * 7, "Bb1_" * 7, "Cc2_" * 7
    rows = [(k, f"key {example}", f"r{k}") for k in range(5)] + [(10, f"{mine} and {mine}", "r1"), (11, mine, "r1"), (12, two, "r1"), (13, two, "r2"), (14, f"token={example}", "r9")]
    got = {r["doc_id"]: (r["spans"], r["n_live"], r["n_copied"], r["verdicts"]) for r in secret_scan.scan(frame(spark, rows)).collect()}
    assert got[0] == ("", 0, 1, "mixed:4:32:copied:6:6")
    assert got[10] == ("mixed:0:28,mixed:33:61", 2, 0, "mixed:0:28:live:1:1,mixed:33:61:live:1:1")
    assert got[12] == ("", 0, 0, "mixed:0:28:shared:2:2")
    assert got[14][0] == "assign:0:34"  # base spans stay, copied or not
    docs = frame(spark, rows)
    owned = {r["doc_id"]: r["spans"] for r in secret_scan.scan(docs, owner=docs["row"]).collect()}
    assert owned[12] == "mixed:0:28"  # two repositories of one owner


@pytest.mark.parametrize("name", ["none", "all"])
def test_no_rows_and_no_secrets(spark, name):
    rows = [] if name == "none" else [(k, "just words", "s") for k in range(4)]
    got = secret_scan.scan(frame(spark, rows)).collect()
    assert [(r["spans"], r["verdicts"], r["n_live"]) for r in got] == [("", "", 0)] * len(rows)
