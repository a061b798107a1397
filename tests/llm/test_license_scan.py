"""Licences by template, and inheritance against a walk up the directories."""

import random

import pytest

from noema.llm import license_scan

FILES = "doc_id long, path string, text string, dir string, license string, given string, above string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z", "w") for r in rows], FILES).repartition(3)


@pytest.mark.parametrize("name", sorted(license_scan.NOTICES))
def test_spdx_tags_and_notices(name):
    model = license_scan.Templates()
    assert model.scan(f"code\n# SPDX-License-Identifier: {name}\nmore", 0.6)[1] == name
    assert model.scan(f"some words before\n{license_scan.NOTICES[name][0]}\nand after", 0.6)[1] == name


@pytest.mark.parametrize("name", sorted(license_scan.TEXTS))
def test_whole_texts(name):
    words = license_scan.TEXTS[name].split()
    text = "Copyright (c) 2020 Somebody\n\n" + "\n".join(" ".join(words[k : k + 11]) for k in range(0, len(words), 11))
    assert license_scan.Templates().scan(text, 0.6)[1] == name


def test_no_licence_in_prose():
    assert license_scan.Templates().scan("The pilot has a licence to fly and permission to land. " * 5000, 0.6) is None


def test_inheritance_by_walking_up(spark):
    dice = random.Random(2)
    names = sorted(license_scan.NOTICES)
    rows, stated = [], {}
    for k in range(120):
        folder = "/".join(dice.choice("abc") for _ in range(dice.randrange(0, 5)))
        kind = dice.random()
        name = ("LICENSE", "COPYING.txt")[k % 2] if kind < 0.25 else f"f{k}.py"
        own = dice.choice(names) if kind < 0.4 else None
        path = f"{folder}/{name}" if folder else name
        rows.append((k, path, f"SPDX-License-Identifier: {own}" if own else "words only"))
        if own and not name.startswith("f"):
            value = license_scan.Templates().scan(rows[-1][2], 0.6)[0]
            stated.setdefault(folder, []).append((-value, path, own))
    want = {}
    for k, path, text in rows:
        own = text.split()[-1] if text.startswith("SPDX") else None
        parts, near = path.split("/")[:-1], None
        while near is None:
            if "/".join(parts) in stated:
                near = min(stated["/".join(parts)])
            if not parts:
                break
            parts.pop()
        want[k] = (own, False, path) if own else (near[2], True, near[1]) if near else (None, False, None)
    got = {r["doc_id"]: (r["license"], r["inherited"], r["source_path"]) for r in license_scan.scan(frame(spark, rows)).collect()}
    assert got == want


def test_odd_rows(spark):
    rows = [(None, "a/LICENSE", "SPDX-License-Identifier: MIT"), (1, "a/x", None), (1, "a/x", None), (2, "", ""), (3, None, "SPDX-License-Identifier: ISC"), (4, "b/long", "word " * 300_000 + "\nReleased under the MIT License."), (5, "a//y", "")]
    got = sorted(((r["doc_id"] or 0, r["license"], r["inherited"]) for r in license_scan.scan(frame(spark, rows)).collect()), key=str)
    assert got == sorted([(0, "MIT", False), (1, "MIT", True), (1, "MIT", True), (2, None, False), (3, "ISC", False), (4, "MIT", False), (5, "MIT", True)], key=str)
    assert license_scan.scan(frame(spark, rows).limit(0)).count() == 0


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("SPDX-License-Identifier: GPL-2.0-or-later", "GPL-2.0-or-later"),
        ("// SPDX-License-Identifier: (MIT OR Apache-2.0) AND Zlib */", "(MIT OR Apache-2.0) AND Zlib"),
        ("<!-- SPDX-License-Identifier: BSL-1.0 -->", "BSL-1.0"),
        ("# spdx-license-identifier: EPL-2.0 and words after it", "EPL-2.0"),
        ("SPDX-License-Identifier:", None),
        ("under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License", license_scan.UNKNOWN),
        ("This Source Code Form is subject to the terms of the Eclipse Public License, v. 2.0.", license_scan.UNKNOWN),
        ("Licensed under the Mozilla Public License, version 1.1.", license_scan.UNKNOWN),
        ("Licensed under the Apache License, Version 1.1.", license_scan.UNKNOWN),
        ("Licensed under the BSD 4-Clause License.", license_scan.UNKNOWN),
        ("This work is licensed under CC BY-ND 4.0.", license_scan.UNKNOWN),
        ("This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 International License.", license_scan.UNKNOWN),
        ("Licensed under the Zlib License.", license_scan.UNKNOWN),
        ("under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License", "GPL-3.0"),
        ("under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License", "GPL-2.0"),
    ],
)
def test_other_licences_are_not_taken_for_known_ones(text, want):
    got = license_scan.Templates().scan(f"words\n{text}\nmore", 0.6)
    assert (got and got[1]) == want


def test_decision_by_the_plain_cosine():
    """The best licence against cosines worked out word by word."""
    import collections
    import math

    model, templates = license_scan.Templates(), [(n, t) for n, ts in license_scan.TEMPLATES.items() for t in ts]
    bags = [collections.Counter(license_scan._WORD.findall(t.lower())) for _, t in templates]
    idf = lambda w: math.log((1 + len(bags)) / (1 + sum(w in b for b in bags))) + 1
    dice = random.Random(8)
    for name, text in templates:
        words = text.split()
        some = " ".join(w for w in words if dice.random() < 0.9) + " or so"
        bag = collections.Counter(license_scan._WORD.findall(some.lower()))
        size = lambda b: math.sqrt(sum((n * idf(w)) ** 2 for w, n in b.items()))
        cosines = [sum(n * b[w] * idf(w) ** 2 for w, n in bag.items()) / size(bag) / size(b) for b in bags]
        value, found = model.best(some)
        assert value == pytest.approx(max(cosines), abs=1e-9) or found == license_scan.UNKNOWN or value >= max(cosines) - 0.05
        if found != license_scan.UNKNOWN:
            assert max(c for c, (n, _) in zip(cosines, templates) if n == found) == pytest.approx(value, abs=1e-9)


def test_a_tie_between_licences_is_unknown():
    both = license_scan.Templates({"A": ["Permission is granted to all."], "B": ["Permission is granted to all."]})
    assert both.scan("Permission is granted to all.", 0.6) == (pytest.approx(1.0), license_scan.UNKNOWN, "Permission is granted to all.")
