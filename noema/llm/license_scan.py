"""License scans: sparse TF-IDF cosine to templates, and inheritance from the nearest ancestor directory.

Every line of a file, and every run of a few lines, is a candidate header. Its
words, weighted by TF-IDF over the templates, are compared with all templates
at once; a file's own licence is that of its best candidate. A candidate that
names another licence or version than the template is not of that licence, and
if no template remains it states an unknown one. A tag's expression counts as
it stands. A licence file
speaks for its directory, and a file without a licence of its own takes that
of the nearest directory above it that has one, found by joining paths.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noema.llm.frames import cut, map_batches
from noema.llm.words import texts_of
from noema.operators.common import lookup

SCHEMA = "doc_id long, license string, similarity double, matched string, inherited boolean, source_path string"
#: Notices and first words of licence texts, by their SPDX names.
NOTICES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.', "Apache License Version 2.0, January 2004"],
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "The MIT License"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License", "GNU General Public License Version 3, 29 June 2007"],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License", "GNU General Public License Version 2, June 1991"],
    "LGPL-3.0": ["Licensed under the GNU Lesser General Public License, version 3.", "GNU Lesser General Public License Version 3, 29 June 2007"],
    "AGPL-3.0": ["Licensed under the GNU Affero General Public License, version 3.", "GNU Affero General Public License Version 3, 19 November 2007"],
    "BSD-3-Clause": ["Licensed under the BSD 3-Clause License.", "BSD 3-Clause License"],
    "BSD-2-Clause": ["Licensed under the BSD 2-Clause License.", "BSD 2-Clause License"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, version 2.0."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related rights to this work. CC0 1.0 Universal", "Licensed under CC0 1.0."],
    "ISC": ["Licensed under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
}
_GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_CLAUSES = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_DISCLAIMER = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
#: Whole texts of the short licences.
TEXTS = {"MIT": _GRANT, "BSD-2-Clause": f"{_CLAUSES} {_DISCLAIMER}", "BSD-3-Clause": f"{_CLAUSES} {_THIRD} {_DISCLAIMER}", "ISC": _ISC}
TEMPLATES = {name: [*notices, *([TEXTS[name]] if name in TEXTS else [])] for name, notices in NOTICES.items()}
_WORD = re.compile(r"[a-z0-9][a-z0-9.+]*[a-z0-9+]|[a-z0-9]")
#: How a licence is named, as patterns of lower-case text; a candidate that names another one, or another version, is not of that licence.
NAMES = {
    "apache": r"\bapache licen[cs]e\b",
    "mit": r"\bmit licen[cs]e\b",
    "agpl": r"\b(affero general public licen[cs]e|agpl)",
    "lgpl": r"\b((lesser|library) general public licen[cs]e|lgpl)",
    "gpl": r"(?<!affero )(?<!lesser )(?<!library )\bgeneral public licen[cs]e\b|\bgpl",
    "bsd": r"\bbsd\b",
    "mpl": r"\b(mozilla public licen[cs]e|mpl)\b",
    "epl": r"\b(eclipse (public licen[cs]e|distribution)|epl)\b",
    "cc": r"\b(creative commons|cc)\b(?! ?0)",
    "cc0": r"\bcc0\b",
    "isc": r"\bisc licen[cs]e\b",
    "unlicense": r"\bunlicense\b|\bunencumbered software\b",
    "bsl": r"\b(boost software licen[cs]e|bsl)\b",
    "zlib": r"\bzlib\b",
    "artistic": r"\bartistic licen[cs]e\b",
    "eupl": r"\b(european union public licen[cs]e|eupl)\b",
    "cddl": r"\b(common development and distribution licen[cs]e|cddl)\b",
    "wtfpl": r"\bwtfpl\b|\bdo what the f",
    "python": r"\b(python software foundation|psf) licen[cs]e\b",
    "ofl": r"\b(open font licen[cs]e|ofl)\b",
}
_NAMES = {k: re.compile(v) for k, v in NAMES.items()}
#: A version, told from a year or a clause by its place.
_VERSION = re.compile(r"\b(?:version|v\.?|l?gpl-?|agpl-?|by(?:-sa|-nc)?|licen[cs]e,?|attribution(?:-\w+)*)\s*(\d+(?:\.\d+)*)\b(?!-clause)")
_CLAUSE = re.compile(r"\b([234])[- ]clause\b")
_CREATIVE = {"sa": re.compile(r"sharealike|share-alike|\bby(?:-nc)?-sa\b"), "nc": re.compile(r"noncommercial|non-commercial|\bby-nc\b"), "nd": re.compile(r"noderiv|\bby(?:-nc)?-nd\b")}
#: A tag and the expression that follows it on its line.
_TAG = re.compile(r"spdx-license-identifier:[ \t]*([^\r\n]*)", re.IGNORECASE)
_GRANTED = re.compile(r"\b(licen[cs]ed|released|distributed|available) under\b", re.IGNORECASE)
UNKNOWN = "unknown"


def named(text: str) -> tuple[frozenset[str], frozenset[str], frozenset[str]]:
    """What a candidate says of itself: families, versions without closing zeros, and further marks (clauses, terms of sharing)."""
    low = re.sub(r"\s+", " ", text.lower())
    marks = {m[1] + "-clause" for m in _CLAUSE.finditer(low)} | {k for k, p in _CREATIVE.items() if p.search(low)}
    return frozenset(k for k, p in _NAMES.items() if p.search(low)), frozenset(re.sub(r"(\.0)+$", "", m[1]) for m in _VERSION.finditer(low)), frozenset(marks)


def expression(text: str) -> str | None:
    """Identifiers of a tag's expression, with their operators as they stand; None if there is none. Comments' ends are no part of it."""
    words = re.findall(r"[A-Za-z0-9][A-Za-z0-9.+-]*|[()]", re.split(r"\*/|-->|\}|\s#", text)[0])
    kept: list[str] = []
    for w in words:
        operator = w in ("AND", "OR", "WITH")
        if w not in "()" and not operator and kept and kept[-1] not in ("AND", "OR", "WITH", "("):
            break  # prose after the expression
        kept.append(w)
    while kept and kept[-1] in ("AND", "OR", "WITH", "("):
        kept.pop()
    names = [w for w in kept if w not in ("AND", "OR", "WITH", "(", ")")]
    if not names:
        return None
    return re.sub(r"\( | \)", lambda m: m[0].strip(), " ".join(kept))
#: Names of files that speak for their directory.
LICENSE_FILES = r"(?i)^(licen[cs]e|copying|copyright|notice|unlicense)([-._].*)?$"


class Templates:
    """Unit vectors of all templates over their words."""

    def __init__(self, templates: dict[str, list[str]] = TEMPLATES, margin: float = 0.05):
        self.margin = margin
        pairs = [(name, text) for name in templates for text in templates[name]]
        self.names = [name for name, _ in pairs]
        counts = [Counter(_WORD.findall(text.lower())) for _, text in pairs]
        seen = Counter(w for c in counts for w in c)
        self.column = {w: k for k, w in enumerate(sorted(seen))}
        self.idf = np.array([np.log((1 + len(pairs)) / (1 + seen[w])) + 1 for w in sorted(seen)])
        self.unknown = np.log(1 + len(pairs)) + 1
        self.matrix = np.zeros((len(pairs), len(self.idf)))
        for k, c in enumerate(counts):
            for w, n in c.items():
                self.matrix[k, self.column[w]] = n * self.idf[self.column[w]]
        self.matrix /= np.linalg.norm(self.matrix, axis=1, keepdims=True)
        own = [named(text) for _, text in pairs]
        #: What each licence's templates say of themselves, taken together.
        self.says = {n: tuple(frozenset().union(*(o[k] for (m, _), o in zip(pairs, own, strict=True) if m == n)) for k in range(3)) for n in templates}
        # a line is compared if it has one of the templates' words that speak of licences
        rare = sorted({w for w in seen if re.fullmatch(r"licen[cs]e[ds]?|copyright|permission|redistribution|unencumbered|waived", w)})
        self.any = re.compile(r"(?<![a-z0-9])(?:" + "|".join(rare) + r")(?![a-z0-9])", re.IGNORECASE)

    def fits(self, name: str, text: str) -> bool:
        """Whether what a candidate says of itself may be said of a licence: no other family, no other version (one at least where the licence has versions), and the same marks where it names any."""
        families, versions, marks = named(text)
        own_families, own_versions, own_marks = self.says[name]
        if families and own_families and not families <= own_families:
            return False
        if families and own_versions and not versions & own_versions:
            return False
        if versions and own_versions and not versions & own_versions:
            return False
        return marks == own_marks if families & {"cc", "bsd"} else not marks - own_marks

    def best(self, text: str, least: float = 0.0) -> tuple[float, str]:
        """Largest cosine to a template, and the template's licence (below ``least`` nothing is looked up and it is ``UNKNOWN``); ``UNKNOWN`` if what the candidate says of itself doesn't fit it, or no licence is ``margin`` ahead of all others."""
        c = Counter(_WORD.findall(text.lower()))
        known = {self.column[w]: n for w, n in c.items() if w in self.column}
        if not known:
            return 0.0, ""
        columns = np.fromiter(known, np.int64)
        weights = np.fromiter(known.values(), np.float64) * self.idf[columns]
        length = float((weights * weights).sum() + sum((n * self.unknown) ** 2 for w, n in c.items() if w not in self.column)) ** 0.5
        cosine = self.matrix[:, columns] @ weights / length
        if cosine.max() < least:
            return float(cosine.max()), UNKNOWN
        by_name: dict[str, float] = {}
        for name, value in zip(self.names, cosine.tolist(), strict=True):
            if value > by_name.get(name, 0.0):
                by_name[name] = value
        ranked = sorted((n for n in by_name if self.fits(n, text)), key=lambda n: (-by_name[n], n))
        top = max(by_name.values(), default=0.0)
        if not ranked or by_name[ranked[0]] < top - self.margin or len(ranked) > 1 and by_name[ranked[0]] - by_name[ranked[1]] < 1e-9:
            return top, UNKNOWN
        return by_name[ranked[0]], ranked[0]

    def scan(self, text: str, threshold: float, most: int = 4) -> tuple[float, str, str] | None:
        """Best candidate of a whole text at ``threshold`` or more: similarity, licence, its words; a grant under a named licence that is like no template is ``UNKNOWN`` at whatever similarity. A tag's expression decides (similarity 1). A candidate of a licence without templates is ``UNKNOWN``, and gives way to any other. Candidates are the lines (and sentences) with a word of licences, alone and with up to ``most`` - 1 of those that follow, runs of blank-free lines, and the whole text."""
        if self.any.search(text) is None:
            return None
        lines = [p for line in text.splitlines() for p in re.split(r"(?<=[.;:])\s+(?=[A-Z\"(])", line)]
        for tag in _TAG.finditer(text):
            if (stated := expression(tag[1])) is not None:
                return 1.0, stated, tag[0].strip()
        best: tuple[float, str, str] | None = None

        def better(value: float, name: str) -> bool:
            return value >= threshold and (best is None or (name != UNKNOWN, value) > (best[1] != UNKNOWN, best[0] + 1e-12))

        blocks = [b for b in re.split(r"\n[ \t\r]*\n", text) if self.any.search(b)]
        for part in dict.fromkeys([*blocks, text]):
            value, name = self.best(part, threshold)
            if better(value, name):
                best = (value, name, part)
        for k, line in enumerate(lines):
            if self.any.search(line) is None:
                continue
            for n in range(1, most + 1):
                part = " ".join(lines[k : k + n])
                value, name = self.best(part, threshold)
                if better(value, name):
                    best = (value, name, part)
                if k + n >= len(lines):
                    break
        if best is None:  # a grant under a licence of another name than those of the templates
            for line in lines:
                if _GRANTED.search(line) and named(line)[0]:
                    return self.best(line)[0], UNKNOWN, line
        return best


def own_licenses(files: DataFrame, threshold: float = 0.6, templates: dict[str, list[str]] = TEMPLATES) -> DataFrame:
    """The licence that each file states: doc_id, path, license (or ``unknown``), similarity, matched (nulls if none). ``files``: doc_id, path, text; other columns are ignored. A null or empty text states nothing, each of repeated rows gives a row, and an empty table none; of equally similar licences it is unknown which."""
    model = Templates(templates)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [model.scan(t.decode(), threshold) or (None, None, None) for t in texts_of(batch.column(2))]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([f[1] for f in found], pa.string()), pa.array([f[0] for f in found], pa.float64()), pa.array([f[2] for f in found], pa.string())], ["doc_id", "path", "license", "similarity", "matched"])

    return map_batches(files.select(files["doc_id"].cast("long").alias("doc_id"), files["path"].cast("string").alias("path"), files["text"].cast("string").alias("text")), run, "doc_id long, path string, license string, similarity double, matched string")


def scan(files: DataFrame, threshold: float = 0.6, templates: dict[str, list[str]] = TEMPLATES) -> DataFrame:
    """Licences of files by their own text, else by inheritance.

    A file whose name is that of a licence file and that states a licence speaks for its
    directory (of several, the one of highest similarity, then of the first path). Files
    without a licence join their ancestor directories with those; the deepest wins. Rows
    without any keep nulls. A null text states nothing; a null path inherits nothing and
    gives nothing; repeated rows each give a row; an empty table gives none.
    """
    own = cut(own_licenses(files, threshold, templates))
    parts = F.split("path", "/")
    speaking = own.where(F.col("license").isNotNull() & F.element_at(parts, -1).rlike(LICENSE_FILES)).select(F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/").alias("dir"), F.struct(-F.col("similarity"), F.col("path"), F.col("license")).alias("best"))
    given = speaking.groupBy("dir").agg(F.min("best").alias("best")).select("dir", F.col("best.license").alias("given"), F.col("best.path").alias("given_path"))
    # every directory is looked up once, not once for each of its files
    own = own.withColumn("dir", F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), "/"))
    folders = own.where(F.col("license").isNull() & F.col("path").isNotNull()).select("dir").distinct()
    above = folders.select("dir", F.explode(F.expr("transform(sequence(0, size(split(dir, '/'))), k -> struct(k as depth, array_join(slice(split(dir, '/'), 1, k), '/') as above))")).alias("step")).select("dir", "step.depth", "step.above")
    nearest = above.join(given.withColumnRenamed("dir", "above"), "above").groupBy("dir").agg(F.max(F.struct("depth", "given", "given_path")).alias("near")).select("dir", "near.given", "near.given_path")
    joined = lookup(own, nearest, ["dir"])
    mine = F.col("license").isNotNull()
    return joined.select("doc_id", F.coalesce("license", "given").alias("license"), "similarity", "matched", (~mine & F.col("given").isNotNull()).alias("inherited"), F.when(mine, F.col("path")).otherwise(F.col("given_path")).alias("source_path"))


def document_paths(docs: DataFrame) -> DataFrame:
    """Documents as files: source / group of 50 ids / id.txt; short texts are named LICENSE, as a text of its own in their folder. The table has no paths, so these are made up: a null source is the folder ``none``, a null id is -1, and a null text is no licence file."""
    number = F.coalesce(docs["doc_id"].cast("long"), F.lit(-1))
    name = F.when(F.length(docs["text"]) <= 200, F.concat(F.lit("LICENSE."), number.cast("string"))).otherwise(F.concat(number.cast("string"), F.lit(".txt")))
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.concat_ws("/", F.coalesce(docs["source"], F.lit("none")), F.concat(F.lit("d"), F.floor(number / 50).cast("string")), name).alias("path"), docs["text"].cast("string").alias("text"))
