"""Secret scans by corpus-wide ownership: who else holds a candidate tells an example from a live credential.

Every text gives candidates: the base kinds, and wider kinds that are only
worth reporting if they are somebody's own. The hashes of all candidates are
summed over the corpus by distinct repositories and owners; one that a single
owner holds looks live, one that many owners hold is a copied example. All of
it is column expressions and joins.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import or_
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noema.llm.frames import cut
from noema.operators.common import lookup

SPANS = "array<struct<s:int,k:int,e:int,h:string>>"


class Kind(NamedTuple):
    """A pattern, the group that holds the secret, its least length, classes of which it needs a character each, and what a text in lower case must hold."""

    pattern: str
    group: int = 0
    least: int = 1
    needs: tuple[str, ...] = ()
    hints: tuple[str, ...] = ()


#: The kinds whose matches are always reported. Runs of one class have their least length in the
#: pattern: a run that is too short holds no longer one.
BASE = {
    "assign": Kind(r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, (), ("password", "passwd", "secret", "token", "apikey", "api_key")),
    "access": Kind(r"AKIA[A-Z0-9]{16,}", 0, 20, (), ("akia",)),
    "hex": Kind(r"[0-9a-f]{24,}", 0, 24),
}
#: Kinds that are reported if they look live; their repetitions are bounded, so no text takes quadratic time.
WIDER = {
    "jwt": Kind(r"eyJ[A-Za-z0-9_-]{8,900}[.][A-Za-z0-9_-]{8,900}[.][A-Za-z0-9_-]{8,900}", hints=("eyj",)),
    "pem": Kind(r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----[A-Za-z0-9+/=\x0A\x0D\x20]{16,}-----END", hints=("private key-----",)),
    "prefixed": Kind(r"(gh[pousr]_|github_pat_|glpat-|xox[abprs]-|[sr]k_live_|AIza)[A-Za-z0-9_-]{16,200}", hints=("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_", "glpat-", "xox", "k_live_", "aiza")),
    "url": Kind(r"[a-z][a-z0-9+.-]{1,15}://[^\x00-\x20/:@]{1,100}:([^\x00-\x20/@]{1,100})@", 1, hints=("://",)),
    "mixed": Kind(r"[A-Za-z0-9+_-]{24,}={0,2}", 0, 24, ("[0-9]", "[A-Z]", "[a-z]")),
}


def matches(text: Column, kind: Kind, number: int, possible: Column) -> Column:
    """Leftmost matches of a kind that do not overlap, less the failing ones: array of (s, k, e, h): code points, the kind's number, digest of the secret.

    Where a match lies follows from the lengths of what lies between matches,
    summed in log(n) passes over the array; a text is only split if it is ``possible`` and has one.
    """
    parts = F.struct(
        F.split(text, kind.pattern, -1).alias("between"),
        F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)).alias("whole"),
        F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(kind.group)).alias("secret"),
    )

    def ends(z: Column) -> Column:
        steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(z["whole"]).cast("double"))).cast("int"))
        lengths = F.transform(z["whole"], lambda x, i: F.length(x) + F.length(F.get(z["between"], i)))
        return F.aggregate(steps, lengths, lambda acc, k: F.transform(acc, lambda v, i: v + F.coalesce(F.get(acc, i - F.call_function("shiftleft", F.lit(1), k)), F.lit(0))))

    def spans(z: Column, at: Column) -> Column:
        rows = F.transform(z["whole"], lambda x, i: F.struct((F.get(at, i) - F.length(x)).alias("s"), F.lit(number).alias("k"), F.get(at, i).alias("e"), F.get(z["secret"], i).alias("v")))
        return F.transform(F.filter(rows, lambda r: passes(r["v"], kind)), lambda r: F.struct(r["s"], r["k"], r["e"], F.md5(r["v"].cast("binary")).alias("h")))

    # a one-element array names what lambdas would otherwise evaluate for every element
    found = F.flatten(F.transform(F.array(parts), lambda z: F.flatten(F.transform(F.array(ends(z)), lambda at: spans(z, at)))))
    return F.when(possible & text.rlike(kind.pattern), found).otherwise(F.array().cast(SPANS))


def passes(secret: Column, kind: Kind) -> Column:
    out = F.length(secret) >= kind.least
    for needed in kind.needs:
        out = out & secret.rlike(needed)
    return out


def candidates(docs: DataFrame, owner: Column | None = None, wider: dict[str, Kind] = WIDER) -> DataFrame:
    """Per row of ``docs`` (doc_id, text, source): row, doc_id, repo, owner, base and more (arrays of matches). A null text is empty; null sources are one repository.

    ``row`` numbers rows as the scan meets them; cut the table before using it twice.
    """
    repo = F.coalesce(docs["source"].cast("string"), F.lit(""))
    texts = docs.select(F.monotonically_increasing_id().alias("row"), docs["doc_id"].cast("long").alias("doc_id"), repo.alias("repo"), (repo if owner is None else F.coalesce(owner.cast("string"), F.lit(""))).alias("owner"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"))

    def kinds(z: Column, some: list[Kind], first: int) -> Column:
        hinted = [reduce(or_, (F.contains(z["low"], F.lit(h)) for h in kind.hints), F.lit(not kind.hints)) for kind in some]
        return F.concat(F.array().cast(SPANS), *(matches(z["text"], kind, first + k, test) for k, (kind, test) in enumerate(zip(some, hinted, strict=True))))

    both = F.transform(F.array(F.struct("text", F.lower("text").alias("low"))), lambda z: F.struct(F.array_sort(kinds(z, [*BASE.values()], 0)).alias("base"), kinds(z, [*wider.values()], len(BASE)).alias("more")))
    return texts.select("row", "doc_id", "repo", "owner", F.inline(both))


def ownership(spans: DataFrame) -> DataFrame:
    """Digests (h) with the numbers of distinct repositories and owners that hold them; combined before each shuffle."""
    each = spans.select("h", "owner", "repo").distinct().groupBy("h", "owner").agg(F.count("*").alias("repos"))
    return each.groupBy("h").agg(F.sum("repos").alias("n_repos"), F.count("*").alias("n_owners"))


def scan(docs: DataFrame, owner: Column | None = None, own: int = 1, copied: int = 3, wider: dict[str, Kind] = WIDER) -> DataFrame:
    """Secrets of every text: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_copied, verdicts.

    ``docs``: doc_id, text, source; the source is the repository, and its owner too unless ``owner`` is
    given. A digest with at most ``own`` owners is live, one with ``copied`` or more is copied, others
    are shared. Base spans are always in ``spans``, wider ones if they are live. ``verdicts`` has
    kind:start:end:verdict:repositories:owners of every candidate. Spans are ordered by start, then
    kind, then end; one text may hold several that overlap. Null and empty texts hold none; each of
    repeated rows gives its row (they are one repository); an empty table gives no rows; other columns
    are ignored.
    """
    names = F.array(*(F.lit(n) for n in [*BASE, *wider]))
    found = cut(candidates(docs, owner, wider))
    spans = cut(found.select("row", "repo", "owner", F.explode(F.concat("base", "more")).alias("x")).select("row", "repo", "owner", "x.*"))
    judged = lookup(spans, cut(ownership(spans)), ["h"])
    verdict = F.when(F.col("n_owners") <= own, "live").when(F.col("n_owners") >= copied, "copied").otherwise("shared")
    near = judged.select("row", F.struct("s", "k", "e", verdict.alias("verdict"), "n_repos", "n_owners").alias("x")).groupBy("row").agg(F.array_sort(F.collect_list("x")).alias("all"))

    def text(kept: Column, *more: str) -> Column:
        return F.array_join(F.transform(kept, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"], x["e"], *(x[m] for m in more))), ",")

    everything = F.coalesce("all", F.array().cast("array<struct<s:int,k:int,e:int,verdict:string,n_repos:bigint,n_owners:bigint>>"))

    def count(test) -> Column:
        return F.size(F.filter(everything, test)).cast("long")

    def of_kind(k: int) -> Column:
        return F.size(F.filter("base", lambda x: x["k"] == k)).cast("long")

    return found.join(near, "row", "left").select(
        "doc_id",
        *(of_kind(k).alias(f"n_{name}") for k, name in enumerate(BASE)),
        F.sha2(text(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        text(F.filter(everything, lambda x: (x["k"] < len(BASE)) | (x["verdict"] == "live"))).alias("spans"),
        count(lambda x: x["verdict"] == "live").alias("n_live"),
        count(lambda x: x["verdict"] == "copied").alias("n_copied"),
        text(everything, "verdict", "n_repos", "n_owners").alias("verdicts"),
    )


def _sql_kind(number: int, kind: Kind) -> str:
    """DuckDB SQL of a kind's spans: (s, k, e, v) of every match that passes, from a table ``t`` with a column ``x``."""
    pattern = re.sub("[a-z]", lambda c: f"[{c[0]}{c[0].upper()}]", kind.pattern[4:].split("[", 1)[0]) + "[" + kind.pattern.split("[", 1)[1] if kind.pattern.startswith("(?i)") else kind.pattern
    quoted = pattern.replace("'", "''")
    needs = "".join(f" AND regexp_matches(v, '{n}')" for n in kind.needs)
    return f"""SELECT r, g[1] AS s, {number} AS k, g[1] + length(g[2]) AS e, g[3] AS v FROM (
  SELECT r, unnest(list_transform(range(1, len(m) + 1), lambda i: (list_sum(list_transform(p[1:i], lambda y: length(y)))::BIGINT + coalesce(list_sum(list_transform(m[1:i - 1], lambda y: length(y))), 0)::BIGINT, m[i], q[i]))) AS g
  FROM (SELECT r, string_split_regex(x, '{quoted}') AS p, regexp_extract_all(x, '{quoted}') AS m, regexp_extract_all(x, '{quoted}', {kind.group}) AS q FROM t WHERE regexp_matches(x, '{quoted}')))
WHERE length(g[3]) >= {kind.least}{needs.replace("(v,", "(g[3],")}"""


def oracle(own: int = 1, copied: int = 3, wider: dict[str, Kind] = WIDER) -> str:
    """DuckDB SQL of ``scan`` over ``documents``."""
    kinds = {**BASE, **wider}
    union = "\nUNION ALL\n".join(_sql_kind(k, kind) for k, kind in enumerate(kinds.values()))
    name = "(CASE k " + " ".join(f"WHEN {k} THEN '{n}'" for k, n in enumerate(kinds)) + " END)"
    counts = ", ".join(f"count(*) FILTER (WHERE k = {k}) AS n_{n}" for k, n in enumerate(BASE))
    return f"""WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS repo, coalesce(text, '') AS x FROM documents),
found AS ({union}),
held AS (SELECT v, count(DISTINCT repo) AS n FROM found JOIN t USING (r) GROUP BY v),
judged AS (SELECT r, s, k, e, n, {name} || ':' || s || ':' || e AS span, CASE WHEN n <= {own} THEN 'live' WHEN n >= {copied} THEN 'copied' ELSE 'shared' END AS verdict FROM found JOIN held USING (v)),
each AS (SELECT r, {counts},
  coalesce(string_agg(span, ',' ORDER BY s, k) FILTER (WHERE k < {len(BASE)}), '') AS base,
  coalesce(string_agg(span, ',' ORDER BY s, k, e) FILTER (WHERE k < {len(BASE)} OR verdict = 'live'), '') AS spans,
  count(*) FILTER (WHERE verdict = 'live') AS n_live, count(*) FILTER (WHERE verdict = 'copied') AS n_copied,
  string_agg(span || ':' || verdict || ':' || n || ':' || n, ',' ORDER BY s, k, e) AS verdicts FROM judged GROUP BY r)
SELECT doc_id, {", ".join(f"coalesce(n_{n}, 0) AS n_{n}" for n in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
  coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied, coalesce(verdicts, '') AS verdicts
FROM t LEFT JOIN each USING (r)"""


ORACLE = oracle()
