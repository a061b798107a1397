"""Main text of web pages by equivalence classes of tokens.

Pages of one host share a template. Its tokens are elements under their path and
texts under theirs. A token's occurrence vector says how often it is on each page;
tokens with the same vector form a class, and classes that are frequent and have at
least two members are valid. Vectors are sums over all pages of a host, so Spark
aggregates them without ever holding a host's pages together. Elements of valid
classes nest and cut a page into slots; how much text that no class holds is in a
slot, over all pages, tells which slots are the article. What these slots hold is
the text of a page, without the texts that are themselves tokens of a class.
"""

from __future__ import annotations

import html
import re
from collections import Counter, defaultdict
from collections.abc import Iterable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noema.llm.frames import cut, map_batches

SCHEMA = "page_id long, url string, text string, n_chars long"
#: Shares of a host's pages that hold an element or a text of the template, and bits (of 64) that hashes of the different pages with such a text must fill, also where the page itself says that it is an article's.
ELEMENTS, TEXTS, DIFFERENT, DECLARED = 0.5, 0.9, 4, 8
#: Share of an element's text that its largest part must hold to stand for it: where page and article part, and further inside.
PARTING, INSIDE = 0.5, 0.85
#: Links from which on a slot is a menu; share of a page's slots that texts of the template may fill before they count as its own.
LINKS, OWN = 0.6, 0.5
#: Share of an element's text from which a part only wraps the rest; bits of an occurrence vector of one page, so that sums over 2^33 pages stay below 2^63.
WRAPS, VECTOR = 0.98, (1 << 30) - 1
#: Bytes of templates that are broadcast (more of them meet the pages in a join by host, where CROWD pages of a host or more are split); hosts at most whose numbers of pages are broadcast.
BROADCAST, CROWD, SHARE = 32 << 20, 1024, 100_000
#: Elements whose content is no text of the page, elements, roles and whole class names or ids that are not the article, elements that begin and end a block.
RAW = "script style noscript template textarea title svg math iframe object select canvas audio video xmp".split()
ASIDE = {"nav", "header", "footer", "aside", "form", "button", "dialog", "menu", "head"}
ASIDE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu"}
ASIDE_NAMES = set("ad ads advert advertisement banner promo sponsored nav navbar menu breadcrumbs header footer sidebar cookie-notice notice newsletter share comments comment-list related".split())
BLOCKS = set("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
FLOW = set("p b i em strong span a u s small font sub sup code br h1 h2 h3 h4 h5 h6".split())
ENDS_ITSELF = {"li", "tr", "td", "th", "dt", "dd", "option"}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>" + "|".join(RAW) + r")\b(?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</(?P=raw)\s*>|\Z)|<(?P<end>/?)(?P<name>[a-zA-Z][\w:-]*)(?P<rest>(?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[!?][^>]*>",
    re.DOTALL | re.IGNORECASE,
)
_CLASS = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.IGNORECASE)
_NUMBER = re.compile(r"\d+")
#: The page as an element around all others.
ROOT = -(1 << 63)


class Token(NamedTuple):
    """A text, or an element that begins (``text`` None; ``kind`` 1: an article, 2: named as no article) or ends (``kind`` -1). ``key`` names it under its path; ``parent``: the element around it."""

    key: int
    parent: int
    text: str | None
    kind: int
    breaks: bool
    aside: bool
    link: bool
    title: bool


def _key(name: str, parent: int) -> int:
    return xxhash.xxh64_intdigest(name.encode("utf-8", "replace"), parent) - (1 << 63)


def _seed(key: int) -> int:
    return key + (1 << 63)


def tokens(page: str) -> list[Token]:
    """Elements and texts of a page, in order. Elements left open end with the one around them; tags inside a line only mark breaks, links and titles."""
    out: list[Token] = [Token(ROOT, ROOT + 1, None, 0, False, False, False, False)]
    stack: list[tuple[str, bool, bool, bool, int]] = []  # name, aside, link, title, parent
    held: Counter[str] = Counter()
    aside = link = title = False
    parent, at = ROOT, 0

    def text(upto: int) -> None:
        if upto > at:
            part = page[at:upto]
            bare = part.strip()
            out.append(Token(_key(bare, _seed(parent)) if bare else 0, parent, part if bare else " ", 0, False, aside, link, title))

    def leave(depth: int) -> None:
        nonlocal aside, link, title, parent
        for name, *_ in stack[depth:]:
            held[name] -= 1
        for name, _, _, _, outside in reversed(stack[depth:]):
            if name not in FLOW:
                out.append(Token(0, outside, None, -1, name in BLOCKS, aside, link, title))
            elif name in BLOCKS:
                out.append(Token(0, outside, None, 0, True, aside, link, title))
        _, aside, link, title, parent = stack[depth]
        del stack[depth:]

    for found in _TOKEN.finditer(page):
        text(found.start())
        at = found.end()
        name = found["name"]
        if name is None:
            continue
        name = name.lower()
        if found["end"]:
            if held[name]:
                depth = len(stack) - 1
                while stack[depth][0] != name:
                    depth -= 1
                leave(depth)
            elif name in BLOCKS:
                out.append(Token(0, parent, None, 0, True, aside, link, title))
            continue
        if name in ENDS_ITSELF and stack and stack[-1][0] == name:
            leave(len(stack) - 1)
        rest = found["rest"]
        label, role, hidden, kind = "", "", False, 0
        if rest:
            for what, a, b, c in _CLASS.findall(rest):
                value, what = (a or b or c).lower(), what.lower()
                if what == "role":
                    role = value
                elif what in ("hidden", "aria-hidden"):
                    hidden |= what == "hidden" or value == "true"
                else:
                    label += " " + value
        if name in VOID or rest.endswith("/"):
            if name in BLOCKS:
                out.append(Token(0, parent, None, 0, True, aside, link, title))
            continue
        stack.append((name, aside, link, title, parent))
        held[name] += 1
        link, title = link or name == "a", title or name == "h1"
        if name not in ("body", "html", "article", "main"):
            aside = aside or hidden or name in ASIDE or role in ASIDE_ROLES
        if name in FLOW:
            if name in BLOCKS:
                out.append(Token(0, parent, None, 0, True, aside, link, title))
            continue
        if not aside and (name in ("article", "main") or role in ("article", "main")):
            kind = 1
        elif label and not ASIDE_NAMES.isdisjoint(label.split()):
            kind = 2
        own = _key(name + _NUMBER.sub("", label), _seed(parent))
        out.append(Token(own, parent, None, kind, name in BLOCKS, aside, link, title))
        parent = own
    text(len(page))
    if stack:
        leave(0)
    out.append(Token(0, ROOT + 1, None, -1, False, False, False, False))
    return out


class Row(NamedTuple):
    """What all pages of a host say of one token: ``pages`` that hold it and ``times`` it is on them, its occurrence ``vector`` and the ``bits`` of the pages' hashes, its characters (of what no tag sets aside), those in links and in titles, and the sum of its first places."""

    key: int
    parent: int
    is_text: bool
    kind: int
    pages: int
    times: int
    vector: int
    bits: int
    chars: int
    links: int
    titles: int
    place: int


def counted(read: list[Token], page_hash: int) -> list[Row]:
    """The rows of one page."""
    seen: dict[int, list] = {}
    open_at: list[tuple[int, int, int, int]] = []
    total = links = titles = 0
    for place, token in enumerate(read):
        if token.text is not None:
            if not token.key:
                continue
            size = 0 if token.aside else len(token.text.strip())
            total, links, titles = total + size, links + size * token.link, titles + size * token.title
            row = seen.setdefault(token.key, [token.parent, True, 0, 0, 0, 0, 0, place])
            row[3:7] = row[3] + 1, row[4] + size, row[5] + size * token.link, row[6] + size * token.title
        elif token.kind < 0:
            key, *before = open_at.pop()
            row = seen[key]
            row[4:7] = row[4] + total - before[0], row[5] + links - before[1], row[6] + titles - before[2]
        elif token.key:
            row = seen.setdefault(token.key, [token.parent, False, token.kind, 0, 0, 0, 0, place])
            row[3] += 1
            open_at.append((token.key, total, links, titles))
    name, bit = page_hash.to_bytes(8, "little", signed=True), 1 << (page_hash & 63)
    vectors = {times: xxhash.xxh64_intdigest(name, times) & VECTOR for times in {row[3] for row in seen.values()}}
    return [Row(k, *row[:3], 1, row[3], vectors[row[3]], bit, *row[4:]) for k, row in seen.items()]


def added(a: Row, b: Row) -> Row:
    """Rows of one token from different pages as one."""
    return Row(*a[:4], a.pages + b.pages, a.times + b.times, a.vector + b.vector, a.bits | b.bits, a.chars + b.chars, a.links + b.links, a.titles + b.titles, a.place + b.place)


class Template(NamedTuple):
    """``outer``: elements that are once on each page, with their order; ``slots``: elements that hold the article; ``closed``: elements inside that don't; ``fixed``: texts that are tokens of a class; ``titles``: whether a title outside of the slots belongs to it."""

    outer: dict[int, int]
    slots: frozenset[int]
    closed: frozenset[int]
    fixed: frozenset[int]
    titles: bool

    def packed(self) -> bytes:
        parts = (sorted(self.outer, key=self.outer.get), sorted(self.slots), sorted(self.closed), sorted(self.fixed))
        return np.array([self.titles, *map(len, parts), *(x for p in parts for x in p)], np.int64).tobytes()


def unpacked(data: bytes) -> Template:
    titles, *rest = np.frombuffer(data, np.int64).tolist()
    ends = np.cumsum([4, *rest[:4]]).tolist()
    outer, slots, closed, fixed = (rest[a:b] for a, b in zip(ends, ends[1:], strict=False))
    return Template({k: n for n, k in enumerate(outer)}, frozenset(slots), frozenset(closed), frozenset(fixed), bool(titles))


def deduce(rows: Iterable[Row], pages: int) -> Template:
    """Template of a host with so many pages from the rows of its tokens.

    Elements of valid classes form a tree. Its articles are the slots; where no element says that
    it is one, the way goes from the page down to the element that holds most of the text.
    """
    rows = [r for r in rows if r.pages >= ELEMENTS * pages]
    members: Counter[int] = Counter(r.vector for r in rows)
    valid = [r for r in rows if members[r.vector] > 1 or r.key == ROOT]
    different = {r.key: (r.bits & (1 << 64) - 1).bit_count() for r in valid if r.is_text}
    fixed = [r for r in valid if r.is_text and r.pages >= TEXTS * pages and different[r.key] >= DIFFERENT]
    elements = {r.key: r for r in valid if not r.is_text}
    constant: Counter[int] = Counter()
    for r in fixed:
        at = r.parent
        while at in elements:
            constant[at] += r.chars - r.links
            at = elements[at].parent
    weight = {k: max(0, r.chars - r.links - constant[k]) for k, r in elements.items()}
    below: dict[int, list[Row]] = defaultdict(list)
    for r in elements.values():
        below[r.parent].append(r)
    once = sorted((r for r in elements.values() if r.pages == r.times == pages), key=lambda r: (r.place, r.key))
    outer = {r.key: n for n, r in enumerate(once)}
    texts = frozenset(r.key for r in fixed)
    closed = {k for k, r in elements.items() if r.kind == 2 and 2 * weight[k] < weight.get(ROOT, 0)}
    largest: dict[int, int] = {}  # the heaviest article inside of each
    articles = {k for k, r in elements.items() if r.kind == 1 and r.chars}
    for k in articles:
        at = elements[k].parent
        while at in elements:
            largest[at] = max(largest.get(at, 0), weight[k])
            at = elements[at].parent
    if slots := frozenset(k for k in articles if 2 * largest.get(k, -1) < weight[k] or k not in largest):
        return Template(outer, slots, frozenset(closed), frozenset(k for k in texts if different[k] >= DECLARED), False)
    at, need = elements.get(ROOT), PARTING
    while at is not None:
        best = max((r for r in below[at.key] if r.key not in closed and r.times == r.pages), key=lambda r: (weight[r.key], r.key), default=None)
        if best is None or not weight[best.key] or weight[best.key] < need * weight[at.key]:
            break
        if weight[best.key] < WRAPS * weight[at.key]:
            need = INSIDE
        at = best
    closed |= {k for k, r in elements.items() if r.links > LINKS * r.chars}
    return Template(outer, frozenset([at.key] if at else []), frozenset(closed), texts, bool(at) and not at.titles)


def article(page: list[Token], template: Template | None) -> str:
    """Blocks that the slots hold, joined by line feeds. A page without slots of the template, or with its elements in another order, is a template of its own."""
    if template is not None:
        begun = [t.key for t in page if t.key and t.text is None]
        known = [template.outer[k] for k in begun if k in template.outer]
        if template.slots.isdisjoint(begun) or any(a >= b for a, b in zip(known, known[1:], strict=False)):
            template = None
    if template is None:
        template = deduce(counted(page, 0), 1)
    slots, closed, fixed = template.slots, template.closed, template.fixed
    kept: list[list[tuple[str, bool]]] = [[]]
    around = [(False, False)]  # in a slot, in a closed element
    sizes = [0, 0]
    for token in page:
        if token.breaks:
            kept.append([])
        held, shut = around[-1]
        if token.text is None:
            if token.kind < 0:
                around.pop()
            elif token.key:
                around.append((held or token.key in slots, token.key not in slots and (shut or token.key in closed)))
        elif not token.aside and not shut and (held or template.titles and token.title):
            constant = token.key in fixed
            sizes[constant] += len(token.text)
            kept[-1].append((token.text, constant))
    whole = sizes[True] > OWN * sum(sizes)  # pages that are copies but for a little
    blocks = (" ".join(html.unescape("".join(t for t, constant in parts if whole or not constant)).split()) for parts in kept if parts)
    return "\n".join(b for b in blocks if b)


def brute_force(pages: list[str]) -> Template:
    """The template of a host's pages with its classes by definition: equal occurrence vectors, page by page."""
    every = [{r.key: r for r in counted(tokens(p), xxhash.xxh64_intdigest(p) - (1 << 63))} for p in pages]
    rows = []
    for key in {k for page in every for k in page}:
        mine = [page[key] for page in every if key in page]
        vector = hash(tuple(page[key].times if key in page else 0 for page in every))
        total = mine[0]
        for r in mine[1:]:
            total = added(total, r)
        rows.append(total._replace(vector=vector))
    return deduce(rows, len(pages))


_COUNTS = "host long, key long, parent long, is_text boolean, kind int, pages long, times long, vector long, bits long, chars long, links long, titles long, place long"
_SUMS = ("pages", "times", "vector", "chars", "links", "titles", "place")


def token_rows(rows: DataFrame) -> DataFrame:
    """Rows of all tokens by host and key, ``rows``: host long, html. The row with key 0 has the number of pages."""

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        found: dict[tuple[int, int], Row] = {}
        for host, page_hash, page in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            for r in counted(tokens(page), page_hash):
                name = (host, r.key)
                found[name] = added(found[name], r) if name in found else r
        types = [pa.int64(), pa.int64(), pa.bool_(), pa.int32(), *[pa.int64()] * 8]
        values = zip(*found.values(), strict=True) if found else [()] * len(types)
        signed = [np.array(c, np.uint64).view(np.int64) if n == "bits" else c for n, c in zip(Row._fields, values, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array([h for h, _ in found], pa.int64()), *(pa.array(c, t) for c, t in zip(signed, types, strict=True))], ["host", *Row._fields])

    counts = map_batches(rows.select("host", F.xxhash64("html"), "html"), count, _COUNTS)
    return counts.groupBy("host", "key").agg(*(F.min(c).alias(c) for c in ("parent", "is_text", "kind")), F.bit_or("bits").alias("bits"), *(F.sum(c).alias(c) for c in _SUMS))


def templates(rows: DataFrame, sizes: DataFrame, large: DataFrame) -> DataFrame:
    """A template for each host: host long, template binary. ``sizes``: host, n; ``large``: those of few hosts with many pages, small enough to broadcast."""
    enough = F.col("pages") >= ELEMENTS * F.col("n")
    # most rows of hosts with many pages go before the rows of a host meet
    some = token_rows(rows).join(F.broadcast(large), "host", "left").where(F.col("n").isNull() | enough).drop("n").join(sizes, "host").where(enough)
    lists = some.groupBy("host").agg(F.max("n").alias("n"), F.collect_list(F.struct(*Row._fields)).alias("rows"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = [deduce([Row(*(r[f] for f in Row._fields)) for r in rows], n).packed() for n, rows in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], ["host", "template"])

    return map_batches(lists, run, "host long, template binary")


def main_text(pages: DataFrame, broadcast: int = BROADCAST, crowd: int = CROWD) -> DataFrame:
    """Main text of every page: page_id, url, text, n_chars.

    A host's template comes from all its pages, as sums by token: no task holds a host. Templates
    of ``broadcast`` bytes in all go to every task; beyond that, pages meet them in a join by host,
    in which hosts of ``crowd`` pages and more are split. A null or empty page has an empty text; a
    null url is a host of its own; a page that doesn't fit its host's template is read by its own
    elements; repeated rows each give a row; an empty table gives none; other columns are not read.
    """
    url = F.coalesce(pages["url"].cast("string"), F.lit(""))
    host = F.xxhash64(F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)))
    rows = pages.select(host.alias("host"), pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), F.coalesce(pages["html"].cast("string"), F.lit("")).alias("html"))
    sizes = rows.groupBy("host").agg(F.count("*").alias("n"))
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    large = sizes.where(F.col("n") > total / SHARE)  # fewer than SHARE rows
    made = cut(templates(rows, sizes, large))
    volume = made.agg(F.coalesce(F.sum(F.octet_length("template") + 16), F.lit(0))).first()[0]
    if volume <= broadcast:
        joined = rows.join(F.broadcast(made), "host", "left")
    else:
        split = large.where(F.col("n") >= crowd).select("host", (F.col("n") / crowd).cast("int").alias("parts"))
        parts = F.coalesce("parts", F.lit(1))
        spread = made.join(F.broadcast(split), "host", "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
        dealt = rows.join(F.broadcast(split), "host", "left").withColumn("part", F.pmod(F.xxhash64("page_id", "url"), parts).cast("int")).drop("parts")
        joined = dealt.join(spread, ["host", "part"], "left")
    joined = joined.select("page_id", "url", "html", "template")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        known: dict[bytes, Template] = {}
        texts = []
        for page, packed in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            if packed is not None and packed not in known:
                known[packed] = unpacked(packed)
            texts.append(article(tokens(page), known.get(packed)))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return map_batches(joined, run, SCHEMA)
