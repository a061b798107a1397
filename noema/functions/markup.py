"""Markup of wiki pages and issues as Markdown, and the links in both."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StringType, StructType

from noema.functions.scalars import tiny_link_id

#: Labels of notes.
NOTES = {"info": "INFO", "tip": "TIPP", "note": "HINWEIS", "warning": "ACHTUNG"}
#: What an issue's marks become (before, after), which marks may not touch a word from outside, and what encloses code and quotes.
PHRASES = {"*": ("**", "**"), "_": ("*", "*"), "-": ("~~", "~~"), "+": ("<u>", "</u>"), "^": ("<sup>", "</sup>"), "~": ("<sub>", "</sub>")}
BETWEEN_WORDS = "*_-+"
CODE, QUOTES = ("code", "noformat"), ("quote", "panel", *NOTES)
MARKS = {"strong": "**", "b": "**", "em": "*", "i": "*", "code": "`", "s": "~~", "del": "~~", "strike": "~~"}
TAGGED = ("u", "sup", "sub")
IMAGES = (".png", ".jpg", ".jpeg", ".gif", ".svg", ".webp")


def is_issue_key(text: str) -> bool:
    """Whether a text names an issue: a project of 2 to 16 capitals, digits or underscores that begins with a capital, a hyphen, a number."""
    project, hyphen, number = text.partition("-")
    plain = all("A" <= c <= "Z" or c == "_" or "0" <= c <= "9" for c in project)
    return bool(hyphen) and 2 <= len(project) <= 16 and plain and "A" <= project[0] <= "Z" and number.isascii() and number.isdigit()


class _Issue:
    """A reader of one issue's markup: what comes first in a line is read first, and what it encloses by the same rules."""

    def __init__(self, web: str):
        self.web, self.keys = web.rstrip("/"), []

    def link(self, text: str, target: str) -> str:
        if is_issue_key(target):
            if target not in self.keys:
                self.keys.append(target)
            return f"[{text}]({self.web}/browse/{target})"
        return f"[{text}]({target})"

    def bracket(self, line: str, at: int) -> tuple[str, int] | None:
        """A mention or a link that begins at a bracket, and where it ends; double brackets are references and stay."""
        end = line.find("]", at)
        if end < 0 or line[at - 1 : at] == "[" or line[at + 1 : at + 2] == "[":
            return None
        text, bar, target = line[at + 1 : end].partition("|")
        if text.startswith("~") and len(text) > 1 and not bar:
            return "@" + text[1:], end + 1
        if bar:
            text, target = text.strip(), target.strip()
            return (self.link(self.inline(text) or target, target), end + 1) if target else None
        follows = line[end + 1 : end + 2]
        if not text or any(c.isspace() for c in text) or follows in ("(", "]") and follows:
            return None
        return self.link(text, text), end + 1

    def phrase(self, line: str, at: int) -> tuple[str, int] | None:
        """What two equal marks enclose, and where it ends."""
        mark = line[at]
        end = line.find(mark, at + 1)
        before, after = line[at - 1 : at] if at else "", line[end + 1 : end + 2]
        bound = lambda c: c == mark or mark in BETWEEN_WORDS and (c.isalnum() or c == "_")
        if end < at + 2 or bound(before) or bound(after):
            return None
        return PHRASES[mark][0] + self.inline(line[at + 1 : end]) + PHRASES[mark][1], end + 1

    def inline(self, line: str) -> str:
        out, at = [], 0
        while at < len(line):
            found, char = None, line[at]
            if char == "{":
                end = line.find("}}", at + 2) if line.startswith("{{", at) else -1
                if end > at + 2:
                    found = f"`{line[at + 2 : end]}`", end + 2
                elif line[at : at + 7].lower() == "{color:" and 0 < (inner := line.find("}", at)) < (end := line.lower().find("{color}", at)):
                    found = self.inline(line[inner + 1 : end]), end + 7
            elif char == "[":
                found = self.bracket(line, at)
            elif char == "!":
                end = line.find("!", at + 1)
                name = line[at + 1 : end].partition("|")[0]
                if end > at and name and not any(c.isspace() for c in name):
                    found = f"![{name}]({name})", end + 1
            elif char in PHRASES:
                found = self.phrase(line, at)
            text, at = found or (char, at + 1)
            out.append(text)
        return "".join(out)

    def line(self, line: str) -> str:
        """A heading, quote, row or item, or a plain line."""
        bare = line.strip()
        if line[:1] == "h" and line[1:2] in set("123456") and line[2:3] == ".":
            return self.inline(f"{'#' * int(line[1])} {line[3:].lstrip()}")
        if line.startswith("bq."):
            return self.inline("> " + line[3:].lstrip())
        if len(bare) > 2 and bare[0] == bare[-1] == "|":
            top = bare.startswith("||") and bare.endswith("||") and len(bare) > 4
            cells = [c.strip() for c in (bare[2:-2].split("||") if top else bare.strip("|").split("|"))]
            row = "| " + " | ".join(map(self.inline, cells)) + " |"
            return row + ("\n| " + " | ".join(["---"] * len(cells)) + " |" if top else "")
        marks = line[: len(line) - len(line.lstrip("*#-"))]
        if marks and line[len(marks) : len(marks) + 1].isspace():
            return "  " * (len(marks) - 1) + ("1. " if marks[-1] == "#" else "- ") + self.inline(line[len(marks) :].strip())
        return self.inline(line)

    def macro(self, line: str) -> tuple[str, str] | None:
        """Name and parameters of a line that is one tag of a quote."""
        bare = line.strip()
        name, _, given = bare[1:-1].partition(":")
        return (name.lower(), given) if bare[:1] == "{" and bare[-1:] == "}" and line[:1] == "{" and name.lower() in QUOTES else None

    def text(self, text: str) -> str:
        text, fences, low = text.replace("\r\n", "\n"), [], None
        out, at = [], 0
        low = text.lower()
        while (begin := min((p for n in CODE if (p := low.find("{" + n, at)) >= 0), default=-1)) >= 0:
            name = next(n for n in CODE if low.startswith("{" + n, begin))
            edge = low.find("}", begin)
            end = low.find("{" + name + "}", edge + 1)
            if edge < 0 or end < 0 or low[begin + 1 + len(name)] not in ":}":
                out.append(text[at : begin + 1])
                at = begin + 1
                continue
            language = text[begin + 1 + len(name) : edge].lstrip(":").partition("|")[0].strip()
            body = text[edge + 1 : end].strip("\n")
            fences.append(f"\n```{'' if '=' in language else language}\n{body}\n```\n")
            out.append(text[at:begin] + "\0")
            at = end + len(name) + 2
        lines, inside = [], None
        for line in ("".join(out) + text[at:]).split("\n"):
            tag = self.macro(line)
            if tag and inside is None:
                inside, given = tag
                lines.append("")
                title = next((v.strip() for k, _, v in (p.partition("=") for p in given.split("|")) if k.strip().lower() == "title"), "")
                label = f"{NOTES[inside]}:" if inside in NOTES else title if inside == "panel" else ""
                lines += [f"> **{label}**"] if label else []
            elif tag and tag == (inside, ""):
                inside = None
                lines.append("")
            else:
                made = line if "\0" in line else self.line(line)
                lines.append(made if inside is None else f"> {made}".rstrip())
        parts = "\n".join(lines).split("\0")
        whole = parts[0] + "".join(f + p for f, p in zip(fences, parts[1:], strict=False))
        return re.sub(r"\n{3,}", "\n\n", whole).strip()


def _by_row(kind: DataType):
    """A function of single values. They travel a hundred rows at a time, where an Arrow batch would hold the texts of ten thousand, several times over."""
    return F.udf(returnType=kind, useArrow=False)


def issue_markdown(text: Column, web: str) -> Column:
    """Issue markup as Markdown; null for null. Code is read first, so no rule touches it; keys of issues in links point at ``web``. Marks nest, which is beyond column expressions."""

    @_by_row(StringType())
    def convert(value: str | None) -> str | None:
        return None if value is None else _Issue(web).text(value)

    return convert(text)


def issue_links(text: Column, prefix: str) -> Column:
    """Ids of the issues that links name, each once, code aside: array of ``prefix:KEY``."""

    @_by_row(ArrayType(StringType()))
    def named(value: str | None) -> list[str]:
        reader = _Issue("")
        reader.text(value or "")
        return [f"{prefix}:{k}" for k in reader.keys]

    return named(text)


class _Tree(HTMLParser):
    """Markup as nested nodes [tag, attributes, children]; what isn't closed ends with its parent."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root: list = ["", {}, []]
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        node = [tag, {k: v or "" for k, v in attrs}, []]
        self.open[-1][2].append(node)
        if tag not in ("br", "hr", "img", "col"):
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.open[-1][2].append([tag, {k: v or "" for k, v in attrs}, []])

    def handle_endtag(self, tag):
        if any(n[0] == tag for n in self.open[1:]):
            while self.open.pop()[0] != tag:
                pass

    def handle_data(self, data):
        self.open[-1][2].append(data)

    def unknown_decl(self, data):
        if data.startswith("CDATA["):
            self.open[-1][2].append(["cdata", {}, [data[6:]]])


def _raw(node) -> str:
    """All text inside, whatever the nesting."""
    out, todo = [], [node]
    while todo:
        node = todo.pop()
        if isinstance(node, str):
            out.append(node)
        else:
            todo += reversed(node[2])
    return "".join(out)


def _named(node, tag: str) -> Iterator[list]:
    """Elements of a name inside of another, not inside of nested ones of the outer name."""
    todo = list(reversed(node[2]))
    while todo:
        child = todo.pop()
        if not isinstance(child, str):
            if child[0] == tag:
                yield child
            elif child[0] != node[0]:
                todo += reversed(child[2])


def _quote(text: str, label: str = "") -> str:
    body = text.strip()
    return "\n\n" + "\n".join(f"> {x}".rstrip() for x in ([label] if label else []) + body.split("\n")) + "\n\n" if body else ""


class _Done(NamedTuple):
    """Texts of elements by identity, made from the innermost outwards."""

    texts: dict[int, str]

    def inside(self, nodes) -> str:
        return "".join(re.sub(r"[ \t\xa0\n]+", " ", n) if isinstance(n, str) else self.texts[id(n)] for n in nodes)


def _rendered(root) -> str:
    """The text of a tree of any depth, with a stack of its own."""
    order, todo = [], [(root, 0)]
    while todo:
        node, depth = todo.pop()
        order.append((node, depth))
        inner = depth + 1 if node[0] == "li" else 0 if node[0] in ("td", "th") else depth
        todo += [(c, inner) for c in node[2] if not isinstance(c, str)]
    done = _Done({})
    for node, depth in reversed(order):
        done.texts[id(node)] = _render(node, depth, done)
    return done.texts[id(root)]


def _render(node, depth: int, done: _Done) -> str:
    tag, attrs, children = node
    if tag in ("script", "style", "ac:parameter"):
        return ""
    if tag in MARKS:
        return MARKS[tag] + done.inside(children) + MARKS[tag]
    if tag in TAGGED:
        return f"<{tag}>{done.inside(children)}</{tag}>"
    if tag == "br":
        return "\n"
    if tag == "hr":
        return "\n\n---\n\n"
    if re.fullmatch("h[1-6]", tag):
        return f"\n\n{'#' * int(tag[1])} {done.inside(children).strip()}\n\n"
    if tag == "pre":
        return f"\n\n```\n{_raw(node)}\n```\n\n"
    if tag in ("ul", "ol"):
        items = [c for c in children if not isinstance(c, str) and c[0] == "li"]
        made = [f"{'  ' * depth}{f'{k}.' if tag == 'ol' else '-'} {done.inside(i[2]).strip()}" for k, i in enumerate(items, 1)]
        return "\n" * (1 if depth else 2) + re.sub(r"\n{2,}", "\n", "\n".join(made)) + ("" if depth else "\n\n")
    if tag == "blockquote":
        return _quote(done.inside(children))
    if tag == "table":
        rows = [[done.inside(c[2]).strip().replace("\n", " ").replace("|", "\\|") for c in r[2] if not isinstance(c, str) and c[0] in ("td", "th")] for r in _named(node, "tr")]
        rows = [r for r in rows if r]
        wide = max(map(len, rows), default=0)
        made = ["| " + " | ".join(r + [""] * (wide - len(r))) + " |" for r in rows]
        return "\n\n" + "\n".join(made[:1] + ["| " + " | ".join(["---"] * wide) + " |"] + made[1:]) + "\n\n" if rows else ""
    if tag == "ac:structured-macro":
        name, given = attrs.get("ac:name", ""), {c[1].get("ac:name"): _raw(c).strip() for c in children if not isinstance(c, str) and c[0] == "ac:parameter"}
        if name in ("code", "noformat"):
            text = "".join(_raw(c) for c in children if isinstance(c, str) or c[0] != "ac:parameter").strip("\n")
            return f"\n\n```{given.get('language', '')}\n{text}\n```\n\n"
        label = f"**{NOTES[name]}:**" if name in NOTES else f"**{given['title']}**" if name == "panel" and given.get("title") else ""
        return _quote(done.inside(children), label) if name in NOTES or name == "panel" else done.inside(children)
    if tag == "ri:attachment":
        name = attrs.get("ri:filename", "")
        return f"![{name}]({name})" if name.lower().endswith(IMAGES) else f"📎 [{name}]({name})" if name else ""
    if tag == "ri:url":
        return f"![]({attrs['ri:value']})" if attrs.get("ri:value") else ""
    if tag == "ri:user":
        return "@" + attrs.get("ri:userkey", attrs.get("ri:account-id", ""))
    if tag == "ac:link":
        page, file = next(_named(node, "ri:page"), None), next(_named(node, "ri:attachment"), None)
        text = done.inside([c for c in children if isinstance(c, str) or not c[0].startswith("ri:")]).strip()
        if file:
            return f"📎 [{text or file[1].get('ri:filename', '')}]({file[1].get('ri:filename', '')})"
        return text or (page[1].get("ri:content-title", "") if page else "") or done.inside(children)
    if tag == "a":
        text, href = done.inside(children).strip(), attrs.get("href", "")
        return f"[{text or href}]({href})" if href else text
    if tag == "cdata":
        return _raw(node)
    if tag in ("p", "div", "tr"):
        return f"\n\n{done.inside(children)}\n\n"
    return done.inside(children)


def storage_text(value: str | None) -> str:
    """Wiki markup of one page as Markdown; links to pages by title keep their text."""
    tree = _Tree()
    tree.feed(value or "")
    tree.close()
    out, fenced = [], False
    for line in _rendered(tree.root).split("\n"):
        edge = line.lstrip().startswith("```")
        lead = line[: len(line) - len(line.lstrip(" "))]
        out.append(line.rstrip() if edge or fenced or lead and re.match(r" +([-] |\d+\.)", line) else line.strip())
        fenced ^= edge
    return re.sub(r"\n{3,}", "\n\n", "\n".join(out)).strip()


@_by_row(StringType())
def storage_markdown(value: str | None) -> str:
    """Wiki markup as Markdown; the nesting of elements is beyond column expressions. Null becomes empty."""
    return storage_text(value)


class PageLink(NamedTuple):
    """A link to a page: its address, or its space and title."""

    href: str | None
    space: str | None
    title: str | None


def links_of_storage(value: str | None) -> list[PageLink]:
    """Links of one page's markup to others, each once, in order."""
    tree = _Tree()
    tree.feed(value or "")
    tree.close()
    found, todo = [], [tree.root]
    while todo:
        node = todo.pop()
        if isinstance(node, str) or node[0] in ("script", "style"):
            continue
        if node[0] == "a" and node[1].get("href"):
            found.append(PageLink(node[1]["href"], None, None))
        elif node[0] == "ri:page" and node[1].get("ri:content-title"):
            found.append(PageLink(None, node[1].get("ri:space-key"), node[1]["ri:content-title"]))
        todo += reversed(node[2])
    return list(dict.fromkeys(found))


@_by_row(ArrayType(StructType().add("href", StringType()).add("space", StringType()).add("title", StringType())))
def storage_links(value: str | None) -> list[PageLink]:
    """Links of wiki markup: array of href, space, title; empty for null."""
    return links_of_storage(value)


def link_parts(href: Column) -> dict[str, Column]:
    """What an address names, by the strongest sign: ``page`` (viewpage, pages of a space, short link), else ``space`` and ``title`` (display), else the page of the query."""
    part = lambda pattern, group=1: F.nullif(F.regexp_extract(href, pattern, group), F.lit(""))
    short = part(r"^[^?#]*/x/([A-Za-z0-9_-]+)/?(?:[?#]|$)")
    strong = F.coalesce(part(r"viewpage\.action\?(?:.*&)?pageId=(\d+)"), part(r"^[^?#]*/spaces/[^/?#]+/pages/(\d+)"), F.when(short.isNotNull(), tiny_link_id(short).cast("string")))
    display = r"^[^?#]*/display/([^/?#]+)/([^/?#]+)"
    shown = strong.isNull() & part(display).isNotNull()
    plain = lambda text: F.try_url_decode(text)
    page = F.coalesce(strong, F.when(~shown, part(r"[?&]pageId=(\d+)")))
    return {"page": page, "space": F.when(shown, plain(part(display))), "title": F.when(shown, plain(part(display, 2)))}


def page_of_link(href: Column) -> Column:
    """The page id that an address names; null if there is none."""
    return link_parts(href)["page"]


def link_target(href: Column, page: Column, prefix: str, web: str) -> dict[str, Column]:
    """The address of a link and the concept that it names: a known page gets its canonical address, any other link an absolute one."""
    root = web.rstrip("/")
    away = href.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:")
    url = F.when(page.isNotNull(), F.concat(F.lit(root + "/pages/viewpage.action?pageId="), page)).when(away, href).otherwise(F.concat(F.lit(root), F.when(href.startswith("/"), href).otherwise(F.concat(F.lit("/"), href))))
    return {"url": url, "target": F.when(page.isNotNull(), F.concat(F.lit(prefix + ":"), page))}
