"""Main text of pages: templates against their definition, pages without telling names, ablation, and odd rows."""

import random
import re

import pytest

from noema.llm import html_text

PAGES = "page_id long, url string, html string, text string, host long, template binary"
RNG = random.Random(11)


def prose(n: int) -> str:
    return " ".join(RNG.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) + str(RNG.randrange(99)) for _ in range(n))


def site(n: int, plain: bool = False) -> tuple[list[str], list[str]]:
    """Pages of one host, and their main texts."""
    pages, texts = [], []
    for k in range(n):
        title, parts = prose(6), [prose(RNG.randrange(20, 60)) for _ in range(RNG.randrange(2, 6))]
        page = f"""<html><head><title>{title}</title></head><body><nav><ul>{"".join(f'<li><a href="/{x}">{x}</a>' for x in prose(5).split())}</ul></nav>
        <div class="ad">{prose(4)}</div><article><h1>{title}</h1><div class="share">Tell a friend</div>{"".join(f"<p>{p}" for p in parts)}</article>
        <section id="s{k}"><h2>Readers say</h2><div class="one">{prose(5)}</div></section><footer>&copy; me {prose(3)}</footer></body></html>"""
        if plain:
            for number, name in enumerate(("nav", "article", "footer", "section")):
                page = re.sub(rf"<{name}[^>]*>", f'<div class="x{"abcd"[number]}">', page).replace(f"</{name}>", "</div>")
            page = page.replace('class="ad"', 'class="q"').replace('class="share"', 'class="r"').replace('class="one"', 'class="t"')
        pages.append(page)
        texts.append("\n".join([title, *parts]))
    return pages, texts


def table(spark, pages, first=0, url="http://h.example/"):
    return spark.createDataFrame([(k, f"{url}{k}", p, "x", 1, None) for k, p in enumerate(pages, first)], PAGES).repartition(3)


def by_id(df):
    return {r["page_id"]: r["text"] for r in df.collect()}


@pytest.mark.parametrize("plain", [False, True])
@pytest.mark.parametrize("split", [False, True])
def test_articles_of_a_host(spark, plain, split):
    pages, texts = site(40, plain)
    more = {"broadcast": 0, "crowd": 7} if split else {}
    assert by_id(html_text.main_text(table(spark, pages), **more)) == dict(enumerate(texts))


def test_template_as_by_definition(spark):
    pages, _ = site(15, plain=True)
    df = table(spark, pages + pages[:3]).selectExpr("7L AS host", "html")
    sizes = df.groupBy("host").count().withColumnRenamed("count", "n")
    got = html_text.unpacked(html_text.templates(df, sizes, sizes).first()["template"])
    want = html_text.brute_force(pages + pages[:3])
    assert got == want and len(want.outer) > 8 and len(want.slots) == 1 and want.fixed


def test_without_its_template_a_page_is_read_otherwise(spark, monkeypatch):
    pages, texts = site(12, plain=True)
    monkeypatch.setattr(html_text, "deduce", lambda rows, n: html_text.Template({}, frozenset(), frozenset(), frozenset(), False))
    assert all(html_text.article(html_text.tokens(p), None) == "" for p in pages)
    monkeypatch.undo()
    template = html_text.brute_force(pages)
    assert [html_text.article(html_text.tokens(p), template) for p in pages] == texts
    # what all pages share is known from the others only
    assert all("Tell a friend" in html_text.article(html_text.tokens(p), None) for p in pages)


def test_wrapper_with_a_telling_word(spark):
    page = '<body><div class="layout has-sidebar"><div id="page" class="sidebar"><div class="main-col"><h1>Head</h1><p>{0}</p></div></div><div class="sidebar"><a href="/">on</a></div></div></body>'
    pages = [page.format(prose(30)) for _ in range(5)]
    got = by_id(html_text.main_text(table(spark, pages)))
    assert all(t.startswith("Head\n") or t.count(" ") == 29 for t in got.values()) and "on" not in got[0].split()


def test_near_copies_keep_what_they_share(spark):
    body, _ = site(1)
    pages = [body[0].replace("</article>", f"<p>{k} own</article>") for k in range(30)]
    got = by_id(html_text.main_text(table(spark, pages)))
    first = html_text.article(html_text.tokens(body[0]), None)
    assert all(got[k] == f"{first}\n{k} own" for k in range(30))


def test_hosts_of_any_number_of_pages(spark):
    parts = [(n, *site(n)) for n in (1, 2, 3, 5, 130)]
    frame, want = None, {}
    for n, pages, texts in parts:
        one = table(spark, pages, 1000 * n, f"http://h{n}.example/")
        frame = one if frame is None else frame.unionAll(one)
        want |= {1000 * n + k: t for k, t in enumerate(texts) if n > 3}
    got = by_id(html_text.main_text(frame))
    assert len(got) == 141 and {k: got[k] for k in want} == want
    assert "alpha" not in got[1000].split("\n")[0] or got[1000].startswith(parts[0][2][0].split("\n")[0])


def test_odd_rows(spark):
    deep, wide = "<div>" * 3000 + "deep" + "</div>" * 3000, "<p>" + "word " * 400_000
    rows = [(1, None, None), (2, "x", ""), (3, "http://o.example/", "<p>a < b<p>c<form>no</form>"), (3, "http://o.example/", "<p>a < b<p>c<form>no</form>"), (4, "y", deep), (5, "z", wide), (None, "u", "&lt;i&gt; \n &amp;"), (6, "w", "<" * 5000)]
    df = spark.createDataFrame([(*r, "x", 1, None) for r in rows], PAGES)
    got = html_text.main_text(df).collect()
    texts = sorted((r["page_id"] or 0, r["text"], r["n_chars"]) for r in got)
    assert [t[:2] for t in texts if t[0] not in (5, 6)] == [(0, "<i> &"), (1, ""), (2, ""), (3, "a < b\nc"), (3, "a < b\nc"), (4, "deep")]
    assert all(n == len(t) for _, t, n in texts) and texts[-2][1].count("word") == 400_000
    assert html_text.main_text(df.limit(0)).count() == 0
