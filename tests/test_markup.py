"""Markup on small texts."""

from noema.functions import markup
from pyspark.sql import functions as F

ISSUE = "h3. Plan\r\nbq. said once\n*all _done_ now* at {{a*b*c}}, by [~ann] in {color:red}red{color} !pic.png|thumb!\nsee [AB-12], [name | CD-3], [http://h/a_b_c], [[note:x]] and x[y z]\n* one\n** two\n## num\n||a||b||\n|1| 2 |\n{code:title=T|java}\nif (a*b*c) {}\n{code}\n{panel:title=Mind|x=y}\nhold *on*\n{panel}\n{tip}\ngo\n{tip}\nlog~b~(n) of 3^k^, -gone- +new+ snake_case_name 1-2-3 {code unclosed"
WANT = "### Plan\n> said once\n**all *done* now** at `a*b*c`, by @ann in red ![pic.png](pic.png)\nsee [AB-12](http://w/browse/AB-12), [name](http://w/browse/CD-3), [http://h/a_b_c](http://h/a_b_c), [[note:x]] and x[y z]\n- one\n  - two\n  1. num\n| a | b |\n| --- | --- |\n| 1 | 2 |\n\n```\nif (a*b*c) {}\n```\n\n> **Mind**\n> hold **on**\n\n> **TIPP:**\n> go\n\nlog<sub>b</sub>(n) of 3<sup>k</sup>, ~~gone~~ <u>new</u> snake_case_name 1-2-3 {code unclosed"


def test_issue_markup(spark):
    df = spark.createDataFrame([(ISSUE,), (None,), ("",), ("{noformat}[EF-4]{noformat} *",)], "t string")
    got = df.select(markup.issue_markdown(F.col("t"), "http://w/").alias("m"), markup.issue_links(F.col("t"), "jj").alias("l")).collect()
    assert got[0]["m"] == WANT
    assert got[0]["l"] == ["jj:AB-12", "jj:CD-3"]
    assert got[1]["m"] is None and got[2]["m"] == "" and got[1]["l"] == []
    assert got[3]["m"] == "```\n[EF-4]\n```\n *" and got[3]["l"] == []


def test_issue_keys():
    assert all(map(markup.is_issue_key, ("AB-1", "A_9-20", "ABCDEFGHIJKLMNOP-1")))
    assert not any(map(markup.is_issue_key, ("", "A-1", "ab-1", "AB-", "AB-1x", "1A-2", "AB", "-1", "ABCDEFGHIJKLMNOPQ-1")))


def test_storage_markup(spark):
    text = '<h1>T</h1><p>a&nbsp; <strong>b</strong></p><script>x</script><ul><li>p<ul><li>q</li></ul></li><li>r</li></ul><table><tr><th>h|</th></tr><tr><td>c</td></tr></table><ac:structured-macro ac:name="code"><ac:parameter ac:name="language">sql</ac:parameter><ac:plain-text-body><![CDATA[SELECT  1]]></ac:plain-text-body></ac:structured-macro><ac:structured-macro ac:name="tip"><p>go</p></ac:structured-macro><p><a href="http://x">l</a>'
    want = "# T\n\na **b**\n\n- p\n  - q\n- r\n\n| h\\| |\n| --- |\n| c |\n\n```sql\nSELECT  1\n```\n\n> **TIPP:**\n> go\n\n[l](http://x)"
    deep = "<div>" * 5000 + "<ul><li>x</li></ul>" + "</div>" * 5000
    df = spark.createDataFrame([(text,), (None,), (deep,)], "t string")
    assert [r[0] for r in df.select(markup.storage_markdown("t")).collect()] == [want, "", "- x"]


def test_links_of_pages(spark):
    text = '<p><a href="/x/AQ">s</a><ac:link><ri:page ri:space-key="E" ri:content-title="A b"/></ac:link><ac:link><ri:page ri:content-title="C"/></ac:link><a href="/x/AQ">again</a></p>'
    df = spark.createDataFrame([(text,), (None,)], "t string")
    got = [[tuple(x) for x in r[0]] for r in df.select(markup.storage_links("t")).collect()]
    assert got == [[("/x/AQ", None, None), (None, "E", "A b"), (None, None, "C")], []]


def test_pages_of_links(spark):
    hrefs = {
        "http://w/pages/viewpage.action?pageId=12": ("12", None, None),
        "http://w/spaces/E/pages/34/T": ("34", None, None),
        "http://w/x/AQ": ("1", None, None),
        "http://w/display/ENG/Two+words%21?pageId=9": (None, "ENG", "Two words!"),
        "http://w/y?a=1&pageId=56": ("56", None, None),
        "http://w/x.html": (None, None, None),
    }
    df = spark.createDataFrame([(h,) for h in hrefs], "h string")
    parts = markup.link_parts(F.col("h"))
    assert {r["h"]: (r["page"], r["space"], r["title"]) for r in df.select("h", *(v.alias(k) for k, v in parts.items())).collect()} == hrefs
    rows = spark.createDataFrame([("/a", None), ("b", None), ("http://o/", None), ("mailto:x@y", None), ("/x/AQ", "1")], "h string, p string")
    made = markup.link_target(F.col("h"), F.col("p"), "wiki", "http://w/")
    assert [(r["url"], r["target"]) for r in rows.select(*(v.alias(k) for k, v in made.items())).collect()] == [("http://w/a", None), ("http://w/b", None), ("http://o/", None), ("mailto:x@y", None), ("http://w/pages/viewpage.action?pageId=1", "wiki:1")]
