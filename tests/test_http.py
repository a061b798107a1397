"""The HTTP source against a local server that throttles, fails and pages."""

import json
import re
import threading
from collections import Counter
from datetime import datetime
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.sql import functions as F

from noema.sources import http, readers


def page(k, space, when):
    return {"id": str(k), "title": f"T{k}", "space": {"key": space}, "version": {"when": when}, "body": {"storage": {"value": f"<p>text {k}</p>"}}, "metadata": {"labels": {"results": [{"name": "x"}]}}, "links": {"webui": f"/p/{k}"}}


def issue(k, project, when):
    return {"key": f"{project}-{k}", "fields": {"summary": f"S{k}", "description": "h2. Head", "updated": when, "project": {"key": project}, "labels": []}}


class Server:
    """Pages (or issues) behind a query of a few conditions; the first answers of each request fail by turns."""

    def __init__(self, items, rows, total, fail=()):
        self.items, self.seen, self.fails, outer = items, [], Counter(), self

        class Handler(BaseHTTPRequestHandler):
            def log_message(self, *args):
                pass

            def do_GET(self):
                asked = {k: v[0] for k, v in parse_qs(urlparse(self.path).query).items()}
                outer.seen.append(asked)
                turn = outer.fails[self.path]
                outer.fails[self.path] += 1
                if turn < len(fail):
                    self.send_response(fail[turn])
                    if fail[turn] == 429:
                        self.send_header("Retry-After", "0.01")
                    self.end_headers()
                    return
                found = outer.matching(asked.get("cql") or asked.get("jql") or "")
                start, limit = int(asked.get("start") or asked.get("startAt") or 0), int(asked.get("limit") or asked.get("maxResults"))
                body = json.dumps({rows: found[start : start + limit]} | ({total: len(found)} if total else {})).encode()
                self.send_response(200)
                self.end_headers()
                self.wfile.write(body)

        self.server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        self.url = f"http://127.0.0.1:{self.server.server_port}"
        threading.Thread(target=self.server.serve_forever, daemon=True).start()

    def matching(self, query):
        when = lambda x: x.get("version", x.get("fields", {})).get("when") or x["fields"]["updated"]
        space = lambda x: (x.get("space") or x["fields"]["project"])["key"]
        out = self.items
        for sign, value in re.findall(r'(?:space|project) (=) "([^"]+)"', query):
            out = [x for x in out if space(x) == value]
        for sign, value in re.findall(r'(?:lastmodified|updated) (>=|<) "([^"]+)"', query):
            out = [x for x in out if (when(x)[:16].replace("T", " ") >= value) == (sign == ">=")]
        return sorted(out, key=when, reverse=True) if query.endswith("desc") else out


@pytest.fixture
def source(spark):
    spark.dataSource.register(http.PagedSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return lambda url, **more: spark.read.format("noema_http").options(url=url, pageSize=5, pagesPerTask=2, backoff=0.01, **more)


PAGES = [page(k, "ENG" if k % 3 else "OPS", f"2026-01-{1 + k % 28:02}T10:00:30.000Z") for k in range(53)]


def test_pages_by_ranges_with_failures(source):
    server = Server(PAGES, "results", "totalSize", (429, 503))
    df = source(server.url, api="wiki").load()
    assert df.rdd.getNumPartitions() == 6
    rows = df.collect()
    assert sorted(int(r["id"]) for r in rows) == list(range(53)) and json.loads(rows[0]["value"])["id"] == rows[0]["id"]
    assert min(server.fails.values()) >= 3  # every request was refused twice


def test_filters_go_to_the_server(source):
    server = Server(PAGES, "results", "totalSize")
    got = source(server.url, api="wiki", since="2026-01-05").load().where((F.col("space") == "OPS") & (F.col("updated_at") >= F.lit(datetime(2026, 1, 20, 10, 0, 31)))).collect()
    want = [p["id"] for p in PAGES if p["space"]["key"] == "OPS" and p["version"]["when"] >= "2026-01-21"]
    assert sorted(r["id"] for r in got) == sorted(want)
    assert server.seen[-1]["cql"] == 'lastmodified >= "2026-01-05 00:00" and space = "OPS" and lastmodified >= "2026-01-20 10:00"'


def test_issues_without_a_total_and_documents(spark, source):
    server = Server([issue(k, "AB", "2026-02-01T00:00:00.000+0100") for k in range(12)], "issues", None)
    df = source(server.url, api="issues", query='status = "Open"', space='A"B').load()
    assert df.rdd.getNumPartitions() == 1 and server.seen[-1]["jql"] == '(status = "Open") and project = "A\\"B"'
    server = Server([issue(k, "AB", "2026-02-01T00:00:00.000+01:00") for k in range(12)], "issues", "total")
    docs = readers.issue_documents(readers.parsed(source(server.url, api="issues").load(), readers.ISSUE)).collect()
    assert sorted(d["external_id"] for d in docs)[:2] == ["AB-0", "AB-1"] and docs[0]["body"] == "## Head" and docs[0]["updated_at"] == datetime(2026, 1, 31, 23)
    wiki = Server(PAGES, "results", "totalSize")
    docs = {d["external_id"]: d for d in readers.wiki_documents(readers.parsed(source(wiki.url).load(), readers.PAGE), web="http://w").collect()}
    assert len(docs) == 53 and (docs["7"]["title"], docs["7"]["body"], docs["7"]["tags"], docs["7"]["url"]) == ("T7", "text 7", ["x"], "http://w/p/7")


def test_refusals_that_do_not_end(source):
    for code in (404, 500):
        server = Server(PAGES, "results", "totalSize", (code,) * 9)
        with pytest.raises(Exception, match=str(code)):
            source(server.url, retries=1).load().collect()
        assert len(server.seen) <= 2 if code == 404 else len(server.seen) >= 2


def test_nothing_to_read(source):
    assert source(Server([], "results", "totalSize").url).load().collect() == []


def test_a_streams_offset_is_the_cursor(spark, source, tmp_path):
    server = Server(PAGES[:30], "results", "totalSize")
    rows = []

    def run():
        stream = spark.readStream.format("noema_http").options(url=server.url, pageSize=5, backoff=0.01).load()
        stream.writeStream.foreachBatch(lambda df, _: rows.extend(r["id"] for r in df.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(120)

    run()
    assert sorted(map(int, rows)) == list(range(30))
    rows.clear()
    run()
    assert rows == []
    server.items = PAGES[:30] + [page(99, "ENG", "2026-03-01T00:00:00Z")]
    run()
    # to the minute, the last minute comes again with what is new
    assert set(rows) == {"99"} | {p["id"] for p in PAGES[:30] if p["version"]["when"] == max(x["version"]["when"] for x in PAGES[:30])}
