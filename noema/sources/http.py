"""Wikis and issue trackers over HTTP as a Spark data source: page ranges are partitions, filters go to the server, and a stream's offset is the cursor.

    spark.dataSource.register(PagedSource)
    spark.read.format("noema_http").options(url=..., api="wiki", space="ENG", since="2026-01-01").load()

Rows: id, space (of issues: the project), updated_at, value (the object as JSON). An answer of 429 or
5xx, or none, is asked for again after a pause that doubles, or as long as ``Retry-After`` says. What
moves between pages while they are read may come twice, so take one row an id.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition

SCHEMA = "id string, space string, updated_at timestamp, value string"
#: Answers that are asked for again, and how long at most to wait in between.
AGAIN, LONGEST = (429, 500, 502, 503, 504), 30.0


@dataclass(frozen=True)
class Api:
    """How a kind of server pages, and where its answers have what a row needs."""

    path: str
    start: str
    limit: str
    totals: tuple[str, ...]
    rows: str
    query: str
    space: str
    changed: str
    expand: str = ""

    def row(self, item: dict) -> tuple[str, str | None, datetime | None, str]:
        if self.query == "cql":
            key, space, when = item.get("id"), (item.get("space") or {}).get("key"), (item.get("version") or {}).get("when")
        else:
            fields = item.get("fields") or {}
            key, space, when = item.get("key"), (fields.get("project") or {}).get("key"), fields.get("updated")
        return str(key), space, parsed(when), json.dumps(item, ensure_ascii=False)


#: Names that the two kinds of servers use.
APIS = {
    "wiki": Api("/rest/api/content/search", "start", "limit", ("totalSize", "size"), "results", "cql", "space", "lastmodified", "body.storage,version,space,metadata.labels"),
    "issues": Api("/rest/api/2/search", "startAt", "maxResults", ("total",), "issues", "jql", "project", "updated"),
}


def parsed(text: str | None) -> datetime | None:
    """A time as servers write it, in UTC; None if it is none."""
    try:
        found = datetime.fromisoformat(text.replace("Z", "+00:00")) if text else None
    except ValueError:
        return None
    return found if found is None or found.tzinfo is None else found.astimezone(timezone.utc).replace(tzinfo=None)


def quoted(value: str) -> str:
    return '"' + value.replace("\\", "\\\\").replace('"', '\\"') + '"'


class Client:
    """Asks one server, politely: pauses between requests, more after a refusal."""

    def __init__(self, options: dict[str, str]):
        self.api = APIS[options.get("api", "wiki")]
        self.root = options["url"].rstrip("/") + options.get("path", self.api.path)
        self.token, self.page = options.get("token"), int(options.get("pagesize", 50))
        self.pause, self.retries, self.first = float(options.get("interval", 0)), int(options.get("retries", 4)), float(options.get("backoff", 0.5))
        self.last = 0.0

    def get(self, start: int, limit: int, query: str) -> dict:
        params = {self.api.start: start, self.api.limit: limit} | ({self.api.query: query} if query else {}) | ({"expand": self.api.expand} if self.api.expand else {})
        request = urllib.request.Request(f"{self.root}?{urllib.parse.urlencode(params)}", headers={"Accept": "application/json"} | ({"Authorization": f"Bearer {self.token}"} if self.token else {}))
        for attempt in range(self.retries + 1):
            time.sleep(max(0.0, self.last + self.pause - time.monotonic()))
            self.last = time.monotonic()
            wait = self.first * 2**attempt
            try:
                with urllib.request.urlopen(request, timeout=60) as reply:
                    return json.load(reply)
            except urllib.error.HTTPError as refused:
                if refused.code not in AGAIN or attempt == self.retries:
                    raise
                try:
                    wait = max(0.0, float(refused.headers.get("Retry-After", wait)))
                except ValueError:
                    pass  # a date; the pause is as good
            except OSError:
                if attempt == self.retries:
                    raise
            time.sleep(min(wait, LONGEST))
        raise AssertionError("unreachable")

    def total(self, query: str) -> int | None:
        answer = self.get(0, 1, query)
        return next((int(answer[t]) for t in self.api.totals[:1] if t in answer), None)

    def pages(self, first: int, stop: int | None, query: str) -> Iterator[dict]:
        """Items of the pages that begin from ``first`` on and before ``stop``; without an end, until a page is short."""
        at = first
        while stop is None or at < stop:
            items = self.get(at, self.page, query).get(self.api.rows) or []
            yield from items
            if len(items) < self.page:
                break
            at += self.page


@dataclass
class Pages(InputPartition):
    first: int
    stop: int | None
    query: str


def conditions(options: dict[str, str], pushed: Sequence[tuple[str, str, object]] = (), before: str | None = None) -> str:
    """The query of a server for what is asked: the given one, a space (or project), and times of change."""
    api, parts = APIS[options.get("api", "wiki")], []
    if options.get("query"):
        parts.append(f"({options['query']})")
    if options.get("space"):
        parts.append(f"{api.space} = {quoted(options['space'])}")
    if options.get("since"):
        parts.append(f"{api.changed} >= {quoted(minute(options['since']))}")
    parts += [f"{api.space if column == 'space' else api.changed} {sign} {quoted(str(value) if column == 'space' else minute(value))}" for column, sign, value in pushed]
    if before:
        parts.append(f"{api.changed} < {quoted(minute(before, 1))}")
    return " and ".join(parts)


def minute(when: str | datetime, later: int = 0) -> str:
    """A time to the minute, which is as fine as the servers' queries are; ``later`` minutes on."""
    found = when if isinstance(when, datetime) else parsed(str(when).replace(" ", "T"))
    if found is None:
        raise ValueError(f"{when} is no time")
    found = found.astimezone(timezone.utc).replace(tzinfo=None) if found.tzinfo else found
    return datetime.fromtimestamp((found.replace(tzinfo=timezone.utc).timestamp() // 60 + later) * 60, timezone.utc).strftime("%Y-%m-%d %H:%M")


class PagedReader(DataSourceReader):
    """A scan whose partitions are ranges of pages; one request finds out how many there are."""

    def __init__(self, options: dict[str, str]):
        self.options, self.pushed = dict(options), []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Equal spaces and least times of change go to the server. Spark filters by times again, as the server's are to the minute."""
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("space",):
                self.pushed.append(("space", "=", f.value))
                continue
            if isinstance(f, (GreaterThan, GreaterThanOrEqual)) and f.attribute == ("updated_at",):
                self.pushed.append(("updated_at", ">=", f.value))
            yield f

    def partitions(self) -> list[InputPartition]:
        return ranges(self.options, conditions(self.options, self.pushed))

    def read(self, partition: Pages) -> Iterator[tuple]:
        client = Client(self.options)
        return map(client.api.row, client.pages(partition.first, partition.stop, partition.query))


def ranges(options: dict[str, str], query: str) -> list[InputPartition]:
    """Page ranges of what a query finds, ``pagespertask`` pages each; one open range where the server names no total."""
    client = Client(options)
    total, step = client.total(query), client.page * int(options.get("pagespertask", 20))
    return [Pages(0, None, query)] if total is None else [Pages(k, min(k + step, total), query) for k in range(0, max(total, 1), step)]


class PagedStream(DataSourceStreamReader):
    """What has changed, batch by batch: an offset is a time of change, and a batch takes the changes from one to the next, both to the minute."""

    def __init__(self, options: dict[str, str]):
        self.options = dict(options)

    def initialOffset(self) -> dict:
        return {"since": self.options.get("since", "1970-01-01 00:00")}

    def latestOffset(self) -> dict:
        api = APIS[self.options.get("api", "wiki")]
        order = f"order by {api.changed} desc"
        client, query = Client(self.options), conditions(self.options)
        items = client.get(0, 1, f"{query} {order}".strip()).get(api.rows) or []
        latest = client.api.row(items[0])[2] if items else None
        return {"since": latest.strftime("%Y-%m-%d %H:%M:%S")} if latest else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return ranges(self.options, conditions(self.options | {"since": start["since"]}, before=end["since"]))

    def read(self, partition: Pages) -> Iterator[tuple]:
        client = Client(self.options)
        return map(client.api.row, client.pages(partition.first, partition.stop, partition.query))


class PagedSource(DataSource):
    """``noema_http``. Options: url, api (wiki, issues), space, query (CQL or JQL), since, token, path, pageSize, pagesPerTask, interval (seconds between requests of a task), retries, backoff."""

    @classmethod
    def name(cls) -> str:
        return "noema_http"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PagedReader:
        return PagedReader({k.lower(): v for k, v in self.options.items()})

    def streamReader(self, schema) -> PagedStream:
        return PagedStream({k.lower(): v for k, v in self.options.items()})
