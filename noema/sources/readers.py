"""Readers: wiki pages, issues and files become documents of one shape."""

from __future__ import annotations

import fnmatch
import posixpath
import re
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from noema.functions.markup import issue_links, issue_markdown, link_parts, page_of_link, storage_links, storage_markdown
from noema.functions.scalars import teaser, unescaped
from noema.operators.merge import cursor_filter
from noema.sources.mapping import mapped

PAGE = "id string, type string, title string, space struct<key:string,name:string>, excerpt string, body struct<storage:struct<value:string>>, version struct<number:int,when:string>, metadata variant, links struct<webui:string>"
ISSUE = "key string, id string, self string, references array<string>, fields struct<summary:string,description:string,labels:array<string>,updated:string,status:struct<name:string>,project:struct<key:string>,issuetype:struct<name:string>,priority:struct<name:string>,parent:struct<key:string>,subtasks:array<struct<key:string>>,issuelinks:array<struct<type:struct<name:string,inward:string,outward:string>,inwardIssue:struct<key:string>,outwardIssue:struct<key:string>>>,remotelinks:array<struct<globalId:string,object:struct<url:string,title:string>>>>"
_REF = "struct<target:string,kind:string>"


def _selected(documents: DataFrame, since: str | None, exclude_tags: Sequence[str]) -> DataFrame:
    """Documents changed after ``since`` (those without a time always pass) and without a tag that is excluded."""
    if exclude_tags:
        documents = documents.where(~F.coalesce(F.arrays_overlap("tags", F.array(*map(F.lit, exclude_tags))), F.lit(False)))
    return cursor_filter(documents, since)


def _pages(spark: SparkSession, path: str, spaces: Sequence[str]) -> DataFrame:
    raw = spark.read.schema(PAGE).option("multiLine", True).json(path)
    return raw.where(F.col("space.key").isin(*spaces)) if spaces else raw


def wiki_pages(spark: SparkSession, path: str, *, spaces: Sequence[str] = (), since: str | None = None, exclude_tags: Sequence[str] = (), web: str = "", prefix: str = "page") -> DataFrame:
    """Documents of wiki pages, one JSON file each: external_id, title, description, body, tags, updated_at, url, references.

    Labels come as a list or as an object with results; both are read. References are the pages that
    links name, by id or by space and title among all pages that were read; a title that no page has
    costs the reference, not the document.
    """
    return wiki_documents(_pages(spark, path, spaces), since=since, exclude_tags=exclude_tags, web=web, prefix=prefix)


def parsed(objects: DataFrame, schema: str) -> DataFrame:
    """Objects that a server gave as JSON (id, value) in the columns of ``schema`` (PAGE or ISSUE), one an id; ``wiki_documents`` and ``issue_documents`` take them on."""
    one = objects.groupBy("id").agg(F.max("value").alias("value"))
    return one.select(F.from_json("value", schema).alias("o")).select("o.*")


def wiki_documents(raw: DataFrame, *, since: str | None = None, exclude_tags: Sequence[str] = (), web: str = "", prefix: str = "page") -> DataFrame:
    """``wiki_pages`` of pages that have been read (columns of PAGE)."""
    names = F.transform(F.coalesce(F.try_variant_get("metadata", "$.labels.results", "array<struct<name:string>>"), F.try_variant_get("metadata", "$.labels", "array<struct<name:string>>")), lambda x: x["name"])
    targets = page_references(raw.select("id", F.col("space.key").alias("space"), "title", F.col("body.storage.value").alias("body")), prefix)
    refs = targets.groupBy("id").agg(F.array_sort(F.collect_set(F.struct("target", F.lit("references").alias("kind")))).alias("references"))
    documents = raw.join(refs, "id", "left").select(
        F.col("id").alias("external_id"),
        "title",
        F.col("excerpt").alias("description"),
        storage_markdown("body.storage.value").alias("body"),
        F.coalesce(names, F.array().cast("array<string>")).alias("tags"),
        F.try_to_timestamp("version.when").alias("updated_at"),
        F.concat(F.lit(web.rstrip("/")), "links.webui").alias("url"),
        F.coalesce("references", F.array().cast(f"array<{_REF}>")).alias("references"),
    )
    return _selected(documents, since, exclude_tags)


def page_references(pages: DataFrame, prefix: str = "page") -> DataFrame:
    """Pages that the links of ``pages`` (id, space, title, body) name, each once: id, target. Titles are looked up in the link's space, or the page's own; one join for all of them."""
    links = pages.select("id", F.col("space").alias("own"), F.explode(storage_links("body")).alias("link"))
    parts = link_parts(F.col("link.href"))
    links = links.select("id", parts["page"].alias("page"), F.coalesce("link.space", parts["space"], "own").alias("space"), F.coalesce("link.title", F.translate(parts["title"], "+", " ")).alias("title"))
    index = pages.groupBy("space", "title").agg(F.min("id").alias("found"))
    found = links.join(index, ["space", "title"], "left").select("id", F.coalesce("page", "found").alias("page"))
    return found.where("page is not null and page <> id").select("id", F.concat(F.lit(prefix + ":"), "page").alias("target")).distinct()


def issues(spark: SparkSession, path: str, prefix: str = "issue", web: str = "", *, projects: Sequence[str] = (), statuses: Sequence[str] = (), since: str | None = None, exclude_tags: Sequence[str] = (), pages: str | None = None) -> DataFrame:
    """Documents of issues, one JSON file each, with Markdown bodies; of some projects or states only, where these are given.

    References: issues linked in the text, listed ones, subtasks (member: the issue holds them), the
    parent (related, since an edge starts at its issue) and links: a blocking issue on the inward side
    is depended on, all others are related. With ``pages`` (a prefix), wiki pages that remote links
    name by id are referenced too.
    """
    raw = spark.read.schema(ISSUE).option("multiLine", True).json(path)
    return issue_documents(raw, prefix, web, projects=projects, statuses=statuses, since=since, exclude_tags=exclude_tags, pages=pages)


def issue_documents(raw: DataFrame, prefix: str = "issue", web: str = "", *, projects: Sequence[str] = (), statuses: Sequence[str] = (), since: str | None = None, exclude_tags: Sequence[str] = (), pages: str | None = None) -> DataFrame:
    """``issues`` that have been read (columns of ISSUE)."""
    for values, column in ((projects, "fields.project.key"), (statuses, "fields.status.name")):
        raw = raw.where(F.col(column).isin(*values)) if values else raw
    remote = F.transform("fields.remotelinks", lambda x: F.coalesce(F.nullif(F.regexp_extract(x["globalId"], r"pageId=(\d+)", 1), F.lit("")), page_of_link(x["object"]["url"])))
    key = lambda k: F.concat(F.lit(prefix + ":"), k)
    ref = lambda target, kind: F.struct(target.alias("target"), (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"))
    empty = F.array().cast(f"array<{_REF}>")
    blocks = lambda x: F.coalesce(F.lower(F.trim(x["type"]["name"])) == "blocks", F.lit(False))
    end = lambda x: F.when(blocks(x), x["inwardIssue"]["key"]).otherwise(F.coalesce(x["inwardIssue"]["key"], x["outwardIssue"]["key"]))
    links = F.transform(F.filter("fields.issuelinks", lambda x: end(x).isNotNull()), lambda x: ref(key(end(x)), F.when(blocks(x), "depends_on").otherwise("related")))
    parts = [
        F.transform(issue_links(F.col("fields.description"), prefix), lambda x: ref(x, "references")),
        F.transform("fields.subtasks", lambda x: ref(key(x["key"]), "member")),
        F.when(F.col("fields.parent.key").isNotNull(), F.array(ref(key(F.col("fields.parent.key")), "related"))),
        links,
        F.transform("references", lambda x: ref(x, "references")),
    ]
    if pages is not None:
        parts.append(F.transform(F.filter(remote, lambda x: x.isNotNull()), lambda x: ref(F.concat(F.lit(pages + ":"), x), "references")))
    documents = raw.select(
        F.col("key").alias("external_id"),
        F.col("fields.summary").alias("title"),
        F.lit(None).cast("string").alias("description"),
        F.nullif(issue_markdown(F.col("fields.description"), web), F.lit("")).alias("body"),
        F.coalesce("fields.labels", F.array().cast("array<string>")).alias("tags"),
        F.try_to_timestamp("fields.updated").alias("updated_at"),
        F.concat(F.lit(web.rstrip("/") + "/browse/"), "key").alias("url"),
        F.array_distinct(F.concat(*(F.coalesce(p.cast(f"array<{_REF}>"), empty) for p in parts))).alias("references"),
    )
    return _selected(documents, since, exclude_tags)


@F.pandas_udf(StringType())
def _resolved(folders: pd.Series, links: pd.Series) -> pd.Series:
    """A relative link from a folder as a path inside of the collection."""
    return pd.Series([posixpath.normpath(posixpath.join(f, x)) for f, x in zip(folders, links, strict=True)], dtype=object)


def files(spark: SparkSession, path: str, pattern: str = "*.md", *, folders: Sequence[str] = (), exclude: Sequence[str] = (), limit: int | None = None, web: str = "", marker: str | None = None, since: str | None = None) -> DataFrame:
    """Documents of the text files below a folder, in the order of their paths.

    The id is the hexadecimal number in a comment that begins with ``marker`` in the first five
    lines, else the path; the title is the first heading or the name, the description the first
    prose, the tag the first folder. ``folders``: only files below one of these; ``exclude``: no files
    that such a pattern (of the whole path) matches; ``limit``: the first files only. Relative links
    to other files of the collection are references; links out of it are left out.
    """
    root = path.rstrip("/")
    raw = spark.read.text(path, wholetext=True, pathGlobFilter=pattern, recursiveFileLookup=True).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("updated_at"))
    below = F.substring_index("file", posixpath.basename(root) + "/", -1) if "/" + posixpath.basename(root) + "/" not in root else F.expr(f"substring(file, locate('{root}/', file) + {len(root) + 1})")
    rows = raw.withColumn("path", F.try_url_decode(F.regexp_replace(below, r"\+", "%2B"))).withColumn("parts", F.split("path", "/"))
    if folders:
        rows = rows.where(F.arrays_overlap("parts", F.array(*map(F.lit, folders))))
    for glob in exclude:
        rows = rows.where(~F.col("path").rlike(fnmatch.translate(glob).replace(r"\Z", "$").replace(r"\z", "$")))
    if limit:
        rows = rows.orderBy("path").limit(limit)
    comment = rf"(?i)<!--\s*{re.escape(marker)}([0-9a-f]{{8,}})\s*-->" if marker else None
    top = F.array_join(F.slice(F.split("value", "\n"), 1, 5), "\n")
    named = F.nullif(F.lower(F.regexp_extract(top, comment, 1)), F.lit("")) if comment else F.lit(None).cast("string")
    body = F.trim(F.regexp_replace("value", comment, "") if comment else F.col("value"))
    heading = F.nullif(F.trim(F.regexp_extract("value", r"(?m)^#\s+(.+)$", 1)), F.lit(""))
    rows = rows.withColumn("external_id", F.coalesce(named, "path")).withColumn("body", body)
    targets = rows.select("external_id", F.explode(F.regexp_extract_all("value", F.lit(r"\]\(([^)\s:#]+\.md)(?:#[^)\s]*)?\)"), F.lit(1))).alias("link"), F.regexp_replace("path", r"[^/]*$", "").alias("folder"))
    index = rows.select(F.col("path").alias("to"), F.col("external_id").alias("target"))
    found = targets.withColumn("to", _resolved("folder", "link")).join(index, "to").groupBy("external_id").agg(F.array_sort(F.collect_set(F.struct("target", F.lit("references").alias("kind")))).alias("references"))
    tag = F.when(F.size("parts") > 1, F.array(F.col("parts")[0])).otherwise(F.array().cast("array<string>"))
    url = F.concat(F.lit(web.rstrip("/") + "/"), "path") if web else F.lit(None).cast("string")
    documents = rows.join(found, "external_id", "left").select("external_id", F.coalesce(unescaped(heading), F.regexp_replace(F.element_at("parts", -1), r"\.[^.]*$", "")).alias("title"), teaser(F.col("body")).alias("description"), "body", tag.alias("tags"), "updated_at", url.alias("url"), F.coalesce("references", F.array().cast(f"array<{_REF}>")).alias("references"))
    return cursor_filter(documents, since)


def json_documents(spark: SparkSession, path: str | None = None, inline: Sequence[str] = (), mapping: Mapping[str, str] | None = None) -> DataFrame:
    """Documents from JSON files (an object or a list of objects each) and from JSON texts given inline. Fields that no document has go to ``extra`` as they are; a mapping may fill fields from them."""
    texts = spark.createDataFrame([(t, None) for t in inline], "value string, file string")
    if path is not None:
        texts = texts.unionAll(spark.read.text(path, wholetext=True, pathGlobFilter="*.json").select("value", "_metadata.file_path"))
    listed = F.when(F.ltrim("value").startswith("["), F.from_json("value", "array<variant>")).otherwise(F.array(F.try_parse_json("value")))
    raw = texts.select(F.explode(listed).alias("v")).where("v is not null").select("v", F.to_json("v").alias("raw"))
    text = lambda name, kind="string": F.try_variant_get("v", f"$.{name}", kind)
    one = lambda x: F.struct(F.coalesce(F.try_variant_get(x, "$.target", "string"), F.try_variant_get(x, "$", "string")).alias("target"), F.coalesce(F.try_variant_get(x, "$.kind", "string"), F.lit("references")).alias("kind"))
    refs = F.coalesce(F.transform(text("references", "array<variant>"), one), F.array().cast(f"array<{_REF}>"))
    known = ("external_id", "title", "description", "body", "tags", "updated_at", "url", "references")
    extra = F.to_json(F.map_filter(F.from_json("raw", "map<string,variant>"), lambda k, v: ~k.isin(*known)))
    documents = raw.select(*(text(c).alias(c) for c in ("external_id", "title", "description", "body")), F.coalesce(text("tags", "array<string>"), F.array().cast("array<string>")).alias("tags"), F.try_to_timestamp(text("updated_at")).alias("updated_at"), text("url").alias("url"), refs.alias("references"), extra.alias("extra"), "raw")
    return (mapped(documents, "raw", mapping) if mapping else documents.withColumn("error", F.lit(None).cast("string"))).drop("raw")
