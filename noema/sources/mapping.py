"""From source documents to drafts of concepts: paths into JSON, declared mappings, ids, references and admission."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

from noema.functions.scalars import ID, references

#: Fields that a mapping may fill.
FIELDS = ("title", "description", "body", "tags", "updated_at", "resource")
Step = str | int | None


class PathError(ValueError):
    """A path that isn't written in the supported form."""


def steps(path: str) -> list[Step]:
    """A path as steps: a field's name, a number of an item, or None for all items."""
    text, at, out = path.strip(), 1, []
    if not text.startswith("$"):
        raise PathError(f"{path!r} doesn't begin with $")
    while at < len(text):
        if text[at] == ".":
            end = at + 1
            while end < len(text) and (text[end].isascii() and text[end].isalnum() or text[end] in "_-"):
                end += 1
            name = text[at + 1 : end]
            if not name or name[0].isdigit() or name[0] == "-":
                raise PathError(f"{path!r} has no name at {at + 1}")
            out.append(name)
            at = end
            continue
        end = text.find("]", at)
        inner = text[at + 1 : end].strip()
        if text[at] != "[" or end < 0 or not inner:
            raise PathError(f"{path!r} can't be read at {at}")
        if inner[0] in "'\"":
            end = text.find(inner[0], text.index(inner[0], at) + 1)
            close = text.find("]", end)
            if end < 0 or close < 0 or text[end + 1 : close].strip():
                raise PathError(f"{path!r} has an open quote at {at}")
            out.append(text[text.index(inner[0], at) + 1 : end])
            end = close
        elif inner == "*":
            out.append(None)
        elif inner.lstrip("-").isdigit() and inner.count("-") <= 1:
            out.append(int(inner))
        else:
            raise PathError(f"{path!r} can't be read at {at}")
        at = end + 1
    return out


def find(value: object, path: Sequence[Step]) -> list[object]:
    """All values at a path; a missing step gives none, a set null counts."""
    held = [value]
    for step in path:
        new: list[object] = []
        for v in held:
            if step is None:
                new += list(v.values()) if isinstance(v, dict) else v if isinstance(v, list) else []
            elif isinstance(step, int):
                new += [v[step]] if isinstance(v, list) and -len(v) <= step < len(v) else []
            elif isinstance(v, dict) and step in v:
                new.append(v[step])
        held = new
    return held


def json_find(text: Column, path: str) -> Column:
    """All values at a path of a JSON text, as JSON texts; none for a text that is no JSON. All items of a list and places from its end are beyond the paths of Spark's own functions."""
    parsed = steps(path)

    @F.pandas_udf(ArrayType(StringType()))
    def found(values: pd.Series) -> pd.Series:
        def one(value: str | None) -> list[str]:
            try:
                return [json.dumps(v, ensure_ascii=False) for v in find(json.loads(value), parsed)] if value else []
            except ValueError:
                return []

        return values.map(one)

    return found(text)


def _mapped(value: object, paths: Mapping[str, list[Step]]) -> dict:
    out: dict = {}
    for field, path in paths.items():
        hits = find(value, path)
        if field == "tags" and hits:
            flat = [x for h in hits for x in (h if isinstance(h, list) else [h]) if x is not None]
            if any(isinstance(x, dict | list) for x in flat):
                return {"error": f"{field} names a nested value"}
            out[field] = [str(x) for x in flat]
        elif hits and hits[0] is not None:
            if isinstance(hits[0], dict | list):
                return {"error": f"{field} names a nested value"}
            out[field] = str(hits[0])
    return out


def mapped(documents: DataFrame, raw: str, mapping: Mapping[str, str]) -> DataFrame:
    """Documents with the fields that a mapping (field: path) finds in the JSON column ``raw`` in place of their own, and ``error`` where a path names a nested value; fields of which nothing is found stay."""
    unknown = sorted(set(mapping) - set(FIELDS))
    if unknown:
        raise PathError(f"no such field: {', '.join(unknown)}")
    paths = {field: steps(path) for field, path in mapping.items()}
    schema = StructType().add("error", StringType())
    for field in mapping:
        schema = schema.add(field, ArrayType(StringType()) if field == "tags" else StringType())

    @F.pandas_udf(schema)
    def apply(values: pd.Series) -> pd.DataFrame:
        def one(value: str | None) -> dict:
            try:
                return _mapped(json.loads(value), paths) if value else {}
            except ValueError:
                return {"error": "no JSON"}

        rows = [one(v) for v in values]
        return pd.DataFrame({f.name: pd.Series([r.get(f.name) for r in rows], dtype=object) for f in schema})

    rows = documents.withColumn("found", apply(F.col(raw)))
    kinds = dict(documents.dtypes)
    for field in mapping:
        new = F.try_to_timestamp(F.col(f"found.{field}")) if field == "updated_at" else F.col(f"found.{field}")
        rows = rows.withColumn(field, F.coalesce(new, F.col(field)) if field in kinds else new)
    return rows.withColumn("error", F.col("found.error")).drop("found")


def reference_id(target: Column, prefix: str, known: Sequence[str]) -> Column:
    """The concept that a source's reference names: an id of a known prefix as it is, anything else is the source's own."""
    other = target.rlike(ID) & F.substring_index(target, ":", 1).isin(*known)
    return F.when(other, target).otherwise(F.concat(F.lit(prefix + ":"), target))


def drafts(documents: DataFrame, *, source: str, prefix: str, scope: str, kind: str, store: str, known: Sequence[str] = ()) -> DataFrame:
    """Drafts of concepts from documents of one source: ids of its prefix, references in ids, the type that a document hints at (``type_hint``, if there is that column) or the source's."""
    hint = F.coalesce("type_hint", F.lit(kind)) if "type_hint" in documents.columns else F.lit(kind)
    refs = F.array_distinct(F.transform("references", lambda r: F.struct(reference_id(r["target"], prefix, known).alias("target"), r["kind"].alias("kind"))))
    return documents.select(
        F.concat(F.lit(prefix + ":"), "external_id").alias("id"), F.lit(store).alias("store"), F.lit(scope).alias("scope"), hint.alias("type"), "title", "description", "body",
        F.col("url").alias("resource"), "tags", F.lit("active").alias("status"), F.lit(source).alias("source_name"), "external_id", F.col("updated_at").alias("source_updated_at"), refs.alias("references"),
    )


def admitted(rows: DataFrame, scopes: DataFrame, types: DataFrame) -> DataFrame:
    """Drafts with ``reason``: null, or why they can't be taken. ``scopes``: scope, store; ``types``: type, store (the stores that take it). Both are tables of settings, a few rows each."""
    known = rows.join(F.broadcast(scopes.select("scope", F.col("store").alias("home"))), "scope", "left")
    allowed = types.groupBy("type").agg(F.collect_set("store").alias("stores"))
    known = known.join(F.broadcast(allowed), "type", "left")
    reason = F.when(F.col("home").isNull(), "unknown scope").when(F.col("home") != F.col("store"), "scope of another store").when(F.col("stores").isNull(), "unknown type").when(~F.array_contains("stores", F.col("store")), "type not in this store")
    return known.withColumn("reason", reason).select(*rows.columns, "reason")


def body_links(documents: DataFrame) -> DataFrame:
    """References in the bodies of documents: external_id, target."""
    return documents.select("external_id", F.explode(references(F.coalesce("body", F.lit("")))).alias("target"))
