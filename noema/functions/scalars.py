"""Scalar functions of concepts, references and texts as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The hash's separator, the pattern of references in bodies, and that of a valid id.
SEPARATOR, REFERENCE, ID = "\x1e", r"\[\[([^\[\]\n]+)\]\]", r"^[a-z][a-z0-9_-]*:[^\s\[\]]+$"


def content_hash(title: Column, description: Column, body: Column) -> Column:
    """SHA-256 of title, description and body; null counts as empty."""
    return F.sha2(F.concat_ws(SEPARATOR, *(F.coalesce(c, F.lit("")) for c in (title, description, body))).cast("binary"), 256)


def references(body: Column) -> Column:
    """Valid ids in double brackets, each once, in order of first occurrence; null for a null body."""
    found = F.regexp_extract_all(body, F.lit(REFERENCE), F.lit(1))
    return F.array_distinct(F.filter(F.transform(found, lambda x: F.trim(x)), lambda x: x.rlike(ID)))


def id_prefix(concept_id: Column) -> Column:
    return F.when(concept_id.rlike(ID), F.substring_index(concept_id, ":", 1))


def id_local(concept_id: Column) -> Column:
    return F.when(concept_id.rlike(ID), F.regexp_extract(concept_id, r"^[^:]*:(.*)$", 1))


def embedding_text(title: Column, description: Column) -> Column:
    """Title and description with a blank line between, without those that are empty."""
    return F.concat_ws("\n\n", F.nullif(F.trim(F.coalesce(title, F.lit(""))), F.lit("")), F.nullif(F.trim(F.coalesce(description, F.lit(""))), F.lit("")))


def tiny_link_id(token: Column) -> Column:
    """The page id in a short link: url-safe base64 of a little-endian number."""
    plain = F.translate(token, "-_", "+/")
    padded = F.rpad(plain, 12, "A")
    digits = F.regexp_extract_all(F.hex(F.unbase64(F.concat(F.substring(padded, 1, 11), F.lit("=")))), F.lit("(..)"), F.lit(1))
    return F.conv(F.array_join(F.reverse(digits), ""), 16, 10).cast("long")


def json_part(text: Column) -> Column:
    """From the first opening to the last closing brace; empty if there is none."""
    return F.regexp_extract(text, r"(?s)(\{.*\})", 1)


def unescaped(text: Column) -> Column:
    """Markdown without its backslash escapes."""
    return F.regexp_replace(text, r"\\([\\`*_{}\[\]()#+\-.!|>~])", "$1")


def teaser(body: Column, limit: int = 400) -> Column:
    """The first paragraph of prose (no heading, list, table, quote or code), at most ``limit`` characters with an ellipsis."""
    parts = F.filter(F.transform(F.split(body, r"\n\s*\n"), lambda p: F.trim(F.regexp_replace(p, r"\s+", " "))), lambda p: (p != "") & ~p.rlike(r"^(#|[-*+] |\d+\. |\||>|```|!\[)"))
    first = unescaped(F.try_element_at(parts, F.lit(1)))
    return F.when(F.length(first) > limit, F.concat(F.rtrim(F.substring(first, 1, limit - 1)), F.lit("…"))).otherwise(first)


def trigrams(text: Column) -> Column:
    """Different trigrams of the lower-cased words, each with two blanks in front and one behind."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    return F.array_distinct(F.flatten(F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda k: w.substr(k, F.lit(3))))))


def trigram_similarity(a: Column, b: Column) -> Column:
    """Shared trigrams over all trigrams; 0 if there are none."""
    shared, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(either > 0, shared / either).otherwise(0.0)


def text_words(text: Column) -> Column:
    """Lower-cased words in order: runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def text_rank(places: Column) -> Column:
    """Rank of a text for a query, given the places at which it has each of the query's words (array of arrays).

    One word: the sum of 1 / k² over its k-th occurrence, set against what endless ones would give. Several
    words: every pair of places of two words says something, the more the nearer they are; what all pairs say is
    put together as independent evidence. All words have the weight of plain text, 0.1. Rounded to nine digits.
    """
    weight, endless, far, none = 0.1, 1.64493406685, 1e-30, 1e-20  # fixed values

    def near(p: Column, q: Column) -> Column:
        away = F.abs(p - q)
        said = F.lit(weight) * F.sqrt(F.when(away > 100, F.lit(far)).otherwise(1.0 / (1.005 + 0.05 * F.exp(away / 1.5 - 2))))
        return F.when(away == 0, F.lit(1.0)).otherwise(1.0 - said)

    def product(values: Column, of) -> Column:
        return F.aggregate(values, F.lit(1.0), lambda acc, x: acc * of(x))

    numbered = F.transform(places, lambda p, k: F.struct(p.alias("p"), k.alias("k")))
    unsaid = product(numbered, lambda a: product(F.slice(numbered, 1, a["k"]), lambda b: product(a["p"], lambda p: product(b["p"], lambda q: near(p, q)))))
    alone = F.aggregate(F.transform(F.element_at(places, 1), lambda p, k: 1.0 / ((k + 1) * (k + 1))), F.lit(0.0), lambda acc, x: acc + x) * weight / endless
    together = F.greatest(F.round(1.0 - unsaid, 9), F.lit(none))
    return F.when(F.size(places) == 0, F.lit(0.0)).when(F.size(places) == 1, F.round(alone, 9)).otherwise(together)


def cost(tokens_in: Column, tokens_out: Column, price_in: float, price_out: float) -> Column:
    """Price of a model call, with prices for a thousand tokens."""
    return ((tokens_in * price_in + tokens_out * price_out) / 1000).cast("decimal(10,5)")


def unique_strings(values: Column) -> Column:
    """Trimmed strings without empty ones, each once, in order."""
    return F.array_distinct(F.filter(F.transform(values, lambda v: F.trim(v)), lambda v: v != ""))
