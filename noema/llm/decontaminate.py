"""Benchmark decontamination by winnowing.

Of every six consecutive hashes of five words, the smallest is the fingerprint of
the ten words that they span: any ten words that a document shares with a benchmark
item have the same fingerprint on both sides. Fingerprints of documents and of
items are joined; the hits are extended to whole windows, whose hashes are joined
again, so that what counts as hit is exact. An item of fewer words is one window
with a fingerprint of a shorter run.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noema.llm.frames import cut, document_name, keyed_text, map_batches
from noema.llm.words import chunks, grams, mix, smallest, texts_of, word_table, words

LETTERS = word_table(letters=b"0123456789abcdefghijklmnopqrstuvwxyz" + bytes(range(128, 256)))
SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
#: Bytes of a table that is broadcast; a larger one is joined by a shuffle, where each of its keys is dealt to so many tasks.
BROADCAST, SALTS = 32 << 20, 32


def _windows(h: np.ndarray, owner: np.ndarray, size: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, fingerprint and hash of each run of ``size`` words of one text."""
    if len(h) < size:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    at = np.flatnonzero(owner[: len(h) - size + 1] == owner[size - 1 :])
    low = smallest(grams(h, k), size - k + 1)
    return at, mix(low[at] + np.uint64(size)), mix(grams(h, size)[at] ^ np.uint64(size))


def _shape(size: int, window: int, k: int) -> int:
    """Words of a fingerprint of windows of so many words."""
    return k if size == window else (size + 1) // 2


def _item_windows(benchmark: DataFrame, window: int, k: int) -> DataFrame:
    """The benchmark's windows: fp long, win long, size int, items array<string> (of those with an id)."""
    items = benchmark.select(benchmark["item_id"].cast("string").alias("item"), benchmark["text"].cast("string").alias("text")).where("text is not null")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        names = np.array(batch.column(0).to_pylist(), object)
        texts, out = texts_of(batch.column(1)), []
        for a, b in chunks(texts):
            tokens = words(texts[a:b], LETTERS, lower=True)
            h, owner, lengths = tokens.hashes(), tokens.owner(), np.diff(tokens.first)
            for size in np.unique(np.minimum(lengths, window)).tolist():
                if size:
                    at, fp, win = _windows(h, owner, size, _shape(size, window, k))
                    own = np.flatnonzero(np.minimum(lengths[owner[at]], window) == size)
                    out.append((fp[own], win[own], np.full(len(own), size), a + owner[at[own]]))
        fp, win, size, of = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0), np.zeros(0, np.int64))
        return pa.RecordBatch.from_arrays([pa.array(fp.view(np.int64)), pa.array(win.view(np.int64)), pa.array(size.astype(np.int32)), pa.array(names[of.astype(np.int64)].tolist(), pa.string())], ["fp", "win", "size", "item"])

    return map_batches(items, run, "fp long, win long, size int, item string").groupBy("fp", "win").agg(F.first("size").alias("size"), F.collect_set("item").alias("items"))


def _met(left: DataFrame, right: DataFrame, keys: list[str], how: str, size: int, broadcast: int) -> DataFrame:
    """Join with a table of ``size`` bytes: a broadcast if they are few, else a shuffle in which the rows of one key spread over SALTS tasks."""
    if size <= broadcast:
        return left.join(F.broadcast(right), keys, how)
    spread = right.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return left.withColumn("salt", F.pmod(F.xxhash64("hash", "low"), F.lit(SALTS)).cast("int")).join(spread, [*keys, "salt"], how).drop("salt")


def _bytes(df: DataFrame, row: str) -> int:
    return int(df.agg(F.coalesce(F.sum(F.expr(row)), F.lit(0))).first()[0])


def _document_windows(docs: DataFrame, sizes: Sequence[int], window: int, k: int) -> DataFrame:
    """Fingerprints of documents, one row for each run of windows that share one: hash long, low int, fp long. ``docs``: hash, low, text."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        hashes, lows = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
        texts, docs_of, prints = texts_of(batch.column(2)), [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for a, b in chunks(texts):
            tokens = words(texts[a:b], LETTERS, lower=True)
            h, owner = tokens.hashes(), tokens.owner()
            for size in sizes:
                at, fp, _ = _windows(h, owner, size, _shape(size, window, k))
                new = np.ones(len(at), bool)
                new[1:] = (fp[1:] != fp[:-1]) | (owner[at[1:]] != owner[at[:-1]])
                docs_of.append(a + owner[at[new]])
                prints.append(fp[new])
        of = np.concatenate(docs_of)
        return pa.RecordBatch.from_arrays([pa.array(hashes[of]), pa.array(lows[of]), pa.array(np.concatenate(prints).view(np.int64))], ["hash", "low", "fp"])

    return map_batches(docs, run, "hash long, low int, fp long")


def hits(docs: DataFrame, benchmark: DataFrame, window: int = 10, k: int = 5, broadcast: int = BROADCAST) -> DataFrame:
    """Windows of documents that are windows of items: hash long, low int, start int, size int, items array<string>. ``docs``: hash, low, text."""
    items = cut(_item_windows(benchmark, window, k))
    sizes = sorted(r[0] for r in items.select("size").distinct().collect())  # at most ``window`` numbers
    prints = items.select("fp").distinct()
    found = _met(_document_windows(docs.select("hash", "low", "text"), sizes, window, k), prints, ["fp"], "left_semi", 16 * prints.count(), broadcast)
    matched = cut(found.groupBy("hash", "low").agg(F.collect_set("fp").alias("fps")))
    some = docs.select("hash", "low", "text")
    near = F.broadcast(matched) if _bytes(matched, "24 + 8 * size(fps)") <= broadcast else matched

    def extend(batch: pa.RecordBatch) -> pa.RecordBatch:
        out, texts = [], texts_of(batch.column(2))
        for row, text in enumerate(texts):
            tokens = words([text], LETTERS, lower=True)
            h, owner = tokens.hashes(), tokens.owner()
            wanted = batch.column(3)[row].values.to_numpy().view(np.uint64)
            for size in sizes:
                at, fp, win = _windows(h, owner, size, _shape(size, window, k))
                own = np.flatnonzero(np.isin(fp, wanted))
                out.append((np.full(len(own), row), at[own], np.full(len(own), size), fp[own], win[own]))
        of, at, size, fp, win = (np.concatenate(x) for x in zip(*out, strict=True)) if out else [np.zeros(0, np.uint64)] * 5
        names = [batch.column(c).to_numpy(zero_copy_only=False)[of.astype(np.int64)] for c in (0, 1)]
        return pa.RecordBatch.from_arrays([*map(pa.array, names), pa.array(at.astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(fp.view(np.int64)), pa.array(win.view(np.int64))], ["hash", "low", "start", "size", "fp", "win"])

    extended = map_batches(some.join(near, ["hash", "low"]).select("hash", "low", "text", "fps"), extend, "hash long, low int, start int, size int, fp long, win long")
    return _met(extended, items.drop("size"), ["fp", "win"], "inner", _bytes(items, "48 + octet_length(array_join(items, ','))"), broadcast).drop("fp", "win")


def clean(docs: DataFrame, benchmark: DataFrame, window: int = 10, k: int = 5, broadcast: int = BROADCAST) -> DataFrame:
    """The documents, all columns, without a word that is hit.

    A null or wordless text stays, as do all texts with an empty benchmark; repeated rows stay or
    go together; an empty table gives none; columns may have any names.
    """
    hash_, low = document_name(docs)
    found = cut(hits(docs.select(hash_.alias("hash"), low.alias("low"), F.col("text").cast("string").alias("text")), benchmark, window, k, broadcast).select(F.col("hash").alias("hit_hash"), F.col("low").alias("hit_low")).distinct())
    near = F.broadcast(found) if 24 * found.count() <= broadcast else found
    return docs.join(near, (hash_ == near["hit_hash"]) & (low == near["hit_low"]), "left_anti")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, k: int = 5, broadcast: int = BROADCAST) -> DataFrame:
    """Words of each document inside a window that it shares with a benchmark item, and the items.

    A window is ``window`` consecutive words of an item; an item of fewer (but some) words is one
    window. Tables of at most ``broadcast`` bytes go to every task, larger ones are joined by
    shuffles; the driver gets numbers only.

    A null or wordless text gives n_words 0 and no hit; a null or wordless item has no window; an
    item without an id marks words as hit and adds nothing to the items; repeated documents each
    give a row; items that share an id count once; empty tables give no rows, or no hits; other
    columns are not read.
    """
    docs = keyed_text(docs, "doc_id", "text")
    hash_, low = document_name(docs)
    named = docs.select("doc_id", "text", hash_.alias("hash"), low.alias("low"))
    spans = cut(hits(named, benchmark, window, k, broadcast).groupBy("hash", "low").agg(F.collect_list(F.struct("start", "size")).alias("spans"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items")))
    near = F.broadcast(spans) if _bytes(spans, "32 + 8 * size(spans) + octet_length(array_join(items, ','))") <= broadcast else spans

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, n_words = texts_of(batch.column(1)), []
        for a, b in chunks(texts):
            n_words += np.diff(words(texts[a:b], LETTERS, lower=True).first).tolist()
        n_hit, names = [0] * len(texts), [[]] * len(texts)
        for k, row in enumerate(batch.column(2)):
            if row.is_valid:
                start, size = (row.values.field(c).to_numpy() for c in (0, 1))
                change = np.zeros(n_words[k] + 1, np.int64)
                np.add.at(change, start, 1)
                np.add.at(change, start + size, -1)
                n_hit[k] = int((np.cumsum(change[:-1]) > 0).sum())
                names[k] = sorted(batch.column(3)[k].as_py())
        digests = [hashlib.sha256(",".join(n).encode()).hexdigest() for n in names]
        columns = [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array([len(n) for n in names], pa.int64()), pa.array(digests, pa.string()), pa.array([n > 0 for n in n_hit], pa.bool_())]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    return map_batches(named.join(near, ["hash", "low"], "left").select("doc_id", "text", "spans", "items"), run, SCHEMA)


def brute_force(text: str | None, items: list[tuple[object, str | None]], window: int = 10) -> tuple[int, int, list[str]]:
    """The definition: number of words, words hit, items."""
    own, hit, names = _plain(text), set(), set()
    for item, body in items:
        other = _plain(body)
        for at in range(max(1, len(other) - window + 1)) if other else []:
            part = other[at : at + window]
            for k in range(len(own) - len(part) + 1):
                if own[k : k + len(part)] == part:
                    hit.update(range(k, k + len(part)))
                    names |= set() if item is None else {str(item)}
    return len(own), len(hit), sorted(names)


def _plain(text: str | None) -> list[bytes]:
    return bytes(b if LETTERS[b] else 32 for b in (text or "").encode().lower()).split()
