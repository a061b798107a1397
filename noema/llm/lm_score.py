"""LM scoring: a context-tree weighting model learned from the corpus, and scores of every whole text.

Counting, weighting and prediction are split by the two bytes before a byte, and
after frequent pairs by three: each shard holds the context trees below its byte
pairs or triples. Only sums over the at most 256 one-byte contexts and over the
at most HEAVY frequent pairs go to the driver. Documents are scored in
blocks: a block asks each shard for the different grams that it holds and gets
their probabilities back, so neither model nor corpus is ever in one place.
Word counts for the base score travel the same way.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noema.llm.ctw import EDGE, Tree, counted, distinct, gram_keys, merge, shorter
from noema.llm.frames import block_count, crc_remainder, cut, keyed_text
from noema.llm.words import SPACES, chunks, mix, texts_of, word_table, words

SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
#: Bytes of context; characters of text for a shard; different keys that a task gathers before it sends them.
DEPTH, SHARD_CHARS, GATHER = 6, 8_000_000, 1_000_000
#: A pair of bytes is split by the third if more than one in HEAVY bytes follow it.
HEAVY = 256
_INSIDE = word_table(separators=SPACES)
_EDGES = bytes((EDGE, EDGE))
GRAMS, WORDS = 0, 1
_ROWS = "shard int, block int, kind int, keys binary, counts binary"


def squeeze(values: np.ndarray, ordered: bool) -> bytes:
    """Packs 64-bit numbers; sorted ones as differences."""
    v = values.astype(np.uint64)
    if ordered:
        v = np.diff(v, prepend=np.uint64(0))
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(v.view(np.uint8).reshape(-1, 8).T).tobytes())


def unsqueeze(data: bytes, ordered: bool) -> np.ndarray:
    v = np.ascontiguousarray(np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1).T).view(np.uint64).ravel()
    return np.cumsum(v, dtype=np.uint64) if ordered else v


def _keys(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    return gram_keys(texts, depth), words(texts, _INSIDE, lower=True).hashes()


class Deal(NamedTuple):
    """How keys are dealt to shards; ``heavy``: sorted pairs of bytes that are split."""

    depth: int
    shards: int
    heavy: np.ndarray

    def is_heavy(self, grams: np.ndarray) -> np.ndarray:
        split = np.zeros(1 << 16, bool)
        split[self.heavy.astype(np.int64)] = True
        return split[(grams >> np.uint64(8 * (self.depth - 1))).astype(np.int64)] if self.depth > 1 else np.zeros(len(grams), bool)

    def shard_of(self, keys: np.ndarray, kind: int) -> np.ndarray:
        if kind == WORDS:
            return (keys % np.uint64(self.shards)).astype(np.int64)
        context = keys >> np.uint64(8 * (self.depth - 1))
        if len(self.heavy):
            split = self.is_heavy(keys)
            context[split] = keys[split] >> np.uint64(8 * (self.depth - 2))
        return (mix(context) % np.uint64(self.shards)).astype(np.int64)

    def dealt(self, keys: np.ndarray, kind: int) -> tuple[np.ndarray, np.ndarray]:
        """Order of sorted keys by shard, and where each shard begins."""
        shard = self.shard_of(keys, kind)
        order = np.argsort(shard, kind="stable")
        return order, np.searchsorted(shard[order], np.arange(self.shards + 1))

    def trees(self, grams: np.ndarray, counts: np.ndarray) -> list[tuple[bool, Tree]]:
        """The trees of a shard: below pairs, and below triples (True)."""
        heavy = self.is_heavy(grams)
        return [(split, Tree(grams[part], counts[part], self.depth, 3 if split else 2)) for split, part in ((False, ~heavy), (True, heavy)) if part.any()]


def frequent_pairs(docs: DataFrame, depth: int) -> np.ndarray:
    """The pairs of bytes that are more than one in HEAVY contexts of ``docs`` (text), fewer than HEAVY of them; none where contexts are too short to be split."""
    if depth < 4:
        return np.zeros(0, np.uint64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(1 << 16, np.int64)
        for batch in batches:
            texts = texts_of(batch.column(0))
            for a, b in chunks(texts):
                data = np.frombuffer(_EDGES + _EDGES.join(texts[a:b]), np.uint8).astype(np.uint16)
                held += np.bincount(data[1:] << 8 | data[:-1], minlength=1 << 16)
        pairs = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(held[pairs])], ["pair", "n"])

    found = docs.select("text").mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect()  # 65,536 rows at most
    total = sum(r["n"] for r in found)
    return np.array(sorted(r["pair"] for r in found if r["n"] * HEAVY > total), np.uint64)


def _rows(block: int | None, kind: int, keys: np.ndarray, counts: np.ndarray | None, deal: Deal) -> pa.RecordBatch:
    order, edges = deal.dealt(keys, kind)
    some = [int(s) for s in np.flatnonzero(np.diff(edges))]
    parts = [order[edges[s] : edges[s + 1]] for s in some]
    n = len(some)
    return pa.RecordBatch.from_arrays(
        [pa.array(some, pa.int32()), pa.array([block] * n, pa.int32()), pa.array([kind] * n, pa.int32()), pa.array([squeeze(keys[p], True) for p in parts], pa.binary()), pa.array([None if counts is None else squeeze(counts[p], False) for p in parts], pa.binary())],
        ["shard", "block", "kind", "keys", "counts"],
    )


def _by_shard(batches: Iterator[pa.RecordBatch]) -> list[tuple[int, list[dict]]]:
    found: dict[int, list[dict]] = {}
    for batch in batches:
        for row in batch.to_pylist():
            found.setdefault(row["shard"], []).append(row)
    return sorted(found.items())


def _table(rows: list[dict], kind: int) -> tuple[np.ndarray, np.ndarray]:
    own = [r for r in rows if r["kind"] == kind and r["counts"] is not None]
    return merge([unsqueeze(r["keys"], True) for r in own], [unsqueeze(r["counts"], False).astype(np.int64) for r in own])


def count_table(docs: DataFrame, deal: Deal) -> DataFrame:
    """Counts of grams and words over ``docs`` (text): one row for each shard and kind, or some for many keys."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[tuple[np.ndarray, np.ndarray]]] = [[], []]

        def flush() -> Iterator[pa.RecordBatch]:
            for kind, parts in enumerate(held):
                keys, counts = merge([p[0] for p in parts], [p[1] for p in parts])
                parts.clear()
                if len(keys):
                    yield _rows(None, kind, keys, counts, deal)

        for batch in batches:
            texts = texts_of(batch.column(0))
            for a, b in chunks(texts):
                for parts, keys in zip(held, _keys(texts[a:b], deal.depth), strict=True):
                    parts.append(counted(keys))
                if sum(len(p[0]) for p in held[0]) > 2 * GATHER:
                    for kind, parts in enumerate(held):
                        held[kind] = [merge([p[0] for p in parts], [p[1] for p in parts])]
                    if len(held[0][0][0]) > GATHER:
                        yield from flush()
        yield from flush()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, rows in _by_shard(batches):
            for kind in (GRAMS, WORDS):
                keys, counts = _table(rows, kind)
                for k in range(0, len(keys), GATHER):
                    part = slice(k, k + GATHER)
                    yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([None], pa.int32()), pa.array([kind], pa.int32()), pa.array([squeeze(keys[part], True)], pa.binary()), pa.array([squeeze(counts[part], False)], pa.binary())], ["shard", "block", "kind", "keys", "counts"])

    return docs.select("text").mapInArrow(count, _ROWS).repartition(deal.shards, "shard").mapInArrow(add, _ROWS)


def _summed(key: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    new, at = np.unique(key, return_inverse=True)
    return new, np.bincount(at, value, len(new))


def top_tree(table: DataFrame, deal: Deal) -> tuple[Tree, int, int]:
    """The contexts of at most one byte and the frequent pairs, from sums over the shards (below 132,000 and 132,000 numbers), the number of words, and of different words."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _by_shard(batches):
            names, keys, values = [], [], []
            for split, tree in deal.trees(*_table(rows, GRAMS)):
                first = 20 * split  # sums for pairs, or for single bytes
                short, total = shorter(*tree.entries)
                for name, key, value in [(8, short, total.astype(np.float64)), *((known, *_summed(*x)) for known, x in enumerate(tree.upward))]:
                    names.append(np.full(len(key), first + name))
                    keys.append(key.astype(np.int64))
                    values.append(value)
            _, words_here = _table(rows, WORDS)
            names.append(np.array([9, 10]))
            keys.append(np.zeros(2, np.int64))
            values.append(np.array([words_here.sum(), len(words_here)], np.float64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(names).astype(np.int32)), pa.array(np.concatenate(keys)), pa.array(np.concatenate(values))], ["name", "key", "value"])

    found = table.repartition(deal.shards, "shard").mapInArrow(sums, "name int, key long, value double").groupBy("name", "key").agg(F.sum("value").alias("value")).toPandas()  # of bounded size

    def part(name: int) -> tuple[np.ndarray, np.ndarray]:
        own = found[found["name"] == name].sort_values("key")
        return own["key"].to_numpy().astype(np.uint64), own["value"].to_numpy()

    keys, counts = part(8)
    below = [part(k) for k in range(8)]
    pairs, pair_counts = part(28)
    levels = []
    if len(pairs):  # what the frequent pairs hand to their single bytes
        two = Tree(pairs, pair_counts.astype(np.int64), 2, 2, [part(20 + k) for k in range(8)])
        levels = two.levels[2]
        below = [_summed(*(np.concatenate(x) for x in zip(a, b, strict=True))) for a, b in zip(below, two.upward, strict=True)]
        keys, counts = merge([keys, (short := shorter(pairs, pair_counts.astype(np.int64)))[0]], [counts.astype(np.int64), short[1]])
    top = Tree(keys, counts.astype(np.int64), 1, 0, below)
    if levels:
        top.levels[2] = levels
    return top, int(part(9)[1].sum()), int(part(10)[1].sum())


def score(docs: DataFrame, folds: int = 10, depth: int = DEPTH) -> DataFrame:
    """Log10 probability of every whole text under the model and under counted words.

    The model learns from rows whose crc32(doc_id as text) mod ``folds`` is not 0. A null text
    counts as empty and a null doc_id as the empty text in that rule; repeated rows each give a
    row and each count; without training rows all bytes are equally likely; an empty table gives
    none; other columns are not read. A context that training never met predicts as the longest
    one that it did meet.
    """
    named = keyed_text(docs, "doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), (crc_remainder("doc_id", folds) == 0).alias("held_out"))
    size = named.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)), F.coalesce(F.sum(F.when(F.col("held_out"), 0).otherwise(1)), F.lit(0))).first()
    shards = max(16, int(size[0]) // SHARD_CHARS)
    training = named.where(~F.col("held_out"))
    deal = Deal(depth, shards, frequent_pairs(training, depth))
    table = cut(count_table(training, deal))
    tree, n_words, n_distinct = top_tree(table, deal)
    n_train = int(size[1])
    total, vocabulary = n_words + n_train, n_distinct + (n_train > 0)
    top = docs.sparkSession.sparkContext.broadcast(tree)
    blocks = block_count(named)
    dealt = named.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int")).repartition(blocks, "block")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[list[np.ndarray]]] = {}
        for batch in batches:
            ids, texts = batch.column(0).to_numpy(zero_copy_only=False), texts_of(batch.column(1))
            for block in np.unique(ids).tolist():
                own = [texts[k] for k in np.flatnonzero(ids == block).tolist()]
                parts = held.setdefault(block, [[], []])
                for a, b in chunks(own):
                    for part, keys in zip(parts, _keys(own[a:b], depth), strict=True):
                        part.append(distinct(keys))
                        if len(part) > 6:
                            part[:] = [distinct(np.concatenate(part))]
        for block in sorted(held):
            for kind, part in enumerate(held.pop(block)):
                keys = distinct(np.concatenate(part))
                if len(keys):
                    yield _rows(block, kind, keys, None, deal)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, rows in _by_shard(batches):
            for kind in (GRAMS, WORDS):
                keys, counts = _table(rows, kind)
                asked = [(r["block"], unsqueeze(r["keys"], True)) for r in rows if r["kind"] == kind and r["block"] is not None]
                if not asked:
                    continue
                wanted = distinct(np.concatenate([a[1] for a in asked]))
                if kind == GRAMS:
                    trees = dict(deal.trees(keys, counts))
                    none = Tree(keys[:0], counts[:0], depth, 2)
                    split, values = deal.is_heavy(wanted), np.empty(len(wanted), np.float32)
                    for part in (False, True):
                        values[split == part] = trees.get(part, none).log_probability(wanted[split == part], top.value)
                else:
                    at = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
                    values = np.where(keys[at] == wanted, counts[at], 0) if len(keys) else np.zeros(len(wanted), np.int64)
                for block, own in asked:
                    mine = values[np.searchsorted(wanted, own)]
                    yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([shard], pa.int32()), pa.array([kind], pa.int32()), pa.array([mine.tobytes() if kind == GRAMS else squeeze(mine, False)], pa.binary())], ["block", "shard", "kind", "found"])

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        texts = texts_of(left.column("text").combine_chunks()) if left.num_rows else []
        seen = []  # of each chunk: its different grams, which of them each byte has, its words
        for a, b in chunks(texts):
            grams = gram_keys(texts[a:b], depth)
            order = np.argsort(grams)
            ordered = grams[order]
            new = np.concatenate(([True], ordered[1:] != ordered[:-1]))
            place = np.empty(len(grams), np.int32)
            place[order] = np.cumsum(new, dtype=np.int32) - 1
            tokens = words(texts[a:b], _INSIDE, lower=True)
            seen.append((ordered[new], place, tokens.hashes(), tokens.first))
        uniques = [[x[0] for x in seen], [x[2] for x in seen]]
        found = {(r["kind"], r["shard"]): r["found"] for r in right.to_pylist()}
        tables = []
        for kind, parts in enumerate(uniques):
            keys = distinct(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)
            order, edges = deal.dealt(keys, kind)
            values = np.zeros(len(keys), np.float64)
            for s in np.flatnonzero(np.diff(edges)).tolist():
                data = found[kind, s]
                values[order[edges[s] : edges[s + 1]]] = np.frombuffer(data, np.float32) if kind == GRAMS else unsqueeze(data, False)
            tables.append((keys, values))
        scores, base, n_tokens, n_known = [], [], [], []
        floor = total + 0.1 * (vocabulary + 1)
        for (a, b), (asked, place, hashes, first) in zip(chunks(texts), seen, strict=True):
            part = texts[a:b]
            logs = tables[0][1][np.searchsorted(tables[0][0], asked)][place]
            sizes = np.fromiter(map(len, part), np.int64, len(part)) + 1
            scores.append(np.add.reduceat(logs, np.cumsum(sizes) - sizes) / math.log(10))
            counts = tables[1][1][np.searchsorted(tables[1][0], hashes)]
            owner = np.repeat(np.arange(len(part)), np.diff(first))
            n = len(part)
            base.append(np.bincount(owner, np.log10((counts + 0.1) / floor), n) + math.log10((n_train + 0.1) / floor))
            n_tokens.append(np.diff(first) + 1)
            n_known.append(np.bincount(owner, counts > 0, n).astype(np.int64) + (n_train > 0))
        join = lambda x, t: pa.array(np.concatenate(x or [np.zeros(0)]).astype(t))
        return pa.table([left.column("doc_id"), left.column("held_out"), join(n_tokens, np.int64), join(n_known, np.int64), pa.array(np.full(left.num_rows, total)), join(base, np.float64), join(scores, np.float64)], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    asked = dealt.select("block", "text").mapInArrow(ask, _ROWS)
    answers = table.unionByName(asked).repartition(shards, "shard").mapInArrow(answer, "block int, shard int, kind int, found binary")
    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(finish, SCHEMA)
