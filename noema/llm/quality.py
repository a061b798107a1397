"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

Score of a document: w0 + sum of w_i x_i + half of the sum over factors of
(sum of v_if x_i)**2 - sum of (v_if x_i)**2, which covers all pairs of features
in time linear in their number. It is learned from a bounded sample of labelled
rows and then applied to every whole text in one pass without a shuffle.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noema.llm.frames import crc_remainder, filter_rows, free_names, map_batches
from noema.llm.words import SPACES, chunks, texts_of, word_table, words

#: Bits of the hash space of words.
WORD_BITS = 17
#: Labelled rows of either label that the fit takes at most; those with the smallest hashes.
SAMPLE = 4000
#: Scores from here on are predicted as label 1.
THRESHOLD = 0.3
FACTORS = 8
SCHEMA = "doc_id long, held_out boolean, score double, predicted int"
_WORD, _LINE = word_table(separators=SPACES), word_table(separators=b"\n\r")
#: Kinds of bytes whose shares are statistics.
_KINDS = [
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    b"0123456789",
    b".,;:",
    b"!?",
    b"#$%&*+=@^~",
    b"|/\\_-",
    b"<>[]{}()\"'`",
    b"\n",
    bytes(range(128, 256)),
]
_KIND = np.zeros(256, np.int64)
for _n, _members in enumerate(_KINDS):
    _KIND[list(_members)] = _n + 1
#: Bins of one statistic, and how many statistics there are.
BINS, STATISTICS = 24, len(_KINDS) + 9
WIDTH = (1 << WORD_BITS) + BINS * STATISTICS


class Rows(NamedTuple):
    """Sparse rows: features ``index`` with ``value``; row k has those from ``first[k]`` to ``first[k + 1]``."""

    first: np.ndarray
    index: np.ndarray
    value: np.ndarray


def _distinct(keys: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owners and counts of the different keys of each owner, and the keys."""
    order = np.lexsort((keys, owner))
    keys, owner = keys[order], owner[order]
    new = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])))) if len(keys) else np.zeros(0, np.int64)
    return owner[new], np.diff(np.append(new, len(keys))), keys[new]


def features(texts: list[bytes], declared: np.ndarray) -> Rows:
    """Features of whole texts; ``declared``: the metadata's number of characters, negative if unknown.

    Every word's weight is the square root of its count, all of a text's words together
    have length one. A statistic marks one of its bins. A text without words has its
    statistics only.
    """
    n = len(texts)
    tokens = words(texts, _WORD)
    owner = tokens.owner()
    counts = np.diff(tokens.first)
    size = np.fromiter(map(len, texts), np.int64, n)
    lower = words(texts, _WORD, lower=True)
    word_owner, times, key = _distinct(lower.hashes() >> np.uint64(64 - WORD_BITS), owner)
    weight = np.sqrt(times)
    norm = np.sqrt(np.maximum(np.bincount(word_owner, times, n), 1e-9))
    weight /= norm[word_owner]

    begin = np.concatenate(([0], np.cumsum(size + 1)))
    kinds = np.zeros((n, len(_KINDS) + 1))
    codes = _KIND[tokens.data]
    for k in range(1, len(_KINDS) + 1):
        total = np.concatenate(([0], np.cumsum(codes == k)))
        kinds[:, k] = total[begin[1:] - 1] - total[begin[:-1]]
    some = np.maximum(size, 1)
    lines = words(texts, _LINE)
    line_owner, line_times, _ = _distinct(lines.hashes(), lines.owner())
    n_lines = np.maximum(np.diff(lines.first), 1)
    length = tokens.ends - tokens.starts
    many = np.maximum(counts, 1)
    by_owner = lambda values: np.bincount(owner, values, n)
    top = np.zeros(n)
    np.maximum.at(top, word_owner, times)
    longest = np.zeros(n)
    np.maximum.at(longest, owner, length)
    ends = tokens.data[tokens.ends - 1] if len(tokens.ends) else np.zeros(0, np.uint8)
    firsts = tokens.data[tokens.starts] if len(tokens.starts) else np.zeros(0, np.uint8)
    shares = [kinds[:, k] / some for k in range(1, len(_KINDS) + 1)]
    shares += [
        np.bincount(word_owner, minlength=n) / many,
        top / many,
        np.bincount(line_owner, minlength=n) / n_lines,
        by_owner(np.isin(ends, np.frombuffer(b"!*#$%&|", np.uint8))) / many,
        by_owner((firsts >= 65) & (firsts <= 90)) / many,
    ]
    logs = [np.log2(1 + by_owner(length) / many) * 4, np.log2(1 + longest) * 2, np.log2(1 + counts) * 1.5, np.where(declared < 0, -1, np.log2(1 + np.maximum(declared, 0)) * 1.3) + 1]
    bins = [np.round(np.sqrt(np.clip(s, 0, 1)) * (BINS - 1)) for s in shares] + [np.clip(np.round(x), 0, BINS - 1) for x in logs]
    marks = np.stack([np.asarray(b, np.int64) + (1 << WORD_BITS) + BINS * k for k, b in enumerate(bins)], axis=1)
    owners = np.concatenate([word_owner, np.repeat(np.arange(n), STATISTICS)])
    index = np.concatenate([key.astype(np.int64), marks.ravel()])
    value = np.concatenate([weight, np.full(marks.size, 0.5)])
    order = np.argsort(owners, kind="stable")
    return Rows(np.concatenate(([0], np.cumsum(np.bincount(owners, minlength=n)))), index[order].astype(np.int32), value[order].astype(np.float32))


class Model(NamedTuple):
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def raw(self, rows: Rows) -> np.ndarray:
        """Log-odds of label 1."""
        if not len(rows.index):
            return np.full(len(rows.first) - 1, self.bias)
        at = rows.first[:-1]
        step = self.factors[rows.index] * rows.value[:, None]
        sums = np.add.reduceat(step, at, axis=0)
        squares = np.add.reduceat((step * step).sum(1), at)
        return self.bias + np.add.reduceat(self.linear[rows.index] * rows.value, at) + 0.5 * ((sums * sums).sum(1) - squares)


def fit(rows: Rows, labels: np.ndarray, epochs: int = 12, batch: int = 32, rate: float = 0.15, decay: float = 1e-5, seed: int = 1) -> Model:
    """Logistic loss by AdaGrad over small batches; a model without rows, or of one label only, is its bias."""
    rng = np.random.default_rng(seed)
    share = (labels.sum() + 1) / (len(labels) + 2)
    linear, factors = np.zeros(WIDTH, np.float32), rng.normal(0, 0.05, (WIDTH, FACTORS)).astype(np.float32)
    bias = float(np.log(share / (1 - share)))
    if labels.min(initial=1) == labels.max(initial=0):
        return Model(bias, linear, np.zeros((WIDTH, FACTORS), np.float32))
    g_linear, g_factors, g_bias = np.full(WIDTH, 1e-2, np.float32), np.full((WIDTH, FACTORS), 1e-2, np.float32), 1e-2
    size = np.diff(rows.first)
    for _ in range(epochs):
        turn = rng.permutation(len(labels))
        for begin in range(0, len(turn), batch):
            pick = turn[begin : begin + batch]
            n = size[pick]
            first = np.concatenate(([0], np.cumsum(n)))
            slot = np.repeat(rows.first[pick] - first[:-1], n) + np.arange(first[-1])
            index, value = rows.index[slot], rows.value[slot]
            own = np.repeat(np.arange(len(pick)), n)
            v = factors[index] * value[:, None]
            sums = np.add.reduceat(v, first[:-1], axis=0)
            raw = bias + np.add.reduceat(linear[index] * value, first[:-1]) + 0.5 * ((sums * sums).sum(1) - np.add.reduceat((v * v).sum(1), first[:-1]))
            error = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - labels[pick]).astype(np.float32)
            seen, at = np.unique(index, return_inverse=True)
            order = np.argsort(at, kind="stable")
            edges = np.searchsorted(at[order], np.arange(len(seen)))
            step = error[own] * value
            grad = np.add.reduceat(step[order], edges) + decay * linear[seen]
            grads = np.add.reduceat((step[:, None] * (sums[own] - v))[order], edges, axis=0) + decay * factors[seen]
            g_linear[seen] += grad * grad
            g_factors[seen] += grads * grads
            linear[seen] -= rate * grad / np.sqrt(g_linear[seen])
            factors[seen] -= 0.3 * rate * grads / np.sqrt(g_factors[seen])
            g_bias += float(error.mean()) ** 2
            bias -= 0.2 * rate * float(error.mean()) / g_bias**0.5
    return Model(bias, linear, factors)


def _inputs(docs: DataFrame) -> DataFrame:
    size = docs["n_chars"].cast("long") if "n_chars" in docs.columns else F.lit(None).cast("long")
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"), F.coalesce(size, F.lit(-1)).alias("declared"))


def train(docs: DataFrame, labels: DataFrame, folds: int = 5, sample: int = SAMPLE) -> Model:
    """Fits on at most ``sample`` rows of each label whose crc32(doc_id as text) mod ``folds`` is not 0.

    Rows without a label of 0 or 1 are left out; labels that repeat count once, and a
    doc_id with both labels is left out. Of documents with one id, that with the smallest text
    (a null one first) is learned from. What the bound does to the share of the labels is
    undone: the bias moves by the log of how much scarcer a label is in the sample.
    """
    known = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels["quality"].cast("int").alias("quality")).where("quality in (0, 1) and doc_id is not null")
    known = known.where(crc_remainder("doc_id", folds) != 0).groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("other")).where("quality = other")
    there = {r[0]: r[1] for r in known.groupBy("quality").count().collect()}
    scarcer = [max(1.0, there.get(label, 0) / sample) for label in (0, 1)]
    picked = known.where("quality = 0").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).unionAll(known.where("quality = 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)).select("doc_id", "quality")
    # 2 * sample rows at most
    chosen = _inputs(docs).join(F.broadcast(picked), "doc_id").groupBy("doc_id", "quality").agg(F.min(F.struct("text", "declared")).alias("row")).select("doc_id", "quality", "row.*")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [features([t], np.array([d])) for t, d in zip(texts_of(batch.column("text")), batch.column("declared").to_pylist(), strict=True)]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), pa.array([r.index.tobytes() for r in rows], pa.binary()), pa.array([r.value.tobytes() for r in rows], pa.binary())], ["doc_id", "quality", "index", "value"])

    found = sorted(map_batches(chosen.select("doc_id", "text", "declared", "quality"), run, "doc_id long, quality int, index binary, value binary").collect())
    index = [np.frombuffer(r[2], np.int32) for r in found]
    value = [np.frombuffer(r[3], np.float32) for r in found]
    first = np.concatenate(([0], np.cumsum([len(i) for i in index]))).astype(np.int64)
    model = fit(Rows(first, np.concatenate(index or [np.zeros(0, np.int32)]), np.concatenate(value or [np.zeros(0, np.float32)])), np.array([r[1] for r in found], np.float32))
    return model._replace(bias=model.bias + float(np.log(scarcer[1] / scarcer[0])))


def _scores(model: Model, texts: list[bytes], declared: np.ndarray) -> np.ndarray:
    raw = np.concatenate([model.raw(features(texts[a:b], declared[a:b])) for a, b in chunks(texts)])
    return 1 / (1 + np.exp(-np.clip(raw.astype(np.float64), -30, 30)))


def accepted(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The documents, all columns, that score ``threshold`` or more.

    A null text counts as empty and is scored by its statistics; repeated rows stay or go
    together; an empty table gives none; columns may have any names and keep their nulls.
    """
    [declared] = free_names(docs, "declared")
    sent = docs.sparkSession.sparkContext.broadcast(model)
    size = F.coalesce(docs["n_chars"].cast("long"), F.lit(-1)) if "n_chars" in docs.columns else F.lit(-1).cast("long")

    def keep(batch: pa.RecordBatch) -> np.ndarray:
        return _scores(sent.value, texts_of(batch.column("text")), batch.column(declared).to_numpy(zero_copy_only=False)) >= threshold

    return filter_rows(docs.withColumn(declared, size), keep, declared)


def score(docs: DataFrame, model: Model, folds: int = 5, threshold: float = THRESHOLD) -> DataFrame:
    """Scores of every whole text: doc_id, held_out, score (0 to 1), predicted (1 from ``threshold`` on).

    A null text counts as empty and is scored by its statistics; a null doc_id stays null
    and its fold is that of the empty text; repeated rows each give a row; an empty table
    gives none; only doc_id, text and n_chars (where there is one) are read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # WIDTH * (FACTORS + 1) numbers

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, declared = texts_of(batch.column(1)), batch.column(2).to_numpy(zero_copy_only=False)
        p = _scores(sent.value, texts, declared)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array((p >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    scored = map_batches(_inputs(docs), run, "doc_id long, score double, predicted int")
    return scored.select("doc_id", (crc_remainder("doc_id", folds) == 0).alias("held_out"), "score", "predicted")


def classify(docs: DataFrame, labels: DataFrame, folds: int = 5, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """``train`` and ``score`` over the same documents."""
    return score(docs, train(docs, labels, folds, sample), folds, threshold)
