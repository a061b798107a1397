"""Substring dedup with an FM-index for each shard.

A window is a run of consecutive words. Equal windows have the same smallest
8-gram hash, so consecutive windows with the same one form a segment, and
segments go to the shard of that hash: whatever repeats, repeats within one
shard, and the work grows with the text. Words travel as 12-bit symbols. A shard
builds an FM-index of its segments (but those whose hash no other segment has),
streams them through backward search, and takes the stretches whose matching
statistics say that they occur twice. What the index reports, and nothing else, is
confirmed by a 16-bit check of each window, which tells words with the same symbol
apart. A hash with very many segments is dealt out window by window; equal
segments of one batch are sent once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noema.llm.fm_index import FmIndex, repeated_windows
from noema.llm.frames import cut, document_name, free_names, keyed_text, map_batches
from noema.llm.words import SPACES, chunks, grams, mix, powers, smallest, texts_of, word_table, words

SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string"
WINDOW, ANCHOR = 35, 8
#: Segments of a shard, and of one hash from which it is dealt out by window (more for large inputs, so that the list of such hashes stays below HOT_LIST).
SHARD, HOT, HOT_LIST = 50_000, 5_000, 100_000
_INSIDE = word_table(separators=SPACES)
_COLUMNS = ["docs", "starts", "refs", "keys", "counts", "twice", "symbols", "checks"]
_PACKED = "shard int, " + ", ".join(f"{c} binary" for c in _COLUMNS)
_PIECE = np.dtype([("hash", "<i8"), ("low", "<i4")])


def _segments(texts: list[bytes], window: int, anchor: int, most: int = 255) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, the text of each segment, its first word (in all words and in its text), its number of windows (``most`` at the most), and its key."""
    tokens = words(texts, _INSIDE)
    h, owner = tokens.hashes(), tokens.owner()
    none = np.zeros(0, np.int64)
    if len(h) < window:
        return h, none, none, none, none, none.astype(np.uint64)
    low = smallest(grams(h, anchor), window - anchor + 1)
    at = np.flatnonzero(owner[: len(low)] == owner[window - 1 :])
    if not len(at):
        return h, none, none, none, none, none.astype(np.uint64)
    new = np.concatenate(([True], (np.diff(at) > 1) | (low[at[1:]] != low[at[:-1]]) | (owner[at[1:]] != owner[at[:-1]])))
    begin = np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
    new |= (np.arange(len(at)) - begin) % most == 0
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(at)))
    place = at[first]
    return h, owner[place], place, place - tokens.first[owner[place]], count, low[place]


def _ragged(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The numbers from each begin on, ``count`` of them, one range after the other."""
    return np.repeat(begin - np.cumsum(count) + count, count) + np.arange(count.sum())


def _sums(values: np.ndarray, count: np.ndarray) -> np.ndarray:
    """A hash of each range of 64-bit hashes; ranges follow one another."""
    place = np.arange(len(values)) - np.repeat(np.cumsum(count) - count, count)
    up, _ = powers(int(count.max(initial=1)) + 1)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values * up[place])))
    ends = np.cumsum(count)
    return mix(total[ends] - total[ends - count] + count.astype(np.uint64))


def _pack(symbols: np.ndarray) -> bytes:
    """Symbols of 12 bits, two in three bytes."""
    pairs = (np.append(symbols, 0) if len(symbols) % 2 else symbols).reshape(-1, 2)
    out = np.empty((len(pairs), 3), np.uint8)
    out[:, 0], out[:, 1], out[:, 2] = pairs[:, 0] >> 4, (pairs[:, 0] & 15) << 4 | pairs[:, 1] >> 8, pairs[:, 1] & 255
    return out.tobytes()


def _unpack(data: bytes, n: int) -> np.ndarray:
    three = np.frombuffer(data, np.uint8).reshape(-1, 3).astype(np.uint16)
    out = np.empty((len(three), 2), np.uint16)
    out[:, 0], out[:, 1] = three[:, 0] << 4 | three[:, 1] >> 4, (three[:, 1] & 15) << 8 | three[:, 2]
    return out.ravel()[:n]


def _key_counts(docs: DataFrame, shards: int, window: int, anchor: int, least: int) -> DataFrame:
    """For each shard, the number of its segments and the keys that many of them have: total long, key long, count long."""

    def send(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        texts = texts_of(batch.column(1))
        found = [np.unique(_segments(texts[a:b], window, anchor)[5], return_counts=True) for a, b in chunks(texts)]
        keys, counts = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
        shard = (keys % np.uint64(shards)).astype(np.int32)
        order = np.argsort(shard, kind="stable")
        edges = np.searchsorted(shard[order], np.arange(shards + 1))
        keys, counts = keys[order], counts[order].astype(np.int32)
        some = np.flatnonzero(np.diff(edges))
        return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([keys[edges[s] : edges[s + 1]].tobytes() for s in some], pa.binary()), pa.array([counts[edges[s] : edges[s + 1]].tobytes() for s in some], pa.binary())], ["shard", "keys", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in batches:
            keys = np.concatenate([keys, *(np.frombuffer(b, np.uint64) for b in batch.column(1).to_pylist())])
            counts = np.concatenate([counts, *(np.frombuffer(b, np.int32) for b in batch.column(2).to_pylist())])
            keys, at = np.unique(keys, return_inverse=True)
            counts = np.bincount(at, counts, len(keys)).astype(np.int64)
        many = np.flatnonzero(counts > least)
        yield pa.RecordBatch.from_arrays([pa.array([counts.sum()], pa.int64()), pa.array([None], pa.int64()), pa.array([0], pa.int64())], ["total", "key", "count"])
        yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(many), np.int64)), pa.array(keys[many].view(np.int64)), pa.array(counts[many])], ["total", "key", "count"])

    return map_batches(docs.select("hash", "text"), send, "shard int, keys binary, counts binary").repartition(shards, "shard").mapInArrow(add, "total long, key long, count long")


def _send(docs: DataFrame, shards: int, window: int, anchor: int, hot) -> DataFrame:
    """Segments packed by batch and shard: for each one its document, first word and the number (``refs``) of its text, each text once with its key, number of windows, whether it is there twice or more, symbols, and checks of its windows."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        texts = texts_of(batch.column(2))
        names = np.empty(batch.num_rows, _PIECE)
        names["hash"], names["low"] = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
        parts = []
        for a, b in chunks(texts):
            h, doc, place, start, count, key = _segments(texts[a:b], window, anchor)
            if not len(key):
                continue
            checks = grams(h, window)
            crowded = np.isin(key, hot.value) if len(hot.value) else np.zeros(len(key), bool)
            if crowded.any():  # one segment for each window, under a key of its own
                calm, n = ~crowded, count[crowded]
                place2 = _ragged(place[crowded], n)
                start2 = _ragged(start[crowded], n)
                doc, place, start = np.concatenate([doc[calm], np.repeat(doc[crowded], n)]), np.concatenate([place[calm], place2]), np.concatenate([start[calm], start2])
                count, key = np.concatenate([count[calm], np.ones(len(place2), np.int64)]), np.concatenate([key[calm], mix(checks[place2] ^ np.uint64(1))])
            whole = mix(_sums(checks[_ragged(place, count)], count) + key * np.uint64(0x9E3779B97F4A7C15))
            _, first, at, times = np.unique(whole, return_index=True, return_inverse=True, return_counts=True)
            place, count, key = place[first], count[first], key[first]
            symbols = ((h >> np.uint64(52)) % np.uint64(4095)).astype(np.uint16) + np.uint16(1)
            parts.append((at, names[a + doc], start.astype(np.int32), key, count.astype(np.uint8), times > 1, symbols[_ragged(place, count + window - 1)], checks[_ragged(place, count)].astype(np.uint16)))
        if not parts:
            return None
        before = np.cumsum([0, *(len(p[3]) for p in parts)])
        at = np.concatenate([p[0] + n for p, n in zip(parts, before, strict=False)])
        name, start, key, count, twice, symbols, checks = (np.concatenate(x) for x in list(zip(*parts, strict=True))[1:])
        shard = (key % np.uint64(shards)).astype(np.int32)
        order = np.argsort(shard, kind="stable")
        number = np.empty(len(order), np.int64)
        number[order] = np.arange(len(order))
        edges = np.searchsorted(shard[order], np.arange(shards + 1))
        pieces = np.argsort(shard[at], kind="stable")
        piece_edges = np.searchsorted(shard[at[pieces]], np.arange(shards + 1))
        n = count.astype(np.int64)
        symbols = symbols[_ragged((np.cumsum(n + window - 1) - (n + window - 1))[order], n[order] + window - 1)]
        checks = checks[_ragged((np.cumsum(n) - n)[order], n[order])]
        to_check = np.concatenate(([0], np.cumsum(n[order])))
        to_symbol = to_check + (window - 1) * np.arange(len(n) + 1)
        some = [int(s) for s in np.flatnonzero(np.diff(edges))]
        cuts, own = [slice(edges[s], edges[s + 1]) for s in some], [pieces[piece_edges[s] : piece_edges[s + 1]] for s in some]
        columns = [[name[p].tobytes() for p in own], [start[p].tobytes() for p in own], [(number[at[p]] - c.start).astype(np.int32).tobytes() for p, c in zip(own, cuts, strict=True)]]
        columns += [[x[order[c]].tobytes() for c in cuts] for x in (key, count, twice)]
        columns.append([_pack(symbols[to_symbol[c.start] : to_symbol[c.stop]]) for c in cuts])
        columns.append([checks[to_check[c.start] : to_check[c.stop]].tobytes() for c in cuts])
        return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), *(pa.array(c, pa.binary()) for c in columns)], ["shard", *_COLUMNS])

    return map_batches(docs.select("hash", "low", "text"), run, _PACKED)


def _search(rows: list[dict], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names of documents and word ranges (begin, end) that repeated windows of one shard cover."""
    read = lambda c, t: np.concatenate([np.frombuffer(r[c], t) for r in rows])
    name, start, ref, key, n = read("docs", _PIECE), read("starts", np.int32), read("refs", np.int32).astype(np.int64), read("keys", np.uint64), read("counts", np.uint8).astype(np.int64)
    texts = np.cumsum([0, *(len(r["counts"]) for r in rows)])
    ref += np.repeat(texts[:-1], [len(r["refs"]) // 4 for r in rows])
    times = read("twice", np.bool_).astype(np.int64) + 1
    checks = read("checks", np.uint16).astype(np.uint64)
    symbols = np.concatenate([_unpack(r["symbols"], int(n[a:b].sum() + (window - 1) * (b - a))) for r, a, b in zip(rows, texts, texts[1:], strict=False)])
    at_check, at_symbol = np.cumsum(n) - n, np.cumsum(n + window - 1) - (n + window - 1)
    check = mix(checks ^ (np.repeat(key, n) << np.uint64(16)))
    # texts of batches that are the same one
    whole = mix(_sums(check, n) + key + mix(_sums(symbols.astype(np.uint64), n + window - 1)))
    _, first, same = np.unique(whole, return_index=True, return_inverse=True)
    total = np.minimum(np.bincount(same, times).astype(np.int64), 2)
    # what no other text has the key of can only repeat within itself
    _, by_key, sharing = np.unique(key[first], return_inverse=True, return_counts=True)
    stay = (sharing[by_key] > 1) | (total > 1)
    order = np.argsort(check)
    again = check[order[1:]] == check[order[:-1]]
    stay[same[np.repeat(np.arange(len(n)), n)[order[1:][again]]]] = True
    only = np.flatnonzero(stay)
    if not len(only):
        return np.zeros(0, _PIECE), np.zeros(0, np.int64), np.zeros(0, np.int64)
    text_of, m = first[only], n[first[only]]
    # all texts, each ended by 0; what is there more than once is in the index twice
    long, copies = m + window - 1, total[only] > 1
    begin = np.cumsum(long + 1) - (long + 1)
    size = int((long + 1).sum())
    text = np.zeros(size + int((long + 1)[copies].sum()), np.uint16)
    text[_ragged(begin, long)] = symbols[_ragged(at_symbol[text_of], long)]
    text[size:] = text[_ragged(begin[copies], long[copies] + 1)]
    marked = repeated_windows(FmIndex(text), text, begin, begin + long, window)[_ragged(begin, m)]
    found = _confirmed(marked, check[_ragged(at_check[text_of], m)], np.repeat(total[only], m))
    # runs of found windows in each text, and these in every place that has the text
    owner = np.repeat(np.arange(len(only)), m)
    hit = np.flatnonzero(found)
    new = np.concatenate(([True], (np.diff(hit) > 1) | (owner[hit[1:]] != owner[hit[:-1]])))[: len(hit)]
    last = np.concatenate((np.flatnonzero(new)[1:] - 1, [len(hit) - 1])) if len(hit) else np.zeros(0, np.int64)
    inside = np.arange(len(owner)) - np.repeat(np.cumsum(m) - m, m)
    run_begin, run_end, run_owner = inside[hit[new]], inside[hit[last]] + window, owner[hit[new]]
    slot = np.full(len(first), -1)
    slot[only] = np.arange(len(only))
    runs_from = np.searchsorted(run_owner, np.arange(len(only) + 1))
    mine = slot[same[ref]]
    piece = np.flatnonzero(mine >= 0)
    runs = np.diff(runs_from)[mine[piece]]
    each, run = np.repeat(piece, runs), _ragged(runs_from[mine[piece]], runs)
    return name[each], start[each] + run_begin[run], start[each] + run_end[run]


def _confirmed(marked: np.ndarray, check: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Windows that the index reports and whose checks are equal to those of another reported one: two words of 4095 have the same symbol."""
    found = marked.copy()
    _, slot = np.unique(check[marked], return_inverse=True)
    found[marked] = np.bincount(slot, times[marked])[slot] > 1
    return found


def repeated_spans(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, hot_from: int = HOT) -> DataFrame:
    """Word ranges covered by repeated windows: hash long, low int (both name the document), begin int, end int. ``docs``: hash, low, text."""
    spark = docs.sparkSession
    size = docs.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = max(least, int(size) // (80 * SHARD))  # a segment starts about every 80 characters
    counted = cut(_key_counts(docs, shards, window, anchor, hot_from))
    total = counted.agg(F.coalesce(F.sum("total"), F.lit(0))).first()[0]
    keys = [r[0] for r in counted.where((F.col("count") > max(hot_from, total // HOT_LIST)) & F.col("key").isNotNull()).select("key").collect()]
    hot = spark.sparkContext.broadcast(np.sort(np.array(keys, np.int64).view(np.uint64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards_here: dict[int, list[dict]] = {}
        for batch in batches:
            for row in batch.to_pylist():
                shards_here.setdefault(row["shard"], []).append(row)
        for shard in sorted(shards_here):
            name, begin, end = _search(shards_here.pop(shard), window)
            for k in range(0, len(name), 50_000):
                part = slice(k, k + 50_000)
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(name["hash"][part])), pa.array(np.ascontiguousarray(name["low"][part])), pa.array(begin[part].astype(np.int32)), pa.array(end[part].astype(np.int32))], ["hash", "low", "begin", "end"])

    return _send(docs, shards, window, anchor, hot).repartition(shards, "shard").mapInArrow(run, "hash long, low int, begin int, end int")


def dedup(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, keep_text: bool = False, hot_from: int = HOT) -> DataFrame:
    """Removes from every text the words covered by a window of ``window`` words that also starts anywhere else.

    Returns doc_id, n_words, n_removed, kept_sha256, and the kept words joined by one space
    with ``keep_text``. A null text has no words; texts shorter than a window keep all;
    rows that repeat are each other's copies and each give a row; null doc_ids are rows like
    others; an empty table gives none; other columns are not read.
    """
    docs = keyed_text(docs, "doc_id", "text")
    hash_, low = document_name(docs)
    named = docs.select("doc_id", "text", hash_.alias("hash"), low.alias("low"))
    spans = repeated_spans(named, window, anchor, hot_from).groupBy("hash", "low").agg(F.collect_list("begin").alias("begins"), F.collect_list("end").alias("ends"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts, gone, digests, kept_texts = [], [], [], []
        begins, ends = batch.column(2), batch.column(3)
        for k, text in enumerate(texts_of(batch.column(1))):
            parts = text.split()
            kept = parts
            if begins[k].is_valid:
                change = np.zeros(len(parts) + 1, np.int64)
                np.add.at(change, begins[k].values.to_numpy(), 1)
                np.add.at(change, ends[k].values.to_numpy(), -1)
                kept = [parts[j] for j in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]
            joined = b" ".join(kept)
            counts.append(len(parts))
            gone.append(len(parts) - len(kept))
            digests.append(hashlib.sha256(joined).hexdigest())
            if keep_text:
                kept_texts.append(joined.decode())
        columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(gone, pa.int64()), pa.array(digests, pa.string())]
        return pa.RecordBatch.from_arrays(columns + [pa.array(kept_texts, pa.string())] * keep_text, ["doc_id", "n_words", "n_removed", "kept_sha256"] + ["text"] * keep_text)

    joined = named.join(spans, ["hash", "low"], "left").select("doc_id", "text", "begins", "ends")
    return map_batches(joined, run, SCHEMA + ", text string" * keep_text)


def rewrite(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """The documents, all columns, without repeated windows: a text that loses words is the others joined by one space (and n_chars its length, where there is that column); other texts stay as they are.

    A null text stays null; repeated rows are each other's copies and each give a row; an
    empty table gives none; columns may have any names.
    """
    hash_, low, begins_, ends_ = free_names(docs, "hash", "low", "begins", "ends")
    named = docs.withColumns(dict(zip((hash_, low), document_name(docs), strict=True)))
    spans = repeated_spans(named.select(F.col(hash_).alias("hash"), F.col(low).alias("low"), F.col("text").cast("string").alias("text")), window, anchor).groupBy(F.col("hash").alias(hash_), F.col("low").alias(low)).agg(F.collect_list("begin").alias(begins_), F.collect_list("end").alias(ends_))
    schema = docs.schema
    sized = "n_chars" in docs.columns

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        begins, ends = batch.column(begins_), batch.column(ends_)
        texts = batch.column("text").to_pylist()
        sizes = batch.column("n_chars").to_pylist() if sized else []
        for k, text in enumerate(texts):
            if text is not None and begins[k].is_valid:
                parts = text.encode().split()
                change = np.zeros(len(parts) + 1, np.int64)
                np.add.at(change, begins[k].values.to_numpy(), 1)
                np.add.at(change, ends[k].values.to_numpy(), -1)
                texts[k] = b" ".join([parts[j] for j in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]).decode()
                if sized:
                    sizes[k] = len(texts[k])
        new = {"text": texts, "n_chars": sizes}
        columns = [pa.array(new[f], batch.column(f).type) if f == "text" or sized and f == "n_chars" else batch.column(f) for f in schema.names]
        return pa.RecordBatch.from_arrays(columns, schema.names)

    joined = named.join(spans, [hash_, low], "left").select(*docs.columns, begins_, ends_)
    return map_batches(joined, run, schema)


def brute_force(texts: list[str | None], window: int = WINDOW) -> list[tuple[int, int, str]]:
    """The definition: number of words, of removed words, digest of the kept words."""
    split = [(t or "").encode().split() for t in texts]
    seen: dict[tuple, int] = {}
    for parts in split:
        for k in range(len(parts) - window + 1):
            run = tuple(parts[k : k + window])
            seen[run] = seen.get(run, 0) + 1
    out = []
    for parts in split:
        gone = set()
        for k in range(len(parts) - window + 1):
            if seen[tuple(parts[k : k + window])] > 1:
                gone.update(range(k, k + window))
        out.append((len(parts), len(gone), hashlib.sha256(b" ".join(p for j, p in enumerate(parts) if j not in gone)).hexdigest()))
    return out
