"""SimHash near-duplicates by anchor-point covering.

The 64 bits of a fingerprint are cut into blocks; of two fingerprints at four
or fewer differing bits, some block differs in at most four divided by the
number of blocks. In each block the anchors are a covering code: fifteen bits
take the perfect Hamming code (every word is at most one bit from one of 2048
code words), the block's other bits stand for themselves. A fingerprint lives
at its nearest anchor and is copied to every anchor within the covering radius
plus the block's share of the threshold, so each linked pair meets where one
of the two lives. Only there are fingerprints compared.

Near copies (Jaccard of the five-word shingles 0.8 or more) differ in about 15 %
of the bits, too many for blocks of 64. For them a text has a fingerprint of 512
bits, and lives at its nearest anchor in each of 96 blocks drawn from these bits.
Texts that meet and are close enough are candidates; the pairs of each
component of candidates are confirmed by their shingles.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noema.llm.frames import cut, free_names, keyed_text, map_batches
from noema.llm.graph import components, forest
from noema.llm.words import chunks, mix, texts_of

SEED = 42
#: Fingerprints that live at one anchor before it is split; for large inputs a share of all fingerprints, so that the list of split anchors stays below 3 * SHARE.
CROWD, SHARE = 4096, 65_536
#: Pairs that are compared at a time.
PAIRS = 2_000_000
#: Fingerprints that a task of the comparison gets on average.
TASK_ROWS = 1_500_000
#: Near copies: 64-bit words of a fingerprint and blocks drawn from it; bits that may differ in the first two words and in all (mean of pairs at Jaccard 0.8 plus three and four deviations).
WIDE, DRAWN, CLOSE_TWO, CLOSE_ALL = 8, 96, 32, 110
#: Characters of text of a chunk whose pairs one task confirms, and texts that are looked up by a broadcast of their names at most.
CHUNK_CHARS, SENT = 2_000_000, 200_000


def hamming_table() -> np.ndarray:
    """The number (0 to 2047) of the nearest code word of the [15, 11] Hamming code, for every word of 15 bits."""
    word = np.arange(1 << 15)
    syndrome = np.zeros(1 << 15, np.int64)
    for bit in range(15):
        syndrome ^= np.where(word >> bit & 1, bit + 1, 0)
    nearest = np.where(syndrome > 0, word ^ (1 << np.maximum(syndrome - 1, 0)), word)
    return np.unique(nearest, return_inverse=True)[1]


class Cover:
    """Anchors of every block. ``blocks`` 3: up to one bit differs in some block of 21 or 22 bits; 2: up to two bits in some half."""

    def __init__(self, threshold: int, blocks: int):
        self.table = hamming_table()
        width = -(-64 // blocks)
        self.parts = [(low, min(width, 64 - low)) for low in range(0, 64, width)]
        self.share = threshold // blocks

    def copies(self) -> int:
        """Anchors that a fingerprint goes to in all, rounded up from the mean of some random ones."""
        some = np.random.default_rng(SEED).integers(0, 1 << 63, 200, np.uint64)
        return -(-sum(len(self.near(some, b)[0]) for b in range(len(self.parts))) // len(some))

    def home(self, fp: np.ndarray, block: int) -> np.ndarray:
        """The nearest anchor's number in a block, the block's number in the highest bits."""
        low, width = self.parts[block]
        bits = (fp >> np.uint64(low) & np.uint64((1 << width) - 1)).astype(np.int64)
        return block << 40 | bits >> 15 << 11 | self.table[bits & 0x7FFF]

    def near(self, fp: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers and the different anchors at which those fingerprints may have a partner's home."""
        low, width = self.parts[block]
        flips = [sum(1 << low + b for b in bits) for k in range(self.share + 1) for bits in itertools.combinations(range(width), k)]
        all_ = np.stack([self.home(fp ^ np.uint64(f), block) for f in flips], axis=1)
        all_.sort(axis=1)
        first = np.ones(all_.shape, bool)
        first[:, 1:] = all_[:, 1:] != all_[:, :-1]
        return np.nonzero(first)[0], all_[first]


def shingles(text: bytes, k: int) -> list[int]:
    """Hashes of the k-word shingles of a text; fewer words are one shingle."""
    digest, parts = xxhash.xxh64_intdigest, text.lower().split()
    joined = b" ".join(parts)
    if len(parts) <= k:
        return [digest(joined, SEED)] if parts else []
    stops = list(itertools.accumulate([len(p) + 1 for p in parts]))
    return [digest(joined[a : b - 1], SEED) for a, b in zip([0, *stops], stops[k - 1 :], strict=False)]


def fingerprints(texts: list[bytes], k: int = 4) -> np.ndarray:
    """SimHash of the k-word shingles of each text."""
    out = np.zeros(len(texts), np.uint64)
    for begin, end in chunks(texts):
        hashes, counts = [], []
        for text in texts[begin:end]:
            own = shingles(text, k)
            hashes += own
            counts.append(len(own))
        n = np.array(counts)
        some = np.flatnonzero(n)
        if not len(some):
            continue
        firsts = np.cumsum(n[some]) - n[some]
        bits = np.unpackbits(np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, firsts, axis=0, dtype=np.int32) * 2 > n[some][:, None]
        out[begin + some] = np.packbits(ones, axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


def fingerprint_table(docs: DataFrame, k: int = 4) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(fingerprints(texts_of(batch.column(1)), k).view(np.int64))], ["doc_id", "fp"])

    return map_batches(keyed_text(docs, "doc_id", "text"), run, "doc_id long, fp long")


def links(distinct: DataFrame, threshold: int = 4, crowd: int = CROWD, blocks: int | None = None) -> DataFrame:
    """Edges (a, b) that connect the different fingerprints ``fp`` at ``threshold`` or fewer differing bits.

    Of the pairs found at the anchors of one task, only a spanning forest goes
    on, so copies of copies don't make a row for each pair. An anchor at which
    more than ``crowd`` fingerprints live is split: each lives in one part,
    visitors go to all parts.
    """
    spark = distinct.sparkSession
    total = distinct.count()
    cover = Cover(threshold, blocks or (3 if total < 50_000_000 else 2))
    crowd = max(crowd, total // SHARE)

    def homes(batch: pa.RecordBatch) -> pa.RecordBatch:
        fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([cover.home(fp, b) for b in range(len(cover.parts))]))], ["key"])

    crowded = map_batches(distinct.select("fp"), homes, "key long").groupBy("key").count().where(F.col("count") > crowd).collect()
    split = spark.sparkContext.broadcast({r[0]: -(-r[1] // crowd) for r in crowded})

    def deal(batch: pa.RecordBatch) -> pa.RecordBatch:
        fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        keys, parts, fps, lives = [], [], [], []
        for block in range(len(cover.parts)):
            row, key = cover.near(fp, block)
            count = np.array([split.value.get(k, 1) for k in key.tolist()]) if split.value else np.ones(len(key), np.int64)
            part = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            row, key, count = np.repeat(row, count), np.repeat(key, count), np.repeat(count, count)
            at_home = (cover.home(fp, block)[row] == key) & ((fp[row] * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % count.astype(np.uint64) == part.astype(np.uint64))
            keys.append(key)
            parts.append(part)
            fps.append(fp[row].view(np.int64))
            lives.append(at_home)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(parts)), pa.array(np.concatenate(fps)), pa.array(np.concatenate(lives))], ["key", "part", "fp", "lives"])

    def compare(batches):
        tables = [b for b in batches if b.num_rows]
        if not tables:
            return
        key, part, fp, lives = (np.concatenate([b.column(j).to_numpy(zero_copy_only=False) for b in tables]) for j in range(4))
        order = np.lexsort((part, key))
        key, part, fp, lives = key[order], part[order], fp[order].view(np.uint64), lives[order].astype(bool)
        new = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (part[1:] != part[:-1]))))
        size = np.diff(np.append(new, len(key)))
        group = np.repeat(np.arange(len(new)), size)
        x = np.flatnonzero(lives)
        count = size[group[x]]
        found: list[tuple[np.ndarray, np.ndarray]] = []
        bounds = np.searchsorted(np.cumsum(count), np.arange(0, int(count.sum()) + PAIRS, PAIRS)) if len(x) else []
        for low, high in zip(bounds, [*bounds[1:], len(x)], strict=False):
            own, n = x[low:high], count[low:high]
            if not len(own):
                continue
            left = np.repeat(own, n)
            right = np.repeat(new[group[own]] - np.cumsum(n) + n, n) + np.arange(len(left))
            close = (np.bitwise_count(fp[left] ^ fp[right]) <= threshold) & (fp[left] != fp[right])
            if close.any():
                found.append(forest(fp[left[close]].view(np.int64), fp[right[close]].view(np.int64)))
        if found:
            a, b = forest(np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]))
            for k in range(0, len(a), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(a[k : k + 50_000]), pa.array(b[k : k + 50_000])], ["a", "b"])

    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total * cover.copies() // TASK_ROWS)
    dealt = map_batches(distinct.select("fp"), deal, "key long, part long, fp long, lives boolean").repartition(tasks, "key", "part")
    return dealt.mapInArrow(compare, "a long, b long").distinct()


def _roots(prints: DataFrame, threshold: int, crowd: int, blocks: int | None) -> DataFrame:
    """fp, root (a fingerprint that names the component), low (smallest doc_id of the fingerprint)."""
    distinct = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("low")))
    star = components(links(distinct, threshold, crowd, blocks))
    return distinct.join(star, distinct["fp"] == star["node"], "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, k: int = 4, threshold: int = 4, crowd: int = CROWD, blocks: int | None = None) -> DataFrame:
    """Each document's fingerprint and the smallest doc_id that can be reached over links of ``threshold`` or fewer differing bits.

    Null, empty and wordless texts have fingerprint zero and are linked like
    any others; rows that repeat each give a row; a null doc_id is never
    smallest, and component_id is null only where all doc_ids of the component
    are; an empty table gives no rows; other columns are not read.
    """
    prints = cut(fingerprint_table(docs, k))
    rooted = _roots(prints, threshold, crowd, blocks)
    smallest = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    return prints.join(rooted.select("fp", "root").join(smallest, "root").select("fp", "component_id"), "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


class Drawn:
    """Anchors of near copies: blocks of ``width`` bits, drawn from wide fingerprints so that all bits are used about equally often."""

    def __init__(self, width: int, count: int = DRAWN):
        rng, fit = np.random.default_rng(SEED), 64 * WIDE // width
        self.table = hamming_table()
        self.bits = [part for _ in range(-(-count // fit)) for part in rng.permutation(64 * WIDE)[: fit * width].reshape(fit, width)][:count]

    def homes(self, wide: np.ndarray) -> np.ndarray:
        """The nearest anchor's number in each block (row) of each fingerprint (column)."""
        bits = np.ascontiguousarray(np.unpackbits(wide.view(np.uint8), axis=1, bitorder="little").T)
        out = np.empty((len(self.bits), len(wide)), np.int64)
        for block, own in enumerate(self.bits):
            value = np.zeros(len(wide), np.int64)
            for place, bit in enumerate(own.tolist()):
                value |= bits[bit].astype(np.int64) << place
            out[block] = block << 40 | value >> 15 << 11 | self.table[value & 0x7FFF]
        return out


def wide_fingerprints(texts: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray]:
    """SimHash of 64 * WIDE bits of the different k-word shingles of each text, and a digest of these shingles (0 without words)."""
    out, digests = np.zeros((len(texts), WIDE), np.uint64), np.zeros(len(texts), np.uint64)
    for begin, end in chunks(texts):
        own = [np.array(list(set(shingles(text, k))), np.uint64) for text in texts[begin:end]]
        n = np.array([len(o) for o in own])
        some = np.flatnonzero(n)
        if not len(some):
            continue
        hashes, firsts = np.concatenate(own), np.cumsum(n[some]) - n[some]
        digests[begin + some] = mix(np.add.reduceat(mix(hashes), firsts))
        for word in range(WIDE):
            bits = np.unpackbits(mix(hashes + np.uint64(word * 0x9E3779B97F4A7C15 % 2**64)).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones = np.add.reduceat(bits, firsts, axis=0, dtype=np.int32) * 2 > n[some][:, None]
            out[begin + some, word] = np.packbits(ones, axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out, digests


def _wide(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, WIDE)


def candidates(nodes: DataFrame, crowd: int = CROWD, blocks: int = 3) -> DataFrame:
    """Edges (a, b) whose components hold the pairs of ``nodes`` (node long, wide binary) that meet at an anchor of a block of 64 // ``blocks`` bits and are close.

    As in ``links``, a forest of each task's pairs goes on, and crowded anchors
    are split; which ones are crowded is told by a sample of nodes.
    """
    spark = nodes.sparkSession
    total, drawn = nodes.count(), Drawn(64 // blocks)
    every, crowd = max(1, total // 20_000), max(crowd, total // SHARE)

    def homes(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(drawn.homes(_wide(batch.column(0))).ravel())], ["key"])

    crowded = map_batches(nodes.where(F.pmod("node", F.lit(every)) == 0).select("wide"), homes, "key long").groupBy("key").count().where(F.col("count") * every > crowd).collect()
    split = spark.sparkContext.broadcast({r[0]: -(-r[1] * every // crowd) for r in crowded})

    def deal(batch: pa.RecordBatch) -> pa.RecordBatch:
        node, wide = batch.column(0).to_numpy(zero_copy_only=False), _wide(batch.column(1))
        key, row = drawn.homes(wide).ravel(), np.tile(np.arange(len(node)), len(drawn.bits))
        part, lives = np.zeros(len(key), np.int32), np.ones(len(key), bool)
        if split.value:
            count = np.array([split.value.get(k, 1) for k in key.tolist()])
            part = (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)).astype(np.int32)
            key, row, count = np.repeat(key, count), np.repeat(row, count), np.repeat(count, count)
            lives = (node[row].view(np.uint64) >> np.uint64(33)) % count.astype(np.uint64) == part.astype(np.uint64)
        columns = [key, part, node[row], wide[row, 0].view(np.int64), wide[row, 1].view(np.int64), lives]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "part", "node", "one", "two", "lives"])

    def compare(batches):
        tables = [b for b in batches if b.num_rows]
        if not tables:
            return
        key, part, node, one, two, lives = (np.concatenate([b.column(j).to_numpy(zero_copy_only=False) for b in tables]) for j in range(6))
        order = np.lexsort((part, key))
        key, part, node, one, two, lives = key[order], part[order], node[order], one[order].view(np.uint64), two[order].view(np.uint64), lives[order].astype(bool)
        new = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (part[1:] != part[:-1]))))
        size = np.diff(np.append(new, len(key)))
        group = np.repeat(np.arange(len(new)), size)
        x = np.flatnonzero(lives & (size[group] > 1))
        count = size[group[x]]
        found: list[tuple[np.ndarray, np.ndarray]] = []
        bounds = np.searchsorted(np.cumsum(count), np.arange(0, int(count.sum()) + PAIRS, PAIRS)) if len(x) else []
        for low, high in zip(bounds, [*bounds[1:], len(x)], strict=False):
            own, n = x[low:high], count[low:high]
            if not len(own):
                continue
            left = np.repeat(own, n)
            right = np.repeat(new[group[own]] - np.cumsum(n) + n, n) + np.arange(len(left))
            close = (np.bitwise_count(one[left] ^ one[right]) + np.bitwise_count(two[left] ^ two[right]) <= CLOSE_TWO) & (node[left] != node[right])
            if close.any():
                found.append(forest(node[left[close]], node[right[close]]))
        if found:
            a, b = forest(np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]))
            for k in range(0, len(a), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(a[k : k + 50_000]), pa.array(b[k : k + 50_000])], ["a", "b"])

    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total * DRAWN // TASK_ROWS)
    dealt = map_batches(nodes.select("node", "wide"), deal, "key long, part int, node long, one long, two long, lives boolean").repartition(tasks, "key", "part")
    return dealt.mapInArrow(compare, "a long, b long").distinct()


def near_pairs(node: np.ndarray, side: np.ndarray, wide: np.ndarray, texts: list[bytes], k: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """A forest of the pairs with Jaccard ``least`` or more: pairs of the two sides, or of all where there is one side."""
    label, sets = np.arange(len(node)), {}
    one = side.min() == side.max()
    a, b = [], []

    def own(i: int) -> np.ndarray:
        if i not in sets:
            sets[i] = np.unique(np.array(shingles(texts[i], k), np.uint64))
        return sets[i]

    for i in range(len(node)) if one else np.flatnonzero(side == side.min()).tolist():
        others = np.flatnonzero(label != label[i])
        others = others[others > i] if one else others[side[others] != side[i]]
        others = others[np.bitwise_count(wide[others] ^ wide[i]).sum(1, dtype=np.int64) <= CLOSE_ALL]
        for j in others.tolist():
            if label[i] == label[j]:
                continue
            x, y = own(i), own(j)
            if min(len(x), len(y)) < least * max(len(x), len(y)) - 1e-9:
                continue
            both = len(np.intersect1d(x, y, assume_unique=True))
            if both >= least * (len(x) + len(y) - both) - 1e-9:
                label[label == label[j]] = label[i]
                a.append(i)
                b.append(j)
    return node[np.array(a, np.int64)], node[np.array(b, np.int64)]


def _confirmed(members: DataFrame, k: int, least: float, chars: int) -> DataFrame:
    """Edges (a, b) of the near copies among ``members`` (node, root, wide, text) with one root; a root of much text in chunks, every two of which meet."""
    tasks = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sizes = members.groupBy("root").agg(F.ceil(F.sum(F.length("text") + 100) / chars).cast("int").alias("parts"))
    dealt = members.join(sizes, "root").withColumn("side", F.pmod(F.xxhash64("node"), "parts").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select("root", F.least("side", "other").alias("low"), F.greatest("side", "other").alias("high"), "node", "side", "wide", "text")

    def flush(rows: list[dict]) -> pa.RecordBatch:
        if rows[0]["low"] != rows[0]["high"] and len({r["side"] for r in rows}) == 1:
            return pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 2, ["a", "b"])
        node, side = np.array([r["node"] for r in rows], np.int64), np.array([r["side"] for r in rows])
        wide = np.frombuffer(b"".join(r["wide"] for r in rows), np.uint64).reshape(-1, WIDE)
        a, b = near_pairs(node, side, wide, [r["text"].encode() for r in rows], k, least)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    def run(batches):
        held: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                if held and any(row[c] != held[0][c] for c in ("root", "low", "high")):
                    yield flush(held)
                    held = []
                held.append(row)
        if held:
            yield flush(held)

    return dealt.repartition(tasks, "root", "low", "high").sortWithinPartitions("root", "low", "high").mapInArrow(run, "a long, b long")


def representatives(docs: DataFrame, k: int = 5, least: float = 0.8, crowd: int = CROWD, blocks: int = 3, chars: int = CHUNK_CHARS) -> DataFrame:
    """One document of each group of near copies, all columns: that of the smallest doc_id (null last), of equal ids that of the smallest hash of its text.

    Documents are linked if the Jaccard of their sets of ``k``-word shingles (the whole text,
    if it has fewer words) is ``least`` or more; groups are components of links. Every link is
    exact; a pair is missed if it neither meets at an anchor nor shares a component of
    candidates. Null, empty and wordless texts are each other's copies; of rows with equal id and
    text one stays, whose other columns are those of any of them; an empty table gives none; columns
    may have any names.
    """
    named = F.xxhash64(F.col("doc_id").cast("long"), "text")
    id_, name = free_names(docs, "id", "name")
    keyed = docs.withColumns({id_: F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)), name: named})

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        wide, digest = wide_fingerprints(texts_of(batch.column(2)), k)
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(digest.view(np.int64)), pa.array([row.tobytes() for row in wide], pa.binary())], ["doc_id", "name", "node", "wide"])

    prints = map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), named.alias("name"), F.col("text").cast("string").alias("text")), run, "doc_id long, name long, node long, wide binary")
    nodes = cut(prints.groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "name")).alias("first"), F.min("wide").alias("wide")))
    star = cut(components(candidates(nodes, crowd, blocks)))
    star = star.unionAll(star.select(F.col("root").alias("node"), "root").distinct())
    members = cut(nodes.join(star, "node").select("node", "root", "wide", F.coalesce("first.doc_id", F.lit(-1)).alias(id_), F.col("first.name").alias(name)))
    few = F.broadcast(members) if members.count() <= SENT else members
    texts = keyed.select(id_, name, F.col("text").cast("string").alias("text")).join(few, [name, id_]).where("text is not null").dropDuplicates(["node"])
    linked = components(_confirmed(cut(texts.select("node", "root", "wide", "text")), k, least, chars))
    rooted = nodes.join(linked, "node", "left").select("first", F.coalesce("root", "node").alias("root"))
    chosen = rooted.groupBy("root").agg(F.min("first").alias("first")).select(F.coalesce("first.doc_id", F.lit(-1)).alias(id_), F.col("first.name").alias(name))
    return keyed.join(chosen, [name, id_], "left_semi").dropDuplicates([name, id_]).select(*docs.columns)


def brute_force(texts: list[str | None], k: int = 4, threshold: int = 4) -> tuple[list[int], list[int]]:
    """The definition: fingerprints, and for each text the first text that it is linked to over any number of links."""
    fps = []
    for text in texts:
        parts = bytes(text or "", "utf-8").lower().split()
        shingles = [b" ".join(parts[i : i + k]) for i in range(max(1, len(parts) - k + 1))] if parts else []
        hashes = [xxhash.xxh64_intdigest(s, seed=SEED) for s in shingles]
        fps.append(sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes)))
    label = list(range(len(texts)))
    changed = True
    while changed:
        changed = False
        for i, j in itertools.combinations(range(len(texts)), 2):
            if label[i] != label[j] and (fps[i] ^ fps[j]).bit_count() <= threshold:
                label[i] = label[j] = min(label[i], label[j])
                changed = True
    return fps, label
