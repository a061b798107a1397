"""Vector search, neighbours, components and centroids."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from noema.operators.common import checkpointed

#: Vectors of a block at the least, and bytes of one; comparisons of all with all send each vector once for each block of the other side.
BLOCK, BLOCK_BYTES = 4096, 16 << 20
#: Blocks of a side, if there are vectors for them, so that there is work for many tasks.
SPREAD = 6
#: Links that one task can turn into components.
SMALL = 100_000


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two arrays, 0 where one has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)


def _cells(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values by place in the vector, lengths, and whether a value is null; short vectors are filled up with 0."""
    lists = column.combine_chunks()
    length = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten()
    row, place = np.repeat(np.arange(len(length)), length), np.arange(len(flat)) - np.repeat(np.cumsum(length) - length, length)
    out = np.zeros((int(length.max(initial=0)), len(length)))
    out[place, row] = flat.fill_null(0.0).to_numpy(zero_copy_only=False)
    return out, length, np.bincount(row, flat.is_null().to_numpy(zero_copy_only=False), len(length)) > 0


def cosines(x: pa.ChunkedArray, y: pa.ChunkedArray, at_x: np.ndarray, at_y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``cosine`` of the vectors at places of two columns of lists, with the same sums in the same order, and where it is null: at a place of -1, and where lengths differ."""
    (v, m, v_null), (w, n, w_null) = _cells(x), _cells(y)
    with np.errstate(all="ignore"):
        lengths = [np.sqrt(sum((row * row for row in side), np.zeros(side.shape[1]))) for side in (v, w)]
    value, null = np.zeros(len(at_x)), (at_x < 0) | (at_y < 0)
    for begin in range(0, len(at_x), 1 << 16):
        part = begin + np.flatnonzero(~null[begin : begin + (1 << 16)])
        i, j = at_x[part], at_y[part]
        with np.errstate(all="ignore"):
            dot = sum((a[i] * b[j] for a, b in zip(v, w, strict=False)), np.zeros(len(part)))
            norm = lengths[0][i] * lengths[1][j]
            zero = (norm <= 0) | v_null[i] | w_null[j]  # as a length that isn't known
            value[part] = np.where(zero, 0.0, dot / norm)
        null[part] = ~zero & (m[i] != n[j])
    return value, null


def cosine_grid(x: pa.ChunkedArray, y: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """``cosines`` of each vector of a column with each of another, and where it is null: where one is missing, and where lengths differ."""
    (v, m, v_null), (w, n, w_null) = _cells(x), _cells(y)
    missing = [~column.combine_chunks().is_valid().to_numpy(zero_copy_only=False) for column in (x, y)]
    dot = np.zeros((v.shape[1], w.shape[1]))
    with np.errstate(all="ignore"):
        lengths = [np.sqrt(sum((row * row for row in side), np.zeros(side.shape[1]))) for side in (v, w)]
        for a, b in zip(v, w, strict=False):
            dot += a[:, None] * b[None, :]
        norm = lengths[0][:, None] * lengths[1][None, :]
        zero = (norm <= 0) | v_null[:, None] | w_null[None, :]
        value = np.where(zero, 0.0, dot / norm)
    return value, missing[0][:, None] | missing[1][None, :] | (~zero & (m[:, None] != n[None, :]))


def search(vectors: DataFrame, query: list[float], limit: int, least: float | None = None) -> DataFrame:
    """The ``limit`` most similar vectors, of which those at ``least`` or more: id, similarity."""
    found = vectors.select("id", cosine(F.col("vector"), F.array(*map(F.lit, query))).alias("similarity")).orderBy(F.desc("similarity"), "id").limit(limit)
    return found if least is None else found.where(F.col("similarity") >= least)


def neighbours(vectors: DataFrame, k: int, least: float | None = None) -> DataFrame:
    """Exact ``k`` nearest others of every vector by cosine: id, other, similarity, rank.

    Vectors are dealt out in blocks; each pair of blocks is one task that keeps its best
    ``k``, so no task holds more than two blocks and ``k`` rows a block and vector are shuffled.
    """
    return nearest(vectors, vectors, k, least, others=True)


def nearest(queries: DataFrame, targets: DataFrame, k: int, least: float | None = None, others: bool = False) -> DataFrame:
    """Exact ``k`` nearest ``targets`` of every query, in blocks as for ``neighbours``: id, other, similarity, rank. With ``others``, a target with the query's id is the query itself and left out. Rows without an id or a vector take no part; ties go by id, in every block as well, so equal vectors are no more rows than others."""

    def dealt(rows: DataFrame) -> tuple[DataFrame, int]:
        rows = rows.where("id is not null and vector is not null")
        n, cells = rows.agg(F.count("*"), F.coalesce(F.max(F.size("vector")), F.lit(1))).first()
        large = max(BLOCK, BLOCK_BYTES // (8 * max(1, cells)))
        blocks = max(-(-n // large), min(-(-n // BLOCK), SPREAD), 1)
        return rows.select(F.col("id").alias("id"), F.col("vector").cast("array<double>").alias("vector"), F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block")), blocks

    (ours, m_blocks), (theirs, n_blocks) = dealt(queries), dealt(targets)
    left = ours.select("id", "vector", F.col("block").alias("a"), F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("b"))
    right = theirs.select("id", "vector", F.explode(F.sequence(F.lit(0), F.lit(m_blocks - 1))).alias("a"), F.col("block").alias("b"))

    found = _compared(left, right, ["a", "b"], k, others)
    ranked = _ranked(found, k)
    return ranked if least is None else ranked.where(F.col("similarity") >= least)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    return found.withColumn("rank", F.row_number().over(W.partitionBy("id").orderBy(F.desc("similarity"), "other"))).where(F.col("rank") <= k)


def _compared(left: DataFrame, right: DataFrame, keys: list[str], k: int, apart: bool) -> DataFrame:
    """The best ``k`` of each left row (id, vector), by similarity and then id, among the right rows of the same ``keys``, a task for each value of these: id, other, similarity."""

    def best(x: pa.Table, y: pa.Table) -> pa.Table:
        if not x.num_rows or not y.num_rows:
            return _answers(x, y, [], k)
        y = y.sort_by("id")  # places are in the order of ids
        names, others = (t.column("id").to_numpy() if apart else None for t in (x, y))
        m, n = (_units(np.stack(t.column("vector").to_numpy())) for t in (x, y))
        return _answers(x, y, _best(m, n, k, names, others), k)

    kind, others = (df.schema["id"].dataType.simpleString() for df in (left, right))
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(best, f"id {kind}, other {others}, similarity double")


def _best(m: np.ndarray, n: np.ndarray, k: int, names: np.ndarray | None = None, others: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each row of ``m`` its place and the places and products of its best ``k`` rows of ``n``, ties by place; rows of the same name don't count, where names are given."""
    out, step = [], max(1, (1 << 22) // max(1, len(n)))
    for begin in range(0, len(m), step):
        sims = m[begin : begin + step] @ n.T
        if names is not None:
            sims[names[begin : begin + step, None] == others[None, :]] = -np.inf
        last = np.partition(sims, len(n) - k, axis=1)[:, len(n) - k, None] if len(n) > k else -np.inf
        good = (sims >= last) & (sims > -np.inf)
        for r in np.flatnonzero(good.sum(axis=1) > k):  # of many equal products the first
            above = np.flatnonzero(sims[r] > last[r])
            tied = np.flatnonzero((sims[r] == last[r]) & (sims[r] > -np.inf))[: k - len(above)]
            good[r] = False
            good[r, above] = good[r, tied] = True
        i, j = np.nonzero(good)
        out.append((i + begin, j, sims[i, j]))
    return out


def _answers(x: pa.Table, y: pa.Table, found: list[tuple[np.ndarray, np.ndarray, np.ndarray]], k: int) -> pa.Table:
    """id, other and similarity of pairs of places, of which the best ``k`` of each row of ``x`` are left, ties by place."""
    i, j, s = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
    order = np.lexsort((j, -s, i))
    i, j, s = i[order], j[order], s[order]
    keep = np.arange(len(i)) - np.searchsorted(i, i) < k
    i, j, s = i[keep], j[keep], s[keep]
    return pa.table({"id": x.column("id").take(pa.array(i, pa.int64())), "other": y.column("id").take(pa.array(j, pa.int64())), "similarity": pa.array(s, pa.float64())})


def _units(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-300)


def _homes(units: np.ndarray, means: np.ndarray) -> np.ndarray:
    return np.concatenate([np.argmax(units[b : b + 4096] @ means.T, axis=1) for b in range(0, len(units), 4096)])


def spherical(units: np.ndarray, lists: int, rounds: int = 8) -> np.ndarray:
    """Directions of spherical k-means, begun at the first vectors."""
    means = units[:lists].copy()
    for _ in range(rounds):
        home = _homes(units, means)
        sums = np.zeros_like(means)
        np.add.at(sums, home, units)
        filled = np.bincount(home, minlength=len(means)) > 0
        means[filled] = _units(sums[filled])
    return means


def compared_in_lists(asking: DataFrame, targets: DataFrame, k: int, least: float | None = None, others: bool = False) -> DataFrame:
    """The ``k`` nearest targets (id, vector, list) of each query among those of the lists that it asks (id, vector, lists: different ones): id, other, similarity, rank.

    Lists are bundled, and a query goes once to each bundle that holds one of its lists, however
    many of these it asks: the k best of a bundle, not of a list, come back. Both sides of a
    bundle are dealt out in blocks, a task for each pair.
    """
    n, cells = targets.agg(F.count("*"), F.coalesce(F.max(F.size("vector")), F.lit(1))).first()
    large = max(BLOCK, BLOCK_BYTES // (8 * max(1, cells)))
    bundles = max(-(-n // large), min(-(-n // BLOCK), SPREAD), 1)
    bundle = lambda c: F.pmod(F.xxhash64(c), F.lit(bundles)).cast("int")
    asks = asking.where(F.size("lists") > 0).withColumn("bundle", F.explode(F.array_distinct(F.transform("lists", bundle))))
    asks = asks.select("id", "vector", "bundle", F.filter("lists", lambda c: bundle(c) == F.col("bundle")).alias("lists"))
    holds = targets.withColumn("bundle", bundle(F.col("list")))
    blocks = lambda df, name: df.groupBy("bundle").agg(F.ceil(F.count("*") / large).cast("int").alias(name))
    sizes = checkpointed(blocks(asks, "m").join(blocks(holds, "n"), "bundle"))  # a row a bundle
    block = lambda of: F.pmod(F.xxhash64("id"), F.col(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    left = asks.join(F.broadcast(sizes), "bundle").select("id", "vector", "lists", "bundle", block("m").alias("a"), every("n").alias("b"))
    right = holds.join(F.broadcast(sizes), "bundle").select(F.col("id").alias("id"), F.col("vector").alias("vector"), F.col("list").alias("list"), F.col("bundle").alias("bundle"), every("m").alias("a"), block("n").alias("b"))

    def best(x: pa.Table, y: pa.Table) -> pa.Table:
        if not x.num_rows or not y.num_rows:
            return _answers(x, y, [], k)
        y = y.sort_by([("list", "ascending"), ("id", "ascending")])
        names, theirs = (t.column("id").to_numpy() for t in (x, y))
        m, n = (_units(np.stack(t.column("vector").to_numpy())) for t in (x, y))
        lists = x.column("lists").combine_chunks()
        asked, row = lists.flatten().to_numpy(), np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy())
        order = np.argsort(asked, kind="stable")
        asked, row = asked[order], row[order]
        held = y.column("list").to_numpy()
        found = []
        for name in np.unique(held):
            at = slice(*np.searchsorted(held, [name, name + 1]))
            who = row[slice(*np.searchsorted(asked, [name, name + 1]))]
            for i, j, s in _best(m[who], n[at], k, *((names[who], theirs[at]) if others else ())):
                found.append((who[i], j + at.start, s))
        # ties go by id over all lists
        rank = np.argsort(np.argsort(theirs, kind="stable"), kind="stable")
        by_id = y.sort_by("id")
        return _answers(x, by_id, [(i, rank[j], s) for i, j, s in found], k)

    kind, other = (df.schema["id"].dataType.simpleString() for df in (left, right))
    found = left.groupBy("bundle", "a", "b").cogroup(right.groupBy("bundle", "a", "b")).applyInArrow(best, f"id {kind}, other {other}, similarity double")
    ranked = _ranked(found, k)
    return ranked if least is None else ranked.where(F.col("similarity") >= least)


def _fitted(rows: DataFrame, k: int, lists: int, probes: int | None, share: float, sample: int, rounds: int = 8) -> tuple[np.ndarray, int]:
    """Directions of spherical k-means, and how many lists to ask.

    Both are learned on the driver from at most ``sample`` different vectors, those of the smallest hash; that bounds what
    is sent there. Lists are asked until ``share`` of the true neighbours of 512 vectors of the sample are met.
    """
    some = rows.select("vector").distinct().orderBy(F.xxhash64("vector"), "vector").limit(sample).toArrow().column("vector").to_pylist()
    if not some:
        return np.empty((0, 0)), 0
    units = _units(np.array(some, float))
    means = spherical(units, lists, rounds)
    if probes is None:
        home, asking = _homes(units, means), units[:512]
        sims = asking @ units.T
        np.fill_diagonal(sims, -np.inf)
        near = home[np.argsort(-sims, axis=1)[:, :k]]
        place = np.argsort(np.argsort(-(asking @ means.T), axis=1, kind="stable"), axis=1)
        probes = int(np.quantile(np.take_along_axis(place, near, axis=1), share, method="higher")) + 1
    return means, probes


def approximate(vectors: DataFrame, k: int, least: float | None = None, probes: int | None = None, lists: int | None = None, share: float = 0.95, sample: int = 20_000) -> DataFrame:
    """Some ``k`` nearest others of every vector by an inverted file: id, other, similarity, rank.

    Every vector lies in the list of its nearest centre and is compared with the vectors of its ``probes`` nearest lists;
    similarities are exact, but a neighbour in another list is missed. Without ``probes``, as many lists are asked as find
    ``share`` of the neighbours within a sample of ``sample`` vectors: few where vectors form groups, up to half of them where
    they are random. There are ``lists`` (the root of the number of rows, where none is given; an eighth of ``sample`` at most).
    Only the centres travel with the tasks. A list of more than 4096 rows is compared in blocks. Equal vectors ask once, and
    of each such group only the k + 1 smallest ids can be an answer, so that copies cost nothing; ties go by id, as in
    ``neighbours``. Rows without a vector have no neighbours, and an empty table gives an empty one.
    """
    rows = checkpointed(vectors.where("id is not null and vector is not null").select("id", F.col("vector").cast("array<double>").alias("vector")))
    means, probes = _fitted(rows, k, min(lists or math.isqrt(rows.count()) or 1, max(1, sample // 8)), probes, share, sample)
    kind = rows.schema["id"].dataType.simpleString()
    if not len(means):
        return rows.sparkSession.createDataFrame([], f"id {kind}, other {kind}, similarity double, rank int")

    def dealt(batches):
        for batch in batches:
            if batch.num_rows:
                sims = _units(np.stack(batch.column("vector").to_numpy(zero_copy_only=False))) @ means.T
                order = np.argsort(-sims, axis=1, kind="stable")[:, :probes].astype(np.int32)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(order), pa.list_(pa.int32()))], [*batch.schema.names, "near"])

    alike = rows.withColumn("place", F.row_number().over(W.partitionBy("vector").orderBy("id"))).where(F.col("place") <= k + 1)
    placed = checkpointed(alike.mapInArrow(dealt, f"id {kind}, vector array<double>, place int, near array<int>"))
    targets = placed.select("id", "vector", F.col("near")[0].alias("list"))
    asking = placed.where("place = 1").select("id", "vector", F.col("near").alias("lists"))
    answers = checkpointed(compared_in_lists(asking, targets, k + 1))
    first = placed.where("place = 1").select(F.col("id").alias("first"), "vector")
    own = rows.join(first, "vector").select("id", "first")
    found = _ranked(own.join(answers.select(F.col("id").alias("first"), "other", "similarity"), "first").where("id <> other").select("id", "other", "similarity"), k)
    return found if least is None else found.where(F.col("similarity") >= least)


def bands(pairs: DataFrame, candidate: float, automatic: float) -> DataFrame:
    """Pairs at ``candidate`` or more, and whether they become edges without a question: band."""
    band = F.when(F.col("similarity") >= automatic, "edge").when(F.col("similarity") >= candidate, "candidate")
    return pairs.withColumn("band", band).where(F.col("band").isNotNull())


def components(pairs: DataFrame, a: str = "id", b: str = "other", rounds: int = 60, small: int = SMALL) -> DataFrame:
    """Connected components of undirected pairs: node, component (its smallest node).

    Every node follows the one of the least hash among itself and those next to it, what follows one node becomes one, and the
    pairs between these are left: a round takes away a share of the nodes however long the ways are, so written tables shrink. At
    most ``small`` pairs are one task's work. The names of the rounds are put together backwards.
    """
    left = checkpointed(pairs.select(F.least(a, b).alias("x"), F.greatest(a, b).alias("y")).where(F.col(a).isNotNull() & F.col(b).isNotNull()).distinct())
    kind = left.schema["x"].dataType.simpleString()
    named = []
    while left.limit(small + 1).count() > small:
        if len(named) == rounds:
            raise RuntimeError("components did not settle")
        rank = lambda c: F.struct(F.xxhash64(F.lit(len(named)), c).alias("hash"), F.col(c).alias("node"))  # noqa: B023, E731
        both = left.unionAll(left.select("y", "x"))
        led = checkpointed(both.groupBy("x").agg(F.min(rank("y")).alias("least")).select(F.col("x").alias("node"), F.least("least", rank("x"))["node"].alias("leader")))
        # the smallest node of those that follow a leader stands for them
        names = checkpointed(led.join(led.groupBy("leader").agg(F.min("node").alias("name")), "leader").select("node", "name"))
        named.append(names)
        for end in ("x", "y"):
            left = left.join(names.withColumnRenamed("node", end), end).drop(end).withColumnRenamed("name", end)
        left = checkpointed(left.where("x <> y").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct())
    found = left.withColumn("all", F.lit(True)).groupBy("all").applyInArrow(_joined, f"node {kind}, component {kind}")
    for names in reversed(named):
        later = found.select(F.col("node").alias("name"), "component")
        found = checkpointed(names.join(later, "name", "left").select("node", F.coalesce("component", "name").alias("component")))
    return found


def _joined(key: tuple, table: pa.Table) -> pa.Table:
    """Nodes of a table of links with the smallest node of their component."""
    ends = [table.column(c).to_pylist() for c in ("x", "y")]
    order = (lambda v: tuple(v.values())) if ends[0] and isinstance(ends[0][0], dict) else (lambda v: v)
    nodes = sorted({order(v): v for side in ends for v in side}.items())
    place = {name: k for k, (name, _) in enumerate(nodes)}
    root = list(range(len(nodes)))

    def top(n: int) -> int:
        while root[n] != n:
            root[n] = n = root[root[n]]
        return n

    for x, y in zip(*ends, strict=True):
        m, n = top(place[order(x)]), top(place[order(y)])
        root[max(m, n)] = min(m, n)  # places are in the order of nodes
    kind = table.schema.field("x").type
    return pa.table({"node": pa.array([v for _, v in nodes], kind), "component": pa.array([nodes[top(k)][1] for k in range(len(nodes))], kind)})


def mean_similarity(groups: DataFrame, pairs: DataFrame) -> DataFrame:
    """Mean similarity of each member inside of its component; a pair counts for both ends, a mutual pair twice: node, component, similarity."""
    ends = pairs.select(F.col("id").alias("node"), F.col("other").alias("peer"), "similarity").unionAll(pairs.select("other", "id", "similarity"))
    peers = groups.select(F.col("node").alias("peer"), F.col("component").alias("peer_component"))
    return ends.join(groups, "node").join(peers, "peer").where("component = peer_component").groupBy("node", "component").agg(F.avg("similarity").alias("similarity"))


def centroids(vectors: DataFrame, groups: DataFrame) -> DataFrame:
    """Component-wise mean of each group's vectors, not of unit length: component, size, vector."""
    return means(vectors.join(groups, vectors["id"] == groups["node"]).select("component", "vector"))


def means(rows: DataFrame) -> DataFrame:
    """``centroids`` of rows that name their group (component, vector)."""
    cells = rows.select("component", F.posexplode("vector").alias("at", "value"))
    places = cells.groupBy("component", "at").agg(F.avg(F.col("value").cast("double")).alias("mean"), F.count("*").alias("size"))
    return places.groupBy("component").agg(F.max("size").alias("size"), F.transform(F.array_sort(F.collect_list(F.struct("at", "mean"))), lambda c: c["mean"]).alias("vector"))


def split_large(groups: DataFrame, most: int) -> DataFrame:
    """Components of more than ``most`` nodes in chunks of sorted ids: node, component (the chunk's smallest node)."""
    chunk = F.floor((F.row_number().over(W.partitionBy("component").orderBy("node")) - 1) / most)
    return groups.withColumn("chunk", chunk).withColumn("component", F.min("node").over(W.partitionBy("component", "chunk"))).drop("chunk")
