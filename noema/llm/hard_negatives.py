"""Hard-negative mining by distributed radix selection.

Anchors are compared with all rows in blocks, and what travels are histograms:
each block counts the integer scores that fall into an anchor's window, by the
next digit of the score; the sums locate the digit that holds the kth score,
the window narrows to it, and the next round refines. If more rows share the
kth score than are worth fetching, the selection goes on by the digits of their
ids. Only then are the rows that qualify gathered and ranked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from noema.llm.frames import cut, map_batches

#: Buckets of a digit.
BUCKETS = 1024
#: A window is narrow enough once no more rows than these would be gathered.
FEW = 64
#: Rows and anchors of a block, anchors whose scores are in memory at a time, and the blocks into which few rows are dealt.
ROWS, ANCHORS, TILE, LEAST_BLOCKS = 4096, 4096, 256, 32
_VECTORS = "row long, vec_id long, label long, v binary, norm double"
_STATE = ["anchor", "window", "same", "k", "top", "lo", "hi", "ids", "ilo", "ihi", "above", "done"]
_END = (1 << 63) - 1


def vectors(rows: DataFrame, every: int = 7) -> DataFrame:
    """Rows that take part, from vec_id, embedding, label: row (a number), vec_id, label (moved on for ids divisible by ``every``), v (components as floor(256 x): 2 or 8 bytes each after their width), norm."""
    vec_id, values, label = rows["vec_id"].cast("long"), rows["embedding"].cast("array<double>"), rows["label"].cast("long")
    good = F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = rows.where(vec_id.isNotNull() & label.isNotNull() & values.isNotNull() & good)
    moved = F.when(vec_id % every == 0, (label + 1) % 10).otherwise(label)
    kept = kept.select(F.monotonically_increasing_id().alias("row"), vec_id.alias("vec_id"), moved.alias("label"), values.alias("v"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        column = batch.column(3)
        flat, at = np.floor(256.0 * column.flatten().to_numpy(zero_copy_only=False)), column.offsets.to_numpy()
        at = at - at[0]
        packed, norms = [], np.zeros(batch.num_rows)
        for k in range(batch.num_rows):
            v = flat[at[k] : at[k + 1]]
            packed.append(b"\x02" + v.astype(np.int16).tobytes() if not len(v) or np.abs(v).max() < 32768 else b"\x08" + v.tobytes())
            norms[k] = v @ v
        return pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(packed, pa.binary()), pa.array(norms)], ["row", "vec_id", "label", "v", "norm"])

    return map_batches(kept, run, _VECTORS)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Vectors as rows of whole numbers; shorter ones end in zeros."""
    rows = [np.frombuffer(b, np.int16 if b[0] == 2 else np.float64, offset=1) for b in column.to_pylist()]
    out = np.zeros((len(rows), max(map(len, rows), default=0)))
    for k, v in enumerate(rows):
        out[k, : len(v)] = v
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers; beyond what a long holds it is an error, as in SQL."""
    width = max(a.shape[1], b.shape[1])
    a, b = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (a, b))
    if width * np.abs(a).max(initial=0) * np.abs(b).max(initial=0) < 2**53:
        return (a @ b.T).astype(np.int64)
    exact = [np.array([[int(x) for x in row] for row in m], object).reshape(m.shape) for m in (a, b)]
    return (exact[0] @ exact[1].T).astype(np.int64)


def _windows(anchors: pa.Table, rows: pa.Table) -> Iterator[tuple[dict, np.ndarray, np.ndarray]]:
    """Each window of a cell with the scores and the ids of the rows inside it."""
    ids, labels, b = rows.column("vec_id").to_numpy(), rows.column("label").to_numpy(), _matrix(rows.column("v"))
    for begin in range(0, anchors.num_rows, TILE):
        tile = anchors.slice(begin, TILE)
        scores = products(_matrix(tile.column("own_v")), b)
        for k, (row, own, label, windows) in enumerate(zip(*(tile.column(c).to_pylist() for c in ("row", "own", "own_label", "windows")), strict=True)):
            alike = labels == label
            groups = {True: np.flatnonzero(alike & (ids != own)), False: np.flatnonzero(~alike)}
            held = {same: (scores[k, at], ids[at]) for same, at in groups.items()}
            for w in windows:
                s, i = held[w["same"]]
                low = s == w["lo"] if w["ids"] else s >= w["lo"]
                inside = low & (s <= w["hi"]) & (i >= w["ilo"]) & (i <= w["ihi"])
                yield w | {"anchor": row}, s[inside], i[inside]


def _counted(key: tuple, anchors: pa.Table, rows: pa.Table) -> pa.Table:
    """Counts of a cell by window and bucket, from the best one down: no further than the window still needs rows, as what lies lower can't hold the kth."""
    out: list[tuple[np.ndarray, ...]] = []
    for w, s, i in _windows(anchors, rows) if anchors.num_rows and rows.num_rows else ():
        if not len(s):
            continue
        where = _steps(i, w["ilo"], w["ihi"]) if w["ids"] else _steps(-s, -w["hi"], -w["lo"])
        n = np.bincount(where)
        end = min(len(n), int(np.searchsorted(np.cumsum(n), w["k"] - w["above"])) + 1)
        used = np.flatnonzero(n[:end])
        out.append((np.full(len(used), w["anchor"]), np.full(len(used), w["window"]), used, n[used]))
    columns = [np.concatenate(c).astype(np.int64) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 4
    return pa.table(columns, names=["anchor", "window", "bucket", "n"])


def _width(first: int, last: int) -> int:
    return -(-(last - first + 1) // BUCKETS)


def _steps(values: np.ndarray, first: int, last: int) -> np.ndarray:
    """Buckets of values from ``first`` on; without overflow, as differences of longs fit unsigned ones."""
    away = values.astype(np.uint64) - np.array(first, np.int64).astype(np.uint64)
    return (away // np.uint64(_width(first, last))).astype(np.int64)


def _gathered(key: tuple, anchors: pa.Table, rows: pa.Table) -> pa.Table:
    """Qualifying rows of a cell; of rows with the same id and score, which are one answer, no more than are asked for."""
    out: list[tuple[np.ndarray, ...]] = []
    for w, s, i in _windows(anchors, rows) if anchors.num_rows and rows.num_rows else ():
        order = np.lexsort((i, -s))
        s, i = s[order], i[order]
        start = np.flatnonzero(np.concatenate([[True], (s[1:] != s[:-1]) | (i[1:] != i[:-1])])) if len(s) else np.zeros(0, np.int64)
        copy = np.arange(len(s)) - np.repeat(start, np.diff(np.append(start, len(s))))
        keep = copy < w["k"]
        out.append((np.full(keep.sum(), w["anchor"]), np.full(keep.sum(), w["window"]), i[keep], s[keep]))
    columns = [np.concatenate(c).astype(np.int64) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 4
    return pa.table(columns, names=["anchor", "window", "vec_id", "score"])


class Search:
    """Anchors and rows in blocks; every pair of blocks is a cell, which one task compares."""

    def __init__(self, rows: DataFrame, anchors: DataFrame):
        n, m = rows.count(), anchors.count()
        self.across, self.down = max(1, -(-m // ANCHORS)), max(1, -(-n // ROWS), min(LEAST_BLOCKS, n // 64))
        self.anchors = anchors.select("row", F.col("vec_id").alias("own"), F.col("label").alias("own_label"), F.col("v").alias("own_v")).withColumn("i", F.pmod(F.xxhash64("row"), F.lit(self.across)).cast("int"))
        numbered = rows.withColumn("j", F.pmod(F.xxhash64("row"), F.lit(self.down)).cast("int"))
        self.rows = numbered.select("vec_id", "label", "v", "j", F.explode(F.sequence(F.lit(0), F.lit(self.across - 1))).alias("i"))

    def cells(self, state: DataFrame, fn, schema: str) -> DataFrame:
        windows = state.groupBy(F.col("anchor").alias("row")).agg(F.collect_list(F.struct("window", "same", "k", "lo", "hi", "ids", "ilo", "ihi", "above")).alias("windows"))
        asked = self.anchors.join(windows, "row").select("row", "own", "own_label", "own_v", "windows", "i", F.explode(F.sequence(F.lit(0), F.lit(self.down - 1))).alias("j"))
        return asked.groupBy("i", "j").cogroup(self.rows.groupBy("i", "j")).applyInArrow(fn, schema)

    def select(self, windows: DataFrame) -> DataFrame:
        """The best k rows of each window (anchor, window, same, k, lo, hi: scores, all included): anchor, window, rank, vec_id, score. Windows of one anchor are few."""
        first = F.lit(-_END - 1)
        state = cut(windows.select("anchor", "window", "same", "k", F.col("hi").alias("top"), "lo", "hi", F.lit(False).alias("ids"), first.alias("ilo"), F.lit(_END).alias("ihi"), F.lit(0).cast("long").alias("above"), F.lit(False).alias("done")).select(*_STATE))
        while not (open_ := state.where("not done")).isEmpty():
            counts = self.cells(open_, _counted, "anchor long, window long, bucket long, n long").groupBy("anchor", "window", "bucket").agg(F.sum("n").alias("n"))
            running = counts.withColumn("upto", F.sum("n").over(Window.partitionBy("anchor", "window").orderBy("bucket")))
            kth = running.join(open_.select("anchor", "window", "k", "above"), ["anchor", "window"]).where("above + upto >= k").groupBy("anchor", "window").agg(F.min(F.struct("bucket", "upto", "n")).alias("at"))
            state = cut(state.join(kth, ["anchor", "window"], "left").mapInArrow(_narrowed, state.schema))
        # the rows of a window: better scores than the last interval's as well
        best = state.withColumn("hi", F.when(F.col("ids"), F.col("lo")).otherwise(F.col("top")))
        above = state.where("ids and lo < top").withColumns({"lo": F.col("lo") + 1, "hi": F.col("top"), "ids": F.lit(False), "ilo": first, "ihi": F.lit(_END)})
        found = self.cells(best.withColumn("ilo", first).unionByName(above), _gathered, "anchor long, window long, vec_id long, score long")
        order = Window.partitionBy("anchor", "window").orderBy(F.col("score").desc(), "vec_id")
        ranked = found.withColumn("rank", F.row_number().over(order)).join(windows.select("anchor", "window", "k"), ["anchor", "window"])
        return ranked.where("rank <= k").select("anchor", "window", "rank", "vec_id", "score")


def _narrowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The next interval of each window, given the bucket in which the kth row lies."""
    for batch in batches:
        rows = batch.to_pylist()
        for r in rows:
            at = r.pop("at")
            if r["done"]:
                continue
            if at is None:  # fewer rows than asked for: all of the interval
                r["done"] = True
                continue
            ends = ("ilo", "ihi") if r["ids"] else ("lo", "hi")
            first, last = (r["ilo"], r["ihi"]) if r["ids"] else (-r["hi"], -r["lo"])
            begin = first + at["bucket"] * _width(first, last)
            end = min(last, begin + _width(first, last) - 1)
            r[ends[0]], r[ends[1]] = (begin, end) if r["ids"] else (-end, -begin)
            r["above"] += at["upto"] - at["n"]
            if r["above"] + at["n"] <= FEW or r["ids"] and begin == end:
                r["done"] = True
            elif begin == end:
                r["ids"] = True
        yield pa.RecordBatch.from_pylist([{c: r[c] for c in _STATE} for r in rows], schema=pa.schema([batch.schema.field(c) for c in _STATE]))


def _tenths(score: str, times: int, up: bool) -> Column:
    """times * score / 10, rounded, without leaving a long."""
    rest = F.pmod(F.col(score), F.lit(10))
    tens = F.call_function("div", F.col(score) - rest, F.lit(10))
    part = times * rest + (9 if up else 0)
    return times * tens + F.call_function("div", part, F.lit(10))


def mine(rows: DataFrame, every: int = 100, positives: int = 5, negatives: int = 10) -> DataFrame:
    """Hard negatives: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``rows``: vec_id, embedding, label; other columns are ignored. A row without an id, a label or a whole
    finite vector takes no part. Anchors are the different rows whose id is divisible by ``every``; an
    anchor's positives are its first ``positives`` rows of the same label and another id; a negative of
    another label has a score of 30 to 90 hundredths of the positive's. Every row counts, repeated ones
    too. Shorter vectors end in zeros (an empty one scores 0); scores are exact, and one that no long
    holds is an error. An anchor without positives, and a positive without negatives, give no rows, nor
    does an empty table.
    """
    table = cut(vectors(rows))
    anchors = cut(table.where(F.col("vec_id") % every == 0).groupBy("vec_id", "label", "v").agg(F.min("row").alias("row")))
    search = Search(table, anchors)
    most = min(float(_END), float((table.agg(F.max("norm")).first()[0] or 0.0) * (1 + 1e-9) + 1))
    bound = min(_END, int(most))
    near = anchors.select(F.col("row").alias("anchor"), F.lit(0).cast("long").alias("window"), F.lit(True).alias("same"), F.lit(positives).cast("long").alias("k"), F.lit(-bound).cast("long").alias("lo"), F.lit(bound).cast("long").alias("hi"))
    found = cut(search.select(near).select("anchor", F.col("rank").cast("long").alias("window"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))
    far = found.withColumns({"lo": _tenths("positive_score", 3, True), "hi": _tenths("positive_score", 9, False)}).where("lo <= hi")
    far = cut(far.select("anchor", "window", F.lit(False).alias("same"), F.lit(negatives).cast("long").alias("k"), "lo", "hi"))
    names = anchors.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    return search.select(far).join(found, ["anchor", "window"]).join(names, "anchor").select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


#: DuckDB SQL of ``mine`` over ``embeddings``, for unique ids and products that a double holds exactly.
ORACLE = """WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.e, b.e)::BIGINT AS score FROM v a, v b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id AS negative_id, positive_score, score AS negative_score
  FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT * FROM n WHERE rank <= 10"""
