"""Conversation prefix trie by leaf-peeling: subtree totals climb from the leaves as messages.

A node is a distinct sequence of first turns, named by an exclusive-or of hashes
of its turns and their places, which sums of parts of a conversation give. The
nodes of one chain have the same members, so a chain peels as one: it holds the
number of its remaining children, and once that is none it sends its totals to
the chain above, until only the root's is left. Rounds are the branching levels
of the tree, not its depth.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from noema.llm.frames import cut
from noema.operators.common import lookup

#: Turn numbers, or places, of one conversation that one task orders at a time.
SPAN = 4096
#: Width of the ranges of conversation ids that are joined to one string.
IDS = 256
NODE = ["depth", "kx", "ky"]


def ranked_turns(turns: DataFrame) -> DataFrame:
    """Turns by place: conv_id, rank (from 1), a, b (hashes of role and text), words. Texts are not shuffled, and a conversation of very many turns is ordered by ranges of their numbers."""
    role, text = (F.coalesce(turns[c].cast("string"), F.lit("")) for c in ("role", "text"))
    rows = turns.where(turns["conv_id"].isNotNull()).select(
        turns["conv_id"].cast("long").alias("conv_id"),
        turns["turn"].cast("long").alias("turn"),
        F.coalesce(F.call_function("div", turns["turn"].cast("long"), F.lit(SPAN)), F.lit(-(1 << 62))).alias("range"),
        F.xxhash64(F.lit(1), role, text).alias("a"),
        F.xxhash64(F.lit(2), text, role).alias("b"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"),
    )
    here = Window.partitionBy("conv_id", "range").orderBy(F.col("turn").asc_nulls_first(), "a", "b")
    rows = cut(rows.withColumn("rank", F.row_number().over(here).cast("long")))
    counts = rows.groupBy("conv_id", "range").agg(F.max("rank").alias("n"))
    earlier = counts.withColumn("before", F.sum("n").over(Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))).where("before > 0").select("conv_id", "range", "before")
    return rows.join(earlier, ["conv_id", "range"], "left").select("conv_id", (F.col("rank") + F.coalesce("before", F.lit(0))).alias("rank"), "a", "b", "words")


def head(conv_id: str | Column) -> Column:
    """How many first turns a conversation takes from the first of its twenty."""
    return F.pmod(F.crc32(F.col(conv_id).cast("string").cast("binary")), F.lit(4))


def rebuilt(ranked: DataFrame) -> DataFrame:
    """Turns of rebuilt conversations: c, depth, x, y, words; depth 0 stands for the textless root. ``ranked`` is read several times, so it should be cut."""
    first = F.col("conv_id") - F.col("conv_id") % 20
    convs = ranked.groupBy("conv_id").agg(F.max("rank").alias("n")).withColumns({"base": first, "h": head("conv_id")})
    known = convs.where("conv_id % 20 = 0").select(F.col("conv_id").alias("base"), F.col("n").alias("held"))
    convs = cut(convs.join(known, "base", "left").select(F.col("conv_id").alias("c"), "base", "h", F.least("h", F.coalesce("held", F.lit(0))).alias("taken")))
    heads = ranked.where("conv_id % 20 = 0 and rank <= 3").withColumnRenamed("conv_id", "base")
    borrowed = convs.join(heads, "base").where("rank <= h").select("c", F.col("rank").alias("depth"), "a", "b", "words")
    own = lookup(ranked.where(F.col("rank") > head("conv_id")).withColumnRenamed("conv_id", "c"), convs.where("taken < h").select("c", "taken"), ["c"])
    own = own.select("c", (F.coalesce("taken", head("c")) + F.col("rank") - head("c")).alias("depth"), "a", "b", "words")
    path = borrowed.unionAll(own).select("c", "depth", F.xxhash64("depth", "a", "b").alias("x"), F.xxhash64("b", "depth", "a").alias("y"), "words")
    zero = F.lit(0).cast("long")
    return path.unionAll(convs.select("c", zero.alias("depth"), zero.alias("x"), zero.alias("y"), zero.alias("words")))


def prefixes(path: DataFrame) -> DataFrame:
    """A row for every conversation and depth with the name of its node and of the one above: c, depth, kx, ky, px, py, words."""
    path = path.withColumn("range", F.call_function("div", "depth", F.lit(SPAN)))
    here = Window.partitionBy("c", "range").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("c").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    totals = path.groupBy("c", "range").agg(F.bit_xor("x").alias("tx"), F.bit_xor("y").alias("ty"))
    totals = totals.select("c", "range", F.bit_xor("tx").over(before).alias("bx"), F.bit_xor("ty").over(before).alias("by")).where("range > 0")
    rows = path.withColumns({"hx": F.bit_xor("x").over(here), "hy": F.bit_xor("y").over(here)}).join(totals, ["c", "range"], "left")
    rows = rows.withColumns({"kx": F.col("hx").bitwiseXOR(F.coalesce("bx", F.lit(0))), "ky": F.col("hy").bitwiseXOR(F.coalesce("by", F.lit(0)))})
    return rows.select("c", "depth", "kx", "ky", F.col("kx").bitwiseXOR(F.col("x")).alias("px"), F.col("ky").bitwiseXOR(F.col("y")).alias("py"), "words")


def nodes_of(path: DataFrame) -> DataFrame:
    """Nodes: depth, kx, ky, conv_id, n_convs, own (tokens saved at it), parent_conv_id, parent_n, n_children."""
    nodes = cut(prefixes(path).groupBy(*NODE).agg(F.min("c").alias("conv_id"), F.count("*").alias("n_convs"), F.min("words").alias("words"), F.min("px").alias("px"), F.min("py").alias("py")))
    nodes = nodes.select(*NODE, "conv_id", "n_convs", ((F.col("n_convs") - 1) * F.col("words")).alias("own"), (F.col("depth") - 1).alias("up"), "px", "py")
    children = nodes.groupBy(F.col("up").alias("depth"), F.col("px").alias("kx"), F.col("py").alias("ky")).agg(F.count("*").alias("n_children"))
    above = nodes.select(F.col("depth").alias("up"), F.col("kx").alias("px"), F.col("ky").alias("py"), F.col("conv_id").alias("parent_conv_id"), F.col("n_convs").alias("parent_n"))
    return lookup(nodes, above, ["up", "px", "py"]).drop("up", "px", "py").join(children, NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))


def peeled(nodes: DataFrame) -> DataFrame:
    """Totals of every chain's subtree: conv_id, n_convs, n_leaves, saved. A chain is the nodes of equal smallest member and number of members.

    Each round the chains without remaining children send one message to the
    chain above, where messages are summed before they are shuffled.
    """
    chains = nodes.groupBy("conv_id", "n_convs").agg(
        F.max_by("n_children", "depth").alias("remaining"),
        F.sum("own").alias("saved"),
        F.min_by(F.struct(F.col("parent_conv_id").alias("conv_id"), F.col("parent_n").alias("n_convs")), "depth").alias("parent"),
    )
    active = cut(chains.withColumn("n_leaves", (F.col("remaining") == 0).cast("long")))
    done = []
    while True:
        done.append(active.where("remaining = 0"))
        sent = done[-1].groupBy(F.col("parent.conv_id").alias("conv_id"), F.col("parent.n_convs").alias("n_convs")).agg(F.count("*").alias("came"), F.sum("n_leaves").alias("leaves"), F.sum("saved").alias("more"))
        held = active.where("remaining > 0").join(sent, ["conv_id", "n_convs"], "left")
        active = cut(held.select("conv_id", "n_convs", (F.col("remaining") - F.coalesce("came", F.lit(0))).alias("remaining"), (F.col("saved") + F.coalesce("more", F.lit(0))).alias("saved"), "parent", (F.col("n_leaves") + F.coalesce("leaves", F.lit(0))).alias("n_leaves")))
        if active.isEmpty():
            break
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out.select("conv_id", "n_convs", "n_leaves", "saved")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest of all strings of a node; its rows come one after another, and only a digest's state is kept."""
    at, state = None, None
    for batch in batches:
        out = []
        for *key, text in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            if key != at:
                if at is not None:
                    out.append((*at, state.hexdigest()))
                at, state = key, hashlib.sha256(text.encode())
            else:
                state.update(b"," + text.encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.int64()] * 3 + [pa.string()], strict=True)], [*NODE, "ends_sha256"])
    if at is not None:
        yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip((*at, state.hexdigest()), [pa.int64()] * 3 + [pa.string()], strict=True)], [*NODE, "ends_sha256"])


def ends_of(path: DataFrame) -> DataFrame:
    """Digests of the ids of the conversations that end at each node: depth, kx, ky, ends_sha256. Ids are joined by ranges first, so a node at which very many end gets a few strings."""
    ends = path.groupBy("c").agg(F.max("depth").alias("depth"), F.bit_xor("x").alias("kx"), F.bit_xor("y").alias("ky"))
    strings = ends.groupBy(*NODE, F.floor(F.col("c") / IDS).alias("range")).agg(F.array_join(F.sort_array(F.collect_list("c")), ",").alias("ids"))
    return strings.repartition(*NODE).sortWithinPartitions(*NODE, "range").select(*NODE, "ids").mapInArrow(_digests, "depth long, kx long, ky long, ends_sha256 string")


def trie(turns: DataFrame) -> DataFrame:
    """The prefix tree of rebuilt conversations, a row a node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``turns``: conv_id, turn, role, text; other columns are ignored. Null roles and texts are empty; a null
    turn comes first; equal turns come in the order of hashes of role and text, so repeated rows are turns
    of their own. Rows without conv_id belong to no conversation. The remainder of a negative id has its
    sign. A conversation whose turns all fall away is a member of the root alone; an empty table has no
    root. Turns count as equal if two 64-bit hashes of role and text are.
    """
    path = cut(rebuilt(cut(ranked_turns(turns))))
    nodes = cut(nodes_of(path))
    shared = nodes.where("n_convs > 1")
    passed = Window.partitionBy("conv_id", "n_convs").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    totals = peeled(nodes).where("n_convs > 1")
    shared = shared.withColumn("passed", F.coalesce(F.sum("own").over(passed), F.lit(0))).join(totals, ["conv_id", "n_convs"])
    columns = [*NODE, "conv_id", "n_convs", "parent_conv_id", "n_children"]
    # what a single conversation goes on with is one chain, which saves nothing
    rows = nodes.where("n_convs = 1").select(*columns, F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"))
    rows = rows.unionByName(shared.select(*columns, "n_leaves", (F.col("saved") - F.col("passed")).alias("saved_tokens")))
    nobody = hashlib.sha256(b"").hexdigest()
    return rows.join(ends_of(path), NODE, "left").select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(nobody)).alias("ends_sha256"))


#: DuckDB SQL of ``trie`` over ``conversations``; the checksum is folded bit by bit.
ORACLE = """WITH RECURSIVE t AS (SELECT conv_id, list((coalesce(role, ''), coalesce(text, '')) ORDER BY turn NULLS FIRST) AS own FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (SELECT *, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(conv_id::VARCHAR, ''), lambda d: ascii(d)::BIGINT)),
  lambda c, d: list_reduce(list_concat([xor(c, d)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda v, z: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)), 4294967295) % 4 AS h FROM t),
r AS (SELECT a.conv_id, list_concat(coalesce(b.own, [])[1:a.h], a.own[a.h + 1:]) AS turns FROM h a LEFT JOIN h b ON b.conv_id = a.conv_id - a.conv_id % 20),
p AS (SELECT conv_id, len(turns) AS n, unnest(range(0, len(turns) + 1)) AS depth, turns FROM r),
q AS (SELECT conv_id, n, depth, sha256(turns[1:depth]::VARCHAR) AS name, CASE WHEN depth > 0 THEN sha256(turns[1:depth - 1]::VARCHAR) END AS above,
  CASE WHEN depth > 0 THEN len(regexp_extract_all(turns[depth][2], '[^\\x20\\x09-\\x0D]+')) ELSE 0 END AS words FROM p),
nodes AS (SELECT depth, name, any_value(above) AS above, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(words) AS own,
  sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE n = depth), '')) AS ends_sha256 FROM q GROUP BY depth, name),
kids AS (SELECT above AS name, depth - 1 AS depth, count(*) AS n FROM nodes WHERE above IS NOT NULL GROUP BY ALL),
full_nodes AS (SELECT nodes.*, coalesce(kids.n, 0) AS n_children FROM nodes LEFT JOIN kids USING (name, depth)),
line AS (SELECT name, depth, above, name AS top, depth AS top_depth FROM full_nodes UNION ALL SELECT line.name, line.depth, up.above, up.name, up.depth FROM line JOIN full_nodes up ON up.name = line.above AND up.depth = line.top_depth - 1),
sums AS (SELECT top AS name, top_depth AS depth, sum(own)::BIGINT AS saved_tokens, count(*) FILTER (WHERE n_children = 0) AS n_leaves FROM line JOIN full_nodes USING (name, depth) GROUP BY ALL)
SELECT a.conv_id, a.depth, b.conv_id AS parent_conv_id, a.n_convs, a.n_children, s.n_leaves, s.saved_tokens, a.ends_sha256
FROM full_nodes a JOIN sums s USING (name, depth) LEFT JOIN full_nodes b ON b.name = a.above AND b.depth = a.depth - 1"""
