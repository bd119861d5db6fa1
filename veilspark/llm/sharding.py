"""Sharding by a k-d tree over metadata.

A node is split at the weighted median of its widest dimension until there are as many leaves
as the target bytes call for.  Medians are found by distributed histograms: every round
sums the weights of at most 4096 intervals of each node's bracket - so at most 4096 rows a
node reach the driver, whatever the input - and narrows the bracket, all nodes of a level in one
pass over a small written table of metadata (no texts).  The finished tree is one nested
CASE expression, so dealing the rows out takes a projection and no shuffle.

A row's coordinate on a dimension is followed by the CRC-32 of its text, so equal texts share
all coordinates and go to one leaf together.  A cut moves to the edge of such a group if that
costs no more than the tolerance, a hundredth of a shard's bytes; only a group too large for that is cut
itself, by row.

Slots are numbered without putting a shard into one task: rows fall by hash into parts
of about a thousand, parts are counted, and a row's slot is its place in its part after the
parts before it.

Defined results: a null text has size 1 and the CRC-32 of nothing, 0; null ids and
other columns play no part; repeated rows are rows of their own; an empty table has no shards.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspark.llm.common import materialize, partitioned

#: Intervals of a histogram round.
INTERVALS = 4096
#: Leaves whose tree still is one expression.
MOST_LEAVES = 1024


@dataclass
class Node:
    """Cut of a node: rows with key < cut, or key = cut and row < row_cut, go to the left."""

    leaves: int
    first: int
    dimension: int = 0
    cut: int = 0
    row_cut: int = 0
    left: Node | None = None
    right: Node | None = None


def metadata(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Written table of id, size, text_crc32, a row key and a key for each dimension."""
    text = F.col(f"`{text_column}`")
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1
    letters = F.coalesce(F.length(text), F.lit(0)).cast("long") + 1
    lines = F.coalesce(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))), F.lit(0)).cast("long")
    crc = F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long")
    rows = docs.select(
        F.col(f"`{id_column}`").alias("id"), size.alias("size"), crc.alias("text_crc32"),
        F.log2(size).alias("d0"), F.log2(lines + 1).alias("d1"), (size / letters).cast("double").alias("d2"),
        F.monotonically_increasing_id().alias("row"),
    )
    return materialize(rows, "metadata")


DIMENSIONS = ("d0", "d1", "d2")


def leaf_of(tree: Node, keys: list[Column], row: Column) -> Column:
    """The number of a row's leaf as one expression."""
    if tree.left is None:
        return F.lit(tree.first)
    k = keys[tree.dimension]
    goes = (k < tree.cut) | ((k == tree.cut) & (row < tree.row_cut)) if tree.row_cut else k < tree.cut
    return F.when(goes, leaf_of(tree.left, keys, row)).otherwise(leaf_of(tree.right, keys, row))


def build_tree(meta: DataFrame, keys: list[Column], row: Column, leaves: int, first: int = 0, stop: int = 1, tolerance: float = 0.01) -> Node:
    """Split until every leaf, or node of ``stop`` leaves, has an equal share of the bytes, up to ``tolerance`` of a share."""
    root = Node(leaves, first)
    open_ = [root] if leaves > stop else []
    share = None
    while open_:
        at = leaf_of(root, keys, row)
        widths = [(F.max(k) - F.min(k)).cast("double").alias(f"w{i}") for i, k in enumerate(keys)]
        ends = [f(k).alias(f"{n}{i}") for i, k in enumerate(keys) for n, f in (("lo", F.min), ("hi", F.max))]
        stats = {r.node: r for r in meta.select("*", at.alias("node")).groupBy("node").agg(F.sum("size").alias("bytes"), *widths, *ends).collect()}  # one row a node
        share = share or sum(r.bytes for r in stats.values()) / leaves
        live = [n for n in open_ if n.first in stats]
        goal, seek = {}, {}
        for n in live:
            r = stats[n.first]
            n.dimension = max(range(len(keys)), key=lambda i: (r[f"w{i}"], -i))
            goal[n.first] = r.bytes * (n.leaves // 2) / n.leaves
            seek[n.first] = [r[f"lo{n.dimension}"], r[f"hi{n.dimension}"] + 1, 0, False]  # bracket, bytes before it, by row
        while seek:
            # Each node's bracket falls into intervals of one width; bytes are summed for each.
            by = {n.first: n for n in live if n.first in seek}
            bits = {k: max(0, (hi - lo - 1).bit_length() - INTERVALS.bit_length() + 1) for k, (lo, hi, _, _) in seek.items()}
            step = {k: 1 << b for k, b in bits.items()}
            interval = F.lit(None).cast("long")
            for k, (lo, hi, _, rows) in seek.items():
                x = row if rows else keys[by[k].dimension]
                inside = (F.col("node") == k) & (x >= lo) & (x < hi)
                if rows:
                    inside = inside & (keys[by[k].dimension] == by[k].cut)
                interval = F.when(inside, F.shiftright(x - lo, bits[k])).otherwise(interval)
            counted = meta.select(at.alias("node"), "*").select("node", interval.cast("long").alias("i"), "size").filter("i is not null").groupBy("node", "i").agg(F.sum("size").alias("bytes")).collect()
            sums: dict[int, list[tuple[int, int]]] = {}
            for r in counted:  # at most INTERVALS rows a node
                sums.setdefault(r.node, []).append((r.i, r.bytes))
            for k in list(seek):
                lo, hi, before, rows = seek[k]
                total, edge, inner = before, lo, None
                for i, size in sorted(sums.get(k, [])):
                    if total + size > goal[k]:
                        inner = (lo + i * step[k], size)
                        break
                    total += size
                    edge = lo + (i + 1) * step[k]
                n, slack = by[k], tolerance * share
                if inner is None:
                    cut, done = min(edge, hi), True
                else:
                    after = total + inner[1] - goal[k]
                    done = min(goal[k] - total, after) <= slack
                    cut = inner[0] if goal[k] - total <= after else inner[0] + step[k]
                if rows:
                    n.row_cut = cut
                else:
                    n.cut = cut
                if done or (rows and step[k] == 1):
                    del seek[k]
                elif step[k] == 1:  # one group of equal texts: cut it by row
                    n.cut = inner[0]
                    seek[k] = [0, 1 << 62, total, True]
                else:
                    seek[k] = [inner[0], inner[0] + step[k], total, rows]
        new = []
        for n in open_:
            half = n.leaves // 2
            n.left, n.right = Node(half, n.first), Node(n.leaves - half, n.first + half)
            new += [x for x in (n.left, n.right) if x.leaves > stop]
        open_ = new
    return root


def top_nodes(tree: Node) -> list[Node]:
    return [tree] if tree.left is None else top_nodes(tree.left) + top_nodes(tree.right)


def shard(docs: DataFrame, shards: int | None = 16, target_bytes: int | None = None, id_column: str = "doc_id", text_column: str = "text", part_rows: int = 1000, most_leaves: int = MOST_LEAVES) -> DataFrame:
    """(id, size, text_crc32, shard, slot) of every row.

    ``target_bytes``, where given, sets the number of shards: bytes / target, rounded up.  More
    than ``most_leaves`` shards make trees of two levels.
    """
    meta = metadata(docs, id_column, text_column)
    spans = meta.agg(F.sum("size").alias("bytes"), F.count("*").alias("n"), *[f(d).alias(f"{x}_{d}") for d in DIMENSIONS for x, f in (("lo", F.min), ("hi", F.max))]).first()
    if target_bytes:
        shards = max(1, -(-(spans.bytes or 0) // target_bytes))
    scale = lambda d: float((1 << 30) - 1) / max((spans[f"hi_{d}"] or 0.0) - (spans[f"lo_{d}"] or 0.0), 1e-9)
    # 30 bits of the coordinate, of the widest range at the root, then 32 of the text's CRC-32.
    place = lambda d: F.floor((F.col(d) - F.lit(spans[f"lo_{d}"] or 0.0)) * F.lit(scale(d))).cast("long")
    keys = [F.shiftleft(place(d), 32) + F.col("text_crc32") for d in DIMENSIONS]
    row = F.shiftrightunsigned(F.xxhash64("row"), 2)
    parts = max(1, -(-(spans.n or 0) // (shards * part_rows)))
    part = F.pmod(F.xxhash64("row", F.lit(1)), F.lit(parts)).cast("int").alias("part")
    deal = lambda rows, tree: rows.select("id", "size", "text_crc32", leaf_of(tree, keys, row).cast("int").alias("shard"), row.alias("row"), part)
    top = build_tree(meta, keys, row, shards, stop=most_leaves)
    if top.left is None:
        dealt = deal(meta, build_tree(meta, keys, row, shards))
    else:  # a tree of its own below each of the top's nodes, over the rows of that node
        below = top_nodes(top)
        met = partitioned(meta.withColumn("node", leaf_of(top, keys, row)), "node")
        dealt = reduce(DataFrame.union, [deal(own, build_tree(own, keys, row, n.leaves, n.first)) for n in below for own in [met.filter(F.col("node") == n.first).drop("node")]])
    counts = materialize(dealt.groupBy("shard", "part").agg(F.count("*").alias("n")), "counts")
    before = counts.select("shard", "part", (F.sum("n").over(Window.partitionBy("shard").orderBy("part")) - F.col("n")).alias("before"))
    number = F.row_number().over(Window.partitionBy("shard", "part").orderBy("row"))
    return dealt.join(before, ["shard", "part"]).select("id", "size", "text_crc32", "shard", (F.col("before") + number - 1).alias("slot"))


def shard_report(docs: DataFrame) -> DataFrame:
    return shard(docs).select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
