"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints come from one Arrow pass over whole texts.  Equal fingerprints are one node.
Candidate blocks hold the nodes that agree on some of the bits; a block's fingerprints are
stored as vertical bit planes (plane b has bit b of every member), so one machine operation
serves all of the members.  Distances of all pairs at one lag are summed at once by carry-save
counters that start at 2^k - 1 - radius, so that a carry out of the last plane means "beyond
the radius"; a lag is abandoned as soon as all of its pairs are.  Links become a
spanning forest within the block, never all pairs, and the forests' union is resolved by
distributed connected components.

A block of too many nodes is hot.  Its chunks are linked on their own first, and then only what
that leaves in different components meets across chunks (``block_links``).

With ``pigeonhole_tables`` the search is exact: two fingerprints that differ in at most r
bits agree on all but r of m bit groups.  A radius beyond the pigeonhole's reach, as a
similarity of 0.8 needs, takes its blocks from the smallest shingle hashes instead: groups of
fingerprint bits that such pairs share often enough are too short to tell millions of texts apart, and
more of them would be needed as the table grows.  ``drop_near_duplicates`` takes a link within
the radius for a candidate only: a link is two texts whose sets of shingles have the similarity asked for.

Defined results: a null or wordless text has fingerprint zero, linked like any other;
fewer words than a shingle make one shingle of them all; repeated rows share a fingerprint;
a null doc_id is never a component's name unless all of its rows lack one.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import acos, comb, pi

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm.common import fresh, materialize, ready, remove
from veilspark.llm.graph import connected_components

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
#: Rows of hashes whose bits are counted at a time.
SLICE = 1 << 16


def words_of(text: str | None) -> list[bytes]:
    """Words of a whole text as UTF-8, A to Z lower-cased.

    bytes.split() parts at space and U+0009 to U+000D, and no byte of a longer UTF-8
    sequence is among them.
    """
    return (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()


def shingle_hashes(words: list[bytes], k: int) -> np.ndarray:
    """XXH64 (seed 42) of each k-word shingle, repeats included; of all words where there are fewer."""
    if not words:
        return np.zeros(0, np.uint64)
    joined, h = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= k:
        return np.array([h(joined, 42)], np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[: -k].tolist()]
    stops = (ends[k - 1 :] - 1).tolist()
    return np.array([h(joined[a:b], 42) for a, b in zip(starts, stops, strict=True)], np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def print_of(h: np.ndarray, width: int = 1) -> bytes:
    """Big-endian bytes: a bit is 1 if set in over half of the hashes; ``width`` words of 64 bits, all but the first mixed from it."""
    counts = np.zeros(64 * width, np.int64)
    for i in range(0, len(h), SLICE):
        part = h[i : i + SLICE]
        words = np.stack([part, *(_mix(part + np.uint64((0x9E3779B97F4A7C15 * s) & (2**64 - 1))) for s in range(1, width))], axis=1)
        counts += np.unpackbits(words.astype(">u8").view(np.uint8).reshape(-1, 8 * width), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * counts > len(h)).tobytes()


def fingerprints(docs: DataFrame, k: int = 3, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, fingerprint as a signed number) of every row; repeats of a shingle count."""
    ready(docs.sparkSession)
    kind = docs.schema[id_column].dataType.simpleString()
    src = docs.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{text_column}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [int.from_bytes(print_of(shingle_hashes(words_of(t.as_py()), k)), "big", signed=True) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.int64())], ["id", "node"])

    return src.mapInArrow(run, f"id {kind}, node bigint")


def pigeonhole_tables(bits: int, radius: int, nodes: int) -> list[list[int]]:
    """Bit positions of each table's key; more and narrower groups, so longer keys, for more nodes."""
    m = radius + 1
    while m < radius + 4 and bits * (m - radius) / m < np.log2(max(nodes, 2)):
        m += 1
    groups = [list(map(int, x)) for x in np.array_split(np.arange(bits), m)]
    return [sum(keep, []) for keep in combinations(groups, m - radius)]


def radius_recall(similarity: float, bits: int, radius: int) -> float:
    """Share of pairs of that Jaccard similarity whose fingerprints are within the radius.

    Sets of equal size, the worst case, have the cosine 2J / (1 + J); a bit differs with the angle's share of pi.
    """
    p = acos(2 * similarity / (1 + similarity)) / pi
    return sum(comb(bits, d) * p**d * (1 - p) ** (bits - d) for d in range(radius + 1))


def joint_recall(similarity: float, bits: int, radius: int, tables: int, minima: int) -> float:
    """Share of pairs of that similarity that also share one of ``tables`` keys of ``minima`` smallest hashes each."""
    return radius_recall(similarity, bits, radius) * (1 - (1 - similarity**minima) ** tables)


def smallest_hashes(h: np.ndarray, tables: int, minima: int) -> list[int]:
    """Each table's key: of ``minima`` hash functions, the smallest values over all shingles, as one signed number."""
    if not len(h):
        h = np.zeros(1, np.uint64)
    out = []
    for t in range(tables):
        key = np.uint64(0x9E3779B97F4A7C15 * (t + 1) & (2**64 - 1))
        for m in range(minima):
            odd = np.uint64((0xD1342543DE82EF95 * (2 * (t * minima + m) + 3)) & (2**64 - 1) | 1)
            key = _mix(key ^ (h * odd).min())
        out.append(int(key.view(np.int64)))
    return out


def _keys(batches: Iterator[pa.RecordBatch], tables: list[list[int]]) -> Iterator[pa.RecordBatch]:
    """A row (block, node, fp) for each table; node is a fingerprint's number."""
    for b in batches:
        if not b.num_rows:
            continue
        fp = b.column(0).to_numpy(zero_copy_only=False).astype(">i8").view(np.uint8).reshape(-1, 8)
        bits, raw = np.unpackbits(fp, axis=1), pa.array([x.tobytes() for x in fp], pa.binary())
        for t, at in enumerate(tables):
            key = np.zeros(len(fp), np.uint64)
            for x in at:
                key = (key << np.uint64(1)) | bits[:, x].astype(np.uint64)
            key = _mix(key + np.uint64((t + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1))).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(key), b.column(0), raw], ["block", "node", "fp"])


class Planes:
    """Vertical bit planes of a run of fingerprints, as integers of one bit a member."""

    def __init__(self, bits: np.ndarray, radius: int):
        self.n, self.radius = len(bits), radius
        packed = np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little")
        self.planes = [int.from_bytes(row.tobytes(), "little") for row in packed]
        self.levels = max(1, radius.bit_length())
        self.start = (1 << self.levels) - 1 - radius

    def cut(self, n: int) -> None:
        """Keep the first n members only."""
        keep = (1 << n) - 1
        self.planes = [p & keep for p in self.planes]
        self.n = n

    def within(self, lag: int, live: int) -> int:
        """The bits i of ``live`` for which members i and i + lag differ in at most radius bits."""
        ones = (1 << self.n) - 1
        acc = [ones if self.start >> k & 1 else 0 for k in range(self.levels)]
        wait: list[int | None] = [None] * self.levels
        over = 0
        for at, p in enumerate(self.planes, 1):
            x, k = p ^ (p >> lag), 0
            while True:
                if k == self.levels:
                    over |= x
                    break
                y = wait[k]
                if y is None:
                    wait[k] = x
                    break
                wait[k], a = None, acc[k]
                u = a ^ y
                acc[k], x = u ^ x, (a & y) | (u & x)
                k += 1
            if at % 8 == 0 and not live & ~over:
                return 0
        for k in range(self.levels):
            x, j = wait[k], k
            wait[k] = None
            while x:
                if j == self.levels:
                    over |= x
                    break
                acc[j], x, j = acc[j] ^ x, acc[j] & x, j + 1
        return live & ~over


def link_block(groups: np.ndarray, fps: np.ndarray, radius: int, labels: np.ndarray | None = None, shingles: list[np.ndarray] | None = None, percent: int = 80, buffer: int = 200_000) -> list[tuple[int, int]]:
    """A spanning forest's edges (row, row) of the links within each group.

    ``groups``: the group of each row, equal ones side by side; ``fps``: (n, bytes) uint8;
    ``labels``: rows of equal labels count as linked already; ``shingles``: each row's distinct
    shingle hashes, for links that also have that Jaccard similarity in percent.
    """
    edges = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]])
    sizes = np.diff(np.r_[edges, len(groups)])
    order = np.argsort(-sizes, kind="stable")
    order = order[sizes[order] > 1]
    if not len(order):
        return []
    rows = np.concatenate([np.arange(edges[g], edges[g] + sizes[g]) for g in order])
    sizes = sizes[order]
    group = np.repeat(np.arange(len(order)), sizes)
    planes = Planes(np.unpackbits(fps[rows], axis=1), radius)
    label = np.arange(len(rows))
    if labels is not None:
        label = np.unique(np.stack([group, np.unique(labels[rows], return_inverse=True)[1]]), axis=1, return_inverse=True)[1].reshape(-1)
    parts = np.bincount(np.unique(np.stack([group, label]), axis=1)[0], minlength=len(order))
    done, found, held, lag = parts == 1, [], [], 1
    alike = Overlap([shingles[r] for r in rows], percent) if shingles is not None else None

    def unite(i: np.ndarray, j: np.ndarray) -> None:
        """Take the links (i, j) that join different parts, where they are alike."""
        nonlocal label
        parent: dict[int, int] = {}

        def top(x: int) -> int:
            while x in parent:
                parent[x] = x = parent.get(parent[x], parent[x])
            return x

        def take(a: int, b: int) -> None:
            p, q = top(int(label[a])), top(int(label[b]))
            if p != q:
                parent[max(p, q)] = min(p, q)
                found.append((a, b))
                parts[group[a]] -= 1
                done[group[a]] = parts[group[a]] == 1

        if alike is None:
            for a, b in zip(i.tolist(), j.tolist(), strict=True):
                take(a, b)
        else:
            by = np.argsort(i, kind="stable")
            i, j = i[by], j[by]
            for at in np.split(np.arange(len(i)), np.flatnonzero(i[1:] != i[:-1]) + 1):
                a, mine = int(i[at[0]]), top(int(label[i[at[0]]]))
                apart = j[at][[top(int(x)) != mine for x in label[j[at]]]]
                for b in apart[alike.of(a, apart)].tolist() if len(apart) else []:
                    take(a, b)
        to = np.arange(int(label.max()) + 1)
        for x in parent:
            to[x] = top(x)
        label = to[label]

    while True:
        reach = int(np.searchsorted(-sizes, -lag, side="left"))  # groups with more than lag members
        n = int(sizes[:reach].sum())
        over = not n or done[:reach].all()
        if held and (over or sum(len(i) for i, _ in held) >= buffer):
            unite(np.concatenate([i for i, _ in held]), np.concatenate([j for _, j in held]))
            held.clear()
        if over:
            return [(int(rows[i]), int(rows[j])) for i, j in found]
        if n < planes.n:
            planes.cut(n)
        pair = (group[: n - lag] == group[lag:n]) & ~done[group[: n - lag]] & (label[: n - lag] != label[lag:n])
        live = int.from_bytes(np.packbits(pair, bitorder="little").tobytes(), "little") if pair.any() else 0
        hit = planes.within(lag, live) if live else 0
        if hit:
            i = np.flatnonzero(np.unpackbits(np.frombuffer(hit.to_bytes((n + 7) // 8, "little"), np.uint8), bitorder="little")).astype(np.int32)
            if alike is None:
                unite(i, i + lag)
            else:
                held.append((i, i + np.int32(lag)))
        lag += 1


class Overlap:
    """Jaccard similarity of one set with many at a time, over numbered shingles."""

    def __init__(self, sets: list[np.ndarray], percent: int):
        self.percent = percent
        self.sizes = np.array([len(x) for x in sets], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        names, self.flat = np.unique(np.concatenate(sets), return_inverse=True)
        self.flat = self.flat.astype(np.int32).reshape(-1)
        self.mark = np.zeros(len(names), bool)

    def of(self, a: int, others: np.ndarray) -> np.ndarray:
        """Whether set a and each of the others, none of them empty, are that similar."""
        mine = self.flat[self.starts[a] : self.starts[a] + self.sizes[a]]
        self.mark[mine] = True
        sizes = self.sizes[others]
        begins = np.cumsum(sizes) - sizes
        at = np.arange(int(sizes.sum())) + np.repeat(self.starts[others] - begins, sizes)
        both = np.add.reduceat(self.mark[self.flat[at]].astype(np.int64), begins)
        self.mark[mine] = False
        return 100 * both >= self.percent * (self.sizes[a] + sizes - both)


def _compare(batches: Iterator[pa.RecordBatch], radius: int, rows: int, size: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Edges within the groups of a partition sorted by group; ``rows`` rows or ``size`` bytes, and a group, are held.

    Columns: group, node, fingerprint, label, and perhaps shingles.
    """
    held: list[list] = []
    count = weight = 0

    def flush(last: bool) -> Iterator[pa.RecordBatch]:
        nonlocal count, weight
        g, f, label = (np.concatenate([x[k] for x in held]) for k in (0, 2, 3))
        nodes = pa.concat_arrays([x[1] for x in held])
        sets = [y for x in held for y in x[4]] if held[0][4] is not None else None
        end = len(g) if last else int(np.searchsorted(g, g[-1], side="left"))
        held.clear()
        if end < len(g):
            held.append([g[end:], nodes.slice(end), f[end:], label[end:], sets and sets[end:]])
        count, weight = len(g) - end, sum(x.nbytes for x in sets[end:]) if sets else 0
        e = link_block(g[:end], f[:end], radius, label[:end], sets and sets[:end], percent) if end else []
        if e:
            i, j = zip(*e, strict=True)
            yield pa.RecordBatch.from_arrays([nodes.take(pa.array(i)), nodes.take(pa.array(j))], ["a", "b"])

    for b in batches:
        for at in range(0, b.num_rows, 1024):
            part = b.slice(at, 1024)
            fp = np.frombuffer(b"".join(part.column(2).to_pylist()), np.uint8).reshape(part.num_rows, -1)
            sets = [np.frombuffer(x.as_py(), np.uint64) for x in part.column(4)] if part.num_columns > 4 else None
            held.append([part.column(0).to_numpy(zero_copy_only=False), part.column(1), fp, part.column(3).to_numpy(zero_copy_only=False), sets])
            count += part.num_rows
            weight += sum(x.nbytes for x in sets) if sets else 0
            if count >= rows or weight >= size:
                yield from flush(False)
    if held:
        yield from flush(True)


def block_links(rows: DataFrame, radius: int, chunk: int, percent: int = 80, chunk_bytes: int = 1 << 23, n_rows: int | None = None) -> DataFrame:
    """Edges (a, b) that connect all nodes which the links within blocks connect, a forest for each block.

    ``rows``: block (bigint), node, fp (binary) and perhaps shingles (binary), by the node.  A block of
    more than ``chunk`` nodes, or ``chunk_bytes`` of shingles, is hot: its nodes are dealt by hash to
    chunks that are linked each on their own.  Of what that leaves in different components, the
    nodes outside the block's largest one meet all chunks, in chunks of their own: every pair that
    may still count is compared, and no task holds more than two chunks.  ``n_rows``: see materialize().
    """
    has = "shingles" in rows.columns
    payload = ["node", "fp", *(["shingles"] if has else [])]
    kind = rows.schema["node"].dataType.simpleString()
    weight = F.sum(F.length("shingles")) if has else F.lit(0)
    pieces = F.greatest(F.ceil(F.col("n") / chunk), F.ceil(F.col("bytes") / chunk_bytes)).cast("int")
    big = materialize(rows.groupBy("block").agg(F.count("*").alias("n"), weight.alias("bytes")).filter(f"n > {chunk} or (n > 1 and bytes > {chunk_bytes})").select("block", pieces.alias("chunks")), "big", n_rows)
    size = F.xxhash64("node")
    dealt = rows.join(big, "block", "left").withColumn("group", F.when(F.col("chunks").isNull(), F.col("block")).otherwise(F.xxhash64("block", F.pmod(size, F.col("chunks")))))

    def compare(frame: DataFrame, label) -> DataFrame:
        cols = [F.col("group"), F.col("node"), F.col("fp"), label.alias("label"), *([F.col("shingles")] if has else [])]
        blocks = frame.select(*cols).repartition("group").sortWithinPartitions("group")
        return blocks.mapInArrow(lambda it: _compare(it, radius, 4 * chunk, 4 * chunk_bytes, percent), f"a {kind}, b {kind}")

    first = materialize(compare(dealt, size), "first", n_rows)
    if big.isEmpty():
        return first
    parts = materialize(connected_components(first), "parts", n_rows)
    hot = rows.join(big, "block").join(parts, "node", "left").select("block", *payload, "chunks", F.xxhash64(F.coalesce("component", "node")).alias("label"))
    shares = materialize(hot.groupBy("block", "label").agg(F.count("*").alias("n")), "shares", n_rows)
    main = shares.groupBy("block").agg(F.max_by("label", F.struct("n", "label")).alias("main"), (F.sum("n") - F.max("n")).alias("others"))
    split = materialize(main.filter("others > 0").join(big, "block").select("block", "main", "chunks", F.least("chunks", F.ceil(F.col("others") / chunk).cast("int")).alias("few")), "split", n_rows)
    met = hot.drop("chunks").join(split, "block")
    # A node of the main component is in chunk c of them; another one, in chunk d of the few, meets all c and all of the few.
    c, d = F.pmod(size, F.col("chunks")).cast("int"), F.pmod(F.xxhash64("node", F.lit(1)), F.col("few")).cast("int")
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    pair = lambda side, x, y: F.struct(F.lit(side).alias("side"), x.alias("x"), y.alias("y"))
    mains = F.transform(upto(F.col("few")), lambda y: pair(0, c, y))
    others = F.concat(F.transform(upto(F.col("chunks")), lambda x: pair(0, x, d)), F.transform(upto(F.col("few")), lambda y: pair(1, F.least(d, y), F.greatest(d, y))))
    spread = met.select("block", *payload, "label", F.explode(F.when(F.col("label") == F.col("main"), mains).otherwise(others)).alias("to"))
    second = compare(spread.withColumn("group", F.xxhash64("block", "to.side", "to.x", "to.y")), F.col("label"))
    out = materialize(parts.select(F.col("node").alias("a"), F.col("component").alias("b")).union(second), "second")
    for t in (big, first, parts, shares, split):
        remove(t)
    return out


def group_near_duplicates(docs: DataFrame, k: int = 3, radius: int = 2, tables: list[list[int]] | None = None, id_column: str = "doc_id", chunk: int = 1 << 13) -> DataFrame:
    """(id, fingerprint, component_id) of every row; component_id is the smallest id reachable."""
    prints = materialize(fingerprints(docs, k, id_column), "prints")
    n = prints.count()
    nodes = materialize(prints.groupBy("node").agg(F.min("id").alias("least")), "nodes", n)
    tables = tables or pigeonhole_tables(64, radius, nodes.count())
    rows = materialize(nodes.select("node").mapInArrow(lambda it: _keys(it, tables), "block bigint, node bigint, fp binary"), "rows")
    found = block_links(rows, radius, chunk, n_rows=n * len(tables))
    parts = materialize(connected_components(found), "parts", n)
    some = parts.select("node").union(parts.select("component")).distinct()
    linked = nodes.join(some, "node").join(parts, "node", "left").select("node", "least", F.coalesce("component", "node").alias("part"))
    linked = materialize(linked, "linked", n)
    names = linked.groupBy("part").agg(F.min("least").alias("component_id"))
    mapped = materialize(linked.join(names, "part").select("node", "component_id"), "mapped", n)
    named = materialize(nodes.join(mapped, "node", "left").select("node", F.coalesce("component_id", "least").alias("component_id")), "named", n)
    for t in (rows, found, parts, linked, mapped):
        remove(t)
    return prints.join(named, "node").select("id", F.lower(F.lpad(F.hex("node"), 16, "0")).alias("fingerprint"), "component_id")


def similar(a: list[bytes], b: list[bytes], k: int, percent: int) -> bool:
    """Whether the sets of k-word shingles have at least that Jaccard similarity; wordless texts are alike."""
    x, y = _shingles(a, k), _shingles(b, k)
    both = len(x & y)
    return 100 * both >= percent * (len(x) + len(y) - both)


def _shingles(words: list[bytes], k: int) -> set[bytes]:
    return {b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def _distinct(text: str | None, k: int) -> np.ndarray:
    """The distinct shingle hashes of a text, sorted; a wordless text has the one of no words."""
    h = np.unique(shingle_hashes(words_of(text), k))
    return h if len(h) else np.zeros(1, np.uint64)


def similar_groups(docs: DataFrame, k: int, width: int, radius: int, percent: int, tables: int, minima: int, id_column: str, text_column: str = "text", chunk: int = 1 << 11) -> tuple[DataFrame, DataFrame]:
    """The rows' texts as (id, node), and (node, part) of each text that is similar to another; part is the smallest node reachable.

    First the candidates: fingerprints within the radius in a block, as forests whose components
    hold both ends of every candidate pair.  Then each component is a block, and its members are
    compared all over again, now with their shingles: a link within the radius also has
    the similarity, and nothing but forests leaves a task.
    """
    ready(docs.sparkSession)
    kind = docs.schema[id_column].dataType.simpleString()
    texts = docs.select(F.col(f"`{id_column}`").alias("id"), F.unhex(F.md5(F.coalesce(F.col(f"`{text_column}`"), F.lit("")))).alias("node"), F.col(f"`{text_column}`").alias("text"))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = [np.unique(shingle_hashes(words_of(t.as_py()), k)) for t in b.column(2)]
            fps = pa.array([print_of(x, width) for x in h], pa.binary())
            keys = pa.array([smallest_hashes(x, tables, minima) for x in h], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), fps, keys], ["id", "node", "fp", "keys"])

    prints = materialize(texts.mapInArrow(sketch, f"id {kind}, node binary, fp binary, keys array<bigint>"), "prints")
    n = prints.count()
    nodes = materialize(prints.groupBy("node").agg(F.min("id").alias("least"), F.first("fp").alias("fp"), F.first("keys").alias("keys")), "nodes", n)
    near = block_links(nodes.select(F.explode("keys").alias("block"), "node", "fp"), radius, 1 << 13, n_rows=n * tables)
    parts = materialize(connected_components(near), "parts", n)
    members = materialize(parts.select("node", "component").union(parts.select(F.col("component").alias("node"), "component").distinct()), "members", n)
    m = members.count()
    wanted = materialize(nodes.join(members, "node").select("node", F.col("least").alias("id"), "fp", F.xxhash64("component").alias("block")), "wanted", n)

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = pa.array([_distinct(t.as_py(), k).tobytes() for t in b.column(3)], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns[:3], sets], ["block", "node", "fp", "shingles"])

    found = texts.join(wanted, ["id", "node"]).select("block", "node", "fp", "text")
    held = materialize(found.mapInArrow(shingled, "block bigint, node binary, fp binary, shingles binary"), "held")
    repeats = held.groupBy("node").count().filter("count > 1")
    once = held if repeats.isEmpty() else held.dropDuplicates(["node"])
    links = block_links(once, radius, chunk, percent, n_rows=20 * m)  # rows with their shingles are large
    groups = materialize(connected_components(links), "groups", m)
    out = materialize(groups.select("node", F.col("component").alias("part")).union(groups.select(F.col("component").alias("node"), F.col("component").alias("part")).distinct()), "similar", m)
    for t in (near, parts, members, wanted, held, links, groups, nodes):
        remove(t)
    return prints.select("id", "node"), out


def drop_near_duplicates(docs: DataFrame, k: int = 5, width: int = 4, radius: int = 63, percent: int = 80, tables: int = 8, minima: int = 2, id_column: str = "doc_id", chunk: int = 1 << 11) -> DataFrame:
    """One document of each group stays, the one with the smallest id; the table's own columns.

    A link is a pair of texts with a Jaccard similarity of at least ``percent`` of their sets of
    five-word shingles, as 64-bit hashes, computed exactly; groups are the links' components.
    Fingerprints only find the candidates, and are compared in blocks of texts that share one of
    ``tables`` keys of ``minima`` smallest shingle hashes: at 0.8, 39 of 256 bits differ on
    average with a standard deviation of 5.7, and the defaults miss three such pairs in ten thousand
    (``joint_recall``).

    Rows that share an id but not their text are told apart; of rows that share both, one
    stays.  Rows without an id, which nothing could be told apart by, all stay.
    """
    some = docs.filter(F.col(f"`{id_column}`").isNotNull())
    rows, parts = similar_groups(some, k, width, radius, percent, tables, minima, id_column, chunk=chunk)
    grouped = rows.join(parts, "node", "left").select("id", "node", F.coalesce("part", "node").alias("part"))
    n = rows.count()
    counted = materialize(grouped.groupBy("part", "id", "node").agg(F.count("*").alias("n")), "counted", n)
    first = counted.groupBy("part").agg(F.min(F.struct("id", "node")).alias("first"), F.count("*").alias("size")).filter("size > 1")
    gone = materialize(counted.join(first, "part").filter("id != first.id or node != first.node").select("id", "node"), "gone", n)
    repeated = materialize(counted.filter("n > 1").join(gone, ["id", "node"], "left_anti").select("id", "node"), "repeated", n)
    node, one = fresh(docs, "node"), fresh(docs, "one")
    own = F.unhex(F.md5(F.coalesce(F.col("text"), F.lit(""))))
    named = lambda df: df.select(F.col("id").alias(id_column), F.col("node").alias(node))
    stay = docs.withColumn(node, own).join(named(gone), [id_column, node], "left_anti")
    if not repeated.isEmpty():  # a repeated row is one document
        same = stay.join(named(repeated), [id_column, node], "left_semi").withColumn(one, F.struct(*[F.col(f"`{c}`") for c in docs.columns]))
        stay = stay.join(named(repeated), [id_column, node], "left_anti").unionByName(same.groupBy(id_column, node).agg(F.min(one).alias(one)).select(f"{one}.*", node))
    return stay.select(*[F.col(f"`{c}`") for c in docs.columns])
