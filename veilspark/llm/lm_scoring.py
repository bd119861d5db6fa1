"""Language-model scoring by a hierarchical Pitman-Yor process over word pairs.

A text's word is drawn from the restaurant of the word before it (begin mark: the first word);
all of these context restaurants share one parent, the restaurant of single words, whose own
parent is uniform over the V known words and one unknown.  Customers are the words of the
training texts; each table of a context restaurant is one customer of the parent.

Seating is sampled by Gibbs sweeps.  A sweep draws the number of tables of each (context, word)
from its conditional distribution, p(t) proportional to S(c, t) b^t - S: generalised Stirling numbers of
the discount, b: weight of a new table given all the rest of the restaurant and its parent - so
the customers of a dish are seated anew together.  Contexts are dealt to buckets, and within a sweep a bucket
uses the state of the sweep before (all dishes at once), and a parent seated from its own tables; the tables
of all buckets then become the customers of the one shared parent, which is seated by sweeps of its
own.  The score averages predictive probabilities over the sweeps that are kept; they are
linear in the numbers of tables, so averaging these is the same thing.

Data moves as packed arrays.  Texts are cut into blocks of some million tokens; a block sends its
distinct pairs with their counts to the pairs' buckets and its words to the words' shards, both
answer in the order of the question, and the block adds up its texts.  A context with more than a
quarter of a bucket's share of the tokens is split over several buckets by the second word, so no bucket
grows with the commonest word; the number of buckets and shards grows with the corpus.

Defined results: a null text is empty and is one end mark; a null id counts as training (its
CRC-32 is that of no text); repeated rows count as often as they stand; with no training
text all words are unknown and all scores are those of the uniform distribution; an
empty table gives no rows.  Words are told apart by their 64-bit XXH64.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm.common import materialize, ready, release
from veilspark.llm.simhash import words_of

#: No word holds white space, so these hashes are no word's.
END, BEGIN = xxhash.xxh64_intdigest(b"\n"), xxhash.xxh64_intdigest(b"\t")
#: Counts up to here are drawn from exact Stirling numbers, larger ones by the saddle point.
EXACT = 64
MESSAGE = "key bigint, kind string, src bigint, x binary, y binary, z binary"
ARROW = pa.schema([("key", pa.int64()), ("kind", pa.string()), ("src", pa.int64()), ("x", pa.binary()), ("y", pa.binary()), ("z", pa.binary())])


def pack(a: np.ndarray, ascending: bool = False) -> bytes:
    """Compressed byte planes; of ascending unsigned numbers, those of their steps."""
    a = np.diff(a, prepend=a.dtype.type(0)) if ascending else np.ascontiguousarray(a)
    return zstandard.compress(a.view(np.uint8).reshape(-1, a.itemsize).T.tobytes(), 1)


def unpack(b: bytes, kind, ascending: bool = False) -> np.ndarray:
    size = np.dtype(kind).itemsize
    a = np.frombuffer(zstandard.decompress(b), np.uint8).reshape(size, -1).T.copy().reshape(-1).view(kind)
    return np.cumsum(a, dtype=kind) if ascending else a


# ---------------------------------------------------------------------------------------- seating


def log_stirling(most: int, d: float) -> np.ndarray:
    """Logarithms of generalised Stirling numbers S(c, t) of discount d; -inf where there are none."""
    s = np.full((most + 1, most + 1), -np.inf)
    s[1, 1] = 0.0
    for c in range(1, most):
        t = np.arange(1, c + 2)
        with np.errstate(divide="ignore"):
            s[c + 1, 1 : c + 2] = np.logaddexp(s[c, : c + 1], s[c, 1 : c + 2] + np.log(np.maximum(c - t * d, 0)))
    return s


def draw_tables(c: np.ndarray, b: np.ndarray, d: float, rng: np.random.Generator, stirling: np.ndarray) -> np.ndarray:
    """Tables of dishes with c customers: p(t) proportional to S(c, t) b^t, 1 <= t <= c."""
    t = np.ones(len(c), np.int64)
    two = np.flatnonzero(c == 2)
    t[two] += rng.random(len(two)) * (b[two] + 1 - d) < b[two]
    rest = np.flatnonzero((c > 2) & (c <= EXACT))
    rest = rest[np.argsort(c[rest].astype(np.uint8), kind="stable")]
    ends = np.searchsorted(c[rest], np.arange(3, EXACT + 2))
    for k, (lo, hi) in enumerate(zip(ends, ends[1:], strict=False), 3):
        for a in range(lo, hi, 1 << 16):
            at = rest[a : min(hi, a + (1 << 16))]
            p = stirling[k, 1 : k + 1][:, None] + np.arange(1, k + 1)[:, None] * np.log(b[at])
            p = np.cumsum(np.exp(p - p.max(axis=0)), axis=0)
            t[at] = 1 + (p < rng.random(len(at)) * p[-1]).sum(axis=0)
    big = np.flatnonzero(c > EXACT)
    if len(big):
        t[big] = _draw_large(c[big].astype(float), b[big], d, rng)
    return t


def _draw_large(c: np.ndarray, b: np.ndarray, d: float, rng: np.random.Generator) -> np.ndarray:
    """The same for many customers.

    Given t, table sizes are t draws from the Sibuya law held to the sum c, so t is a Poisson
    number held to its compound sum: at the tilt z that makes c the expected sum, its mean is
    b / d (1 - (1 - z)^d), and what the sum doesn't explain of its variance is its spread.
    """
    lo, hi = np.full(len(c), -700.0), np.full(len(c), -1e-12)  # of log(1 - z)
    for _ in range(60):
        mid = (lo + hi) / 2
        more = np.log(b) + np.log(-np.expm1(mid)) - (1 - d) * mid > np.log(c)
        lo, hi = np.where(more, mid, lo), np.where(more, hi, mid)
    mean = b / d * -np.expm1(d * hi)
    z = -np.expm1(hi)
    with np.errstate(over="ignore"):
        spread = mean - c * c / (c + b * z * z * (1 - d) * np.exp((d - 2) * hi))
    few = mean < 20
    t = np.where(few, 1 + rng.poisson(np.where(few, mean, 1)), np.rint(rng.normal(mean + spread / np.maximum(mean, 1e-9) / 2, np.sqrt(np.maximum(spread, 0)))))
    return np.clip(t, 1, c).astype(np.int64)


def discount(counts: np.ndarray) -> float:
    """The leave-one-out estimate n1 / (n1 + 2 n2) from how many are seen once and twice."""
    return bounded(int((counts == 1).sum()), int((counts == 2).sum()))


def bounded(n1: int, n2: int) -> float:
    return min(0.95, max(0.05, n1 / (n1 + 2 * n2))) if n1 + n2 else 0.5


def seat_parent(customers: np.ndarray, d: float, strength: float, base: float, scale: float, tables: np.ndarray, rng, stirling) -> np.ndarray:
    """A sweep over the parent's dishes; ``scale``: how many times these tables the whole restaurant has."""
    return draw_tables(customers, np.maximum((strength + d * (tables.sum() * scale - tables)) * base, 1e-300), d, rng, stirling)


def seat_bucket(c, ui, wi, split, d0, strengths, base, sweeps, burn, rng):
    """Mean tables of each pair, those of the last sweep, and the discount.

    c: customers; ui, wi: numbers of context and word; split: over how many buckets each context is dealt.
    """
    d, (s1, s0) = discount(c), strengths
    of, of0 = log_stirling(EXACT, d), log_stirling(EXACT, d0)
    t = np.ones(len(c), np.int64)
    r = np.ones(int(wi.max(initial=-1)) + 1, np.int64)
    total = np.zeros(len(c))
    for k in range(sweeps):
        tw = np.bincount(wi, t, len(r)).astype(np.int64)
        r = seat_parent(tw, d0, s0, base, 1.0, r, rng, of0)
        p = (tw - d0 * r + (s0 + d0 * r.sum()) * base) / (s0 + tw.sum())
        tu = np.bincount(ui, t) * split
        t = draw_tables(c, (s1 + d * np.maximum(tu[ui] - t, 0)) * p[wi], d, rng, of)
        if k >= burn:
            total += t
    return total / max(sweeps - burn, 1), t, d


# ---------------------------------------------------------------------------------------- blocks


class _Numbers(dict):
    """Gives each new word the next number."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _blocks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Blocks of whole texts of at least ``most`` tokens (the last: fewer), as packed arrays."""
    from pyspark import TaskContext

    task, seq = TaskContext.get().partitionId(), 0
    words, ids, held, parts, size = _Numbers(), [], [], [], 0
    mark = np.array([-1], np.int32)

    def flush(kind: pa.DataType) -> pa.RecordBatch:
        hashes = np.array([*map(xxhash.xxh64_intdigest, words), END, BEGIN], np.uint64)
        order = np.argsort(hashes)
        flat = np.concatenate([x for p in parts for x in (p, mark)])
        flat[flat < 0] = len(words)
        # The commonest words get the smallest numbers, which pack best; places: theirs in the sorted vocabulary.
        common = np.argsort(-np.bincount(flat, minlength=len(hashes)), kind="stable")
        rank, places = np.empty(len(order), np.int32), np.empty(len(order), np.int32)
        rank[common] = np.arange(len(order), dtype=np.int32)
        places[rank[order]] = np.arange(len(order), dtype=np.int32)
        lens, held_ = np.array([len(p) + 1 for p in parts], np.int32), np.array(held, bool)
        row = [task << 32 | seq, int(lens[~held_].sum()), len(flat), int((~held_).sum()), len(hashes), ids, pack(held_), pack(lens), pack(hashes[order], True), pack(places), pack(rank[flat])]
        types = [pa.int64()] * 5 + [pa.list_(kind)] + [pa.binary()] * 5
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], ["block", "n_train", "n_tokens", "n_docs", "n_words", "ids", "held", "lens", "vocab", "places", "tokens"])

    kind = None
    for b in batches:
        kind = b.schema.field(0).type
        for i, out, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
            found = words_of(text.as_py())
            parts.append(np.fromiter(map(words.__getitem__, found), np.int32, len(found)))
            ids.append(i)
            held.append(out)
            size += len(found) + 1
            if size >= most:
                yield flush(kind)
                seq, size, words, ids, held, parts = seq + 1, 0, _Numbers(), [], [], []
    if parts:
        yield flush(kind)


def _rows(batch: pa.RecordBatch, *names: str):
    columns = [batch.column(batch.schema.get_field_index(n)) for n in names]
    for k in range(batch.num_rows):
        yield [c[k].as_py() for c in columns]


def _messages(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, ARROW.types, strict=True)], schema=ARROW)


def _parts(hashes: np.ndarray, n: int) -> np.ndarray:
    """Where each of n equal ranges of 64-bit hashes starts and ends in sorted ones."""
    edges = np.array([(1 << 64) * k // n for k in range(1, n)], np.uint64)
    return np.r_[0, np.searchsorted(hashes, edges), len(hashes)]


def _ask_words(batches: Iterator[pa.RecordBatch], shards: int) -> Iterator[pa.RecordBatch]:
    """A block's words and their training counts, to the words' shards."""
    for b in batches:
        for block, held, lens, vocab, places, tokens in _rows(b, "block", "held", "lens", "vocab", "places", "tokens"):
            held, lens, vocab, tokens = unpack(held, bool), unpack(lens, np.int32), unpack(vocab, np.uint64, True), unpack(places, np.int32)[unpack(tokens, np.int32)]
            n = np.bincount(tokens[~np.repeat(held, lens)], minlength=len(vocab)).astype(np.int64)
            at = _parts(vocab, shards)
            yield _messages([(k, "block", block, pack(vocab[i:j], True), pack(n[i:j]), None) for k, (i, j) in enumerate(zip(at, at[1:], strict=False))])


class _Pairs:
    """A block's distinct pairs in the order in which they are sent, and where its tokens find them."""

    def __init__(self, held: bytes, lens: bytes, vocab: bytes, places: bytes, tokens: bytes, buckets: int, hot: tuple[np.ndarray, np.ndarray]):
        self.held, self.lens, self.vocab = unpack(held, bool), unpack(lens, np.int32), unpack(vocab, np.uint64, True)
        self.tokens = unpack(places, np.int32)[unpack(tokens, np.int32)]
        v = len(self.vocab)
        self.starts = np.r_[0, np.cumsum(self.lens[:-1])]
        context = np.empty(len(self.tokens), np.int64)
        context[1:] = self.tokens[:-1]
        context[self.starts] = np.searchsorted(self.vocab, np.uint64(BEGIN))
        context *= v
        context += self.tokens
        codes, self.which = distinct(context)
        del context
        self.u, self.w = (codes // v).astype(np.int32), (codes % v).astype(np.int32)
        split = split_of(self.vocab, hot)[self.u]
        bucket = (self.vocab % np.uint64(buckets)).astype(np.int64)[self.u]
        many = np.flatnonzero(split > 1)
        bucket[many] = (bucket[many] + (self.vocab[self.w[many]] >> np.uint64(7)).astype(np.int64) % split[many]) % buckets
        self.order = np.argsort(bucket.astype(np.uint16) if buckets < 1 << 16 else bucket, kind="stable")
        self.edges = np.searchsorted(bucket[self.order], np.arange(buckets + 1))


def distinct(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct numbers in order, and where each one's are; sorts code and place as one number where they fit."""
    bits = max(1, (len(codes) - 1).bit_length())
    if int(codes.max()).bit_length() + bits > 63:
        return np.unique(codes, return_inverse=True)
    both = codes << bits
    both |= np.arange(len(codes))
    both.sort()
    place = (both & ((1 << bits) - 1)).astype(np.int32)
    both >>= bits
    new = np.r_[True, both[1:] != both[:-1]]
    which = np.empty(len(codes), np.int32)
    which[place] = np.cumsum(new, dtype=np.int32) - 1
    return both[new], which


def split_of(hashes: np.ndarray, hot: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Over how many buckets each context is dealt."""
    out = np.ones(len(hashes), np.int64)
    if len(hot[0]):
        at = np.minimum(np.searchsorted(hot[0], hashes), len(hot[0]) - 1)
        out = np.where(hot[0][at] == hashes, hot[1][at], 1)
    return out


def _ask_pairs(batches: Iterator[pa.RecordBatch], buckets: int, hot) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for block, *arrays in _rows(b, "block", "held", "lens", "vocab", "places", "tokens"):
            p = _Pairs(*arrays, buckets, hot)
            n = np.bincount(p.which[~np.repeat(p.held, p.lens)], minlength=len(p.u)).astype(np.int32)
            for k, (i, j) in enumerate(zip(p.edges, p.edges[1:], strict=False)):
                if i < j:
                    at = p.order[i:j]
                    yield _messages([(k, "pairs", block, pack(p.vocab[p.u[at]]), pack(p.vocab[p.w[at]]), pack(n[at]))])


def _sample(table: pa.Table, buckets: int, shards: int, hot, d0: float, strengths, base: float, sweeps: int, burn: int) -> pa.Table:
    """Seat a bucket's restaurants; answers to blocks, and tables by word and context to the shards."""
    bucket = table.column("key")[0].as_py()
    src = [x.as_py() for x in table.column("src")]
    us, ws, ns = ([unpack(x.as_py(), k) for x in table.column(c)] for c, k in (("x", np.uint64), ("y", np.uint64), ("z", np.int32)))
    lens = [len(x) for x in us]
    u, w, n = np.concatenate(us), np.concatenate(ws), np.concatenate(ns).astype(np.int64)
    del us, ws, ns
    order = np.lexsort((w, u))
    u, w = u[order], w[order]
    new = np.r_[True, (u[1:] != u[:-1]) | (w[1:] != w[:-1])]
    which = np.empty(len(order), np.int64)
    which[order] = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    c, u, w = np.add.reduceat(n[order], first), u[first], w[first]
    del order, new, n
    known = np.flatnonzero(c)
    contexts, ui = np.unique(u[known], return_inverse=True)
    words, wi = np.unique(w[known], return_inverse=True)
    mean, last, d = seat_bucket(c[known], ui, wi, split_of(contexts, hot), d0, strengths, base, sweeps, burn, np.random.default_rng([11, bucket]))
    kept = np.zeros(len(c), np.int64)  # tables, summed over the sweeps that count
    kept[known] = np.rint(mean * max(sweeps - burn, 1))
    c, kept = c.astype(np.int32)[which], kept.astype(np.int32)[which]
    share = np.array([d / max(sweeps - burn, 1)]).tobytes()
    rows, at = [], 0
    for block, k in zip(src, lens, strict=True):
        rows.append((block, "rest", bucket, pack(c[at : at + k]), pack(kept[at : at + k]), share))
        at += k
    for kind, hashes, values in (("tables", words, np.bincount(wi, last, len(words)).astype(np.int32)), ("context", contexts, (d * np.bincount(ui, mean, len(contexts))))):
        cut = _parts(hashes, shards)
        rows += [(k, kind, bucket, pack(hashes[i:j], True), pack(values[i:j]), None) for k, (i, j) in enumerate(zip(cut, cut[1:], strict=False)) if i < j]
    return pa.Table.from_batches([_messages(rows)])


def _add_up(rows: list[list], kind) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of packed (hashes, values), and the sums of their values."""
    if not rows:
        return np.zeros(0, np.uint64), np.zeros(0, kind)
    h = np.concatenate([unpack(x, np.uint64, True) for x, _ in rows])
    v = np.concatenate([unpack(y, kind) for _, y in rows])
    found, which = np.unique(h, return_inverse=True)
    return found, np.bincount(which, v, len(found))


def _of(table: pa.Table, kind: str) -> list[list]:
    keep = table.filter(pc.equal(table.column("kind"), kind))
    return [[x.as_py(), y.as_py()] for x, y in zip(keep.column("x"), keep.column("y"), strict=True)]


def _count(table: pa.Table, least: int) -> pa.Table:
    """A shard's numbers of words known, seen once and twice, and its words seen ``least`` times or more."""
    h, c = _add_up(_of(table, "block"), np.int64)
    hot = c >= least
    stats = np.array([(c > 0).sum(), (c == 1).sum(), (c == 2).sum()], np.int64)
    return pa.Table.from_batches([_messages([(0, "stats", 0, stats.tobytes(), h[hot].tobytes(), c[hot].astype(np.int64).tobytes())])])


def _answer_words(table: pa.Table, shards: int, d0: float, strength: float, base: float, sweeps: int, burn: int) -> pa.Table:
    """Seat the parent's dishes of a shard and answer the blocks: counts, what tables leave of them, contexts' mass."""
    shard = table.column("key")[0].as_py()
    words, c = _add_up(_of(table, "block"), np.int64)
    th, t = _add_up(_of(table, "tables"), np.int32)
    dh, mass = _add_up(_of(table, "context"), np.float64)
    t = t.astype(np.int64)
    rng, of, r, total = np.random.default_rng([13, shard]), log_stirling(EXACT, d0), np.ones(len(t), np.int64), np.zeros(len(t))
    for k in range(sweeps):
        r = seat_parent(t, d0, strength, base, float(shards), r, rng, of)
        if k >= burn:
            total += r
    r = total / max(sweeps - burn, 1)
    left, by = np.zeros(len(words)), np.zeros(len(words))
    left[np.searchsorted(words, th)] = t - d0 * r
    by[np.searchsorted(words, dh)] = mass
    rows = [(-1, "sums", shard, np.array([t.sum(), r.sum()], float).tobytes(), None, None)]
    keep = table.filter(pc.equal(table.column("kind"), "block"))
    for block, x in zip(keep.column("src"), keep.column("x"), strict=True):
        at = np.searchsorted(words, unpack(x.as_py(), np.uint64, True))
        rows.append((block.as_py(), "words", shard, pack(c[at].astype(np.int64)), pack(left[at]), pack(by[at])))
    return pa.Table.from_batches([_messages(rows)])


def _score(table: pa.Table, schema: pa.Schema, buckets: int, hot, strengths, base: float, docs: int, n: int, v: int, customers: float, tables: float, d0: float) -> pa.Table:
    """Scores of a block's texts from the answers of buckets and shards."""
    own = table.filter(pc.equal(table.column("kind"), "own"))
    ids = own.column("ids").combine_chunks().flatten()
    p = _Pairs(*(own.column(k)[0].as_py() for k in ("held", "lens", "x", "y", "z")), buckets, hot)
    s1, s0 = strengths

    def answers(kind: str) -> pa.Table:
        return table.filter(pc.equal(table.column("kind"), kind)).sort_by("src")

    rest = np.empty(len(p.u), np.float64)
    got = zip(*(answers("rest").column(k).to_pylist() for k in "xyz"), strict=True)
    rest[p.order] = np.concatenate([unpack(x, np.int32) - np.frombuffer(z)[0] * unpack(y, np.int32) for x, y, z in got])
    told = answers("words")
    c, left, mass = (np.concatenate([unpack(x.as_py(), k) for x in told.column(name)]) for name, k in (("x", np.int64), ("y", np.float64), ("z", np.float64)))
    parent = (left + (s0 + d0 * tables) * base) / (s0 + customers)
    served = c.astype(np.float64)
    served[np.searchsorted(p.vocab, np.uint64(BEGIN))] = docs
    probability = (rest + (s1 + mass[p.u]) * parent[p.w]) / (s1 + served[p.u])
    add = lambda x: np.add.reduceat(x, p.starts)
    columns = [
        ids, pa.array(p.held), pa.array(p.lens.astype(np.int64)), pa.array(add((c > 0)[p.tokens].astype(np.int64))), pa.array(np.full(len(p.lens), n, np.int64)),
        pa.array(add(np.log10((c + 1) / (n + v + 1))[p.tokens])), pa.array(add(np.log10(probability)[p.which])),
    ]
    return pa.Table.from_arrays(columns, schema=schema)


def score(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", modulus: int = 7, held_remainder: int = 2,
    strengths: tuple[float, float] = (1.0, 1.0), sweeps: int = 5, burn: int = 2, block_tokens: int = 3_000_000, bucket_pairs: int = 2_000_000,
) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    ``strengths``: of context restaurants and of their parent; discounts are estimated from
    counts of one and two.  ``sweeps``: Gibbs sweeps, of which the first ``burn`` don't count.

    What comes to the driver: sums of each shard, and the words with over a quarter of a bucket's
    share of the tokens, at most four for each bucket; so it grows with the corpus, at some
    100 bytes for each ``bucket_pairs`` tokens.
    """
    spark = ready(docs.sparkSession)
    field = docs.schema[id_column]
    kind = field.dataType.simpleString()
    i = F.col(f"`{id_column}`")
    held = F.pmod(F.crc32(F.coalesce(i.cast("string"), F.lit("")).cast("binary")), F.lit(modulus)) == held_remainder
    src = docs.select(i.alias("id"), held.alias("held"), F.col(f"`{text_column}`").alias("text"))
    columns = f"block bigint, n_train bigint, n_tokens bigint, n_docs bigint, n_words bigint, ids array<{kind}>, held binary, lens binary, vocab binary, places binary, tokens binary"
    blocks = materialize(src.mapInArrow(lambda it: _blocks(it, block_tokens), columns), "blocks")
    n, tokens, n_docs, entries = (int(x or 0) for x in blocks.agg(*[F.sum(c) for c in ("n_train", "n_tokens", "n_docs", "n_words")]).first())
    buckets, shards = max(1, -(-tokens // bucket_pairs)), max(1, -(-entries // 2_000_000))
    out = f"id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    asked = blocks.mapInArrow(lambda it: _ask_words(it, shards), MESSAGE)
    # Words with over a quarter of a bucket's share of the tokens: at most 4 * buckets of them.
    least = max(1, n // (4 * buckets))
    stats = asked.groupBy("key").applyInArrow(lambda t: _count(t, least), MESSAGE).select("x", "y", "z").collect()
    v, n1, n2 = np.sum([np.frombuffer(r.x, np.int64) for r in stats], axis=0).tolist() if stats else (0, 0, 0)
    hashes, counts = (np.concatenate([np.frombuffer(bytes(r[k]), np.uint64 if k == "y" else np.int64) for r in stats] or [np.zeros(0, np.uint64)]) for k in ("y", "z"))
    order = np.argsort(hashes)
    hot = (hashes[order], np.minimum(buckets, -(-counts[order].astype(np.int64) // least)))
    base, d0 = 1.0 / (v + 1), bounded(n1, n2)
    pairs = blocks.mapInArrow(lambda it: _ask_pairs(it, buckets, hot), MESSAGE)
    seated = materialize(pairs.groupBy("key").applyInArrow(lambda t: _sample(t, buckets, shards, hot, d0, strengths, base, sweeps, burn), MESSAGE), "seated")
    del pairs, stats
    release(spark)  # the pairs' shuffle
    told = asked.unionByName(seated.filter("kind != 'rest'")).groupBy("key").applyInArrow(lambda t: _answer_words(t, shards, d0, strengths[1], base, sweeps, burn), MESSAGE)
    told = materialize(told, "words")
    release(spark)
    sums = [np.frombuffer(r.x) for r in told.filter("kind = 'sums'").select("x").collect()]  # one row a shard
    customers, tables = np.sum(sums, axis=0).tolist() if sums else (0.0, 0.0)
    none = lambda c, t: F.lit(None).cast(t).alias(c)
    own = blocks.select(F.col("block").alias("key"), F.lit("own").alias("kind"), F.lit(0).cast("bigint").alias("src"), F.col("vocab").alias("x"), F.col("places").alias("y"), F.col("tokens").alias("z"), "ids", "held", "lens")
    rest = seated.filter("kind = 'rest'").unionByName(told.filter("kind = 'words'")).select("*", none("ids", f"array<{kind}>"), none("held", "binary"), none("lens", "binary"))
    scored = own.unionByName(rest).groupBy("key").applyInArrow(
        lambda t: _score(t, _schema(t), buckets, hot, strengths, base, n_docs, n, v, customers, tables, d0), out
    )
    return scored


def _schema(table: pa.Table) -> pa.Schema:
    return pa.schema(
        [("id", table.schema.field("ids").type.value_type), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())]
    )


def perplexity(scored: DataFrame) -> DataFrame:
    """Held-out and training perplexity per token of the model and of the base."""
    p = lambda c: F.pow(F.lit(10.0), -F.sum(c) / F.sum("n_tokens"))
    return scored.groupBy("held_out").agg(p("score").alias("perplexity"), p("base_score").alias("base_perplexity"))


def held_out(doc_id: object, modulus: int = 7, remainder: int = 2) -> bool:
    """Whether a row's id puts it out of training."""
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % modulus == remainder
