"""Best-fit packing by bin completion.

Only lengths matter to a packing, and there are at most ``capacity`` of them, so the driver
solves it over the histogram of lengths: a table of at most 4096 rows whatever the corpus.
A solution is a list of patterns, each a multiset of lengths and how many sequences repeat it.

The first incumbent is best-fit decreasing over length classes.  If it is above the lower
bound, bin completion searches on: the largest remaining length starts a sequence; the
undominated fillings of the rest are enumerated and tried, the best fit first; branches whose
waste can't beat the incumbent are pruned.  The search ends at the bound or after ``nodes``
fillings, and a node's enumeration after ``steps`` steps (bounds on effort, not on
documents: the incumbent packs all of them).

The pieces are then dealt out without a sort: each has its rank within its length - the task
that made it counts as it goes, and tasks' counts are summed up - and the ranks of a
length map to places by a binary search in the solution.

Defined results: a null text is an empty one, and an empty one is a piece of one token, the
end mark; a text of over ``capacity`` tokens is cut into full pieces and a rest; repeated rows
are packed each on their own; an empty table gives no rows.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilspark.llm.bpe_trie import byte_letters
from veilspark.llm.common import materialize, ready

#: A pattern: lengths from large to small as (length, copies), and the sequences that repeat it.
Pattern = tuple[tuple[tuple[int, int], ...], int]


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Best-fit decreasing, a whole length class at a time."""
    open_: dict[int, list[list]] = {}  # room -> [[pattern, sequences], ...]
    rooms: list[int] = []

    def put(room: int, pattern: tuple, n: int) -> None:
        if room not in open_:
            open_[room] = []
            rooms.insert(bisect_left(rooms, room), room)
        open_[room].append([pattern, n])

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            at = bisect_left(rooms, length)
            if at == len(rooms):  # no room anywhere: new sequences, filled with this length
                k = min(capacity // length, left)
                n = left // k
                put(capacity - k * length, ((length, k),), n)
                left -= n * k
                continue
            room = rooms[at]
            pattern, n = open_[room].pop()
            if not open_[room]:
                del open_[room], rooms[at]
            k = min(room // length, left)
            m = min(n, left // k)
            put(room - k * length, (*pattern, (length, k)), m)
            if n > m:
                put(room, pattern, n - m)
            left -= m * k
    return [(p, n) for room in rooms for p, n in open_[room]]


def fillings(counts: dict[int, int], room: int, most: int, steps: int) -> tuple[list[tuple[int, tuple]], bool]:
    """Fillings of ``room`` that waste at most ``most``, as (waste, pattern), the best fit first; whether that is all.

    Every count of every length is tried, larger lengths and larger counts first, in at most ``steps`` steps.
    """
    lengths = sorted((a for a in counts if a <= room), reverse=True)
    after = [0] * (len(lengths) + 1)  # what the lengths from here on could fill
    for at in range(len(lengths) - 1, -1, -1):
        after[at] = after[at + 1] + lengths[at] * counts[lengths[at]]
    found, stack = [], [(room, 0, ())]
    while stack and steps:
        steps -= 1
        left, at, chosen = stack.pop()
        if left - after[at] > most:
            continue
        while at < len(lengths) and lengths[at] > left:
            at += 1
        if at == len(lengths):
            if left <= most:
                found.append((left, chosen))
            continue
        length = lengths[at]
        for k in range(min(left // length, counts[length]) + 1):
            stack.append((left - k * length, at + 1, (*chosen, (length, k)) if k else chosen))
    return sorted(found, key=lambda x: x[0]), not stack


def dominated(chosen: dict[int, int], waste: int, counts: dict[int, int]) -> bool:
    """Whether a length that is left over could take the place of smaller chosen ones of no greater sum, or of nothing.

    What it replaces would fit wherever it stood, so a packing as good has the other filling.
    """
    sums = 1  # bit s: some chosen lengths under ``length`` add up to s
    for length in sorted(counts):
        if counts[length] > chosen.get(length, 0) and (sums & ((2 << length) - 1)) >> max(0, length - waste):
            return True
        for _ in range(chosen.get(length, 0)):
            sums |= sums << length
    return False


@dataclass
class Packing:
    """A solution: its patterns, the sequences no packing could do without, the fillings tried, and whether it is proved the best."""

    patterns: list[Pattern]
    bound: int
    nodes: int = 0
    optimal: bool = False

    @property
    def sequences(self) -> int:
        return sum(n for _, n in self.patterns)


def bin_completion(counts: dict[int, int], capacity: int, nodes: int = 500, steps: int = 200) -> Packing:
    """Patterns that hold every length as often as ``counts`` says, in as few sequences as are found.

    A filling is taken as often as it can be, and after that branch failed once at a time, so
    that the search is complete where neither limit ends it: ``nodes`` fillings
    tried, ``steps`` in the enumeration of one node's.
    """
    left = {a: n for a, n in counts.items() if n > 0}
    total = sum(a * n for a, n in left.items())
    found = Packing(best_fit_decreasing(left, capacity), -(-total // capacity))
    best, whole, waste = found.sequences, True, 0
    taken: list[tuple[tuple, int, int]] = []
    seen: dict[int, int] = {}  # by the hash of what is left

    def put(pattern: tuple, n: int) -> None:
        for a, k in pattern:
            left[a] = left.get(a, 0) - n * k
            if not left[a]:
                del left[a]

    def branches() -> Iterator[tuple[tuple, int, int]]:
        nonlocal whole
        largest = max(left)
        rest = dict(left)
        rest[largest] -= 1
        if not rest[largest]:
            del rest[largest]
        choices, all_of_them = fillings(rest, capacity - largest, (best - 1) * capacity - total - waste, steps)
        whole &= all_of_them
        for w, part in choices:
            if dominated(dict(part), w, rest):
                continue
            pattern = _join(largest, part)
            n = min(left[a] // k for a, k in pattern)
            for often in (n, 1) if n > 1 else (1,):
                yield pattern, often, w

    path = [branches()] if left and best > found.bound else []
    while path and found.nodes < nodes and best > found.bound:
        step = next(path[-1], None)
        if step is None:
            path.pop()
            if taken:
                pattern, n, w = taken.pop()
                waste -= n * w
                put(pattern, -n)
            continue
        found.nodes += 1
        pattern, n, w = step
        allowed = (best - 1) * capacity - total
        if waste + n * w > allowed:  # no fewer sequences than the incumbent's can come of it
            continue
        waste += n * w
        put(pattern, n)
        taken.append(step)
        if not left:
            found.patterns, best = [(p, k) for p, k, _ in taken], sum(k for _, k, _ in taken)
        state = hash(frozenset(left.items()))
        if left and seen.get(state, waste + 1) > waste:
            seen[state] = waste
            path.append(branches())
        else:
            path.append(iter(()))
    found.optimal = best == found.bound or (whole and not path)
    return found


def _join(length: int, pattern: tuple) -> tuple:
    held = dict(pattern)
    held[length] = held.get(length, 0) + 1
    return tuple(sorted(held.items(), reverse=True))


def places(patterns: list[Pattern], capacity: int) -> dict[str, np.ndarray]:
    """Slots of the solution sorted by (length, first rank)."""
    rank: dict[int, int] = {}
    rows, sequence = [], 0
    for pattern, n in patterns:
        offset = 0
        for length, k in pattern:
            rows.append((length, rank.get(length, 0), sequence, offset, k))
            rank[length] = rank.get(length, 0) + n * k
            offset += length * k
        sequence += n
    rows.sort()
    a = np.array(rows, np.int64).reshape(-1, 5)
    return {"length": a[:, 0], "rank": a[:, 1], "sequence": a[:, 2], "offset": a[:, 3], "copies": a[:, 4]}


class WordTokenizer:
    """Ids as by the tokenizers library, each distinct word encoded once.

    The vocabulary's normaliser and word cutter never look across white space.  A plain text -
    letters, digits and marks that normalisation leaves as they are but for their case - is
    lower-cased and cut here, and its new words are merged by tiktoken, a NUL in place of the
    word's end; other texts part at white space, and their chunks that aren't plain go to the
    tokenizers library whole.

    tiktoken joins any two neighbours that make a token, the library only the two of its merge
    table.  These are the same two wherever the library makes a token of the token's own bytes:
    what stands beside them took no part, so they were merged as if alone.  ``merger`` makes
    sure of that for the whole vocabulary.

    The ids of words met lately are kept, in two generations of at most ``keep`` and a batch.
    """

    LETTERS = "a-z\u00df-\u00f6\u00f8-\u00ff"
    PLAIN = re.compile("[\t-\r -~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]*")
    WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[0-9]|[^\\s0-9{LETTERS}]+")
    END = "</w>"

    def __init__(self, path: str, keep: int = 300_000):
        from tokenizers import Tokenizer

        self.library, self.keep, self.known, self.old = Tokenizer.from_file(path), keep, {}, {}
        self.merger, self.ends = self.make_merger()

    def make_merger(self):
        """A tiktoken encoding of NUL-ended words with this vocabulary, and which ids end a word."""
        import tiktoken
        from tokenizers import Tokenizer

        spec = json.loads(self.library.to_str())
        inner = Tokenizer.from_str(json.dumps({**spec, "model": {**spec["model"], "end_of_word_suffix": None}})).model
        letters, ranks = byte_letters(), {}
        ends = np.zeros(max(spec["model"]["vocab"].values()) + 1, bool)
        special = {t["content"] for t in spec["added_tokens"]}
        for token, i in spec["model"]["vocab"].items():
            if token in special:
                continue
            shown = token.removesuffix(self.END)
            ends[i] = shown != token
            if [x.id for x in (self.library.model if ends[i] else inner).tokenize(shown)] != [i]:
                raise ValueError(f"the vocabulary's own merges don't make {token!r}")
            raw = bytes(letters[c] for c in shown) + b"\0" * int(ends[i])
            if raw != b"\0\0":
                ranks[raw] = i
        return tiktoken.Encoding("words", pat_str=r"[^\x00]+\x00", mergeable_ranks=ranks, special_tokens={}), ends

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        if len(self.known) > self.keep:
            self.old, self.known = self.known, {}
        get, cut, out, lack = self.known.get, [], [], []
        for text in texts:
            words = self.words(text)
            ids = list(map(get, words))
            cut.append(words)
            out.append(ids)
            lack.append([at for at, x in enumerate(ids) if x is None] if None in ids else [])
        self.learn({words[at] for words, miss in zip(cut, lack, strict=True) for at in miss})
        for words, ids, miss in zip(cut, out, lack, strict=True):
            for at in miss:
                ids[at] = get(words[at])
        return [b"".join(ids) for ids in out]

    def plain(self, text: str) -> bool:
        return bool(self.PLAIN.fullmatch(text)) and "<|" not in text

    def words(self, text: str) -> list[str]:
        """What is encoded on its own: lower-cased words of plain runs; other chunks as they are, after a NUL."""
        if self.plain(text):
            return self.WORDS.findall(text.lower())
        parts = ((self.WORDS.findall(c.lower()) if self.plain(c) else ["\0" + c]) for c in re.split("[ \t-\r]+", text))
        return [w for part in parts for w in part]

    def learn(self, words: set[str]) -> None:
        known, old, new = self.known, self.old, []
        for w in words:
            if w in old:
                known[w] = old[w]
            elif w[0] != "\0":
                new.append(w)
            else:
                known[w] = np.array(self.library.encode(w[1:], add_special_tokens=False).ids, "<u4").tobytes()
        if new:
            ids = self.merger.encode_to_numpy("\0".join(new) + "\0").astype("<u4", copy=False)
            stops = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            raw = ids.tobytes()
            known.update(zip(new, map(raw.__getitem__, map(slice, [0, *stops[:-1]], stops)), strict=True))


_made: dict[str, WordTokenizer] = {}


def _pieces(batches: Iterator[pa.RecordBatch], path: str, end_id: int, capacity: int, batch_chars: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    if path not in _made:
        _made[path] = WordTokenizer(path)
    task, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
    end = int(end_id).to_bytes(4, "little")
    for b in batches:
        at = 0
        while at < b.num_rows:
            texts, size = [], 0
            while at + len(texts) < b.num_rows and (not texts or size < batch_chars):
                texts.append(b.column(1)[at + len(texts)].as_py())
                size += len(texts[-1])
            rows, pick = [], []
            for k, ids in enumerate(_made[path].encode(texts)):
                ids += end
                for piece, start in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[start : start + 4 * capacity]
                    n = len(part) // 4
                    rows.append((piece, start // 4, n, zlib.crc32(part), task, int(seen[n])))
                    pick.append(at + k)
                    seen[n] += 1
            piece, start, n, crc, tasks, rank = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(pick)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(tasks, pa.int32()), pa.array(rank, pa.int64())],
                ["id", "piece", "start", "length", "ids_crc32", "task", "rank"],
            )
            at += len(texts)


def pack(docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 1, id_column: str = "doc_id", text_column: str = "text", nodes: int = 500, steps: int = 200, batch_chars: int = 1 << 21) -> DataFrame:
    """One row a piece: (id, piece, start, length, ids_crc32, sequence_id, offset)."""
    spark = ready(docs.sparkSession)
    kind = docs.schema[id_column].dataType.simpleString()
    src = docs.select(F.col(f"`{id_column}`").alias("id"), F.coalesce(F.col(f"`{text_column}`"), F.lit("")).alias("text"))
    schema = f"id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, task int, rank bigint"
    pieces = materialize(src.mapInArrow(lambda it: _pieces(it, path, end_id, capacity, batch_chars), schema), "pieces")
    by_task = materialize(pieces.groupBy("length", "task").agg(F.count("*").alias("n")), "by_task")
    counts = {r.length: r.n for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    spots = places(bin_completion(counts, capacity, nodes, steps).patterns, capacity)
    before = by_task.select("length", "task", (F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n")).alias("before"))
    ranked = pieces.join(before.hint("merge"), ["length", "task"]).select("id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("before")).alias("rank"))
    held = spark.sparkContext.broadcast(spots)  # a few slots for each of at most ``capacity`` lengths

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = held.value
        order = s["length"] * (1 << 50) + s["rank"]
        for b in batches:
            length, rank = (b.column(k).to_numpy(zero_copy_only=False) for k in (3, 5))
            at = np.searchsorted(order, length * (1 << 50) + rank, side="right") - 1
            more = rank - s["rank"][at]
            sequence, offset = s["sequence"][at] + more // s["copies"][at], s["offset"][at] + more % s["copies"][at] * length
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sequence), pa.array(offset)], ["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(deal, f"id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")
