"""Byte-level BPE by a prefix-sharing trie.

Distinct words go into a trie - laid out as the sorted word list, in which a node is a common
prefix of neighbours - and a depth-first walk carries one state a node: the last token of the
prefix's encoding.  The encoding of a prefix p with last token t is the encoding of p without
t, then t; exactly one vocabulary suffix t of p is compatible with the last token before it, so
each node costs a few dictionary look-ups and a prefix shared by many words is encoded once.

Compatible means that merging in rank order leaves both tokens apart: undo merges at the seam,
newest first, and no pair met on the way may itself merge earlier.  It needs token ids that rise
with merge rank, which ``Vocabulary`` checks.

Defined results: null and empty texts have no ids and decode to the empty text; special tokens'
strings become their ids; repeated rows are encoded alike; texts of any length are processed
whole.
"""

from __future__ import annotations

import gc
import hashlib
import json
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm.common import ready

#: Unicode white space, as the library's \s; what stands between has no bearing on its neighbours.
WHITE = "\\t\\n\\x0b\\x0c\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
CHUNKS = re.compile(f" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Beyond these letters Unicode versions may tell classes apart, and the library itself cuts the words.
PLAIN = re.compile(f"[\\x20-\\u024f{WHITE}]*")


def byte_letters() -> dict[str, int]:
    """The printable letters that byte-level vocabularies write bytes with."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in shown}
    out.update({chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in shown)})
    return out


class Vocabulary:
    """Tokens as bytes, merges by pair, and how each token was merged."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        vocab = spec["model"]["vocab"]
        self.ids = {raw(s): i for s, i in vocab.items()}
        self.bytes = {i: b for b, i in self.ids.items()}
        self.pairs: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        for m in spec["model"]["merges"]:
            a, b = m.split(" ") if isinstance(m, str) else m
            i, j, k = vocab[a], vocab[b], vocab[a + b]
            self.pairs[i, j] = k
            if k in self.parts or k < max(i, j):
                raise ValueError("token ids don't rise with merge rank")
            self.parts[k] = (i, j)
        ranks = [self.pairs[p] for p in self.pairs]
        if ranks != sorted(ranks):
            raise ValueError("token ids don't rise with merge rank")
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        for s, i in self.special.items():
            self.bytes[i] = s.encode()
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.longest = max(map(len, self.ids))
        self.sizes = {i: len(b) for i, b in self.bytes.items()}
        self.seams: dict[int, bool] = {}  # what apart() said of two tokens
        self.library = Tokenizer.from_file(path)
        self.packed = {i: int(i).to_bytes(4, "little") for i in self.bytes}

    def apart(self, a: int, b: int) -> bool:
        """Whether tokens a and b stay as they are side by side."""
        limit = 1 << 62
        pairs, parts = self.pairs, self.parts
        while True:
            m = pairs.get((a, b))
            if m is not None and m < limit:
                return False
            if a > b:
                limit = a
                if a not in parts:
                    return True
                a = parts[a][1]
                if a == limit:
                    return True
            else:
                limit = b + 1
                if b not in parts:
                    # b is a byte; undo a if it is newer than a byte too
                    if a not in parts:
                        return True
                    limit = a
                    a = parts[a][1]
                else:
                    b = parts[b][0]

    def encode_words(self, words: Iterable[bytes]) -> dict[bytes, bytes]:
        """Packed ids of distinct words by one depth-first walk of their trie."""
        out: dict[bytes, bytes] = {}
        packed = self.packed
        ids, apart, longest, met = self.ids, self.apart, self.longest, self.seams
        if len(met) > 1_000_000:
            met.clear()
        get, sizes = ids.get, self.sizes
        last: list[int] = []  # of each prefix on the path
        before = b""
        for w in sorted(words):
            shared = 0
            for x, y in zip(before, w):  # noqa: B905
                if x != y:
                    break
                shared += 1
            del last[shared:]
            for end in range(shared + 1, len(w) + 1):
                for start in range(end - longest if end > longest else 0, end):
                    t = get(w[start:end])
                    if t is not None:
                        if start:
                            seam = last[start - 1] << 32 | t
                            ok = met.get(seam)
                            if ok is None:
                                ok = met[seam] = apart(last[start - 1], t)
                        else:
                            ok = self.whole(t)
                        if ok:
                            last.append(t)
                            break
                else:
                    raise ValueError(f"no token ends {w[:end]!r}")
            before = w
            found, end = [], len(w)
            while end:
                t = last[end - 1]
                found.append(packed[t])
                end -= sizes[t]
            out[w] = b"".join(found[::-1])
        return out

    def whole(self, token: int) -> bool:
        """Whether a token's own bytes encode to it: its two parts are whole and meet no earlier merge."""
        known = self.__dict__.setdefault("_whole", {})
        if token not in known:
            p = self.parts.get(token)
            known[token] = p is None or (self.whole(p[0]) and self.whole(p[1]) and self.met(p[0], p[1], token))
        return known[token]

    def met(self, a: int, b: int, token: int) -> bool:
        """Whether a and b, side by side, come to merge into ``token``: no seam pair merges earlier."""
        pair = self.pairs.pop((a, b))
        ok = self.apart(a, b)
        self.pairs[a, b] = pair
        return ok


class Encoder:
    """Encodes texts; keeps what distinct chunks came to, at most ``keep`` of them."""

    def __init__(self, vocabulary: Vocabulary, keep: int = 600_000):
        self.v, self.keep, self.known = vocabulary, keep, {}

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        v, known = self.v, self.known
        if len(known) > self.keep:
            known.clear()
        known.update((i, v.packed[i]) for i in v.special.values())
        cut: list[list[str | int]] = []
        for text in texts:
            out: list[str | int] = []
            for piece in v.split_special.split(text) if v.split_special else [text]:
                if piece in v.special:
                    out.append(v.special[piece])
                elif PLAIN.fullmatch(piece):
                    out.extend(CHUNKS.findall(piece))
                else:
                    out.extend(self.by_library(piece))
            cut.append(out)
        found = [list(map(known.get, out)) for out in cut]
        lack = [k for k, ids in enumerate(found) if None in ids]
        if lack:
            self.learn({c for k in lack for c, ids in zip(cut[k], found[k], strict=True) if ids is None})
            for k in lack:
                found[k] = list(map(known.__getitem__, cut[k]))
        return [b"".join(ids) for ids in found]

    def by_library(self, piece: str) -> list[str]:
        """Words as the library cuts them, each then a chunk of its own."""
        return [piece[a:b] for _, (a, b) in self.v.library.pre_tokenizer.pre_tokenize_str(piece)]

    def learn(self, chunks: set[str]) -> None:
        collects = gc.isenabled()
        gc.disable()  # nothing here refers to itself, and full collections over the cache cost more than the trie
        try:
            known = self.known
            cut = {c: [w.encode() for w in (WORDS.findall(c) if PLAIN.fullmatch(c) else self.by_library(c))] for c in chunks}
            ids = self.v.encode_words({w for ws in cut.values() for w in ws})
            for c, ws in cut.items():
                known[c] = ids[ws[0]] if len(ws) == 1 else b"".join(map(ids.__getitem__, ws))
        finally:
            if collects:
                gc.enable()

    def decode(self, packed: bytes) -> str:
        """The text of ids, special tokens included; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.v.bytes.__getitem__, np.frombuffer(packed, "<u4").tolist())).decode("utf-8", "replace")


_made: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each worker process."""
    if path not in _made:
        _made[path] = Encoder(Vocabulary(path))
    return _made[path]


def encode(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text", batch_chars: int = 1 << 21) -> DataFrame:
    """(id, ids as binary, decoded text) of every row."""
    return _mapped(docs, path, id_column, text_column, batch_chars, "ids binary, decoded string", lambda e, ids, text: (ids, text), [pa.binary(), pa.string()], ["ids", "decoded"])


def digests(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text", batch_chars: int = 1 << 21) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of every row."""
    sha = lambda b: hashlib.sha256(b).hexdigest()
    make = lambda e, ids, text: (len(ids) // 4, sha(ids), sha(text.encode()))
    return _mapped(docs, path, id_column, text_column, batch_chars, "n_tokens bigint, ids_sha256 string, decoded_sha256 string", make, [pa.int64(), pa.string(), pa.string()], ["n_tokens", "ids_sha256", "decoded_sha256"])


def _mapped(docs: DataFrame, path: str, id_column: str, text_column: str, batch_chars: int, schema: str, make, types, names) -> DataFrame:
    ready(docs.sparkSession)
    kind = docs.schema[id_column].dataType.simpleString()
    src = docs.select(F.col(f"`{id_column}`").alias("id"), F.coalesce(F.col(f"`{text_column}`"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for b in batches:
            at = 0
            while at < b.num_rows:
                texts, size = [], 0
                while at + len(texts) < b.num_rows and (not texts or size < batch_chars):
                    texts.append(b.column(1)[at + len(texts)].as_py())
                    size += len(texts[-1])
                rows = [make(e, ids, e.decode(ids)) for ids in e.encode_batch(texts)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(texts)), *[pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]], ["id", *names])
                at += len(texts)

    return src.mapInArrow(run, f"id {kind}, {schema}")
