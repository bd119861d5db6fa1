"""Media columns: content-addressed payloads in tar shards.

Every task packs its payloads, each as a PNG of 64 eight-bit grey samples a row, into tar shards in
the shared folder, under the payload's SHA-256; rows carry digest, shard, offset and length.
Metadata columns come from range reads of the 33 header bytes alone; whole payloads are read
back only for the features.

A digest is stored once.  Digests are counted first (no texts move), and those that stand on more
than one row are marked in a bitmap of fixed size.  A payload whose bit isn't set is stored by
the task that reads it; of the others each task hands on one text a digest, and these few
are shuffled by digest and stored.  A bit that digests share only sends a text the long way.

Work tables and shuffles hold digests as their 32 bytes, and a payload's digest as read back once;
what callers get is lower-case hexadecimal.

A shard's name holds a random part, so an attempt that is run again never writes into
the file of another; rows and shards are both written before anything reads them.

Defined results: a null text is an empty one, whose payload is 64 zero bytes; repeated rows keep
their own rows and share one place; an empty table has no shards.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm.common import materialize, ready, work_path

WIDTH = 64
#: Signature and IHDR chunk: all that metadata needs.
HEADER = 33
#: Bits of the bitmap of repeated digests: 8 MB.
BITS = 1 << 26
SIGNATURE = b"\x89PNG\r\n\x1a\n"


def padded(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + b"\0" * (-len(raw) % WIDTH or (0 if raw else WIDTH))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_png(payload: bytes, level: int = 6) -> bytes:
    """A grey PNG whose samples are the payload's bytes, row by row."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)  # each line begins with its filter, none
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def png_header(raw: bytes) -> dict[str, int]:
    """Width, height, bit depth and colour type from the first 33 bytes."""
    if raw[:8] != SIGNATURE or raw[12:16] != b"IHDR" or struct.unpack(">I", raw[29:33])[0] != zlib.crc32(raw[12:29]):
        raise ValueError("no PNG header")
    width, height, depth, colour = struct.unpack(">IIBB", raw[16:26])
    return {"width": width, "height": height, "depth": depth, "colour": colour}


def from_png(raw: bytes) -> bytes:
    """The samples; checks every chunk's CRC."""
    at, data, size = 8, [], png_header(raw[:HEADER])
    while at < len(raw):
        n = struct.unpack(">I", raw[at : at + 4])[0]
        kind, body = raw[at + 4 : at + 8], raw[at + 8 : at + 8 + n]
        if struct.unpack(">I", raw[at + 8 + n : at + 12 + n])[0] != zlib.crc32(kind + body):
            raise ValueError(f"chunk {kind!r} is damaged")
        if kind == b"IDAT":
            data.append(body)
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(size["height"], size["width"] + 1)
    if lines[:, 0].any():
        raise ValueError("filtered lines aren't ours")
    return lines[:, 1:].tobytes()


def feature(payload: bytes, head: dict[str, int]) -> str:
    """Size, distinct samples, mean and entropy as text."""
    counts = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
    p = counts[counts > 0] / len(payload)
    mean, entropy = float((counts * np.arange(256)).sum()) / len(payload), float(-(p * np.log2(p)).sum()) + 0.0
    return f"png {head['width']}x{head['height']}x{head['depth']} distinct={int((counts > 0).sum())} mean={mean:.6f} entropy={entropy:.6f}"


class _Shards:
    """Writes tar shards, one open at a time."""

    def __init__(self, folder: str, task: int, most: int):
        from pyarrow import fs

        self.fs, self.path = fs.FileSystem.from_uri(folder)
        self.fs.create_dir(self.path, recursive=True)
        self.folder, self.task, self.most, self.out, self.at, self.name = folder, task, most, None, 0, ""

    def add(self, name: str, body: bytes) -> tuple[str, int, int]:
        if self.out is not None and self.at > self.most:
            self.close()
        if self.out is None:
            self.name, self.at = f"shard-{self.task:06d}-{uuid.uuid4().hex}.tar", 0
            self.out = self.fs.open_output_stream(f"{self.path}/{self.name}")
        info = tarfile.TarInfo(name)
        info.size = len(body)
        head = info.tobuf(tarfile.USTAR_FORMAT)
        self.out.write(head + body + b"\0" * (-len(body) % 512))
        start = self.at + len(head)
        self.at = start + len(body) + -len(body) % 512
        return f"{self.folder}/{self.name}", start, len(body)

    def close(self) -> None:
        if self.out is not None:
            self.out.write(b"\0" * 1024)
            self.out.close()
            self.out = None


def _hex(df: DataFrame) -> DataFrame:
    return df.withColumn("digest", F.lower(F.hex("digest")))


def _digests(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(id, n_bytes, digest) of every row, without Python; the digest as bytes."""
    raw = F.coalesce(F.col(f"`{text_column}`").cast("binary"), F.lit(b""))
    n = F.octet_length(raw)
    zeros = F.when(n == 0, WIDTH).otherwise(F.pmod(-n, F.lit(WIDTH))).cast("int")
    payload = F.concat(raw, F.substring(F.lit(b"\0" * WIDTH), F.lit(1), zeros))
    return docs.select(F.col(f"`{id_column}`").alias("id"), n.cast("bigint").alias("n_bytes"), F.unhex(F.sha2(payload, 256)).alias("digest"))


def digests(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_bytes, digest) of every row, without Python."""
    return _hex(_digests(docs, id_column, text_column))


def _bit(digest: bytes, bits: int) -> int:
    return (int.from_bytes(digest[:8], "big") >> 4) % bits


def repeated_bits(rows: DataFrame, bits: int = BITS) -> bytes:
    """A bitmap with the bits of the digests (bytes) on more than one row: ``bits`` bits come to the driver, whatever the input."""
    spot = F.pmod(F.conv(F.substring(F.hex("digest"), 1, 15), 16, 10).cast("bigint"), F.lit(bits))
    many = rows.groupBy("digest").count().filter("count > 1").select((spot + 1).alias("spot"))  # Spark's bitmaps begin at 1
    parts = many.groupBy(F.bitmap_bucket_number(F.col("spot")).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("spot"))).alias("marks"))
    out = np.zeros(bits, bool)
    for r in parts.toLocalIterator():
        marks = np.unpackbits(np.frombuffer(bytes(r.marks), np.uint8), bitorder="little").astype(bool)
        here = out[(r.bucket - 1) * len(marks) : r.bucket * len(marks)]
        here |= marks[: len(here)]
    return np.packbits(out, bitorder="little").tobytes()


def _stored(docs: DataFrame, folder: str | None = None, id_column: str = "doc_id", text_column: str = "text", shard_bytes: int = 1 << 28, bits: int = BITS) -> tuple[DataFrame, DataFrame]:
    """store(), with digests as bytes."""
    spark = ready(docs.sparkSession)
    folder = folder or work_path(spark, "shards")
    rows = materialize(_digests(docs, id_column, text_column), "rows")
    held = spark.sparkContext.broadcast(repeated_bits(rows, bits))
    names = ["digest", "shard", "offset", "length", "text"]
    types = [pa.binary(), pa.string(), pa.int64(), pa.int64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch], direct: bool) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shards, seen, marks = _Shards(folder, TaskContext.get().partitionId(), shard_bytes), set(), held.value
        before = None
        for b in batches:
            out = []
            for t in b.column(b.num_columns - 1):
                text = t.as_py()
                payload = padded(text)[1]
                digest = hashlib.sha256(payload).digest()
                if direct and marks[(n := _bit(digest, bits)) >> 3] >> (n & 7) & 1:
                    if digest not in seen:
                        seen.add(digest)
                        out.append((digest, None, None, None, text or ""))
                elif direct or digest != before:  # the second time, equal digests come one after the other
                    out.append((digest, *shards.add(digest.hex() + ".png", to_png(payload)), None))
                before = digest
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)
        shards.close()

    schema = "digest binary, shard string, offset bigint, length bigint, text string"
    first = materialize(docs.select(F.col(f"`{text_column}`").alias("text")).mapInArrow(lambda it: run(it, True), schema), "first")
    later = first.filter("text is not null").select("digest", "text").repartition("digest").sortWithinPartitions("digest")
    second = materialize(later.mapInArrow(lambda it: run(it, False), schema), "second")
    return rows, first.filter("text is null").drop("text").union(second.drop("text"))


def store(docs: DataFrame, folder: str | None = None, id_column: str = "doc_id", text_column: str = "text", shard_bytes: int = 1 << 28, bits: int = BITS) -> tuple[DataFrame, DataFrame]:
    """Write the payloads; (id, n_bytes, digest) of every row and (digest, shard, offset, length) of every digest."""
    rows, places = _stored(docs, folder, id_column, text_column, shard_bytes, bits)
    return _hex(rows), _hex(places)


def _read(places: DataFrame, schema: str, make, along: tuple[str, ...] = ()) -> DataFrame:
    """mapInArrow over distinct places in order of shard and offset; make(file, digest, offset, length) gives a row.

    ``along``: columns of the places that go along.
    """
    ordered = places.select("digest", "shard", "offset", "length").repartitionByRange(F.col("shard"), F.col("offset")).sortWithinPartitions("shard", "offset")
    fields = [x.split() for x in schema.split(", ")]
    kinds = {"binary": pa.binary(), "string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        name, file = None, None
        for b in batches:
            rows = []
            for digest, shard, offset, length in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if shard != name:
                    if file is not None:
                        file.close()
                    system, path = fs.FileSystem.from_uri(shard)
                    name, file = shard, system.open_input_file(path)
                rows.append(make(file, digest, offset, length))
            if rows:
                yield pa.RecordBatch.from_arrays([*[pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows, strict=True), fields, strict=True)], *[b.column(c) for c in along]], [*[n for n, _ in fields], *along])
        if file is not None:
            file.close()

    return ordered.mapInArrow(run, ", ".join([schema, *[f"{c} {places.schema[c].dataType.simpleString()}" for c in along]]))


def read_headers(places: DataFrame) -> DataFrame:
    """(digest, width, height, depth, colour) of each digest by range reads of its header alone."""

    def make(file, digest, offset, length):
        h = png_header(file.read_at(HEADER, offset))
        return digest, h["width"], h["height"], h["depth"], h["colour"]

    return _read(places, "digest string, width int, height int, depth int, colour int", make)


def _payloads(places: DataFrame) -> DataFrame:
    """read_payloads() without its second column, over digests as bytes; the digest is that of the payload read back."""

    def make(file, digest, offset, length):
        head = png_header(file.read_at(HEADER, offset))
        raw = file.read_at(length, offset)
        payload = from_png(raw)
        sha = hashlib.sha256(payload).digest()
        if sha != digest:
            raise ValueError(f"payload {digest.hex()} is damaged")
        return sha, len(payload), zlib.crc32(payload[-64:]), len(raw), hashlib.sha256(raw).digest(), feature(payload, head), offset, length, head["width"], head["height"], head["depth"], head["colour"]

    schema = "digest binary, payload_bytes bigint, tail_crc32 bigint, media_bytes bigint, media_sha256 binary, feature string, offset bigint, length bigint, width int, height int, depth int, colour int"
    return _read(places, schema, make, ("shard",))


def _as_text(found: DataFrame) -> DataFrame:
    return _hex(found).withColumn("payload_sha256", F.col("digest")).withColumn("media_sha256", F.lower(F.hex("media_sha256")))


def read_payloads(places: DataFrame) -> DataFrame:
    """What each digest's header alone and then its stored bytes give when they are read back, beside its place."""
    columns = ["digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "offset", "length", "width", "height", "depth", "colour", "shard"]
    return _as_text(_payloads(places.withColumn("digest", F.unhex("digest")))).select(columns)


def described(docs: DataFrame, folder: str | None = None, id_column: str = "doc_id", text_column: str = "text") -> tuple[DataFrame, DataFrame]:
    """Rows (id, n_bytes, digest), and for each digest its place and the metadata columns read from its header alone."""
    rows, places = store(docs, folder, id_column, text_column)
    return rows, materialize(places.join(read_headers(places), "digest"), "heads")


def media_columns(docs: DataFrame, folder: str | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Rows with digest, shard, offset and length, and the metadata columns."""
    rows, heads = described(docs, folder, id_column, text_column)
    return rows.join(heads, "digest")


def media_report(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """The media columns and what the payloads give when they are read back."""
    rows, places = _stored(docs, folder)
    found = materialize(_payloads(places), "features")
    columns = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "digest", "shard", "offset", "length", "width", "height", "depth", "colour"]
    return _as_text(rows.join(found, "digest")).select(F.col("id").alias("doc_id"), *columns)
