"""Readers and writers of records (record_id, text, metadata columns)."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser
from pathlib import PurePosixPath
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: File endings and their formats.
ENDINGS = {".csv": "csv", ".jsonl": "jsonl", ".ndjson": "jsonl", ".json": "json", ".txt": "txt", ".text": "txt", ".parquet": "parquet", ".pq": "parquet", ".xml": "xml", ".html": "html", ".htm": "html"}


def detect_format(path: str) -> str:
    ending = PurePosixPath(path).suffix.lower()
    if ending not in ENDINGS:
        raise ValueError(f"no format has the ending {ending!r}")
    return ENDINGS[ending]


def _id(df: DataFrame) -> DataFrame:
    """Rows with an id of their own; ids rise within a file's partitions and have gaps."""
    return df.withColumn("record_id", F.monotonically_increasing_id())


def _cut(df: DataFrame, text_column: str, max_chars: int) -> DataFrame:
    if text_column not in df.columns:
        raise ValueError(f"no column {text_column!r}; there are {', '.join(df.columns)}")
    t = F.coalesce(F.col(f"`{text_column}`").cast("string"), F.lit(""))
    others = [F.col(f"`{c}`") for c in df.columns if c not in (text_column, "record_id", "text")]
    return df.select("record_id", (F.substring(t, 1, max_chars) if max_chars else t).alias("text"), *others)


def read(spark: SparkSession, path: str, fmt: str | None = None, text_column: str = "text", delimiter: str = ",", encoding: str = "UTF-8", whole_file: bool = False, max_chars: int = 0) -> DataFrame:
    """Records of files of one format; metadata are the other columns."""
    fmt = fmt or detect_format(path)
    if fmt == "csv":
        return _cut(_id(spark.read.csv(path, header=True, sep=delimiter, encoding=encoding, multiLine=True, escape='"')), text_column, max_chars)
    if fmt == "jsonl":
        return _cut(_id(spark.read.json(path, mode="FAILFAST", encoding=encoding)), text_column, max_chars)
    if fmt == "json":
        raw = spark.read.json(path, multiLine=True, encoding=encoding)
        if raw.columns == ["records"]:
            raw = raw.select(F.explode("records").alias("r")).select("r.*")
        return _cut(_id(raw), text_column, max_chars)
    if fmt == "parquet":
        return _cut(_id(spark.read.parquet(path)), text_column, max_chars)
    if fmt == "txt":
        lines = spark.read.text(path, wholetext=whole_file).withColumn("value", F.col("value") if whole_file else F.trim("value")).filter(F.trim("value") != "")
        return _cut(_id(lines.withColumnRenamed("value", "text")), "text", max_chars)
    if fmt in ("xml", "html"):
        return _cut(_id(_nodes(spark, path, fmt, encoding, whole_file)), "text", max_chars)
    raise ValueError(f"no reader for {fmt!r}")


class _Texts(HTMLParser):
    """Text nodes outside script, style and noscript."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style", "noscript")

    def handle_endtag(self, tag):
        self.hidden = max(0, self.hidden - (tag in ("script", "style", "noscript")))

    def handle_data(self, data):
        if not self.hidden and data.strip():
            self.found.append(data.strip())


def html_texts(html: str | None) -> list[str]:
    p = _Texts()
    p.feed(html or "")
    p.close()
    return p.found


def html_nodes(pages: DataFrame, id_column: str = "page_id", html_column: str = "html") -> DataFrame:
    """(id, node, text) of every text node of a table of pages."""
    kind = pages.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, node, text = [], [], []
            for i, h in enumerate(b.column(1)):
                for k, t in enumerate(html_texts(h.as_py())):
                    at.append(i)
                    node.append(k)
                    text.append(t)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(node, pa.int32()), pa.array(text, pa.string())], [id_column, "node", "text"])

    return pages.select(id_column, html_column).mapInArrow(run, f"{id_column} {kind}, node int, text string")


def _nodes(spark: SparkSession, path: str, fmt: str, encoding: str, whole: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            paths, tags, texts = [], [], []
            for p, raw in zip(b.column(0), b.column(1), strict=True):
                body = raw.as_py().decode(encoding)
                if fmt == "html":
                    rows = [("", t) for t in html_texts(body)]
                else:
                    rows = [(e.tag, " ".join(x.strip() for x in (e.text, e.tail) if x and x.strip())) for e in ElementTree.fromstring(body).iter()]
                rows = [r for r in rows if r[1]]
                for tag, t in [("", " ".join(t for _, t in rows))] if whole and rows else rows:
                    paths.append(p.as_py())
                    tags.append(tag)
                    texts.append(t)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in (paths, tags, texts)], ["source", "tag", "text"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "source string, tag string, text string")


def write(df: DataFrame, path: str, fmt: str, text_column: str = "text", mode: str = "errorifexists") -> None:
    """Records to files; nested columns become JSON for CSV."""
    if fmt == "txt":
        df.select(F.coalesce(F.col(text_column), F.lit("")).alias("value")).write.mode(mode).text(path)
    elif fmt in ("jsonl", "json"):
        df.write.mode(mode).json(path)
    elif fmt == "parquet":
        df.write.mode(mode).parquet(path)
    elif fmt == "csv":
        flat = [F.to_json(f.name).alias(f.name) if f.dataType.typeName() in ("struct", "array", "map") else F.col(f"`{f.name}`") for f in df.schema]
        df.select(*flat).write.mode(mode).csv(path, header=True, escape='"')
    else:
        raise ValueError(f"no writer for {fmt!r}")


def bio_spans(tokens: DataFrame) -> DataFrame:
    """(doc_id, entity_type, start, end) of tagged tokens (doc_id, pos, token, tag), joined by single spaces."""
    from pyspark.sql import Window

    w = Window.partitionBy("doc_id").orderBy("pos")
    start: Column = F.sum(F.length("token") + 1).over(w) - F.length("token") - 1
    kind = F.substring("tag", 3, 100)
    placed = tokens.withColumns({"s": start, "kind": kind, "before": F.lag("tag", 1, "O").over(w)})
    new = F.col("tag").startswith("B-") | (F.col("tag").startswith("I-") & (F.substring("before", 3, 100) != F.col("kind")))
    island = placed.withColumn("n", F.sum(new.cast("int")).over(w)).filter("tag != 'O'")
    return island.groupBy("doc_id", "n", F.col("kind").alias("entity_type")).agg(F.min("s").alias("start"), F.max(F.col("s") + F.length("token")).alias("end")).drop("n")
