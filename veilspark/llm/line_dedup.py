"""Line dedup by distinct-site spread.

Each line (trimmed, not blank) is hashed to 128 bits; HyperLogLog sketches of the sites it
stands on merge in one aggregation, with partial sketches before the shuffle.  Lines whose
estimate is near the threshold get exact distinct counts; the others are decided by the
estimate, which is off by more than the band only beyond three standard errors.  A line on
``min_sites`` sites or more is boilerplate: its first occurrence, by doc_id and position,
stays and the others go.

Texts are shuffled once, to meet the positions of their own boilerplate lines.

Defined results: a null text stays null; blank lines always stay; a null source is no site;
rows with equal doc_id and text are one document and are treated alike; a document whose lines
all go stays with an empty text.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm.common import NOT_SPACES, SPACES, fresh, materialize, ready

#: Standard error of an HLL sketch with 2^12 registers, times three.
BAND = 3 * 1.04 / 64


def _lines(docs: DataFrame, id_column: str, text_column: str, site_column: str) -> DataFrame:
    text = F.col(f"`{text_column}`")
    base = docs.filter(text.isNotNull()).select(
        F.col(f"`{id_column}`").alias("id"), F.col(f"`{site_column}`").alias("site"), *_row_keys(id_column, text_column), F.posexplode(F.split(text, "\n", -1)).alias("at", "line")
    )
    line = F.regexp_replace("line", f"^{SPACES}+|{SPACES}+$", "")
    return base.filter(F.col("line").rlike(NOT_SPACES)).select("id", "site", "k1", "k2", "at", F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(1), line).alias("h2"))


def _row_keys(id_column: str, text_column: str) -> list:
    i, t = F.col(f"`{id_column}`"), F.col(f"`{text_column}`")
    return [F.xxhash64(i.isNull(), i, t).alias("k1"), F.xxhash64(F.lit(1), t, i).alias("k2")]


def boilerplate(lines: DataFrame, min_sites: int) -> DataFrame:
    """(h1, h2, first) of the lines on at least ``min_sites`` sites."""
    n = lines.count()
    spread = materialize(
        lines.groupBy("h1", "h2").agg(F.hll_sketch_agg("site", F.lit(12)).alias("sketch"), F.min(F.struct("id", "k1", "at")).alias("first"), F.count("*").alias("n"))
        .filter(F.col("n") >= min_sites)
        .select("h1", "h2", "first", F.hll_sketch_estimate("sketch").alias("sites")),
        "spread", n,
    )
    slack = max(1.0, BAND * min_sites)
    near = materialize(spread.filter((F.col("sites") >= min_sites - slack) & (F.col("sites") <= min_sites + slack)).select("h1", "h2"), "near", n)
    exact = lines.join(near, ["h1", "h2"], "left_semi").select("h1", "h2", "site").filter("site is not null").distinct().groupBy("h1", "h2").count()
    sure = spread.filter(F.col("sites") > min_sites + slack).select("h1", "h2", "first")
    told = spread.join(exact.filter(F.col("count") >= min_sites).select("h1", "h2"), ["h1", "h2"], "left_semi").select("h1", "h2", "first")
    return materialize(sure.union(told), "boilerplate", n)


def _cut(batches: Iterator[pa.RecordBatch], at: int, gone: int, count: str) -> Iterator[pa.RecordBatch]:
    """Rewrite the texts (column ``at``) of rows with lines to go (column ``gone``, dropped); ``count`` names the new column."""
    for b in batches:
        lost = b.column(gone)
        counts = [0] * b.num_rows
        texts = b.column(at)
        if lost.null_count < b.num_rows:
            new = texts.to_pylist()
            for k, out in enumerate(lost.to_pylist()):
                if out:
                    drop = set(out)
                    new[k] = "\n".join([x for i, x in enumerate(new[k].split("\n")) if i not in drop])
                    counts[k] = len(drop)
            texts = pa.array(new, b.schema.field(at).type)
        columns = [texts if i == at else c for i, c in enumerate(b.columns) if i != gone]
        names = [n for i, n in enumerate(b.schema.names) if i != gone]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int64())], [*names, count])


def remove_boilerplate(docs: DataFrame, min_sites: int = 10, id_column: str = "doc_id", text_column: str = "text", site_column: str = "source") -> tuple[DataFrame, str]:
    """The table with boilerplate lines cut from its texts and a count of them, and the count's name."""
    ready(docs.sparkSession)
    lines = materialize(_lines(docs, id_column, text_column, site_column), "lines")
    known = boilerplate(lines, min_sites)
    hits = lines.join(known, ["h1", "h2"]).filter(F.struct("id", "k1", "at") != F.col("first"))
    gone = materialize(hits.groupBy("k1", "k2").agg(F.collect_set("at").alias("gone")), "gone", lines.count())
    k1, k2, lost, count = (fresh(docs, s) for s in ("k1", "k2", "gone", "removed"))
    keyed = docs.withColumns(dict(zip((k1, k2), _row_keys(id_column, text_column), strict=True)))
    met = keyed.join(gone.select(F.col("k1").alias(k1), F.col("k2").alias(k2), F.col("gone").alias(lost)), [k1, k2], "left").select(*[f"`{c}`" for c in docs.columns], lost)
    at, end = docs.columns.index(text_column), len(docs.columns)
    schema = docs.select("*", F.lit(0).cast("bigint").alias(count)).schema
    return met.mapInArrow(lambda it: _cut(it, at, end, count), schema), count


def line_report(docs: DataFrame, min_sites: int = 10) -> DataFrame:
    cut, count = remove_boilerplate(docs.select("doc_id", "text", "source"), min_sites)
    return cut.select("doc_id", F.col(count).alias("n_removed"), "text")


SQL = r"""
with l as (
  select doc_id, source, i, regexp_replace(line, '^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$', '', 'g') as line, line as raw
  from (select doc_id, source, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i from documents where text is not null)),
b as (select line from l where line <> '' group by line having count(distinct source) >= 10),
m as (select l.*, b.line is not null and row_number() over (partition by l.line order by doc_id nulls first, i) > 1 as gone from l left join b on l.line = b.line),
t as (select doc_id, count(*) filter (gone) as n_removed, coalesce(string_agg(raw, chr(10) order by i) filter (not gone), '') as text from m group by doc_id)
select doc_id, n_removed, text from t
union all select doc_id, 0, null from documents where text is null
"""
