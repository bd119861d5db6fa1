"""Overlap resolution and the rebuilding of texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN = "struct<s:int,e:int,c:double,entity_type:string,matched:string>"


def resolved(spans: Column) -> Column:
    """Disjoint spans of an array of (s, e, c, entity_type, matched).

    In order of start and end; one that overlaps the last kept takes its place if its
    confidence, then its length, is greater.
    """
    rank = lambda x: F.struct(x["c"], x["e"] - x["s"])
    last = lambda a: F.try_element_at(a, F.lit(-1))
    step = lambda a, x: (
        F.when((F.size(a) == 0) | (x["s"] >= last(a)["e"]), F.concat(a, F.array(x)))
        .when(rank(x) > rank(last(a)), F.concat(F.slice(a, 1, F.size(a) - 1), F.array(x)))
        .otherwise(a)
    )
    return F.aggregate(F.array_sort(spans), F.array().cast(f"array<{SPAN}>"), step)


def rebuilt(text: Column, spans: Column) -> Column:
    """The text with disjoint ascending spans (s, e, replacement) replaced."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    step = lambda a, x: F.struct(F.concat(a["out"], text.substr(a["at"] + 1, x["s"] - a["at"]), x["replacement"]).alias("out"), x["e"].alias("at"))
    return F.aggregate(spans, start, step, lambda a: F.concat(a["out"], text.substr(a["at"] + 1, F.length(text))))


def collected(findings: DataFrame) -> DataFrame:
    """(doc_id, field_path, spans): each field's findings, resolved.  A field's findings, bounded by its text, meet in one row."""
    one = F.struct(F.col("span_start").alias("s"), F.col("span_end").alias("e"), F.col("confidence").alias("c"), "entity_type", "matched")
    return findings.groupBy("doc_id", "field_path").agg(F.collect_list(one).alias("all")).select("doc_id", "field_path", resolved(F.col("all")).alias("spans"))


def transform_texts(texts: DataFrame, findings: DataFrame, replacement) -> DataFrame:
    """(doc_id, field_path, text, n_findings): every finding's span replaced.

    ``replacement``: a function of (entity type, matched text, number of the span from 0) to a Column.
    Texts without findings stay as they are.
    """
    made = F.transform(F.col("spans"), lambda x, i: F.struct(x["s"].alias("s"), x["e"].alias("e"), replacement(x["entity_type"], x["matched"], i).alias("replacement")))
    joined = texts.join(collected(findings), ["doc_id", "field_path"], "left")
    return joined.withColumn("made", made).select("doc_id", "field_path", F.when(F.size("made") > 0, rebuilt(F.col("text"), F.col("made"))).otherwise(F.col("text")).alias("text"), F.coalesce(F.size("spans"), F.lit(0)).alias("n_findings"))
