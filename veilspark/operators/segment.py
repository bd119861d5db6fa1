"""Segmentation of long texts and the merging of their findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def token_estimate(text: Column) -> Column:
    """Spaces, line ends and tabs, plus one."""
    return F.length(text) - F.length(F.translate(text, " \n\t", "")) + 1


def context_tier(text: Column) -> Column:
    n = F.size(F.filter(F.split(text, "\\s+"), lambda w: w != ""))
    return F.when(n < 100, "short").when(n < 1000, "medium").when(n < 10000, "long").otherwise("very_long")


def chunks(texts: DataFrame, max_tokens: int = 4096, overlap: int = 128) -> DataFrame:
    """The windows of a chunker that reads on: like segments(), and one more with the overlap alone where a window ends with the text."""
    if not 0 <= overlap < max_tokens:
        raise ValueError("the overlap must be less than a window")
    return segments(texts, max_tokens, overlap, trailing=True)


def segments(texts: DataFrame, max_tokens: int = 512, overlap: int = 32, trailing: bool = False) -> DataFrame:
    """(doc_id, segment, token_start, token_end, char_start, char_end, text) windows of every text.

    A step is ``max_tokens - overlap``; the last window is the first that reaches the last
    token.  A text without tokens has no windows.
    """
    step = max(1, max_tokens - overlap)
    words, gaps = F.filter(F.split("text", "\\s+"), lambda w: w != ""), F.split("text", "\\S+", -1)
    cut = texts.select("doc_id", "text", words.alias("w"), gaps.alias("g")).filter(F.size("w") > 0)
    # what a token takes with the gap before it; offsets are sums of these, for the windows' ends only
    cut = cut.select("doc_id", "text", F.transform("g", F.length).alias("gap"), F.zip_with("g", "w", lambda g, w: F.length(g) + F.coalesce(F.length(w), F.lit(0))).alias("len"), F.size("w").alias("n"))
    count = F.when(F.col("n") <= max_tokens, 1).otherwise(1 + F.ceil((F.col("n") - max_tokens) / step)).cast("int")
    if trailing and overlap:
        count = count + ((F.col("n") >= max_tokens) & ((F.col("n") - max_tokens) % step == 0)).cast("int")
    cut = cut.select("*", F.explode(F.sequence(F.lit(0), count - 1)).alias("segment"))
    a = F.col("segment") * step
    z = F.least(a + max_tokens, F.col("n")) - 1
    upto = lambda k: F.aggregate(F.slice("len", F.lit(1), k), F.lit(0), lambda s, x: s + x)
    cut = cut.select("doc_id", "segment", "text", a.alias("token_start"), z.alias("token_end"), (upto(a) + F.get("gap", a)).alias("char_start"), upto(z + 1).alias("char_end"))
    return cut.withColumn("text", F.col("text").substr(F.col("char_start") + 1, F.col("char_end") - F.col("char_start")))


def shifted(findings: DataFrame, cut: DataFrame) -> DataFrame:
    """Findings of segments (doc_id, segment) with offsets of the whole text."""
    return findings.join(cut.select("doc_id", "segment", "char_start"), ["doc_id", "segment"]).withColumns({c: F.col(c) + F.col("char_start") for c in ("span_start", "span_end")}).drop("char_start")


def reconciled(findings: DataFrame) -> DataFrame:
    """One row for each (document, type, field, span): the highest confidence, all engines, how many met."""
    return findings.groupBy("doc_id", "entity_type", "field_path", "span_start", "span_end").agg(F.max("confidence").alias("confidence"), F.array_sort(F.collect_set("engine_id")).alias("engines"), F.count("*").alias("n_merged"))
