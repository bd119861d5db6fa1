"""One-to-one alignment of predicted and gold spans, by any of four rules.

Spans: (record_id, entity_type, start, end).  Labels are taken in order, each by the first
prediction not yet taken that its rule accepts.  The different spans of a stretch of text, with their
numbers, are one array, so the alignment is a fold over it in the JVM.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.operators.metrics import iou, meeting, numbered, prf

MODES = ("strict", "exact", "partial", "type")


def accepts(mode: str, p: Column, g: Column, threshold: float = 0.5) -> Column:
    """Whether prediction p stands for label g (structs of entity_type, start, end).

    strict: type and boundaries; exact: boundaries; partial: an overlap of the threshold or
    more, whatever the type; type: the same type and any overlap.
    """
    same = (p["start"] == g["start"]) & (p["end"] == g["end"])
    over = (p["start"] < g["end"]) & (g["start"] < p["end"])
    kind = p["entity_type"] == g["entity_type"]
    return {"strict": kind & same, "exact": same, "partial": over & (iou(p["start"], p["end"], g["start"], g["end"]) >= threshold), "type": kind & over}[mode]


def sanitised(predicted: DataFrame, lengths: DataFrame) -> DataFrame:
    """Predictions within their record's text (record_id, n_chars), each once; spans of no record go."""
    inside = (F.col("start") >= 0) & (F.col("end") > F.col("start")) & (F.col("end") <= F.col("n_chars"))
    return predicted.join(lengths.select("record_id", "n_chars"), "record_id").filter(inside).select("record_id", "entity_type", "start", "end").distinct()


def aligned(predicted: DataFrame, gold: DataFrame, mode: str = "strict", threshold: float = 0.5) -> DataFrame:
    """(record_id, tp, predicted, gold) by first fit; spans in order of start, end, type.

    Equal labels follow each other and so do equal predictions, so a different label takes from each
    different prediction in turn as many as both have left.
    """
    start = F.struct(F.transform("p", lambda x: x["n"]).alias("left"), F.lit(0).cast("bigint").alias("need"), F.lit(0).cast("bigint").alias("tp"))
    none = F.array().cast("array<bigint>")

    def take(a: Column, x: Column, g: Column) -> Column:
        n = F.when(accepts(mode, x["p"], g, threshold), F.least(x["left"], a["need"])).otherwise(F.lit(0).cast("bigint"))
        return F.struct(F.concat(a["left"], F.array(x["left"] - n)).alias("left"), (a["need"] - n).alias("need"), (a["tp"] + n).alias("tp"))

    def step(a: Column, g: Column) -> Column:
        given = F.zip_with("p", a["left"], lambda x, n: F.struct(x.alias("p"), n.alias("left")))
        return F.aggregate(given, F.struct(none.alias("left"), g["n"].alias("need"), a["tp"].alias("tp")), lambda b, x: take(b, x, g))

    count = lambda n: F.sum(F.aggregate(n, F.lit(0).cast("bigint"), lambda a, x: a + x["n"])).alias(n)
    both = meeting(numbered(predicted), numbered(gold), ["record_id"])
    tp = F.when((F.size("p") > 0) & (F.size("g") > 0), F.aggregate("g", start, step, lambda a: a["tp"])).otherwise(0)
    return both.withColumn("tp", tp).groupBy("record_id", "apart").agg(F.sum("tp").alias("tp"), count("p").alias("predicted"), count("g").alias("gold")).drop("apart")


def alignment_scores(predicted: DataFrame, gold: DataFrame, modes: Sequence[str] = MODES, threshold: float = 0.5) -> DataFrame:
    """(mode, tp, predicted, gold, precision, recall, f1) over all records."""
    out = None
    for mode in modes:
        c = aligned(predicted, gold, mode, threshold).agg(*[F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in ("tp", "predicted", "gold")])
        c = c.select(F.lit(mode).alias("mode"), "tp", "predicted", "gold", *prf(F.col("tp"), F.col("predicted"), F.col("gold")))
        out = c if out is None else out.unionByName(c)
    return out


def scores_by(predicted: DataFrame, gold: DataFrame, records: DataFrame, by: str, mode: str = "strict", threshold: float = 0.5) -> DataFrame:
    """Scores for each value of a column of the records (language, context tier, dimension …)."""
    c = aligned(predicted, gold, mode, threshold).join(records.select("record_id", by), "record_id").groupBy(by).agg(*[F.sum(x).alias(x) for x in ("tp", "predicted", "gold")])
    return c.select(by, "tp", "predicted", "gold", *prf(F.col("tp"), F.col("predicted"), F.col("gold")))


def gain(before: DataFrame, after: DataFrame, gold: DataFrame, mode: str = "strict") -> DataFrame:
    """What reconciling segments' findings changed: both F1 and their difference, one row."""
    one = lambda df, n: alignment_scores(df, gold, [mode]).select(F.col("f1").alias(n), F.col("mode"))
    return one(before, "before").join(one(after, "after"), "mode").select("before", "after", (F.col("after") - F.col("before")).alias("gain"))


def set_f_beta(predicted: DataFrame, gold: DataFrame, keys: Sequence[str], beta: float = 1.0) -> DataFrame:
    """Scores of two tables as sets of their keys."""
    p, g = predicted.select(*keys).distinct().withColumn("p", F.lit(1)), gold.select(*keys).distinct().withColumn("g", F.lit(1))
    c = p.join(g, list(keys), "full").agg(F.count_if(F.col("p").isNotNull() & F.col("g").isNotNull()).alias("tp"), F.count("p").alias("predicted"), F.count("g").alias("gold"))
    return c.select("tp", "predicted", "gold", *prf(F.col("tp"), F.col("predicted"), F.col("gold"), beta))


def boundary_loss(cases: DataFrame, found: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Share of expected boundary cases that weren't found."""
    lost = cases.join(found.select(*keys).distinct(), list(keys), "left_anti").agg(F.count("*").alias("lost"))
    return cases.agg(F.count("*").alias("cases")).join(lost).select("cases", "lost", F.when(F.col("cases") > 0, F.col("lost") / F.col("cases")).otherwise(0.0).alias("loss"))  # one row each


def token_stability(tokens: DataFrame) -> DataFrame:
    """Share of entities (entity, token) that had one token throughout."""
    per = tokens.groupBy("entity").agg(F.count_distinct("token").alias("n"))
    return per.agg(F.count("*").alias("entities"), F.count_if(F.col("n") == 1).alias("stable")).select("entities", "stable", F.when(F.col("entities") > 0, F.col("stable") / F.col("entities")).otherwise(1.0).alias("score"))
