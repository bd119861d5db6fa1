"""Dawid-Skene annotator models, calibration of engines, and signals of candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilspark.operators.metrics import prf


def majority_vote(votes: DataFrame) -> DataFrame:
    """(item_id, label, share) of rows (item_id, engine_id, label); ties: the smaller label."""
    n = votes.groupBy("item_id", "label").agg(F.count("*").alias("n"))
    w = Window.partitionBy("item_id")
    best = n.withColumn("share", F.col("n") / F.sum("n").over(w)).withColumn("place", F.row_number().over(w.orderBy(F.desc("n"), "label")))
    return best.filter("place = 1").select("item_id", "label", "share")


def dawid_skene(votes: DataFrame, iterations: int = 10, smoothing: float = 0.01) -> tuple[DataFrame, DataFrame]:
    """(item_id, label, posterior) and (engine_id, truth, label, p) by expectation maximisation.

    Each round is two aggregations; the confusion table has a row for each engine and pair of labels.
    Rounds are cut by checkpoint() where a checkpoint folder is set.
    """
    spark = votes.sparkSession
    cut = (lambda df: df.checkpoint()) if spark.sparkContext.getCheckpointDir() else (lambda df: df)
    labels = votes.select("label").filter("label is not null").distinct()
    k = labels.count()
    n = votes.groupBy("item_id").agg(F.count("*").alias("n"))
    post = votes.groupBy("item_id", "label").agg(F.count("*").alias("c")).join(n, "item_id").select("item_id", F.col("label").alias("truth"), (F.col("c") / F.col("n")).alias("p"))
    confusion = votes.limit(0)
    for _ in range(iterations):
        joint = votes.join(post, "item_id").groupBy("engine_id", "truth", "label").agg(F.sum("p").alias("w"))
        one = lambda name: labels.select(F.col("label").alias(name), F.lit(1).alias("_all"))
        grid = joint.select("engine_id", F.lit(1).alias("_all")).distinct().join(one("truth"), "_all").join(one("label"), "_all").drop("_all")
        full = grid.join(joint, ["engine_id", "truth", "label"], "left").fillna(0.0, ["w"]).withColumn("w", F.col("w") + smoothing)
        confusion = cut(full.withColumn("p", F.col("w") / F.sum("w").over(Window.partitionBy("engine_id", "truth"))).select("engine_id", "truth", "label", "p"))
        prior = post.groupBy("truth").agg(F.sum("p").alias("w")).withColumn("prior", (F.col("w") + smoothing) / (F.sum("w").over(Window.partitionBy()) + smoothing * k)).select("truth", "prior")
        scores = votes.join(confusion, ["engine_id", "label"]).groupBy("item_id", "truth").agg(F.sum(F.ln("p")).alias("s")).join(prior, "truth").withColumn("s", F.col("s") + F.ln("prior"))
        w = Window.partitionBy("item_id")
        e = F.exp(F.col("s") - F.max("s").over(w))
        post = cut(scores.withColumn("e", e).withColumn("p", F.col("e") / F.sum("e").over(w)).select("item_id", "truth", "p"))
    best = post.withColumn("place", F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("p"), "truth"))).filter("place = 1")
    return best.select("item_id", F.col("truth").alias("label"), F.col("p").alias("posterior")), confusion


def offline_calibration(predicted: DataFrame, gold: DataFrame, least: int = 5) -> DataFrame:
    """(engine_id, entity_type, f1, support) of engines' spans, where gold has ``least`` of the type or more."""
    keys = ["record_id", "entity_type", "start", "end"]
    p = predicted.groupBy("engine_id", *keys).agg(F.count("*").alias("p"))
    g = gold.groupBy(*keys).agg(F.count("*").alias("g"))
    met = p.join(g, keys, "left").groupBy("engine_id", "entity_type").agg(F.sum(F.least("p", F.coalesce("g", F.lit(0)))).alias("tp"), F.sum("p").alias("predicted"))
    totals = gold.groupBy("entity_type").agg(F.count("*").alias("gold")).filter(F.col("gold") >= least)
    engines = predicted.select("engine_id", F.lit(1).alias("_all")).distinct()
    grid = engines.join(totals.withColumn("_all", F.lit(1)), "_all").drop("_all")  # a row for each engine and type
    c = grid.join(met, ["engine_id", "entity_type"], "left").fillna(0, ["tp", "predicted"])
    return c.select("engine_id", "entity_type", F.col("gold").alias("support"), *prf(F.col("tp"), F.col("predicted"), F.col("gold")))


def calibrated_strengths(experts: DataFrame, measured: DataFrame, least: int = 5) -> DataFrame:
    """Experts' strengths (expert_id, entity_type, strength) with what was measured in their place."""
    m = measured.select(F.col("engine_id").alias("expert_id"), "entity_type", F.when(F.col("support") >= least, F.col("f1")).alias("f1"))
    return experts.join(m, ["expert_id", "entity_type"], "left").select("expert_id", "entity_type", F.coalesce("f1", "strength").alias("strength"))


def informativeness(findings: DataFrame) -> DataFrame:
    """Of each engine: five times the spread of its confidences, from 0.1 to 1."""
    s = F.least(F.lit(1.0), F.greatest(F.lit(0.1), 5 * F.stddev_pop("confidence")))
    return findings.groupBy("engine_id").agg(F.when(F.count("*") < 2, 0.1).otherwise(s).alias("informativeness"))


def sample_weights(df: DataFrame, boost: float = 2.0, paired: float = 1.5) -> DataFrame:
    """Rows (resistance, is_paired) with weights: 1 + (boost - 1)(1 - resistance), more for paired profiles."""
    w = 1 + (boost - 1) * (1 - F.coalesce("resistance", F.lit(1.0)))
    return df.withColumn("weight", w * F.when(F.col("is_paired"), paired).otherwise(1.0))


def cosine(a, b):
    """Cosine of two arrays; 0 for a zero vector."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    n = norm(a) * norm(b)
    return F.when(n > 0, dot / n).otherwise(0.0)


def stratified_sample(df: DataFrame, strata: str, n: int, id_column: str, seed: int = 42) -> DataFrame:
    """About n rows, each stratum in proportion and at least one, by a hash of the id: a sampling operator."""
    counts = df.groupBy(strata).agg(F.count("*").alias("_n"))
    total = df.count()
    share = F.greatest(F.lit(1), F.floor(F.col("_n") * n / max(total, 1)))
    w = Window.partitionBy(strata).orderBy(F.md5(F.concat_ws(":", F.col(id_column).cast("string"), F.lit(str(seed)))), id_column)
    ranked = df.withColumn("_r", F.row_number().over(w)).join(counts.select(strata, share.alias("_share")), strata)
    return ranked.filter(F.col("_r") <= F.col("_share")).drop("_r", "_share")
