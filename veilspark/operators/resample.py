"""Bootstrap intervals and paired tests by Poisson weights.

A row's weight in a draw comes from its id and the draw's number alone: squares modulo a prime
mix them, and the result is compared with the distribution of Poisson(1).  Each task sums
weights and weighted values of its rows for all draws, so a row never leaves its task and what is
shuffled is one row a task, group and draw.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from math import exp, factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PRIME = 2_147_483_647
#: P(weight <= k) of Poisson(1).
STEPS = np.cumsum([exp(-1) / factorial(k) for k in range(10)])


def weights(ids: np.ndarray, draw: int, seed: int = 42) -> np.ndarray:
    """Poisson(1) weights of rows in a draw."""
    i = ids.astype(np.int64) % PRIME
    x = (i * 48_271 + draw * 69_621 + seed) % PRIME
    x = (x * x + draw) % PRIME
    x = (x * x + i) % PRIME
    return np.searchsorted(STEPS, x / PRIME, side="right")


def draw_means(df: DataFrame, value: str, id_column: str, by: Sequence[str] = (), draws: int = 1000, seed: int = 42) -> DataFrame:
    """(by…, draw, mean) of every draw whose weights aren't all zero; rows without a value don't count."""
    by = list(by)
    src = df.filter(F.col(value).isNotNull()).select(F.to_json(F.struct(*by), {"ignoreNullFields": "false"}).alias("g") if by else F.lit("").alias("g"), F.col(id_column).cast("bigint").alias("i"), F.col(value).cast("double").alias("x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            names, at = np.unique(np.array(b.column(0).to_pylist(), object), return_inverse=True)
            ids, x = b.column(1).to_numpy(zero_copy_only=False), b.column(2).to_numpy(zero_copy_only=False)
            for g in names:
                sums.setdefault(g, np.zeros((2, draws)))
            for d in range(draws):
                w = weights(ids, d, seed)
                n, s = np.bincount(at, w, len(names)), np.bincount(at, w * x, len(names))
                for k, g in enumerate(names):
                    sums[g][:, d] += n[k], s[k]
        for g, a in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([g] * draws), pa.array(np.arange(draws), pa.int32()), pa.array(a[0]), pa.array(a[1])], ["g", "draw", "n", "s"])

    each = src.mapInArrow(run, "g string, draw int, n double, s double").groupBy("g", "draw").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).filter("n > 0")
    means = each.select("g", "draw", (F.col("s") / F.col("n")).alias("mean"))
    if not by:
        return means.drop("g")
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by)
    return means.withColumn("g", F.from_json("g", kinds)).select("g.*", "draw", "mean")


def interval(df: DataFrame, value: str = "value", id_column: str = "id", by: Sequence[str] = (), draws: int = 1000, level: float = 0.95, seed: int = 42) -> DataFrame:
    """(by…, low, high, error): percentile interval and standard error of the mean, for each group."""
    a = (1 - level) / 2
    return draw_means(df, value, id_column, by, draws, seed).groupBy(*by).agg(F.percentile("mean", F.lit(a)).alias("low"), F.percentile("mean", F.lit(1 - a)).alias("high"), F.stddev_pop("mean").alias("error"))


def paired(df: DataFrame, a: str, b: str, id_column: str = "id", by: Sequence[str] = (), draws: int = 1000, seed: int = 42, compat: bool = False) -> DataFrame:
    """(by…, n, delta, low, high, p_value) of the difference a - b over rows that have both.

    p: the share of draws whose mean, less the observed one, is at least as far from zero as the
    observed one; ``compat`` doesn't subtract it, which makes about a half of any p.
    """
    by = list(by)
    both = df.withColumn("_d", F.col(a) - F.col(b)).filter("_d is not null")
    seen = both.groupBy(*by).agg(F.count("*").alias("n"), F.avg("_d").alias("delta"))
    means = draw_means(both, "_d", id_column, by, draws, seed)
    met = means.join(seen, by) if by else means.crossJoin(seen)  # without groups it is one row
    far = F.abs(F.col("mean") if compat else F.col("mean") - F.col("delta")) >= F.abs("delta")
    return met.groupBy(*by, "n", "delta").agg(F.percentile("mean", F.lit(0.025)).alias("low"), F.percentile("mean", F.lit(0.975)).alias("high"), F.avg(far.cast("double")).alias("p_value"))


def significance(scores: DataFrame, draws: int = 1000, seed: int = 42) -> DataFrame:
    """Every pair of systems of (system, id, score) once: n, delta, p_value and whether it is below 0.05 and 0.01.

    Pairs meet on the ids that both have.
    """
    x = scores.select(F.col("system").alias("a"), "id", F.col("score").alias("score_a"))
    y = scores.select(F.col("system").alias("b"), "id", F.col("score").alias("score_b"))
    t = paired(x.join(y, "id").filter("a < b"), "score_a", "score_b", "id", ["a", "b"], draws, seed)
    return t.select("a", "b", "n", "delta", "p_value", (F.col("p_value") < 0.05).alias("significant_at_05"), (F.col("p_value") < 0.01).alias("significant_at_01"))
