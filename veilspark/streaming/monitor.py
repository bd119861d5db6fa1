"""Monitoring of streams: count windows, moving averages, drift, coverage, disturbances, and a streamed pipeline."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def rolling(df: DataFrame, value: str, key: str, order: str, sizes: tuple[int, ...] = (10, 50, 100)) -> DataFrame:
    """Means of each key's last n values."""
    w = Window.partitionBy(key).orderBy(order)
    return df.withColumns({f"mean_{n}": F.avg(value).over(w.rowsBetween(1 - n, 0)) for n in sizes})


def drift(df: DataFrame, value: str, key: str, order: str, warn: float = 3.0, critical: float = 5.0, least: int = 30) -> DataFrame:
    """Range of the running sum of deviations from each key's mean, in standard deviations, and the alert it gives."""
    by = Window.partitionBy(key)
    mean, sd = F.avg(value).over(by), F.stddev_pop(value).over(by)
    run = df.withColumns({"_m": mean, "_s": sd}).withColumn("_c", F.sum(F.col(value) - F.col("_m")).over(by.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))
    out = run.groupBy(key).agg(F.count("*").alias("n"), F.first("_s").alias("sd"), (F.greatest(F.max("_c"), F.lit(0.0)) - F.least(F.min("_c"), F.lit(0.0))).alias("reach"))
    x = F.when(F.col("sd") > 0, F.col("reach") / F.col("sd")).otherwise(0.0)
    level = F.when(F.col("n") < least, "none").when(x > critical * F.col("sd"), "critical").when(x > warn * F.col("sd"), "warning").otherwise("none")
    return out.select(key, "n", "reach", x.alias("drift"), level.alias("level"))


def ewma_fold(values, alpha: float = 0.05):
    """Exponential moving average of an ordered array column; the first value starts it."""
    start = F.get(values, F.lit(0)).cast("double")
    return F.aggregate(F.slice(values, 2, F.greatest(F.size(values), F.lit(1))), start, lambda a, x: alpha * x.cast("double") + (1 - alpha) * a)


def coverage(df: DataFrame, column: str, least: int = 10) -> DataFrame:
    """Counts of types, and whether they are short of ``least``; works on streams in update mode."""
    return df.groupBy(column).agg(F.count("*").alias("n")).withColumn("gap", F.col("n") < least)


def disturbed(df: DataFrame, mode: str, column: str = "text") -> DataFrame:
    """Rows split in two, doubled or cut in half, with what was done to them."""
    t = F.coalesce(F.col(column), F.lit(""))
    half = F.greatest(F.lit(1), F.floor(F.length(t) / 2)).cast("int")
    if mode == "split":
        parts = F.array(F.struct(F.substring(t, 1, half).alias("t"), F.lit("split-a").alias("d")), F.struct(t.substr(half + 1, F.length(t)).alias("t"), F.lit("split-b").alias("d")))
        return df.withColumn("_p", F.explode(parts)).withColumns({column: F.col("_p.t"), "disturbance": F.col("_p.d")}).drop("_p")
    if mode == "duplicate":
        return df.withColumn("disturbance", F.explode(F.array(F.lit(None).cast("string"), F.lit("duplicate"))))
    if mode == "truncate":
        return df.withColumns({column: F.substring(t, 1, half), "disturbance": F.lit("truncate")})
    if mode == "none":
        return df.withColumn("disturbance", F.lit(None).cast("string"))
    raise ValueError(f"no disturbance {mode!r}")


EVALUATED = "key string, n bigint, ewma double, mean double, drift double, level string"
STATE = "n bigint, ewma double, total double, squares double, run double, high double, low double"


def evaluator(alpha: float = 0.05, warn: float = 3.0, critical: float = 5.0, least: int = 30) -> Callable:
    """For ``applyInPandasWithState`` over (key, seq, value): moving average, mean and drift alerts.

    State is a few sums for each key, whatever the stream's length: the running sum of
    deviations is taken from the mean so far.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, ewma, total, squares, acc, high, low = state.get if state.exists else (0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0)
        values = [v for f in frames for v in f.sort_values("seq")["value"].tolist()]
        for v in values:
            n += 1
            ewma = v if n == 1 else alpha * v + (1 - alpha) * ewma
            total += v
            squares += v * v
            acc += v - total / n
            high, low = max(high, acc), min(low, acc)
        state.update((n, ewma, total, squares, acc, high, low))
        mean = total / n if n else 0.0
        sd = max(0.0, squares / n - mean * mean) ** 0.5 if n else 0.0
        x = (high - low) / sd if sd > 0 else 0.0
        level = "none" if n < least else "critical" if x > critical * sd else "warning" if x > warn * sd else "none"
        yield pd.DataFrame([(key[0], n, ewma, mean, x, level)], columns=["key", "n", "ewma", "mean", "drift", "level"])

    return run


def evaluate_stream(stream: DataFrame, key: str, seq: str, value: str, **options) -> DataFrame:
    src = stream.select(F.col(key).cast("string").alias("key"), F.col(seq).cast("bigint").alias("seq"), F.col(value).cast("double").alias("value"))
    return src.groupBy("key").applyInPandasWithState(evaluator(**options), EVALUATED, STATE, "update", "NoTimeout")


def deidentify_stream(stream: DataFrame, sink: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame]):
    """Start a query that runs a batch plan on every micro-batch and appends its rows to ``sink`` as Parquet."""

    def each(batch: DataFrame, number: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{sink}/batch={number}")  # a batch that is run again replaces its rows

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
