"""Evaluation end to end: detectors against gold records, external systems, leaderboards, checkpoints."""

from __future__ import annotations

import importlib
import time
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.operators import compare, fusion, matching, metrics, rating, resample
from veilspark.sources import datasets

Detector = Callable[[DataFrame], DataFrame]
PREDICTED = "record_id string, entity_type string, start int, end int, ms double"


def texts_of(records: DataFrame) -> DataFrame:
    return records.select(F.col("record_id").alias("doc_id"), F.lit("text").alias("field_path"), "language", "text")


def predictions(records: DataFrame, detector: Detector) -> DataFrame:
    """(record_id, entity_type, start, end) of a detector over the records' texts, valid and each once."""
    found = detector(texts_of(records)).select(F.col("doc_id").alias("record_id"), "entity_type", F.col("span_start").alias("start"), F.col("span_end").alias("end"))
    return matching.sanitised(found, records.select("record_id", F.length("text").alias("n_chars")))


def evaluate(records: DataFrame, predicted: DataFrame, modes: Sequence[str] = matching.MODES) -> dict[str, DataFrame]:
    """The report of predictions: overall by match mode, by type, by language, by context tier, averages, errors."""
    gold = datasets.labels_of(records)
    by_type = metrics.span_scores(predicted, gold, "strict", ["entity_type"])
    return {
        "overall": matching.alignment_scores(predicted, gold, modes), "by_type": by_type, "averages": metrics.averages(by_type), "by_language": matching.scores_by(predicted, gold, records, "language"),
        "by_context": matching.scores_by(predicted, gold, records, "context_length_tier"), "errors": metrics.error_taxonomy(predicted, gold),
    }


def record_scores(predicted: DataFrame, gold: DataFrame, mode: str = "strict") -> DataFrame:
    """(record_id, f1) of each record: what intervals and paired tests are made of."""
    c = matching.aligned(predicted, gold, mode)
    return c.select("record_id", metrics.safe_div(2.0 * F.col("tp"), F.col("predicted") + F.col("gold")).alias("f1"))


def intervals(records: DataFrame, predicted: DataFrame, by: str | None = None, draws: int = 1000) -> DataFrame:
    """Bootstrap interval of records' F1, over all or for each value of a column."""
    s = record_scores(predicted, datasets.labels_of(records)).join(records.select("record_id", *([by] if by else [])), "record_id")
    return resample.interval(s.withColumn("id", F.xxhash64("record_id").bitwiseAND((1 << 62) - 1)), "f1", "id", [by] if by else [], draws)


def resolve(path: str) -> Callable:
    """The callable that "module:name" names."""
    module, _, name = path.partition(":")
    if not module or not name:
        raise ValueError(f"{path!r} isn't module:name")
    found = getattr(importlib.import_module(module), name)
    if not callable(found):
        raise TypeError(f"{path} isn't callable")
    return found


def external(records: DataFrame, predictor: str | Callable[[str, str], Sequence[tuple[str, int, int]]], warm_up: int = 10) -> DataFrame:
    """(record_id, entity_type, start, end, ms) of a system outside: a function of (text, language), called in the tasks.

    A record without a finding has one row with no span, so that its time counts; a
    task's first ``warm_up`` records' times are left out.
    """
    src = records.select("record_id", "text", "language")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        call, seen = resolve(predictor) if isinstance(predictor, str) else predictor, 0
        for b in batches:
            rows = []
            for i, text, language in zip(*(c.to_pylist() for c in b.columns), strict=True):
                began = time.perf_counter()
                spans = list(call(text, language))
                ms = 1000 * (time.perf_counter() - began) if seen >= warm_up else None
                seen += 1
                rows += [(i, t, a, z, ms) for t, a, z in spans] or [(i, None, None, None, ms)]
            if rows:
                kinds = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["record_id", "entity_type", "start", "end", "ms"])

    return src.mapInArrow(run, PREDICTED)


def scorecard(name: str, records: DataFrame, timed: DataFrame) -> DataFrame:
    """One row of a system: its micro scores, latency and documents an hour, from ``external``'s rows."""
    spans = matching.sanitised(timed.filter("entity_type is not null").select("record_id", "entity_type", "start", "end"), records.select("record_id", F.length("text").alias("n_chars")))
    scores = matching.alignment_scores(spans, datasets.labels_of(records), ["strict"]).select("precision", "recall", "f1")
    pace = timed.groupBy("record_id").agg(F.max("ms").alias("ms")).agg(F.percentile("ms", F.lit(0.5)).alias("latency_ms"), F.avg("ms").alias("mean_ms"), F.count("*").alias("samples"))
    pace = pace.select("latency_ms", "samples", metrics.safe_div(F.lit(3_600_000.0), F.col("mean_ms")).alias("docs_per_hour"))
    return scores.crossJoin(pace).select(F.lit(name).alias("system"), F.lit(True).alias("available"), "precision", "recall", "f1", "latency_ms", "docs_per_hour", "samples")  # one row each


def compared(records: DataFrame, systems: dict[str, str | Callable]) -> DataFrame:
    """Scorecards of several systems with their composite score."""
    cards = [scorecard(n, records, external(records, p)) for n, p in systems.items()]
    return reduce(DataFrame.unionByName, cards).withColumn("composite", rating.composite())


def board(cards: DataFrame, rounds: int = 3, by: str = "composite") -> DataFrame:
    """A leaderboard of scorecards with Elo ratings after a few round robins."""
    if by not in ("composite", "rating", "f1", "precision", "recall", "docs_per_hour"):
        raise ValueError(f"a board can't be sorted by {by!r}")
    elo = rating.elo_ratings(cards.filter("available").select("system", "composite"), rounds=rounds)
    return rating.leaderboard(cards.join(elo.drop("grp"), "system"), by)


def resistance_tournament(scores: DataFrame, rounds: int = 1) -> DataFrame:
    """Ratings by re-identification resistance (system, resistance)."""
    return rating.elo_ratings(scores.select("system", F.col("resistance").alias("composite")), rounds=rounds)


def ensemble(findings: DataFrame, strengths: Sequence[tuple[str, str, float]]) -> DataFrame:
    """Fused findings of several systems by their experts' strengths."""
    return fusion.experts_fusion(findings, list(strengths))


def save_checkpoint(cards: DataFrame, path: str, profile: str) -> None:
    """A profile's scorecards; a run that starts again writes the same folder anew."""
    cards.write.mode("overwrite").parquet(f"{path.rstrip('/')}/profile={profile}")


def load_checkpoints(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("basePath", path).parquet(f"{path.rstrip('/')}/profile=*")


def merged_checkpoints(spark: SparkSession, path: str) -> DataFrame:
    """Each system's row of the first profile by name."""
    return compare.merged_profiles(load_checkpoints(spark, path), "profile")


def quick(records: DataFrame, detector: Detector, most: int | None = None) -> DataFrame:
    """(records, tp, predicted, gold, precision, recall, f1) of a detector; ``most`` takes the first records by id."""
    some = records.orderBy("record_id").limit(most) if most else records
    return matching.alignment_scores(predictions(some, detector), datasets.labels_of(some), ["strict"]).drop("mode").crossJoin(some.agg(F.count("*").alias("records")))  # one row each
