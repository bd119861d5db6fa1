"""End-to-end plans: detect, fuse, resolve, link, transform; and a fluent builder for them."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.functions.patterns import SUPPORTED
from veilspark.operators import detect as detection
from veilspark.operators import fusion, rewrite, transform, vault
from veilspark.sources import files


@dataclass(frozen=True)
class Profile:
    """What a job does; ``rules`` (type -> strategy) come before ``mode``."""

    types: tuple[str, ...] = SUPPORTED
    mode: str = "redact"
    rules: dict[str, str] = field(default_factory=dict)
    fusion: str | None = None
    key: str = "default"
    min_confidence: float = 0.5
    allow: dict[str, str] | None = None


def deidentify(texts: DataFrame, profile: Profile = Profile(), engines: Sequence[Callable[[DataFrame], DataFrame]] = ()) -> tuple[DataFrame, DataFrame]:  # noqa: B008
    """(doc_id, field_path, text, n_findings) and the findings of (doc_id, field_path, language, text).

    ``engines``: more detectors, functions from texts to findings; with them or a fusion mode the findings are fused.
    """
    found = detection.detect(texts, profile.types, profile.allow, min_confidence=profile.min_confidence)
    for engine in engines:
        found = found.unionByName(engine(texts))
    if engines or profile.fusion:
        fused = fusion.fuse(found, profile.fusion or "weighted_consensus")
        fields = texts.select("doc_id", "field_path", F.col("text").alias("_text"))
        cut = F.col("_text").substr(F.col("span_start") + 1, F.col("span_end") - F.col("span_start"))
        found = fused.join(fields, ["doc_id", "field_path"]).withColumn("matched", cut).drop("_text")
    replacement = transform.apply_policy(profile.rules, profile.key, language=F.coalesce(F.col("language"), F.lit("en")), otherwise=profile.mode)
    return rewrite.transform_texts(texts.select("doc_id", "field_path", "language", "text"), found, replacement), found


class Builder:
    """Reads, de-identifies and writes; each call gives a new builder."""

    def __init__(self, spark: SparkSession, **state):
        self.spark, self.state = spark, state

    def _with(self, **more) -> Builder:
        return Builder(self.spark, **{**self.state, **more})

    def source(self, path: str, fmt: str | None = None, text_column: str = "text", **options) -> Builder:
        return self._with(records=files.read(self.spark, path, fmt, text_column, **options))

    def records(self, df: DataFrame, text_column: str = "text", id_column: str = "record_id") -> Builder:
        return self._with(records=df.withColumnsRenamed({text_column: "text", id_column: "record_id"}))

    def language(self, lang: str | Column) -> Builder:
        return self._with(lang=lang if isinstance(lang, Column) else F.lit(lang))

    def mode(self, mode: str) -> Builder:
        return self._with(mode=mode)

    def policy(self, name: str) -> Builder:
        return self._with(rules={**self.state.get("rules", {}), **transform.policy(name)})

    def rule(self, entity_type: str, strategy: str) -> Builder:
        return self._with(rules={**self.state.get("rules", {}), entity_type: strategy})

    def types(self, *types: str) -> Builder:
        return self._with(types=types)

    def fuse(self, mode: str) -> Builder:
        return self._with(fusion=mode)

    def engine(self, detector: Callable[[DataFrame], DataFrame]) -> Builder:
        return self._with(engines=(*self.state.get("engines", ()), detector))

    def key(self, key: str) -> Builder:
        return self._with(key=key)

    def build(self) -> DataFrame:
        """Records with transformed text, number of findings, confidence and risk."""
        s = self.state
        records = s["records"]
        profile = Profile(types=tuple(s.get("types", SUPPORTED)), mode=s.get("mode", "redact"), rules=s.get("rules", {}), fusion=s.get("fusion"), key=s.get("key", "default"))
        texts = records.select(F.col("record_id").alias("doc_id"), F.lit("text").alias("field_path"), s.get("lang", F.lit("en")).alias("language"), "text")
        out, found = deidentify(texts, profile, s.get("engines", ()))
        env = fusion.envelope(found).select(F.col("doc_id").alias("record_id"), F.col("score").alias("confidence_score"), F.col("risk").alias("risk_level"))
        done = out.select(F.col("doc_id").alias("record_id"), F.col("text").alias("transformed_text"), F.col("n_findings").alias("entities_found"))
        joined = records.drop("text").join(done, "record_id").join(env, "record_id", "left")
        return joined.withColumns({"confidence_score": F.coalesce("confidence_score", F.lit(0.0)), "risk_level": F.coalesce("risk_level", F.lit("high"))})

    def vault(self) -> DataFrame:
        """The token vault of the records' findings."""
        s = self.state
        texts = s["records"].select(F.col("record_id").alias("doc_id"), F.lit("text").alias("field_path"), s.get("lang", F.lit("en")).alias("language"), "text")
        return vault.vault(detection.detect(texts, tuple(s.get("types", SUPPORTED))), s.get("key", "default"))

    def write(self, path: str, fmt: str = "parquet", mode: str = "errorifexists") -> None:
        files.write(self.build(), path, fmt, "transformed_text", mode)
