"""Which engines see a text: plan selection, escalation and the segmented path, over whole tables.

A plan depends on use case, objective and language only, so a batch has few: they are a small
table joined to the texts.  What depends on a text - its number of tokens - stays a Column.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.operators import fusion, segment

#: Rank of the engines, preferences by objective, thresholds and caps.
RANKED = ("regex-oss", "presidio-compatible", "scrubadub-compatible", "spacy-ner-compatible", "stanza-ner-compatible", "llm-guard-compatible")
ACCURATE = ("presidio-compatible", "regex-oss", "spacy-ner-compatible", "stanza-ner-compatible")
FAST = ("stanza-ner-compatible", "spacy-ner-compatible", "regex-oss")
SEGMENTED_CASES = ("long_document", "multilingual_mix")


@dataclass(frozen=True)
class Capability:
    languages: tuple[str, ...] = ()
    available: bool = True


@dataclass(frozen=True)
class Settings:
    ensemble_threshold: float = 0.70
    accuracy_threshold: float = 0.88
    balanced_threshold: float = 0.80
    ensemble_cap: int = 8
    accuracy_cap: int = 4
    balanced_cap: int = 3
    segment_tokens: int = 2000


@dataclass(frozen=True)
class Plan:
    plan_id: str
    engines: tuple[str, ...]
    fusion: str = "weighted_consensus"
    may_segment: bool = False
    concurrency: int = 1
    threshold: float = 0.0
    escalates: bool = False
    escalation: tuple[str, ...] = field(default=())


def available_engines(capabilities: Mapping[str, Capability], language: str = "en") -> tuple[str, ...]:
    """Ranked engines that are installed (the first needs nothing) and speak the language or English."""
    fits = lambda c: not c.languages or language in c.languages or "en" in c.languages
    found = [e for e in RANKED if e in capabilities and fits(capabilities[e]) and (capabilities[e].available or e == RANKED[0])]
    return tuple(found) or RANKED[:1]


def preferred_engines(available: Sequence[str], objective: str, use_case: str = "", language: str = "en") -> tuple[str, ...]:
    if objective == "accuracy" or (objective == "balanced" and use_case == "structured_form_accuracy"):
        return tuple(e for e in ACCURATE if e in available) or tuple(available)
    if objective == "speed" or (objective == "balanced" and use_case == "structured_form_latency"):
        return tuple(e for e in FAST if e in available)[:1] or tuple(available[:1])
    many = use_case in SEGMENTED_CASES or language in ("es", "fr")
    wanted = ("regex-oss", *(("presidio-compatible",) if many else ()), "spacy-ner-compatible")
    return tuple(e for e in wanted if e in available) or tuple(available)


def select(use_case: str, objective: str, language: str, capabilities: Mapping[str, Capability], settings: Settings = Settings(), mode: str = "weighted_consensus") -> Plan:  # noqa: B008
    """The plan of a batch; ``mode`` is the fusion of the use case "default"."""
    here = available_engines(capabilities, (language or "en").lower())
    if (use_case or "default") == "default":
        return Plan("default_compat", here, mode)
    segmented = use_case in SEGMENTED_CASES
    if objective == "ensemble":
        return Plan("ensemble_all", here, may_segment=segmented, concurrency=min(settings.ensemble_cap, len(here)), threshold=settings.ensemble_threshold)
    if objective not in ("accuracy", "speed"):
        objective = "balanced"
    mine = preferred_engines(here, objective, use_case, language)
    rest = tuple(e for e in here if e not in mine)
    if objective == "speed":
        return Plan("speed_guarded", mine, "union", escalation=rest)
    cap, threshold = (settings.accuracy_cap, settings.accuracy_threshold) if objective == "accuracy" else (settings.balanced_cap, settings.balanced_threshold)
    return Plan(f"{objective}_guarded", mine, may_segment=segmented, concurrency=min(cap, max(1, len(mine))), threshold=threshold, escalates=True, escalation=rest)


def resolve(plan: Plan, enabled: Sequence[str]) -> Plan:
    """The plan with enabled engines only; the default plan runs all of them, and none left means all."""
    names = tuple(sorted(enabled))
    mine = names if plan.plan_id == "default_compat" else tuple(e for e in plan.engines if e in enabled)
    mine = mine or names or RANKED[:1]
    return replace(plan, engines=mine, escalation=tuple(e for e in plan.escalation if e in enabled and e not in mine))


def plan_table(spark: SparkSession, capabilities: Mapping[str, Capability], use_cases: Sequence[str], objectives: Sequence[str], languages: Sequence[str], settings: Settings = Settings()) -> DataFrame:  # noqa: B008
    """A row for each combination: a table as small as its arguments."""
    rows = [(u, o, g, p.plan_id, list(p.engines), p.fusion, p.may_segment, p.concurrency, p.threshold, p.escalates, list(p.escalation)) for u, o, g in product(use_cases, objectives, languages) for p in [select(u, o, g, capabilities, settings)]]
    kinds = "use_case string, objective string, language string, plan_id string, engines array<string>, fusion string, may_segment boolean, concurrency int, threshold double, escalates boolean, escalation array<string>"
    return spark.createDataFrame(rows, kinds)


def route(texts: DataFrame, plans: DataFrame, settings: Settings = Settings()) -> DataFrame:  # noqa: B008
    """Rows (use_case, objective, language, text, …) with their plan and whether they are cut into segments."""
    out = texts.join(plans, ["use_case", "objective", "language"], "left")
    return out.withColumn("segmented", F.coalesce(F.col("may_segment"), F.lit(False)) & (words(F.col("text")) > settings.segment_tokens))


def words(text: Column) -> Column:
    return F.coalesce(F.size(F.filter(F.split(text, "\\s+"), lambda w: w != "")), F.lit(0))


Detector = Callable[[DataFrame], DataFrame]


class Engines:
    """Detectors by name: functions from texts to findings, shipped to executors by closure."""

    def __init__(self):
        self._all: dict[str, tuple[Detector, Capability, bool]] = {}

    def register(self, name: str, detector: Detector, capability: Capability = Capability(), enabled: bool = True) -> None:  # noqa: B008
        self._all[name] = (detector, capability, enabled)

    def unregister(self, name: str) -> None:
        del self._all[name]

    def get(self, name: str) -> Detector:
        return self._all[name][0]

    def names(self, disabled: bool = False) -> tuple[str, ...]:
        return tuple(n for n, (_, _, on) in sorted(self._all.items()) if on or disabled)

    def capabilities(self) -> dict[str, Capability]:
        return {n: c for n, (_, c, _) in sorted(self._all.items())}

    def health(self) -> dict[str, str]:
        """native, fallback (its package is missing) or disabled."""
        return {n: "disabled" if not on else "native" if c.available else "fallback" for n, (_, c, on) in sorted(self._all.items())}

    def discover(self, group: str = "veilspark.engines") -> list[str]:
        """Register installed packages' entry points: each gives (detector, capability).  One that fails to load is left out and logged."""
        import logging
        from importlib.metadata import entry_points

        found = []
        for point in entry_points(group=group):
            try:
                self.register(point.name, *point.load()())
                found.append(point.name)
            except Exception as e:
                logging.getLogger(__name__).warning("engine %s can't be loaded: %s", point.name, e)
        return found

    def run(self, names: Sequence[str], texts: DataFrame) -> DataFrame:
        """All findings of the named engines: each is one plan over the texts, and their union one job."""
        made = [self.get(n)(texts) for n in names if n in self._all] or [self.get(n)(texts) for n in self.names()]
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), made)


def needy(raw_merged: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Ids of texts without a finding or with a mean confidence below the threshold.

    The last bits of a mean depend on the order of its terms and are left out, so a text whose mean is the threshold isn't below it in any order.
    """
    score = raw_merged.groupBy("doc_id").agg(F.round(F.avg("confidence"), 12).alias("score"))
    return texts.select("doc_id").distinct().join(score, "doc_id", "left").filter(F.col("score").isNull() | (F.col("score") < threshold)).select("doc_id")


def escalate(texts: DataFrame, raw: DataFrame, plan: Plan, extra: Detector, fuse: Detector | None = None) -> DataFrame:
    """Fused findings, where texts of low confidence also had the escalation engines.

    ``raw``: findings of the plan's engines; ``extra``: detector of the others, run over those
    texts only.  All findings of such a text are fused anew.
    """
    fuse = fuse or (lambda f: fusion.fuse(f, plan.fusion))
    merged = fuse(raw)
    if not plan.escalates or not plan.escalation:
        return merged
    low = needy(merged, texts, plan.threshold)
    more = extra(texts.join(low, "doc_id", "left_semi"))
    again = more.select("doc_id").distinct()
    return merged.join(again, "doc_id", "left_anti").unionByName(fuse(raw.join(again, "doc_id", "left_semi").unionByName(more, allowMissingColumns=True)))


def segmented(texts: DataFrame, detector: Detector, max_tokens: int = 512, overlap: int = 32) -> DataFrame:
    """Findings of texts that are detected window by window, with whole-text offsets, one for each span.

    A window's id is (doc_id, segment) as one string, so a detector sees windows as texts.
    """
    cut = segment.segments(texts.select("doc_id", "text"), max_tokens, overlap)
    other = texts.select("doc_id", "field_path", "language")
    windows = cut.join(other, "doc_id").select(F.to_json(F.struct("doc_id", "segment")).alias("doc_id"), "field_path", "language", "text")
    kind = texts.schema["doc_id"].dataType.simpleString()
    found = detector(windows).withColumn("_at", F.from_json("doc_id", f"doc_id {kind}, segment int")).drop("doc_id").select("*", "_at.doc_id", "_at.segment").drop("_at")
    return segment.reconciled(segment.shifted(found, cut))


def detect_by_plan(texts: DataFrame, plan: Plan, engines: Engines, settings: Settings = Settings(), max_tokens: int = 512, overlap: int = 32) -> DataFrame:  # noqa: B008
    """Fused findings of (doc_id, field_path, language, text) by a plan.

    One fast engine without escalation isn't fused at all.  Texts that the plan cuts into windows and
    the others are two branches of one plan.
    """
    plan = resolve(plan, engines.names())
    if len(plan.engines) == 1 and not plan.escalates and plan.plan_id == "speed_guarded":
        return fusion.union(engines.run(plan.engines, texts))
    run = lambda names: lambda t: engines.run(names, t)
    whole = texts
    if plan.may_segment:
        long = words(F.col("text")) > settings.segment_tokens
        whole, cut = texts.filter(~F.coalesce(long, F.lit(False))), texts.filter(long)
    done = escalate(whole, engines.run(plan.engines, whole), plan, run(plan.escalation))
    if plan.may_segment:
        windows = segmented(cut, run(plan.engines), max_tokens, overlap)
        language = cut.select("doc_id", "field_path", "language")
        done = done.unionByName(windows.join(language, ["doc_id", "field_path"]).select(*fusion.FUSED))
    return done


class Strategies:
    """Transform strategies by name; a name is taken once."""

    def __init__(self, made: Mapping[str, Callable] | None = None):
        self._all = dict(made or {})

    def register(self, name: str, strategy: Callable) -> None:
        if name in self._all:
            raise ValueError(f"strategy {name!r} is registered already")
        self._all[name] = strategy

    def unregister(self, name: str) -> None:
        del self._all[name]

    def get(self, name: str) -> Callable:
        return self._all[name]

    def names(self) -> tuple[str, ...]:
        return tuple(sorted(self._all))
