"""Fusion of several engines' findings.

Findings: (doc_id, field_path, entity_type, language, span_start, span_end, confidence,
engine_id, ordinal).  Modes: union, intersection, weighted consensus, calibrated majority,
mixture of experts, swarm.  Clustering depends on order, so it is a fold over a document's
findings of one type, field and language, as one array (bounded by its text), in the JVM.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GROUP = ["doc_id", "field_path", "entity_type", "language"]
FUSED = [*GROUP, "span_start", "span_end", "confidence", "engines"]
ITEM = "struct<s:int,e:int,o:int,c:double,engine:string>"


def hull_iou(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Overlap over the hull of two spans."""
    hull = F.greatest(e1, e2) - F.least(s1, s2)
    return F.when(hull > 0, F.greatest(F.lit(0), F.least(e1, e2) - F.greatest(s1, s2)) / hull).otherwise(0.0)


def union(findings: DataFrame) -> DataFrame:
    return findings.select(*GROUP, "span_start", "span_end", "confidence", F.array("engine_id").alias("engines"))


def intersection(findings: DataFrame, engines: int = 2) -> DataFrame:
    """Spans that at least ``engines`` (two or more) engines give exactly; the lowest confidence."""
    keys = [*GROUP, "span_start", "span_end"]
    out = findings.groupBy(*keys).agg(F.min("confidence").alias("confidence"), F.array_sort(F.collect_set("engine_id")).alias("engines"))
    return out.filter(F.size("engines") >= max(2, engines)).select(*FUSED)


def clusters(findings: DataFrame, iou: float = 0.5, gap: int = 5) -> DataFrame:
    """(…GROUP, cluster: array of items in order).

    By start and end, the first free span anchors a cluster; a later one joins if its overlap
    with the anchor's bounds, which grow, reaches ``iou``; the search ends at a span that starts
    ``gap`` or more after the bounds' end.
    """
    item = F.struct(F.col("span_start").alias("s"), F.col("span_end").alias("e"), F.col("ordinal").cast("int").alias("o"), F.col("confidence").alias("c"), F.col("engine_id").alias("engine"))
    grouped = findings.groupBy(*GROUP).agg(F.array_sort(F.collect_list(item)).alias("items"))
    none = F.array().cast(f"array<{ITEM}>")

    def visit(a: Column, x: Column) -> Column:
        past = a["past"] | (x["s"] >= a["e"] + gap)
        joins = ~past & (hull_iou(a["s"], a["e"], x["s"], x["e"]) >= iou)
        return F.struct(
            F.when(joins, F.least(a["s"], x["s"])).otherwise(a["s"]).alias("s"), F.when(joins, F.greatest(a["e"], x["e"])).otherwise(a["e"]).alias("e"), past.alias("past"),
            F.when(joins, F.concat(a["mine"], F.array(x))).otherwise(a["mine"]).alias("mine"), F.when(joins, a["rest"]).otherwise(F.concat(a["rest"], F.array(x))).alias("rest"),
        )

    def anchor(state: Column, _: Column) -> Column:
        head = F.get(state["rest"], F.lit(0))
        start = F.struct(head["s"].alias("s"), head["e"].alias("e"), F.lit(False).alias("past"), F.array(head).alias("mine"), none.alias("rest"))
        done = F.aggregate(F.slice(state["rest"], 2, F.greatest(F.size(state["rest"]), F.lit(1))), start, visit)
        return F.when(F.size(state["rest"]) == 0, state).otherwise(F.struct(F.concat(state["out"], F.array(done["mine"])).alias("out"), done["rest"].alias("rest")))

    first = F.struct(F.array().cast(f"array<array<{ITEM}>>").alias("out"), F.col("items").alias("rest"))
    found = F.aggregate(F.col("items"), first, anchor, lambda s: s["out"])
    return grouped.select(*GROUP, F.explode(found).alias("cluster"))


def voted(values: Column, weights: Column) -> Column:
    """The value with most weight; ties: the first seen."""
    distinct = F.array_distinct(values)
    pairs = F.arrays_zip(values.alias("v"), weights.alias("w"))
    sums = F.transform(distinct, lambda v, i: F.struct(F.aggregate(F.filter(pairs, lambda p: p["v"] == v), F.lit(0.0), lambda a, p: a + p["w"]).alias("w"), (-i).alias("i"), v.alias("v")))
    return F.array_max(sums)["v"]


def weighted(findings: DataFrame, weight: Callable[[Column, Column], Column] | None = None, iou: float = 0.5) -> DataFrame:
    """One finding a cluster: weighted mean confidence, boundaries by weighted vote.

    ``weight``: a function of (engine, entity type); all engines weigh 1 without it.
    """
    w = weight or (lambda engine, kind: F.lit(1.0))
    c = clusters(findings, iou).withColumn("weights", F.transform("cluster", lambda x: w(x["engine"], F.col("entity_type")).cast("double")))
    total = F.aggregate("weights", F.lit(0.0), lambda a, x: a + x)
    mass = F.aggregate(F.zip_with("cluster", "weights", lambda x, v: x["c"] * v), F.lit(0.0), lambda a, x: a + x)
    return c.select(
        *GROUP, voted(F.col("cluster.s"), F.col("weights")).alias("span_start"), voted(F.col("cluster.e"), F.col("weights")).alias("span_end"),
        F.when(total > 0, mass / total).otherwise(0.0).alias("confidence"), F.array_sort(F.array_distinct(F.col("cluster.engine"))).alias("engines"),
    )


def majority(findings: DataFrame, engines: int = 2, iou: float = 0.5) -> DataFrame:
    return weighted(findings, None, iou).filter(F.size("engines") >= engines)


def routes(experts: DataFrame, top_k: int = 3) -> DataFrame:
    """(entity_type, expert_id, weight): softmax of the strengths of each type's best experts."""
    best = experts.withColumn("place", F.row_number().over(Window.partitionBy("entity_type").orderBy(F.desc("strength"), "expert_id"))).filter(F.col("place") <= top_k)
    e = F.exp("strength")
    return best.select("entity_type", "expert_id", (e / F.sum(e).over(Window.partitionBy("entity_type"))).alias("weight"))


def experts_fusion(findings: DataFrame, experts: Sequence[tuple[str, str, float]], top_k: int = 3, floor: float = 0.15, iou: float = 0.5) -> DataFrame:
    """Weighted consensus with routed weights; an engine that isn't routed for a type weighs ``floor``.

    ``experts``: (expert, type, strength), a small table of the registry, compiled into the plan.
    """
    import math

    table: dict[str, float] = {}
    for kind in sorted({t for _, t, _ in experts}):
        best = sorted(((e, s) for e, t, s in experts if t == kind), key=lambda x: (-x[1], x[0]))[:top_k]
        total = sum(math.exp(s) for _, s in best)
        table |= {f"{kind}|{e}": math.exp(s) / total for e, s in best}
    known = F.create_map(*[F.lit(x) for p in table.items() for x in p]) if table else F.create_map().cast("map<string,double>")
    return weighted(findings, lambda engine, kind: F.coalesce(F.try_element_at(known, F.concat_ws("|", kind, engine)), F.lit(floor)), iou)


def swarm(findings: DataFrame, fast_engine: str = "regex", fast: float = 0.90, iou: float = 0.3, emit: float = 0.50, semantic: Sequence[str] = (), structured: Sequence[str] = ()) -> DataFrame:
    """Four layers: sure findings of the fast engine pass; the rest is clustered, scored and must be corroborated.

    The score is logistic in mean confidence, number of engines, whether the fast engine is among them and
    whether the type is a structured one.  ``semantic`` types need two engines or 0.85.
    """
    sure = findings.filter((F.col("engine_id") == fast_engine) & (F.col("confidence") >= fast))
    passed = union(sure)
    c = weighted(findings, None, iou)
    n = F.size("engines")
    x = 2 * F.col("confidence") + 0.5 * F.least(n, F.lit(4)) + 0.8 * F.array_contains("engines", fast_engine).cast("int") + 0.3 * F.col("entity_type").isin(*structured).cast("int") - 2
    scored = c.withColumn("confidence", 1 / (1 + F.exp(-x))).filter(F.col("confidence") >= emit)
    if semantic:
        scored = scored.filter(~F.col("entity_type").isin(*semantic) | (F.size("engines") >= 2) | (F.col("confidence") >= 0.85))
    p = passed.select("doc_id", "field_path", F.col("span_start").alias("ps"), F.col("span_end").alias("pe"))
    near = (scored["doc_id"] == p["doc_id"]) & scored["field_path"].eqNullSafe(p["field_path"]) & (hull_iou(scored["span_start"], scored["span_end"], p["ps"], p["pe"]) > 0.3)
    return passed.select(*FUSED).unionByName(scored.join(p, near, "left_anti").select(*FUSED))


MODES = ("union", "intersection", "weighted_consensus", "calibrated_majority", "mixture_of_experts", "swarm")
_own: dict[str, Callable[[DataFrame], DataFrame]] = {}


def register(mode: str, merge: Callable[[DataFrame], DataFrame]) -> None:
    """A fusion of the user's own: findings to fused findings."""
    _own[mode] = merge


def fuse(findings: DataFrame, mode: str = "weighted_consensus", engines: int = 2, **options) -> DataFrame:
    made = {
        "union": union, "intersection": lambda f: intersection(f, engines), "weighted_consensus": lambda f: weighted(f, **options), "calibrated_majority": lambda f: majority(f, engines),
        "mixture_of_experts": lambda f: experts_fusion(f, **options), "swarm": lambda f: swarm(f, **options), **_own,
    }
    if mode not in made:
        raise ValueError(f"no fusion mode {mode!r}; there are {', '.join(sorted(made))}")
    return made[mode](findings)


def audit(fused: DataFrame, findings: DataFrame) -> DataFrame:
    """Each fused finding with the raw ones at exactly its span: their engines and number."""
    keys = ["doc_id", "field_path", "entity_type", "span_start", "span_end"]
    raw = findings.groupBy(*keys).agg(F.array_sort(F.collect_set("engine_id")).alias("sources"), F.count("*").alias("n_sources"))
    return fused.join(raw, keys, "left").withColumn("n_sources", F.coalesce("n_sources", F.lit(0)))


def envelope(findings: DataFrame) -> DataFrame:
    """Mean confidence, risk and number of findings of each document that has some."""
    score = F.avg("confidence")
    return findings.groupBy("doc_id").agg(F.count("*").alias("n_findings"), score.alias("score")).withColumn("risk", risk("score"))


def risk(score: str | Column) -> Column:
    s = F.col(score) if isinstance(score, str) else score
    return F.when(s >= 0.90, "low").when(s >= 0.75, "moderate").otherwise("high")
