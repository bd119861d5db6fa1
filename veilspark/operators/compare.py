"""Systems against systems: floors, dominance, availability, tournaments, and calibration as it goes on.

Tables of systems are as small as the number of systems; they stay DataFrames so that the
results of a benchmark need no way through the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspark.operators.metrics import safe_div
from veilspark.operators.rating import requirements

#: What an objective compares, and whether less is better.
FLOORS = {"accuracy": (("f1", False), ("recall", False)), "speed": (("latency_ms", True), ("docs_per_hour", False))}


def best_available(systems: DataFrame, metric: str, lower: bool = False, by: Sequence[str] = ()) -> DataFrame:
    """(by…, system, metric) of the best available system; of equal ones the first by name."""
    order = F.struct((-F.col(metric) if not lower else F.col(metric)).alias("v"), F.col("system"))
    best = systems.filter("available").groupBy(*by).agg(F.min(order).alias("b"))
    return best.select(*by, F.col("b.system").alias("system"), (F.col("b.v") if lower else -F.col("b.v")).alias(metric)).filter("system is not null")


def floor_contract(systems: DataFrame, core: str, objective: str = "accuracy") -> DataFrame:
    """(metric, comparator, target, actual, passed) of a core system against the best of the others."""
    mine, others = systems.filter((F.col("system") == core) & F.col("available")), systems.filter(F.col("system") != core)
    out = None
    for metric, lower in FLOORS[objective]:
        best = best_available(others, metric, lower).select(F.col("system").alias("comparator"), F.col(metric).alias("target"), F.lit(metric).alias("metric"))
        actual = mine.select(F.lit(metric).alias("metric"), F.col(metric).alias("actual"))
        row = best.join(actual, "metric", "left")
        held = F.col("actual") <= F.col("target") if lower else F.col("actual") >= F.col("target")
        row = row.select("metric", "comparator", "target", "actual", F.coalesce(held, F.lit(False)).alias("passed"))
        out = row if out is None else out.unionByName(row)
    return out


def availability(reports: DataFrame) -> DataFrame:
    """(system, everywhere, missing) of rows (profile, system, available): the profiles where a system wasn't."""
    lack = F.array_sort(F.collect_list(F.when(~F.col("available"), F.col("profile"))))
    return reports.groupBy("system").agg(F.bool_and("available").alias("everywhere"), F.array_join(lack, ",").alias("missing"))


def merged_profiles(reports: DataFrame, order: str = "place") -> DataFrame:
    """Of each system the row of the first profile that has it."""
    w = Window.partitionBy("system").orderBy(order)
    return reports.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def dominance(scores: DataFrame, ensemble: str, epsilon: float = 1e-6) -> DataFrame:
    """(entity_type, ensemble, best, expert, dominates): an ensemble's F1 against the best expert's, by type."""
    e = scores.filter(F.col("system") == ensemble).select("entity_type", F.col("f1").alias("ensemble"))
    o = scores.filter(F.col("system") != ensemble).groupBy("entity_type").agg(F.max("f1").alias("best"), F.max_by("system", F.struct("f1", "system")).alias("expert"))
    return o.join(e, "entity_type", "left").select("entity_type", F.coalesce("ensemble", F.lit(0.0)).alias("ensemble"), "best", "expert", (F.coalesce("ensemble", F.lit(0.0)) >= F.col("best") - epsilon).alias("dominates"))


def pruned_engines(found: DataFrame, similarity: float = 0.85, most: int = 4, force: Sequence[str] = ()) -> DataFrame:
    """Engines to keep of (engine_id, entity_type): by falling number of types, unless too like one that is kept.

    Engines are few, so a fold over one array of them decides; what findings bring is the
    distinct pairs.
    """
    sets = found.select("engine_id", "entity_type").distinct().groupBy("engine_id").agg(F.array_sort(F.collect_set("entity_type")).alias("kinds"))
    forced = F.col("engine_id").isin(*force) if force else F.lit(False)
    item = F.struct((~forced).alias("late"), (-F.size("kinds")).alias("size"), F.col("engine_id").alias("engine"), F.col("kinds"))
    all_ = sets.agg(F.array_sort(F.collect_list(item)).alias("a"))
    like = lambda x, y: F.size(F.array_intersect(x["kinds"], y["kinds"])) / F.greatest(F.size(F.array_union(x["kinds"], y["kinds"])), F.lit(1)) >= similarity
    none = F.slice("a", 1, 0)
    keep = F.aggregate("a", none, lambda kept, x: F.when(~x["late"] | ((F.size(kept) < most) & ~F.exists(kept, lambda y: like(x, y))), F.concat(kept, F.array(x))).otherwise(kept))
    return all_.select(F.explode(keep).alias("k")).select(F.col("k.engine").alias("engine_id"), F.size("k.kinds").alias("types"))


def pareto_distance(systems: DataFrame, frontier: DataFrame, x: str, y: str) -> DataFrame:
    """(system, distance) to the nearest system of the frontier, which is one array in each row."""
    points = frontier.agg(F.collect_list(F.struct(F.col(x).alias("x"), F.col(y).alias("y"))).alias("_f"))
    away = F.array_min(F.transform("_f", lambda p: F.sqrt((F.col(x) - p["x"]) * (F.col(x) - p["x"]) + (F.col(y) - p["y"]) * (F.col(y) - p["y"]))))
    return systems.crossJoin(points).select("system", away.alias("distance"))  # one row on the right


def converged(ratings: DataFrame, floor: float = 30.0) -> DataFrame:
    """Whether all deviations are at most twice the floor."""
    return ratings.agg(F.coalesce(F.bool_and(F.col("deviation") <= 2 * floor), F.lit(True)).alias("converged"))


def rating_intervals(ratings: DataFrame) -> DataFrame:
    """Ratings with 95 % bounds."""
    return ratings.select("*", (F.col("rating") - 1.96 * F.col("deviation")).alias("low"), (F.col("rating") + 1.96 * F.col("deviation")).alias("high"))


def distinct_pairs(ratings: DataFrame) -> DataFrame:
    """(a, b, z, significant) of each pair of systems once, by their difference over both deviations."""
    x = ratings.select(F.col("system").alias("a"), F.col("rating").alias("ra"), F.col("deviation").alias("da"))
    y = ratings.select(F.col("system").alias("b"), F.col("rating").alias("rb"), F.col("deviation").alias("db"))
    z = F.abs(F.col("ra") - F.col("rb")) / F.sqrt(F.col("da") * F.col("da") + F.col("db") * F.col("db"))
    return x.join(y, F.col("a") < F.col("b")).select("a", "b", z.alias("z"), (z > 1.96).alias("significant"))


def tuned(composites: DataFrame) -> DataFrame:
    """(n, spread, gamma, k) for a tournament: a narrower field takes a steeper curve and smaller steps."""
    s = composites.agg(F.count("*").alias("n"), F.coalesce(F.stddev_pop("composite"), F.lit(0.0)).alias("spread"))
    return s.select("n", "spread", F.greatest(F.lit(2.0), F.least(F.lit(50.0), safe_div(F.lit(1.0), F.col("spread")))).alias("gamma"), F.when(F.col("spread") < 0.05, 16.0).when(F.col("spread") > 0.2, 48.0).otherwise(32.0).alias("k"))


def category_gaps(needs: DataFrame, covered: DataFrame) -> DataFrame:
    """(standard, category, required, covered, missing) of needs (standard, category, entity_type)."""
    have = covered.select("entity_type").distinct().withColumn("there", F.lit(True))
    g = needs.join(have, "entity_type", "left").groupBy("standard", "category")
    return g.agg(F.count("*").alias("required"), F.count("there").alias("covered"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("there").isNull(), F.col("entity_type")))), ",").alias("missing"))


def remediation(covered: DataFrame, risks: DataFrame, standard: str) -> DataFrame:
    """(place, entity_type, risk) of a standard's types that aren't covered, the gravest first; risks: (entity_type, risk)."""
    rank = F.array_position(F.array(*map(F.lit, ("critical", "high", "moderate", "low"))), F.col("risk"))
    gaps = requirements(covered.sparkSession).filter(F.col("standard") == standard).select("entity_type").join(covered.select("entity_type").distinct(), "entity_type", "left_anti")
    named = gaps.join(risks, "entity_type", "left").select("entity_type", F.coalesce("risk", F.lit("low")).alias("risk"))
    return named.select(F.row_number().over(Window.orderBy(rank, "entity_type")).alias("place"), "entity_type", "risk")


def strategies_compared(fused: DataFrame, gold: DataFrame, beta: float = 1.0) -> DataFrame:
    """(strategy, tp, predicted, gold, f, best) of fused findings (strategy, entity_type, span_start, span_end) as sets, pooled."""
    keys = ["entity_type", "start", "end"]
    p = fused.select("strategy", "entity_type", F.col("span_start").alias("start"), F.col("span_end").alias("end")).distinct()
    g = gold.select(*keys).distinct()
    total = g.agg(F.count("*").alias("gold"))
    c = p.join(g.withColumn("hit", F.lit(1)), keys, "left").groupBy("strategy").agg(F.count("hit").alias("tp"), F.count("*").alias("predicted")).crossJoin(total)  # one row on the right
    b = beta * beta
    f = safe_div((1 + b) * F.col("tp"), b * F.col("gold") + F.col("predicted"))
    return c.withColumn("f", f).withColumn("best", F.row_number().over(Window.orderBy(F.desc("f"), "strategy")) == 1)


def online_strengths(experts: DataFrame, observed: DataFrame, alpha: float = 0.05, least: int = 5, floor: float = 0.05) -> DataFrame:
    """Experts' strengths after observations (engine_id, entity_type, at, f1): from the ``least``-th on, each moves them a little.

    An (engine, type)'s observations are one array, folded in their order.
    """
    seen = observed.groupBy(F.col("engine_id").alias("expert_id"), "entity_type").agg(F.array_sort(F.collect_list(F.struct("at", "f1"))).alias("o"))
    tail = F.slice("o", least, F.greatest(F.size("o") - (least - 1), F.lit(0)))
    moved = F.aggregate(tail, F.col("strength"), lambda s, x: F.greatest(alpha * x["f1"] + (1 - alpha) * s, F.lit(floor)))
    return experts.join(seen, ["expert_id", "entity_type"], "left").select("expert_id", "entity_type", F.when(F.size("o") >= least, moved).otherwise(F.col("strength")).alias("strength"))


def throughput(n: Column, seconds: Column) -> Column:
    """Documents an hour."""
    return safe_div(n * 3600.0, seconds)
