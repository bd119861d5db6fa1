"""Span, privacy, utility, fairness and calibration metrics as aggregations.

Spans: (record_id, entity_type, start, end); matching is scoped to the record unless ``pooled``.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPAN = ["record_id", "entity_type", "start", "end"]


def safe_div(a: Column, b: Column) -> Column:
    """a / b; 0 where b isn't positive."""
    return F.when(b > 0, a / b).otherwise(0.0)


def f_beta(p: Column, r: Column, beta: float = 1.0) -> Column:
    b = beta * beta
    return F.when(b * p + r > 0, (1 + b) * p * r / (b * p + r)).otherwise(0.0)


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def iou(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Overlap over the union of the lengths."""
    both = F.greatest(F.lit(0), F.least(e1, e2) - F.greatest(s1, s2))
    return safe_div(both.cast("double"), (e1 - s1) + (e2 - s2) - both)


def prf(tp: Column, predicted: Column, gold: Column, beta: float = 1.0) -> list[Column]:
    p, r = safe_div(tp.cast("double"), predicted), safe_div(tp.cast("double"), gold)
    return [p.alias("precision"), r.alias("recall"), f_beta(p, r, beta).alias("f1")]


def matched_counts(predicted: DataFrame, gold: DataFrame, keys: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by…, tp, predicted, gold) of an equality match with repeats: the smaller number on each key counts."""
    keys, by = list(keys), list(by)
    g = lambda df, n: df.groupBy(*keys).agg(F.count("*").alias(n))
    both = g(predicted, "p").join(g(gold, "g"), keys, "full").fillna(0, ["p", "g"])
    return both.groupBy(*by).agg(F.sum(F.least("p", "g")).alias("tp"), F.sum("p").alias("predicted"), F.sum("g").alias("gold"))


def span_scores(predicted: DataFrame, gold: DataFrame, mode: str = "strict", by: Sequence[str] = (), pooled: bool = False) -> DataFrame:
    """Precision, recall and F1; strict: type and boundaries, exact: boundaries."""
    keys = [*([] if pooled else ["record_id"]), *(["entity_type"] if mode == "strict" else []), "start", "end"]
    c = matched_counts(predicted, gold, [*dict.fromkeys([*keys, *by])], by)
    return c.select(*by, "tp", "predicted", "gold", *prf(F.col("tp"), F.col("predicted"), F.col("gold")))


def numbered(spans: DataFrame) -> DataFrame:
    """Each different span once, with how often it is there (n)."""
    return spans.groupBy(*SPAN).agg(F.count("*").alias("n"))


def meeting(predicted: DataFrame, gold: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys…, apart, p, g): the numbered spans (start, end, entity_type, n) of both sides, in order, for each stretch of a record that spans cover without a gap.

    Spans that overlap or are equal are in one stretch, so stretches are dealt with one by one.  Repeats are
    numbers: an array grows with the stretch, not with the input.  ``apart`` keeps the sides of a missing key apart.
    """
    both = predicted.select(*SPAN, "n", F.lit(True).alias("_p")).unionByName(gold.select(*SPAN, "n", F.lit(False).alias("_p")))
    w = Window.partitionBy(*keys).orderBy("start")
    both = both.withColumn("_reach", F.max("end").over(w.rangeBetween(Window.unboundedPreceding, -1)))
    first = F.when(F.col("_reach").isNull() | (F.col("start") >= F.col("_reach")), F.col("start"))
    both = both.withColumn("_at", F.max(first).over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow)))
    missing = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    span = F.struct("start", "end", "entity_type", "n")
    side = lambda mine, n: F.array_sort(F.collect_list(F.when(mine, span))).alias(n)
    return both.groupBy(*keys, F.when(missing, F.col("_p")).alias("apart"), "_at").agg(side(F.col("_p"), "p"), side(~F.col("_p"), "g")).drop("_at")


def overlap_matches(predicted: DataFrame, gold: DataFrame, threshold: float = 0.5, same_type: bool = True) -> DataFrame:
    """(record_id, entity_type, tp) of greedy one-to-one matches by falling overlap."""
    return _overlap_matches(numbered(predicted), numbered(gold), threshold, same_type)


def _overlap_matches(predicted: DataFrame, gold: DataFrame, threshold: float, same_type: bool) -> DataFrame:
    """Of numbered spans.  Pairs of equal spans stand side by side in the order, so a pair of different spans takes as many as both have left."""
    keys = ["record_id", "entity_type"] if same_type else ["record_id"]
    over = lambda x, y: (x["start"] < y["end"]) & (y["start"] < x["end"])
    share = lambda x, y: iou(x["start"], x["end"], y["start"], y["end"])
    pair = lambda x, i: F.transform("g", lambda y, j: F.when(over(x, y) & (share(x, y) >= threshold), F.struct((-share(x, y)).alias("d"), i.alias("i"), j.alias("j"))))
    pairs = F.array_sort(F.flatten(F.transform("p", lambda x, i: F.array_compact(pair(x, i)))))
    start = F.struct(F.transform("p", lambda x: x["n"]).alias("p"), F.transform("g", lambda y: y["n"]).alias("g"), F.lit(0).cast("bigint").alias("n"))
    least = lambda a, x: F.least(F.get(a["p"], x["i"]), F.get(a["g"], x["j"]))
    less = lambda left, at, n: F.transform(left, lambda v, k: F.when(k == at, v - n).otherwise(v))
    step = lambda a, x: F.when(least(a, x) == 0, a).otherwise(
        F.struct(less(a["p"], x["i"], least(a, x)).alias("p"), less(a["g"], x["j"], least(a, x)).alias("g"), (a["n"] + least(a, x)).alias("n"))
    )
    made = meeting(predicted, gold, keys).filter((F.size("p") > 0) & (F.size("g") > 0)).withColumn("tp", F.aggregate(pairs, start, step, lambda a: a["n"]))
    return made.filter("tp > 0").groupBy(*keys).agg(F.sum("tp").alias("tp"))


def overlap_scores(predicted: DataFrame, gold: DataFrame, threshold: float = 0.5, drop_unknown_types: bool = True) -> DataFrame:
    """The benchmark's rule: same type, overlap of a half or more; predictions of types that gold lacks don't count."""
    predicted, gold = numbered(predicted), numbered(gold)
    if drop_unknown_types:
        predicted = predicted.join(gold.select("entity_type").distinct(), "entity_type", "left_semi")
    tp = _overlap_matches(predicted, gold, threshold, True).groupBy("entity_type").agg(F.sum("tp").alias("tp"))
    count = lambda df, n: df.groupBy("entity_type").agg(F.sum("n").alias(n))
    c = count(predicted, "predicted").join(count(gold, "gold"), "entity_type", "full").join(tp, "entity_type", "left").fillna(0, ["tp", "predicted", "gold"])
    return c.select("entity_type", "tp", "predicted", "gold", *prf(F.col("tp"), F.col("predicted"), F.col("gold")))


def covered(spans: Column) -> Column:
    """Disjoint ascending intervals (start, end) of the same characters as an array of spans."""
    none = F.slice(spans, 1, 0)
    last = lambda a: F.try_element_at(a, F.lit(-1))
    step = lambda a, x: (
        F.when((F.size(a) == 0) | (x["start"] > last(a)["end"]), F.concat(a, F.array(x)))
        .otherwise(F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.struct(last(a)["start"].alias("start"), F.greatest(last(a)["end"], x["end"]).alias("end")))))
    )
    return F.aggregate(F.array_sort(spans), none, step)


def char_scores(predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """Sets of (record, type, character), as intervals: a record's spans of a type are one array, bounded by its text."""
    span, kind = F.struct(F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end")), "array<struct<start:int,end:int>>"
    of = lambda df, n: df.groupBy("record_id", "entity_type").agg(covered(F.collect_list(span)).alias(n))
    both = of(predicted, "p").join(of(gold, "g"), ["record_id", "entity_type"], "full")
    both = both.select(*[F.coalesce(F.col(n), F.array().cast(kind)).alias(n) for n in ("p", "g")])
    total = lambda x: F.aggregate(x, F.lit(0).cast("bigint"), lambda a, s: a + s["end"] - s["start"])
    shared = F.aggregate("p", F.lit(0).cast("bigint"), lambda a, x: a + F.aggregate("g", F.lit(0).cast("bigint"), lambda b, y: b + F.greatest(F.lit(0), F.least(x["end"], y["end"]) - F.greatest(x["start"], y["start"]))))
    c = both.agg(F.coalesce(F.sum(shared), F.lit(0)).alias("tp"), F.coalesce(F.sum(total("p")), F.lit(0)).alias("predicted"), F.coalesce(F.sum(total("g")), F.lit(0)).alias("gold"))
    return c.select("tp", "predicted", "gold", *prf(F.col("tp"), F.col("predicted"), F.col("gold")))


def averages(per_type: DataFrame) -> DataFrame:
    """Micro, macro and weighted averages of rows (tp, predicted, gold, precision, recall, f1)."""
    micro = per_type.agg(F.sum("tp").alias("tp"), F.sum("predicted").alias("n"), F.sum("gold").alias("g")).select(F.lit("micro").alias("average"), *prf(F.col("tp"), F.col("n"), F.col("g")))
    macro = per_type.agg(*[F.avg(c).alias(c) for c in ("precision", "recall", "f1")]).select(F.lit("macro").alias("average"), "precision", "recall", "f1")
    weight = lambda c: safe_div(F.sum(F.col(c) * F.col("gold")), F.sum("gold")).alias(c)
    weighted = per_type.agg(*[weight(c) for c in ("precision", "recall", "f1")]).select(F.lit("weighted").alias("average"), "precision", "recall", "f1")
    return micro.unionByName(macro).unionByName(weighted)


def error_taxonomy(predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """Of every gold span: hit, boundary miss, type confusion or complete miss, by its best overlap in the record."""
    spans = meeting(numbered(predicted), numbered(gold), ["record_id"]).select("p", F.explode("g").alias("g"))
    g = F.col("g")
    over = F.filter("p", lambda x: (x["start"] < g["end"]) & (g["start"] < x["end"]))
    best = F.array_max(F.transform(over, lambda x: F.struct(iou(g["start"], g["end"], x["start"], x["end"]).alias("iou"), (x["entity_type"] == g["entity_type"]).alias("same"), x["start"], x["end"])))
    spans = spans.select(g["entity_type"].alias("entity_type"), g["n"].alias("n"), best.alias("b"))
    b = F.col("b")
    kind = F.when(b.isNull(), "complete_miss").when(~b["same"], "type_confusion").when(b["iou"] < 1, "boundary_miss").otherwise("hit")
    return spans.groupBy("entity_type", kind.alias("outcome")).agg(F.sum("n").alias("n"))


# groups and fairness ----------------------------------------------------------------------


def breakdown(counts: DataFrame, dimensions: Sequence[str]) -> DataFrame:
    """Scores of records (dimensions…, tp, predicted, gold) by each dimension and over all."""
    sets = ", ".join([f"({d})" for d in dimensions] + ["()"])
    counts.createOrReplaceTempView("_veilspark_counts")
    spark = counts.sparkSession
    name = " ".join(f"when grouping({d}) = 0 then '{d}'" for d in dimensions)
    value = ", ".join(f"case when grouping({d}) = 0 then cast({d} as string) end" for d in dimensions)
    rows = spark.sql(f"select case {name} else 'overall' end as dimension, coalesce({value}, 'all') as value, sum(tp) as tp, sum(predicted) as predicted, sum(gold) as gold from _veilspark_counts group by grouping sets ({sets})")
    return rows.select("dimension", "value", "tp", "predicted", "gold", *prf(F.col("tp"), F.col("predicted"), F.col("gold")))


def fairness(groups: DataFrame, value: str = "f1", floor: float = 0.7) -> DataFrame:
    """Largest gap, deciles, spread and violations of a floor over groups' scores."""
    v = F.col(value)
    return groups.agg(
        (F.max(v) - F.min(v)).alias("max_gap"), F.percentile(v, F.lit(0.1)).alias("p10"), F.percentile(v, F.lit(0.9)).alias("p90"), F.stddev_pop(v).alias("spread"), F.count_if(v < floor).alias("below_floor")
    )


# privacy ----------------------------------------------------------------------------------


def k_anonymity(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.coalesce(F.min("n"), F.lit(0)).alias("k"))


def _shares(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    n = df.groupBy(*keys, value).agg(F.count("*").alias("n"))
    total = n.groupBy(*keys).agg(F.sum("n").alias("total"))
    return n.join(total, list(keys)).withColumn("p", F.col("n") / F.col("total"))


def l_diversity(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Smallest entropy, in bits, of a group's values."""
    h = _shares(df, keys, value).groupBy(*keys).agg((-F.sum(F.col("p") * F.log2("p"))).alias("h"))
    return h.agg(F.min("h").alias("l"))


def t_closeness(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Largest total variation between a group's values and those of all.

    Only pairs that occur are joined: values that a group lacks add up to one less what it covers.
    """
    every = df.groupBy(value).agg(F.count("*").alias("n"))
    n = df.count()
    every = every.select(value, (F.col("n") / max(n, 1)).alias("q"))
    met = _shares(df, keys, value).join(every, value)
    d = met.groupBy(*keys).agg(((F.sum(F.abs(F.col("p") - F.col("q"))) + 1 - F.sum("q")) / 2).alias("d"))
    return d.agg(F.max("d").alias("t"))


def reidentification_risk(pairs: DataFrame) -> DataFrame:
    """Share of (output, surface) rows whose surface still stands in the output, case aside."""
    hit = F.lower("output").contains(F.lower("surface"))
    return pairs.agg(F.count("*").alias("n"), F.count_if(hit).alias("exposed"), safe_div(F.count_if(hit).cast("double"), F.count("*")).alias("risk"))


def ngrams(x: Column, n: int) -> Column:
    """Distinct character n-grams."""
    made = F.transform(F.sequence(F.lit(1), F.length(x) - n + 1), lambda i: x.substr(i, F.lit(n)))
    return F.when(F.length(x) >= n, F.array_distinct(made)).otherwise(F.array().cast("array<string>"))


def fragment_leaked(output: Column, surface: Column, n: int = 4) -> Column:
    """Whether any n characters in a row of the surface stand in the output."""
    return F.exists(ngrams(surface, n), lambda g: output.contains(g))


def membership_overlap(output: Column, surface: Column, n: int = 4) -> Column:
    g = ngrams(surface, n)
    return safe_div(F.size(F.filter(g, lambda x: output.contains(x))).cast("double"), F.size(g))


def canary_exposure(output: Column, canary: Column) -> Column:
    """1 if the canary stands in the output, else the share of its length that its letters fill there, at most 1 (0 below a half)."""
    inside = F.size(F.filter(F.split(output, ""), lambda c: (c != "") & canary.contains(c)))
    part = F.least(F.lit(1.0), safe_div(inside.cast("double"), F.length(canary)))
    return F.when(output.contains(canary), 1.0).when(part >= 0.5, part).otherwise(0.0)


def jaccard(a: Column, b: Column, empty: float = 1.0) -> Column:
    u = F.size(F.array_union(a, b))
    return F.when(u == 0, empty).otherwise(F.size(F.array_intersect(a, b)) / u)


def ngram_linkage(left: DataFrame, right: DataFrame, n: int = 5, threshold: float = 0.3) -> DataFrame:
    """(l, r, jaccard) of rows (id, text) of both sides whose n-gram sets are that alike.

    An equality join on n-grams and counts: exact, and pairs without a common n-gram are never made.
    """
    grams = lambda df, i: df.select(F.col("id").alias(i), F.size(ngrams(F.col("text"), n)).alias(f"n_{i}"), F.explode(ngrams(F.col("text"), n)).alias("g"))
    both = grams(left, "l").join(grams(right, "r"), "g").groupBy("l", "r", "n_l", "n_r").agg(F.count("*").alias("c"))
    j = F.col("c") / (F.col("n_l") + F.col("n_r") - F.col("c"))
    return both.select("l", "r", j.alias("jaccard")).filter(F.col("jaccard") > threshold)


def information_loss(df: DataFrame) -> DataFrame:
    """Risk-weighted length of findings over the text's, at most 1: rows (doc_id, n_chars, removed)."""
    return df.select("doc_id", F.least(F.lit(1.0), safe_div(F.col("removed").cast("double"), F.col("n_chars"))).alias("loss"))


def consistency(mentions: DataFrame) -> DataFrame:
    """Share of (surface, entity_type) surfaces with one type only."""
    per = mentions.groupBy("surface").agg(F.count_distinct("entity_type").alias("kinds"))
    return per.agg(F.count("*").alias("surfaces"), F.count_if(F.col("kinds") == 1).alias("consistent"), safe_div(F.count_if(F.col("kinds") == 1).cast("double"), F.count("*")).alias("score"))


# calibration ------------------------------------------------------------------------------


def calibration_bins(df: DataFrame, bins: int = 15) -> DataFrame:
    """(bin, n, confidence, accuracy, gap) of rows (confidence, correct); the last bin is closed."""
    b = F.least(F.floor(F.col("confidence") * bins), F.lit(bins - 1)).cast("int")
    g = df.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg("confidence").alias("confidence"), F.avg(F.col("correct").cast("double")).alias("accuracy"))
    return g.withColumn("gap", F.abs(F.col("confidence") - F.col("accuracy")))


def calibration(df: DataFrame, bins: int = 15) -> DataFrame:
    """Expected and maximum calibration error."""
    b = calibration_bins(df, bins)
    return b.agg(safe_div(F.sum(F.col("n") * F.col("gap")), F.sum("n")).alias("ece"), F.max("gap").alias("mce"), F.sum("n").alias("n"))


def tempered(p: Column, temperature: float | Column) -> Column:
    """A probability with its log odds divided by a temperature."""
    q = F.greatest(F.lit(1e-7), F.least(F.lit(1 - 1e-7), p))
    return 1 / (1 + F.exp(-F.ln(q / (1 - q)) / temperature))


def best_temperature(df: DataFrame, bins: int = 15) -> DataFrame:
    """(temperature, ece) of the grid 0.5, 0.6 … 3.0 with the least error; one pass for the whole grid."""
    grid = F.explode(F.array(*[F.lit(round(0.5 + 0.1 * k, 1)) for k in range(26)])).alias("temperature")
    t = df.select("confidence", "correct", grid).withColumn("p", tempered(F.col("confidence"), F.col("temperature")))
    b = t.groupBy("temperature", F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).alias("bin")).agg(F.count("*").alias("n"), F.abs(F.avg("p") - F.avg(F.col("correct").cast("double"))).alias("gap"))
    e = b.groupBy("temperature").agg((F.sum(F.col("n") * F.col("gap")) / F.sum("n")).alias("ece"))
    return e.orderBy("ece", "temperature").limit(1)


def threshold_sweep(df: DataFrame, low: float = 0.30, high: float = 0.70, step: float = 0.02, beta: float = 2.0) -> DataFrame:
    """(threshold, tp, fp, fn, score) of every threshold for rows (score, positive)."""
    grid = [round(low + step * k, 6) for k in range(int(round((high - low) / step)) + 1)]
    rows = df.select(F.col("score").alias("s"), F.col("positive").cast("boolean").alias("y"), F.explode(F.array(*map(F.lit, grid))).alias("threshold"))
    hit = F.col("s") >= F.col("threshold")
    c = rows.groupBy("threshold").agg(F.count_if(hit & F.col("y")).alias("tp"), F.count_if(hit & ~F.col("y")).alias("fp"), F.count_if(~hit & F.col("y")).alias("fn"))
    p, r = safe_div(F.col("tp").cast("double"), F.col("tp") + F.col("fp")), safe_div(F.col("tp").cast("double"), F.col("tp") + F.col("fn"))
    return c.withColumn("score", f_beta(p, r, beta))


def cohens_kappa(df: DataFrame) -> DataFrame:
    """Agreement of raters a and b beyond chance."""
    n = df.groupBy("a", "b").agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("t"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("same"))
    sums = lambda c: n.groupBy(F.col(c).alias("v")).agg(F.sum("n").alias(f"n_{c}"))
    chance = sums("a").join(sums("b"), "v").agg(F.coalesce(F.sum(F.col("n_a").cast("double") * F.col("n_b")), F.lit(0.0)).alias("x"))
    po, pe = safe_div(F.col("same").cast("double"), F.col("t")), safe_div(F.col("x"), F.col("t").cast("double") * F.col("t"))
    return total.crossJoin(chance).select(F.when(pe >= 1, F.when(po >= 1, 1.0).otherwise(0.0)).otherwise((po - pe) / (1 - pe)).alias("kappa"))  # one row each


def cohens_d(df: DataFrame) -> DataFrame:
    """Effect size of rows (group, value) of groups 'a' and 'b', by the pooled spread."""
    s = df.groupBy().agg(*[f(F.when(F.col("group") == g, F.col("value"))).alias(f"{n}_{g}") for g in ("a", "b") for n, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))])
    pooled = F.sqrt(((F.col("n_a") - 1) * F.col("v_a") + (F.col("n_b") - 1) * F.col("v_b")) / (F.col("n_a") + F.col("n_b") - 2))
    return s.select(F.when(pooled > 0, (F.col("m_a") - F.col("m_b")) / pooled).otherwise(0.0).alias("d"))


# statistics of samples --------------------------------------------------------------------


def sample_for_effect(effect: float, z_alpha: float = 1.959963984540054, z_power: float = 0.8416212335729143) -> int:
    """Rows that an effect of that size takes to be seen."""
    import math

    return math.ceil(((z_alpha + z_power) / effect) ** 2)


def sample_size(population: int, z: float = 1.959963984540054, margin: float = 0.05, variance: float = 0.25) -> int:
    """Cochran's number with the correction for a finite population."""
    import math

    n0 = z * z * variance / margin**2
    return math.ceil(n0 / (1 + (n0 - 1) / population)) if population else math.ceil(n0)


def detectable_effect(n: int, spread: float, z_alpha: float = 1.959963984540054, z_power: float = 0.8416212335729143) -> float:
    return (z_alpha + z_power) * spread * (2 / n) ** 0.5


# what a dataset holds ---------------------------------------------------------------------


def coverage(df: DataFrame, keys: Sequence[str], least: int = 10) -> DataFrame:
    """(keys…, n, gap): how many rows each combination has, and whether they are too few."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).withColumn("gap", F.col("n") < least)


def length_statistics(df: DataFrame, by: str, length: str, distinct: str) -> DataFrame:
    """Number, mean, median and range of a length for each group, and its distinct values of another column."""
    return df.groupBy(by).agg(
        F.count("*").alias("docs"), F.avg(length).alias("mean"), F.percentile(length, F.lit(0.5)).alias("median"), F.min(length).alias("least"), F.max(length).alias("most"), F.count_distinct(distinct).alias("sources")
    )


def head_to_head(scores: DataFrame, by: str, system: str, score: str) -> DataFrame:
    """The best and the worst system of each group by a score."""
    return scores.groupBy(by).agg(F.max_by(system, score).alias("best"), F.max(score).alias("score"), F.min_by(system, score).alias("worst"))


def record_rows(df: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(record_id, text, chars) of any table with an id and a text."""
    return df.select(F.col(f"`{id_column}`").alias("record_id"), F.col(f"`{text_column}`").alias("text"), F.length(f"`{text_column}`").cast("bigint").alias("chars"))
