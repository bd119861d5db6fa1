"""Queries of systems compared and calibrated, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.operators import compare, rating
from veilspark.plans.catalogue import _COVERED, FINDINGS, SYSTEMS, findings, query, r6, systems, table


def field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return systems(spark, sf_dir).withColumn("available", F.col("system") % 5 != 0)


FIELD = f"{SYSTEMS}, v as (select * from c where system % 5 <> 0), o as (select * from v where system <> 1), me as (select * from v where system = 1)"


@query(f"with {FIELD} select 'f1' as metric, (select system from o order by f1 desc, system limit 1) as comparator, round((select max(f1) from o), 6) as target, round((select f1 from me), 6) as actual, (select f1 from me) >= (select max(f1) from o) as passed union all select 'recall', (select system from o order by recall desc, system limit 1), round((select max(recall) from o), 6), round((select recall from me), 6), (select recall from me) >= (select max(recall) from o)")
def floor_contract(spark, sf_dir):
    return compare.floor_contract(field(spark, sf_dir), 1, "accuracy").withColumns({c: r6(c) for c in ("target", "actual")})


@query(f"with {FIELD} select system % 3 as kind, min_by(system, latency_ms * 1000000 + system) as system, min(latency_ms) as latency_ms from v group by 1")
def best_available(spark, sf_dir):
    return compare.best_available(field(spark, sf_dir).withColumn("kind", F.col("system") % 3), "latency_ms", True, ["kind"])


REPORTS = "r as (select c_custkey % 20 as system, 'p' || (c_nationkey % 3) as profile, c_custkey as place, c_acctbal > -900 as available, round(c_acctbal, 2) as f1 from customer)"


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select((F.col("c_custkey") % 20).alias("system"), F.concat(F.lit("p"), F.col("c_nationkey") % 3).alias("profile"), F.col("c_custkey").alias("place"), (F.col("c_acctbal") > -900).alias("available"), F.round("c_acctbal", 2).alias("f1"))


@query(f"with {REPORTS} select system, bool_and(available) as everywhere, coalesce(string_agg(profile, ',' order by profile) filter (not available), '') as missing from r group by 1")
def competitor_availability(spark, sf_dir):
    return compare.availability(reports(spark, sf_dir))


@query(f"with {REPORTS} select system, min_by(profile, place) as profile, min_by(f1, place) as f1 from r group by 1")
def merged_profiles(spark, sf_dir):
    return compare.merged_profiles(reports(spark, sf_dir)).select("system", "profile", "f1")


@query("with s as (select c_mktsegment as entity_type, 's' || (c_nationkey % 5) as system, avg(c_acctbal) as f1 from customer group by all), o as (select entity_type, max(f1) as best, max_by(system, f1) as expert from s where system <> 's0' group by 1) select entity_type, round(coalesce(e.f1, 0), 4) as ensemble, round(best, 4) as best, expert, coalesce(e.f1, 0) >= best - 1e-6 as dominates from o left join (select * from s where system = 's0') e using (entity_type)")
def dominance_check(spark, sf_dir):
    s = table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("entity_type"), F.concat(F.lit("s"), F.col("c_nationkey") % 5).alias("system")).agg(F.avg("c_acctbal").alias("f1"))
    return compare.dominance(s, "s0").withColumns({c: F.round(c, 4) for c in ("ensemble", "best")})


@query(f"with {SYSTEMS}, front as (select distinct a.precision as x, a.recall as y from s a where not exists (select 1 from s b where b.precision >= a.precision and b.recall >= a.recall and (b.precision > a.precision or b.recall > a.recall))) select system, round(min(sqrt((precision - x) * (precision - x) + (recall - y) * (recall - y))), 6) as distance from s, front group by 1")
def pareto_distance(spark, sf_dir):
    s = systems(spark, sf_dir)
    return compare.pareto_distance(s, rating.pareto(s, "precision", "recall"), "precision", "recall").withColumn("distance", r6("distance"))


HAVE = ", ".join(f"'{t}'" for t in _COVERED)
NEEDS = "n(standard, entity_type) as (values " + ", ".join(f"('{s}', '{t}')" for s, ts in rating.STANDARDS.items() for t in ts.split()) + ")"


@query(f"with {NEEDS} select standard, substr(entity_type, 1, 1) as category, count(*) as required, count(*) filter (entity_type in ({HAVE})) as covered, coalesce(string_agg(entity_type, ',' order by entity_type) filter (entity_type not in ({HAVE})), '') as missing from n group by all")
def category_gaps(spark, sf_dir):
    """The categories are the types' first letters."""
    needs = rating.requirements(spark).withColumn("category", F.substring("entity_type", 1, 1))
    return compare.category_gaps(needs, spark.createDataFrame([(t,) for t in _COVERED], "entity_type string"))


@query(f"with {NEEDS}, g as (select entity_type, case length(entity_type) % 3 when 0 then 'critical' when 1 then 'high' else 'low' end as risk from n where standard = 'gdpr' and entity_type not in ({HAVE})) select row_number() over (order by case risk when 'critical' then 1 when 'high' then 2 else 4 end, entity_type)::int as place, entity_type, risk from g")
def remediation_plan(spark, sf_dir):
    n = F.length("entity_type") % 3
    risks = rating.requirements(spark).select("entity_type").distinct().withColumn("risk", F.when(n == 0, "critical").when(n == 1, "high").otherwise("low"))
    return compare.remediation(spark.createDataFrame([(t,) for t in _COVERED], "entity_type string"), risks, "gdpr")


@query(f"with {FINDINGS}, p as (select distinct engine_id as strategy, entity_type, span_start, span_end from f where doc_id % 3 = 0), g as (select distinct entity_type, span_start, span_end from f where doc_id % 5 = 0), c as (select strategy, count(g.span_start) as tp, count(*) as predicted, (select count(*) from g) as gold from p left join g using (entity_type, span_start, span_end) group by 1), s as (select *, 2 * tp / (gold + predicted)::double as f from c) select strategy, tp, predicted, gold, round(f, 6) as f, row_number() over (order by f desc, strategy) = 1 as best from s")
def strategies_compared(spark, sf_dir):
    f = findings(spark, sf_dir)
    gold = f.filter("doc_id % 5 = 0").select("entity_type", F.col("span_start").alias("start"), F.col("span_end").alias("end"))
    return compare.strategies_compared(f.filter("doc_id % 3 = 0").withColumnRenamed("engine_id", "strategy"), gold).withColumn("f", r6("f"))


@query("with o as (select event_type as expert_id, 't' || (event_id % 3) as entity_type, list((event_id % 10) / 10.0::double order by event_id) as a from events where event_id % 50 = 0 group by all) select expert_id, entity_type, round(case when len(a) >= 5 then list_reduce(list_prepend(0.5::double, a[5:]), lambda s, x: greatest(0.05 * x + 0.95 * s, 0.05)) else 0.5 end, 6) as strength from o")
def online_calibration(spark, sf_dir):
    e = table(spark, sf_dir, "events").filter("event_id % 50 = 0").select(F.col("event_type").alias("engine_id"), F.concat(F.lit("t"), F.col("event_id") % 3).alias("entity_type"), F.col("event_id").alias("at"), (F.col("event_id") % 10 / F.lit(10.0)).alias("f1"))
    experts = e.select(F.col("engine_id").alias("expert_id"), "entity_type").distinct().withColumn("strength", F.lit(0.5))
    return compare.online_strengths(experts, e).withColumn("strength", r6("strength"))
