"""Queries of alignment, resampling, routing, datasets and utility, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.functions.patterns import NOT_NAMES, REGISTRY, Spec
from veilspark.operators import detect as D
from veilspark.operators import fusion, keys, matching, resample, routing, segment, siv, utility, vault
from veilspark.plans.catalogue import FINDINGS, GOLD, PRED, _prf_sql, _rounded, cores, findings, gold_and_predicted, query, r6, spans_sql, table
from veilspark.sources import datasets

# alignment --------------------------------------------------------------------------------

OVERLAP = '(least(p."end", g."end") - greatest(p.start, g.start))'
RULES = {
    "strict": 'p.entity_type = g.entity_type and p.start = g.start and p."end" = g."end"', "exact": 'p.start = g.start and p."end" = g."end"',
    "partial": f'{OVERLAP} > 0 and {OVERLAP} / (g."end" - g.start + p."end" - p.start - {OVERLAP})::double >= 0.5', "type": f"p.entity_type = g.entity_type and {OVERLAP} > 0",
}


def aligned_sql(rule: str) -> str:
    """Per record, first fit by a recursive walk over its labels."""
    number = "row_number() over (partition by record_id order by start, \"end\", entity_type)"
    return f"""with recursive {GOLD}, {PRED}, g as (select *, {number} as k from gold), p as (select *, {number} as i from pred),
m as (select record_id, k, list_sort(list(i)) as fits from (select g.record_id, g.k, p.i from g join p using (record_id) where {rule}) group by all),
n as (select record_id, max(k) as last from g group by 1),
st as (select record_id, 0::bigint as k, []::bigint[] as taken from n
  union all select st.record_id, st.k + 1, case when m.fits is null or len(list_filter(m.fits, lambda x: not list_contains(st.taken, x))) = 0 then st.taken else list_append(st.taken, list_filter(m.fits, lambda x: not list_contains(st.taken, x))[1]) end
  from st join n using (record_id) left join m on m.record_id = st.record_id and m.k = st.k + 1 where st.k < n.last),
c as (select record_id, len(taken)::bigint as tp from st join n using (record_id) where k = last),
t as (select coalesce(c.record_id, a.record_id) as record_id, coalesce(tp, 0) as tp, coalesce(a.n, 0) as predicted, coalesce(b.n, 0) as gold
  from (select record_id, count(*) as n from pred group by 1) a full join (select record_id, count(*) as n from gold group by 1) b using (record_id) left join c on c.record_id = coalesce(a.record_id, b.record_id))"""


def _total(rule: str) -> str:
    return f"{aligned_sql(RULES[rule])}, s as (select sum(tp)::bigint as tp, sum(predicted)::bigint as predicted, sum(gold)::bigint as gold from t) select '{rule}' as mode, tp, predicted, gold, {_prf_sql()} from s"


def _alignment(rule: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _rounded(matching.alignment_scores(*gold_and_predicted(spark, sf_dir), [rule]))

    run.__name__ = f"alignment_{rule}"
    return query(_total(rule))(run)


for _rule in RULES:
    _alignment(_rule)


@query(f"{aligned_sql(RULES['type'])}, s as (select 'l' || (record_id % 3) as language, sum(tp)::bigint as tp, sum(predicted)::bigint as predicted, sum(gold)::bigint as gold from t where record_id is not null group by 1) select language, tp, predicted, gold, {_prf_sql()} from s")
def scores_by_language(spark, sf_dir):
    predicted, gold = gold_and_predicted(spark, sf_dir)
    records = gold.select("record_id").union(predicted.select("record_id")).distinct().withColumn("language", F.concat(F.lit("l"), F.col("record_id") % 3))
    return _rounded(matching.scores_by(predicted, gold, records, "language", "type"))


@query(f"with {PRED}, n as (select distinct record_id, 200 + record_id % 3 * 100 as n_chars from pred) select distinct record_id, entity_type, start, \"end\" from pred join n using (record_id) where start >= 0 and \"end\" <= n_chars")
def predictions_sanitised(spark, sf_dir):
    predicted, _ = gold_and_predicted(spark, sf_dir)
    return matching.sanitised(predicted, predicted.select("record_id", (200 + F.col("record_id") % 3 * 100).alias("n_chars")).distinct())


@query(f"with {GOLD}, {PRED}, p as (select distinct entity_type, start from pred), g as (select distinct entity_type, start from gold), c as (select (select count(*) from p join g using (entity_type, start)) as tp, (select count(*) from p) as predicted, (select count(*) from g) as gold) select tp, predicted, gold, {_prf_sql()} from c")
def set_f1(spark, sf_dir):
    return _rounded(matching.set_f_beta(*gold_and_predicted(spark, sf_dir), ["entity_type", "start"]))


@query(f"with {GOLD}, {PRED}, l as (select count(*) as lost from gold where not exists (select 1 from pred where pred.record_id = gold.record_id and pred.start = gold.start)), c as (select count(*) as cases from gold) select cases, lost, round(lost / cases::double, 6) as loss from c, l")
def boundary_loss(spark, sf_dir):
    predicted, gold = gold_and_predicted(spark, sf_dir)
    return matching.boundary_loss(gold, predicted, ["record_id", "start"]).withColumn("loss", r6("loss"))


@query("with p as (select c_nationkey as entity, count(distinct c_mktsegment) as n from customer where c_custkey % 40 = 0 group by 1) select count(*) as entities, count(*) filter (n = 1) as stable, round(count(*) filter (n = 1) / count(*)::double, 6) as score from p")
def token_stability(spark, sf_dir):
    c = table(spark, sf_dir, "customer").filter("c_custkey % 40 = 0").select(F.col("c_nationkey").alias("entity"), F.col("c_mktsegment").alias("token"))
    return matching.token_stability(c).withColumn("score", r6("score"))


# resampling -------------------------------------------------------------------------------


def _weights_sql(rows: str, keys: str = "") -> str:
    """Draws' means of rows (i, x and keys), by the same weights."""
    g = f"{keys}, " if keys else ""
    w = " + ".join(f"(x2 / 2147483647.0::double >= {float(s)!r})::int" for s in resample.STEPS)
    return f"""r as ({rows}), d0 as (select *, (i % 2147483647 * 48271 + k * 69621 + 42) % 2147483647 as x0 from r, (select unnest(range(0, 50)) as k)),
d1 as (select *, (x0 * x0 + k) % 2147483647 as x1 from d0), d2 as (select *, (x1 * x1 + i % 2147483647) % 2147483647 as x2 from d1), w as (select {g}k, x, {w} as w from d2),
means as (select {g}k, sum(w * x) / sum(w) as mean from w group by {g}k having sum(w) > 0)"""


@query("with " + _weights_sql("select doc_id as i, quality::double as x from labels") + " select round(quantile_cont(mean, 0.025), 6) as low, round(quantile_cont(mean, 0.975), 6) as high, round(stddev_pop(mean), 6) as error from means")
def bootstrap_ci(spark, sf_dir):
    out = resample.interval(table(spark, sf_dir, "labels"), "quality", "doc_id", draws=50)
    return out.select(*[r6(c).alias(c) for c in out.columns])


@query("with " + _weights_sql("select doc_id as i, quality::double as x, lang from labels join documents using (doc_id)", "lang") + " select lang, round(quantile_cont(mean, 0.025), 6) as low, round(quantile_cont(mean, 0.975), 6) as high, round(stddev_pop(mean), 6) as error from means group by lang")
def bootstrap_ci_by_language(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    return resample.interval(rows, "quality", "doc_id", ["lang"], draws=50).select("lang", *[r6(c).alias(c) for c in ("low", "high", "error")])


@query("with " + _weights_sql("select doc_id as i, (quality - toxic)::double as x from labels") + ", s as (select count(*) as n, avg(x) as delta from r) select n, round(delta, 6) as delta, round(quantile_cont(mean, 0.025), 6) as low, round(quantile_cont(mean, 0.975), 6) as high, round(avg((abs(mean - delta) >= abs(delta))::int), 6) as p_value from means, s group by n, delta")
def paired_bootstrap(spark, sf_dir):
    out = resample.paired(table(spark, sf_dir, "labels"), "quality", "toxic", "doc_id", draws=50)
    return out.select("n", *[r6(c).alias(c) for c in ("delta", "low", "high", "p_value")])


SCORES = "s as (select 'sys' || (event_id % 4) as system, event_id // 4 as id, (event_id * 7919 % 101 + event_id % 4)::double as score from events)"


@query(f"with {SCORES}, " + _weights_sql("select a.system as a, b.system as b, a.id as i, a.score - b.score as x from s a join s b using (id) where a.system < b.system", "a, b") + ", o as (select a, b, count(*) as n, avg(x) as delta from r group by all) select a, b, n, round(delta, 6) as delta, round(avg((abs(mean - delta) >= abs(delta))::int), 6) as p_value, avg((abs(mean - delta) >= abs(delta))::int) < 0.05 as significant_at_05, avg((abs(mean - delta) >= abs(delta))::int) < 0.01 as significant_at_01 from means join o using (a, b) group by a, b, n, delta")
def significance_matrix(spark, sf_dir):
    i = F.col("event_id")
    s = table(spark, sf_dir, "events").select(F.concat(F.lit("sys"), i % 4).alias("system"), F.floor(i / 4).alias("id"), (i * 7919 % 101 + i % 4).cast("double").alias("score"))
    return resample.significance(s, draws=50).withColumns({c: r6(c) for c in ("delta", "p_value")})


# routing ----------------------------------------------------------------------------------

CAPABLE = {
    "regex-oss": routing.Capability(), "presidio-compatible": routing.Capability(("en", "es")), "spacy-ner-compatible": routing.Capability(("en", "de")), "stanza-ner-compatible": routing.Capability(available=False),
    "llm-guard-compatible": routing.Capability(("fr",)),
}
CASES, GOALS = ("default", "short_chat", "long_document", "structured_form_accuracy", "structured_form_latency"), ("accuracy", "balanced", "speed", "ensemble")


@query("""with d as (select doc_id, lang, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) as n, ['default', 'short_chat', 'long_document', 'structured_form_accuracy', 'structured_form_latency'][doc_id % 5 + 1] as u, ['accuracy', 'balanced', 'speed', 'ensemble'][doc_id // 5 % 4 + 1] as o from documents),
e as (select *, 'regex-oss,presidio-compatible,spacy-ner-compatible' || case when lang = 'fr' then ',llm-guard-compatible' else '' end as here from d)
select doc_id, case when u = 'default' then 'default_compat' when o = 'ensemble' then 'ensemble_all' else o || '_guarded' end as plan_id,
  case when u = 'default' or o = 'ensemble' then here
       when o = 'accuracy' or (o = 'balanced' and u = 'structured_form_accuracy') then 'presidio-compatible,regex-oss,spacy-ner-compatible'
       when o = 'speed' or u = 'structured_form_latency' then 'spacy-ner-compatible'
       when u = 'long_document' or lang in ('es', 'fr') then 'regex-oss,presidio-compatible,spacy-ner-compatible' else 'regex-oss,spacy-ner-compatible' end as engines,
  case when u = 'default' or o = 'speed' then 0.0 when o = 'ensemble' then 0.7 when o = 'accuracy' then 0.88 else 0.8 end::double as threshold,
  u <> 'default' and o in ('accuracy', 'balanced') as escalates, u = 'long_document' and o <> 'speed' and n > 300 as segmented from e""")
def route_documents(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    plans = routing.plan_table(spark, CAPABLE, CASES, GOALS, ("en", "de", "fr", "es"))
    named = lambda values, at: F.element_at(F.array(*map(F.lit, values)), (at + 1).cast("int"))
    texts = d.select("doc_id", F.col("lang").alias("language"), "text", named(CASES, F.col("doc_id") % 5).alias("use_case"), named(GOALS, F.floor(F.col("doc_id") / 5) % 4).alias("objective"))
    return routing.route(texts, plans, routing.Settings(segment_tokens=300)).select("doc_id", "plan_id", F.array_join("engines", ",").alias("engines"), "threshold", "escalates", "segmented")


KEYS = "doc_id, entity_type, span_start, span_end"


@query(f"""with {FINDINGS}, a as (select * from f where engine_id in ('click', 'view')), m as (select {KEYS}, avg(confidence) as c from a group by {KEYS}),
e as (select doc_id, avg(c) as s from m group by 1), low as (select doc_id from (select distinct doc_id from f) left join e using (doc_id) where s is null or s < 0.5),
again as (select distinct doc_id from f join low using (doc_id) where engine_id not in ('click', 'view'))
select {KEYS}, round(c, 6) as confidence from m where doc_id not in (select doc_id from again)
union all select {KEYS}, round(avg(confidence), 6) from f where doc_id in (select doc_id from again) group by {KEYS}""")
def escalation(spark, sf_dir):
    """Two engines first; documents of low confidence also have the others, and are fused anew."""
    f = findings(spark, sf_dir)
    first = F.col("engine_id").isin("click", "view")
    plan = routing.Plan("balanced_guarded", ("click", "view"), threshold=0.5, escalates=True, escalation=("other",))
    texts = f.select("doc_id").distinct()
    out = routing.escalate(texts, f.filter(first), plan, lambda low: f.filter(~first).join(low.select("doc_id"), "doc_id", "left_semi"))
    return out.select(*KEYS.split(", "), r6("confidence").alias("confidence"))


@query("with " + spans_sql("em", D.EMAIL) + " select doc_id, span_start, cast(span_start + length(matched) as int) as span_end from em")
def segmented_detect(spark, sf_dir):
    """E-mail addresses found window by window are those of the whole texts."""
    def emails(windows):
        spans = windows.select("doc_id", "field_path", "language", F.explode(D.native_spans(F.col("text"), D.EMAIL)).alias("s"))
        return spans.select("doc_id", "field_path", "language", F.lit("EMAIL_ADDRESS").alias("entity_type"), F.col("s.start").alias("span_start"), F.col("s.end").alias("span_end"), F.lit(0.9).alias("confidence"), F.lit("native").alias("engine_id"))

    texts = D.document_texts(table(spark, sf_dir, "documents").filter(F.col("text").contains("@")))
    return routing.segmented(texts, emails, 40, 8).select("doc_id", "span_start", "span_end")


@query("""with w as (select doc_id, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) as n from documents), s as (select doc_id, n, case when n <= 90 then 1 else 1 + ceil((n - 90) / 80.0)::int end + (n >= 90 and (n - 90) % 80 = 0)::int as k from w where n > 0)
select doc_id, k - 1 as last, least((k - 1) * 80 + 90, n) - 1 as token_end from s""")
def streaming_chunks(spark, sf_dir):
    """The last window of every text."""
    c = segment.chunks(table(spark, sf_dir, "documents").select("doc_id", "text"), 90, 10)
    return c.groupBy("doc_id").agg(F.max(F.struct("segment", "token_end")).alias("x")).select("doc_id", F.col("x.segment").cast("bigint").alias("last"), F.col("x.token_end").cast("bigint").alias("token_end"))


# vault ------------------------------------------------------------------------------------


@query("select c_custkey, c_name as plaintext, true as same_for_same, c_name is not null as hidden from customer")
def siv_round_trip(spark, sf_dir):
    """Tokens of all names and what they decrypt to."""
    key = "veilspark-demo-key"
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("matched"), F.lit("PERSON_NAME").alias("entity_type"))
    t = siv.tokenize(c, key)
    again = siv.tokenize(c.select("c_custkey", "matched", "entity_type"), key).select("c_custkey", F.col("token").alias("again"))
    back = siv.detokenize(t.join(again, "c_custkey"), key)
    return back.select("c_custkey", "plaintext", (F.col("token") == F.col("again")).alias("same_for_same"), (~F.col("token").contains(F.col("matched")) & F.col("token").startswith("<PERSON_NAME:v1:aes_")).alias("hidden"))


@query("select o_orderkey, o_orderstatus as a, o_orderpriority as b from orders")
def detokenize_payload(spark, sf_dir):
    """Every string field of a record, tokenized and brought back."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("a"), F.col("o_orderpriority").alias("b"))
    cells = D.payload_texts(o, "o_orderkey", ["a", "b"])
    spans = cells.select("doc_id", "field_path", F.lit("NATIONAL_ID").alias("entity_type"), F.col("text").alias("matched"))
    store = vault.vault(spans, "veilspark-demo-key")
    held = {c: vault.token(F.lit("NATIONAL_ID"), F.col(c), "veilspark-demo-key", F.lit("default")) for c in ("a", "b")}
    return vault.detokenize_payload(o.withColumns(held), store, "o_orderkey", ["a", "b"])


@query("""with m as (select c_nationkey % 5 as scope, c_nationkey as cluster, case when c_custkey % 3 = 0 then split_part(c_name, '#', 1) else split_part(c_name, '#', 1) || ' ' || c_mktsegment end as alias, c_custkey as pos from customer),
f as (select scope, cluster, min_by(alias, pos) as first_, min_by(alias, pos) filter (contains(alias, ' ')) as full_, count(*) as mentions, count(distinct lower(alias)) as n_aliases from m group by all)
select scope, cluster, case when contains(first_, ' ') then first_ else coalesce(full_, first_) end as canonical, mentions, n_aliases from f""")
def identity_ledger(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    name = F.split("c_name", "#")[0]
    m = c.select((F.col("c_nationkey") % 5).alias("scope"), F.col("c_nationkey").alias("cluster"), F.when(F.col("c_custkey") % 3 == 0, name).otherwise(F.concat(name, F.lit(" "), "c_mktsegment")).alias("alias"), F.col("c_custkey").alias("at"))
    return keys.ledger(m).select("scope", "cluster", "canonical", "mentions", F.size("aliases").cast("bigint").alias("n_aliases"))


# datasets ---------------------------------------------------------------------------------

RECORDS = """x as (select 'r' || doc_id as record_id, text, lang as language, case when doc_id % 4 = 0 then 'code' when doc_id % 4 = 1 then 'prose' end as data_type, case when doc_id % 5 = 0 then 'challenging' end as difficulty_level,
  case when doc_id % 6 = 0 then 'alias_continuity' when doc_id % 6 = 1 then 'context_loss' end as scenario_id,
  [{'t': 'STREET_ADDRESS', 's': 0, 'e': 3, 'c': 'k1'}, {'t': 'TIMESTAMP', 's': 1, 'e': 2, 'c': 'k1'}, {'t': 'EMAIL_ADDRESS', 's': 2, 'e': doc_id % 5, 'c': 'k1'}, {'t': 'VISA_NUMBER', 's': 4, 'e': 100 + doc_id % 400, 'c': 'k2'}] as raw from documents where text is not null and text <> ''),
l as (select *, list_filter(list_transform(raw, lambda r: {'t': case r.t when 'STREET_ADDRESS' then 'ADDRESS' when 'TIMESTAMP' then '' when 'VISA_NUMBER' then 'PASSPORT' else r.t end, 's': r.s, 'e': r.e, 'c': r.c}), lambda r: r.t <> '' and r.e > r.s and r.e <= length(text)) as labels from x),
n as (select record_id, text, language, case when data_type = 'code' then 'code' else 'unstructured_text' end as data_type, coalesce(difficulty_level, 'moderate') as difficulty_level, labels,
  list_sort(list_distinct(list_transform(labels, lambda r: r.t))) as types, case when len(list_filter(labels, lambda r: r.c = 'k1')) > 1 then 1 else 0 end as repeated,
  list_filter([case when scenario_id = 'context_loss' then 'context_preservation' end, case when data_type = 'code' then 'data_format_variations' end, case when difficulty_level = 'challenging' then 'edge_cases' end, case when scenario_id = 'alias_continuity' then 'entity_tracking' end, case when language <> 'en' then 'multilingual' end], lambda t: t is not null) as told from l)"""


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw rows as a file of another edition might have them: its names, spans that don't fit, values out of range."""
    d, i = table(spark, sf_dir, "documents"), F.col("doc_id")
    span = lambda t, a, z, c: F.struct(F.lit(t).alias("entity_type"), F.lit(a).cast("int").alias("start"), z.cast("int").alias("end"), F.lit(None).cast("string").alias("entity_cluster_id"), F.lit(c).alias("cluster_id"), F.lit(None).cast("string").alias("mention_variant"), F.lit(None).cast("string").alias("context_group"))
    return d.select(
        F.concat(F.lit("r"), i).alias("id"), "text", F.col("lang").alias("language"), F.when(i % 4 == 0, "code").when(i % 4 == 1, "prose").alias("data_type"), F.when(i % 5 == 0, "challenging").alias("difficulty_level"),
        F.when(i % 6 == 0, "alias_continuity").when(i % 6 == 1, "context_loss").alias("scenario_id"),
        F.array(span("STREET_ADDRESS", 0, F.lit(3), "k1"), span("TIMESTAMP", 1, F.lit(2), "k1"), span("EMAIL_ADDRESS", 2, i % 5, "k1"), span("VISA_NUMBER", 4, 100 + i % 400, "k2")).alias("annotations"),
    )


TAGS = "case when len(told) = 0 then 'diverse_pii_types' else array_to_string(told, ',') end"


@query(f"with {RECORDS} select record_id, language, data_type, difficulty_level, len(labels)::bigint as n_labels, array_to_string(types, ',') as types, repeated::bigint as repeated, {TAGS} as tags from n")
def evaluation_records(spark, sf_dir):
    n = datasets.normalised(records(spark, sf_dir))
    return n.select("record_id", "language", "data_type", "difficulty_level", F.size("labels").cast("bigint").alias("n_labels"), F.array_join("entity_types_present", ",").alias("types"), F.col("num_repeated_entities").cast("bigint").alias("repeated"), F.array_join("dimension_tags", ",").alias("tags"))


@query(f"with {RECORDS}, u as (select record_id, unnest(labels) as r from n) select record_id, r.t as entity_type, r.s::int as start, r.e::int as \"end\" from u")
def gold_spans(spark, sf_dir):
    return datasets.labels_of(datasets.normalised(records(spark, sf_dir)))


@query(f"with {RECORDS} select 'language' as field, language as value, count(*) as n from n group by 2 union all select 'data_type', data_type, count(*) from n group by 2 union all select 'entity_types_present', t, count(*) from (select unnest(types) as t from n) group by 2 union all select 'dimension_tags', t, count(*) from (select unnest(string_split({TAGS}, ',')) as t from n) group by 2")
def dataset_summary(spark, sf_dir):
    return datasets.summary(datasets.normalised(records(spark, sf_dir)), ["language", "data_type", "entity_types_present", "dimension_tags"])


@query(f"with {RECORDS} select record_id, language from n where list_contains(string_split({TAGS}, ','), 'edge_cases') and language in ('de', 'fr')")
def profile_records(spark, sf_dir):
    n = datasets.normalised(records(spark, sf_dir))
    return datasets.for_profile(datasets.with_dimension(n, "edge_cases"), "p", ("de", "fr")).select("record_id", "language")


PICK = "(('0x' || substr(md5(n_nationkey || ':{slot}:42'), 1, 8))::bigint % {n})"


@query("with g as (select n_nationkey, " + PICK.format(slot="language", n=4) + " as d from nation) select 'gen-' || lpad(n_nationkey::varchar, 9, '0') as record_id, ['en', 'de', 'fr', 'es'][d + 1] as language from g")
def generated_languages(spark, sf_dir):
    """As many records as there are nations."""
    return datasets.generate(spark, table(spark, sf_dir, "nation").count()).select("record_id", "language")


# utility ----------------------------------------------------------------------------------


@query("select p_partkey, round(case when len(a) = 0 then 1 else len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b)))::double end, 6) as score from (select p_partkey, list_distinct(list_transform(range(1, length(p_name) - 1), lambda i: p_name[i:i+2])) as a, list_distinct(list_transform(range(1, length(p_type) - 1), lambda i: p_type[i:i+2])) as b from part)")
def semantic_preservation(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", r6(utility.ngram_preservation(F.col("p_name"), F.col("p_type"))).alias("score"))


@query("with x as (select item_id, text as a, replace(replace(text, ' ', '. '), 'a', '') as b from benchmark), s as (select item_id, a, b, len(list_filter(regexp_split_to_array(a, '[.!?]+'), lambda s: regexp_matches(s, '\\S'))) as sa, len(list_filter(regexp_split_to_array(b, '[.!?]+'), lambda s: regexp_matches(s, '\\S'))) as sb from x) select item_id, round(1 - abs(sa - sb) / greatest(sa, sb, 1)::double / 2, 6) as structure, round(length(b) / length(a)::double, 6) as short, round(2 * 0.4 * (length(b) / length(a)::double) / (0.4 + length(b) / length(a)::double), 6) as tradeoff from (select *, length(a) as la from s) where length(b) <= length(a) union all select item_id, round(1 - abs(sa - sb) / greatest(sa, sb, 1)::double / 2, 6), round(length(a) / length(b)::double, 6), round(2 * 0.4 * (length(a) / length(b)::double) / (0.4 + length(a) / length(b)::double), 6) from s where length(b) > length(a)")
def structure_preservation(spark, sf_dir):
    a = F.col("text")
    b = F.replace(F.replace(a, F.lit(" "), F.lit(". ")), F.lit("a"), F.lit(""))
    kept = utility.length_kept(a, b)
    return table(spark, sf_dir, "benchmark").select("item_id", r6(utility.structure_kept(a, b)).alias("structure"), r6(kept).alias("short"), r6(utility.tradeoff(F.lit(0.4), kept)).alias("tradeoff"))


@query("with x as (select case when c_custkey % 2 = 0 then 'US_SSN' else 'DATE_OF_BIRTH' end as t, lpad((c_custkey % 1000)::varchar, 3, '0') || '-' || lpad((c_custkey % 100)::varchar, 2, '0') || '-' || lpad(c_custkey::varchar, 4, '0') as o, case when c_custkey % 3 = 0 then '***' else '123-45-6789' end as r from customer), s as (select case t when 'US_SSN' then regexp_full_match(o, '[0-9]{3}[-\\s]?[0-9]{2}[-\\s]?[0-9]{4}') else regexp_full_match(o, '[0-9]{4}[-/][0-9]{2}[-/][0-9]{2}|[0-9]{2}[-/][0-9]{2}[-/][0-9]{4}') end as a, case t when 'US_SSN' then regexp_full_match(r, '[0-9]{3}[-\\s]?[0-9]{2}[-\\s]?[0-9]{4}') else false end as b from x) select count(*) filter (a) as checked, count(*) filter (a and b) as preserved, round(case when count(*) filter (a) > 0 then count(*) filter (a and b) / (count(*) filter (a))::double else 1 end, 6) as score from s")
def format_preservation(spark, sf_dir):
    k = F.col("c_custkey")
    part = lambda x, n: F.lpad(x.cast("string"), n, "0")
    c = table(spark, sf_dir, "customer").select(F.when(k % 2 == 0, "US_SSN").otherwise("DATE_OF_BIRTH").alias("entity_type"), F.concat_ws("-", part(k % 1000, 3), part(k % 100, 2), part(k, 4)).alias("original"), F.when(k % 3 == 0, "***").otherwise("123-45-6789").alias("replacement"))
    return utility.format_preservation(c).withColumn("score", r6("score"))


@query("select doc_id, len(list_intersect(regexp_split_to_array(lower(text), '\\s+'), ['he', 'she', 'his', 'her', 'him', 'hers'])) > 0 as gender, contains(lower(text), 'american') or contains(lower(text), 'british') or contains(lower(text), 'french') or contains(lower(text), 'german') or contains(lower(text), 'spanish') or contains(lower(text), 'italian') or contains(lower(text), 'chinese') or contains(lower(text), 'japanese') or contains(lower(text), 'indian') or contains(lower(text), 'brazilian') or contains(lower(text), 'canadian') or contains(lower(text), 'australian') or contains(lower(text), 'mexico') or contains(lower(text), 'london') or contains(lower(text), 'paris') or contains(lower(text), 'tokyo') or contains(lower(text), 'mumbai') or contains(lower(text), 'russia') or contains(lower(text), 'usa') or contains(lower(text), 'uk') or contains(lower(text), 'europe') or contains(lower(text), 'asia') or contains(lower(text), 'africa') as nationality from documents where text is not null")
def attribute_inference(spark, sf_dir):
    d = table(spark, sf_dir, "documents").filter("text is not null")
    told = lambda kind: utility.attribute_inferred(F.lit(kind), F.col("text")).alias(kind)
    return d.select("doc_id", told("gender"), told("nationality"))


@query("with k as (select distinct split_part(p_name, ' ', 1) as token from part where p_partkey % 50 = 0), h as (select distinct token from k join documents d on contains(d.text, k.token)) select (select count(*) from k) as known, count(*) as found, round(count(*) / (select count(*) from k)::double, 6) as rate from h")
def reconstruction_attack(spark, sf_dir):
    known = table(spark, sf_dir, "part").filter("p_partkey % 50 = 0").select(F.split("p_name", " ")[0].alias("token"))
    return utility.reconstruction(table(spark, sf_dir, "documents"), known).withColumn("rate", r6("rate"))


# the registry's patterns ------------------------------------------------------------------

#: Letters that SQL's expressions don't take for word characters.
FOREIGN = "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿßÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ"
NOT_FIRST = "^(" + NOT_NAMES + ")[ \t]"


def _plain(s: Spec) -> tuple[str, int]:
    """A pattern without look-around, and the group that holds what is found.

    What must stand before or not after a match is taken along, outside the group.
    """
    before = {"(?<![:\\w])": "(?:^|[^:\\w])", "(?<!\\w)": "(?:^|\\W)", "(?<![A-Za-z])": "(?:^|[^A-Za-z])", "(?<![0-9.])": "(?:^|[^0-9.])"}
    after = {"(?![:\\w])": "(?:[^:\\w]|$)", "(?!\\w)": "(?:\\W|$)" if s.entity_type == "USERNAME" else "\\b", "(?![A-Za-z])": "(?:[^A-Za-z]|$)", "(?![0-9.])": "(?:[^0-9.]|$)"}
    rx, group = s.pattern.replace(f"(?!(?:{NOT_NAMES})[ \\t])", ""), s.group
    for look, plain in before.items():
        if rx.startswith(look):
            end = next(x for x in after if rx.endswith(x))
            inner = rx[len(look) : -len(end)]
            rx, group = f"{plain}({inner}){after[end]}", 1
    return ("(?i)" if s.flags else "") + rx, group


#: Texts (language, text) that between them hold something for every pattern.
FIXTURES = (
    ("en", "Write to mara.holt@example.org or (212) 555-0161 today."), ("en", "SSN 123-45-6789 and 123 45 6789 and 123456789 here."), ("en", "Hosts 10.0.0.30 and fe80:0:0:0:0:0:0:1 answered."),
    ("en", "Card 4111 1111 1111 1111 and IBAN GB82WEST12345698765432 used."), ("es", "Llame al +34 612 345 678 hoy, Sra. Lopez Vega viene."), ("fr", "Appelez le +33 6 12 34 56 78, Mme Durand Petit arrive."),
    ("en", "Dr. Ann Vale spoke with Tom R. for long, and Tom R.too."), ("en", "This belongs to Mr. Reed and alias Kestrel; patient Ann Vale waits."), ("en", "Mara's account and Tom R. were closed. [Kestrel] said call me Ishmael."),
    ("en", "Vincent van Gogh was born: 03/30/1853 it is said."), ("en", "On 2024-03-09 and March 9, 2024 we met."), ("en", "MAC 00:1A:2B:3C:4D:5E was seen."), ("en", "driver's license: D1234567 and DL-A1234-22 checked."),
    ("en", "passport number: X1234567, routing number: 021000021."), ("en", "license plate: ABC 1234 and tag XYZ-987 noted."), ("en", "card ending in 4242, account number: 12345678."), ("en", "national id: NID-123456789 and handle @kestrel_77 seen, username: mara.holt7"),
    ("en", "employee id: EMP-1234, also EMP-4321."), ("en", "MRN: AB-123456 on file."), ("en", "Vale Works Inc and Orbit Dynamics Systems met. Employer: Blue Harbor"), ("en", "They live at 12 Long Street and city: Porto Novo there."), ("en", "Addr: 5 Elm Row, Porto Novo CA there."),
    ("en", "Elm Row, Porto Novo, CA 94000 (near the pier) and near Lisbon too."), ("en", "Send 1BoatSLRHtKNngkdXEeobR76b53LETtpyT or bc1qar0srrr7xfkvy5l643lydnw9re59gtzzwf5mdq or 0x52908400098527886E0F7030069857D2E4169EE7."),
    ("en", "At 40.7128, -74.0060 the SWIFT code DEUTDEFF500 and VIN 1HGCM82633A004352 are."), ("en", "zip code: 94000-1234, SIN: 046 454 286, UK NI AB 12 34 56 C."), ("en", "eyJhbGciOiJIUzI1.eyJzdWIiOiIxMjM0.SflKxwRJSMeKKF2QT4"),
    ("en", "api_key = abcdefghijklmnopqrstuvwxyz0123456789 and aadhaar number: 2345 6789 0124."), ("en", "See https://example.org/a?email=x%40example.org now."), ("en", "She is aged 44, a 44-year-old."), ("en", "NPI number: 1234567893 and DEA number: AB1234563."),
    ("en", "NID123456789 and 912-34-5678 and 912 34 5678 stand here."), ("en", "+1 (212) 555-0161 and +49 30 123-4567 and +44 20 7946 0958 ring."), ("en", "DOB? A: 03/30/1953 and cvv: 123 and pin: 4321 and password: hunter22!"),
    ("en", "case no. 2:21-cv-01234 and docket: 2021-CV-1234 and state bar: 123456."), ("en", "invoice no. INV-20231 and policy number: POL-123456 and salary: $55,000 per year."),
)


def _hits_sql(source: str = "documents") -> str:
    parts = []
    for k, s in enumerate(REGISTRY):
        rx, group = _plain(s)
        text = "text" if any(ord(c) > 127 for c in rx) else "t"
        names = NOT_NAMES in s.pattern
        if names:  # what stands between two names is taken along by both of them, so it is there twice
            text = "regexp_replace(t, '([^A-Za-z])', '\\1\\1', 'g')"
        rx = rx.replace("'", "''")
        lang = f" and lang = '{s.language}'" if s.language else ""
        kept = f"not regexp_matches(x, '{NOT_FIRST}')" if names else "x <> ''"
        shown = r"replace(replace(x, '  ', ' '), '\t\t', '\t')" if names else "x"
        parts.append(f"select doc_id, {k} as spec, list_transform(list_filter(regexp_extract_all({text}, '{rx}', {group}), lambda x: {kept}), lambda x: {shown}) as m from d where regexp_matches({text}, '{rx}'){lang}")
    return f"with d as (select doc_id, lang, text, translate(text, '{FOREIGN}', '{'_' * len(FOREIGN)}') as t from {source} where text is not null), h as (" + " union all ".join(parts) + ") select doc_id, spec, len(m)::bigint as n, array_to_string(m, '|') as found from h where len(m) > 0"


@query(_hits_sql())
def pattern_hits(spark, sf_dir):
    """What each of the 82 patterns matches in each text, in order, before validators and lists."""
    return hits(D.candidates(D.document_texts(table(spark, sf_dir, "documents")), partitions=cores(spark)))


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


@query(_hits_sql("(select * from (values " + ", ".join(f"({i}, {_quoted(g)}, {_quoted(t)})" for i, (g, t) in enumerate(FIXTURES)) + ") v(doc_id, lang, text))"))
def pattern_fixtures(spark, sf_dir):
    """The same for texts that hold something for every pattern."""
    texts = spark.createDataFrame([(i, "text", g, t) for i, (g, t) in enumerate(FIXTURES)], "doc_id int, field_path string, language string, text string")
    return hits(D.candidates(texts))


def hits(candidates: DataFrame) -> DataFrame:
    g = candidates.groupBy("doc_id", "spec").agg(F.array_sort(F.collect_list(F.struct("span_start", "matched"))).alias("m"))
    return g.select("doc_id", "spec", F.size("m").cast("bigint").alias("n"), F.array_join(F.transform("m", lambda x: x["matched"]), "|").alias("found"))


@query("with r as (select conv_id * 100000 + turn as id, role, text from conversations) select id as doc_id, 'role' as field_path, role as text from r union all select id, 'text', text from r")
def payload_fields(spark, sf_dir):
    """Every string field of every message as a text of its own."""
    rows = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 100000 + F.col("turn")).alias("id"), "role", "text")
    return D.payload_texts(rows, "id").select("doc_id", "field_path", "text")
