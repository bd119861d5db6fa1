"""Named queries over the driver's tables, with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.functions import checks, lexicon
from veilspark.functions.lexicon import EXPERTS
from veilspark.operators import detect as D
from veilspark.operators import fusion, learn, link, metrics, rating, rewrite, segment, transform, vault
from veilspark.plans import pipeline
from veilspark.session import ready
from veilspark.sources import files
from veilspark.streaming import monitor

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}
KEY = "veilspark-demo-key"


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        _queries[f.__name__] = f
        if sql:
            _sql[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def cores(spark: SparkSession) -> int:
    """For tables of few files whose texts take long."""
    return spark.sparkContext.defaultParallelism


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


def r6(c) -> F.Column:
    return F.round(c, 6)


# SQL that several oracles share -----------------------------------------------------------

SPANS = """
{name}0 as (select doc_id, lang, regexp_extract_all(text, '{rx}') as m, string_split_regex(text, '{rx}') as g from documents where regexp_matches(text, '{rx}')),
{name}1 as (select doc_id, lang, unnest(range(1, len(m) + 1)) as i, m, g from {name}0),
{name} as (select doc_id, lang, cast(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) as int) as span_start, m[i] as matched from {name}1)
"""


def spans_sql(name: str, rx: str) -> str:
    return SPANS.format(name=name, rx=rx.replace("'", "''")).strip()


LUHN = "list_sum(list_transform(range(1, length({d}) + 1), lambda i: case when i % 2 = 1 then cast(reverse({d})[i] as int) else (2 * cast(reverse({d})[i] as int)) // 10 + (2 * cast(reverse({d})[i] as int)) % 10 end)) % 10 = 0"
ALL4 = {"EMAIL_ADDRESS": D.EMAIL, "IP_ADDRESS": D.IPV4, "CREDIT_CARD": D.CARD, "PHONE_NUMBER": D.PHONE}


def native_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid native findings of four types."""
    docs = table(spark, sf_dir, "documents")
    ip = D.native(docs, D.IPV4, "IP_ADDRESS", ".").filter(checks.ipv4(F.col("matched")))
    card = D.native(docs, D.CARD, "CREDIT_CARD").filter(F.length(checks.digits(F.col("matched"))).between(13, 19) & checks.luhn(checks.digits(F.col("matched"))))
    return D.native(docs, D.EMAIL, "EMAIL_ADDRESS", "@").unionByName(ip).unionByName(card).unionByName(D.native(docs, D.PHONE, "PHONE_NUMBER", "+1"))


IP_OK = "list_min(list_transform(string_split(matched, '.'), lambda x: cast(cast(x as int) <= 255 as int))) = 1"
NATIVE = (
    "with " + ", ".join(spans_sql(n, rx) for n, rx in (("em", D.EMAIL), ("ip", D.IPV4), ("cc", D.CARD), ("ph", D.PHONE))) + f""",
ccd as (select *, regexp_replace(matched, '[^0-9]', '', 'g') as d from cc),
found as (
  select doc_id, lang, 'EMAIL_ADDRESS' as entity_type, span_start, matched from em
  union all select doc_id, lang, 'IP_ADDRESS', span_start, matched from ip where {IP_OK}
  union all select doc_id, lang, 'CREDIT_CARD', span_start, matched from ccd where length(d) between 13 and 19 and {LUHN.format(d='d')}
  union all select doc_id, lang, 'PHONE_NUMBER', span_start, matched from ph)
"""
)


# detection --------------------------------------------------------------------------------


@query("with " + spans_sql("em", D.EMAIL) + " select doc_id, span_start, cast(span_start + length(matched) as int) as span_end, matched from em")
def detect_email_spans(spark, sf_dir):
    return D.native(table(spark, sf_dir, "documents"), D.EMAIL, "EMAIL_ADDRESS", "@").select("doc_id", "span_start", "span_end", "matched")


@query("with " + spans_sql("ip", D.IPV4) + f" select doc_id, span_start, matched, {IP_OK} as valid from ip")
def detect_ipv4_valid(spark, sf_dir):
    return D.native(table(spark, sf_dir, "documents"), D.IPV4, "IP_ADDRESS", ".").select("doc_id", "span_start", "matched", checks.ipv4(F.col("matched")).alias("valid"))


@query("with " + spans_sql("cc", D.CARD) + ", c as (select *, regexp_replace(matched, '[^0-9]', '', 'g') as d from cc) select doc_id, span_start, d as digits, " + LUHN.format(d="d") + " as luhn from c where length(d) between 13 and 19")
def detect_card_luhn(spark, sf_dir):
    found = D.native(table(spark, sf_dir, "documents"), D.CARD, "CREDIT_CARD").withColumn("digits", checks.digits(F.col("matched")))
    return found.filter(F.length("digits").between(13, 19)).select("doc_id", "span_start", "digits", checks.luhn(F.col("digits")).alias("luhn"))


@query("with " + spans_sql("ph", D.PHONE) + " select doc_id, span_start, matched from ph")
def detect_phone_plus1(spark, sf_dir):
    return D.native(table(spark, sf_dir, "documents"), D.PHONE, "PHONE_NUMBER", "+1").select("doc_id", "span_start", "matched")


@query(NATIVE + "select lang, entity_type, count(*) as n, count(distinct doc_id) as docs from found group by all")
def type_counts_by_lang(spark, sf_dir):
    return native_all(spark, sf_dir).groupBy("lang", "entity_type").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("docs"))


@query(NATIVE + "select d.doc_id, count(f.doc_id) as n_findings from documents d left join found f using (doc_id) group by all having count(f.doc_id) > 0")
def findings_per_document(spark, sf_dir):
    return native_all(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("n_findings"))


@query()
def detect_all_specs(spark, sf_dir):
    """All 82 patterns with validators, context and deny lists, over all texts."""
    return D.detect(D.document_texts(table(spark, sf_dir, "documents")), types=None, partitions=cores(spark))


@query()
def context_confidence(spark, sf_dir):
    """Findings of the supported types by type and confidence."""
    found = D.detect(D.document_texts(table(spark, sf_dir, "documents")), partitions=cores(spark))
    return found.groupBy("entity_type", r6("confidence").alias("confidence")).agg(F.count("*").alias("n"))


@query()
def detect_conversations(spark, sf_dir):
    """String columns unpivoted to fields, then detection."""
    rows = table(spark, sf_dir, "conversations").withColumn("id", F.col("conv_id") * 100000 + F.col("turn"))
    return D.detect(D.payload_texts(rows.select("id", "role", "text"), "id"))


@query("select n_nationkey, n_name from nation where lower(n_name) not in ('nation_1', 'nation_7', 'nation_19')")
def deny_list_anti_join(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    return n.filter(~checks.listed(F.lit("LOCATION"), F.col("n_name"), {"LOCATION": "nation_1|nation_7|nation_19"})).select("n_nationkey", "n_name")


# transforms -------------------------------------------------------------------------------


@query("select c_custkey, repeat('█', length(c_name)) as full_mask, substr(c_name, 1, 2) || repeat('█', length(c_name) - 2) as start_mask, repeat('█', length(c_name) - 2) || right(c_name, 2) as end_mask, regexp_replace(c_name, '[A-Za-z0-9]', '█', 'g') as shape_mask from customer")
def redact_modes(spark, sf_dir):
    c, x = table(spark, sf_dir, "customer"), F.col("c_name")
    return c.select("c_custkey", transform.redact(x).alias("full_mask"), transform.redact(x, "partial_start").alias("start_mask"), transform.redact(x, "partial_end").alias("end_mask"), transform.redact(x, "length_preserving").alias("shape_mask"))


@query("with " + spans_sql("em", D.EMAIL) + " select doc_id, span_start, matched[1] || '***' || matched[strpos(matched, '@'):] as masked from em")
def generalize_email(spark, sf_dir):
    return D.native(table(spark, sf_dir, "documents"), D.EMAIL, "EMAIL_ADDRESS", "@").select("doc_id", "span_start", transform.email_mask(F.col("matched")).alias("masked"))


@query("with " + spans_sql("ip", D.IPV4) + " select doc_id, span_start, array_to_string(string_split(matched, '.')[1:3], '.') || '.0/24' as subnet from ip")
def generalize_subnet(spark, sf_dir):
    return D.native(table(spark, sf_dir, "documents"), D.IPV4, "IP_ADDRESS", ".").select("doc_id", "span_start", transform.subnet(F.col("matched")).alias("subnet"))


@query("select c_custkey, cast(cast(floor(c_acctbal / 1000) * 1000 as bigint) as varchar) || '-' || cast(cast(floor(c_acctbal / 1000) * 1000 as bigint) + 999 as varchar) as band from customer")
def generalize_numeric_range(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", transform.numeric_range(F.format_string("%.2f", "c_acctbal"), 1000).alias("band"))


@query("select o_orderkey, strftime(o_orderdate, '%Y') as year from orders")
def generalize_date_year(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", transform.date_year(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("year"))


@query("select c_custkey, substr(c_name, 1, 3) || repeat('*', length(c_name) - 3) as prefix, repeat('*', length(c_name) - 4) || right(c_name, 4) as tail from customer")
def mask_prefix_and_tail(spark, sf_dir):
    x = F.col("c_name")
    return table(spark, sf_dir, "customer").select("c_custkey", transform.prefix_mask(x, 3).alias("prefix"), transform.partial_mask(x, 0, 4).alias("tail"))


@query("select p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || '.'), ' ') as initials from part")
def initials(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", transform.initials(F.col("p_name")).alias("initials"))


@query("select c_custkey, c_name[1] || repeat('*', length(c_name) - 1) as generic from customer")
def generalize_generic(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", transform.generalize(F.lit("UNKNOWN"), F.col("c_name")).alias("generic"))


def _hmac_sql(message: str, key: str = KEY) -> str:
    inner, outer = (x.hex() for x in transform._pads(key))
    return f"unhex(sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || encode({message})))))"


def _token_sql(kind: str, x: str) -> str:
    h = _hmac_sql(f"'default|v1|' || {kind} || '|' || {x}")
    return f"'<' || {kind} || ':v1:tok_' || translate(to_base64(unhex(hex({h})[1:36])), '+/', '-_') || '>'"


@query("with " + spans_sql("em", D.EMAIL) + f" select distinct matched, {_token_sql(chr(39) + 'EMAIL_ADDRESS' + chr(39), 'matched')} as token from em")
def pseudonymize_hmac_email(spark, sf_dir):
    found = D.native(table(spark, sf_dir, "documents"), D.EMAIL, "EMAIL_ADDRESS", "@").select("matched").distinct()
    return found.select("matched", transform.token(F.lit("EMAIL_ADDRESS"), F.col("matched"), KEY, F.lit("default")).alias("token"))


@query(f"with s as (select c_custkey, cast('0x' || hex({_hmac_sql(chr(39) + KEY + '|default|' + chr(39) + ' || c_name')})[1:16] as uhugeint) as seed from customer) select c_custkey, ({[*lexicon.NAMES['en'][0].split()]})[cast(seed % 32 as int) + 1] as first_name, ({[*lexicon.NAMES['en'][1].split()]})[cast((seed // 65536) % 32 as int) + 1] as last_name from s")
def synthetic_seed_name(spark, sf_dir):
    s = transform.seed(KEY, F.lit("default"), F.col("c_name"))
    full = transform.synthetic_name(F.concat(F.lit("A "), F.col("c_name")), F.lit("en"), s)
    return table(spark, sf_dir, "customer").select("c_custkey", F.split(full, " ")[0].alias("first_name"), F.split(full, " ")[1].alias("last_name"))


@query()
def synthetic_and_perturbed(spark, sf_dir):
    """The other synthetic kinds and the perturbations, on order dates and prices."""
    s = F.lit("s")
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.format_string("$%,.0f", "o_totalprice").alias("price"))
    seeds = F.struct(transform.seed(KEY, s, F.col("day")).alias("a"), transform.noise_seed(s, F.col("o_orderkey"), F.col("price")).alias("b"))
    o = o.select("*", F.explode(F.array(seeds)).alias("seed"))  # explode() keeps the hashes from being copied
    a, b, day = F.col("seed.a"), F.col("seed.b"), F.col("day")
    return o.select(
        "o_orderkey", transform.synthetic_date(day, a).alias("date"), transform.synthetic_card(a).alias("card"), transform._digit_walk(F.format_string("+1 (212) 555-%04d", F.col("o_orderkey") % 10000), b).alias("phone"),
        transform.synthetic_address(day, F.lit("fr"), a).alias("address"), transform.synthetic_zip(F.format_string("%05d-6789", F.col("o_orderkey") % 100000), a).alias("zip"), transform.synthetic_email(F.format_string("a.b%d@c.de", "o_orderkey"), F.lit("es"), a).alias("email"),
        transform.perturb_salary(F.col("price"), b).alias("salary"), transform.perturb_age((F.col("o_orderkey") % 80 + 10).cast("string"), b).alias("age"), transform.perturb_date(day, b).alias("shifted"), transform.perturb_coordinates(F.format_string("%.4f,-74.0060", F.col("o_orderkey") % 90 / 1.0), b).alias("place"),
    )


@query(NATIVE + f", t as (select distinct entity_type, matched, {_token_sql('entity_type', 'matched')} as token from found) select 'default' as scope, token, min(matched) as plaintext, min(entity_type) as entity_type, 1 as version from t group by token")
def token_vault_dedup(spark, sf_dir):
    return vault.vault(native_all(spark, sf_dir), KEY).select("scope", "token", "plaintext", "entity_type", "version")


@query(NATIVE + "select doc_id, span_start, entity_type, matched as plaintext, true as success from found")
def detokenize_join(spark, sf_dir):
    found = native_all(spark, sf_dir)
    rows = found.select("doc_id", "span_start", "entity_type", F.lit("default").alias("scope"), transform.token(F.col("entity_type"), F.col("matched"), KEY, F.lit("default")).alias("token"))
    return vault.detokenize(rows, vault.vault(found, KEY)).select("doc_id", "span_start", "entity_type", "plaintext", "success")


REDACTED = f"regexp_replace(text, '{D.EMAIL}', '[EMAIL]', 'g')"


@query(f"select doc_id, {REDACTED} as text, len(regexp_extract_all(text, '{D.EMAIL}')) as n_findings from documents where text is not null")
def redact_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").filter("text is not null")
    found = D.native(docs, D.EMAIL, "EMAIL_ADDRESS", "@").withColumns({"field_path": F.lit("text"), "confidence": F.lit(0.99)})
    out = rewrite.transform_texts(docs.select("doc_id", F.lit("text").alias("field_path"), "text"), found, lambda t, x, i: F.lit("[EMAIL]"))
    return out.select("doc_id", "text", F.col("n_findings").cast("bigint").alias("n_findings"))


@query("select doc_id, text from documents where text is not null")
def token_round_trip(spark, sf_dir):
    """Texts with emails tokenised, then restored from the vault."""
    docs = table(spark, sf_dir, "documents").filter("text is not null")
    found = D.native(docs, D.EMAIL, "EMAIL_ADDRESS", "@").withColumns({"field_path": F.lit("text"), "confidence": F.lit(0.99)})
    hidden = rewrite.transform_texts(docs.select("doc_id", F.lit("text").alias("field_path"), "text"), found, lambda t, x, i: transform.token(t, x, KEY, F.lit("default")))
    return vault.detokenize_texts(hidden, vault.vault(found, KEY)).select("doc_id", "text")


@query("select p_type as entity_type, case when p_type in ('ECONOMY', 'STANDARD') then 'redact' when p_type = 'PROMO' then 'tokenize' else 'none' end as strategy, count(*) as n from part group by all")
def policy_rule_join(spark, sf_dir):
    kind = F.col("p_type")
    rules = {"ECONOMY": "redact", "STANDARD": "redact", "PROMO": "tokenize"}
    return table(spark, sf_dir, "part").groupBy(kind.alias("entity_type"), transform.strategy_of(kind, rules).alias("strategy")).agg(F.count("*").alias("n"))


@query()
def deidentify_documents(spark, sf_dir):
    """Detection of all supported types and the policy of the Safe Harbor rules."""
    out, _ = pipeline.deidentify(D.document_texts(table(spark, sf_dir, "documents")), pipeline.Profile(mode="redact", rules=transform.policy("hipaa_safe_harbor")))
    return out


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detect four types natively, resolve overlaps, tokenise."""
    docs = table(spark, sf_dir, "documents")
    found = native_all(spark, sf_dir).withColumns({"field_path": F.lit("text"), "confidence": F.lit(0.9)})
    out = rewrite.transform_texts(docs.select("doc_id", F.lit("text").alias("field_path"), "text"), found, lambda t, x, i: transform.token(t, x, KEY, F.lit("default")))
    return out.join(docs.select("doc_id", "lang"), "doc_id").select("doc_id", "lang", "n_findings", F.col("text").alias("redacted_text"))


@query()
def flagship_tokenized(spark, sf_dir):
    return flagship(spark, sf_dir)


@query()
def link_entities(spark, sf_dir):
    """Findings resolved, then linked within their documents."""
    found = D.detect(D.document_texts(table(spark, sf_dir, "documents")), partitions=cores(spark))
    kept = rewrite.collected(found).select("doc_id", F.explode("spans").alias("x")).select("doc_id", "x.entity_type", F.col("x.s").alias("span_start"), F.col("x.e").alias("span_end"), "x.matched")
    return link.link(kept)


@query("with f as (select distinct c_nationkey, c_mktsegment from customer) select c_nationkey, c_mktsegment, dense_rank() over (partition by c_nationkey order by c_mktsegment) as idx, '<SEG:anon_' || dense_rank() over (partition by c_nationkey order by c_mktsegment) || '>' as placeholder from f")
def placeholder_dense_index(spark, sf_dir):
    return transform.indexed(table(spark, sf_dir, "customer"), "c_nationkey", "c_mktsegment", F.lit("SEG"))


# segmentation -----------------------------------------------------------------------------


@query("select doc_id, length(text) - length(replace(replace(replace(text, ' ', ''), chr(10), ''), chr(9), '')) + 1 as tokens from documents where text is not null")
def token_count_estimate(spark, sf_dir):
    return table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", segment.token_estimate(F.col("text")).cast("bigint").alias("tokens"))


WORDS = "len(list_filter(string_split_regex(text, '[ \\t\\n\\r\\x0B\\f]+'), lambda w: w <> ''))"


@query(f"with t as (select lang, {WORDS} as n from documents where text is not null) select lang, case when n < 100 then 'short' when n < 1000 then 'medium' when n < 10000 then 'long' else 'very_long' end as tier, count(*) as docs from t group by all")
def context_length_tier(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").filter("text is not null")
    return docs.groupBy("lang", segment.context_tier(F.col("text")).alias("tier")).agg(F.count("*").alias("docs"))


@query(f"with t as (select doc_id, {WORDS} as n from documents where text is not null), s as (select doc_id, n, unnest(range(0, case when n <= 200 then 1 else 1 + cast(ceil((n - 200) / 180.0) as bigint) end)) as segment from t where n > 0) select doc_id, cast(segment as int) as segment, cast(segment * 180 as int) as token_start, cast(least(segment * 180 + 200, n) - 1 as int) as token_end from s")
def segment_bounds(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").filter("text is not null")
    return segment.segments(docs, 200, 20).select("doc_id", "segment", "token_start", "token_end")


# findings made of events: several engines over the same spans -----------------------------

FINDINGS = """f as (select user_id as doc_id, 'text' as field_path, case when event_id % 3 = 0 then 'EMAIL_ADDRESS' when event_id % 3 = 1 then 'PERSON_NAME' else 'US_SSN' end as entity_type, 'en' as language,
  cast(event_id % 20 * 10 as int) as span_start, cast(event_id % 20 * 10 + 5 as int) as span_end, event_id % 9 / 10.0::double + 0.1 as confidence, event_type as engine_id from events)"""


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    i = F.col("event_id")
    return e.select(
        F.col("user_id").alias("doc_id"), F.lit("text").alias("field_path"), F.when(i % 3 == 0, "EMAIL_ADDRESS").when(i % 3 == 1, "PERSON_NAME").otherwise("US_SSN").alias("entity_type"), F.lit("en").alias("language"),
        (i % 20 * 10).cast("int").alias("span_start"), (i % 20 * 10 + 5).cast("int").alias("span_end"), (i % 9 / F.lit(10.0) + 0.1).alias("confidence"), F.col("event_type").alias("engine_id"), i.alias("ordinal"),
    )


KEYS = "doc_id, entity_type, span_start, span_end"
ENGINES = "array_to_string(list_sort(list(distinct engine_id)), ',') as engines"


@query(f"with {FINDINGS} select {KEYS}, round(max(confidence), 6) as confidence, {ENGINES}, count(*) as n_merged from f group by {KEYS}")
def reconcile_dedup(spark, sf_dir):
    return segment.reconciled(findings(spark, sf_dir)).select(*KEYS.split(", "), r6("confidence").alias("confidence"), F.array_join("engines", ",").alias("engines"), "n_merged")


@query(f"with {FINDINGS} select {KEYS}, round(confidence, 6) as confidence, engine_id as engines from f")
def fusion_union(spark, sf_dir):
    return fusion.union(findings(spark, sf_dir)).select(*KEYS.split(", "), r6("confidence").alias("confidence"), F.array_join("engines", ",").alias("engines"))


@query(f"with {FINDINGS} select {KEYS}, round(min(confidence), 6) as confidence, {ENGINES} from f group by {KEYS} having count(distinct engine_id) >= 2")
def fusion_intersection(spark, sf_dir):
    return fusion.intersection(findings(spark, sf_dir)).select(*KEYS.split(", "), r6("confidence").alias("confidence"), F.array_join("engines", ",").alias("engines"))


@query(f"with {FINDINGS} select {KEYS}, round(avg(confidence), 6) as confidence, {ENGINES} from f group by {KEYS}")
def fusion_weighted(spark, sf_dir):
    """Spans of these findings are equal or ten apart, so a cluster is a span."""
    return fusion.weighted(findings(spark, sf_dir)).select(*KEYS.split(", "), r6("confidence").alias("confidence"), F.array_join("engines", ",").alias("engines"))


@query(f"with {FINDINGS} select {KEYS}, round(avg(confidence), 6) as confidence from f group by {KEYS} having count(distinct engine_id) >= 3")
def fusion_majority(spark, sf_dir):
    return fusion.majority(findings(spark, sf_dir), 3).select(*KEYS.split(", "), r6("confidence").alias("confidence"))


@query(
    "with e(expert_id, entity_type, strength) as (values " + ", ".join(f"('{a}', '{b}', {c}::double)" for a, b, c in EXPERTS) + "), r as (select *, row_number() over (partition by entity_type order by strength desc, expert_id) as n from e qualify n <= 3) select entity_type, expert_id, round(exp(strength) / sum(exp(strength)) over (partition by entity_type), 6) as weight from r"
)
def moe_topk_softmax(spark, sf_dir):
    return fusion.routes(spark.createDataFrame(EXPERTS, "expert_id string, entity_type string, strength double")).withColumn("weight", r6("weight"))


@query()
def fusion_experts(spark, sf_dir):
    names = {"click": "regex-oss", "view": "gliner-compatible", "purchase": "presidio-compatible"}
    f = findings(spark, sf_dir).replace(names, subset=["engine_id"])
    return fusion.experts_fusion(f, EXPERTS)


@query()
def fusion_swarm(spark, sf_dir):
    return fusion.swarm(findings(spark, sf_dir), fast_engine="click", structured=("US_SSN", "EMAIL_ADDRESS"), semantic=("PERSON_NAME",))


@query(f"with {FINDINGS} select doc_id, count(*) as n_findings, round(avg(confidence), 6) as score, case when avg(confidence) >= 0.9 then 'low' when avg(confidence) >= 0.75 then 'moderate' else 'high' end as risk from f group by doc_id")
def confidence_envelope(spark, sf_dir):
    return fusion.envelope(findings(spark, sf_dir)).withColumn("score", r6("score"))


@query(f"with {FINDINGS}, m as (select {KEYS}, min(confidence) as c from f group by {KEYS} having count(distinct engine_id) >= 2) select {KEYS}, count(*) as n_sources from m join f using (doc_id, entity_type, span_start, span_end) group by {KEYS}")
def fusion_audit(spark, sf_dir):
    f = findings(spark, sf_dir)
    return fusion.audit(fusion.intersection(f), f).select(*KEYS.split(", "), "n_sources")


@query(f"with {FINDINGS}, n as (select span_start, engine_id, count(*) as n from f group by all), r as (select *, row_number() over (partition by span_start order by n desc, engine_id) as k, n / sum(n) over (partition by span_start) as share from n) select span_start as item_id, engine_id as label, round(share, 6) as share from r where k = 1")
def majority_vote(spark, sf_dir):
    f = findings(spark, sf_dir).select(F.col("span_start").alias("item_id"), F.col("engine_id").alias("label"), F.col("doc_id").alias("engine_id"))
    return learn.majority_vote(f).withColumn("share", r6("share"))


@query()
def dawid_skene_em(spark, sf_dir):
    """Labels of span types by events' engines."""
    f = findings(spark, sf_dir).select(F.concat_ws("-", "doc_id", "span_start").alias("item_id"), F.col("engine_id"), F.col("entity_type").alias("label"))
    return learn.dawid_skene(f, 3)[0].withColumn("posterior", r6("posterior"))


@query(f"with {FINDINGS} select engine_id, case when count(*) < 2 then 0.1 else round(least(1.0, greatest(0.1, 5 * stddev_pop(confidence))), 6) end as informativeness from f group by engine_id")
def engine_informativeness(spark, sf_dir):
    return learn.informativeness(findings(spark, sf_dir)).withColumn("informativeness", r6("informativeness"))


# metrics ----------------------------------------------------------------------------------

GOLD = "gold as (select event_id % 500 as record_id, event_type as entity_type, cast(event_id % 40 * 10 as int) as start, cast(event_id % 40 * 10 + 6 as int) as \"end\" from events where event_id % 4 <> 1)"
PRED = "pred as (select event_id % 500 as record_id, case when event_id % 11 = 0 then 'error' else event_type end as entity_type, cast(event_id % 40 * 10 + case when event_id % 7 = 0 then 1 else 0 end as int) as start, cast(event_id % 40 * 10 + 6 as int) as \"end\" from events where event_id % 4 <> 2)"


def gold_and_predicted(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e, i = table(spark, sf_dir, "events"), F.col("event_id")
    span = lambda kind, shift: [(i % 500).alias("record_id"), kind.alias("entity_type"), (i % 40 * 10 + shift).cast("int").alias("start"), (i % 40 * 10 + 6).cast("int").alias("end")]
    gold = e.filter(i % 4 != 1).select(*span(F.col("event_type"), F.lit(0)))
    predicted = e.filter(i % 4 != 2).select(*span(F.when(i % 11 == 0, "error").otherwise(F.col("event_type")), F.when(i % 7 == 0, 1).otherwise(0)))
    return predicted, gold


def _prf_sql(beta2: int = 1) -> str:
    return "round(case when predicted > 0 then tp / predicted::double else 0 end, 6) as precision, round(case when gold > 0 then tp / gold::double else 0 end, 6) as recall, round(case when predicted + gold > 0 then 2 * tp / (predicted + gold)::double else 0 end, 6) as f1"


def _counts_sql(keys: str, by: str = "") -> str:
    g = f"group by {by}" if by else ""
    sel = f"{by}, " if by else ""
    return f"{GOLD}, {PRED}, p as (select {keys}, count(*) as p from pred group by all), g as (select {keys}, count(*) as g from gold group by all), c as (select {sel}sum(least(coalesce(p, 0), coalesce(g, 0)))::bigint as tp, sum(coalesce(p, 0))::bigint as predicted, sum(coalesce(g, 0))::bigint as gold from p full join g using ({keys}) {g})"


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: r6(c) for c in ("precision", "recall", "f1")})


@query(f'with {_counts_sql("record_id, entity_type, start, " + chr(34) + "end" + chr(34), "entity_type")} select entity_type, tp, predicted, gold, {_prf_sql()} from c')
def span_prf_strict(spark, sf_dir):
    return _rounded(metrics.span_scores(*gold_and_predicted(spark, sf_dir), "strict", ["entity_type"]))


@query(f'with {_counts_sql("record_id, start, " + chr(34) + "end" + chr(34))} select tp, predicted, gold, {_prf_sql()} from c')
def span_prf_exact(spark, sf_dir):
    return _rounded(metrics.span_scores(*gold_and_predicted(spark, sf_dir), "exact"))


@query(f'with {_counts_sql("entity_type, start, " + chr(34) + "end" + chr(34))} select tp, predicted, gold, {_prf_sql()} from c')
def span_prf_pooled(spark, sf_dir):
    return _rounded(metrics.span_scores(*gold_and_predicted(spark, sf_dir), "strict", pooled=True))


WALK = f"""with recursive {GOLD}, {PRED}, p as (select *, row_number() over (partition by record_id order by start, "end", entity_type) as i from pred where entity_type in (select entity_type from gold)),
g as (select *, row_number() over (partition by record_id order by start, "end", entity_type) as j from gold),
o as (select record_id, entity_type, i, j, least(p."end", g."end") - greatest(p.start, g.start) as o, p."end" - p.start + g."end" - g.start as s from p join g using (record_id, entity_type)),
n as (select *, row_number() over (partition by record_id, entity_type order by o / (s - o)::double desc, i, j) as k from o where o > 0 and o / (s - o)::double >= 0.5),
m as (select record_id, entity_type, max(k) as last from n group by all),
w as (select record_id, entity_type, 0::bigint as k, []::bigint[] as pi, []::bigint[] as gj from m
  union all select w.record_id, w.entity_type, n.k, case when list_contains(pi, n.i) or list_contains(gj, n.j) then pi else list_append(pi, n.i) end, case when list_contains(pi, n.i) or list_contains(gj, n.j) then gj else list_append(gj, n.j) end
  from w join n on n.record_id = w.record_id and n.entity_type = w.entity_type and n.k = w.k + 1),
t as (select entity_type, sum(len(pi))::bigint as tp from w join m using (record_id, entity_type) where k = last group by 1),
c as (select entity_type, coalesce(tp, 0) as tp, coalesce(a.n, 0) as predicted, coalesce(b.n, 0) as gold from (select entity_type, count(*) as n from p group by 1) a full join (select entity_type, count(*) as n from gold group by 1) b using (entity_type) left join t using (entity_type))"""


@query(f"{WALK} select entity_type, tp, predicted, gold, {_prf_sql()} from c")
def iou_greedy_match(spark, sf_dir):
    return _rounded(metrics.overlap_scores(*gold_and_predicted(spark, sf_dir)))


CHARS = 'select distinct record_id, entity_type, unnest(range(start, "end")) as pos from'


@query(f"with {GOLD}, {PRED}, gc as ({CHARS} gold), pc as ({CHARS} pred), c as (select (select count(*) from gc join pc using (record_id, entity_type, pos)) as tp, (select count(*) from pc) as predicted, (select count(*) from gc) as gold) select tp, predicted, gold, {_prf_sql()} from c")
def char_level_f1(spark, sf_dir):
    return _rounded(metrics.char_scores(*gold_and_predicted(spark, sf_dir)))


@query(
    f'with {_counts_sql("record_id, entity_type, start, " + chr(34) + "end" + chr(34), "entity_type")}, s as (select *, tp / predicted::double as p, tp / gold::double as r, 2 * tp / (predicted + gold)::double as f from c), m as (select sum(tp) as tp, sum(predicted) as n, sum(gold) as g from s) '
    "select 'micro' as average, round(tp / n::double, 6) as precision, round(tp / g::double, 6) as recall, round(2 * tp / (n + g)::double, 6) as f1 from m union all select 'macro', round(avg(p), 6), round(avg(r), 6), round(avg(f), 6) from s union all select 'weighted', round(sum(p * gold) / sum(gold), 6), round(sum(r * gold) / sum(gold), 6), round(sum(f * gold) / sum(gold), 6) from s"
)
def metric_averages(spark, sf_dir):
    return _rounded(metrics.averages(metrics.span_scores(*gold_and_predicted(spark, sf_dir), "strict", ["entity_type"])))


@query("with c as (select o_orderstatus, o_orderpriority, count(*) filter (o_orderkey % 3 = 0) as tp, count(*) filter (o_orderkey % 2 = 0) + count(*) filter (o_orderkey % 3 = 0) as predicted, count(*) as gold from orders group by all), g as (select case when grouping(o_orderstatus) = 0 then 'o_orderstatus' when grouping(o_orderpriority) = 0 then 'o_orderpriority' else 'overall' end as dimension, coalesce(o_orderstatus, o_orderpriority, 'all') as value, sum(tp)::bigint as tp, sum(predicted)::bigint as predicted, sum(gold)::bigint as gold from c group by grouping sets ((o_orderstatus), (o_orderpriority), ())) select dimension, value, tp, predicted, gold, " + _prf_sql() + " from g")
def breakdown_grouping_sets(spark, sf_dir):
    k = F.col("o_orderkey")
    c = table(spark, sf_dir, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count_if(k % 3 == 0).alias("tp"), (F.count_if(k % 2 == 0) + F.count_if(k % 3 == 0)).alias("predicted"), F.count("*").alias("gold"))
    return _rounded(metrics.breakdown(c, ["o_orderstatus", "o_orderpriority"]))


@query("with g as (select lang, avg(quality) as f1 from documents join labels using (doc_id) group by lang) select round(max(f1) - min(f1), 6) as max_gap, round(quantile_cont(f1, 0.1), 6) as p10, round(quantile_cont(f1, 0.9), 6) as p90, round(stddev_pop(f1), 6) as spread, count(*) filter (f1 < 0.7) as below_floor from g")
def fairness_gap(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id")
    f = metrics.fairness(d.groupBy("lang").agg(F.avg("quality").alias("f1")))
    return f.select(*[r6(c).alias(c) for c in ("max_gap", "p10", "p90", "spread")], "below_floor")


@query("with g as (select c_nationkey, c_mktsegment, count(*) as n from customer group by all) select min(n) as k from g")
def k_anonymity(spark, sf_dir):
    return metrics.k_anonymity(table(spark, sf_dir, "customer"), ["c_nationkey", "c_mktsegment"])


SHARES = "n as (select c_nationkey, c_mktsegment, count(*) as n from customer group by all), s as (select *, n / sum(n) over (partition by c_nationkey)::double as p from n)"


@query(f"with {SHARES}, h as (select c_nationkey, -sum(p * log2(p)) as h from s group by 1) select round(min(h), 6) as l from h")
def l_diversity(spark, sf_dir):
    return metrics.l_diversity(table(spark, sf_dir, "customer"), ["c_nationkey"], "c_mktsegment").select(r6("l").alias("l"))


@query(f"with {SHARES}, q as (select c_mktsegment, count(*) / (select count(*) from customer)::double as q from customer group by 1), d as (select k.c_nationkey, sum(abs(coalesce(p, 0) - q)) / 2 as d from (select distinct c_nationkey from customer) k cross join q left join s on s.c_nationkey = k.c_nationkey and s.c_mktsegment = q.c_mktsegment group by 1) select round(max(d), 6) as t from d")
def t_closeness(spark, sf_dir):
    return metrics.t_closeness(table(spark, sf_dir, "customer"), ["c_nationkey"], "c_mktsegment").select(r6("t").alias("t"))


@query("select p_partkey, list_max(list_transform(range(1, length(p_brand) - 2), lambda i: cast(contains(p_name || p_brand[2:6], p_brand[i:i+3]) as int))) = 1 as leaked, contains(lower(p_name), lower(p_brand)) as exposed from part")
def leakage_4gram(spark, sf_dir):
    out = F.concat("p_name", F.substring("p_brand", 2, 5))
    return table(spark, sf_dir, "part").select("p_partkey", metrics.fragment_leaked(out, F.col("p_brand")).alias("leaked"), F.lower("p_name").contains(F.lower("p_brand")).alias("exposed"))


@query("select count(*) as n, count(*) filter (contains(lower(p_name), lower(string_split(p_type, 'O')[1]))) as exposed, round(count(*) filter (contains(lower(p_name), lower(string_split(p_type, 'O')[1]))) / count(*)::double, 6) as risk from part")
def reidentification_risk(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_name").alias("output"), F.split("p_type", "O")[0].alias("surface"))
    return metrics.reidentification_risk(p).withColumn("risk", r6("risk"))


GRAMS = "select {k} as id, {t} as text, unnest(list_distinct(list_transform(range(1, length({t}) - 3), lambda i: {t}[i:i+4]))) as g from {f}"


@query("with l as (select p_partkey as id, p_name as text from part where p_partkey % 2 = 0), a as (" + GRAMS.format(k="n_nationkey", t="n_name", f="nation") + "), b as (" + GRAMS.format(k="s_suppkey", t="n_name", f="(select s_suppkey, 'NATION_' || s_nationkey as n_name from supplier)") + "), na as (select id, count(*) as n from a group by 1), nb as (select id, count(*) as n from b group by 1), c as (select a.id as l, b.id as r, count(*) as c from a join b using (g) group by 1, 2) select l, r, round(c / (na.n + nb.n - c)::double, 6) as jaccard from c join na on l = na.id join nb on r = nb.id where c / (na.n + nb.n - c)::double > 0.3")
def ngram_jaccard_linkage(spark, sf_dir):
    left = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("text"))
    right = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.concat(F.lit("NATION_"), F.col("s_nationkey")).alias("text"))
    return metrics.ngram_linkage(left, right).withColumn("jaccard", r6("jaccard"))


@query(NATIVE + "select d.doc_id, round(least(1.0, sum(length(matched)) / n_chars::double), 6) as loss from found f join documents d using (doc_id) group by d.doc_id, n_chars")
def info_loss(spark, sf_dir):
    removed = native_all(spark, sf_dir).groupBy("doc_id").agg(F.sum(F.length("matched")).alias("removed"))
    return metrics.information_loss(removed.join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")).withColumn("loss", r6("loss"))


CONF = "c as (select (n_chars % 97) / 97.0::double as confidence, quality = 1 as correct, toxic, quality from documents join labels using (doc_id))"


def _confidences(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")
    return d.select((F.col("n_chars") % 97 / F.lit(97.0)).alias("confidence"), (F.col("quality") == 1).alias("correct"), "toxic", "quality")


BINS = "b as (select cast(least(floor(confidence * 15), 14) as int) as bin, count(*) as n, avg(confidence) as confidence, avg(correct::int) as accuracy from c group by 1)"


@query(f"with {CONF}, {BINS} select bin, n, round(confidence, 6) as confidence, round(accuracy, 6) as accuracy, round(abs(confidence - accuracy), 6) as gap from b")
def ece_bins(spark, sf_dir):
    return metrics.calibration_bins(_confidences(spark, sf_dir)).select("bin", "n", *[r6(c).alias(c) for c in ("confidence", "accuracy", "gap")])


@query(f"with {CONF}, {BINS} select round(sum(n * abs(confidence - accuracy)) / sum(n), 6) as ece, round(max(abs(confidence - accuracy)), 6) as mce, sum(n)::bigint as n from b")
def ece_mce(spark, sf_dir):
    return metrics.calibration(_confidences(spark, sf_dir)).select(r6("ece").alias("ece"), r6("mce").alias("mce"), "n")


TEMPERED = "1 / (1 + exp(-ln(greatest(1e-7, least(1 - 1e-7, confidence)) / (1 - greatest(1e-7, least(1 - 1e-7, confidence)))) / t))"


@query(f"with {CONF}, g as (select round(0.5 + 0.1 * k, 1)::double as t from (select unnest(range(0, 26)) as k)), p as (select t, {TEMPERED} as p, correct from c, g where confidence > 0), b as (select t, least(floor(p * 15), 14) as bin, count(*) as n, abs(avg(p) - avg(correct::int)) as gap from p group by all), e as (select t, sum(n * gap) / sum(n) as ece from b group by t) select round(t, 6) as temperature, round(ece, 6) as ece from e order by ece, t limit 1")
def optimal_temperature(spark, sf_dir):
    return metrics.best_temperature(_confidences(spark, sf_dir).filter("confidence > 0")).select(r6("temperature").alias("temperature"), r6("ece").alias("ece"))


@query("with n as (select quality as a, toxic as b, count(*)::double as n from labels group by all), t as (select sum(n) as t, sum(case when a = b then n else 0 end) as s from n), x as (select sum(ra.n * rb.n) as x from (select a as v, sum(n) as n from n group by 1) ra join (select b as v, sum(n) as n from n group by 1) rb using (v)) select round((s / t - x / (t * t)) / (1 - x / (t * t)), 6) as kappa from t, x")
def cohens_kappa(spark, sf_dir):
    return metrics.cohens_kappa(table(spark, sf_dir, "labels").select(F.col("quality").alias("a"), F.col("toxic").alias("b"))).select(r6("kappa").alias("kappa"))


@query("with s as (select avg(value) filter (event_type = 'click') as ma, avg(value) filter (event_type = 'view') as mb, var_samp(value) filter (event_type = 'click') as va, var_samp(value) filter (event_type = 'view') as vb, count(*) filter (event_type = 'click') as na, count(*) filter (event_type = 'view') as nb from events) select round((ma - mb) / sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2)), 6) as d from s")
def cohens_d(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.when(F.col("event_type") == "click", "a").when(F.col("event_type") == "view", "b").alias("group"), "value")
    return metrics.cohens_d(e).select(r6("d").alias("d"))


@query(f"with {CONF}, t as (select unnest(range(0, 21)) as k), s as (select round(0.3 + 0.02 * k, 6) as threshold, count(*) filter (confidence >= round(0.3 + 0.02 * k, 6) and correct) as tp, count(*) filter (confidence >= round(0.3 + 0.02 * k, 6) and not correct) as fp, count(*) filter (confidence < round(0.3 + 0.02 * k, 6) and correct) as fn from t, c group by k) select cast(threshold as double) as threshold, tp, fp, fn, round(5 * tp / (5 * tp + 4 * fn + fp)::double, 6) as score from s")
def f2_threshold_sweep(spark, sf_dir):
    return metrics.threshold_sweep(_confidences(spark, sf_dir).select(F.col("confidence").alias("score"), F.col("correct").alias("positive"))).withColumn("score", r6("score"))


SYSTEMS = "s as (select s_suppkey as system, (s_suppkey % 17) / 17.0::double as precision, (s_suppkey % 13) / 13.0::double as recall, (s_suppkey % 29 + 1)::double as latency_ms, (abs(s_acctbal) * 100)::double as docs_per_hour from supplier), f as (select *, case when precision + recall > 0 then 2 * precision * recall / (precision + recall) else 0 end as f1 from s), c as (select system, f1, precision, recall, latency_ms, docs_per_hour, (0.5 * f1 + 0.15 * precision + 0.15 * recall + 0.1 / (1 + (latency_ms / 100) * (latency_ms / 100)) + 0.1 * docs_per_hour / (docs_per_hour + 1000000)) as score from f)"


def systems(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    s = table(spark, sf_dir, "supplier").select(k.alias("system"), (k % 17 / F.lit(17.0)).alias("precision"), (k % 13 / F.lit(13.0)).alias("recall"), (k % 29 + 1).cast("double").alias("latency_ms"), (F.abs("s_acctbal") * 100).alias("docs_per_hour"))
    return s.withColumn("f1", metrics.f_beta(F.col("precision"), F.col("recall")))


@query(f"with {SYSTEMS} select system, round(score, 6) as score, round(case when f1 < 0.3 or precision < 0.2 then least(score, 0.4) else score end, 6) as capped from c")
def composite_score(spark, sf_dir):
    score = rating.composite()
    return systems(spark, sf_dir).select("system", r6(score).alias("score"), r6(rating.floor_gates(score, {"f1": 0.3, "precision": 0.2})[0]).alias("capped"))


@query(f"with {SYSTEMS} select a.system from s a where not exists (select 1 from s b where b.precision >= a.precision and b.recall >= a.recall and (b.precision > a.precision or b.recall > a.recall))")
def pareto_frontier(spark, sf_dir):
    return rating.pareto(systems(spark, sf_dir), "precision", "recall").select("system")


@query()
def elo_fold(spark, sf_dir):
    s = systems(spark, sf_dir).withColumn("composite", rating.composite())
    return rating.elo_ratings(s.select(F.format_string("%03d", "system").alias("system"), "composite"))


@query(f"with {SYSTEMS} select system, row_number() over (order by score desc, system) as rank from c")
def leaderboard_rank(spark, sf_dir):
    s = systems(spark, sf_dir).withColumn("composite", rating.composite())
    return rating.leaderboard(s).select("system", F.col("rank").cast("bigint").alias("rank"))


_COVERED = sorted({lexicon.ALIASES.get(t, t) for t in D.SUPPORTED})


@query("with r(standard, entity_type) as (values " + ", ".join(f"('{s}', '{t}')" for s, ts in rating.STANDARDS.items() for t in ts.split()) + ") select standard, count(*) as required, count(*) filter (entity_type in (" + ", ".join(f"'{t}'" for t in _COVERED) + ")) as covered, array_to_string(list_sort(coalesce(list(entity_type) filter (entity_type not in (" + ", ".join(f"'{t}'" for t in _COVERED) + ")), [])), ',') as missing from r group by 1")
def compliance_gap(spark, sf_dir):
    have = spark.createDataFrame([(t,) for t in _COVERED], "entity_type string")
    return rating.compliance(spark, have).select("standard", "required", "covered", F.array_join("missing", ",").alias("missing"))


@query("with n as (select source, lang, count(*) as n from documents group by all) select source, lang, n, n < 10 as gap from n")
def coverage_gaps(spark, sf_dir):
    return metrics.coverage(table(spark, sf_dir, "documents"), ["source", "lang"])


@query("with c as (select c_mktsegment, greatest(1, floor(count(*) * 100 / (select count(*) from customer)::double)) as share from customer group by 1), r as (select c_custkey, c_mktsegment, row_number() over (partition by c_mktsegment order by md5(c_custkey || ':42'), c_custkey) as n from customer) select c_custkey, c_mktsegment from r join c using (c_mktsegment) where n <= share")
def stratified_sample_hash(spark, sf_dir):
    return learn.stratified_sample(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", 100, "c_custkey")


@query("select lang, count(*) as docs, round(avg(n_chars), 6) as mean, median(n_chars) as median, min(n_chars) as least, max(n_chars) as most, count(distinct source) as sources from documents group by lang")
def dataset_stats_median(spark, sf_dir):
    return metrics.length_statistics(table(spark, sf_dir, "documents"), "lang", "n_chars", "source").withColumn("mean", r6("mean"))


@query("select event_id, round(avg(value) over (partition by event_type order by event_id rows 9 preceding), 8) as mean_10, round(avg(value) over (partition by event_type order by event_id rows 99 preceding), 8) as mean_100 from events")
def rolling_window_mean(spark, sf_dir):
    e = monitor.rolling(table(spark, sf_dir, "events"), "value", "event_type", "event_id", (10, 100))
    return e.select("event_id", F.round("mean_10", 8).alias("mean_10"), F.round("mean_100", 8).alias("mean_100"))


@query("with m as (select *, avg(value) over (partition by event_type) as m, stddev_pop(value) over (partition by event_type) as s from events), r as (select *, sum(value - m) over (partition by event_type order by event_id) as c from m), g as (select event_type, count(*) as n, min(s) as s, greatest(max(c), 0) - least(min(c), 0) as reach from r group by 1) select event_type, n, round(reach, 3) as reach, case when n < 30 then 'none' when reach / s > 5 * s then 'critical' when reach / s > 3 * s then 'warning' else 'none' end as level from g")
def cusum_range(spark, sf_dir):
    return monitor.drift(table(spark, sf_dir, "events"), "value", "event_type", "event_id").select("event_type", "n", F.round("reach", 3).alias("reach"), "level")


@query("select event_type, count(*) as n, count(*) < 10 as gap from events group by 1")
def coverage_monitor_counts(spark, sf_dir):
    return monitor.coverage(table(spark, sf_dir, "events"), "event_type")


@query("with c as (select conv_id, list(length(text)::double order by turn) as a from conversations where text is not null group by 1) select conv_id, round(list_reduce(a, lambda s, x: 0.05 * x + 0.95 * s), 6) as ewma from c")
def ewma(spark, sf_dir):
    """Moving average of each conversation's text lengths, in order of the turns."""
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.length("text").alias("n")))).alias("a"))
    return c.select("conv_id", r6(monitor.ewma_fold(F.col("a.n"))).alias("ewma"))


HALF = "cast(greatest(1, length(text) // 2) as int)"


@query(f"select item_id, text[1:{HALF}] as text, 'split-a' as disturbance from benchmark union all select item_id, text[{HALF} + 1:], 'split-b' from benchmark")
def stream_disturbance_split(spark, sf_dir):
    return monitor.disturbed(table(spark, sf_dir, "benchmark"), "split")


@query("select item_id, text, cast(null as varchar) as disturbance from benchmark union all select item_id, text, 'duplicate' from benchmark")
def stream_disturbance_duplicate(spark, sf_dir):
    return monitor.disturbed(table(spark, sf_dir, "benchmark"), "duplicate")


@query(f"select item_id, text[1:{HALF}] as text, 'truncate' as disturbance from benchmark")
def stream_disturbance_truncate(spark, sf_dir):
    return monitor.disturbed(table(spark, sf_dir, "benchmark"), "truncate")


@query("with c as (select label, embedding from embeddings where vec_id in (select min(vec_id) from embeddings group by label)) select e.vec_id, round(max(list_cosine_similarity(e.embedding::double[], c.embedding::double[])), 4) as similarity from embeddings e join c using (label) group by 1")
def cosine_expert_similarity(spark, sf_dir):
    """Each vector against the first of its label."""
    e = table(spark, sf_dir, "embeddings")
    first = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("other"))
    return e.join(first, "label").select("vec_id", F.round(learn.cosine(F.col("embedding"), F.col("other")), 4).alias("similarity"))


@query(f"with {GOLD}, {PRED}, g as (select row_number() over () as k, * from gold), b as (select k, max(struct_pack(i := o / (g.\"end\" - g.start + p.\"end\" - p.start - o)::double, same := p.entity_type = g.entity_type)) as b from (select g.k, g.start, g.\"end\", g.entity_type, least(g.\"end\", p.\"end\") - greatest(g.start, p.start) as o, p from g join pred p using (record_id) where p.start < g.\"end\" and g.start < p.\"end\") g group by k) select entity_type, case when b.b is null then 'complete_miss' when not b.b.same then 'type_confusion' when b.b.i < 1 then 'boundary_miss' else 'hit' end as outcome, count(*) as n from g left join b using (k) group by all")
def error_taxonomy(spark, sf_dir):
    return metrics.error_taxonomy(*gold_and_predicted(spark, sf_dir))


@query("with s as (select c_nationkey, c_mktsegment, avg(c_acctbal) as v from customer group by all) select c_mktsegment, max_by(c_nationkey, v) as best, round(max(v), 4) as score, min_by(c_nationkey, v) as worst from s group by 1")
def head_to_head_max_by(spark, sf_dir):
    s = table(spark, sf_dir, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.avg("c_acctbal").alias("v"))
    return metrics.head_to_head(s, "c_mktsegment", "c_nationkey", "v").withColumn("score", F.round("score", 4))


@query("with m as (select c_mktsegment as surface, c_nationkey % 2 as entity_type from customer), p as (select surface, count(distinct entity_type) as k from m group by 1) select count(*) as surfaces, count(*) filter (k = 1) as consistent, round(count(*) filter (k = 1) / count(*)::double, 6) as score from p")
def mention_consistency(spark, sf_dir):
    m = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("surface"), (F.col("c_nationkey") % 2).alias("entity_type"))
    return metrics.consistency(m).withColumn("score", r6("score"))


@query()
def html_text_nodes(spark, sf_dir):
    return files.html_nodes(table(spark, sf_dir, "pages"))


@query("select n_nationkey as record_id, n_name as text, length(n_name) as chars from nation")
def record_projection(spark, sf_dir):
    return metrics.record_rows(table(spark, sf_dir, "nation"), "n_nationkey", "n_name")


@query("with b as (select c_custkey as doc_id, case when c_custkey % 9 = 0 then 'B-PER' when c_custkey % 9 = 1 then 'I-PER' else 'O' end as tag, c_name as token, c_custkey // 9 as g from customer), p as (select *, sum(length(token) + 1) over (partition by g order by doc_id) - length(token) - 1 as s from b) select g as doc_id, 'PER' as entity_type, min(s)::bigint as start, max(s + length(token))::bigint as \"end\" from p where tag <> 'O' group by g")
def bio_spans(spark, sf_dir):
    k = F.col("c_custkey")
    t = table(spark, sf_dir, "customer").select(F.floor(k / 9).alias("doc_id"), k.alias("pos"), F.col("c_name").alias("token"), F.when(k % 9 == 0, "B-PER").when(k % 9 == 1, "I-PER").otherwise("O").alias("tag"))
    return files.bio_spans(t)


from veilspark.plans import compare_catalogue, scoring_catalogue  # noqa: E402, F401  (it registers more queries)
