"""Labelled datasets: evaluation, benchmark and training records, their summaries, and a generator of them.

Files are JSON lines (gzip or not), read with one fixed schema; what a row lacks is null and gets its
default in the normalisation, which is a projection.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.operators import learn, segment

LABEL = "entity_type string, start int, end int, entity_cluster_id string, cluster_id string, mention_variant string, context_group string"
RAW = (
    f"id string, record_id string, text string, labels array<struct<{LABEL}>>, annotations array<struct<{LABEL}>>, language string, source_type string, source_id string, license string, scenario_id string, "
    "entity_cluster_id string, mention_variant string, context_group string, datatype_group string, domain string, difficulty_level string, evaluation_dimension string, primary_dimension string, dimension_tags array<string>, "
    "dimensions array<string>, data_type string, context_length_tier string, token_count int, regulatory_domain array<string>, script string, language_family string, resource_level string, num_repeated_entities int, "
    "has_conversational_context boolean, is_time_series boolean, time_series_id string, temporal_ordering int, quasi_identifiers_present array<string>, reidentification_risk_tier string, adversarial_type string, "
    "adversarial_difficulty string, edge_case_types array<string>, adversarial struct<type:string,attack_type:string,difficulty:string>, "
    "privacy_risk struct<reidentification_risk:string,tier3_risk_level:string,quasi_identifiers:array<string>>, provenance struct<source_type:string,license:string,source_id:string>"
)
SPAN = "array<struct<entity_type:string,start:int,end:int,entity_cluster_id:string,mention_variant:string,context_group:string>>"
#: Names of other datasets for our types; an empty one is left out.
TYPE_NAMES = {
    "SOCIAL_SECURITY_NUMBER": "US_SSN", "STREET_ADDRESS": "ADDRESS", "ORGANIZATION_NAME": "ORGANIZATION", "PASSPORT_NUMBER": "PASSPORT", "DRIVER_LICENSE_NUMBER": "DRIVERS_LICENSE", "BANK_ACCOUNT_NUMBER": "BANK_ACCOUNT",
    "BANK_ROUTING_NUMBER": "ROUTING_NUMBER", "NATIONAL_ID_NUMBER": "NATIONAL_ID", "LOCATION_NAME": "LOCATION", "CRYPTOCURRENCY_ADDRESS": "CRYPTO_WALLET", "SOCIAL_MEDIA_HANDLE": "USERNAME",
    "VEHICLE_IDENTIFICATION_NUMBER": "VIN", "CREDIT_CARD_NUMBER": "CREDIT_CARD", "CREDIT_CARD_FRAGMENT": "CREDIT_CARD", "LATITUDE_LONGITUDE": "", "TIMESTAMP": "", "POSTAL_CODE": "ADDRESS", "SWIFT_BIC_CODE": "",
    "HEALTH_INSURANCE_ID": "MEDICAL_RECORD_NUMBER", "DEVICE_IDENTIFIER": "MAC_ADDRESS", "TAX_ID": "NATIONAL_ID", "VISA_NUMBER": "PASSPORT",
}
DATA_TYPES = ("unstructured_text", "structured", "semi_structured", "code", "logs", "mixed")
TIERS = ("short", "medium", "long", "very_long")
RISKS = ("low", "moderate", "high", "critical")
_taxonomies: dict[str, dict[str, str]] = {"default": TYPE_NAMES}


def register_taxonomy(name: str, mapping: Mapping[str, str]) -> None:
    """Type names of the user's own data; "" leaves a type out."""
    _taxonomies[name] = dict(mapping)


def read_rows(spark: SparkSession, path: str) -> DataFrame:
    """Raw rows of JSON lines; lines that aren't JSON are left out."""
    return spark.read.schema(RAW).option("mode", "DROPMALFORMED").json(path)


def _with_all(rows: DataFrame) -> DataFrame:
    """Every column of the raw schema, null where the table lacks it."""
    have = {c.lower() for c in rows.columns}
    wanted = rows.sparkSession.createDataFrame([], RAW).schema
    return rows.select(*[(F.col(f"`{f.name}`").cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in wanted])


def renamed(kind: Column, names: Mapping[str, str]) -> Column:
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair]) if names else F.lit(None).cast("map<string,string>")
    return F.coalesce(F.try_element_at(table, F.trim(kind)), F.trim(kind), F.lit(""))


def _labels(names: Mapping[str, str]) -> Column:
    raw = F.coalesce(F.when(F.size("annotations") > 0, F.col("annotations")), F.col("labels"), F.array().cast(f"array<struct<{LABEL}>>"))
    made = F.transform(
        raw,
        lambda x: F.struct(
            renamed(x["entity_type"], names).alias("entity_type"), x["start"].alias("start"), x["end"].alias("end"), F.coalesce(x["entity_cluster_id"], x["cluster_id"]).alias("entity_cluster_id"),
            x["mention_variant"].alias("mention_variant"), x["context_group"].alias("context_group"),
        ),
    )
    return made.cast(SPAN)


def valid_span(x: Column, text: Column) -> Column:
    return F.coalesce((x["entity_type"] != "") & (x["start"] >= 0) & (x["end"] > x["start"]) & (x["end"] <= F.length(text)), F.lit(False))


def _one_of(value: Column, allowed: Sequence[str], other: str | Column) -> Column:
    other = other if isinstance(other, Column) else F.lit(other)
    return F.when(value.isin(*allowed), value).otherwise(other)


def dimensions(labels: Column) -> Column:
    """Tags of a row: its own where it has some, else what its content tells; sorted, each once."""
    c, text = F.col, lambda n, d="": F.coalesce(F.col(n), F.lit(d))
    own = F.array_compact(F.concat(F.array(c("primary_dimension")), F.coalesce(F.when(F.size("dimension_tags") > 0, c("dimension_tags")), c("dimensions"), F.array().cast("array<string>"))))
    own = F.filter(own, lambda x: x != "")
    tags = {
        "entity_tracking": text("scenario_id").contains("continuity") | text("context_group").contains("tracking"),
        "multilingual": text("language", "en") != "en",
        "context_preservation": text("scenario_id").contains("context_loss") | F.coalesce("has_conversational_context", F.lit(False)),
        "diverse_pii_types": F.size(F.array_distinct(F.transform(labels, lambda x: x["entity_type"]))) >= 5,
        "data_format_variations": text("data_type").isin(*DATA_TYPES[1:]),
        "edge_cases": text("difficulty_level") == "challenging",
        "temporal_consistency": F.coalesce("is_time_series", F.lit(False)),
    }
    told = F.array_compact(F.array(*[F.when(test, F.lit(tag)) for tag, test in tags.items()]))
    told = F.when(F.size(told) == 0, F.array(F.lit("diverse_pii_types"))).otherwise(told)
    return F.array_sort(F.array_distinct(F.when(F.size(own) > 0, own).otherwise(told)))


def normalised(rows: DataFrame, taxonomy: str = "default") -> DataFrame:
    """Evaluation records of raw rows: names mapped, invalid spans and empty texts left out, values of fixed sets put right."""
    c, d = F.col, lambda n, other: F.coalesce(F.col(n), F.lit(other))
    base = _with_all(rows).filter("text is not null and text != ''").withColumn("_l", _labels(_taxonomies[taxonomy]))
    base = base.withColumn("_l", F.filter("_l", lambda x: valid_span(x, F.col("text"))))
    named = F.filter(F.transform("_l", lambda x: x["entity_cluster_id"]), lambda x: x.isNotNull() & (x != "none"))
    repeated = F.size(F.filter(F.array_distinct(named), lambda x: F.size(F.filter(named, lambda y: y == x)) > 1))
    risk = F.coalesce(F.col("privacy_risk.reidentification_risk"), F.col("privacy_risk.tier3_risk_level"), _one_of(c("reidentification_risk_tier"), RISKS, "low"))
    return base.select(
        F.coalesce("id", "record_id", F.concat(F.lit("eval-"), F.substring(F.md5("text"), 1, 12))).alias("record_id"), "text", c("_l").alias("labels"), d("language", "en").alias("language"),
        _one_of(F.coalesce(c("source_type"), c("provenance.source_type")), ("curated_public",), "synthetic").alias("source_type"), F.coalesce("source_id", "provenance.source_id", F.lit("generated")).alias("source_id"),
        F.coalesce("license", "provenance.license", F.lit("CC0-1.0")).alias("license"), d("scenario_id", "baseline").alias("scenario_id"), d("entity_cluster_id", "none").alias("entity_cluster_id"),
        d("context_group", "baseline").alias("context_group"), F.coalesce("datatype_group", "domain", F.lit("general")).alias("datatype_group"), d("difficulty_level", "moderate").alias("difficulty_level"),
        _one_of(c("data_type"), DATA_TYPES, DATA_TYPES[0]).alias("data_type"), _one_of(c("context_length_tier"), TIERS, segment.context_tier(c("text"))).alias("context_length_tier"),
        F.coalesce("token_count", F.size(F.filter(F.split("text", "\\s+"), lambda w: w != ""))).alias("token_count"), F.coalesce("regulatory_domain", F.array().cast("array<string>")).alias("regulatory_domain"),
        F.coalesce("adversarial_type", "adversarial.type").alias("adversarial_type"), F.coalesce("adversarial.difficulty", "adversarial_difficulty", F.lit("clean")).alias("adversarial_difficulty"),
        d("script", "Latin").alias("script"), d("language_family", "").alias("language_family"), d("resource_level", "high").alias("resource_level"),
        F.array_sort(F.array_distinct(F.transform("_l", lambda x: x["entity_type"]))).alias("entity_types_present"), dimensions(c("_l")).alias("dimension_tags"),
        F.coalesce("num_repeated_entities", repeated).alias("num_repeated_entities"), d("is_time_series", False).alias("is_time_series"), "time_series_id", d("temporal_ordering", 0).alias("temporal_ordering"),
        F.coalesce(F.when(F.size("quasi_identifiers_present") > 0, c("quasi_identifiers_present")), c("privacy_risk.quasi_identifiers"), F.array().cast("array<string>")).alias("quasi_identifiers_present"),
        _one_of(risk, RISKS, "low").alias("reidentification_risk_tier"), F.coalesce("edge_case_types", F.array().cast("array<string>")).alias("edge_case_types"),
    )


def evaluation_records(spark: SparkSession, path: str, language: str | None = None, data_type: str | None = None, difficulty: str | None = None, adversarial_only: bool = False, dimension: str | None = None, max_samples: int | None = None) -> DataFrame:
    """Records of a file that pass the filters; ``max_samples`` keeps the first by id."""
    out = normalised(read_rows(spark, path))
    for name, value in (("language", language), ("data_type", data_type), ("difficulty_level", difficulty)):
        out = out.filter(F.col(name) == value) if value else out
    if adversarial_only:
        out = out.filter(F.coalesce(F.col("adversarial_type"), F.lit("")) != "")
    if dimension:
        out = with_dimension(out, dimension)
    return out.orderBy("record_id").limit(max_samples) if max_samples else out


def with_dimension(records: DataFrame, dimension: str) -> DataFrame:
    return records.filter(F.array_contains("dimension_tags", dimension))


def labels_of(records: DataFrame) -> DataFrame:
    """(record_id, entity_type, start, end) of the records' gold spans."""
    return records.select("record_id", F.explode("labels").alias("l")).select("record_id", "l.entity_type", "l.start", "l.end")


def ordered_in_time(records: DataFrame) -> DataFrame:
    """Records of time series with their place in the series."""
    from pyspark.sql import Window

    w = Window.partitionBy("time_series_id").orderBy("temporal_ordering", "record_id")
    return records.filter("time_series_id is not null").withColumn("position", F.row_number().over(w))


#: What a benchmark falls back on where no file is found.
DEFAULT_ROWS = [("default-1", "Write to mara.holt@example.org.", [("EMAIL_ADDRESS", 9, 30)]), ("default-2", "Call 212-555-0161 before noon.", [("PHONE_NUMBER", 5, 17)])]


def dataset_path(name: str, roots: Sequence[str] = ()) -> str | None:
    """The first of root/name.jsonl(.gz) that exists; roots: the arguments, then VEILSPARK_DATASETS."""
    for root in [*roots, *filter(None, os.environ.get("VEILSPARK_DATASETS", "").split(os.pathsep))]:
        for ending in (".jsonl", ".jsonl.gz"):
            if (Path(root) / (name + ending)).exists():
                return str(Path(root) / (name + ending))
    return None


def benchmark_records(spark: SparkSession, path: str | None, language: str | None = None) -> DataFrame:
    """Benchmark records: unlike the evaluation's, an invalid span is an error.  Without a path, two built-in rows."""
    if path is None:
        rows = spark.createDataFrame([(i, t, [{"entity_type": k, "start": a, "end": z} for k, a, z in ls]) for i, t, ls in DEFAULT_ROWS], "record_id string, text string, labels array<struct<entity_type:string,start:int,end:int>>")
        rows = rows.withColumn("labels", F.transform("labels", lambda x: F.struct(*[x[f] if f in ("entity_type", "start", "end") else F.lit(None).cast("string").alias(f) for f in [y.split()[0] for y in LABEL.split(", ")]])))
    else:
        rows = read_rows(spark, path)
    out = strict(rows)
    return out.filter(F.col("language") == language) if language else out


def strict(rows: DataFrame) -> DataFrame:
    d = lambda n, other: F.coalesce(F.col(n), F.lit(other)).alias(n)
    base = _with_all(rows).withColumn("_l", _labels(TYPE_NAMES))
    bad = (F.coalesce(F.col("text"), F.lit("")) == "") | F.exists("_l", lambda x: ~valid_span(x, F.col("text")) & (x["entity_type"] != ""))
    checked = F.when(bad, F.raise_error(F.concat(F.lit("invalid benchmark row "), F.coalesce("record_id", "id", F.lit("?"))))).otherwise(F.col("text"))
    return base.select(
        F.coalesce("record_id", "id", F.concat(F.lit("row-"), F.substring(F.md5("text"), 1, 12))).alias("record_id"), checked.alias("text"), F.filter("_l", lambda x: x["entity_type"] != "").alias("labels"), d("language", "en"),
        d("scenario_id", "baseline"), d("context_group", "baseline"), F.coalesce("datatype_group", "domain", F.lit("general")).alias("datatype_group"), d("difficulty_level", "moderate"),
        F.coalesce("evaluation_dimension", "primary_dimension", F.lit("pii_type_coverage")).alias("evaluation_dimension"),
    )


def profiles(spark: SparkSession, path: str) -> DataFrame:
    """Use-case profiles of one JSON document: profile, objective, required, languages, max_samples."""
    kinds = "profile string, objective string, required boolean, languages array<string>, max_samples int"
    raw = spark.read.option("multiLine", True).schema(f"profiles array<struct<{kinds}>>").json(path)
    return raw.select(F.explode("profiles").alias("p")).select("p.*")


def for_profile(records: DataFrame, profile: str, languages: Sequence[str] = (), max_samples: int | None = None) -> DataFrame:
    """A profile's records: of its languages, and the first by "profile:record_id" where it asks for so many."""
    out = records.filter(F.col("language").isin(*languages)) if languages else records
    return out.orderBy(F.concat(F.lit(f"{profile}:"), F.col("record_id"))).limit(max_samples) if max_samples else out


# training ---------------------------------------------------------------------------------

Loader = Callable[[SparkSession], DataFrame]
_loaders: dict[str, Loader] = {}


def register_loader(name: str, loader: Loader, replace: bool = False) -> None:
    if not re.fullmatch(r"[A-Za-z0-9_.-]+", name):
        raise ValueError(f"{name!r} looks like a path, not a name")
    if name in _loaders and not replace:
        raise ValueError(f"loader {name!r} is registered already")
    _loaders[name] = loader


def training_rows(spark: SparkSession, path: str, taxonomy: str = "default", source: str | None = None) -> DataFrame:
    """(dataset, record_id, text, language, labels) of JSON lines; rows without text are left out."""
    return normalised(read_rows(spark, path), taxonomy).select(F.lit(source or Path(path).name.split(".")[0]).alias("dataset"), "record_id", "text", "language", "labels")


def load_training(spark: SparkSession, datasets: Sequence[str], most: int | None = None, taxonomy: str = "default") -> DataFrame:
    """Union of datasets, by registered name or path; of each at most ``most`` records, dealt by language as they stand."""
    made = []
    for name in datasets:
        rows = _loaders[name](spark) if name in _loaders else training_rows(spark, name, taxonomy)
        made.append(learn.stratified_sample(rows, "language", most, "record_id") if most else rows)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), made)


# summaries --------------------------------------------------------------------------------


def summary(records: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(field, value, n) of every value of the columns; arrays count each element.  One pass over the records."""
    kinds = dict(records.dtypes)

    def cells(c: str) -> Column:
        values = F.coalesce(F.col(c).cast("array<string>"), F.array().cast("array<string>")) if kinds[c].startswith("array") else F.array(F.col(c).cast("string"))
        return F.transform(values, lambda v: F.struct(F.lit(c).alias("field"), v.alias("value")))

    return records.select(F.explode(F.concat(*map(cells, columns))).alias("x")).groupBy("x.field", "x.value").agg(F.count("*").alias("n"))


def checksum(records: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Number and a checksum of rows that doesn't depend on their order: sums of two halves of their MD5."""
    row = F.md5(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}))
    half = lambda a: F.sum(F.conv(F.substring(row, a, 15), 16, 10).cast("decimal(20,0)"))
    return records.agg(F.count("*").alias("n"), F.concat_ws("-", half(1).cast("string"), half(16).cast("string")).alias("checksum"))


# generator --------------------------------------------------------------------------------

TEMPLATES = {
    "en": ("{PERSON_NAME} wrote from {EMAIL_ADDRESS}.", "Please call {PERSON_NAME} at {PHONE_NUMBER} on {DATE_ISO}.", "The server {IP_ADDRESS} answered."),
    "de": ("{PERSON_NAME} schrieb von {EMAIL_ADDRESS}.", "Rufen Sie {PERSON_NAME} unter {PHONE_NUMBER} an."),
    "fr": ("{PERSON_NAME} a écrit de {EMAIL_ADDRESS}.", "Appelez {PERSON_NAME} au {PHONE_NUMBER}."),
    "es": ("{PERSON_NAME} escribió desde {EMAIL_ADDRESS}.",),
}
VALUES = {
    "PERSON_NAME": ("Mara Holt", "Idris Vane", "Lena Okafor", "Tomas Reyes", "Yuki Arden"), "EMAIL_ADDRESS": ("mara.holt@example.org", "i.vane@example.net", "okafor@example.com"),
    "PHONE_NUMBER": ("212-555-0161", "646-555-0142"), "IP_ADDRESS": ("192.0.2.7", "198.51.100.23"), "DATE_ISO": ("2024-03-09", "2023-11-30"),
}


def pick(id_column: Column, slot: str, n: int, seed: int) -> Column:
    """A choice of 0 to n - 1 that depends on the record, the slot and the seed alone."""
    h = F.md5(F.concat_ws(":", id_column.cast("string"), F.lit(slot), F.lit(str(seed))))
    return (F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint") % n).cast("int")


def filled(template: str, row: Column, seed: int) -> Column:
    """Struct (text, labels) of a template whose places are filled left to right."""
    text, labels = F.lit(""), []
    for k, part in enumerate(re.split(r"(\{[A-Z_]+\})", template)):
        if part.startswith("{"):
            kind = part[1:-1]
            value = F.element_at(F.array(*map(F.lit, VALUES[kind])), pick(row, f"{kind}{k}", len(VALUES[kind]), seed) + 1)
            labels.append(F.struct(F.lit(kind).alias("entity_type"), F.length(text).alias("start"), (F.length(text) + F.length(value)).alias("end")))
        else:
            value = F.lit(part)
        text = F.concat(text, value)
    return F.struct(text.alias("text"), F.array(*labels).alias("labels"))


def generate(spark: SparkSession, records: int, seed: int = 42, weights: Mapping[str, int] | None = None) -> DataFrame:
    """(record_id, language, text, labels): every record from its number and the seed, so any task can make it again."""
    weights = dict(weights or dict.fromkeys(TEMPLATES, 1))
    total, row = sum(weights.values()), F.col("id")
    draw, reached, out = pick(row, "language", total, seed), 0, None
    for language, weight in weights.items():
        reached += weight
        made = TEMPLATES[language]
        which = pick(row, "template", len(made), seed)
        body = F.lit(None)
        for k, t in enumerate(made):
            body = F.when(which == k, filled(t, row, seed)).otherwise(body)
        here = F.struct(F.lit(language).alias("language"), body.alias("b"))
        out = here if out is None else F.when(draw >= reached - weight, here).otherwise(out)
    return spark.range(records).select(F.format_string("gen-%09d", row).alias("record_id"), out.alias("r")).select("record_id", "r.language", "r.b.text", "r.b.labels")


def write_dataset(records: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """JSON lines, gzip."""
    records.write.mode(mode).json(path, compression="gzip")
