"""Token vault and re-identification.

A vault is a table (scope, token, plaintext, entity_type, version, created_at, expires_at) with
one row for each (scope, token).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspark.operators.transform import token

TOKEN = r"<[A-Z0-9_]+:v[0-9]+:tok_[A-Za-z0-9_-]+>"
KEY = ["scope", "token"]


def vault(findings: DataFrame, key: str, scope: Column | None = None, version: int = 1, created_at: Column | None = None, ttl_seconds: float | None = None) -> DataFrame:
    """The vault rows of findings (entity_type, matched), one for each token."""
    scope = scope if scope is not None else F.lit("default")
    made = created_at if created_at is not None else F.lit(0.0)
    until = made + ttl_seconds if ttl_seconds is not None else F.lit(None)
    return (
        findings.select(scope.alias("scope"), token(F.col("entity_type"), F.col("matched"), key, scope, version).alias("token"), F.col("matched").alias("plaintext"), "entity_type")
        .groupBy(*KEY).agg(F.min("plaintext").alias("plaintext"), F.min("entity_type").alias("entity_type"))
        .select(*KEY, "plaintext", "entity_type", F.lit(version).alias("version"), made.cast("double").alias("created_at"), until.cast("double").alias("expires_at"))
    )


def put(store: DataFrame, rows: DataFrame) -> DataFrame:
    """Upsert: rows replace what has their key."""
    return store.join(rows.select(*KEY), KEY, "left_anti").unionByName(rows)


def alive(store: DataFrame, now: float) -> DataFrame:
    return store.filter(F.col("expires_at").isNull() | (F.col("expires_at") > now))


def latest(store: DataFrame) -> DataFrame:
    """Of each plaintext in a scope, its newest token."""
    w = Window.partitionBy("scope", "entity_type", "plaintext").orderBy(F.desc("version"), F.desc("created_at"), "token")
    return store.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def detokenize(tokens: DataFrame, store: DataFrame, now: float = 0.0, reason: str = "") -> DataFrame:
    """(scope, token) rows with plaintext (null: unknown or expired) and an audit row's columns for every attempt."""
    found = tokens.join(alive(store, now).select(*KEY, "plaintext"), KEY, "left")
    return found.withColumns({"success": F.col("plaintext").isNotNull(), "reason": F.lit(reason), "attempted_at": F.lit(now)})


def detokenize_texts(texts: DataFrame, store: DataFrame, scope: Column | None = None, now: float = 0.0) -> DataFrame:
    """(doc_id, field_path, text) with every known token replaced; unknown ones stay."""
    scope = scope if scope is not None else F.lit("default")
    named = texts.withColumn("scope", scope)
    inside = named.select("doc_id", "field_path", "scope", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0)))).alias("token"))
    known = inside.join(alive(store, now).select(*KEY, "plaintext"), KEY).groupBy("doc_id", "field_path").agg(F.map_from_entries(F.collect_list(F.struct("token", "plaintext"))).alias("known"))
    parts, gaps = F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0)), F.split("text", TOKEN, -1)
    joined = named.join(known, ["doc_id", "field_path"], "left")
    shown = F.transform(F.arrays_zip(gaps.alias("g"), parts.alias("t")), lambda z: F.concat(z["g"], F.coalesce(F.try_element_at(F.col("known"), z["t"]), z["t"], F.lit(""))))
    return joined.select("doc_id", "field_path", F.when(F.col("known").isNull(), F.col("text")).otherwise(F.array_join(shown, "")).alias("text"))


def detokenize_payload(records: DataFrame, store: DataFrame, id_column: str, fields: list[str], scope: Column | None = None, now: float = 0.0) -> DataFrame:
    """Records with every known token in their fields replaced; unknown ones stay."""
    cells = F.array(*[F.struct(F.lit(f).alias("field_path"), F.col(f"`{f}`").cast("string").alias("text")) for f in fields])
    long = records.select(F.col(f"`{id_column}`").alias("doc_id"), F.explode(cells).alias("c")).select("doc_id", "c.field_path", "c.text")
    back = detokenize_texts(long, store, scope, now).groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("field_path", "text"))).alias("_cells"))
    joined = records.join(back.withColumnRenamed("doc_id", id_column), id_column, "left")
    return joined.withColumns({f: F.try_element_at("_cells", F.lit(f)) for f in fields}).drop("_cells")
