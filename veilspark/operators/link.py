"""Entity linking within a scope.

A scope's mentions are taken in order; each finds the cluster whose aliases fit best, or starts
one.  The order matters, so a scope's mentions are one array: a document's by default.  A batch
has many scopes, as a group of its own costs milliseconds.
A scope that is the whole corpus is one task, and for that ``link_by_alias`` joins on
normalised aliases instead, which is another semantics and named so.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.functions.lexicon import HONORIFICS

LINKED = "scope string, doc_id bigint, entity_type string, span_start int, span_end int, matched string, cluster_id string, placeholder_index int, link_score double, rule string"
KINDS = {x.split()[0]: {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64()}[x.split()[1]] for x in LINKED.split(", ")}


def alias_norm(x: Column) -> Column:
    """Lower case without ASCII characters that are no letters or digits."""
    return F.regexp_replace(F.lower(x), "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]", "")


def family(entity_type: Column) -> Column:
    return F.when(entity_type.isin("PERSON_NAME", "EMAIL_ADDRESS"), "person_contact").otherwise(F.lower(entity_type))


def _norm(x: str) -> str:
    return "".join(c for c in x.lower() if c.isalnum() or ord(c) > 127)


def _features(kind: str, text: str) -> dict:
    """Aliases that a mention brings."""
    out = {"all": _norm(text), "full": None, "short": None, "last": None, "local": None}
    if kind == "EMAIL_ADDRESS":
        out["local"] = _norm(text.split("@")[0])
        return out
    words = [w for w in re.findall(r"[^\W\d_][\w'’-]*", text) if w.lower() not in HONORIFICS.split()]
    if len(words) >= 2:
        out |= {"full": _norm("".join(words)), "short": _norm(words[0]), "last": _norm(words[-1])}
    elif words:
        out["short"] = _norm(words[0])
    return out


def _fit(cluster: dict, f: dict, link_email: bool) -> tuple[float, str]:
    if f["full"] and f["full"] in cluster["full"]:
        return 0.98, "full name"
    if link_email and f["local"] and f["local"] in cluster["full"]:
        return 0.92, "email is the full name"
    if link_email and f["full"] and f["full"] in cluster["local"]:
        return 0.92, "full name is the email"
    if f["full"] is None and f["short"] and f["short"] in cluster["short"]:
        return 0.85, "first name"
    if f["full"] is None and f["short"] and f["short"] in cluster["last"]:
        return 0.82, "last name"
    if link_email and f["local"] and f["local"] in cluster["short"]:
        return 0.80, "email is the first name"
    return 0.0, ""


def link_scope(mentions: Sequence[tuple[str, str]], min_score: float = 0.8, link_email: bool = True) -> list[tuple[int, float, str]]:
    """(cluster, score, rule) of mentions (type, text) in order.

    A first or last name that fits several clusters fits none: it starts its own.
    """
    clusters: list[dict] = []
    out = []
    for kind, text in mentions:
        fam = "person_contact" if kind in ("PERSON_NAME", "EMAIL_ADDRESS") else kind.lower()
        f = _features(kind, text) if fam == "person_contact" else {"all": _norm(text), "full": None, "short": None, "last": None, "local": None}
        found = next((i for i, c in enumerate(clusters) if c["family"] == fam and f["all"] in c["all"]), None)
        score, rule = 1.0, "same alias"
        if found is None:
            fits = [(*_fit(c, f, link_email), i) for i, c in enumerate(clusters) if c["family"] == fam]
            fits = [x for x in fits if x[0] >= min_score]
            if f["full"] is None and f["local"] is None and len({x[2] for x in fits}) > 1:
                fits = []
            if fits:
                score, rule, found = max(fits, key=lambda x: (x[0], -x[2]))
        elif f["full"] is None and f["short"] and len([c for c in clusters if c["family"] == fam and (f["short"] in c["short"] or f["short"] in c["last"])]) > 1:
            found = found if f["all"] in clusters[found]["own"] else None
        if found is None:
            clusters.append({"family": fam, "all": set(), "own": set(), "full": set(), "short": set(), "last": set(), "local": set()})
            found, score, rule = len(clusters) - 1, 1.0, "new"
        c = clusters[found]
        c["all"].add(f["all"])
        c["own"].add(f["all"])
        for k in ("full", "short", "last", "local"):
            if f[k]:
                c[k].add(f[k])
        out.append((found, score, rule))
    return out


def link(findings: DataFrame, scope: Column | None = None, min_score: float = 0.8) -> DataFrame:
    """Disjoint findings (doc_id, entity_type, span_start, span_end, matched) with cluster and placeholder number."""
    scope = scope if scope is not None else F.col("doc_id").cast("string")

    def rows(scope: str, mentions: list[dict]) -> Iterator[tuple]:
        for m, (i, score, rule) in zip(mentions, link_scope([(m["entity_type"], m["matched"]) for m in mentions], min_score), strict=True):
            kind = "PERSON_NAME" if m["entity_type"] in ("PERSON_NAME", "EMAIL_ADDRESS") else m["entity_type"]
            yield scope, m["doc_id"], m["entity_type"], m["span_start"], m["span_end"], m["matched"], f"{kind}:{i}", i, score, rule

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [r for scope, mentions in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for r in rows(scope, mentions)]
            columns = zip(*made, strict=True) if made else [[]] * len(KINDS)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, KINDS.values(), strict=True)], list(KINDS))

    mention = F.struct(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("span_start").cast("int").alias("span_start"), F.col("span_end").cast("int").alias("span_end"), "entity_type", "matched")
    grouped = findings.select(scope.alias("scope"), mention.alias("m")).groupBy("scope").agg(F.array_sort(F.collect_list("m")).alias("mentions"))
    return grouped.mapInArrow(run, LINKED)


def link_by_alias(findings: DataFrame) -> DataFrame:
    """Corpus-wide: mentions with equal normalised text and family are one entity."""
    key = F.concat_ws(":", family(F.col("entity_type")), alias_norm(F.col("matched")))
    return findings.withColumn("cluster_id", F.sha2(key, 256))
