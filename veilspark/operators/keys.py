"""Versioned keys with a time to live, and the ledger of identities."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class KeyVersion:
    version: int
    key: str
    created_at: float
    expires_at: float | None = None
    retired: bool = False

    def valid(self, now: float) -> bool:
        return not self.retired and (self.expires_at is None or now < self.expires_at)


class KeyManager:
    """Keys by version; the newest is current.  It lives on the driver, and jobs get the keys they name."""

    def __init__(self, key: str, ttl_seconds: float | None = None, clock=time.time):
        if not key:
            raise ValueError("a key can't be empty")
        self.ttl, self.clock, self._all = ttl_seconds, clock, {}
        self.rotate(key)

    def rotate(self, key: str, ttl_seconds: float | None = None) -> int:
        """Make a new current version."""
        if not key:
            raise ValueError("a key can't be empty")
        now, ttl = self.clock(), self.ttl if ttl_seconds is None else ttl_seconds
        version = max(self._all, default=0) + 1
        self._all[version] = KeyVersion(version, key, now, now + ttl if ttl else None)
        return version

    @property
    def current(self) -> int:
        return max(self._all)

    def get(self, version: int | None = None) -> str:
        held = self._all.get(self.current if version is None else version)
        if held is None or held.retired:
            raise KeyError(f"no key version {version}")
        if not held.valid(self.clock()):
            raise ValueError(f"key version {held.version} has expired")
        return held.key

    def is_valid(self, version: int) -> bool:
        return version in self._all and self._all[version].valid(self.clock())

    def retire(self, version: int) -> None:
        if version == self.current:
            raise ValueError("the current version can't be retired")
        if version not in self._all:
            raise KeyError(f"no key version {version}")
        held = self._all[version]
        self._all[version] = KeyVersion(held.version, "", held.created_at, held.expires_at, True)

    def versions(self) -> list[KeyVersion]:
        return [self._all[v] for v in sorted(self._all)]


def ledger(mentions: DataFrame) -> DataFrame:
    """Clusters of (scope, cluster, alias, at): canonical name, aliases and number of mentions.

    The canonical name is the first one, unless that is a single word and a later one isn't:
    then the first of those.
    """
    at = F.struct("at", "alias")
    first, full = F.min(at)["alias"], F.min(F.when(F.col("alias").contains(" "), at))["alias"]
    return mentions.groupBy("scope", "cluster").agg(
        F.when(first.contains(" "), first).otherwise(F.coalesce(full, first)).alias("canonical"), F.array_sort(F.collect_set(F.lower("alias"))).alias("aliases"), F.count("*").alias("mentions")
    )


def merge_ledgers(old: DataFrame, new: DataFrame, max_scopes: int | None = None) -> DataFrame:
    """A ledger with later mentions' ledger merged in; of more than ``max_scopes`` scopes the oldest (by ``seen``) go.

    Both: (scope, cluster, canonical, aliases, mentions, seen).
    """
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    name = lambda c: F.min(F.when(c, F.struct("_new", "canonical")))["canonical"]
    out = both.groupBy("scope", "cluster").agg(
        F.coalesce(name(F.col("canonical").contains(" ")), name(F.lit(True))).alias("canonical"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("aliases")))).alias("aliases"),
        F.sum("mentions").alias("mentions"), F.max("seen").alias("seen"),
    )
    if max_scopes is None:
        return out
    newest = out.groupBy("scope").agg(F.max("seen").alias("s")).orderBy(F.desc("s"), "scope").limit(max_scopes)
    return out.join(newest.select("scope"), "scope", "left_semi")


def alias_index(clusters: DataFrame) -> DataFrame:
    """(scope, alias, clusters): who an alias may be."""
    return clusters.select("scope", F.explode("aliases").alias("alias"), "cluster").groupBy("scope", "alias").agg(F.array_sort(F.collect_set("cluster")).alias("clusters"))


def rendered_type(cluster: str = "cluster", entity_type: str = "entity_type"):
    """Person-and-contact clusters are shown as names whatever the mention's type."""
    return F.when(F.col(cluster).startswith("person_contact"), "PERSON_NAME").otherwise(F.col(entity_type))
