"""Connected components of an edge table, wholly distributed.

Large star and small star by turns (Kiveris et al., "Connected Components in MapReduce
and Beyond", 2014).  Each half step is one aggregation, whose partial sums run before the
shuffle, and one join of two written tables, which adaptive execution can split where a
component's root is hot.  Every round is written to the shared folder, so lineage
stays short and lost executors cost one round's tasks at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm.common import materialize, remove


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """One row (node, component) for each node but the smallest of its component.

    ``edges`` holds one undirected edge a row; loops, repeats and rows with a null end
    count for nothing.  ``component`` is the smallest node of the component.
    """
    u, v = F.col(f"`{a}`"), F.col(f"`{b}`")
    n = edges.count()
    stars = materialize(edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).filter((u != v)).distinct(), "edges", n)
    last = _sums(stars)
    while last[0]:
        # Large star: a node's larger neighbours move to the smallest of its neighbourhood.
        both = stars.select("u", "v").union(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("v"), F.least("u", "m").alias("m")), "least", 2 * n)
        large = materialize(stars.join(least, "v").select("u", F.col("m").alias("v")).filter("u != v").distinct(), "large", n)
        # Small star: a node and its smaller neighbours move to the smallest of these.
        least2 = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "least2", n)
        moved = large.join(least2, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v")
        new = materialize(moved.union(least2.select("u", F.col("m").alias("v"))).distinct(), "stars", 2 * n)
        now = _sums(new)
        for old in (stars, least, large, least2):
            remove(old)
        stars = new
        if now == last:
            break
        last = now
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component"))


def _sums(stars: DataFrame) -> tuple[int, int]:
    r = stars.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return r[0], int(r[1] or 0)
