"""Spans that are there many times, against brute force and at numbers whose pairs could not be made one by one."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilspark.operators import matching, metrics

SPAN = "record_id string, entity_type string, start int, end int"


@pytest.fixture(scope="module")
def repeated(spark):
    """Predictions and labels of a few records, some of them of no length, each up to three times."""
    rng = np.random.RandomState(7)
    one = lambda: [(f"r{rng.randint(5)}", "AB"[rng.randint(2)], int(a), int(a + rng.randint(7))) for a in rng.randint(0, 40, 50)]
    p, g = ([s for s in one() for _ in range(rng.randint(1, 4))] for _ in range(2))
    return p, g, spark.createDataFrame(p, SPAN), spark.createDataFrame(g, SPAN)


@pytest.fixture(scope="module")
def many(spark):
    """One record with two predictions and two labels, 100,000 times each."""
    at = lambda shift: F.when(F.col("id") % 2 == 0, 0).otherwise(20 + shift).cast("int").alias("start")
    rows = lambda shift: spark.range(200_000).select(F.lit("r").alias("record_id"), F.lit("A").alias("entity_type"), at(shift), (F.col("id") % 2 * 20 + 10).cast("int").alias("end"))
    return rows(1), rows(0)


def share(x, y):
    both = max(0, min(x[3], y[3]) - max(x[2], y[2]))
    whole = x[3] - x[2] + y[3] - y[2] - both
    return both / whole if whole > 0 else 0.0


def over(x, y):
    return x[0] == y[0] and x[2] < y[3] and y[2] < x[3]


def test_outcomes_of_repeated_labels(repeated, many):
    p, g, pd, gd = repeated
    want = {}
    for y in g:
        best = max(((share(x, y), x[1] == y[1], x[2], x[3]) for x in p if over(x, y)), default=None)
        kind = "complete_miss" if best is None else "type_confusion" if not best[1] else "boundary_miss" if best[0] < 1 else "hit"
        want[y[1], kind] = want.get((y[1], kind), 0) + 1
    assert {(r.entity_type, r.outcome): r.n for r in metrics.error_taxonomy(pd, gd).collect()} == want
    assert {r.outcome: r.n for r in metrics.error_taxonomy(*many).collect()} == {"hit": 100_000, "boundary_miss": 100_000}


def test_outcomes_of_labels_without_a_record(spark):
    s = spark.createDataFrame([(None, "A", 0, 5)], SPAN)
    assert [(r.outcome, r.n) for r in metrics.error_taxonomy(s, s).collect()] == [("complete_miss", 1)]


@pytest.mark.parametrize("same_type", [True, False])
def test_greedy_matches_of_repeated_spans(repeated, many, same_type):
    p, g, pd, gd = repeated
    p, g = (sorted(s, key=lambda x: (x[0], x[2], x[3], x[1])) for s in (p, g))
    pairs = sorted((-share(x, y), i, j) for i, x in enumerate(p) for j, y in enumerate(g) if over(x, y) and (x[1] == y[1] or not same_type) and share(x, y) >= 0.5)
    taken, other, want = set(), set(), {}
    for _, i, j in pairs:
        if i not in taken and j not in other:
            taken.add(i), other.add(j)
            key = p[i][:2] if same_type else p[i][:1]
            want[key] = want.get(key, 0) + 1
    got = metrics.overlap_matches(pd, gd, same_type=same_type).collect()
    assert {tuple(r)[:-1]: r.tp for r in got} == want
    r = metrics.overlap_scores(*many).first()
    assert (r.tp, r.predicted, r.gold) == (200_000, 200_000, 200_000)


@pytest.mark.parametrize("mode", matching.MODES)
def test_first_fit_of_repeated_spans(repeated, many, mode):
    p, g, pd, gd = repeated
    order = lambda s: (s[2], s[3], s[1])
    fits = {"strict": lambda x, y: x[1:] == y[1:], "exact": lambda x, y: x[2:] == y[2:], "type": lambda x, y: x[1] == y[1] and over(x, y), "partial": lambda x, y: over(x, y) and share(x, y) >= 0.5}[mode]
    for r in matching.aligned(pd, gd, mode).collect():
        mine, labels, taken = (sorted([s for s in side if s[0] == r.record_id], key=order) for side in (p, g, []))
        for y in labels:
            taken += [i for i, x in enumerate(mine) if i not in taken and fits(x, y)][:1]
        assert (r.tp, r.predicted, r.gold) == (len(taken), len(mine), len(labels))
    r = matching.aligned(*many, mode).first()
    assert (r.tp, r.predicted, r.gold) == (100_000 if mode in ("strict", "exact") else 200_000, 200_000, 200_000)


def test_scores_by_group_of_repeated_spans(spark, many):
    records = spark.createDataFrame([("r", "en")], "record_id string, language string")
    assert [tuple(r)[:4] for r in matching.scores_by(*many, records, "language", "type").collect()] == [("en", 200_000, 200_000, 200_000)]
