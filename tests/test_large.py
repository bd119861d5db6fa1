"""Operators whose cost a row or a group was out of proportion, against plain Python."""

import random
import re
import time
from functools import reduce
from itertools import permutations
from operator import add

from pyspark.sql import functions as F

from veilspark.functions.patterns import REGISTRY
from veilspark.operators import detect, link, rating, routing, siv, transform
from veilspark.plans.scoring_catalogue import FIXTURES


def walk(x, s, gain):
    out = ""
    for ch in x:
        if ch in "0123456789":
            out, s = out + str(s % 10), s // 10 + gain
        else:
            out += ch
    return out


def luhn(digits):
    return sum(d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def test_seeds_walks_and_dates(spark):
    seeds = [0, 1, 9, 10, 333, 2**31, 2**63 - 1, 2**63, 2**64 - 1, 12345678901234567890]
    x = "+1 (212) 555-0147 x" + "9" * 40
    s = F.col("s").cast("decimal(20,0)")
    rows = spark.createDataFrame([(str(v),) for v in seeds], "s string").select(
        "s", transform._digit_walk(F.lit(x), s).alias("walk"), transform.synthetic_card(s).alias("card"), transform.synthetic_zip(F.lit("12345-6789"), s).alias("zip"), transform._mod(s, 97, 20).alias("mod"),
        transform.synthetic_date(F.lit("on 1996/2-29, late"), s).alias("date"), transform.synthetic_date(F.lit("never"), s).alias("none"), transform._digit_walk(F.lit("none"), s).alias("bare"),
    ).collect()
    for r in rows:
        v = int(r.s)
        card = r.card.replace("-", "")
        assert r.walk == walk(x, v, 7) and r.bare == "none" and r.none == "never"
        assert card[:15] == "4" + walk("0" * 14, v, 3) and luhn(card) and len(card) == 16 and r.card.count("-") == 3
        assert r.zip == f"{v % 10**9:09d}"[:5] + "-" + f"{v % 10**9:09d}"[5:] and r.mod == (v >> 20) % 97
        assert r.date == f"{1996 + v % 5 - 2}/{2 + (v >> 8) % 3:02d}/28"


def test_cards_are_cheap(spark):
    """A card was 16 seconds for 15,000 rows."""
    cards = spark.range(40_000).select(transform.synthetic_card(F.col("id").cast("decimal(20,0)") * 1_000_003).alias("card"))
    cards.limit(1).collect()
    began = time.time()
    cards.coalesce(1).write.format("noop").mode("overwrite").save()
    assert time.time() - began < 20


def test_a_mean_at_the_threshold_is_not_below_it_in_any_order(spark):
    values = [0.7, 0.1, 0.2 + 0.1, 0.8 + 0.1, 0.5 + 0.1, 0.4]  # their mean is 0.5, their sum depends on the order
    assert {reduce(add, p) / 6 < 0.5 for p in permutations(values)} == {True, False}
    rows = [(k, x) for k, p in enumerate(permutations(values)) for x in p]
    found = spark.createDataFrame(rows, "doc_id bigint, confidence double").coalesce(1)
    more = spark.createDataFrame([(-1, 0.49), (-1, 0.5)], "doc_id bigint, confidence double")
    texts = spark.range(-2, 720).withColumnRenamed("id", "doc_id")
    assert {r.doc_id for r in routing.needy(found.unionByName(more), texts, 0.5).collect()} == {-2, -1}


def test_tokens_are_cheap_and_as_before(spark):
    """60,000 names there and back; the first tokens are those that the plan of Spark's functions gave."""
    names = spark.range(60_000).select("id", F.concat(F.lit("Name "), "id", F.lit(" of some length")).alias("matched"), F.lit("PERSON_NAME").alias("entity_type"))
    began = time.time()
    back = siv.detokenize(siv.tokenize(names, "k"), "k")
    assert back.filter(F.col("plaintext") == F.col("matched")).count() == 60_000
    assert time.time() - began < 60
    rows = spark.createDataFrame([(0, "", "A"), (1, "é" * 20, "B"), (2, None, "A"), (3, "x", None)], "id int, matched string, entity_type string")
    got = {r.id: r.token for r in siv.tokenize(rows, "k").collect()}
    assert got == {0: '<A:v1:aes_mO25OHvRjf6F9pX7zy7qbQ>', 1: '<B:v1:aes_Eb-Nzg6d8fxZnKK_eAa3N3UG2AEQmWKBMUXbS6ZsR4V-RjwfUimdbaEt4Wjis9o5IqPRyppwz1Q>', 2: None, 3: None}


def test_patterns_start_at_their_places():
    """All matches of the patterns that are tried at some places only, in texts that hold something for every pattern and in scrambled ones."""
    rng, fixtures = random.Random(3), [t for _, t in FIXTURES]
    pieces = sorted({x for t in fixtures for x in re.findall(r"\w+|\W", t)}) + ["é", "É", "_", "٣", "\n", "1", "A", "-", ".", "("]
    texts = fixtures + ["".join(x) for x in (rng.choices(pieces, k=60) for _ in range(400))] + ["".join(rng.choices("AaB1 9.-+(é_", k=80)) for _ in range(400)]
    texts += [" ".join(rng.sample(fixtures, 3)) for _ in range(40)]
    placed = [(s, detect.places(s)) for s in REGISTRY if detect.places(s)]
    assert len(placed) >= 30
    for s, where in placed:
        rx = re.compile(s.pattern, s.flags)
        for t in texts:
            starts = [m.start() for m in detect.PLACES[where][1].finditer(t)]
            assert [m.regs for m in detect._matches(rx, t, starts)] == [m.regs for m in rx.finditer(t)], (s.pattern, t)


def test_many_small_scopes_are_linked_in_batches(spark):
    """20,000 documents, none of which is a group of its own for Python."""
    kinds = F.array(F.lit("Omar"), F.lit("omarreyes@example.net"), F.lit("Omar Reyes"))
    at = F.posexplode(kinds).alias("k", "matched")
    found = spark.range(20_000).select(F.col("id").alias("doc_id"), at).select("doc_id", F.when(F.col("k") == 1, "EMAIL_ADDRESS").otherwise("PERSON_NAME").alias("entity_type"), (50 - F.col("k") * 20).alias("span_start"), (60 - F.col("k") * 20).alias("span_end"), "matched")
    linked = link.link(found).groupBy("span_start", "placeholder_index", "cluster_id", "rule").count().orderBy("span_start").collect()
    assert [tuple(r) for r in linked] == [(10, 0, "PERSON_NAME:0", "new", 20_000), (30, 0, "PERSON_NAME:0", "email is the full name", 20_000), (50, 0, "PERSON_NAME:0", "first name", 20_000)]
    assert "FlatMapGroupsInPandas" not in link.link(found)._jdf.queryExecution().executedPlan().toString()


def test_elo_by_blocks_is_elo(spark):
    """Groups of several blocks, the last of them short, in one process and over all cores."""
    rng = random.Random(5)
    score = {f"s{i:02d}": rng.random() for i in range(41)}
    want = rating.elo(score.items(), 2)
    assert all(rating.elo(score.items(), 2, block=n) == want for n in (1, 7, 40, 41))
    rows = spark.createDataFrame([(g, n, x) for g in ("a", "b") for n, x in score.items()] + [("c", "one", 0.5), (None, "two", 0.4)], "g string, system string, composite double")
    got = rating.elo_ratings(rows, "g", 2, rating.Elo(block=7)).collect()
    assert len(got) == 84 and all((r.rating, r.deviation, r.matches) == want[r.system] for r in got if r.grp in ("a", "b"))
    assert {(r.grp, r.system, r.rating, r.matches) for r in got if r.grp not in ("a", "b")} == {("c", "one", 1500.0, 0), (None, "two", 1500.0, 0)}
