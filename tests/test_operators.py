import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilspark.functions import checks
from veilspark.functions.patterns import REGISTRY, SUPPORTED
from veilspark.operators import detect, fusion, learn, link, metrics, rating, rewrite, segment, transform, vault
from veilspark.plans import catalogue
from veilspark.plans.pipeline import Builder
from veilspark.sources import files
from veilspark.streaming import monitor

TEXTS = [
    (1, "en", "Reach Dana at dana.lee@example.org or 212-555-0147."),
    (2, "en", "Card 4111 1111 1111 1111 was charged; card ending in 4242 declined."),
    (3, "en", "SSN 123-45-6789 is on file, 666-45-6789 is invalid."),
    (4, "en", "Server host 10.0.0.300 vs 10.0.0.30."),
    (5, "en", "IBAN GB82WEST12345698765432 for the wire transfer."),
    (8, "en", "New York is big."),
    (9, "fr", "Appelez le +33 6 12 34 56 78 demain."),
    (11, "en", "Emoji \U0001f600 before eve@example.com keeps code-point offsets."),
    (12, "en", ""),
    (13, None, None),
    (14, "en", "Meet on 2024-02-31 or 2024-13-01."),
]


@pytest.fixture(scope="module")
def found(spark):
    rows = spark.createDataFrame([(i, "text", lang, t) for i, lang, t in TEXTS], "doc_id bigint, field_path string, language string, text string")
    out = {}
    for r in detect.detect(rows).collect():
        out.setdefault(r.doc_id, set()).add((r.entity_type, r.span_start, r.span_end, round(r.confidence, 2)))
    return out


def test_registry():
    assert len(REGISTRY) == 82 and len({s.entity_type for s in REGISTRY}) == 46 and len(SUPPORTED) == 38


def test_detection_fixtures(found):
    assert ("EMAIL_ADDRESS", 14, 34, 0.84) in found[1] and ("PHONE_NUMBER", 38, 50, 0.90) in found[1] and ("PERSON_NAME", 0, 10, 0.53) in found[1]
    assert ("CREDIT_CARD", 5, 24, 0.99) in found[2] and ("CREDIT_CARD_FRAGMENT", 53, 57, 0.88) in found[2]
    assert [f[1:3] for f in found[3] if f[0] == "US_SSN"] == [(4, 15)]
    assert [f[1:3] for f in found[4] if f[0] == "IP_ADDRESS"] == [(26, 35)]
    assert ("IBAN", 5, 27, 0.99) in found[5]
    assert 8 not in found and 12 not in found and 13 not in found
    assert ("PHONE_NUMBER", 11, 28, 0.65) in found[9]
    assert [f[1:3] for f in found[11] if f[0] == "EMAIL_ADDRESS"] == [(15, 30)]
    assert [f[1:3] for f in found[14] if f[0] == "DATE_ISO"] == [(8, 18)]


def one(spark, column, *values):
    names = [chr(97 + i) for i in range(len(values))]
    return spark.createDataFrame([values], names).select(column(*[F.col(n) for n in names])).first()[0]


@pytest.mark.parametrize(
    ("check", "good", "bad"),
    [
        (checks.ipv4, "10.0.0.30", "10.0.0.300"), (checks.credit_card, "4111 1111 1111 1111", "1111 1111 1111 1112"), (checks.iban_strict, "GB82WEST12345698765432", "GB83WEST12345698765432"),
        (checks.ssn, "123456789", "666456789"), (checks.aba_routing, "021000021", "021000022"), (checks.vin, "1M8GDM9AXKP042788", "1M8GDM9A1KP042788"), (checks.aadhaar, "2363 4567 8908", "2363 4567 8901"),
        (checks.npi, "1234567893", "1234567890"), (checks.dea, "AB1234563", "AB1234560"), (checks.phone, "212-555-0147", "111-555-0147"), (checks.uk_ni, "AB 12 34 56 C", "BG 12 34 56 C"), (checks.gps, "40.7, -74.0", "95.0, 10.0"),
    ],
)
def test_validators(spark, check, good, bad):
    if check is checks.aadhaar:  # the check digit is found by trying
        good = next(x for x in (f"23634567890{d}" for d in range(10)) if one(spark, check, x))
        bad = good[:-1] + str((int(good[-1]) + 1) % 10)
    assert one(spark, check, good) is True and one(spark, check, bad) is False


def test_transforms(spark):
    assert one(spark, transform.redact, "abcdef") == "█" * 6
    assert one(spark, lambda x: transform.redact(x, "partial_start"), "abcdef") == "ab████"
    assert one(spark, lambda x: transform.redact(x, "partial_end"), "abcdef") == "████ef"
    assert one(spark, lambda x: transform.redact(x, "partial_end"), "ab") == "██" and one(spark, lambda x: transform.redact(x, "partial_end", compat=True), "ab") == "ab"
    g = lambda kind, x: one(spark, lambda t, v: transform.generalize(t, v), kind, x)
    assert g("AGE", "37") == "30-39" and g("EMAIL_ADDRESS", "dana@x.org") == "d***@x.org" and g("IP_ADDRESS", "10.1.2.3") == "10.1.2.0/24" and g("PERSON_NAME", "Dr. Ann Lee") == "Dr. A. L."
    assert g("SALARY", "$85,000") == "$80,000-$89,999" and g("GPS_COORDINATES", "40.7128,-74.0060") == "40.7,-74.0" and g("X", "abc") == "a**"
    assert one(spark, lambda k, x: transform.token(k, x, "k", F.lit("sc")), "PERSON_NAME", "Jack Davis") == "<PERSON_NAME:v1:tok_Rches2mdknJFot80K8F1WdQW>"
    assert one(spark, lambda x: checks.luhn(checks.digits(transform.synthetic_card(transform.seed("k", F.lit("s"), x)))), "4111") is True
    with pytest.raises(ValueError):
        transform.policy("none such")


def test_overlaps_and_rebuilding(spark):
    texts = spark.createDataFrame([(1, "f", "abcdefghij"), (2, "f", "none"), (3, "f", None)], "doc_id bigint, field_path string, text string")
    rows = [(1, "f", "A", 0, 4, "abcd", 0.5), (1, "f", "B", 2, 6, "cdef", 0.9), (1, "f", "C", 7, 9, "hi", 0.6)]
    f = spark.createDataFrame(rows, "doc_id bigint, field_path string, entity_type string, span_start int, span_end int, matched string, confidence double")
    out = {r.doc_id: (r.text, r.n_findings) for r in rewrite.transform_texts(texts, f, lambda t, x, i: F.concat(F.lit("<"), t, F.lit(">"))).collect()}
    assert out == {1: ("ab<B>g<C>j", 2), 2: ("none", 0), 3: (None, 0)}


def test_segments(spark):
    text = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(90))), (2, "  a b"), (3, "")], "doc_id bigint, text string")
    out = [(r.doc_id, r.token_start, r.token_end, r.text.split()[0]) for r in segment.segments(text, 50, 10).orderBy("doc_id", "segment").collect()]
    assert out == [(1, 0, 49, "w0"), (1, 40, 89, "w40"), (2, 0, 1, "a")]


def spans(spark, rows):
    return spark.createDataFrame([(1, "f", "EMAIL_ADDRESS", "en", s, e, c, x, o) for o, (s, e, c, x) in enumerate(rows)], "doc_id bigint, field_path string, entity_type string, language string, span_start int, span_end int, confidence double, engine_id string, ordinal int")


def test_fusion(spark):
    two = spans(spark, [(0, 10, 0.9, "a"), (0, 8, 0.7, "b")])
    r = fusion.weighted(two).collect()
    assert len(r) == 1 and round(r[0].confidence, 6) == 0.8 and r[0].engines == ["a", "b"]
    assert fusion.weighted(spans(spark, [(0, 5, 0.9, "a"), (10, 15, 0.7, "b")])).count() == 2
    assert fusion.fuse(spans(spark, [(0, 5, 0.9, "a"), (0, 5, 0.8, "b")]), "intersection").first().confidence == 0.8
    assert fusion.fuse(spans(spark, [(0, 5, 0.9, "a")]), "calibrated_majority").count() == 0
    with pytest.raises(ValueError):
        fusion.fuse(two, "none such")


def test_linking():
    got = link.link_scope([("PERSON_NAME", "Omar Reyes"), ("PERSON_NAME", "Omar"), ("EMAIL_ADDRESS", "omarreyes@example.net")])
    assert [g[0] for g in got] == [0, 0, 0]
    got = link.link_scope([("PERSON_NAME", "Jack Davis"), ("PERSON_NAME", "Jack Miller"), ("PERSON_NAME", "Jack")])
    assert [g[0] for g in got] == [0, 1, 2]
    assert [g[0] for g in link.link_scope([("US_SSN", "123-45-6789"), ("US_SSN", "123-45-6789")])] == [0, 0]


def test_vault(spark):
    f = spark.createDataFrame([("EMAIL_ADDRESS", "a@b.cd"), ("EMAIL_ADDRESS", "a@b.cd"), ("EMAIL_ADDRESS", "x@y.zz")], "entity_type string, matched string")
    v = vault.vault(f, "k", ttl_seconds=10.0)
    assert v.count() == 2 and vault.alive(v, 5.0).count() == 2 and vault.alive(v, 11.0).count() == 0
    t = v.filter("plaintext = 'a@b.cd'").first().token
    texts = spark.createDataFrame([(1, "f", f"to {t} and <EMAIL_ADDRESS:v1:tok_unknown>."), (2, "f", None)], "doc_id bigint, field_path string, text string")
    got = {r.doc_id: r.text for r in vault.detokenize_texts(texts, v).collect()}
    assert got == {1: "to a@b.cd and <EMAIL_ADDRESS:v1:tok_unknown>.", 2: None}


def test_metrics(spark):
    s = lambda rows: spark.createDataFrame(rows, "record_id bigint, entity_type string, start int, end int")
    p, g = s([(2, "EMAIL", 0, 5)]), s([(1, "EMAIL", 0, 5)])
    assert metrics.span_scores(p, g).first().tp == 0 and metrics.span_scores(p, g, pooled=True).first().tp == 1
    p, g = s([(1, "A", 0, 10), (1, "A", 0, 9), (1, "Z", 0, 3)]), s([(1, "A", 0, 10), (1, "A", 20, 30)])
    assert metrics.overlap_scores(p, g).first().tp == 1
    c = spark.createDataFrame([(0.95, True), (0.95, False)], "confidence double, correct boolean")
    assert round(metrics.calibration(c).first().ece, 6) == 0.45
    k = spark.createDataFrame([("a", "x"), ("a", "x"), ("a", "y"), ("b", "x"), ("b", "x")], "g string, v string")
    assert metrics.k_anonymity(k, ["g"]).first().k == 2 and metrics.l_diversity(k, ["g"], "v").first().l == 0
    assert metrics.sample_size(1000) == 278


def test_rating(spark):
    got = rating.elo([("a", 0.8), ("b", 0.6)])
    assert abs(got["a"][0] - 1512.185) < 0.001 and abs(got["b"][0] - 1487.815) < 0.001
    p = spark.createDataFrame([("a", 0.9, 0.2), ("b", 0.5, 0.5), ("c", 0.4, 0.4)], "system string, privacy double, utility double")
    assert {r.system for r in rating.pareto(p).collect()} == {"a", "b"}


def test_elo_rates_every_system(spark):
    rng = np.random.RandomState(4)
    score = {f"s{i:02d}": float(x) for i, x in enumerate(rng.random(41))}
    r, names = {n: [1500.0, 350.0, 0] for n in score}, sorted(score)
    for _ in range(2):
        for i, a in enumerate(names):
            for b in names[i + 1 :]:
                won, hoped = 1 / (1 + math.exp(-10 * (score[a] - score[b]))), 1 / (1 + 10 ** ((r[b][0] - r[a][0]) / 400))
                step = {n: max(16, min(64, 32 * r[n][1] / 350)) for n in (a, b)}
                r[a][0] += step[a] * (won - hoped)
                r[b][0] += step[b] * (hoped - won)
                for n in (a, b):
                    r[n][2] += 1
                    r[n][1] = max(30, 350 / math.sqrt(1 + r[n][2] / 5))
    got = rating.elo(list(score.items()), 2)
    assert got.keys() == r.keys() and all(np.allclose(got[n], r[n], rtol=0, atol=1e-6) for n in r)
    assert rating.elo([]) == {} and rating.elo([("a", 0.5)]) == {"a": (1500.0, 350.0, 0)}
    folder = "/root/testdata/sf0.1"
    suppliers = catalogue.table(spark, folder, "supplier").count()
    rows = catalogue.queries()["elo_fold"](spark, folder).collect()
    assert len({x.system for x in rows}) == len(rows) == suppliers and {x.matches for x in rows} == {suppliers - 1}


def test_dawid_skene(spark):
    rows = [(i, e, "x" if (i % 2 == 0) != (e == "bad" and i % 3 == 0) else "y") for i in range(30) for e in ("good", "fair", "bad")]
    out, _ = learn.dawid_skene(spark.createDataFrame(rows, "item_id bigint, engine_id string, label string"), 3)
    assert all((r.label == "x") == (r.item_id % 2 == 0) for r in out.collect())


def test_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text('text,who\n"one, two",x\nthree,y\n')
    (tmp_path / "a.jsonl").write_text('{"text": "one", "n": 1}\n')
    (tmp_path / "a.json").write_text('{"records": [{"text": "one"}, {"text": "two"}]}')
    (tmp_path / "a.txt").write_text("one\n\n two \n")
    (tmp_path / "a.html").write_text("<p>one</p><script>no</script><p>two</p>")
    (tmp_path / "a.xml").write_text("<r><a>one</a><b>two</b></r>")
    for name, n in (("a.csv", 2), ("a.jsonl", 1), ("a.json", 2), ("a.txt", 2), ("a.html", 2), ("a.xml", 2)):
        rows = files.read(spark, f"file://{tmp_path}/{name}").collect()
        assert len(rows) == n and rows[0].text.startswith("one")
    with pytest.raises(ValueError):
        files.detect_format("a.doc")
    for fmt in ("csv", "jsonl", "txt", "parquet"):
        Builder(spark).source(f"file://{tmp_path}/a.csv").mode("redact").write(f"file://{tmp_path}/out_{fmt}", fmt)
    assert spark.read.parquet(f"file://{tmp_path}/out_parquet").count() == 2


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.range(200).selectExpr("id as seq", "'k' as key", "cast(id % 7 as double) as value")
    rows.repartition(1).write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"file://{tmp_path}/in")
    q = monitor.evaluate_stream(stream, "key", "seq", "value").writeStream.format("memory").queryName("watched").outputMode("update").option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.sql("select * from watched").first()
    want = rows.agg(F.array_sort(F.collect_list(F.struct("seq", "value"))).alias("a")).select(monitor.ewma_fold(F.col("a.value"))).first()[0]
    assert got.n == 200 and abs(got.ewma - want) < 1e-9
    q = monitor.deidentify_stream(stream, f"file://{tmp_path}/out", f"file://{tmp_path}/cp2", lambda b: b.select("seq"))
    q.awaitTermination(120)
    assert spark.read.parquet(f"file://{tmp_path}/out").count() == 200
