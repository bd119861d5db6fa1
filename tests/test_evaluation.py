"""Alignment, resampling, routing, datasets, keys and AES-SIV beyond what SQL says of them."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilspark.operators import fusion, keys, learn, matching, metrics, resample, routing, segment, siv, utility
from veilspark.sources import datasets

SPAN = "record_id string, entity_type string, start int, end int"


def first_fit(p, g, fits):
    taken = set()
    for label in sorted(g, key=lambda s: (s[2], s[3], s[1])):
        for i, x in enumerate(sorted(p, key=lambda s: (s[2], s[3], s[1]))):
            if i not in taken and fits(x, label):
                taken.add(i)
                break
    return len(taken)


def test_first_fit_by_every_rule(spark):
    rng = np.random.RandomState(2)
    make = lambda: [(f"r{rng.randint(6)}", "AB"[rng.randint(2)], int(a), int(a + 1 + rng.randint(6))) for a in rng.randint(0, 20, 60)]
    p, g = make(), make()
    over = lambda x, y: min(x[3], y[3]) - max(x[2], y[2])
    rules = {
        "strict": lambda x, y: x[1:] == y[1:], "exact": lambda x, y: x[2:] == y[2:], "type": lambda x, y: x[1] == y[1] and over(x, y) > 0,
        "partial": lambda x, y: over(x, y) > 0 and over(x, y) / (x[3] - x[2] + y[3] - y[2] - over(x, y)) >= 0.5,
    }
    pd, gd = spark.createDataFrame(p, SPAN), spark.createDataFrame(g, SPAN)
    for mode, fits in rules.items():
        got = {r.record_id: r.tp for r in matching.aligned(pd, gd, mode).collect()}
        assert got == {k: first_fit([x for x in p if x[0] == k], [y for y in g if y[0] == k], fits) for k in got}, mode
    none = spark.createDataFrame([], SPAN)
    assert matching.alignment_scores(none, none, ["strict"]).first().f1 == 0.0
    assert matching.aligned(pd, none, "type").agg(F.sum("tp")).first()[0] == 0


def test_weights_are_poisson_and_intervals_cover(spark):
    w = np.array([resample.weights(np.arange(20_000), d) for d in range(20)])
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.03 and abs(np.corrcoef(w[0], w[1])[0, 1]) < 0.03
    rng = np.random.RandomState(1)
    rows = spark.createDataFrame([(i, float(a), float(a + b)) for i, (a, b) in enumerate(zip(rng.normal(0, 1, 400), rng.normal(0.5, 1, 400), strict=True))], "id bigint, a double, b double")
    r = resample.paired(rows, "b", "a", draws=300).first()
    assert r.low < 0.5 < r.high and r.p_value < 0.01
    assert 0.3 < resample.paired(rows, "b", "a", draws=300, compat=True).first().p_value < 0.7
    i = resample.interval(rows, "a", draws=300).first()
    assert i.low < 0 < i.high and abs(i.error - 0.05) < 0.015
    assert resample.interval(rows.limit(0), "a", draws=10).first().low is None


def test_plans_and_registries(spark):
    can = {"regex-oss": routing.Capability(), "stanza-ner-compatible": routing.Capability(("en",)), "presidio-compatible": routing.Capability(("es",), False)}
    assert routing.available_engines(can, "fr") == ("regex-oss", "stanza-ner-compatible")
    assert routing.select("short_chat", "speed", "en", can).engines == ("stanza-ner-compatible",)
    plan = routing.select("long_document", "balanced", "en", can)
    assert plan.may_segment and plan.escalates and plan.escalation == ("stanza-ner-compatible",)
    assert routing.resolve(plan, ["presidio-compatible"]).engines == ("presidio-compatible",)
    assert routing.resolve(routing.select("default", "", "en", can), ["b", "a"]).engines == ("a", "b")
    engines = routing.Engines()
    finding = lambda c: lambda t: t.filter("text != ''").select("doc_id", "field_path", F.lit("US_SSN").alias("entity_type"), "language", F.lit(0).alias("span_start"), F.lit(3).alias("span_end"), F.lit(c).alias("confidence"), F.lit(f"e{c}").alias("engine_id"), F.lit(0).alias("ordinal"))
    engines.register("regex-oss", finding(0.4))
    engines.register("stanza-ner-compatible", finding(0.9))
    engines.register("off", finding(0.1), enabled=False)
    assert engines.names() == ("regex-oss", "stanza-ner-compatible") and engines.health()["off"] == "disabled" and engines.discover() == []
    texts = spark.createDataFrame([(1, "text", "en", "one two three"), (2, "text", "en", "")], "doc_id bigint, field_path string, language string, text string")
    out = routing.detect_by_plan(texts, plan, engines).collect()
    assert [(r.doc_id, round(r.confidence, 6), r.engines) for r in out] == [(1, 0.65, ["e0.4", "e0.9"])]
    long = routing.detect_by_plan(texts.withColumn("text", F.repeat(F.lit("word "), 50)), plan, engines, routing.Settings(segment_tokens=10), 20, 5)
    assert {r.span_start for r in long.filter("doc_id = 1").collect()} == {0, 75, 150}
    named = routing.Strategies({"redact": len})
    with pytest.raises(ValueError):
        named.register("redact", len)
    assert named.names() == ("redact",)


def test_chunks_read_on(spark):
    t = spark.createDataFrame([(1, " ".join("ab" for _ in range(90))), (2, " ".join("ab" for _ in range(50))), (3, "")], "doc_id bigint, text string")
    assert [(r.doc_id, r.token_start, r.token_end) for r in segment.chunks(t, 50, 10).orderBy("doc_id", "segment").collect()] == [(1, 0, 49), (1, 40, 89), (1, 80, 89), (2, 0, 49), (2, 40, 49)]


def test_siv_vectors_of_the_rfc(spark):
    h = bytes.fromhex
    s = siv.Siv(spark, h("fffefdfcfbfaf9f8f7f6f5f4f3f2f1f0f0f1f2f3f4f5f6f7f8f9fafbfcfdfeff"))
    ad = [F.lit(h("101112131415161718191a1b1c1d1e1f2021222324252627"))]
    made = s.encrypt(spark.range(1), F.lit(h("112233445566778899aabbccddee")), ad, "c")
    assert bytes(made.first().c) == h("85632d07c6e8f37f950acd320a2ecc9340c02b9690c4dc04daef7f6afe5c")
    assert bytes(s.decrypt(made, F.col("c"), ad, "p").first().p) == h("112233445566778899aabbccddee")
    assert s.decrypt(made, F.col("c"), [F.lit(b"other")], "p").first().p is None


def test_siv_tokens_of_any_length(spark):
    rows = [(i, t) for i, t in enumerate(["", "a", "fifteen letters", "sixteen letters!", "x" * 33, "Åsa 😀 Öberg", None])]
    df = spark.createDataFrame(rows, "i int, matched string").withColumn("entity_type", F.lit("PERSON_NAME"))
    back = siv.detokenize(siv.tokenize(df, "k"), "k").collect()
    assert {r.i: r.plaintext for r in back} == dict(rows)
    assert {r.plaintext for r in siv.detokenize(siv.tokenize(df, "k"), "another").collect()} == {None}


def test_keys_rotate_expire_and_retire():
    now = [0.0]
    m = keys.KeyManager("first", ttl_seconds=10, clock=lambda: now[0])
    assert m.rotate("second", ttl_seconds=100) == 2 and m.get(1) == "first" and m.get() == "second"
    now[0] = 50
    assert not m.is_valid(1) and m.is_valid(2)
    with pytest.raises(ValueError):
        m.get(1)
    m.retire(1)
    with pytest.raises(KeyError):
        m.get(1)
    with pytest.raises(ValueError):
        m.retire(2)
    assert [v.version for v in m.versions()] == [1, 2]


def test_ledgers_merge_and_keep_the_newest_scopes(spark):
    m = spark.createDataFrame([("s", 1, "Ann", 1), ("s", 1, "Ann Lee", 2), ("t", 1, "Bo", 1)], "scope string, cluster int, alias string, at int")
    made = keys.ledger(m).withColumn("seen", F.when(F.col("scope") == "s", 1).otherwise(2))
    out = {(r.scope, r.canonical, r.mentions) for r in keys.merge_ledgers(made, made).collect()}
    assert out == {("s", "Ann Lee", 4), ("t", "Bo", 2)}
    assert [r.scope for r in keys.merge_ledgers(made, made, 1).collect()] == ["t"]
    assert {(r.alias, tuple(r.clusters)) for r in keys.alias_index(made).collect()} == {("ann", (1,)), ("ann lee", (1,)), ("bo", (1,))}


def test_dataset_files(spark, tmp_path):
    rows = [
        {"record_id": "a", "text": "Ann Lee here", "labels": [{"entity_type": "PERSON_NAME", "start": 0, "end": 7}], "language": "en"}, {"id": "b", "text": "", "labels": []},
        {"id": "c", "text": "xy", "annotations": [{"entity_type": "TAX_ID", "start": 0, "end": 9}], "language": "fr", "adversarial": {"type": "typo", "difficulty": "hard"}, "provenance": {"source_type": "curated_public"}},
    ]
    path = tmp_path / "d.jsonl"
    path.write_text("\n".join(map(json.dumps, rows)) + "\nnot json\n")
    got = {r.record_id: r for r in datasets.evaluation_records(spark, str(path)).collect()}
    assert set(got) == {"a", "c"} and got["c"].labels == [] and got["c"].source_type == "curated_public" and got["c"].adversarial_difficulty == "hard"
    assert [r.record_id for r in datasets.evaluation_records(spark, str(path), adversarial_only=True).collect()] == ["c"]
    assert datasets.dataset_path("d", [str(tmp_path)]) == str(path) and datasets.dataset_path("e", [str(tmp_path)]) is None
    with pytest.raises(Exception, match="invalid benchmark row"):
        datasets.benchmark_records(spark, str(path)).collect()
    assert {r.record_id for r in datasets.benchmark_records(spark, None).collect()} == {"default-1", "default-2"}
    datasets.register_loader("mine", lambda s: datasets.training_rows(s, str(path)), replace=True)
    assert datasets.load_training(spark, ["mine", str(path)]).count() == 4
    with pytest.raises(ValueError):
        datasets.register_loader("a/b", len)
    (tmp_path / "m.json").write_text(json.dumps({"profiles": [{"profile": "chat", "objective": "speed", "required": True, "languages": ["en"], "max_samples": 5}]}))
    assert datasets.profiles(spark, str(tmp_path / "m.json")).first().profile == "chat"


def test_generated_records_hold_their_spans_and_come_again(spark):
    g = datasets.generate(spark, 200, weights={"en": 3, "de": 1})
    rows = g.collect()
    for r in rows:
        for x in r.labels:
            assert r.text[x.start : x.end] in datasets.VALUES[x.entity_type]
    assert {r.language for r in rows} == {"en", "de"}
    a = datasets.checksum(g, ["record_id", "text"]).first()
    assert a == datasets.checksum(datasets.generate(spark, 200, weights={"en": 3, "de": 1}).repartition(3), ["record_id", "text"]).first() and a.n == 200


def test_offline_calibration_counts_engines_that_found_nothing(spark):
    gold = spark.createDataFrame([("r", "A", i, i + 1) for i in range(5)], SPAN)
    p = spark.createDataFrame([("r", "A", 0, 1, "x"), ("r", "B", 0, 1, "y")], SPAN + ", engine_id string")
    assert {(r.engine_id, r.entity_type, r.recall) for r in learn.offline_calibration(p, gold).collect()} == {("x", "A", 0.2), ("y", "A", 0.0)}


def test_flipped_labels_and_utility(spark):
    df = spark.range(4000).select("id", F.lit("A").alias("a"))
    share = utility.flipped(df, ("A", "B", "C"), 0.05).filter("b != a").count() / 4000
    assert 0.03 < share < 0.07
    one = spark.createDataFrame([("Good day. Bad luck!", "Good day.")], "a string, b string")
    r = one.select(utility.task_utility(F.col("a"), F.col("b")).alias("t"), F.size(utility.sentences(F.col("a"))).alias("n"), utility.without_spans(F.col("a"), F.expr("array(named_struct('start', 0, 'end', 5), named_struct('start', 9, 'end', 19))")).alias("w")).first()
    assert r.n == 2 and r.w == "day." and 0 < r.t < 1


def fused_by_hand(items, iou=0.5, gap=5):
    """Clusters of (start, end, ordinal, confidence, engine) and what a vote makes of each."""
    rest, out = sorted(items), []
    while rest:
        (s, e, *_), mine, left, past = rest[0], [rest[0]], [], False
        for x in rest[1:]:
            past = past or x[0] >= e + gap
            hull = max(e, x[1]) - min(s, x[0])
            if not past and hull > 0 and max(0, min(e, x[1]) - max(s, x[0])) / hull >= iou:
                s, e = min(s, x[0]), max(e, x[1])
                mine.append(x)
            else:
                left.append(x)
        vote = lambda values: max(dict.fromkeys(values), key=values.count)
        out.append((vote([x[0] for x in mine]), vote([x[1] for x in mine]), round(sum(x[3] for x in mine) / len(mine), 6), tuple(sorted({x[4] for x in mine}))))
        rest = left
    return sorted(out)


def test_fusion_of_overlapping_spans(spark):
    rng = np.random.RandomState(4)
    rows = []
    for i in range(160):
        a = int(rng.randint(0, 60))
        rows.append((f"d{i % 4}", "text", "AB"[i % 2], "en", a, a + int(rng.randint(2, 12)), float(rng.randint(3, 10)) / 10, f"e{rng.randint(4)}", i))
    df = spark.createDataFrame(rows, "doc_id string, field_path string, entity_type string, language string, span_start int, span_end int, confidence double, engine_id string, ordinal int")
    groups = {}
    for d, _, t, _, a, z, c, e, o in rows:
        groups.setdefault((d, t), []).append((a, z, o, c, e))
    want = sorted((k, *x) for k, v in groups.items() for x in fused_by_hand(v))
    got = lambda f: sorted(((r.doc_id, r.entity_type), r.span_start, r.span_end, round(r.confidence, 6), tuple(r.engines)) for r in f.collect())
    assert got(fusion.weighted(df)) == want and len(want) < 150
    assert got(fusion.majority(df, 2)) == [x for x in want if len(x[4]) >= 2]


def test_characters_as_intervals(spark):
    rng = np.random.RandomState(6)
    make = lambda: [(f"r{rng.randint(4)}", "AB"[rng.randint(2)], int(a), int(a + rng.randint(0, 7))) for a in rng.randint(0, 25, 50)]
    p, g = make(), make()
    chars = lambda rows: {(r, t, x) for r, t, a, z in rows for x in range(a, z)}
    r = metrics.char_scores(spark.createDataFrame(p, SPAN), spark.createDataFrame(g, SPAN)).first()
    assert (r.tp, r.predicted, r.gold) == (len(chars(p) & chars(g)), len(chars(p)), len(chars(g)))
    none = spark.createDataFrame([], SPAN)
    assert metrics.char_scores(none, none).first().f1 == 0.0
