"""Evaluation end to end, reports, settings, the command line."""

import json

import pytest
from pyspark.sql import functions as F

from veilspark import cli, config
from veilspark.functions.patterns import REGISTRY
from veilspark.operators import compare
from veilspark.operators import detect as D
from veilspark.plans import evaluate, report
from veilspark.plans.scoring_catalogue import FIXTURES
from veilspark.sources import datasets


def system():
    """A system outside, which finds every word with an @; made here so that it is shipped by value."""

    def find_at(text, language):
        at, out = 0, []
        for word in text.split(" "):
            if "@" in word:
                out.append(("EMAIL_ADDRESS", at, at + len(word.rstrip("."))))
            at += len(word) + 1
        return out

    return find_at


def test_every_pattern_is_met_by_a_fixture(spark):
    texts = spark.createDataFrame([(i, "text", g, t) for i, (g, t) in enumerate(FIXTURES)], "doc_id int, field_path string, language string, text string")
    assert {r.spec for r in D.candidates(texts).select("spec").distinct().collect()} == set(range(len(REGISTRY)))


def test_guards_lose_no_match(spark):
    import re

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    found = {(r.doc_id, r.spec, r.span_start) for r in D.candidates(D.document_texts(docs)).collect()}
    want = {(r.doc_id, k, m.start(s.group)) for r in docs.collect() for k, s in enumerate(REGISTRY) if s.language in (None, r.lang) for m in re.compile(s.pattern, s.flags).finditer(r.text or "") if m.start(s.group) < m.end(s.group)}
    assert found == want


def test_evaluation_of_detectors_and_outside_systems(spark, tmp_path):
    records = datasets.benchmark_records(spark, None).withColumn("context_length_tier", F.lit("short"))
    got = evaluate.evaluate(records, evaluate.predictions(records, D.detect))
    assert got["overall"].filter("mode = 'strict'").first().recall == 1.0 and got["by_language"].first().language == "en"
    assert evaluate.quick(records, D.detect, 1).first().records == 1
    find_at = system()
    timed = evaluate.external(records, find_at, warm_up=0)
    card = evaluate.scorecard("mine", records, timed).first()
    assert (card.precision, card.recall, card.samples) == (1.0, 0.5, 2) and card.docs_per_hour > 0
    cards = evaluate.compared(records, {"a": find_at, "b": lambda text, language: []})
    board = evaluate.board(cards).orderBy("rank").collect()
    assert [r.system for r in board] == ["a", "b"]
    with pytest.raises(ValueError):
        evaluate.board(cards, by="name")
    evaluate.save_checkpoint(cards, str(tmp_path / "c"), "p1")
    evaluate.save_checkpoint(cards.withColumn("f1", F.lit(0.0)), str(tmp_path / "c"), "p2")
    assert {r.profile for r in evaluate.merged_checkpoints(spark, str(tmp_path / "c")).collect()} == {"p1"}
    assert evaluate.intervals(records, evaluate.predictions(records, D.detect), draws=20).first().low == 1.0
    assert evaluate.resolve("json:dumps") is json.dumps
    with pytest.raises(ValueError):
        evaluate.resolve("json")


def test_reports_in_every_format(spark, tmp_path):
    df = spark.createDataFrame([("a_b", 0.5, None), ("c|d", 1.0, "x")], "name string, score double, note string")
    made = report.export(df, str(tmp_path), "board", ("json", "md", "csv", "tex"))
    assert json.loads(open(made["json"]).read())["board"][0] == {"name": "a_b", "score": 0.5, "note": None}
    assert "| c\\|d | 1.0000 | x |" in open(made["md"]).read() and open(made["csv"]).read().startswith("name,score,note\na_b,0.5,\n") and "a\\_b & 0.5000" in open(made["tex"]).read()
    assert report.json_array(df, str(tmp_path / "a.json")) == 2 and len(json.loads((tmp_path / "a.json").read_text())) == 2
    assert report.summary([{"mode": "strict", "f1": 0.5, "precision": 0.5, "recall": 0.5}]).startswith("strict: F1 0.500") and report.summary([]) and report.to_csv([]) == "" and "No rows." in report.to_markdown("t", {"x": []})


def test_settings_merge_and_coerce(tmp_path):
    (tmp_path / "c.json").write_text('{"detect": {"min_confidence": 0.6}, "more": 1}')
    got = config.load(str(tmp_path / "c.json"), {"VEILSPARK__detect__min_confidence": "0.7", "VEILSPARK__a__b": "[1, 2]", "OTHER": "x"})
    assert got["detect"]["min_confidence"] == 0.7 and got["more"] == 1 and got["a"] == {"b": [1, 2]} and got["fusion"]["iou"] == 0.5
    assert [config.coerced(x) for x in ("true", "None", "3", "0.5", "{bad", "text")] == [True, None, 3, 0.5, "{bad", "text"]
    (tmp_path / "bad.json").write_text("[")
    with pytest.raises(config.ConfigError):
        config.load(str(tmp_path / "bad.json"), {})
    path = str(tmp_path / "s.json")
    assert config.load_state(path, ("x",)) is None
    config.save_state(path, {"x": 1, "y": 2})
    assert config.load_state(path, ("x",)) == {"x": 1}
    config.save_state(path, {"expert_id": "e", "strengths": {"A": 0.5}})
    assert config.load_manifest(path)["name"] == "e"
    config.save_state(path, {"expert_id": "e", "strengths": {"A": 5}})
    with pytest.raises(config.ConfigError):
        config.load_manifest(path)


def test_pruned_engines_and_convergence(spark):
    rows = [("big", t) for t in "ABCDEFG"] + [("like", t) for t in "ABCDEF"] + [("other", t) for t in "XYZ"] + [("regex", "A")]
    kept = {r.engine_id for r in compare.pruned_engines(spark.createDataFrame(rows, "engine_id string, entity_type string"), force=["regex"]).collect()}
    assert kept == {"big", "other", "regex"}
    ratings = spark.createDataFrame([("a", 1700.0, 50.0), ("b", 1500.0, 60.0)], "system string, rating double, deviation double")
    assert compare.converged(ratings).first().converged and not compare.converged(ratings, 20.0).first().converged
    assert compare.distinct_pairs(ratings).first().significant and compare.rating_intervals(ratings).filter("low < rating and rating < high").count() == 2
    assert compare.tuned(ratings.withColumn("composite", F.col("rating") / 1000)).first().k == 32.0


def test_commands(capsys):
    assert cli.main(["version"]) == 0 and cli.main(["config"]) == 0 and cli.main(["detect", "Write to mara.holt@example.org."]) == 0
    assert "EMAIL_ADDRESS" in capsys.readouterr().out
    assert cli.main(["tokenize", "Write to mara.holt@example.org."]) == 0 and "<EMAIL_ADDRESS:v1:tok_" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        cli.main(["nothing"])
