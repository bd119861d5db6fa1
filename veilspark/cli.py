"""Command line: ``python -m veilspark.cli COMMAND …``, or by spark-submit."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Sequence

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

import veilspark
from veilspark import config
from veilspark.functions.patterns import SUPPORTED, TYPES
from veilspark.operators import detect, fusion, rating, segment
from veilspark.plans import evaluate, pipeline, report
from veilspark.session import ready
from veilspark.sources import datasets, files


def session(args: argparse.Namespace) -> SparkSession:
    return ready(SparkSession.builder.appName("veilspark").getOrCreate())


def one_text(spark: SparkSession, text: str, language: str):
    return spark.createDataFrame([(0, "text", language, text)], "doc_id bigint, field_path string, language string, text string")


def cmd_detect(args) -> int:
    found = detect.detect(one_text(session(args), args.text, args.language))
    print(json.dumps(report.rows_of(found.select("entity_type", "span_start", "span_end", "matched", "confidence").orderBy("span_start", "span_end", "entity_type")), ensure_ascii=False))
    return 0


def cmd_tokenize(args) -> int:
    texts = one_text(session(args), args.text, args.language)
    out, _ = pipeline.deidentify(texts, pipeline.Profile(mode="tokenize", key=args.key))
    print(out.first().text)
    return 0


def cmd_process(args) -> int:
    builder = pipeline.Builder(session(args)).source(args.source, args.format, args.text_column).mode(args.mode).language(args.language)
    builder = builder.key(args.key) if args.key else builder
    builder.write(args.target, args.target_format, "overwrite" if args.overwrite else "errorifexists")
    return 0


def cmd_evaluate(args) -> int:
    records = datasets.evaluation_records(session(args), args.path, args.language)
    predicted = evaluate.predictions(records, detect.detect)
    made = {k: report.rows_of(v) for k, v in evaluate.evaluate(records, predicted).items()}
    print(report.to_json(made) if args.format == "json" else report.to_markdown("Evaluation", made))
    return 0


def cmd_external(args) -> int:
    records = datasets.evaluation_records(session(args), args.path, args.language)
    cards = evaluate.compared(records, dict(x.split("=", 1) for x in args.systems))
    print(report.to_json({"systems": report.rows_of(evaluate.board(cards))}))
    return 0


def cmd_rate(args) -> int:
    cards = session(args).read.option("header", True).option("inferSchema", True).csv(args.path)
    print(report.to_csv(report.rows_of(rating.elo_ratings(cards.select("system", "composite"), rounds=args.rounds).orderBy(F.desc("rating")))))
    return 0


def cmd_compliance(args) -> int:
    spark = session(args)
    print(report.to_json({"standards": report.rows_of(rating.compliance(spark, spark.createDataFrame([(t,) for t in SUPPORTED], "entity_type string")))}))
    return 0


def cmd_generate(args) -> int:
    datasets.write_dataset(datasets.generate(session(args), args.records, args.seed), args.target)
    return 0


def cmd_segments(args) -> int:
    print(report.to_json({"segments": report.rows_of(segment.segments(one_text(session(args), args.text, "en").select("doc_id", "text"), args.max_tokens, args.overlap))}))
    return 0


def cmd_capabilities(args) -> int:
    print(json.dumps({"types": TYPES, "supported": SUPPORTED, "transforms": ["generalize", "perturb", "placeholder", "redact", "synthetic", "tokenize"], "fusion": fusion.MODES}))
    return 0


def cmd_health(args) -> int:
    spark = session(args)
    n = spark.range(100).count()
    print(json.dumps({"spark": spark.version, "tasks": n == 100, "regex": "native"}))
    return 0 if n == 100 else 1


def cmd_config(args) -> int:
    print(json.dumps(config.load(args.path), ensure_ascii=False))
    return 0


def cmd_version(args) -> int:
    print(getattr(veilspark, "__version__", "0"))
    return 0


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="veilspark", description=__doc__)
    sub = out.add_subparsers(dest="command", required=True)

    def add(name: str, run, *arguments):
        p = sub.add_parser(name)
        p.set_defaults(run=run)
        for names, options in arguments:
            p.add_argument(*names, **options)

    a = lambda *names, **options: (names, options)
    text, language, key = a("text"), a("--language", default="en"), a("--key", default="default")
    add("detect", cmd_detect, text, language)
    add("tokenize", cmd_tokenize, text, language, key)
    add("process-file", cmd_process, a("source"), a("target"), a("--format"), a("--target-format", default="parquet"), a("--text-column", default="text"), a("--mode", default="redact"), language, a("--key"), a("--overwrite", action="store_true"))
    add("evaluate", cmd_evaluate, a("path"), a("--language"), a("--format", default="markdown", choices=("json", "markdown")))
    add("compare", cmd_external, a("path"), a("systems", nargs="+", help="name=module:callable"), a("--language"))
    add("rate-elo", cmd_rate, a("path"), a("--rounds", type=int, default=3))
    add("compliance", cmd_compliance)
    add("generate", cmd_generate, a("target"), a("--records", type=int, default=1000), a("--seed", type=int, default=42))
    add("segments", cmd_segments, text, a("--max-tokens", type=int, default=512), a("--overlap", type=int, default=32))
    add("capabilities", cmd_capabilities)
    add("health", cmd_health)
    add("config", cmd_config, a("--path"))
    add("version", cmd_version)
    return out


def main(argv: Sequence[str] | None = None) -> int:
    args = parser().parse_args(argv)
    return args.run(args)


if __name__ == "__main__":
    sys.exit(main())
