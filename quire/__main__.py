"""Thin commands over the operators: python -m quire COMMAND ... Tables are Parquet folders; results are written, and what is said is one line of JSON."""

from __future__ import annotations

import argparse
import json
import sys

import pyspark
from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quire.operators import benchmark, quality
from quire.operators.pages import classify_pages, inspect, page_text
from quire.operators.paragraphs import paragraph_metrics, paragraphs_of
from quire.operators.reports import EXIT_CODES
from quire.operators.translate import run_counters
from quire.plans.options import TranslationOptions
from quire.plans.pipeline import DocumentRun
from quire.sources.datasets import markdown, read_samples, write_text
from quire.sources.files import Memory


def doctor(spark: SparkSession, a: argparse.Namespace) -> dict:
    return {"pyspark": pyspark.__version__, "python": sys.version.split()[0], "master": spark.sparkContext.master, "checkpoints": spark.conf.get("spark.checkpoint.dir", None)}


def inspect_pages(spark: SparkSession, a: argparse.Namespace) -> dict:
    pages = classify_pages(page_text(spark.read.parquet(a.blocks)).withColumns({"images": F.lit(0), "image_area": F.lit(0.0)}))
    inspect(pages, "doc").write.parquet(a.out)
    return inspect(pages).first().asDict()


def reconstruct(spark: SparkSession, a: argparse.Namespace) -> dict:
    blocks = spark.read.parquet(a.blocks)
    paragraphs, decisions = paragraphs_of(blocks)
    paragraphs.write.parquet(f"{a.out}/paragraphs")
    decisions.write.parquet(f"{a.out}/decisions")
    return paragraph_metrics(blocks, by=()).first().asDict()


def translate(spark: SparkSession, a: argparse.Namespace) -> dict:
    run = DocumentRun(spark, translation=TranslationOptions(batch_size=a.batch_size, token_limit=a.token_limit))
    made = run.run(spark.read.parquet(a.blocks), a.out, a.source_hash, Memory(spark, a.memory) if a.memory else None)
    return run_counters(made["translated"]).first().asDict()


def benchmark_translation(spark: SparkSession, a: argparse.Namespace) -> dict:
    samples = read_samples(spark, a.samples).withColumn("place", F.monotonically_increasing_id())
    results, findings = benchmark.run_benchmark(samples, TranslationOptions(batch_size=a.batch_size, token_limit=a.token_limit))
    results.write.parquet(f"{a.out}/results")
    findings.write.parquet(f"{a.out}/findings")
    write_text(markdown(results.drop("output"), "Translation benchmark", ("sample_id",)), f"{a.out}/report")
    said = benchmark.benchmark_summary(results).first().asDict()
    if a.baseline:
        changes = quality.compare_with_baseline(spark.read.parquet(f"{a.baseline}/results"), results)
        quality.finding_changes(spark.read.parquet(f"{a.baseline}/findings"), findings).write.parquet(f"{a.out}/finding_changes")
        said |= {f"n_{r['change']}": r["count"] for r in changes.groupBy("change").count().collect()}
    return said


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quire", description=__doc__)
    commands = p.add_subparsers(dest="command", required=True)
    add = lambda name, run, *names: [c := commands.add_parser(name), c.set_defaults(run=run), *[c.add_argument(n) for n in names]][0]
    add("doctor", doctor)
    add("inspect", inspect_pages, "blocks", "out")
    add("reconstruct", reconstruct, "blocks", "out")
    for name, run, names in (("translate", translate, ("blocks", "out", "source_hash")), ("benchmark-translation", benchmark_translation, ("samples", "out"))):
        c = add(name, run, *names)
        c.add_argument("--batch-size", type=int, default=8)
        c.add_argument("--token-limit", type=int, default=512)
        c.add_argument("--memory" if name == "translate" else "--baseline")
    return p


def main(arguments: list[str] | None = None) -> int:
    try:
        a = parser().parse_args(arguments)
    except SystemExit as e:
        return EXIT_CODES["success"] if not e.code else EXIT_CODES["invalid_arguments"]
    try:
        print(json.dumps(a.run(SparkSession.builder.appName("quire").getOrCreate(), a)))
    except AnalysisException as e:  # a table that isn't there, or that would be written over
        print(json.dumps({"error": str(e).split("\n")[0]}), file=sys.stderr)
        return EXIT_CODES["input_error"]
    except ValueError as e:
        print(json.dumps({"error": str(e)}), file=sys.stderr)
        return EXIT_CODES["invalid_arguments"]
    return EXIT_CODES["success"]


if __name__ == "__main__":
    sys.exit(main())
