"""Validation of a corpus: a manifest, a run over its documents, unchanged sources, manual reviews, and one report of all that."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.operators.checks import changed_sources
from quire.operators.reports import defects, validation_summary, with_reviews
from quire.plans.pipeline import DocumentRun
from quire.plans.scratch import settle
from quire.sources.datasets import manifest_problems, markdown

STAGES = ("extract", "units", "translated", "layout")
CHECKS = ("layout", "terminology", "completeness")


@dataclass
class Validation:
    """results: a row per document of the manifest. found: a row per defect. summary: one row. report: lines of Markdown (place, value)."""

    problems: DataFrame
    results: DataFrame
    found: DataFrame
    summary: DataFrame
    report: DataFrame


def validate_corpus(run: DocumentRun, manifest: DataFrame, before: DataFrame, after: DataFrame, extracted: DataFrame, reviews: DataFrame, root: str, source_hash: str, planned_only: bool = False) -> Validation:
    """manifest: document_id, path. before, after: scans of the files (path, file_size, sha256), taken around the run. extracted: blocks with path (as doc) and error. reviews: doc, checks map."""
    problems = settle(manifest_problems(manifest, before))
    changed = changed_sources(before, after).withColumn("source_changed", F.lit(True))
    if planned_only:
        state = manifest.select("path", F.lit("planned").alias("status"), F.create_map().cast("map<string,string>").alias("stages"))
    else:
        files = run.batch(extracted, root, source_hash)["files"]
        # stages before the one that failed passed, those after it weren't run
        at = {stage: k for k, stage in enumerate(STAGES)}
        failed = F.coalesce(*[F.when(F.col("failed_stage") == stage, k) for stage, k in at.items()], F.when(F.col("outcome") == "ok", len(STAGES)), F.lit(-1))
        stages = F.map_from_arrays(F.array(*[F.lit(stage) for stage in STAGES]), F.array(*[F.when(failed == k, "failed").when(failed > k, "passed").otherwise("not_run") for k in at.values()]))
        state = files.select("path", F.when(F.col("outcome") == "ok", "passed").otherwise("failed").alias("status"), stages.alias("stages"))
    rows = manifest.join(state, "path", "left").join(changed, "path", "left").select(F.col("document_id").alias("doc"), "path", F.coalesce("status", F.lit("failed")).alias("status"), F.coalesce("stages", F.create_map().cast("map<string,string>")).alias("stages"), F.coalesce("source_changed", F.lit(False)).alias("source_changed"))
    results = settle(with_reviews(rows, reviews, CHECKS))
    found, summary = settle(defects(results)), validation_summary(results)
    counted = found.groupBy("doc").agg(F.count("*").alias("defects"))
    report = markdown(results.select("doc", "path", "status", "source_changed", "manual").join(counted, "doc", "left").fillna(0, ["defects"]), "Validation", ("doc",))
    return Validation(problems, results, found, summary, report)
