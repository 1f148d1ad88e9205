"""Translation benchmarks: samples through a model, findings by stage, status, summary and comparison with a baseline."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.text import CORE_MARK, protect, restore_one, segment
from quire.operators.quality import REVIEW, analyse, analyse_trace, review_findings, stage_summary, statuses
from quire.operators.translate import Measured, PrefixTranslator
from quire.plans.options import TranslationOptions
from quire.plans.scratch import settle

# The stages of a report, in its order.
STAGES = ("extraction", "segmentation", "protected_token", "model", "terminology", "rendering")


def evaluate(texts: DataFrame, o: TranslationOptions, translator: type = PrefixTranslator) -> DataFrame:
    """source, output, n_segments, n_outputs, forced, protection_error, runtime_error, calls and seconds of each text. A model that fails or miscounts is evidence, not a failure. texts: source."""
    rows = texts.withColumn("p", protect(F.col("source"))).withColumn("s", segment(F.col("p.text"), o.token_limit, translator().count_tokens))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, core = None, re.compile(CORE_MARK)
        for batch in batches:
            model = model or Measured(translator())
            out = []
            for segments, tokens in zip(batch["segments"], batch["tokens"], strict=True):
                pieces, error, failed, output = [x["text"] for x in segments], None, None, None
                done: list[str] = []
                calls, seconds = model.calls, model.seconds
                try:
                    for i in range(0, len(pieces), o.batch_size):
                        done += model.translate_batch(pieces[i : i + o.batch_size])
                    output = " ".join(done)
                    if len(done) == len(pieces):
                        joined = "".join(d + x["separator"] for d, x in zip(done, segments, strict=True))
                        output = restore_one(joined, tokens, core)
                        if output is None:
                            output, failed = joined, "a protected token is missing"
                except (RuntimeError, ValueError, MemoryError) as e:
                    error = f"{type(e).__name__}: {e}"
                out.append((output, len(pieces), len(done), failed, error, model.calls - calls, model.seconds - seconds))
            found = pd.DataFrame(out, columns=["output", "n_segments", "n_outputs", "protection_error", "runtime_error", "calls", "seconds"])
            yield pd.concat([batch[["source", "forced"]].reset_index(drop=True), found], axis=1)

    schema = "source string, forced boolean, output string, n_segments int, n_outputs int, protection_error string, runtime_error string, calls int, seconds double"
    return rows.select("source", F.col("s.segments").alias("segments"), F.col("s.forced").alias("forced"), F.col("p.tokens").alias("tokens")).mapInPandas(run, schema)


def run_benchmark(samples: DataFrame, o: TranslationOptions = TranslationOptions(), translator: type = PrefixTranslator) -> tuple[DataFrame, DataFrame]:
    """Results (sample_id, category, status, output, cache_hit, n_findings) and findings. Each distinct text goes through the model once; every sample is analysed.

    samples: sample_id, place, category, source, protected_tokens, stage_trace (struct) and human_review (struct).
    """
    rows = samples.withColumn("effective", F.coalesce("stage_trace.extracted_text", "source"))
    first = rows.groupBy("effective").agg(F.min("place").alias("first_place"))
    done = settle(evaluate(first.select(F.col("effective").alias("source")), o, translator)).withColumnRenamed("source", "effective")
    whole = rows.join(done, "effective").join(first, "effective").withColumn("cache_hit", F.col("place") != F.col("first_place"))
    none = F.array().cast("array<string>")
    current = whole.where("runtime_error IS NULL").select("sample_id", F.col("effective").alias("source"), "output", F.coalesce("protected_tokens", none).alias("protected"), "n_segments", "n_outputs", "forced", "protection_error")
    failed = whole.where("runtime_error IS NOT NULL").select("sample_id", F.lit("benchmark-execution-error").alias("code"), F.lit("model").alias("stage"), F.lit("error").alias("severity"), F.array("runtime_error").alias("evidence"), F.lit("current_run").alias("origin"))
    reviewed = review_findings(samples.where("human_review IS NOT NULL").select("sample_id", *[F.col(f"human_review.{c}").alias(c) for c, _ in REVIEW]), "sample_id")
    reviewed = reviewed.select("sample_id", "code", "stage", "severity", none.alias("evidence"), F.lit("current_run").alias("origin"))
    trace = samples.where("stage_trace IS NOT NULL").select("sample_id", "source", F.col("stage_trace.extracted_text").alias("extracted"), F.col("stage_trace.observed_translation").alias("observed"), F.col("stage_trace.rendered_text").alias("rendered"), "stage_trace.source_segments", "stage_trace.translated_segments", F.coalesce("protected_tokens", none).alias("protected"))
    findings = settle(analyse(current).unionByName(failed).unionByName(reviewed).unionByName(analyse_trace(trace)))
    counts = findings.groupBy("sample_id").agg(F.count("*").alias("n_findings"))
    results = statuses(whole, findings).join(whole.select("sample_id", "category", "output", "cache_hit"), "sample_id").join(counts, "sample_id", "left")
    return results.select("sample_id", "category", "status", "output", "cache_hit", F.coalesce("n_findings", F.lit(0)).alias("n_findings")), findings


def benchmark_summary(results: DataFrame) -> DataFrame:
    n = lambda s: F.count_if(F.col("status") == s).alias(f"n_{s}")
    return results.agg(F.count("*").alias("n_samples"), n("passed"), n("failed"), n("error"), F.count_if("cache_hit").alias("n_hits"), F.count_if(~F.col("cache_hit")).alias("n_misses"))


def stage_table(findings: DataFrame) -> DataFrame:
    """Current and historical findings of all six stages, also of those without any."""
    every = findings.sparkSession.createDataFrame([(i, s) for i, s in enumerate(STAGES)], "place int, stage string")
    return every.join(stage_summary(findings), "stage", "left").fillna(0, ["n_current", "n_historical", "n_errors"])
