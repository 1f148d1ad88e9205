"""Batch, validation and diagnostic rollups, and process results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# What a result must agree on.
EXIT_CODES = {"success": 0, "invalid_arguments": 2, "input_error": 3, "ocr_required": 4, "model_unavailable": 5, "translation_failed": 6, "rendering_failed": 7, "output_validation_failed": 8, "ocr_failed": 9, "batch_failed": 10, "diagnostic_publication_failed": 11, "interrupted": 130}


def exit_code(error: Column) -> Column:
    """0 without an error; an unknown one counts as a failed translation."""
    table = F.create_map(*[F.lit(x) for pair in EXIT_CODES.items() for x in pair])
    return F.when(error.isNull(), 0).otherwise(F.coalesce(F.try_element_at(table, error), F.lit(EXIT_CODES["translation_failed"])))


def first_failures(files: DataFrame, continue_on_error: bool) -> DataFrame:
    """Files with outcome: ok, failed or not_run. A missing model stops a batch, as any error does unless told to go on. files: batch, path, error."""
    stops = (F.col("error") == "model_unavailable") if continue_on_error else F.col("error").isNotNull()
    place = F.struct(F.lower("path").alias("folded"), F.col("path"))
    first = files.where(stops).groupBy("batch").agg(F.min(place).alias("stop"))  # partly done before the shuffle, so a huge batch is no large state
    after = F.coalesce(place > F.col("stop"), F.lit(False))
    return files.join(first, "batch", "left").withColumn("outcome", F.when(after, "not_run").when(F.col("error").isNull(), "ok").otherwise("failed")).drop("stop")


def batch_summary(files: DataFrame, *by: str) -> DataFrame:
    """Totals and status: interrupted, partial, failed or completed. files: outcome (ok, failed, skipped, interrupted)."""
    n = lambda kind: F.count_if(F.col("outcome") == kind)
    sums = files.groupBy(*by).agg(F.count("*").alias("n_files"), n("ok").alias("n_ok"), n("failed").alias("n_failed"), n("skipped").alias("n_skipped"), n("interrupted").alias("n_interrupted"))
    status = F.when(F.col("n_interrupted") > 0, "interrupted").when((F.col("n_failed") > 0) & (F.col("n_ok") > 0), "partial").when(F.col("n_failed") > 0, "failed").otherwise("completed")
    return sums.withColumn("status", status).withColumn("exit_code", F.when(F.col("status") == "interrupted", 130).when(F.col("n_failed") > 0, 10).otherwise(0))


def manual_status(checks: Column) -> Column:
    """fail if one failed, pending if one isn't checked, else pass. checks: map of check to pass, fail, not_checked or not_applicable."""
    values = F.map_values(checks)
    return F.when(F.exists(values, lambda v: v == "fail"), "fail").when(F.exists(values, lambda v: v == "not_checked"), "pending").otherwise("pass")


def validation_summary(results: DataFrame, *by: str) -> DataFrame:
    """results: status (passed, failed, planned), source_changed, manual (pass, fail, pending)."""
    n = lambda c, v: F.count_if(F.col(c) == v)
    return results.groupBy(*by).agg(n("status", "passed").alias("n_passed"), n("status", "failed").alias("n_failed"), n("status", "planned").alias("n_planned"), F.count_if("source_changed").alias("n_integrity"), n("manual", "pass").alias("n_manual_pass"), n("manual", "fail").alias("n_manual_fail"), n("manual", "pending").alias("n_manual_pending"))


def with_reviews(documents: DataFrame, reviews: DataFrame, checks: tuple[str, ...]) -> DataFrame:
    """Documents with their review, or with every check not done. reviews: doc, checks map."""
    default = F.create_map(*[x for c in checks for x in (F.lit(c), F.lit("not_checked"))])
    return documents.join(reviews, "doc", "left").withColumn("checks", F.coalesce("checks", default)).withColumn("manual", manual_status(F.col("checks")))


def defects(results: DataFrame) -> DataFrame:
    """A row per failed stage, changed source or failed manual check. results: doc, stages map, source_changed, checks map."""
    failed = lambda c, label: F.transform(F.map_keys(F.map_filter(c, lambda k, v: v.isin("fail", "failed"))), lambda k: F.concat(F.lit(label), k))
    found = F.concat(failed("stages", "stage:"), F.when(F.col("source_changed"), F.array(F.lit("integrity:source"))).otherwise(F.array().cast("array<string>")), failed("checks", "manual:"))
    return results.select("doc", F.explode(found).alias("defect"))


def diagnostics(units: DataFrame, layout: DataFrame | None = None, compliance: DataFrame | None = None, with_text: bool = False) -> DataFrame:
    """Units with their layout and glossary evidence; texts only if asked for. units: unit_id, status, text, translated."""
    rows = units
    if layout is not None:
        rows = rows.join(layout, "unit_id", "left")
    if compliance is not None:
        rows = rows.join(compliance.groupBy("unit_id").agg(F.count("*").alias("n_terms"), F.count_if(~F.col("compliant")).alias("n_violations")), "unit_id", "left").fillna(0, ["n_terms", "n_violations"])
    return rows if with_text else rows.drop("text", "translated", "normalized")


def invariants(documents: DataFrame) -> DataFrame:
    """Violations of a document's invariants. documents: doc, version, pages array<int>, n_paragraphs, blocks, classified (both array<string>), mapped array<string>, status, n_done, n_total."""
    rising = F.forall(F.sequence(F.lit(1), F.greatest(F.size("pages") - 1, F.lit(1))), lambda i: (F.size("pages") < 2) | (F.get("pages", i - 1) < F.get("pages", i)))
    rules = {
        "pages not strictly increasing": ~rising,
        "paragraphs missing": F.col("version").isin("1.2", "1.3") & (F.col("n_paragraphs") == 0) & (F.size("blocks") > 0),
        "paragraphs not allowed": F.col("version").isin("1.0", "1.1") & (F.col("n_paragraphs") > 0),
        "block not classified once": F.array_sort("classified") != F.array_sort("blocks"),
        "unknown block": F.size(F.array_except("mapped", "blocks")) > 0,
        "completed with units left": (F.col("status") == "completed") & (F.col("n_done") != F.col("n_total")),
    }
    found = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in rules.items()]))
    return documents.select("doc", F.explode(found).alias("violation"))


def lifecycle_violations(runs: DataFrame) -> DataFrame:
    """What can't be so in a run's record. runs: doc, status, n_total, n_completed, n_skipped, started, updated, completed (times)."""
    rules = {
        "more completed than there are": F.col("n_completed") > F.col("n_total"),
        "more skipped than completed": F.col("n_skipped") > F.col("n_completed"),
        "updated before it started": F.col("updated") < F.col("started"),
        "completed with units left": (F.col("status") == "completed") & (F.col("n_completed") != F.col("n_total")),
        "completed without its time": (F.col("status") == "completed") & F.col("completed").isNull(),
        "time of completion too early": (F.col("status") != "completed") & F.col("completed").isNotNull(),
    }
    return runs.select("doc", F.explode(F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in rules.items()]))).alias("violation"))


def version_violations(documents: DataFrame) -> DataFrame:
    """What a document's version does not allow. documents: doc, version, translated and reconstructed (booleans), n_paragraphs, n_expected, n_translated (paragraphs)."""
    v, modern = F.col("version"), F.col("version").isin("1.2", "1.3")
    rules = {
        "unknown version": ~v.isin("1.0", "1.1", "1.2", "1.3"),
        "translation not allowed": v.isin("1.0", "1.2") & F.col("translated"),
        "translation missing": v.isin("1.1", "1.3") & ~F.col("translated"),
        "paragraphs not allowed": v.isin("1.0", "1.1") & (F.col("reconstructed") | (F.col("n_paragraphs") > 0)),
        "reconstruction missing": modern & ~F.col("reconstructed"),
        "number of paragraphs": modern & F.col("reconstructed") & (F.col("n_paragraphs") != F.col("n_expected")),
        "translated paragraphs not allowed": (v == "1.2") & (F.col("n_translated") > 0),
    }
    return documents.select("doc", F.explode(F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in rules.items()]))).alias("violation"))


def document_summary(pages: DataFrame, units: DataFrame, metrics: DataFrame, labelled: DataFrame, layout: DataFrame, timings: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """The counters of a report, a row per document; without texts.

    pages: doc, class, ocr. units: doc, status, n_segments. metrics: doc and the reconstruction counters. labelled: doc, kind, ambiguous. layout: doc,
    font_size, font_first, expanded, overflow. timings: doc, stage, seconds. terms: doc, term, mode, n, n_violations.
    """
    counts = lambda rows, key, name: rows.groupBy("doc", key).agg(F.count("*").alias("n")).groupBy("doc").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(key, "n")))).alias(name))
    sums = pages.groupBy("doc").agg(F.count("*").alias("page_count"), F.count_if("ocr").alias("ocr_pages"))
    s = F.col("status")
    done = units.groupBy("doc").agg(
        F.count("*").alias("blocks_extracted"), F.count_if(s.isin("hit", "miss")).alias("blocks_translated"), F.count_if(s == "skipped").alias("blocks_skipped"), F.count_if(s == "hit").alias("cache_hits"),
        F.count_if(s == "miss").alias("cache_misses"), F.coalesce(F.sum(F.when(s == "miss", F.col("n_segments"))), F.lit(0)).cast("long").alias("translated_segments"),
    )
    repeated = counts(labelled.where("kind <> 'body'"), "kind", "repeated_elements")
    doubtful = labelled.groupBy("doc").agg(F.count_if("ambiguous").alias("ambiguous_repeated_elements"))
    drawn = layout.groupBy("doc").agg(F.count_if(F.col("font_size") < F.col("font_first")).alias("font_reductions"), F.count_if("expanded").alias("expanded_blocks"), F.count_if("overflow").alias("overflow_blocks"))
    took = timings.groupBy("doc").agg(F.sum("seconds").alias("elapsed_seconds"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("stage", "seconds")))).alias("stage_durations"))
    parts = [counts(pages, "class", "pages_by_type"), done, metrics.select("doc", "raw_lines", F.col("n_paragraphs").alias("logical_paragraphs"), F.col("n_ambiguous").alias("ambiguous_decisions"), "cross_page_merges"), repeated, doubtful, drawn, took]
    if terms is not None:
        n = lambda when: F.coalesce(F.sum(F.when(when, F.col("n"))), F.lit(0)).cast("long")
        parts.append(terms.groupBy("doc").agg(
            F.count("*").alias("glossary_total_entries"), F.count_if(F.col("n") > 0).alias("glossary_matched_entries"), F.count_if(F.col("n") == 0).alias("glossary_unmatched_entries"), n(F.lit(True)).alias("glossary_applied_occurrences"),
            n(F.col("mode") == "preserve").alias("glossary_preserved_occurrences"), n(F.col("mode") == "translate").alias("glossary_translation_occurrences"), F.sum("n_violations").cast("long").alias("glossary_violations"),
        ))
    for part in parts:
        sums = sums.join(part, "doc", "left")
    return sums.withColumn("glossary_enabled", F.lit(terms is not None))


def failure_report(runs: DataFrame) -> DataFrame:
    """The form of a report for a run that failed: its stage and error, exit code, and no texts. runs: run, doc, stage, error, message."""
    return runs.where("error IS NOT NULL").select("run", "doc", F.lit("failed").alias("status"), "stage", "error", "message", exit_code(F.col("error")).alias("exit_code"))
