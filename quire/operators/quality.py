"""Quality findings on translations, human review, comparison with a baseline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import ANY_MARK, DRIVE_PATH, NUMBER_VALUE, OPTION_VALUE, UNIT_VALUE, URL, missing_values, suspicious

# The codes, stages and names of scores that a result must agree on.
VALUES = (("number-damaged", NUMBER_VALUE), ("unit-damaged", UNIT_VALUE), ("url-damaged", URL), ("path-damaged", DRIVE_PATH), ("option-damaged", OPTION_VALUE))
REVIEW = (("adequacy", "model"), ("fluency", "model"), ("terminology", "terminology"), ("token_preservation", "protected_token"), ("segmentation", "segmentation"), ("overall_acceptability", "model"))
FINDING = "struct<code:string,stage:string,severity:string,evidence:array<string>>"


def _finding(when: Column, code: str, stage: Column | str, severity: str, evidence: Column) -> Column:
    stage = F.lit(stage) if isinstance(stage, str) else stage
    return F.when(F.coalesce(when, F.lit(False)), F.struct(F.lit(code).alias("code"), stage.alias("stage"), F.lit(severity).alias("severity"), evidence.cast("array<string>").alias("evidence")))


def integrity(source: Column, output: Column, protected: Column, stage: str) -> list[Column]:
    """Findings (null where there is none) on one text and what became of it."""
    none = F.array().cast("array<string>")
    lost = F.filter(protected, lambda t: ~F.contains(output, t))
    odd = F.transform(suspicious(output), lambda x: F.concat(F.lit("U+"), F.lpad(F.hex(F.ascii(x)), 4, "0")))
    a, b = F.lower(F.trim(F.regexp_replace(source, r"\s+", " "))), F.lower(F.trim(F.regexp_replace(output, r"\s+", " ")))
    ratio = F.length(b) / F.length(a)
    checks = [_finding(F.size(lost) > 0, "protected-token-damaged", "protected_token", "error", lost), _finding(output.rlike(ANY_MARK), "protected-placeholder-leaked", "protected_token", "error", none)]
    lost_values = missing_values(source, output, tuple(p for _, p in VALUES))
    for k, (code, _) in enumerate(VALUES):
        missing = F.get(lost_values, F.lit(k))
        checks.append(_finding(F.size(missing) > 0, code, stage, "error", missing))
    checks += [
        _finding(F.size(odd) > 0, "suspicious-character", stage, "error", odd),
        _finding((a != "") & (a == b), "untranslated-output", stage, "error", none),
        _finding((a != "") & (b != "") & ((ratio < 0.25) | (ratio > 4.0)), "suspicious-length-ratio", stage, "warning", F.array(F.format_string("ratio=%.3f", ratio))),
    ]
    return checks


def analyse(samples: DataFrame) -> DataFrame:
    """A row per finding. samples: sample_id, source, output, protected, n_segments, n_outputs, forced and, where restoring may fail, protection_error."""
    counts = F.array(F.concat(F.lit("source="), F.col("n_segments")), F.concat(F.lit("output="), F.col("n_outputs")))
    none = F.array().cast("array<string>")
    failed = F.col("protection_error").isNotNull() if "protection_error" in samples.columns else F.lit(False)
    checks = [
        _finding(F.col("n_segments") != F.col("n_outputs"), "segment-count-mismatch", "segmentation", "error", counts),
        _finding(F.col("forced"), "forced-segmentation", "segmentation", "warning", none),
        _finding(failed, "protected-token-restore-failed", "protected_token", "error", none),
        *integrity(F.col("source"), F.col("output"), F.col("protected"), "model"),
    ]
    return explode_findings(samples, "sample_id", checks, "current_run")


def analyse_trace(samples: DataFrame) -> DataFrame:
    """Findings on earlier snapshots, by the stage whose step changed the text; they never change a status. samples: sample_id, source, extracted, observed, rendered, protected and, if kept, source_segments and translated_segments."""
    none, extracted = F.array().cast("array<string>"), F.coalesce("extracted", "source")
    changed = extracted != F.col("source")
    checks = [_finding(changed, "extracted-text-changed", "extraction", "error", none)]
    checks += [F.when(changed, c) for c in integrity(F.col("source"), extracted, F.col("protected"), "extraction")]
    if {"source_segments", "translated_segments"} <= set(samples.columns):
        n, m = (F.size(F.coalesce(F.col(c), none)) for c in ("source_segments", "translated_segments"))
        checks.append(_finding(n != m, "observed-segment-count-mismatch", "segmentation", "error", F.array(F.concat(F.lit("source="), n), F.concat(F.lit("translated="), m))))
    checks += [F.when(F.col("observed").isNotNull(), c) for c in integrity(extracted, F.col("observed"), F.col("protected"), "model")]
    redrawn = F.col("rendered").isNotNull() & ~F.col("rendered").eqNullSafe(F.col("observed"))
    checks += [_finding(redrawn, "rendered-text-changed", "rendering", "error", none)]
    checks += [F.when(redrawn, c) for c in integrity(F.col("observed"), F.col("rendered"), F.col("protected"), "rendering")]
    return explode_findings(samples, "sample_id", checks, "historical_trace")


def explode_findings(rows: DataFrame, key: str, checks: list[Column], origin: str) -> DataFrame:
    """Of equal stage, code and evidence one stays: a code has one severity, so the last is as the first."""
    found = F.array_distinct(F.array_compact(F.array(*[c.cast(FINDING) for c in checks])))
    return rows.select(key, F.explode(found).alias("f")).select(key, "f.*", F.lit(origin).alias("origin"))


def last_of_each(findings: Column) -> Column:
    """Findings by the place where their stage, code and evidence first occur, with the severity that they last have."""
    key = lambda f: F.struct(f["stage"], f["code"], f["evidence"])
    places = F.transform(findings, lambda f, i: F.struct(key(f).alias("key"), i.alias("i")))
    first = F.filter(F.transform(findings, lambda f, i: F.when(F.array_position(F.transform(findings, key), key(f)) == i + 1, f)), lambda f: f.isNotNull())
    last = lambda f: F.element_at(F.filter(places, lambda p: p["key"] == key(f)), -1)["i"]
    return F.transform(first, lambda f: F.get(findings, last(f)))


def review_findings(reviews: DataFrame, key: str) -> DataFrame:
    """An error for each score of at most 2. reviews: the key and the scores it has, of the six."""
    scores = [c for c, _ in REVIEW if c in reviews.columns]
    stage = F.create_map(*[F.lit(x) for c in REVIEW for x in c])
    low = reviews.unpivot([key], scores, "name", "score").where(F.col("score") <= 2)
    return low.select(key, F.concat(F.lit("human-"), F.replace("name", F.lit("_"), F.lit("-"))).alias("code"), F.element_at(stage, F.col("name")).alias("stage"), F.lit("error").alias("severity"), F.col("score"))


def statuses(samples: DataFrame, findings: DataFrame, key: str = "sample_id") -> DataFrame:
    """failed with a current error, else passed; error where there is no output."""
    errors = findings.where("origin = 'current_run' AND severity = 'error'").groupBy(key).agg(F.count("*").alias("n_errors"))
    return samples.join(errors, key, "left").select(key, F.coalesce("n_errors", F.lit(0)).cast("long").alias("n_errors"), F.when(F.col("output").isNull(), "error").when(F.col("n_errors") > 0, "failed").otherwise("passed").alias("status"))


def stage_summary(findings: DataFrame) -> DataFrame:
    return findings.groupBy("stage").agg(F.count_if(F.col("origin") == "current_run").alias("n_current"), F.count_if(F.col("origin") == "historical_trace").alias("n_historical"), F.count_if((F.col("origin") == "current_run") & (F.col("severity") == "error")).alias("n_errors"))


def compare_with_baseline(before: DataFrame, after: DataFrame, key: str = "sample_id") -> DataFrame:
    """Samples in both runs whose status changed: regressed or improved. before, after: key, status."""
    both = before.select(key, F.col("status").alias("was")).join(after.select(key, F.col("status").alias("is")), key)
    return both.where("was <> is").withColumn("change", F.when(F.col("was") == "passed", "regressed").when(F.col("is") == "passed", "improved").otherwise("changed"))


def finding_changes(before: DataFrame, after: DataFrame, key: str = "sample_id") -> DataFrame:
    """New and resolved findings: the differences of the two sets, both ways."""
    ids = [key, "stage", "code"]
    new = after.select(*ids).subtract(before.select(*ids)).withColumn("change", F.lit("new"))
    return new.unionByName(before.select(*ids).subtract(after.select(*ids)).withColumn("change", F.lit("resolved")))
