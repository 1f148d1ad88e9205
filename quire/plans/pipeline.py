"""The stages of a document run, over any number of documents at once."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators.glossary import Glossary
from quire.operators.layout import plan_layout
from quire.operators.pages import classify_pages, inspect, ocr_targets
from quire.operators.paragraphs import paragraphs_of
from quire.operators.repeated import classify_repeated
from quire.operators.reports import batch_summary, first_failures
from quire.operators.translate import ModelRuntime, PrefixTranslator, finish_units, new_memory, plan_units, policies, translate_misses
from quire.plans.options import LayoutOptions, PageOptions, ParagraphOptions, RepeatedOptions, TranslationOptions, identity
from quire.plans.scratch import scratch, settle
from quire.sources.files import Memory, Workspace


REVISION = "1"  # of the stages; another one makes other runs


@dataclass
class DocumentRun:
    """Inspect, classify, reconstruct, translate and plan the layout of the blocks of many documents."""

    spark: SparkSession
    pages_options: PageOptions = field(default_factory=PageOptions)
    repeated: RepeatedOptions = field(default_factory=RepeatedOptions)
    paragraphs: ParagraphOptions = field(default_factory=ParagraphOptions)
    translation: TranslationOptions = field(default_factory=TranslationOptions)
    layout: LayoutOptions = field(default_factory=LayoutOptions)
    glossary: Glossary | None = None
    translator: type | ModelRuntime = PrefixTranslator

    def run_id(self, source_hash: str) -> str:
        return identity(source_hash, self.repeated, self.paragraphs, self.translation, self.layout, self.glossary.fingerprint() if self.glossary else None, REVISION)

    def facts(self, source_hash: str) -> dict[str, str]:
        """What a stored run must agree on to be resumed."""
        t = self.translation
        said = {"source": source_hash, "backend": t.backend, "model": t.model, "languages": f"{t.source}-{t.target}", "batch_size": t.batch_size, "token_limit": t.token_limit}
        return {k: str(v) for k, v in said.items()} | {"glossary": self.glossary.fingerprint() if self.glossary else "none", "revision": REVISION}

    def plan(self, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Without any model: page classes rolled up by document, and the pages that need recognition."""
        classified = classify_pages(pages, self.pages_options)
        return inspect(classified, "doc"), ocr_targets(classified)

    def reconstruct(self, blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Translation units (by paragraph) and the decisions that made them."""
        kinds = classify_repeated(blocks, self.repeated)
        fragments = kinds.withColumnRenamed("kind", "repeated").drop("norm", "region", "sequential", "confidence", "ambiguous", "group_id")
        paragraphs, decisions = paragraphs_of(fragments.drop("policy"), self.paragraphs)
        own = policies(paragraphs.select("doc", "para", F.explode("blocks").alias("block_id")), kinds.where("kind <> 'body'"))
        units = paragraphs.join(own, ["doc", "para"], "left").select(F.concat_ws("#", "doc", "para").alias("unit_id"), F.struct("doc", "para").alias("unit_order"), "doc", "page", "id", "kind", "text", F.coalesce("policy", F.lit("translate")).alias("policy"), "x0", "y0", "x1", "y1")
        return units, decisions

    def translate(self, units: DataFrame, memory: Memory | None = None) -> DataFrame:
        """The model sees each distinct text once: what it gave is written, and both the memory and the result read it there."""
        known = memory.read() if memory is not None and memory.exists() else None
        planned = settle(plan_units(units, known, self.translation, self.glossary))
        done = settle(translate_misses(planned.where("status = 'miss'"), self.translation, self.translator, self.glossary))
        if memory is not None:
            memory.put(new_memory(done))
        return finish_units(planned, done)

    def run(self, blocks: DataFrame, root: str, source_hash: str, memory: Memory | None = None) -> dict[str, DataFrame]:
        """All stages, each kept under the run's identity and reused when it is complete."""
        space = Workspace(self.spark, root, self.run_id(source_hash), self.facts(source_hash))
        with scratch(self.spark):  # what a stage writes beside its rows goes when all are there
            units = space.stage("units", lambda: self.reconstruct(blocks)[0])
            finished = space.stage("translated", lambda: self.translate(units, memory))
            fonts = blocks.groupBy("doc", F.col("block_id").alias("id")).agg(F.collect_list("font").alias("sizes"), F.first("page_h").alias("page_h"))
            # documents with a unit that failed aren't drawn
            drawn = finished.join(finished.where("error IS NOT NULL").select("doc").distinct(), "doc", "left_anti")
            drawn = drawn.where(~F.col("policy").isin("preserve", "skip", "remove")).join(fonts, ["doc", "id"]).withColumnRenamed("id", "block_id")
            planned = space.stage("layout", lambda: plan_layout(drawn, self.layout))
        return {"units": units, "translated": finished, "layout": planned}

    def batch(self, extracted: DataFrame, root: str, source_hash: str, continue_on_error: bool = True, memory: Memory | None = None) -> dict[str, DataFrame]:
        """Many files at once: those that couldn't be read or translated, and what a batch doesn't reach after them, are left out and reported. extracted: blocks with path (as doc) and error.

        files: path, error, outcome, and the stage that failed.
        """
        files = extracted.groupBy(F.col("doc").alias("path")).agg(F.max(F.when(F.col("error").isNotNull(), "input_error")).alias("error")).withColumn("batch", F.lit(source_hash))
        files = settle(first_failures(files, continue_on_error))
        good = extracted.join(files.where("outcome = 'ok'").select(F.col("path").alias("doc")), "doc", "left_semi").drop("error")
        made = self.run(good, root, source_hash, memory)
        # a document whose model failed on a text has failed; the others go on
        failed = made["translated"].where("error IS NOT NULL").groupBy(F.col("doc").alias("path")).agg(F.min("error").alias("why"))
        files = files.drop("outcome").join(failed, "path", "left")
        stage = F.when(F.col("error").isNotNull(), "extract").when(F.col("why").isNotNull(), "translated")
        files = files.withColumn("failed_stage", stage).withColumn("error", F.coalesce("error", F.when(F.col("why").isNotNull(), "translation_failed")))
        files = settle(first_failures(files, continue_on_error))
        outcome = F.when(F.col("outcome") == "not_run", "skipped").otherwise(F.col("outcome"))
        return made | {"files": files, "summary": batch_summary(files.withColumn("outcome", outcome), "batch")}
