"""A translation run in batches that are committed one by one, can be interrupted between them, and goes on where it stopped.

The texts that need the model are written once, in order, as files of a bounded number of rows. A stream takes one file for each
trigger; what a batch gave is written under its number, with its measures, before the stream's checkpoint counts it as done. So a
run that is stopped or killed after batch k has the results of k batches, and the next run asks the model only for the rest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from quire.operators.glossary import Glossary
from quire.operators.translate import ModelRuntime, PrefixTranslator, finish_units, plan_units, translate_misses
from quire.plans.options import TranslationOptions
from quire.plans.scratch import remove
from quire.sources.files import Memory, Workspace

DONE = "cache_key string, translated string, n_segments int, forced boolean, error string, created_at timestamp"
LOG = "batch long, texts long, failed long, segments long, calls long, seconds double, peak_mb double"


class Interrupted(Exception):
    """Asked for between two batches."""


class BatchRun:
    """folder: planned (units), queue (texts by batch), done (results by batch), measures (by batch), checkpoint, and stop, a mark that asks for the end."""

    def __init__(self, spark: SparkSession, folder: str, options: TranslationOptions = TranslationOptions(), translator: type | ModelRuntime = PrefixTranslator, glossary: Glossary | None = None, per_batch: int = 1000, memory: Memory | None = None):
        if per_batch < 1:
            raise ValueError("a batch has one text or more")
        self.spark, self.folder, self.options, self.glossary, self.per_batch, self.memory = spark, folder, options, glossary, per_batch, memory
        self.runtime = translator if isinstance(translator, ModelRuntime) else ModelRuntime(translator, options)
        self.runtime.check(options)
        self.space = Workspace(spark, folder, "run")

    def _path(self, name: str) -> str:
        return f"{self.folder}/run/{name}"

    def _exists(self, name: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self._path(name))
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def plan(self, units: DataFrame) -> DataFrame:
        """The units with their status, and the queue; both are made once. units: unit_id, unit_order, text, policy."""
        known = self.memory.read() if self.memory is not None and self.memory.exists() else None
        planned = self.space.stage("planned", lambda: plan_units(units, known, self.options, self.glossary))
        if not self.space.complete("queue"):
            misses = planned.where("status = 'miss'").select("cache_key", "text", "unit_order")
            ordered = misses.repartitionByRange("unit_order").sortWithinPartitions("unit_order").drop("unit_order")
            ordered.write.mode("overwrite").option("maxRecordsPerFile", self.per_batch).parquet(self._path("queue"))
        return planned

    def request_stop(self) -> None:
        """Ends a run, here or in another process, after the batch that it is at."""
        self.spark.range(1).coalesce(1).write.mode("overwrite").parquet(self._path("stop"))

    def run(self, units: DataFrame, most: int | None = None) -> str:
        """Status: completed; interrupted, by a request or after ``most`` batches; or failed, with the error in ``error``. Goes on with what an earlier run left."""
        self.plan(units)
        remove(self.spark, self._path("stop"))
        self.error: str | None = None
        made = 0

        def commit(batch: DataFrame, number: int) -> None:
            nonlocal made
            if self._exists("stop") or (most is not None and made >= most):
                raise Interrupted
            seen = Observation()
            rows = translate_misses(batch, self.options, self.runtime, self.glossary, measures=True).withColumn("created_at", F.current_timestamp())
            whole = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
            rows = rows.observe(seen, F.count("*").alias("texts"), F.count("error").alias("failed"), whole("n_segments").alias("segments"), whole("calls").alias("calls"), F.coalesce(F.sum("seconds"), F.lit(0.0)).alias("seconds"), F.coalesce(F.max("peak_mb"), F.lit(0.0)).alias("peak_mb"))
            rows.drop("calls", "seconds", "peak_mb").write.mode("overwrite").parquet(self._path(f"done/batch={number}"))
            m = seen.get
            row = [(number, *(m[c.split(" ")[0]] for c in LOG.split(", ")[1:]))]
            self.spark.createDataFrame(row, LOG).coalesce(1).write.mode("overwrite").json(self._path(f"measures/at={number}"))
            if self.memory is not None:
                done = self.spark.read.schema(DONE).parquet(self._path(f"done/batch={number}"))
                self.memory.put(done.where("translated IS NOT NULL").select("cache_key", F.col("translated").alias("translated_text"), "created_at"), f"{self.runtime.options.model}-{number}")
            made += 1

        stream = self.spark.readStream.schema("cache_key string, text string").option("maxFilesPerTrigger", 1).parquet(self._path("queue"))
        query = stream.writeStream.foreachBatch(commit).option("checkpointLocation", self._path("checkpoint")).trigger(availableNow=True).start()
        try:
            query.awaitTermination()
            return self._note("completed")
        except Exception as e:
            if Interrupted.__name__ in str(e):
                return self._note("interrupted")
            self.error = f"{type(e).__name__}: {e}"[:2000]
            return self._note("failed")

    def _note(self, status: str) -> str:
        self.spark.createDataFrame([(status, self.error)], "status string, error string").coalesce(1).write.mode("overwrite").json(self._path("status"))
        return status

    def log(self) -> DataFrame:
        """The measures of each batch that is done."""
        if not self._exists("measures"):
            return self.spark.createDataFrame([], LOG)
        return self.spark.read.schema(LOG).option("recursiveFileLookup", "true").json(self._path("measures"))

    def progress(self) -> dict:
        """Texts and batches that are done, of how many, the status of the last run, the model's seconds and a worker's peak memory: from counts and small files, also while a run goes on elsewhere."""
        queue = self.spark.read.schema("cache_key string, text string").parquet(self._path("queue"))
        total = queue.select(F.count("*").alias("texts")).first()["texts"]
        m = self.log().agg(F.count("*").alias("batches"), F.sum("texts").alias("texts"), F.sum("failed").alias("failed"), F.sum("seconds").alias("seconds"), F.max("peak_mb").alias("peak_mb")).first()
        last = self.spark.read.schema("status string, error string").json(self._path("status")).first() if self._exists("status") else None
        return {"status": last["status"] if last else "not_run", "texts": m["texts"] or 0, "of": total, "batches": m["batches"], "failed": m["failed"] or 0, "seconds": m["seconds"] or 0.0, "peak_mb": m["peak_mb"] or 0.0}

    def result(self) -> DataFrame:
        """Every unit: with its translation, its error, or neither if its batch is still to come (status pending)."""
        planned = self.spark.read.parquet(self._path("planned"))
        if self._exists("done"):
            done = self.spark.read.schema(DONE).option("recursiveFileLookup", "true").parquet(self._path("done")).drop("created_at")
        else:
            done = self.spark.createDataFrame([], DONE).drop("created_at")
        rows = finish_units(planned, done)
        waits = F.col("translated").isNull() & F.col("error").isNull() & (F.col("status") != "skipped")
        return rows.withColumn("status", F.when(waits, "pending").when(F.col("error").isNotNull(), "failed").otherwise(F.col("status")))
