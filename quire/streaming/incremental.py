"""Translation as a stream of units: each micro-batch is deduplicated, looked up in the memory and committed once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quire.operators.translate import PrefixTranslator, finish_units, plan_units, translate_misses
from quire.plans.options import TranslationOptions
from quire.sources.files import Memory, Workspace


def translate_stream(spark: SparkSession, units: DataFrame, folder: str, options: TranslationOptions = TranslationOptions(), translator: type = PrefixTranslator) -> StreamingQuery:
    """units: a stream of unit_id, unit_order, text, policy. Results go to folder/translated, the memory to folder/memory, one sub-folder per micro-batch.

    What a batch plans and what the model gives for it are written first (folder/work) and only read from there: a batch that is
    repeated writes the same rows over the same sub-folders and asks no model again.
    """
    memory = Memory(spark, f"{folder}/memory")

    def commit(batch: DataFrame, number: int) -> None:
        work = Workspace(spark, f"{folder}/work", f"batch-{number}")
        known = memory.read() if memory.exists() else None
        planned = work.stage("planned", lambda: plan_units(batch, known, options))
        done = work.stage("done", lambda: translate_misses(planned.where("status = 'miss'"), options, translator).withColumn("created_at", F.current_timestamp()))
        finish_units(planned, done.drop("created_at")).drop("unit_order").write.mode("overwrite").parquet(f"{folder}/translated/batch={number}")
        memory.put(done.where("translated IS NOT NULL").select("cache_key", F.col("translated").alias("translated_text"), "created_at"), f"batch-{number}")

    return units.writeStream.foreachBatch(commit).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()


def progress(spark: SparkSession, folder: str) -> DataFrame:
    """Units by micro-batch and status."""
    return spark.read.parquet(f"{folder}/translated").groupBy("batch", "status").agg(F.count("*").alias("n"))


def stage_windows(events: DataFrame, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Counts of a stream of stage events by window, late events up to a bound."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
