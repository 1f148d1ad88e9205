"""A corpus through five stages: quality, near-duplicates, benchmark leaks, mixing, shards.

Each stage takes the whole output of the one before. The first three only drop rows. The order of training, which the mixing stage
gives, is the order of the rows in the files that it is written to (file number, then row); the sharding stage reads it from
there, so that shards are successive parts of the training and slots follow it.

Nulls: a null text counts as an empty one in every stage; a null doc_id, source or n_chars is a value like others. Very long
texts are read whole. Of equal rows, and of near-duplicates with one doc_id, one stays; ties go to the smaller doc_id. An empty table gives empty tables.
Columns that the table has beside those of documents pass through, unless the last stage adds one of their name (size, shard,
slot); the stages hide names that their operators use.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import ensure_checkpoints, remove, scratch, table
from quire.llm.near_duplicates import drop_near_duplicates
from quire.llm.op1_sharding import histogram_shards
from quire.llm.op4_mixing import curriculum_plan, training_sequence
from quire.llm.op9_decontaminate import find_leaks
from quire.llm.op10_quality import fit_quality, score_quality

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for good ones (score of at least 0.5). Null and empty texts are scored like others."""
    model = fit_quality(docs, table(spark, sf_dir, "labels"))
    return score_quality(docs, model, name="__score").where("__score >= 0.5").drop("__score")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity 0.8) the document with the smallest doc_id; of repeated rows one."""
    return drop_near_duplicates(docs).select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Null and empty texts hold none."""
    return find_leaks(docs, table(spark, sf_dir, "benchmark"), name="__leaks").where(F.size("__leaks") == 0).drop("__leaks")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The copies that the mix takes, in the order of training. A null or empty text stands once."""
    return training_sequence(docs, curriculum_plan(docs)).select(*docs.columns)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with size, shard and slot; shards hold nearly equal bytes. In the order of the files, if docs are read from files, else by text."""
    part = F.coalesce(F.regexp_extract("_metadata.file_name", r"(\d+)", 1).try_cast("long"), F.xxhash64("_metadata.file_path"))
    try:
        placed = docs.select("*", part.alias("__part"), F.col("_metadata.row_index").alias("__at"))
    except AnalysisException:
        return histogram_shards(docs)
    return histogram_shards(placed, order=(F.col("__part"), F.col("__at"))).drop("__part", "__at")


STAGES: list[tuple[str, Stage]] = [("quality", quality), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("mix", mix), ("shard", shard)]

#: A trained classifier, a singular value decomposition and rounds of splitters have no SQL; tests compare with plain code.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written to the shared folder and read again by the next. What a stage wrote beside goes with it, and its rows when the next has ended."""
    ensure_checkpoints(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
        if k:
            remove(spark, f"{folder}/{k - 1}-{STAGES[k - 1][0]}")
    return docs
