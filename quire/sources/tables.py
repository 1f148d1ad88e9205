"""Parquet tables by folder and name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SMALL_BYTES = 256 << 20


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table; if it is small and in fewer files than there are cores, its rows are dealt to all cores, since a file of one row group is one task."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < SMALL_BYTES and len(df.inputFiles()) < cores else df
