"""Scratch tables in the shared checkpoint folder: written once, read by later steps, also after executors are lost."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress
from contextvars import ContextVar

from py4j.java_gateway import JavaObject
from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoints(spark: SparkSession) -> None:
    """Uses the folder that the cluster names; only a session without one on a single machine, as in tests, gets its own."""
    if spark.conf.get("spark.checkpoint.dir", None) is None and spark.sparkContext.getCheckpointDir() is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="quire-checkpoints-"))


#: The folder of the scratch tables that are being written, of each thread.
_FOLDER: ContextVar[str | None] = ContextVar("quire_scratch", default=None)


#: Folders of applications whose tables go when the driver ends.
_LEFT: set[str] = set()


def _root(spark: SparkSession) -> str:
    """The application's own folder. Tables that no ``scratch`` block removes stay there, since results that are read later may need them, and go with the driver."""
    ensure_checkpoints(spark)
    folder = f"{spark.sparkContext.getCheckpointDir() or spark.conf.get('spark.checkpoint.dir')}/quire-{spark.sparkContext.applicationId}"
    if folder not in _LEFT:
        _LEFT.add(folder)
        atexit.register(_clear, spark._jvm.org.apache.hadoop.fs.Path(folder), spark._jsc.hadoopConfiguration())
    return folder


def _clear(path: JavaObject, conf: JavaObject) -> None:
    with suppress(Exception):  # the virtual machine may be gone already
        path.getFileSystem(conf).delete(path, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """Tables settled inside go when it ends. Gives the folder around it, for those that stay."""
    outer = _FOLDER.get() or _root(spark)
    folder = f"{outer}/scratch-{uuid.uuid4().hex}"
    before = _FOLDER.set(folder)
    try:
        yield outer
    finally:
        _FOLDER.reset(before)
        remove(spark, folder)


def remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Shuffle files go when the execution that wrote them ends; else they stay until the driver's virtual machine happens to collect its plans.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def settle(df: DataFrame, folder: str | None = None) -> DataFrame:
    """The rows, written once to the shared checkpoint folder and read from there. What was shuffled for them goes at once."""
    spark = df.sparkSession
    path = f"{folder or _FOLDER.get() or _root(spark)}/table-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)
