"""Files in and out: discovery, page ranges, document JSON, translation memory, run workspaces, reports."""

from __future__ import annotations

import fnmatch
import re
import time
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.text import fold_case

DOCUMENT = "schema_version string, doc string, sha256 string, file_size long, pages array<struct<page:int,width:double,height:double,class:string,blocks:array<struct<id:string,text:string,x0:double,y0:double,x1:double,y1:double,translated:string>>>>, paragraphs array<struct<id:string,page:int,kind:string,text:string,translated:string>>"
LOG = "stage string, status string, began double, seconds double, error string"
TRANSLATED = re.compile(r"\.ru\.pdf$", re.IGNORECASE)


def parse_pages(text: str | None, n_pages: int) -> list[int]:
    """"1,3-5" as pages; all without a text. Pages must rise, from 1 to the document's last."""
    if text is None:
        return list(range(1, n_pages + 1))
    out: list[int] = []
    for part in text.split(","):
        if not (m := re.fullmatch(r"\s*(\d+)(?:\s*-\s*(\d+))?\s*", part)):
            raise ValueError(f"page range {part!r} isn't valid")
        low, high = int(m[1]), int(m[2] or m[1])
        if not 1 <= low <= high <= n_pages or out and low <= out[-1]:
            raise ValueError(f"page range {part!r} is out of order or out of the document")
        out += range(low, high + 1)
    return out


def glob_matches(path: Column, pattern: str) -> Column:
    """Against the whole relative path, its last part or, for a pattern that begins with **/, the path without folders."""
    shapes = {pattern, pattern.removeprefix("**/")}
    regex = "|".join(fnmatch.translate(p.lower()).replace("(?s:", "(?:").replace(r"\z", "$").replace(r"\Z", "$") for p in sorted(shapes))
    return F.lower(path).rlike(f"(?s)^(?:{regex})") | F.lower(F.element_at(F.split(path, "/"), -1)).rlike(f"(?s)^(?:{regex})")


def skip_reasons(paths: DataFrame, include: tuple[str, ...] = (), exclude: tuple[str, ...] = (), output: str | None = None) -> DataFrame:
    """Relative paths in order with skip: why a file isn't taken, by the first reason that holds."""
    path = F.col("path")
    any_of = lambda patterns: F.array_contains(F.array(*[glob_matches(path, p) for p in patterns]), True)
    reason = F.when(path.startswith(f"{output.rstrip('/')}/"), "inside_output") if output else F.when(F.lit(False), "")
    reason = reason.when(path.rlike(r"(?i)\.ru\.pdf$"), "already_translated").when(~path.rlike(r"(?i)\.pdf$"), "not_a_pdf")
    if include:
        reason = reason.when(~any_of(include), "not_included")
    if exclude:
        reason = reason.when(any_of(exclude), "excluded")
    return paths.withColumn("skip", reason).orderBy(F.lower("path"), "path")


def output_name(path: Column) -> Column:
    return F.regexp_replace(path, r"(?i)\.pdf$", ".ru.pdf")


def named_output(path: Column, kind: str) -> Column:
    """Names beside a source or an output: translated, debug, failed, or (of a folder) batch."""
    stem = F.regexp_replace(path, r"\.[^./]*$", "")
    return {"translated": F.concat(stem, F.lit(".ru.pdf")), "debug": F.concat(stem, F.lit(".debug.pdf")), "failed": F.concat(stem, F.lit(".failed-render.pdf")), "batch": F.concat(F.rtrim(path, F.lit("/")), F.lit("_ru"))}[kind]


def generated_id(path: Column) -> Column:
    """The id of a document that a manifest doesn't name."""
    return F.concat(F.lit("document-"), F.left(F.sha2(fold_case(path), 256), F.lit(12)))


def folder_size(files: DataFrame) -> DataFrame:
    return files.agg(F.coalesce(F.sum("file_size"), F.lit(0)).cast("long").alias("bytes"), F.count("*").alias("n_files"))


def scan_files(spark: SparkSession, folder: str, glob: str = "*.pdf") -> DataFrame:
    """path, file_size, sha256 and content of a folder's files, at any depth."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(folder)
    return files.select("path", F.col("length").alias("file_size"), F.sha2("content", 256).alias("sha256"), "content")


def extract(files: DataFrame, extractor: Callable[[str, bytes], Iterator[dict]], schema: str) -> DataFrame:
    """The rows that a document reader makes of each file; a reader that fails gives a row with its error, and no other file suffers."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows: list[dict] = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    rows += [{"path": path, "error": None} | r for r in extractor(path, content)]
                except Exception as e:  # the reader's own errors are data here
                    rows.append({"path": path, "error": f"{type(e).__name__}: {e}"})
            yield pd.DataFrame(rows, columns=names, dtype=object)

    full = f"path string, error string, {schema}"
    names = [f.strip().split(" ")[0] for f in re.sub(r"<[^<>]*(?:<[^<>]*>)?[^<>]*>", "", full).split(",")]
    return files.select("path", "content").mapInPandas(run, full)


def blank_to_null(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.withColumns({c: F.nullif(F.trim(c), F.lit("")) for c in columns})


def typed_blocks(raw: DataFrame) -> DataFrame:
    """Blocks of raw lines (doc, page, block, line, text, box): blank lines and blocks go, the rest are numbered densely, a block's box is its lines'."""
    from pyspark.sql.window import Window

    lines = raw.withColumn("text", F.trim("text")).where("text <> ''")
    items = F.sort_array(F.collect_list(F.struct("line", "text")))
    blocks = lines.groupBy("doc", "page", "block").agg(F.array_join(F.transform(items, lambda x: x["text"]), "\n").alias("text"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.count("*").alias("n_lines"))
    ord_ = F.row_number().over(Window.partitionBy("doc", "page").orderBy("block"))
    return blocks.withColumn("ord", (ord_ - 1).cast("int")).withColumn("block_id", F.format_string("p%04d-b%04d", "page", F.col("ord") + 1)).drop("block")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(DOCUMENT).option("mode", "FAILFAST").json(path)


def write_documents(docs: DataFrame, path: str) -> None:
    """Never over what is there."""
    docs.write.mode("errorifexists").json(path)


class Memory:
    """A translation memory as Parquet folders, one per update; reads see the latest row of each key."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def read(self) -> DataFrame:
        from quire.operators.translate import MEMORY, merge_memory

        rows = self.spark.read.schema(MEMORY).option("recursiveFileLookup", "true").parquet(self.path)
        return merge_memory(rows, rows.limit(0))

    def put(self, fresh: DataFrame, update: str | None = None) -> None:
        """Adds rows; under a name of its own an update can be repeated."""
        if update is None:
            fresh.write.mode("append").parquet(self.path)
        else:
            fresh.write.mode("overwrite").parquet(f"{self.path}/{update}")

    def updates(self) -> list[str]:
        """The folders and files of the memory's updates."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        system = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        found = [f.getPath() for f in system.listStatus(path)] if system.exists(path) else []
        return [p.toString() for p in found if not p.getName().startswith(("_", "."))]

    def compact(self) -> int:
        """Brings all updates together as one, and says how many there were. Readers see the latest row of each key before, meanwhile and after, as the new update holds the same rows; only then the old ones go."""
        old = self.updates()
        if len(old) > 1:
            self.read().write.parquet(f"{self.path}/compact-{uuid.uuid4().hex}")
            for path in old:
                p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
        return len(old)

    def exists(self) -> bool:
        fs = self.spark._jvm.org.apache.hadoop.fs
        p = fs.Path(self.path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)


class Workspace:
    """Stage results of a run under its identity; a stage that is complete is read, not made again. Keeps what the run is, and a log of its stages."""

    def __init__(self, spark: SparkSession, root: str, run_id: str, facts: dict[str, str] | None = None):
        """facts: what the run is made of. A stored run of other facts is an error that names them."""
        self.spark, self.folder = spark, f"{root}/{run_id}"
        if facts is None:
            return
        if self.complete("manifest"):
            stored = {r["fact"]: r["value"] for r in spark.read.schema("fact string, value string").json(f"{self.folder}/manifest").collect()}
            if differ := sorted(k for k in stored.keys() | facts.keys() if stored.get(k) != facts.get(k)):
                raise ValueError(f"the stored run differs in {', '.join(differ)}")
        else:
            spark.createDataFrame(sorted(facts.items()), "fact string, value string").coalesce(1).write.mode("overwrite").json(f"{self.folder}/manifest")

    def complete(self, stage: str) -> bool:
        fs = self.spark._jvm.org.apache.hadoop.fs
        p = fs.Path(f"{self.folder}/{stage}/_SUCCESS")
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def _note(self, stage: str, status: str, began: float, error: str | None = None) -> None:
        row = [(stage, status, began, time.time() - began, error)]
        self.spark.createDataFrame(row, LOG).coalesce(1).write.mode("append").json(f"{self.folder}/log")

    def log(self) -> DataFrame:
        """stage, status (passed, reused or failed), began, seconds and error of each attempt."""
        return self.spark.read.schema(LOG).json(f"{self.folder}/log")

    def stage(self, stage: str, make: Callable[[], DataFrame]) -> DataFrame:
        began, reused = time.time(), self.complete(stage)
        if not reused:
            try:
                make().write.mode("overwrite").parquet(f"{self.folder}/{stage}")
            except Exception as e:
                self._note(stage, "failed", began, f"{type(e).__name__}: {e}"[:2000])
                raise
        self._note(stage, "reused" if reused else "passed", began)
        return self.spark.read.parquet(f"{self.folder}/{stage}")
