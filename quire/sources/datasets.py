"""Benchmark datasets, review manifests, generated paragraph sets and report sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SAMPLES = "dataset_version string, samples array<struct<id:string,category:string,source:string,reference:string,context:string,protected_tokens:array<string>,notes:string,stage_trace:struct<extracted_text:string,source_segments:array<string>,translated_segments:array<string>,observed_translation:string,rendered_text:string>,human_review:struct<adequacy:int,fluency:int,terminology:int,token_preservation:int,segmentation:int,overall_acceptability:int>>>"
REVIEWS = "reviews array<struct<document_id:string,checks:map<string,string>>>"
MANIFEST = "documents array<struct<document_id:string,path:string,categories:array<string>,notes:string>>"

PAGES, PER_PAGE, VARIANTS = 10, 12, 5
#: Words, about, of the variants' sentences; how many a text of each has.
LENGTHS = (8, 20, 45, 90, 12)


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema(SAMPLES).option("multiLine", "true").option("mode", "FAILFAST").json(path)
    return rows.select("dataset_version", F.explode("samples").alias("s")).select("dataset_version", "s.*").withColumnRenamed("id", "sample_id")


def read_reviews(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(REVIEWS).option("multiLine", "true").json(path).select(F.explode("reviews").alias("r")).select(F.col("r.document_id").alias("doc"), "r.checks")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Documents of a corpus; a path outside its folder is an error."""
    rows = spark.read.schema(MANIFEST).option("multiLine", "true").json(path).select(F.explode("documents").alias("d")).select("d.*")
    return rows.withColumn("path", F.when(escapes(F.col("path")), F.raise_error(F.concat(F.lit("not a path inside the corpus: "), "path"))).otherwise(F.col("path")))


def escapes(path: Column) -> Column:
    """Whether a path is not one below the folder that it is relative to."""
    return F.coalesce((path == "") | path.startswith("/") | path.rlike(r"^[A-Za-z]:") | path.rlike(r"(^|[/\\\\])\.\.([/\\\\]|$)"), F.lit(True))


def manifest_problems(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """A row for each problem of a manifest: a path outside the corpus, an id or a path again (in any case of letters), a file that isn't there."""
    again = lambda c: F.count("*").over(Window.partitionBy(F.lower(c))) > 1
    there = files.select(F.col("path").alias("there")).distinct()
    rows = manifest.withColumns({"id_again": again("document_id"), "path_again": again("path")}).join(there, F.col("path") == F.col("there"), "left")
    found = F.array_compact(F.array(F.when(escapes(F.col("path")), "outside"), F.when(F.col("id_again"), "id repeated"), F.when(F.col("path_again"), "path repeated"), F.when(F.col("there").isNull(), "missing")))
    return rows.select("document_id", F.explode(found).alias("problem"))


def missing_documents(manifest: DataFrame, files: DataFrame) -> DataFrame:
    return manifest.join(files.select("path"), "path", "left_anti")


def paragraph_set(spark: SparkSession, documents: int = 1, distinct: int = 42) -> DataFrame:
    """Units of made-up documents: on each of 10 pages 10 to translate, with so many distinct texts in all, one to preserve and one to skip."""
    n = spark.range(documents * PAGES * PER_PAGE).withColumnRenamed("id", "n")
    place, page = F.col("n") % PER_PAGE, F.floor(F.col("n") / PER_PAGE) % PAGES
    number = page * (PER_PAGE - 2) + place
    words = F.element_at(F.array(*[F.lit(k) for k in LENGTHS]), (number % distinct % VARIANTS + 1).cast("int"))
    text = F.concat(F.lit("Paragraph "), (number % distinct).cast("string"), F.lit(" "), F.repeat(F.lit("of plain words "), (words / 3).cast("int")), F.lit("ends."))
    policy = F.when(place == PER_PAGE - 2, "preserve").when(place == PER_PAGE - 1, "skip").otherwise("translate")
    return n.select(F.concat(F.lit("u"), "n").alias("unit_id"), F.col("n").alias("unit_order"), F.concat(F.lit("document-"), F.floor(F.col("n") / (PAGES * PER_PAGE)).cast("string")).alias("doc"), (page + 1).cast("int").alias("page"), F.when(policy == "translate", text).otherwise(F.concat(F.lit("Kept "), "n")).alias("text"), policy.alias("policy"))


def length_class(units: DataFrame, kind: str) -> DataFrame:
    """Units of up to 15 words (short), 60 (medium) or more (long); an empty class is an error."""
    n = F.size(F.split("text", r"\s+"))
    rows = units.where({"short": n <= 15, "medium": (n > 15) & (n <= 60), "long": n > 60}[kind])
    if rows.isEmpty():
        raise ValueError(f"no unit is {kind}")
    return rows


def write_report(rows: DataFrame, path: str) -> None:
    """A small report as one JSON file; never over another."""
    rows.coalesce(1).write.mode("errorifexists").json(path)


def write_text(lines: DataFrame, path: str) -> None:
    """Lines (place, value) in order as one text file; never over another."""
    lines.repartitionByRange(1, "place").sortWithinPartitions("place").select("value").write.mode("errorifexists").text(path)


def _cell(c: str) -> Column:
    return F.coalesce(F.replace(F.col(c).cast("string"), F.lit("|"), F.lit("\\|")), F.lit(""))


def markdown(rows: DataFrame, title: str, order: tuple[str, ...] = ()) -> DataFrame:
    """The lines (place, value) of a report table with all rows, in the given order or else that of all columns."""
    sql = rows.sparkSession
    head = [f"# {title}", "", "| " + " | ".join(rows.columns) + " |", "|" + " --- |" * len(rows.columns)]
    lines = sql.createDataFrame([(i - len(head), line) for i, line in enumerate(head)], "place long, value string")
    number = F.row_number().over(Window.orderBy(*(order or rows.columns))).cast("long")  # reports are small: rows that a reader reads
    body = rows.select(number.alias("place"), F.concat(F.lit("| "), F.concat_ws(" | ", *[_cell(c) for c in rows.columns]), F.lit(" |")).alias("value"))
    return lines.unionByName(body)


def html(rows: DataFrame, title: str, order: tuple[str, ...] = ()) -> DataFrame:
    """The lines (place, value) of a page with one table; texts are escaped."""
    safe = lambda c: F.replace(F.replace(F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    head = ["<!doctype html>", '<meta charset="utf-8">', f"<title>{title}</title>", "<table>", "<tr>" + "".join(f"<th>{c}</th>" for c in rows.columns) + "</tr>"]
    lines = rows.sparkSession.createDataFrame([(i - len(head), line) for i, line in enumerate(head)], "place long, value string")
    number = F.row_number().over(Window.orderBy(*(order or rows.columns))).cast("long")
    body = rows.select(number.alias("place"), F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td>"), safe(F.col(c)), F.lit("</td>")) for c in rows.columns], F.lit("</tr>")).alias("value"))
    last = rows.sparkSession.createDataFrame([((1 << 62), "</table>")], "place long, value string")
    return lines.unionByName(body).unionByName(last)
