"""Page classes and document inspection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import count_cyrillic, count_latin, probable_language
from quire.plans.options import PageOptions

CLASSES = ("text", "scanned", "mixed", "empty")


def image_ratio(area: Column, page_area: Column) -> Column:
    return F.least(area / F.greatest(page_area, F.lit(1.0)), F.lit(1.0))


def page_text(blocks: DataFrame) -> DataFrame:
    """chars and n_blocks of each page."""
    return blocks.groupBy("doc", "page").agg(F.sum(F.length(F.trim("text"))).cast("long").alias("chars"), F.count("*").alias("n_blocks"))


def classify_pages(pages: DataFrame, options: PageOptions = PageOptions()) -> DataFrame:
    """pages: doc, page, chars, n_blocks, images, image_area (a share of the page). Adds class and warning."""
    meaningful = (F.col("chars") >= options.least_chars) | (F.col("n_blocks") > 1)
    ratio = F.least(F.col("image_area"), F.lit(1.0))
    image = F.col("images") > 0
    kind = F.when((F.col("n_blocks") == 0) & ~image, "empty").when(image & ~meaningful, "scanned").when(meaningful & image & (ratio >= options.mixed_image_ratio), "mixed").otherwise("text")
    return pages.withColumn("class", kind).withColumn("warning", F.when((F.col("class") == "scanned") & (ratio < options.scanned_image_ratio), "low image coverage"))


def inspect(classified: DataFrame, *by: str) -> DataFrame:
    """Pages of each class, blocks and images; zero where there are none."""
    counts = [F.count_if(F.col("class") == c).alias(f"{c}_pages") for c in CLASSES]
    return classified.groupBy(*by).agg(*counts, F.count("*").alias("n_pages"), F.sum("n_blocks").cast("long").alias("n_blocks"), F.sum("images").cast("long").alias("n_images"))


def languages(texts: DataFrame, doc: str, text: str) -> DataFrame:
    """Latin and Cyrillic letters of each document, and its probable language."""
    sums = texts.groupBy(doc).agg(F.sum(count_latin(F.col(text))).cast("long").alias("latin"), F.sum(count_cyrillic(F.col(text))).cast("long").alias("cyrillic"))
    return sums.withColumn("language", probable_language(F.col("latin"), F.col("cyrillic")))


def ocr_targets(classified: DataFrame, mode: str = "auto", force: bool = False) -> DataFrame:
    """Pages for character recognition: scanned ones (auto), all (on, forced), scanned and empty ones (on), none (off)."""
    wanted = {"auto": F.col("class") == "scanned", "on": F.lit(True) if force else F.col("class").isin("scanned", "empty"), "off": F.lit(False)}
    return classified.where(wanted[mode])


def compare_pages(before: DataFrame, after: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Pages before and after recognition: whether the geometry is the same and text was gained; missing sides are skipped."""
    a, b = before.alias("a"), after.alias("b")
    same = (F.abs(F.col("a.page_w") - F.col("b.page_w")) <= tolerance) & (F.abs(F.col("a.page_h") - F.col("b.page_h")) <= tolerance)
    return a.join(b, ["doc", "page"]).select("doc", "page", same.alias("same_geometry"), (F.col("b.chars") - F.col("a.chars")).alias("gained"))


def recognition_problems(before: DataFrame, after: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Of documents whose pages went through recognition: another number of pages, another geometry, little or no text gained. Both: doc, page, page_w, page_h, chars, class; after: processed."""
    count = lambda rows, name: rows.groupBy("doc").agg(F.count("*").alias(name))
    other = count(before, "n").join(count(after, "m"), "doc", "full_outer").where(~F.col("n").eqNullSafe(F.col("m"))).select("doc", F.lit(None).cast("int").alias("page"), F.lit("page count").alias("problem"))
    pairs = compare_pages(before, after, tolerance).join(after.select("doc", "page", "class", "processed"), ["doc", "page"])
    moved = pairs.where("NOT same_geometry").select("doc", "page", F.lit("geometry").alias("problem"))
    poor = pairs.where("processed AND (class = 'scanned' OR gained <= 0)").select("doc", "page", F.lit("little text").alias("problem"))
    return other.unionByName(moved).unionByName(poor)
