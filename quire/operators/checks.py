"""Consistency of layouts, references, sources and selections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.sources.files import glob_matches


def layout_differences(current: DataFrame, stored: DataFrame, tolerance: float = 0.5) -> DataFrame:
    """Blocks that one side lacks, or whose text or box differs by over a tolerance. Both: doc, page, ord, text, box."""
    box = ("x0", "y0", "x1", "y1")
    a = current.select("doc", "page", "ord", F.struct("text", *box).alias("a"))
    b = stored.select("doc", "page", "ord", F.struct("text", *box).alias("b"))
    moved = F.lit(False)
    for c in box:
        moved = moved | (F.abs(F.col(f"a.{c}") - F.col(f"b.{c}")) > tolerance)
    problem = F.when(F.col("b").isNull(), "not stored").when(F.col("a").isNull(), "gone").when(~F.col("a.text").eqNullSafe(F.col("b.text")), "text").when(moved, "box")
    return a.join(b, ["doc", "page", "ord"], "full_outer").select("doc", "page", "ord", problem.alias("problem")).where("problem IS NOT NULL")


def dangling(children: DataFrame, parents: DataFrame, *key: str) -> DataFrame:
    """Keys of the children that no parent has."""
    return children.select(*key).distinct().join(parents.select(*key), list(key), "left_anti")


def repeated_ids(rows: DataFrame, key: str) -> DataFrame:
    """Ids that occur more than once, in any case of letters."""
    return rows.groupBy(F.lower(key).alias("id")).agg(F.count("*").alias("n")).where("n > 1")


def changed_sources(before: DataFrame, after: DataFrame) -> DataFrame:
    """Files whose hash or size differs between two scans. Both: path, file_size, sha256."""
    a, b = before.alias("a"), after.alias("b")
    return a.join(b, "path").where((F.col("a.sha256") != F.col("b.sha256")) | (F.col("a.file_size") != F.col("b.file_size"))).select("path")


def in_subset(path: Column, ids: Column, categories: Column, selectors: tuple[str, ...]) -> Column:
    """The first selector that fits: an id, a category, or a glob of the path."""
    fits = [F.when((ids == s) | F.array_contains(categories, s) | glob_matches(path, s), s) for s in selectors]
    return F.coalesce(*fits, F.lit(None).cast("string"))


def unmatched_selectors(documents: DataFrame, selectors: tuple[str, ...]) -> DataFrame:
    """Selectors that fit no document. documents: path, id, categories."""
    hit = [F.max(F.coalesce((F.col("id") == s) | F.array_contains("categories", s) | glob_matches(F.col("path"), s), F.lit(False))).alias(f"s{k}") for k, s in enumerate(selectors)]
    flags = F.array(*[F.struct(F.lit(s).alias("selector"), F.coalesce(F.col(f"s{k}"), F.lit(False)).alias("hit")) for k, s in enumerate(selectors)])
    return documents.agg(*hit).select(F.explode(flags).alias("x")).where("NOT x.hit").select("x.selector")


def code_points(texts: DataFrame, text: str, *by: str) -> DataFrame:
    """The distinct characters that a font must have."""
    return texts.select(*by, F.explode(F.split(text, "")).alias("c")).where("c <> ''").groupBy(*by, "c").count().groupBy(*by).agg(F.array_sort(F.collect_list("c")).alias("characters"))


def has_cyrillic(c: Column) -> Column:
    return c.rlike("[\\x{0400}-\\x{052F}]")


def missing_languages(requested: Column, installed: Column) -> Column:
    return F.array_except(requested, installed)


def sane_boxes(blocks: DataFrame, slack: float = 0.5) -> DataFrame:
    """Blocks whose box is not empty and lies on its page."""
    inside = (F.col("x0") >= -slack) & (F.col("y0") >= -slack) & (F.col("x1") <= F.col("page_w") + slack) & (F.col("y1") <= F.col("page_h") + slack)
    return blocks.where(inside & (F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0")))


def resumable(run: DataFrame, units: DataFrame, stored: DataFrame, identity: str) -> DataFrame:
    """Why a stored run can't be resumed; no row if it can. run: identity; units, stored: unit_id, text."""
    other = run.where(F.col("identity") != identity).select(F.lit("identity differs").alias("reason"))
    changed = units.join(stored.withColumnRenamed("text", "was"), "unit_id", "full_outer").where(~F.col("text").eqNullSafe(F.col("was"))).limit(1).select(F.lit("units differ").alias("reason"))
    return other.unionByName(changed)


def first_boxes(fragments: DataFrame) -> DataFrame:
    """Fragments with repeated: whether an earlier one (para, frag) has the same box on the same page, so that it is taken out once."""
    earlier = F.row_number().over(Window.partitionBy("doc", "page", "x0", "y0", "x1", "y1").orderBy("para", "frag"))
    return fragments.withColumn("repeated", earlier > 1)


def shown(ids: Column, most: int = 8) -> Column:
    """The first ids of a list, for a message."""
    return F.array_join(F.slice(ids, 1, most), ", ")


def snippet(text: Column, most: int = 240) -> Column:
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.left(text, F.lit(most)), F.lit("...")))


def rounded_box(*box: Column) -> Column:
    """Half to even, as floating-point numbers are rounded."""
    return F.array(*[F.bround(c, 2) for c in box])


def first_known(value: str, order: str) -> Column:
    """Of a group: the first value, in order, that there is."""
    return F.min_by(value, F.when(F.col(value).isNotNull(), F.col(order)))


def iterations(runs: DataFrame, warmup: int) -> DataFrame:
    """The runs of each batch size numbered from 0, warm-ups by themselves. runs: batch, place."""
    n = F.row_number().over(Window.partitionBy("batch").orderBy("place")) - 1
    return runs.withColumn("n", n).withColumns({"warmup": F.col("n") < warmup, "iteration": F.when(F.col("n") < warmup, F.col("n")).otherwise(F.col("n") - warmup)}).drop("n")


def distinct_in_order(warnings: DataFrame, *by: str) -> DataFrame:
    """The warnings of a group, each once, in the order of their first occurrence. warnings: place, warning."""
    firsts = warnings.groupBy(*by, "warning").agg(F.min("place").alias("place"))
    items = F.sort_array(F.collect_list(F.struct("place", "warning")))
    return firsts.groupBy(*by).agg(F.transform(items, lambda x: x["warning"]).alias("warnings"))


def compatible_runs(stored: DataFrame, wanted: dict[str, object]) -> DataFrame:
    """Of each stored run the facts that differ from those wanted; none: it can be resumed. stored: run, and a column for each fact."""
    differ = F.array_compact(F.array(*[F.when(~F.col(c).eqNullSafe(F.lit(v)), F.lit(c)) for c, v in wanted.items()]))
    return stored.select("run", differ.alias("differ"), (F.size(differ) == 0).alias("resumable"))
