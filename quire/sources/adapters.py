"""Layout tables made from the text tables: blocks(doc, page, ord, block_id, text, x0, y0, x1, y1, font, bold, page_w, page_h)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


NUMBERED = 4096


def _block(text: Column, x0: Column | float, y0: Column | float, x1: Column | float, y1: Column | float, font: float) -> Column:
    number = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    return F.struct(text.alias("text"), number(x0).alias("x0"), number(y0).alias("y0"), number(x1).alias("x1"), number(y1).alias("y1"), F.lit(float(font)).alias("font"))


def _blocks(pages: DataFrame, blocks: Column, page_w: Column, page_h: Column) -> DataFrame:
    rows = pages.select("doc", "page", page_w.alias("page_w"), page_h.alias("page_h"), F.posexplode(blocks).alias("ord", "b"))
    return rows.select("doc", "page", "ord", F.format_string("p%04d-b%04d", "page", F.col("ord") + 1).alias("block_id"), "b.*", F.lit(False).alias("bold"), "page_w", "page_h")


def furniture(documents: DataFrame) -> DataFrame:
    """A logical document per source: a header, a block per line, a legal line, a watermark and a page number on each page.

    Pages are numbered by blocks of doc_ids, so that a source with most of the rows is no single task.
    """
    docs = documents.select("source", "doc_id", "text", F.floor(F.col("doc_id") / NUMBERED).alias("block"))
    counts = docs.groupBy("source", "block").count()
    before = F.coalesce(F.sum("count").over(Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(F.col("source").alias("s"), F.col("block").alias("b"), before.alias("before"))
    within = F.row_number().over(Window.partitionBy("source", "block").orderBy("doc_id"))
    numbered = docs.join(counts, F.col("source").eqNullSafe(F.col("s")) & F.col("block").eqNullSafe(F.col("b"))).withColumn("page", (F.col("before") + within).cast("int"))
    pages = numbered.select(F.col("source").alias("doc"), "page", F.split(F.coalesce("text", F.lit("")), "\n").alias("lines"))
    n = F.size("lines").cast("double")
    h = F.greatest(F.lit(800.0), 120.0 + 12.0 * n)
    lines = F.transform("lines", lambda x, k: _block(x, 50, 60.0 + 12.0 * k.cast("double"), 50.0 + F.least(F.lit(500.0), 5.0 * F.length(x).cast("double")), 70.0 + 12.0 * k.cast("double"), 10))
    head = _block(F.concat("doc", F.lit(" digest")), 50, 20, 550, 34, 10)
    tail = F.array(
        _block(F.concat(F.lit("Copyright "), "doc", F.lit(". All rights reserved.")), 50, h - 50.0, 550, h - 38.0, 8),
        _block(F.lit("DRAFT"), 220, 0.4 * h, 380, 0.4 * h + 30.0, 28),
        _block(F.col("page").cast("string"), 290, h - 25.0, 310, h - 11.0, 10),
    )
    return _blocks(pages, F.concat(F.array(head), lines, tail), F.lit(600.0), h)


FURNITURE_SQL = """
fp AS (SELECT source AS doc, (row_number() OVER (PARTITION BY source ORDER BY doc_id))::INT AS page, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
fh AS (SELECT *, greatest(800.0::DOUBLE, 120.0::DOUBLE + 12.0::DOUBLE * len(lines)) AS h FROM fp),
fx AS (SELECT doc, page, h, list_concat(list_concat([{'text': doc || ' digest', 'x0': 50.0::DOUBLE, 'y0': 20.0::DOUBLE, 'x1': 550.0::DOUBLE, 'y1': 34.0::DOUBLE, 'font': 10.0::DOUBLE}],
  list_transform(lines, lambda x, k: {'text': x, 'x0': 50.0::DOUBLE, 'y0': 60.0::DOUBLE + 12.0::DOUBLE * (k - 1), 'x1': 50.0::DOUBLE + least(500.0::DOUBLE, 5.0::DOUBLE * length(x)), 'y1': 70.0::DOUBLE + 12.0::DOUBLE * (k - 1), 'font': 10.0::DOUBLE})),
  [{'text': 'Copyright ' || doc || '. All rights reserved.', 'x0': 50.0::DOUBLE, 'y0': h - 50.0::DOUBLE, 'x1': 550.0::DOUBLE, 'y1': h - 38.0::DOUBLE, 'font': 8.0::DOUBLE},
   {'text': 'DRAFT', 'x0': 220.0::DOUBLE, 'y0': 0.4::DOUBLE * h, 'x1': 380.0::DOUBLE, 'y1': 0.4::DOUBLE * h + 30.0::DOUBLE, 'font': 28.0::DOUBLE},
   {'text': page::VARCHAR, 'x0': 290.0::DOUBLE, 'y0': h - 25.0::DOUBLE, 'x1': 310.0::DOUBLE, 'y1': h - 11.0::DOUBLE, 'font': 10.0::DOUBLE}]) AS bs FROM fh),
fu AS (SELECT doc, page, h, unnest(bs) AS b, generate_subscripts(bs, 1) - 1 AS ord FROM fx),
blocks AS (SELECT doc, page, ord, printf('p%04d-b%04d', page, ord + 1) AS block_id, b.text AS text, b.x0 AS x0, b.y0 AS y0, b.x1 AS x1, b.y1 AS y1, b.font AS font, 600.0::DOUBLE AS page_w, h AS page_h FROM fu)"""


def wrapped(documents: DataFrame, words: int = 12, lines: int = 50, columns: int = 1, span: int | None = None) -> DataFrame:
    """A logical document per doc_id, its words wrapped into line blocks, in one or two columns.

    span: the blocks have page_range, the number of their range of so many pages, and those of a range are in one task. It is texts
    that are shuffled for that, before they are cut into lines.
    """
    tokens = F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda w: w != "")
    cut = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.size("w") / words).cast("int") - 1)), lambda k: F.array_join(F.slice("w", k * words + 1, words), " "))
    rows, per, range_ = documents.select(F.col("doc_id").cast("string").alias("doc"), tokens.alias("w")).where(F.size("w") > 0), lines * columns, []
    if span is None:
        rows = rows.select("doc", F.posexplode(cut).alias("n", "text"))
    else:
        held = words * per * span
        texts = F.transform(F.sequence(F.lit(0), F.ceil(F.size("w") / held).cast("int") - 1), lambda k: F.array_join(F.slice("w", k * held + 1, held), " "))
        rows = rows.select("doc", F.posexplode(texts).alias("page_range", "text")).repartition("doc", "page_range")
        rows = rows.select("doc", "page_range", F.split("text", " ").alias("w")).select("doc", "page_range", F.posexplode(cut).alias("n", "text"))
        rows, range_ = rows.withColumn("n", F.col("page_range") * per * span + F.col("n")), ["page_range"]
    slot = F.col("n") % per
    y0 = 20.0 + 15.0 * (slot % lines).cast("double")
    x0, x1 = (F.lit(50.0), F.lit(550.0)) if columns == 1 else (F.when(slot < lines, 40.0).otherwise(340.0), F.when(slot < lines, 260.0).otherwise(560.0))
    page, order = (F.floor(F.col("n") / per) + 1).cast("int"), slot.cast("int")
    return rows.select("doc", page.alias("page"), order.alias("ord"), F.format_string("p%04d-b%04d", page, order + 1).alias("block_id"), "text", x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), (y0 + 10.0).alias("y1"), F.lit(10.0).alias("font"), F.lit(False).alias("bold"), F.lit(600.0).alias("page_w"), F.lit(800.0).alias("page_h"), *range_)


def wrapped_sql(words: int = 12, lines: int = 50, columns: int = 1) -> str:
    per = lines * columns
    x0, x1 = ("50.0", "550.0") if columns == 1 else (f"CASE WHEN n % {per} < {lines} THEN 40.0 ELSE 340.0 END", f"CASE WHEN n % {per} < {lines} THEN 260.0 ELSE 560.0 END")
    return rf"""
ww AS (SELECT doc_id::VARCHAR AS doc, list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda w: w <> '') AS w FROM documents),
wl AS (SELECT doc, w, unnest(generate_series(0, ceil(len(w) / {words}.0)::INT - 1)) AS n FROM ww WHERE len(w) > 0),
blocks AS (SELECT doc, (n // {per} + 1)::INT AS page, (n % {per})::INT AS ord, printf('p%04d-b%04d', (n // {per} + 1)::INT, (n % {per} + 1)::INT) AS block_id, array_to_string(w[n * {words} + 1 : (n + 1) * {words}], ' ') AS text,
  ({x0})::DOUBLE AS x0, 20.0::DOUBLE + 15.0::DOUBLE * (n % {per} % {lines}) AS y0, ({x1})::DOUBLE AS x1, 30.0::DOUBLE + 15.0::DOUBLE * (n % {per} % {lines}) AS y1, 10.0::DOUBLE AS font, 600.0::DOUBLE AS page_w, 800.0::DOUBLE AS page_h FROM wl)"""


def units(conversations: DataFrame) -> DataFrame:
    """A translation unit per turn."""
    return conversations.select(F.col("conv_id").cast("string").alias("doc"), (F.col("turn") + 1).cast("int").alias("page"), F.struct("conv_id", "turn").alias("unit_order"), F.format_string("c%d-t%d", "conv_id", "turn").alias("unit_id"), "text", F.lit("translate").alias("policy"))


def html_pages(pages: DataFrame) -> DataFrame:
    """Pages of tag-stripped text; each advertisement counts as an image of a fifth of the page."""
    bare = F.trim(F.regexp_replace(F.regexp_replace("html", r"(?s)<script.*?</script>|<style.*?</style>", " "), "<[^>]*>", " "))
    images = F.size(F.regexp_extract_all("html", F.lit('<div class="ad"'), 0))
    return pages.select(F.col("url").alias("doc"), F.lit(1).alias("page"), F.length(bare).cast("long").alias("chars"), F.lit(1).alias("n_blocks"), images.alias("images"), (0.2 * images).alias("image_area"))


def words(blocks: DataFrame, advance: float = 5.0) -> DataFrame:
    """The words of blocks as they stand on their line, each character ``advance`` wide: doc, page, word, its box and the page's size.

    A word begins behind the space before it, so places come from the text alone and nothing is shuffled.
    """
    characters = F.transform(F.split("text", ""), lambda c, k: F.when(c == " ", k + 1))
    begins = F.concat(F.array(F.lit(0)), F.array_compact(characters))
    rows = blocks.select("doc", "page", "x0", "y0", "y1", "page_w", "page_h", F.explode(F.arrays_zip(F.split("text", " ").alias("word"), begins.alias("begin"))).alias("w"))
    rows = rows.where("w.word <> ''").withColumns({"word": F.col("w.word"), "x": F.col("x0") + advance * F.col("w.begin")})
    return rows.select("doc", "page", "word", F.col("x").alias("x0"), "y0", (F.col("x") + advance * F.length("word")).alias("x1"), "y1", "page_w", "page_h")


WORDS_SQL = """
wd AS (SELECT doc, page, block_id, x0, y0, y1, unnest(string_split(text, ' ')) AS word, generate_subscripts(string_split(text, ' '), 1) AS place FROM blocks),
we AS (SELECT *, x0 + 5.0::DOUBLE * coalesce(sum(length(word) + 1) OVER (PARTITION BY doc, page, block_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS x FROM wd),
words AS (SELECT doc, page, word, x AS x0, y0, x + 5.0::DOUBLE * length(word) AS x1, y1 FROM we WHERE word <> '')"""
