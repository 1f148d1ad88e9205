"""Reading order and logical paragraphs.

A decision between neighbours depends on the two fragments alone: every kind but body keeps its paragraph to itself, so a
paragraph of several fragments is all body and its kind is its last fragment's. Paragraphs are therefore windows over
pages, with a running sum of the breaks as number.

Fragments are dealt to tasks once, by document and range of pages, and everything within a range is made there: its paragraphs
are written with their texts, and those of one range only aren't shuffled again. What a range needs of the one before, and the
numbers of paragraphs, come from one row for each range. A document of any number of pages is therefore spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.functions.text import CAPTION, LIST_MARKER, TERMINAL, is_ascii, is_lower_start, is_soft_hyphen, join_text, lstrip, rstrip, strip
from quire.plans.options import ParagraphOptions
from quire.plans.scratch import settle

REPEATED_KINDS = {"page_number": "page_number", "running_header": "header", "running_footer": "footer", "repeated_boilerplate": "repeated_boilerplate", "watermark_candidate": "watermark_candidate", "unknown_repeated": "unknown_repeated"}
BOUNDARIES = (("heading", "heading_boundary"), ("list_item", "list_boundary"), ("caption", "caption_boundary"), ("footnote", "footnote_boundary"))
PAGE = ["doc", "page"]
RANGE = 1024  # pages that one task holds at once


def _page(rows: DataFrame) -> list[str]:
    """What windows over a page are partitioned by; rows that are dealt by ranges of pages stay where they are."""
    return ["doc", "page_range", "page"] if "page_range" in rows.columns else PAGE


def _facing(fragments: DataFrame, o: ParagraphOptions) -> DataFrame:
    """facing: whether a fragment on one side of the gutter overlaps, in height, an earlier one on the other side."""
    middle, half = F.col("page_w") / 2, F.col("page_w") * o.gutter / 2
    left, right = F.col("x1") <= middle - half, F.col("x0") >= middle + half
    # from the top of the page down, the lowest end of each side so far; an empty box comes before others that begin where it is
    above = Window.partitionBy(*_page(fragments)).orderBy("y0", "y1").rowsBetween(Window.unboundedPreceding, -1)
    lowest = lambda side: F.max(F.when(side, F.col("y1"))).over(above)
    return fragments.withColumn("facing", F.coalesce((left & (lowest(right) > F.col("y0"))) | (right & (lowest(left) > F.col("y0"))), F.lit(False)))


def two_column_pages(fragments: DataFrame, o: ParagraphOptions = ParagraphOptions()) -> DataFrame:
    """Pages on which a fragment left of the gutter overlaps, in height, one to the right of it."""
    boxes = fragments.select(*PAGE, "x0", "y0", "x1", "y1", "page_w")
    return _facing(boxes, o).groupBy(*PAGE).agg(F.max("facing").alias("two")).where("two").select(*PAGE)


def reading_order(fragments: DataFrame, o: ParagraphOptions = ParagraphOptions()) -> DataFrame:
    """The fragments with column and seq (from 1 on each page)."""
    page = _page(fragments)
    two = F.max("facing").over(Window.partitionBy(*page))
    column = F.when(F.col("two") & (F.col("x1") > F.col("page_w") / 2) & (F.col("x0") >= F.col("page_w") / 2), 1).otherwise(0)
    rows = _facing(fragments, o).withColumn("two", two).withColumn("column", column).drop("two", "facing")
    return rows.withColumn("seq", F.row_number().over(Window.partitionBy(*page).orderBy("column", "y0", "x0", "block_id", "ord")))


def _kinds(rows: DataFrame, o: ParagraphOptions) -> DataFrame:
    """page_font and paragraph kind of each fragment; repeated: the kind that the block was classified as, if any."""
    page = Window.partitionBy(*_page(rows))
    rows = rows.withColumn("page_font", F.coalesce(F.expr("percentile(CASE WHEN font > 0 THEN font END, 0.5)").over(page), F.lit(0.0)))
    known = (F.col("page_font") > 0) & (F.coalesce("font", F.lit(0.0)) > 0)
    letters = F.regexp_replace("text", r"\P{L}", "")
    # ASCII text with capitals only is its own upper case, which is cheaper to see than its letters
    upper = ((F.upper("text") == F.col("text")) | ~is_ascii(F.col("text"))) & (F.upper(letters) == letters) & letters.rlike(r"\p{Lu}")
    words = F.size(F.filter(F.split("text", r"(?U)\s+"), lambda w: w != ""))
    larger = (F.col("page_font") > 0) & (F.coalesce("font", F.lit(0.0)) >= F.col("page_font") * o.heading_font)
    repeated = F.coalesce(*[F.when(F.col("repeated") == k, v) for k, v in REPEATED_KINDS.items()])
    kind = (
        F.when(F.col("text").rlike(LIST_MARKER), "list_item")
        .when(F.col("text").rlike(CAPTION), "caption")
        .when(known & (F.col("font") <= F.col("page_font") * o.footnote_font) & (F.col("y0") >= F.col("page_h") * 0.6), "footnote")
        .when((F.coalesce("bold", F.lit(False)) | larger | upper) & (letters != "") & (words <= 12), "heading")
        .otherwise("body")
    )
    return rows.withColumn("kind", F.coalesce(repeated, kind))


def _boundary(a: Column, b: Column) -> Column:
    return F.coalesce(*[F.when((a == kind) | (b == kind), reason) for kind, reason in BOUNDARIES])


def _unfinished(text: Column) -> Column:
    last = F.right(rstrip(text), F.lit(1))
    return (last != "") & ~last.isin(*TERMINAL)


def _prefixed(*flags: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*[F.when(c, r) for c, r in flags]))


def page_decisions(fragments: DataFrame, o: ParagraphOptions = ParagraphOptions()) -> DataFrame:
    """The fragments in reading order with the action (null for the first of a page) and reasons towards the one before. fragments may have ``repeated``."""
    rows = fragments if "repeated" in fragments.columns else fragments.withColumn("repeated", F.lit(None).cast("string"))
    rows = _kinds(reading_order(rows, o), o)
    by_page = Window.partitionBy(*_page(rows)).orderBy("seq")
    names = ("x0", "y0", "x1", "y1", "font", "bold", "text", "kind", "column", "block_id", "ord")
    rows = rows.withColumn("p", F.lag(F.struct(*names)).over(by_page)).select("*", *[F.col(f"p.{c}").alias(f"p_{c}") for c in names]).drop("p")
    special = [v for v in REPEATED_KINDS.values()]
    height = F.least(F.greatest(F.col("y1") - F.col("y0"), F.lit(1.0)), F.greatest(F.col("p_y1") - F.col("p_y0"), F.lit(1.0)))
    wide, p_wide = F.greatest(F.col("x1") - F.col("x0"), F.lit(1.0)), F.greatest(F.col("p_x1") - F.col("p_x0"), F.lit(1.0))
    shift, gap = F.abs(F.col("p_x0") - F.col("x0")), F.col("y0") - F.col("p_y1")
    aligned, far = shift <= o.alignment, (gap > height * o.gap) | (gap < -height * 0.35)
    both_fonts = (F.coalesce("p_font", F.lit(0.0)) > 0) & (F.coalesce("font", F.lit(0.0)) > 0)
    bold = F.coalesce("bold", F.lit(False)) == F.coalesce("p_bold", F.lit(False))
    style = bold & ~(both_fonts & (F.abs(F.col("p_font") - F.col("font")) > F.greatest(F.lit(0.75), F.col("page_font") * 0.08)))
    same_block = F.col("p_block_id") == F.col("block_id")
    similar = F.least(wide, p_wide) / F.greatest(wide, p_wide) >= o.width
    soft, lower, open_end = is_soft_hyphen(F.col("p_text"), F.col("text")), is_lower_start(F.col("text")), _unfinished(F.col("p_text"))
    boundary = F.when(F.col("p_kind").isin(special) | F.col("kind").isin(special), "repeated_element_boundary").otherwise(F.coalesce(_boundary(F.col("p_kind"), F.col("kind")), F.when(F.col("p_column") != F.col("column"), "column_boundary")))
    geometry, goes_on = same_block | similar, lower | open_end
    stop = F.when(shift > o.indentation, "indentation_change").when(far, "gap_too_large").when(~style, "style_change")
    action = F.when(F.col("p_kind").isNull(), None).when(boundary.isNotNull() | stop.isNotNull(), "keep").when(soft | (goes_on & geometry), "merge").when(geometry, "ambiguous").otherwise("keep")
    first = (F.lit(True), "same_column"), (aligned, "aligned")
    middle = (~far, "close_vertical_gap"), (~far & style, "compatible_style")
    last = (same_block, "same_source_block"), (~same_block & similar, "similar_width")
    tail = (soft, "soft_hyphen"), (~soft & rstrip(F.col("p_text")).endswith("-"), "protected_hyphen"), (~soft & lower, "lowercase_continuation"), (~soft & open_end, "unfinished_sentence"), (~soft & ~open_end, "terminal_punctuation"), (~soft & geometry & ~goes_on, "ambiguous_geometry")
    reasons = (
        F.when(F.col("p_kind").isNull(), None)
        .when(boundary.isNotNull(), F.array(boundary))
        .when(stop == "indentation_change", _prefixed(*first, (F.lit(True), "indentation_change")))
        .when(stop == "gap_too_large", _prefixed(*first, (F.lit(True), "gap_too_large")))
        .when(stop == "style_change", _prefixed(*first, middle[0], (F.lit(True), "style_change")))
        .otherwise(_prefixed(*first, *middle, *last, *tail))
    )
    return rows.withColumns({"action": action, "reasons": reasons, "soft": soft})


def _folded(items: Column, first: Column) -> Column:
    """Texts in order, as one; ``first`` stands for the first. The same as ``join_text`` from left to right, but what precedes the last space put in is kept aside, as no later text changes it."""
    none = F.array().cast("array<string>")

    def add(acc: Column, x: Column) -> Column:
        left, right = rstrip(acc["last"]), lstrip(x["text"])
        apart = F.struct(F.array_append(acc["done"], left).alias("done"), right.alias("last"))
        onto = lambda last: F.struct(acc["done"].alias("done"), last.alias("last"))
        # an empty text gives a space that goes again with the next one
        return F.when(right == "", onto(F.concat(left, F.lit(" ")))).when(is_soft_hyphen(left, right), onto(F.concat(F.regexp_replace(left, "-$", ""), right))).otherwise(apart)

    made = F.aggregate(F.slice(items, 2, F.size(items)), F.struct(none.alias("done"), first.alias("last")), add, lambda acc: F.array_join(F.array_append(acc["done"], acc["last"]), " "))
    return F.when(~F.exists(items, lambda x: x["text"].isNull()), made)


def _same_range(p: DataFrame, ranges: DataFrame, *kept: str) -> DataFrame:
    """Rows with what is known of their range of pages."""
    thin = ranges.select(F.col("doc").alias("r_doc"), F.col("page_range").alias("r_range"), *kept)
    return p.join(thin, F.col("doc").eqNullSafe(F.col("r_doc")) & (F.col("page_range") == F.col("r_range")), "left").drop("r_doc", "r_range")


def numbered(p: DataFrame, amount: Column, name: str, *order: str) -> DataFrame:
    """The running sum of an amount in ``order`` within a document: within ranges, plus the sum of the ranges before. p: doc, page_range."""
    within = Window.partitionBy("doc", "page_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    sums = p.select("doc", "page_range", amount.alias("n")).groupBy("doc", "page_range").agg(F.sum("n").alias("n"))
    earlier = Window.partitionBy("doc").orderBy("page_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = sums.withColumn("offset", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    return _same_range(p.withColumn(name, F.sum(amount).over(within)), ranges, "offset").withColumn(name, F.col(name) + F.col("offset")).drop("offset")


def page_range(page: Column, span: int = RANGE) -> Column:
    return F.floor((page - 1) / span)


def _dealt(fragments: DataFrame, span: int) -> DataFrame:
    """Fragments with the range of their page, in its task. Those that have ``page_range`` are there already."""
    return fragments if "page_range" in fragments.columns else fragments.withColumn("page_range", page_range(F.col("page"), span)).repartition("doc", "page_range")


def _across(q: Column, p: Column, o: ParagraphOptions) -> dict[str, Column]:
    """action (null within a page), reasons and soft of the start of a page's paragraph (p) towards the end of the one before (q)."""
    crosses = q["page"] != p["page"]
    aligned, column = F.abs(q["x0"] - p["x0"]) <= o.alignment, q["column"] == p["column"]
    lower, open_end, soft = p["lower"], _unfinished(q["word"]), is_soft_hyphen(q["word"], p["word"])
    edges = (q["y1"] >= q["page_h"] * (1 - o.page_edge)) & (p["y0"] <= p["page_h"] * o.page_edge)
    able = column & aligned & (lower | open_end)
    bodies, next_page = (q["kind"] == "body") & (p["kind"] == "body"), p["page"] == q["page"] + 1
    action = F.when(~crosses | q["page"].isNull(), None).when(~next_page | ~bodies, "keep").when(able & edges, "merge").when(able, "ambiguous").otherwise("keep")
    weak = F.lit("page_boundary_weak")
    said = _prefixed((column, "same_column"), (aligned, "aligned"), (lower, "lowercase_continuation"), (open_end, "unfinished_sentence"), (soft, "soft_hyphen"), (able & edges, "cross_page_continuation"), (~(able & edges), "page_boundary_weak"))
    reasons = F.when(~next_page, F.array(weak)).when(~bodies, F.array(F.coalesce(_boundary(q["kind"], p["kind"]), weak))).otherwise(said)
    return {"action": action, "reasons": F.when(action.isNotNull(), reasons), "soft": F.when(action.isNotNull(), soft)}


def page_paragraphs(fragments: DataFrame, o: ParagraphOptions = ParagraphOptions(), span: int = RANGE) -> DataFrame:
    """A row per paragraph of a page, in the task of its range of ``span`` pages, with the decision towards the page before.

    part numbers the paragraphs of a range. The first row of a range has no decision; it has opening and the last one closing, from
    which ``_borders`` makes it.
    """
    rows = page_decisions(_dealt(fragments, span), o)
    page = _page(rows)
    by_page = Window.partitionBy(*page).orderBy("seq")
    merges, doubtful = (F.coalesce(F.col("action") == a, F.lit(False)) for a in ("merge", "ambiguous"))
    rows = rows.withColumns({"local": F.sum(F.when(merges, 0).otherwise(1)).over(by_page), "after": F.lead("action").over(by_page)})
    # each block counts where it first occurs
    rows = rows.withColumn("new_block", F.row_number().over(Window.partitionBy(*page, "block_id").orderBy("seq")) == 1)
    box = [F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")]
    first, last = lambda c: F.min_by(c, "seq"), lambda c: F.max_by(c, "seq")
    made = F.when(F.col("action").isNotNull(), F.struct("seq", F.col("p_block_id").alias("previous"), F.col("block_id").alias("current"), "action", "reasons"))
    p = rows.groupBy(*page, "local").agg(
        first("block_id").alias("id"), first("kind").alias("kind"), F.sort_array(F.collect_list(F.struct("seq", "text"))).alias("items"),
        F.max(doubtful | F.coalesce(F.col("after") == "ambiguous", F.lit(False))).alias("ambiguous"), *box, F.first("page_h").alias("page_h"),
        first(F.struct("x0", "y0", "column", "block_id", is_lower_start(F.col("text")).alias("lower"))).alias("head"), last(F.struct("x0", "y1", "column", "block_id")).alias("tail"),
        F.count("*").alias("n_fragments"), F.count_if("new_block").alias("n_blocks"), F.count("action").alias("n_decisions"), F.count_if(doubtful).alias("n_ambiguous"),
        F.count_if(merges & F.col("soft")).alias("n_soft"), F.sort_array(F.collect_list(made)).alias("inside"), F.collect_set("block_id").alias("blocks"),
    )
    p = p.withColumn("text", _folded(F.col("items"), strip(F.col("items")[0]["text"]))).drop("items")
    # of a text the other page needs no more than its last or first word
    begin, end = F.substring_index(lstrip(F.col("text")), " ", 1), F.substring_index(rstrip(F.col("text")), " ", -1)
    p = p.withColumns({"start": F.struct("page", "kind", "page_h", "head.*", begin.alias("word")), "end": F.struct("page", "kind", "page_h", "tail.*", end.alias("word"))}).drop("head", "tail", "page_h")
    within = Window.partitionBy("doc", "page_range").orderBy("page", "local")
    p = p.withColumns({"q": F.lag("end").over(within), "final": F.lead("page").over(within).isNull()})
    p = p.withColumns(_across(F.col("q"), F.col("start"), o)).withColumns({"opening": F.when(F.col("q").isNull(), F.col("start")), "closing": F.when(F.col("final"), F.col("end"))})
    breaks = F.when(F.coalesce(F.col("action") == "merge", F.lit(False)), 0).otherwise(1)
    return p.withColumn("part", F.sum(breaks).over(within)).drop("final", "end")


def _borders(ends: DataFrame, o: ParagraphOptions) -> DataFrame:
    """Ranges of pages (doc, page_range, opening, closing, parts) with the decision towards the range before: goes_on and gone_on tell whether a paragraph crosses the two borders, offset is the number before the first paragraph."""
    by_doc = Window.partitionBy("doc").orderBy("page_range")
    rows = ends.withColumn("q", F.lag("closing").over(by_doc))
    rows = rows.withColumns(_across(F.col("q"), F.col("opening"), o)).withColumn("goes_on", F.coalesce(F.col("action") == "merge", F.lit(False)))
    earlier = F.coalesce(F.sum("parts").over(by_doc.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offset = earlier - F.sum(F.col("goes_on").cast("int")).over(by_doc.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumns({"offset": offset, "gone_on": F.coalesce(F.lead("goes_on").over(by_doc), F.lit(False))})


def _decided(*more: Column) -> Column:
    """Decisions as one array; ``more`` are arrays of them."""
    return F.flatten(F.filter(F.array(*more), lambda x: x.isNotNull()))


def _crossing(q: Column, p: Column) -> Column:
    return F.when(F.col("action").isNotNull(), F.array(F.struct(p["page"].alias("page"), q["block_id"].alias("previous"), p["block_id"].alias("current"), "action", "reasons", F.lit(True).alias("cross_page"))))


def _joined(rows: DataFrame, by: tuple[str, ...], *more: Column) -> DataFrame:
    """Parts of paragraphs as one row: a paragraph has one part on a page, and the kind and box of the first."""
    merged = rows.groupBy(*by).agg(
        F.min(F.struct("page", "id", "kind", "x0", "y0", "x1", "y1")).alias("first"), F.sort_array(F.collect_list(F.struct("page", "text"))).alias("parts"), F.sum("n_fragments").cast("long").alias("n_fragments"),
        F.max("ambiguous").alias("ambiguous"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("blocks")))).alias("blocks"), *more,
    )
    text = _folded(F.col("parts"), F.col("parts")[0]["text"])
    return merged.select(*by, "first.id", "first.page", "first.kind", "first.x0", "first.y0", "first.x1", "first.y1", "n_fragments", "ambiguous", "blocks", text.alias("text"), *merged.columns[len(by) + 5 :])


def _written(fragments: DataFrame, o: ParagraphOptions, span: int, decisions: bool) -> tuple[DataFrame, DataFrame]:
    """Paragraphs of ranges of pages, with their texts, and the borders between ranges of one document. Both are written, the second is thin."""
    p = page_paragraphs(fragments, o, span)
    more = [F.max("opening").alias("opening"), F.max("closing").alias("closing")]
    if decisions:
        within = F.transform("inside", lambda x: F.struct(F.col("page"), x["previous"].alias("previous"), x["current"].alias("current"), x["action"].alias("action"), x["reasons"].alias("reasons"), F.lit(False).alias("cross_page")))
        more.append(F.flatten(F.collect_list(_decided(within, _crossing(F.col("q"), F.col("start"))))).alias("decisions"))
    p = p.withColumn("ambiguous", F.col("ambiguous") | F.coalesce(F.col("action") == "ambiguous", F.lit(False)))
    parts = settle(_joined(p, ("doc", "page_range", "part"), *more))
    ends = parts.groupBy("doc", "page_range").agg(F.max("opening").alias("opening"), F.max("closing").alias("closing"), F.max("part").alias("parts"))
    several = F.count("*").over(Window.partitionBy("doc")) > 1
    return parts, settle(_borders(ends.withColumn("several", several).where("several").drop("several"), o))


def _numbered_paragraphs(parts: DataFrame, borders: DataFrame) -> DataFrame:
    """Logical paragraphs. Only those that cross a border between ranges are grouped once more."""
    known = _same_range(parts, borders.withColumn("doubt", F.col("action") == "ambiguous"), "offset", "goes_on", "gone_on", "parts", "doubt")
    at_start, at_end = F.col("part") == 1, F.col("part") == F.col("parts")
    yes = lambda c: F.coalesce(c, F.lit(False))
    known = known.withColumns({"para": F.col("part") + F.coalesce("offset", F.lit(0)), "ambiguous": F.col("ambiguous") | yes(at_start & F.col("doubt")), "crosses": yes((at_start & F.col("goes_on")) | (at_end & F.col("gone_on")))})
    crossing = _joined(known.where("crosses"), ("doc", "para"))
    return known.where("NOT crosses").select(*crossing.columns).unionByName(crossing)


def logical_paragraphs(fragments: DataFrame, o: ParagraphOptions = ParagraphOptions(), span: int = RANGE) -> DataFrame:
    """Logical paragraphs (doc, para, id, page, kind, text, box, n_fragments, ambiguous, blocks); no decisions are written for them. fragments may have ``page_range``, and are dealt by it then."""
    if o.mode == "off":
        alone = numbered(fragments.withColumn("page_range", page_range(F.col("page"), span)), F.lit(1), "para", "page", "ord")
        return alone.select("doc", "para", F.col("block_id").alias("id"), "page", F.lit("body").alias("kind"), strip(F.col("text")).alias("text"), "x0", "y0", "x1", "y1", F.lit(1).cast("long").alias("n_fragments"), F.lit(False).alias("ambiguous"), F.array("block_id").alias("blocks"))
    return _numbered_paragraphs(*_written(fragments, o, span, False))


def paragraphs_of(fragments: DataFrame, o: ParagraphOptions = ParagraphOptions(), span: int = RANGE) -> tuple[DataFrame, DataFrame]:
    """Logical paragraphs, as of ``logical_paragraphs``, and decisions (doc, page, previous, current, action, reasons, cross_page)."""
    if o.mode == "off":
        none = fragments.sparkSession.createDataFrame([], "doc string, page int, previous string, current string, action string, reasons array<string>, cross_page boolean")
        return logical_paragraphs(fragments, o, span), none
    parts, borders = _written(fragments, o, span, True)
    at_borders = borders.select("doc", F.explode(_crossing(F.col("q"), F.col("opening"))).alias("d"))
    return _numbered_paragraphs(parts, borders), parts.select("doc", F.explode("decisions").alias("d")).unionByName(at_borders).select("doc", "d.*")


def paragraph_metrics(fragments: DataFrame, o: ParagraphOptions = ParagraphOptions(), by: tuple[str, ...] = ("doc",)) -> DataFrame:
    """Raw lines and blocks, paragraphs, merged fragments, decisions, ambiguous ones, merges across pages, soft hyphens removed. by: doc, or nothing."""
    decided, merges, doubted = F.col("action").isNotNull(), *(F.coalesce(F.col("action") == a, F.lit(False)) for a in ("merge", "ambiguous"))
    n = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    counts = {"n_decisions": decided, "n_ambiguous": doubted, "n_merges": merges, "n_soft": merges & F.col("soft")}
    within = page_paragraphs(fragments, o).withColumn("n_merges", F.lit(0)).groupBy("doc", "page_range").agg(
        n("n_fragments").alias("raw_lines"), n("n_blocks").alias("raw_blocks"), F.max("part").alias("parts"), F.max("opening").alias("opening"), F.max("closing").alias("closing"),
        *[(n(c) + F.count_if(here)).alias(c) for c, here in counts.items()],
    )
    total = {c: n(c) + F.count_if(here) for c, here in counts.items()}
    paragraphs = n("parts") - F.count_if("goes_on")
    return _borders(within, o).groupBy(*by).agg(
        n("raw_lines").alias("raw_lines"), n("raw_blocks").alias("raw_blocks"), paragraphs.alias("n_paragraphs"), (n("raw_lines") - paragraphs).alias("merged"), total["n_decisions"].alias("n_decisions"),
        total["n_ambiguous"].alias("n_ambiguous"), total["n_merges"].alias("cross_page_merges"), total["n_soft"].alias("soft_hyphens"),
    )


def merge_adjacent_blocks(blocks: DataFrame) -> DataFrame:
    """The older rule on whole blocks of a page, in order: close below, equally wide and aligned, a lower-case start after an open end. Gives blocks with dense numbers."""
    by_page = Window.partitionBy(*PAGE).orderBy("ord")
    was = {c: F.lag(c).over(by_page) for c in ("x0", "x1", "y0", "y1", "text")}
    height = F.greatest(F.least(F.col("y1") - F.col("y0"), was["y1"] - was["y0"]), F.lit(1.0))
    gap, wide, p_wide = F.col("y0") - was["y1"], F.greatest(F.col("x1") - F.col("x0"), F.lit(1.0)), F.greatest(was["x1"] - was["x0"], F.lit(1.0))
    joins = (gap >= -0.25 * height) & (gap <= 0.5 * height) & (F.least(wide, p_wide) / F.greatest(wide, p_wide) >= 0.8) & (F.abs(F.col("x0") - was["x0"]) <= 8) & is_lower_start(F.col("text")) & _unfinished(was["text"])
    rows = blocks.withColumn("n", F.sum(F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1)).over(by_page))
    items = F.sort_array(F.collect_list(F.struct("ord", "text")))
    out = rows.groupBy(*PAGE, "n").agg(items.alias("items"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    text = F.aggregate(F.slice("items", 2, F.size("items")), strip(F.col("items")[0]["text"]), lambda acc, x: join_text(acc, x["text"]))
    return out.select(*PAGE, (F.col("n") - 1).cast("int").alias("ord"), F.format_string("p%04d-b%04d", F.col("page").cast("int"), F.col("n").cast("int")).alias("block_id"), text.alias("text"), "x0", "y0", "x1", "y1", F.size("items").alias("n_merged"))
