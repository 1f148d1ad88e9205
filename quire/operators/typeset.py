"""Setting text in boxes: widths from a table of glyph advances, greedy line breaking, sizes that fit, places of words, and what lies in a clip.

Advances are whole thousandths of the font size, so widths are exact sums. A line takes words as long as they fit with a space
between; a word wider than a line begins a new one and is broken between characters. A line feed always ends a line.
Everything is built-in expressions: a text is a fold over its words, and lines, words and clips are compared by cells of a page.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import compatible

PAGE = ["doc", "page"]
BOX = ["x0", "y0", "x1", "y1"]
EM = 1000
WIDE = 8  # times as wide as high are the cells in which words and clips meet, as lines are
#: Advances of a plain sans-serif face by groups of characters; all others have the default.
SANS = {"ijl'|": 222, " !,./:;I[]ft()-\\": 278, "rt\"`*": 333, "cksvxyzJ": 500, "ABEKPSVXY&": 667, "CDHNRUw": 722, "GOQ": 778, "mM": 833, "W": 944, "%": 889, "@": 1015}


@dataclass(frozen=True)
class FontMetrics:
    """Advances of characters in thousandths of the font size."""

    advances: Mapping[str, int] = field(default_factory=lambda: {c: a for group, a in SANS.items() for c in group})
    default: int = 556
    overrides: int = 1000  # of characters of full width: those of East Asian scripts

    def __post_init__(self) -> None:
        if self.default <= 0 or any(len(c) != 1 or a < 0 for c, a in self.advances.items()):
            raise ValueError("advances are those of single characters, from 0 up, and the default is above 0")

    def groups(self) -> dict[int, str]:
        """The characters of each advance."""
        out: dict[int, str] = {}
        for c, a in sorted(self.advances.items()):
            if a != self.default:
                out[a] = out.get(a, "") + c
        return out

    @property
    def space(self) -> int:
        return self.advances.get(" ", self.default)

    def width(self, text: Column) -> Column:
        """The width of a text in thousandths of the size: a count of characters for each advance."""
        count = lambda kept: (F.length(text) - F.length(kept)).cast("long")
        total = F.length(text).cast("long") * self.default + count(F.regexp_replace(text, FULL_WIDTH, "")) * (self.overrides - self.default)
        for advance, chars in self.groups().items():
            total = total + count(F.translate(text, chars, "")) * (advance - self.default)
        return total


#: Scripts whose characters are as wide as they are high.
FULL_WIDTH = r"[\x{1100}-\x{115F}\x{2E80}-\x{303E}\x{3041}-\x{33FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{A000}-\x{A4CF}\x{AC00}-\x{D7A3}\x{F900}-\x{FAFF}\x{FE30}-\x{FE4F}\x{FF00}-\x{FF60}\x{FFE0}-\x{FFE6}\x{20000}-\x{3FFFD}]"


def measured_words(text: Column, metrics: FontMetrics) -> Column:
    """For each line of a text its words, with their widths."""
    return F.transform(F.split(text, "\n", -1), lambda line: F.transform(F.filter(F.split(line, r"[ \t\r]+"), lambda w: w != ""), lambda w: F.struct(w.alias("text"), metrics.width(w).alias("width"))))


def _pieces(words: Column, limit: Column, metrics: FontMetrics) -> Column:
    """What is set one after the other: words, and the characters of words wider than a line. fresh: begins a line; space: before it on a line."""
    piece = lambda text, width, space, fresh: F.struct(text.alias("text"), width.cast("long").alias("width"), space.cast("long").alias("space"), fresh.alias("fresh"))
    whole = lambda w: F.array(piece(w["text"], w["width"], F.lit(metrics.space), F.lit(False)))
    chars = lambda w: F.transform(F.split(w["text"], ""), lambda c, k: piece(c, metrics.width(c), F.lit(0), k == 0))
    return F.flatten(F.transform(words, lambda w: F.when(w["width"] > limit, chars(w)).otherwise(whole(w))))


def _step(state: Column, piece: Column, limit: Column) -> tuple[Column, Column]:
    """Whether a piece stays on the line, and the line's width after it. state: at, the width so far, -1 on an empty line."""
    after = state["at"] + piece["space"] + piece["width"]
    stays = (state["at"] < 0) | (~piece["fresh"] & (after <= limit))
    return stays, F.when(stays & (state["at"] >= 0), after).otherwise(piece["width"])


def line_count(words: Column, limit: Column, metrics: FontMetrics) -> Column:
    """How many lines a text has at a width. words: of ``measured_words``; limit: the width of a line in thousandths of the size."""

    def lines(of_line: Column) -> Column:
        start = F.struct(F.lit(1).cast("long").alias("n"), F.lit(-1).cast("long").alias("at"))

        def merge(state: Column, piece: Column) -> Column:
            stays, at = _step(state, piece, limit)
            return F.struct((state["n"] + F.when(stays, 0).otherwise(1)).cast("long").alias("n"), at.cast("long").alias("at"))

        return F.aggregate(_pieces(of_line, limit, metrics), start, merge, lambda s: s["n"])

    return F.aggregate(F.transform(words, lines), F.lit(0).cast("long"), lambda a, n: a + n)


def broken_lines(text: Column, limit: Column, metrics: FontMetrics) -> Column:
    """The lines of a text at a width, each with its width in thousandths of the size."""
    kind = "array<struct<text:string,width:bigint>>"

    def lines(of_line: Column) -> Column:
        start = F.struct(F.array().cast(kind).alias("done"), F.lit("").alias("text"), F.lit(-1).cast("long").alias("at"))
        line = lambda s: F.array(F.struct(s["text"].alias("text"), F.greatest(s["at"], F.lit(0)).cast("long").alias("width")))

        def merge(state: Column, piece: Column) -> Column:
            stays, at = _step(state, piece, limit)
            gap = F.when((state["at"] >= 0) & (piece["space"] > 0), " ").otherwise("")
            said = F.when(stays, F.concat(state["text"], gap, piece["text"])).otherwise(piece["text"])
            return F.struct(F.when(stays, state["done"]).otherwise(F.concat(state["done"], line(state))).cast(kind).alias("done"), said.alias("text"), at.cast("long").alias("at"))

        return F.aggregate(_pieces(of_line, limit, metrics), start, merge, lambda s: F.concat(s["done"], line(s)))

    return F.flatten(F.transform(measured_words(text, metrics), lines))


def line_limit(width: Column, size: Column) -> Column:
    """The width of a box in thousandths of the size."""
    return F.floor(width * EM / size + 1e-6).cast("long")


def fits(words: Column, total: Column, size: Column, width: Column, height: Column, line_height: float, metrics: FontMetrics) -> Column:
    """Whether a text at a size stays in a box. total: the width of all its words; if it alone is too much, lines aren't counted."""
    room = F.floor(height / (size * line_height) + 1e-6).cast("long")
    limit = line_limit(width, size)
    return F.when((room < 1) | (total > limit * room), F.lit(False)).otherwise(line_count(words, limit, metrics) <= room)


def largest_fit(ladder: Column, words: Column, total: Column, width: Column, height: Column, line_height: float, metrics: FontMetrics) -> Column:
    """size (null: none) and attempts: the first size of a ladder, from the largest down, at which a text fits; smaller ones aren't tried."""
    start = F.struct(F.lit(None).cast("double").alias("size"), F.lit(0).alias("attempts"))

    def merge(state: Column, size: Column) -> Column:
        found = F.when(fits(words, total, size, width, height, line_height, metrics), size)
        return F.when(state["size"].isNotNull(), state).otherwise(F.struct(found.alias("size"), (state["attempts"] + 1).alias("attempts")))

    return F.aggregate(ladder, start, merge)


def words_width(words: Column) -> Column:
    return F.aggregate(F.flatten(words), F.lit(0).cast("long"), lambda a, w: a + w["width"])


def placed_words(blocks: DataFrame, text: str, size: str, line_height: float, metrics: FontMetrics) -> DataFrame:
    """doc, page, block_id, line, place, word and its box: a block's text set in its box from the top left corner. Lines below the box are set too."""
    base = blocks.select(*PAGE, "block_id", *BOX, F.col(size).cast("double").alias("__size"), F.col(text).alias("__text"))
    lines = broken_lines(F.col("__text"), line_limit(F.col("x1") - F.col("x0"), F.col("__size")), metrics)
    rows = base.select(*PAGE, "block_id", *BOX, "__size", F.posexplode(lines).alias("line", "l"))
    split = F.split("l.text", " ")
    offset = lambda k: F.when(k == 0, 0).otherwise(metrics.width(F.array_join(F.slice("parts", 1, k), " ")) + metrics.space)
    words = F.transform("parts", lambda w, k: F.struct(w.alias("word"), offset(k).cast("long").alias("offset"), metrics.width(w).alias("width")))
    rows = rows.withColumn("parts", split).where("l.text <> ''").select(*PAGE, "block_id", *BOX, F.col("__size").alias("size"), "line", F.posexplode(words).alias("place", "w"))
    x, y = F.col("x0") + F.col("w.offset") * F.col("size") / EM, F.col("y0") + F.col("line") * F.col("size") * line_height
    return rows.select(*PAGE, "block_id", "line", "place", F.col("w.word").alias("word"), x.alias("x0"), y.alias("y0"), (x + F.col("w.width") * F.col("size") / EM).alias("x1"), (y + F.col("size")).alias("y1"))


def validation_clips(blocks: DataFrame, size: str, *kept: str) -> DataFrame:
    """doc, page, block_id, what is ``kept``, and the box in which a block's text has to be found: its own with a margin by its size, on the page."""
    margin = F.greatest(F.lit(2.0), F.coalesce(F.col(size), F.lit(0.0)) * 0.8)
    return blocks.select(*PAGE, "block_id", *kept, F.greatest(F.lit(0.0), F.col("x0") - margin).alias("x0"), F.greatest(F.lit(0.0), F.col("y0") - margin).alias("y0"), F.least(F.col("page_w"), F.col("x1") + margin).alias("x1"), F.least(F.col("page_h"), F.col("y1") + margin).alias("y1"))


def _met(clips: DataFrame, words: DataFrame, cell: float, *kept: str) -> DataFrame:
    """doc, page, clip_id, found (null: no word) and owns: what is ``kept`` of each row of the clip.

    Both sides are dealt to the cells of their page that they touch. A word and a clip that meet in several cells are a pair only in the
    cell that holds the upper left corner of what they share, so no pair leaves a cell, and none is made twice. Clips and words are
    rows of one table, so if both come dealt by pages, nothing is shuffled: not the words, of which there are many, nor their pairs.
    """
    wide = {"x0": WIDE * cell, "x1": WIDE * cell}
    at = lambda c: F.floor(F.col(c) / wide.get(c, cell)).cast("long")
    known = F.lit(True)
    for c in BOX:
        known = known & F.col(c).isNotNull()
    cells = lambda a, b: F.when(known, F.sequence(at(a), F.greatest(at(a), at(b))))
    # a clip has a row in its first cell, or in none, that stands for it if it has no words
    home = ~known | ((F.col("cx") == at("x0")) & (F.col("cy") == at("y0")))
    c = clips.select("*", F.explode_outer(cells("x0", "x1")).alias("cx")).select("*", F.explode_outer(cells("y0", "y1")).alias("cy"))
    c = c.select(*PAGE, "cx", "cy", F.struct(*BOX, "clip_id", F.when(home, F.struct(F.lit(True).alias("home"), *kept)).alias("own")).alias("c"))
    w = words.select(*PAGE, *BOX, "word").where("doc IS NOT NULL AND page IS NOT NULL")
    w = w.select("*", F.explode(cells("x0", "x1")).alias("cx")).select("*", F.explode(cells("y0", "y1")).alias("cy")).select(*PAGE, "cx", "cy", F.struct(*BOX, "word").alias("w"))
    met = c.unionByName(w, allowMissingColumns=True).groupBy(*PAGE, "cx", "cy").agg(F.collect_list("c").alias("cs"), F.collect_list("w").alias("ws"))
    met = met.select(*PAGE, "cx", "cy", "cs", F.concat("ws", F.array(F.lit(None))).alias("ws")).select(*PAGE, "cx", "cy", F.explode("cs").alias("c"), "ws").select(*PAGE, "cx", "cy", "c", F.explode("ws").alias("w"))
    left, top = F.greatest("c.x0", "w.x0"), F.greatest("c.y0", "w.y0")
    meets = (F.col("w.x0") < F.col("c.x1")) & (F.col("c.x0") < F.col("w.x1")) & (F.col("w.y0") < F.col("c.y1")) & (F.col("c.y0") < F.col("w.y1"))
    first, stands = (F.floor(left / wide["x0"]) == F.col("cx")) & (F.floor(top / cell) == F.col("cy")), F.col("w").isNull()
    met = met.where((stands & F.col("c.own").isNotNull()) | (meets & first))
    met = met.select(*PAGE, "c.clip_id", F.when(stands, F.col("c.own")).alias("own"), F.when(~stands, F.struct("w.y0", "w.x0", "w.word")).alias("item"))
    met = met.groupBy(*PAGE, "clip_id").agg(F.collect_list("item").alias("items"), F.collect_list("own").alias("owns"))
    found = F.array_join(F.transform(F.sort_array("items"), lambda x: x["word"]), " ")
    return met.select(*PAGE, "clip_id", F.when(F.size("items") > 0, found).alias("found"), "owns")


def clip_texts(clips: DataFrame, words: DataFrame, cell: float = 72.0) -> DataFrame:
    """clip_id, found: the words that overlap each clip, lines from the top down and words from the left. clips: doc, page, clip_id, box; words: doc, page, word, box.

    Of clips without words there is no row. Words of one height are a line; of equal words at one place each one counts.
    """
    return _met(clips, words, cell).where("found IS NOT NULL").select(*PAGE, "clip_id", "found")


def normalized_clip(c: Column) -> Column:
    """Compatible forms, dashes and brackets as plain ones, white space collapsed."""
    return F.trim(F.regexp_replace(F.translate(compatible(c), "‐‑‒–—−（）", "------()"), r"(?U)\s+", " "))


def verified_clips(blocks: DataFrame, words: DataFrame, text: str, size: str, cell: float = 72.0) -> DataFrame:
    """doc, page, block_id, found and verified: whether the words in a block's place hold its text. blocks: doc, page, block_id, the text, the size, box and page.

    Words may have the page's size: clips end with the page, so words beyond it can be in none.
    """
    if {"page_w", "page_h"} <= set(words.columns):
        words = words.where("x0 < page_w AND y0 < page_h")
    clips = validation_clips(blocks.withColumn("__expected", F.col(text)), size, "__expected")
    met = _met(clips.withColumnRenamed("block_id", "clip_id"), words, cell, "__expected")
    rows = met.select(*PAGE, F.col("clip_id").alias("block_id"), F.when(F.col("clip_id").isNotNull(), F.col("found")).alias("found"), F.explode("owns.__expected").alias("__expected"))
    holds = F.contains(normalized_clip(F.coalesce("found", F.lit(""))), normalized_clip(F.coalesce("__expected", F.lit(""))))
    return rows.select(*PAGE, "block_id", "found", holds.alias("verified"))


def failure_message(row: DataFrame, limit: int = 240) -> DataFrame:
    """The rows that aren't verified, with a message that shortens what was expected and found. row: block_id, page, expected, found, verified."""
    short = lambda c: F.when(F.length(c) > limit, F.concat(F.left(c, F.lit(limit)), F.lit("..."))).otherwise(c)
    said = F.concat(F.lit("text of block "), "block_id", F.lit(" on page "), F.col("page").cast("string"), F.lit(" is missing; expected: "), short(F.coalesce("expected", F.lit(""))), F.lit("; found: "), short(F.coalesce("found", F.lit(""))))
    return row.where("NOT verified").withColumn("message", said)
