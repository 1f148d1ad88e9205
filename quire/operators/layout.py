"""Layout planning: font sizes, expansion downwards, redaction boxes, overflow."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.operators.typeset import FontMetrics, largest_fit, measured_words, normalized_clip, words_width
from quire.plans.options import LayoutOptions

PAGE = ["doc", "page"]
ROWS = 256  # blocks that are looked at at once


def first_font(sizes: Column, default: float) -> Column:
    """The largest finite size of a block in (0, 144]."""
    usable = F.filter(sizes, lambda s: s.isNotNull() & ~F.isnan(s) & (s > 0) & (s <= 144))
    return F.coalesce(F.array_max(usable), F.lit(default))


def font_ladder(start: Column, o: LayoutOptions) -> Column:
    """Sizes from the first down by exact decimal steps; the least is always among them."""
    exact = lambda c: c.cast("decimal(10,4)")
    low, step = exact(F.lit(o.least_font)), exact(F.lit(o.font_step))
    top = F.greatest(exact(start), low)
    steps = F.ceil((top - low) / step).cast("int")
    above = F.when(steps > 0, F.transform(F.sequence(F.lit(0), steps - 1), lambda k: (top - k.cast("decimal(10,0)") * step).cast("double"))).otherwise(F.array().cast("array<double>"))
    return F.concat(above, F.array(F.lit(float(o.least_font))))


def _by_page(blocks: DataFrame, found: Callable[..., np.ndarray], kind: str, name: str) -> DataFrame:
    """The blocks with what a function finds from all boxes of their page: no pairs of blocks leave the task."""

    @F.arrow_udf(f"array<{kind}>")
    def run(pages: pa.Array) -> pa.Array:
        flat, ends = pages.flatten(), np.concatenate([[0], np.cumsum(np.asarray(pc.list_value_length(pages), dtype=np.int64))])
        box = [np.asarray(pc.struct_field(flat, c), dtype=np.float64) for c in ("x0", "y0", "x1", "y1")]
        ids = np.asarray(pc.struct_field(flat, "block_id").dictionary_encode().indices)
        values = [found(*(c[a:b] for c in (*box, ids))) for a, b in zip(ends, ends[1:], strict=False)]
        one = pa.concat_arrays([pa.array(v, from_pandas=True) for v in values]) if values else pa.array([], pa.float64())
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), one)

    whole = [c for c in blocks.columns if c not in (*PAGE, name)]
    pages = blocks.groupBy(*PAGE).agg(F.collect_list(F.struct(*whole)).alias("blocks"))
    rows = pages.withColumn("found", run("blocks")).select(*PAGE, F.explode(F.arrays_zip("blocks", "found")).alias("z"))
    return rows.select(*PAGE, "z.blocks.*", F.col("z.found").alias(name)).select(*[c for c in blocks.columns if c != name], name)


def _next_below(x0: np.ndarray, y0: np.ndarray, x1: np.ndarray, y1: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The top of the next block below each that overlaps it sideways; NaN without one."""
    order, out = np.argsort(y0, kind="stable"), np.full(len(x0), np.nan)
    left, right, top, name = x0[order], x1[order], y0[order], ids[order]
    first = np.searchsorted(top, y1, side="left")
    for i in range(len(x0)):
        for a in range(first[i], len(order), ROWS):  # the first that fits is the nearest
            part = slice(a, a + ROWS)
            hit = np.flatnonzero((left[part] < x1[i]) & (right[part] > x0[i]) & (name[part] != ids[i]))
            if len(hit):
                out[i] = top[a + hit[0]]
                break
    return out


def lower_limits(blocks: DataFrame, o: LayoutOptions) -> DataFrame:
    """limit: how far down each block may grow, which is to a gap above the next block below it that overlaps it sideways, or the page's end."""
    rows, gap = _by_page(blocks, _next_below, "double", "next_y0"), max(o.padding, 1.0)
    return rows.withColumn("limit", F.greatest(F.col("y1"), F.coalesce(F.least(F.col("page_h"), F.col("next_y0") - gap), F.col("page_h")))).drop("next_y0")


def redaction_boxes(blocks: DataFrame, o: LayoutOptions) -> DataFrame:
    """padded: whether a block's box may be padded, as no other is hit that wasn't before; redaction: the box, clipped to the page."""
    p = o.padding

    def free(x0: np.ndarray, y0: np.ndarray, x1: np.ndarray, y1: np.ndarray, ids: np.ndarray) -> np.ndarray:
        order, out = np.argsort(y0, kind="stable"), np.ones(len(x0), dtype=bool)
        left, right, top, bottom, name = x0[order], x1[order], y0[order], y1[order], ids[order]
        tallest = float((bottom - top).max()) if len(top) else 0.0
        # only blocks that begin between these can reach the padded box
        first, last = np.searchsorted(top, y0 - p - tallest, side="left"), np.searchsorted(top, y1 + p, side="left")
        for i in range(len(x0)):
            part = slice(first[i], last[i])
            hits = lambda d, i=i, part=part: (x0[i] - d < right[part]) & (left[part] < x1[i] + d) & (y0[i] - d < bottom[part]) & (top[part] < y1[i] + d)
            out[i] = not (hits(p) & ~hits(0.0) & (name[part] != ids[i])).any()
        return out

    rows = _by_page(blocks, free, "boolean", "padded")
    pad = F.when(F.col("padded"), F.lit(float(p))).otherwise(F.lit(0.0))
    box = F.struct(F.greatest(F.col("x0") - pad, F.lit(0.0)).alias("x0"), F.greatest(F.col("y0") - pad, F.lit(0.0)).alias("y0"), F.least(F.col("x1") + pad, F.col("page_w")).alias("x1"), F.least(F.col("y1") + pad, F.col("page_h")).alias("y1"))
    return rows.withColumn("redaction", box)


def plan_layout(blocks: DataFrame, o: LayoutOptions = LayoutOptions(), metrics: FontMetrics = FontMetrics()) -> DataFrame:
    """font_first, font_size (null: overflow), attempts, expanded, overflow and warning of each block. blocks: translated, sizes (of its spans), and the box.

    A text is set word by word in its box by the font's advances, at smaller and smaller sizes, then in the box grown downwards.
    """
    rows = lower_limits(blocks, o) if o.expand else blocks.withColumn("limit", F.col("y1"))
    rows = rows.withColumn("font_first", first_font(F.col("sizes"), o.default_font)).withColumn("ladder", font_ladder(F.col("font_first"), o))
    width, own, grown = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), F.col("limit") - F.col("y0")
    # words are measured once: widths are in thousandths of the size, whatever the size
    rows = rows.withColumn("words", measured_words(F.coalesce("translated", F.lit("")), metrics)).withColumn("total", words_width(F.col("words")))
    tried = lambda h: largest_fit(F.col("ladder"), F.col("words"), F.col("total"), width, h, o.line_height, metrics)
    rows = rows.withColumn("here", tried(own))
    grows = F.col("here.size").isNull() & (F.col("limit") > F.col("y1") + 1e-6)
    rows = rows.withColumn("grown", F.when(grows, tried(grown)))
    size = F.coalesce("here.size", "grown.size")
    attempts = (F.col("here.attempts") + F.coalesce("grown.attempts", F.lit(0))).cast("long")
    expanded = F.col("grown.size").isNotNull()
    return rows.select(*PAGE, "block_id", "font_first", size.alias("font_size"), attempts.alias("attempts"), expanded.alias("expanded"), size.isNull().alias("overflow"), F.when(size.isNull(), F.concat(F.lit("block "), "block_id", F.lit(" overflows at the least font"))).when(expanded, F.concat(F.lit("block "), "block_id", F.lit(" expanded downward"))).alias("warning"))


def layout_counters(plan: DataFrame, *by: str) -> DataFrame:
    return plan.groupBy(*by).agg(F.count("*").alias("n_blocks"), F.count_if(F.col("font_size") < F.col("font_first")).alias("n_reduced"), F.count_if("expanded").alias("n_expanded"), F.count_if("overflow").alias("n_overflow"))


def clip_matches(clips: DataFrame) -> DataFrame:
    """Whether what a page has in a block's place contains the expected text. clips: expected, found."""
    return clips.withColumn("verified", F.contains(normalized_clip(F.col("found")), normalized_clip(F.col("expected"))))
