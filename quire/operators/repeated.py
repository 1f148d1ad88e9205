"""Repeated page elements: page numbers, headers, footers, boilerplate, watermarks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.text import collapse, group_id
from quire.plans.options import RepeatedOptions
from quire.plans.scratch import settle

# What a result must agree on.
PAGE_NUMBER = r"(?i)^\s*(?:page\s+)?(\d+)(?:\s*(?:of|/)\s*\d+)?\s*$"
LEGAL = ("all rights reserved", "copyright", "©", "confidential", "proprietary", "unauthorized", "terms and conditions")
WATERMARK = ("draft", "confidential", "sample", "copy", "do not distribute")

KEY = ["doc", "norm"]


def candidates(blocks: DataFrame, o: RepeatedOptions) -> DataFrame:
    region = F.when(F.col("y1") <= F.col("page_h") * o.margin, "top").when(F.col("y0") >= F.col("page_h") * (1 - o.margin), "bottom").otherwise("middle")
    rows = blocks.withColumns({"norm": collapse(F.col("text")), "region": region})
    value = F.regexp_extract("text", PAGE_NUMBER, 1)
    return rows.withColumn("sequential", (F.col("region") != "middle") & (value != "") & F.coalesce(F.expr("try_cast(regexp_extract(text, r'" + PAGE_NUMBER + "', 1) AS BIGINT)") == F.col("page"), F.lit(False)))


def classify_repeated(blocks: DataFrame, options: RepeatedOptions = RepeatedOptions(), pages: DataFrame | None = None) -> DataFrame:
    """The blocks with kind, policy, confidence, ambiguous and group_id. pages: doc, page, where pages without blocks count."""
    o = options
    rows = candidates(blocks, o)
    if o.mode == "off":
        return rows.withColumns({"kind": F.lit("body"), "policy": F.lit("translate"), "confidence": F.lit(1.0), "ambiguous": F.lit(False), "group_id": F.lit(None).cast("string")})
    return _label(rows, settle(repeated_groups(rows, o, pages)))  # a row per repeated text


def _label(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Blocks of a confirmed page sequence look up the sequence of their document, the others their text."""
    sequences = groups.where("sequence").select("doc", F.lit(True).alias("numbered"), F.col("group_id").alias("sequence_id"))
    marked = rows.join(sequences, "doc", "left").withColumn("is_number", F.col("sequential") & F.coalesce("numbered", F.lit(False)))
    texts = groups.where("NOT sequence").select(*KEY, *[F.col(c).alias(f"g_{c}") for c in ("kind", "policy", "confidence", "ambiguous", "group_id")])
    joined = marked.join(texts, KEY, "left")
    number = F.col("is_number")
    pick = lambda own, c, rest: F.when(number, own).otherwise(F.coalesce(F.col(f"g_{c}"), rest))
    return joined.select(
        *rows.columns,
        pick(F.lit("page_number"), "kind", F.lit("body")).alias("kind"),
        pick(F.lit("preserve"), "policy", F.lit("translate")).alias("policy"),
        pick(F.lit(0.99), "confidence", F.lit(1.0)).alias("confidence"),
        pick(F.lit(False), "ambiguous", F.lit(False)).alias("ambiguous"),
        pick(F.col("sequence_id"), "group_id", F.lit(None).cast("string")).alias("group_id"),
    )


def repeated_groups(rows: DataFrame, o: RepeatedOptions, pages: DataFrame | None = None) -> DataFrame:
    """One row per group: of a text, or (sequence) of a document's page numbers. rows: from candidates()."""
    odd = F.col("page") % 2 == 1
    docs = settle(_documents(rows, pages))  # a row per document
    rest = rows.join(docs.select("doc", "numbered"), "doc").where(~(F.col("sequential") & F.col("numbered")))
    edge = lambda c, size: F.col(c) / F.col(size)
    spread = {"x0": "page_w", "y0": "page_h", "x1": "page_w", "y1": "page_h"}
    sized = F.when(F.col("font") > 0, F.col("font"))
    place = F.when(F.col("region") == "top", 0).when(F.col("region") == "middle", 1).otherwise(2)
    # by page first: a text has a row per page, pages are counted and not collected, and sums are numbers that hash aggregates can hold
    per_page = rest.groupBy(*KEY, "page").agg(
        F.min(place).alias("place"), F.max(place).alias("place_max"),
        *[f(edge(c, size)).alias(f"{c}_{k}") for c, size in spread.items() for k, f in (("min", F.min), ("max", F.max))],
        F.min(sized).alias("font_min"), F.max(sized).alias("font_max"), F.min("font").alias("font_least"), F.count("*").alias("n"),
    )
    per_text = per_page.groupBy(*KEY).agg(
        F.count("*").alias("observed"), F.count_if(odd).alias("seen_odd"), F.count_if(~odd).alias("seen_even"), F.min("page").alias("from_page"), F.max("page").alias("to_page"),
        F.min("place").alias("place"), F.max("place_max").alias("place_max"),
        *[(F.max(f"{c}_max") - F.min(f"{c}_min")).alias(f"spread_{c}") for c in spread],
        F.min("y0_min").alias("y_least"), F.max("y0_max").alias("y_most"), F.sum("n").cast("long").alias("n_blocks"),
        F.min("font_min").alias("font_min"), F.max("font_max").alias("font_max"), F.min("font_least").alias("font_least"),
    ).where((F.col("norm") != "") & (F.col("observed") >= 2))
    per_text = settle(per_text)
    # a median matters only where fonts differ by more than half a point
    varied = per_text.where("font_max - font_min > 0.5").select(*KEY)
    if varied.take(1):
        middle = rest.join(varied, KEY, "left_semi").groupBy(*KEY).agg(F.expr("percentile(CASE WHEN font > 0 THEN font END, 0.5)").alias("font_mid"))
        per_text = per_text.join(middle, KEY, "left")
    else:
        per_text = per_text.withColumn("font_mid", F.lit(None).cast("double"))
    region = lambda c: F.when(F.col(c) == 0, "top").when(F.col(c) == 1, "middle").otherwise("bottom")
    g = per_text.withColumns({"region": region("place"), "region_max": region("place_max"), "font_mid": F.coalesce("font_mid", "font_min")}).join(docs, "doc")
    g = g.withColumns({"on_first": F.col("from_page") == F.col("first_page"), "on_last": F.col("to_page") == F.col("last_page")})
    head = F.when(F.col("on_first"), 0).otherwise(1)
    tail = F.when((F.col("n_pages") - head > 0) & ~F.col("on_last"), 1).otherwise(0)
    g = g.withColumn("raw", F.col("observed") / F.greatest(F.col("n_pages") - head - tail, F.lit(1)))
    g = g.withColumns({k: F.col(f"seen_{k}") / F.greatest(F.col(f"n_{k}"), F.lit(1)) for k in ("odd", "even")})
    parity = F.when((F.col("odd") > F.col("raw")) & (F.col("odd") >= F.col("even")), "odd").when(F.col("even") > F.col("raw"), "even").otherwise("all")
    g = g.withColumns({"parity": parity, "ratio": F.least(F.col("raw"), F.lit(1.0))})
    one_region = F.col("region") == F.col("region_max")
    geometry = one_region
    for c in spread:
        geometry = geometry & (F.col(f"spread_{c}") <= o.geometry_tolerance)
    fonts = F.col("font_mid").isNull() | (F.col("font_max") - F.col("font_min") <= F.greatest(F.lit(0.5), F.col("font_mid") * o.font_tolerance))
    by_parity = F.when(F.col("parity") == "odd", F.col("odd")).when(F.col("parity") == "even", F.col("even"))
    recurring = (F.col("ratio") >= o.recurrence) | F.coalesce(by_parity >= o.parity_recurrence, F.lit(False))
    sure = geometry & recurring & (F.col("total_pages") >= o.least_pages)
    legal = F.exists(F.array(*[F.lit(x) for x in LEGAL]), lambda cue: F.contains(F.col("norm"), cue))
    large = (F.coalesce("doc_font", F.lit(0.0)) > 0) & (F.col("font_least") >= F.col("doc_font") * o.watermark_font)
    conspicuous = (F.col("y_least") >= 0.25) & (F.col("y_most") <= 0.75) & (large | F.col("norm").isin(*WATERMARK))
    margin = one_region & F.col("region").isin("top", "bottom")
    kind = F.when(sure & legal, "repeated_boilerplate").when(sure & conspicuous, "watermark_candidate").when(sure & fonts & margin, F.when(F.col("region") == "top", "running_header").otherwise("running_footer")).when(geometry & fonts, "unknown_repeated")
    g = g.withColumn("kind", kind).where("kind IS NOT NULL")
    by_kind = lambda values, rest_of: F.coalesce(*[F.when(F.col("kind") == k, v) for k, v in values.items()], rest_of)
    g = g.select(
        "doc", "norm", F.lit(False).alias("sequence"), "kind",
        by_kind({"watermark_candidate": F.lit("skip"), "unknown_repeated": F.lit("preserve")}, F.lit("translate")).alias("policy"),
        by_kind({"repeated_boilerplate": F.lit(0.94), "watermark_candidate": F.lit(0.82), "unknown_repeated": F.lit(0.55)}, F.least(F.lit(0.98), 0.76 + F.col("ratio") * 0.22)).alias("confidence"),
        F.col("kind").isin("watermark_candidate", "unknown_repeated").alias("ambiguous"),
        group_id(F.col("kind"), F.col("norm"), F.col("parity")).alias("group_id"), "parity", "ratio", F.col("observed").alias("n_pages"), "n_blocks", F.col("n_blocks").alias("n_marked"),
    )
    sequence = docs.where("numbered").select(
        "doc", F.lit("page-sequence").alias("norm"), F.lit(True).alias("sequence"), F.lit("page_number").alias("kind"), F.lit("preserve").alias("policy"), F.lit(0.99).alias("confidence"), F.lit(False).alias("ambiguous"),
        group_id(F.lit("page_number"), F.lit("page-sequence"), F.lit("sequence")).alias("group_id"), F.lit("sequence").alias("parity"), (F.col("number_pages") / F.greatest(F.col("total_pages"), F.lit(1))).alias("ratio"), F.col("number_pages").alias("n_pages"), F.col("number_pages").alias("n_blocks"), F.col("number_blocks").alias("n_marked"),
    )
    return g.unionByName(sequence)


def _documents(rows: DataFrame, pages: DataFrame | None) -> DataFrame:
    """A row per document: its pages, median font, and whether they are numbered."""
    odd = F.col("page") % 2 == 1
    # both sums below read this one exchange
    fonts = rows.groupBy("doc", "page", "font").agg(F.count("*").alias("n"), F.max("sequential").alias("sequential"), F.count_if("sequential").alias("numbers"))
    on_page = fonts.where("n > 0").groupBy("doc", "page").agg(F.max("sequential").alias("sequential"), F.sum("numbers").alias("numbers"))
    span = [F.min("page").alias("first_page"), F.max("page").alias("last_page"), F.count("*").alias("n_pages"), F.count_if(odd).alias("n_odd"), F.count_if(~odd).alias("n_even")]
    seen = [F.count("*").alias("total_pages"), F.count_if("sequential").alias("number_pages"), F.sum("numbers").alias("number_blocks")]
    docs = on_page.groupBy("doc").agg(*seen, *span) if pages is None else on_page.groupBy("doc").agg(*seen).join(pages.select("doc", "page").distinct().groupBy("doc").agg(*span), "doc")
    sizes = fonts.where("sequential IS NOT NULL").groupBy("doc", "font").agg(F.sum("n").alias("n"))
    middle = sizes.groupBy("doc").agg(F.expr("percentile(CASE WHEN font > 0 THEN font END, 0.5, n)").alias("doc_font"))
    return docs.join(middle, "doc").withColumn("numbered", F.col("number_pages") >= 2)


def group_pages(labelled: DataFrame) -> DataFrame:
    """The pages of each group, a row per page."""
    return labelled.where("group_id IS NOT NULL").select("doc", "group_id", "page").distinct()


def kind_counts(labelled: DataFrame, *by: str) -> DataFrame:
    return labelled.groupBy(*by, "kind").agg(F.count("*").alias("n_blocks"), F.count_if("ambiguous").alias("n_ambiguous"), F.count_distinct("doc", "group_id").alias("n_groups"))


def kind_totals(blocks: DataFrame, options: RepeatedOptions = RepeatedOptions()) -> DataFrame:
    """The same as ``kind_counts`` of all blocks, from the groups alone: no block looks up its group."""
    if options.mode == "off":
        return kind_counts(classify_repeated(blocks, options))
    rows = candidates(blocks, options)
    groups = settle(repeated_groups(rows, options))  # with the blocks that each marks
    marked = groups.groupBy("kind").agg(F.sum("n_marked").alias("n_blocks"), F.sum(F.when(F.col("ambiguous"), F.col("n_marked")).otherwise(0)).alias("n_ambiguous"), F.count("*").alias("n_groups"))
    none = F.lit(0).cast("long")
    body = blocks.agg(F.count("*").alias("n")).unionByName(groups.agg(F.coalesce(-F.sum("n_marked"), none).alias("n"))).agg(F.sum("n").alias("n_blocks"))
    return marked.unionByName(body.where("n_blocks > 0").select(F.lit("body").alias("kind"), "n_blocks", none.alias("n_ambiguous"), none.alias("n_groups")))
