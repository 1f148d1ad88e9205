"""Literal cases: what small operators give for them, and the rows that were worked out by hand."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import benchmark, checks, layout, pages, paragraphs, performance, quality, reports, translate
from quire.operators.glossary import Glossary, Term, compliance, conflicts, glossary_matches, matches, prepare
from quire.plans.options import LayoutOptions, PageOptions, ParagraphOptions, RepeatedOptions, TranslationOptions, identity
from quire.sources import datasets, files

#: name: (columns, rows, what gives them).
CASES: dict[str, tuple[list[list[str]], list[tuple], Callable[[SparkSession], DataFrame]]] = {}


def cases(columns: str, *rows: tuple) -> Callable:
    """Registers a case with its rows: columns as "name type, ..."."""
    named = [c.strip().split(" ") for c in columns.split(",")]

    def add(f: Callable[[SparkSession], DataFrame]) -> Callable[[SparkSession], DataFrame]:
        CASES[f.__name__] = named, [r if isinstance(r, tuple) else (r,) for r in rows], f
        return f

    return add


def _texts(spark: SparkSession, *values: str | None) -> DataFrame:
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "n int, t string")


def _list(c: str | Column) -> Column:
    return F.array_join(c, "|")


# Text functions


@cases("n int, t string", (0, "office"), (1, "fl st"), (2, "é"), (3, None))
def ligatures_and_composition(spark):
    return _texts(spark, "oﬃce", "ﬂ ﬅ", "é", None).select("n", T.source_text(F.col("t")).alias("t"))


@cases("n int, t string", (0, "strasse"), (1, "οδοσ οδοσ"), (2, "sos s"), (3, "iı"), (4, "a b c"), (5, ""))
def case_folding(spark):
    return _texts(spark, "Straße", "ΟΔΟΣ οδος", "ſOS ſ", "Iı", " A\u00a0\tB\n\u2003c ", " ").select("n", T.collapse(F.col("t")).alias("t"))


@cases("n int, marker boolean, skipped boolean", (0, True, True), (1, False, False), (2, False, True), (3, False, True), (4, False, True), (5, False, False), (6, False, True), (7, False, True), (8, False, False), (9, False, True))
def private_use_and_skipped(spark):
    rows = _texts(spark, "\ue000", "\ue000a", " 42 ", "5 kg, 3 mm", "AB-12/3", "ABC", "def f(x)", "[]", "def inition", "SELECT a FROM b")
    return rows.select("n", T.private_marker(F.col("t")).alias("marker"), T.skips_translation(F.col("t")).alias("skipped"))


@cases("n int, t string, soft boolean", (0, "paragraph text", True), (1, "A well- known", False), (2, "e-mail- server", False), (3, "one two", False), (4, "ab- cd", False), (5, "para- Graph", False), (6, "word goes", False))
def joined_lines(spark):
    rows = spark.createDataFrame([(0, "para-", "graph text"), (1, "A well-", "known"), (2, "e-mail-", "server"), (3, "one", "two"), (4, "ab-", "cd"), (5, "para-", "Graph"), (6, "word\u00a0\t", "\u2003goes")], "n int, a string, b string")
    return rows.select("n", T.join_text(F.col("a"), F.col("b")).alias("t"), T.is_soft_hyphen(F.col("a"), F.col("b")).alias("soft"))


@cases("n int, found string", (0, "FFFD"), (1, "2FFFE"), (2, "FDD0,10FFFF"), (3, ""), (4, "7,85"))
def suspicious_characters(spark):
    rows = _texts(spark, "a\ufffdb", "\U0002fffe", "\ufdd0 \U0010ffff", "plain\n\r\t text", "\x07\x85")
    return rows.select("n", F.array_join(F.transform(T.suspicious(F.col("t")), lambda c: F.hex(F.ascii(c))), ",").alias("found"))


@cases("n int, numbers string, units string, urls string, paths string, options string", (0, "12", "", "", "", ""), (1, "5", "5 kg", "", "", ""), (2, "", "", "https://a.b/c", "", ""), (3, "", "", "", "C:\\x\\y.txt", "--dry-run"), (4, "1.5-2", "", "", "", ""))
def values_lost(spark):
    rows = spark.createDataFrame([(0, "12 and 12", "12"), (1, "weigh 5 kg", "weigh"), (2, "see https://a.b/c now", "see"), (3, "C:\\x\\y.txt --dry-run", ""), (4, "1.5-2 of x3", "of x3")], "n int, a string, b string")
    lost = T.missing_values(F.col("a"), F.col("b"), tuple(p for _, p in quality.VALUES))
    return rows.select("n", *[F.array_join(F.get(lost, F.lit(k)), ",").alias(c) for k, c in enumerate(("numbers", "units", "urls", "paths", "options"))])


@cases("n int, t string, tokens string, back boolean", (0, "see __KEEP_0000__ now", "https://a.b/c?d=1", True), (1, "__KEEP_0000__ or __KEEP_0001__ or __KEEP_0002__", "C:\\d\\f.txt|../up/file|/usr/bin/x", True), (2, "__KEEP_0000__, __KEEP_0001__", "12 mm|AB-1234", True), (3, "plain and/or prose", "", True), (4, "__KEEP_0000__ ___KEEP_0000___", "5678", True), (5, "mail __KEEP_0000__.", "x.y@z.org", True))
def placeholders(spark):
    rows = _texts(spark, "see https://a.b/c?d=1 now", "C:\\d\\f.txt or ../up/file or /usr/bin/x", "12 mm, AB-1234", "plain and/or prose", "__KEEP_0000__ 5678", "mail x.y@z.org.")
    rows = rows.withColumn("p", T.protect(F.col("t"))).withColumn("back", T.restore(F.col("p.text"), F.col("p.tokens")) == F.col("t"))
    return rows.select("n", F.col("p.text").alias("t"), F.array_join(F.transform("p.tokens", lambda x: x["token"]), "|").alias("tokens"), "back")


@cases("n int, t string", (0, "a X b"), (1, None), (2, "X Y"))
def restored_marks(spark):
    rows = spark.createDataFrame([(0, "a __KEEP_0000__ b", [("__KEEP_0000__", "X")]), (1, "lost", [("__KEEP_0000__", "X")]), (2, "__KEEP_0000__ __KEEP_0001__", [("__KEEP_0000__", "X"), ("__KEEP_0001__", "Y")])], "n int, t string, k array<struct<mark:string,token:string>>")
    return rows.select("n", T.restore(F.col("t"), F.col("k")).alias("t"))


@cases("n int, segments string, separators string, forced boolean", (0, "One two. Three four five six.|Seven.", " |", False), (1, "a b c d e f|g h", " |", True), (2, "abcdefgh|ij", " |", True), (3, "First part.|Second part.", "\n\n|", False), (4, "short", "", False))
def packed_segments(spark):
    by_words = _texts(spark, "One two. Three four five six. Seven.", "a b c d e f g h").select("n", T.segment(F.col("t"), 8).alias("s"))
    by_chars = _texts(spark, "", "", "abcdefghij").where("n = 2").select("n", T.segment(F.col("t"), 8, len).alias("s"))
    others = _texts(spark, "", "", "", "First part.\n \nSecond part.", "short").where("n > 2").select("n", F.when(F.col("n") == 3, T.segment(F.col("t"), 12, len)).otherwise(T.segment(F.col("t"), 8)).alias("s"))
    rows = by_words.unionByName(by_chars).unionByName(others)
    return rows.select("n", F.array_join(F.transform("s.segments", lambda x: x["text"]), "|").alias("segments"), F.array_join(F.transform("s.segments", lambda x: x["separator"]), "|").alias("separators"), F.col("s.forced").alias("forced"))


@cases("n int, t string", (0, "RU a. RU b"), (1, "RU a.\n\nRU b"), (2, None))
def recombined_segments(spark):
    schema = "n int, s array<struct<text:string,separator:string>>, t array<string>"
    rows = spark.createDataFrame([(0, [("a.", " "), ("b", "")], ["RU a.", "RU b"]), (1, [("a.", "\n\n"), ("b", "")], ["RU a.", "RU b"]), (2, [("a.", " "), ("b", "")], ["RU a."])], schema)
    return rows.select("n", T.recombine(F.col("s"), F.col("t")).alias("t"))


@cases("n int, spans string", (0, "0-2,3-5"), (1, ""), (2, "1-3"))
def match_spans(spark):
    rows = _texts(spark, "ab ab", "none", "🙂ab")
    return rows.select("n", F.array_join(F.transform(T.match_spans(F.col("t"), "ab"), lambda m: F.concat(m["start"].cast("string"), F.lit("-"), m["end"].cast("string"))), ",").alias("spans"))


@cases("n int, shown string, r double, g double, b double", (0, "512.00 B", 0.0, 0.0, 0.0), (1, "1.00 KiB", 1.0, 0.0, 0.0), (2, "1.50 MiB", 0.0, 1.0, 0.0), (3, "2.00 GiB", 0.0, 0.0, 1.0), (4, "n/a", 1.0, 1.0, 1.0))
def units_and_colours(spark):
    rows = spark.createDataFrame([(0, 512, 0), (1, 1024, 0xFF0000), (2, 1572864, 0x00FF00), (3, 2147483648, 0x0000FF), (4, None, 0xFFFFFF)], "n int, size long, colour int")
    return rows.select("n", T.human_bytes(F.col("size")).alias("shown"), T.unpack_rgb(F.col("colour")).alias("c")).select("n", "shown", "c.r", "c.g", "c.b")


@cases("n int, language string", (0, None), (1, "en"), (2, "ru"), (3, "mixed"))
def probable_languages(spark):
    rows = spark.createDataFrame([(0, 10, 9), (1, 14, 6), (2, 6, 14), (3, 13, 7)], "n int, a long, b long")
    return rows.select("n", T.probable_language(F.col("a"), F.col("b")).alias("language"))


# Sources


@cases("doc string, page int, block_id string, t string, x0 double, y1 double, n_lines long", ("d", 1, "p0001-b0001", "one|two", 1.0, 22.0, 2), ("d", 1, "p0001-b0002", "three", 3.0, 40.0, 1), ("d", 2, "p0002-b0001", "four", 1.0, 10.0, 1))
def numbered_blocks(spark):
    lines = [("d", 1, 3, 0, " one ", 2.0, 0.0, 9.0, 10.0), ("d", 1, 3, 1, "two", 1.0, 12.0, 9.0, 22.0), ("d", 1, 5, 0, "  ", 0.0, 0.0, 1.0, 1.0), ("d", 1, 7, 2, "three", 3.0, 30.0, 9.0, 40.0), ("d", 2, 1, 0, "four", 1.0, 0.0, 9.0, 10.0)]
    raw = spark.createDataFrame(lines, "doc string, page int, block int, line int, text string, x0 double, y0 double, x1 double, y1 double")
    return files.typed_blocks(raw).withColumn("t", F.replace("text", F.lit("\n"), F.lit("|")))


@cases("n int, a string, b string", (0, "x", None), (1, None, None), (2, "y z", "w"))
def blank_fields(spark):
    return files.blank_to_null(spark.createDataFrame([(0, " x ", ""), (1, "  ", None), (2, "y z", "w")], "n int, a string, b string"), "a", "b")


def _ranges(text: str | None) -> str:
    try:
        return ",".join(map(str, files.parse_pages(text, 5)))
    except ValueError:
        return "error"


@cases("t string, found string", (None, "1,2,3,4,5"), ("1", "1"), ("1-3", "1,2,3"), ("1, 3-5", "1,3,4,5"), ("", "error"), ("0", "error"), ("2-1", "error"), ("1,1", "error"), ("6", "error"), ("a", "error"))
def page_ranges(spark):
    return spark.createDataFrame([(t, _ranges(t)) for t in (None, "1", "1-3", "1, 3-5", "", "0", "2-1", "1,1", "6", "a")], "t string, found string")


_PATHS = ("out/a.pdf", "a.ru.pdf", "b.pdf", "sub/C.PDF", "d.txt", "sub/deep/e.pdf")


@cases("path string, skip string, output string", ("out/a.pdf", "inside_output", "out/a.ru.pdf"), ("a.ru.pdf", "already_translated", "a.ru.ru.pdf"), ("b.pdf", None, "b.ru.pdf"), ("sub/C.PDF", "excluded", "sub/C.ru.pdf"), ("d.txt", "not_a_pdf", "d.ru.pdf"), ("sub/deep/e.pdf", "not_included", "sub/deep/e.ru.pdf"))
def discovered_files(spark):
    found = files.skip_reasons(spark.createDataFrame([(p,) for p in _PATHS], "path string"), include=("b*.pdf", "sub/c.pdf"), exclude=("**/c.pdf",), output="out")
    return found.withColumn("output", files.named_output(F.col("path"), "translated"))


@cases("path string, place int", ("a.ru.pdf", 0), ("b.pdf", 1), ("d.txt", 2), ("out/a.pdf", 3), ("sub/C.PDF", 4), ("sub/deep/e.pdf", 5))
def file_order(spark):
    found = files.skip_reasons(spark.createDataFrame([(p,) for p in reversed(_PATHS)], "path string")).coalesce(1)
    return found.withColumn("place", F.monotonically_increasing_id())


@cases("kind string, name string", ("translated", "in/x.ru.pdf"), ("debug", "in/x.debug.pdf"), ("failed", "in/x.failed-render.pdf"), ("batch", "in/x.pdf_ru"), ("id", "document-3c58a6b6e95c"))
def output_names(spark):
    one, path = spark.range(1), F.lit("in/x.pdf")
    kinds = ("translated", "debug", "failed", "batch")
    rows = [F.struct(F.lit(k).alias("kind"), files.named_output(path, k).alias("name")) for k in kinds] + [F.struct(F.lit("id").alias("kind"), files.generated_id(F.lit("IN/x.pdf")).alias("name"))]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


@cases("path string, outside boolean", ("a/b.pdf", False), ("../b.pdf", True), ("a/../b.pdf", True), ("/a.pdf", True), ("C:\\a.pdf", True), ("a..b/c.pdf", False), ("", True))
def path_guards(spark):
    rows = spark.createDataFrame([(p,) for p in ("a/b.pdf", "../b.pdf", "a/../b.pdf", "/a.pdf", "C:\\a.pdf", "a..b/c.pdf", "")], "path string")
    return rows.select("path", datasets.escapes(F.col("path")).alias("outside"))


@cases("document_id string, problem string", ("b", "outside"), ("b", "missing"), ("c", "id repeated"), ("C", "id repeated"), ("C", "missing"), ("d", "path repeated"), ("e", "path repeated"))
def manifest_problems(spark):
    manifest = spark.createDataFrame([("a", "a.pdf"), ("b", "../b.pdf"), ("c", "c.pdf"), ("C", "x.pdf"), ("d", "d.pdf"), ("e", "d.pdf")], "document_id string, path string")
    return datasets.manifest_problems(manifest, spark.createDataFrame([(p,) for p in ("a.pdf", "c.pdf", "d.pdf")], "path string"))


@cases("bytes long, n_files long", (30, 2))
def folder_size(spark):
    return files.folder_size(spark.createDataFrame([("a", 10), ("b", 20)], "path string, file_size long"))


@cases("cache_key string, t string", ("a", "new"), ("b", "only"))
def latest_translations(spark):
    rows = lambda *r: spark.createDataFrame(list(r), "cache_key string, translated_text string, at long").select("cache_key", "translated_text", F.timestamp_seconds("at").alias("created_at"))
    return translate.merge_memory(rows(("a", "old", 1), ("b", "only", 2)), rows(("a", "new", 3))).withColumnRenamed("translated_text", "t")


@cases("sample_id string, category string, source string, tokens string, observed string, score int", ("s1", "plain", "Take 5 kg", "5 kg", None, 4), ("s2", None, "Other", None, "RU Other", None))
def parsed_samples(spark):
    said = '{"dataset_version":"1","samples":[{"id":"s1","category":"plain","source":"Take 5 kg","protected_tokens":["5 kg"],"human_review":{"adequacy":4}},{"id":"s2","source":"Other","stage_trace":{"observed_translation":"RU Other"}}]}'
    rows = spark.createDataFrame([(said,)], "j string").select(F.from_json("j", datasets.SAMPLES).alias("d")).select(F.explode("d.samples").alias("s")).select("s.*")
    return rows.select(F.col("id").alias("sample_id"), "category", "source", _list("protected_tokens").alias("tokens"), F.col("stage_trace.observed_translation").alias("observed"), F.col("human_review.adequacy").alias("score"))


@cases("doc string, page int, id string, t string, kind string", ("d", 1, "p0001-b0001", "text", "body"))
def document_json(spark):
    docs = spark.createDataFrame([("1.3", "d", "s", 3, [(1, 600.0, 800.0, "text", [])], [("p0001-b0001", 1, "body", "text", None)])], files.DOCUMENT)
    back = docs.select(F.to_json(F.struct("*")).alias("j")).select(F.from_json("j", files.DOCUMENT, {"mode": "FAILFAST"}).alias("d")).select("d.doc", F.explode("d.paragraphs").alias("p"))
    return back.select("doc", "p.page", "p.id", F.col("p.text").alias("t"), "p.kind")


@cases("policy string, n long, n_texts long", ("translate", 300, 42), ("preserve", 30, 30), ("skip", 30, 30))
def generated_paragraphs(spark):
    return datasets.paragraph_set(spark, 3).groupBy("policy").agg(F.count("*").alias("n"), F.count_distinct("text").alias("n_texts"))


@cases("kind string, n long", ("short", 5), ("medium", 15), ("long", 16))
def length_classes(spark):
    units = spark.createDataFrame([(" ".join(["w"] * n),) for n in (1, 8, 14, 15, 15, *range(16, 31), *range(61, 77))], "text string")
    rows = [datasets.length_class(units, k).agg(F.lit(k).alias("kind"), F.count("*").alias("n")) for k in ("short", "medium", "long")]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


# Options


def _valid(make: Callable[[], object]) -> bool:
    try:
        make()
    except ValueError:
        return False
    return True


@cases("n int, valid boolean", (0, True), (1, False), (2, False), (3, False), (4, False), (5, False), (6, True))
def option_checks(spark):
    made = (lambda: RepeatedOptions(least_pages=3), lambda: RepeatedOptions(least_pages=2), lambda: PageOptions(mixed_image_ratio=0), lambda: ParagraphOptions(width=1.5), lambda: LayoutOptions(font_step=0), lambda: TranslationOptions(token_limit=7), lambda: TranslationOptions(token_limit=8))
    return spark.createDataFrame([(i, _valid(m)) for i, m in enumerate(made)], "n int, valid boolean")


@cases("id string", ("7423ffe42376623513cd16c642cef17dbf188c1fe0e00aed34c1581bb752f4f4",))
def run_identity(spark):
    """The hash of ["abc",{"backend":"fake","batch_size":8,"model":"prefix","source":"en","target":"ru","token_limit":64}]."""
    return spark.createDataFrame([(identity("abc", TranslationOptions()),)], "id string")


# Layout


@cases("n int, class string, warning string, ratio double", (0, "empty", None, 0.0), (1, "scanned", "low image coverage", 0.5), (2, "scanned", None, 0.9), (3, "mixed", None, 0.2), (4, "text", None, 0.1), (5, "text", None, 0.0), (6, "text", None, 1.0))
def all_page_classes(spark):
    rows = [(0, 0, 0, 0, 0.0), (1, 5, 1, 1, 300.0), (2, 0, 0, 1, 540.0), (3, 50, 1, 2, 120.0), (4, 50, 1, 1, 60.0), (5, 3, 1, 0, 0.0), (6, 3, 1, 0, 900.0)]
    found = spark.createDataFrame(rows, "n int, chars long, n_blocks long, images int, area double").withColumn("image_area", pages.image_ratio(F.col("area"), F.lit(600.0)))
    return pages.classify_pages(found).withColumnRenamed("image_area", "ratio")


@cases("mode string, pages string", ("auto", "2"), ("on", "1|2"), ("forced", "1|2|3"), ("off", ""))
def recognition_targets(spark):
    rows = spark.createDataFrame([(1, "empty"), (2, "scanned"), (3, "text")], "page int, class string")
    one = lambda mode, force, name: pages.ocr_targets(rows, mode, force).agg(F.lit(name).alias("mode"), F.array_join(F.array_sort(F.collect_list(F.col("page").cast("string"))), "|").alias("pages"))
    return one("auto", False, "auto").unionByName(one("on", False, "on")).unionByName(one("on", True, "forced")).unionByName(one("off", False, "off"))


@cases("page int, same_geometry boolean, gained long", (1, True, 90), (2, False, 0))
def recognised_pages(spark):
    schema = "doc string, page int, page_w double, page_h double, chars long"
    return pages.compare_pages(spark.createDataFrame([("d", 1, 600.0, 800.0, 10), ("d", 2, 600.0, 800.0, 5), ("d", 3, 1.0, 1.0, 1)], schema), spark.createDataFrame([("d", 1, 600.005, 800.0, 100), ("d", 2, 601.0, 800.0, 5)], schema))


@cases("n int, first double, ladder string", (0, 7.1, "7.1|6.6|6.1|6.0"), (1, 11.0, "11.0|10.5|10.0|9.5|9.0|8.5|8.0|7.5|7.0|6.5|6.0"), (2, 4.0, "6.0"))
def font_ladders(spark):
    rows = spark.createDataFrame([(0, [5.0, 7.1, float("nan")]), (1, [0.0, 200.0]), (2, [4.0])], "n int, s array<double>")
    rows = rows.withColumn("first", layout.first_font(F.col("s"), 11.0))
    return rows.withColumn("ladder", F.array_join(F.transform(layout.font_ladder(F.col("first"), LayoutOptions()), lambda x: x.cast("string")), "|"))


@cases("block_id string, font_size double, attempts long, expanded boolean, overflow boolean", ("a", 10.0, 1, False, False), ("b", 10.0, 10, True, False), ("c", None, 18, False, True), ("d", 8.0, 5, False, False))
def planned_layout(spark):
    rows = [("d", 1, "a", "short", [10.0], 0.0, 0.0, 100.0, 20.0, 100.0, 800.0), ("d", 1, "b", "x" * 200, [10.0], 0.0, 100.0, 100.0, 120.0, 100.0, 800.0), ("d", 2, "c", "x" * 4000, [10.0], 0.0, 0.0, 100.0, 20.0, 100.0, 60.0), ("d", 3, "d", "x" * 50, [10.0], 0.0, 0.0, 100.0, 20.0, 100.0, 60.0)]
    return layout.plan_layout(spark.createDataFrame(rows, "doc string, page int, block_id string, translated string, sizes array<double>, x0 double, y0 double, x1 double, y1 double, page_w double, page_h double"), LayoutOptions(expand=True))


@cases("n_blocks long, n_reduced long, n_expanded long, n_overflow long", (3, 1, 1, 1))
def layout_counts(spark):
    return layout.layout_counters(spark.createDataFrame([(10.0, 10.0, True, False), (10.0, 8.0, False, False), (10.0, None, False, True)], "font_first double, font_size double, expanded boolean, overflow boolean"))


@cases("n int, verified boolean", (0, True), (1, True), (2, False), (3, True))
def verified_clips(spark):
    rows = spark.createDataFrame([(0, "a-b (c)", "x a\u2011b （c） y"), (1, "one two", "one\n two"), (2, "one", "two"), (3, "file 12", "ﬁle １２")], "n int, expected string, found string")
    return layout.clip_matches(rows)


@cases("block_id string, padded boolean, x0 double, y0 double, x1 double, y1 double", ("a", True, 0.0, 9.5, 50.5, 20.5), ("b", False, 0.0, 30.0, 50.0, 40.0), ("c", False, 0.0, 40.2, 50.0, 50.0), ("d", True, 99.5, 9.5, 100.0, 20.5))
def clipped_redactions(spark):
    rows = [("d", 1, "a", 0.0, 10.0, 50.0, 20.0, 100.0, 60.0), ("d", 1, "b", 0.0, 30.0, 50.0, 40.0, 100.0, 60.0), ("d", 1, "c", 0.0, 40.2, 50.0, 50.0, 100.0, 60.0), ("d", 1, "d", 100.0, 10.0, 100.0, 20.0, 100.0, 60.0)]
    found = layout.redaction_boxes(spark.createDataFrame(rows, "doc string, page int, block_id string, x0 double, y0 double, x1 double, y1 double, page_w double, page_h double"), LayoutOptions())
    return found.select("block_id", "padded", "redaction.*")


_BOXES = "doc string, page int, ord int, text string, x0 double, y0 double, x1 double, y1 double, page_w double, page_h double"


@cases("block_id string, t string, n_merged int", ("p0001-b0001", "An open line goes on here", 2), ("p0001-b0002", "Another sentence.", 1), ("p0001-b0003", "far below", 1))
def older_merge(spark):
    rows = [("d", 1, 0, "An open line", 50.0, 100.0, 500.0, 110.0, 600.0, 800.0), ("d", 1, 1, "goes on here", 50.0, 112.0, 500.0, 122.0, 600.0, 800.0), ("d", 1, 2, "Another sentence.", 50.0, 124.0, 500.0, 134.0, 600.0, 800.0), ("d", 1, 3, "far below", 50.0, 400.0, 500.0, 410.0, 600.0, 800.0)]
    return paragraphs.merge_adjacent_blocks(spark.createDataFrame(rows, _BOXES)).withColumnRenamed("text", "t")


def _fragments(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    made = [("d", p, o, f"p{p:04d}-b{o + 1:04d}", t, *map(float, box), b, 600.0, 800.0) for p, o, t, *box, b in rows]
    return spark.createDataFrame(made, "doc string, page int, ord int, block_id string, text string, x0 double, y0 double, x1 double, y1 double, font double, bold boolean, page_w double, page_h double")


@cases("para long, page int, kind string, t string, y0 double, y1 double, n_fragments long, blocks string", (1, 1, "heading", "TITLE", 50.0, 64.0, 1, "p0001-b0001"), (2, 1, "body", "A paragraph goes on and continues on the next page.", 100.0, 764.0, 3, "p0001-b0002|p0001-b0003|p0002-b0001"), (3, 2, "list_item", "1. First item", 100.0, 110.0, 1, "p0002-b0002"), (4, 2, "caption", "Figure 2 shows", 200.0, 210.0, 1, "p0002-b0003"), (5, 2, "footnote", "a small note", 700.0, 706.0, 1, "p0002-b0004"))
def paragraph_boxes(spark):
    rows = [(1, 0, "TITLE", 50, 50, 550, 64, 14, True), (1, 1, "A para-", 50, 100, 550, 110, 10, False), (1, 2, "graph goes on and", 50, 752, 550, 764, 10, False), (2, 0, "continues on the next page.", 50, 20, 550, 32, 10, False), (2, 1, "1. First item", 50, 100, 550, 110, 10, False), (2, 2, "Figure 2 shows", 50, 200, 550, 210, 10, False), (2, 3, "a small note", 50, 700, 550, 706, 6, False)]
    rows[2] = (1, 2, "graph goes on and", 50, 112, 550, 764, 10, False)
    return paragraphs.paragraphs_of(_fragments(spark, rows))[0].select("para", "page", "kind", F.col("text").alias("t"), "y0", "y1", "n_fragments", _list("blocks").alias("blocks"))


@cases("current string, action string, reasons string", ("p0001-b0002", "keep", "heading_boundary"), ("p0001-b0003", "merge", "same_column|aligned|close_vertical_gap|compatible_style|similar_width|soft_hyphen"), ("p0001-b0004", "keep", "same_column|aligned|close_vertical_gap|style_change"), ("p0001-b0005", "keep", "same_column|indentation_change"), ("p0001-b0006", "keep", "same_column|aligned|gap_too_large"), ("p0001-b0007", "ambiguous", "same_column|aligned|close_vertical_gap|compatible_style|similar_width|terminal_punctuation|ambiguous_geometry"), ("p0002-b0001", "keep", "same_column|page_boundary_weak"))
def decision_reasons(spark):
    rows = [(1, 0, "TITLE OF ALL", 50, 20, 550, 34, 10, False), (1, 1, "some text of a para-", 50, 100, 550, 110, 10, False), (1, 2, "graph that goes on with many more words than a heading may ever have in it", 50, 112, 550, 122, 10, False), (1, 3, "in another size which is not at all that of the lines above it and long enough to be no heading", 50, 124, 550, 134, 11.5, False), (1, 4, "set in a good deal further so that it is surely no part of what was above it, by any means", 90, 136, 550, 146, 11.5, False), (1, 5, "a line that is very far below the one before, with more words than a heading can hold.", 90, 300, 550, 310, 11.5, False), (1, 6, "The next one begins anew right below it and has, as they all do here, very many words.", 90, 312, 550, 322, 11.5, False), (2, 0, "A page later there is again one line that stands by itself and is as long as others are.", 50, 20, 550, 34, 10, False)]
    _, decisions = paragraphs.paragraphs_of(_fragments(spark, rows))
    return decisions.withColumn("reasons", _list("reasons"))


# Checks


@cases("ord int, problem string", (1, "box"), (2, "not stored"), (3, "gone"), (4, "text"))
def layout_changes(spark):
    schema = "doc string, page int, ord int, text string, x0 double, y0 double, x1 double, y1 double"
    a = spark.createDataFrame([("d", 1, i, t, 0.0, 0.0, 1.0, 1.0) for i, t in ((0, "t"), (1, "u"), (2, "v"), (4, "w"))], schema)
    b = spark.createDataFrame([("d", 1, 0, "t", 0.4, 0.0, 1.0, 1.0), ("d", 1, 1, "u", 0.6, 0.0, 1.0, 1.0), ("d", 1, 3, "v", 0.0, 0.0, 1.0, 1.0), ("d", 1, 4, "x", 0.0, 0.0, 1.0, 1.0)], schema)
    return checks.layout_differences(a, b)


@cases("kind string, id string", ("dangling", "y"), ("repeated", "x"), ("changed", "p"), ("unmatched", "none"))
def references(spark):
    a, b = spark.createDataFrame([("x",), ("y",)], "id string"), spark.createDataFrame([("x",), ("X",)], "id string")
    scan = "path string, file_size long, sha256 string"
    changed = checks.changed_sources(spark.createDataFrame([("p", 1, "a"), ("q", 1, "a")], scan), spark.createDataFrame([("p", 1, "b"), ("q", 1, "a")], scan))
    docs = spark.createDataFrame([("a/b.pdf", "one", ["big"])], "path string, id string, categories array<string>")
    parts = {"dangling": checks.dangling(a, b, "id"), "repeated": checks.repeated_ids(b, "id").select("id"), "changed": changed.withColumnRenamed("path", "id"), "unmatched": checks.unmatched_selectors(docs, ("one", "none")).withColumnRenamed("selector", "id")}
    rows = [d.select(F.lit(k).alias("kind"), "id") for k, d in parts.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])


@cases("id string, selector string", ("one", "big"), ("two", "two"), ("three", "**/*.pdf"), ("four", None))
def subset_selectors(spark):
    docs = spark.createDataFrame([("a.txt", "one", ["big"]), ("c.txt", "two", []), ("x/y.pdf", "three", []), ("z.txt", "four", [])], "path string, id string, categories array<string>")
    return docs.select("id", checks.in_subset(F.col("path"), F.col("id"), F.col("categories"), ("two", "big", "**/*.pdf")).alias("selector"))


@cases("n int, characters string, cyrillic boolean", (0, "abc", False), (1, "aя", True))
def font_characters(spark):
    rows = _texts(spark, "cab", "яa")
    return checks.code_points(rows, "t", "n").select("n", F.array_join("characters", "").alias("characters")).join(rows.select("n", checks.has_cyrillic(F.col("t")).alias("cyrillic")), "n")


@cases("n int, missing string", (0, "rus"), (1, ""))
def missing_languages(spark):
    rows = spark.createDataFrame([(0, ["eng", "rus"], ["eng", "osd"]), (1, ["eng"], ["eng"])], "n int, a array<string>, b array<string>")
    return rows.select("n", _list(checks.missing_languages(F.col("a"), F.col("b"))).alias("missing"))


@cases("ord int", (0,), (1,))
def sane_boxes(spark):
    rows = [("d", 1, 0, "t", 0.0, 0.0, 10.0, 10.0, 600.0, 800.0), ("d", 1, 1, "t", -0.4, 0.0, 600.4, 10.0, 600.0, 800.0), ("d", 1, 2, "t", -1.0, 0.0, 10.0, 10.0, 600.0, 800.0), ("d", 1, 3, "t", 5.0, 5.0, 5.0, 10.0, 600.0, 800.0)]
    return checks.sane_boxes(spark.createDataFrame(rows, _BOXES))


@cases("para int, frag int, repeated boolean", (1, 0, False), (1, 1, False), (2, 0, True), (3, 0, False))
def repeated_boxes(spark):
    rows = [("d", 1, 1, 0, 0.0, 0.0, 1.0, 1.0), ("d", 1, 1, 1, 0.0, 2.0, 1.0, 3.0), ("d", 1, 2, 0, 0.0, 0.0, 1.0, 1.0), ("d", 2, 3, 0, 0.0, 0.0, 1.0, 1.0)]
    return checks.first_boxes(spark.createDataFrame(rows, "doc string, page int, para int, frag int, x0 double, y0 double, x1 double, y1 double"))


@cases("ids string, cut string, whole string, box string", ("1, 2, 3, 4, 5, 6, 7, 8", "x" * 240 + "...", "xyz", "0.12|2.0|3.46|4.0"))
def shortened_messages(spark):
    one = spark.createDataFrame([([str(i) for i in range(1, 12)], "x" * 300, "xyz", 0.125, 2.0, 3.456, 4.0)], "i array<string>, a string, b string, x0 double, y0 double, x1 double, y1 double")
    return one.select(checks.shown(F.col("i")).alias("ids"), checks.snippet(F.col("a")).alias("cut"), checks.snippet(F.col("b")).alias("whole"), F.array_join(F.transform(checks.rounded_box(*[F.col(c) for c in ("x0", "y0", "x1", "y1")]), lambda x: x.cast("string")), "|").alias("box"))


@cases("doc string, colour string, warnings string", ("d", "red", "b|a"), ("e", None, "c"))
def first_and_distinct(spark):
    rows = spark.createDataFrame([("d", 1, None, "b"), ("d", 2, "red", "a"), ("d", 3, "blue", "b"), ("e", 1, None, "c")], "doc string, place int, colour string, warning string")
    first = rows.groupBy("doc").agg(checks.first_known("colour", "place").alias("colour"))
    return first.join(checks.distinct_in_order(rows, "doc").select("doc", _list("warnings").alias("warnings")), "doc")


@cases("batch int, place int, warmup boolean, iteration int", (1, 0, True, 0), (1, 1, False, 0), (1, 2, False, 1), (4, 0, True, 0), (4, 1, False, 0))
def numbered_iterations(spark):
    return checks.iterations(spark.createDataFrame([(1, 0), (1, 1), (1, 2), (4, 0), (4, 1)], "batch int, place int"), 1)


@cases("run string, differ string, resumable boolean", ("r1", "", True), ("r2", "model|tokens", False))
def compatible_runs(spark):
    stored = spark.createDataFrame([("r1", "fake", "m", 64), ("r2", "fake", "n", 32)], "run string, backend string, model string, tokens int")
    return checks.compatible_runs(stored, {"backend": "fake", "model": "m", "tokens": 64}).withColumn("differ", _list("differ"))


@cases("reason string", ("identity differs",), ("units differ",))
def resume_reasons(spark):
    run, units = spark.createDataFrame([("i",)], "identity string"), spark.createDataFrame([("1", "t")], "unit_id string, text string")
    return checks.resumable(run, units, units.limit(0), "j")


# Translation and glossary


@cases("para int, policy string", (1, "translate"), (2, "skip"), (3, "preserve"))
def paragraph_policies(spark):
    parts = spark.createDataFrame([("d", 1, "a"), ("d", 2, "b"), ("d", 3, "b"), ("d", 3, "c")], "doc string, para int, block_id string")
    return translate.policies(parts, spark.createDataFrame([("d", "b", "skip"), ("d", "c", "translate")], "doc string, block_id string, policy string"))


_UNITS = "unit_id string, unit_order int, text string, policy string"


@cases("n_units long, n_skipped long, n_hits long, n_misses long, n_segments long", (5, 2, 1, 2, 2))
def translation_counters(spark):
    units = spark.createDataFrame([("a", 0, "one text here", "translate"), ("b", 1, "one  text here", "translate"), ("c", 2, "another", "translate"), ("d", 3, "42", "translate"), ("e", 4, "kept", "preserve")], _UNITS)
    planned = translate.plan_units(units, None, TranslationOptions())
    return translate.run_counters(translate.finish_units(planned, translate.translate_misses(planned.where("status = 'miss'"), TranslationOptions())))


@cases("n int, batch long", (0, 0), (1, 0), (2, 1), (3, 1), (4, 2))
def micro_batches(spark):
    return translate.batches_of(spark.createDataFrame([("d", i) for i in range(5)], "doc string, n int"), "n", 2)


@cases("unit_id string", ("b",), ("c",))
def pending_units(spark):
    units = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "z")], "unit_id string, text string")
    return translate.pending(units, spark.createDataFrame([("a", "x"), ("b", "older")], "unit_id string, text string"))


class _Small(translate.PrefixTranslator):
    def translate_batch(self, texts: list[str]) -> list[str]:
        if len(texts) > 2:
            raise MemoryError
        return super().translate_batch(texts)


@cases("n int, t string", (0, "RU a"), (1, "RU b"), (2, "RU c"), (3, "RU d"), (4, "RU e"))
def halved_batches(spark):
    return spark.createDataFrame(list(enumerate(translate.halving(_Small(), list("abcde")))), "n int, t string")


_TERMS = (Term("press", "pressure", "ДАВЛЕНИЕ"), Term("hp", "high pressure", "ВД", priority=5), Term("ok", "OK", "OK", mode="preserve", match="whole_word", case_sensitive=True), Term("all", "whole text", "ВСЁ", match="exact"), Term("flex", "valve", "клапан", inflection="flexible"))


@cases("n int, place int, term string, start int, end int", (0, 0, "hp", 0, 13), (0, 1, "press", 18, 26), (1, 0, "ok", 3, 5), (2, 0, "all", 0, 12), (4, 0, "flex", 4, 9))
def glossary_precedence(spark):
    rows = _texts(spark, "High  pressure and pressure"[0:4] + " pressure and pressure", "ok OK OKs", " Whole text ", "a whole text", "the valve")
    return glossary_matches(rows, Glossary(_TERMS), "t", "n")


@cases("n int, t string, tokens string", (0, "__TERM_0000__ of the valve", "ДАВЛЕНИЕ"), (1, "valve __TERM_0001__", "ДАВЛЕНИЕ"))
def marked_terms(spark):
    glossary = Glossary(_TERMS)
    rows = _texts(spark, "pressure of the valve", "valve pressure").withColumn("p", prepare(F.col("t"), matches(F.col("t"), glossary), glossary))
    return rows.select("n", F.col("p.text").alias("t"), F.array_join(F.transform("p.tokens", lambda x: x["token"]), "|").alias("tokens"))


@cases("unit_id string, term string, required long, present long, compliant boolean", ("a", "press", 2, 1, False), ("b", "press", 1, 1, True))
def required_targets(spark):
    units = spark.createDataFrame([("a", "pressure or pressure"), ("b", "pressure")], "unit_id string, text string")
    return compliance(glossary_matches(units, Glossary(_TERMS)), spark.createDataFrame([("a", "RU ДАВЛЕНИЕ"), ("b", "ДАВЛЕНИЕ")], "unit_id string, translated string"))


@cases("n int, problem string", (0, ""), (1, "id a is repeated|a: the same source, match and case again"), (2, "b: its source has another mode elsewhere"), (3, "a: its source or target has a reserved mark"))
def glossary_conflicts(spark):
    sets = ((Term("a", "x", "y"), Term("b", "z", "w")), (Term("a", "x", "y"), Term("a", "X", "z")), (Term("a", "x", "y"), Term("b", "x", "x", mode="preserve", match="whole_word")), (Term("a", "__TERM_0000__", "y"),))
    return spark.createDataFrame([(i, "|".join(conflicts(s))) for i, s in enumerate(sets)], "n int, problem string")


@cases("n int, same boolean", (0, True), (1, False), (2, True))
def glossary_fingerprints(spark):
    one = Glossary((Term("a", "x", "y"), Term("b", "z", "w")))
    others = (Glossary((Term("b", "z", "w"), Term("a", "x", "y"))), Glossary((Term("a", "x", "other"), Term("b", "z", "w"))), Glossary((Term("a", "x", "y", notes="said"), Term("b", "z", "w"))))
    return spark.createDataFrame([(i, g.fingerprint() == one.fingerprint()) for i, g in enumerate(others)], "n int, same boolean")


# Quality and reports

_SAMPLE = "sample_id string, source string, output string, protected array<string>, n_segments int, n_outputs int, forced boolean, protection_error string"


@cases(
    "sample_id string, code string, stage string, severity string, evidence string",
    ("a", "segment-count-mismatch", "segmentation", "error", "source=1|output=2"), ("a", "forced-segmentation", "segmentation", "warning", ""), ("b", "protected-token-restore-failed", "protected_token", "error", ""), ("b", "protected-token-damaged", "protected_token", "error", "ABC"),
    ("c", "protected-placeholder-leaked", "protected_token", "error", ""), ("d", "number-damaged", "model", "error", "12"), ("e", "unit-damaged", "model", "error", "5 kg"), ("e", "number-damaged", "model", "error", "5"), ("f", "url-damaged", "model", "error", "https://a.b"), ("g", "path-damaged", "model", "error", "C:\\a\\b"),
    ("h", "option-damaged", "model", "error", "--go"), ("i", "suspicious-character", "model", "error", "U+FFFD"), ("j", "untranslated-output", "model", "error", ""), ("k", "suspicious-length-ratio", "model", "warning", "ratio=0.200"),
)
def all_findings(spark):
    rows = [("a", "some text", "RU some text", [], 1, 2, True, None), ("b", "has ABC in it", "RU has in it all", ["ABC"], 1, 1, False, "lost"), ("c", "some text", "RU __KEEP_0000__", [], 1, 1, False, None), ("d", "12 and 12", "RU 12 and", [], 1, 1, False, None), ("e", "weigh 5 kg", "RU weigh it", [], 1, 1, False, None)]
    rows += [("f", "at https://a.b so", "RU at home so", [], 1, 1, False, None), ("g", "in C:\\a\\b so", "RU in there so", [], 1, 1, False, None), ("h", "with --go so", "RU with it so", [], 1, 1, False, None), ("i", "a char", "RU a \ufffd char", [], 1, 1, False, None), ("j", "Same  text", "same text", [], 1, 1, False, None), ("k", "ten chars.", "RU", [], 1, 1, False, None)]
    return quality.analyse(spark.createDataFrame(rows, _SAMPLE)).withColumn("evidence", _list("evidence"))


@cases("code string, stage string, origin string", ("extracted-text-changed", "extraction", "historical_trace"), ("number-damaged", "extraction", "historical_trace"), ("observed-segment-count-mismatch", "segmentation", "historical_trace"), ("rendered-text-changed", "rendering", "historical_trace"), ("suspicious-character", "rendering", "historical_trace"))
def trace_findings(spark):
    rows = [("a", "Take 5 apples", "Take apples", "RU Take apples", "RU Take \ufffd apples", [], ["one", "two"], ["one"])]
    return quality.analyse_trace(spark.createDataFrame(rows, "sample_id string, source string, extracted string, observed string, rendered string, protected array<string>, source_segments array<string>, translated_segments array<string>"))


@cases("findings string", ("a:model:warning|b:model:error",))
def last_findings(spark):
    rows = spark.createDataFrame([([("a", "model", "error", ["x"]), ("b", "model", "error", []), ("a", "model", "warning", ["x"])],)], f"f array<{quality.FINDING}>")
    return rows.select(F.array_join(F.transform(quality.last_of_each(F.col("f")), lambda f: F.concat_ws(":", f["code"], f["stage"], f["severity"])), "|").alias("findings"))


@cases("change string, stage string, code string", ("new", "model", "c"), ("resolved", "model", "a"))
def finding_changes(spark):
    rows = lambda *codes: spark.createDataFrame([("s", "model", c) for c in codes], "sample_id string, stage string, code string")
    return quality.finding_changes(rows("a", "b"), rows("b", "c"))


@cases("stage string, n_current long, n_historical long, n_errors long", ("extraction", 0, 0, 0), ("segmentation", 0, 0, 0), ("protected_token", 0, 0, 0), ("model", 2, 0, 1), ("terminology", 0, 0, 0), ("rendering", 0, 1, 0))
def finding_stages(spark):
    return benchmark.stage_table(spark.createDataFrame([("model", "current_run", "error"), ("model", "current_run", "warning"), ("rendering", "historical_trace", "error")], "stage string, origin string, severity string"))


class _Odd(translate.PrefixTranslator):
    """Fails on one text, gives too much for another."""

    def translate_batch(self, texts: list[str]) -> list[str]:
        if "fail" in texts[0]:
            raise RuntimeError("no")
        return [*super().translate_batch(texts), *(["more"] if "twice" in texts[0] else [])]


def _benchmark(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    said = '{"samples":[{"id":"a","category":"x","source":"Take 5 kg of it","protected_tokens":["5 kg"]},{"id":"b","category":"x","source":"Take 5 kg of it","human_review":{"adequacy":2,"fluency":4,"terminology":5,"token_preservation":5,"segmentation":5,"overall_acceptability":3}},{"id":"c","category":"y","source":"this will fail"},{"id":"d","category":"y","source":"this comes twice","stage_trace":{"observed_translation":"RU this","rendered_text":"RU that"}}]}'
    rows = spark.createDataFrame([(said,)], "j string").select(F.from_json("j", datasets.SAMPLES).alias("d")).select(F.posexplode("d.samples").alias("place", "s")).select("place", "s.*").withColumnRenamed("id", "sample_id")
    return benchmark.run_benchmark(rows, TranslationOptions(), _Odd)


@cases("sample_id string, category string, status string, output string, cache_hit boolean, n_findings long", ("a", "x", "passed", "RU Take 5 kg of it", False, 0), ("b", "x", "failed", "RU Take 5 kg of it", True, 1), ("c", "y", "error", None, False, 1), ("d", "y", "failed", "RU this comes twice more", False, 2))
def benchmark_results(spark):
    return _benchmark(spark)[0]


@cases("n_samples long, n_passed long, n_failed long, n_error long, n_hits long, n_misses long", (4, 1, 2, 1, 1, 3))
def benchmark_totals(spark):
    return benchmark.benchmark_summary(_benchmark(spark)[0])


@cases("value string", ("# Run",), ("",), ("| a | b |",), ("| --- | --- |",), ("| 1 | x\\|y |",), ("| 2 |  |",))
def report_lines(spark):
    return datasets.markdown(spark.createDataFrame([(2, None), (1, "x|y")], "a int, b string"), "Run", ("a",))


@cases("error string, code int", (None, 0), ("invalid_arguments", 2), ("input_error", 3), ("ocr_required", 4), ("model_unavailable", 5), ("translation_failed", 6), ("rendering_failed", 7), ("output_validation_failed", 8), ("ocr_failed", 9), ("batch_failed", 10), ("diagnostic_publication_failed", 11), ("interrupted", 130), ("unheard of", 6))
def exit_codes(spark):
    rows = spark.createDataFrame([(e,) for e in (None, *[k for k in reports.EXIT_CODES if k != "success"], "unheard of")], "error string")
    return rows.select("error", reports.exit_code(F.col("error")).alias("code"))


@cases("mode string, path string, outcome string", ("stop", "a", "ok"), ("stop", "b", "failed"), ("stop", "c", "not_run"), ("go on", "a", "ok"), ("go on", "b", "failed"), ("go on", "c", "ok"), ("no model", "a", "failed"), ("no model", "b", "not_run"))
def batch_outcomes(spark):
    rows = spark.createDataFrame([("x", "a", None), ("x", "b", "input_error"), ("x", "c", None)], "batch string, path string, error string")
    gone = spark.createDataFrame([("x", "a", "model_unavailable"), ("x", "b", None)], "batch string, path string, error string")
    parts = [d.withColumn("mode", F.lit(m)) for m, d in (("stop", reports.first_failures(rows, False)), ("go on", reports.first_failures(rows, True)), ("no model", reports.first_failures(gone, True)))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@cases("doc string, manual string, defects string", ("a", "pass", ""), ("b", "fail", "integrity:source|manual:layout|stage:render"), ("c", "pending", ""))
def manual_reviews(spark):
    docs = spark.createDataFrame([("a", {"render": "passed"}, False), ("b", {"render": "failed"}, True), ("c", {}, False)], "doc string, stages map<string,string>, source_changed boolean")
    seen = reports.with_reviews(docs, spark.createDataFrame([("a", {"layout": "pass"}), ("b", {"layout": "fail"})], "doc string, checks map<string,string>"), ("layout",))
    found = reports.defects(seen).groupBy("doc").agg(F.array_join(F.array_sort(F.collect_list("defect")), "|").alias("defects"))
    return seen.join(found, "doc", "left").select("doc", "manual", F.coalesce("defects", F.lit("")).alias("defects"))


@cases("n_passed long, n_failed long, n_planned long, n_integrity long, n_manual_pass long, n_manual_fail long, n_manual_pending long", (1, 1, 1, 1, 1, 1, 1))
def validation_totals(spark):
    return reports.validation_summary(spark.createDataFrame([("passed", False, "pass"), ("failed", True, "fail"), ("planned", False, "pending")], "status string, source_changed boolean, manual string"))


@cases("unit_id string, status string, font_size double, n_terms long, n_violations long", ("a", "miss", 10.0, 2, 1), ("b", "hit", None, 0, 0))
def unit_diagnostics(spark):
    units = spark.createDataFrame([("a", "miss", "t", "RU t"), ("b", "hit", "t", "RU t")], "unit_id string, status string, text string, translated string")
    return reports.diagnostics(units, spark.createDataFrame([("a", 10.0)], "unit_id string, font_size double"), spark.createDataFrame([("a", True), ("a", False)], "unit_id string, compliant boolean"))


@cases(
    "doc string, page_count long, pages_by_type string, ocr_pages long, blocks_extracted long, blocks_translated long, blocks_skipped long, cache_hits long, cache_misses long, translated_segments long, raw_lines long, logical_paragraphs long, ambiguous_decisions long, cross_page_merges long, repeated_elements string, ambiguous_repeated_elements long, font_reductions long, expanded_blocks long, overflow_blocks long, elapsed_seconds double, glossary_enabled boolean, glossary_total_entries long, glossary_matched_entries long, glossary_applied_occurrences long, glossary_violations long",
    ("d", 2, "scanned=1,text=1", 1, 3, 2, 1, 1, 1, 4, 10, 5, 1, 1, "page_number=2,running_header=1", 1, 1, 1, 0, 3.5, True, 2, 1, 3, 1),
)
def document_summaries(spark):
    said = lambda c: F.array_join(F.transform(F.map_entries(c), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",")
    found = reports.document_summary(
        spark.createDataFrame([("d", "text", False), ("d", "scanned", True)], "doc string, class string, ocr boolean"),
        spark.createDataFrame([("d", "hit", None), ("d", "miss", 4), ("d", "skipped", None)], "doc string, status string, n_segments int"),
        spark.createDataFrame([("d", 10, 5, 1, 1)], "doc string, raw_lines long, n_paragraphs long, n_ambiguous long, cross_page_merges long"),
        spark.createDataFrame([("d", "page_number", False), ("d", "page_number", False), ("d", "running_header", True), ("d", "body", False)], "doc string, kind string, ambiguous boolean"),
        spark.createDataFrame([("d", 8.0, 10.0, True, False), ("d", 10.0, 10.0, False, False)], "doc string, font_size double, font_first double, expanded boolean, overflow boolean"),
        spark.createDataFrame([("d", "inspect", 1.0), ("d", "render", 2.5)], "doc string, stage string, seconds double"),
        spark.createDataFrame([("d", "a", "translate", 3, 1), ("d", "b", "preserve", 0, 0)], "doc string, term string, mode string, n long, n_violations long"),
    )
    return found.withColumns({"pages_by_type": said("pages_by_type"), "repeated_elements": said("repeated_elements")})


@cases("run string, status string, stage string, exit_code int", ("r2", "failed", "render", 7))
def failure_reports(spark):
    return reports.failure_report(spark.createDataFrame([("r1", "d", "render", None, None), ("r2", "d", "render", "rendering_failed", "no font")], "run string, doc string, stage string, error string, message string"))


@cases("doc string, violation string", ("a", "pages not strictly increasing"), ("b", "paragraphs missing"), ("c", "paragraphs not allowed"), ("d", "block not classified once"), ("e", "unknown block"), ("f", "completed with units left"))
def document_violations(spark):
    rows = [("a", "1.3", [2, 1], 1, ["x"], ["x"], ["x"], "completed", 1, 1), ("b", "1.3", [1], 0, ["x"], ["x"], [], "completed", 1, 1), ("c", "1.0", [1], 1, ["x"], ["x"], ["x"], "completed", 1, 1), ("d", "1.3", [1], 1, ["x", "y"], ["x"], ["x"], "completed", 1, 1), ("e", "1.3", [1], 1, ["x"], ["x"], ["z"], "completed", 1, 1), ("f", "1.3", [1, 2], 1, ["x"], ["x"], ["x"], "completed", 1, 2), ("g", "1.3", [1, 2, 5], 1, ["x"], ["x"], ["x"], "failed", 1, 2)]
    return reports.invariants(spark.createDataFrame(rows, "doc string, version string, pages array<int>, n_paragraphs int, blocks array<string>, classified array<string>, mapped array<string>, status string, n_done int, n_total int"))


@cases("n int, rate double", (0, 50.0), (1, 0.0), (2, 0.0))
def rates(spark):
    rows = spark.createDataFrame([(0, 100, 2.0), (1, 100, 0.0), (2, 0, 2.0)], "n int, count long, seconds double")
    return rows.select("n", performance.rate(F.col("count"), F.col("seconds")).alias("rate"))


@cases("batch int, rate double", (4, 20.0))
def best_batches(spark):
    rows = [(1, 0, False, 10, 1.0), (4, 1, True, 1000, 1.0), (4, 1, False, 20, 1.0), (4, 1, False, 30, 1.0), (4, 1, False, 10, 1.0), (8, 2, False, 20, 1.0)]
    return performance.best_batch(spark.createDataFrame(rows, "batch int, place int, warmup boolean, n long, seconds double"))


@cases("n_units long, n_outputs long, n_leaks long, n_lost long, passed boolean", (3, 2, 1, 1, False))
def output_integrity(spark):
    return performance.integrity(spark.createDataFrame([("a X", "RU X", ["X"]), ("b Y", "RU __KEEP_0000__", ["Y"]), ("c", None, [])], "text string, translated string, tokens array<string>"))


@cases("batch int, identical boolean", (1, True), (4, False))
def identical_outputs(spark):
    return performance.same_outputs(spark.createDataFrame([(1, "h"), (1, "h"), (4, "h"), (4, "i")], "batch int, hash string"), "batch")


_TIMES = "doc string, status string, n_total int, n_completed int, n_skipped int, started int, updated int, completed int"


@cases("doc string, violation string", ("b", "more completed than there are"), ("b", "completed with units left"), ("c", "more skipped than completed"), ("d", "updated before it started"), ("e", "completed without its time"), ("f", "time of completion too early"))
def lifecycle_violations(spark):
    rows = [("a", "completed", 2, 2, 1, 1, 2, 2), ("b", "completed", 2, 3, 1, 1, 2, 2), ("c", "running", 2, 1, 2, 1, 2, None), ("d", "running", 2, 1, 0, 2, 1, None), ("e", "completed", 2, 2, 0, 1, 2, None), ("f", "running", 2, 1, 0, 1, 2, 2)]
    return reports.lifecycle_violations(spark.createDataFrame(rows, _TIMES))


@cases("doc string, violation string", ("a", "translation not allowed"), ("b", "translation missing"), ("c", "paragraphs not allowed"), ("d", "reconstruction missing"), ("e", "number of paragraphs"), ("f", "translated paragraphs not allowed"), ("h", "unknown version"))
def version_violations(spark):
    rows = [("a", "1.0", True, False, 0, 0, 0), ("b", "1.1", False, False, 0, 0, 0), ("c", "1.1", True, False, 1, 0, 0), ("d", "1.2", False, False, 0, 0, 0), ("e", "1.3", True, True, 2, 3, 2), ("f", "1.2", False, True, 2, 2, 1), ("g", "1.3", True, True, 2, 2, 2), ("h", "2.0", False, True, 1, 1, 0)]
    return reports.version_violations(spark.createDataFrame(rows, "doc string, version string, translated boolean, reconstructed boolean, n_paragraphs int, n_expected int, n_translated int"))


@cases("run string, stage string, status string, seconds double", ("a", "inspect", "reused", 1.0), ("a", "extract", "passed", 2.0), ("a", "render", "not_run", 0.0), ("b", "inspect", "passed", 1.0), ("b", "extract", "failed", 3.0), ("b", "render", "not_run", 0.0), ("c", "inspect", "passed", 4.0), ("c", "extract", "not_run", 0.0), ("c", "render", "failed", 0.0))
def stage_results(spark):
    events = spark.createDataFrame([("a", "inspect", 0.0, True), ("a", "extract", 1.0, False), ("b", "inspect", 0.0, False), ("b", "extract", 1.0, False), ("c", "inspect", 0.0, False)], "run string, stage string, ts double, reused boolean")
    runs = spark.createDataFrame([("a", 3.0, False, None), ("b", 4.0, True, None), ("c", 4.0, True, "render")], "run string, ended double, failed boolean, failed_stage string")
    return performance.stage_results(events, runs, ("inspect", "extract", "render"))


@cases("doc string, page int, problem string", ("d", 2, "geometry"), ("d", 3, "little text"), ("e", None, "page count"), ("e", 1, "little text"))
def recognition_problems(spark):
    schema = "doc string, page int, page_w double, page_h double, chars long, class string, processed boolean"
    before = spark.createDataFrame([("d", 1, 6.0, 8.0, 0, "scanned", True), ("d", 2, 6.0, 8.0, 0, "scanned", True), ("d", 3, 6.0, 8.0, 5, "scanned", True), ("e", 1, 6.0, 8.0, 0, "scanned", True), ("e", 2, 6.0, 8.0, 0, "text", False)], schema)
    after = spark.createDataFrame([("d", 1, 6.0, 8.0, 90, "text", True), ("d", 2, 6.5, 8.0, 90, "text", True), ("d", 3, 6.0, 8.0, 5, "text", True), ("e", 1, 6.0, 8.0, 30, "scanned", True)], schema)
    return pages.recognition_problems(before, after)


@cases("n int, calls int, texts int", (0, 3, 5))
def measured_calls(spark):
    model = translate.Measured(translate.PrefixTranslator())
    for texts in (["a", "b"], ["c"], ["d", "e"]):
        model.translate_batch(texts)
    return spark.createDataFrame([(0, model.calls, model.texts)], "n int, calls int, texts int")
