import pytest
from pyspark.sql import functions as F

from quire.operators import layout, pages, performance, quality, repeated, reports
from quire.operators.paragraphs import merge_adjacent_blocks, paragraph_metrics, paragraphs_of, reading_order
from quire.operators.repeated import classify_repeated, kind_counts
from quire.plans.options import LayoutOptions, ParagraphOptions, RepeatedOptions


def kinds(labelled):
    return {r["kind"]: (r["n_blocks"], r["n_ambiguous"], r["n_groups"]) for r in kind_counts(labelled).collect()}


def test_stacked_blocks_are_one_paragraph(blocks):
    b = blocks([(1, i, f"generated continuation {i}", 50, 20 + 12 * i, 550, 30 + 12 * i, 10) for i in range(1000)], height=13000.0)
    p, d = paragraphs_of(b)
    m = paragraph_metrics(b).first()
    assert (m["n_decisions"], m["merged"], m["n_paragraphs"]) == (999, 999, 1)


def test_soft_hyphen_and_legitimate_one(blocks):
    soft = blocks([(1, 0, "A deterministic para-", 50, 100, 500, 110, 10), (1, 1, "graph continues on the next line", 50, 114, 500, 124, 10)])
    p, d = paragraphs_of(soft)
    assert p.first()["text"] == "A deterministic paragraph continues on the next line"
    assert paragraph_metrics(soft).first()["soft_hyphens"] == 1
    real = blocks([(1, 0, "A well-", 50, 100, 500, 110, 10), (1, 1, "known term remains protected.", 50, 114, 500, 124, 10), (1, 2, "1. First item", 50, 150, 500, 160, 10), (1, 3, "2. Second item", 50, 164, 500, 174, 10)])
    found = paragraphs_of(real)[0].orderBy("para").collect()
    assert found[0]["text"].startswith("A well- known") and [r["kind"] for r in found[1:]] == ["list_item", "list_item"]


def test_two_columns_left_first(blocks):
    b = blocks([(1, 0, "left one goes", 40, 100, 260, 110, 10), (1, 1, "right one goes", 340, 100, 560, 110, 10), (1, 2, "left two goes", 40, 114, 260, 124, 10), (1, 3, "right two goes", 340, 114, 560, 124, 10)])
    assert [r["text"] for r in paragraphs_of(b)[0].orderBy("para").collect()] == ["left one goes left two goes", "right one goes right two goes"]
    assert [r["block_id"][-1] for r in reading_order(b).orderBy("seq").collect()] == ["1", "3", "2", "4"]


def test_across_pages_and_off(blocks):
    b = blocks([(1, 0, "Sentence continues", 50, 760, 500, 774, 10), (2, 0, "on the next page.", 50, 20, 500, 34, 10)])
    p, d = paragraphs_of(b)
    assert p.count() == 1 and paragraph_metrics(b, by=()).first()["cross_page_merges"] == 1
    alone, none = paragraphs_of(b, ParagraphOptions(mode="off"))
    assert alone.count() == 2 and none.count() == 0


def test_alternating_headers(blocks):
    rows = []
    for k in range(1, 9):
        rows += [(k, 0, "Odd title" if k % 2 else "Even title", 50, 20, 550, 34, 10), (k, 1, f"unique body number {k} text", 50, 150, 550, 164, 10), (k, 2, "Copyright Example. All rights reserved.", 50, 750, 550, 764, 8), (k, 3, str(k), 290, 775, 310, 789, 10)]
    assert kinds(classify_repeated(blocks(rows))) == {"body": (8, 0, 0), "page_number": (8, 0, 1), "running_header": (8, 0, 2), "repeated_boilerplate": (8, 0, 1)}
    assert kinds(classify_repeated(blocks(rows), RepeatedOptions(mode="off"))) == {"body": (32, 0, 0)}


def test_page_numbers_footers_and_watermark(blocks):
    numbers = [(k, j, *row) for k in range(1, 5) for j, row in enumerate([("body text of page " + "abcd"[k - 1], 50, 120, 550, 134, 10), (str(k), 290, 770, 310, 784, 10)])]
    assert kinds(classify_repeated(blocks(numbers)))["page_number"][0] == 4
    footers = [(k, j, *row) for k in range(1, 5) for j, row in enumerate([("Company manual", 50, 760, 550, 774, 10), ("body text of page " + "abcd"[k - 1], 50, 150, 550, 164, 10)])]
    row = classify_repeated(blocks(footers)).where("kind = 'running_footer'").first()
    assert row["policy"] == "translate" and row["confidence"] == pytest.approx(0.98)
    marks = [(k, j, *row) for k in range(1, 5) for j, row in enumerate([("DRAFT", 200, 330, 400, 360, 28), ("moving body", 50, 100 + 30 * k, 550, 114 + 30 * k, 10), ("Copyright Example", 50, 750, 550, 764, 8)])]
    assert {k: v[0] for k, v in kinds(classify_repeated(blocks(marks))).items()} == {"watermark_candidate": 4, "body": 4, "repeated_boilerplate": 4}


def test_uncertain_groups(blocks):
    few = [(k, j, *row) for k in range(1, 7) for j, row in enumerate([("seldom header", 50, 20, 550, 34, 10)] * (k in (2, 3)) + [("body text of page " + "abcdef"[k - 1], 50, 150, 550, 164, 10)])]
    found = classify_repeated(blocks(few)).where("norm = 'seldom header'").collect()
    assert {(r["kind"], r["policy"], r["ambiguous"]) for r in found} == {("unknown_repeated", "preserve", True)}


def test_legacy_merge(blocks):
    b = blocks([(1, 0, "A first part", 50, 100, 500, 110, 10), (1, 1, "goes on here.", 50, 112, 500, 122, 10), (1, 2, "Apart.", 50, 300, 500, 310, 10)])
    assert [r["text"] for r in merge_adjacent_blocks(b).orderBy("ord").collect()] == ["A first part goes on here.", "Apart."]


def test_page_classes(spark):
    rows = [("d", 1, 0, 0, 0, 0.0), ("d", 2, 0, 0, 1, 0.9), ("d", 3, 0, 0, 1, 0.2), ("d", 4, 50, 1, 1, 0.3), ("d", 5, 50, 1, 1, 0.1), ("d", 6, 5, 1, 0, 0.0)]
    found = pages.classify_pages(spark.createDataFrame(rows, "doc string, page int, chars long, n_blocks long, images int, image_area double")).orderBy("page").collect()
    assert [r["class"] for r in found] == ["empty", "scanned", "scanned", "mixed", "text", "text"]
    assert [r["warning"] is not None for r in found[1:3]] == [False, True]


def test_layout_plan(spark):
    rows = [("d", 1, "a", "x" * 10, [10.0], 50.0, 100.0, 250.0, 112.0, 800.0), ("d", 1, "b", "y" * 400, [10.0], 50.0, 130.0, 250.0, 142.0, 800.0), ("d", 1, "c", "z" * 9000, [None], 50.0, 700.0, 250.0, 712.0, 800.0)]
    b = spark.createDataFrame(rows, "doc string, page int, block_id string, translated string, sizes array<double>, x0 double, y0 double, x1 double, y1 double, page_h double")
    plan = {r["block_id"]: r for r in layout.plan_layout(b, LayoutOptions(expand=True)).collect()}
    assert plan["a"]["font_size"] == 10 and plan["b"]["expanded"] and plan["c"]["overflow"] and plan["c"]["font_first"] == 11
    ladder = spark.range(1).select(layout.font_ladder(F.lit(7.1), LayoutOptions()).alias("l")).first()["l"]
    assert ladder == [7.1, 6.6, 6.1, 6.0]


def test_timings(spark):
    found = performance.timings(spark.createDataFrame([(3.0,), (1.0,), (2.0,), (-1.0,)], "s double"), "s").first()
    assert tuple(found) == (3, 1.0, 2.0, 3.0, 3.0)
    assert tuple(performance.timings(spark.createDataFrame([], "s double"), "s").first()) == (0, None, None, None, None)


def test_findings_and_statuses(spark):
    rows = [("a", "See 12 kg at https://x.y/z", "RU See 12 kg at https://x.y/z", ["12 kg"], 1, 1, False), ("b", "Take 12 and 12", "RU Take 12", [], 1, 2, True), ("c", "Same text", "same  text", [], 1, 1, False)]
    s = spark.createDataFrame(rows, "sample_id string, source string, output string, protected array<string>, n_segments int, n_outputs int, forced boolean")
    found = quality.analyse(s)
    codes = {(r["sample_id"], r["code"]): r["evidence"] for r in found.collect()}
    assert set(codes) == {("b", "number-damaged"), ("b", "segment-count-mismatch"), ("b", "forced-segmentation"), ("c", "untranslated-output")} and codes["b", "number-damaged"] == ["12"]
    assert {r["sample_id"]: r["status"] for r in quality.statuses(s, found).collect()} == {"a": "passed", "b": "failed", "c": "failed"}


def test_batches(spark):
    files = spark.createDataFrame([("x", "a", None), ("x", "b", "translation_failed"), ("x", "c", None)], "batch string, path string, error string")
    stop = reports.first_failures(files, False)
    assert [r["outcome"] for r in stop.orderBy("path").collect()] == ["ok", "failed", "not_run"]
    assert reports.batch_summary(reports.first_failures(files, True), "batch").first()["status"] == "partial"
    assert [r[0] for r in files.select(reports.exit_code(F.col("error"))).collect()] == [0, 6, 0]


def test_totals_from_groups(blocks):
    """Counts of kinds from the groups are those of all labelled blocks, also with nothing repeated and in mode off."""
    rows = [(k, j, *row) for k in range(1, 6) for j, row in enumerate([("Company manual", 50, 20, 550, 34, 10), (f"Page text {'abcde'[k - 1]}.", 50, 150, 550, 164, 10), ("DRAFT", 220, 320, 380, 350, 28), (str(k), 290, 770, 310, 784, 10), (str(k), 20, 770, 40, 784, 10)])]
    for some, o in ((rows, repeated.RepeatedOptions()), (rows[:3], repeated.RepeatedOptions()), ([], repeated.RepeatedOptions()), (rows, repeated.RepeatedOptions(mode="off"))):
        b = blocks(some)
        assert sorted(map(tuple, repeated.kind_totals(b, o).collect())) == sorted(map(tuple, repeated.kind_counts(repeated.classify_repeated(b, o)).collect()))
