"""The thin commands and the validation of a corpus, end to end on small tables."""

import json

from pyspark.sql import functions as F

from quire.__main__ import main
from quire.plans.pipeline import DocumentRun
from quire.plans.validation import validate_corpus


def said(capsys):
    return json.loads(capsys.readouterr().out.strip().splitlines()[-1])


def test_commands(spark, blocks, tmp_path, capsys):
    path = str(tmp_path / "blocks")
    blocks([(1, 0, "Some text of a para-", 50, 150, 550, 164, 10), (1, 1, "graph of a page.", 50, 166, 550, 180, 10), (1, 2, "12", 50, 700, 550, 710, 10)]).write.parquet(path)
    assert main(["doctor"]) == 0 and said(capsys)["pyspark"]
    assert main(["inspect", path, str(tmp_path / "pages")]) == 0 and said(capsys)["text_pages"] == 1
    assert main(["reconstruct", path, str(tmp_path / "paragraphs")]) == 0 and said(capsys)["soft_hyphens"] == 1
    assert main(["translate", path, str(tmp_path / "run"), "hash", "--memory", str(tmp_path / "memory")]) == 0
    assert said(capsys) == {"n_units": 2, "n_skipped": 1, "n_hits": 0, "n_misses": 1, "n_segments": 1}
    (tmp_path / "s.json").write_text(json.dumps({"dataset_version": "1", "samples": [{"id": "a", "category": "x", "source": "Take 5 kg"}, {"id": "b", "category": "x", "source": "Take 5 kg"}]}))
    assert main(["benchmark-translation", str(tmp_path / "s.json"), str(tmp_path / "b1")]) == 0
    assert said(capsys) == {"n_samples": 2, "n_passed": 2, "n_failed": 0, "n_error": 0, "n_hits": 1, "n_misses": 1}
    assert main(["benchmark-translation", str(tmp_path / "s.json"), str(tmp_path / "b2"), "--baseline", str(tmp_path / "b1")]) == 0
    assert main(["inspect", str(tmp_path / "none"), str(tmp_path / "x")]) == 3 and main(["unheard"]) == 2
    assert main(["inspect", path, str(tmp_path / "pages")]) == 3  # never over what is there


def test_validation(spark, blocks, tmp_path):
    manifest = spark.createDataFrame([("one", "a.pdf"), ("two", "b.pdf"), ("three", "c.pdf")], "document_id string, path string")
    scan = lambda h: spark.createDataFrame([("a.pdf", 1, "x"), ("b.pdf", 1, h)], "path string, file_size long, sha256 string")
    rows = blocks([(1, 0, "Some text of a page.", 50, 150, 550, 164, 10)]).withColumn("error", F.lit(None).cast("string"))
    extracted = rows.withColumn("doc", F.lit("a.pdf")).unionByName(rows.withColumns({"doc": F.lit("b.pdf"), "error": F.lit("broken")}))
    reviews = spark.createDataFrame([("one", {"layout": "pass", "terminology": "fail", "completeness": "pass"})], "doc string, checks map<string,string>")
    v = validate_corpus(DocumentRun(spark), manifest, scan("x"), scan("y"), extracted, reviews, str(tmp_path), "h")
    assert {(r["document_id"], r["problem"]) for r in v.problems.collect()} == {("three", "missing")}
    assert {r["doc"]: (r["status"], r["source_changed"], r["manual"]) for r in v.results.collect()} == {"one": ("passed", False, "fail"), "two": ("failed", True, "pending"), "three": ("failed", False, "pending")}
    assert {(r["doc"], r["defect"]) for r in v.found.collect()} == {("one", "manual:terminology"), ("two", "stage:extract"), ("two", "integrity:source")}
    s = v.summary.first()
    assert (s["n_passed"], s["n_failed"], s["n_integrity"], s["n_manual_fail"], s["n_manual_pending"]) == (1, 2, 1, 1, 2)
    assert [r["value"] for r in v.report.orderBy("place").collect()][4:] == ["| one | a.pdf | passed | false | fail | 1 |", "| three | c.pdf | failed | false | pending | 0 |", "| two | b.pdf | failed | true | pending | 2 |"]
    plan = validate_corpus(DocumentRun(spark), manifest, scan("x"), scan("x"), extracted, reviews, str(tmp_path), "h", planned_only=True)
    assert plan.summary.first()["n_planned"] == 3
