"""Batch runs that stop and go on, models that workers share, failures by document, and the document source."""

import os
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from quire.operators.translate import ModelRuntime, PrefixTranslator, plan_units, translate_misses, worker_model
from quire.plans.options import TranslationOptions
from quire.plans.pipeline import DocumentRun
from quire.plans.validation import validate_corpus
from quire.sources import document_source as ds
from quire.sources.files import Memory
from quire.streaming.batches import BatchRun

cloudpickle.register_pickle_by_value(sys.modules[__name__])
UNITS = "unit_id string, unit_order int, text string, policy string"


class Fussy(PrefixTranslator):
    """Fails on a batch that holds a bad text."""

    def translate_batch(self, texts):
        if any("bad" in t for t in texts):
            raise RuntimeError("bad text")
        return super().translate_batch(texts)


class Other(PrefixTranslator):
    pass


def units_of(spark, n, text="text number {}"):
    return spark.createDataFrame([(f"u{i}", i, text.format(i % (n - 5)), "translate") for i in range(n)] + [("s", n, "42", "translate"), ("k", n + 1, "kept as it is", "preserve")], UNITS)


def test_a_stopped_run_goes_on(spark, tmp_path):
    units, folder = units_of(spark, 45), str(tmp_path / "run")
    memory = Memory(spark, str(tmp_path / "memory"))
    make = lambda: BatchRun(spark, folder, TranslationOptions(batch_size=4), per_batch=7, memory=memory)
    first = make()
    assert first.run(units, most=2) == "interrupted"
    at = first.progress()
    assert at["status"] == "interrupted" and at["of"] == 40 and at["batches"] == 2 and 0 < at["texts"] <= 14
    stood = {p: os.stat(p).st_mtime_ns for p in map(str, (tmp_path / "run/run/done").rglob("part-*"))}
    part = {r["status"]: r["count"] for r in first.result().groupBy("status").count().collect()}
    assert part["pending"] >= 26 and part["skipped"] == 2
    again = make()
    again.request_stop()
    assert again.run(units) == "completed"  # an old request doesn't count
    end = again.progress()
    assert end["status"] == "completed" and end["texts"] == end["of"] == 40 and end["failed"] == 0 and end["peak_mb"] > 1
    assert {p: os.stat(p).st_mtime_ns for p in stood} == stood
    log = again.log().collect()
    assert sum(r["segments"] for r in log) == 40 and sum(r["calls"] for r in log) < 40 and all(r["texts"] <= 7 for r in log)
    rows = {r["unit_id"]: (r["status"], r["translated"]) for r in again.result().collect()}
    assert rows["s"] == ("skipped", "42") and rows["k"] == ("skipped", "kept as it is") and rows["u3"] == ("miss", "RU text number 3") and rows["u43"] == ("hit", "RU text number 3") and len(rows) == 47
    assert memory.read().count() == 40
    assert make().run(units) == "completed" and make().progress()["batches"] == end["batches"]


def test_a_request_ends_a_run(spark, tmp_path):
    run = BatchRun(spark, str(tmp_path), per_batch=1)
    units = units_of(spark, 8)
    run.plan(units)
    kept, seen = run._exists, []
    run._exists = lambda name: (seen.append(name), run.request_stop() if len(seen) == 3 else None, kept(name))[2]
    assert run.run(units) == "interrupted" and run.progress()["batches"] == 2
    run._exists = kept
    assert run.run(units) == "completed" and run.progress()["texts"] == 3
    with pytest.raises(ValueError, match="one text or more"):
        BatchRun(spark, str(tmp_path), per_batch=0)


def test_texts_that_fail_are_rows(spark, tmp_path):
    units = spark.createDataFrame([(f"u{i}", i, f"a {'bad' if i % 4 == 0 else 'good'} text {'x' * i}", "translate") for i in range(12)], UNITS)
    run = BatchRun(spark, str(tmp_path), translator=Fussy, per_batch=5)
    assert run.run(units) == "completed" and run.progress()["failed"] == 3
    rows = {r["unit_id"]: r for r in run.result().collect()}
    assert all((rows[f"u{i}"]["status"] == "failed") == (i % 4 == 0) for i in range(12))
    assert rows["u0"]["error"] == "RuntimeError: bad text" and rows["u0"]["translated"] is None and rows["u1"]["translated"] == "RU a good text x"


def test_one_model_for_a_process():
    sys.modules.pop("quire_worker_model", None)
    one = worker_model(PrefixTranslator, "a")
    assert worker_model(PrefixTranslator, "a") is one and sys.modules["quire_worker_model"].made == 1
    assert worker_model(Other, "b") is not one and sys.modules["quire_worker_model"].made == 2
    sys.modules.pop("quire_worker_model")


def test_a_shared_model_refuses_other_options(spark):
    runtime = ModelRuntime(PrefixTranslator, TranslationOptions())
    planned = plan_units(units_of(spark, 8), None, TranslationOptions())
    assert translate_misses(planned.where("status = 'miss'"), TranslationOptions(batch_size=2), runtime).count() == 3
    with pytest.raises(ValueError, match="another model, token_limit"):
        translate_misses(planned, TranslationOptions(model="m", token_limit=9), runtime)
    assert "quire_worker_model" not in sys.modules  # the driver made none


def test_a_document_that_fails_in_translation(spark, blocks, tmp_path):
    page = blocks([(1, 0, "Some text of a page.", 50, 150, 550, 164, 10)]).withColumn("error", F.lit(None).cast("string"))
    rows = page.withColumn("doc", F.lit("a")).unionByName(page.withColumns({"doc": F.lit("b"), "text": F.lit("A bad text of a page.")})).unionByName(page.withColumns({"doc": F.lit("c"), "error": F.lit("ValueError: no file")})).unionByName(page.withColumns({"doc": F.lit("d"), "text": F.lit("Other text.")}))
    made = DocumentRun(spark, translator=Fussy).batch(rows, str(tmp_path / "a"), "h1")
    assert {r["path"]: (r["outcome"], r["failed_stage"]) for r in made["files"].collect()} == {"a": ("ok", None), "b": ("failed", "translated"), "c": ("failed", "extract"), "d": ("ok", None)}
    assert {r["doc"] for r in made["layout"].collect()} == {"a", "d"} and made["summary"].first()["status"] == "partial"
    manifest = spark.createDataFrame([(d.upper(), d) for d in "abcd"], "document_id string, path string")
    scan = spark.createDataFrame([(d, 1, "h") for d in "abcd"], "path string, file_size long, sha256 string")
    reviews = spark.createDataFrame([], "doc string, checks map<string,string>")
    found = validate_corpus(DocumentRun(spark, translator=Fussy), manifest, scan, scan, rows, reviews, str(tmp_path / "b"), "h2")
    stages = {r["doc"]: r["stages"] for r in found.results.collect()}
    assert stages["A"] == dict.fromkeys(("extract", "units", "translated", "layout"), "passed")
    assert stages["B"] == {"extract": "passed", "units": "passed", "translated": "failed", "layout": "not_run"}
    assert stages["C"] == {"extract": "failed", "units": "not_run", "translated": "not_run", "layout": "not_run"}
    assert {r["defect"] for r in found.found.where("doc = 'B'").collect()} >= {"stage:translated"}


def test_documents_by_page(spark, blocks, tmp_path):
    names = ("a", "b/c d", "ü", "_hidden")
    rows = blocks([(p, k, f"page {p} block {k} ü", 10, 20 * k, 90, 20 * k + 10, 9) for p in range(1, 9) for k in range(3)])
    every = rows.where("false")
    for n in names:
        every = every.unionByName(rows.withColumn("doc", F.lit(n)))
    folder = str(tmp_path / "docs")
    ds.write_documents(every, folder)
    assert sorted(p.name for p in (tmp_path / "docs").iterdir()) == sorted(map(ds.file_name, names)) and [ds.document_name(ds.file_name(n)) for n in names] == list(names)
    back = ds.read_documents(spark, folder)
    assert sorted(map(tuple, back.select(every.columns).collect())) == sorted(map(tuple, every.collect()))
    assert {r["page"] for r in ds.read_documents(spark, folder, "2,4-5,8-").collect()} == {2, 4, 5, 8}
    some = back.where("doc IN ('a', 'ü') AND page >= 3 AND page < 5 AND ord = 1").select("doc", "page", "text")
    assert sorted(map(tuple, some.collect())) == [(d, p, f"page {p} block 1 ü") for d in ("a", "ü") for p in (3, 4)]
    assert back.where("doc = 'none'").count() == 0 and back.where("doc LIKE 'b%' AND page = 1").count() == 3
    # what a filter excludes isn't opened: neither other documents nor other pages
    (tmp_path / "docs" / ds.file_name("b/c d")).write_bytes(b"broken")
    broken = tmp_path / "docs" / "a.pages"
    data = broken.read_bytes()
    broken.write_bytes(data[:-40] + b"x" * 40)  # the last page
    assert back.where("doc = 'a' AND page <= 7").count() == 21
    with pytest.raises(Exception, match="JSON|Expecting|json"):
        back.where("doc = 'a'").collect()
    with pytest.raises(Exception, match="stored already: a"):
        ds.write_documents(rows.withColumn("doc", F.lit("a")), folder)
    ds.write_documents(rows.withColumn("doc", F.lit("z")), folder, overwrite=True)
    assert [p.name for p in (tmp_path / "docs").iterdir()] == ["z.pages"]
    with pytest.raises(Exception, match="a document and a page"):
        ds.write_documents(rows.withColumn("page", F.lit(None).cast("int")), folder)
    assert [p.name for p in (tmp_path / "docs").iterdir()] == ["z.pages"] and ds.read_documents(spark, folder).count() == 24


def test_filters_that_are_taken():
    from pyspark.sql.datasource import EqualTo, GreaterThan, In, IsNotNull, LessThan

    r = ds.DocumentReader("x", ds.Wanted())
    rest = [IsNotNull(("doc",)), EqualTo(("text",), "a"), EqualTo(("page",), 2.5)]
    assert list(r.pushFilters([EqualTo(("doc",), "a"), In(("doc",), ("a", "b")), GreaterThan(("page",), 2), LessThan(("page",), 9), *rest])) == rest
    assert r.wanted == ds.Wanted(docs={"a"}, low=3, high=8) and r.wanted.document("a") and not r.wanted.document("b") and [p for p in range(12) if r.wanted.page(p)] == [3, 4, 5, 6, 7, 8]
    for wrong in ("0", "3-2", "a", "-3", "1,,2"):
        with pytest.raises(ValueError, match="page range"):
            ds.page_ranges(wrong)
