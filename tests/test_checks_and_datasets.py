import json

import pytest
from pyspark.sql import functions as F

from quire.operators import checks
from quire.operators.quality import analyse_trace, compare_with_baseline, finding_changes, stage_summary
from quire.operators.reports import defects, invariants, validation_summary, with_reviews
from quire.operators.translate import finish_units, plan_units, policies, run_counters, translate_misses
from quire.plans.options import LayoutOptions, ParagraphOptions, RepeatedOptions, TranslationOptions, from_environment, from_settings, identity
from quire.sources import datasets, files
from quire.sources.files import Memory


def test_generated_set_counts(spark):
    for documents, hits in ((1, 58), (3, 258)):
        units = datasets.paragraph_set(spark, documents)
        planned = plan_units(units, None, TranslationOptions(token_limit=512))
        c = run_counters(finish_units(planned, translate_misses(planned.where("status = 'miss'"), TranslationOptions(token_limit=512)))).first()
        assert (c["n_misses"], c["n_hits"], c["n_skipped"]) == (42, hits, 20 * documents)
    assert datasets.length_class(units, "short").count() and datasets.length_class(units, "long").count()
    with pytest.raises(ValueError):
        datasets.length_class(units.limit(0), "short")


def test_layout_differences(spark):
    schema = "doc string, page int, ord int, text string, x0 double, y0 double, x1 double, y1 double"
    a = spark.createDataFrame([("d", 1, 0, "t", 0.0, 0.0, 1.0, 1.0), ("d", 1, 1, "u", 0.0, 0.0, 1.0, 1.0), ("d", 1, 2, "v", 0.0, 0.0, 1.0, 1.0)], schema)
    b = spark.createDataFrame([("d", 1, 0, "t", 0.4, 0.0, 1.0, 1.0), ("d", 1, 1, "u", 0.6, 0.0, 1.0, 1.0), ("d", 1, 3, "v", 0.0, 0.0, 1.0, 1.0)], schema)
    assert {(r["ord"], r["problem"]) for r in checks.layout_differences(a, b).collect()} == {(1, "box"), (2, "not stored"), (3, "gone")}


def test_references_and_sources(spark):
    a, b = spark.createDataFrame([("x",), ("y",)], "id string"), spark.createDataFrame([("x",), ("X",)], "id string")
    assert [r["id"] for r in checks.dangling(a, b, "id").collect()] == ["y"] and [r["id"] for r in checks.repeated_ids(b, "id").collect()] == ["x"]
    scan = "path string, file_size long, sha256 string"
    assert checks.changed_sources(spark.createDataFrame([("p", 1, "a"), ("q", 1, "a")], scan), spark.createDataFrame([("p", 1, "b"), ("q", 1, "a")], scan)).count() == 1
    docs = spark.createDataFrame([("a/b.pdf", "one", ["big"]), ("c.pdf", "two", [])], "path string, id string, categories array<string>")
    assert [r[0] for r in docs.orderBy("id").select(checks.in_subset(F.col("path"), F.col("id"), F.col("categories"), ("two", "big", "*.pdf"))).collect()] == ["big", "two"]
    assert [r[0] for r in checks.unmatched_selectors(docs, ("two", "none", "x*")).collect()] == ["none", "x*"]
    assert checks.code_points(spark.createDataFrame([("bab",)], "t string"), "t").first()["characters"] == ["a", "b"]
    run, units = spark.createDataFrame([("i",)], "identity string"), spark.createDataFrame([("1", "t")], "unit_id string, text string")
    assert checks.resumable(run, units, units, "i").count() == 0 and checks.resumable(run, units, units.limit(0), "j").count() == 2


def test_files_in_and_out(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.pdf").write_bytes(b"one")
    (tmp_path / "b.pdf").write_bytes(b"bad")
    found = files.scan_files(spark, str(tmp_path))
    assert sorted(r["file_size"] for r in found.collect()) == [3, 3]

    def reader(path, content):
        if content == b"bad":
            raise ValueError("broken")
        yield {"page": 1, "text": content.decode()}

    rows = {r["path"].rsplit("/", 1)[1]: (r["error"], r["text"]) for r in files.extract(found, reader, "page int, text string").collect()}
    assert rows == {"a.pdf": (None, "one"), "b.pdf": ("ValueError: broken", None)}
    docs = spark.createDataFrame([("1.3", "d", "s", 3, [], [("p", 1, "body", "t", None)])], files.DOCUMENT)
    files.write_documents(docs, str(tmp_path / "out"))
    assert files.read_documents(spark, str(tmp_path / "out")).first()["paragraphs"][0]["text"] == "t"
    with pytest.raises(Exception, match="(?i)exists"):
        files.write_documents(docs, str(tmp_path / "out"))


def test_datasets(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps({"dataset_version": "1", "samples": [{"id": "a", "source": "Take 5 kg", "protected_tokens": [], "stage_trace": {"observed_translation": "RU Take", "rendered_text": "RU"}}]}))
    s = datasets.read_samples(spark, str(tmp_path / "s.json")).select("sample_id", "source", F.col("stage_trace.extracted_text").alias("extracted"), F.col("stage_trace.observed_translation").alias("observed"), F.col("stage_trace.rendered_text").alias("rendered"), F.col("protected_tokens").alias("protected"))
    found = analyse_trace(s)
    assert {(r["code"], r["stage"]) for r in found.collect()} == {("number-damaged", "model"), ("unit-damaged", "model"), ("rendered-text-changed", "rendering"), }
    assert {r["stage"]: r["n_historical"] for r in stage_summary(found).collect()} == {"model": 2, "rendering": 1}
    (tmp_path / "m.json").write_text(json.dumps({"documents": [{"document_id": "d", "path": "../x.pdf", "categories": []}]}))
    with pytest.raises(Exception, match="inside the corpus"):
        datasets.read_manifest(spark, str(tmp_path / "m.json")).collect()
    table = spark.createDataFrame([(i, None if i % 2 else "a|<b>") for i in range(1500)], "a int, b string")
    lines = [r["value"] for r in datasets.markdown(table, "T", ("a",)).orderBy("place").collect()]
    assert lines[:3] == ["# T", "", "| a | b |"] and len(lines) == 1504 and lines[4:6] == ["| 0 | a\\|<b> |", "| 1 |  |"]
    page = [r["value"] for r in datasets.html(table, "T", ("a",)).orderBy("place").collect()]
    assert page[5] == "<tr><td>0</td><td>a|&lt;b&gt;</td></tr>" and page[-1] == "</table>" and len(page) == 1506
    datasets.write_text(datasets.markdown(table, "T", ("a",)), str(tmp_path / "report"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "report")).collect()] == lines


def test_comparison_and_reviews(spark):
    a, b = spark.createDataFrame([("x", "passed"), ("y", "failed")], "sample_id string, status string"), spark.createDataFrame([("x", "failed"), ("y", "passed"), ("z", "passed")], "sample_id string, status string")
    assert {(r["sample_id"], r["change"]) for r in compare_with_baseline(a, b).collect()} == {("x", "regressed"), ("y", "improved")}
    kind = "sample_id string, stage string, code string"
    assert {(r["sample_id"], r["change"]) for r in finding_changes(spark.createDataFrame([("x", "m", "c")], kind), spark.createDataFrame([("y", "m", "c")], kind)).collect()} == {("x", "resolved"), ("y", "new")}
    docs = spark.createDataFrame([("d", "passed", True, {"render": "failed"}), ("e", "failed", False, {"render": "completed"})], "doc string, status string, source_changed boolean, stages map<string,string>")
    reviewed = with_reviews(docs, spark.createDataFrame([("d", {"look": "fail"})], "doc string, checks map<string,string>"), ("look",))
    assert {r["doc"]: r["manual"] for r in reviewed.collect()} == {"d": "fail", "e": "pending"}
    assert {r["defect"] for r in defects(reviewed).collect()} == {"stage:render", "integrity:source", "manual:look"}
    assert tuple(validation_summary(reviewed).first()) == (1, 1, 0, 1, 0, 1, 1)


def test_invariants_and_policies(spark):
    schema = "doc string, version string, pages array<int>, n_paragraphs int, blocks array<string>, classified array<string>, mapped array<string>, status string, n_done int, n_total int"
    rows = [("ok", "1.3", [1, 2], 1, ["a"], ["a"], ["a"], "completed", 1, 1), ("bad", "1.1", [2, 2], 1, ["a"], ["a", "a"], ["b"], "completed", 0, 1)]
    found = [(r["doc"], r["violation"]) for r in invariants(spark.createDataFrame(rows, schema)).collect()]
    assert {d for d, _ in found} == {"bad"} and len(found) == 5
    blocks = spark.createDataFrame([("d", 1, "a"), ("d", 1, "b"), ("d", 2, "a"), ("d", 3, "z")], "doc string, para int, block_id string")
    known = spark.createDataFrame([("d", "a", "skip"), ("d", "b", "translate")], "doc string, block_id string, policy string")
    assert {r["para"]: r["policy"] for r in policies(blocks, known).collect()} == {1: "preserve", 2: "skip", 3: "translate"}


def test_options():
    for bad in (lambda: RepeatedOptions(margin=0), lambda: RepeatedOptions(mode="x"), lambda: ParagraphOptions(width=2), lambda: LayoutOptions(default_font=1), lambda: TranslationOptions(token_limit=1)):
        with pytest.raises(ValueError):
            bad()
    assert identity(TranslationOptions()) == identity(TranslationOptions()) != identity(TranslationOptions(batch_size=9))


def test_settings(spark, monkeypatch):
    """Session before environment, blank values as none, errors that name what is wrong."""
    monkeypatch.setenv("QUIRE_TOKEN_LIMIT", "99")
    monkeypatch.setenv("QUIRE_BATCH_SIZE", " ")
    monkeypatch.setenv("QUIRE_EXPAND", "False")
    try:
        assert from_settings(TranslationOptions, spark) == TranslationOptions(token_limit=99) == from_environment(TranslationOptions)
        spark.conf.set("spark.quire.token_limit", "12")
        assert from_settings(TranslationOptions, spark).token_limit == 12 and from_environment(TranslationOptions).token_limit == 99
        assert from_settings(LayoutOptions, spark).expand is False
        for key, value, said in (("token_limit", "7", "settings of TranslationOptions: .*8 tokens"), ("token_limit", "many", "spark.quire.token_limit is a value of type int, not 'many'"), ("expand", "maybe", "true or false")):
            spark.conf.set(f"spark.quire.{key}", value)
            with pytest.raises(ValueError, match=said):
                from_settings(LayoutOptions if key == "expand" else TranslationOptions, spark)
    finally:
        for key in ("token_limit", "expand"):
            spark.conf.unset(f"spark.quire.{key}")


def test_a_compacted_memory(spark, tmp_path):
    memory = Memory(spark, str(tmp_path))
    row = lambda k, t, day: spark.createDataFrame([(k, t, f"2024-01-0{day} 00:00:00")], "cache_key string, translated_text string, created_at string").withColumn("created_at", F.to_timestamp("created_at"))
    for n, (k, t, day) in enumerate([("a", "old", 1), ("a", "new", 3), ("b", "one", 2), ("a", "mid", 2)]):
        memory.put(row(k, t, day), f"u{n}" if n % 2 else None)
    want = {("a", "new"), ("b", "one")}
    assert {tuple(r)[:2] for r in memory.read().collect()} == want and len(memory.updates()) >= 4
    assert memory.compact() >= 4 and len(memory.updates()) == 1
    assert {tuple(r)[:2] for r in memory.read().collect()} == want and memory.compact() == 1
    memory.put(row("b", "two", 5), "u9")
    assert {tuple(r)[:2] for r in memory.read().collect()} == {("a", "new"), ("b", "two")}
