import collections
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quire.llm import registry
from quire.llm.op4_mixing import curriculum_plan, training_sequence

DATA = Path("/root/testdata/sf0.001")
STAGES = dict(corpus_pipeline.STAGES)


def test_queries_are_registered():
    assert {q.split("_")[0] for q in registry.queries()} == {f"op{n}" for n in range(1, 14)}
    assert set(registry.oracle_sql()) <= set(registry.queries())


@pytest.mark.skipif(not DATA.exists(), reason="no tables here")
def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    ids, columns = {r["doc_id"] for r in docs.collect()}, docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(DATA)).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        now = [r["doc_id"] for r in docs.collect()]
        assert set(now) <= ids and (name in ("mix", "shard") or len(now) == len(set(now)))
        ids = set(now)
        if name != "shard":
            assert docs.columns == columns
    assert {"shard", "slot", "size"} <= set(docs.columns) and ids


@pytest.mark.skipif(not DATA.exists(), reason="no tables here")
def test_run_cleans_up(spark):
    assert corpus_pipeline.run(spark, str(DATA)).count() > 0
    folder = Path(spark.sparkContext.getCheckpointDir().removeprefix("file:"))
    assert not [p for p in folder.rglob("*") if p.name.startswith("scratch-")]


@pytest.fixture
def tables(spark, tmp_path):
    """Labels and a benchmark for small documents: good ones are prose, bad ones repeat one word."""
    rng = np.random.default_rng(30)
    words = [f"w{i}" for i in range(3000)]
    say = lambda n: " ".join(rng.choice(words, n))
    item = say(40)
    rows = [(i, say(80) + ".", f"s{i % 3}") for i in range(300)] + [(1000 + i, "spam " * 60, "s0") for i in range(100)]
    rows += [(2000 + i, rows[i][1] + " " + say(3), "s1") for i in range(30)] + [(3000 + i, say(30) + " " + item + " " + say(20), "s2") for i in range(5)]
    spark.createDataFrame([(d, int(d < 1000), 0) for d, _, _ in rows if d < 2000], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path), rows


def test_each_stage_does_its_work(spark, tables, documents):
    folder, rows = tables
    docs = documents(rows)
    good = {r["doc_id"] for r in STAGES["quality"](spark, docs, folder).collect()}
    assert good == {d for d, _, _ in rows if not 1000 <= d < 2000}
    docs = docs.where(f"NOT doc_id BETWEEN 1000 AND 1999")
    unique = {r["doc_id"] for r in STAGES["near_dedup"](spark, docs, folder).collect()}
    assert unique == {d for d in good if not 2000 <= d < 3000}
    docs = docs.where("NOT doc_id BETWEEN 2000 AND 2999")
    assert {r["doc_id"] for r in STAGES["decontaminate"](spark, docs, folder).collect()} == {d for d in unique if d < 3000}


def test_shards_follow_the_order_of_training(spark, tables, documents, tmp_path):
    folder, rows = tables
    docs = documents(rows)
    order = [r["doc_id"] for r in training_sequence(docs, curriculum_plan(docs)).collect()]
    STAGES["mix"](spark, docs, folder).write.parquet(str(tmp_path / "mixed"))
    placed = STAGES["shard"](spark, spark.read.parquet(str(tmp_path / "mixed")), folder).collect()
    assert [r["doc_id"] for r in sorted(placed, key=lambda r: (r["shard"], r["slot"]))] == order
    assert len({r["shard"] for r in placed}) == 16


@pytest.mark.parametrize("name", list(STAGES))
def test_awkward_tables(spark, tables, documents, awkward, name):
    """Nulls, empty and long texts, repeated rows, empty tables and columns that clash with those of the operators."""
    folder, _ = tables
    clashing = {c: F.lit("own") for c in ("score", "leaks", "position", "target", "__node", "label", "order", "Shard")}
    docs = awkward.withColumns({k: v for k, v in clashing.items() if name != "shard" or k != "Shard"})
    found = STAGES[name](spark, docs, folder)
    assert found.columns[: len(docs.columns)] == docs.columns if name != "shard" else {"shard", "slot", "size"} <= set(found.columns)
    rows = found.collect()
    assert collections.Counter(r["doc_id"] for r in rows).keys() <= {1, 2, 3, 4, 5, 6, 7, 8, None} and all(r["leaks"] == "own" for r in rows)
    assert len(rows) == 10 if name in ("decontaminate", "shard") else len(rows) <= 20
    assert STAGES[name](spark, documents([]), folder).count() == 0


def test_a_large_group_of_near_copies(spark, documents, tables):
    """Half of all rows are near copies of one text; one of them stays."""
    rng = np.random.default_rng(31)
    base, rows = [f"b{i}" for i in range(200)], []
    for k in range(1500):
        own = list(base)
        own[int(rng.integers(0, 200))] = f"x{k}"
        rows.append((k, " ".join(own), "s"))
    rows += [(5000 + k, " ".join(f"u{i}" for i in rng.integers(0, 9000, 60)), "s") for k in range(1500)]
    kept = [r["doc_id"] for r in STAGES["near_dedup"](spark, documents(rows), "").collect()]
    assert sorted(kept) == [0, *range(5000, 6500)]
