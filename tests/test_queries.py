"""Every query against its SQL on the small tables, and the plan of a whole document run."""

from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

import quire.table_queries  # noqa: F401  registers its queries
from quire.plans.pipeline import DocumentRun
from quire.queries import QUERIES, SQL
from quire.sources.files import Workspace

DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def tables():
    c = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.skipif(not DATA.exists(), reason="no tables here")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, tables, name):
    df = QUERIES[name](spark, str(DATA))
    columns = sorted(df.columns)
    rows = sorted((tuple(r) for r in df.select(*[f"`{c}`" for c in columns]).collect()), key=str)
    if name in SQL:
        want = tables.execute("SELECT " + ", ".join(f'"{c}"' for c in columns) + f" FROM ({SQL[name]})").fetchall()
        assert rows == sorted((tuple(r) for r in want), key=str)


def test_document_run(spark, blocks, tmp_path):
    rows = [(k, j, *row) for k in range(1, 5) for j, row in enumerate([("Company manual", 50, 20, 550, 34, 10), (f"The body of page {'abcd'[k - 1]} ends here.", 50, 150, 550, 164, 10), (str(k), 290, 770, 310, 784, 10)])]
    run = DocumentRun(spark)
    made = run.run(blocks(rows), str(tmp_path), "hash")
    status = {r["status"]: r["count"] for r in made["translated"].groupBy("status").count().collect()}
    assert status == {"miss": 5, "hit": 3, "skipped": 4}
    assert made["layout"].where("overflow").count() == 0
    assert run.run(blocks(rows), str(tmp_path), "hash")["units"].count() == made["units"].count()
    space = Workspace(spark, str(tmp_path), run.run_id("hash"), run.facts("hash"))
    assert {(r["stage"], r["status"]): r["count"] for r in space.log().groupBy("stage", "status").count().collect()} == {(s, k): 1 for s in ("units", "translated", "layout") for k in ("passed", "reused")}
    with pytest.raises(ValueError, match="model, token_limit"):
        Workspace(spark, str(tmp_path), run.run_id("hash"), run.facts("hash") | {"model": "other", "token_limit": "8"})
    with pytest.raises(ZeroDivisionError):
        space.stage("broken", lambda: 1 / 0)
    assert [r["error"] for r in space.log().where("status = 'failed'").collect()] == ["ZeroDivisionError: division by zero"]


def test_batch_goes_on_without_broken_files(spark, blocks, tmp_path):
    rows = blocks([(1, 0, "Some text of a page.", 50, 150, 550, 164, 10)]).withColumn("error", F.lit(None).cast("string"))
    both = rows.unionByName(rows.withColumns({"doc": F.lit("broken"), "error": F.lit("ValueError: no file")})).unionByName(rows.withColumn("doc", F.lit("z")))
    made = DocumentRun(spark).batch(both, str(tmp_path / "a"), "h1")
    assert {r["path"]: r["outcome"] for r in made["files"].collect()} == {"broken": "failed", "d": "ok", "z": "ok"}
    assert {r["doc"] for r in made["translated"].collect()} == {"d", "z"} and made["summary"].first()["status"] == "partial"
    stopped = DocumentRun(spark).batch(both, str(tmp_path / "b"), "h2", continue_on_error=False)
    assert {r["path"]: r["outcome"] for r in stopped["files"].collect()} == {"broken": "failed", "d": "not_run", "z": "not_run"}
    assert stopped["summary"].first()["exit_code"] == 10 and stopped["translated"].count() == 0
