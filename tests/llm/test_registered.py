"""The registered queries on whole small tables, column by column, against SQL or plain code."""

import collections
import hashlib
import re
from pathlib import Path

import duckdb
import numpy as np
import pytest

from quire.llm import op10_quality as quality
from quire.llm import registry
from quire.llm.op8_simhash import hashes_of
from quire.llm.op9_decontaminate import WINDOW, common_length

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no tables here")
QUERIES, SQL = registry.queries(), registry.oracle_sql()
LOWER = {c: c + 32 for c in range(65, 91)}


@pytest.fixture(scope="module")
def documents(spark):
    return [(r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, name):
    c = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    df = QUERIES[name](spark, str(DATA))
    columns = sorted(df.columns)
    want = c.execute("SELECT " + ", ".join(f'"{x}"' for x in columns) + f" FROM ({SQL[name]})").fetchall()
    assert sorted(map(tuple, df.select(*columns).collect()), key=str) == sorted(map(tuple, want), key=str)


def test_secrets(spark, documents):
    """Base spans of a plain scan; the method's own spans come beside them."""
    words = r"(?i:password|passwd|secret|token|api_?key)"
    rules = (("assign", words + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[1]) >= 12), ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 18), ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 16))
    found = {r["doc_id"]: r for r in QUERIES["op5_secrets"](spark, str(DATA)).collect()}
    assert set(found) == {d for d, _ in documents}
    total = 0
    for doc, text in documents:
        spans = sorted((m.start(), k, m.end()) for k, (_, p, ok) in enumerate(rules) for m in re.finditer(p, text, re.ASCII) if ok(m))
        said = ",".join(f"{rules[k][0]}:{a}:{b}" for a, k, b in spans)
        r = found[doc]
        assert r["base_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(k == i for _, k, _ in spans) for i in range(3))
        assert set(filter(None, said.split(","))) <= set(filter(None, r["spans"].split(",")))
        total += len(spans)
    assert total


def test_neighbours(spark):
    rows = [(r["vec_id"], np.array(r["embedding"], dtype=float)) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()]
    found = QUERIES["op7_ann"](spark, str(DATA)).collect()
    score = lambda x, y: float((x * y).sum() / (np.sqrt((x * x).sum()) * np.sqrt((y * y).sum())))
    by_id = dict(rows)
    assert all(r["score"] == pytest.approx(score(by_id[r["query_id"]], by_id[r["vec_id"]]), abs=1e-12) for r in found)
    want = {(q, i) for q, x in rows if q % 50 == 0 for _, i in sorted((-round(score(x, y), 12), i) for i, y in rows if i != q)[:5]}
    assert len({(r["query_id"], r["vec_id"]) for r in found} & want) >= 0.9 * len(want) and len(found) == len(want)


def test_fingerprints_and_components(spark, documents):
    prints = {}
    for doc, text in documents:
        h = np.array(hashes_of(re.findall(rb"[^\x20\x09-\x0D]+", text.translate(LOWER).encode()), 3), dtype=np.uint64)
        prints[doc] = sum(1 << b for b in range(64) if len(h) and 2 * int(((h >> np.uint64(b)) & np.uint64(1)).sum()) > len(h))
    label = {d: d for d in prints}
    changed = True
    while changed:
        changed = False
        for a in prints:
            for b in prints:
                if (prints[a] ^ prints[b]).bit_count() <= 2 and label[b] < label[a]:
                    label[a], changed = label[b], True
    found = QUERIES["op8_simhash"](spark, str(DATA)).collect()
    assert sorted((r["doc_id"], r["fingerprint"], r["component_id"]) for r in found) == sorted((d, f"{p:016x}", label[d]) for d, p in prints.items())


def test_contaminated_documents(spark, documents):
    """Whole items with at most a fifth of their words missing, against an exhaustive scan; every reported item has a stretch that a check accepts."""
    words = lambda t: re.findall(r"[0-9a-z\u0080-\U0010ffff]+", t.translate(LOWER))
    items = {r["item_id"]: words(r["text"]) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect() if r["text"]}
    found = {r["doc_id"]: r for r in QUERIES["op9_decontaminate"](spark, str(DATA)).collect()}
    assert set(found) == {d for d, _ in documents}
    number = collections.defaultdict(lambda: len(number))
    for doc, text in documents:
        w, r = [number[x] for x in words(text)], found[doc]
        said = {int(x) for x in r["items"].split(",") if x}
        assert r["n_items"] == len(said) and r["contaminated"] == bool(said)
        for item, own in items.items():
            n = [number[x] for x in own]
            best = max((common_length(n, w[i : i + 2 * len(n)]) for i in range(0, max(1, len(w)), max(1, len(n) // 2))), default=0) / max(1, len(n))
            if best >= 0.8:
                assert item in said
            elif item in said:  # a paraphrase or an excerpt
                assert best >= min(0.5, 0.5 * WINDOW / len(n))


def test_scores(spark, documents):
    found = QUERIES["op10_quality"](spark, str(DATA)).collect()
    out = lambda d: __import__("zlib").crc32(str(d).encode()) % 3 == 1
    assert sorted((r["doc_id"], r["held_out"]) for r in found) == sorted((d, out(d)) for d, _ in documents)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in found)
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    held = [(r["predicted"], labels[r["doc_id"]]) for r in found if r["held_out"] and r["doc_id"] in labels]
    assert np.mean([p == y for p, y in held]) > 0.8


def test_pairwise_sums():
    """The sum-of-squares form against all pairs of features."""
    rng = np.random.default_rng(40)
    size = quality.BUCKETS + quality.STATISTICS
    model = quality.FactorisationMachine(0.3, rng.normal(size=size), rng.normal(size=(size, quality.FACTORS)), np.zeros(quality.STATISTICS), np.ones(quality.STATISTICS))
    buckets = rng.integers(0, quality.BUCKETS, 30)
    x = quality.Features(np.array([0, 10, 10, 30]), buckets, rng.normal(size=30), np.clip(rng.normal(size=(3, quality.STATISTICS)), -4, 4))
    for row, (a, b) in enumerate(((0, 10), (10, 10), (10, 30))):
        at = np.concatenate([buckets[a:b], np.arange(quality.BUCKETS, size)])
        v = np.concatenate([x.values[a:b], x.stats[row]])
        plain = 0.3 + model.linear[at] @ v + sum(model.factors[at[i]] @ model.factors[at[j]] * v[i] * v[j] for i in range(len(at)) for j in range(i))
        assert model.margins(x)[row] == pytest.approx(plain)


def test_the_sample_is_bounded_in_rows(spark):
    """A repeated doc_id counts once, whatever its copies."""
    schema = "doc_id long, text string, n_chars long"
    docs = spark.createDataFrame([(i % 4, f"text {i % 4} {i}" * (1 + i % 2), 5) for i in range(400)], schema)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(4)], "doc_id long, quality int, toxic int")
    taken = []
    train, quality.train = quality.train, lambda x, y: taken.append(len(y)) or None
    try:
        quality.fit_quality(docs, labels, sample=4)
    finally:
        quality.train = train
    assert taken and taken[0] <= 4
