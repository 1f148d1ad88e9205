import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quire.llm import op11_importance as importance
from quire.llm import op12_whitening as whitening
from quire.llm import near_duplicates as near
from quire.llm import op13_ngram_join as joined
from quire.llm.near_duplicates import drop_near_duplicates
from quire.llm.overlap import links_among

LOWER = {c: c + 32 for c in range(65, 91)}


def resampled(docs, target, n=2, buckets=10_000, percent=25, least=20):
    """The contract in plain code. docs: (doc_id, text)."""
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    runs = lambda w: Counter(zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, n + 1) for i in range(len(w) - k + 1))
    corpus, aim = Counter(), Counter()
    for _, t in docs:
        corpus.update(runs(words(t)))
    for t in target:
        aim.update(runs(words(t)))
    total, goal, rows = sum(corpus.values()), sum(aim.values()), []
    for d, t in docs:
        own = runs(words(t))
        size = sum(own.values())
        weight = sum(k * math.floor(1000 * math.log((aim[b] + 1.0) * (total + buckets) / ((corpus[b] + 1.0) * (goal + buckets)))) for b, k in own.items()) // size if size else 0
        h = int(hashlib.sha256(f"7:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        rows.append((d, size, weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words(t)) >= least))
    able = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = percent * len(able) // 100
    ranks = defaultdict(list)
    for k, r in enumerate(able):
        ranks[r].append(k + 1 if k < drawn else None)
    return sorted([(*r[:4], ranks[r].pop() if r[4] else None) for r in rows], key=str)


def test_checksums_join():
    rng, sums = np.random.default_rng(50), importance.Checksums(direct=9)
    pairs = [(rng.bytes(int(a)), rng.bytes(int(b))) for a, b in rng.integers(0, 40, (60, 2))] + [(b"x", b"y" * 5000)]
    of = lambda xs: np.array([zlib.crc32(x) for x in xs], dtype=np.uint32)
    found = sums.joined(of([a for a, _ in pairs]), of([b for _, b in pairs]), np.array([len(b) for _, b in pairs]))
    assert found.tolist() == [zlib.crc32(a + b) for a, b in pairs]


@pytest.mark.parametrize("n", [1, 2, 3])
def test_pieces_lose_no_run(n):
    text = "  " + " ".join(f"w{i % 7}" * (1 + i % 5) for i in range(400)) + " " + "z" * 900 + "  tail"
    words = text.split()
    want = Counter(tuple(words[i : i + k]) for k in range(1, n + 1) for i in range(len(words) - k + 1))
    for most in (1, 30, 200, 5000):
        got = Counter()
        pieces = list(importance.pieces_of(pa.array([text, None, ""]), n, most))
        for row, body, tail in pieces:
            w = body.decode().split()
            got.update(tuple(w[i : i + k]) for i in range(len(w) - tail) for k in range(1, n + 1) if i + k <= len(w))
            assert row == 0 or not w
        assert got == want and (most > 200 or len(pieces) > 5)


@pytest.mark.parametrize("block", [1 << 20, 300])
def test_importance(documents, awkward, monkeypatch, block):
    monkeypatch.setattr(importance, "BLOCK_BYTES", block)
    rng = np.random.default_rng(51)
    rows = [(100 + i, " ".join(f"w{k}" for k in rng.zipf(1.5, int(rng.integers(1, 60))) % 500), "s") for i in range(120)]
    rows += rows[:3] + [(500 + i, rows[0][1], "hot") for i in range(60)]
    docs = documents(rows).unionByName(awkward.where("length(text) < 10000 OR text IS NULL"))
    target = documents([(1, rows[5][1] + " Extra, words", "t"), (2, None, "t")])
    extra = {c: F.lit("own") for c in ("Weight", "score", "place", "able", "buckets", "__file", "doc")}
    got = importance.importance_resample(docs.withColumns(extra), target).collect()
    want = resampled([(r["doc_id"], r["text"]) for r in docs.collect()], [r["text"] for r in target.collect()])
    assert sorted(map(tuple, got), key=str) == want
    assert sum(r["rank"] is not None for r in got) == sum(w[4] is not None for w in want) > 10


def test_importance_of_runs_of_three(documents):
    rows = [(i, " ".join(f"w{(i * k) % 11}" for k in range(i % 5 + (20 if i % 2 else 0))), "s") for i in range(40)]
    got = importance.importance_resample(documents(rows), documents([(1, rows[3][1], "t")]), n=3, buckets=97, percent=60)
    assert sorted(map(tuple, got.collect()), key=str) == resampled([r[:2] for r in rows], [rows[3][1]], 3, 97, 60)


def test_importance_of_empty_tables(documents):
    assert importance.importance_resample(documents([]), documents([(1, "a b", "t")])).count() == 0
    rows = [(i, f"some {i} words " * 10, "s") for i in range(8)]
    assert sorted(map(tuple, importance.importance_resample(documents(rows), documents([])).collect()), key=str) == resampled([r[:2] for r in rows], [])


def plain_whitening(rows, most=16, kind=np.float32):
    """The contract in plain code, for vectors of one length. rows: (vec_id, vector)."""
    rows = [(i, [math.floor(64 * float(kind(c))) + 1_000_000 for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in rows})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    off = lambda x: [n * a - s for a, s in zip(x, sums, strict=True)]
    d = np.array([off(x) for x in fit], dtype=float) / n
    e, v = np.linalg.eigh(d.T @ d / n)
    keep = np.argsort(-e)[: min(most, int((e > 1e-12 * e.max()).sum()))]
    trace = sum(a * a for x in fit for a in off(x)) / n**3
    return {i: (sum(a * a for a in off(x)), (np.array(off(x)) / n) @ v[:, keep] / np.sqrt(e[keep])) for i, x in rows}, n, e[keep] / trace


def embedded(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def test_whitening(spark):
    rng = np.random.default_rng(60)
    base = rng.normal(size=(24, 24)) * np.linspace(3, 0.4, 24)
    rows = [(i, (rng.normal(size=24) @ base + 50).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[7][1]) for i in range(150)]
    rows += [(2000, None), (2001, [None] + [0.5] * 23), (2002, [float("nan")] * 24), (2003, [float("inf")] * 24), (2004, [1.0, 2.0]), (2005, []), (2006, [1e30] * 24)]
    clash = {c: F.lit("own") for c in ("X", "n", "whitened", "deviation", "component", "high")}
    got = whitening.whiten(embedded(spark, rows).withColumns(clash)).collect()
    want, n, explained = plain_whitening(rows[:450])
    assert {r["vec_id"] for r in got} == set(want) and len(got) == 450 and {r["n"] for r in got} == {n}
    signs = np.sign(np.array(got[0]["whitened"]) * want[got[0]["vec_id"]][1])
    for r in got:
        assert r["deviation"] == want[r["vec_id"]][0]
        assert np.allclose(np.array(r["whitened"]) * signs, want[r["vec_id"]][1], rtol=1e-8, atol=1e-9)
        assert np.allclose(r["explained"], explained, rtol=1e-10) and r["identity_error"] < 1e-10


def test_whitening_of_few_directions(spark):
    """Fewer directions than asked for, copies, one vector, equal vectors, no vectors."""
    rows = [(i, [float(i % 5), 2.0 * (i % 5), 7.0, float(i % 3)]) for i in range(30)] + [(None, [9.0, 1.0, 7.0, 0.0])]
    got = whitening.whiten(embedded(spark, rows)).collect()
    want, n, explained = plain_whitening(rows)
    assert len(got) == 31 and all(len(r["whitened"]) == 3 and r["n"] == n and r["deviation"] == want[r["vec_id"]][0] for r in got)
    assert np.allclose(got[0]["explained"], explained) and got[0]["identity_error"] < 1e-9
    for few in ([], [(1, [1.0, 2.0])], [(i, [1.0, 2.0]) for i in range(5)], [(1, None)], [(1, []), (2, [])]):
        assert whitening.whiten(embedded(spark, few)).count() == 0


def test_whitening_of_large_numbers(spark):
    """Deviations beyond 2^63 are exact or null, and their sum is exact."""
    rows = [(i, [float(i) * 1e9, float(i * i % 7), -3e9 * (i % 2)]) for i in range(40)] + [(100 + i, [2e12, 0.0, 0.0]) for i in range(3)]
    schema = "vec_id long, embedding array<double>"
    got = whitening.whiten(spark.createDataFrame(rows, schema)).collect()
    want, _, explained = plain_whitening(rows, kind=float)
    assert all(r["deviation"] == (want[r["vec_id"]][0] if want[r["vec_id"]][0] < 1 << 63 else None) for r in got)
    assert np.allclose(got[0]["explained"][0], explained[0])
    assert any(r["deviation"] is None for r in got)


def plain_components(rows, shingle=5):
    """The contract in plain code. rows: (doc_id, text); ids are distinct."""
    sets = {}
    for d, t in rows:
        w = (t or "").translate(LOWER).encode().split()  # bytes are split at ASCII white space
        sets[d] = {tuple(w[i : i + shingle]) for i in range(max(1, len(w) - shingle + 1))} if w else set()
    label = {d: d for d in sets}

    def top(d):
        while label[d] != d:
            d = label[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = top(a), top(b)
                label[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), top(d)) for d in ids}


@pytest.mark.parametrize("block_bytes", [16 << 20, 8_000])
def test_ngram_join(documents, block_bytes):
    """Copies, near copies around the limit, contiguous edits, a passage that many share, short and empty texts."""
    rng = np.random.default_rng(70)
    say = lambda n: [f"w{i}" for i in rng.integers(0, 2500, n)]
    passage, texts = say(60), []
    for i in range(25):
        base = say(int(rng.integers(30, 160)))
        texts += [base, base[: int(len(base) * 0.82)], base + say(len(base) // 5), base[3:] + say(3)]
        for k in range(4):
            own = list(base)
            for at in rng.choice(len(own), k, replace=False):
                own[at] = f"x{i}{k}"
            texts.append(own)
        texts.append(say(12) + passage + say(int(rng.integers(0, 9))))
    texts += [passage + [f"y{k}"] for k in range(30)] + [texts[0]] * 20 + [w.split() for w in ("a", "a b c d", "A B c d", "a b c d e", "a b c d e f", "a b c d e a b c d e", "a b c d e f a b c d e f")]
    rows = [(10 + k, (" " if k % 3 else "\n\t").join(t), "s") for k, t in enumerate(texts)] + [(1, None, "s"), (2, "", "s"), (3, "", None), (4, " \n ", "s")]
    docs = documents(rows).withColumns({c: F.lit("own") for c in ("node", "Doc", "label", "component_id", "body")})
    got = joined.ngram_join(docs, block_bytes=block_bytes).collect()
    want = plain_components([r[:2] for r in rows])
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want and len(got) == len(rows)
    assert 40 < len({c for _, c in want.values()}) < 150


def test_ngram_join_of_awkward_tables(documents, awkward):
    got = sorted(map(tuple, joined.ngram_join(awkward).collect()), key=str)
    long = len({i % 977 for i in range(30_000 - 4)})
    assert got == sorted([(1, 0, 1), (2, 0, 2), (3, long, 3), (4, 1, 4), (5, 1, 4), (6, 1, 6), (6, 1, 6), (None, 1, None), (7, 0, 7), (8, 1, 8)], key=str)
    assert joined.ngram_join(documents([])).count() == 0


def test_many_short_texts_of_one_template(documents):
    """Texts that differ in one word of twelve aren't similar; none is lost, and the time doesn't grow with their pairs."""
    rows = [(k, f"order number {k} was sent to you today by our usual carrier", "s") for k in range(20_000)]
    assert drop_near_duplicates(documents(rows)).count() == 20_000
    assert joined.ngram_join(documents(rows)).where("component_id <> doc_id").count() == 0


def test_prefixes_are_moved_once(spark, monkeypatch):
    """Whatever the number of shared shingles, a key of a prefix is shuffled once: it is counted and met in the same place."""
    monkeypatch.setattr(near, "small_side", lambda df: near.settle(df).hint("shuffle_hash"))  # as if there were too many to broadcast
    # 2,000 sets of 100, each but the last sharing five of their first shingles with one neighbour
    keys = F.transform(F.sequence(F.lit(0), F.lit(20)), lambda k: F.when(k < 5, F.floor(F.col("id") / 2) * 5 + k).otherwise(1_000_000 + F.col("id") * 21 + k))
    classes = spark.range(1999).select(F.col("id").alias("node"), F.lit(100).alias("size"), keys.alias("keys"))
    with near.scratch(spark):
        classes = near.settle(classes)
        spark.sparkContext.setJobGroup("prefixes", "prefixes")
        got = {(r["cluster"], r["node"]) for r in near._gathered(classes, 0.8).collect()}
        jobs = [spark.sparkContext.statusTracker().getJobInfo(j) for j in spark.sparkContext.statusTracker().getJobIdsForGroup("prefixes")]
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    stages = {s for j in jobs for s in j.stageIds}
    store = spark.sparkContext._jsc.sc().statusStore()
    moved = sum(store.lastStageAttempt(s).shuffleWriteRecords() for s in stages)
    assert got == {(k - k % 2, k) for k in range(1998)}
    first = [store.lastStageAttempt(s).shuffleWriteRecords() for s in stages]
    assert sum(n >= 1999 * 16 for n in first) == 1 and moved < 1.5 * 1999 * 21 + 4 * 1998 * 5


def test_blocks_of_many_sets():
    """Thousands of sets of one template, of a cloud of near copies and of no similar pair."""
    rng = np.random.default_rng(71)
    template = [np.unique(np.concatenate([np.arange(3), 10 + 5 * i + np.arange(5)])) for i in range(4000)]
    assert links_among(template, np.arange(4000), 0.8) == []
    cloud = [np.unique(np.concatenate([np.delete(np.arange(196), slice(k, k + 5)), 1000 + 5 * i + np.arange(5)])) for i, k in enumerate(rng.integers(0, 190, 4000))]
    assert len(links_among(cloud + template, np.arange(8000), 0.8)) == 3999
    loose = [rng.choice(260, 170, replace=False) for _ in range(600)]
    assert links_among(loose, np.arange(600), 0.8) == []
