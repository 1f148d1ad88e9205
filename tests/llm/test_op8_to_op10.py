import collections
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import op9_decontaminate as leaks
from quire.llm.graph import components
from quire.llm.near_duplicates import _gathered, candidates_among, drop_near_duplicates
from quire.llm.op8_simhash import Part, group_bits, hashes_of, majority, plan_partitions, simhash_groups, simhash_links
from quire.llm.op10_quality import fit_quality, held_out, score_quality
from quire.llm.overlap import links_among

LOWER = {c: c + 32 for c in range(65, 91)}


def union(pairs, nodes):
    parent = {n: n for n in nodes}

    def top(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in pairs:
        x, y = top(a), top(b)
        parent[max(x, y)] = min(x, y)
    return {n: top(n) for n in nodes}


@pytest.mark.parametrize("small", [1 << 18, 0])
def test_components(spark, small):
    rng = np.random.default_rng(6)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (240, 2))] + [(i, i + 1) for i in range(1000, 1040)] + [(2000, i) for i in range(2001, 2050)]
    want = union(edges, {n for e in edges for n in e})
    found = dict(components(spark.createDataFrame(edges, "u long, v long"), small).collect())
    assert all(found.get(n, n) == label for n, label in want.items())
    assert components(spark.createDataFrame([], "u long, v long"), small).count() == 0


@pytest.mark.parametrize(("tau", "bucket"), [(2, 512), (2, 3), (1, 512), (0, 512), (3, 512), (3, 24), (5, 40)])
def test_links_against_all_pairs(spark, tau, bucket):
    rng = np.random.default_rng(7)
    base = rng.integers(0, 1 << 63, 40)
    prints = sorted({int(b) ^ sum(1 << int(k) for k in rng.choice(63, int(rng.integers(0, 4)), replace=False)) for b in base for _ in range(12)})
    want = union([(a, b) for i, a in enumerate(prints) for b in prints[:i] if (a ^ b).bit_count() <= tau], prints)
    df = spark.createDataFrame([(p,) for p in prints], "fingerprint long")
    found = dict(components(simhash_links(df, tau, bucket)).collect())
    assert {p: found.get(p, p) for p in prints} == want


def test_plan_covers_the_threshold(spark):
    df = spark.createDataFrame([(int(x),) for x in np.random.default_rng(8).integers(0, 1 << 62, 500)], "fingerprint long")
    for tau in (0, 2, 10, 24, 40, 63):
        parts = plan_partitions(df, tau)
        bits = [b for p in parts for b in p.bits]
        assert len(bits) == len(set(bits)) and sum(p.threshold + 1 for p in parts) >= tau + 1 and all(isinstance(p, Part) for p in parts)
    for tau in (-1, 64):
        with pytest.raises(ValueError, match="tau is from 0 to 63"):
            plan_partitions(df, tau)
    both = np.ones((64, 64)) * 25 + np.eye(64) * 25
    both[0, 63] = both[63, 0] = 50
    assert any({0, 63} <= set(g) for g in group_bits(100, both, 4))


def test_simhash_groups(documents, awkward):
    rng = np.random.default_rng(9)
    texts = [" ".join(rng.choice([f"w{i}" for i in range(50)], 60)) for _ in range(20)]
    docs = documents([(100 + i, t if i % 3 else t.upper(), "s") for i, t in enumerate(texts * 3)]).unionByName(awkward).withColumn("fingerprint", F.lit("clash"))
    rows = docs.select("doc_id", "text").collect()
    prints = [majority(hashes_of((r["text"] or "").encode().translate(bytes(LOWER.get(i, i) for i in range(256))).split(), 3)) for r in rows]
    labels = union([(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2], range(len(rows)))
    least = {}
    for i, r in enumerate(rows):
        if r["doc_id"] is not None:
            least[labels[i]] = min(least.get(labels[i], r["doc_id"]), r["doc_id"])
    want = collections.Counter((r["doc_id"], prints[i], least.get(labels[i])) for i, r in enumerate(rows))
    assert collections.Counter((r[0], r[1] & (1 << 64) - 1, r[2]) for r in simhash_groups(docs).collect()) == want
    assert simhash_groups(documents([])).count() == 0


@pytest.mark.parametrize("block_bytes", [16 << 20, 20_000])
def test_near_duplicates(documents, awkward, block_bytes):
    rng = np.random.default_rng(10)
    vocabulary = np.array([f"w{i}" for i in range(3000)])
    rows, texts = [], [list(rng.choice(vocabulary, 300)) for _ in range(30)]
    for i, words in enumerate(texts):
        for k in range(4):
            w = list(words)
            for at in rng.choice(300, k, replace=False):
                w[at] = "changed"
            rows.append((100 + 4 * i + k, " ".join(w), "s"))
    sets = {d: {tuple(t.split()[j : j + 5]) for j in range(296)} for d, t, _ in rows}
    pairs = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    want = set(union(pairs, sets).values())
    kept = drop_near_duplicates(documents(rows), block_bytes=block_bytes).collect()
    assert {r["doc_id"] for r in kept} == want and len(kept) == len(want)
    left = drop_near_duplicates(awkward).collect()
    assert sorted((r["doc_id"] for r in left), key=str) == sorted([1, 3, 4, 6, None, 8], key=str)
    assert drop_near_duplicates(documents([])).count() == 0


@pytest.mark.parametrize("block_bytes", [16 << 20, 20_000])
def test_near_duplicates_with_contiguous_edits(documents, block_bytes):
    """Appended, cut and replaced blocks, down to a similarity of 0.8 and just below, against all pairs."""
    rng = np.random.default_rng(15)
    say = lambda n: [f"w{i}" for i in rng.integers(0, 5000, n)]
    common, rows = say(12), []
    for i in range(60):
        own = say(200 + i) + common
        n = len(own) - 4
        for cut in (int(n / 4) - 1, int(n / 4), int(n / 4) + 1, n // 5, n // 9 - 5):
            rows += [own + say(cut), own[:-cut] if i % 2 else own[cut:], say(cut) + own[cut:]][i % 3 : i % 3 + 1]
        rows.append(own)
    rows = [(k, " ".join(rows[k]), "s") for k in range(len(rows))]
    sets = {d: {tuple(t.split()[j : j + 5]) for j in range(len(t.split()) - 4)} for d, t, _ in rows}
    pairs = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert sorted(r["doc_id"] for r in drop_near_duplicates(documents(rows), block_bytes=block_bytes).collect()) == sorted(set(union(pairs, sets).values()))


@pytest.mark.parametrize(("copies", "block_bytes"), [(700, 16 << 20), (700, 60_000)])
def test_near_copies_of_one_text(spark, documents, copies, block_bytes):
    """A cloud of copies with a few changed words each: many pairs just below and above the limit, and outliers."""
    rng = np.random.default_rng(18)
    base, rows = [f"w{i}" for i in rng.integers(0, 4000, 200)], []
    for k in range(copies):
        own = list(base)
        for at in rng.choice(200, int(rng.integers(0, 8)), replace=False):
            own[at] = f"x{rng.integers(0, 500)}"
        rows.append((k, " ".join(own), "s"))
    sets = {d: {tuple(t.split()[j : j + 5]) for j in range(196)} for d, t, _ in rows}
    pairs = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    want = sorted(set(union(pairs, sets).values()))
    assert 1 < len(want) < copies // 2
    assert sorted(r["doc_id"] for r in drop_near_duplicates(documents(rows), block_bytes=block_bytes).collect()) == want


def test_links_among():
    """Against all pairs, with dense and rare elements, sizes at the limit and empty sets."""
    rng = np.random.default_rng(19)
    for m in (2, 3, 40, 150):
        core = rng.integers(0, 1 << 60, 60)
        sets = [np.unique(np.concatenate([rng.choice(core, int(rng.integers(40, 60)), replace=False), rng.integers(0, 40, int(rng.integers(0, 9)))])) for _ in range(m)] + [np.zeros(0, np.int64)] * 2
        labels = rng.integers(0, max(2, m // 2), len(sets))
        same = [(i, j) for i in range(len(sets)) for j in range(i) if labels[i] == labels[j]]
        jaccard = lambda a, b: len(np.intersect1d(a, b)) / len(np.union1d(a, b)) if len(a) + len(b) else 1.0
        near = [(i, j) for i in range(len(sets)) for j in range(i) if labels[i] != labels[j] and jaccard(sets[i], sets[j]) >= 0.8]
        found = links_among(sets, labels, 0.8)
        assert {tuple(sorted(p)) for p in found} <= {tuple(sorted(p)) for p in near}
        assert union(same + found, range(len(sets))) == union(same + near, range(len(sets)))


def test_candidates_lose_no_similar_pair():
    rng = np.random.default_rng(23)
    for _ in range(30):
        m, core = int(rng.integers(2, 60)), np.sort(rng.choice(1 << 40, 90, replace=False))
        sets = []
        for _ in range(m):
            part = np.sort(rng.choice(core, int(rng.integers(40, 90)), replace=False))[int(rng.integers(0, 9)) :]
            sets.append(np.unique(np.concatenate([part, rng.integers(0, 1 << 40, int(rng.integers(0, 12)))])))
        keys = [x[: len(x) - math.ceil(0.8 * len(x) - 1e-9) + 1] for x in sets]
        labels = rng.integers(0, m, m)
        part = candidates_among(keys, np.array([len(x) for x in sets]), labels, 0.8)
        for i in range(m):
            for j in range(i):
                if labels[i] != labels[j] and len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j])):
                    assert part[i] == part[j]
    apart = [np.arange(k * 100, k * 100 + 21) for k in range(5)]
    assert (candidates_among(apart, np.full(5, 100), np.arange(5), 0.8) == np.arange(5)).all()


def plain_leaks(text, items):
    words = lambda t: "".join(c if c.isascii() and c.isalnum() or not c.isascii() else " " for c in (t or "").translate(LOWER)).split()
    w, out = words(text), set()
    for k, item in items:
        n = words(item)
        if n and any(leaks.common_length([hash(x) for x in n], [hash(x) for x in w[i : i + 2 * len(n)]]) >= 0.8 * len(n) for i in range(0, max(1, len(w)), max(1, len(n) // 2))):
            out.add(k)
    return out


def test_leaks(documents, awkward, spark):
    rng = np.random.default_rng(11)
    vocabulary = [f"word{i}" for i in range(2000)]
    say = lambda n: " ".join(rng.choice(vocabulary, n))
    items = [(i, say(int(rng.integers(15, 60)))) for i in range(20)] + [(98, None), (99, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = []
    for i in range(80):
        own = items[i % 20][1].split() if i % 2 else []
        if i % 4 == 3:
            own[len(own) // 3] = "other"  # a paraphrase of one word
        rows.append((100 + i, say(int(rng.integers(5, 120))) + " " + " ".join(own).upper() + ". " + say(int(rng.integers(0, 80))), "s"))
    docs = documents(rows).unionByName(awkward).withColumn("leaks", F.lit("clash"))
    found = {r["doc_id"]: {x["item_id"] for x in r["leaks"]} for r in leaks.find_leaks(docs, bench).collect()}
    for doc, text, _ in rows:
        assert found[doc] == plain_leaks(text, items), doc
    assert not any(found[d] for d in (1, 2, 3, 7, 8, None))
    assert all(r["leaks"] == [] for r in leaks.find_leaks(awkward, bench.limit(0)).collect()) and leaks.find_leaks(documents([]), bench).count() == 0


def test_leaks_of_a_large_benchmark(documents, spark):
    """The latent space keeps little of each of thousands of items; copies and paraphrases are found all the same."""
    rng = np.random.default_rng(14)
    vocabulary = [f"word{i}" for i in range(5000)]
    items = [list(rng.choice(vocabulary, int(rng.integers(15, 60)))) for _ in range(2000)]
    rows = []
    for i in range(0, 2000, 25):
        own = list(items[i])
        if i % 2:
            for at in rng.choice(len(own) * 3 // 4, len(own) // 4, replace=False):
                own[at] = "other"
        rows.append((i, " ".join([*rng.choice(vocabulary, i % 90), *own, *rng.choice(vocabulary, 40)]), "s"))
    rows += [(9000 + i, " ".join(rng.choice(vocabulary, 100)), "s") for i in range(50)]
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    found = {r["doc_id"]: [x["item_id"] for x in r["leaks"]] for r in leaks.find_leaks(documents(rows), bench).collect()}
    assert found == {d: [d] if d < 2000 else [] for d, _, _ in rows}


def test_leaks_of_excerpts(documents, spark):
    """Verbatim parts of long items: 45 of 59 words, 100 of 400, and runs of a window at any place; shorter ones are no leaks."""
    rng = np.random.default_rng(16)
    say = lambda n: [f"word{i}" for i in rng.integers(0, 5000, n)]
    items = [say(59), say(400), say(50)]
    parts = [(0, 0, 45), (1, 130, 230)] + [(2, i, i + leaks.WINDOW) for i in range(50 - leaks.WINDOW + 1)]
    rows = [(k, " ".join(say(37 + k) + items[j][a:b] + say(30)), "s") for k, (j, a, b) in enumerate(parts)]
    rows += [(100 + k, " ".join(say(50) + items[k][5:17] + say(50)), "s") for k in range(3)]
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    found = {r["doc_id"]: [x["item_id"] for x in r["leaks"]] for r in leaks.find_leaks(documents(rows), bench).collect()}
    assert found == {k: [j] for k, (j, _, _) in enumerate(parts)} | {100 + k: [] for k in range(3)}


def test_common_length():
    def plain(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            before = row[:]
            for j, y in enumerate(b):
                row[j + 1] = before[j] + 1 if x == y else max(before[j + 1], row[j])
        return row[-1]

    rng = np.random.default_rng(12)
    for _ in range(50):
        a, b = (rng.integers(0, 6, int(rng.integers(0, 30))).tolist() for _ in range(2))
        assert leaks.common_length(a, b) == plain(a, b)


def test_svd_reaches_the_driver_in_small_pieces(spark, monkeypatch):
    """Of a wide vocabulary too; rows of megabytes make the driver's virtual machine grow."""
    rng, kind, seen = np.random.default_rng(22), type(spark.range(0)), []

    def spied(name):
        read = getattr(kind, name)

        def call(self, *args, **kwargs):
            out = read(self, *args, **kwargs)
            rows = out.to_pylist() if name == "toArrow" else [r.asDict() for r in out]
            seen.extend(len(v) for r in rows for v in r.values() if isinstance(v, (bytes, bytearray)))
            return out

        monkeypatch.setattr(kind, name, call)

    spied("collect")
    spied("toArrow")
    dense = np.zeros((300, 2500))
    for row in dense:
        row[rng.choice(2500, 24, replace=False)] = rng.random(24)
    made = [(np.flatnonzero(r).tolist(), r[np.flatnonzero(r)].tolist()) for r in dense]
    basis, values = leaks.randomised_svd(spark.createDataFrame(made, "words array<int>, weights array<double>").repartition(3), 2500, rank=256)
    assert seen and max(seen) <= 256 << 10 and sum(seen) >= 3 * 2500 * 256 * 8 * 0.8
    s = np.linalg.svd(dense, compute_uv=False)
    assert np.allclose(values[:40], s[:40], rtol=0.01) and np.allclose(basis.T @ basis, np.eye(256), atol=1e-6)


def test_svd_finds_the_leading_vectors(spark):
    rng = np.random.default_rng(13)
    a = rng.normal(size=(60, 5)) @ rng.normal(size=(5, 40)) + 0.001 * rng.normal(size=(60, 40))
    rows = spark.createDataFrame([(list(range(40)), r.tolist()) for r in a], "words array<int>, weights array<double>").repartition(3)
    basis, values = leaks.randomised_svd(rows, 40, rank=5)
    _, s, v = np.linalg.svd(a, full_matrices=False)
    assert values == pytest.approx(s[:5], rel=1e-6) and np.abs(np.abs(np.diag(v[:5] @ basis)) - 1).max() < 1e-6


def test_quality(documents, awkward, spark):
    rng = np.random.default_rng(14)
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(rng.choice(words, 80)) + "." if i % 3 else " | ".join(["spam"] * int(rng.integers(20, 60))), "s") for i in range(600)]
    docs = documents(rows).unionByName(awkward).withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(600)] + [(1, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    model = fit_quality(docs, labels)
    scored = score_quality(docs, model).select("doc_id", "score", held_out("doc_id").alias("out")).collect()
    assert len(scored) == 610 and all(0 <= r["score"] <= 1 for r in scored)
    test = [r for r in scored if r["out"] and r["doc_id"] >= 9]
    assert np.mean([(r["score"] >= 0.5) == (r["doc_id"] % 3 > 0) for r in test]) > 0.95
    again = fit_quality(docs.repartition(5), labels)
    assert np.allclose(again.linear, model.linear)
    assert {r["score"] for r in score_quality(docs, fit_quality(docs, labels.limit(0))).collect()} == {0.5}
    assert score_quality(documents([]), model).count() == 0


def test_chance_meetings_of_sets_are_no_clusters(spark):
    # one shared shingle: sizes too far apart; too late in both sets; and early enough in sets of one size, alone and among others
    rows = [(1, 100, [5, 900]), (2, 200, [5, 901]), (3, 100, [*range(1000, 1015), 6]), (4, 100, [*range(2000, 2015), 6]), (5, 100, [7]), (6, 110, [7]), (7, 100, [8]), (8, 110, [8]), (9, 1000, [8])]
    found = _gathered(spark.createDataFrame(rows, "node long, size int, keys array<long>"), 0.8)
    assert sorted(map(tuple, found.collect())) == [(5, 5, 100), (5, 6, 110), (7, 7, 100), (7, 8, 110)]


def test_written_tables_leave_no_shuffle_files(spark, tmp_path):
    from quire.plans.scratch import CLEANUP, settle

    before = spark.conf.get(CLEANUP)
    tracker = spark.sparkContext._jsc.sc().env().mapOutputTracker()
    kept = tracker.shuffleStatuses().size()
    assert settle(spark.range(100).repartition(3, "id")).count() == 100
    assert tracker.shuffleStatuses().size() <= kept + 1  # that of the count
    assert spark.conf.get(CLEANUP) == before
