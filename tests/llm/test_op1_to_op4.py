import bisect
import collections
import hashlib
import re
import zlib
from pathlib import Path
import textwrap

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import op2_line_dedup as lines
from quire.llm.op1_sharding import find_splitters, histogram_shards, op1_sharding
from quire.llm.op3_license import KNOWN, canonical_lines, scan_licenses, whole_form
from quire.llm.op4_mixing import curriculum_plan, source_targets, training_sequence

DATA = Path("/root/testdata/sf0.001")


def check_shards(rows, shards):
    by = collections.defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in by.values()) and set(by) <= set(range(shards))


def test_shards_are_near_equal_and_keep_copies(documents):
    rng = np.random.default_rng(1)
    docs = documents([(i, "x" * int(rng.integers(10, 300)) + str(i), "s") for i in range(3000)] + [(10_000 + i, "copy of one text", "s") for i in range(40)])
    rows = histogram_shards(docs).collect()
    check_shards(rows, 16)
    sizes = collections.Counter()
    for r in rows:
        assert r["size"] == len(r["text"]) + 1
        sizes[r["shard"]] += r["size"]
    mean = sum(sizes.values()) / 16
    assert len(rows) == 3040 and max(sizes.values()) < 1.06 * mean and min(sizes.values()) > 0.94 * mean
    assert len({r["shard"] for r in rows if r["text"] == "copy of one text"}) == 1


def test_a_hot_group_is_split(documents):
    docs = documents([(i, "the hot text", "s") for i in range(900)] + [(1000 + i, f"text {i}", "s") for i in range(600)])
    rows = histogram_shards(docs, piece_bytes=300).collect()
    check_shards(rows, 16)
    counts = collections.Counter(r["shard"] for r in rows)
    assert len(counts) == 16 and max(counts.values()) < 1.2 * len(rows) / 16 + 20
    again = histogram_shards(docs.repartition(7), piece_bytes=300).collect()
    assert {(r["doc_id"], r["shard"], r["slot"]) for r in rows} == {(r["doc_id"], r["shard"], r["slot"]) for r in again}


def test_shards_of_awkward_rows(awkward, documents):
    rows = histogram_shards(awkward.withColumns({"shard": F.lit("x"), "SIZE": F.lit("y")})).collect()
    assert len(rows) == 10 and sorted(r["size"] for r in rows)[:2] == [1, 1]
    check_shards(rows, 16)
    assert histogram_shards(documents([])).count() == 0


def test_shards_of_an_order(documents):
    """Shards are successive parts of the order, and slots follow it."""
    rng = np.random.default_rng(20)
    docs = documents([(i, "x" * int(rng.integers(10, 300)), "s") for i in range(2000)])
    rows = sorted(histogram_shards(docs, order=(F.col("doc_id") % 3, -F.col("doc_id")), piece_bytes=4000).collect(), key=lambda r: (r["shard"], r["slot"]))
    check_shards(rows, 16)
    assert [r["doc_id"] for r in rows] == sorted(range(2000), key=lambda i: (i % 3, -i))
    sizes = collections.Counter()
    for r in rows:
        sizes[r["shard"]] += r["size"]
    assert max(sizes.values()) < 1.06 * sum(sizes.values()) / 16


@pytest.mark.skipif(not DATA.exists(), reason="no tables here")
def test_shard_query(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    rows = op1_sharding(spark, str(DATA)).collect()
    want = {r["doc_id"]: (len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in docs}
    assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in rows} == want and len(rows) == len(docs)
    assert {(r["law"], r["grown_shard"]) for r in rows} == {("bytes", None)}
    check_shards(rows, 16)


def test_splitters_of_many_targets(spark):
    """Exact bytes and rows below each splitter, near its target."""
    rng = np.random.default_rng(22)
    rows = [(int(a), i, int(s)) for i, (a, s) in enumerate(zip(rng.integers(-(1 << 62), 1 << 62, 20_000), rng.integers(1, 100, 20_000), strict=True))]
    total = sum(r[2] for r in rows)
    targets = [total * i / 500 for i in range(1, 500)]
    keys = spark.createDataFrame(rows, "digest long, second long, size long").cache()
    found = find_splitters(keys, targets, total / 500 * 0.5, total / 500)
    order = sorted(rows)
    at = [((r[0] + (1 << 63)) << 64) + r[1] + (1 << 63) for r in order]
    sums = np.concatenate([[0], np.cumsum([r[2] for r in order])])
    for target, (key, below, n) in zip(targets, found, strict=True):
        k = bisect.bisect_left(at, key)
        assert (below, n) == (sums[k], k) and abs(below - target) <= total / 500 * 0.5


def plain_dedup(rows, least_chars=40, least_docs=5):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    held = collections.defaultdict(list)
    for doc, text in rows:
        for k in {key(x) for x in (text or "").split("\n")} if doc is not None else ():
            held[k].append(doc)
    gone = {k: max(d) for k, d in held.items() if len(k) >= least_chars and len(set(d)) >= least_docs}
    out = []
    for doc, text in rows:
        all_lines = (text or "").split("\n")
        kept = [x for x in all_lines if key(x) not in gone or gone[key(x)] == doc]
        out.append((doc, len(all_lines), len(all_lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("limit", [32 << 20, 0])
def test_lines_against_plain_code(documents, awkward, limit):
    rng = np.random.default_rng(2)
    pool = [f"a line that is long enough to count, number {i} of the pool" for i in range(30)] + ["short"]
    rows = [(i, "\n".join(("  " if rng.random() < 0.3 else "") + (p.upper() if rng.random() < 0.2 else p) for p in rng.choice(pool, int(rng.integers(0, 6)))), "s") for i in range(60)]
    docs = documents(rows).unionByName(awkward).withColumns({"dropped": F.lit(1), "lines": F.lit(2)})
    found = lines.line_duplicates(docs, broadcast_bytes=limit).select("doc_id", F.size("lines"), F.size("dropped"), F.sha2("kept_text", 256)).collect()
    assert sorted((tuple(r) for r in found), key=str) == plain_dedup([(r["doc_id"], r["text"]) for r in docs.collect()])


@pytest.mark.parametrize("limit", [32 << 20, 0])
def test_lines_of_repeated_and_null_ids(documents, limit):
    """Rows of one doc_id are one document, rows without one are none; a hot line is served by several copies of its shard."""
    line, other = "one line that is long enough to count for certain", "another line that is long enough to count, surely"
    rows = [(i, line, "s") for i in (1, 2, 3, 4, 4, None, None)] + [(i, other + "\nshort", "s") for i in (*range(10, 400), 399, None)]
    found = lines.line_duplicates(documents(rows), broadcast_bytes=limit).select("doc_id", F.size("lines"), F.size("dropped"), F.sha2("kept_text", 256)).collect()
    assert sorted((tuple(r) for r in found), key=str) == plain_dedup([(d, t) for d, t, _ in rows])
    assert sorted(r[2] for r in found) == [0] * 9 + [1] * 390


def test_counts_are_read_from_the_arrays():
    shard = lines.LineShard(*(np.array(x, dtype=np.int64) for x in ([1, 2], [3, 4], [4, 5], [9, 8])))
    known, last = shard.last_of(np.array([1, 2, 7]), np.array([3, 4, 7]), 5)
    assert known.tolist() == [False, True, False] and last[1] == 8
    assert shard.last_of(np.array([1]), np.array([3]), 4)[0].tolist() == [True]


def test_no_lines(documents):
    assert lines.line_duplicates(documents([])).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 63, 64, 65, 5000])
def test_perfect_hash_is_minimal(n):
    keys = np.unique(np.random.default_rng(n).integers(0, 1 << 63, n).astype(np.uint64))
    table = lines.PerfectHash(keys)
    assert sorted(table.slots(keys).tolist()) == list(range(len(keys)))
    assert (table.slots(keys + np.uint64(1)) < max(1, len(keys))).all()


def test_licenses(documents, awkward):
    docs = documents([(20, "RELEASED under the mit licence", "a"), (21, "Copyright 2020 Somebody\nReleased under the MIT License!", "a"), (22, "Text.\n  Licensed under CC BY-NC 4.0\nMore.", "a"), (23, "Released under the MIT License, mostly", "a")])
    found = {r["doc_id"]: (r["license"], r["line_licenses"]) for r in scan_licenses(docs.withColumn("license", F.lit("x"))).collect()}
    assert found[20] == ("MIT", ["MIT"]) and found[21][0] == "MIT" and found[22] == (None, ["CC-BY-NC-4.0"]) and found[23] == (None, [])
    clash = scan_licenses(docs.withColumns({"License": F.lit("x"), "__lines": F.lit("own")})).collect()
    assert {r["doc_id"]: r["license"] for r in clash} == {k: v[0] for k, v in found.items()} and {r["__lines"] for r in clash} == {"own"}
    rows = scan_licenses(awkward).collect()
    assert len(rows) == 10 and all(r["digest"] is None for r in rows if not (r["text"] or "").strip())
    assert scan_licenses(documents([])).count() == 0


def test_canonical_forms(spark):
    """Neighbouring equivalents, spellings across lines, and every known text under changes that don't matter."""
    form = lambda t: spark.createDataFrame([(t,)], "t string").select(whole_form(canonical_lines(F.col("t")))).first()[0]
    assert form("Licence licence LICENCE") == "license license license" and form("a sub-\nlicence, non commercial") == "a sublicense noncommercial"
    assert form("Copyright 2020 Me\n(c) you\nThe text.") == "the text" and form("") == "" and form("\n \t.") == ""
    rows = [(i, "Copyright (c) 2021 Somebody\n\n" + body.upper().replace(" LICENSE", " LICENCE").replace("\n\n", "\n * "), "s") for i, (_, body) in enumerate(KNOWN)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    first = {}
    for name, body in KNOWN:
        first[form(body)] = min(name, first.get(form(body), name))
    assert {r["doc_id"]: r["license"] for r in scan_licenses(docs).collect()} == {i: first[form(body)] for i, (_, body) in enumerate(KNOWN)}
    own = spark.createDataFrame([("Own", "Some other text")], "license string, body string")
    assert [r["license"] for r in scan_licenses(spark.createDataFrame([(1, "some OTHER text")], "doc_id long, text string"), known=own).collect()] == ["Own"]


def plain_targets(sizes, weights, total):
    target, open_ = dict.fromkeys(sizes, 0.0), set(sizes)
    while open_:
        left = total - sum(target[s] for s in sizes if s not in open_)
        share = {s: left * weights[s] / sum(weights[k] for k in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * sizes[s]}
        target |= {s: 2.0 * sizes[s] for s in over} if over else share
        if not over:
            break
        open_ -= over
    return target


def test_targets_against_plain_refilling(spark):
    rng = np.random.default_rng(3)
    for _ in range(4):
        sizes = {f"s{i}": int(rng.integers(1, 10_000) ** (1 + i % 2)) for i in range(9)}
        weights = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(sizes))}
        found = {r["source"]: r["target"] for r in source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long"), (5, 2, 1), (0, 0, 0), 1.5, 2.0).collect()}
        assert found == pytest.approx(plain_targets(sizes, weights, 1.5 * sum(sizes.values())))


def test_mix(documents, awkward):
    rng = np.random.default_rng(4)
    docs = documents([(100 + i, " ".join("w" * int(rng.integers(1, 60))), ("hot" if i % 3 else f"s{i % 5}")) for i in range(400)]).unionByName(awkward).withColumn("target", F.lit("clash"))
    mixed = curriculum_plan(docs)
    rows = mixed.collect()
    sizes = sorted((str(r["doc_id"]), len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))) for r in docs.collect())
    assert len(rows) == 410 and sorted((str(r["doc_id"]), r["size"]) for r in rows) == sizes
    by = collections.defaultdict(lambda: [0, 0])
    for r in rows:
        assert 0 <= r["taken"] <= 2 * r["size"]
        by[r["source"]][0] += r["taken"]
        by[r["source"]][1] = r["target"]
    assert all(abs(took - target) <= 1 for took, target in by.values())
    assert sorted(map(str, rows)) == sorted(map(str, curriculum_plan(docs.repartition(5), bucket_rows=16).collect()))
    sequence = training_sequence(docs, mixed).collect()
    order = [r["position"] for r in sequence]
    assert order == sorted(order) and all(0 <= p <= 1 for p in order)
    whole = collections.Counter()
    for r in rows:
        first = min(r["taken"], r["size"])
        whole[r["doc_id"]] += (r["first_position"] is not None and 2 * first >= r["size"]) + (r["second_position"] is not None and 2 * (r["taken"] - first) >= r["size"])
    assert collections.Counter(r["doc_id"] for r in sequence) == +whole
    assert all(r["target"] == "clash" for r in sequence)
    assert curriculum_plan(documents([])).count() == 0 and training_sequence(documents([]), curriculum_plan(documents([]))).count() == 0


def test_positions_are_shares_of_all_demand(documents):
    """At each position, the words of all copies before it are that share of all words taken."""
    rng = np.random.default_rng(21)
    docs = documents([(i, " ".join("w" * int(rng.integers(1, 9))), f"s{i % 3}") for i in range(3000)])
    copies = [(p, n) for r in curriculum_plan(docs).collect() for p, n in ((r["first_position"], min(r["size"], r["taken"])), (r["second_position"], r["taken"] - min(r["size"], r["taken"]))) if p is not None]
    total, so_far = sum(n for _, n in copies), 0
    for p, n in sorted(copies):
        assert abs(so_far / total - p) < 0.01
        so_far += n


def test_crc_is_unsigned(spark):
    assert spark.range(1).select(F.crc32(F.lit("hello").cast("binary"))).first()[0] == zlib.crc32(b"hello")


def test_ordinary_license_files(documents):
    """Every known text of several lines, wrapped at many widths, with a title, notices, typographic quotes and dashes; body lines that begin with the word copyright stay."""
    titles = {"MIT": ("MIT License", "The MIT License (MIT)"), "ISC": ("ISC License",), "BSD-2-Clause": ("BSD 2-Clause License",), "BSD-3-Clause": ("BSD 3-Clause License", "The 3-Clause BSD License"), "Zlib": ("zlib License",), "0BSD": ("BSD Zero Clause License",), "BSL-1.0": ("Boost Software License - Version 1.0 - August 17th, 2003",), "Unlicense": ("The Unlicense",)}
    notices = ("Copyright (c) 2021 Somebody", "Copyright 2019-2021 The Authors. All rights reserved.", "Copyright Jane Doe", "(c) 2020 Jane Doe\nAll rights reserved.", "© Jane Doe", "COPYRIGHT (C) 1999 JANE DOE", "Copyright [yyyy] [name of copyright owner]", "copyright by Jane Doe")
    rows, want = [], {}
    for name, body in KNOWN:
        if len(body) < 400:
            continue
        for k, width in enumerate(range(50, 101)):
            said = "\n\n".join(textwrap.fill(p, width) for p in body.split("\n\n"))
            if k % 3 == 1:
                said = said.replace('"AS IS"', "“AS IS”").replace("'as-is'", "‘as‑is’").replace("non-commercial", "non–commercial")
            title = titles.get(name, ())
            head = [*([title[k % len(title)]] if title and k % 2 else []), *([notices[k % len(notices)]] if k % 5 else [])]
            want[len(rows)] = name
            rows.append((len(rows), "\n\n".join([*head, said]), "s"))
    assert len(rows) > 400
    found = {r["doc_id"]: r["license"] for r in scan_licenses(documents(rows)).collect()}
    assert [(i, n, rows[i][1][:80]) for i, n in want.items() if found[i] != n] == []
    prose = [(1, "Copyright is a right. Read the MIT License.", "s"), (2, "copyright holders be liable\nfor this", "s")]
    forms = {r["doc_id"]: r["f"] for r in documents(prose).select("doc_id", whole_form(canonical_lines(F.col("text"))).alias("f")).collect()}
    assert forms == {1: "copyright is a right read the mit license", 2: "copyright holders be liable for this"}
