"""Text in boxes, clips, glossaries of many terms, and operators that spread one large group over tasks, against plain code."""

import json
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire import queries, table_queries  # noqa: F401  the second registers its queries
from quire.functions.text import join_text, strip
from quire.operators import glossary as g
from quire.operators import layout, paragraphs, performance, typeset
from quire.plans.options import LayoutOptions
from quire.sources import adapters

M = typeset.FontMetrics()


def width(text):
    full = re.compile(re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: "\\U%08x" % int(m[1], 16), typeset.FULL_WIDTH))
    return sum(M.overrides if full.match(c) else M.advances.get(c, M.default) for c in text)


def plain_lines(text, limit):
    """Greedy lines: words with a space between, long words cut between characters, every line feed a new line."""
    out = []
    for part in text.split("\n"):
        lines, open_ = [], None
        for word in [w for w in re.split(r"[ \t\r]+", part) if w]:
            if width(word) > limit:
                if open_ is not None:
                    lines.append(open_)
                open_ = None
                for c in word:
                    if open_ is not None and width(open_ + c) <= limit:
                        open_ += c
                    else:
                        if open_ is not None:
                            lines.append(open_)
                        open_ = c
            elif open_ is not None and width(open_ + " " + word) <= limit:
                open_ += " " + word
            else:
                if open_ is not None:
                    lines.append(open_)
                open_ = word
        out += lines + [open_ or ""]
    return out


TEXTS = ["", "word", "two words", "a\n\nb", "x" * 90, "il" * 40 + " mm " + "W" * 30 + " end", "漢字仮名交じり文 and latin 🙂 text", "tab\tand\rreturn  spaces", " leading and trailing ", "fits exactly"] + [" ".join("w" * random.Random(i * 97 + k).randint(1, 14) for k in range(i * 7)) for i in range(12)]


def test_lines_and_widths(spark):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "n int, t string")
    for limit in (900, 4000, 12_000, 10**6):
        m = typeset.measured_words(F.col("t"), M)
        got = rows.select("n", typeset.broken_lines(F.col("t"), F.lit(limit).cast("long"), M).alias("l"), typeset.line_count(m, F.lit(limit).cast("long"), M).alias("c"), M.width(F.col("t")).alias("w")).collect()
        for r in got:
            want = plain_lines(TEXTS[r["n"]], limit)
            assert [x["text"] for x in r["l"]] == want and r["c"] == len(want), (TEXTS[r["n"]], limit)
            assert all(x["width"] == width(x["text"]) for x in r["l"])
    with pytest.raises(ValueError, match="single characters"):
        typeset.FontMetrics({"ab": 3})


def test_layout_by_advances(spark):
    """The largest size at which the lines fit, in the own box, then in the grown one."""
    o, rng = LayoutOptions(expand=True), random.Random(5)
    rows = [("d", 1, f"b{k}", TEXTS[k % len(TEXTS)], [rng.choice([8.0, 11.0, 14.5])], 10.0, 50.0 * k, 10.0 + rng.choice([30, 80, 200]), 50.0 * k + rng.choice([6, 12, 30]), 600.0, 2000.0) for k in range(40)]
    blocks = spark.createDataFrame(rows, "doc string, page int, block_id string, translated string, sizes array<double>, x0 double, y0 double, x1 double, y1 double, page_w double, page_h double")
    got = {r["block_id"]: r for r in layout.plan_layout(blocks, o).collect()}
    low = {r["block_id"]: r["limit"] for r in layout.lower_limits(blocks, o).collect()}
    fits = lambda t, s, w, h: len(plain_lines(t, int(w * 1000 / s + 1e-6))) <= int(h / (s * o.line_height) + 1e-6)
    kinds = set()
    for _, _, b, t, (first,), x0, y0, x1, y1, _, _ in rows:
        ladder, s = [], first
        while s > o.least_font:
            ladder.append(s)
            s -= o.font_step
        ladder.append(o.least_font)
        tries = [[s for s in ladder if fits(t, s, x1 - x0, h)] for h in (y1 - y0, low[b] - y0)]
        here, grown = (ladder.index(x[0]) + 1 if x else None for x in tries)
        size = ladder[here - 1] if here else ladder[grown - 1] if grown else None
        assert got[b]["font_size"] == size and got[b]["attempts"] == (here or len(ladder) + (grown or len(ladder))) and got[b]["expanded"] == (not here and bool(grown)), (b, t)
        kinds.add((bool(here), bool(grown)))
    assert {(True, True), (False, True)} <= kinds


def test_placed_words_and_clips(spark):
    rng = np.random.default_rng(6)
    boxes = [("d", 1 + k % 2, f"b{k}", TEXTS[k % len(TEXTS)] or "some text", 9.0, float(x), float(y), float(x) + 140.0, float(y) + 40.0, 600.0, 800.0) for k, (x, y) in enumerate(rng.integers(0, 600, (40, 2)))]
    blocks = spark.createDataFrame(boxes, "doc string, page int, block_id string, text string, size double, x0 double, y0 double, x1 double, y1 double, page_w double, page_h double")
    words = typeset.placed_words(blocks, "text", "size", 1.2, M)
    placed = words.collect()
    for _, _, b, t, s, x0, y0, x1, _, _, _ in boxes:
        mine = sorted((r for r in placed if r["block_id"] == b), key=lambda r: (r["line"], r["place"]))
        lines = plain_lines(t, int((x1 - x0) * 1000 / s + 1e-6))
        assert [r["word"] for r in mine] == " ".join(x for x in lines if x).split(" ")
        for r in mine:
            before = " ".join(lines[r["line"]].split(" ")[: r["place"]])
            left = x0 + (width(before + " ") if before else 0) * s / 1000
            assert (r["x0"], r["y0"]) == (pytest.approx(left), pytest.approx(y0 + r["line"] * s * 1.2)) and r["x1"] == pytest.approx(left + width(r["word"]) * s / 1000)
    clips = [(r[0], r[1], i, *map(float, (x, y, x + w, y + h))) for i, (x, y, w, h) in enumerate(rng.integers(1, 300, (60, 4))) for r in [boxes[i % 40]]]
    found = {r["clip_id"]: r["found"] for r in typeset.clip_texts(spark.createDataFrame(clips, "doc string, page int, clip_id int, x0 double, y0 double, x1 double, y1 double"), words.drop("block_id"), 37.0).collect()}
    for _, page, i, x0, y0, x1, y1 in clips:
        inside = sorted((r["y0"], r["x0"], r["word"]) for r in placed if r["page"] == page and r["x0"] < x1 and x0 < r["x1"] and r["y0"] < y1 and y0 < r["y1"])
        assert found.get(i, "") == " ".join(w for *_, w in inside)
    checked = typeset.verified_clips(blocks.limit(1), typeset.placed_words(blocks.limit(1), "text", "size", 1.2, M), "text", "size").first()
    assert checked["verified"]
    lost = typeset.verified_clips(blocks.limit(1), words.where("false"), "text", "size").first()
    assert not lost["verified"] and lost["found"] is None


LINE = "doc string, page int, block_id string, text string, size double, x0 double, y0 double, x1 double, y1 double, page_w double, page_h double"


def test_words_as_they_stand(spark):
    texts = ["a bc  d", "", " ", "  lead and trail ", "\u00e9\u4e2d \U0001f600x y", "w" * 90 + " off the page", None]
    blocks = spark.createDataFrame([("d", 1, f"b{k}", t, 9.0, 50.0, 20.0 * k, 500.0, 20.0 * k + 10, 600.0, 800.0) for k, t in enumerate(texts)], LINE)
    want = []
    for k, t in enumerate(texts):
        at = 0
        for w in (t or "").split(" "):
            want += [(w, 50.0 + 5 * at, 20.0 * k, 50.0 + 5 * (at + len(w)), 20.0 * k + 10)] if w else []
            at += len(w) + 1
    assert sorted(map(tuple, adapters.words(blocks).select("word", "x0", "y0", "x1", "y1").collect())) == sorted(want)


def test_clips_of_odd_rows(spark):
    """Null boxes, documents and ids keep their block without words; of blocks of one id each has the words of all."""
    rows = [
        ("d", 1, "a", "one two", 10.0, 50.0, 20.0, 100.0, 30.0, 600.0, 800.0),
        ("d", 1, "a", "two", 10.0, 300.0, 20.0, 350.0, 30.0, 600.0, 800.0),
        ("d", 1, "no box", "one", 10.0, 50.0, 20.0, None, 30.0, None, 800.0),
        ("d", 1, None, "one", 10.0, 50.0, 20.0, 100.0, 30.0, 600.0, 800.0),
        (None, 1, "a", "one", 10.0, 50.0, 20.0, 100.0, 30.0, 600.0, 800.0),
        ("d", 1, "far", "", 10.0, 50.0, 700.0, 50.0, 710.0, 600.0, 800.0),
    ]
    words = [("d", 1, "one", 50.0, 20.0, 65.0, 30.0), ("d", 1, "two", 70.0, 20.0, 85.0, 30.0), (None, 1, "one", 50.0, 20.0, 65.0, 30.0), ("d", 1, "one", None, 20.0, 65.0, 30.0)]
    words = spark.createDataFrame(words, "doc string, page int, word string, x0 double, y0 double, x1 double, y1 double")
    got = typeset.verified_clips(spark.createDataFrame(rows, LINE), words, "text", "size").collect()
    want = [("d", "a", "one two", True), ("d", "a", "one two", True), ("d", "no box", None, False), ("d", None, None, False), (None, "a", None, False), ("d", "far", None, True)]
    assert sorted(((r["doc"], r["block_id"], r["found"], r["verified"]) for r in got), key=str) == sorted(want, key=str)


def test_clips_shuffle_blocks_and_no_words(spark, tmp_path):
    """Of long lines, what is shuffled are the blocks, not their words or what words and clips make."""
    text = "\n".join(" ".join(f"w{k}" for k in range(40)) for _ in range(10))
    rows = spark.range(40).select(F.col("id").alias("doc_id"), F.lit(text).alias("text"), F.lit("s").alias("source"))
    rows.write.parquet(str(tmp_path / "documents.parquet"))
    tracker, store = spark.sparkContext.statusTracker(), spark.sparkContext._jsc.sc().statusStore()
    spark.sparkContext.setJobGroup("clips", "clips")
    (row,) = queries.clip_checks(spark, str(tmp_path)).collect()
    stages = {s for j in tracker.getJobIdsForGroup("clips") for s in tracker.getJobInfo(j).stageIds}
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert row["n_blocks"] == 40 * 14 and row["chars"] > 40 * 10 * 100
    assert max(store.lastStageAttempt(s).shuffleWriteRecords() for s in stages) <= 40 * 14


def test_messages_of_missing_texts(spark):
    rows = spark.createDataFrame([("b1", 3, "e" * 300, "f", False), ("b2", 3, "x", "x", True), ("b3", 1, None, None, False)], "block_id string, page int, expected string, found string, verified boolean")
    said = {r["block_id"]: r["message"] for r in typeset.failure_message(rows).collect()}
    assert said == {"b1": "text of block b1 on page 3 is missing; expected: " + "e" * 240 + "...; found: f", "b3": "text of block b3 on page 1 is missing; expected: ; found: "}


def plain_matches(terms, text):
    """Every term's expression over the whole text."""
    found = sorted((-t.priority, m.start() - m.end(), not t.case_sensitive, -g.RANK[t.match], t.id, m.start(), m.end()) for t in terms for m in re.finditer(t.pattern(), text, 0 if t.case_sensitive else re.IGNORECASE))
    taken = []
    for *_, i, a, b in found:
        if all(b <= x or a >= y for x, y, _ in taken):
            taken.append((a, b, i))
    return [{"start": a, "end": b, "term": i} for a, b, i in sorted(taken)]


def test_all_terms_at_once():
    rng = random.Random(3)
    words = ["alpha", "Beta", "C++", "U.S.", "(foo)", "foo", "bar-baz", "bar", "ſo", "so", "Straße", "K", "k", "ΣΑΣ", "σας", "ı", "i", "İ", "-", "++", "a_b", "12", "é", "漢字", "漢"]
    say = lambda n: "".join(rng.choice([*words, *map(str.upper, words), *map(str.lower, words)]) + rng.choice([" ", "  ", "\n", ".", ", ", "-", "", " "]) for _ in range(n))
    for _ in range(150):
        terms = tuple(g.Term(f"t{k}", rng.choice(["", "", "", "(", "["]) + " ".join(rng.choice(words) for _ in range(rng.randint(1, 3))), "X", case_sensitive=rng.random() < 0.3, match=rng.choice(list(g.RANK)), priority=rng.randint(0, 2)) for k in range(rng.randint(1, 25)))
        matcher = g.Matcher(terms)
        for text in (say(rng.randint(0, 40)), f"  {rng.choice(terms).source.upper()} \n", ""):
            assert matcher.select(text) == plain_matches(terms, text)


def test_ten_thousand_terms(spark):
    terms = tuple(g.Term(f"t{k}", f"word{k} word{k + 1}" if k % 2 else f"word{k}", f"W{k}", priority=k % 3) for k in range(10_000))
    text = " ".join(f"word{(i * 7919) % 12_000}" for i in range(3000)) + " word5 word6"
    few = tuple(t for t in terms if f" {t.source} " in f" {text} ")
    assert g.Matcher(terms).select(text) == plain_matches(few, text)
    book = g.Glossary(terms)
    row = spark.createDataFrame([(1, text)], "unit_id int, text string").select(g.prepare(F.col("text"), g.matches(F.col("text"), book), book).alias("p")).first()["p"]
    assert len(row["tokens"]) == len(plain_matches(few, text)) and row["text"].count("__TERM_") == len(row["tokens"])


def test_a_glossary_as_a_table(spark, tmp_path):
    entries = [{"id": "a", "source": "Foo  bar", "target": "X"}, {"id": "b", "source": "foo BAR", "target": "Y"}, {"id": "c", "source": "FOO bar", "target": "Z", "mode": "preserve", "case_sensitive": True}, {"id": "a", "source": "other", "target": "T"}, {"id": "e", "source": " ", "target": "", "mode": "x", "priority": 20_000}, {"id": "f", "source": "__TERM_0001__", "target": "Q"}]
    (tmp_path / "g.json").write_text(json.dumps({"entries": entries}, indent=1))
    terms = g.read_terms(spark, str(tmp_path / "g.json"))
    assert sorted((r["problem"], r["source"], r["first_id"], r["last_id"], r["n"]) for r in g.term_conflicts(terms).collect()) == [("repeated id", "foo bar", "a", "a", 2), ("repeated source", "foo bar", "a", "b", 2), ("two modes", "foo bar", "a", "c", 3)]
    assert sorted(tuple(r) for r in g.invalid_terms(terms).collect()) == [("e", "no source"), ("e", "no target"), ("e", "priority out of range"), ("e", "unknown mode"), ("f", "reserved mark")]
    good = terms.where("id NOT IN ('e', 'f')")
    print_of = lambda df: g.terms_fingerprint(df).first()["fingerprint"]
    assert print_of(good) == print_of(good.repartition(3).withColumn("notes", F.lit("other"))) == print_of(good.withColumn("source", F.when(F.col("id") == "b", "foo bar").otherwise(F.col("source"))))
    assert len({print_of(good), print_of(good.withColumn("priority", F.lit(1))), print_of(good.limit(2)), g.terms_fingerprint(good, "2").first()["fingerprint"], print_of(good.where("false"))}) == 5
    assert g.collected_glossary(terms.where("id IN ('b', 'c')").withColumn("mode", F.lit("translate"))).terms[0] == g.Term("b", "foo BAR", "Y")
    with pytest.raises(ValueError, match="over 1 terms"):
        g.collected_glossary(terms, 1)


@pytest.mark.parametrize("span", [1, 3])
def test_one_large_document_is_spread(blocks, span):
    """Ranges of pages change no row: also with gaps, empty pages and paragraphs over several ranges."""
    rng = random.Random(8)
    rows = []
    for page in [*range(1, 12), 15, 16, *range(30, 34)]:
        for j in range(rng.randint(1, 3)):
            y = 30 + 250 * j if page % 4 else 700 if j == 0 else 60 * j
            rows.append((page, j, rng.choice(["this goes on and", "and further on it goes", "It ends here.", "- a point", "A new be-", "ginning of it"]), 50, y, 550, y + 12, 10))
    rows += [(p, 9, rng.choice(["which goes on and", "and then some"]), 50, 785, 550, 797, 10) for p in range(1, 9)] + [(p, 8, "and it goes", 50, 10, 550, 22, 10) for p in range(2, 10)]
    rows += [(p, 0, "it goes on and", 50, 100, 550, 700, 10) for p in range(40, 49)]  # one paragraph over nine pages
    both = blocks(rows).unionByName(blocks(rows[:9]).withColumn("doc", F.lit(None).cast("string")))
    whole, split = (paragraphs.paragraphs_of(both, span=s) for s in (1024, span))
    for a, b in zip(whole, split, strict=True):
        assert sorted(map(tuple, a.collect()), key=str) == sorted(map(tuple, b.collect()), key=str)
    off = paragraphs.ParagraphOptions(mode="off")
    one, two = (sorted((r["doc"] or "", r["para"], r["id"]) for r in paragraphs.paragraphs_of(both, off, s)[0].collect()) for s in (1024, span))
    assert one == two and [p for d, p, _ in two if d == "d"] == list(range(1, len(rows) + 1))
    assert max(r["n_fragments"] for r in split[0].collect()) == 9


@pytest.mark.parametrize("columns", [1, 2])
def test_texts_dealt_by_ranges_of_pages(spark, columns):
    """Blocks and paragraphs are those of texts that aren't dealt: odd white space, empty and null texts, a doc_id twice, texts at the end of a range."""
    rng = random.Random(5)
    words = ["goes", "on", "and", "be-", "ginning", "ends.", "TITLE", "\u00a0", "-"]
    texts = ["".join(rng.choice(words) + rng.choice([" ", "  ", "\n", "\t "]) for _ in range(n)) for n in (1, 3, 17, 24, 25, 48, 49, 200)]
    docs = spark.createDataFrame([*enumerate([*texts, "", None, " \n "]), (7, texts[6])], "doc_id long, text string")
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    plain, dealt = adapters.wrapped(docs, 2, 3, columns), adapters.wrapped(docs, 2, 3, columns, span=2)
    assert rows(plain) == rows(dealt.drop("page_range")) and dealt.where(F.col("page_range") != paragraphs.page_range(F.col("page"), 2)).count() == 0
    single = dealt.where("doc <> '7'")  # two texts of one doc_id have equal blocks, whose order is open
    one, two, spread = (rows(paragraphs.logical_paragraphs(df, span=2)) for df in (plain.where("doc <> '7'"), single, single.drop("page_range")))
    assert one == two == spread and max(r[1] for r in one) > 1


def test_texts_are_put_together_as_one_by_one(spark):
    rng = random.Random(1)
    pieces = ["", " ", "\t", "be-", "we-", "ll-", "no-", "n-", "ginning", "ginning-", " and ", "x ", "--ab-", "a-b-", "Abc", "\x1c", "\u00e9-", "abc-\n", "-"]
    rows = [([("".join(rng.choice(pieces) for _ in range(rng.randint(0, 3))) if rng.random() < 0.99 else None,) for _ in range(rng.randint(1, 7))],) for _ in range(2000)]
    df, items = spark.createDataFrame(rows, "items array<struct<text: string>>"), F.col("items")
    for first in (strip(items[0]["text"]), items[0]["text"]):
        plain = F.aggregate(F.slice(items, 2, F.size(items)), first, lambda acc, x: join_text(acc, x["text"]))
        assert df.where(~plain.eqNullSafe(paragraphs._folded(items, first))).count() == 0


@pytest.mark.parametrize("name", ["paragraph_text", "paragraph_contents"])
def test_texts_of_paragraphs_are_shuffled_once(spark, tmp_path, name):
    rng = random.Random(6)
    rows = [(k, " ".join(f"{rng.getrandbits(40):x}" for _ in range(3000))) for k in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(8).write.parquet(str(tmp_path / "documents.parquet"))
    context = spark.sparkContext._jsc.sc()

    def shuffled():
        context.listenerBus().waitUntilEmpty()
        return context.statusStore().executorList(False).head().totalShuffleWrite()

    before = shuffled()
    queries.QUERIES[name](spark, str(tmp_path)).write.parquet(str(tmp_path / "out"))
    assert shuffled() - before < 1.5 * sum(len(text) for _, text in rows)


def test_exact_quantiles_in_rounds(spark):
    """Groups beyond the bound of one task: normal values, heavy ties at both ends and in the middle, tiny and huge ones."""
    rng = np.random.default_rng(9)
    groups = {"normal": rng.normal(size=4001) ** 2, "ties": np.repeat([0.0, 1.0, 5.0, 9.0], [10, 3000, 20, 900]), "top": np.append(rng.random(60), np.full(3000, 7.0)), "bottom": np.append(rng.random(60) + 1, np.zeros(3000)), "wide": 10.0 ** rng.integers(-300, 300, 3000), "small": rng.random(50), "one": np.full(2500, 3.0), "none": np.full(3, -1.0)}
    rows = [(k, float(v)) for k, vs in groups.items() for v in vs] + [(None, float(v)) for v in range(2000)] + [("normal", None), ("normal", -4.0)]
    df = spark.createDataFrame(rows, "g string, s double").repartition(3)
    plain, rounds = (sorted(map(tuple, performance.timings(df, "s", "g", small=n).collect()), key=str) for n in (1 << 16, 100))
    assert plain == rounds and len(plain) == 9
    one, many = (tuple(performance.timings(df, "s", small=n).first()) for n in (1 << 16, 100))
    assert one == many
