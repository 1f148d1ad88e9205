import re
import sys

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark import cloudpickle
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators.glossary import Glossary, Term, conflicts, glossary_matches, prepare, matches
from quire.operators.translate import PrefixTranslator, finish_units, halving, merge_memory, new_memory, plan_units, run_counters, translate_misses
from quire.plans.options import TranslationOptions
from quire.plans.pipeline import DocumentRun
from quire.sources.files import Memory, glob_matches, parse_pages, skip_reasons, typed_blocks


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the models below go to workers


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("x")).first()["x"]


@pytest.mark.parametrize("text", ["see https://a.b/c?d=1 and x.y@z.org", "C:\\dir\\file.txt or ../up/file or /usr/bin/x", "12 mm, AB-1234 and 2024-05", "plain and/or prose", "__KEEP_0000__ 123"])
def test_protect_round_trip(spark, text):
    p = spark.createDataFrame([(text,)], "t string").select(T.protect(F.col("t")).alias("p"))
    row = p.select("p", T.restore(F.col("p.text"), F.col("p.tokens")).alias("back")).first()
    assert row["back"] == text
    assert ("and/or" in text) == (not row["p"]["tokens"])


def test_skips(spark):
    said = {"": True, " 42 ": True, "5 kg, 3 mm": True, "AB-12/3": True, "ABC": False, "Some words": False, "def f(x)": True, "\ue000": True, "\ue000a": False}
    rows = spark.createDataFrame([(k,) for k in said], "t string").select("t", T.skips_translation(F.col("t")).alias("s")).collect()
    assert {r["t"]: r["s"] for r in rows} == said


def test_normalize(spark):
    assert one(spark, " o\ufb03ce\r\n a \t b e\u0301 ", T.normalize) == "office\n a b \xe9"


def test_segments_of_twenty_sentences(spark):
    text = " ".join(f"Sentence number {i} has a fixed number of words which is about twenty in all so that three of them fit here." for i in range(20))
    s = one(spark, text, lambda c: T.segment(c, 64))
    assert all(T.word_tokens(x["text"]) <= 64 for x in s["segments"]) and " ".join(x["text"] for x in s["segments"]) == text and not s["forced"]
    assert one(spark, "x" * 50, lambda c: T.segment(c, 8, len))["forced"]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .!\n", max_size=120), st.integers(8, 20))
def test_segments_fit_and_lose_no_word(text, limit):
    s = T.segment_one(text, limit, T.word_tokens)["segments"]
    assert " ".join(x["text"] for x in s).split() == text.split()
    assert all(T.word_tokens(x["text"]) <= limit for x in s)


def test_page_ranges():
    assert [parse_pages(t, 5) for t in (None, "1", "1-3", "1,3-5")] == [[1, 2, 3, 4, 5], [1], [1, 2, 3], [1, 3, 4, 5]]
    for bad in ("", "0", "2-1", "1,1", "1-3,3", "1,a", "6"):
        with pytest.raises(ValueError):
            parse_pages(bad, 5)


def test_discovery(spark):
    paths = spark.createDataFrame([("out/a.pdf",), ("a.ru.pdf",), ("b.pdf",), ("sub/C.PDF",), ("d.txt",)], "path string")
    found = {r["path"]: r["skip"] for r in skip_reasons(paths, exclude=("**/c.pdf",), output="out").collect()}
    assert found == {"out/a.pdf": "inside_output", "a.ru.pdf": "already_translated", "b.pdf": None, "sub/C.PDF": "excluded", "d.txt": "not_a_pdf"}
    assert paths.where(glob_matches(F.col("path"), "*.txt")).count() == 1


def test_typed_blocks(spark):
    raw = spark.createDataFrame([("d", 1, 0, 0, "  ", 0.0, 0.0, 1.0, 1.0), ("d", 1, 1, 0, " a ", 1.0, 2.0, 3.0, 4.0), ("d", 1, 1, 1, "b", 0.0, 3.0, 2.0, 6.0)], "doc string, page int, block int, line int, text string, x0 double, y0 double, x1 double, y1 double")
    r = typed_blocks(raw).first()
    assert (r["text"], r["block_id"], r["x0"], r["y1"]) == ("a\nb", "p0001-b0001", 0.0, 6.0)


SECRET = Glossary((Term("short", "Service", "S", match="whole_word", priority=10), Term("long", "Secret Service", "SS", priority=10), Term("priority", "Secret", "X", match="whole_word", priority=20)))


def test_glossary_precedence_and_boundaries(spark):
    units = spark.createDataFrame([("u", "Secret Service")], "unit_id string, text string")
    assert [r["term"] for r in glossary_matches(units, SECRET).orderBy("place").collect()] == ["priority", "short"]
    other = Glossary((Term("kgb", "KGB", "K", case_sensitive=True, match="whole_word"), Term("service", "Secret Service", "SS")))
    units = spark.createDataFrame([("u", "KGB, not XKGB; secret   service and KGB.")], "unit_id string, text string")
    assert [r["term"] for r in glossary_matches(units, other).orderBy("place").collect()] == ["kgb", "service", "kgb"]
    row = units.select(prepare(F.col("text"), matches(F.col("text"), other), other).alias("g")).first()["g"]
    assert row["text"] == "__TERM_0000__, not XKGB; __TERM_0001__ and __TERM_0002__." and [t["token"] for t in row["tokens"]] == ["K", "SS", "K"]


def test_glossary_conflicts_and_fingerprint():
    a, b = Term("a", "x", "1"), Term("b", "X", "2")
    assert conflicts((a, b)) and conflicts((a, a)) and not conflicts((a,))
    assert Glossary((a, Term("c", "z", "3"))).fingerprint() == Glossary((Term("c", "z", "3", notes="n"), a)).fingerprint()


UNITS = "unit_id string, unit_order int, text string, policy string"


def test_dedup_and_skips(spark):
    rows = [("1", 1, "Keep code 1234.", "translate"), ("2", 2, "Keep code 1234.", "translate"), ("3", 3, "42", "translate"), ("4", 4, "A plain sentence.", "translate"), ("5", 5, "As it is", "preserve"), ("6", 6, "Gone", "skip")]
    planned = plan_units(spark.createDataFrame(rows, UNITS), None, TranslationOptions())
    done = finish_units(planned, translate_misses(planned.where("status = 'miss'"), TranslationOptions()))
    c = run_counters(done).first()
    assert (c["n_hits"], c["n_skipped"], c["n_misses"], c["n_segments"]) == (1, 3, 2, 2)
    assert [r["translated"] for r in done.orderBy("unit_order").collect()] == ["RU Keep code 1234."] * 2 + ["42", "RU A plain sentence.", "As it is", ""]


def test_memory_makes_a_warm_run(spark, tmp_path):
    units = spark.createDataFrame([(str(i), i, f"text number {i % 42} of many words", "translate") for i in range(100)], UNITS)
    memory, o = Memory(spark, str(tmp_path / "memory")), TranslationOptions()
    planned = plan_units(units, None, o)
    done = translate_misses(planned.where("status = 'miss'"), o)
    memory.put(new_memory(done))
    assert {r["status"]: r["count"] for r in planned.groupBy("status").count().collect()} == {"miss": 42, "hit": 58}
    warm = plan_units(units, memory.read(), o)
    assert warm.where("status = 'hit'").count() == 100
    assert merge_memory(memory.read(), memory.read()).count() == 42


class Small(PrefixTranslator):
    def translate_batch(self, texts):
        if len(texts) > 2:
            raise MemoryError
        return super().translate_batch(texts)


class Logged(PrefixTranslator):
    """Writes down each text that it is given; its answers differ from call to call."""

    folder = ""

    def translate_batch(self, texts):
        import os
        import uuid

        with open(os.path.join(self.folder, uuid.uuid4().hex), "w") as f:
            f.write("\n".join(texts))
        return [f"RU {t} {uuid.uuid4().hex}" for t in texts]


def logged(folder):
    folder.mkdir()
    return type("LoggedHere", (Logged,), {"folder": str(folder)}), lambda: sorted(line for p in folder.iterdir() for line in p.read_text().split("\n"))


def test_each_text_is_translated_once(spark, tmp_path):
    """Also where the result and the memory are read several times."""
    model, asked = logged(tmp_path / "log")
    units = spark.createDataFrame([(str(i), i, f"text {'abc'[i % 3]} here", "translate") for i in range(9)], UNITS)
    memory = Memory(spark, str(tmp_path / "memory"))
    done = DocumentRun(spark, translator=model).translate(units, memory)
    first = {r["unit_id"]: r["translated"] for r in done.collect()}
    assert {r["unit_id"]: r["translated"] for r in done.collect()} == first
    assert {r["translated_text"] for r in memory.read().collect()} == set(first.values()) and len(set(first.values())) == 3
    assert asked() == ["text a here", "text b here", "text c here"]


def test_a_repeated_micro_batch_asks_no_model_again(spark, tmp_path):
    import shutil

    from quire.streaming.incremental import translate_stream

    model, asked = logged(tmp_path / "log")
    units = spark.createDataFrame([(str(i), i, f"text {'abc'[i % 3]} here", "translate") for i in range(5)], UNITS)
    units.write.parquet(str(tmp_path / "in"))
    out = tmp_path / "out"
    run = lambda: translate_stream(spark, spark.readStream.schema(UNITS).parquet(str(tmp_path / "in")), str(out), translator=model).awaitTermination()
    rows = lambda: sorted(map(tuple, spark.read.parquet(str(out / "translated")).select("unit_id", "status", "translated").collect()))
    run()
    before = rows()
    for p in [*(out / "checkpoint" / "commits").iterdir(), out / "translated"]:  # as if it had been killed before the commit
        shutil.rmtree(p) if p.is_dir() else p.unlink()
    run()
    assert rows() == before and asked() == ["text a here", "text b here", "text c here"]


def test_long_words_and_many_tokens():
    """Bisection over a long word, and one pass over thousands of marks."""
    calls = []
    s = T.segment_one("x" * 20_000, 512, lambda t: calls.append(1) or len(t))
    assert [len(x["text"]) for x in s["segments"]] == [512] * 39 + [32] and s["forced"] and len(calls) < 2000
    tokens = [{"mark": f"__KEEP_{i:04d}__", "token": str(i)} for i in range(20_000)]
    core = re.compile(T.CORE_MARK)
    assert T.restore_one(" ".join(t["mark"] for t in tokens), tokens, core) == " ".join(map(str, range(20_000)))
    assert T.restore_one("___KEEP_0000___ __KEEP_0000__", [{"mark": "___KEEP_0000___", "token": "x"}], core) == "x __KEEP_0000__"


def test_halving():
    assert halving(Small(), list("abcde")) == [f"RU {x}" for x in "abcde"]


def test_stream_resumes(spark, tmp_path):
    from quire.streaming.incremental import progress, translate_stream

    folder = str(tmp_path / "in")
    units = lambda a, b: spark.createDataFrame([(str(i), i, f"text {'abc'[i % 3]} here", "translate") for i in range(a, b)], UNITS)
    for k, (a, b) in enumerate([(0, 5), (5, 9)]):
        units(a, b).write.mode("append").parquet(folder)
        translate_stream(spark, spark.readStream.schema(UNITS).parquet(folder), str(tmp_path / "out")).awaitTermination()
    found = {(r["batch"], r["status"]): r["n"] for r in progress(spark, str(tmp_path / "out")).collect()}
    assert found == {(0, "miss"): 3, (0, "hit"): 2, (1, "hit"): 4}
