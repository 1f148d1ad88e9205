"""Glossary: loading, matching with deterministic overlap resolution, fixed terms, compliance."""

from __future__ import annotations

import bisect
import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.text import TERM_MARK, compose, fold_case

RANK = {"exact": 3, "phrase": 2, "whole_word": 1}
REVISION = 1


@dataclass(frozen=True)
class Term:
    id: str
    source: str
    target: str
    mode: str = "translate"  # or preserve
    case_sensitive: bool = False
    match: str = "phrase"  # or exact, whole_word
    inflection: str = "fixed"  # or flexible
    priority: int = 0
    notes: str | None = None

    def __post_init__(self) -> None:
        if not self.source.strip() or not self.target or self.mode not in ("translate", "preserve") or self.match not in RANK or self.inflection not in ("fixed", "flexible") or abs(self.priority) > 10_000:
            raise ValueError(f"term {self.id} isn't valid")

    def effective_source(self) -> str:
        text = " ".join(unicodedata.normalize("NFC", self.source).split())
        return text if self.case_sensitive else text.casefold()

    def pattern(self) -> str:
        body = r"\s+".join(map(re.escape, self.source.split()))
        return rf"\A\s*{body}\s*\Z" if self.match == "exact" else rf"(?<!\w){body}(?!\w)"

    @property
    def fixed(self) -> bool:
        return self.mode == "preserve" or self.inflection == "fixed"


@dataclass(frozen=True)
class Glossary:
    terms: tuple[Term, ...]
    version: str = "1"
    source_language: str = "en"
    target_language: str = "ru"

    def __post_init__(self) -> None:
        if found := conflicts(self.terms):
            raise ValueError("; ".join(found))

    def fingerprint(self) -> str:
        """The hash of what has an effect: not of notes, nor of the order of the terms."""
        terms = [{k: v for k, v in asdict(t).items() if k != "notes"} | {"source": t.effective_source(), "target": unicodedata.normalize("NFC", t.target)} for t in sorted(self.terms, key=lambda t: t.id)]
        whole = {"version": self.version, "languages": [self.source_language, self.target_language], "revision": REVISION, "terms": terms}
        return hashlib.sha256(json.dumps(whole, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def conflicts(terms: tuple[Term, ...]) -> list[str]:
    """Repeated ids, repeated sources of one kind, a source with two modes, and names of our marks."""
    out, ids, kinds, modes = [], set(), set(), {}
    for t in terms:
        source = t.effective_source()
        out += [f"id {t.id} is repeated"] if t.id in ids else []
        out += [f"{t.id}: the same source, match and case again"] if (source, t.match, t.case_sensitive) in kinds else []
        out += [f"{t.id}: its source has another mode elsewhere"] if modes.get(source.casefold(), t.mode) != t.mode else []
        out += [f"{t.id}: its source or target has a reserved mark"] if "__TERM_" in t.source + t.target else []
        ids.add(t.id)
        kinds.add((source, t.match, t.case_sensitive))
        modes[source.casefold()] = t.mode
    return out


def load_glossary(spark: SparkSession, path: str) -> Glossary:
    """From a JSON file that Spark can read."""
    text = spark.read.text(path, wholetext=True).first()
    data = json.loads(text[0])
    return Glossary(tuple(Term(**{k: v for k, v in e.items()}) for e in data["entries"]), data.get("glossary_version", "1"), data.get("source_language", "en"), data.get("target_language", "ru"))


def letter(c: str) -> str:
    """One small letter for all that a pattern without regard to case takes for the same character (and, now and then, for some more)."""
    return c.lower()[0].upper()[0].lower()[0]


class Matcher:
    """All terms at once: a trie over the runs of word characters of their sources.

    A term can begin only where the run of its first word does, so a text is walked run by run: the cost is that of its runs, whatever the
    number of terms. Where a path of the trie ends, the terms that end there are verified by their own expressions, which decide about
    case, punctuation and spaces. Terms for whole texts are looked up by the text's runs. Terms whose first word has no word character have no place in the
    trie and scan the text.
    """

    RUN = re.compile(r"\w+")

    def __init__(self, terms: tuple[Term, ...]):
        self.terms, self.compiled = terms, {}
        self.trie: dict = {}
        self.whole: dict[tuple[str, ...], list[int]] = {}
        self.scanned: list[int] = []
        self.known: dict[str, str] = {}
        for k, t in enumerate(terms):
            words = t.source.split()
            runs = tuple(self.folded(r) for r in self.RUN.findall(t.source))
            if t.match == "exact":
                self.whole.setdefault(runs, []).append(k)
            elif not (first := self.RUN.search(words[0])):
                self.scanned.append(k)
            else:
                node = self.trie
                for run in runs:
                    node = node.setdefault(run, {})
                node.setdefault(None, []).append((k, first.start()))

    def folded(self, run: str) -> str:
        out = self.known.get(run)
        if out is None:
            if len(self.known) > 200_000:
                self.known.clear()
            out = self.known[run] = run.lower() if run.isascii() else "".join(map(letter, run))
        return out

    def pattern(self, k: int) -> re.Pattern[str]:
        if k not in self.compiled:
            t = self.terms[k]
            self.compiled[k] = re.compile(t.pattern(), 0 if t.case_sensitive else re.IGNORECASE)
        return self.compiled[k]

    def candidates(self, text: str) -> Iterator[tuple[int, int, int]]:
        """term, start, end: every match of every term, those of one term apart from each other."""
        spans = [m.span() for m in self.RUN.finditer(text)]
        runs = [self.folded(text[a:b]) for a, b in spans]
        ended: dict[int, int] = {}
        for i, (start, _) in enumerate(spans):
            node, j = self.trie.get(runs[i]), i + 1
            while node is not None:
                for k, before in node.get(None, ()):
                    m = self.pattern(k).match(text, start - before) if start - before >= ended.get(k, 0) else None
                    if m:
                        ended[k] = m.end()
                        yield k, m.start(), m.end()
                node, j = (node.get(runs[j]) if j < len(runs) else None), j + 1
        for k in self.whole.get(tuple(runs), ()):
            if m := self.pattern(k).match(text):
                yield k, m.start(), m.end()
        for k in self.scanned:
            yield from ((k, *m.span()) for m in self.pattern(k).finditer(text))

    def select(self, text: str) -> list[dict]:
        """Candidates by priority, length, case, kind and id; later ones that overlap go."""
        t = self.terms
        found = sorted((-t[k].priority, a - b, not t[k].case_sensitive, -RANK[t[k].match], t[k].id, a, b) for k, a, b in self.candidates(text))
        # taken spans stay sorted and apart, so only the two neighbours of a place can be in the way
        starts: list[int] = []
        taken: list[tuple[int, int, str]] = []
        for *_, term, start, end in found:
            at = bisect.bisect_left(starts, start)
            if (at == 0 or taken[at - 1][1] <= start) and (at == len(taken) or end <= starts[at]):
                starts.insert(at, start)
                taken.insert(at, (start, end, term))
        return [{"start": a, "end": b, "term": i} for a, b, i in taken]


def matches(c: Column, glossary: Glossary) -> Column:
    """start, end and term of each selected match."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("term", pa.string())]))

    @F.arrow_udf("array<struct<start:int,end:int,term:string>>")
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        matcher = Matcher(glossary.terms)  # once for each task
        for texts in batches:
            yield pa.array([matcher.select(text or "") for text in texts.to_pylist()], kind)

    return find(c)


def terms_table(spark: SparkSession, glossary: Glossary) -> DataFrame:
    return spark.createDataFrame([(t.id, t.source, t.target, t.mode, t.fixed, t.match, t.priority) for t in glossary.terms], "term string, source string, target string, mode string, fixed boolean, match string, priority int")


def glossary_matches(units: DataFrame, glossary: Glossary, text: str = "text", key: str = "unit_id") -> DataFrame:
    """A row per selected match, with its place among the unit's matches."""
    rows = units.select(key, F.posexplode(matches(F.col(text), glossary)).alias("place", "m")).select(key, "place", "m.*")
    return rows.join(F.broadcast(terms_table(units.sparkSession, glossary)), "term")  # a row per term of a driver-side list


def prepare(c: Column, found: Column, glossary: Glossary) -> Column:
    """text with the fixed terms as marks, numbered by match, and what the marks stand for."""
    # one literal, whatever the number of terms
    fixed = F.from_json(F.lit(json.dumps({t.id: t.target for t in glossary.terms if t.fixed})), "map<string,string>")
    # from the last match on, so that earlier offsets stay valid
    numbered = F.reverse(F.transform(found, lambda m, i: F.struct(m["start"].alias("start"), m["end"].alias("end"), m["term"].alias("term"), F.format_string(TERM_MARK.replace("{:04d}", "%04d"), i).alias("mark"))))
    fixed_only = F.filter(numbered, lambda m: F.map_contains_key(fixed, m["term"]))
    text = F.aggregate(fixed_only, c, lambda acc, m: F.concat(F.substring(acc, F.lit(1), m["start"]), m["mark"], F.substring(acc, m["end"] + 1, F.length(acc))))
    marks = F.reverse(F.transform(fixed_only, lambda m: F.struct(m["mark"].alias("mark"), F.element_at(fixed, m["term"]).alias("token"))))
    return F.struct(text.alias("text"), marks.alias("tokens"))


def compliance(matched: DataFrame, outputs: DataFrame, key: str = "unit_id") -> DataFrame:
    """Of each unit and term: matches, times that the output has the target, and whether that is enough. outputs: key, translated."""
    need = matched.groupBy(key, "term", "target", "mode").agg(F.count("*").alias("required"))
    have = ((F.length("translated") - F.length(F.replace("translated", F.col("target")))) / F.length("target")).cast("long")
    return need.join(outputs, key).select(key, "term", "mode", "required", have.alias("present"), (have >= F.col("required")).alias("compliant"))


def statistics(matched: DataFrame, glossary: Glossary) -> DataFrame:
    """Of a run: terms, matched and unmatched ones, occurrences, and those kept or required."""
    all_terms = terms_table(matched.sparkSession, glossary).select("term", "mode")
    counts = matched.groupBy("term").agg(F.count("*").alias("n"))
    joined = all_terms.join(counts, "term", "left").fillna(0, ["n"])
    return joined.agg(F.count("*").alias("n_terms"), F.count_if(F.col("n") > 0).alias("n_matched"), F.count_if(F.col("n") == 0).alias("n_unmatched"), F.sum("n").cast("long").alias("n_occurrences"), F.sum(F.when(F.col("mode") == "preserve", F.col("n")).otherwise(0)).cast("long").alias("n_preserved"), F.sum(F.when(F.col("mode") == "translate", F.col("n")).otherwise(0)).cast("long").alias("n_required"))


# A glossary as a table: for terms that don't fit a driver's list, or come from other tables

TERMS = "id string, source string, target string, mode string, case_sensitive boolean, match string, inflection string, priority int, notes string"


def read_terms(spark: SparkSession, path: str) -> DataFrame:
    """The terms of JSON glossary files, with the defaults of ``Term`` where a value is missing."""
    files = spark.read.schema(f"entries array<struct<{TERMS.replace(' ', ':').replace(',:', ',')}>>").option("multiLine", "true").json(path)
    rows = files.select(F.explode("entries").alias("e")).select("e.*")
    given = {f: getattr(Term, f) for f in ("mode", "case_sensitive", "match", "inflection", "priority")}
    return rows.withColumns({f: F.coalesce(F.col(f), F.lit(v)) for f, v in given.items()})


def with_effective_source(terms: DataFrame) -> DataFrame:
    """effective: the source composed, with single spaces and, unless case matters, folded; folded: the same without regard to case."""
    plain = F.trim(F.regexp_replace(compose(F.col("source")), r"(?U)\s+", " "))
    return terms.withColumn("plain", plain).withColumn("folded", fold_case(F.col("plain"))).withColumn("effective", F.when(F.col("case_sensitive"), F.col("plain")).otherwise(F.col("folded"))).drop("plain")


def invalid_terms(terms: DataFrame) -> DataFrame:
    """id, problem: blank sources, empty targets, unknown modes, kinds and inflections, priorities out of range, and names of our marks."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    rules = (
        (blank("id"), "no id"), (blank("source"), "no source"), (F.coalesce("target", F.lit("")) == "", "no target"), (~F.coalesce(F.col("mode").isin("translate", "preserve"), F.lit(False)), "unknown mode"),
        (~F.coalesce(F.col("match").isin(*RANK), F.lit(False)), "unknown kind of match"), (~F.coalesce(F.col("inflection").isin("fixed", "flexible"), F.lit(False)), "unknown inflection"),
        (F.coalesce(F.abs("priority") > 10_000, F.lit(False)), "priority out of range"), (F.contains(F.concat_ws(" ", "source", "target"), F.lit("__TERM_")), "reserved mark"),
    )
    return terms.select("id", F.explode(F.array_compact(F.array(*[F.when(c, p) for c, p in rules]))).alias("problem"))


def term_conflicts(terms: DataFrame) -> DataFrame:
    """problem, source, ids (the least and the greatest), n: repeated ids, repeated sources of one kind and case, and sources with two modes. Aggregates, partly done before each shuffle."""
    rows = with_effective_source(terms)
    ids = [F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.count("*").alias("n")]
    same = rows.groupBy("id").agg(F.min("effective").alias("source"), F.count("*").alias("n")).where("n > 1").select(F.lit("repeated id").alias("problem"), "source", F.col("id").alias("first_id"), F.col("id").alias("last_id"), "n")
    again = rows.groupBy("effective", "match", "case_sensitive").agg(*ids).where("n > 1").select(F.lit("repeated source").alias("problem"), F.col("effective").alias("source"), "first_id", "last_id", "n")
    modes = rows.groupBy("folded").agg(*ids, F.min("mode").alias("a"), F.max("mode").alias("b")).where("a <> b").select(F.lit("two modes").alias("problem"), F.col("folded").alias("source"), "first_id", "last_id", "n")
    return same.unionByName(again).unionByName(modes)


def terms_fingerprint(terms: DataFrame, version: str = "1", source_language: str = "en", target_language: str = "ru") -> DataFrame:
    """fingerprint, n_terms: a hash of what has an effect, as an order-free sum of the rows' hashes, so that no task sees all terms."""
    said = F.to_json(F.struct("id", F.col("effective").alias("source"), compose(F.col("target")).alias("target"), "mode", "case_sensitive", "match", "inflection", "priority"))
    rows = with_effective_source(terms).select(F.sha2(said, 256).alias("h"))
    part = lambda at: F.sum(F.conv(F.substring("h", at, 15), 16, 10).cast("decimal(38,0)"))
    sums = rows.agg(*[F.coalesce(part(1 + 15 * k), F.lit(0)).cast("decimal(38,0)").cast("string").alias(f"s{k}") for k in range(4)], F.count("*").alias("n_terms"))
    whole = F.concat_ws(chr(0), F.lit(version), F.lit(source_language), F.lit(target_language), F.lit(str(REVISION)), F.col("n_terms").cast("string"), *[F.col(f"s{k}") for k in range(4)])
    return sums.select(F.sha2(whole, 256).alias("fingerprint"), "n_terms")


def collected_glossary(terms: DataFrame, most: int = 100_000, **names: str) -> Glossary:
    """A table's terms as a list, for matching; more than ``most`` are an error, since every task holds them all."""
    rows = terms.select(*[f.split(" ")[0] for f in TERMS.split(", ")]).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"the glossary has over {most} terms")
    return Glossary(tuple(Term(**r.asDict()) for r in sorted(rows, key=lambda r: r["id"])), **names)
