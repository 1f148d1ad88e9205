"""Secret scans with a trigram inverted index.

Each rule's regular expression is parsed into a Boolean query of trigrams that every match must contain. For each block of
texts a task builds the postings of the trigrams in question, intersects and unites them as the queries say, and runs a
rule only over its candidates. Rules without mandatory trigrams scan every text of the block. Blocks hold a bounded number
of bytes, and no row leaves its task, so there is no shuffle and no limit on a rule's candidates.

Offsets are code points, ends exclusive. Nulls and empty texts have no spans. Very long texts are read whole, one
larger than a block in a block of its own. Equal rows give equal results and are all kept; of spans that begin at one place the
kinds in the order of the rules come first. An empty table gives no rows. A column named like this operator's is replaced; others pass through.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from re import _parser
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import LOWER_BYTES, blocks, recoded, small_batches, table

MOST_STRINGS = 64  # of a set of alternatives; beyond it a query is closed and a new one begun
BLOCK_BYTES = 2 << 20
SPANS = "array<struct<kind:string,start:int,end:int>>"


@dataclass(frozen=True)
class SecretRule:
    """A match counts if its ``group`` has at least ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


BASE_RULES = (
    SecretRule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    SecretRule("access", r"AKIA[A-Z0-9]+", 0, 18),
    SecretRule("hex", r"[0-9a-f]{16,}"),
)
MORE_RULES = (
    SecretRule("github", r"gh[pousr]_[A-Za-z0-9]{36}"),
    SecretRule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    SecretRule("google", r"AIza[0-9A-Za-z_-]{35}"),
    SecretRule("pem", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
    SecretRule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
)
RULES = BASE_RULES + MORE_RULES

#: A query is None (anything fits), a trigram, or ("and" | "or", queries).
Query = Any


def _all_of(parts: list[Query]) -> Query:
    parts = [p for p in parts if p is not None]
    return None if not parts else parts[0] if len(parts) == 1 else ("and", parts)


def _any_of(parts: list[Query]) -> Query:
    return None if not parts or any(p is None for p in parts) else parts[0] if len(parts) == 1 else ("or", parts)


def _of_strings(strings: set[str]) -> Query:
    return _any_of([_all_of([s[i : i + 3] for i in range(len(s) - 2)]) for s in sorted(strings)])


def _members(items: list) -> set[str] | None:
    """The characters of a class in lower case; None if they are negated, categories or too many."""
    out: set[str] = set()
    for op, value in items:
        if op is _parser.LITERAL:
            out.add(chr(value).lower())
        elif op is _parser.RANGE and value[1] - value[0] <= MOST_STRINGS:
            out |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
        else:
            return None
    return out if len(out) <= 8 else None


def _analyse(items: Any) -> tuple[set[str] | None, Query]:
    """Of a sequence: all strings that it matches, if they are few; and a query that all its matches fulfil."""
    exact, closed, whole = {""}, [], True

    def close() -> None:
        nonlocal exact, whole
        closed.append(_of_strings(exact))
        exact, whole = {""}, False

    def extend(strings: set[str]) -> None:
        nonlocal exact
        if len(exact) * len(strings) > MOST_STRINGS:
            close()
        exact = {a + b for a in exact for b in strings} if len(strings) <= MOST_STRINGS else exact

    for op, value in items:
        if op is _parser.LITERAL:
            extend({chr(value).lower()})
        elif op is _parser.IN and (found := _members(value)):
            extend(found)
        elif op is _parser.AT:
            continue
        elif op is _parser.SUBPATTERN or op is _parser.BRANCH:
            branches = [value[-1]] if op is _parser.SUBPATTERN else value[1]
            seen = [_analyse(b) for b in branches]
            if all(s is not None for s, _ in seen) and len(union := set().union(*(s for s, _ in seen))) <= MOST_STRINGS:
                extend(union)
            else:
                close()
                closed.append(_any_of([q for _, q in seen]))
        elif op in (_parser.MAX_REPEAT, _parser.MIN_REPEAT):
            least, most, inner = value
            strings, query = _analyse(inner)
            if strings is not None and most == 1:
                extend(strings | ({""} if least == 0 else set()))
            else:
                close()
                if least:
                    closed.append(query)
        else:
            close()
    strings = exact if whole else None
    return strings, _all_of([*closed, _of_strings(exact)])


def trigram_query(pattern: str) -> Query:
    """A query over the lower-cased text; None if the pattern has no mandatory trigram."""
    return _analyse(_parser.parse(pattern))[1]


def trigrams_in(query: Query) -> set[str]:
    return set() if query is None else {query} if isinstance(query, str) else set().union(*(trigrams_in(q) for q in query[1]))


class TrigramIndex:
    """Postings, as bitmaps over the texts of a block, of the trigrams that the queries ask for."""

    def __init__(self, vocabulary: list[str]):
        self.places = {t: i for i, t in enumerate(vocabulary)}
        self.number = np.zeros(1 << 24, dtype=np.uint16)
        for t, i in self.places.items():
            a, b, c = t.encode("latin-1")
            self.number[a << 16 | b << 8 | c] = i + 1

    def postings(self, texts: pa.Array) -> np.ndarray:
        _, offsets, data = recoded(texts, LOWER_BYTES).buffers()
        at = np.frombuffer(offsets, dtype=np.int64)[: len(texts) + 1]
        raw = np.frombuffer(data, dtype=np.uint8).astype(np.uint32) if data is not None else np.zeros(0, np.uint32)
        bits = np.zeros((len(self.places), len(texts)), dtype=bool)
        if len(raw) >= 3:
            found = self.number[raw[:-2] << 16 | raw[1:-1] << 8 | raw[2:]]
            where = np.flatnonzero(found)
            row = np.searchsorted(at, where, side="right") - 1
            inside = where + 3 <= at[row + 1]
            bits[found[where[inside]] - 1, row[inside]] = True
        return bits

    def candidates(self, query: Query, bits: np.ndarray) -> np.ndarray:
        if query is None:
            return np.ones(bits.shape[1], dtype=bool)
        if isinstance(query, str):
            return bits[self.places[query]]
        parts = [self.candidates(q, bits) for q in query[1]]
        return np.logical_and.reduce(parts) if query[0] == "and" else np.logical_or.reduce(parts)


def find_secrets(docs: DataFrame, text: str = "text", rules: tuple[SecretRule, ...] = RULES, name: str = "secrets") -> DataFrame:
    """The rows with the spans of all rules, by start and then in the order of the rules."""
    small_batches(docs.sparkSession)

    @F.arrow_udf(SPANS)
    def spans(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        queries = [trigram_query(r.pattern) for r in rules]
        compiled = [re.compile(r.pattern, re.ASCII) for r in rules]
        index = TrigramIndex(sorted(set().union(*(trigrams_in(q) for q in queries))))
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

        def block(texts: pa.Array) -> list[list[tuple[int, int, int]]]:
            bits, found = index.postings(texts), [[] for _ in range(len(texts))]
            opened: dict[int, str] = {}
            for k, (rule, query) in enumerate(zip(rules, queries, strict=True)):
                for i in np.flatnonzero(index.candidates(query, bits)).tolist():
                    if i not in opened:
                        opened[i] = texts[i].as_py() or ""
                    found[i] += [(m.start(), k, m.end()) for m in compiled[k].finditer(opened[i]) if m.end(rule.group) - m.start(rule.group) >= rule.least]
            return found

        for texts in batches:
            out: list = []
            for a, b in blocks(pc.binary_length(texts), BLOCK_BYTES):
                out += [[{"kind": rules[k].kind, "start": s, "end": e} for s, k, e in sorted(row)] for row in block(texts.slice(a, b - a))]
            yield pa.array(out, kind)

    return docs.withColumn(name, spans(F.col(text)))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "secrets")
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long")
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("secrets", lambda s: s["kind"].isin([r.kind for r in BASE_RULES]))
    return found.select("doc_id", *[count(r.kind).alias(f"n_{r.kind}") for r in BASE_RULES], F.sha2(said(base), 256).alias("base_sha256"), said(F.col("secrets")).alias("spans"))


QUERIES = {"op5_secrets": op5_secrets}
#: SQL gives no offsets of matches; tests compare with a plain scan.
SQL: dict[str, str] = {}
