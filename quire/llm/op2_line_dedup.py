"""Line dedup with sharded minimal perfect hashes.

A line's key is the line without ASCII white space at its ends and with A-Z lower-cased. Long keys are hashed to 128
bits and counted by document. The distinct hashes are dealt to shards (but for those of a single document, which no probe
could find frequent); each shard's task builds a minimal perfect hash over them (levels of bit arrays; a key's rank among
the set bits is its slot) with arrays of fingerprints, document counts and last documents in slot order. Documents probe the
arrays: a line is frequent if its slot holds its fingerprint and a large enough count. The fingerprint is half of the hash
and the other half helps to find the slot, so a wrong match needs two keys that agree in about 128 bits.

A shard has about ``SHARD_LINES`` lines, which are counted first, so that what one task builds doesn't grow with the table or with
its documents. Where all arrays together are below ``broadcast_bytes`` (their size is summed first) every task gets them; beyond it the
line hashes, not the documents, are dealt to the shards, as many salted copies of a shard as its lines need sharing the load, and
the indexes of the lines to be dropped meet the documents by doc_id and a hash of the text (hashed or broadcast, as they are few).

Keys of at least ``least_chars`` code points found in at least ``least_docs`` documents (distinct doc_ids) lose all lines but those
of the largest doc_id that has the key. Nulls: a null text is one empty line; a null doc_id is no document to count, and its
frequent lines go. All rows with the largest doc_id keep the line. Very long texts and lines are read whole. An empty table
gives no rows. Columns named like this operator's are replaced.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import LOWER_BYTES, recoded, settle, small_batches, small_side, table

STRIP = b" \t\n\x0b\x0c\r"
GAMMA = 2.0  # bits of a level for each of its keys
SHARD_LINES = 100_000  # of several documents, in one shard
SALT_LINES = 500_000  # that a copy of a shard serves, where lines are dealt to shards
NULL_ID = -(1 << 63)


def _mix(x: np.ndarray, level: int) -> np.ndarray:
    """A hash of 64-bit values for each level (the finaliser of splitmix64)."""
    z = x + np.uint64((0x9E3779B97F4A7C15 * (level + 1)) % (1 << 64))
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


class PerfectHash:
    """A minimal perfect hash over distinct unsigned 64-bit keys: keys alone at their position of a level get its bit; the others go to the next level, the last few to a sorted list."""

    def __init__(self, keys: np.ndarray, levels: int = 24):
        self.levels: list[tuple[int, np.ndarray, np.ndarray, int]] = []
        rest, base = np.asarray(keys, dtype=np.uint64), 0
        while len(rest) and len(self.levels) < levels:
            size = max(64, int(GAMMA * len(rest)))
            place = (_mix(rest, len(self.levels)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(place, minlength=size) == 1
            ranks = np.concatenate([[0], np.cumsum(np.add.reduceat(alone, np.arange(0, size, 64)))])[:-1].astype(np.uint32)  # set bits before each block of 64
            self.levels.append((size, np.packbits(alone), ranks, base))
            base += int(alone.sum())
            rest = rest[~alone[place]]
        self.last, self.base, self.size = np.sort(rest), base, base + len(rest)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """A slot below size for each key of the set; for others some slot or -1."""
        keys = np.asarray(keys, dtype=np.uint64)
        out, rest = np.full(len(keys), -1, dtype=np.int64), np.arange(len(keys))
        for level, (size, bits, ranks, base) in enumerate(self.levels):
            place = (_mix(keys[rest], level) % np.uint64(size)).astype(np.int64)
            hit = bits[place >> 3] >> (7 - (place & 7)).astype(np.uint8) & 1 == 1
            at = place[hit]
            block = np.minimum(np.arange(8)[None, :] + (at >> 6)[:, None] * 8, len(bits) - 1)
            first = (at >> 6) * 64
            before = np.bitwise_count(np.where(np.arange(8)[None, :] * 8 + first[:, None] + 8 <= at[:, None], bits[block], 0)).sum(axis=1, dtype=np.int64)
            partial = np.bitwise_count(bits[at >> 3] >> (8 - (at & 7)).astype(np.uint8))
            out[rest[hit]] = base + ranks[at >> 6] + before + np.where(at & 7, partial, 0)
            rest = rest[~hit]
        if len(self.last) and len(rest):
            i = np.minimum(np.searchsorted(self.last, keys[rest]), len(self.last) - 1)
            same = self.last[i] == keys[rest]
            out[rest[same]] = self.base + i[same]
        return out


def _joined(first: np.ndarray, second: np.ndarray, seed: int) -> np.ndarray:
    return _mix(first.view(np.uint64), 1000 + seed) ^ second.view(np.uint64)


class LineShard:
    """The keys of a shard: fingerprints, counts and last documents in the order of the slots."""

    def __init__(self, first: np.ndarray, second: np.ndarray, counts: np.ndarray, last: np.ndarray):
        self.seed = 0
        while len(np.unique(keys := _joined(first, second, self.seed))) < len(keys):
            self.seed += 1
        self.hash = PerfectHash(keys)
        slot = self.hash.slots(keys)
        self.second, self.counts, self.last = np.empty_like(second), np.empty(len(second), np.uint32), np.empty_like(last)
        self.second[slot], self.counts[slot], self.last[slot] = second, np.minimum(counts, 2**32 - 1), last

    def last_of(self, first: np.ndarray, second: np.ndarray, least_docs: int) -> tuple[np.ndarray, np.ndarray]:
        """Which of the lines so many documents have, and the last document of those."""
        slot = self.hash.slots(_joined(first, second, self.seed))
        found = np.maximum(slot, 0)
        return (slot >= 0) & (self.second[found] == second) & (self.counts[found] >= least_docs), self.last[found]

    def dump(self) -> bytes:
        return pickle.dumps(self.__dict__ | {"hash": self.hash.__dict__}, protocol=5)

    @classmethod
    def load(cls, data: bytes) -> LineShard:
        out = cls.__new__(cls)
        out.hash, state = PerfectHash.__new__(PerfectHash), pickle.loads(data)
        out.hash.__dict__.update(state.pop("hash"))
        out.__dict__.update(state)
        return out


def line_hashes(text: Column, least_chars: int) -> Column:
    """For each line of a text: the two halves of its key's hash; null for short keys."""
    kind = pa.struct([("first", pa.int64()), ("second", pa.int64())])

    @F.arrow_udf("array<struct<first:long,second:long>>")
    def hashes(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            _, offsets, data = recoded(texts, LOWER_BYTES).buffers()
            at, raw = np.frombuffer(offsets, dtype=np.int64)[: len(texts) + 1].tolist(), data.to_pybytes() if data is not None else b""
            digests, short, ends = bytearray(), [], [0]
            for a, b in zip(at, at[1:], strict=False):
                for line in raw[a:b].split(b"\n"):
                    key = line.strip(STRIP)
                    long = len(key) >= least_chars and (len(key) >= 4 * least_chars or len(key.decode()) >= least_chars)
                    digests += xxhash.xxh3_128_digest(key) if long else bytes(16)
                    short.append(not long)
                ends.append(len(short))
            halves = np.frombuffer(bytes(digests), dtype="<i8").reshape(-1, 2)
            values = pa.StructArray.from_arrays([pa.array(halves[:, 0]), pa.array(halves[:, 1])], fields=list(kind), mask=pa.array(short, pa.bool_()))
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)

    return hashes(text)


def shared_lines(lines: DataFrame) -> DataFrame:
    """first, second, docs, last: the lines of several documents. lines: doc_id and the array of line hashes of each document."""
    each = lines.where("doc_id IS NOT NULL").select("doc_id", F.explode(F.array_distinct(F.filter("hashes", lambda h: h.isNotNull()))).alias("h")).select("doc_id", "h.*")
    return each.groupBy("first", "second").agg(F.count_distinct("doc_id").alias("docs"), F.max("doc_id").alias("last")).where("docs > 1")


def build_shards(several: DataFrame, shards: int) -> DataFrame:
    """shard, data: the arrays of each shard. several: of ``shared_lines``."""
    several = several.withColumn("shard", F.pmod(F.xxhash64("second"), F.lit(shards)).cast("int"))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        made = LineShard(*(pdf[c].to_numpy(np.int64) for c in ("first", "second", "docs", "last")))
        return pd.DataFrame({"shard": [pdf["shard"].iloc[0]], "data": [made.dump()]})

    return several.groupBy("shard").applyInPandas(build, "shard int, data binary")


def line_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", least_chars: int = 40, least_docs: int = 5, shards: int | None = None, broadcast_bytes: int = 32 << 20) -> DataFrame:
    """The rows with ``lines`` (of the text), ``dropped`` (their indexes from 0, sorted) and ``kept_text``."""
    small_batches(docs.sparkSession)
    docs = docs.drop("lines", "dropped", "kept_text")
    split = F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)
    lines = docs.select(F.col(doc_id).cast("long").alias("doc_id"), line_hashes(F.col(text), least_chars).alias("hashes"))
    several = settle(shared_lines(lines))
    if shards is None:
        shards = max(16, several.count() // SHARD_LINES)
    made = settle(build_shards(several, shards))
    size = made.agg(F.sum(F.length("data"))).first()[0] or 0
    rows = docs.withColumns({"__doc": F.coalesce(F.col(doc_id).cast("long"), F.lit(NULL_ID)), "__same": F.xxhash64(F.coalesce(F.col(text), F.lit(""))), "lines": split})
    rows = rows.withColumn("__hashes", line_hashes(F.col(text), least_chars))
    flagged = _probe_here(rows, made, shards, least_docs) if size <= broadcast_bytes else _probe_there(rows, made, shards, least_docs)
    kept = F.transform(F.filter(F.transform("lines", lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda s: ~F.array_contains("dropped", s["i"])), lambda s: s["x"])
    return flagged.withColumn("kept_text", F.array_join(kept, "\n")).drop("__doc", "__same", "__hashes")


def _probe_here(rows: DataFrame, made: DataFrame, shards: int, least_docs: int) -> DataFrame:
    """The arrays are small: every task has them all."""
    data = rows.sparkSession.sparkContext.broadcast(dict(made.collect()))

    @F.arrow_udf("array<int>")
    def dropped(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        tables = {k: LineShard.load(v) for k, v in data.value.items()}
        for docs, hashes in batches:
            flat, n = hashes.flatten(), np.asarray(pc.list_value_length(hashes))
            row = np.repeat(np.arange(len(hashes)), n)
            at = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
            there = np.flatnonzero(np.asarray(flat.is_valid()))
            first, second = (np.asarray(pc.struct_field(flat, k).fill_null(0), dtype=np.int64)[there] for k in (0, 1))
            shard = np.asarray(_shard_of(second, shards))
            drop = np.zeros(len(there), dtype=bool)
            doc = np.asarray(docs, dtype=np.int64)[row[there]]
            for k, t in tables.items():
                mine = np.flatnonzero(shard == k)
                known, last = t.last_of(first[mine], second[mine], least_docs)
                drop[mine] = known & (last != doc[mine])
            hit = there[drop]
            ends = np.searchsorted(row[hit], np.arange(len(hashes) + 1))
            yield pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(at[hit].astype(np.int32)))

    return rows.withColumn("dropped", dropped("__doc", "__hashes"))


def _shard_of(second: np.ndarray, shards: int) -> np.ndarray:
    """As pmod(xxhash64(second), shards) in SQL."""
    return np.array([(v - (1 << 64) if (v := xxhash.xxh64_intdigest(int(x).to_bytes(8, "little", signed=True), 42)) >= 1 << 63 else v) % shards for x in second.tolist()], dtype=np.int64)


def _probe_there(rows: DataFrame, made: DataFrame, shards: int, least_docs: int) -> DataFrame:
    """The line hashes go to the shards; the lines to drop come back by document and text."""
    lines = rows.select("__doc", "__same", F.posexplode("__hashes").alias("at", "h")).where("h IS NOT NULL").select("__doc", "__same", "at", "h.*")
    lines = lines.withColumn("shard", F.pmod(F.xxhash64("second"), F.lit(shards)).cast("int"))
    salts = settle(lines.groupBy("shard").agg(F.ceil(F.count("*") / SALT_LINES).cast("int").alias("salts")))  # a row per shard
    lines = lines.join(F.broadcast(salts), "shard").withColumn("salt", F.pmod(F.xxhash64("__doc", "at"), F.col("salts")).cast("int")).drop("salts")
    copies = made.join(F.broadcast(salts), "shard").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")

    def probe(pdf: pd.DataFrame, shard: pd.DataFrame) -> pd.DataFrame:
        if not len(shard) or not len(pdf):
            return pd.DataFrame({"__doc": np.zeros(0, np.int64), "__same": np.zeros(0, np.int64), "at": np.zeros(0, np.int32)})
        known, last = LineShard.load(shard["data"].iloc[0]).last_of(pdf["first"].to_numpy(np.int64), pdf["second"].to_numpy(np.int64), least_docs)
        return pdf.loc[known & (last != pdf["__doc"].to_numpy(np.int64)), ["__doc", "__same", "at"]]

    hits = lines.groupBy("shard", "salt").cogroup(copies.groupBy("shard", "salt")).applyInPandas(probe, "__doc long, __same long, at int")
    by_row = hits.groupBy("__doc", "__same").agg(F.sort_array(F.collect_set("at")).alias("dropped"))
    found = rows.join(small_side(by_row), ["__doc", "__same"], "left")
    return found.withColumn("dropped", F.coalesce("dropped", F.array().cast("array<int>")))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.size("lines").cast("long").alias("n_lines"), F.size("dropped").cast("long").alias("n_dropped"), F.sha2("kept_text", 256).alias("kept_sha256"))


QUERIES = {"op2_line_dedup": op2_line_dedup}
SQL = {
    "op2_line_dedup": r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM d),
k AS (SELECT doc_id, line, i, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM l),
f AS (SELECT k, max(doc_id) AS last FROM k WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
j AS (SELECT k.doc_id, k.line, k.i, f.k IS NOT NULL AND k.doc_id IS DISTINCT FROM f.last AS dropped FROM k LEFT JOIN f ON k.k = f.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM j GROUP BY doc_id""",
}
