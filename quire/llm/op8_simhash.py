"""Near-duplicate detection with SimHash and the generalised pigeonhole principle.

The 64 bits of a fingerprint are grouped into partitions, correlated bits together. Two fingerprints within ``tau`` bits
must, for any thresholds t_i >= -1 with sum t_i = tau - m + 1, differ in at most t_i bits in some partition i. Thresholds
are allotted by dynamic programming over the estimated candidates of each partition (from counts over all fingerprints),
for several numbers of partitions; the cheapest plan is used. A threshold of 0 probes a partition's value, 1 also its
one-bit neighbours, 2 lets both sides emit one-bit neighbours, and -1 leaves the partition out.

Equal fingerprints are one node. Buckets of bounded size are verified in one task each and emit a star for each group of
linked members, never all pairs. Larger buckets have exact forms. For up to 2 bits: two different fingerprints within 2 bits
share one of their 65 one-bit neighbours, and at most 65 fingerprints meet at one. For more bits the pigeonhole principle is
applied again inside the bucket, with other groups of bits, level by level, until all buckets are small.

Nulls: a null text counts as empty, whose fingerprint is zero; a null doc_id never becomes a component's id, unless no
other is in it. Very long texts are read whole. Repeated rows are all kept; so are ties. An empty table gives no rows. The
result has the three columns of this operator, whatever others the table has.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import LOWER_BYTES, recoded, scratch, settle, small_batches, table
from quire.llm.graph import components

BITS = 64
#: Of a bucket that one task verifies.
BUCKET = 512
#: Relative costs of a shuffled key and of a verified pair.
KEY_COST, PAIR_COST = 100.0, 1.0


def majority(hashes: list[int] | np.ndarray) -> int:
    """The fingerprint whose bits are set in over half of the hashes."""
    if not len(hashes):
        return 0
    bits = np.unpackbits(np.array(hashes, dtype=">u8").view(np.uint8).reshape(-1, 8), axis=1)
    return int.from_bytes(np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > len(hashes)).tobytes(), "big")


def hashes_of(words: list[bytes], shingle: int) -> list[int]:
    """XXH64, seed 42, of the shingles, repeats included; of all words if they are fewer; none of no words."""
    if len(words) <= shingle:
        return [xxhash.xxh64_intdigest(b" ".join(words), 42)] if words else []
    return [xxhash.xxh64_intdigest(s, 42) for s in map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))]


def word_lists(texts: pa.Array) -> Iterator[list[bytes]]:
    """The words of each text, A-Z lower-cased, split at ASCII white space."""
    _, offsets, data = recoded(texts, LOWER_BYTES).buffers()
    at, raw = np.frombuffer(offsets, dtype=np.int64)[: len(texts) + 1].tolist(), data.to_pybytes() if data is not None else b""
    for a, b in zip(at, at[1:], strict=False):
        yield raw[a:b].split()


def simhash(text: str, shingle: int) -> Column:
    @F.arrow_udf("long")
    def fingerprint(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array(np.array([majority(hashes_of(w, shingle)) for w in word_lists(texts)], dtype=np.uint64).view(np.int64))

    return fingerprint(F.col(text))


@dataclass(frozen=True)
class Part:
    bits: tuple[int, ...]
    threshold: int

    @property
    def mask(self) -> int:
        return sum(1 << b for b in self.bits)


def signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def bit_statistics(prints: DataFrame) -> tuple[int, np.ndarray]:
    """Over all fingerprints: how many there are, and how often bits i and j are both set."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, both = 0, np.zeros((BITS, BITS), dtype=np.int64)
        for b in batches:
            x = np.unpackbits(np.asarray(b.column(0), dtype=np.int64).astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            n, both = n + len(x), both + (x.T @ x).astype(np.int64)
        if n:
            yield pa.record_batch([pa.array(np.arange(BITS * BITS + 1)), pa.array(np.concatenate([both.ravel(), [n]]))], names=["at", "n"])

    sums = dict(prints.select("fingerprint").mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n")).collect())
    return sums.get(BITS * BITS, 0), np.array([sums.get(i, 0) for i in range(BITS * BITS)], dtype=np.float64).reshape(BITS, BITS)


def group_bits(n: int, both: np.ndarray, parts: int) -> list[tuple[int, ...]]:
    """Groups of nearly equal size, each grown from its first free bit by the bits most correlated with the group."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread))
    free, out = list(range(BITS)), []
    for k in range(parts):
        group = [free.pop(0)]
        while len(group) < (BITS * (k + 1)) // parts - (BITS * k) // parts:
            best = max(free, key=lambda b: (corr[b, group].sum(), -b))
            free.remove(best)
            group.append(best)
        out.append(tuple(sorted(group)))
    return out


def plan_partitions(prints: DataFrame, tau: int) -> list[Part]:
    """The cheapest partitions and thresholds for this table. Thresholds are 2 at most, so many bits need many partitions."""
    if not 0 <= tau < BITS:
        raise ValueError(f"tau is from 0 to {BITS - 1}")
    n, both = bit_statistics(prints)
    plans = {m: group_bits(n, both, m) for m in range(1, min(BITS, tau + 1, max(8, -(-(tau + 1) // 3))) + 1) if tau - m + 1 <= 2 * m}
    masks = [(m, i, signed(sum(1 << b for b in bits))) for m, groups in plans.items() for i, bits in enumerate(groups)]
    values = F.explode(F.array(*[F.struct(F.lit(m).alias("m"), F.lit(i).alias("i"), F.col("fingerprint").bitwiseAND(F.lit(mask)).alias("value")) for m, i, mask in masks]))
    same = prints.select(values.alias("s")).groupBy("s.m", "s.i", "s.value").count().groupBy("m", "i").agg(F.sum(F.col("count").cast("double") * F.col("count")))
    equal = {(m, i): c for m, i, c in same.collect()}
    p = np.diag(both) / max(n, 1)
    odds = 2 * p * (1 - p) / np.maximum(1 - 2 * p * (1 - p), 1e-9)
    best: tuple[float, list[Part]] = (float("inf"), [])
    for m, groups in plans.items():
        choice: dict[int, tuple[float, tuple[int, ...]]] = {0: (0.0, ())}  # sum of (t + 1) so far: cost, thresholds
        for i, bits in enumerate(groups):
            e1 = odds[list(bits)].sum()
            e2 = (e1 * e1 - (odds[list(bits)] ** 2).sum()) / 2
            e0, w = equal.get((m, i), 0.0), len(bits)
            cost = {-1: 0.0, 0: n * KEY_COST + e0 * PAIR_COST, 1: n * (1 + w) * KEY_COST + e0 * (1 + 2 * e1) * PAIR_COST, 2: n * (1 + w) * KEY_COST + e0 * (1 + w + 2 * e1 + 2 * e2) * PAIR_COST}
            after: dict[int, tuple[float, tuple[int, ...]]] = {}
            for total, (so_far, ts) in choice.items():
                for t, c in cost.items():
                    key = min(tau + 1, total + t + 1)
                    if key not in after or so_far + c < after[key][0]:
                        after[key] = (so_far + c, (*ts, t))
            choice = after
        if tau + 1 in choice and choice[tau + 1][0] < best[0]:
            best = (choice[tau + 1][0], [Part(bits, t) for bits, t in zip(groups, choice[tau + 1][1], strict=True)])
    return [part for part in best[1] if part.threshold >= 0]


def probe_keys(prints: DataFrame, parts: list[Part]) -> DataFrame:
    """The rows of the table for each key: part, value, and whether the value is the row's own."""
    own = lambda p: F.col("fingerprint").bitwiseAND(F.lit(signed(p.mask)))
    keys = []
    for i, p in enumerate(parts):
        keys.append(F.struct(F.lit(i).alias("part"), own(p).alias("value"), F.lit(True).alias("own")))
        if p.threshold >= 1:
            keys += [F.struct(F.lit(i).alias("part"), own(p).bitwiseXOR(F.lit(signed(1 << b))).alias("value"), F.lit(p.threshold == 2).alias("own")) for b in p.bits]
    return prints.select("*", F.explode(F.array(*keys)).alias("__key")).select(*prints.columns, "__key.*")


def links_within(tau: int) -> Column:
    """Of a bucket's members: an edge from each to the smallest that it is linked with in the bucket."""

    @F.arrow_udf("array<struct<u:long,v:long>>")
    def link(members: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("u", pa.int64()), ("v", pa.int64())]))
        out = []
        flat, at = np.asarray(members.flatten(), dtype=np.int64), np.concatenate([[0], np.cumsum(np.asarray(pa.compute.list_value_length(members)))])
        for a, b in zip(at, at[1:], strict=False):
            x = np.unique(flat[a:b])
            near = np.bitwise_count((x[:, None] ^ x[None, :]).view(np.uint64)) <= tau
            label = np.arange(len(x))
            while True:  # labels fall to the smallest in reach
                lower = np.where(near, label[None, :], len(x)).min(axis=1)
                if (lower == label).all():
                    break
                label = lower
            out.append([{"u": int(x[i]), "v": int(x[label[i]])} for i in range(len(x)) if label[i] != i])
        return pa.array(out, kind)

    return link(F.col("members"))


def _stars(within: DataFrame, tau: int) -> DataFrame:
    """within: bucket (a struct), fingerprint."""
    return within.groupBy("bucket").agg(F.collect_list("fingerprint").alias("members")).select(F.explode(links_within(tau)).alias("e")).select("e.*")


def _hubs(large: DataFrame) -> DataFrame:
    """Links up to 2 bits: two such fingerprints share one of their one-bit neighbours, and at most 65 meet at one."""
    around = large.select("fingerprint", F.explode(F.array(F.col("fingerprint"), *[F.col("fingerprint").bitwiseXOR(F.lit(signed(1 << b))) for b in range(BITS)])).alias("at"))
    return around.groupBy("at").agg(F.min("fingerprint").alias("v"), F.collect_list("fingerprint").alias("u")).select(F.explode("u").alias("u"), "v").where("u <> v")


def _split(large: DataFrame, tau: int, level: int) -> DataFrame:
    """Buckets dealt on: of tau + 1 groups of the 64 bits, drawn anew for each level, two within tau bits agree in one."""
    groups = np.array_split(np.random.default_rng(level).permutation(BITS), tau + 1)
    masks = [signed(sum(1 << int(b) for b in g)) for g in groups]
    keys = F.array(*[F.struct(F.lit(g).alias("group"), F.col("fingerprint").bitwiseAND(F.lit(m)).alias("value")) for g, m in enumerate(masks)])
    dealt = large.select("bucket", "fingerprint", F.explode(keys).alias("k"))
    return dealt.select(F.struct(F.xxhash64("bucket").alias("part"), F.xxhash64("k.group", "k.value").alias("value")).alias("bucket"), "fingerprint").distinct()


def simhash_links(prints: DataFrame, tau: int, bucket: int = BUCKET) -> DataFrame:
    """Edges u, v that connect what fingerprints within tau bits connect. prints: one column of distinct fingerprints."""
    keys = probe_keys(prints, plan_partitions(prints, tau))
    counts = settle(keys.groupBy("part", "value").agg(F.count("*").alias("n"), F.max("own").alias("any_own")).where("n > 1 AND any_own").drop("any_own"))
    named = lambda rows: rows.select(F.struct(F.col("part").cast("long").alias("part"), "value").alias("bucket"), "fingerprint")
    edges = _stars(named(keys.join(counts.where(F.col("n") <= bucket), ["part", "value"])), tau)
    if not counts.where(F.col("n") > bucket).take(1):
        return edges
    large, level = named(keys.join(counts.where(F.col("n") > bucket), ["part", "value"], "left_semi")), 0
    if tau <= 2:
        return edges.unionByName(_hubs(large.select("fingerprint").distinct()))
    while True:
        large = settle(_split(large, tau, level))
        sizes = settle(large.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"))
        edges = edges.unionByName(_stars(large.join(sizes.where(F.col("n") <= bucket), "bucket"), tau))
        over = sizes.where(F.col("n") > bucket)
        if not over.take(1):
            return edges
        large, level = large.join(over, "bucket", "left_semi"), level + 1


def print_components(prints: DataFrame, tau: int, bucket: int = BUCKET) -> DataFrame:
    """node, label: the smallest fingerprint of its component, for all but those. prints: one column of distinct fingerprints."""
    with scratch(prints.sparkSession) as outer:
        return settle(components(simhash_links(prints, tau, bucket)), outer)


def simhash_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = 3, tau: int = 2, bucket: int = BUCKET) -> DataFrame:
    """doc_id, fingerprint (long) and component_id of every row."""
    small_batches(docs.sparkSession)
    rows = settle(docs.select(F.col(doc_id).alias("doc_id"), simhash(text, shingle).alias("fingerprint")))
    with scratch(docs.sparkSession) as outer:
        nodes = settle(rows.groupBy("fingerprint").agg(F.min("doc_id").alias("least")))
        found = print_components(nodes.select("fingerprint"), tau, bucket)
        labelled = nodes.join(found, nodes["fingerprint"] == found["node"], "left").select("fingerprint", "least", F.coalesce("label", "fingerprint").alias("label"))
        ids = settle(labelled.groupBy("label").agg(F.min("least").alias("component_id")))
        by_print = settle(labelled.join(ids, "label").select("fingerprint", "component_id"), outer)
    return rows.join(by_print, "fingerprint").select("doc_id", "fingerprint", "component_id")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op8_simhash": op8_simhash}
#: SQL can't hash as the fingerprints do; tests compare with all pairs.
SQL: dict[str, str] = {}
