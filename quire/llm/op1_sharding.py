"""Sharding by histogram sort.

A row's key is (hash of its text, doc_id), or two numbers that give an order to keep: then shards are its successive parts. The driver keeps, for each of the shard and piece targets, the bucket of keys
that it falls in; in each round all partitions count the exact bytes and rows of the buckets between the probes, and
buckets that are still too wide get finer probes between the smallest and largest key that occur in them. When every
target is near enough to a boundary, the rows are exchanged once, by piece, and sorted within it.

Law ``bytes``: shards hold nearly equal bytes. Equal texts are neighbours, so they share a shard unless their group
is so large that keeping it whole would move a boundary by over ``group_tolerance`` of a shard; such a group is split
by doc_id. Rows that agree in text and doc_id can't be told apart and stay together.

Nulls: a null text has size 1 and its own hash; a null doc_id sorts first. Very long texts are one row like others and may
make a shard larger by their size. Ties (rows of one key) have slots in no set order. An empty table gives no rows. Other
columns pass through; of the names this operator adds, those that the input already has are replaced.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.llm.common import own_prefix, settle, table

LOW, HIGH = 0, 1 << 128
#: Pieces in all; beyond them pieces grow, so that the driver's work and the broadcast splitters (16 bytes each) stay bounded.
MOST_PIECES = 1 << 16
_FLIP = np.uint64(1 << 63)


def _encode(digest: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Keys as 16 bytes that sort as (digest, second), both as signed longs."""
    out = np.empty((len(digest), 2), dtype=">u8")
    out[:, 0], out[:, 1] = digest.astype(np.int64).view(np.uint64) ^ _FLIP, second.astype(np.int64).view(np.uint64) ^ _FLIP
    return np.ascontiguousarray(out).view("S16").ravel()


def _bytes(keys: list[int]) -> np.ndarray:
    return np.frombuffer(b"".join(k.to_bytes(16, "big") for k in keys), dtype="S16")


def _fixed(keys: np.ndarray) -> list[bytes]:
    return [bytes(k).ljust(16, b"\0") for k in keys]


def _count(keys: DataFrame, probes: list[int]) -> dict[int, tuple[int, int, int, int]]:
    """For each bucket between probes that has rows: exact bytes, rows, smallest and largest key."""
    edges = _bytes(probes)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            key = _encode(np.asarray(b.column(0)), np.asarray(b.column(1)))
            bucket = np.searchsorted(edges, key, side="right")
            order = np.lexsort((key, bucket))
            bucket, key, size = bucket[order], key[order], np.asarray(b.column(2))[order]
            first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
            last = np.concatenate([first[1:], [len(bucket)]]) - 1
            yield pa.record_batch([pa.array(bucket[first].astype(np.int64)), pa.array(np.add.reduceat(size, first)), pa.array((last - first + 1).astype(np.int64)), pa.array(_fixed(key[first]), pa.binary()), pa.array(_fixed(key[last]), pa.binary())], names=["bucket", "bytes", "rows", "low", "high"])

    found = keys.mapInArrow(part, "bucket long, bytes long, rows long, low binary, high binary").groupBy("bucket").agg(F.sum("bytes"), F.sum("rows"), F.min("low"), F.max("high"))
    return {r[0]: (r[1], r[2], int.from_bytes(r[3], "big"), int.from_bytes(r[4], "big")) for r in found.collect()}


def _aligned(key: int) -> int:
    """The first key of the digest that the key has."""
    return key >> 64 << 64


def find_splitters(keys: DataFrame, targets: list[float], tolerance: float, group_tolerance: float, fan: int = 16, rounds: int = 64) -> list[tuple[int, int, int]]:
    """For each target of bytes below: a key, and the exact bytes and rows below it. keys: digest, second, size."""
    known: dict[int, tuple[int, int]] = {LOW: (0, 0)}
    done: dict[int, int] = {}
    probes = sorted({(i * HIGH // (fan * (len(targets) + 1))) >> 64 << 64 for i in range(1, fan * (len(targets) + 1))} - {LOW})
    total = None
    for _ in range(rounds):
        counts = _count(keys, probes)
        below_bytes = below_rows = 0
        edges, spans, ends = [LOW, *probes, HIGH], [], []
        for i in range(len(probes) + 1):
            known[edges[i]] = (below_bytes, below_rows)
            if i in counts:
                size, rows, low, high = counts[i]
                spans.append((below_bytes, below_bytes + size, edges[i], edges[i + 1], low, high))
                ends.append(below_bytes + size)
                below_bytes, below_rows = below_bytes + size, below_rows + rows
        known[HIGH], total = (below_bytes, below_rows), below_bytes
        finer: set[int] = set()
        for k, target in enumerate(targets):
            if k in done:
                continue
            found = bisect.bisect_right(ends, target)  # the span with above > target
            if target < 0 or found == len(spans):
                done[k] = LOW if target <= 0 or not total else HIGH
                continue
            below, above, left, right, low, high = spans[found]
            near = left if target - below <= above - target else right
            if min(target - below, above - target) <= tolerance or low == high:
                done[k] = near
            elif low >> 64 == high >> 64:
                # one group of equal texts; its own edges are (nearly) those of the bucket
                first, after = _aligned(low), _aligned(low) + (1 << 64)
                if (left < first or right > after) and after < HIGH:
                    finer |= {first, after} - {left, right}
                elif min(target - below, above - target) <= group_tolerance:
                    done[k] = near
                else:
                    step = max(1, (high - low) // fan)
                    finer |= {min(high, low + 1 + i * step) for i in range(fan)}
            else:
                step = max(1 << 64, _aligned((high - low) // fan))
                finer |= {min(_aligned(high), _aligned(low) + (1 << 64) + i * step) for i in range(fan)}
            if k not in done:
                finer |= {left, right}
        if len(done) == len(targets):
            break
        probes = [p for p in sorted(set(done.values()) | finer) if LOW < p < HIGH]
    return [(done[k], *known[done[k]]) for k in range(len(targets))]


def histogram_shards(docs: DataFrame, shards: int = 16, text: str = "text", doc_id: str = "doc_id", order: tuple[Column, Column] | None = None, piece_bytes: int = 64 << 20, tolerance: float = 0.01, group_tolerance: float = 0.025) -> DataFrame:
    """The rows with ``size``, ``shard`` and ``slot``, exchanged once and sorted by key within each piece of a shard. order: two longs that are the key instead."""
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1
    first, second = order or (F.xxhash64(F.col(text)), F.coalesce(F.col(doc_id).cast("long"), F.lit(-(1 << 63))))
    mine = own_prefix(docs)
    docs = docs.withColumns({f"{mine}digest": first, f"{mine}second": second}).withColumn("size", size)
    keys = settle(docs.select(f"{mine}digest", f"{mine}second", "size"))
    total = keys.agg(F.sum("size")).first()[0] or 0
    per = max(1, min(math.ceil(total / (shards * piece_bytes)), MOST_PIECES // shards))  # pieces of a shard, so that no task gets a whole shard
    share = total / shards
    cuts = find_splitters(keys, [total * i / (shards * per) for i in range(1, shards * per)], tolerance * share / per, group_tolerance * share / per)
    for i in range(1, len(cuts)):  # two targets within one group may choose boundaries out of order
        cuts[i] = max(cuts[i], cuts[i - 1])
    edges, rows_below = _bytes([c[0] for c in cuts if c[0] < HIGH]), [0, *(c[2] for c in cuts)]

    @F.arrow_udf("int")
    def piece(digest: pa.Array, second: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(edges, _encode(np.asarray(digest), np.asarray(second)), side="right").astype(np.int32))

    n = shards * per
    offsets = docs.sparkSession.createDataFrame([(i, rows_below[i] - rows_below[i // per * per]) for i in range(n)], f"{mine}piece int, {mine}before long")
    dealt = docs.withColumn(f"{mine}piece", piece(f"{mine}digest", f"{mine}second")).repartitionById(n, F.col(f"{mine}piece"))
    within = F.row_number().over(Window.partitionBy(f"{mine}piece").orderBy(f"{mine}digest", f"{mine}second"))
    placed = dealt.withColumn(f"{mine}row", within).join(F.broadcast(offsets), f"{mine}piece")
    return placed.withColumns({"shard": F.floor(F.col(f"{mine}piece") / per).cast("int"), "slot": F.col(f"{mine}before") + F.col(f"{mine}row") - 1}).drop(f"{mine}piece", f"{mine}before", f"{mine}row", f"{mine}digest", f"{mine}second")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = histogram_shards(table(spark, sf_dir, "documents"))
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    return placed.select("doc_id", "size", crc.alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op1_sharding": op1_sharding}
#: The splitters depend on rounds of counting, which SQL can't express; tests check the law and the slots.
SQL: dict[str, str] = {}
