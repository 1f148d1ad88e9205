"""Importance resampling towards a target: hashed n-gram features, weighted by how much likelier the target holds them.

1. Each task runs DuckDB over its own Arrow batches: SQL splits texts into words (unnest), puts neighbours beside each word
   (window) and counts the buckets of all runs of 1 to ``n`` words. A bucket is the run's CRC-32, from a registered function on
   zlib: the checksum of each distinct word is taken once, and those of longer runs are joined from them.
2. The counts of each document are written as Parquet. Spark adds them up to one count for each bucket, for the corpus and for the
   target; a bucket's gain is the logarithm of their smoothed ratio. Gains are ``buckets`` numbers, whatever the input.
3. A document's weight is the mean gain of its features, its score the weight plus Gumbel noise that its doc_id decides. The
   highest scores are drawn, so that documents are sampled without replacement in proportion to exp(weight). Rows are
   range-sorted by score; a rank is the place in its file plus the rows of the files before.

Texts are counted in blocks of ``BLOCK_BYTES``; a longer text in several pieces that share ``n`` - 1 words, so that memory is
bounded by a block whatever a text's length, and no run is lost or counted twice.

Nulls: a null text has no words, weight 0, and is not drawn; a null doc_id counts as the empty string in the noise, and comes
last among ties. Very long texts count whole. Ties of score go to the smaller doc_id; repeated rows have equal scores and one
rank each, in any order. An empty table gives no rows; an empty target leaves gains that favour what the corpus lacks. The
result has this operator's columns only, whatever others the table has.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.llm.common import WORD_BYTES, blocks, give_back, recoded, scratch, settle, small_batches, table

BUCKETS = 10_000
BLOCK_BYTES = 2 << 20  # of text that one statement counts
POLYNOMIAL = 0xEDB88320  # of CRC-32, bits reversed
WORD = re.compile(rb"[^ ]+")


def _zero_byte() -> np.ndarray:
    """What a zero byte makes of each single bit of a checksum."""
    out = np.left_shift(np.uint32(1), np.arange(32, dtype=np.uint32))
    for _ in range(8):
        out = (out >> np.uint32(1)) ^ np.where(out & np.uint32(1), np.uint32(POLYNOMIAL), np.uint32(0))
    return out


def _applied(step: np.ndarray, to: np.ndarray) -> np.ndarray:
    """A linear map of 32 bits, given by the images of single bits, applied to checksums."""
    out = np.zeros_like(to)
    for bit in range(32):
        out ^= np.where((to >> np.uint32(bit)) & np.uint32(1), step[bit], np.uint32(0))
    return out


class Checksums:
    """CRC-32 of joined byte strings from the checksums of both and the length of the second."""

    def __init__(self, direct: int = 64):
        """direct: lengths up to which tables are kept."""
        self.single, self.direct = _zero_byte(), direct
        steps = [np.left_shift(np.uint32(1), np.arange(32, dtype=np.uint32))]
        for _ in range(direct):
            steps.append(_applied(self.single, steps[-1]))
        values = np.arange(256, dtype=np.uint32)
        self.tables = np.stack([np.stack([_applied(s, values << np.uint32(8 * k)) for k in range(4)]) for s in steps])

    def shifted(self, crc: np.ndarray, size: int) -> np.ndarray:
        """Checksums moved over so many zero bytes, by repeated squaring."""
        step = self.single
        while size:
            if size & 1:
                crc = _applied(step, crc)
            step, size = _applied(step, step), size >> 1
        return crc

    def joined(self, first: np.ndarray, second: np.ndarray, size: np.ndarray) -> np.ndarray:
        at = np.minimum(size, self.direct)
        out = second.copy()
        for k in range(4):
            out ^= self.tables[at, k, (first >> np.uint32(8 * k)) & np.uint32(255)]
        for n in np.unique(size[size > self.direct]):
            rows = size == n
            out[rows] = self.shifted(first[rows], int(n)) ^ second[rows]
        return out


def zlib_crc(words: pa.Array) -> pa.Array:
    return pa.array([zlib.crc32(w) for w in words.cast(pa.binary()).to_numpy(zero_copy_only=False)], pa.int64())


def count_sql(n: int, buckets: int) -> str:
    """doc, bucket, n of the table ``texts``: doc, body (words between spaces), tail (words at the end with which no run begins)."""
    ahead = [f"lead({c}, {k}) OVER following AS {c}{k}" for k in range(1, n) for c in ("after", "size")]
    runs, crc = ["SELECT doc, own AS c FROM line WHERE place < starts"], "own"
    for k in range(1, n):
        crc = f"crc_joined({crc}, after{k}, size{k})"
        runs.append(f"SELECT doc, {crc} AS c FROM line WHERE place < starts AND after{k} IS NOT NULL")
    return f"""
    WITH lists AS (SELECT doc, piece, tail, list_filter(string_split(body, ' '), lambda w: w <> '') AS l FROM texts),
    words AS MATERIALIZED (SELECT doc, piece, len(l) - tail AS starts, unnest(l) AS w, unnest(range(len(l))) AS place FROM lists),
    named AS (SELECT w, crc(w) AS own, crc(' ' || w) AS after, strlen(w) + 1 AS size FROM (SELECT DISTINCT w FROM words)),
    line AS MATERIALIZED (SELECT doc, place, starts, own {"".join(", " + a for a in ahead)} FROM words JOIN named USING (w)
                          WINDOW following AS (PARTITION BY piece ORDER BY place))
    SELECT doc, c % {buckets} AS bucket, count(*) AS n FROM ({" UNION ALL ".join(runs)}) GROUP BY ALL"""


def pieces_of(text: pa.Array, n: int, most: int) -> Iterator[tuple[int, bytes, int]]:
    """Row, body and tail of texts that are cut at words into pieces of about ``most`` bytes; words are what is between spaces."""
    for row, body in enumerate(recoded(text, WORD_BYTES).cast(pa.large_binary()).to_pylist()):
        start = 0
        while len(body) - start > most:
            end = body.find(b" ", start + most)
            if end < 0:
                break
            following = [m.end() for m in islice(WORD.finditer(body, end), n - 1)]
            yield row, body[start : following[-1] if following else end], len(following)
            start = end
        yield row, body[start:], 0


class Counter:
    """A DuckDB connection of one task."""

    def __init__(self, n: int, buckets: int):
        import duckdb

        self.sql, self.n, self.buckets = count_sql(n, buckets), n, buckets
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "512MB", "temp_directory": ""})
        sums = Checksums()
        unsigned = lambda x: np.asarray(x).astype(np.uint32)
        self.db.create_function("crc", zlib_crc, ["VARCHAR"], "BIGINT", type="arrow")
        self.db.create_function("crc_joined", lambda a, b, size: pa.array(sums.joined(unsigned(a), unsigned(b), np.asarray(size)).astype(np.int64)), ["BIGINT", "BIGINT", "BIGINT"], "BIGINT", type="arrow")

    def _block(self, pieces: list[tuple[int, bytes, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rows, bodies, tails = zip(*pieces, strict=True)
        texts = pa.table({"doc": pa.array(rows, pa.int32()), "piece": pa.array(range(len(rows)), pa.int32()), "body": pa.array(bodies, pa.binary()).cast(pa.string()), "tail": pa.array(tails, pa.int32())})
        self.db.register("texts", texts)
        found = self.db.sql(self.sql).to_arrow_table()
        self.db.unregister("texts")
        docs, buckets, n = (np.asarray(found[c], dtype=np.int64) for c in ("doc", "bucket", "n"))
        order = np.argsort(docs * self.buckets + buckets, kind="stable")
        return docs[order], buckets[order], n[order]

    def counts(self, text: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Each row's buckets and their counts, rows in order; rows without features are left out."""
        held: tuple[int, np.ndarray, np.ndarray] | None = None  # of the last row, which the next block may go on with
        block, size = [], 0
        for piece in [*pieces_of(text, self.n, BLOCK_BYTES), None]:
            if block and (piece is None or size + len(piece[1]) > BLOCK_BYTES):
                docs, buckets, n = self._block(block)
                starts = np.flatnonzero(np.diff(docs, prepend=-1))
                for a, b in zip(starts, [*starts[1:], len(docs)], strict=False):
                    row = int(docs[a]), buckets[a:b], n[a:b]
                    if held and held[0] == row[0]:
                        both = np.concatenate([held[1], row[1]])
                        at, where = np.unique(both, return_inverse=True)
                        row = row[0], at, np.bincount(where, weights=np.concatenate([held[2], row[2]])).astype(np.int64)
                    elif held:
                        yield held
                    held = row
                block, size = [], 0
            if piece:
                block.append(piece)
                size += len(piece[1])
        if held:
            yield held


def bucket_counts(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", n: int = 2, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_words, n_features, buckets, counts of every row; not written yet."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("body"))
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_words long, n_features long, buckets array<int>, counts array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = None
        for whole in batches:
            counter = counter or Counter(n, buckets)
            for low, high in blocks(pc.binary_length(whole["body"]), BLOCK_BYTES):
                b = whole.slice(low, high - low)
                lengths, at, often = np.zeros(b.num_rows, dtype=np.int64), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                features = np.zeros(b.num_rows, dtype=np.int64)
                for row, found, count in counter.counts(b["body"]):
                    lengths[row], features[row] = len(found), count.sum()
                    at.append(found)
                    often.append(count)
                ends = pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(x).astype(np.int32))) for x in (at, often)]
                # f features of w words: n w - n (n - 1) / 2 runs, or w (w + 1) / 2 of fewer words than n
                words = np.where(features >= n * (n + 1) // 2, (features + n * (n - 1) // 2) // n, ((np.sqrt(8 * features + 1) - 1) / 2).round().astype(np.int64))
                yield pa.record_batch([b["doc_id"], pa.array(words), pa.array(features), *lists], names=["doc_id", "n_words", "n_features", "buckets", "counts"])
        counter = None
        give_back()

    return rows.mapInArrow(run, schema)


def _task_totals(counted: DataFrame, buckets: int) -> DataFrame:
    """bucket, n: what each task has read."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for b in batches:
            np.add.at(total, np.asarray(b["buckets"].flatten()), np.asarray(b["counts"].flatten()))
        some = np.flatnonzero(total)
        if len(some):
            yield pa.record_batch([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    return counted.select("buckets", "counts").mapInArrow(add, "bucket long, n long")


def bucket_gains(corpus: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    """A gain for each bucket that occurs, from the counts of the corpus and of the target; the sums and logarithms are Spark's."""
    none = F.lit(0).cast("long")
    parts = _task_totals(corpus, buckets).select("bucket", F.col("n").alias("s"), none.alias("t")).unionByName(_task_totals(target, buckets).select("bucket", none.alias("s"), F.col("n").alias("t")))
    sums = parts.groupBy("bucket").agg(F.sum("s").cast("double").alias("s"), F.sum("t").cast("double").alias("t"))
    every = Window.partitionBy()  # a row per bucket
    ratio = (F.col("t") + 1) * (F.sum("s").over(every) + buckets) / ((F.col("s") + 1) * (F.sum("t").over(every) + buckets))
    gains = np.zeros(buckets, dtype=np.int64)
    for at, gain in sums.select("bucket", F.floor(1000 * F.log(ratio))).collect():
        gains[at] = gain
    return gains


def weighted(counted: DataFrame, gains: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features, weight: the floored mean gain of a row's features, 0 without any."""
    shared = counted.sparkSession.sparkContext.broadcast(gains)
    schema = f"doc_id {counted.schema['doc_id'].dataType.simpleString()}, n_words long, n_features long, weight long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, often = (np.asarray(b[c].flatten()) for c in ("buckets", "counts"))
            ends = np.concatenate([[0], np.cumsum(np.asarray(pc.list_value_length(b["buckets"])))])
            sums = np.concatenate([[0], np.cumsum(shared.value[at] * often)])[ends]
            n = np.asarray(b["n_features"])
            yield pa.record_batch([b["doc_id"], b["n_words"], b["n_features"], pa.array(np.where(n > 0, np.diff(sums) // np.maximum(n, 1), 0))], names=["doc_id", "n_words", "n_features", "weight"])

    return counted.mapInArrow(run, schema)


def gumbel(doc_id: Column, seed: int) -> Column:
    """Noise in thousandths, decided by the id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def places(df: DataFrame, *order: Column) -> DataFrame:
    """The rows with ``place``, from 1 in the given order, without a task that sees all rows: range-sorted, written and counted by file."""
    rows = settle(df.repartitionByRange(*order).sortWithinPartitions(*order))
    rows = rows.select("*", F.col("_metadata.file_name").alias("__file"), F.col("_metadata.row_index").alias("__at"))
    files = rows.groupBy("__file").count()
    before = Window.orderBy("__file").rowsBetween(Window.unboundedPreceding, -1)  # a row per file; Spark names files in the order of the ranges
    offsets = files.select("__file", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__before"))
    return rows.join(F.broadcast(offsets), "__file").withColumn("place", F.col("__before") + F.col("__at") + 1).drop("__file", "__at", "__before")


def importance_resample(docs: DataFrame, target: DataFrame, text: str = "text", doc_id: str = "doc_id", target_text: str = "text", n: int = 2, buckets: int = BUCKETS, percent: int = 25, least_words: int = 20, seed: int = 7) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every row; drawn are ``percent`` of those with enough words, by score, and others have no rank."""
    with scratch(docs.sparkSession) as outer:
        counted = settle(bucket_counts(docs, text, doc_id, n, buckets))
        aim = settle(bucket_counts(target.withColumn("__no_id", F.lit(0)), target_text, "__no_id", n, buckets))
        gains = bucket_gains(counted, aim, buckets)
        rows = settle(weighted(counted, gains).select("doc_id", "n_features", "weight", (F.col("weight") + gumbel(F.col("doc_id"), seed)).alias("score"), (F.col("n_words") >= least_words).alias("able")))
        drawn = rows.where("able").count() * percent // 100
        placed = places(rows, F.desc("able"), F.desc("score"), F.asc_nulls_last("doc_id"))
        rank = F.when(F.col("able") & (F.col("place") <= drawn), F.col("place"))
        return settle(placed.select("doc_id", "n_features", "weight", "score", rank.alias("rank")), outer)


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op11_importance": op11_importance}
#: The checksum is worked out from its polynomial: a table of 256 values by eight shifts each, then a fold over the bytes.
SQL = {
    "op11_importance": r"""
WITH RECURSIVE step AS (SELECT range AS i, range::BIGINT AS v, 0 AS k FROM range(256)
                        UNION ALL SELECT i, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END, k + 1 FROM step WHERE k < 8),
crc_table AS (SELECT list(v ORDER BY i) AS t FROM step WHERE k = 8),
lists AS (SELECT 'd' AS kind, doc_id, row_number() OVER () AS r, list_filter(regexp_split_to_array(coalesce(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ''), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS l FROM documents
          UNION ALL SELECT 'b', NULL, row_number() OVER (), list_filter(regexp_split_to_array(coalesce(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ''), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') FROM benchmark),
words AS (SELECT kind, r, unnest(l) AS w, unnest(range(len(l))) AS p FROM lists),
runs AS (SELECT kind, r, w AS f FROM words UNION ALL
         SELECT kind, r, f FROM (SELECT kind, r, w || ' ' || lead(w) OVER (PARTITION BY kind, r ORDER BY p) AS f FROM words) WHERE f IS NOT NULL),
hexed AS (SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM runs)),
bytes AS (SELECT f, list_prepend(4294967295::BIGINT, list_transform(range(0, len(h) // 2), lambda k: ('0x' || substr(h, 2 * k + 1, 2))::BIGINT)) AS b FROM hexed),
coded AS (SELECT f, xor(list_reduce(b, lambda c, x: xor(c // 256, t[xor(c, x) % 256 + 1])), 4294967295) % 10000 AS bucket FROM bytes, crc_table),
counted AS (SELECT kind, r, bucket, count(*) AS n FROM runs JOIN coded USING (f) GROUP BY ALL),
totals AS (SELECT bucket, coalesce(sum(n) FILTER (kind = 'd'), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (kind = 'b'), 0)::DOUBLE AS t FROM counted GROUP BY bucket),
gains AS (SELECT bucket, floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM totals) + 10000) / ((s + 1) * ((SELECT sum(t) FROM totals) + 10000)))) AS gain FROM totals),
weights AS (SELECT r, sum(n)::BIGINT AS n_features, floor(sum(n * gain) / sum(n))::BIGINT AS weight FROM counted JOIN gains USING (bucket) WHERE kind = 'd' GROUP BY r),
scored AS (SELECT r, doc_id, len(l) >= 20 AS able, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
                  coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
           FROM (SELECT * FROM lists WHERE kind = 'd') LEFT JOIN weights USING (r)),
placed AS (SELECT *, row_number() OVER (PARTITION BY able ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY able) AS many FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN able AND place <= 25 * many // 100 THEN place END AS rank FROM placed""",
}
