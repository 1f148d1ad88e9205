"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(w0 + sum w_i x_i + 1/2 sum_f [(sum v_if x_i)^2 - sum v_if^2 x_i^2]), linear in the features of a text.
Words are hashed; a word's value is the logarithm of its count, with unit length over the text. Structure statistics
(shares of character classes, line and word shapes, repetition) and the logarithm of n_chars, where the table has it, are
standardised. It is trained in the driver on at most ``sample`` labelled rows, picked by a hash of doc_id from those
whose crc32(doc_id) mod 3 is not 1 (of rows that share a doc_id one is learnt from); doc_id, lang, source and labels are no features. All rows are scored in whole texts.

Nulls: a null text counts as empty, and is scored; a null n_chars counts as 0; labels that are null are not learnt from;
a null doc_id is not held out. Without any usable label the score is 0.5. Very long texts are read whole. Ties and repeated
rows are scored alike. An empty table gives no rows. Columns named like this operator's are replaced; others pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import WORD_BYTES, blocks, give_back, recoded, segment_sum, small_batches, table, words_of

BUCKETS = 1 << 16
FACTORS = 8
SAMPLE = 4000  # labelled rows to learn from, at most
BLOCK_BYTES = 512 << 10

_KIND = np.array([0 if 97 <= b <= 122 or b >= 128 else 1 if 65 <= b <= 90 else 2 if 48 <= b <= 57 else 3 if b in (9, 11, 12, 13, 32) else 4 if b == 10 else 5 if chr(b) in ".,;:!?'\"-()" else 6 for b in range(256)], dtype=np.uint8)
_SAME = np.arange(256, dtype=np.uint8)
STATISTICS = 16


@dataclass
class Features:
    """Of a block of texts: the distinct word buckets of each text (rows begin at ``starts``), their values, and the statistics."""

    starts: np.ndarray
    buckets: np.ndarray
    values: np.ndarray
    stats: np.ndarray


def features_of(texts: pa.Array, n_chars: np.ndarray) -> Features:
    n = len(texts)
    words, starts = words_of(texts, WORD_BYTES)
    coded = words.dictionary_encode()
    distinct = coded.dictionary
    number = np.asarray(coded.indices, dtype=np.int64)
    hashed = np.array([xxhash.xxh64_intdigest(w.as_buffer(), 7) % BUCKETS for w in distinct], dtype=np.int64)
    length = np.asarray(pc.utf8_length(pc.cast(distinct, pa.large_string())), dtype=np.float64) if len(distinct) else np.zeros(0)
    row = np.repeat(np.arange(n), np.diff(starts))
    pair, count = np.unique(row * max(len(distinct), 1) + number, return_counts=True)
    row_of = pair // max(len(distinct), 1)
    at = np.searchsorted(row_of, np.arange(n + 1))
    value = np.log1p(count.astype(np.float64))
    norm = np.sqrt(segment_sum(value * value, at))
    value = value / np.maximum(norm[row_of], 1e-9)
    most = np.zeros(n)
    np.maximum.at(most, row_of, count)

    _, offsets, data = recoded(texts, _SAME).buffers()
    ends = np.frombuffer(offsets, dtype=np.int64)[: n + 1]
    kind = _KIND[np.frombuffer(data, dtype=np.uint8)] if data is not None else np.zeros(0, np.uint8)
    of = np.repeat(np.arange(n, dtype=np.int32), np.diff(ends))
    shares = np.bincount(of * 7 + kind, minlength=7 * n).reshape(n, 7).astype(np.float64)
    size, n_words, n_lines = np.maximum(np.diff(ends), 1).astype(np.float64), np.maximum(np.diff(starts), 1).astype(np.float64), shares[:, 4] + 1
    lines = pc.split_pattern(recoded(texts, _SAME), "\n")
    line_row = np.repeat(np.arange(n), np.asarray(pc.list_value_length(lines)))
    line_code = np.asarray(lines.flatten().dictionary_encode().indices, dtype=np.int64)
    distinct_lines = np.bincount(np.unique(line_row * (line_code.max(initial=0) + 1) + line_code) // (line_code.max(initial=0) + 1), minlength=n)[:n] if len(line_row) else np.zeros(n)
    word_chars = segment_sum(length[number], starts)
    stats = np.stack([
        *(shares[:, k] / size for k in (0, 1, 2, 3, 5, 6)),
        np.log1p(np.diff(starts)), np.diff(at) / n_words, most / n_words, word_chars / n_words, np.sqrt(np.maximum(segment_sum(length[number] ** 2, starts) / n_words - (word_chars / n_words) ** 2, 0)),
        np.log1p(n_words / n_lines), np.log(n_lines), distinct_lines / n_lines, np.log1p(np.maximum(n_chars, 0)), (np.diff(starts) == 0).astype(np.float64),
    ], axis=1)
    return Features(at, hashed[pair % max(len(distinct), 1)] if len(pair) else np.zeros(0, np.int64), value, stats)


@dataclass
class FactorisationMachine:
    bias: float
    linear: np.ndarray  # of the buckets, then of the statistics
    factors: np.ndarray
    mean: np.ndarray
    spread: np.ndarray

    def dense(self, stats: np.ndarray) -> np.ndarray:
        return np.clip((stats - self.mean) / self.spread, -4, 4)

    def margins(self, x: Features) -> np.ndarray:
        dense, v = self.dense(x.stats), self.factors[x.buckets] * x.values[:, None]
        w, vd = self.linear[BUCKETS:], self.factors[BUCKETS:]
        total = segment_sum(v, x.starts) + dense @ vd
        squares = segment_sum(v * v, x.starts) + dense**2 @ vd**2
        return self.bias + segment_sum(self.linear[x.buckets] * x.values, x.starts) + dense @ w + 0.5 * (total**2 - squares).sum(axis=1)

    def scores(self, x: Features) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(x), -30, 30)))


def train(x: Features, y: np.ndarray, epochs: int = 12, batch: int = 256, rate: float = 0.02, decay: float = 1e-4, seed: int = 7) -> FactorisationMachine:
    """Logistic loss, Adam on mini-batches; the same rows give the same model."""
    rng = np.random.default_rng(seed)
    size = BUCKETS + STATISTICS
    model = FactorisationMachine(0.0, np.zeros(size), rng.normal(0, 0.02, (size, FACTORS)), x.stats.mean(axis=0), np.maximum(x.stats.std(axis=0), 1e-6))
    dense, theta = model.dense(x.stats), np.concatenate([model.linear[:, None], model.factors], axis=1)
    m1, m2, bias, b1, b2, step = np.zeros_like(theta), np.zeros_like(theta), np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)), 0.0, 0.0, 0
    stat_at = np.arange(BUCKETS, size)
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for rows in (order[i : i + batch] for i in range(0, len(order), batch)):
            step += 1
            n = np.diff(x.starts)[rows]
            starts = np.concatenate([[0], np.cumsum(n)])
            at = np.arange(starts[-1]) - np.repeat(starts[:-1], n) + np.repeat(x.starts[rows], n)
            bucket, value, of = x.buckets[at], x.values[at], np.repeat(np.arange(len(rows)), n)
            v, d = theta[bucket, 1:] * value[:, None], dense[rows]
            total = segment_sum(v, starts) + d @ theta[BUCKETS:, 1:]
            squares = segment_sum(v * v, starts) + d**2 @ theta[BUCKETS:, 1:] ** 2
            margin = bias + segment_sum(theta[bucket, 0] * value, starts) + d @ theta[BUCKETS:, 0] + 0.5 * (total**2 - squares).sum(axis=1)
            error = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y[rows]) / len(rows)
            used, place = np.unique(bucket, return_inverse=True)
            grad = np.zeros((len(used), 1 + FACTORS))
            np.add.at(grad, place, (error[of] * value)[:, None] * np.concatenate([np.ones((len(of), 1)), total[of] - v], axis=1))
            stat = np.concatenate([(error @ d)[:, None], np.einsum("n,nj,nf->jf", error, d, total) - (error @ d**2)[:, None] * theta[BUCKETS:, 1:]], axis=1)
            touched, grad = np.concatenate([used, stat_at]), np.concatenate([grad, stat])
            grad += decay * theta[touched]
            m1[touched] = 0.9 * m1[touched] + 0.1 * grad
            m2[touched] = 0.999 * m2[touched] + 0.001 * grad**2
            theta[touched] -= rate * (m1[touched] / (1 - 0.9**step)) / (np.sqrt(m2[touched] / (1 - 0.999**step)) + 1e-8)
            b1, b2 = 0.9 * b1 + 0.1 * error.sum(), 0.999 * b2 + 0.001 * error.sum() ** 2
            bias -= rate * (b1 / (1 - 0.9**step)) / (np.sqrt(b2 / (1 - 0.999**step)) + 1e-8)
    model.bias, model.linear, model.factors = float(bias), theta[:, 0].copy(), theta[:, 1:].copy()
    return model


def held_out(doc_id: str) -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit_quality(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", sample: int = SAMPLE) -> FactorisationMachine | None:
    """The model of the sample, or None without labels. labels: doc_id, quality."""
    usable = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
    chosen = usable.groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    n_chars = F.coalesce(F.col("n_chars").cast("long"), F.lit(0)) if "n_chars" in docs.columns else F.lit(0).cast("long")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), n_chars.alias("n_chars")).join(F.broadcast(chosen), "doc_id")
    # one row of a repeated doc_id, so that the bound holds for rows; picked by thin keys, since texts may be long and the copies many
    rows = rows.withColumn("hash", F.xxhash64("text", "n_chars"))
    one = rows.groupBy("doc_id").agg(F.min("hash").alias("hash"))
    rows = rows.join(F.broadcast(one), ["doc_id", "hash"])
    # features are made where the texts are; a row to the driver has a few hundred numbers
    made = rows.select("doc_id", "quality", "text", "n_chars").mapInArrow(_packed, "doc_id long, quality int, buckets binary, counts binary, stats binary")
    made = made.groupBy("doc_id").agg(*[F.first(c).alias(c) for c in ("quality", "buckets", "counts", "stats")]).orderBy("doc_id").toArrow()
    y = np.asarray(made["quality"], dtype=np.float64)
    if len(np.unique(y)) < 2:
        return None
    whole = lambda c, kind: np.frombuffer(b"".join(made[c].to_pylist()), kind)
    lengths = np.concatenate([np.zeros(0, np.int64), *(np.asarray(pc.binary_length(c), dtype=np.int64) // 4 for c in made["buckets"].chunks)])
    x = Features(np.concatenate([[0], np.cumsum(lengths)]), whole("buckets", np.int32).astype(np.int64), whole("counts", np.float32).astype(np.float64), whole("stats", np.float64).reshape(len(y), STATISTICS))
    return train(x, y)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for low, high in blocks(pc.binary_length(b["text"]), BLOCK_BYTES):
            part = b.slice(low, high - low)
            x = features_of(part["text"], np.asarray(part["n_chars"], dtype=np.float64))
            rows = list(zip(x.starts, x.starts[1:], strict=False))
            yield pa.record_batch([part["doc_id"], part["quality"], pa.array([x.buckets[a:z].astype(np.int32).tobytes() for a, z in rows], pa.binary()), pa.array([x.values[a:z].astype(np.float32).tobytes() for a, z in rows], pa.binary()), pa.array([s.tobytes() for s in x.stats], pa.binary())], names=["doc_id", "quality", "buckets", "counts", "stats"])


def score_quality(docs: DataFrame, model: FactorisationMachine | None, text: str = "text", name: str = "score") -> DataFrame:
    """The rows with the score, under ``name``."""
    small_batches(docs.sparkSession)
    if model is None:
        return docs.withColumn(name, F.lit(0.5))
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))  # BUCKETS * (FACTORS + 1) numbers, whatever the input

    @F.arrow_udf("double")
    def score(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        model = FactorisationMachine(**shared.value)
        for texts, n_chars in batches:
            out = [model.scores(features_of(texts.slice(a, b - a), np.asarray(n_chars.slice(a, b - a).fill_null(0), dtype=np.float64))) for a, b in blocks(pc.binary_length(texts), BLOCK_BYTES)]
            yield pa.array(np.concatenate(out) if out else np.zeros(0))
        give_back()

    return docs.withColumn(name, score(F.col(text), F.col("n_chars").cast("long") if "n_chars" in docs.columns else F.lit(0).cast("long")))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    scored = score_quality(docs, fit_quality(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op10_quality": op10_quality}
#: A trained model has no SQL; tests measure held-out accuracy.
SQL: dict[str, str] = {}
