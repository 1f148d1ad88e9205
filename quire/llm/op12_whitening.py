"""Whitening of embeddings by the singular value decomposition of their centred, distinct vectors.

1. Components of a vector become whole numbers, x = floor(scale * c) + shift. The fit list has each distinct x vector once, so
   that copies, however many, weigh as one. With n of them and their sums S, n x - S is exact, and (n x - S) / n is centred
   before anything is multiplied, whatever the shift.
2. MLlib's ``RowMatrix.computeSVD`` decomposes the centred rows. Squared singular values over the divisor n are the variances,
   right singular vectors the components. All of them are asked for, so that the decomposition is a direct one of the Gram
   matrix (a square of the dimension, in the driver, whatever the number of rows) and no iteration stops early; beyond
   15,000 dimensions MLlib multiplies the rows instead and iterates.
3. The total variance is no sum of those: it is the sum of all exact deviations over n^3.
4. Every row is projected on the components in use, over the square roots of their variances. As a check, the covariance of
   the whitened fit list, again centred first and over n, is compared with the identity.

A component whose standard deviation is below ``least`` times the largest one is rounding error of a direction without spread:
it can't be whitened and is left out, as are all components if fewer than two distinct vectors are there.

Nulls: vectors that are null or hold null or non-finite entries take no part, nor do those with an entry too large for a long
(beyond 2^52 after scaling, where doubles no longer have fractions); a null vec_id is kept. Vectors of another length than most
take no part (of two lengths as frequent, the longer one stays). Repeated rows and ties each have their rows in the result. A
deviation beyond the range of a long is null. Very long vectors: step 2 bounds the dimension, nothing else does. An empty table
gives no rows. The result has this operator's columns only, whatever others the table has.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import scratch, settle, small_batches, table

SCALE, SHIFT = 64, 1_000_000
LIMIT = float(1 << 52)
LEAST = 1e-7
PART = 10**25


def whole_vectors(df: DataFrame, vec_id: str, vector: str, scale: int, shift: int) -> DataFrame:
    """vec_id, x: of the rows that take part."""
    v = F.col(vector).cast("array<double>")
    usable = F.forall(v, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c * scale) <= LIMIT), F.lit(False)))
    rows = df.select(F.col(vec_id).alias("vec_id"), v.alias("v")).where(F.col("v").isNotNull() & F.coalesce(usable, F.lit(False)))
    rows = rows.select("vec_id", F.transform("v", lambda c: F.floor(c * scale).cast("long") + shift).alias("x"))
    common = rows.groupBy(F.size("x").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    return rows.where(F.size("x") == (common[0]["n"] if common else 0))


def _matrix(lists: pa.Array) -> np.ndarray:
    return np.asarray(lists.flatten(), dtype=np.int64).reshape(len(lists), -1)


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))


def exact_sums(fit: DataFrame) -> tuple[int, list[int]]:
    """How many vectors there are and the sum of each dimension; tasks add up what they read, Spark adds up the tasks."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, None
        for b in batches:
            if b.num_rows:
                x = _matrix(b["x"])  # below 2^52 each; halves of 26 bits add up without overflow
                part = (x >> 26).sum(axis=0).astype(object) * (1 << 26) + (x & ((1 << 26) - 1)).sum(axis=0).astype(object)
                n, total = n + len(x), part if total is None else total + part
        if n:
            yield pa.record_batch([pa.array(range(len(total) + 1), pa.int32()), pa.array([Decimal(int(t)) for t in [n, *total]], pa.decimal128(38, 0))], names=["at", "sum"])

    sums = fit.select("x").mapInArrow(add, "at int, sum decimal(38,0)").groupBy("at").agg(F.sum("sum").cast("decimal(38,0)").alias("sum")).orderBy("at").collect()
    found = [int(r["sum"]) for r in sums]
    return (found[0], found[1:]) if found else (0, [])


def centred(x: np.ndarray, n: int, sums: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """n x - S, exact: as longs if n x and S surely fit, else as Python's integers; and whether its squares surely add up within a long."""
    wide = max([1, *map(abs, sums)], default=1) + n * (int(np.abs(x).max(initial=0)) + 1)
    if wide < 1 << 62:
        d = x * n - np.array(sums, dtype=np.int64)
        rough = np.square(d.astype(np.float64)).sum(axis=1)
        return d, rough < float(1 << 62)
    d = x.astype(object) * n - np.array(sums, dtype=object)
    return d, np.zeros(len(x), dtype=bool)


def deviations(d: np.ndarray, safe: np.ndarray) -> list[int]:
    """Sums of squares of n x - S by row, exact whatever their size."""
    if safe.all():
        return (d * d).sum(axis=1).tolist() if len(d) else []
    return [int((row * row).sum()) if fits else sum(int(v) ** 2 for v in row) for row, fits in zip(d, safe, strict=True)]


def _vectors(arrays: DataFrame) -> DataFrame:
    return MLUtils.convertVectorColumnsFromML(arrays.select(array_to_vector(F.col("x")).alias("x")), "x")


class Whitening:
    """What is fitted: n, sums, components (columns), variances, and the total variance."""

    def __init__(self, n: int, sums: list[int], components: np.ndarray, variances: np.ndarray, total: float):
        self.n, self.sums, self.components, self.variances, self.total = n, sums, components, variances, total

    def whitened(self, d: np.ndarray) -> np.ndarray:
        """d: n x - S."""
        return (d.astype(np.float64) / self.n) @ self.components / np.sqrt(self.variances)


def fit_whitening(fit: DataFrame, most: int = 16, least: float = LEAST) -> Whitening | None:
    """fit: x, distinct. None if there is no direction with any spread."""
    n, sums = exact_sums(fit)
    if n < 2 or not sums:
        return None

    def centre(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                d, safe = centred(_matrix(b["x"]), n, sums)
                lists = _lists(d.astype(np.float64) / n)
                parts = zip(*(divmod(s, PART) for s in deviations(d, safe)), strict=True)
                yield pa.record_batch([lists, *(pa.array([Decimal(p) for p in part], pa.decimal128(38, 0)) for part in parts)], names=["x", "high", "low"])

    # a row's deviation may have more digits than a decimal, so it is added up in two parts
    rows = settle(fit.select("x").mapInArrow(centre, "x array<double>, high decimal(38,0), low decimal(38,0)"))
    high, low = rows.agg(F.sum("high").cast("decimal(38,0)"), F.sum("low").cast("decimal(38,0)")).first()
    total = (int(high) * PART + int(low)) / n**3
    if not total:
        return None
    found = RowMatrix(_vectors(rows)).computeSVD(len(sums), False, least)
    variances = np.array(found.s.toArray()) ** 2 / n
    return Whitening(n, sums, np.array(found.V.toArray())[:, :most].copy(), variances[:most].copy(), total)


def _whiten(rows: DataFrame, model: Whitening) -> DataFrame:
    """vec_id, deviation, whitened (an array) of every row."""
    shared = rows.sparkSession.sparkContext.broadcast(model)  # components: at most ``most`` times the dimension

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                m, x = shared.value, _matrix(b["x"])
                d, safe = centred(x, m.n, m.sums)
                lists = _lists(m.whitened(d))
                yield pa.record_batch([b["vec_id"], pa.array([s if s < 1 << 63 else None for s in deviations(d, safe)], pa.int64()), lists], names=["vec_id", "deviation", "whitened"])

    return rows.mapInArrow(run, f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, deviation long, whitened array<double>")


def identity_error(whitened: DataFrame, n: int) -> float:
    """The largest absolute entry of the covariance, over n, less the identity. whitened: x, an array of doubles."""
    covariance = np.array(RowMatrix(_vectors(whitened)).computeCovariance().toArray()) * (n - 1) / n
    return float(np.abs(covariance - np.eye(len(covariance))).max())


def whiten(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", most: int = 16, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """vec_id, n, deviation, whitened (an array, component by component), explained (likewise) and identity_error of every row that takes part."""
    spark = df.sparkSession
    small_batches(spark)
    with scratch(spark) as outer:
        rows = settle(whole_vectors(df, vec_id, vector, scale, shift))
        fit = settle(rows.select("x").distinct())
        model = fit_whitening(fit, most)
        if model is None:
            return spark.createDataFrame([], f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, n long, deviation long, whitened array<double>, explained array<double>, identity_error double")
        again = settle(_whiten(fit.select(F.lit(None).cast("long").alias("vec_id"), "x"), model).select(F.col("whitened").alias("x")))
        error = identity_error(again, model.n)
        out = settle(_whiten(rows, model), outer)
    explained = F.array(*[F.lit(float(e / model.total)) for e in model.variances])
    return out.select("vec_id", F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", explained.alias("explained"), F.lit(error).alias("identity_error"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whiten(table(spark, sf_dir, "embeddings"))
    each = rows.select("vec_id", "n", "deviation", "identity_error", F.posexplode(F.arrays_zip("whitened", "explained")).alias("k", "e"))
    return each.select("vec_id", (F.col("k") + 1).cast("int").alias("component"), "n", "deviation", "e.whitened", "e.explained", "identity_error")


QUERIES = {"op12_whitening": op12_whitening}
#: SQL has no singular value decomposition; tests compare with plain code.
SQL: dict[str, str] = {}
