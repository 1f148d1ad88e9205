"""Approximate nearest neighbours with balanced posting lists.

Index: coarse centroids by balanced k-means on a bounded sample of unit vectors; each of their cells is split again, from a
bounded sample of its members, into lists of about ``list_rows`` vectors, so that the number of lists grows with the table (up
to ``lists`` and ``index_bytes``; beyond it lists grow). A vector goes to its nearest cell and list and, near a boundary, also to others almost as
near (``replicas`` at most). Lists that still come out long are cut into sublists, all of which are searched. Search: coarse centroids are
found with a best-first walk over their in-memory neighbour graph; of the cells, and then of all their lists, those
within a ratio of the nearest one's distance are read, whatever their number (a query that finds fewer than k reads all); their vectors are compared exactly, and the best of all lists are merged.
With ``exact`` every query reads every list, and the result is that of a full search.

Equal vectors: only the k + 1 smallest ids of a vector can be among the k nearest of any query, so only those are searched; a
very common vector is therefore no long list. Queries of one list are cut into blocks.

Nearness is the cosine in double precision of the original vectors, ties go to the smaller id. Vectors that are null,
zero, of another length than most, or hold null or non-finite components take no part, nor do null ids. Repeated ids: all rows
of an id are candidates (the nearest counts, and an id is in a result once); of a query's rows the smallest vector asks, and
none of its id's rows is its candidate. Queries without candidates have no rows; an empty table gives none. The columns of the result are this
operator's, whatever others the table has.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.llm.common import settle, small_batches, table


PIECE = 4096  # rows of a batch in which a task hands on copies of vectors
FAR = 1 << 20  # distances that are in memory at once


@dataclass(frozen=True)
class AnnOptions:
    sample: int = 20_000  # rows that the coarse centroids are fitted on, at most
    cells: int = 64  # coarse centroids
    cell_sample: int = 8192  # rows of a cell that its lists are fitted on, about
    list_rows: int = 256
    lists: int = 1 << 18  # in all
    index_bytes: int = 64 << 20  # of the lists' centroids, which the driver and all tasks hold; with longer vectors there are fewer lists
    replicas: int = 4
    boundary: float = 1.05  # distance to a cluster, over that to the nearest, up to which a vector is replicated
    cell_ratio: float = 1.5  # the same for the cells that a query looks into
    probe_ratio: float = 1.35  # the same for the lists that a query reads
    least: int = 3  # cells, and lists, that a query reads at least
    degree: int = 16  # neighbours of a centroid in the graph
    beam: int = 64  # cells that a walk finds
    sublist: int = 2048  # rows of a list that one task searches at once
    asked: int = 1024  # queries that it answers at once
    exact: bool = False


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two each, which is exact, so that squares neither overflow nor vanish."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def _unit(x: np.ndarray) -> np.ndarray:
    x = scaled(np.asarray(x, dtype=np.float64))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def balanced_centroids(x: np.ndarray, count: int, seed: int = 3) -> np.ndarray:
    """Spherical k-means in which a cluster of over twice the mean size is split, until none is (or it can't be)."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(count, len(x)), replace=False)]
    for round_no in range(12):
        nearest = np.concatenate([np.argmax(x[i : i + 2048] @ centres.T, axis=1) for i in range(0, len(x), 2048)])
        sizes = np.bincount(nearest, minlength=len(centres))
        new = np.zeros_like(centres)
        np.add.at(new, nearest, x)
        live = (sizes > 0) & (np.linalg.norm(new, axis=1) > 1e-9)
        centres = _unit(new[live])
        large = np.flatnonzero(sizes[live] > 2 * len(x) / count)
        if round_no < 9 and len(large):  # a member of a large cluster becomes a centre of its own
            members = [np.flatnonzero(nearest == np.flatnonzero(live)[k]) for k in large]
            centres = np.concatenate([centres, x[[int(rng.choice(m)) for m in members]]])
    return np.unique(centres, axis=0)


def neighbour_graph(centres: np.ndarray, degree: int) -> np.ndarray:
    """For each centroid: its nearest others and, against islands, the next in a fixed ring."""
    near = np.argsort(-(centres @ centres.T), axis=1, kind="stable")[:, 1 : degree + 1]
    ring = (np.arange(len(centres)) + 1) % max(len(centres), 1)
    return np.concatenate([near, ring[:, None]], axis=1)


def graph_search(query: np.ndarray, centres: np.ndarray, graph: np.ndarray, start: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``beam`` nearest centroids that a best-first walk finds, nearest first, and their distances."""
    seen = np.zeros(len(centres), dtype=bool)
    seen[start] = True
    first = np.linalg.norm(centres[start] - query, axis=1)
    todo = list(zip(first.tolist(), start.tolist(), strict=True))
    best = [(-d, i) for d, i in todo]
    heapq.heapify(todo)
    heapq.heapify(best)
    while len(best) > beam:
        heapq.heappop(best)
    while todo:
        d, i = heapq.heappop(todo)
        if len(best) >= beam and d > -best[0][0]:
            break
        fresh = graph[i][~seen[graph[i]]]
        if not len(fresh):
            continue
        seen[fresh] = True
        for e, j in zip(np.linalg.norm(centres[fresh] - query, axis=1).tolist(), fresh.tolist(), strict=True):
            if len(best) < beam or e < -best[0][0]:
                heapq.heappush(todo, (e, j))
                heapq.heappush(best, (-e, j))
                if len(best) > beam:
                    heapq.heappop(best)
    found = sorted((-d, i) for d, i in best)
    return np.array([i for _, i in found]), np.array([d for d, _ in found])


def valid_vectors(df: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """id, v: of the vectors that take part."""
    v = F.col(vector).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = df.select(F.col(vec_id).cast("long").alias("id"), v.alias("v")).where(F.col("v").isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists("v", lambda x: x != 0) & F.col("id").isNotNull())
    sizes = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return rows.where(F.size("v") == (sizes[0]["n"] if sizes else 0))


def _matrix(lists: pa.Array) -> np.ndarray:
    return np.asarray(lists.flatten(), dtype=np.float64).reshape(len(lists), -1)


class Index:
    """Coarse centroids with their graph, and the centroids of the lists by cell."""

    def __init__(self, centres: np.ndarray, graph: np.ndarray, lists: np.ndarray, starts: np.ndarray):
        self.centres, self.graph, self.lists, self.starts = centres, graph, lists, starts

    def of_cells(self, cells: np.ndarray) -> np.ndarray:
        """The lists of some cells."""
        return np.concatenate([np.arange(self.starts[c], self.starts[c + 1]) for c in cells])

    def homes(self, u: np.ndarray, o: AnnOptions) -> tuple[np.ndarray, np.ndarray]:
        """Row and list of each place of the vectors: the nearest, and others almost as near."""
        rows, found = [], []
        for cell, members in _grouped(np.argmax(u @ self.centres.T, axis=1)):
            # the lists of a vector lie in its cell and in the cells next to it
            near = self.of_cells(np.unique(np.append(self.graph[cell], cell)))
            step = max(1, FAR // len(near))
            for some in (members[k : k + step] for k in range(0, len(members), step)):
                far = _distances(u[some], self.lists[near])
                best = np.argpartition(far, min(o.replicas, far.shape[1]) - 1, axis=1)[:, : o.replicas]
                d = np.take_along_axis(far, best, axis=1)
                row, col = np.nonzero(d <= np.maximum(d.min(axis=1, keepdims=True) * o.boundary, 1e-6))
                rows.append(some[row])
                found.append(near[best[row, col]])
        return np.concatenate(rows), np.concatenate(found)

    def probes(self, q: np.ndarray, o: AnnOptions) -> np.ndarray:
        """The lists that a query reads."""
        start = np.unique(np.linspace(0, len(self.centres) - 1, 8).astype(np.int64))
        cells, far = graph_search(q, self.centres, self.graph, start, min(o.beam, len(self.centres)))
        near = self.of_cells(cells[far <= max(far[: o.least][-1], far[0] * o.cell_ratio)])
        d = _distances(q[None, :], self.lists[near])[0]
        return near[d <= max(np.sort(d)[: o.least][-1], d.min() * o.probe_ratio)]


def _distances(u: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * (u @ centres.T), 0))


def _grouped(label: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(label, kind="stable")
    edges = np.flatnonzero(np.diff(label[order], prepend=-1))
    for a, b in zip(edges, np.append(edges[1:], len(order)), strict=True):
        yield int(label[order[a]]), order[a:b]


def _copies(b: pa.RecordBatch, lists: Iterator[tuple[np.ndarray, np.ndarray]], names: list[str]) -> Iterator[pa.RecordBatch]:
    """A row (list, id, v) for each row of a batch and list of it, in batches of PIECE rows. lists: rows and their lists, a few at a time."""
    for row, found in lists:
        for k in range(0, len(row), PIECE):
            at = pa.array(row[k : k + PIECE])
            yield pa.record_batch([pa.array(found[k : k + PIECE].astype(np.int32)), b["id"].take(at), b["v"].take(at)], names=names)


def build_index(rows: DataFrame, o: AnnOptions) -> Index | None:
    """rows: id, v."""
    picked = rows.orderBy(F.xxhash64("id"), "id").limit(o.sample).select("v").toArrow()["v"].combine_chunks()
    if not len(picked):
        return None
    centres = balanced_centroids(np.unique(_unit(_matrix(picked)), axis=0), max(1, min(o.cells, len(picked) // o.list_rows)))
    shared = rows.sparkSession.sparkContext.broadcast(centres)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.record_batch([pa.array(np.argmax(_unit(_matrix(b["v"])) @ shared.value.T, axis=1).astype(np.int32)), b["id"], b["v"]], names=["cell", "id", "v"])

    placed = rows.mapInArrow(cells, "cell int, id long, v array<double>")
    sizes = {r["cell"]: r["count"] for r in placed.groupBy("cell").count().collect()}  # a row per cell
    total = sum(sizes.values())
    per = max(o.list_rows, total / max(1, min(o.lists, o.index_bytes // (4 * centres.shape[1]))))
    counts = {c: max(1, round(n / per)) for c, n in sizes.items()}
    table = rows.sparkSession.createDataFrame([(c, sizes[c], counts[c]) for c in sorted(sizes)], "cell int, n long, count int")
    sampled = placed.join(F.broadcast(table), "cell").where(F.pmod(F.xxhash64("id"), F.col("n")) < o.cell_sample)

    def split(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.unique(_unit(np.stack(pdf["v"].to_numpy())), axis=0)
        found = balanced_centroids(x, int(pdf["count"].iloc[0])).astype(np.float32)
        return pd.DataFrame({"cell": [int(pdf["cell"].iloc[0])], "centres": [found.tobytes()]})

    made = dict(sampled.select("cell", "count", "v").groupBy("cell").applyInPandas(split, "cell int, centres binary").collect())
    width = centres.shape[1]
    # a cell without a sampled member is a list of its own
    lists = [np.frombuffer(made[c], np.float32).reshape(-1, width) if c in made else centres[c : c + 1].astype(np.float32) for c in range(len(centres))]
    return Index(centres.astype(np.float32), neighbour_graph(centres, o.degree), np.concatenate(lists), np.concatenate([[0], np.cumsum([len(x) for x in lists])]))


def nearest_neighbours(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", every: int = 50, k: int = 5, options: AnnOptions = AnnOptions()) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest that were found for each row whose id is divisible by ``every``."""
    spark, o = df.sparkSession, options
    small_batches(spark)
    rows = valid_vectors(df, vec_id, vector)
    rows = settle(rows.withColumn("key", F.xxhash64("v")).groupBy("key", "id").agg(F.first("v").alias("v")))
    same = F.row_number().over(Window.partitionBy("key").orderBy("id"))  # equal vectors, by their hash
    members = settle(rows.withColumn("place", same).where(F.col("place") <= k + 1).select("id", "v"))
    index = build_index(members, o)
    if index is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    shared = spark.sparkContext.broadcast(index)  # bounded by the sample and the number of lists

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                homes = shared.value.homes(_unit(_matrix(b["v"])).astype(np.float32), replace(o, replicas=1) if o.exact else o)
                yield from _copies(b, iter([homes]), ["list", "id", "v"])

    lists = settle(members.mapInArrow(assign, "list int, id long, v array<double>"))
    cuts = lambda table, most, name: table.groupBy("list").agg(F.ceil(F.count("*") / most).cast("int").alias(name))
    subs = settle(cuts(lists, o.sublist, "subs"))  # a row per list
    block = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    every_block = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    keys = ["list", "sub", "turn"]

    def answers(askers: DataFrame, exact: bool) -> DataFrame:
        """query_id, vec_id, score: of the lists that the queries (id, v) read, or of all."""

        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    index = shared.value
                    u = _unit(_matrix(b["v"])).astype(np.float32)
                    some = ([(k, np.arange(len(index.lists)) if exact else index.probes(u[k], o)) for k in range(a, min(a + 16, len(u)))] for a in range(0, len(u), 16))
                    yield from _copies(b, ((np.repeat([k for k, _ in x], [len(t) for _, t in x]), np.concatenate([t for _, t in x])) for x in some), ["list", "query_id", "q"])

        wanted = settle(askers.mapInArrow(probe, "list int, query_id long, q array<double>"))
        lengths = settle(subs.join(cuts(wanted, o.asked, "turns"), "list"))
        dealt = lists.join(F.broadcast(lengths), "list").withColumn("sub", block("id", "subs")).withColumn("turn", every_block("turns"))
        asked = wanted.join(F.broadcast(lengths), "list").withColumn("turn", block("query_id", "turns")).withColumn("sub", every_block("subs"))
        found = asked.select(*keys, "query_id", "q").groupBy(*keys).cogroup(dealt.select(*keys, "id", "v").groupBy(*keys)).applyInPandas(search, "query_id long, vec_id long, score double")
        return settle(found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")))

    def search(queries: pd.DataFrame, members: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(members):
            return pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})
        m, ids = np.stack(members["v"].to_numpy()), members["id"].to_numpy()
        q, own = np.stack(queries["q"].to_numpy()), queries["query_id"].to_numpy()
        rough = np.where(ids[None, :] == own[:, None], -np.inf, _unit(q) @ _unit(m).T)
        # near ties stay in, so that rounding decides none; rows of one id may be several
        most = min(len(ids), k * int(np.unique(ids, return_counts=True)[1].max())) - 1
        least = np.partition(rough, len(ids) - 1 - most, axis=1)[:, len(ids) - 1 - most]
        row, col = np.nonzero((rough >= least[:, None] - 1e-9) & np.isfinite(rough))
        m, q = scaled(m), scaled(q)
        score = (m[col] * q[row]).sum(axis=1) / (np.sqrt((m[col] * m[col]).sum(axis=1)) * np.sqrt((q[row] * q[row]).sum(axis=1)))
        return pd.DataFrame({"query_id": own[row], "vec_id": ids[col], "score": score})

    askers = settle(rows.where(F.col("id") % every == 0).groupBy("id").agg(F.min("v").alias("v")))
    best = answers(askers, o.exact)
    if not o.exact:  # a query whose lists hold too few candidates reads all lists
        enough = best.groupBy("query_id").count().where(F.col("count") >= k).select(F.col("query_id").alias("id"))
        short = askers.join(enough, "id", "left_anti")
        if short.take(1):
            best = best.join(enough.withColumnRenamed("id", "query_id"), "query_id", "left_semi").unionByName(answers(short, True))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")  # of a query: k rows for each list that it read
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op7_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(table(spark, sf_dir, "embeddings"))


QUERIES = {"op7_ann": op7_ann}
#: The search is approximate; tests measure recall against all pairs.
SQL: dict[str, str] = {}
