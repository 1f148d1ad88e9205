"""Connected components of a distributed edge table, by alternating large and small stars.

When at most ``small`` edges are left (they are counted in each round), one task finishes them; more go on in rounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import scratch, settle


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """edges: u, v. Each node hands the smallest node around it to its larger (large star) or smaller neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    if not large:
        both = both.where("v < u")
    # written first, so that the join below reads two plain sides, whose large partitions can be split
    low = settle(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("low")))
    joined = both.join(low, "u")
    linked = joined.where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")) if large else joined.select(F.col("v").alias("u"), F.col("low").alias("v")).unionByName(low.select("u", F.col("low").alias("v")))
    return settle(linked.where("u <> v").distinct())


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Labels fall along the edges and then along the labels, until none falls."""
    parts = [(np.asarray(b["u"]), np.asarray(b["v"])) for b in batches if b.num_rows]
    if not parts:
        return
    nodes, ends = np.unique(np.concatenate([x for part in parts for x in part]), return_inverse=True)
    cuts = np.cumsum([len(x) for part in parts for x in part])[:-1]
    split = np.split(ends, cuts)
    u, v, label = np.concatenate(split[::2]), np.concatenate(split[1::2]), np.arange(len(nodes))
    while True:
        low, lower = np.minimum(label[u], label[v]), label.copy()
        for at in (u, v, label[u], label[v]):
            np.minimum.at(lower, at, low)
        while (lower[lower] != lower).any():
            lower = lower[lower]
        if (lower == label).all():
            break
        label = lower
    other = np.flatnonzero(label != np.arange(len(nodes)))
    yield pa.record_batch([pa.array(nodes[other]), pa.array(nodes[label[other]])], names=["node", "label"])


def components(edges: DataFrame, small: int = 1 << 18) -> DataFrame:
    """edges: u, v long. Gives node, label: the smallest node of its component, for all nodes but those smallest ones."""
    with scratch(edges.sparkSession) as outer:
        found, before = settle(edges.where("u <> v").select("u", "v")), None
        if found.count() > small:
            found = settle(found.distinct())
        while True:
            now = found.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
            if now[0] <= small:
                return settle(found.coalesce(1).mapInArrow(_finish, "node long, label long"), outer)
            if now == before:
                return settle(found.select(F.col("u").alias("node"), F.col("v").alias("label")), outer)
            before = now
            found = _stars(_stars(found, True), False)
