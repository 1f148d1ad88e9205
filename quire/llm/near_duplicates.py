"""Near-duplicate groups by text: candidates from SimHash fingerprints and from prefixes of shingle sets, verified on the sets.

Texts are linked if the Jaccard similarity of their sets of word shingles is at least ``similarity``, s. Equal texts are one
class and never paired. Classes are gathered into clusters, whose members are compared with each other:

1. A cluster for each component of fingerprints that the SimHash operator links (``tau`` bits or fewer).
2. Prefixes complete what fingerprints miss. All sets are sorted in one order, rare shingles first. Of n shingles of a set s n
   at least must be in a similar one, so by the pigeonhole principle two similar sets share one of their first n - ceil(s n) + 1.
   It must also be one behind which both have enough left, and their sizes must be near, so chance meetings, whose number grows faster than the table, mostly end there.
   The classes that share such a shingle in their prefixes gather around the smallest of them, their pivot: one cluster for each
   pivot, however many shingles it shares. The order comes from a sample of texts; another sample changes the work but no result.
   Before texts are moved, prefixes are compared: they bound what two sets can share, and clusters fall into the parts that may have links.

Clusters are compared in rounds: each class in one of its clusters, that of its fingerprint if it has company there; then in all
its clusters of prefixes. A round
leaves out clusters whose members are of one group already, deals the members of the others into blocks of ``block_bytes``
of text and MEMBERS members, and finds the links between groups inside each block from the whole shingle sets: a task gives at most one link less than its
block has members, never pairs. So all texts of a cluster meet in its block or, if it has several blocks, most of its groups
merge; a last round then lets the members outside the cluster's largest group meet all others. So no link between texts of
different groups is lost, whatever a cluster's size, and what is shuffled grows with the members, not with their pairs.

Nulls: a null text counts as empty; texts without words are near-duplicates of each other. A null doc_id is kept only in
a group without others. Of repeated rows, and of texts of one group with one doc_id, one stays. Very long texts are compared whole; one that is larger than a block is a
block of its own. Ties go to the smaller doc_id, then to the smaller hash of the text. Other columns pass through, whatever their
names. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.llm.common import blocks, give_back, own_prefix, scratch, settle, shingle_hashes, small_batches, small_side
from quire.llm.graph import components
from quire.llm.op8_simhash import majority, print_components
from quire.llm.overlap import links_among

SAMPLE = 2000, 20_000, 20  # texts by which shingles are ordered: at least, at most, one in so many between. It grows with the table, as chance meetings do
ORDERED = 300_000  # shingles that are known to be frequent, at most
HASHED_BYTES = 512 << 10  # of text whose shingles are in memory at once
BLOCK_BYTES = 16 << 20  # of text that one task compares
FILTERED = 1024  # members of a cluster up to which the beginnings of sets are compared before texts are moved; beyond it texts are compared at once
MEMBERS = 4096  # that a block has at most, about


def _sets(texts: pa.Array, shingle: int) -> Iterator[np.ndarray]:
    """The distinct hashes of each text's shingles."""
    for low, high in blocks(pc.binary_length(texts), HASHED_BYTES):
        hashes, ends = shingle_hashes(texts.slice(low, high - low), shingle)
        for a, z in zip(ends, ends[1:], strict=False):
            yield np.unique(hashes[a:z]).view(np.int64)


def _frequent(docs: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several texts of a sample have, sorted, and how many have each."""

    @F.arrow_udf("array<long>")
    def sets(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array(list(_sets(texts, shingle)), pa.list_(pa.int64()))

    n = docs.count()
    rate = max(1, n // max(SAMPLE[0], min(SAMPLE[1], n // SAMPLE[2])))
    sample = docs.where(F.pmod("node", F.lit(rate)) == 0).dropDuplicates(["node"])
    counts = settle(sample.select(F.explode(sets(F.col("body"))).alias("key")).groupBy("key").count().where("count > 1").orderBy(F.desc("count"), "key").limit(ORDERED))
    found = counts.orderBy("key").toArrow()
    return tuple(np.concatenate([np.zeros(0, np.int64), *(np.asarray(x, dtype=np.int64) for x in found[c].chunks)]) for c in ("key", "count"))


def _sketch(text: Column, shingle: int, similarity: float, frequent: tuple[np.ndarray, np.ndarray], prints: bool) -> Column:
    """A text's fingerprint (zero without ``prints``), the size of its shingle set, and as much of the sorted set as a similar one must share a shingle with.

    Shingles are numbers whose order is the common one: hashes, then the frequent shingles by their counts.
    """
    known, counts = frequent
    place = np.empty(len(known), dtype=np.int64)
    place[np.lexsort((known, counts))] = np.arange(len(known))

    @F.arrow_udf("struct<fingerprint:long,size:int,keys:array<long>>")
    def sketch(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            marks, sizes, keys = [], [], []
            for low, high in blocks(pc.binary_length(texts), HASHED_BYTES):
                hashes, ends = shingle_hashes(texts.slice(low, high - low), shingle)
                codes = (hashes >> np.uint64(2)).view(np.int64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, hashes.view(np.int64)), len(known) - 1)
                    codes = np.where(known[at] == hashes.view(np.int64), (1 << 62) + (place[at] << 31), codes)
                for a, z in zip(ends, ends[1:], strict=False):
                    own = np.unique(codes[a:z])
                    marks.append(majority(hashes[a:z]) if prints else 0)
                    sizes.append(len(own))
                    keys.append(own[: len(own) - math.ceil(similarity * len(own) - 1e-9) + 1] if len(own) else np.zeros(1, np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, keys)]).astype(np.int32)), pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64)))
            yield pa.StructArray.from_arrays([pa.array(np.array(marks, dtype=np.uint64).view(np.int64)), pa.array(sizes, pa.int32()), lists], names=["fingerprint", "size", "keys"])
        give_back()

    return sketch(text)


class _Members:
    """The beginnings of the sets of a cluster, smaller sets first: numbered elements, and who has the shared ones."""

    def __init__(self, sets: list[np.ndarray], size: np.ndarray, labels: np.ndarray):
        self.order = np.argsort(size, kind="stable")
        self.size, self.group = size[self.order], np.unique(labels[self.order], return_inverse=True)[1]
        length = np.array([len(sets[i]) for i in self.order], dtype=np.int64)
        self.starts, self.row = np.concatenate([[0], np.cumsum(length)]), np.repeat(np.arange(len(sets)), length)
        self.number, self.count = np.unique(np.concatenate([sets[i] for i in self.order]), return_inverse=True, return_counts=True)[1:]

    def post(self, which: np.ndarray) -> None:
        """Postings of the elements that are marked."""
        by_number = np.argsort(self.number[which], kind="stable")
        posted, self.which = self.number[which][by_number], which
        self.owner = self.row[which][by_number]
        self.first, self.last = np.searchsorted(posted, self.number, side="left"), np.searchsorted(posted, self.number, side="right")

    def shared(self, x: int) -> np.ndarray:
        """How many posted elements of x each member has."""
        mine = np.flatnonzero(self.which[self.starts[x] : self.starts[x + 1]]) + self.starts[x]
        owners = [self.owner[self.first[k] : self.last[k]] for k in mine]
        return np.bincount(np.concatenate(owners), minlength=len(self.size)) if owners else np.zeros(len(self.size), np.int64)

    def others(self, x: int, similarity: float) -> np.ndarray:
        """Later members of other groups that aren't too large."""
        end = int(np.searchsorted(self.size, self.size[x] / similarity + 1e-6, side="right")) if self.size[x] else int((self.size == 0).sum())
        return x + 1 + np.flatnonzero(self.group[x + 1 : end] != self.group[x])


def candidates_among(keys: list[np.ndarray], size: np.ndarray, labels: np.ndarray, similarity: float) -> np.ndarray:
    """For each member the least position that pairs which may be similar connect it with; its own if none does. keys: beginnings of sorted sets.

    Of two sets, all shared elements up to the smaller of the last keys are shared keys; behind it at most as many as either set has left.
    Keys may be shortened, as long as their order stays: then more pairs may be similar, never fewer.
    """
    b = _Members(keys, size, labels)
    b.post(b.count[b.number] > 1)
    length, n = np.diff(b.starts), len(keys)
    last, wide = b.number[b.starts[1:] - 1], len(b.count)
    place = b.row * wide + b.number
    joined = np.arange(n)
    for x in range(n):
        others = b.others(x, similarity)
        if not len(others):
            continue
        both = b.shared(x)[others]
        others, both = others[both > 0], both[both > 0]
        mine = b.number[b.starts[x] : b.starts[x + 1]]
        behind_x = np.minimum(b.size[x] - length[x], b.size[others] - (np.searchsorted(place, others * wide + last[x], side="left") - b.starts[others]))
        behind_y = np.minimum(b.size[x] - np.searchsorted(mine, last[others], side="left"), b.size[others] - length[others])
        most = both + np.where(last[x] <= last[others], behind_x, behind_y)
        found = others[most >= similarity / (1 + similarity) * (b.size[x] + b.size[others]) - 1e-6]
        if len(found):
            parts = np.unique(np.append(joined[found], joined[x]))
            joined[np.isin(joined, parts)] = parts[0]
    out = np.arange(n)
    least = np.full(n, n)
    np.minimum.at(least, joined, b.order)
    out[b.order] = least[joined]
    return out


def _in_blocks(rows: DataFrame, key: list[str], work: Callable[[list[dict]], pa.RecordBatch | None], read: Callable[[pa.RecordBatch], Iterator[dict]], schema: str) -> DataFrame:
    """What a function makes of the rows of each block, one block at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: tuple = ()
        members: list[dict] = []
        for batch in batches:
            for member, at in zip(read(batch), zip(*(batch[c].to_pylist() for c in key), strict=True), strict=True):
                if at != block:
                    if len(members) > 1 and (out := work(members)):
                        yield out
                    block, members = at, []
                members.append(member)
        if len(members) > 1 and (out := work(members)):
            yield out
        members = []
        give_back()

    return rows.repartition(*key).sortWithinPartitions(*key).mapInArrow(run, schema)


def _gathered(classes: DataFrame, similarity: float) -> DataFrame:
    """cluster, node, size: the classes around the smallest class that they share a shingle of their prefixes with. classes: node, size, keys.

    A shared shingle only counts if it can be the first that two similar sets share: behind it each must have as many as both have in
    common at least, and sizes must be near. Two sets are told exactly, of more the members that no size in their band lets pass leave.
    """
    bound = similarity / (1 + similarity)  # of the sum of two sizes, what similar sets have in common
    keys = classes.select("node", "size", F.posexplode("keys").alias("at", "value")).select("value", "node", "size", (F.col("size") - F.col("at")).alias("rest"))
    keys = keys.repartition("value")  # moved once, at any size: counted where they are, and met there by what is counted
    lead = F.col("rest") >= F.lit(2 * bound) * F.col("size") - 1e-6  # so for the smaller of two
    able = (F.col("n") > 1) & F.col("lead") & ((F.col("n") > 2) | (F.col("least") >= bound * F.col("total") - 1e-6))
    sums = {"cluster": F.min("node"), "n": F.count("*"), "total": F.sum("size"), "least": F.min("rest"), "lead": F.max(lead)}
    ends = keys.groupBy("value").agg(*[c.alias(k) for k, c in sums.items()]).where(able).select("value", "cluster", "n")
    found = settle(keys.join(ends.hint("shuffle_hash"), "value"))
    # of two similar sets the sizes are in one band or in neighbouring ones
    band = F.floor(F.log(F.greatest("size", F.lit(1))) / F.lit(1e-6 - math.log(max(similarity, 1e-9))))
    small = found.where(F.col("n") <= FILTERED).drop("cluster", "n").withColumn("band", F.explode(F.array(band, band + 1)))
    within = Window.partitionBy("value", "band")
    small = small.withColumns({k: c.over(within) for k, c in (sums | {"smallest": F.min("size")}).items()})
    small = small.where(able & (F.col("rest") >= bound * (F.col("size") + F.col("smallest")) - 1e-6))
    return found.where(F.col("n") > FILTERED).select("cluster", "node", "size").unionByName(small.select("cluster", "node", "size")).distinct()


def _promising(members: DataFrame, classes: DataFrame, similarity: float) -> DataFrame:
    """cluster, node: of clusters of at most FILTERED members, the parts whose beginnings of sets allow for links; the others as they are. members: cluster, node, size."""
    counts = small_side(members.groupBy("cluster").agg(F.count("*").alias("n")))
    counted = members.join(counts, "cluster")

    def read(batch: pa.RecordBatch) -> Iterator[dict]:
        for cluster, node, size, keys in zip(*(batch[c].to_pylist() for c in ("cluster", "node", "size")), batch["keys"], strict=True):
            yield {"cluster": cluster, "node": node, "size": size, "keys": np.asarray(keys.values, dtype=np.int64)}

    def work(rows: list[dict]) -> pa.RecordBatch | None:
        part = candidates_among([r["keys"] for r in rows], np.array([r["size"] for r in rows], dtype=np.int64), np.arange(len(rows)), similarity)
        kept = [k for k in range(len(rows)) if np.bincount(part, minlength=len(rows))[part[k]] > 1]
        names = [xxhash.xxh64_intdigest(f"{rows[k]['cluster']} {rows[part[k]]['node']}") - (1 << 63) for k in kept]
        return pa.record_batch([pa.array(names, pa.int64()), pa.array([rows[k]["node"] for k in kept], pa.int64())], names=["cluster", "node"]) if kept else None

    # members of about no other's size leave first
    by_size = Window.partitionBy("cluster").orderBy("size")
    alike = (F.lag("size").over(by_size) >= similarity * F.col("size") - 1e-6) | (F.col("size") >= similarity * F.lead("size").over(by_size) - 1e-6)
    small = counted.where(F.col("n") <= FILTERED).withColumn("alike", alike).where("alike").select("cluster", "node")
    # thin rows go to the sets where they are few enough, so that sets are moved once, as numbers of 32 bits
    short = F.transform("keys", lambda k: (F.shiftright(k, 31) - F.lit(1 << 31)).cast("int"))
    small = classes.select("node", "size", short.alias("keys")).join(small_side(small), "node")
    kept = _in_blocks(small.select("cluster", "node", "size", "keys"), ["cluster"], work, read, "cluster long, node long")
    return kept.unionByName(counted.where(F.col("n") > FILTERED).select("cluster", "node"))


def _links(dealt: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Links u, v between members of different labels in each block. dealt: cluster, i, j, node, label."""

    def read(batch: pa.RecordBatch) -> Iterator[dict]:
        for node, label, own in zip(batch["node"].to_pylist(), batch["label"].to_pylist(), _sets(batch["body"], shingle), strict=True):
            yield {"node": node, "label": label, "set": own}

    def work(rows: list[dict]) -> pa.RecordBatch | None:
        nodes = np.array([r["node"] for r in rows], dtype=np.int64)
        ends = nodes[np.array(links_among([r["set"] for r in rows], np.array([r["label"] for r in rows]), similarity), dtype=np.int64).reshape(-1, 2)]
        return pa.record_batch([pa.array(ends.max(axis=1)), pa.array(ends.min(axis=1))], names=["u", "v"]) if len(ends) else None

    rows = texts.join(small_side(dealt), "node").select("cluster", "i", "j", "node", "label", "body")
    return _in_blocks(rows, ["cluster", "i", "j"], work, read, "u long, v long")


def _compare(members: DataFrame, nodes: DataFrame, texts: DataFrame, shingle: int, similarity: float, block_bytes: int, seed: int, last: bool) -> tuple[DataFrame | None, bool]:
    """The links of a round, or None if no cluster needs it, and whether a cluster had several blocks. members: cluster, node. nodes: node, bytes, label."""
    with_label = members.join(nodes, "node")
    parts = lambda c: F.greatest(F.lit(1), F.ceil(c / F.lit(block_bytes))).cast("int")
    if not last:
        clusters = with_label.groupBy("cluster").agg(F.min("label").alias("a"), F.max("label").alias("b"), F.sum("bytes").alias("total")).where("a <> b").select("cluster", parts(F.col("total")).alias("parts"))
    else:  # the members of a label are summed first, so that a large cluster is a few rows
        groups = with_label.groupBy("cluster", "label").agg(F.sum("bytes").alias("bytes"))
        clusters = groups.groupBy("cluster").agg(F.max(F.struct("bytes", "label")).alias("top"), F.sum("bytes").alias("total"), F.count("*").alias("n")).where("n > 1")
        clusters = clusters.select("cluster", F.col("top.label").alias("most"), parts(F.col("total")).alias("parts"), parts(F.col("top.bytes")).alias("inner"), parts(F.col("total") - F.col("top.bytes")).alias("outer")).where("parts > 1")
    clusters = small_side(clusters)
    most = clusters.agg(F.max("parts")).first()[0]
    if most is None:
        return None, False
    dealt = with_label.join(clusters, "cluster")
    part = lambda n: F.pmod(F.xxhash64("node", F.lit(seed)), F.col(n)).cast("int")
    if not last:
        dealt = dealt.withColumns({"i": part("parts"), "j": F.lit(0)})
    else:  # blocks of the largest group are columns from 0, of the others from ``inner``; rows are blocks of the others
        dealt = dealt.withColumns({"inside": F.col("label") == F.col("most")}).withColumn("k", F.when(F.col("inside"), part("inner")).otherwise(part("outer")))
        row_of = lambda i, j: F.struct(i.alias("i"), j.alias("j"))
        k = F.col("k")
        inside = F.transform(F.sequence(F.lit(0), F.col("outer") - 1), lambda o: row_of(o, k))
        outside = F.concat(F.transform(F.sequence(F.lit(0), F.col("inner") - 1), lambda c: row_of(k, c)), F.transform(F.sequence(F.lit(0), F.col("outer") - 1), lambda o: row_of(F.least(k, o), F.col("inner") + F.greatest(k, o))))
        dealt = dealt.withColumn("at", F.explode(F.when(F.col("inside"), inside).otherwise(outside))).select("cluster", "at.i", "at.j", "node", "label")
    return _links(dealt.select("cluster", "i", "j", "node", "label"), texts, shingle, similarity), most > 1


def near_duplicate_classes(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, tau: int | None = 2, block_bytes: int = BLOCK_BYTES, empty: bool = True) -> DataFrame:
    """docs: doc, node (hash of body), body. Gives the classes of equal texts: node, least (doc), size (of the set), label (the smallest node of its group).

    tau: None leaves out the clusters of fingerprints, which only change the work. empty: whether texts without words are linked with each other.
    """
    with scratch(docs.sparkSession) as outer:
        sketch = _sketch(F.col("body"), shingle, similarity, _frequent(docs, shingle), tau is not None)
        rows = docs.select("doc", "node", F.octet_length("body").cast("long").alias("bytes"), sketch.alias("s"))
        first = [F.first(f"s.{c}").alias(c) for c in ("fingerprint", "size", "keys")]
        classes = settle(rows.groupBy("node").agg(F.min("doc").alias("least"), F.first("bytes").alias("bytes"), *first))
        around = settle(_gathered(classes.where(F.lit(empty) | (F.col("size") > 0)).select("node", "size", "keys"), similarity))
        around = settle(_promising(around, classes, similarity))
        # first, each class is compared in one cluster: that of its fingerprint if there is one, else one of prefixes
        near = around.select("cluster", "node", F.lit(1).alias("rank"))
        if tau is not None:
            found = print_components(classes.select("fingerprint").distinct(), tau)
            alike = classes.join(found.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").select(F.coalesce("label", "fingerprint").alias("cluster"), "node")
            alike = alike.join(alike.groupBy("cluster").count().where("count > 1").select("cluster"), "cluster")
            near = near.unionByName(alike.select("cluster", "node", F.lit(0).alias("rank")))
        one = settle(near.groupBy("node").agg(F.min(F.struct("rank", "cluster"))["cluster"].alias("cluster")))
        thin = classes.select("node", "least", "size", F.greatest("bytes", F.lit(max(1, block_bytes // MEMBERS)).cast("long")).alias("bytes"))
        wanted = small_side(thin.join(one, "node", "left_semi").select("node", F.col("least").alias("__least")))
        texts = docs.join(wanted, "node").where(F.col("doc").eqNullSafe(F.col("__least"))).select("node", "body")
        texts = settle(texts.dropDuplicates(["node"]))

        labelled, links = thin.withColumn("label", F.col("node")), None
        for seed, (members, last) in enumerate([(one, False), (around, False), (around, True)]):
            new, split = _compare(members, labelled, texts, shingle, similarity, block_bytes, seed, last)
            if new is not None:
                links = settle(new if links is None else links.unionByName(new))
                labelled = thin.join(components(links), "node", "left").withColumn("label", F.coalesce("label", "node"))
            if seed == 1 and not split:
                break  # all members of each cluster have met
        return settle(labelled.select("node", "least", "size", "label"), outer)


def drop_near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = 5, similarity: float = 0.8, **options: int) -> DataFrame:
    """The rows without those that are near-duplicates of one with a smaller doc_id in their group."""
    small_batches(docs.sparkSession)
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc"), F.xxhash64(body).alias("node"))
    labelled = near_duplicate_classes(docs.select(F.col(doc_id).alias("doc"), F.xxhash64(body).alias("node"), body.alias("body")), shingle, similarity, **options)
    kept = labelled.groupBy("label").agg(F.min(F.struct(F.col("least").isNull(), F.col("least"), F.col("node"))).alias("k")).select(F.col("k.node").alias("node"), F.col("k.least").alias("least"))
    kept = settle(kept.withColumn("keeps", F.lit(True)))
    counted = settle(rows.groupBy("doc", "node").count().join(kept, "node", "left").withColumn("keeps", F.coalesce(F.col("keeps") & F.col("doc").eqNullSafe(F.col("least")), F.lit(False))))
    mine = own_prefix(docs)
    gone = small_side(counted.where("NOT keeps").select(F.col("doc").alias(f"{mine}doc"), F.col("node").alias(f"{mine}gone")))
    left = docs.withColumn(f"{mine}node", F.xxhash64(body))
    left = left.join(gone, (F.col(f"{mine}node") == F.col(f"{mine}gone")) & F.col(doc_id).eqNullSafe(F.col(f"{mine}doc")), "left_anti")
    if counted.where("keeps AND count > 1").take(1):
        left = left.dropDuplicates([doc_id, f"{mine}node"])
    return left.drop(f"{mine}node")
