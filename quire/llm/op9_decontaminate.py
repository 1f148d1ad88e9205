"""Benchmark decontamination by latent semantic retrieval.

1. Benchmark items are cut into passages of ``WINDOW`` words (overlapping by half). Word weights are inverse document
   frequencies, counted over all documents for the words that the benchmark has.
2. A randomised SVD of the TF-IDF passages, computed by distributed products A^T (A Q) over the passage table, gives the
   latent space. Passages and all windows of all documents (``WINDOW`` words, a step of ``STEP``) are projected into it.
3. Windows whose cosine with a passage is at least ``cosine`` are candidates. A window whose projection is too short for
   any passage to reach it is passed over, which loses none of those (Cauchy-Schwarz).
4. The latent space keeps little of a passage if the benchmark is large, so stretches are also retrieved by words alone.
   If n of an item's words must be there, at most its length less n are missing; so of that many and m more of its rarest
   words, m at least are there. Stretches of three item lengths with m of them are candidates, which loses none.
5. Around each candidate the longest common subsequence with the whole item is measured. A document leaks the item
   if ``whole`` of its words are there in order, or if ``paraphrase`` of them are and so is its answer: the last
   quarter of the item, of which ``answer`` must be there in order. Excerpts of longer items leak them too: ``whole`` of the
   words of a passage in order, or any ``WINDOW`` consecutive words of the item. Passages are retrieved by words as items are.

The projection, search and checks run where the text is, so documents are not shuffled and no candidate is cut off. The
benchmark is worked through in blocks of about ``ITEMS`` items or ``ITEM_BYTES`` bytes, so what tasks hold is bounded whatever the benchmark's size.

Words are runs of ASCII letters, digits and non-ASCII characters; A-Z are lower-cased. Nulls: null or empty texts and
items leak nothing. Very long documents and items are read whole, window by window. Items are reported by their ids, so ties need no
order. Repeated rows are judged alike, repeated items are reported each. An empty table on either side gives no leaks. A
column named like this operator's is replaced; others pass through.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import WORD_BYTES, blocks, give_back, segment_sum, settle, small_batches, table, words_of

WINDOW, STEP = 24, 8
RANK, OVERSAMPLE, POWER = 256, 16, 2
ITEMS, ITEM_BYTES = 20_000, 16 << 20  # of a block of the benchmark
SUM_BYTES = 128 << 10  # of a row that brings a piece of a sum to the driver, whose virtual machine would grow by larger ones
PASSAGES = 10_000  # of a task of the decomposition
BLOCK_BYTES = 256 << 10
HITS = 1 << 18  # word occurrences that are counted at once
LEAKS = "array<struct<item_id:long,at:int,ratio:double>>"


def item_words(texts: pa.Array) -> list[list[str]]:
    words, starts = words_of(texts, WORD_BYTES)
    plain = words.to_pylist()
    return [plain[a:b] for a, b in zip(starts, starts[1:], strict=False)]


def passage_starts(words: int) -> list[int]:
    last = max(0, words - WINDOW)
    return sorted({*range(0, last, WINDOW // 2), last})


def passages_of(words: list[str]) -> list[list[str]]:
    """Pieces of WINDOW words, half overlapping, the last flush with the end; a shorter text is one piece."""
    return [words[i : i + WINDOW] for i in passage_starts(len(words))] if words else []


def places_of(pattern: list[int]) -> dict[int, int]:
    """The places of each word of a pattern, as bits."""
    place: dict[int, int] = {}
    for i, w in enumerate(pattern):
        place[w] = place.get(w, 0) | 1 << i
    return place


def common_length(pattern: list[int], text: list[int], least: int = 0, place: dict[int, int] | None = None) -> int:
    """The length of the longest common subsequence, by bits of one integer; 0 if too few words of the pattern occur for ``least``."""
    place = place if place is not None else places_of(pattern)
    found = place.get
    matches = [m for w in text if (m := found(w))]  # other words change nothing
    if len(matches) < least:
        return 0
    row = full = (1 << len(pattern)) - 1
    for match in matches:
        both = row & match
        row = (row + both | row - both) & full
    return len(pattern) - row.bit_count()


def document_frequencies(docs: DataFrame, text: str, vocabulary: list[str]) -> tuple[int, np.ndarray]:
    """How many documents there are, and how many of them have each word."""
    size = len(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, total, rows = pa.array(vocabulary, pa.large_string()), np.zeros(size, np.int64), 0
        for b in batches:
            for low, high in blocks(pc.binary_length(b[text]), BLOCK_BYTES):
                words, starts = words_of(b[text].slice(low, high - low), WORD_BYTES)
                ids = np.asarray(pc.index_in(words, value_set=known).fill_null(-1), dtype=np.int64)
                pairs = np.unique((np.repeat(np.arange(high - low), np.diff(starts)) * size + ids)[ids >= 0])
                total += np.bincount(pairs % size, minlength=size)
                rows += high - low
        if rows:
            yield pa.record_batch([pa.array(np.arange(size + 1)), pa.array(np.append(total, rows))], names=["word", "n"])

    sums = dict(docs.select(text).mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n")).collect())
    return sums.get(size, 0), np.array([sums.get(i, 0) for i in range(size)], dtype=np.float64)


def randomised_svd(passages: DataFrame, words: int, rank: int = RANK, oversample: int = OVERSAMPLE, power: int = POWER, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The leading right singular vectors (as columns) and singular values. passages: words array<int>, weights array<double>."""
    sc = passages.sparkSession.sparkContext
    k = min(rank + oversample, words)
    high = max(1, SUM_BYTES // (8 * k))  # rows of a sum in a piece

    def product(q: np.ndarray, gram: bool) -> np.ndarray:
        """A^T (A Q), or (A Q)^T (A Q), summed over the partitions."""
        shared = sc.broadcast(q)

        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            q = shared.value
            total = np.zeros((q.shape[1], q.shape[1]) if gram else q.shape)
            for b in batches:
                starts = np.concatenate([[0], np.cumsum(np.asarray(pc.list_value_length(b["words"]), dtype=np.int64))])
                ids, values = np.asarray(b["words"].flatten(), dtype=np.int64), np.asarray(b["weights"].flatten(), dtype=np.float64)
                y = segment_sum(q[ids] * values[:, None], starts)
                if gram:
                    total += y.T @ y
                else:
                    np.add.at(total, ids, np.repeat(y, np.diff(starts), axis=0) * values[:, None])
            for at in range(0, len(total), high):
                if total[at : at + high].any():
                    yield pa.record_batch([pa.array([at]), pa.array([total[at : at + high].tobytes()], pa.binary())], names=["at", "sum"])

        def added(blocks: pa.Table) -> pa.Table:
            return pa.table({"at": blocks["at"].slice(0, 1), "sum": pa.array([sum(np.frombuffer(b.as_buffer()) for b in blocks["sum"]).tobytes()], pa.binary())})

        # pieces of the sums are added up in the cluster; one matrix comes here, as Arrow batches that the virtual machine only hands on
        found = passages.mapInArrow(part, "at long, sum binary").groupBy("at").applyInArrow(added, "at long, sum binary").toArrow()
        shared.destroy()
        out = np.zeros((q.shape[1], q.shape[1]) if gram else q.shape)
        for b in found.to_batches():
            for at, piece in zip(b["at"].to_pylist(), b["sum"], strict=True):
                piece = np.frombuffer(piece.as_buffer()).reshape(-1, q.shape[1])
                out[at : at + len(piece)] = piece
        return out

    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(words, k)))[0]
    for _ in range(1 + power):
        q = np.linalg.qr(product(q, False))[0]
    values, turn = np.linalg.eigh(product(q, True))
    keep = np.argsort(-values)[: min(rank, k)]
    return q @ turn[:, keep], np.sqrt(np.maximum(values[keep], 0))


class WordIndex:
    """Postings of the rarest words of pieces of text, by which all stretches that may hold ``need[i]`` words of piece i are found."""

    def __init__(self, pieces: list[list[int]], need: list[int], idf: np.ndarray):
        self.span = np.array([len(x) for x in pieces], dtype=np.int64)
        self.least = np.array([max(1, n // 2) for n in need], dtype=np.int64)
        words, owners, counts = [], [], []
        for k, (piece, n) in enumerate(zip(pieces, need, strict=True)):
            chosen = sorted(piece, key=lambda w: (-idf[w], w))[: len(piece) - n + int(self.least[k])]
            w, c = np.unique(chosen, return_counts=True)
            words.append(w)
            owners.append(np.full(len(w), k))
            counts.append(c)
        word, order = np.concatenate(words), np.argsort(np.concatenate(words), kind="stable")
        self.owner, self.count = np.concatenate(owners)[order], np.concatenate(counts)[order]
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(word, minlength=len(idf)))])

    def stretches(self, ids: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """Text, piece and first word; a stretch has three times the words of the piece, and any two lengths lie in one."""
        posted = np.where(ids >= 0, np.diff(self.starts)[np.maximum(ids, 0)], 0)
        total = np.concatenate([[0], np.cumsum(posted)])[starts]
        edges = [0, *(np.flatnonzero(np.diff(total // HITS)) + 1).tolist(), len(starts) - 1]
        for a, b in zip(edges, edges[1:], strict=False):
            if total[b] > total[a]:
                yield from self._stretches(ids, posted, starts, a, b)

    def _stretches(self, ids: np.ndarray, posted: np.ndarray, starts: np.ndarray, a: int, b: int) -> Iterator[tuple[int, int, int]]:
        n = posted[starts[a] : starts[b]]
        at = np.repeat(np.arange(len(n)), n)
        posting = self.starts[ids[starts[a] : starts[b]][at]] + np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
        row = np.repeat(np.arange(b - a), np.diff(starts[a : b + 1]))[at]
        piece = self.owner[posting]
        part = (at + starts[a] - starts[a + row]) // self.span[piece]
        parts = int(part.max()) + 3
        key = (row * len(self.span) + piece) * parts + part
        order = np.argsort(key)
        key, count = key[order], self.count[posting[order]]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        key, count = key[first], np.add.reduceat(count, first)
        here = count.copy()
        for k in (1, 2):
            here[:-k] += np.where(key[k:] - key[:-k] <= 2, count[k:], 0)
        piece = key // parts % len(self.span)
        found = np.flatnonzero(here >= self.least[piece])
        row, piece = key[found] // parts // len(self.span) + a, piece[found]
        yield from zip(row.tolist(), piece.tolist(), (key[found] % parts * self.span[piece]).tolist(), strict=True)


class LatentIndex:
    """The latent vectors of the passages, and the items to check against."""

    def __init__(self, vocabulary: list[str], idf: np.ndarray, rare: float, basis: np.ndarray, vectors: np.ndarray, owner: np.ndarray, items: list[list[int]], ids: list[int], excerpts: list[tuple[int, int]], pieces: WordIndex):
        self.vocabulary, self.idf, self.rare = vocabulary, idf, rare
        self.basis = np.vstack([basis * idf[:, None], np.zeros((1, basis.shape[1]))]).astype(np.float32)
        norm = np.linalg.norm(vectors, axis=1)
        self.vectors, self.owner, self.items, self.ids = (vectors / np.maximum(norm, 1e-9)[:, None]).astype(np.float32), owner, items, ids
        self.excerpts, self.pieces = excerpts, pieces

    def windows(self, ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Row, first word, projection and length of each window of the texts."""
        n, count = len(starts) - 1, np.diff(starts)
        row = np.repeat(np.arange(n), count)
        steps = np.maximum(1, -(-count // STEP))
        first = np.concatenate([[0], np.cumsum(steps)])  # of each text among the steps of all
        step = first[row] + (np.arange(len(ids)) - starts[row]) // STEP
        known = ids >= 0
        weight = np.where(known, self.idf[np.maximum(ids, 0)], self.rare)
        squares = np.bincount(step, weights=weight * weight, minlength=first[-1]).astype(np.float64)
        # the words of a step by their places in it; whatever isn't known has the last row of the basis, which is zero
        slots = np.full((first[-1] + 1, STEP), len(self.basis) - 1)
        slots[step, (np.arange(len(ids)) - starts[row]) % STEP] = np.where(known, ids, len(self.basis) - 1)
        sums = self.basis[slots[:, 0]]
        for k in range(1, STEP):
            sums += self.basis[slots[:, k]]
        wide = WINDOW // STEP
        spans = np.maximum(1, steps - wide + 1)
        of = np.repeat(np.arange(n), spans)
        begin = np.arange(len(of)) - np.repeat(np.cumsum(spans) - spans, spans) + first[of]
        total, square, squares = sums[begin], squares[begin], np.append(squares, 0.0)
        for k in range(1, wide):
            at = np.where(begin + k < first[of + 1], begin + k, first[-1])
            total += sums[at]
            square += squares[at]
        # a repeated word counts once in square for each time; no vector is shorter than its projection
        return of, (begin - first[of]) * STEP, total, np.sqrt(np.maximum(np.maximum(square, np.einsum("ij,ij->i", total, total)), 1e-12))

    def leaks(self, texts: pa.Array, known: pa.Array, cosine: float, whole: float, paraphrase: float, answer: float) -> list[list[dict]]:
        words, starts = words_of(texts, WORD_BYTES)
        ids = np.asarray(pc.index_in(words, value_set=known).fill_null(-1), dtype=np.int64)
        row, at, projected, length = self.windows(ids, starts)
        out: list[list[dict]] = [[] for _ in range(len(texts))]
        places: dict[int, tuple[dict[int, int], np.ndarray]] = {}

        def judge(r: int, j: int, at: int, low: int, high: int) -> None:
            """Takes down item j for text r if its words from low to high hold it."""
            item, region = self.items[j], ids[starts[r] + max(0, low) : min(starts[r + 1], starts[r] + high)]
            if j not in places:
                places[j] = places_of(item), np.unique(item)
            place, own = places[j]
            least = math.ceil(min(whole, paraphrase) * len(item) - 1e-9)
            if np.count_nonzero(own[np.minimum(np.searchsorted(own, region), len(own) - 1)] == region) < least:
                return  # no subsequence can be longer than the words of the item that are there
            region = region.tolist()
            ratio = common_length(item, region, least, place) / len(item)
            tail = item[-max(3, len(item) // 4) :]
            if ratio >= whole or (ratio >= paraphrase and common_length(tail, region) >= answer * len(tail)):
                out[r].append({"item_id": self.ids[j], "at": int(at), "ratio": ratio})

        def judge_passage(r: int, k: int, first: int) -> None:
            """Takes down the item of passage k if the passage is there, or a run of WINDOW words of the item."""
            j, p = self.excerpts[k]
            item, passage = self.items[j], self.items[j][p : p + WINDOW]
            begin, end = starts[r] + first, min(starts[r + 1], starts[r] + first + 3 * WINDOW)
            region = ids[begin:end].tolist()
            found = common_length(passage, region, math.ceil(whole * WINDOW - 1e-9))
            if found < whole * WINDOW:
                wide = ids[max(starts[r], begin - WINDOW) : min(starts[r + 1], end + WINDOW)].tolist()
                runs = {tuple(wide[i : i + WINDOW]) for i in range(len(wide) - WINDOW + 1)}
                if not any(tuple(item[i : i + WINDOW]) in runs for i in range(max(0, p - WINDOW // 2), min(p + WINDOW // 2, len(item) - WINDOW) + 1)):
                    return
                found = common_length(passage, region)
            out[r].append({"item_id": self.ids[j], "at": int(first), "ratio": found / len(item)})

        able = np.flatnonzero(np.einsum("ij,ij->i", projected, projected) >= (cosine * length) ** 2)
        for part in (able[i : i + 4096] for i in range(0, len(able), 4096)):
            near = (projected[part] @ self.vectors.T) / length[part][:, None]
            w, p = np.nonzero(near >= cosine)
            order = np.lexsort((-near[w, p],))
            done: dict[tuple[int, int], list[int]] = {}
            for i, j in zip(part[w[order]].tolist(), self.owner[p[order]].tolist(), strict=True):
                r, item = row[i], self.items[j]
                tried = done.setdefault((r, j), [])
                if any(abs(at[i] - t) < STEP * 2 for t in tried) or any(x["item_id"] == self.ids[j] for x in out[r]):
                    continue
                tried.append(at[i])
                # as much wider as windows that are passed over for this one may lie away
                judge(r, j, at[i], at[i] - len(item) - 2 * STEP, at[i] + WINDOW + len(item) + 2 * STEP)
        passages = []  # judged after the items
        for r, j, first in self.pieces.stretches(ids, starts):
            k = j - len(self.items)
            if k >= 0:
                passages.append((r, k, first))
            elif not any(x["item_id"] == self.ids[j] for x in out[r]):
                judge(r, j, first, first, first + 3 * len(self.items[j]))
        for r, k, first in passages:
            if not any(x["item_id"] == self.ids[self.excerpts[k][0]] for x in out[r]):
                judge_passage(r, k, first)
        return [sorted(x, key=lambda y: y["item_id"]) for x in out]


def _index(docs: DataFrame, text: str, items: DataFrame, share: float, part: float) -> LatentIndex | None:
    """items: item_id, text; a bounded number of them. No check accepts less than ``share`` of an item or ``part`` of a passage but by a run."""
    rows = [(i, w) for i, w in zip(*(lambda t: (t["item_id"].to_pylist(), item_words(t["text"].combine_chunks())))(items.toArrow()), strict=True) if w]
    if not rows:
        return None
    vocabulary = sorted({w for _, words in rows for w in words})
    number = {w: i for i, w in enumerate(vocabulary)}
    n, df = document_frequencies(docs, text, vocabulary)
    idf = np.log((n + 1) / (df + 1)) + 0.1
    cut = [(k, [number[w] for w in p]) for k, (_, words) in enumerate(rows) for p in passages_of(words)]
    made = []
    for _, p in cut:
        ids, counts = np.unique(p, return_counts=True)
        values = counts * idf[ids]
        made.append((ids.tolist(), (values / np.linalg.norm(values)).tolist()))
    passages = docs.sparkSession.createDataFrame(made, "words array<int>, weights array<double>").repartition(-(-len(made) // PASSAGES))  # each part's sum comes to the driver
    basis, _ = randomised_svd(settle(passages), len(vocabulary))
    vectors = np.stack([np.asarray(v) @ basis[ids] for ids, v in made])
    numbered = [[number[w] for w in words] for _, words in rows]
    excerpts = [(k, p) for k, x in enumerate(numbered) if len(x) > WINDOW for p in passage_starts(len(x))]
    # a run of WINDOW words has all but a quarter of WINDOW in common with the nearest passage
    need = [max(1, math.ceil(share * len(x) - 1e-9)) for x in numbered] + [max(1, min(math.ceil(part * WINDOW - 1e-9), WINDOW - WINDOW // 4))] * len(excerpts)
    pieces = WordIndex(numbered + [numbered[k][p : p + WINDOW] for k, p in excerpts], need, idf)
    return LatentIndex(vocabulary, idf, float(np.log(n + 1) + 0.1), basis, vectors, np.array([k for k, _ in cut]), numbered, [i for i, _ in rows], excerpts, pieces)


def find_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", cosine: float = 0.3, whole: float = 0.8, paraphrase: float = 0.6, answer: float = 0.6, name: str = "leaks") -> DataFrame:
    """The rows with the benchmark items that each text holds: item_id, a word position near it, and the share found."""
    small_batches(docs.sparkSession)
    usable = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), "text")
    n, size = usable.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    rounds = max(1, -(-n // ITEMS), -(-(size or 0) // ITEM_BYTES))
    found = []
    for k in range(rounds):
        index = _index(docs, text, usable.where(F.pmod(F.xxhash64("item_id"), F.lit(rounds)) == k), min(whole, paraphrase), whole)
        if index is not None:
            found.append(_search(docs, text, index, cosine, whole, paraphrase, answer))
    leaks = F.array_sort(F.flatten(F.array(*found))) if found else F.array().cast(LEAKS)
    return docs.withColumn(name, leaks)


def _search(docs: DataFrame, text: str, index: LatentIndex, *limits: float):  # noqa: ANN202
    shared = docs.sparkSession.sparkContext.broadcast(vars(index))  # bounded by ITEMS
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("at", pa.int32()), ("ratio", pa.float64())]))

    @F.arrow_udf(LEAKS)
    def search(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        index = LatentIndex.__new__(LatentIndex)
        index.__dict__.update(shared.value)
        known = pa.array(index.vocabulary, pa.large_string())
        for texts in batches:
            yield pa.array([x for a, b in blocks(pc.binary_length(texts), BLOCK_BYTES) for x in index.leaks(texts.slice(a, b - a), known, *limits)], kind)
        give_back()

    return search(F.col(text))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", (F.size("leaks") > 0).alias("contaminated"), F.size("leaks").cast("long").alias("n_items"), F.array_join(F.transform("leaks", lambda x: x["item_id"].cast("string")), ",").alias("items"))


QUERIES = {"op9_decontaminate": op9_decontaminate}
#: SQL has no singular values or subsequences; tests compare with an exhaustive scan.
SQL: dict[str, str] = {}
