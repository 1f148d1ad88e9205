"""Overlaps of sets in one block, as a sparse matrix product: rows are sets, columns the elements that several of them have.

The product of a strip of rows with all rows is accumulated column block by column block: first the prefix columns, then the
other sparse columns, then the dense ones as bits. After each block the pairs that can no longer reach the bound that follows
from their sizes are discarded. Prefixes are exact: columns are ordered by how many sets of the block have them, rare ones first,
and of two similar sets of which the smaller has n elements, both must have one of their first n - ceil(s n) + 1 in common.

Only links between groups are wanted, so groups merge as they are found, and the rows of the largest one are left to the end:
when all rows outside it have been compared with all others, no link between groups is left, since none lies within it. A
cloud of near copies therefore costs a few strips, and sets that share only frequent elements have no pairs at all.
"""

from __future__ import annotations

import numpy as np

DENSE = 32  # a column that more than one in so many rows have is a bit, rarer ones are postings
STRIP = 64  # rows of a strip; the first ones are shorter, since groups form there
WIDE = 2  # entries of prefixes for each pair of rows, beyond which all pairs are compared
PAIRS = 1 << 22  # words of bits that are compared at once


def _ranges(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All positions of some ranges, and which range each is of."""
    length = last - first
    of = np.repeat(np.arange(len(first)), length)
    return np.arange(len(of)) - np.repeat(np.cumsum(length) - length, length) + first[of], of


class Postings:
    """Some entries of a matrix by column: which rows have them."""

    def __init__(self, row: np.ndarray, column: np.ndarray, columns: int):
        self.owner = row[np.argsort(column, kind="stable")]
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(column, minlength=columns))])

    def work(self, column: np.ndarray) -> int:
        return int((self.starts[column + 1] - self.starts[column]).sum())

    def product(self, local: np.ndarray, column: np.ndarray, strip: int, rows: int) -> np.ndarray:
        """How many of the entries (local row, column) of a strip each row shares: strip x rows."""
        at, of = _ranges(self.starts[column], self.starts[column + 1])
        return np.bincount(local[of] * rows + self.owner[at], minlength=strip * rows)


class Incidence:
    """Sets as rows, smaller ones first, with the elements that several have as columns, rare ones first."""

    def __init__(self, sets: list[np.ndarray], similarity: float):
        size = np.array([len(x) for x in sets], dtype=np.int64)
        self.order = np.argsort(size, kind="stable")
        self.size, self.n, self.similarity = size[self.order], len(sets), similarity
        row = np.repeat(np.arange(self.n), self.size)
        elements, number, count = np.unique(np.concatenate([sets[i] for i in self.order]) if self.n else np.zeros(0, np.int64), return_inverse=True, return_counts=True)
        rank = np.empty(len(elements), dtype=np.int64)
        rank[np.argsort(count, kind="stable")] = np.arange(len(elements))
        shared = (count > 1)[number]
        alone = np.bincount(row[~shared], minlength=self.n)  # elements of one row only come first in its order
        row, column = row[shared], rank[number[shared]]
        by_row = np.lexsort((column, row))
        self.row, column = row[by_row], column[by_row]
        used, self.column = np.unique(column, return_inverse=True)
        often = np.bincount(self.column, minlength=len(used))
        self.length = np.bincount(self.row, minlength=self.n)
        self.starts = np.concatenate([[0], np.cumsum(self.length)])
        prefix = np.maximum(self.size - np.ceil(similarity * self.size - 1e-9).astype(np.int64) + 1 - alone, 0)
        self.first = np.arange(len(self.row)) - self.starts[self.row] < prefix[self.row]
        self.columns = len(used)
        dense = often > max(1, self.n // DENSE)
        self.sparse = ~dense[self.column]
        self.post(np.ones(self.n, dtype=bool))
        self.bits = np.zeros((self.n, -(-int(dense.sum()) // 64)), dtype=np.uint64)
        at = (np.cumsum(dense) - 1)[self.column[~self.sparse]]
        np.bitwise_or.at(self.bits, (self.row[~self.sparse], at >> 6), np.uint64(1) << (at & 63).astype(np.uint64))
        self.sparse_length = np.bincount(self.row[self.sparse], minlength=self.n)

    def post(self, live: np.ndarray) -> None:
        """Postings of the rows that are still to be met."""
        first, sparse = self.first & live[self.row], self.sparse & live[self.row]
        self.prefixes = Postings(self.row[first], self.column[first], self.columns)
        self.postings = Postings(self.row[sparse], self.column[sparse], self.columns)

    def _entries(self, rows: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at, of = _ranges(self.starts[rows], self.starts[rows + 1])
        keep = which[at]
        return of[keep], self.column[at[keep]]

    def near(self, rows: np.ndarray, group: np.ndarray, over: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Similar pairs (row, other) of the rows of a strip, of different groups; the others aren't marked as ``over``."""
        at, column = self._entries(rows, self.first)
        if self.prefixes.work(column) <= WIDE * len(rows) * self.n:
            local, other = np.divmod(np.flatnonzero(self.prefixes.product(at, column, len(rows), self.n)), self.n)
        else:  # prefixes that most rows share tell little
            left = np.flatnonzero(~over)
            local, other = np.repeat(np.arange(len(rows)), len(left)), np.tile(left, len(rows))
        keep = (group[other] != group[rows[local]]) & ~over[other]
        local, other = local[keep], other[keep]
        a, b = self.size[rows[local]], self.size[other]
        bound = self.similarity / (1 + self.similarity) * (a + b) - 1e-6
        keep = np.minimum(self.length[rows[local]], self.length[other]) >= bound
        local, other, bound = local[keep], other[keep], bound[keep]
        if not len(local):
            return local, other
        # the sparse columns, of the rows that still have pairs
        some, place = np.unique(local, return_inverse=True)
        both = self.postings.product(*self._entries(rows[some], self.sparse), len(some), self.n)[place * self.n + other]
        dense = np.minimum(self.length - self.sparse_length, self.bits.shape[1] * 64)
        keep = both + np.minimum(dense[rows[local]], dense[other]) >= bound
        local, other, bound, both = local[keep], other[keep], bound[keep], both[keep]
        step = max(1, PAIRS // max(1, self.bits.shape[1]))
        for k in range(0, len(local), step):
            s = slice(k, k + step)
            both[s] += np.bitwise_count(self.bits[rows[local[s]]] & self.bits[other[s]]).sum(axis=1, dtype=np.int64)
        union = self.size[rows[local]] + self.size[other] - both
        keep = both / np.maximum(union, 1) >= self.similarity
        return rows[local[keep]], other[keep]


def links_among(sets: list[np.ndarray], labels: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Pairs of positions that join all groups (members of one label) between which similar sets are; none within a group. Empty sets are similar to each other."""
    m = Incidence(sets, similarity)
    group = np.unique(np.asarray(labels)[m.order], return_inverse=True)[1]
    out: list[tuple[int, int]] = []

    def join(row: int, other: int) -> None:
        a, b = group[row], group[other]
        if a != b:
            out.append((int(m.order[row]), int(m.order[other])))
            group[group == b] = a

    empty = np.flatnonzero(m.size == 0)
    for other in empty[1:]:
        join(int(empty[0]), int(other))
    over, strip, posted = np.zeros(m.n, dtype=bool), 4, m.n
    while m.n:
        largest = np.argmax(np.bincount(group))
        todo = np.flatnonzero(~over & (group != largest))
        if not len(todo):
            return out
        rows = todo[:strip]
        row, other = m.near(rows, group, over)
        # a row's pairs with one group are one link
        _, one = np.unique(row * m.n + group[other], return_index=True)
        for k in one:
            join(int(row[k]), int(other[k]))
        over[rows] = True
        if 2 * (~over).sum() < posted:
            m.post(~over)
            posted = (~over).sum()
        strip = min(STRIP, 2 * strip)
    return out
