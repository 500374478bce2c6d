"""Scores of blocks of queries and items, of which only the first of each query stay.

A block is a matrix in a Python worker; neither the pairs nor the items of a task are
ever held whole, and what leaves a task is ``k`` rows of a query at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import SparkSession

#: Queries and items of a block.
QUERIES, ITEMS = 256, 512
#: Numbers of the largest matrix of a block of items.
CELLS = 1 << 22
#: Bytes of rows that Spark sends to a Python worker at once.
TRANSFER_BYTES = 1 << 22


def small_transfers(spark: SparkSession) -> None:
    """From now on rows of this session go to Python in batches of ``TRANSFER_BYTES``, so
    that what a worker holds of them doesn't depend on how long texts are. By default a
    batch is 10,000 rows or 64 MB, which a worker holds several times over. A smaller
    setting stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name).rstrip("bB")
    if not now.isdigit() or int(now) > TRANSFER_BYTES:
        spark.conf.set(name, str(TRANSFER_BYTES))


def rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """Halves go away from zero, as SQL rounds."""
    scale = 10.0**digits
    return np.copysign(np.floor(np.abs(x) * scale + 0.5), x) / scale + 0.0


class Kept:
    """The first ``k`` items of each of ``n`` queries, largest score first, then smallest
    item. ``digits`` rounds scores before they are compared."""

    def __init__(self, n: int, k: int, digits: int | None = None):
        self.n, self.k, self.digits = n, k, digits
        self.least = np.full(n, -np.inf)
        self.last: np.ndarray | None = None
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size, self.most = 0, 1 << 17

    def offer(self, queries: np.ndarray, items: np.ndarray, score: np.ndarray, valid: np.ndarray | None = None) -> None:
        """``score[i, j]`` of query ``queries[i]`` and item ``items[j]``, where ``valid``."""
        slack = 0.0 if self.digits is None else 10.0**-self.digits
        least = self.least[queries]
        found = score >= (least - slack)[:, None]
        if valid is not None:
            found &= valid
        if score.shape[1] > 2 * self.k and found.sum() > found.size / 4:
            # Nothing is known of most queries yet: a block settles its own limit.
            own = score if valid is None else np.where(valid, score, -np.inf)
            found &= own >= (np.partition(own, -self.k, 1)[:, -self.k] - slack)[:, None]
        i, j = np.nonzero(found)
        if not len(i):
            return
        s, q, x = score[i, j], queries[i], items[j]
        if self.digits is not None:
            s = rounded(s, self.digits)
        stay = s >= self.least[q]
        if self.last is not None:
            stay &= (s > self.least[q]) | (x < self.last[q])
        self.parts.append((q[stay], x[stay], s[stay]))
        self.size += int(stay.sum())
        if self.size > self.most:
            self.prune()

    def prune(self) -> None:
        q, x, s = (np.concatenate(c) for c in zip(*self.parts, strict=True))
        place = np.unique(x, return_inverse=True)[1] if x.dtype == object else x
        order = np.lexsort((place, -s, q))
        q, x, s = q[order], x[order], s[order]
        first = np.searchsorted(q, q)
        at = np.arange(len(q)) - first
        full = at == self.k - 1
        self.least[q[full]] = s[full]
        if x.dtype != object:
            if self.last is None:
                self.last = np.full(self.n, np.iinfo(x.dtype).max if x.dtype.kind in "iu" else np.inf, x.dtype)
            self.last[q[full]] = x[full]
        stay = at < self.k
        self.parts = [(q[stay], x[stay], s[stay])]
        self.size = int(stay.sum())
        self.most = max(1 << 17, 2 * self.size)

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """Query, item and score of what is kept."""
        if not self.parts:
            return None
        self.prune()
        return self.parts[0]


class Wanted:
    """Sparse queries: rows of ``(query, term, weight)``, all numbered from 0. Rows of a
    query are added up one after the other, for a block of queries at once."""

    def __init__(self, query: np.ndarray, term: np.ndarray, weight: np.ndarray | None = None):
        order = np.argsort(query, kind="stable")
        query, term = query[order], term[order]
        weight = None if weight is None else weight[order]
        some, start, count = np.unique(query, return_index=True, return_counts=True)
        by = np.argsort(-count, kind="stable")
        self.blocks = []
        for lo in range(0, len(by), QUERIES):
            own = by[lo : lo + QUERIES]
            rounds = []
            for k in range(int(count[own[0]])):
                at = start[own[: int((count[own] > k).sum())]] + k
                rounds.append((term[at], None if weight is None else weight[at][:, None]))
            self.blocks.append((some[own], rounds))

    def sums(self, block: int, places: np.ndarray, cells: np.ndarray, weighted: bool = True) -> np.ndarray:
        """``sum(weight * cells[places[term]])`` of each query of a block."""
        own, rounds = self.blocks[block]
        out = np.zeros((len(own), cells.shape[1]))
        for term, weight in rounds:
            x = cells[places[term]]
            if weighted and weight is not None:
                x *= weight
            out[: len(term)] += x
        return out


def cut(item: np.ndarray, term: np.ndarray, n_items: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Items in ranges ``[lo, hi)`` whose matrix has ``CELLS`` numbers at most (one item
    alone may have more): with the rows of the range and its distinct terms. Rows are
    in the order of their items."""
    todo = [(lo, min(lo + ITEMS, n_items)) for lo in range(0, n_items, ITEMS)][::-1]
    while todo:
        lo, hi = todo.pop()
        a, b = np.searchsorted(item, [lo, hi])
        own = np.unique(term[a:b])
        if (len(own) + 1) * (hi - lo) > CELLS and hi - lo > 1:
            mid = (lo + hi) // 2
            todo += [(mid, hi), (lo, mid)]
            continue
        yield lo, hi, np.arange(a, b), own
