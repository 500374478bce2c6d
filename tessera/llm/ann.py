"""Nearest neighbours by an inverted multi-index.

Vectors are cut in two halves, and each half has a codebook of its own, so every
vector lies in a cell named by a pair of centroids. A query visits cells in the
order of the summed distances of its halves to the two centroids, taken from a
heap over the pairs, until the cells hold the wanted share of all vectors; their
entries are reranked by the exact inner product in double precision.

The codebooks are fitted on at most ``sample`` rows chosen by a hash. The share is
the smallest one that reaches ``target`` recall for sample queries against the
sample by brute force; a sample is sparser than the table and needs the larger
share of it, so this errs to the safe side. All rows are indexed.

The entries are dealt to slices of about ``slice_rows`` rows: runs of cells, with
a cell that is larger than a slice dealt over several. A query goes to a slice
only if it visits a cell there. Vectors that are null or zero or hold null or
non-finite components take no part; nor do rows with a null id. Vectors of different
lengths have no inner product: each length is a search of its own. Rows that repeat
an id are separate candidates and one query (of different vectors the one with the
smallest hash). Ties go to the smaller id. An empty table gives no rows; only the id
and the vector column are read besides what ``is_query`` names.
"""

from __future__ import annotations

import functools
import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import staged, tidy


#: Queries whose cells one task finds.
ASKED = 256


@dataclass(frozen=True)
class MultiIndex:
    centroids: int = 128
    sample: int = 20_000
    rounds: int = 12
    target: float = 0.96
    tries: int = 400
    slice_rows: int = 16_384
    block_queries: int = 65_536


@dataclass(frozen=True)
class Codebooks:
    left: np.ndarray
    right: np.ndarray
    share: float

    @property
    def dim(self) -> int:
        return self.left.shape[1] + self.right.shape[1]

    def distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared distances of both halves to the centroids."""
        h = self.left.shape[1]
        return _squares(x[:, :h], self.left), _squares(x[:, h:], self.right)

    def cells(self, x: np.ndarray) -> np.ndarray:
        a, b = self.distances(x)
        return a.argmin(1) * len(self.right) + b.argmin(1)


def _squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)


def _centroids(x: np.ndarray, k: int, rounds: int) -> np.ndarray:
    c = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        own = _squares(x, c).argmin(1)
        n = np.bincount(own, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


def reach(a: np.ndarray, b: np.ndarray, counts: np.ndarray, want: int) -> float:
    """The summed distance up to which cells are visited: pairs come from a heap in
    ascending order until their cells hold ``want`` entries. ``counts`` is the
    grid of entries of each cell."""
    if want <= 0:
        return -np.inf
    i, j = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
    x, y, n = a[i].tolist(), b[j].tolist(), counts[np.ix_(i, j)].tolist()
    heap, held, last = [(x[0] + y[0], 0, 0)], 0, len(y) - 1
    while heap:
        d, r, s = heapq.heappop(heap)
        held += n[r][s]
        if held >= want:
            return d
        if s < last:
            heapq.heappush(heap, (x[r] + y[s + 1], r, s + 1))
        if s == 0 and r + 1 < len(x):
            heapq.heappush(heap, (x[r + 1] + y[0], r + 1, 0))
    return np.inf


def _best(x: np.ndarray, ids: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest inner products, ties to the smaller id."""
    score = (x * q).sum(1)
    if len(score) > k:
        floor = np.partition(score, len(score) - k)[len(score) - k]
        near = np.flatnonzero(score >= floor)
        score, ids = score[near], ids[near]
    order = np.lexsort((ids, -score))[:k]
    return ids[order], score[order]


def fit(x: np.ndarray, k: int, s: MultiIndex) -> Codebooks:
    """Codebooks and share from the sample."""
    half = max(1, x.shape[1] // 2)
    n = max(1, min(s.centroids, len(x) // 16))
    plain = Codebooks(_centroids(x[:, :half], n, s.rounds), _centroids(x[:, half:], n, s.rounds), 1.0)
    cell = plain.cells(x)
    counts = np.bincount(cell, minlength=n * n)
    tries = np.linspace(0, len(x) - 1, min(s.tries, len(x))).astype(int)
    need = []
    a, b = plain.distances(x[tries])
    for t, i in enumerate(tries):
        score = x @ x[i]
        score[i] = -np.inf
        top = np.argsort(-score)[: min(k, len(x) - 1)]
        order = np.sort((a[t][:, None] + b[t]).ravel())
        place = np.argsort((a[t][:, None] + b[t]).ravel(), kind="stable")
        held = np.cumsum(counts[place])
        sums = (a[t][:, None] + b[t]).ravel()[cell[top]]
        need.append(held[np.searchsorted(order, sums, "right") - 1] / len(x))
    need = np.sort(np.concatenate(need)) if need else np.ones(1)
    share = float(need[min(len(need) - 1, int(np.ceil(s.target * len(need))))]) if len(need) else 1.0
    return Codebooks(plain.left, plain.right, min(1.0, share))


def usable(vector: str, dim: int) -> Column:
    """Whether a vector of ``dim`` takes part."""
    v = F.col(vector)
    odd = F.exists(v, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    return F.coalesce(v.isNotNull() & (F.size(v) == dim) & ~odd & F.exists(v, lambda e: e != 0), F.lit(False))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def search(df: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", settings: MultiIndex | None = None) -> DataFrame:
    """``(query_id, rank, <id>, score)``: the ``k`` nearest found of each query."""
    s = settings or MultiIndex()
    empty = df.sparkSession.createDataFrame([], f"query_id long, rank int, {id_col} long, score double")
    lengths = [r.d for r in df.where(is_query & F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).select(F.size(vector_col).alias("d")).where("d > 0").distinct().orderBy("d").collect()]
    found = [x for x in (_search(df, is_query, k, id_col, vector_col, s, d) for d in lengths) if x is not None]
    return functools.reduce(DataFrame.unionByName, found) if found else empty


def _search(df: DataFrame, is_query: Column, k: int, id_col: str, vector_col: str, s: MultiIndex, dim: int) -> DataFrame | None:
    """The search among the vectors of one length."""
    rows = df.where(F.col(id_col).isNotNull() & usable(vector_col, dim)).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"), is_query.alias("query"))
    n = rows.count()
    if not n:
        return None
    place = F.xxhash64("id")
    part = rows.where((place % 1_000_003 + 1_000_003) % 1_000_003 < 1_000_003 * min(1.0, 1.1 * s.sample / n)).orderBy(place, "id").select("v").limit(s.sample).toArrow()
    x = _matrix(part.column("v").combine_chunks(), dim) if part.num_rows else np.zeros((0, dim))
    if not len(x):
        x = _matrix(rows.select("v").limit(1).toArrow().column("v").combine_chunks(), dim)
    books = fit(x, k, s)
    width = len(books.right)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(books.cells(_matrix(batch.column(1), dim)).astype(np.int64))], ["id", "v", "query", "cell"])

    kind = dict(rows.dtypes)["v"]
    coded = staged(rows.mapInArrow(tidy(encode), f"id long, v {kind}, query boolean, cell long"), "ann-entries")
    counts = np.zeros(len(books.left) * width, np.int64)
    for r in coded.groupBy("cell").agg(F.count("*").alias("c")).collect():
        counts[r.cell] = r.c
    # Slices: first slice of each cell, and over how many it is dealt.
    first, over, filled, number = np.zeros(len(counts), np.int64), np.ones(len(counts), np.int64), 0, 0
    for cell in np.flatnonzero(counts).tolist():
        c = int(counts[cell])
        if filled and filled + c > s.slice_rows:
            number, filled = number + 1, 0
        first[cell] = number
        if c > s.slice_rows:
            over[cell] = -(-c // s.slice_rows)
            number, filled = number + int(over[cell]), 0
        else:
            filled += c
    last = number + 1
    want = int(np.ceil(books.share * n))
    n_queries = coded.where("query").count()
    n_blocks = max(1, -(-n_queries // s.block_queries))

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, ids = batch.column(2).to_numpy(), batch.column(0).to_numpy()
            spread = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)
            where = first[cell] + spread % over[cell]
            for block in range(n_blocks):
                yield pa.RecordBatch.from_arrays([pa.array(where * n_blocks + block), pa.array(np.zeros(len(cell), np.int8)), batch.column(0), batch.column(1), batch.column(2), pa.array(np.zeros(len(cell)))], ["task", "kind", "id", "v", "cell", "reach"])

    grid = counts.reshape(len(books.left), width)
    busy = np.flatnonzero(counts)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin, stop = first[busy], first[busy] + over[busy]
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0).to_numpy()
            spread = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)
            a, b = books.distances(_matrix(batch.column(1), dim))
            task, row, far = [], [], []
            for q in range(len(ids)):
                r = reach(a[q], b[q], grid, want)
                seen = a[q][busy // width] + b[q][busy % width] <= r
                hit = np.zeros(last + 1, np.int64)
                np.add.at(hit, begin[seen], 1)
                np.add.at(hit, stop[seen], -1)
                to = np.flatnonzero(np.cumsum(hit)[:-1] > 0)
                task.append(to * n_blocks + spread[q] % n_blocks)
                row.append(np.full(len(to), q))
                far.append(np.full(len(to), r))
            take = np.concatenate(row)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(task)), pa.array(np.ones(len(take), np.int8)), batch.column(0).take(pa.array(take)), batch.column(1).take(pa.array(take)), pa.array(np.zeros(len(take), np.int64)), pa.array(np.concatenate(far))], ["task", "kind", "id", "v", "cell", "reach"])

    def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            task, kinds = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = [0, *(np.flatnonzero((task[1:] != task[:-1]) | (kinds[1:] != kinds[:-1])) + 1).tolist(), len(task)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                part = batch.slice(lo, hi - lo)
                if kinds[lo] == 0:
                    if task[lo] != now:
                        now, held = task[lo], []
                    held.append(part)
                    shelf = None
                    continue
                if task[lo] != now or not held:
                    continue
                if shelf is None:
                    cell = np.concatenate([p.column(4).to_numpy() for p in held])
                    order = np.argsort(cell, kind="stable")
                    cell = cell[order]
                    xs = np.concatenate([_matrix(p.column(3), dim) for p in held])[order]
                    names = np.concatenate([p.column(2).to_numpy() for p in held])[order]
                    own = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
                    shelf = xs, names, cell[own], np.diff(np.append(own, len(cell)))
                xs, names, own, size = shelf
                q = _matrix(part.column(3), dim)
                a, b = books.distances(q)
                far, asked = part.column(5).to_numpy(), part.column(2).to_numpy()
                out = []
                for t in range(len(q)):
                    rows = np.flatnonzero(np.repeat(a[t][own // width] + b[t][own % width] <= far[t], size))
                    rows = rows[names[rows] != asked[t]]
                    found, score = _best(xs[rows], names[rows], q[t], k)
                    out.append((np.full(len(found), asked[t]), found, score))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[c] for o in out])) for c in range(3)], ["query_id", "id", "score"])

    layout = f"task long, kind tinyint, id long, v {kind}, cell long, reach double"
    stored = coded.select("id", "v", "cell").mapInArrow(tidy(entries), layout)
    asked = coded.where("query").groupBy("id").agg(F.min_by("v", F.xxhash64("v")).alias("v")).repartition(max(1, -(-n_queries // ASKED))).mapInArrow(tidy(ask), layout)
    found = stored.unionByName(asked).repartition("task").sortWithinPartitions("task", "kind").mapInArrow(tidy(rerank), "query_id long, id long, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")
