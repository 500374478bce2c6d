"""Dense retrieval: cosine, exact search in blocks, an inverted-file index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.blocks import Kept
from tessera.operators.ranking import top_k

#: Queries that meet a batch of vectors at once, and vectors of such a batch.
QUERY_BLOCK, VECTOR_BLOCK = 4096, 512


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays up to the shorter length; 0 if either norm is 0."""
    n = F.least(F.size(a), F.size(b))
    x, y = F.slice(a, 1, n), F.slice(b, 1, n)
    add = lambda p, e: p + e
    zero = F.lit(0.0)
    dot = F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), zero, add)
    norm = lambda v: F.sqrt(F.aggregate(F.transform(v, lambda p: p.cast("double") * p.cast("double")), zero, add))
    size = norm(x) * norm(y)
    return F.when(size > 0, dot / size).otherwise(0.0)


def _matrix(column: pa.Array) -> np.ndarray:
    """Unit rows in double precision; rows of norm 0 stay 0."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(column), -1)
    norm = np.sqrt((x * x).sum(1, keepdims=True))
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def _nearest(vectors: DataFrame, queries: DataFrame, n_queries: int, k: int, digits: int) -> DataFrame:
    """``(query_id, rank, item, score)``: ``vectors`` is ``(item, v, s)``, ``queries``
    ``(query_id, v, s)``, and a query meets the vectors of its cells ``s``, of which a
    vector has one. The queries are cut in blocks; a block meets a cell in one task by
    matrix products, which keeps ``k`` rows of a query, so neither side is held whole by
    a task and the shuffle after it is small."""
    n_blocks = max(1, -(-n_queries // QUERY_BLOCK))
    block = F.pmod(F.xxhash64("query_id"), F.lit(1 << 20)) % n_blocks
    left = vectors.select("s", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("b"), F.lit(1).alias("side"), F.col("item").cast("long").alias("id"), "v")
    right = queries.select("s", block.cast("int").alias("b"), F.lit(0).alias("side"), F.col("query_id").cast("long").alias("id"), "v")
    both = left.unionByName(right).repartition("s", "b").sortWithinPartitions("s", "b", "side")

    def rows(ids: np.ndarray, kept: Kept | None) -> Iterator[pa.RecordBatch]:
        if kept is not None and (found := kept.rows()) is not None:
            yield pa.RecordBatch.from_pydict({"query_id": pa.array(ids[found[0]]), "item": pa.array(found[1]), "score": pa.array(found[2])})

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, asked, kept = None, None, None
        for batch in batches:
            s, b, side = (batch.column(c).to_numpy() for c in ("s", "b", "side"))
            cuts = [0, *(np.flatnonzero((s[1:] != s[:-1]) | (b[1:] != b[:-1]) | (side[1:] != side[:-1])) + 1).tolist(), len(s)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if lo == hi:
                    continue
                if (s[lo], b[lo]) != now:
                    if asked is not None:
                        yield from rows(asked[0], kept)
                    now, asked, kept = (s[lo], b[lo]), None, None
                ids, x = batch.column("id").slice(lo, hi - lo).to_numpy(), _matrix(batch.column("v").slice(lo, hi - lo))
                if side[lo] == 0:
                    asked = (ids, x) if asked is None else (np.concatenate([asked[0], ids]), np.concatenate([asked[1], x]))
                    continue
                if asked is None:
                    continue
                kept = kept or Kept(len(asked[0]), k, digits)
                for at in range(0, len(ids), VECTOR_BLOCK):
                    for q in range(0, len(asked[0]), VECTOR_BLOCK):
                        some = asked[1][q : q + VECTOR_BLOCK]
                        kept.offer(np.arange(q, q + len(some)), ids[at : at + VECTOR_BLOCK], some @ x[at : at + VECTOR_BLOCK].T)
        if asked is not None:
            yield from rows(asked[0], kept)

    found = both.mapInArrow(search, "query_id long, item long, score double")
    return top_k(found, ["query_id"], [F.desc("score"), F.col("item")], k).select("query_id", "rank", "item", "score")


def exact_knn(vectors: DataFrame, queries: DataFrame, k: int = 10, digits: int = 6) -> DataFrame:
    """``(query_id, rank, item, score)`` by cosine against every vector.

    ``vectors`` is ``(item, v)``, ``queries`` ``(query_id, v)``, all of one length."""
    splits = max(1, int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    left = vectors.select("item", "v", F.pmod(F.xxhash64("item"), F.lit(splits)).cast("int").alias("s"))
    right = queries.select("query_id", "v", F.explode(F.sequence(F.lit(0), F.lit(splits - 1))).alias("s"))
    return _nearest(left, right, queries.count(), k, digits)


class InvertedFile:
    """Approximate search: vectors in lists by their nearest centroid, of which a
    query visits ``probes``. The centroids come from at most ``sample`` rows; all
    rows are in the lists."""

    def __init__(self, vectors: DataFrame, lists: int = 32, sample: int = 20_000, rounds: int = 10):
        n = max(1, vectors.count())
        place = F.pmod(F.xxhash64("item"), F.lit(1_000_003))
        part = vectors.where(place < 1_000_003 * min(1.0, 1.1 * sample / n)).orderBy(place, "item").limit(sample).select("v").toArrow()
        x = _matrix(part.column("v").combine_chunks()) if part.num_rows else np.zeros((1, 1))
        c = x[np.linspace(0, len(x) - 1, min(lists, len(x))).astype(int)].copy()
        for _ in range(rounds):
            own = (x @ c.T).argmax(1)
            for k in range(len(c)):
                if (own == k).any():
                    c[k] = x[own == k].mean(0)
            c /= np.maximum(np.sqrt((c * c).sum(1, keepdims=True)), 1e-12)
        self.centroids, self.vectors = c, vectors

    def _lists(self, df: DataFrame, key: str, probes: int) -> DataFrame:
        c = self.centroids

        def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    own = np.argsort(-(_matrix(batch.column("v")) @ c.T), 1, kind="stable")[:, :probes]
                    take = pa.array(np.repeat(np.arange(batch.num_rows), own.shape[1]))
                    yield pa.RecordBatch.from_pydict({key: batch.column(key).take(take), "v": batch.column("v").take(take), "list": pa.array(own.ravel().astype(np.int64))})

        kinds = dict(df.dtypes)
        return df.select(key, "v").mapInArrow(near, f"{key} {kinds[key]}, v {kinds['v']}, list long")

    def search(self, queries: DataFrame, k: int = 10, probes: int = 8, digits: int = 6) -> DataFrame:
        """The lists are split, so that there are enough tasks for the shuffle."""
        lists = len(self.centroids)
        splits = max(1, -(-int(self.vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")) // lists))
        cell = lambda part: (F.col("list") * splits + part).cast("int").alias("s")
        entries = self._lists(self.vectors, "item", 1).select("item", "v", cell(F.pmod(F.xxhash64("item"), F.lit(splits))))
        asked = self._lists(queries, "query_id", probes).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(splits - 1))))
        return _nearest(entries, asked.select("query_id", "v", cell(F.col("part"))), queries.count(), k, digits)
