"""Sequences packed by lexical retrieval.

Documents are tokenised and laid out along a lexical order (the smallest hash of
their id pairs, then their id), which puts copies and near copies side by side and
splits however many share a place. Consecutive documents form shards, each with a
BM25 inverted index over token ids, with document frequencies of the whole corpus.
A window starts with a seed; the unused documents that score best against the
seed's strongest terms fill it. What doesn't fit is cut, and the rest starts the
next window as its seed, so only the last window of a partition is not full.

Each document is its ids and ``end_id``; null texts count as empty and are the end
id alone. Repeated rows are documents of their own; nothing is joined by id.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import files, vocab
from tessera.llm.common import mix, mixers, release, small_batches, staged, tidy


#: Pieces of one batch of results.
PIECES = 512


@dataclass(frozen=True)
class Packing:
    window: int = 2048
    end_id: int = 1
    shard_tokens: int = 1_000_000
    terms: int = 24
    k1: float = 1.2
    b: float = 0.75


def _order_key(ids: np.ndarray) -> int:
    """The smallest hash of neighbouring ids."""
    m = mixers(2, 51)
    with np.errstate(over="ignore"):
        wide = ids.astype(np.uint64)
        pairs = mix(wide[:-1] * m[0] + wide[1:] * m[1]) if len(ids) > 1 else mix(wide * m[0])
    return int(pairs.min() >> np.uint64(1))


def tokenised(df: DataFrame, id_col: str, text_col: str, p: Packing, ranks_path: str, json_path: str) -> DataFrame:
    """``(doc, place, n, ids)`` of each row; ids are unsigned 16-bit."""
    special = vocab.special(json_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([p.end_id], np.uint32)
        for batch in small_batches(batches, "text"):
            rows = [np.concatenate([vocab.text_ids(t or "", ranks_path, special), end]).astype("<u2") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc": batch.column(0), "place": pa.array([_order_key(x) for x in rows], pa.int64()), "n": pa.array([len(x) for x in rows], pa.int64()), "ids": pa.array([x.tobytes() for x in rows], pa.binary())})

    return df.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text")).mapInArrow(tidy(run), "doc long, place long, n long, ids binary")


def frequencies(rows: DataFrame) -> tuple[np.ndarray, int, float]:
    """Documents with each id (65,536 counts at most, whatever the corpus), number
    of documents, and their mean length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << 16, np.int64)
        for batch in batches:
            for x in batch.column(0).to_pylist():
                seen[np.unique(np.frombuffer(x, "<u2"))] += 1
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_pydict({"id": pa.array(at, pa.int64()), "c": pa.array(seen[at], pa.int64())})

    out = np.zeros(1 << 16, np.int64)
    for r in rows.select("ids").mapInArrow(tidy(run), "id long, c long").groupBy("id").agg(F.sum("c").alias("c")).collect():
        out[r.id] = r.c
    total = rows.agg(F.count("*").alias("n"), F.avg("n").alias("mean")).first()
    return out, total.n, total.mean or 1.0


class Index:
    """BM25 postings of one shard, in arrays of 32 bits: its documents' ids stand one
    after the other in ``ids``."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, idf: np.ndarray, mean: float, p: Packing):
        n = len(sizes)
        both = np.repeat(np.arange(n, dtype=np.uint64) << np.uint64(16), sizes)
        both |= ids
        both.sort()
        at = np.flatnonzero(np.append(True, both[1:] != both[:-1])).astype(np.int32)
        tf = np.diff(np.append(at, len(both))).astype(np.float32)
        both = both[at]
        doc, term = (both >> np.uint64(16)).astype(np.int32), (both & np.uint64(0xFFFF)).astype(np.uint16)
        del both, at
        self.weight = idf[term] * tf * np.float32(p.k1 + 1) / (tf + np.float32(p.k1) * (np.float32(1 - p.b) + (p.b * sizes / mean).astype(np.float32)[doc]))
        self.bounds = np.searchsorted(doc, np.arange(n + 1))
        self.terms, self.n, self.top = term, n, p.terms
        order = np.argsort(term, kind="stable").astype(np.int32)
        self.doc, self.by_term = doc[order], self.weight[order]
        self.start = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=1 << 16))])

    def scores(self, seed: int) -> np.ndarray:
        lo, hi = self.bounds[seed], self.bounds[seed + 1]
        own, w = self.terms[lo:hi].astype(np.int64), self.weight[lo:hi]
        if len(own) > self.top:
            own = own[np.argpartition(-w, self.top)[: self.top]]
        a, n = self.start[own], self.start[own + 1] - self.start[own]
        at = np.arange(int(n.sum())) + np.repeat(a - (np.cumsum(n) - n), n)
        return np.bincount(self.doc[at], self.by_term[at], self.n)


def fill(sizes: list[int], index: Index, window: int, used: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Pieces ``(document, start, length, windows since the first, offset)`` that lay
    out all documents, where the first window holds ``used`` tokens already; and
    the tokens of the last window."""
    free = np.ones(len(sizes), bool)
    out: list[tuple[int, int, int, int, int]] = []
    number, following, seed, scores = 0, 0, None, None
    doc = None
    while True:
        if doc is None:
            if seed is not None and used:
                if scores is None:
                    scores = np.where(free, index.scores(seed), -1.0)
                best = int(scores.argmax())
                doc = best if scores[best] > 0 else None
            if doc is None:
                while following < len(sizes) and not free[following]:
                    following += 1
                if following == len(sizes):
                    return out, used
                doc = following
            free[doc] = False
            if scores is not None:
                scores[doc] = -1.0
            if seed is None or not used:
                seed, scores = doc, None
        start, size = 0, sizes[doc]
        while start < size:
            n = min(size - start, window - used)
            out.append((doc, start, n, number, used))
            start, used = start + n, used + n
            if used == window:
                number, used = number + 1, 0
                seed, scores = (doc, None) if start < size else (None, None)
        doc = None


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", packing: Packing | None = None, ranks_path: str | None = None, json_path: str | None = None) -> DataFrame:
    """One row for each piece: the id, ``start``, ``length``, ``ids`` (unsigned
    16-bit little-endian in a binary), ``ids_crc32``, ``doc_tokens``,
    ``sequence_id``, ``offset``."""
    p = packing or Packing()
    ranks_path, json_path = ranks_path or vocab.default_ranks(), json_path or vocab.default_json()
    if not vocab.proven_equal(json_path, ranks_path):
        raise ValueError("the rank file isn't the vocabulary of the tokenizers file")
    if max(vocab.size(json_path), p.end_id + 1) > 1 << 16:
        raise ValueError("ids of this vocabulary need more than 16 bits")
    rows = staged(tokenised(df, id_col, text_col, p, ranks_path, json_path), "packing-ids")
    seen, n_docs, mean = frequencies(rows)
    idf = np.log(1 + (n_docs - seen + 0.5) / (seen + 0.5)).astype(np.float32)
    idf[p.end_id] = 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, used = files.partition() << 32, 0
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
        fields = ["doc", "start", "length", "ids", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

        def shard(names: list[int | None], parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            nonlocal first, used
            sizes = np.array([len(x) for x in parts], np.int64)
            ids, bounds = np.concatenate(parts), np.concatenate([[0], np.cumsum(sizes)])
            parts.clear()
            laid, used = fill(sizes.tolist(), Index(ids, sizes, idf, mean, p), p.window, used)
            last = first + laid[-1][3]
            for at in range(0, len(laid), PIECES):
                columns: list[list] = [[] for _ in kinds]
                for doc, start, length, number, offset in laid[at : at + PIECES]:
                    own = ids[bounds[doc] + start : bounds[doc] + start + length]
                    for c, x in zip(columns, (names[doc], start, length, own.tobytes(), zlib.crc32(own.astype("<u4").tobytes()), int(sizes[doc]), first + number, offset), strict=True):
                        c.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], fields)
            first = last + (used == 0)

        names: list[int | None] = []
        parts: list[np.ndarray] = []
        held = 0
        for batch in small_batches(batches, "ids"):
            for name, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                names.append(name)
                parts.append(np.frombuffer(ids, "<u2"))
                held += len(parts[-1])
                if held >= p.shard_tokens:
                    yield from shard(names, parts)
                    names, parts, held = [], [], 0
                    release()
        if parts:
            yield from shard(names, parts)

    order = [F.col("place"), F.col("doc").asc_nulls_first(), F.xxhash64("ids")]
    laid = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc", "ids").mapInArrow(tidy(run), "doc long, start long, length long, ids binary, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    return laid.withColumnRenamed("doc", id_col)
