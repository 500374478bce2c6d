"""Models behind an interface: embedders, rerankers. The defaults need no network.

A model is a function over Arrow batches; services are plugged in by subclassing.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.operators.blocks import small_transfers

# Dimensions and input limits (in tokens) of known embedding models;
# None means that the dimension is asked for.
MODEL_LIMITS = {
    "text-embedding-3-small": (1536, 8192),
    "text-embedding-3-large": (3072, 8192),
    "text-embedding-ada-002": (1536, 8192),
    "gemini-embedding-001": (3072, 2048),
    "voyage": (None, 32000),
    "ollama": (None, 2048),
    "infinity": (1024, 8192),
}
_TOKEN = re.compile("[a-z0-9_]+")


class Embedder:
    """Feature hashing with signs, scaled to unit length. Queries and passages have
    methods of their own, so that asymmetric models can tell them apart."""

    def __init__(self, dim: int = 64, max_tokens: int = 8192):
        self.dim, self.max_tokens = dim, max_tokens

    def _vector(self, text: str) -> np.ndarray:
        out = np.zeros(self.dim)
        for t in _TOKEN.findall((text or " ")[: 4 * self.max_tokens].lower()):
            h = int.from_bytes(hashlib.blake2b(t.encode(), digest_size=8).digest(), "little")
            out[h % self.dim] += 1.0 if h >> 63 else -1.0
        norm = np.sqrt((out * out).sum())
        return out / norm if norm else out

    def encode_passages(self, texts: list[str]) -> np.ndarray:
        return np.stack([self._vector(t) for t in texts]) if texts else np.zeros((0, self.dim))

    def encode_queries(self, texts: list[str]) -> np.ndarray:
        return self.encode_passages(texts)

    def apply(self, df: DataFrame, key: str, text: str, queries: bool = False) -> DataFrame:
        """``(key, v)``; it is an error if the model gives another number of rows."""
        encode, dim = self.encode_queries if queries else self.encode_passages, self.dim
        small_transfers(df.sparkSession)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = encode(batch.column(1).to_pylist())
                if x.shape != (batch.num_rows, dim):
                    raise ValueError(f"{x.shape} vectors for {batch.num_rows} texts")
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(x), pa.list_(pa.float64()))], [key, "v"])

        return df.select(key, text).mapInArrow(run, f"{key} {dict(df.dtypes)[key]}, v array<double>")


class Reranker:
    """Share of the query's words that the text holds."""

    def scores(self, queries: list[str], texts: list[str]) -> np.ndarray:
        words = [(set(_TOKEN.findall((q or "").lower())), set(_TOKEN.findall((t or "").lower()))) for q, t in zip(queries, texts, strict=True)]
        return np.array([len(q & t) / len(q) if q else 0.0 for q, t in words])

    def apply(self, df: DataFrame, keys: list[str], query: str, text: str) -> DataFrame:
        """``(keys, relevance)`` of each pair."""
        score = self.scores

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                s = score(batch.column(len(keys)).to_pylist(), batch.column(len(keys) + 1).to_pylist())
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(keys))), pa.array(s, pa.float64())], [*keys, "relevance"])

        kinds = dict(df.dtypes)
        return df.select(*keys, query, text).mapInArrow(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", relevance double")


class Registry:
    """An embedder for each domain; domains without one of their own share one."""

    def __init__(self, shared: Embedder, **own: Embedder):
        self.shared, self.own = shared, own

    def of(self, domain: str) -> Embedder:
        return self.own.get(domain, self.shared)
