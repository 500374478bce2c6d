"""One engine over everything: create, index, search, expand, clear.

A collection is a folder under the root with a chunk store, the vectors of its chunks
and the hashes of its files. What happens to collections is appended to a catalog.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.chunking.table import CHUNKERS, chunked
from tessera.operators import graph, joins, lexical, ranking, vectors
from tessera.operators.filters import compiled, ignored
from tessera.sources.locks import Lock, catalog_lock, hadoop_path
from tessera.sources.models import Embedder
from tessera.sources.store import MOST_CHUNKS, ChunkStore, latest, status_of, write_log


@dataclass(frozen=True)
class Options:
    """What a request may set, with its defaults."""

    splitter: str = "syntax"
    extensions: tuple[str, ...] = ()
    ignore: tuple[str, ...] = ()
    limit: int = 10
    channel_limit: int = 50
    hybrid: bool = True
    most_chunks: int | None = MOST_CHUNKS  # None: an index holds all chunks


def normalised(splitter: str | None, extensions: list[str] | None, ignore: list[str] | None) -> Options:
    """Options of a request: empty entries are dropped, an unknown splitter is the default."""
    clean = lambda xs: tuple(dict.fromkeys(x.strip() for x in xs or [] if x and x.strip()))
    return Options(splitter if splitter in CHUNKERS else Options.splitter, tuple(x if x.startswith(".") else f".{x}" for x in clean(extensions)), clean(ignore))


class Engine:
    """Collections of chunks under ``root``."""

    def __init__(self, spark: SparkSession, root: str, embedder: Embedder | None = None, options: Options | None = None):
        self.spark, self.root = spark, root.rstrip("/")
        self.embedder, self.options = embedder or Embedder(), options or Options()

    def _folder(self, name: str) -> str:
        if not name or any(c in name for c in "/\\") or name.startswith("."):
            raise ValueError(f"not a collection's name: {name!r}")
        return f"{self.root}/collections/{name}"

    def store(self, name: str) -> ChunkStore:
        return ChunkStore(self.spark, f"{self._folder(name)}/chunks")

    def _note(self, name: str, status: str, files: int = 0, chunks: int = 0) -> None:
        row = [(name, int(time.time() * 1e6), status, files, chunks)]
        with catalog_lock(self.spark, f"{self.root}/catalog.lock"):
            self.spark.createDataFrame(row, "path string, at long, status string, indexed_files long, total_chunks long").coalesce(1).write.mode("append").parquet(f"{self.root}/catalog")

    def catalog(self) -> DataFrame:
        """The last state of each collection that wasn't cleared."""
        p, fs = hadoop_path(self.spark, f"{self.root}/catalog")
        kind = "path string, at long, status string, indexed_files long, total_chunks long"
        if not fs.exists(p):
            return self.spark.createDataFrame([], kind)
        return latest(self.spark.read.schema(kind).parquet(f"{self.root}/catalog")).where("status <> 'cleared'")

    def has(self, name: str) -> bool:
        return self.store(name).exists()

    def names(self) -> list[str]:
        p, fs = hadoop_path(self.spark, f"{self.root}/collections")
        return sorted(f.getPath().getName() for f in fs.listStatus(p)) if fs.exists(p) else []

    def describe(self, name: str) -> dict[str, object]:
        rows = self.store(name).read()
        return {"name": name, "columns": rows.columns, "rows": self.store(name).count(), "dimension": self.embedder.dim, "hybrid": self.options.hybrid}

    def _chosen(self, files: DataFrame) -> DataFrame:
        ends = self.options.extensions
        if ends:
            keep = F.lit(False)
            for e in ends:
                keep = keep | F.endswith("path", F.lit(e))
            files = files.where(keep)
        if self.options.ignore:
            files = files.where(~ignored(F.col("path"), list(self.options.ignore)))
        return files

    def _chunks(self, files: DataFrame, split: str | Callable | None) -> DataFrame:
        return chunked(files, split or self.options.splitter)

    def _embed(self, name: str, chunks: DataFrame, version: str) -> None:
        self.embedder.apply(chunks, "chunk_id", "content").write.mode("overwrite").parquet(f"{self._folder(name)}/vectors/version={version}")

    def index(self, name: str, files: DataFrame, force: bool = False, splitter: str | Callable | None = None) -> str:
        """Index ``(path, language, content)``: ``indexed``, or ``limit_reached`` where the
        product limit on chunks cuts it; ``exists`` if it was indexed before and isn't
        forced. The splitter is this request's alone."""
        with Lock(self.spark, f"{self._folder(name)}.lock"):
            if self.has(name):
                if not force:
                    return "exists"
                self.clear(name, note=False)
            self._note(name, "indexing")
            try:
                return self._index(name, self._chosen(files), splitter)
            except Exception:
                self._note(name, "indexfailed")
                raise

    def _index(self, name: str, files: DataFrame, splitter: str | Callable | None) -> str:
        files.select("path", F.sha2(F.coalesce("content", F.lit("")), 256).alias("hash")).write.mode("overwrite").parquet(f"{self._folder(name)}/hashes/version=0")
        self.store(name).insert(self._chunks(files, splitter))
        rows = self.store(name).read()
        n = rows.count()
        most = n if self.options.most_chunks is None else self.options.most_chunks
        if n > most:
            kept = rows.orderBy("path", "ord").limit(most)
            self.store(name).delete(rows.join(kept.select("chunk_id"), "chunk_id", "left_anti"))
        self._embed(name, self.store(name).read(), "0")
        status = "limit_reached" if n > most else "indexed"
        self._note(name, status, files.count(), min(n, most))
        return status

    def reindex(self, name: str, files: DataFrame, splitter: str | Callable | None = None) -> dict[str, int]:
        """Bring the index to the state of ``files``; how many were added, removed and
        modified. Only changed files are cut and embedded."""
        files = self._chosen(files)
        with Lock(self.spark, f"{self._folder(name)}.lock"):
            p, fs = hadoop_path(self.spark, f"{self._folder(name)}/hashes")
            last = max(int(f.getPath().getName().split("=")[1]) for f in fs.listStatus(p))
            old = self.spark.read.parquet(f"{self._folder(name)}/hashes/version={last}")
            new = files.select("path", F.sha2(F.coalesce("content", F.lit("")), 256).alias("hash"))
            new.write.mode("overwrite").parquet(f"{self._folder(name)}/hashes/version={last + 1}")
            changes = joins.state_diff(old, self.spark.read.parquet(f"{self._folder(name)}/hashes/version={last + 1}"))
            counts = {r.change: r.n for r in changes.groupBy("change").agg(F.count("*").alias("n")).collect()}
            if counts:
                touched = files.join(changes.where("change <> 'removed'").select("path"), "path", "left_semi")
                fresh = self._chunks(touched, splitter)
                self.store(name).reindex(changes, fresh)
                self._embed(name, fresh, str(last + 1))
            self._note(name, "indexed", files.count(), self.store(name).count() or 0)
        return {k: counts.get(k, 0) for k in ("added", "removed", "modified")}

    def _vectors(self, name: str) -> DataFrame:
        """The newest vector of each chunk."""
        v = self.spark.read.parquet(f"{self._folder(name)}/vectors")
        return ranking.best(v, ["chunk_id"], [F.desc("version")]).select("chunk_id", "v")

    def search(self, name: str, queries: DataFrame, limit: int | None = None, filter_text: str = "") -> DataFrame:
        """``(query_id, rank, chunk_id, path, score)`` of ``(query_id, query)``: the filter
        stands before the channels, keyword and dense ranks are fused."""
        k = max(1, min(50, limit or self.options.limit))
        rows = self.store(name).read().where(compiled(filter_text))
        order = [F.desc("score"), F.col("item")]
        own = rows.select("chunk_id", "content")
        found = lexical.bm25_lists(own, lexical.query_terms(queries, "query_id", "query").distinct(), "chunk_id", "content", self.options.channel_limit)
        pools = ranking.top_k(found, ["query_id"], order, self.options.channel_limit).select("query_id", "item", "rank")
        if self.options.hybrid:
            number = rows.select("chunk_id", F.xxhash64("chunk_id").alias("item"))
            v = self._vectors(name).join(number, "chunk_id").select("item", "v")
            near = vectors.exact_knn(v, self.embedder.apply(queries, "query_id", "query", queries=True), self.options.channel_limit)
            pools = pools.unionByName(near.join(number, "item").select("query_id", F.col("chunk_id").alias("item"), "rank"))
        fused = ranking.fuse_pools(pools, ["query_id"], "item", ranking.CHANNEL_K)
        top = ranking.top_k(fused, ["query_id"], order, k).withColumnRenamed("item", "chunk_id")
        return top.join(rows.select("chunk_id", "path"), "chunk_id").select("query_id", "rank", "chunk_id", "path", "score")

    def expand(self, name: str, seeds: DataFrame, limit: int = 10) -> DataFrame:
        """The neighbours in their files of ``(chunk_id)``."""
        edges = graph.both_ways(graph.sequence_edges(self.store(name).read()))
        return graph.neighbours(seeds, edges, limit=limit)

    def record(self, answers: DataFrame) -> None:
        """Append answers (``kind``, ``ts``, ...) to the usage log."""
        write_log(answers, f"{self.root}/usage")

    def status(self, paths: DataFrame) -> DataFrame:
        return status_of(paths, self.catalog())

    def categories(self) -> DataFrame:
        """``(collection, language, n)`` of all collections."""
        parts = [self.store(n).read().groupBy("language").agg(F.count("*").alias("n")).select(F.lit(n).alias("collection"), "language", "n") for n in self.names() if self.has(n)]
        out = self.spark.createDataFrame([], "collection string, language string, n long")
        for p in parts:
            out = out.unionByName(p)
        return out.orderBy("language", "collection")

    def clear(self, name: str, note: bool = True) -> None:
        p, fs = hadoop_path(self.spark, self._folder(name))
        fs.delete(p, True)
        if note:
            self._note(name, "cleared")
