"""A chunk table on disk in commits, its catalog, and the usage log.

A write adds a folder with its new rows and the ids that it takes away, and then one
commit file whose name says all, created under a lock. Readers see the commits that
are there, a job that dies before its commit leaves nothing, and a write costs what
it changes. ``compact`` folds the commits into one and removes what none needs.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import day_bucket, domain_of
from tessera.operators.filters import compiled
from tessera.operators.joins import longest_prefix
from tessera.operators.ranking import best
from tessera.sources.locks import Lock, hadoop_path

#: Chunks of one index (fixed value).
MOST_CHUNKS = 450_000


class ChunkStore:
    """Chunks under a root folder, in one part for each domain."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _files(self, path: str):
        return hadoop_path(self.spark, path)

    def _commits(self) -> list[tuple[int, str, bool]]:
        """Number, version and whether it stands for all before it, from the last that
        does."""
        p, fs = self._files(f"{self.root}/commits")
        names = sorted(f.getPath().getName() for f in fs.listStatus(p)) if fs.exists(p) else []
        found = [(int(n), version, kind == "base") for n, version, kind in (name.split("-") for name in names if name.count("-") == 2)]
        at = max((k for k, c in enumerate(found) if c[2]), default=0)
        return found[at:]

    def exists(self) -> bool:
        return bool(self._commits())

    def _commit(self, make, kind: str = "delta") -> None:
        """``make(n)`` gives the rows and the ids that go (either may be None)."""
        with Lock(self.spark, f"{self.root}/lock"):
            n, version = max((c[0] for c in self._commits()), default=0) + 1, uuid.uuid4().hex
            rows, gone = make()
            if rows is not None:
                rows.withColumn("domain", domain_of(F.col("content_type"))).withColumn("__n", F.lit(n)).write.partitionBy("domain").parquet(f"{self.root}/rows/commit_of={version}")
            if gone is not None:
                gone.select("chunk_id", F.lit(n).alias("__gone")).write.parquet(f"{self.root}/gone/commit_of={version}")
            p, fs = self._files(f"{self.root}/commits/{n:08d}-{version}-{kind}")
            fs.create(p, False).close()

    def _parts(self, name: str) -> list[str]:
        found = [f"{self.root}/{name}/commit_of={version}" for _, version, _ in self._commits()]
        return [x for x in found for p, fs in [self._files(x)] if fs.exists(p)]

    def read(self) -> DataFrame:
        parts = self._parts("rows")
        if not parts:
            raise FileNotFoundError(f"{self.root} holds no rows")
        rows = self.spark.read.option("mergeSchema", True).option("basePath", f"{self.root}/rows").parquet(*parts)
        gone = self._parts("gone")
        if gone:
            last = self.spark.read.option("basePath", f"{self.root}/gone").parquet(*gone).groupBy("chunk_id").agg(F.max("__gone").alias("__gone"))
            rows = rows.join(last, "chunk_id", "left").where("__gone IS NULL OR __gone <= __n").drop("__gone")
        return rows.drop("__n", "commit_of")

    def insert(self, chunks: DataFrame) -> None:
        """Add chunks; rows of a chunk id that is there already are replaced."""
        self._commit(lambda: (chunks, chunks.select("chunk_id") if self.exists() else None))

    def delete(self, ids: DataFrame) -> None:
        self._commit(lambda: (None, ids.select("chunk_id").distinct()))

    def reindex(self, changes: DataFrame, chunks: DataFrame) -> None:
        """Chunks of removed and modified paths go, those of added and modified ones
        come from ``chunks``; one commit of what changed."""
        gone = changes.where("change <> 'added'").select("path")
        fresh = chunks.join(changes.where("change <> 'removed'").select("path"), "path", "left_semi")
        self._commit(lambda: (fresh, self.read().join(gone, "path", "left_semi").select("chunk_id")))

    def compact(self) -> None:
        """One commit with all rows; the folders of older ones go, so no reader may be
        in the middle of them."""
        old = [version for _, version, _ in self._commits()]
        self._commit(lambda: (self.read().drop("domain"), None), "base")
        for version in old:
            for name in ("rows", "gone"):
                p, fs = self._files(f"{self.root}/{name}/commit_of={version}")
                fs.delete(p, True)

    def query(self, filter_text: str = "", columns: Sequence[str] | None = None, limit: int | None = None) -> DataFrame:
        """A filtered scan. Without a filter the limit is 16384, as a blank query of
        the whole table is never meant."""
        out = self.read().where(compiled(filter_text))
        if limit is None and not filter_text.strip():
            limit = 16384
        out = out.select(*columns) if columns else out
        return out if limit is None else out.orderBy("chunk_id" if "chunk_id" in out.columns else out.columns[0]).limit(limit)

    def count(self) -> int | None:
        """Rows, or None if the storage doesn't tell (which doesn't mean that it is empty)."""
        try:
            return self.read().count()
        except (AnalysisException, Py4JJavaError, OSError):
            return None

    def drop(self) -> None:
        p, fs = self._files(self.root)
        fs.delete(p, True)


def capped(chunks: DataFrame, most: int = MOST_CHUNKS) -> tuple[DataFrame, DataFrame]:
    """The first chunks by path and order, and the status: a product limit."""
    status = chunks.agg(F.count("*").alias("n")).select("n", F.when(F.col("n") > most, "limit_reached").otherwise("completed").alias("status"))
    return chunks.orderBy("path", "ord").limit(most), status


def latest(events: DataFrame) -> DataFrame:
    """The last state of each root. ``events`` is ``(path, at, status, ...)``."""
    return best(events, ["path"], [F.desc("at"), F.desc("status")])


def recovered(catalog: DataFrame, exists: DataFrame) -> DataFrame:
    """The catalog after a restart: what was being indexed has failed, roots that are
    gone are dropped."""
    status = F.when(F.col("status") == "indexing", "indexfailed").otherwise(F.col("status"))
    return catalog.join(exists.select("path"), "path", "left_semi").withColumn("status", status)


def healed(catalog: DataFrame, counts: DataFrame) -> DataFrame:
    """Completed entries that claim no files and no chunks: healed if the table has
    rows, dropped if it is empty, left alone if the count is unknown (negative or
    missing)."""
    hollow = (F.col("status") == "indexed") & (F.col("indexed_files") == 0) & (F.col("total_chunks") == 0)
    n = F.coalesce("row_count", F.lit(-1))
    action = F.when(~hollow, "keep").when(n > 0, "heal").when(n == 0, "drop").otherwise("keep")
    rows = catalog.join(counts, "path", "left").withColumn("action", action)
    return rows.where("action <> 'drop'").withColumn("total_chunks", F.when(F.col("action") == "heal", n).otherwise(F.col("total_chunks"))).drop("row_count", "action")


def status_of(paths: DataFrame, catalog: DataFrame) -> DataFrame:
    """``(path, root, status)`` by the deepest root above each path."""
    found = longest_prefix(paths, catalog.select(F.col("path").alias("root")))
    known = catalog.select(F.col("path").alias("root"), "status")
    return found.join(known, "root", "left").select("path", "root", F.coalesce("status", F.lit("not_found")).alias("status"))


def write_log(records: DataFrame, folder: str, enabled: str | None = None) -> None:
    """Append records (``kind``, ``ts`` as text, ...) as JSON lines by kind and day;
    ``0``, ``false`` and ``off`` turn it off."""
    if (enabled or "").strip().lower() in ("0", "false", "off"):
        return
    records.withColumn("day", day_bucket(F.col("ts"))).write.partitionBy("kind", "day").mode("append").json(folder)
