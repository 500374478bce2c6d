"""Joins that retrieval needs: ordered lookup, overlap, longest prefix, diffs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.ranking import best, top_k


def ordered_lookup(ids: DataFrame, docs: DataFrame, key: str) -> DataFrame:
    """The rows of ``ids`` with what ``docs`` knows; missing ids drop out, and the
    caller's order stays in its own column."""
    return ids.join(docs, key)


def overlapping(locations: DataFrame, chunks: DataFrame, by: Sequence[str], most: int = 5) -> DataFrame:
    """Up to ``most`` chunks of each location (``loc_id, path, loc_start, loc_end``)
    on the same path whose lines overlap, in line order."""
    pairs = locations.join(chunks, "path").where((F.col("start_line") <= F.col("loc_end")) & (F.col("end_line") >= F.col("loc_start")))
    return top_k(pairs, by, [F.col("start_line"), F.col("chunk_id")], most)


def longest_prefix(paths: DataFrame, roots: DataFrame) -> DataFrame:
    """``(path, root)``: the deepest root that covers a path, null if none does.

    Every path is exploded to the folders above it and joined by equality, so no
    path meets every root. (The path ``a//b`` has the folders ``a/`` and ``a``.)"""
    parts = F.split("path", "/", -1)
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    each = paths.select("path", F.explode(above).alias("root")).join(roots.select("root").distinct(), "root")
    found = each.groupBy("path").agg(F.max_by("root", F.length("root")).alias("root"))
    return paths.join(found, "path", "left")


def state_diff(old: DataFrame, new: DataFrame, key: str = "path", value: str = "hash") -> DataFrame:
    """``(key, change)``: what was added, removed or modified."""
    a, b = old.select(F.col(key), F.col(value).alias("__old")), new.select(F.col(key), F.col(value).alias("__new"))
    change = F.when(F.col("__old").isNull(), "added").when(F.col("__new").isNull(), "removed").when(F.col("__old") != F.col("__new"), "modified")
    return a.join(b, key, "full_outer").select(key, change.alias("change")).where("change IS NOT NULL")


def fingerprint(files: DataFrame, path: str = "path", value: str = "hash") -> DataFrame:
    """One row that changes when any file does: a sum over 64-bit hashes and counts,
    combined on the map side, so no task gathers all paths."""
    h = F.xxhash64(path, value)
    return files.agg(F.count("*").alias("n_files"), F.coalesce(F.sum(h.cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).alias("sum"), F.coalesce(F.bit_xor(h), F.lit(0)).alias("xor"))


def upserted(memory: DataFrame, disk: DataFrame, removed: DataFrame, key: str) -> DataFrame:
    """Rows of both, memory first; rows that only the disk has stay unless they were
    removed lately."""
    both = memory.withColumn("__at", F.lit(0)).unionByName(disk.join(removed, key, "left_anti").withColumn("__at", F.lit(1)))
    return best(both, [key], [F.col("__at")]).drop("__at")


def reconciled(local: DataFrame, remote: DataFrame, key: str) -> DataFrame:
    """``(key, action)``: the remote list decides what is kept, added and dropped. An
    empty remote list, or one without a readable name, drops nothing."""
    seen = remote.where(F.col(key).isNotNull()).select(key).distinct().withColumn("__remote", F.lit(True))
    mine = local.select(key).distinct().withColumn("__local", F.lit(True))
    some = seen.agg((F.count("*") > 0).alias("__some"))
    action = F.when(F.col("__remote") & F.col("__local"), "keep").when(F.col("__remote"), "add").when(F.col("__some"), "drop").otherwise("keep")
    return mine.join(seen, key, "full_outer").crossJoin(F.broadcast(some)).select(key, action.alias("action"))


def known(column: Column, vocabulary: DataFrame, df: DataFrame, name: str) -> DataFrame:
    """Rows of ``df`` whose value is in the vocabulary."""
    return df.withColumn(name, column).join(vocabulary, name, "left_semi")
