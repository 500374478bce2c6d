"""Ranked lists: best rows of a key, reciprocal ranks, fusion of pools and channels.

A *pool* is a ranked candidate list of a query. All orders end in a unique column,
so equal scores never make a result depend on the partitioning.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rank constants of the two reciprocal-rank fusions (fixed values).
CHANNEL_K = 100
POOL_K = 60


def ranked(df: DataFrame, by: Sequence[str], order: Sequence[Column], name: str = "rank") -> DataFrame:
    """``df`` with the 1-based position of each row among the rows of its key."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long"))


def top_k(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int, name: str = "rank") -> DataFrame:
    """The first ``k`` rows of each key. The filter on the rank becomes a partial
    limit below the shuffle, so a task sends ``k`` rows of a key at most."""
    return ranked(df, by, order, name).where(F.col(name) <= k)


def best(df: DataFrame, by: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row of each key."""
    return top_k(df, by, order, 1, "__rank").drop("__rank")


def reciprocal_rank(rank: Column, k: int = POOL_K) -> Column:
    return 1.0 / (F.lit(float(k)) + rank)


def fuse_pools(pools: DataFrame, by: Sequence[str], item: str, k: int, weight: str | None = None, digits: int = 9) -> DataFrame:
    """Sum of ``weight / (k + rank)`` over the pools that hold an item."""
    part = reciprocal_rank(F.col("rank"), k)
    if weight is not None:
        part = F.col(weight) * part
    return pools.groupBy(*by, item).agg(F.round(F.sum(part), digits).alias("score"), F.count("*").alias("n_pools"))


def normalised(df: DataFrame, by: Sequence[str], score: str = "score") -> DataFrame:
    """``df`` with ``unit``: the score scaled to 0..1 within its key (1 where all
    scores of the key are equal)."""
    w = Window.partitionBy(*by)
    lo, hi = F.min(score).over(w), F.max(score).over(w)
    return df.withColumn("unit", F.when(hi > lo, (F.col(score) - lo) / (hi - lo)).otherwise(1.0))


def fuse_weighted(channels: DataFrame, by: Sequence[str], item: str, weight: str = "weight", digits: int = 9) -> DataFrame:
    """Weighted sum of channel scores, each scaled within its query and channel."""
    unit = normalised(channels, [*by, "channel"])
    return unit.groupBy(*by, item).agg(F.round(F.sum(F.col(weight) * F.col("unit")), digits).alias("score"))


def canonical(df: DataFrame, by: Sequence[str], symbol: str, path: str, markers: Sequence[str] = ("_std", "node_modules"), tie: str | None = None) -> DataFrame:
    """Drop copies of a symbol under demoted folders.

    Rows with one symbol and one file name form a cluster. If any of its paths has
    no marker folder, only the shortest such path stays; a cluster of demoted paths
    stays whole, as do rows without a symbol. ``tie`` orders equal paths."""
    folders = F.slice(F.split(F.col(path), "/"), 1, F.greatest(F.size(F.split(F.col(path), "/")) - 1, F.lit(0)))
    demoted = F.arrays_overlap(folders, F.array(*map(F.lit, markers)))
    name = F.substring_index(path, "/", -1)
    out = df.withColumn("__demoted", demoted).withColumn("__name", name)
    cluster = Window.partitionBy(*by, symbol, "__name")
    out = out.withColumn("__any", F.min("__demoted").over(cluster))
    out = out.withColumn("__place", F.row_number().over(cluster.orderBy("__demoted", F.length(path), path, *([tie] if tie else []))))
    alone = F.col(symbol).isNull() | (F.col(symbol) == "")
    return out.where(alone | F.col("__any") | (F.col("__place") == 1)).drop("__demoted", "__name", "__any", "__place")


def reserved(df: DataFrame, by: Sequence[str], slots: int, top: int, pool: str = "comparisonBridge") -> DataFrame:
    """``df`` with ``reserved``: the first ``min(slots, top)`` rows of the pool keep
    their place and aren't reranked."""
    slots = max(0, min(10, slots))
    w = Window.partitionBy(*by, "pool").orderBy("rank")
    return df.withColumn("reserved", (F.col("pool") == pool) & (F.row_number().over(w) <= min(slots, top)))


def quota(df: DataFrame, by: Sequence[str], kind: str, k: int) -> DataFrame:
    """``k`` rows of each key, dealt over the kinds in turn, best first."""
    turn = ranked(df, [*by, kind], [F.col("rank")], "turn")
    return top_k(turn, by, [F.col("turn"), F.col("rank")], k, "place")


def guaranteed(df: DataFrame, by: Sequence[str], kind: str, k: int, slots: int = 1) -> DataFrame:
    """``k`` rows of each key of which each kind has at least ``slots``."""
    turn = ranked(df, [*by, kind], [F.col("rank")], "turn")
    return top_k(turn, by, [F.col("turn") > slots, F.col("rank")], k, "place")


def confidence(score: Column, low: float = 0.30, high: float = 0.70) -> Column:
    """``low``, ``medium`` or ``high``; null for a score that isn't finite."""
    finite = score.isNotNull() & ~F.isnan(score) & (F.abs(score) != float("inf"))
    return F.when(finite, F.when(score < low, "low").when(score < high, "medium").otherwise("high"))


def clamped_limit(value: Column, default: int = 10, most: int = 50) -> Column:
    """A wanted number of results: whole, 1 to ``most``; ``default`` if it is no
    number of at least 1."""
    whole = F.floor(value)
    return F.when(value.isNull() | F.isnan(value) | (whole < 1), F.lit(default)).otherwise(F.least(whole, F.lit(most))).cast("long")
