"""Connected components as joins over tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import dropped, staged


def components(edges: DataFrame, tag: str) -> DataFrame:
    """``(node, root)`` for every node of ``edges`` (``a``, ``b``); the root is the
    smallest node that can be reached. Labels spread over the edges and then jump
    to the label of their label, so rounds grow with the logarithm of the width of
    a component. Each round is written, so a lost executor costs one round."""
    both = staged(edges.where("a <> b").select("a", "b").union(edges.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{tag}-edges")
    labels = staged(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("root"), F.lit(True).alias("new")), f"{tag}-labels")
    while labels.where("new").limit(1).count():
        near = both.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("m"))
        best = staged(labels.join(near, "node").select("node", F.col("root").alias("old"), F.least("root", "m").alias("to")), f"{tag}-spread")
        jump = best.join(best.select(F.col("node").alias("to"), F.col("to").alias("root")), "to").select("node", "root", (F.col("root") < F.col("old")).alias("new"))
        after = staged(jump, f"{tag}-labels")
        dropped(labels.sparkSession, labels)
        dropped(labels.sparkSession, best)
        labels = after
    return labels.select("node", "root")
