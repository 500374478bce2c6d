"""What chunkers share: packing of lines, overlap with the chunk before."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def packed(lines: list[str], size: int) -> list[tuple[int, int]]:
    """Line ranges of at most ``size`` characters (each line counts one more for its
    end); a longer line is a range of its own."""
    out, lo, held = [], 0, 0
    for k, line in enumerate(lines):
        n = len(line) + 1
        if k > lo and held + n > size:
            out.append((lo, k))
            lo, held = k, 0
        held += n
    if lo < len(lines):
        out.append((lo, len(lines)))
    return out


def overlapped(chunks: DataFrame, n: int) -> DataFrame:
    """Each chunk of a file (``path``, ordered by ``ord``) with the last ``n``
    characters of the one before it, and its first line moved back by their lines."""
    before = F.lag("content").over(Window.partitionBy("path").orderBy("ord"))
    tail = F.right(before, F.lit(n))
    lines = F.length(tail) - F.length(F.replace(tail, F.lit("\n"), F.lit(""))) + 1
    return chunks.withColumns({
        "content": F.when(before.isNull(), F.col("content")).otherwise(F.concat(tail, F.lit("\n"), F.col("content"))),
        "start_line": F.greatest(F.lit(1), F.col("start_line") - F.coalesce(lines, F.lit(0))),
    })
