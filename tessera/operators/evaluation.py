"""Measures of retrieval runs: precision and recall, tokens, calls, logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import relative_to, token_estimate


def scores(hits: Column, oracles: Column) -> tuple[Column, Column, Column]:
    """Precision, recall and F1 of two sets of paths (a leading slash doesn't
    count); 0 where nothing can be divided by."""
    plain = lambda a: F.array_distinct(F.transform(a, lambda p: F.regexp_replace(p, "^/", "")))
    h, o = plain(hits), plain(oracles)
    both = F.size(F.array_intersect(h, o)).cast("double")
    p = F.when(F.size(h) > 0, both / F.size(h)).otherwise(0.0)
    r = F.when(F.size(o) > 0, both / F.size(o)).otherwise(0.0)
    return p, r, F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)


def relative_change(before: Column, after: Column) -> Column:
    """Percent; 0 from nothing."""
    return F.when(before == 0, 0.0).otherwise(100.0 * (after - before) / before)


def token_totals(turns: DataFrame) -> DataFrame:
    """Tokens in and out of each conversation, the largest turn, the last message.
    ``turns`` is ``(conv_id, turn, role, text)``."""
    n = token_estimate(F.col("text"))
    out = F.col("role") == "assistant"
    return turns.groupBy("conv_id").agg(
        F.sum(F.when(out, 0).otherwise(n)).alias("input_tokens"), F.sum(F.when(out, n).otherwise(0)).alias("output_tokens"), F.sum(n).alias("total_tokens"), F.max(n).alias("max_turn"), F.max_by(F.md5("text"), "turn").alias("final_md5"),
    )


def histogram(calls: DataFrame, by: str, kind: str) -> DataFrame:
    """``name=count`` of each kind in order of the names, and their sum."""
    n = calls.groupBy(by, kind).agg(F.count("*").alias("n"))
    rows = n.groupBy(by).agg(F.sort_array(F.collect_list(F.struct(F.col(kind).alias("k"), "n"))).alias("h"), F.sum("n").alias("total"))
    return rows.select(by, F.array_join(F.transform("h", lambda x: F.concat_ws("=", x["k"], x["n"].cast("string"))), ",").alias("histogram"), "total")


def hit_files(log: Column, root: str) -> Column:
    """Files that a log reports as changed: first its success lines, then the
    arguments of edit calls; relative to ``root``, each once."""
    done = F.regexp_extract_all(log, F.lit(r"(?m)^Successfully modified file: (.+?)\s*$"), F.lit(1))
    calls = F.regexp_extract_all(log, F.lit(r"""file_path=['"]([^'"]+)['"]"""), F.lit(1))
    return F.array_distinct(F.transform(F.concat(done, calls), lambda p: relative_to(p, F.lit(root))))


_TEXT = r"'((?:[^'\\]|\\.)*)'"


def edit_triples(log: Column) -> Column:
    """``array<struct<file_path,old_string,new_string>>`` of the edit calls of a log, whose
    arguments may span lines; a call without both strings is none."""
    call = rf"(?s)Arguments:[^\n]*?'file_path': {_TEXT}[^}}]*?'old_string': {_TEXT}[^}}]*?'new_string': {_TEXT}"
    part = lambda k: F.transform(F.regexp_extract_all(log, F.lit(call), F.lit(k)), lambda s: F.replace(F.replace(F.replace(s, F.lit("\\n"), F.lit("\n")), F.lit("\\'"), F.lit("'")), F.lit("\\\\"), F.lit("\\")))
    rows = F.arrays_zip(part(1).alias("file_path"), part(2).alias("old_string"), part(3).alias("new_string"))
    return F.transform(rows, lambda r: F.struct(r["file_path"].alias("file_path"), r["old_string"].alias("old_string"), r["new_string"].alias("new_string")))


def unified_diffs(edits: DataFrame, key: str, context: int = 3) -> DataFrame:
    """``(key, diff)`` of rows ``(key, file_path, old_string, new_string)``."""
    import difflib

    import pyarrow as pa

    def run(batches):
        for batch in batches:
            out = []
            for path, old, new in zip(*(batch.column(c).to_pylist() for c in ("file_path", "old_string", "new_string")), strict=True):
                out.append("\n".join(difflib.unified_diff((old or "").splitlines(), (new or "").splitlines(), f"a/{path}", f"b/{path}", n=context, lineterm="")))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], [key, "diff"])

    return edits.select(key, "file_path", "old_string", "new_string").mapInArrow(run, f"{key} {dict(edits.dtypes)[key]}, diff string")
