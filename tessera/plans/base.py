"""Inputs that several queries share, as a DataFrame and as SQL.

The corpus is ``documents``: each is a file ``source/lang/doc_id.md`` whose lines
are chunks. Queries come from ``benchmark``; their words are also turned into names,
calls and comparisons, so that every branch of query understanding has rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, path, language, content)`` of each document."""
    d = table(spark, sf_dir, "documents")
    path = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none")), F.concat(F.col("doc_id").cast("string"), F.lit(".md")))
    return d.select("doc_id", path.alias("path"), F.col("lang").alias("language"), F.coalesce("text", F.lit("")).alias("content"))


FILES_SQL = """files AS (SELECT doc_id, coalesce(source, 'none') || '/' || coalesce(lang, 'none') || '/' || doc_id || '.md' AS path,
  lang AS language, coalesce(text, '') AS content FROM documents)"""


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, path, ord, content, chunk_id, content_type)``: lines with a word.
    Lines whose number divides by three are examples, the others prose."""
    lines = files(spark, sf_dir).select("doc_id", "path", F.posexplode(F.split("content", "\n", -1)).alias("ord", "content"))
    lines = lines.where(F.col("content").rlike("[^ \t\r]")).withColumn("ord", F.col("ord").cast("long"))
    return lines.select("doc_id", "path", "ord", "content", F.concat("path", F.lit("_chunk_"), "ord").alias("chunk_id"), F.when(F.col("ord") % 3 == 0, "code_example").otherwise("doc").alias("content_type"))


CHUNKS_SQL = (
    FILES_SQL
    + r""", lines AS (SELECT doc_id, path, unnest(string_split(content, chr(10))) AS content,
  generate_subscripts(string_split(content, chr(10)), 1) - 1 AS ord FROM files),
chunks AS (SELECT doc_id, path, ord, content, path || '_chunk_' || ord AS chunk_id,
  CASE WHEN ord % 3 = 0 THEN 'code_example' ELSE 'doc' END AS content_type FROM lines WHERE regexp_matches(content, '[^ \t\r]'))"""
)


def shaped_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(query_id, query)`` of eight shapes, made of the words of ``benchmark``."""
    b = table(spark, sf_dir, "benchmark").select("item_id", F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0)).alias("w"))
    b = b.select("item_id", *(F.coalesce(F.get("w", F.lit(k)), F.lit("x")).alias(f"w{k + 1}") for k in range(4)))
    up = lambda c: f"concat(upper(substr({c}, 1, 1)), lower(substr({c}, 2)))"
    q = F.expr(f"""CASE item_id % 8 WHEN 0 THEN concat_ws(' ', w1, w2, w3, w4) WHEN 1 THEN concat(lower(w1), {up("w2")})
      WHEN 2 THEN concat({up("w1")}, '.', lower(w2)) WHEN 3 THEN concat(w1, ' vs ', w2) WHEN 4 THEN concat('difference between ', w1, ' and ', w2, ' ', w3)
      WHEN 5 THEN concat(lower(w1), '_', lower(w2)) WHEN 6 THEN concat('init cfg ', w1, ' config') ELSE concat('call ', w1, '(', w2, ') in the ', w3) END""")
    return b.select(F.col("item_id").alias("query_id"), q.alias("query"))


SHAPED_SQL = """words AS (SELECT item_id, regexp_extract_all(text, '[A-Za-z]+') AS w FROM benchmark),
w4 AS (SELECT item_id, coalesce(w[1], 'x') AS w1, coalesce(w[2], 'x') AS w2, coalesce(w[3], 'x') AS w3, coalesce(w[4], 'x') AS w4 FROM words),
shaped AS (SELECT item_id AS query_id, CASE item_id % 8 WHEN 0 THEN concat_ws(' ', w1, w2, w3, w4)
  WHEN 1 THEN lower(w1) || upper(w2[1]) || lower(w2[2:]) WHEN 2 THEN upper(w1[1]) || lower(w1[2:]) || '.' || lower(w2)
  WHEN 3 THEN w1 || ' vs ' || w2 WHEN 4 THEN 'difference between ' || w1 || ' and ' || w2 || ' ' || w3
  WHEN 5 THEN lower(w1) || '_' || lower(w2) WHEN 6 THEN 'init cfg ' || w1 || ' config'
  ELSE 'call ' || w1 || '(' || w2 || ') in the ' || w3 END AS query FROM w4)"""
