"""Hybrid search over dense, sparse and keyword channels, and searches of comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import query_text as qt
from tessera.operators import lexical, ranking, vectors
from tessera.plans.base import table
from tessera.plans.registry import register

_TOKENS = "regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_]+')"


def _bm25_sql(terms: str) -> str:
    """``scored (query_id, doc_id, score)`` for ``qt (query_id, term)``."""
    return f"""tok AS (SELECT doc_id, {_TOKENS} AS t FROM documents), qt AS ({terms}), st AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM tok),
tf AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM tok) WHERE term IN (SELECT term FROM qt) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
w AS (SELECT doc_id, term, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl)) AS s FROM tf JOIN df USING (term) CROSS JOIN st),
scored AS (SELECT query_id, doc_id, round(sum(s), 6) AS score FROM w JOIN qt USING (term) GROUP BY ALL)"""


@register("hybrid_three_channels", f"""WITH {_bm25_sql(f"SELECT DISTINCT doc_id AS query_id, unnest({_TOKENS}[1:8]) AS term FROM documents WHERE doc_id IN (SELECT vec_id FROM embeddings WHERE vec_id % 50 = 0)")},
dense AS (SELECT a.vec_id AS query_id, b.vec_id AS doc_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS score FROM embeddings a JOIN embeddings b ON a.vec_id % 50 = 0),
v AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings), s AS (SELECT * FROM v WHERE x > 0.15),
sparse AS (SELECT q.vec_id AS query_id, s.vec_id AS doc_id, round(sum(q.x * s.x), 6) AS score FROM s q JOIN s USING (i) WHERE q.vec_id % 50 = 0 GROUP BY ALL),
ch AS (SELECT 'dense' AS channel, * FROM dense UNION ALL SELECT 'sparse', * FROM sparse UNION ALL SELECT 'bm25', * FROM scored),
r AS (SELECT *, row_number() OVER (PARTITION BY channel, query_id ORDER BY score DESC, doc_id) AS rank FROM ch),
f AS (SELECT query_id, doc_id, round(sum(1.0::DOUBLE / (100 + rank)), 9) AS score, count(*) AS n_channels FROM r WHERE rank <= CASE channel WHEN 'dense' THEN 50 WHEN 'sparse' THEN 30 ELSE 40 END GROUP BY ALL),
t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM f) SELECT query_id, rank, doc_id, score, n_channels FROM t WHERE rank <= 10""")
def hybrid_three_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense, learned-sparse and keyword channels, each with a limit of its own, fused by
    reciprocal ranks. A query is a document with a vector: its vector, and its first
    eight words."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item"), F.col("embedding").alias("v"))
    asked = e.where("item % 50 = 0").withColumnRenamed("item", "query_id")
    d = table(spark, sf_dir, "documents")
    words = d.join(asked.select(F.col("query_id").alias("doc_id")), "doc_id", "left_semi").select("doc_id", F.array_join(F.slice(lexical.tokens(F.col("text")), 1, 8), " ").alias("q"))
    weights = F.map_from_entries(F.filter(F.transform("v", lambda x, i: F.struct(i.alias("i"), x.cast("double").alias("x"))), lambda p: p["x"] > 0.15))
    sparse = e.select("item", weights.alias("weights"))
    order = [F.desc("score"), F.asc_nulls_last("item")]
    pools = vectors.exact_knn(e, asked, 50).select("query_id", "item", "rank")
    pools = pools.unionByName(ranking.top_k(lexical.sparse_first(sparse, sparse.where("item % 50 = 0").withColumnRenamed("item", "query_id"), 30), ["query_id"], order, 30).select("query_id", "item", "rank"))
    pools = pools.unionByName(ranking.top_k(lexical.bm25_lists(d, lexical.query_terms(words, "doc_id", "q").distinct(), "doc_id", "text", 40), ["query_id"], order, 40).select("query_id", "item", "rank"))
    fused = ranking.fuse_pools(pools, ["query_id"], "item", ranking.CHANNEL_K).withColumnRenamed("n_pools", "n_channels")
    return ranking.top_k(fused, ["query_id"], order, 10).select("query_id", "rank", F.col("item").alias("doc_id"), "score", "n_channels")


#: Comparisons of every trigger, and queries that are none or whose sides don't fit.
_KINDS = (
    "{a} vs {b}", "{a} {b} versus {c}", "{a} compared to {b} {c}", "difference between {a} and {b} {c}", "{a} против {b}", "разница между {a} и {b}", "чем {a} отличается от {b}",
    "отличие {a} от {b}", "compare {a} with {b}", "{a} {b} {c}", "{a} {b} {c} {a} {b} {c} {a} vs {b}", "compared to {a}", "comparing {a} {b} to {c} vs {a}",
)


def _made(kind: str, join: str) -> str:
    """A template as SQL over the columns ``a``, ``b`` and ``c``."""
    parts = [f"'{x}'" for x in kind.replace("{", "\0").replace("}", "\0").split("\0")]
    return join.join(p.strip("'") if k % 2 else p for k, p in enumerate(parts))


def compared_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(query_id, query)`` of the kinds above, made of the words of ``benchmark``."""
    b = table(spark, sf_dir, "benchmark").select("item_id", F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0)).alias("w"))
    b = b.select("item_id", *(F.coalesce(F.get("w", F.lit(k)), F.lit("x")).alias(n) for k, n in enumerate("abc")))
    cases = " ".join(f"WHEN {k} THEN concat({_made(kind, ', ')})" for k, kind in enumerate(_KINDS))
    return b.select(F.col("item_id").alias("query_id"), F.expr(f"CASE item_id % {len(_KINDS)} {cases} END").alias("query"))


_WORDS = lambda s: f"len(list_filter(regexp_split_to_array({s}, '\\s+'), lambda x: x <> ''))"
_SPLITS = [
    r"(?is)^(.*?)\bvs\b(.*)$", r"(?is)^(.*?)\bversus\b(.*)$", r"(?is)^(.*?)\bcompared\s+to\b(.*)$", r"(?i)\bdifference\s+between\s+(.+?)\s+and\s+(.+)", r"(?is)^(.*?)(?:^|\s)против(?:\s|$)(.*)$",
    r"(?i)разница\s+между\s+(.+?)\s+и\s+(.+)", r"(?i)чем\s+(.+?)\s+отличается\s+от\s+(.+)", r"(?i)отличие\s+(.+?)\s+от\s+(.+)", r"(?i)\b(?:compare|comparing)\b\s+(.+?)\s+(?:and|with|to)\s+(.+)",
]
_COMPARED = f"""words AS (SELECT item_id, regexp_extract_all(text, '[A-Za-z]+') AS w FROM benchmark), abc AS (SELECT item_id, coalesce(w[1], 'x') AS a, coalesce(w[2], 'x') AS b, coalesce(w[3], 'x') AS c FROM words),
compared AS (SELECT item_id AS query_id, CASE item_id % {len(_KINDS)} {" ".join(f"WHEN {k} THEN {_made(kind, ' || ')}" for k, kind in enumerate(_KINDS))} END AS query FROM abc),
tried AS ({" UNION ALL ".join(f"SELECT query_id, {k} AS k, trim(regexp_extract(query, '{p}', 1)) AS l, trim(regexp_extract(query, '{p}', 2)) AS r FROM compared" for k, p in enumerate(_SPLITS))}),
fitting AS (SELECT query_id, arg_min(l, k) AS l, arg_min(r, k) AS r FROM tried WHERE {_WORDS("l")} BETWEEN 1 AND 6 AND {_WORDS("r")} BETWEEN 1 AND 6 GROUP BY query_id)"""


@register("comparison_triggers", f"""WITH {_COMPARED} SELECT query_id, query, l AS left_side, r AS right_side,
 regexp_matches(query, '(?i)\\bvs\\b|\\bversus\\b|\\bcompared to\\b|\\bdifference between\\b|\\bcompare\\s+\\w+\\s+(?:and|to)\\b') AS is_comparison FROM compared LEFT JOIN fitting USING (query_id)""")
def comparison_triggers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sides of comparisons of every trigger in two languages; null where a side is
    empty or too long."""
    q = F.col("query")
    sides = qt.comparison_sides(q)
    return compared_queries(spark, sf_dir).select("query_id", "query", sides["left"].alias("left_side"), sides["right"].alias("right_side"), qt.is_comparison(q).alias("is_comparison"))


def _searched(text: Column, number: int) -> Column:
    return F.struct(F.lit(number).alias("sub"), text.alias("text"))


@register("comparison_search", f"""WITH {_COMPARED}, subs AS (SELECT query_id * 10 + 1 AS query_id, l AS text FROM fitting UNION ALL SELECT query_id * 10 + 2, r FROM fitting
  UNION ALL SELECT query_id * 10, query FROM compared WHERE query_id NOT IN (SELECT query_id FROM fitting)),
{_bm25_sql(f"SELECT DISTINCT query_id, unnest({_TOKENS}) AS term FROM subs")}, p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scored),
f AS (SELECT query_id // 10 AS query_id, doc_id, round(sum(CASE WHEN query_id % 10 = 0 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END / (60 + rank)), 9) AS score, count(*) AS n_pools FROM p WHERE rank <= 50 GROUP BY ALL),
t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM f) SELECT query_id, rank, doc_id, score, n_pools FROM t WHERE rank <= 10""")
def comparison_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both sides of a comparison searched by themselves and fused with equal weights;
    a query without two sides is searched as it is."""
    q = compared_queries(spark, sf_dir)
    sides = qt.comparison_sides(F.col("query"))
    subs = q.select("query_id", F.explode(F.when(sides.isNotNull(), F.array(_searched(sides["left"], 1), _searched(sides["right"], 2))).otherwise(F.array(_searched(F.col("query"), 0)))).alias("s"))
    subs = subs.select((F.col("query_id") * 10 + F.col("s.sub")).alias("query_id"), F.col("s.text").alias("q"))
    terms = lexical.query_terms(subs, "query_id", "q").distinct()
    found = lexical.bm25_lists(table(spark, sf_dir, "documents"), terms, "doc_id", "text", 50)
    p = ranking.top_k(found, ["query_id"], [F.desc("score"), F.asc_nulls_last("item")], 50)
    p = p.select(F.floor(F.col("query_id") / 10).alias("query_id"), "item", "rank", F.when(F.col("query_id") % 10 == 0, 1.0).otherwise(0.5).alias("weight"))
    fused = ranking.fuse_pools(p, ["query_id"], "item", ranking.POOL_K, "weight")
    return ranking.top_k(fused, ["query_id"], [F.desc("score"), F.asc_nulls_last("item")], 10).select("query_id", "rank", F.col("item").alias("doc_id"), "score", "n_pools")
