"""Retrieval channels, fusion, deduplication and reranking."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import lexical, ranking, vectors
from tessera.plans.base import CHUNKS_SQL, chunks, table
from tessera.plans.registry import register
from tessera.sources import models

_BM25 = """tok AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_]+') AS t FROM documents),
qt AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_]+')) AS term FROM benchmark),
st AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM tok),
tf AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM tok) WHERE term IN (SELECT term FROM qt) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
w AS (SELECT doc_id, term, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl)) AS s FROM tf JOIN df USING (term) CROSS JOIN st),
scored AS (SELECT query_id, doc_id, round(sum(s), 6) AS score, count(*) AS overlap FROM w JOIN qt USING (term) GROUP BY ALL)"""


def _best() -> list[Column]:
    """Best first, then by id; rows without an id come last, as in SQL."""
    return [F.desc("score"), F.asc_nulls_last("item")]


def _lists(spark: SparkSession, sf_dir: str, k: int, names: Sequence[str]) -> DataFrame:
    """The first ``k`` documents of each query by each list: ``(query_id, item, channel,
    score, rank)``."""
    terms = lexical.query_terms(table(spark, sf_dir, "benchmark"), "item_id", "text").distinct()
    found = lexical.bm25_lists(table(spark, sf_dir, "documents"), terms, "doc_id", "text", k, names)
    return ranking.top_k(found, ["query_id", "channel"], _best(), k)


def _channels(spark: SparkSession, sf_dir: str, k: int = 100) -> DataFrame:
    """The keyword and the overlap channel, ``k`` rows of a query each."""
    return _lists(spark, sf_dir, k, ("bm25", "overlap")).select("query_id", "item", "rank", "score", "channel")


_CHANNELS = f"""WITH {_BM25}, bm AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scored),
ov AS (SELECT query_id, doc_id, overlap::DOUBLE AS score, row_number() OVER (PARTITION BY query_id ORDER BY overlap DESC, doc_id) AS rank FROM scored),
ch AS (SELECT *, 'bm25' AS channel FROM bm WHERE rank <= 100 UNION ALL SELECT *, 'overlap' AS channel FROM ov WHERE rank <= 100)"""


@register("hybrid_search_rrf", f"""{_CHANNELS}, f AS (SELECT query_id, doc_id, round(sum(1.0::DOUBLE / (100 + rank)), 9) AS score FROM ch GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM f) SELECT query_id, rank, doc_id, score FROM r WHERE rank <= 10""")
def hybrid_search_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two channels fused by reciprocal ranks; ten documents for each query."""
    fused = ranking.fuse_pools(_channels(spark, sf_dir), ["query_id"], "item", ranking.CHANNEL_K)
    return ranking.top_k(fused, ["query_id"], _best(), 10).select("query_id", "rank", F.col("item").alias("doc_id"), "score")


@register("bm25_search", f"""WITH {_BM25}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scored) SELECT query_id, rank, doc_id, score FROM r WHERE rank <= 10""")
def bm25_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten documents of each query by BM25."""
    return _lists(spark, sf_dir, 10, ("bm25",)).select("query_id", "rank", F.col("item").alias("doc_id"), "score")


@register("weighted_channel_fusion", f"""{_CHANNELS}, u AS (SELECT *, CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 1.0 END AS unit FROM ch WINDOW w AS (PARTITION BY query_id, channel)),
f AS (SELECT query_id, doc_id, round(sum(CASE channel WHEN 'bm25' THEN 0.4::DOUBLE ELSE 0.6::DOUBLE END * unit), 9) AS score FROM u GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM f)
SELECT query_id, rank, doc_id, score FROM r WHERE rank <= 10""")
def weighted_channel_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The channels fused by weighted scores, scaled to 0..1 in each channel."""
    rows = _channels(spark, sf_dir).withColumn("weight", F.when(F.col("channel") == "bm25", 0.4).otherwise(0.6))
    fused = ranking.fuse_weighted(rows, ["query_id"], "item")
    return ranking.top_k(fused, ["query_id"], _best(), 10).select("query_id", "rank", F.col("item").alias("doc_id"), "score")


@register("outer_weighted_rrf", f"""{_CHANNELS}, f AS (SELECT query_id, doc_id, round(sum(CASE channel WHEN 'bm25' THEN 1.5::DOUBLE ELSE 0.6::DOUBLE END / (60 + rank)), 9) AS score, count(*) AS n_pools FROM ch GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM f) SELECT query_id, rank, doc_id, score, n_pools FROM r WHERE rank <= 10""")
def outer_weighted_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pools with weights of their own, fused by weighted reciprocal ranks."""
    spark_weights = spark.createDataFrame([("bm25", 1.5), ("overlap", 0.6)], "channel string, weight double")
    rows = _channels(spark, sf_dir).join(F.broadcast(spark_weights), "channel")
    fused = ranking.fuse_pools(rows, ["query_id"], "item", ranking.POOL_K, "weight")
    return ranking.top_k(fused, ["query_id"], _best(), 10).select("query_id", "rank", F.col("item").alias("doc_id"), "score", "n_pools")


@register("comparison_fanout", """WITH b AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9_]+') AS t FROM benchmark), q AS (SELECT item_id AS query_id, 1 AS sub, unnest(t[1:3]) AS term FROM b UNION SELECT item_id, 2, unnest(t[4:6]) FROM b),
tok AS (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_]+')) AS term FROM documents), tf AS (SELECT doc_id, term, count(*) AS tf FROM tok WHERE term IN (SELECT term FROM q) GROUP BY ALL),
s AS (SELECT query_id, sub, doc_id, count(*) AS hit, sum(tf) AS n FROM q JOIN tf USING (term) GROUP BY ALL), p AS (SELECT *, row_number() OVER (PARTITION BY query_id, sub ORDER BY hit DESC, n DESC, doc_id) AS rank FROM s),
f AS (SELECT query_id, doc_id, round(sum(0.5::DOUBLE / (60 + rank)), 9) AS score, count(*) AS n_pools FROM p WHERE rank <= 50 GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM f)
SELECT query_id, rank, doc_id, score, n_pools FROM r WHERE rank <= 10""")
def comparison_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both subjects of a comparison searched by themselves, then fused with equal
    weights."""
    b = table(spark, sf_dir, "benchmark").select("item_id", lexical.tokens(F.col("text")).alias("t"))
    part = lambda k, lo: b.select(F.col("item_id").alias("query_id"), F.lit(k).alias("sub"), F.explode(F.slice("t", lo, 3)).alias("term"))
    q = part(1, 1).unionByName(part(2, 4)).distinct()
    found = lexical.bm25_lists(table(spark, sf_dir, "documents"), q, "doc_id", "text", 50, ("hits",), ("query_id", "sub"))
    p = ranking.top_k(found, ["query_id", "sub"], _best(), 50).withColumn("w", F.lit(0.5))
    fused = ranking.fuse_pools(p, ["query_id"], "item", ranking.POOL_K, "w")
    return ranking.top_k(fused, ["query_id"], _best(), 10).select("query_id", "rank", F.col("item").alias("doc_id"), "score", "n_pools")


@register("dense_knn", """WITH p AS (SELECT a.vec_id AS query_id, b.vec_id AS item, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS score FROM embeddings a JOIN embeddings b ON a.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item) AS rank FROM p) SELECT query_id, rank, item AS vec_id, score FROM r WHERE rank <= 10""")
def dense_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten nearest vectors by cosine of every vector whose id is divisible by 50."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item"), F.col("embedding").alias("v"))
    q = e.where("item % 50 = 0").withColumnRenamed("item", "query_id")
    return vectors.exact_knn(e, q, 10).withColumnRenamed("item", "vec_id")


@register("ivf_knn")
def ivf_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same search by an inverted file; its recall is held against the exact one
    in the tests."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item"), F.col("embedding").alias("v"))
    q = e.where("item % 50 = 0").withColumnRenamed("item", "query_id")
    return vectors.InvertedFile(e).search(q, 10, probes=24).withColumnRenamed("item", "vec_id")


@register("filtered_knn", """WITH p AS (SELECT a.vec_id AS query_id, b.vec_id AS item, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS score FROM embeddings a JOIN embeddings b ON a.vec_id % 50 = 0 AND b.label IN (1, 2, 3)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item) AS rank FROM p WHERE score >= 0.1) SELECT query_id, rank, item AS vec_id, score FROM r WHERE rank <= 10""")
def filtered_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest vectors within some labels and above a similarity; the filter stands
    before the search."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item"), F.col("embedding").alias("v"), "label")
    q = e.where("item % 50 = 0").select(F.col("item").alias("query_id"), "v")
    return vectors.exact_knn(e.where(F.col("label").isin(1, 2, 3)).drop("label"), q, 10).where("score >= 0.1").withColumnRenamed("item", "vec_id")


@register("learned_sparse", """WITH v AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings), s AS (SELECT * FROM v WHERE x > 0.15),
p AS (SELECT q.vec_id AS query_id, s.vec_id, round(sum(q.x * s.x), 6) AS score FROM s q JOIN s USING (i) WHERE q.vec_id % 50 = 0 GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""")
def learned_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inner products of sparse vectors (the larger components of the dense ones)."""
    weights = F.map_from_entries(F.filter(F.transform("embedding", lambda x, i: F.struct(i.alias("i"), x.cast("double").alias("x"))), lambda e: e["x"] > 0.15))
    s = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item"), weights.alias("weights"))
    found = lexical.sparse_first(s, s.where("item % 50 = 0").withColumnRenamed("item", "query_id"), 10)
    return ranking.top_k(found, ["query_id"], _best(), 10).select("query_id", "rank", F.col("item").alias("vec_id"), "score")


@register("rerank", f"""{_CHANNELS}, f AS (SELECT query_id, doc_id, round(sum(1.0::DOUBLE / (100 + rank)), 9) AS score FROM ch GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM f),
top AS (SELECT query_id, doc_id, rank FROM r WHERE rank <= 50), x AS (SELECT query_id, doc_id, rank, list_distinct(regexp_extract_all(lower(b.text), '[a-z0-9_]+')) AS q, list_distinct(t) AS d FROM top JOIN tok USING (doc_id) JOIN benchmark b ON b.item_id = query_id),
y AS (SELECT query_id, doc_id, rank, round(len(list_intersect(q, d)) / len(q), 6) AS relevance FROM x), z AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN rank <= 2 THEN 0 ELSE 1 END, CASE WHEN rank <= 2 THEN rank ELSE 0 END, relevance DESC, rank) AS place FROM y)
SELECT query_id, place, doc_id, relevance FROM z WHERE place <= 10""")
def rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fused fifty of each query reranked by the model (the share of its words that
    a document holds); the first two keep their places (reserved slots)."""
    fused = ranking.fuse_pools(_channels(spark, sf_dir), ["query_id"], "item", ranking.CHANNEL_K)
    top = ranking.top_k(fused, ["query_id"], _best(), 50).withColumn("pool", F.lit("comparisonBridge"))
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item"), F.col("text").alias("d"))
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("q"))
    rows = ranking.reserved(top, ["query_id"], 2, 10).join(d, "item").join(q, "query_id")
    rows = models.Reranker().apply(rows, ["query_id", "item", "rank", "reserved"], "q", "d").withColumn("relevance", F.round("relevance", 6))
    order = [F.col("reserved").desc(), F.when(F.col("reserved"), F.col("rank")).otherwise(0), F.desc("relevance"), F.col("rank")]
    return ranking.top_k(rows, ["query_id"], order, 10, "place").select("query_id", "place", F.col("item").alias("doc_id"), "relevance")


@register("canonical_dedup", """WITH p AS (SELECT p_partkey, p_brand AS symbol, p_type AS q, CASE p_size % 4 WHEN 0 THEN 'std/_std/' WHEN 1 THEN 'lib/node_modules/a/' WHEN 2 THEN 'src/' ELSE 'src/deep/' END || CASE WHEN p_partkey % 3 = 0 THEN 'A.hx' ELSE 'B.hx' END AS path FROM part),
k AS (SELECT *, list_has_any(string_split(path, '/')[:-2], ['_std', 'node_modules']) AS demoted, string_split(path, '/')[-1] AS base FROM p),
r AS (SELECT *, min(demoted::INT) OVER (PARTITION BY q, symbol, base) AS every, row_number() OVER (PARTITION BY q, symbol, base ORDER BY demoted, length(path), path, p_partkey) AS place FROM k) SELECT p_partkey, symbol, path FROM r WHERE every = 1 OR place = 1""")
def canonical_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of a symbol under demoted folders leave the results."""
    folder = F.expr("CASE p_size % 4 WHEN 0 THEN 'std/_std/' WHEN 1 THEN 'lib/node_modules/a/' WHEN 2 THEN 'src/' ELSE 'src/deep/' END")
    path = F.concat(folder, F.when(F.col("p_partkey") % 3 == 0, "A.hx").otherwise("B.hx"))
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("symbol"), F.col("p_type").alias("q"), path.alias("path"))
    return ranking.canonical(p, ["q"], "symbol", "path", tie="p_partkey").select("p_partkey", "symbol", "path")


@register("result_shape", """SELECT doc_id, CASE WHEN s < 0.3 THEN 'low' WHEN s < 0.7 THEN 'medium' ELSE 'high' END AS band, CASE WHEN w < 1 THEN 10 ELSE least(floor(w), 50) END::BIGINT AS result_limit FROM (SELECT doc_id, (n_chars % 100) / 100.0::DOUBLE AS s, (n_chars % 120 - 10) / 1.5 AS w FROM documents)""")
def result_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confidence bands of scores and clamped limits."""
    d = table(spark, sf_dir, "documents").select("doc_id", ((F.col("n_chars") % 100) / 100.0).alias("s"), ((F.col("n_chars") % 120 - 10) / 1.5).alias("w"))
    return d.select("doc_id", ranking.confidence(F.col("s")).alias("band"), ranking.clamped_limit(F.col("w")).alias("result_limit"))


_KINDS = f"""WITH {CHUNKS_SQL}, c AS (SELECT doc_id, chunk_id, content_type, row_number() OVER (PARTITION BY doc_id ORDER BY length(content) DESC, ord) AS rank FROM chunks)"""


def _ranked_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.ranked(chunks(spark, sf_dir), ["doc_id"], [F.desc(F.length("content")), F.col("ord")]).select("doc_id", "chunk_id", "content_type", "rank")


@register("concept_quota", f"""{_KINDS}, t AS (SELECT *, row_number() OVER (PARTITION BY doc_id, content_type ORDER BY rank) AS turn FROM c), p AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY turn, rank) AS place FROM t) SELECT doc_id, place, chunk_id FROM p WHERE place <= 5""")
def concept_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five chunks of each document, dealt over the content types in turn."""
    return ranking.quota(_ranked_chunks(spark, sf_dir), ["doc_id"], "content_type", 5).select("doc_id", "place", "chunk_id")


@register("guaranteed_slots", f"""{_KINDS}, t AS (SELECT *, row_number() OVER (PARTITION BY doc_id, content_type ORDER BY rank) AS turn FROM c), p AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY turn > 1, rank) AS place FROM t) SELECT doc_id, place, chunk_id FROM p WHERE place <= 5""")
def guaranteed_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five chunks of each document with at least one of each content type."""
    return ranking.guaranteed(_ranked_chunks(spark, sf_dir), ["doc_id"], "content_type", 5).select("doc_id", "place", "chunk_id")


@register("candidate_symbols", r"""WITH n AS (SELECT source, lang, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z]+')) AS name FROM documents), f AS (SELECT source, name, count(*) AS freq FROM n WHERE length(name) >= 6 GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY freq DESC, length(name) DESC, name) AS rank FROM f) SELECT source, rank, name, freq FROM r WHERE rank <= 10""")
def candidate_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten most frequent names of each result set (here a source): by frequency,
    dotted names first, longer first, then alphabetically."""
    n = table(spark, sf_dir, "documents").select("source", F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[A-Za-z]+"), F.lit(0))).alias("name"))
    f = n.where(F.length("name") >= 6).groupBy("source", "name").agg(F.count("*").alias("freq"))
    order = [F.desc("freq"), F.contains("name", F.lit(".")).desc(), F.desc(F.length("name")), F.col("name")]
    return ranking.top_k(f, ["source"], order, 10).select("source", "rank", "name", "freq")
