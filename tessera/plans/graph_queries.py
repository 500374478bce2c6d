"""Graphs over the corpus and over the trade tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators import graph, ranking
from tessera.plans.base import CHUNKS_SQL, chunks, table
from tessera.plans.registry import register

# Sections of three levels: the heading path of a line follows its number.
_SECTIONS = f"""{CHUNKS_SQL}, sections AS (SELECT path, chunk_id, content_type, content, ord + 1 AS start_line, ord + 1 AS end_line,
  CASE WHEN ord % 5 = 0 THEN 'A' WHEN ord % 5 < 3 THEN 'A/B' || ord % 5 ELSE 'A/B1/C' || ord % 5 END AS heading, CASE WHEN ord % 5 = 0 THEN '' WHEN ord % 5 < 3 THEN 'A' ELSE 'A/B1' END AS above FROM chunks)"""
_SEQ = "SELECT chunk_id AS src, lead(chunk_id) OVER (PARTITION BY path ORDER BY start_line, chunk_id) AS dst, 'sequence' AS type, 1.0::DOUBLE AS weight FROM sections"
_HEAD = "SELECT a.chunk_id AS src, b.chunk_id AS dst, 'heading' AS type, 1.0::DOUBLE AS weight FROM sections a JOIN sections b ON a.path = b.path AND a.heading = b.above"
_EX = "SELECT a.chunk_id AS src, b.chunk_id AS dst, 'code_example' AS type, 1.0::DOUBLE AS weight FROM sections a JOIN sections b ON a.path = b.path AND a.heading = b.heading AND a.content_type = 'doc' AND b.content_type = 'code_example' AND (b.start_line - a.end_line BETWEEN 0 AND 6 OR a.start_line - b.end_line BETWEEN 0 AND 6)"
_ALL = f"e AS ({_HEAD} UNION ALL SELECT * FROM ({_SEQ}) WHERE dst IS NOT NULL UNION ALL {_EX}), edges AS (SELECT * FROM e UNION ALL SELECT dst, src, type, weight FROM e)"


def _sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("ord") % 5
    path = F.when(k == 0, F.array(F.lit("A"))).when(k < 3, F.array(F.lit("A"), F.concat(F.lit("B"), k.cast("string")))).otherwise(F.array(F.lit("A"), F.lit("B1"), F.concat(F.lit("C"), k.cast("string"))))
    return chunks(spark, sf_dir).select("path", "chunk_id", "content_type", "content", (F.col("ord") + 1).alias("start_line"), (F.col("ord") + 1).alias("end_line"), path.alias("heading_path"))


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _sections(spark, sf_dir)
    return graph.both_ways(graph.heading_edges(s).unionByName(_near(s)))


def _near(s: DataFrame, tasks: int | None = None) -> DataFrame:
    """The edges between sections that are close to each other."""
    return graph.sequence_edges(s, tasks).unionByName(graph.example_edges(s, 6, tasks))


@register("prose_graph_edges", f"WITH {_SECTIONS}, {_ALL} SELECT type, src, dst, weight FROM edges")
def prose_graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heading, sequence and example edges of the corpus, both ways."""
    return _edges(spark, sf_dir).select("type", "src", "dst", "weight")


@register("prose_graph_stats", f"WITH {_SECTIONS}, {_ALL} SELECT type, count(*) // 2 AS n_edges, count(DISTINCT src) AS n_nodes FROM edges GROUP BY type")
def prose_graph_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges and nodes of each type."""
    s = _sections(spark, sf_dir)
    n = graph.tasks_for(s)
    return graph.statistics(graph.both_ways(_near(s, n)), n).unionByName(graph.heading_statistics(s, n))


@register("co_mention_graph", """WITH m AS (SELECT DISTINCT l_orderkey AS chunk_id, l_partkey AS symbol FROM lineitem), k AS (SELECT symbol FROM m GROUP BY symbol HAVING count(*) BETWEEN 2 AND 25)
SELECT a.chunk_id AS src, b.chunk_id AS dst, count(*)::DOUBLE AS weight FROM m a JOIN m b ON a.symbol = b.symbol AND a.chunk_id < b.chunk_id WHERE a.symbol IN (SELECT symbol FROM k) GROUP BY ALL""")
def co_mention_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that share parts, weighted by how many; parts in too many are left out."""
    m = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("chunk_id"), F.col("l_partkey").alias("symbol"))
    return graph.co_mention_edges(m, 25).select("src", "dst", "weight")


@register("prose_expansion", f"""WITH {_SECTIONS}, {_ALL}, seeds AS (SELECT path AS query_id, chunk_id FROM sections WHERE start_line IN (1, 3)), s AS (SELECT query_id, dst AS chunk_id, sum(weight) AS weight FROM seeds JOIN edges ON src = chunk_id GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY weight DESC, chunk_id) AS rank FROM s WHERE (query_id, chunk_id) NOT IN (SELECT query_id, chunk_id FROM seeds)) SELECT query_id, rank, chunk_id, weight FROM r WHERE rank <= 10""")
def prose_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours of two seeds of each file by summed edge weight."""
    s = _sections(spark, sf_dir).where("start_line IN (1, 3)").select(F.col("path").alias("query_id"), "chunk_id")
    return graph.prose_expansion(s, _edges(spark, sf_dir), 10).select("query_id", "rank", "chunk_id", "weight")


@register("neighbour_selection", f"""WITH {_SECTIONS}, {_ALL}, w AS (SELECT src, dst, type, weight + length(dst) % 3 AS weight FROM edges WHERE type IN ('heading', 'sequence') AND src <> dst), b AS (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY weight DESC, type) AS rn FROM w),
r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS rank FROM b WHERE rn = 1) SELECT src, rank, dst, type, weight::DOUBLE AS weight FROM r WHERE rank <= 4""")
def neighbour_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four strongest neighbours of every chunk along two edge types."""
    s = _sections(spark, sf_dir)
    weight = lambda dst: F.lit(1.0) + F.length(dst) % 3
    n = graph.tasks_for(s)
    near = graph.both_ways(graph.sequence_edges(s, n)).withColumn("weight", weight(F.col("dst")))
    return graph.neighbours(s, graph.heading_neighbours(s, 4, weight, n).unionByName(near), ("heading", "sequence"), 4, n)


@register("neighbour_types", f"""WITH {_SECTIONS}, {_ALL}, b AS (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY weight DESC, type) AS rn FROM edges WHERE src <> dst), r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS rank FROM b WHERE rn = 1)
SELECT type, count(*) AS n, count(DISTINCT dst) AS n_neighbours FROM r WHERE rank <= 10 GROUP BY type""")
def neighbour_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selected edges by type, and how many neighbours they reach."""
    s = _sections(spark, sf_dir)
    n = graph.tasks_for(s)
    return graph.neighbours(s, graph.heading_neighbours(s, 10, tasks=n).unionByName(graph.both_ways(_near(s, n))), tasks=n).groupBy("type").agg(F.count("*").alias("n"), F.count_distinct("dst").alias("n_neighbours"))


@register("canonical_symbols", """WITH c AS (SELECT p_partkey AS chunk_id, p_brand AS symbol, p_type || '/' || p_name AS path FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY length(path), path, chunk_id) AS rn FROM c) SELECT symbol, chunk_id, path FROM r WHERE rn = 1""")
def canonical_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunk that stands for each symbol."""
    c = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("chunk_id"), F.col("p_brand").alias("symbol"), F.concat_ws("/", "p_type", "p_name").alias("path"))
    return graph.canonical_symbols(c)


@register("reverse_mentions", """SELECT p_brand AS symbol, count(DISTINCT l_orderkey) AS n_chunks, min(l_orderkey) AS first_chunk FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand""")
def reverse_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From each symbol back to the chunks that mention it."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("symbol"))
    return table(spark, sf_dir, "lineitem").join(p, "l_partkey").groupBy("symbol").agg(F.count_distinct("l_orderkey").alias("n_chunks"), F.min("l_orderkey").alias("first_chunk"))


@register("symbol_expansion", """WITH sym AS (SELECT p_brand AS symbol, min(p_partkey) AS chunk_id FROM part GROUP BY 1), ment AS (SELECT p_type || ' ' || p_size AS symbol, p_partkey AS chunk_id FROM part),
seeds AS (SELECT o_custkey AS query_id, o_orderkey AS rank, p_partkey AS chunk_id, CASE WHEN p_size % 3 = 0 THEN 'doc' WHEN p_size % 3 = 1 THEN 'docstring' ELSE 'code' END AS ct, p_type || ' ' || p_size AS symbol, p_brand FROM orders JOIN lineitem ON o_orderkey = l_orderkey AND l_linenumber = 1 JOIN part ON l_partkey = p_partkey),
c AS (SELECT query_id, sym.chunk_id, rank, 0 AS kind, 0 AS pos FROM seeds JOIN sym ON sym.symbol = p_brand WHERE ct <> 'docstring' UNION ALL SELECT query_id, ment.chunk_id, rank, 99, 0 FROM seeds JOIN ment USING (symbol) WHERE ct = 'code'),
f AS (SELECT query_id, chunk_id, min(rank * 100 + kind) AS spot FROM c GROUP BY ALL), r AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY spot, chunk_id) AS rank FROM f WHERE (query_id, chunk_id) NOT IN (SELECT query_id, chunk_id FROM seeds)) SELECT query_id, rank, chunk_id FROM r WHERE rank <= 50""")
def symbol_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One hop over the symbol graph for each customer's parts."""
    p = table(spark, sf_dir, "part")
    sym = p.groupBy(F.col("p_brand").alias("symbol")).agg(F.min("p_partkey").alias("chunk_id"))
    name = F.concat_ws(" ", "p_type", F.col("p_size").cast("string"))
    ment = p.select(name.alias("symbol"), F.col("p_partkey").alias("chunk_id"))
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem").where("l_linenumber = 1"), F.col("o_orderkey") == F.col("l_orderkey")).join(p, F.col("l_partkey") == F.col("p_partkey"))
    kind = F.when(F.col("p_size") % 3 == 0, "doc").when(F.col("p_size") % 3 == 1, "docstring").otherwise("code")
    seeds = rows.select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("rank"), F.col("p_partkey").alias("chunk_id"), kind.alias("content_type"), name.alias("symbol"), F.array(F.struct(F.lit(0).alias("kind"), F.col("p_brand").alias("symbol"))).alias("relations"))
    return graph.symbol_expansion(seeds, sym, ment, 50)


@register("symbol_refs_pool", """WITH d AS (SELECT n_nationkey AS query_id, n_nationkey AS symbol FROM nation), ref AS (SELECT c_nationkey AS symbol, CASE c_custkey % 3 WHEN 0 THEN 'declaration' WHEN 1 THEN 'reference' ELSE 'implementation' END AS kind, c_mktsegment AS path, c_custkey AS lo, c_custkey % 40 AS a, c_custkey % 40 + 2 AS b FROM customer),
n AS (SELECT *, row_number() OVER (PARTITION BY query_id, kind ORDER BY lo, path, a) AS n FROM d JOIN ref USING (symbol)), m AS (SELECT * FROM n WHERE n <= CASE kind WHEN 'declaration' THEN 1 WHEN 'reference' THEN 20 ELSE 10 END),
ch AS (SELECT s_suppkey AS chunk_id, seg AS path, s_suppkey % 40 AS s, s_suppkey % 40 + 3 AS e FROM supplier, (SELECT DISTINCT c_mktsegment AS seg FROM customer)), h AS (SELECT *, row_number() OVER (PARTITION BY query_id, kind, n ORDER BY s, chunk_id) AS pos FROM m JOIN ch USING (path) WHERE s <= b AND e >= a),
f AS (SELECT query_id, chunk_id, min(CASE kind WHEN 'declaration' THEN 0 WHEN 'reference' THEN 1 ELSE 2 END * 10000 + n * 10 + pos) AS spot FROM h WHERE pos <= 5 GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY spot, chunk_id) AS rank FROM f) SELECT query_id, rank, chunk_id, round(1.0::DOUBLE / (60 + rank), 9) AS score FROM r WHERE rank <= 30""")
def symbol_refs_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks around declarations, references and implementations."""
    d = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("query_id"), F.col("n_nationkey").alias("symbol"))
    c = table(spark, sf_dir, "customer")
    kind = F.when(F.col("c_custkey") % 3 == 0, "declaration").when(F.col("c_custkey") % 3 == 1, "reference").otherwise("implementation")
    ref = c.select(F.col("c_nationkey").alias("symbol"), kind.alias("kind"), F.col("c_mktsegment").alias("path"), F.col("c_custkey").alias("loc_order"), (F.col("c_custkey") % 40).alias("loc_start"), (F.col("c_custkey") % 40 + 2).alias("loc_end"))
    at = F.col("s_suppkey") % 40
    segments = c.agg(F.collect_set("c_mktsegment").alias("all"))
    ch = table(spark, sf_dir, "supplier").crossJoin(F.broadcast(segments)).select(F.col("s_suppkey").alias("chunk_id"), F.explode("all").alias("path"), at.alias("start_line"), (at + 3).alias("end_line"))
    return graph.refs_pool(d, ref, ch)


@register("comparison_bridge")
def comparison_bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partners of each order's parts along three axes with a budget a bucket; the
    tests hold it against a plain loop."""
    return graph.bridge_pool(bridge_buckets(spark, sf_dir), dealt=True)


def bridge_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each bucket. Line items are dealt by their order and become candidates
    where they are."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.col("l_linenumber").alias("seed_rank"), F.col("l_partkey").alias("seed"), F.col("l_suppkey").alias("s"))
    whole = Window.partitionBy("query_id").orderBy("seed_rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    li = li.withColumn("seeds", F.when(F.col("query_id").isNotNull(), F.collect_set("seed").over(whole)))
    ids = F.array(*((F.col("seed") + x * x) % 200 for x in range(6)))
    partners = F.array(*(F.struct(F.lit(k).alias("axis"), F.concat(F.lit(f"{name}:"), (F.col("s") % 5).cast("string")).alias("bucket"), ids.alias("ids")) for k, name in enumerate(("super", "alias", "package"))))
    p = li.select("query_id", "seed_rank", "seeds", F.explode(partners).alias("p")).select("query_id", "seed_rank", "seeds", "p.axis", "p.bucket", F.col("p.ids").alias("chunk_id"))
    flags = F.array(*(F.coalesce(F.array_contains("seeds", F.get("chunk_id", F.lit(k))), F.lit(False)) for k in range(6)))
    return p.select("query_id", "seed_rank", "axis", "bucket", "chunk_id", flags.alias("is_seed"))


def bridge_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each candidate."""
    each = bridge_buckets(spark, sf_dir).select("query_id", "seed_rank", "axis", "bucket", F.posexplode(F.arrays_zip("chunk_id", "is_seed")).alias("pos", "c"))
    return each.select("query_id", "seed_rank", "axis", "bucket", "pos", "c.chunk_id", "c.is_seed")


@register("page_links")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links between sections of the corpus, resolved; each line gets one inline and
    one reference link to its neighbours."""
    s = _sections(spark, sf_dir)
    text = F.concat(F.lit("[up](../en/"), F.col("start_line").cast("string"), F.lit(".md#b1) [ref][x]\n[x]: ./"), F.regexp_extract("path", "([^/]*)$", 1))
    return graph.link_edges(s.withColumn("content", text))


@register("two_hop_references", """WITH e AS (SELECT DISTINCT l_partkey AS a, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS b FROM lineitem QUALIFY b IS NOT NULL), h1 AS (SELECT a AS seed, b AS node, 1 AS hop FROM e),
h2 AS (SELECT h1.seed, e.b AS node, 2 AS hop FROM h1 JOIN e ON e.a = h1.node), r AS (SELECT seed, node, min(hop) AS hop FROM (SELECT * FROM h1 UNION ALL SELECT * FROM h2) WHERE node <> seed GROUP BY ALL)
SELECT seed, count(*) FILTER (WHERE hop = 1) AS n_first, count(*) FILTER (WHERE hop = 2) AS n_second, sum(node)::BIGINT AS nodes FROM r GROUP BY seed""")
def two_hop_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References of references, each node at its first hop, counted for each part; a part
    refers to the one after it in an order."""
    after = F.lead("l_partkey").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey"))
    return graph.two_hops(table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), after.alias("dst")))
