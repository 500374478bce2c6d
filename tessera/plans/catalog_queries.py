"""Catalog, incremental indexing, chunkers, sources and streams."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.chunking import languages
from tessera.chunking.table import chunked, structured
from tessera.operators import joins
from tessera.plans.base import FILES_SQL, files, table
from tessera.plans.registry import register
from tessera.sources import models, readers, store
from tessera.streaming import feeds


def scratch(spark: SparkSession, tag: str) -> str:
    """A new folder that driver and executors share. A session on one machine without
    the setting gets a private folder; a cluster without it is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    root = root or "file://" + tempfile.mkdtemp(prefix="tessera-")
    return f"{root.rstrip('/')}/tessera/{tag}-{uuid.uuid4().hex}"


@register("catalog_status", f"""WITH {FILES_SQL}, c AS (SELECT DISTINCT source AS root, CASE WHEN ends_with(source, '1') THEN 'indexing' ELSE 'indexed' END AS status FROM documents WHERE NOT ends_with(source, '3')) SELECT path, root, coalesce(status, 'not_found') AS status FROM files LEFT JOIN c ON starts_with(path, root || '/')""")
def catalog_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status of each path by the root that covers it."""
    c = table(spark, sf_dir, "documents").select(F.col("source").alias("path")).distinct().where("NOT endswith(path, '3')")
    return store.status_of(files(spark, sf_dir).select("path"), c.withColumn("status", F.when(F.endswith("path", F.lit("1")), "indexing").otherwise("indexed")))


@register("catalog_latest", """WITH r AS (SELECT o_custkey::VARCHAR AS path, o_orderstatus AS status, o_orderdate AS at, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderstatus DESC) AS rn FROM orders) SELECT path, status FROM r WHERE rn = 1""")
def catalog_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last state of each root from an event table."""
    e = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("path"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("at"))
    return store.latest(e).select("path", "status")


_CATALOG = """c AS (SELECT c_custkey::VARCHAR AS path, CASE c_custkey % 3 WHEN 0 THEN 'indexing' ELSE 'indexed' END AS status, c_custkey % 2 AS indexed_files, c_custkey % 2 * 5 AS total_chunks FROM customer)"""


def _catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(k.cast("string").alias("path"), F.when(k % 3 == 0, "indexing").otherwise("indexed").alias("status"), (k % 2).alias("indexed_files"), (k % 2 * 5).alias("total_chunks"))


@register("catalog_recovery", f"WITH {_CATALOG} SELECT path, CASE WHEN status = 'indexing' THEN 'indexfailed' ELSE status END AS status, indexed_files FROM c WHERE CAST(path AS BIGINT) % 7 <> 0")
def catalog_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalog after a restart."""
    c = _catalog(spark, sf_dir)
    return store.recovered(c, c.where("cast(path AS long) % 7 <> 0")).select("path", "status", "indexed_files")


@register("catalog_healing", f"""WITH {_CATALOG}, n AS (SELECT *, CASE CAST(path AS BIGINT) % 5 WHEN 0 THEN 0 WHEN 1 THEN -1 ELSE 9 END AS rows, status = 'indexed' AND indexed_files = 0 AND total_chunks = 0 AS hollow FROM c) SELECT path, CASE WHEN hollow AND rows > 0 THEN rows ELSE total_chunks END::BIGINT AS total_chunks FROM n WHERE NOT (hollow AND rows = 0)""")
def catalog_healing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completed entries without files or chunks against the tables' row counts."""
    c = _catalog(spark, sf_dir)
    k = F.col("path").cast("long") % 5
    counts = c.select("path", F.when(k == 0, 0).when(k == 1, -1).otherwise(9).cast("long").alias("row_count"))
    return store.healed(c, counts).select("path", "total_chunks")


@register("incremental_reindex", f"""WITH {FILES_SQL}, kept AS (SELECT path, 'old' AS version FROM files WHERE doc_id % 7 <> 0 AND doc_id % 11 <> 0 AND doc_id % 5 <> 0), fresh AS (SELECT path, 'new' AS version FROM files WHERE doc_id % 11 <> 0 AND (doc_id % 7 = 0 OR doc_id % 5 = 0)) SELECT path, version FROM kept UNION ALL SELECT path, version FROM fresh""")
def incremental_reindex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of changed files replaced in a stored table, one new version."""
    f = files(spark, sf_dir).withColumn("content_type", F.lit("doc"))
    mark = F.when(F.col("doc_id") % 5 == 0, F.concat("content", F.lit("!"))).otherwise(F.col("content"))
    old = f.where("doc_id % 7 <> 0").select("path", F.sha2("content", 256).alias("hash"))
    new = f.where("doc_id % 11 <> 0").select("path", F.sha2(mark, 256).alias("hash"))
    s = store.ChunkStore(spark, scratch(spark, "store"))
    rows = f.select("path", F.col("path").alias("chunk_id"), "content_type")
    s.insert(rows.join(old.select("path"), "path", "left_semi").withColumn("version", F.lit("old")))
    s.reindex(joins.state_diff(old, new), rows.withColumn("version", F.lit("new")))
    return s.read().select("path", "version")


@register("chunk_cap", f"""WITH {FILES_SQL} SELECT count(*) AS n, CASE WHEN count(*) > 150 THEN 'limit_reached' ELSE 'completed' END AS status, least(count(*), 150) AS kept FROM files""")
def chunk_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The product limit on chunks, and the status that reports it."""
    kept, status = store.capped(files(spark, sf_dir).withColumn("ord", F.lit(0)), 150)
    return status.crossJoin(kept.agg(F.count("*").alias("kept")))


@register("usage_log", "SELECT event_type AS kind, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY ALL")
def usage_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records appended as JSON lines by kind and day, read back and counted."""
    folder = scratch(spark, "usage")
    e = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("kind"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("ts"))
    store.write_log(e, folder)
    return spark.read.json(folder).groupBy("kind", F.col("day").cast("string").alias("day")).agg(F.count("*").alias("n"))


@register("stream_windows", "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily counts of the event stream, with late records and a second delivery of
    every request dropped by its id."""
    folder = scratch(spark, "stream")
    e = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("at"), "event_type")
    e.unionByName(e).write.parquet(f"{folder}/in")
    live = spark.readStream.schema("event_id long, at timestamp, event_type string").parquet(f"{folder}/in")
    once = feeds.distinct_requests(live, "event_id", "at", "40 days")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    feeds.poll(once, keep, f"{folder}/checkpoint", once=True).awaitTermination()
    out = spark.read.schema("event_id long, at timestamp, event_type string").parquet(f"{folder}/out")
    return out.groupBy(F.date_format("at", "yyyy-MM-dd").alias("day"), "event_type").agg(F.count("*").alias("n"))


_VALUES = ", ".join(f"('{a}', '{b}', '{c}', {str(d).lower()})" for a, b, c, d in languages.node_kinds())


@register("grammar_registry", f"SELECT * FROM (VALUES {_VALUES}) t(language, node, kind, names_inner)")
def grammar_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Node kinds of every grammar as a table."""
    return spark.createDataFrame(languages.node_kinds(), "language string, node string, kind string, names_inner boolean")


@register("language_support", "SELECT p_partkey, p_size % 4 <> 3 AS supported FROM part")
def language_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which languages are cut along their syntax."""
    name = F.element_at(F.array(*map(F.lit, ("TypeScript", "hxml", "C++", "ocaml"))), (F.col("p_size") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", F.lower(name).isin(*languages.SYNTAX_LANGUAGES).alias("supported"))


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A small source file for each document, in five languages."""
    k, name = F.col("doc_id") % 5, F.concat(F.lit("Doc"), F.col("doc_id").cast("string"))
    python = F.concat(F.lit("import os, a.b\nfrom m import x\n\nclass "), name, F.lit("(base.Base):\n    def run(self):\n        return 1\n\ndef top():\n    pass\n"))
    script = F.concat(F.lit("import { a } from 'lib';\nexport class "), name, F.lit(" extends Base implements I<A>, J {\n  run(x) {\n    if (x) { return '}'; }\n  }\n}\nfunction top() { return 1; }\n"))
    prose = F.concat(F.lit("# "), name, F.lit("\nintro\n\n## Part\n```py\nx = 1\n```\n#### deep\n"), F.col("content"))
    marked = F.concat(name, F.lit("\n=======\nintro\n\n.. code-block:: py\n\n    x = 1\n\nPart\n----\n"), F.col("content"))
    haxe = F.concat(F.lit("import haxe.Json;\nabstract "), name, F.lit("(Int) from String to Float {\n}\ntypedef Alias = a.Other<Int>;\n"))
    content = F.when(k == 0, python).when(k == 1, script).when(k == 2, prose).when(k == 3, marked).otherwise(haxe)
    language = F.element_at(F.array(*map(F.lit, ("python", "ts", "md", "rst", "hx"))), (k + 1).cast("int"))
    return files(spark, sf_dir).select("doc_id", "path", language.alias("language"), content.alias("content"))


@register("syntax_chunks")
def syntax_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Definitions, sections and examples of files in five languages."""
    return chunked(_sources(spark, sf_dir)).select("chunk_id", F.md5("content").alias("content_md5"), "start_line", "end_line", "content_type", "language", F.array_join("heading_path", "/").alias("headings"), "symbol", "kind", "parent")


@register("gap_chunks")
def gap_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the lines outside definitions."""
    return chunked(_sources(spark, sf_dir), "gaps").select("chunk_id", "start_line", "end_line", "symbol", "kind")


@register("recursive_chunks")
def recursive_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents cut by the recursive chunker."""
    return chunked(files(spark, sf_dir), "recursive").select("chunk_id", F.md5("content").alias("content_md5"), "start_line", "end_line")


@register("browser_chunks")
def browser_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents cut by lines with an overlap."""
    return chunked(files(spark, sf_dir), "browser").select("chunk_id", "start_line", "end_line")


@register("file_structure", f"""WITH {FILES_SQL} SELECT path, CASE doc_id % 5 WHEN 0 THEN 'os,a.b,m.x' WHEN 1 THEN 'lib' WHEN 4 THEN 'haxe.Json' ELSE '' END AS imports, CASE WHEN doc_id % 5 IN (0, 1) THEN 'Doc' || doc_id || '<Base' || CASE WHEN doc_id % 5 = 1 THEN '<I,J' ELSE '<' END ELSE '' END AS classes,
 CASE WHEN doc_id % 5 = 4 THEN 'Doc' || doc_id || '<Int,String,Float' ELSE '' END AS abstracts, CASE WHEN doc_id % 5 = 4 THEN 'Alias<Other' ELSE '' END AS aliases FROM files WHERE doc_id % 5 NOT IN (2, 3)""")
def file_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imports, base classes, abstracts and aliases of each source file."""
    s = structured(_sources(spark, sf_dir).where("doc_id % 5 NOT IN (2, 3)"))
    said = lambda column, f: F.array_join(F.transform(column, f), ";")
    return s.select(
        "path", F.array_join("imports", ",").alias("imports"), said("classes", lambda c: F.concat_ws("<", c["name"], F.coalesce(c["base"], F.lit("")), F.array_join(c["others"], ","))).alias("classes"),
        said("abstracts", lambda c: F.concat_ws("<", c["name"], F.array_join(c["others"], ","))).alias("abstracts"), said("aliases", lambda c: F.concat_ws("<", c["name"], c["base"])).alias("aliases"),
    )


@register("symbol_graph_load", """SELECT axis, key, pos::INT AS pos, member FROM (SELECT 'canonical' AS axis, p_name AS key, 0 AS pos, 'c' || p_partkey AS member, p_partkey AS k FROM part UNION ALL SELECT 'package', p_brand, 1, 'm' || p_partkey, p_partkey FROM part) WHERE k % 4 <> 3""")
def symbol_graph_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graph files in JSON to rows; unknown versions have none, empty members drop."""
    p = table(spark, sf_dir, "part")
    text = F.concat(F.lit('{"version":"'), F.when(F.col("p_partkey") % 4 == 3, "v9").otherwise("v3-2"), F.lit('","by_symbol":{"'), "p_name", F.lit('":{"canonical_chunk_ids":["c'), F.col("p_partkey").cast("string"), F.lit('"]}},"by_package":{"'), "p_brand", F.lit('":["","m'), F.col("p_partkey").cast("string"), F.lit('"]}}'))
    return readers.symbol_graph(p.select(text.alias("payload")))


@register("prose_graph_load", """SELECT 'n' || p_partkey AS src, 'n' || (p_partkey + 1) AS dst, 'sequence' AS type, CASE WHEN p_size % 2 = 0 THEN p_size ELSE 1 END::DOUBLE AS weight FROM part WHERE p_partkey % 3 <> 0""")
def prose_graph_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adjacency files in JSON to edges; missing targets drop, odd weights count 1."""
    k = F.col("p_partkey")
    weight = F.when(F.col("p_size") % 2 == 0, F.col("p_size").cast("string")).otherwise("NaN")
    target = F.when(k % 3 == 0, F.lit("null")).otherwise(F.concat(F.lit('"n'), (k + 1).cast("string"), F.lit('"')))
    text = F.concat(F.lit('{"version":"p1","adjacency":{"n'), k.cast("string"), F.lit('":[{"to":'), target, F.lit(',"type":"sequence","weight":'), weight, F.lit("}]}}"))
    return readers.prose_graph(table(spark, sf_dir, "part").select(text.alias("payload")), "p1")


@register("repository_tree", """SELECT 'src/' || p_partkey || '.py' AS path, 'py' AS language, p_name AS content FROM part WHERE p_partkey % 3 = 0""")
def repository_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blobs of a repository listing, decoded and filtered by extension."""
    k = F.col("p_partkey")
    listing = table(spark, sf_dir, "part").select(F.concat(F.lit("src/"), k.cast("string"), F.when(k % 3 == 1, ".bin").otherwise(".py")).alias("path"), F.when(k % 3 == 2, "tree").otherwise("blob").alias("type"), F.lit("base64").alias("encoding"), F.base64(F.col("p_name").cast("binary")).alias("content"))
    return readers.repository_tree(listing)


@register("symbol_locations", """SELECT p_name AS symbol, 'reference' AS kind, p_brand AS path, 0 AS loc_order, CASE WHEN p_size % 2 = 0 THEN p_size ELSE 0 END::BIGINT AS loc_start, CASE WHEN p_size % 2 = 0 THEN p_size + 2 ELSE 1000000 END::BIGINT AS loc_end FROM part""")
def symbol_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Locations from JSON inside mixed text; a summary is the whole file."""
    n = F.col("p_size")
    body = F.when(n % 2 == 0, F.concat(F.lit(',"body_location":{"start_line":'), n.cast("string"), F.lit(',"end_line":'), (n + 2).cast("string"), F.lit("}"))).otherwise("")
    text = F.concat(F.lit('note: [{"relative_path":"'), "p_brand", F.lit('"'), body, F.lit("}]"))
    return readers.symbol_locations(table(spark, sf_dir, "part").select(F.col("p_name").alias("symbol"), F.lit("reference").alias("kind"), text.alias("payload")))


@register("file_window", f"""WITH {FILES_SQL} SELECT path, md5(array_to_string(string_split(content, chr(10))[2:4], chr(10))) AS lines_md5, len(string_split(content, chr(10))) > 4 AS more FROM files""")
def file_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three lines of each file from the second on."""
    return readers.file_window(files(spark, sf_dir), 1, 3).select("path", F.md5(F.array_join("lines", "\n")).alias("lines_md5"), "more")


@register("directory_tree", f"""WITH {FILES_SQL} SELECT string_split(path, '/')[1] AS folder, 1 AS level, count(*) AS n_files FROM files GROUP BY 1 UNION ALL SELECT string_split(path, '/')[1] || '/' || string_split(path, '/')[2], 2, count(*) FROM files GROUP BY 1""")
def directory_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders and how many files lie below them."""
    return readers.directory_tree(files(spark, sf_dir))


@register("embed_and_search")
def embed_and_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and queries embedded by the offline model, ten nearest each."""
    from tessera.operators.vectors import exact_knn

    e = models.Embedder()
    d = e.apply(table(spark, sf_dir, "documents").where("doc_id IS NOT NULL"), "doc_id", "text").withColumnRenamed("doc_id", "item")
    q = e.apply(table(spark, sf_dir, "benchmark"), "item_id", "text", queries=True).withColumnRenamed("item_id", "query_id")
    return exact_knn(d, q, 10).withColumnRenamed("item", "doc_id")
