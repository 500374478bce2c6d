"""Joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import joins, ranking
from tessera.plans.base import CHUNKS_SQL, FILES_SQL, chunks, files, table
from tessera.plans.registry import register


@register("ordered_lookup", """WITH i AS (SELECT l_orderkey, l_linenumber, l_partkey AS id FROM lineitem UNION ALL SELECT 0, 0, -1) SELECT l_orderkey, l_linenumber, id, p_name FROM i JOIN part ON p_partkey = id""")
def ordered_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids to rows in the caller's order; a missing id drops out."""
    i = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey").alias("id"))
    i = i.unionByName(spark.sql("SELECT 0L AS l_orderkey, 0 AS l_linenumber, -1L AS id"))
    return joins.ordered_lookup(i, table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_name"), "id").select("l_orderkey", "l_linenumber", "id", "p_name")


@register("overlap_join", f"""WITH {CHUNKS_SQL}, c AS (SELECT path, chunk_id, ord + 1 AS start_line, ord + 3 AS end_line FROM chunks), loc AS (SELECT doc_id AS loc_id, path, 2 + doc_id % 3 AS a, 6 AS b FROM files),
r AS (SELECT loc_id, chunk_id, row_number() OVER (PARTITION BY loc_id ORDER BY start_line, chunk_id) AS rank FROM loc JOIN c USING (path) WHERE start_line <= b AND end_line >= a) SELECT loc_id, rank, chunk_id FROM r WHERE rank <= 5""")
def overlap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five chunks whose lines overlap a location."""
    c = chunks(spark, sf_dir).select("path", "chunk_id", (F.col("ord") + 1).alias("start_line"), (F.col("ord") + 3).alias("end_line"))
    loc = files(spark, sf_dir).select(F.col("doc_id").alias("loc_id"), "path", (2 + F.col("doc_id") % 3).alias("loc_start"), F.lit(6).alias("loc_end"))
    return joins.overlapping(loc, c, ["loc_id"]).select("loc_id", "rank", "chunk_id")


@register("vocabulary_semi_join", "SELECT s_suppkey, s_name FROM supplier WHERE s_nationkey IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9000)")
def vocabulary_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Membership in a set as a semi-join."""
    vocabulary = table(spark, sf_dir, "customer").where("c_acctbal > 9000").select(F.col("c_nationkey").alias("key")).distinct()
    return joins.known(F.col("s_nationkey"), vocabulary, table(spark, sf_dir, "supplier"), "key").select("s_suppkey", "s_name")


@register("seed_anti_join", "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def seed_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours without the seeds."""
    seeds = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct()
    return table(spark, sf_dir, "customer").join(seeds, "c_custkey", "left_anti").select("c_custkey", "c_name")


_STATES = f"""{FILES_SQL}, old AS (SELECT path, sha256(content) AS hash FROM files WHERE doc_id % 7 <> 0), new AS (SELECT path, sha256(CASE WHEN doc_id % 5 = 0 THEN content || '!' ELSE content END) AS hash FROM files WHERE doc_id % 11 <> 0)"""


def _states(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two states of the file tree: some files are new, gone or changed."""
    f = files(spark, sf_dir)
    changed = F.when(F.col("doc_id") % 5 == 0, F.concat("content", F.lit("!"))).otherwise(F.col("content"))
    return f.where("doc_id % 7 <> 0").select("path", F.sha2("content", 256).alias("hash")), f.where("doc_id % 11 <> 0").select("path", F.sha2(changed, 256).alias("hash"))


@register("state_diff", f"""WITH {_STATES} SELECT coalesce(old.path, new.path) AS path, CASE WHEN old.path IS NULL THEN 'added' WHEN new.path IS NULL THEN 'removed' ELSE 'modified' END AS change FROM old FULL JOIN new ON old.path = new.path WHERE old.hash IS DISTINCT FROM new.hash""")
def state_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Added, removed and modified files between two snapshots."""
    return joins.state_diff(*_states(spark, sf_dir))


@register("node_set_diff", f"""WITH {_STATES} (SELECT hash, 'gone' AS side FROM (SELECT hash FROM old EXCEPT SELECT hash FROM new)) UNION ALL (SELECT hash, 'new' FROM (SELECT hash FROM new EXCEPT SELECT hash FROM old))""")
def node_set_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of one hash tree that the other lacks, both ways."""
    old, new = _states(spark, sf_dir)
    gone = old.select("hash").distinct().join(new, "hash", "left_anti").withColumn("side", F.lit("gone"))
    return gone.unionByName(new.select("hash").distinct().join(old, "hash", "left_anti").withColumn("side", F.lit("new")))


@register("state_counts", f"""WITH {_STATES}, d AS (SELECT CASE WHEN old.path IS NULL THEN 'added' WHEN new.path IS NULL THEN 'removed' ELSE 'modified' END AS change FROM old FULL JOIN new ON old.path = new.path WHERE old.hash IS DISTINCT FROM new.hash) SELECT change, count(*) AS n FROM d GROUP BY change""")
def state_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of a synchronisation."""
    return joins.state_diff(*_states(spark, sf_dir)).groupBy("change").agg(F.count("*").alias("n"))


@register("root_fingerprint", f"""WITH {_STATES} SELECT (SELECT count(*) FROM old) AS n_old, (SELECT count(*) FROM new) AS n_new, FALSE AS equal, TRUE AS equal_to_itself""")
def root_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of two states, and of one state in another order."""
    old, new = _states(spark, sf_dir)
    a, b = joins.fingerprint(old), joins.fingerprint(new)
    c = joins.fingerprint(old.orderBy(F.desc("hash")))
    key = lambda df, n: df.select(F.col("n_files").alias(f"n_{n}"), F.concat_ws(":", "n_files", "sum", "xor").alias(n))
    return key(a, "old").crossJoin(key(b, "new")).crossJoin(key(c, "again")).select("n_old", "n_new", (F.col("old") == F.col("new")).alias("equal"), (F.col("old") == F.col("again")).alias("equal_to_itself"))


@register("reconcile_catalog", """WITH l AS (SELECT DISTINCT 'src' || (doc_id % 23) AS name FROM documents), r AS (SELECT DISTINCT source AS name FROM documents)
SELECT coalesce(l.name, r.name) AS name, CASE WHEN l.name IS NOT NULL AND r.name IS NOT NULL THEN 'keep' WHEN r.name IS NOT NULL THEN 'add' ELSE 'drop' END AS action FROM l FULL JOIN r ON l.name = r.name""")
def reconcile_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The local catalog against the list of tables that exist."""
    d = table(spark, sf_dir, "documents")
    return joins.reconciled(d.select(F.concat(F.lit("src"), F.col("doc_id") % 23).alias("name")), d.select(F.col("source").alias("name")), "name")


@register("merge_snapshot", """WITH m AS (SELECT c_custkey AS k, 'memory' AS v FROM customer WHERE c_custkey % 2 = 0), d AS (SELECT c_custkey AS k, 'disk' AS v FROM customer WHERE c_custkey % 3 = 0 AND c_custkey % 5 <> 0)
SELECT coalesce(m.k, d.k) AS k, coalesce(m.v, d.v) AS v FROM m FULL JOIN d ON m.k = d.k""")
def merge_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of memory and disk; what was removed lately doesn't come back."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    return joins.upserted(c.where("k % 2 = 0").withColumn("v", F.lit("memory")), c.where("k % 3 = 0").withColumn("v", F.lit("disk")), c.where("k % 5 = 0"), "k")


@register("longest_prefix", f"""WITH {FILES_SQL}, roots AS (SELECT DISTINCT source AS root FROM documents UNION SELECT DISTINCT source || '/' || lang FROM documents WHERE lang = 'en'),
j AS (SELECT path, root, row_number() OVER (PARTITION BY path ORDER BY length(root) DESC) AS rn FROM files JOIN roots ON path = root OR starts_with(path, root || '/')) SELECT path, root FROM j WHERE rn = 1""")
def longest_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The deepest indexed root above each file."""
    d = table(spark, sf_dir, "documents")
    roots = d.select(F.col("source").alias("root")).unionByName(d.where("lang = 'en'").select(F.concat_ws("/", "source", "lang").alias("root")))
    return joins.longest_prefix(files(spark, sf_dir).select("path"), roots)


@register("answer_correlation", """WITH a AS (SELECT o_orderkey AS record_id, unnest([o_orderkey, o_orderkey + 1, -1]) AS request_id FROM orders) SELECT record_id, request_id, o_totalprice AS total FROM a JOIN orders ON o_orderkey = request_id""")
def answer_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers joined with the retrievals that they cite."""
    o = table(spark, sf_dir, "orders")
    a = o.select(F.col("o_orderkey").alias("record_id"), F.explode(F.array(F.col("o_orderkey"), F.col("o_orderkey") + 1, F.lit(-1).cast("long"))).alias("request_id"))
    return a.join(o.select(F.col("o_orderkey").alias("request_id"), F.col("o_totalprice").alias("total")), "request_id").select("record_id", "request_id", "total")


@register("delete_by_ids", "SELECT count(*) AS n, sum(doc_id)::BIGINT AS ids FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def delete_by_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays after a delete by a list of ids."""
    gone = table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id").distinct()
    return table(spark, sf_dir, "documents").join(gone, "doc_id", "left_anti").agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"))


@register("pool_union", """WITH p AS (SELECT l_orderkey AS q, l_partkey AS item, 0 AS pool, l_linenumber AS rank FROM lineitem WHERE l_returnflag = 'N' UNION ALL SELECT l_orderkey, l_partkey, 1, l_linenumber FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY q, item ORDER BY pool, rank) AS rn FROM p) SELECT q, item, pool, rank FROM r WHERE rn = 1""")
def pool_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pools laid one after the other; the first occurrence of an item stays."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("q"), F.col("l_partkey").alias("item"), F.col("l_linenumber").alias("rank"), "l_returnflag")
    both = rows.where("l_returnflag = 'N'").withColumn("pool", F.lit(0)).unionByName(rows.withColumn("pool", F.lit(1)))
    return ranking.best(both, ["q", "item"], [F.col("pool"), F.col("rank")]).select("q", "item", "pool", "rank")


@register("set_operations", """WITH a AS (SELECT DISTINCT c_nationkey AS n FROM customer), b AS (SELECT DISTINCT s_nationkey AS n FROM supplier) SELECT n, 'both' AS part FROM (SELECT n FROM a INTERSECT SELECT n FROM b) UNION ALL SELECT n, 'first' FROM (SELECT n FROM a EXCEPT SELECT n FROM b) UNION ALL SELECT n, 'second' FROM (SELECT n FROM b EXCEPT SELECT n FROM a)""")
def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intersection and the differences both ways."""
    a, b = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("n")), table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("n"))
    tag = lambda df, name: df.withColumn("part", F.lit(name))
    return tag(a.intersect(b), "both").unionByName(tag(a.subtract(b), "first")).unionByName(tag(b.subtract(a), "second"))
