"""Aggregates, orders and limits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators import evaluation, ranking
from tessera.plans.base import CHUNKS_SQL, chunks, table
from tessera.plans.registry import register


@register("row_count", "SELECT count(*) AS n FROM lineitem")
def row_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a table."""
    return table(spark, sf_dir, "lineitem").agg(F.count("*").alias("n"))


@register("category_counts", f"""WITH {CHUNKS_SQL}, cat AS (SELECT 'src' || i AS category FROM range(25) t(i)) SELECT category, count(*) FILTER (content_type = 'doc') AS doc, count(*) FILTER (content_type = 'code_example') AS code_example, count(chunk_id) > 0 AS searchable FROM cat LEFT JOIN chunks ON string_split(path, '/')[1] = category GROUP BY category""")
def category_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of each category and content type, categories without any included."""
    c = chunks(spark, sf_dir).groupBy(F.substring_index("path", "/", 1).alias("category")).pivot("content_type", ["doc", "code_example"]).count()
    cat = spark.range(25).select(F.concat(F.lit("src"), F.col("id")).alias("category"))
    return cat.join(c, "category", "left").select("category", F.coalesce("doc", F.lit(0)).alias("doc"), F.coalesce("code_example", F.lit(0)).alias("code_example"), (F.coalesce("doc", F.lit(0)) + F.coalesce("code_example", F.lit(0)) > 0).alias("searchable"))


@register("term_frequency", "SELECT term, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_]+')) AS term FROM documents) GROUP BY term")
def term_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each term occurs."""
    from tessera.operators.lexical import tokens

    return table(spark, sf_dir, "documents").select(F.explode(tokens(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))


@register("precision_recall", """WITH h AS (SELECT l_orderkey AS id, list_distinct(list(l_partkey % 20) FILTER (l_returnflag = 'N')) AS hits, list_distinct(list(l_partkey % 20) FILTER (l_linestatus = 'O')) AS oracles FROM lineitem GROUP BY 1),
n AS (SELECT id, coalesce(len(hits), 0) AS h, coalesce(len(oracles), 0) AS o, coalesce(len(list_intersect(hits, oracles)), 0) AS b FROM h), p AS (SELECT id, CASE WHEN h = 0 THEN 0.0 ELSE b / h END::DOUBLE AS p, CASE WHEN o = 0 THEN 0.0 ELSE b / o END::DOUBLE AS r FROM n)
SELECT id, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END, 6) AS f1 FROM p""")
def precision_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision, recall and F1 of the hits of each instance."""
    key = (F.col("l_partkey") % 20).cast("string")
    h = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_set(F.when(F.col("l_returnflag") == "N", key)).alias("hits"), F.collect_set(F.when(F.col("l_linestatus") == "O", key)).alias("oracles"))
    p, r, f1 = evaluation.scores(F.col("hits"), F.col("oracles"))
    return h.select("id", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(f1, 6).alias("f1"))


@register("run_statistics", """SELECT o_orderpriority AS method, round(avg(o_totalprice), 4) AS mean, round(stddev_pop(o_totalprice), 4) AS std, count(DISTINCT o_custkey) AS instances, round(CASE WHEN min(o_totalprice) = 0 THEN 0 ELSE 100 * (max(o_totalprice) - min(o_totalprice)) / min(o_totalprice) END, 4) AS change FROM orders GROUP BY 1""")
def run_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and population deviation over pooled runs, instances, relative change."""
    lo, hi = F.min("o_totalprice"), F.max("o_totalprice")
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("method")).agg(F.round(F.avg("o_totalprice"), 4).alias("mean"), F.round(F.stddev_pop("o_totalprice"), 4).alias("std"), F.count_distinct("o_custkey").alias("instances"), F.round(evaluation.relative_change(lo, hi), 4).alias("change"))


@register("conversation_tokens", """SELECT conv_id, sum(CASE WHEN role = 'assistant' THEN 0 ELSE n END)::BIGINT AS input_tokens, sum(CASE WHEN role = 'assistant' THEN n ELSE 0 END)::BIGINT AS output_tokens, sum(n)::BIGINT AS total_tokens, max(n)::BIGINT AS max_turn, arg_max(md5(text), turn) AS final_md5
FROM (SELECT conv_id, turn, role, text, ceil(length(text) / 4.0)::BIGINT AS n FROM conversations WHERE text IS NOT NULL) GROUP BY conv_id""")
def conversation_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token totals of each conversation, its largest turn and its last message."""
    return evaluation.token_totals(table(spark, sf_dir, "conversations").where("text IS NOT NULL"))


@register("role_histogram", """SELECT conv_id, string_agg(role || '=' || n, ',' ORDER BY role) AS histogram, sum(n)::BIGINT AS total FROM (SELECT conv_id, role, count(*) AS n FROM conversations GROUP BY ALL) GROUP BY conv_id""")
def role_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of each kind in a conversation."""
    return evaluation.histogram(table(spark, sf_dir, "conversations"), "conv_id", "role")


#: A list without later copies, in order.
_ONCE = "list_filter({x}, lambda x, i: list_position({x}, x) = i)"
_PATCH = "concat('--- a/', source, '/', coalesce(lang, 'none'), '.py\n+++ b/new.py\n@@ -1 +1 @@\n', replace(coalesce(text, ''), '.', '\n--- a/'), '\n--- a/lib/b.py\n--- a/', source, '/', coalesce(lang, 'none'), '.py\n')"
_LOG = "concat('start\nSuccessfully modified file: /work/src/', source, '.py\n', replace(coalesce(text, ''), ', ', '\nSuccessfully modified file: /work/'), '\nedit(file_path=\"', lang, '.md\")\nSuccessfully modified file: /work/src/', source, '.py  \n')"


def _duck(text: str) -> str:
    """The same text expression for DuckDB, whose plain strings know no escapes."""
    return text.replace("\n", "' || chr(10) || '")


@register("oracle_files", f"""WITH p AS (SELECT doc_id, regexp_extract_all({_duck(_PATCH)}, '(?m)^--- a/(.+)$', 1) AS f FROM documents)
SELECT doc_id, md5(array_to_string({_ONCE.format(x="f")}, ',')) AS oracles, len({_ONCE.format(x="f")})::INT AS n FROM p""")
def oracle_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that a patch changes, each once. The patches hold the documents' texts, with
    a header at each full stop."""
    from tessera.functions.symbols import patch_files

    files = table(spark, sf_dir, "documents").select("doc_id", patch_files(F.expr(_PATCH)).alias("f"))
    return files.select("doc_id", F.md5(F.array_join("f", ",")).alias("oracles"), F.size("f").alias("n"))


@register("hit_files", rf"""WITH l AS (SELECT doc_id, {_duck(_LOG)} AS log FROM documents), f AS (SELECT doc_id, list_transform(list_concat(regexp_extract_all(log, '(?m)^Successfully modified file: (.+?)\s*$', 1), regexp_extract_all(log, 'file_path=[''"]([^''"]+)[''"]', 1)), lambda p: regexp_replace(p, '^/work/', '')) AS f FROM l)
SELECT doc_id, md5(array_to_string({_ONCE.format(x="f")}, ',')) AS hits, len({_ONCE.format(x="f")})::INT AS n FROM f""")
def hit_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that a tool log says were edited, relative, in order, each once. The logs
    hold the documents' texts, with a success line at each comma."""
    f = table(spark, sf_dir, "documents").select("doc_id", evaluation.hit_files(F.expr(_LOG), "/work").alias("f"))
    return f.select("doc_id", F.md5(F.array_join("f", ",")).alias("hits"), F.size("f").alias("n"))


@register("eval_topk", """WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) SELECT o_custkey, string_agg(o_orderkey::VARCHAR, ',' ORDER BY rank) AS hits FROM r WHERE rank <= 20 GROUP BY 1""")
def eval_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hit list of each instance, twenty at most, in rank order."""
    top = ranking.top_k(table(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 20)
    rows = top.groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct("rank", "o_orderkey"))).alias("h"))
    return rows.select("o_custkey", F.array_join(F.transform("h", lambda x: x["o_orderkey"].cast("string")), ",").alias("hits"))


@register("sorted_results", """SELECT c_custkey, c_acctbal, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS place FROM customer QUALIFY place <= 50""")
def sorted_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifty best rows by score, ties by id."""
    top = table(spark, sf_dir, "customer").orderBy(F.desc("c_acctbal"), "c_custkey").limit(50)
    return top.select("c_custkey", "c_acctbal", F.row_number().over(Window.orderBy(F.desc("c_acctbal"), "c_custkey")).cast("long").alias("place"))


@register("recent_items", """WITH k AS (SELECT o_custkey, o_orderkey % 9 AS item, max(o_orderdate) AS seen FROM orders GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY seen DESC, item) AS place FROM k) SELECT o_custkey, place, item FROM r WHERE place <= 5""")
def recent_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list that moves what was used to the front, five items at most."""
    k = table(spark, sf_dir, "orders").groupBy("o_custkey", (F.col("o_orderkey") % 9).alias("item")).agg(F.max("o_orderdate").alias("seen"))
    return ranking.top_k(k, ["o_custkey"], [F.desc("seen"), F.col("item")], 5, "place").select("o_custkey", "place", "item")


@register("retention", "SELECT o_orderkey, o_orderdate::DATE::VARCHAR AS day FROM orders WHERE o_orderdate > (SELECT max(o_orderdate) FROM orders) - INTERVAL 30 DAY")
def retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of the last thirty days before a stated time (here the newest one)."""
    o = table(spark, sf_dir, "orders")
    now = o.agg(F.max("o_orderdate").alias("now"))
    return o.crossJoin(F.broadcast(now)).where(F.expr("o_orderdate > now - INTERVAL '30' DAY")).select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))


@register("restored_order", "SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS place FROM lineitem")
def restored_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers back in the order of the requests."""
    return ranking.ranked(table(spark, sf_dir, "lineitem"), ["l_orderkey"], [F.col("l_linenumber")], "place").select("l_orderkey", "l_linenumber", "place")


@register("chunk_overlap", f"""WITH {CHUNKS_SQL}, p AS (SELECT chunk_id, content, ord, lag(content) OVER (PARTITION BY path ORDER BY ord) AS prev FROM chunks) SELECT chunk_id, md5(CASE WHEN prev IS NULL THEN content ELSE right(prev, 30) || chr(10) || content END) AS content_md5, greatest(1, ord + 1 - CASE WHEN prev IS NULL THEN 0 ELSE 1 END) AS start_line FROM p""")
def chunk_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each chunk with the end of the one before it, its first line moved back."""
    from tessera.chunking.refine import overlapped

    c = chunks(spark, sf_dir).withColumn("start_line", F.col("ord") + 1)
    return overlapped(c, 30).select("chunk_id", F.md5("content").alias("content_md5"), "start_line")


@register("estimated_lines", f"""WITH {CHUNKS_SQL} SELECT chunk_id, CASE WHEN instr(f.content, c.content) = 0 THEN 1 ELSE 1 + length(substr(f.content, 1, instr(f.content, c.content) - 1)) - length(replace(substr(f.content, 1, instr(f.content, c.content) - 1), chr(10), '')) END AS start_line FROM chunks c JOIN files f USING (doc_id)""")
def estimated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line on which each chunk is first found in its file."""
    from tessera.functions.text import line_of
    from tessera.plans.base import files

    c = chunks(spark, sf_dir).select("doc_id", "chunk_id", F.col("content").alias("part"))
    return c.join(files(spark, sf_dir).select("doc_id", "content"), "doc_id").select("chunk_id", F.coalesce(line_of(F.col("content"), F.col("part")), F.lit(1)).alias("start_line"))
