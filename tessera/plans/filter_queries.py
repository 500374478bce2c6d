"""Filters and projections over files, chunks and rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import symbols
from tessera.functions.text import domain_of
from tessera.operators import filters
from tessera.plans.base import CHUNKS_SQL, FILES_SQL, chunks, files, table
from tessera.plans.registry import register

_PATTERNS = ["/src1/", "en/", "*7.md", "src2/de", "# comment", ""]


@register("ignore_filter", f"""WITH {FILES_SQL} SELECT doc_id, path FROM files WHERE NOT (starts_with(path, 'src1/') OR contains('/' || path, '/en/') OR ends_with(path, '7.md') OR starts_with(path, 'src2/de/'))""")
def ignore_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that no ignore pattern meets."""
    return files(spark, sf_dir).where(~filters.ignored(F.col("path"), _PATTERNS)).select("doc_id", "path")


@register("effective_files", f"""WITH {FILES_SQL}, p AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'node_modules/' WHEN 1 THEN '.git/' WHEN 2 THEN 'private/' ELSE '' END || source || '/' || doc_id || CASE doc_id % 4 WHEN 0 THEN '.md' WHEN 1 THEN '.vue' WHEN 2 THEN '.min.js' ELSE '.exe' END AS path FROM documents)
SELECT doc_id, path FROM p WHERE regexp_matches(path, '\\.(md|vue)$') AND NOT regexp_matches(path, '^(node_modules|\\.git|private)/')""")
def effective_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All extension sources less all ignore sources."""
    path = F.expr("concat(CASE doc_id % 6 WHEN 0 THEN 'node_modules/' WHEN 1 THEN '.git/' WHEN 2 THEN 'private/' ELSE '' END, source, '/', doc_id, CASE doc_id % 4 WHEN 0 THEN '.md' WHEN 1 THEN '.vue' WHEN 2 THEN '.min.js' ELSE '.exe' END)")
    p = table(spark, sf_dir, "documents").select("doc_id", path.alias("path"))
    return p.where(filters.effective(F.col("path"), [[".vue"]], [["private/**"]]))


@register("chunk_filter", f"""WITH {CHUNKS_SQL} SELECT chunk_id, path, ord, CASE WHEN content_type IN ('doc', 'code_example') THEN 'prose' ELSE 'code' END AS domain FROM chunks WHERE (starts_with(path, 'src1/') OR starts_with(path, 'src3/de/')) AND content_type = 'doc'""")
def chunk_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension, category and content-type filters together, and the domain."""
    c = chunks(spark, sf_dir)
    keep = filters.with_extensions(F.regexp_extract("path", r"(\.[^.]*)$", 1), [" .md "]) & filters.in_categories(F.col("path"), ["src1/", "/src3/de", "src1"]) & (F.col("content_type") == "doc")
    return c.where(keep).select("chunk_id", "path", "ord", domain_of(F.col("content_type")).alias("domain"))


@register("filter_language", """SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE (l_returnflag = 'R' AND l_quantity <= 10) OR (l_linestatus IN ('O') AND l_quantity >= 45 AND starts_with(l_returnflag, 'N'))""")
def filter_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A filter string compiled to a predicate of the scan."""
    text = '(l_returnflag == "R" and l_quantity <= 10) or (l_linestatus in ["O"] AND l_quantity >= 45 and l_returnflag like "N%")'
    return table(spark, sf_dir, "lineitem").where(filters.compiled(text)).select("l_orderkey", "l_linenumber", "l_quantity")


@register("symbol_filter", """WITH r AS (SELECT p_partkey, string_split(p_type, ' ')[-1] AS symbol, string_split(p_type, ' ')[1] AS parent, 'a/' || string_split(p_type, ' ')[1] || CASE WHEN p_size % 2 = 0 THEN '.hx' ELSE '.exe' END AS path, CASE WHEN p_partkey % 3 = 0 THEN string_split(p_type, ' ')[1] ELSE 'Other' END AS cls, CASE WHEN p_partkey % 2 = 0 THEN string_split(p_type, ' ')[-1] ELSE 'none' END AS mth FROM part)
SELECT p_partkey, symbol, parent, path FROM r WHERE cls <> 'Other' AND ((mth <> 'none' AND symbol = mth) OR (mth = 'none' AND ends_with(path, '.hx')))""")
def symbol_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that a class and method name may mean, with a vocabulary."""
    s = F.split("p_type", " ")
    rows = table(spark, sf_dir, "part").select(
        "p_partkey", F.element_at(s, -1).alias("symbol"), F.element_at(s, 1).alias("parent"), F.concat(F.lit("a/"), F.element_at(s, 1), F.when(F.col("p_size") % 2 == 0, ".hx").otherwise(".exe")).alias("path"),
        F.when(F.col("p_partkey") % 3 == 0, F.element_at(s, 1)).otherwise("Other").alias("cls"), F.when(F.col("p_partkey") % 2 == 0, F.element_at(s, -1)).otherwise("none").alias("mth"),
    )
    c = F.col
    return rows.where(filters.symbol_filter(c("cls"), c("mth"), c("symbol"), c("parent"), c("path"), c("cls") != "Other", c("mth") != "none")).select("p_partkey", "symbol", "parent", "path")


@register("safe_ids", "SELECT page_id, regexp_matches(coalesce(url, ''), '^[A-Za-z0-9_-]+$') AS safe_url, regexp_matches('p_' || page_id, '^[A-Za-z0-9_-]+$') AS safe_id FROM pages")
def safe_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which ids may stand in a filter string."""
    return table(spark, sf_dir, "pages").select("page_id", filters.safe_id(F.coalesce("url", F.lit(""))).alias("safe_url"), filters.safe_id(F.concat(F.lit("p_"), F.col("page_id").cast("string"))).alias("safe_id"))


@register("grep_scan", f"""WITH {FILES_SQL}, l AS (SELECT path, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS line_no FROM files) SELECT path, line_no, md5(line) AS line_md5 FROM l WHERE regexp_matches(line, '[0-9]{{3,}}') AND path LIKE '%/en/%'""")
def grep_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of every file that a pattern meets, with an include filter."""
    f = files(spark, sf_dir).where(F.contains("path", F.lit("/en/"))).where(F.col("content").rlike("[0-9]{3,}"))
    lines = f.select("path", F.posexplode(F.split("content", "\n", -1)).alias("pos", "line"))
    return lines.where(F.col("line").rlike("[0-9]{3,}")).select("path", (F.col("pos") + 1).cast("long").alias("line_no"), F.md5("line").alias("line_md5"))


@register("test_files", """SELECT doc_id, list_has_any(regexp_split_to_array(lower(p), '[ _/.]'), ['test', 'tests', 'testing']) AS is_test FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'tests/' WHEN 1 THEN 'src/Test_' ELSE 'src/contest_' END || doc_id || '.py' AS p FROM documents)""")
def test_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths that a word marks as tests."""
    path = F.concat(F.expr("CASE doc_id % 3 WHEN 0 THEN 'tests/' WHEN 1 THEN 'src/Test_' ELSE 'src/contest_' END"), F.col("doc_id").cast("string"), F.lit(".py"))
    return table(spark, sf_dir, "documents").select("doc_id", filters.is_test_file(path).alias("is_test"))


@register("instance_subset", """SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderkey % 3 + 1 = 2""")
def instance_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instances of one difficulty whose patch touches exactly two files."""
    patch = F.array_join(F.transform(F.sequence(F.lit(1), (F.col("o_orderkey") % 3 + 1).cast("int")), lambda k: F.concat(F.lit("--- a/f"), k.cast("string"), F.lit(".py\n+++ b/f"))), "\n")
    o = table(spark, sf_dir, "orders").where(F.col("o_orderpriority") == "1-URGENT")
    return o.where(F.size(symbols.patch_files(patch)) == 2).select("o_orderkey", "o_orderpriority")


@register("resume_filter", "SELECT o_orderkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o.o_orderkey AND l_returnflag = 'R')")
def resume_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instances that no earlier run has worked off."""
    done = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    return table(spark, sf_dir, "orders").select("o_orderkey").join(done, "o_orderkey", "left_anti")


@register("filtered_scan", "SELECT o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders WHERE o_orderstatus = 'O') WHERE rn <= 100")
def filtered_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A filtered scan with a projection and a result limit in a stated order."""
    return table(spark, sf_dir, "orders").where(filters.compiled('o_orderstatus == "O"')).orderBy(F.desc("o_totalprice"), "o_orderkey").limit(100).select("o_orderkey", "o_totalprice")
