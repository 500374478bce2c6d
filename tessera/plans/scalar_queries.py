"""Scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import symbols
from tessera.functions import text as tx
from tessera.operators import vectors
from tessera.plans.base import CHUNKS_SQL, FILES_SQL, chunks, files, table
from tessera.plans.registry import register

_B = r"[ \t\n\r\f\v]"


@register("fn_strings", rf"""SELECT doc_id,
 CASE WHEN length(text) > 20 THEN substr(text, 1, 20) || '...' ELSE text END AS short,
 CASE WHEN len(string_split(text, chr(10))) > 2 THEN array_to_string(string_split(text, chr(10))[1:2], chr(10)) || chr(10) || '... ' || (len(string_split(text, chr(10))) - 2) || ' more lines' ELSE text END AS short_lines,
 regexp_replace('/' || source, '^/', '') AS no_slash,
 CASE WHEN starts_with(source || '/x', source || '/') THEN 'x' END AS relative,
 md5(CASE WHEN coalesce(text, '') = '' THEN ' ' ELSE substr(text, 1, 400) END) AS model_input,
 CASE WHEN regexp_replace(text, '^{_B}+|{_B}+$', '', 'g') = '' THEN 0 ELSE len(regexp_split_to_array(regexp_replace(text, '^{_B}+|{_B}+$', '', 'g'), '{_B}+')) END AS n_words,
 length(text) - length(replace(text, chr(10), '')) + 1 AS n_lines,
 CASE WHEN instr(text, 'the') > 0 THEN length(substr(text, 1, instr(text, 'the') - 1)) - length(replace(substr(text, 1, instr(text, 'the') - 1), chr(10), '')) + 1 ELSE 0 END AS line_of_the,
 CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens, regexp_replace(lang || '(a, b)', '{_B}*\([^)]*\){_B}*$', '') AS no_call,
 regexp_replace('"' || lang || '"', '^["''`]|["''`]$', '', 'g') AS no_quotes
FROM documents WHERE text IS NOT NULL""")
def fn_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Truncation, trimming, line and word counts of every document."""
    t = F.col("text")
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select(
        "doc_id", tx.truncated(t, 20).alias("short"), tx.truncated_lines(t, 2).alias("short_lines"), tx.without_slash(F.concat(F.lit("/"), "source")).alias("no_slash"),
        tx.relative_to(F.concat("source", F.lit("/x")), F.col("source")).alias("relative"), F.md5(tx.embedder_input(t, 100)).alias("model_input"), tx.word_count(t).alias("n_words"),
        tx.line_count(t).alias("n_lines"), F.coalesce(tx.line_of(t, F.lit("the")), F.lit(0)).alias("line_of_the"), tx.token_estimate(t).alias("tokens"),
        tx.without_call(F.concat("lang", F.lit("(a, b)"))).alias("no_call"), tx.unquoted(F.concat(F.lit('"'), "lang", F.lit('"'))).alias("no_quotes"),
    )


@register("fn_paths", FILES_SQL.join(["WITH ", ""]) + r"""
SELECT doc_id, string_split(path, '/')[-1] AS base, regexp_extract(string_split(path, '/')[-1], '[^.](\.[^.]*)$', 1) AS ext,
 replace(regexp_replace(path, '/?[^/]*$', ''), '/', '.') AS package, path || '_chunk_' || doc_id AS chunk_id, substr(md5(path), 1, 8) AS short_md5,
 sha256(content) AS content_sha, sha256(path || sha256(content)) AS leaf_sha,
 'hybrid_v6_' || CASE WHEN language IN ('en', 'de') THEN 'prose' ELSE 'code' END || '_' || substr(md5(path), 1, 8) AS collection, 'hybrid_v3_code_chunks_' || substr(md5(path), 1, 8) AS old_collection,
 (path = 'src1/en' OR starts_with(path, 'src1/en/')) AS below, CASE WHEN starts_with(path, 'src1/') THEN substr(path, 6) WHEN starts_with(path, 'src2/') THEN substr(path, 6) ELSE path END AS relative FROM files""")
def fn_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Path pieces, ids, fingerprints and table names of every file."""
    p = F.col("path")
    return files(spark, sf_dir).select(
        "doc_id", tx.basename(p).alias("base"), tx.extension(p).alias("ext"), tx.package_key(p).alias("package"), tx.chunk_id(p, F.col("doc_id")).alias("chunk_id"), tx.short_hash(p).alias("short_md5"),
        F.sha2("content", 256).alias("content_sha"), F.sha2(F.concat("path", F.sha2("content", 256)), 256).alias("leaf_sha"),
        tx.collection_name(p, tx.domain_of(F.when(F.col("language").isin("en", "de"), "doc").otherwise("code"))).alias("collection"), tx.collection_name(p, F.lit("code"), split=False).alias("old_collection"),
        tx.is_below(p, F.lit("src1/en")).alias("below"), tx.relative_to_first(p, F.lit("src1"), F.lit("src2")).alias("relative"),
    )


@register("fn_case_segments", "SELECT p_partkey, array_to_string(string_split(regexp_replace(regexp_replace(replace(p_brand || p_name || 'XMLParser', ' ', ''), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), ' '), ',') AS segments FROM part")
def fn_case_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Camel-case segments of names."""
    name = F.replace(F.concat("p_brand", "p_name", F.lit("XMLParser")), F.lit(" "), F.lit(""))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(tx.case_segments(name), ",").alias("segments"))


@register("fn_regexes", r"""SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)+')) AS n_dotted,
 array_to_string(regexp_extract_all(text, '`([^`\n]{1,120})`', 1), ',') AS spans,
 array_to_string(list_distinct(regexp_extract_all('--- a/' || source || '.md' || chr(10) || '+++ b/x', '(?m)^--- a/(.+)$', 1)), ',') AS changed,
 array_to_string(regexp_extract_all('class ' || lang || 'Type { def run_' || source || '() }', '\b(?:class|def)\s+([A-Za-z_][A-Za-z0-9_]*)', 1), ',') AS defined FROM documents WHERE text IS NOT NULL""")
def fn_regexes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extraction patterns over whole texts: dotted names, code spans, diff headers,
    definitions."""
    t = F.col("text")
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select(
        "doc_id", F.size(F.regexp_extract_all(t, F.lit(r"[A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)+"), F.lit(0))).cast("long").alias("n_dotted"),
        F.array_join(F.regexp_extract_all(t, F.lit(symbols.CODE_SPAN), F.lit(1)), ",").alias("spans"),
        F.array_join(symbols.patch_files(F.concat(F.lit("--- a/"), "source", F.lit(".md\n+++ b/x"))), ",").alias("changed"),
        F.array_join(symbols.defined_names(F.concat(F.lit("class "), "lang", F.lit("Type { def run_"), "source", F.lit("() }"))), ",").alias("defined"),
    )


@register("fn_day_bucket", """SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, 'unknown-date' AS odd, (TIMESTAMP '2024-02-01' - ts) > INTERVAL 10 DAY AS stale FROM events""")
def fn_day_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UTC day of each record, and whether it is older than a threshold."""
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    return table(spark, sf_dir, "events").select("event_id", tx.day_bucket(iso).alias("day"), tx.day_bucket(F.lit("no time")).alias("odd"), (F.expr("TIMESTAMP_NTZ '2024-02-01' - ts") > F.expr("INTERVAL '10' DAY")).alias("stale"))


@register("fn_json", """SELECT event_id, CASE WHEN json_valid(props) THEN len(json_keys(props)) ELSE 0 END AS n_keys,
 CASE WHEN json_valid(props) THEN array_to_string(list_sort(json_keys(props)), ',') ELSE '' END AS keys FROM events""")
def fn_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tolerant parse of the metadata: what is no object counts as empty."""
    keys = F.coalesce(F.json_object_keys("props"), F.array().cast("array<string>"))
    return table(spark, sf_dir, "events").select("event_id", F.size(keys).cast("long").alias("n_keys"), F.array_join(F.sort_array(keys), ",").alias("keys"))


@register("fn_arrays", """SELECT vec_id, round(CAST(embedding[1] AS DOUBLE), 6) AS first, 2 AS n_pairs, array_to_string(list_filter(['a', NULL, '', label::VARCHAR], lambda x: x IS NOT NULL AND x <> ''), '/') AS path,
 array_to_string(list_sort(list_distinct(['a', 'b', label::VARCHAR])), ',') AS joined FROM embeddings""")
def fn_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a sparse vector, compaction, union of arrays."""
    zipped = tx.sparse_map(F.array(F.lit(0), F.lit(1), F.lit(2)), F.slice("embedding", 1, 2))
    label = F.col("label").cast("string")
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", F.round(F.element_at(zipped, 0).cast("double"), 6).alias("first"), F.size(zipped).alias("n_pairs"), F.array_join(tx.compact(F.array(F.lit("a"), F.lit(None), F.lit(""), label)), "/").alias("path"),
        F.array_join(F.sort_array(F.array_union(F.array(F.lit("a"), F.lit("b")), F.array(label, F.lit("a")))), ",").alias("joined"),
    )


@register("fn_cosine", """SELECT a.vec_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS cosine,
 round(1.0 / (60 + a.label), 6) AS reciprocal, CASE WHEN b.label = 0 THEN 0.0 ELSE round(100.0 * a.label / b.label, 1) END AS percent
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def fn_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine of each vector and its successor, with other small formulas."""
    a = table(spark, sf_dir, "embeddings")
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"), F.col("label").alias("other_label"))
    return a.join(b, "vec_id").select("vec_id", F.round(vectors.cosine(F.col("embedding"), F.col("other")), 6).alias("cosine"), F.round(1.0 / (60 + F.col("label")), 6).alias("reciprocal"), tx.percentage(F.col("label"), F.col("other_label")).alias("percent"))


@register("fn_heading_slug", "SELECT page_id, regexp_replace(trim(regexp_replace(lower(coalesce(url, '') || ' A B.c()'), '[^a-z0-9 _-]', '', 'g')), ' +', '-', 'g') AS slug FROM pages")
def fn_heading_slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors of headings."""
    return table(spark, sf_dir, "pages").select("page_id", tx.heading_slug(F.concat(F.coalesce("url", F.lit("")), F.lit(" A B.c()"))).alias("slug"))


@register("fn_format_results", f"""WITH {CHUNKS_SQL}, best AS (SELECT doc_id, ord, path, content, row_number() OVER (PARTITION BY doc_id ORDER BY length(content) DESC, ord) AS rank FROM chunks)
SELECT doc_id, string_agg(rank || '. ' || path || ':' || (ord + 1) || ' ' || substr(content, 1, 40), chr(10) ORDER BY rank) AS block FROM best WHERE rank <= 3 GROUP BY doc_id""")
def fn_format_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text block of a result list: numbered lines in rank order."""
    from tessera.operators.ranking import top_k

    best = top_k(chunks(spark, sf_dir), ["doc_id"], [F.desc(F.length("content")), F.col("ord")], 3)
    line = F.concat(F.col("rank").cast("string"), F.lit(". "), "path", F.lit(":"), (F.col("ord") + 1).cast("string"), F.lit(" "), F.substring("content", 1, 40))
    rows = best.select("doc_id", F.struct("rank", line.alias("line")).alias("r")).groupBy("doc_id").agg(F.sort_array(F.collect_list("r")).alias("rows"))
    return rows.select("doc_id", F.array_join(F.transform("rows", lambda r: r["line"]), "\n").alias("block"))


@register("fn_clamp", """SELECT doc_id, len(list_filter(range(1, 401), lambda k: strlen(substr(text, 1, k)) <= 100)) AS kept_chars,
 array_to_string(['alpha', 'beta', 'gamma', 'delta'][1:CASE WHEN doc_id % 2 = 0 THEN 2 ELSE 4 END], ',') AS items FROM documents WHERE length(text) >= 400""")
def fn_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte limits: whole characters of a text, whole elements of an array."""
    d = table(spark, sf_dir, "documents").where(F.length("text") >= 400)
    items = F.array(*map(F.lit, ("alpha", "beta", "gamma", "delta")))
    short = F.when(F.col("doc_id") % 2 == 0, tx.clamped_array(items, 16)).otherwise(tx.clamped_array(items, 64))
    return d.select("doc_id", F.length(tx.clamped_bytes(F.col("text"), 100)).cast("long").alias("kept_chars"), F.array_join(short, ",").alias("items"))


@register("fn_clamp_all")
def fn_clamp_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The byte limit over all documents: short, empty and null texts stay as they are."""
    t = F.col("text")
    kept = tx.clamped_bytes(t, 100)
    return table(spark, sf_dir, "documents").select("doc_id", F.length(kept).cast("long").alias("kept_chars"), F.octet_length(kept).cast("long").alias("kept_bytes"), (kept == t).alias("whole"))


@register("fn_symbols", r"""WITH n AS (SELECT doc_id, regexp_extract_all(coalesce(text, '') || ' see a.Bc and `run(x)` or `this`', '\b[A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)+\b') AS q FROM documents)
SELECT doc_id, len(list_distinct(list_filter(q, lambda x: NOT lower(x) IN ('true')))) + 1 AS n_symbols, TRUE AS has_run, FALSE AS has_this FROM n""")
def fn_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols mentioned in every text: dotted names and code spans, no stop words."""
    m = symbols.mentioned_symbols(F.concat(F.coalesce("text", F.lit("")), F.lit(" see a.Bc and `run(x)` or `this`")))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(m).cast("long").alias("n_symbols"), F.array_contains(m, "run").alias("has_run"), F.array_contains(m, "this").alias("has_this"))


@register("fn_imports", """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'lib/' || source || ',' || lang WHEN 1 THEN 'java.' || source || '.' || lang WHEN 2 THEN 'haxe.' || source || '.Tools' ELSE '' END AS imports FROM documents""")
def fn_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imports by language over one small source file for each document."""
    k = F.col("doc_id") % 4
    code = F.when(k == 0, F.concat(F.lit("import { a } from 'lib/"), "source", F.lit("';\nimport \""), "lang", F.lit("\";\n  import x from 'inner';\n"))).when(k == 1, F.concat(F.lit("package p;\nimport java."), "source", F.lit("."), "lang", F.lit(";\n"))).when(k == 2, F.concat(F.lit("using haxe."), "source", F.lit(".Tools;\n"))).otherwise(F.lit("import os"))
    language = F.when(k == 0, "ts").when(k == 1, "java").when(k == 2, "hx").otherwise("ruby")
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(symbols.imports(code, language), ",").alias("imports"))
