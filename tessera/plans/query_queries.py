"""Query understanding over the shaped queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import query_text as qt
from tessera.plans.base import SHAPED_SQL, shaped_queries, table
from tessera.plans.registry import register

# The same shapes for RE2, whose word border is ASCII.
_CAMEL = r"\b[a-z]+[A-Z][a-zA-Z0-9]*\b"
_PASCAL = r"\b[A-Z][a-z]+[A-Z][a-zA-Z0-9]*\b"
_SNAKE = r"\b[a-z][a-z0-9]*_[a-z0-9_]+\b"
_QUALIFIED = r"\b[A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)+\b"
_CODE = [_CAMEL, _PASCAL, _SNAKE, _QUALIFIED, r"@:[A-Za-z_][A-Za-z0-9_]*", r"(?:^|\s)@[A-Za-z_][A-Za-z0-9_]*", r"[A-Za-z_][A-Za-z0-9_]*\s*\(", r"::|->|=>|<<|>>|\+\+|--|&&|\|\|", r"(?:^|\s)[A-Z][a-zA-Z0-9_]*<[^>]+>", r"[A-Za-z_][A-Za-z0-9_]*<[A-Z][A-Za-z0-9_,\s]*>"]
_PLAIN = "len(list_filter(regexp_extract_all({q}, '\\b[A-Za-z]{{3,}}\\b'), lambda w: NOT regexp_matches(w, '" + _CAMEL + "') AND NOT regexp_matches(w, '" + _PASCAL + "') AND NOT (regexp_matches(w, '^[A-Z]') AND len(regexp_extract_all({q}, '\\b[A-Za-z]{{3,}}\\b')) <= 2)))"
_SIGNALS = f"""signals AS (SELECT query_id, query, ({" OR ".join(f"regexp_matches(query, '{p}')" for p in _CODE)}) AS code, {_PLAIN.replace("{{", "{").replace("}}", "}").replace("{q}", "query")} AS plain,
 ({" OR ".join(f"regexp_matches(query, '{p}')" for p in _CODE[:4])}) AS token, {_PLAIN.replace("{{", "{").replace("}}", "}").replace("{q}", f"regexp_replace(query, '{_QUALIFIED}', ' ', 'g')")} AS plain_rest FROM shaped),
forms AS (SELECT *, plain >= 3 AS doc, CASE WHEN token AND plain_rest < 3 THEN 'identifier' WHEN NOT token AND plain_rest >= 3 THEN 'descriptive' ELSE 'mixed' END AS form FROM signals)"""


@register("query_intent", f"""WITH {SHAPED_SQL}, {_SIGNALS} SELECT query_id, query, code AS code_signal, doc AS doc_signal, plain AS plain_words, form AS lexical_form,
 CASE WHEN code AND NOT doc THEN 1.5 ELSE 1.0 END::DOUBLE AS code_weight, CASE WHEN doc AND NOT code THEN 1.3 ELSE 1.0 END::DOUBLE AS doc_weight FROM forms""")
def query_intent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals, plain words, lexical form and pool weights of each query."""
    q = F.col("query")
    code, doc = qt.intent_weights(qt.intent(q))
    return shaped_queries(spark, sf_dir).select("query_id", "query", qt.code_signal(q).alias("code_signal"), qt.doc_signal(q).alias("doc_signal"), qt.plain_words(q).alias("plain_words"), qt.lexical_form(q).alias("lexical_form"), code.alias("code_weight"), doc.alias("doc_weight"))


@register("query_route", f"""WITH {SHAPED_SQL}, {_SIGNALS} SELECT query_id, form AS lexical_form,
 CASE WHEN query_id % 5 = 0 THEN 'concept' WHEN regexp_matches(query, '(?i)\\bvs\\b|\\bversus\\b|\\bcompared to\\b|\\bdifference between\\b|\\bcompare\\s+\\w+\\s+(?:and|to)\\b') THEN 'comparison' ELSE 'single' END AS shape,
 CASE form WHEN 'identifier' THEN 0.6 ELSE 1.0 END::DOUBLE AS dense, CASE form WHEN 'identifier' THEN 0.8 WHEN 'descriptive' THEN 0.5 ELSE 0.6 END::DOUBLE AS learned, CASE form WHEN 'identifier' THEN 1.0 WHEN 'descriptive' THEN 0.3 ELSE 0.4 END::DOUBLE AS keyword FROM forms""")
def query_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shape (a valid hint wins) and channel weights of each query."""
    q, form = F.col("query"), qt.lexical_form(F.col("query"))
    hint = F.when(F.col("query_id") % 5 == 0, "concept").when(F.col("query_id") % 5 == 1, "no shape")
    dense, learned, keyword = qt.channel_weights(form)
    return shaped_queries(spark, sf_dir).select("query_id", form.alias("lexical_form"), qt.shape(q, hint).alias("shape"), dense.alias("dense"), learned.alias("learned"), keyword.alias("keyword"))


@register("query_comparison", f"""WITH {SHAPED_SQL} SELECT query_id, regexp_matches(query, '(?i)\\bvs\\b|\\bdifference between\\b') AS is_comparison,
 CASE WHEN query_id % 8 = 3 THEN string_split(query, ' vs ')[1] WHEN query_id % 8 = 4 THEN regexp_extract(query, 'between (.+?) and (.+)', 1) END AS left_side,
 CASE WHEN query_id % 8 = 3 THEN string_split(query, ' vs ')[2] WHEN query_id % 8 = 4 THEN regexp_extract(query, 'between (.+?) and (.+)', 2) END AS right_side FROM shaped""")
def query_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two sides of comparisons."""
    q = F.col("query")
    sides = qt.comparison_sides(q)
    return shaped_queries(spark, sf_dir).select("query_id", qt.is_comparison(q).alias("is_comparison"), sides["left"].alias("left_side"), sides["right"].alias("right_side"))


_NAME = r"[A-Za-z_][A-Za-z0-9_]*"
_WHOLE = "(" + " OR ".join(f"regexp_matches(query, '^{_NAME}(?:{sep}{_NAME})+$')" for sep in (r"\.", "::", "/")) + ")"
_LAST = r"regexp_split_to_array(query, '\.|::|/')"


@register("query_names", f"""WITH {SHAPED_SQL} SELECT query_id, CASE WHEN {_WHOLE} THEN {_LAST}[-2] END AS class_name, CASE WHEN {_WHOLE} THEN {_LAST}[-1] END AS method_name,
 array_to_string(regexp_extract_all(query, '[\\p{{L}}_][\\p{{L}}\\p{{N}}_]*'), ',') AS tokens FROM shaped""")
def query_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Qualified names and code tokens."""
    q = F.col("query")
    name = qt.qualified_name(q)
    return shaped_queries(spark, sf_dir).select("query_id", name["class_name"].alias("class_name"), name["method_name"].alias("method_name"), F.array_join(qt.code_tokens(q), ",").alias("tokens"))


@register("query_single_symbol", f"""WITH {SHAPED_SQL}, vocab AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS name FROM documents),
t AS (SELECT query_id, unnest(regexp_extract_all(query, '[\\p{{L}}_][\\p{{L}}\\p{{N}}_]*')) AS name, generate_subscripts(regexp_extract_all(query, '[\\p{{L}}_][\\p{{L}}\\p{{N}}_]*'), 1) AS pos FROM shaped),
r AS (SELECT query_id, name, row_number() OVER (PARTITION BY query_id ORDER BY length(name) DESC, CASE WHEN regexp_matches(name, '^[A-Z]') THEN 0 ELSE 1 END, pos) AS rn FROM t WHERE length(name) >= 4 AND name IN (SELECT name FROM vocab))
SELECT query_id, name AS symbol FROM r WHERE rn = 1""")
def query_single_symbol(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most telling token of each query that the corpus knows."""
    from tessera.operators.ranking import best

    vocabulary = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("name"))
    t = shaped_queries(spark, sf_dir).select("query_id", F.posexplode(qt.code_tokens(F.col("query"))).alias("pos", "name")).where(F.length("name") >= 4)
    known = t.join(vocabulary.join(t.select("name").distinct(), "name", "left_semi").distinct(), "name", "left_semi")
    return best(known, ["query_id"], [F.desc(F.length("name")), F.when(F.col("name").rlike("^[A-Z]"), 0).otherwise(1), F.col("pos")]).select("query_id", F.col("name").alias("symbol"))


@register("query_rewrite", f"""WITH {SHAPED_SQL}, parts AS (SELECT query_id, query, CASE query_id % 8 WHEN 1 THEN regexp_extract_all(query, '^[a-z]+|[A-Z][a-z]*') WHEN 5 THEN string_split(query, '_') END AS p FROM shaped)
SELECT query_id, CASE WHEN query_id % 8 = 6 THEN 'initialize,initializer,configuration' WHEN query_id % 8 = 1 THEN lower(array_to_string(p, '_')) || ',' || lower(array_to_string(p, '-')) || ',' || upper(query[1]) || query[2:]
 WHEN query_id % 8 = 5 THEN array_to_string(p, '-') || ',' || p[1] || upper(p[2][1]) || p[2][2:] || ',' || upper(p[1][1]) || p[1][2:] || upper(p[2][1]) || p[2][2:] ELSE '' END AS extras FROM parts WHERE query_id % 8 NOT IN (0, 2, 3, 4, 7)""")
def query_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extra words of the keyword channel for named and abbreviated queries."""
    q = shaped_queries(spark, sf_dir).where((F.col("query_id") % 8).isin(1, 5, 6))
    return q.select("query_id", F.array_join(qt.sparse_extras(F.col("query")), ",").alias("extras"))


@register("query_rewrite_all")
def query_rewrite_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extra words of the keyword channel for queries of every shape."""
    return shaped_queries(spark, sf_dir).select("query_id", "query", F.array_join(qt.sparse_extras(F.col("query")), ",").alias("extras"))


@register("query_gates", f"""WITH {SHAPED_SQL}, {_SIGNALS}, vocab AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS name FROM documents)
SELECT query_id, code AND {_WHOLE} AS bypass, code AND {_WHOLE} AND {_LAST}[-2] IN (SELECT name FROM vocab) AS refs_pool FROM forms""")
def query_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which queries skip the reranker, and which open the symbol pool."""
    q = shaped_queries(spark, sf_dir)
    name = qt.qualified_name(F.col("query"))
    q = q.select("query_id", qt.code_signal(F.col("query")).alias("code"), name.isNotNull().alias("whole"), name["class_name"].alias("name"))
    known = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("name"))
    known = known.join(q.select("name").distinct(), "name", "left_semi").distinct().withColumn("known", F.lit(True))
    return q.join(known, "name", "left").select("query_id", (F.col("code") & F.col("whole")).alias("bypass"), (F.col("code") & F.col("whole") & F.coalesce("known", F.lit(False))).alias("refs_pool"))
