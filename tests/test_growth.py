"""What queries hold and send must not grow faster than their input: pairs are never rows."""

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera.operators import blocks, vectors
from tessera.plans.base import table
from tessera.plans.registry import load

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_inverted_file_scores_in_blocks(spark, monkeypatch):
    e = table(spark, SF, "embeddings").select(F.col("vec_id").alias("item"), F.col("embedding").alias("v"))
    q = e.where("item % 5 = 0").withColumnRenamed("item", "query_id")
    want = {tuple(r) for r in vectors.exact_knn(e, q, 4).collect()}
    monkeypatch.setattr(vectors, "VECTOR_BLOCK", 3)
    index = vectors.InvertedFile(e, lists=5)
    got = index.search(q, 4, probes=5)
    assert "Join" not in plan(got)
    assert {tuple(r) for r in got.collect()} == want


def plain(rows):
    return sorted(tuple(repr(round(x, 6) + 0.0) if isinstance(x, float) else str(x) for x in r) for r in rows)


def by_sql(spark, sf, names, query):
    con = duckdb.connect()
    for t in names:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet/*.parquet'")
    got = load()[0][query](spark, f"file://{sf}")
    want = con.sql(load()[1][query])
    return plain(got.select(*want.columns).collect()), plain(want.fetchall()), got


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Documents that share an id, have none or no text, and many copies of one."""
    folder = tmp_path_factory.mktemp("odd")
    d = table(spark, SF, "documents")
    same = d.where("doc_id % 9 = 0").withColumn("text", F.concat("text", F.lit(" "), F.reverse("text")))
    lost = d.limit(3).withColumn("doc_id", F.lit(None).cast("long"))
    empty = d.limit(3).withColumn("doc_id", F.col("doc_id") + 10**6).withColumn("text", F.lit(None).cast("string"))
    copies = d.where("doc_id = 7").withColumn("doc_id", F.explode(F.sequence(F.lit(10**7), F.lit(10**7 + 700))))
    d.unionByName(same).unionByName(lost).unionByName(empty).unionByName(copies).write.parquet(f"file://{folder}/documents.parquet")
    for name in ("benchmark", "embeddings"):
        table(spark, SF, name).write.parquet(f"file://{folder}/{name}.parquet")
    return folder


@pytest.mark.parametrize("query", ["bm25_search", "hybrid_search_rrf", "weighted_channel_fusion", "outer_weighted_rrf", "comparison_fanout"])
def test_keyword_lists_keep_no_pairs(spark, query, odd, monkeypatch):
    monkeypatch.setattr(blocks, "ITEMS", 7)
    monkeypatch.setattr(blocks, "QUERIES", 5)
    monkeypatch.setattr(blocks, "CELLS", 500)
    got, want, _ = by_sql(spark, odd, ["documents", "benchmark"], query)
    assert got == want
    assert "Explode" not in plan(load()[0][query](spark, SF)) and "explode" not in plan(load()[0][query](spark, SF))


@pytest.mark.parametrize("query", ["learned_sparse", "hybrid_three_channels"])
def test_sparse_lists_keep_no_pairs(spark, query, odd, monkeypatch):
    monkeypatch.setattr(blocks, "ITEMS", 7)
    monkeypatch.setattr(blocks, "QUERIES", 5)
    got, want, found = by_sql(spark, odd, ["documents", "embeddings"], query)
    assert got == want
    assert "explode(weights" not in plan(found)


def test_comparison_search_keeps_no_pairs(spark, odd):
    got, want, _ = by_sql(spark, odd, ["documents", "benchmark"], "comparison_search")
    assert got == want
    assert "explode" not in plan(load()[0]["comparison_search"](spark, SF)).lower()


def test_engine_search_has_no_limit_of_chunks(spark, monkeypatch):
    from tessera import engine

    monkeypatch.setattr(engine, "MOST_CHUNKS", 3)
    for query, names in (("engine_search", "documents benchmark"), ("engine_lifecycle", "documents")):
        con = duckdb.connect()
        for t in names.split():
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
        want = con.sql(load()[1][query])
        assert plain(load()[0][query](spark, SF).select(*want.columns).collect()) == plain(want.fetchall())


def brute_two_hops(edges):
    out = {}
    for a, b in edges:
        out.setdefault(a, set()).add(b)
    rows = set()
    for s, first in out.items():
        one = first - {s}
        two = set().union(*(out.get(n, set()) for n in first)) - first - {s}
        if one or two:
            rows.add((s, len(one), len(two), sum(one | two)))
    return rows


def test_two_hops_send_lists(spark, monkeypatch):
    from tessera.operators import graph

    edges = [(k % 37, (k * k + 3 * k) % 41) for k in range(400)] + [(5, k) for k in range(300)] + [(99, 99), (98, 99), (97, -(1 << 62)), (-(1 << 62), 1 << 62)]
    df = spark.createDataFrame([*edges, (None, 1), (1, None)], "src long, dst long")
    monkeypatch.setattr(graph, "BLOCK", 1)
    monkeypatch.setattr(graph, "LISTED", 20)
    assert {tuple(r) for r in graph.two_hops(df).collect()} == brute_two_hops(edges)
    assert "Aggregate [seed" not in plan(load()[0]["two_hop_references"](spark, SF))


def test_bridge_candidates_are_made_where_their_query_is(spark, monkeypatch):
    from tessera.operators import graph
    from tessera.plans.graph_queries import bridge_buckets, bridge_candidates

    c = bridge_candidates(spark, SF)
    assert "Join" not in plan(c)
    lines = table(spark, SF, "lineitem").collect()
    made = [(x.l_orderkey, x.l_linenumber, k, n, (x.l_partkey + n * n) % 200) for x in lines for k in range(3) for n in range(6)]
    assert sorted((r.query_id, r.seed_rank, r.axis, r.pos, r.chunk_id) for r in c.collect()) == sorted(made)
    want = {tuple(r) for r in graph.bridge_pool(c).collect()}
    monkeypatch.setattr(graph, "BLOCK", 50)
    assert {tuple(r) for r in graph.bridge_pool(c, dealt=True).collect()} == want
    assert {tuple(r) for r in graph.bridge_pool(bridge_buckets(spark, SF), dealt=True).collect()} == want
    assert {tuple(r) for r in graph.bridge_pool(c.withColumn("bucket", F.when(F.col("bucket") != "super:1", F.col("bucket"))).orderBy(F.rand(1)), 2, 9).collect()} == greedy(c, 2, 9)


def greedy(candidates, per_bucket, cap):
    rows, out = {}, set()
    for r in candidates.withColumn("bucket", F.when(F.col("bucket") != "super:1", F.col("bucket"))).collect():
        rows.setdefault(r.query_id, []).append(r)
    for q, own in rows.items():
        seen, used, n = {r.chunk_id for r in own if r.is_seed}, {}, 0
        for r in sorted((r for r in own if not r.is_seed), key=lambda r: (r.seed_rank, r.axis, r.bucket is not None, r.bucket, r.pos, r.chunk_id)):
            key = (r.seed_rank, r.axis, r.bucket)
            if n < cap and r.chunk_id not in seen and used.get(key, 0) < per_bucket:
                seen.add(r.chunk_id)
                used[key] = used.get(key, 0) + 1
                n += 1
                out.add((q, n, r.chunk_id, r.axis))
    return out


def test_symbol_expansion_meets_the_mentions_it_needs(spark):
    from tessera.operators import graph

    seeds = [(q, r, (q * 7 + r * 3) % 60, ["code", "doc", "docstring"][(q + r) % 3], f"s{(q + r * r) % 5}", [(0, f"d{r % 4}")]) for q in range(12) for r in range(1 + q)]
    symbols = [(f"d{k}", 100 + k) for k in range(4)]
    mentions = [(f"s{k % 5}", k) for k in range(400)] + [(f"s{k % 3}", k) for k in range(90)] + [("s1", k) for k in range(5)]
    s = spark.createDataFrame(seeds, "query_id long, rank long, chunk_id long, content_type string, symbol string, relations array<struct<kind:int,symbol:string>>")
    y, m = spark.createDataFrame(symbols, "symbol string, chunk_id long"), spark.createDataFrame(mentions, "symbol string, chunk_id long")
    for cap in (1, 6, 50):
        want, own = set(), {}
        for q, r, _, kind, symbol, relations in seeds:
            at = own.setdefault(q, {})
            for c, spot in ([(dict(symbols)[relations[0][1]], (r, 0))] if kind != "docstring" else []) + ([(c, (r, 99)) for x, c in mentions if x == symbol] if kind == "code" else []):
                at[c] = min(at.get(c, spot), spot)
        for q, at in own.items():
            free = sorted((spot, c) for c, spot in at.items() if c not in {x[2] for x in seeds if x[0] == q})
            want |= {(q, k + 1, c) for k, (_, c) in enumerate(free[:cap])}
        assert {tuple(r) for r in graph.symbol_expansion(s, y, m, cap).collect()} == want
    need = graph._mentioned(s, m, 6).groupBy("query_id").count().collect()
    assert max(r["count"] for r in need) < 100


@pytest.mark.parametrize("query", ["neighbour_types", "neighbour_selection", "prose_graph_stats"])
def test_edges_of_a_heading_are_not_made(spark, query, odd, tmp_path, monkeypatch):
    from tessera.operators import graph

    spark.read.parquet(f"file://{odd}/documents.parquet").where("doc_id IS NOT NULL").write.parquet(f"file://{tmp_path}/documents.parquet")

    monkeypatch.setattr(graph.tasks_for, "__defaults__", (100,))
    monkeypatch.setattr(graph, "heading_edges", None)
    got, want, found = by_sql(spark, tmp_path, ["documents"], query)
    assert got == want
    assert found.sparkSession.conf.get("spark.sql.shuffle.partitions") == "4" and "RepartitionByExpression" in plan(found)


def test_batches_of_texts_are_bounded(spark):
    from tessera.chunking.table import chunked
    from tessera.sources import models

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    files = spark.createDataFrame([("a.md", "markdown", "x")], "path string, language string, content string")
    for make in (lambda: chunked(files), lambda: models.Embedder().apply(files, "path", "content")):
        spark.conf.unset(name)
        make()
        assert int(spark.conf.get(name).rstrip("bB")) == blocks.TRANSFER_BYTES
        spark.conf.set(name, "1000")
        make()
        assert spark.conf.get(name).rstrip("bB") == "1000"
        spark.conf.unset(name)
