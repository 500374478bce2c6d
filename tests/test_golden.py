"""Stated cases of the operators that SQL doesn't express, and of query understanding."""

import collections

import pytest
from pyspark.sql import functions as F

from tessera.chunking import code, prose, structure
from tessera.chunking.table import chunked
from tessera.functions import query_text as qt
from tessera.functions import symbols
from tessera.functions import text as tx
from tessera.operators import filters, graph, joins, ranking, vectors
from tessera.plans.base import table
from tessera.plans.catalog_queries import scratch
from tessera.plans.graph_queries import bridge_candidates
from tessera.plans.registry import load
from tessera.sources import models, readers, store

SF = "/root/testdata/sf0.001"


def one(spark, column, text):
    df = spark.createDataFrame([(text,)], "q string")
    return df.select(column(F.col("q")).alias("x")).first().x


def many(spark, column, cases):
    df = spark.createDataFrame(list(enumerate(cases)), "k int, q string")
    return [r.x for r in df.select("k", column(F.col("q")).alias("x")).orderBy("k").collect()]


def test_lexical_form(spark):
    cases = ["Std.parseInt", "how to read a file line by line", "read file", "", None, "parse_int", "what does Std.parseInt return for bad input"]
    assert many(spark, qt.lexical_form, cases) == ["identifier", "descriptive", "mixed", "mixed", "mixed", "identifier", "mixed"]


def test_signals(spark):
    assert many(spark, qt.code_signal, ["foo(x)", "a::b", "@:meta", "plain words", "", "Array<Int>"]) == [True, True, True, False, False, True]
    assert many(spark, qt.plain_words, ["Reflect", "how does Reflect work", "camelCase word here"]) == [0, 4, 2]


def test_qualified_names(spark):
    got = many(spark, qt.qualified_name, ["Foo/Bar/baz", "a.b", "a..b", "Foo.bar::baz", "parseInt", " A::b ", "a. b"])
    assert [tuple(x) if x else None for x in got] == [("Bar", "baz"), ("a", "b"), None, None, None, ("A", "b"), None]


def test_comparisons(spark):
    cases = ["Bytes vs BytesBuffer", "compared to last year", "difference between map and flat map", "compare Int with Float", "чем Map отличается от List", "Map против List", "разница между A и B", "a b c d e f g vs h", "nothing", ""]
    got = [tuple(x) if x else None for x in many(spark, qt.comparison_sides, cases)]
    assert got == [("Bytes", "BytesBuffer"), None, ("map", "flat map"), ("Int", "Float"), ("Map", "List"), ("Map", "List"), ("A", "B"), None, None, None]
    assert many(spark, qt.is_comparison, ["compared to last year", "a vs. b", "versus", "previous"]) == [True, True, True, False]


def test_rewriting(spark):
    assert many(spark, qt.case_variants, ["parseConfig", "parse_config", "ParseConfig", "parse-config", "word"]) == [["parse_config", "parse-config", "ParseConfig"], ["parse-config", "parseConfig", "ParseConfig"], ["parse_config", "parse-config", "parseConfig"], ["parse_config", "parseConfig", "ParseConfig"], []]
    assert many(spark, qt.abbreviation_forms, ["cfg config flag", "auth authentication", "init DB", "none"]) == [["configuration"], [], ["initialize", "initializer", "database"], []]


def test_small_functions(spark):
    assert many(spark, tx.heading_slug, ["Sys.exec()", "Two Words"]) == ["sysexec", "two-words"]
    assert many(spark, tx.package_key, ["a/b/C.hx", "C.hx", "a\\b\\C.hx"]) == ["a.b", None, "a.b"]
    assert many(spark, lambda q: tx.clamped_bytes(q, 5), ["aééé", "abcdefg", "abc", "😀😀"]) == ["aéé", "abcde", "abc", "😀"]
    assert many(spark, lambda q: F.array_join(tx.case_segments(q), " "), ["parseXMLFile", "word"]) == ["parse XML File", "word"]
    assert many(spark, tx.day_bucket, ["2024-01-02T03:04:05Z", "2024-01-02 10:00:00", "never"]) == ["2024-01-02", "2024-01-02", "unknown-date"]
    assert many(spark, symbols.mentioned_symbols, ["use a.B and `run(x)` or `this` and a.B", ""]) == [["a.B", "run"], []]


def test_limits(spark):
    df = spark.createDataFrame([(k, v) for k, v in enumerate([None, 0.0, -3.0, float("nan"), 3.9, 1000.0])], "k int, v double")
    assert [r.x for r in df.select("k", ranking.clamped_limit(F.col("v")).alias("x")).orderBy("k").collect()] == [10, 10, 10, 10, 3, 50]


def test_filter_language(spark):
    df = spark.createDataFrame([("a", 1, 'q"t'), ("ab", 5, "x"), (None, 9, "y")], "s string, n int, t string")
    keep = lambda f: sorted(r.n for r in df.where(filters.compiled(f)).collect())
    assert keep("") == [1, 5, 9]
    assert keep('s == "a" or n >= 9') == [1, 9]
    assert keep('s in ["a", "ab"] and not n <= 1') == [5]
    assert keep('s like "a%" AND (n < 3 or n > 4)') == [1, 5]
    assert keep(f't == "{filters.escaped(chr(113) + chr(34) + "t")}"') == [1]
    assert keep("s in []") == []
    for bad in ("s ==", "s = 1", 'n in ["a"', "(n < 3", "n < 3 n > 4", "s ~ 1"):
        with pytest.raises(ValueError):
            filters.compiled(bad)


def test_ignore_patterns(spark):
    paths = ["Library/a.hx", "x/Library/a.hx", ".git/c", "a/b.log", "a/b.txt", "docs/api/x.md"]
    kept = lambda p: [q for q, out in zip(paths, many(spark, lambda c: filters.ignored(c, p), paths), strict=True) if not out]
    assert kept(["/Library/"]) == ["x/Library/a.hx", "a/b.log", "a/b.txt", "docs/api/x.md"]
    assert kept(["Library/", "*.log"]) == ["a/b.txt", "docs/api/x.md"]
    assert kept(["docs/*"]) == ["Library/a.hx", "x/Library/a.hx", "a/b.log", "a/b.txt"]
    with pytest.raises(ValueError):
        filters.valid_extensions(["md"])


def test_canonical_dedup(spark):
    rows = [("q", "parse", "std/Std.hx"), ("q", "parse", "std/js/_std/Std.hx"), ("q", "parse", "std/cpp/_std/Std.hx"), ("q", "only", "a/_std/B.hx"), ("q", "only", "b/_std/B.hx"), ("q", None, "x/_std/C.hx")]
    got = ranking.canonical(spark.createDataFrame(rows, "q string, symbol string, path string"), ["q"], "symbol", "path")
    assert sorted(r.path for r in got.collect()) == ["a/_std/B.hx", "b/_std/B.hx", "std/Std.hx", "x/_std/C.hx"]


def test_reserved_slots(spark):
    rows = [("q", k, "comparisonBridge" if k % 3 else "other") for k in range(1, 8)]
    got = ranking.reserved(spark.createDataFrame(rows, "query_id string, rank int, pool string"), ["query_id"], 3, 10)
    assert sorted(r.rank for r in got.where("reserved").collect()) == [1, 2, 4]


def test_markdown():
    text = "intro\n# One\ntext\n## Two\n```py x\ncode\n```\nafter\n#### deep\nThree\n=====\nlast\n~~~\nopen"
    got = [(c.content_type, c.heading_path, c.start_line, c.language) for c in prose.markdown(text)]
    assert got == [("doc", [], 1, ""), ("doc", ["One"], 2, ""), ("doc", ["One", "Two"], 4, ""), ("code_example", ["One", "Two"], 6, "py"), ("doc", ["One", "Two"], 8, ""), ("doc", ["Three"], 10, ""), ("code_example", ["Three"], 14, "")]
    assert [c.content for c in prose.markdown("")] == [""]
    long = prose.markdown("# T\n" + "word " * 30 + "\n" + ("line of text\n" * 100), 200)
    assert all(len(c.content) <= 200 for c in long) and len(long) > 5


def test_rst():
    got = [(c.content_type, c.heading_path, c.content) for c in prose.rst("Top\n===\nhello\n\n.. code:: py\n   :linenos:\n\n   x = 1\n\nSub\n---\nbye")]
    assert got == [("doc", ["Top"], "Top\n===\nhello\n"), ("code_example", ["Top"], "x = 1"), ("doc", ["Top", "Sub"], "Sub\n---\nbye")]


def test_code_chunks():
    py = code.code("import os\n\nclass A:\n    @x\n    def f(self):\n        pass\n\ndef g():\n    def h():\n        pass\n", "py")
    assert [(c.symbol, c.kind, c.parent, c.start_line, c.end_line) for c in py] == [("A", "class", "", 3, 6), ("f", "method", "A", 4, 6), ("g", "function", "", 8, 10), ("h", "function", "", 9, 10)]
    ts = code.code("class A {\n  run(x) { return '}'; } // {\n}\nfunction top() {\n  if (a) { b(); }\n}\n", "ts")
    assert [(c.symbol, c.kind, c.parent) for c in ts] == [("A", "class", ""), ("run", "method", "A"), ("top", "function", "")]
    assert [c.content for c in code.code("x = 1", "py")] == ["x = 1"]
    assert code.code("def (", "py")[0].content == "def ("
    gaps = code.code("import os\n\ndef f():\n    pass\n\nf()\n", "py", gaps=True)
    assert [(c.symbol, c.start_line, c.end_line) for c in gaps] == [("", 1, 2), ("f", 3, 4), ("", 5, 7)]


def test_recursive_chunks():
    text = "\n\n".join(f"paragraph {k} " + "word " * 30 for k in range(40))
    got = code.recursive(text, None, 500, 100)
    assert all(len(c.content) <= 500 for c in got)
    assert all(c.content in text for c in got)
    for k in range(40):
        assert any(f"paragraph {k} " in c.content for c in got)
    assert code.recursive("", None) == []
    assert all(len(c.content) <= 50 for c in code.recursive("x" * 500, None, 50, 10))
    lines = code.browser("\n".join(f"line number {k}" for k in range(200)), 300, 60)
    assert lines[0].start_line == 1 and lines[-1].end_line == 200 and lines[1].start_line <= lines[0].end_line


def test_structure():
    assert structure.python_imports("import a, b.c\nfrom m import x\nfrom . import y\nfrom ..p import z\nimport a") == ["a", "b.c", "m.x", ".y", "..p.z"]
    assert [structure.type_name(t) for t in ("a.b.C<D<E>>", "Map<K, V>", "two words", "A>", "x")] == ["C", "Map", None, None, "x"]
    assert structure.heritage("export class A<T> extends p.B<T> implements I<A, B>, J {}", "ts") == [("A", "B", ["I", "J"])]
    assert structure.heritage("class A(m.Base, Mix):\n  pass\nclass B: pass", "py") == [("A", "Base", []), ("B", None, [])]
    assert structure.heritage("class A extends B implements I implements J {", "hx") == [("A", "B", ["I", "J"])]
    assert structure.abstracts("abstract Kilo(Float) from Float to Int {") == [("Kilo", ["Float", "Int"])]
    assert structure.aliases("typedef Id = haxe.Int64;\ntypedef S = { a:Int }") == [("Id", "Int64")]


def test_links():
    assert graph.normalised_path("guide/page.md", "../macros/build.md") == "macros/build.md"
    assert graph.normalised_path("a.md", "../x.md") is None and graph.normalised_path("a.md", "https://x/y") is None


def test_link_edges(spark):
    rows = [("c1", "guide/a.md", "see [x](../ref/b.md#two-words) and [y][r] and [z][none]\n[r]: b2.md", ["A"], 1), ("c2", "ref/b.md", "", ["Top"], 1), ("c3", "ref/b.md", "", ["Top", "Two Words"], 5), ("c4", "guide/b2.md", "", [], 9), ("c5", "guide/b2.md", "", [], 2)]
    got = graph.link_edges(spark.createDataFrame(rows, "chunk_id string, path string, content string, heading_path array<string>, start_line int"))
    assert sorted((r.src, r.dst) for r in got.collect()) == [("c1", "c3"), ("c1", "c5")]


def test_prose_graph(spark):
    rows = [("c1", "f", ["A"], "doc", 1, 8), ("c2", "f", ["A", "B"], "doc", 9, 20), ("c3", "f", ["A", "B", "C"], "doc", 21, 30), ("c4", "f", ["A"], "code_example", 9, 9), ("c5", "f", ["A"], "code_example", 80, 81)]
    c = spark.createDataFrame(rows, "chunk_id string, path string, heading_path array<string>, content_type string, start_line int, end_line int")
    pairs = lambda df: sorted((r.src, r.dst) for r in df.collect())
    assert pairs(graph.heading_edges(c)) == [("c1", "c2"), ("c2", "c3"), ("c4", "c2"), ("c5", "c2")]
    assert pairs(graph.example_edges(c)) == [("c1", "c4")]
    m = spark.createDataFrame([("x", "B"), ("x", "S"), ("y", "B"), ("y", "S"), ("y", "P"), ("z", "P")], "chunk_id string, symbol string")
    assert sorted((r.src, r.dst, r.weight) for r in graph.co_mention_edges(m).collect()) == [("x", "y", 2.0), ("y", "z", 1.0)]


def test_bridge_pool_is_the_greedy_loop(spark):
    c = bridge_candidates(spark, SF).collect()
    by = collections.defaultdict(list)
    for r in c:
        by[r.query_id].append(r)
    want = set()
    for q, own in by.items():
        seen, used, n = {r.chunk_id for r in own if r.is_seed}, collections.Counter(), 0
        for r in sorted((r for r in own if not r.is_seed), key=lambda r: (r.seed_rank, r.axis, r.bucket, r.pos, r.chunk_id)):
            key = (r.seed_rank, r.axis, r.bucket)
            if n < 50 and r.chunk_id not in seen and used[key] < 3:
                seen.add(r.chunk_id)
                used[key] += 1
                n += 1
                want.add((q, n, r.chunk_id, r.axis))
    assert {tuple(r) for r in graph.bridge_pool(bridge_candidates(spark, SF)).collect()} == want


def test_inverted_file_recall(spark):
    q = load()[0]
    for sf in (SF, "/root/testdata/sf0.1"):
        a, b = ({(r.query_id, r.vec_id) for r in q[n](spark, sf).collect()} for n in ("dense_knn", "ivf_knn"))
        assert len(a & b) >= 0.9 * len(a)


def test_exact_knn_in_many_blocks(spark, monkeypatch):
    e = table(spark, SF, "embeddings").select(F.col("vec_id").alias("item"), F.col("embedding").alias("v"))
    q = e.where("item % 5 = 0").withColumnRenamed("item", "query_id")
    want = {tuple(r) for r in vectors.exact_knn(e, q, 4).collect()}
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 7)
    monkeypatch.setattr(vectors, "VECTOR_BLOCK", 3)
    assert {tuple(r) for r in vectors.exact_knn(e, q, 4).collect()} == want and len(want) == 400


def test_source_tree_and_snapshot(spark, tmp_path):
    for name, raw in {"a.py": b"x = 1", "sub/b.md": b"# t\xff", "sub/c.bin": b"x", ".git/d.py": b"", "build/e.py": b""}.items():
        p = tmp_path / "tree" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(raw)
    got = readers.source_tree(spark, f"file://{tmp_path}/tree", ignores=["build/"])
    assert sorted((r.path, r.language) for r in got.collect()) == [("a.py", "py"), ("sub/b.md", "md")]
    calls = []
    make = lambda: calls.append(1) or got.select("path", "hash")
    assert readers.snapshot(spark, f"{tmp_path}/snap", make).count() == readers.snapshot(spark, f"{tmp_path}/snap", make).count() == 2
    assert calls == [1]
    assert {r.symbol for r in chunked(got).collect()} == {""}


def test_chunk_store(spark):
    s = store.ChunkStore(spark, scratch(spark, "t"))
    assert not s.exists() and s.count() is None
    rows = [(f"c{k}", f"p{k % 3}", "doc" if k % 2 else "code") for k in range(10)]
    s.insert(spark.createDataFrame(rows, "chunk_id string, path string, content_type string"))
    s.insert(spark.createDataFrame([("c1", "new", "doc")], "chunk_id string, path string, content_type string"))
    assert s.count() == 10 and s.query('path == "new"', ["chunk_id"]).first().chunk_id == "c1"
    s.delete(spark.createDataFrame([("c1",)], "chunk_id string"))
    changes = spark.createDataFrame([("p0", "removed"), ("p9", "added")], "path string, change string")
    s.reindex(changes, spark.createDataFrame([("n", "p9", "code")], "chunk_id string, path string, content_type string"))
    assert sorted(r.path for r in s.read().select("path").distinct().collect()) == ["p1", "p2", "p9"]
    s.drop()
    assert not s.exists()


def test_reconcile_never_drops_on_an_empty_list(spark):
    a, none = spark.createDataFrame([("x",), ("y",)], "name string"), spark.createDataFrame([], "name string")
    assert {r.action for r in joins.reconciled(a, none, "name").collect()} == {"keep"}


def test_models(spark):
    e = models.Embedder(8)
    df = spark.createDataFrame([(1, "a b"), (2, None), (3, "")], "k long, t string")
    v = {r.k: r.v for r in e.apply(df, "k", "t").collect()}
    assert abs(sum(x * x for x in v[1]) - 1) < 1e-9 and set(v[2]) == {0.0}
    other = models.Embedder(4)
    r = models.Registry(e, prose=other)
    assert r.of("prose") is other and r.of("code") is e
    pairs = spark.createDataFrame([(1, "a b", "b c"), (2, "", "x")], "k long, q string, t string")
    assert {x.k: x.relevance for x in models.Reranker().apply(pairs, ["k"], "q", "t").collect()} == {1: 0.5, 2: 0.0}


def test_log_can_be_turned_off(spark, tmp_path):
    rec = spark.createDataFrame([("search", "2024-01-02T00:00:00Z", "x")], "kind string, ts string, q string")
    store.write_log(rec, f"{tmp_path}/log", "off")
    assert not (tmp_path / "log").exists()
    store.write_log(rec, f"{tmp_path}/log")
    assert (tmp_path / "log" / "kind=search" / "day=2024-01-02").exists()


def test_order_of_input_does_not_matter(spark):
    q = load()[0]["hybrid_search_rrf"]
    a = {tuple(r) for r in q(spark, SF).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    assert {tuple(r) for r in q(spark, SF).collect()} == a
    spark.conf.set("spark.sql.shuffle.partitions", "4")
