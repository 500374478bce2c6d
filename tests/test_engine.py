"""The engine, its store and its locks."""

import pytest
from pyspark.sql import functions as F

from tessera.engine import Engine, Options, normalised
from tessera.operators import evaluation
from tessera.sources.locks import Lock
from tessera.sources.store import ChunkStore

FILES = [("a.md", "markdown", "# Red\n\nThe red fox runs."), ("b.md", "markdown", "# Blue\n\nA blue whale swims."), ("c.py", "python", "def green():\n    return 1\n"), ("d.txt", "text", None)]


@pytest.fixture()
def files(spark):
    return spark.createDataFrame(FILES, "path string, language string, content string")


def test_engine(spark, files, tmp_path):
    engine = Engine(spark, f"file://{tmp_path}/e", options=Options(ignore=("*.txt",)))
    assert engine.index("one", files) == "indexed" and engine.index("one", files) == "exists"
    assert engine.names() == ["one"] and engine.has("one") and not engine.has("two")
    queries = spark.createDataFrame([(1, "blue whale"), (2, "green")], "query_id long, query string")
    top = {r.query_id: r.path for r in engine.search("one", queries, 5).where("rank = 1").collect()}
    assert top == {1: "b.md", 2: "c.py"}
    assert {r.path for r in engine.search("one", queries, 5, filter_text='path like "%.py"').collect()} == {"c.py"}
    assert engine.describe("one")["dimension"] == 64 and engine.describe("one")["rows"] == engine.store("one").count()
    later = files.where("path <> 'a.md'").withColumn("content", F.when(F.col("path") == "b.md", "# Blue\n\nA grey seal sleeps.").otherwise(F.col("content")))
    assert engine.reindex("one", later) == {"added": 0, "removed": 1, "modified": 1}
    assert engine.reindex("one", later) == {"added": 0, "removed": 0, "modified": 0}
    seal = spark.createDataFrame([(1, "seal")], "query_id long, query string")
    assert engine.search("one", seal).where("rank = 1").first().path == "b.md"
    assert engine.index("one", files, force=True) == "indexed"
    paths = spark.createDataFrame([("one/x",), ("two/y",)], "path string")
    assert {r.path: r.status for r in engine.status(paths).collect()} == {"one/x": "indexed", "two/y": "not_found"}
    assert {r.language for r in engine.categories().collect()} >= {"python"}
    engine.clear("one")
    assert not engine.has("one") and engine.catalog().count() == 0
    with pytest.raises(ValueError):
        engine.index("../up", files)


def test_failed_index_is_noted(spark, files, tmp_path):
    engine = Engine(spark, f"file://{tmp_path}/e")

    def broken(text, language):
        raise RuntimeError("no chunks")

    with pytest.raises(Exception, match="no chunks"):
        engine.index("one", files, splitter=broken)
    assert [r.status for r in engine.catalog().collect()] == ["indexfailed"] and not engine.has("one")


def test_store_commits(spark, tmp_path):
    rows = lambda *x: spark.createDataFrame([(i, p, "doc", v) for i, p, v in x], "chunk_id string, path string, content_type string, v int")
    s = ChunkStore(spark, f"file://{tmp_path}/s")
    assert s.count() is None and not s.exists()
    s.insert(rows(("1", "a", 1), ("2", "b", 1)))
    s.insert(rows(("2", "b", 2), ("3", "c", 2)))
    s.delete(spark.createDataFrame([("1",)], "chunk_id string"))
    s.insert(rows(("1", "a", 4)))
    state = lambda: {r.chunk_id: r.v for r in s.read().collect()}
    assert state() == {"1": 4, "2": 2, "3": 2} and s.count() == 3
    s.compact()
    assert state() == {"1": 4, "2": 2, "3": 2} and len(s._commits()) == 1
    s.delete(spark.createDataFrame([("3",)], "chunk_id string"))
    assert state() == {"1": 4, "2": 2}


def test_locks(spark, tmp_path):
    path = f"file://{tmp_path}/lock"
    a, b = Lock(spark, path), Lock(spark, path, tries=2, wait=0.01)
    assert a.acquire() and not b.acquire()
    b.release()
    assert a.held_by() == a.token
    with pytest.raises(TimeoutError), b:
        pass
    late = Lock(spark, path, stale=-1.0)
    assert late.acquire() and late.held_by() == late.token
    a.release()
    assert late.held_by() == late.token
    late.release()
    with b:
        assert b.held_by() == b.token
    assert b.held_by() is None


def test_options():
    assert normalised("none", ["ts", " ", ".py", "ts"], ["", " a/ "]) == Options("syntax", (".ts", ".py"), ("a/",))
    assert normalised("recursive", None, None) == Options("recursive")


def test_edits(spark):
    log = "x\n  Arguments: {'file_path': 'a.py', 'old_string': 'it\\'s\\n1',\n 'new_string': '2'}\nArguments: {'path': 'b'}"
    rows = spark.createDataFrame([(1, log), (2, ""), (3, None)], "k long, log string")
    got = rows.select("k", F.inline(evaluation.edit_triples(F.col("log"))))
    assert [tuple(r) for r in got.collect()] == [(1, "a.py", "it's\n1", "2")]
    diff = evaluation.unified_diffs(got, "k").first().diff.split("\n")
    assert diff[:2] == ["--- a/a.py", "+++ b/a.py"] and diff[3:] == ["-it's", "-1", "+2"]


def test_bm25_is_the_same_by_broadcast_and_by_shuffle(spark, monkeypatch):
    from tessera.operators import lexical

    docs = spark.createDataFrame([(i, "the " * (i % 4) + f"w{i % 7} w{i % 3}" if i % 11 else None) for i in range(200)], "d long, t string")
    asked = spark.createDataFrame([(q, f"the w{q} w{q + 1} w{q}") for q in range(6)], "q long, t string")
    found = lambda: sorted(map(tuple, lexical.bm25(docs, asked, "d", "t", "q", "t").collect()))
    near = found()
    monkeypatch.setattr(lexical.small, "__defaults__", (0,))
    assert near == found() and len(near) > 200
