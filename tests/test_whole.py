"""Queries over all rows of their table, against brute force."""

import re

from tessera.functions.query_text import ABBREVIATIONS
from tessera.plans.registry import load

SF = "/root/testdata/sf0.001"


def test_clamp_takes_all_documents(spark, tmp_path):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    odd = [None, "", "a", "b" * 99, "c" * 100, "d" * 101, "é" * 50, "x" + "é" * 50, "😀" * 25, "xyz" + "😀" * 25]
    texts |= {10**6 + k: t for k, t in enumerate(odd)}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"file://{tmp_path}/documents.parquet")
    want = {}
    for d, t in texts.items():
        kept = None if t is None else t.encode()[:100].decode(errors="ignore")
        want[d] = (None, None, None) if t is None else (len(kept), len(kept.encode()), kept == t)
    got = {r.doc_id: (r.kept_chars, r.kept_bytes, r.whole) for r in load()[0]["fn_clamp_all"](spark, f"file://{tmp_path}").collect()}
    assert got == want


def brute_extras(query):
    out = []
    for word in re.findall("[A-Za-z][A-Za-z0-9_-]*", query):
        mixed = re.fullmatch("[A-Z]?[a-z]+(?:[A-Z][a-zA-Z0-9]*)+", word)
        joined = [s for s in "_-" if re.fullmatch(f"[a-z][a-z0-9]*(?:{s}[a-z0-9]+)+", word)]
        if mixed or joined:
            parts = word.split(joined[0]) if joined else [p.lower() for p in re.findall("[A-Z]+(?![a-z])|[A-Z]?[a-z0-9]+", word)]
            title = [p[:1].upper() + p[1:] for p in parts]
            out += [v for v in ("_".join(parts), "-".join(parts), parts[0] + "".join(title[1:]), "".join(title)) if v != word]
    held = re.findall("[a-z0-9_]+", query.lower())
    for word in re.findall("[A-Za-z][A-Za-z0-9_]*", query):
        out += [f for f in ABBREVIATIONS.get(word.lower(), []) if f not in held]
    return ",".join(dict.fromkeys(out))


def test_rewrite_takes_all_queries(spark):
    got = load()[0]["query_rewrite_all"](spark, SF).collect()
    assert len(got) == spark.read.parquet(f"{SF}/benchmark.parquet").count()
    assert {r.query_id % 8 for r in got} == set(range(8))
    assert {r.query_id: r.extras for r in got} == {r.query_id: brute_extras(r.query) for r in got}
