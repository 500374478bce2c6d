"""Operators over whole corpora against brute force, and the pipeline."""

import base64
import collections
import hashlib
import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tests.llm.conftest import SMALL, rows
from tests.llm.test_texts import brute_terms, check_packing, spans
from tokenizers import Tokenizer

import corpus_pipeline
from tessera.llm import ann, bwt, common, langid, neardup, substring, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def shingles(text, n):
    w = WORD.findall(lower(text or ""))
    if not w:
        return frozenset()
    return frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)])


def brute_components(texts, n=2):
    """Ids are unique here. A pair of equal sets links too."""
    root = {d: d for d in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    sets = {d: shingles(t, n) for d, t in texts.items()}
    ids = sorted(d for d in texts if sets[d])
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if 100 * min(len(x), len(y)) >= 80 * max(len(x), len(y)):
                both = len(x & y)
                if 100 * both >= 80 * (len(x) + len(y) - both):
                    p, q = find(a), find(b)
                    root[max(p, q)] = min(p, q)
    return {d: (len(sets[d]), find(d)) for d in texts}


def near_copies():
    """Chains, groups of near copies, short texts, exact copies."""
    rng = random.Random(11)
    vocabulary = [f"w{k}" for k in range(400)]
    out = []
    for _ in range(30):
        base = [rng.choice(vocabulary) for _ in range(rng.choice((1, 2, 5, 40, 120)))]
        for _ in range(rng.choice((1, 3, 8))):
            out.append(" ".join(base))
            base = [rng.choice(vocabulary) if rng.random() < 0.04 else w for w in base]
    out += ["", None, "same words here", "Same  WORDS\nhere", "É same", "é same"]
    return dict(enumerate(out, 1))


@pytest.mark.parametrize("settings", [neardup.Forest(), neardup.Forest(region=8, cluster_shingles=300)])
def test_near_duplicates(spark, docs, settings):
    for texts in (near_copies(), {r.doc_id: r.text for r in docs.collect()}):
        df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
        want = brute_components(texts)
        got = neardup.digests(df, settings).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
        assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def fringed(members, alone):
    """A group of near copies of one text, and texts that share 0.80 to 0.85 with one
    of the group's members and less with all others."""
    rng, out = random.Random(23), []
    base = [f"b{k}" for k in range(400)]
    for k in range(members):
        copy = list(base)
        for at in rng.sample(range(400), 6):
            copy[at] = f"m{k}x{at}"
        out.append(copy)
    for k in range(alone):
        copy = list(rng.choice(out[:members]))
        for at in range(k, 400, 21 if k % 2 else 20):
            copy[at] = f"f{k}x{at}"
        out.append(copy)
    return dict(enumerate((" ".join(w) for w in out), 1))


def test_near_duplicates_around_a_hot_region(spark):
    """Texts at the edge of a group that is larger than a region."""
    texts = fringed(260, 60)
    sets = {d: shingles(t, 2) for d, t in texts.items()}
    best = [max(len(sets[d] & s) / len(sets[d] | s) for e, s in sets.items() if e != d) for d in list(texts)[260:]]
    assert sum(0.8 <= b <= 0.85 for b in best) >= 40
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    want = brute_components(texts)
    named = lambda **search: {r.doc_id: r.component_id for r in neardup.digests(df, neardup.Forest(depth=2, **search)).collect()}
    assert named(trees=4, region=40) == named(trees=4, region=10**6)
    assert named(trees=32, region=100) == {d: c for d, (_, c) in want.items()}


def test_near_duplicate_depths():
    """Sorted runs: nothing falls out, none is too large, cuts are at the shortest prefixes."""
    rng = np.random.default_rng(3)
    for most in (2, 5, 40):
        keys = np.sort(rng.integers(0, 3, (300, 6)).astype(np.uint8).view("V6").ravel()).view(np.uint8).reshape(300, 6)
        keys = keys[np.lexsort(keys.T[::-1])]
        runs = neardup.depths(keys, most)
        assert [k for lo, hi in runs for k in range(lo, hi)] == list(range(300)) and max(hi - lo for lo, hi in runs) <= most
    keys = np.array([[0, 0], [0, 0], [0, 1], [2, 0], [2, 0], [3, 3]], np.uint8)
    assert neardup.depths(keys, 3) == [(0, 3), (3, 6)] and neardup.depths(keys, 6) == [(0, 6)]
    assert neardup.depths(np.zeros((5, 4), np.uint8), 2) == [(0, 1), (1, 3), (3, 5)]


def test_near_duplicate_links_of_dense_texts(spark):
    """Recall of single links where regions stay large at their deepest: texts on one
    template whose only close partner is one other text."""
    rng, texts = random.Random(41), {}
    base = [f"b{k}" for k in range(300)]
    for pair in range(150):
        one = [f"p{pair}x{k}" if rng.random() < 0.22 else w for k, w in enumerate(base)]
        texts[2 * pair + 1] = one
        texts[2 * pair + 2] = [f"q{pair}x{k}" if k % 21 == 3 else w for k, w in enumerate(one)]
    texts = {d: " ".join(w) for d, w in texts.items()}
    want = {d: c for d, (_, c) in brute_components(texts).items()}
    assert len(set(want.values())) == 150
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in neardup.digests(df, neardup.Forest(region=20)).collect()}
    assert sum(got[d] == c for d, c in want.items()) == len(want)


def test_near_duplicate_probes_are_asked():
    """Probes that link with one another may still lead to hosts of the block."""
    links = {0: [0, 1], 1: [0, 1, 2], 2: [1, 2], 3: [3], 4: [4, 5], 5: [4, 5]}
    of = lambda i: np.array(links[i])
    for top in ([], [2, 3]):
        root = neardup.probed(6, of, np.array([0, 1, 4]), np.array(top, int))
        assert root[0] == root[1] == root[2] and root[4] == root[5] != root[0]
        assert (root[3] == root[2]) == bool(top)
    pair = {0: [0], 1: [1, 2], 2: [1, 2, 3], 3: [2, 3]}
    root = neardup.probed(4, lambda i: np.array(pair[i]), np.array([1, 2]), np.zeros(0, int))
    assert root[1] == root[2] == root[3] != root[0]


def chained(groups=3, members=12):
    """Groups of copies, and chains of two whose last text alone leads to a group."""
    rng, out = random.Random(31), []
    for g in range(groups):
        base = [f"g{g}x{k}" for k in range(100)]
        for k in range(members):
            out.append([*base, f"t{g}x{k}"])
        for c in range(members):
            at = rng.sample(range(100), 5)
            near = [f"c{g}x{c}x{w}" if w in at else x for w, x in enumerate(base)]
            out += [near, [f"d{g}x{c}x{w}" if w % 20 == 3 else x for w, x in enumerate(near)]]
    return dict(enumerate((" ".join(w) for w in out), 1))


def test_near_duplicates_in_blocks(spark):
    """Clusters cut in many blocks, with chains that leave their block."""
    texts = chained()
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.digests(df, neardup.Forest(cluster_shingles=700)).collect()}
    assert got == brute_components(texts)


def test_near_duplicates_odd(spark, odd, empty):
    got = neardup.digests(odd).collect()
    assert len(got) == odd.count()
    by = collections.defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    assert by[4][0].component_id == 4 == by[5][0].component_id and len(by[5]) == 2
    assert by[6][0].component_id == by[7][0].component_id == 6
    assert by[1][0].kept and by[2][0].kept and by[3][0].n_shingles == 0
    assert neardup.digests(empty).count() == 0
    wide = spark.createDataFrame([(1, "a b c", "x", 2), (2, "a b c", "y", 3)], "doc_id long, text string, node string, th long")
    assert rows(neardup.deduplicated(wide)) == [(1, "a b c", "x", 2)]


def test_near_duplicate_words_of_stage():
    assert corpus_pipeline.NEAR.words == 5 and corpus_pipeline.NEAR.percent == 80


def brute_substring(texts, least=200):
    raw = {d: (t or "").encode() for d, t in texts.items()}
    seen = collections.Counter(b[k : k + least] for b in raw.values() for k in range(len(b) - least + 1))
    out = {}
    for d, b in raw.items():
        gone = bytearray(len(b))
        for k in range(len(b) - least + 1):
            if seen[b[k : k + least]] > 1:
                gone[k : k + least] = b"\1" * least
        runs = sum(gone[k] and (k == 0 or not gone[k - 1]) for k in range(len(gone)))
        out[d] = (len(b), sum(gone), runs, hashlib.sha256(bytes(c for c, g in zip(b, gone, strict=True) if not g)).hexdigest())
    return out


def passages():
    rng = random.Random(4)
    make = lambda n: "".join(rng.choice("abc de") for _ in range(n))
    shared = [make(n) for n in (199, 200, 201, 350, 900)]
    out = ["x" * 600, "ab" * 300, None, "", "é" * 250]
    for k in range(60):
        out.append(make(rng.randrange(0, 300)) + rng.choice(shared) + make(rng.randrange(0, 300)) + (rng.choice(shared) if k % 3 else ""))
    return dict(enumerate(out, 1))


@pytest.mark.parametrize("most_pieces", [2048, 2])
def test_substring(spark, docs, most_pieces):
    for texts in (passages(), {r.doc_id: r.text for r in docs.collect()}):
        df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substring.remove(df, most_pieces=most_pieces).collect()}
        assert got == brute_substring(texts)


def test_substring_odd(spark, odd, empty):
    got = substring.remove(odd).collect()
    assert len(got) == odd.count()
    assert all(r.n_bytes >= r.n_removed for r in got)
    assert substring.remove(empty.select("doc_id", "text")).count() == 0
    wide = spark.createDataFrame([(1, "k" * 150, 7, "a"), (2, None, 8, "b")], "doc_id long, text string, n_bytes long, row string")
    kept = substring.remove(wide, keep=True, prefix="__")
    assert rows(kept.select(*wide.columns)) == [(1, "k" * 150, 7, "a"), (2, None, 8, "b")]


def test_bwt_intervals():
    rng = np.random.default_rng(2)
    parts = [rng.integers(97, 100, n).astype(np.uint8) for n in (0, 3, 80, 120, 40)]
    parts.append(np.concatenate([parts[2], parts[3][:50]]))
    for least in (2, 5, 12, 40):
        seen = collections.Counter(p[k : k + least].tobytes() for p in parts for k in range(len(p) - least + 1))
        want = [[k for k in range(len(p) - least + 1) if seen[p[k : k + least].tobytes()] > 1] for p in parts]
        assert [x.tolist() for x in bwt.repeated_starts(parts, least)] == want


def test_bwt_memory_of_a_whole_shard():
    rng = np.random.default_rng(3)
    parts = [rng.integers(97, 123, 319).astype(np.uint8) for _ in range((bwt.MOST - 2) // 320)]
    parts[-200:] = parts[:200]
    tracemalloc.start()
    got = bwt.repeated_starts(parts, 200)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [len(x) for x in got] == [120 if k < 200 or k >= len(parts) - 200 else 0 for k in range(len(parts))]
    assert peak < 80 * bwt.MOST


def exact(x, ids, k=20):
    out = {}
    for i in np.flatnonzero(ids % 20 == 0):
        s = (x * x[i]).sum(1)
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != ids[i]][:k]
        out[int(ids[i])] = [(int(ids[j]), float(s[j])) for j in order]
    return out


def test_ann_recall(spark):
    for path in (SMALL, "/root/testdata/sf0.1"):
        e = spark.read.parquet(f"{path}/embeddings.parquet")
        t = e.toPandas()
        want = exact(np.stack(t.embedding).astype(float), t.vec_id.to_numpy())
        got = collections.defaultdict(list)
        for r in ann.search(e, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
            got[r.query_id].append((r.vec_id, r.score))
            assert r.rank == len(got[r.query_id])
        assert set(got) == set(want)
        hits = sum(len({a for a, _ in got[q]} & {a for a, _ in want[q]}) for q in want)
        assert hits >= 0.9 * sum(map(len, want.values()))
        for q, found in got.items():
            assert found == sorted(found, key=lambda p: (-p[1], p[0]))
            known = dict(want[q])
            assert all(abs(known[a] - s) < 1e-12 for a, s in found if a in known)


def test_ann_odd_vectors(spark):
    v = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [1.0, None]), (7, [1.0]), (20, [0.0, 1.0]), (None, [1.0, 1.0]), (8, [float("inf"), 1.0]), (9, [])]
    e = spark.createDataFrame(v, "vec_id long, embedding array<float>")
    got = rows(ann.search(e, F.col("vec_id") % 20 == 0))
    assert got == [(0, 1, 1, 0.5), (0, 2, 2, 0.5), (0, 3, 20, 0.0), (20, 1, 1, 0.5), (20, 2, 2, 0.5), (20, 3, 0, 0.0)]
    assert ann.search(e.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    more = spark.createDataFrame([(40, [2.0], 1, 2), (41, [3.0], 1, 2), (0, [1.0, 0.0], 1, 2), (2, [0.5, 0.5], 1, 2), (0, [1.0, 0.0], 1, 2)], "vec_id long, embedding array<float>, rank int, score int")
    assert rows(ann.search(more, F.col("vec_id") % 20 == 0)) == [(0, 1, 2, 0.5), (40, 1, 41, 6.0)]
    assert ann.search(e.where("vec_id IN (3, 4)"), F.col("vec_id") % 20 == 0).count() == 0


def test_ann_traversal():
    rng = np.random.default_rng(1)
    for _ in range(40):
        a, b, n = rng.random(7), rng.random(5), rng.integers(0, 4, (7, 5))
        want = int(rng.integers(1, n.sum() + 1))
        sums = np.sort((a[:, None] + b).ravel())
        held = np.cumsum(n.ravel()[np.argsort((a[:, None] + b).ravel(), kind="stable")])
        assert ann.reach(a, b, n, want) == pytest.approx(sums[np.searchsorted(held, want)])
    assert ann.reach(a, b, n, int(n.sum()) + 1) == np.inf


def brute_warc(pages):
    first = {}
    for p, html in pages:
        if p is not None:
            first[html or ""] = min(first.get(html or "", p), p)
    out = []
    for p, html in pages:
        raw = (html or "").encode()
        to = first.get(html or "") if p is not None else None
        again = p is not None and to != p
        out.append((p, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", to if again else None))
    return sorted(out, key=repr)


def test_warc(spark):
    pages = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()]
    pages += [(900, "http://a/\r\nX: y", None), (901, None, ""), (902, "u", "é\r\n\r\n"), (903, "u", "é\r\n\r\n"), (903, "u", "é\r\n\r\n"), (None, "n", "é\r\n\r\n"), (904, "u", "WARC/1.1\r\n\r\n" * 3), (905, "u", "z" * 300_000)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(2)
    layout = warc.Layout(frame_bytes=5000, bundle_bytes=20_000)
    for options in ({}, {"layout": layout}):
        assert rows(warc.round_trip(df, **options)) == brute_warc([(a, c) for a, _, c in pages])
    assert warc.round_trip(df.limit(0)).count() == 0


def test_warc_random_access(spark, tmp_path):
    df = spark.createDataFrame([(k, f"http://x/{k}", f"page {k} " * k) for k in range(1, 60)], "page_id long, url string, html string")
    index = warc.write_bundles(df, f"file://{tmp_path}/w", layout=warc.Layout(frame_bytes=2000, bundle_bytes=5000)).collect()
    assert len({r.file for r in index}) > 1 and max(r.frame for r in index) > 0
    for r in index[::7]:
        head, block = warc.Bundle(r.file).record(r.frame, r.offset)
        assert head["WARC-Record-ID"] == f"<urn:page:{r.page}>" and block.endswith((f"page {r.page} " * r.page).encode())


def test_langid(spark, empty, odd):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.learn(d)
    got = langid.label(d.select("doc_id", "text"), model).join(d.select("doc_id", "lang", "n_chars"), "doc_id").withColumn("out", langid.held_out("doc_id"))
    accuracy = got.where("out AND lang IS NOT NULL AND lang_pred <> 'und'").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert accuracy >= 0.93, accuracy
    assert set(model.langs) == {"de", "en", "es", "fr"}
    odd_rows = langid.label(odd, model).collect()
    assert len(odd_rows) == odd.count() and all(0 <= r.score <= 1 for r in odd_rows)
    by = {r.doc_id: r for r in odd_rows}
    assert all(by[k].lang_pred == "und" and by[k].score == 0 for k in (1, 2, 3, 10))
    assert by[6].lang_pred in model.langs
    assert langid.learn(empty) is None
    assert {r.lang_pred for r in langid.label(odd, None).collect()} == {"und"}


def test_langid_gradients():
    """Backpropagation through time against finite differences."""
    rng = np.random.default_rng(0)
    x, u, w = rng.integers(0, 5, (6, 3)), rng.standard_normal((9, 3)).astype(np.float64), rng.standard_normal((9, 256))
    weight = rng.standard_normal((6, 3, 3))
    loss = lambda w, u: sum((k[5] * g).sum() for k, g in zip(langid._forward(x, w, u, range(6)), weight, strict=True))
    d_w, d_u = langid._backward(x, langid._forward(x, w, u, range(6)), weight, u, range(6))
    for m, d in ((w, d_w), (u, d_u)):
        for i, j in ((0, 0), (4, 1), (8, 2)):
            up, down = m.copy(), m.copy()
            up[i, j] += 1e-5
            down[i, j] -= 1e-5
            slope = (loss(up, u) - loss(down, u)) / 2e-5 if m is w else (loss(w, up) - loss(w, down)) / 2e-5
            assert d[i, j] == pytest.approx(slope, rel=1e-2, abs=1e-3)


def test_pipeline(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    columns, kept = docs.columns, docs
    assert len(corpus_pipeline.STAGES) == 5
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = corpus_pipeline.staged(stage(spark, kept, SMALL), f"test-{name}")
        assert kept.columns == columns
        sizes.append(kept.count())
    assert sizes[0] >= sizes[1] > sizes[2] == sizes[3] == sizes[4]
    texts = {r.doc_id: r.text for r in kept.collect()}
    left = {d: t for d, t in brute_substring(texts).items() if t[1]}
    assert len(left) < 0.02 * len(texts)
    assert not any(re.search(r"[a-z0-9]@[a-z0-9-]+\.[a-z]", t or "") for t in texts.values())
    pieces = corpus_pipeline.STAGES[-1][1](spark, kept, SMALL)
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == set(texts)


def sanitised_plainly(texts):
    """Each text with its spans replaced, by plain counting and slicing."""
    terms, out = brute_terms(texts), {}
    for d, t in texts.items():
        found = [(a, b, f"[{k.upper()}]") for k, own in spans(t).items() for a, b in own]
        for a, b, gone in terms[d]:
            shape = "[CODE]" if re.search(r"[0-9]", t[a:b]) else "[NAME]" if t[a].isupper() else "[WORD]"
            found.append((a, b, "" if gone else shape))
        merged = []
        for a, b, label in sorted(found):
            if merged and merged[-1][1] > a:
                merged[-1] = (merged[-1][0], max(b, merged[-1][1]), merged[-1][2])
            else:
                merged.append((a, b, label))
        edges = [0, *(x for a, b, _ in merged for x in (a, b)), len(t)]
        out[d] = "".join(t[edges[2 * k] : edges[2 * k + 1]] + (merged[k][2] if k < len(merged) else "") for k in range(len(merged) + 1))
    return out


def test_pipeline_stages_against_plain_python(spark, docs):
    """Every stage on the input that the stage before it leaves."""
    read = lambda df: {r.doc_id: r.text for r in df.collect()}
    stage = dict(corpus_pipeline.STAGES)
    docs = docs.withColumn("text", F.when(F.col("doc_id") == 0, F.concat("text", F.lit(" ask jane@corp.example"))).when(F.col("doc_id") == 1, F.lit(None)).otherwise(F.col("text")))
    first = corpus_pipeline.staged(stage["language"](spark, docs, SMALL), "plain-language")
    kept, every = read(first), read(docs)
    assert all(kept[d] == every[d] for d in kept) and not any(re.search(r"[^\W\d_]", every[d] or "") and len(every[d]) > 200 for d in every.keys() - kept.keys())
    near = corpus_pipeline.staged(stage["near_duplicates"](spark, first, SMALL), "plain-near")
    assert read(near) == {d: kept[d] for d, (_, c) in brute_components(kept, 5).items() if c == d}
    cut = corpus_pipeline.staged(stage["repeated_strings"](spark, near, SMALL), "plain-cut")
    want = {}
    raw = {d: t.encode() for d, t in read(near).items()}
    seen = collections.Counter(b[k : k + 200] for b in raw.values() for k in range(len(b) - 199))
    for d, b in raw.items():
        gone = bytearray(len(b))
        for k in range(len(b) - 199):
            if seen[b[k : k + 200]] > 1:
                gone[k : k + 200] = b"\1" * 200
        want[d] = bytes(c for c, g in zip(b, gone, strict=True) if not g).decode(errors="ignore")
    assert read(cut) == want
    clean = corpus_pipeline.staged(stage["personal_data"](spark, cut, SMALL), "plain-clean")
    assert read(clean) == sanitised_plainly(want) and "jane@" not in "".join(read(clean).values())
    assert {r.doc_id: r.n_chars for r in clean.collect()} == {d: len(t) for d, t in read(clean).items()}
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    check_packing(stage["packing"](spark, clean, SMALL).collect(), clean, lambda t: tokenizer.encode(t or "", add_special_tokens=False).ids, 2048)


def test_pipeline_language_keeps_clean_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    kept = {r.doc_id for r in corpus_pipeline.language(spark, docs, SMALL).select("doc_id").collect()}
    lost = docs.where(~F.col("doc_id").isin(list(kept)))
    assert lost.where(F.col("text").rlike(r"\p{L}") & (F.length("text") > 200)).count() <= 0.002 * docs.count()


def test_pipeline_stages_take_odd_tables(spark, odd):
    wide = odd.withColumn("lang", F.when(F.col("doc_id") < 7, "de").otherwise("en")).withColumn("score", F.lit(1)).withColumn("source", F.lit("s")).withColumn("n_chars", F.length("text").cast("long"))
    for table in (wide, wide.limit(0)):
        docs = corpus_pipeline.staged(table, "test-odd")
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = corpus_pipeline.staged(stage(spark, docs, SMALL), f"test-odd-{name}")
            assert docs.columns == wide.columns
        corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).count()


def test_pipeline_sends_rows_to_python_in_bounded_batches(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [batch.nbytes]})

    docs = spark.range(0, 4000, 1, 1).selectExpr("id AS doc_id", "repeat(concat(id, ' some words '), 200) AS text", "'en' AS lang")
    for k in (0, 1, 2, 4):
        spark.conf.unset(name)
        corpus_pipeline.STAGES[k][1](spark, docs.limit(5), SMALL)
        assert max(r.n for r in docs.mapInArrow(sizes, "n long").collect()) < 1.1 * common.TRANSFER_BYTES
    spark.conf.unset(name)
