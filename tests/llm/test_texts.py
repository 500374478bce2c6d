"""Tokens, packing, shards, quality and personal data against plain Python."""

import collections
import hashlib
import json
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import regex
from pyspark.sql import functions as F
from tests.llm.conftest import LONG, ODD, rows
from tokenizers import Tokenizer

from tessera.llm import bpe, packing, pii, quality, repair, vocab


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_vocabularies_are_equal(tmp_path, monkeypatch):
    assert vocab.proven_equal(vocab.default_json(), vocab.default_ranks())
    other = tmp_path / "other.json"
    for change in ({"added_tokens": [{"id": 50256, "content": "x", "lstrip": True, "rstrip": False, "single_word": False}]}, {"normalizer": {"type": "NFC"}}):
        other.write_text(json.dumps(json.loads(open(vocab.default_json()).read()) | change))
        vocab.specification.cache_clear()
        vocab.proven_equal.cache_clear()
        assert not vocab.proven_equal(str(other), vocab.default_ranks())
    monkeypatch.setattr(vocab, "pattern", lambda: r"\s+|\S+")
    vocab.proven_equal.cache_clear()
    assert not vocab.proven_equal(vocab.default_json(), vocab.default_ranks())
    vocab.proven_equal.cache_clear()
    monkeypatch.undo()
    assert not vocab.proven_equal(vocab.default_json(), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def test_ids_are_those_of_the_tokenizers_library(tokenizer, monkeypatch):
    """The text of the special token included, and texts beyond what is encoded at once."""
    rng, special = random.Random(1), vocab.special(vocab.default_json())
    parts = ["a", "the", " ", "  ", "\n", "\t", "<|endoftext|>", "<|endoftext|", "'s", "1", "é", "日", "\u3000", "\x1c", "\x85", "!", "x ", "😀", " \n"]
    assert vocab.text_ids("a <|endoftext|> b", vocab.default_ranks(), special).tolist() == [64, 220, 50256, 275] == tokenizer("a <|endoftext|> b")
    for most in (vocab.AT_ONCE, 3):
        monkeypatch.setattr(vocab, "AT_ONCE", most)
        for _ in range(500):
            text = "".join(rng.choice(parts) for _ in range(rng.randrange(14)))
            assert vocab.text_ids(text, vocab.default_ranks(), special).tolist() == tokenizer(text), text


@pytest.mark.parametrize("leaf", [1, 3, 16, 200])
def test_bpe_tree_is_exact(leaf):
    rng = random.Random(leaf)
    words = ["the ", " a", "\n\n", "  ", "x", "naïve", "😀", "'s", "1234", "don't", "\t", "\r\n", "aaaa", "!!!", "日本", " \n"]
    enc, path = vocab.encoding(vocab.default_ranks()), vocab.default_ranks()
    for k in range(60):
        text = "".join(rng.choice(words) for _ in range(rng.randrange(1, 80)))
        got = bpe.encode_tree(text, path, leaf)
        assert got.tolist() == enc.encode_ordinary(text), (k, text)
        assert bpe.decode_tree(got, path, leaf) == text.encode()
    for text in (LONG, "a" * 6000, " " * 3000, "\n" * 500):
        assert bpe.encode_tree(text, path, max(leaf, 16)).tolist() == enc.encode_ordinary(text)


def test_bpe_digests(docs, odd, empty):
    enc = vocab.encoding(vocab.default_ranks())
    for df in (docs, odd):
        want = []
        for r in df.collect():
            ids = enc.encode_ordinary(r.text or "")
            want.append((r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
        assert rows(bpe.digests(df)) == sorted(want, key=repr)
    assert bpe.digests(empty).count() == 0
    full = bpe.encode_texts(odd).where("doc_id = 9").first()
    assert bytes(full.decoded).decode() == ODD[11][1]


def test_repair_round_trip(spark, docs, odd, empty, tokenizer):
    for df in (docs, odd):
        got = [tuple(r) for r in repair.round_trip(df, shard_tokens=20_000).collect()]
        want, at = [], 0
        for r in sorted(df.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0)):
            ids = [*tokenizer(r.text), 2]
            want.append((r.doc_id, len(ids), crc(ids)))
        assert sorted(((g[0], g[2], g[3]) for g in got), key=repr) == sorted(want, key=repr)
        for _, start, n, _ in sorted(got, key=lambda g: g[1]):
            assert start == at
            at += n
        order = [g[0] for g in sorted(got, key=lambda g: g[1]) if g[0] is not None]
        assert order == sorted(order)
    assert repair.round_trip(empty).count() == 0


def test_repair_reads_several_files_in_a_task(spark, docs, tmp_path):
    manifest = repair.write_shards(docs.limit(60), f"file://{tmp_path}", shard_tokens=500)
    files = manifest.count()
    got = repair.read_shards(manifest)
    assert files > 8 and got.rdd.getNumPartitions() == -(-files // 4)
    assert got.select("doc_id").distinct().count() == 60


def test_repair_engines_agree(odd):
    assert rows(repair.round_trip(odd).drop("start")) == rows(repair.round_trip(odd, engine="tokenizers").drop("start"))


def test_repair_grammar():
    rng = np.random.default_rng(3)
    sizes = np.array([0, 1, 700, 3, 5000, 2])
    ids = np.tile(rng.integers(0, 40, 57), 101)[: sizes.sum()].astype(np.uint32)
    shard = repair.Shard(repair.to_bytes([None, 1, 2, 3, 4, 5], ids, sizes, 50257))
    assert len(shard.grammar.left) and shard.n_symbols < len(ids) / 3
    ends = np.cumsum(sizes)
    for k in range(len(sizes)):
        assert shard.decode(k).tolist() == ids[ends[k] - sizes[k] : ends[k]].tolist()
    assert shard.lengths.tolist() == shard.grammar.size[50257:].tolist()
    assert shard.doc_ids[0] is None


@pytest.mark.parametrize(("first", "kinds"), [(50257, 3), (50257, 40), (300_000, 200_000)])
def test_repair_leaves_no_frequent_pair(first, kinds):
    """Against a plain count of the pairs that are left, within documents."""
    rng = np.random.default_rng(kinds)
    for least in (3, 8):
        sizes = rng.integers(0, 300, 80)
        ids = np.minimum(rng.zipf(1.3, sizes.sum()), kinds).astype(np.uint32) - 1
        grammar, seq, bounds = repair.compress(ids, sizes, first, least)
        assert (grammar.expand(seq) == ids).all() and len(grammar.left) > 0
        runs = [seq[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        left = collections.Counter(p for r in runs for p in zip(r[:-1], r[1:], strict=True))
        assert max(left.values(), default=0) < least
        both = repair.Grammar(first, grammar.left, grammar.right)
        out = seq.copy()
        while (out >= first).any():
            out = np.array([x for s in out for x in ((both.left[s - first], both.right[s - first]) if s >= first else (s,))], np.uint32)
        assert (out == ids).all()


@pytest.mark.parametrize("bits", [3, 6, 12])
def test_repair_pairs_that_share_a_slot(monkeypatch, bits):
    """However few slots there are, pairs are only put off by a round."""
    assert repair.slot_bits(2_000_000) == 18 and repair.slot_bits(64_000_000) == 23
    monkeypatch.setattr(repair, "SLOTS", (bits, bits))
    rng = np.random.default_rng(bits)
    sizes = rng.integers(0, 300, 60)
    ids = np.minimum(rng.zipf(1.2, sizes.sum()), 60).astype(np.uint32)
    grammar, seq, bounds = repair.compress(ids, sizes, 100)
    assert (grammar.expand(seq) == ids).all() and len(grammar.left) > 0
    runs = [seq[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    left = collections.Counter(p for r in runs for p in zip(r[:-1], r[1:], strict=True))
    assert max(left.values()) < 8
    assert [int(grammar.size[r].sum()) for r in runs if r] == sizes[sizes > 0].tolist()


def test_repair_long_expansions_are_opened_pair_by_pair():
    n = 40
    grammar = repair.Grammar(10, np.array([1, *range(10, 9 + n)], np.uint32), np.array([2, *[3] * (n - 1)], np.uint32))
    slow = repair.Grammar(10, grammar.left, grammar.right)
    slow.__dict__["size"] = grammar.size * 1_000_000
    assert slow.expand(np.array([9 + n, 4], np.uint32)).tolist() == grammar.expand(np.array([9 + n, 4], np.uint32)).tolist() == [1, 2, *[3] * (n - 1), 4]


def test_repair_takes_clashing_columns(spark):
    df = spark.createDataFrame([(2, "b", "x", 1), (1, None, "y", 2)], "doc_id long, text string, file string, start int")
    assert rows(repair.round_trip(df).select("doc_id", "start", "n_tokens")) == [(1, 0, 1), (2, 1, 2)]


def check_packing(got, df, tokenizer, window):
    by_doc, by_seq = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        assert 1 <= r.length and r.offset + r.length <= window
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append((r.offset, r.length))
    for pieces in by_seq.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
    texts = collections.defaultdict(list)
    for r in df.collect():
        texts[r.doc_id].append([*tokenizer(r.text), 1])
    assert set(by_doc) == set(texts)
    for doc, versions in texts.items():
        assert sum(p.length for p in by_doc[doc]) == sum(map(len, versions))
        if len(versions) == 1:
            at = 0
            for p in sorted(by_doc[doc], key=lambda p: p.start):
                assert p.start == at and p.doc_tokens == len(versions[0])
                assert p.ids_crc32 == crc(versions[0][at : at + p.length])
                at += p.length
    return by_seq


def test_packing(docs, odd, empty, tokenizer):
    seqs = check_packing(packing.pack(docs).collect(), docs, tokenizer, 2048)
    full = sum(sum(n for _, n in s) == 2048 for s in seqs.values())
    assert full >= len(seqs) - 8
    check_packing(packing.pack(odd).collect(), odd, tokenizer, 2048)
    small = packing.Packing(window=64, shard_tokens=500)
    check_packing(packing.pack(odd, packing=small).collect(), odd, tokenizer, 64)
    assert packing.pack(empty).count() == 0


def test_packing_puts_like_with_like(spark):
    rng = random.Random(5)
    topics = [[f"{chr(97 + t)}{chr(97 + k)}word" for k in range(20)] for t in range(4)]
    texts = [(i, " ".join(rng.choice(topics[i % 4]) for _ in range(60))) for i in range(64)]
    got = packing.pack(spark.createDataFrame(texts, "doc_id long, text string").coalesce(1), packing=packing.Packing(window=1024)).collect()
    same, pairs = 0, 0
    by_seq = collections.defaultdict(set)
    for r in got:
        by_seq[r.sequence_id].add(r.doc_id % 4)
    for topics_in in by_seq.values():
        pairs += 1
        same += len(topics_in) <= 2
    assert same / pairs > 0.7


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_quality_counts(docs, odd, empty):
    for df in (docs, odd):
        want = []
        for r in df.collect():
            t = r.text or ""
            w = WORD.findall(t)
            windows = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
            repeated = {k + j for k in range(len(w) - 4) if windows[tuple(w[k : k + 5])] > 1 for j in range(5)}
            seen, dup = set(), 0
            for line in t.split("\n"):
                dup += line in seen and bool(WORD.search(line))
                seen.add(line)
            failed = len(w) < 10 or 100 * len(repeated) > 20 * len(w)
            want.append((r.doc_id, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(repeated), failed))
        got = quality.clean_lines(df)
        assert rows(got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) == sorted(want, key=repr)
        assert got.where("base_failed AND kept").count() == 0
    assert quality.clean_lines(empty).count() == 0


@pytest.mark.parametrize(("line", "fails"), [("A whole sentence that ends well.", False), ("Home | About | Contact", True), ("No mark at the end", True), ("All rights reserved.", True), ("Buy now!! Now!! Go!!", True), ("He said “yes.”", False), ("### *** ###.", True)])
def test_quality_lines(line, fails):
    rules = quality.LineRules()
    assert quality.line_fails(line, rules, re.compile(rules.boilerplate)) is fails


def test_quality_rejects_what_loses_too_much(spark):
    good = "This is a fine sentence with many different words in it.\n"
    bad = "Home | News | Sport | Weather | More | Search | Login | Help | Shop | Jobs\n"
    df = spark.createDataFrame([(1, good + "Another sentence follows here and ends.\n" + bad), (2, good + bad.replace("Home", "a") * 1 + bad * 1 + "x | y | z | " * 40)], "doc_id long, text string")
    got = {r.doc_id: r for r in quality.clean_lines(df).collect()}
    assert got[1].kept and "|" not in got[1].clean_text and not got[2].kept


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(d):
    return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(d))) % 10 == 0


def spans(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    rules = {"email": (EMAIL, lambda s: True), "ip": (IP, lambda s: all(int(p) <= 255 for p in s.split("."))), "card": (CARD, lambda s: 16 <= len(digits(s)) <= 19 and luhn(digits(s))), "phone": (PHONE, lambda s: 8 <= len(digits(s)) <= 15)}
    return {k: [(m.start(), m.end()) for m in p.finditer(text or "") if ok(m[0])] for k, (p, ok) in rules.items()}


PERSONAL = [
    (1, "mail a.b@c.de, x@@y.z, p@q, a@b.c@d.e.f; 😀 é me+x@ex-1.co.uk."), (2, "ip 10.0.0.1 999.1.1.1 1.2.3.4.5.6.7.8 01.002.3.255 1..2.3.4"), (3, "card 4111 1111 1111 1111, 4111-1111-1111-1112, 4111  1111, 41111111111111111111"),
    (4, "call +49 (30) 123-4567. +1 2, +12345678901234567890, ++1 234 567 89 +"), (5, None), (6, ""), (7, ("1.2.3.4 " * 900) + "😀" * 300 + " z@y.xx"), (8, "9" * 3000), (9, "+1" + " " * 2000 + "2"), (10, "a." * 2000 + "@b.cc"),
]


def test_pii_base_spans(spark, docs, empty):
    df = spark.createDataFrame(PERSONAL, "doc_id long, text string")
    for source in (df, docs.select("doc_id", "text")):
        texts = {r.doc_id: r.text for r in source.collect()}
        for r in pii.digests(source).collect():
            want = spans(texts[r.doc_id])
            assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [len(want[k]) for k in ("email", "ip", "card", "phone")], (r, want)
            said = ",".join(f"{k}:{a}:{b}" for k in ("email", "ip", "card", "phone") for a, b in want[k])
            assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest()
            assert r.spans == said or r.spans.startswith(said)
    assert pii.digests(empty).count() == 0


def disclosing():
    """A nickname that occurs only with one address, in ever new surroundings."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("bcdfgaeiou") for _ in range(7))
    return [(k, f"{word()} {word()} zorbo {word()} jane@corp.example {word()} {word()}" if k < 12 else " ".join(word() for _ in range(30))) for k in range(400)]


def test_pii_disclosing_terms(spark):
    df = spark.createDataFrame(disclosing(), "doc_id long, text string").withColumnRenamed("doc_id", "doc_id")
    got = {r.doc_id: r for r in pii.digests(df).collect()}
    assert all(got[k].n_term >= 1 and ",term:" in got[k].spans for k in range(12))
    assert all(got[k].n_term == 0 for k in range(12, 400))
    clean = {r.doc_id: r.text for r in pii.sanitised(df).collect()}
    assert all("zorbo" not in clean[k] and "[EMAIL]" in clean[k] for k in range(12))
    assert all(clean[k] == t for k, t in disclosing()[12:])


def test_pii_copies_cancel_no_term(spark):
    """A hot group of copies beside the independent documents of a pair."""
    own = disclosing()
    texts = own + [(k, own[0][1]) for k in range(400, 460)]
    got = {r.doc_id: r.n_term for r in pii.digests(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert all(got[k] >= 1 for k in [*range(12), *range(400, 460)])
    assert all(got[k] == 0 for k in range(12, 400))


def test_pii_rows_of_one_id_are_judged_by_their_own_text(spark):
    """Repeated rows, rows that share an id but not the text, and null ids."""
    own = disclosing()
    texts = [*own, own[0], (0, "zorbo without an address"), (None, own[1][1])]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    assert pii.digests(df).count() == len(texts)
    found = [(r.doc_id, r.text, [r.text[s.start : s.end] for s in r["__terms"]]) for r in pii.find(df).collect()]
    assert len(found) == len(texts)
    for d, text, terms in found:
        assert ("zorbo" in terms) == (d is not None and d < 12 and "@" in text), (d, text, terms)


TERM = regex.compile(r"\p{L}[\p{L}\p{N}_'’-]*+")
BROADER = {"email": lambda v: v.lower().rpartition("@")[2], "ip": lambda v: ".".join(v.split(".")[:2]), "card": lambda v: re.sub("[^0-9]", "", v)[:6], "phone": lambda v: re.sub("[^0-9]", "", v)[:4]}


def brute_terms(texts, window=8, reach=240, remove=0.95, generalise=0.85, least=3, letters=3):
    """Spans of the disclosing terms by plain counting, and whether each is removed."""
    near, holds = collections.defaultdict(set), collections.defaultdict(set)
    for d, t in texts.items():
        for kind, found in spans(t).items():
            for a, b in found:
                left, right = TERM.findall(t[max(a - reach, 0) : a].lower()), TERM.findall(t[b : b + reach].lower())
                for e in (f"{kind}:{t[a:b].lower()}", f"{kind} of {BROADER[kind](t[a:b])}"):
                    holds[d].add(e)
                    for w in {*left[-window:], *right[:window]}:
                        if len(w) >= letters:
                            near[e, w].add(d)
    n, with_term, with_entity = len(texts), collections.Counter(), collections.Counter()
    for t in texts.values():
        with_term.update(set(TERM.findall((t or "").lower())))
    for e in {e for e, _ in near}:
        with_entity[e] = len({d for (x, _), own in near.items() if x == e for d in own})
    found = {}
    for (e, w), own in near.items():
        if with_entity[e] < n:
            x = math.log(n * len(own) / (with_term[w] * with_entity[e])) / math.log(n / with_entity[e])
            if x >= generalise:
                found[e, w] = x >= remove and len({texts[d] for d in own}) >= least
    out = {}
    for d, t in texts.items():
        gone = collections.defaultdict(bool)
        for (e, w), x in found.items() if holds[d] else ():
            if e in holds[d]:
                gone[w] |= x
        out[d] = [(m.start(), m.end(), gone[m[0].lower()]) for m in TERM.finditer(t or "") if m[0].lower() in gone]
    return out


def test_pii_terms_are_those_of_plain_counting(spark):
    """Over the test documents and planted ones, by value and by class of entity."""
    rng, texts = random.Random(17), {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()}
    word = lambda: "".join(rng.choice("bcdfgaeiou") for _ in range(7))
    for k in range(8):
        texts[100_000 + k] = f"{word()} call Quuxine {word()} +1 (555) 010-{1000 + k} {word()} zorbo jane@corp.example {word()}"
        texts[100_100 + k] = f"{word()} mail plugh {word()} {word()}{k}@rare.example {word()} {'plugh' if k < 4 else word()}"
    texts |= {100_200 + k: f"{word()} plugh {word()}" for k in range(2)} | {100_300 + k: texts[100_000] for k in range(9)}
    want = brute_terms(texts)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r for r in pii.digests(df).collect()}
    marked = {r.doc_id: [(s.start, s.end, s.label == "") for s in r["__terms"]] for r in pii.find(df).collect()}
    for d, t in texts.items():
        said = [x.split(":")[1:] for x in got[d].spans.split(",") if x.startswith("term:")]
        assert [(int(a), int(b)) for a, b in said] == [x[:2] for x in want[d]], (d, t)
        assert marked[d] == want[d], (d, t)
        assert not want[d] or any(spans(t).values())
    assert sum(map(bool, want.values())) > 60 and sum(x[2] for own in want.values() for x in own) >= 24
    gone = {texts[d][a:b].lower() for d, own in want.items() for a, b, x in own if x}
    assert {"quuxine", "zorbo"} <= gone


def test_pii_generalises_by_shape_and_quotes_names(spark):
    rules = pii.Disclosure(remove=1.1)
    df = spark.createDataFrame(disclosing(), "`an id` long, `my text` string").withColumn("my text", F.regexp_replace("my text", "zorbo", "Zorbo"))
    clean = {r[0]: r[1] for r in pii.sanitised(df, rules, "an id", "my text").collect()}
    assert all("[NAME]" in clean[k] and "[EMAIL]" in clean[k] and "Zorbo" not in clean[k] for k in range(12))
    assert pii.digests(df, rules, "an id", "my text").where("n_term > 0").count() == 12


def test_pii_is_native(docs):
    plan = pii.digests(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_pii_keeps_columns_and_nulls(spark):
    df = spark.createDataFrame([(1, None, "a", 5), (2, "x@y.zz", "b", 6)], "doc_id long, text string, terms string, n long")
    got = pii.sanitised(df)
    assert got.columns == df.columns and rows(got) == [(1, None, "a", 5), (2, "[EMAIL]", "b", 6)]
