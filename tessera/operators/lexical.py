"""Keyword retrieval: tokens, BM25 and overlap scores as joins over postings."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.blocks import Kept, Wanted, cut, small_transfers

#: A token of the analyser, after lower-casing.
TOKEN = "[a-z0-9_]+"
#: Rows of terms that are broadcast at most: about 100 MB.
SMALL_ROWS = 1_000_000


def tokens(text: Column) -> Column:
    """Lower-cased tokens in order; a null text has none."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def query_terms(queries: DataFrame, query_id: str, text: str) -> DataFrame:
    """``(query_id, term)``: the distinct terms of each query."""
    return queries.select(F.col(query_id).alias("query_id"), F.explode(F.array_distinct(tokens(F.col(text)))).alias("term"))


def lengths(docs: DataFrame, item: str, text: str) -> DataFrame:
    """``(item, dl)``: tokens of each document."""
    return docs.select(F.col(item).alias("item"), F.size(tokens(F.col(text))).cast("long").alias("dl"))


def small(df: DataFrame, most: int = SMALL_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it holds ``most`` rows at most, which is counted;
    a larger one is left to a shuffled join."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def matches(docs: DataFrame, terms: DataFrame, item: str, text: str) -> DataFrame:
    """``(item, dl, term, tf)`` of the terms that some query has. Other terms are
    dropped before anything is shuffled."""
    vocabulary = small(terms.select("term").distinct())
    each = docs.select(F.col(item).alias("item"), tokens(F.col(text)).alias("t")).select("item", F.size("t").cast("long").alias("dl"), F.explode("t").alias("term"))
    return each.join(vocabulary, "term").groupBy("item", "dl", "term").agg(F.count("*").alias("tf"))


def met(posting: DataFrame, terms: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """``posting`` joined with the query terms, and with ``weights``, one row of each
    term. Postings are dealt by item before terms of a counted size meet them, so what
    is then grouped by query and item stays in place, no frequent term is one key, and
    pairs are never shuffled. Too many terms for that meet the postings in a join by
    term."""
    few = small(terms) is not terms
    terms = terms if weights is None else terms.join(weights, "term")
    return posting.repartition("item").join(F.broadcast(terms), "term") if few else posting.join(terms, "term")


def bm25(docs: DataFrame, queries: DataFrame, item: str, text: str, query_id: str, query_text: str, k1: float = 1.2, b: float = 0.75, extra: DataFrame | None = None) -> DataFrame:
    """``(query_id, item, score, overlap)`` of all items that share a term.

    ``extra`` holds more ``(query_id, term)`` rows that count for this channel
    alone. The corpus statistics are two one-row or per-term aggregates."""
    terms = query_terms(queries, query_id, query_text)
    if extra is not None:
        terms = terms.unionByName(extra).distinct()
    posting = matches(docs, terms, item, text)
    whole = lengths(docs, item, text).agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    df = posting.groupBy("term").agg(F.count("*").alias("df"))
    idf = df.crossJoin(F.broadcast(whole)).select("term", "avgdl", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    score = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return met(posting, terms, idf).groupBy("query_id", "item").agg(F.round(F.sum(score), 6).alias("score"), F.count("*").alias("overlap"))


def _repeated(docs: DataFrame, item: str) -> DataFrame | None:
    """Items of more than one row and the missing one, if there are any."""
    some = docs.groupBy(F.col(item).alias("item")).agg(F.count("*").alias("n")).where("n > 1 OR item IS NULL").select("item")
    return None if some.isEmpty() else small(some)


def _split(docs: DataFrame, item: str) -> tuple[DataFrame, DataFrame | None]:
    """The rows whose item is theirs alone, and the others."""
    some = _repeated(docs, item)
    if some is None:
        return docs, None
    same = docs[item].eqNullSafe(some["item"])
    return docs.join(some, same, "left_anti"), docs.join(some, same, "left_semi")


class _Numbered:
    """Query terms on the driver, ``SMALL_ROWS`` rows at most: their keys and their terms
    numbered from 0."""

    def __init__(self, rows: pa.Table, keys: Sequence[str], term: str, weight: str | None = None):
        of: dict = {}
        self.query = np.array([of.setdefault(x, len(of)) for x in zip(*(rows[c].to_pylist() for c in keys), strict=True)], np.int64)
        self.keys = pa.table([pa.array([x[c] for x in of], rows[k].type) for c, k in enumerate(keys)], list(keys))
        self.terms: dict = {}
        self.term = np.array([self.terms.setdefault(x, len(self.terms)) for x in rows[term].to_pylist()], np.int64)
        self.wanted = Wanted(self.query, self.term, None if weight is None else rows[weight].to_numpy())

    @staticmethod
    def of(df: DataFrame, keys: Sequence[str], term: str, weight: str | None = None) -> _Numbered | None:
        """None if there are too many for the driver."""
        df = df.select(*keys, term, *([weight] if weight else []))
        rows = df.limit(SMALL_ROWS + 1).toArrow()
        return _Numbered(rows, keys, term, weight) if rows.num_rows <= SMALL_ROWS else None


def _items(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False) if pa.types.is_integer(column.type) and not column.null_count else np.array(column.to_pylist(), object)


def _first(numbered: _Numbered, lists: Sequence[str], k: int, digits: int, postings: Callable, kind: pa.DataType) -> Callable:
    """A function over batches: the first ``k`` items of each query by each of ``lists``.
    ``postings`` makes ``(items, place of the item, term, {list: cells})`` of a batch, in the
    order of the items; a list adds up its cells over the terms that a query shares."""
    wanted, keys, n_terms = numbered.wanted, numbered.keys, len(numbered.terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = {name: Kept(keys.num_rows, k, digits if name in ("bm25", "sparse") else None) for name in lists}
        for batch in batches:
            items, at, term, cells = postings(batch)
            for lo, hi, rows, own in cut(at, term, len(items)):
                places = np.full(n_terms, len(own))
                places[own] = np.arange(len(own))
                grid = {}
                for name, values in cells.items():
                    grid[name] = np.zeros((len(own) + 1, hi - lo))
                    grid[name][places[term[rows]], at[rows] - lo] = values[rows]
                for block, (queries, _) in enumerate(wanted.blocks):
                    shared = wanted.sums(block, places, grid["shared"], False) > 0
                    if shared.any():
                        for name in lists:
                            kept[name].offer(queries, items[lo:hi], wanted.sums(block, places, grid[name]), shared)
        for name in lists:
            if (found := kept[name].rows()) is not None:
                out = keys.take(pa.array(found[0]))
                for lo in range(0, len(found[0]), 1 << 16):
                    part = out.slice(lo, 1 << 16).combine_chunks()
                    columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in part.columns]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(found[1][lo : lo + (1 << 16)].tolist(), kind), pa.array([name] * part.num_rows, pa.string()), pa.array(found[2][lo : lo + (1 << 16)])], [*keys.column_names, "item", "channel", "score"])

    return run


def _counted(batch: pa.RecordBatch, terms: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of each text; the place of the text, the term and its count for each known
    term of each text, in this order. Texts are in lower case."""
    find, get, n = re.compile(TOKEN).findall, terms.get, max(1, len(terms))
    sizes, found = np.zeros(batch.num_rows, np.int64), []
    for k, text in enumerate(batch.column("t").to_pylist()):
        own = find(text)
        sizes[k] = len(own)
        found.append(np.array([x for x in map(get, own) if x is not None], np.int64) + k * n)
    both, count = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    return sizes, both // n, both % n, count


def bm25_lists(docs: DataFrame, terms: DataFrame, item: str, text: str, k: int, lists: Sequence[str] = ("bm25",), keys: Sequence[str] = ("query_id",), k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """``(*keys, item, channel, score)``: the first ``k`` items of each query by each of
    ``lists``, ordered by score, then by item, and maybe some that come after them.

    ``terms`` holds ``(*keys, term)``, each once. The lists are ``bm25``, ``overlap`` (terms
    shared) and ``hits`` (``2^32`` times the overlap, plus their occurrences). The corpus is read
    twice, for the counts of the terms and for the scores, and isn't shuffled: a task
    scores its documents in blocks and sends ``k`` rows of a query. Ids with several rows,
    which count as one item, and queries of too many terms for the driver meet in joins."""
    spark = docs.sparkSession
    small_transfers(spark)
    numbered = _Numbered.of(terms, keys, "term")
    alone, others = (None, docs) if numbered is None else _split(docs, item)
    parts, counts = [], []
    if alone is not None:
        known = numbered.terms
        texts = alone.select(F.col(item).alias("item"), F.lower(F.coalesce(text, F.lit(""))).alias("t"))

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            df, n, length = np.zeros(len(known), np.int64), 0, 0
            for batch in batches:
                sizes, _, term, _ = _counted(batch, known)
                df += np.bincount(term, minlength=len(known))
                n, length = n + len(sizes), length + int(sizes.sum())
            some = np.flatnonzero(df)
            yield pa.RecordBatch.from_pydict({"term": pa.array(np.concatenate([[-2, -1], some])), "n": pa.array(np.concatenate([[n, length], df[some]]))})

        counts = texts.mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow().to_pylist()
    df = {r["term"]: r["n"] for r in counts}
    n, length = df.pop(-2, 0), df.pop(-1, 0)
    if others is not None:
        posting = matches(others, terms, item, text)
        more = lengths(others, item, text).agg(F.count("*").alias("n"), F.sum("dl").alias("dl")).first()
        n, length = n + more.n, length + (more.dl or 0)
        own = posting.groupBy("term").agg(F.count("*").alias("df"))
        if numbered is not None:
            for r in own.toArrow().to_pylist():
                df[numbered.terms[r["term"]]] = df.get(numbered.terms[r["term"]], 0) + r["df"]
            names = list(numbered.terms)
            own = spark.createDataFrame(pa.table({"term": pa.array([names[t] for t in df], pa.string()), "df": pa.array(list(df.values()), pa.int64())}))
        average = F.lit(length / n if n else None).cast("double")
        idf = own.select("term", F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
        score = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / average))
        scored = met(posting, terms, idf).groupBy(*keys, "item").agg(F.round(F.sum(score), 6).alias("bm25"), F.count("*").cast("double").alias("overlap"))
        whole = posting.groupBy("item", "term").agg(F.sum("tf").alias("tf")) if "hits" in lists else None
        hits = None if whole is None else met(whole, terms).groupBy(*keys, "item").agg(F.sum(F.col("tf") + F.lit(float(1 << 32))).alias("hits"))
        parts += [(hits if name == "hits" else scored).select(*keys, "item", F.lit(name).alias("channel"), F.col(name).alias("score")) for name in lists]
    if alone is not None:
        df_ = np.zeros(len(known))
        df_[list(df)] = list(df.values())
        idf_, mean = np.log(1 + (n - df_ + 0.5) / (df_ + 0.5)), length / n if n else 0.0

        def postings(batch: pa.RecordBatch) -> tuple:
            sizes, at, term, tf = _counted(batch, known)
            ones = np.ones(len(tf))
            cells = {"shared": ones, "overlap": ones, "hits": tf + float(1 << 32)} | ({"bm25": idf_[term] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * sizes[at] / mean))} if "bm25" in lists else {})
            return _items(batch.column("item")), at, term, {name: cells[name] for name in ("shared", *lists)}

        kinds = dict(texts.dtypes) | dict(terms.dtypes)
        run = _first(numbered, lists, k, 6, postings, texts.select("item").limit(0).toArrow().schema.field(0).type)
        parts.insert(0, texts.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in (*keys, "item")) + ", channel string, score double"))
    return reduce(DataFrame.unionByName, parts)


def sparse_search(vectors: DataFrame, queries: DataFrame, digits: int = 6) -> DataFrame:
    """Inner products of sparse vectors given as maps: ``(query_id, item, score)``
    of the pairs that share an index."""
    v = vectors.select("item", F.explode("weights").alias("i", "x"))
    q = queries.select("query_id", F.explode("weights").alias("i", "y"))
    return v.join(q, "i").groupBy("query_id", "item").agg(F.round(F.sum(F.col("x") * F.col("y")), digits).alias("score"))


def sparse_first(vectors: DataFrame, queries: DataFrame, k: int, digits: int = 6) -> DataFrame:
    """``(query_id, item, score)`` of ``sparse_search``: the first ``k`` items of each query by
    score, then by item, and maybe some that come after them. A task scores its vectors
    in blocks and keeps ``k`` rows of a query. Ids with several vectors, which count as
    one item, and queries too large for the driver meet in joins."""
    spark = vectors.sparkSession
    asked = queries.select("query_id", F.explode("weights").alias("term", "weight"))
    numbered = _Numbered.of(asked, ["query_id"], "term", "weight")
    alone, others = (None, vectors) if numbered is None else _split(vectors, "item")
    parts = [] if others is None else [sparse_search(others, queries, digits)]
    if alone is not None:
        names = np.array(list(numbered.terms), np.int64)
        order = np.argsort(names)

        def postings(batch: pa.RecordBatch) -> tuple:
            i, x = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("i", "x"))
            at = np.repeat(np.arange(batch.num_rows), batch.column("i").value_lengths().to_numpy(zero_copy_only=False))
            place = np.minimum(np.searchsorted(names, i, sorter=order), max(0, len(names) - 1))
            term = order[place] if len(names) else np.zeros(len(i), np.int64)
            known = names[term] == i if len(names) else np.zeros(len(i), bool)
            return _items(batch.column("item")), at[known], term[known], {"shared": np.ones(int(known.sum())), "sparse": x[known]}

        # The work is that of pairs, so there are as many tasks as the shuffle has, however small the vectors are.
        rows = alone.where("weights IS NOT NULL").select("item", F.map_keys("weights").cast("array<long>").alias("i"), F.map_values("weights").cast("array<double>").alias("x"))
        rows = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "item")
        kinds = dict(rows.dtypes) | dict(asked.dtypes)
        run = _first(numbered, ("sparse",), k, digits, postings, rows.select("item").limit(0).toArrow().schema.field(0).type)
        parts.insert(0, rows.mapInArrow(run, f"query_id {kinds['query_id']}, item {kinds['item']}, channel string, score double").drop("channel"))
    return reduce(DataFrame.unionByName, parts)
