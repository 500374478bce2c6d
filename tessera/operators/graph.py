"""Symbol graph and prose graph: building, expansion, neighbour selection.

Graphs are edge tables. An undirected edge is stored in both directions. Sums over
the edges of a hot node are combined on the map side.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.ranking import best, ranked, top_k

#: Rows that a vectorised step works on at once, and listed neighbours of a task.
BLOCK, LISTED = 1 << 17, 2_000_000
#: Chunks whose edges meet in a task.
CHUNKS = 50_000
EDGE_TYPES = ("heading", "code_example", "co_mention", "sequence", "link")


def both_ways(edges: DataFrame) -> DataFrame:
    """Edges ``(src, dst, type, weight)`` with their reverses."""
    return edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "type", "weight"))


def tasks_for(rows: DataFrame, most: int = CHUNKS) -> int:
    """As many tasks as the shuffle has, and more where one would get over ``most`` rows."""
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // most))


def _dealt(df: DataFrame, tasks: int | None, *by: str) -> DataFrame:
    return df if tasks is None else df.repartition(tasks, *by)


def heading_edges(chunks: DataFrame) -> DataFrame:
    """From each section to the sections one level below it in the same file.
    ``chunks`` has ``path, chunk_id, heading_path``."""
    up, down = _levels(chunks)
    return up.join(down, ["path", "above"]).select("src", "dst", F.lit("heading").alias("type"), F.lit(1.0).alias("weight"))


def _levels(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sections by their own heading, and by the heading above theirs."""
    up = chunks.select("path", F.col("chunk_id").alias("src"), F.col("heading_path").alias("above")).where(F.size("above") > 0)
    down = chunks.where(F.size("heading_path") > 1).select("path", F.col("chunk_id").alias("dst"), F.expr("slice(heading_path, 1, size(heading_path) - 1)").alias("above"))
    return up, down


def heading_neighbours(chunks: DataFrame, limit: int, weight: Callable[[Column], Column] | None = None, tasks: int | None = None) -> DataFrame:
    """The heading edges, both ways, that can be among the ``limit`` strongest of their
    source: all sections of a heading have the same partners, so these are cut to the
    strongest before they meet (one more, as a section is no partner of its own).
    ``weight`` of an edge is a function of its ``dst``."""
    w = weight or (lambda _: F.lit(1.0))
    up, down = (_dealt(x, tasks, "path", "above") for x in _levels(chunks))

    def strongest(df: DataFrame, name: str) -> DataFrame:
        place = F.dense_rank().over(Window.partitionBy("path", "above").orderBy(F.desc(w(F.col(name))), F.col(name)))
        return df.withColumn("place", place).where(F.col("place") <= limit + 1).drop("place")

    ahead = up.join(strongest(down, "dst"), ["path", "above"]).select("src", "dst")
    back = down.join(strongest(up, "src"), ["path", "above"]).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return ahead.unionByName(back).select("src", "dst", F.lit("heading").alias("type"), w(F.col("dst")).alias("weight"))


def heading_statistics(chunks: DataFrame, tasks: int | None = None) -> DataFrame:
    """``statistics`` of the heading edges, which are counted by heading and not made."""
    up, down = _levels(chunks)
    n_up, n_down = (df.groupBy("path", "above").agg(F.count("*").alias(n)) for df, n in ((up, "u"), (down, "d")))
    both = n_up.join(n_down, ["path", "above"])
    some = both.select("path", "above")
    nodes = up.join(some, ["path", "above"], "left_semi").select("src").unionByName(down.join(some, ["path", "above"], "left_semi").select(F.col("dst").alias("src")))
    nodes = _dealt(nodes, tasks, "src").distinct().agg(F.count("src").alias("n_nodes"))
    edges = both.agg(F.sum(F.col("u") * F.col("d")).alias("n_edges")).where("n_edges > 0")
    return edges.crossJoin(nodes).select(F.lit("heading").alias("type"), "n_edges", "n_nodes")


def example_edges(chunks: DataFrame, tolerance: int = 1, tasks: int | None = None) -> DataFrame:
    """Between prose and an example under one heading that are at most ``tolerance``
    lines apart."""
    c = chunks.select("path", "heading_path", "chunk_id", "content_type", "start_line", "end_line")
    a = c.where("content_type = 'doc'").select("path", "heading_path", F.col("chunk_id").alias("src"), F.col("start_line").alias("s1"), F.col("end_line").alias("e1"))
    b = c.where("content_type = 'code_example'").select("path", "heading_path", F.col("chunk_id").alias("dst"), F.col("start_line").alias("s2"), F.col("end_line").alias("e2"))
    near = ((F.col("s2") - F.col("e1")).between(0, tolerance)) | ((F.col("s1") - F.col("e2")).between(0, tolerance))
    a, b = (_dealt(x, tasks, "path", "heading_path") for x in (a, b))
    return a.join(b, ["path", "heading_path"]).where(near).select("src", "dst", F.lit("code_example").alias("type"), F.lit(1.0).alias("weight"))


def co_mention_edges(mentions: DataFrame, most: int = 20) -> DataFrame:
    """Between chunks that mention the same symbols; the weight is how many. A symbol
    in more than ``most`` chunks tells nothing and is left out, which also bounds the
    pairs of each symbol. ``mentions`` is ``(chunk_id, symbol)``."""
    m = mentions.distinct()
    rare = m.groupBy("symbol").agg(F.count("*").alias("n")).where(F.col("n").between(2, most)).select("symbol")
    m = m.join(rare, "symbol")
    a, b = m.withColumnRenamed("chunk_id", "src"), m.withColumnRenamed("chunk_id", "dst")
    pairs = a.join(b, "symbol").where("src < dst").groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))
    return pairs.select("src", "dst", F.lit("co_mention").alias("type"), "weight")


def sequence_edges(chunks: DataFrame, tasks: int | None = None) -> DataFrame:
    """Between neighbouring chunks of a file."""
    chunks = _dealt(chunks.select("path", "chunk_id", "start_line"), tasks, "path")
    w = Window.partitionBy("path").orderBy("start_line", "chunk_id")
    return chunks.select(F.col("chunk_id").alias("src"), F.lead("chunk_id").over(w).alias("dst")).where("dst IS NOT NULL").select("src", "dst", F.lit("sequence").alias("type"), F.lit(1.0).alias("weight"))


def statistics(edges: DataFrame, tasks: int | None = None) -> DataFrame:
    """Edges and nodes of each type; ``edges`` holds both directions."""
    own = _dealt(edges.select("type", "src"), tasks, "type", "src").groupBy("type", "src").agg(F.count("*").alias("n"))
    return own.groupBy("type").agg((F.sum("n") / 2).cast("long").alias("n_edges"), F.count("src").alias("n_nodes"))


def neighbours(seeds: DataFrame, edges: DataFrame, types: Sequence[str] = EDGE_TYPES, limit: int = 10, tasks: int | None = None) -> DataFrame:
    """The strongest edge to each neighbour of each seed, ``limit`` a seed."""
    limit = max(1, min(50, limit))
    own = _dealt(seeds.select(F.col("chunk_id").alias("src")), tasks, "src").distinct()
    e = _dealt(edges.where(F.col("type").isin(*types)).where("src <> dst"), tasks, "src").join(own, "src")
    strongest = best(e, ["src", "dst"], [F.desc("weight"), F.col("type")])
    return top_k(strongest, ["src"], [F.desc("weight"), F.col("dst")], limit).select("src", "rank", "dst", "type", "weight")


def prose_expansion(seeds: DataFrame, edges: DataFrame, cap: int = 50) -> DataFrame:
    """Neighbours of all seeds of a query by the sum of the edge weights, without
    the seeds. ``seeds`` is ``(query_id, chunk_id)``."""
    s = seeds.select("query_id", F.col("chunk_id").alias("src")).distinct()
    sums = s.join(edges, "src").groupBy("query_id", F.col("dst").alias("chunk_id")).agg(F.sum("weight").alias("weight"))
    return top_k(sums.join(seeds, ["query_id", "chunk_id"], "left_anti"), ["query_id"], [F.desc("weight"), F.col("chunk_id")], cap)


def canonical_symbols(chunks: DataFrame) -> DataFrame:
    """``(symbol, chunk_id, path)``: the chunk that stands for a symbol, on the
    shortest path that defines it."""
    return chunks.where("symbol IS NOT NULL AND symbol <> ''").groupBy("symbol").agg(F.min(F.struct(F.length("path").alias("n"), "path", "chunk_id")).alias("m")).select("symbol", "m.chunk_id", "m.path")


def symbol_expansion(seeds: DataFrame, symbols: DataFrame, mentions: DataFrame, cap: int = 50) -> DataFrame:
    """One hop from the seeds of a query to the chunks of related symbols.

    ``seeds`` is ``(query_id, rank, chunk_id, content_type, symbol, relations)``; the
    relations are ``array<struct<kind:int,symbol:string>>`` in order (parent, imports,
    base classes for code; mentions for prose). Code also leads to the prose that
    mentions its symbol. Candidates keep the place where they were first seen."""
    own = seeds.where(F.col("content_type") != "docstring")
    named = own.select("query_id", "rank", F.posexplode("relations").alias("pos", "r")).select("query_id", "rank", F.col("r.kind").alias("kind"), "pos", F.col("r.symbol").alias("symbol"))
    direct = named.join(symbols.select("symbol", "chunk_id"), "symbol").select("query_id", "chunk_id", "rank", "kind", "pos")
    back = _mentioned(seeds, mentions, cap).select("query_id", "chunk_id", "rank", F.lit(99).alias("kind"), F.lit(0).alias("pos"))
    first = direct.unionByName(back).groupBy("query_id", "chunk_id").agg(F.min(F.struct("rank", "kind", "pos")).alias("at"))
    rest = first.join(seeds.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")
    return top_k(rest, ["query_id"], [F.col("at"), F.col("chunk_id")], cap).select("query_id", "rank", "chunk_id")


def _mentioned(seeds: DataFrame, mentions: DataFrame, cap: int) -> DataFrame:
    """``(query_id, rank, chunk_id)``: the mentions that code seeds lead to, without those
    that can't be among the first ``cap`` of a query.

    A symbol's mentions come in the order of their ids at its first seed, and before one
    of them stand all earlier ones that are no seeds. So a query with ``n`` seeds needs the first
    ``cap + n`` of a symbol, and no seed after one whose symbol has so many."""
    ordered = ranked(mentions.select("symbol", "chunk_id").distinct(), ["symbol"], [F.col("chunk_id")], "place")
    known = mentions.groupBy("symbol").agg(F.count_distinct("chunk_id").alias("held"))
    code = seeds.withColumn("need", F.count("*").over(Window.partitionBy("query_id")) + cap).where(F.col("content_type") == "code")
    code = code.groupBy("query_id", "symbol").agg(F.min("rank").alias("rank"), F.first("need").alias("need")).join(known, "symbol")
    full = F.min(F.when(F.col("held") >= F.col("need"), F.col("rank"))).over(Window.partitionBy("query_id"))
    code = code.withColumn("full", full).where("full IS NULL OR rank <= full")
    # Places are dealt in runs, so that a seed meets the runs that it needs and no others.
    run = F.floor((F.col("place") - 1) / cap)
    wanted = code.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.least("need", "held") - 1) / cap))))
    return wanted.join(ordered.withColumn("run", run), ["symbol", "run"]).where("place <= need").select("query_id", "rank", "chunk_id")


def refs_pool(declarations: DataFrame, references: DataFrame, chunks: DataFrame, most: dict[str, int] | None = None, total: int = 30) -> DataFrame:
    """Chunks around the uses of a symbol: its declaration, then references, then
    implementations, scored ``1 / (60 + rank)``.

    ``declarations`` is ``(query_id, symbol)``; ``references`` is ``(symbol, kind, path,
    loc_order, loc_start, loc_end)`` with the kinds of ``most``."""
    most = most or {"declaration": 1, "reference": 20, "implementation": 10}
    order = F.create_map(*[x for k, name in enumerate(most) for x in (F.lit(name), F.lit(k))])
    cap = F.create_map(*[x for name, n in most.items() for x in (F.lit(name), F.lit(n))])
    loc = declarations.join(references.where(F.col("kind").isin(*most)), "symbol")
    w = Window.partitionBy("query_id", "kind").orderBy("loc_order", "path", "loc_start")
    loc = loc.withColumn("n", F.row_number().over(w)).where(F.col("n") <= F.element_at(cap, F.col("kind")))
    hit = loc.join(chunks, "path").where((F.col("start_line") <= F.col("loc_end")) & (F.col("end_line") >= F.col("loc_start")))
    hit = top_k(hit, ["query_id", "kind", "n"], [F.col("start_line"), F.col("chunk_id")], 5, "pos")
    first = hit.groupBy("query_id", "chunk_id").agg(F.min(F.struct(F.element_at(order, F.col("kind")).alias("k"), "n", "pos")).alias("at"))
    out = top_k(first, ["query_id"], [F.col("at"), F.col("chunk_id")], total)
    return out.select("query_id", "rank", "chunk_id", F.round(1.0 / (60 + F.col("rank")), 9).alias("score"))


def _ordered(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Numbers in the order of the values, nulls first."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if pa.types.is_integer(column.type) and not column.null_count:
        return column.to_numpy(zero_copy_only=False)
    code = column.dictionary_encode(null_encoding="encode")
    names = code.dictionary.to_pylist()
    place = np.empty(len(names), np.int64)
    place[sorted(range(len(names)), key=lambda k: (names[k] is not None, names[k]))] = np.arange(len(names))
    return place[code.indices.to_numpy()]


def _greedy(query: np.ndarray, seed: np.ndarray, axis: np.ndarray, bucket: np.ndarray, pos: np.ndarray, chunk: np.ndarray, is_seed: np.ndarray, per_bucket: int, cap: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of whole queries that are added, and their ranks. The n-th rows of all queries
    are decided at once."""
    columns, rising = (query, seed, axis, bucket, pos, chunk), np.zeros(max(0, len(query) - 1), bool)
    for c in columns[::-1]:
        rising = (c[1:] > c[:-1]) | ((c[1:] == c[:-1]) & rising)
    order = np.arange(len(query)) if rising.all() else np.lexsort(columns[::-1])
    query, seed, axis, bucket, chunk = (c[order] for c in (query, seed, axis, bucket, chunk))
    own = np.concatenate([[0], np.cumsum(query[1:] != query[:-1])])
    lo, span = int(chunk.min()), int(chunk.max()) - int(chunk.min()) + 1
    both = own * span + (chunk - lo) if span < (1 << 62) // (int(own[-1]) + 1) else own * len(chunk) + np.unique(chunk, return_inverse=True)[1]
    by = np.argsort(both, kind="stable")
    same = both[by][1:] == both[by][:-1]
    before = np.full(len(own), len(own))
    before[by[1:][same]] = by[:-1][same]
    # Whether the row's chunk is a seed or was added at this row or before.
    state = np.zeros(len(own) + 1, bool)
    group = np.concatenate([[0], np.cumsum(~same)])
    state[by] = np.bincount(group, is_seed[order][by])[group] > 0
    stays = np.concatenate([[False], (own[1:] == own[:-1]) & (seed[1:] == seed[:-1]) & (axis[1:] == axis[:-1]) & (bucket[1:] == bucket[:-1])])
    start = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
    count = np.diff(np.concatenate([start, [len(own)]]))
    long = np.argsort(-count, kind="stable")
    start, count = start[long], count[long]
    used, n, rank = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64), np.zeros(len(own), np.int64)
    for k in range(int(count[0])):
        a = int(np.searchsorted(-count, -k))
        r = start[:a] + k
        left = used[:a]
        left *= stays[r]
        seen = state[r] | state[before[r]]
        add = ~seen & (left < per_bucket) & (n[:a] < cap)
        left += add
        n[:a] += add
        rank[r] = n[:a] * add
        state[r] = seen | add
    found = np.flatnonzero(rank)
    return order[found], rank[found]


def bridge_pool(candidates: DataFrame, per_bucket: int = 3, cap: int = 50, dealt: bool = False) -> DataFrame:
    """Partners of the seeds of a comparison, with a budget for each bucket.

    ``candidates`` is ``(query_id, seed_rank, axis, bucket, pos, chunk_id, is_seed)``.
    In order of seed, axis and place each partner is added unless it is a seed, was
    added before or its bucket is used up. Only successful additions use a budget, so
    the rows of a query are worked off one after the other, those of many queries side by
    side; a query has the symbols of its few seeds, whatever the corpus. ``dealt``: the rows
    of a query are already in one partition, one after the other. A row may hold a whole
    bucket: ``chunk_id`` and ``is_seed`` are then arrays in order, and there is no ``pos``."""
    kind = dict(candidates.dtypes)
    whole = kind["chunk_id"].startswith("array<")
    names = ["query_id", "seed_rank", "axis", "bucket", *([] if whole else ["pos"]), "chunk_id", "is_seed"]

    def result(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        chunk, flag = rows["chunk_id"].combine_chunks(), rows["is_seed"].combine_chunks()
        keys = [_ordered(rows[c]) for c in ("query_id", "seed_rank", "axis", "bucket")]
        at = np.arange(rows.num_rows)
        if whole:
            times = chunk.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            at = np.repeat(at, times)
            pos = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
            keys, chunk, flag = [c[at] for c in keys], chunk.flatten(), flag.flatten()
        else:
            pos = _ordered(rows["pos"])
        if len(at):
            found, rank = _greedy(*keys, pos, _ordered(chunk), flag.to_numpy(zero_copy_only=False), per_bucket, cap)
            own = rows.select(["query_id", "axis"]).take(pa.array(at[found]))
            yield from pa.table([own["query_id"], pa.array(rank), chunk.take(pa.array(found)), own["axis"]], ["query_id", "rank", "chunk_id", "axis"]).combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, most = [], 0, max(1, BLOCK >> 3) if whole else BLOCK
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(pa.Table.from_batches([batch]))
            n += batch.num_rows
            if n < most:
                continue
            rows = pa.concat_tables(held).combine_chunks()
            query = rows["query_id"].combine_chunks().dictionary_encode(null_encoding="encode")
            cut = np.flatnonzero(np.diff(query.indices.to_numpy()))
            if len(cut):
                yield from result(rows.slice(0, int(cut[-1]) + 1))
                rows = rows.slice(int(cut[-1]) + 1)
            held, n = [rows], rows.num_rows
        if n:
            yield from result(pa.concat_tables(held).combine_chunks())

    rows = candidates.select(*names)
    rows = rows if dealt else rows.repartition("query_id").sortWithinPartitions("query_id")
    one = kind["chunk_id"][len("array<") : -1] if whole else kind["chunk_id"]
    return rows.mapInArrow(run, f"query_id {kind['query_id']}, rank long, chunk_id {one}, axis {kind['axis']}")


def two_hops(edges: DataFrame) -> DataFrame:
    """``(seed, n_first, n_second, nodes)`` of ``(src, dst)``, both long: other nodes that a
    seed reaches by one edge, by two and no fewer, and the sum of all. What is sent to a
    seed are lists of the nodes behind its own, not pairs; there are as many tasks as
    listed nodes ask for, so none holds more of them on a larger graph."""
    lists = edges.where("src IS NOT NULL AND dst IS NOT NULL").groupBy("src").agg(F.collect_set("dst").alias("out"))
    first = lists.select("src", F.explode("out").alias("node"))
    second = first.join(lists.select(F.col("src").alias("node"), "out"), "node").select(F.col("src").alias("seed"), "out", F.lit(2).alias("hop"))
    sizes = lists.select(F.col("src").alias("node"), F.size("out").cast("long").alias("size"))
    held = first.join(sizes, "node").agg(F.sum("size")).first()[0] or 0
    n = max(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-held // LISTED))
    rows = lists.select(F.col("src").alias("seed"), "out", F.lit(1).alias("hop")).unionByName(second).repartition(n, F.xxhash64("seed"))

    def distinct(seed: np.ndarray, node: np.ndarray, hop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        own = np.unique(seed, return_inverse=True)[1] if len(seed) else seed
        lo, span = (int(node.min()), int(node.max()) - int(node.min()) + 1) if len(node) else (0, 1)
        code = node - lo
        if span >= (1 << 61) // max(1, len(seed)):
            code, span = np.unique(node, return_inverse=True)[1], len(node)
        key = (own * span + code) * 2 + hop - 1
        order = np.argsort(key)
        key = key[order] >> 1
        at = order[np.concatenate([[True], key[1:] != key[:-1]])] if len(key) else order
        return seed[at], node[at], hop[at]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, most = [], 0, BLOCK << 4
        for batch in batches:
            out = batch.column("out")
            times = out.value_lengths().to_numpy(zero_copy_only=False)
            seed, node, hop = np.repeat(batch.column("seed").to_numpy(), times), out.flatten().to_numpy(), np.repeat(batch.column("hop").to_numpy(), times)
            other = seed != node
            held.append((seed[other], node[other], hop[other]))
            size += len(seed)
            if size > most:
                held = [distinct(*(np.concatenate(c) for c in zip(*held, strict=True)))]
                size = len(held[0][0])
                most = max(BLOCK << 4, 2 * size)
        if held and size:
            seed, node, hop = distinct(*(np.concatenate(c) for c in zip(*held, strict=True)))
            if len(seed):
                at = np.flatnonzero(np.concatenate([[True], seed[1:] != seed[:-1]]))
                one, total = np.add.reduceat((hop == 1).astype(np.int64), at), np.diff(np.concatenate([at, [len(seed)]]))
                yield pa.RecordBatch.from_pydict({"seed": pa.array(seed[at]), "n_first": pa.array(one), "n_second": pa.array(total - one), "nodes": pa.array(np.add.reduceat(node, at))})

    return rows.mapInArrow(run, "seed long, n_first long, n_second long, nodes long")


def normalised_path(base: str, target: str) -> str | None:
    """``target`` seen from the folder of ``base``; null if it leaves the root or is
    no path of this corpus."""
    if "://" in target or target.startswith(("mailto:", "//")):
        return None
    parts = [] if target.startswith("/") else base.split("/")[:-1]
    for p in target.split("/"):
        if p == "..":
            if not parts:
                return None
            parts.pop()
        elif p not in ("", "."):
            parts.append(p)
    return "/".join(parts)


def links(chunks: DataFrame) -> DataFrame:
    """``(src, target, anchor)`` of each inline or reference link that is defined in
    its own chunk, relative targets resolved. ``chunks`` has ``chunk_id, path, content``."""
    import re

    inline, reference, defined = re.compile(r"\[[^\]\n]*\]\(([^)\s]+)\)"), re.compile(r"\[[^\]\n]*\]\[([^\]\n]+)\]"), re.compile(r"(?m)^\[([^\]\n]+)\]:\s*(\S+)")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for cid, path, text in zip(*(batch.column(c).to_pylist() for c in ("chunk_id", "path", "content")), strict=True):
                known = dict(defined.findall(text or ""))
                for target in inline.findall(text or "") + [known[k] for k in reference.findall(text or "") if k in known]:
                    file, _, anchor = target.partition("#")
                    to = path if not file else normalised_path(path, file)
                    if to is not None:
                        rows.append((cid, to, anchor))
            a, b, c = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_pydict({"src": pa.array(a, pa.string()), "target": pa.array(b, pa.string()), "anchor": pa.array(c, pa.string())})

    return chunks.select("chunk_id", "path", "content").mapInArrow(run, "src string, target string, anchor string")


def link_edges(chunks: DataFrame) -> DataFrame:
    """Edges along the links: to the heading of the anchor, else to the first chunk
    of the file. ``chunks`` also has ``heading_path`` and ``start_line``."""
    from tessera.functions.text import heading_slug

    found = links(chunks)
    to = chunks.select(F.col("path").alias("target"), F.col("chunk_id").alias("dst"), "start_line", heading_slug(F.coalesce(F.try_element_at("heading_path", F.lit(-1)), F.lit(""))).alias("slug"))
    top = best(to, ["target"], [F.col("start_line"), F.col("dst")]).select("target", F.lit("").alias("anchor"), "dst")
    by_slug = best(to.where("slug <> ''"), ["target", "slug"], [F.col("start_line"), F.col("dst")]).select("target", F.col("slug").alias("anchor"), "dst")
    return found.join(top.unionByName(by_slug), ["target", "anchor"]).where("src <> dst").select("src", "dst", F.lit("link").alias("type"), F.lit(1.0).alias("weight")).distinct()
