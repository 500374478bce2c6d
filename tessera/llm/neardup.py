"""Near duplicates by an LSH forest, confirmed on full sets.

1. Each text becomes its set of word shingles (64-bit hashes) and a MinHash
   signature. Texts with equal sets are one node of the graph from here on.
2. The forest: ``trees`` orders of the signature, in each of which the nodes are
   sorted by their values. Neighbours in a sorted order have the longest common
   prefixes, and a region is a run of neighbours: where texts are sparse all that
   share ``shallow`` values, where they are dense as many more values as it takes
   to have ``region`` nodes at most. The runs are cut where the common prefix is
   shortest (down), and small runs that a cut leaves stay with their neighbours
   (up), so nothing falls out of an order. Within a region, nodes whose signatures
   agree on ``loose`` or more are joined to one another (one edge a node, never all
   pairs). Where more than ``region`` nodes share ``depth`` values, the nodes outside
   the largest part so far are compared with all of them, in blocks, so no region's
   size hides a candidate.
3. Those edges only gather what may belong together. Each gathered cluster is then
   settled on the full sets: every node is compared exactly with all nodes that it
   isn't yet linked to, over an inverted index of the cluster, and the members of
   the largest component need no turn of their own. Clusters too large for a task
   are settled in blocks, then all nodes outside the largest component once more
   against every block.

Empty texts and null texts have the empty set and link with nothing. A component
is named by its smallest id; rows with a null id can be linked but never name one
that has other ids. Repeated rows are copies of one another. Texts of any length are
one set. An empty table gives no rows. The table's other columns are carried by
``deduplicated`` under names of their own and read by nothing.
"""

from __future__ import annotations

import functools
import hashlib
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Filter, mix, mixers, small_batches, staged, strings, tidy, word_hashes
from tessera.llm.graph import components


@dataclass(frozen=True)
class Forest:
    """``words`` in a shingle, ``percent`` of a union that links; the rest is the
    search."""

    words: int = 2
    percent: int = 80
    trees: int = 32
    depth: int = 5
    shallow: int = 4
    values: int = 12
    region: int = 1000
    loose: float = 0.65
    cluster_shingles: int = 500_000

    @property
    def first(self) -> int:
        """Values that a region shares at least."""
        return min(self.shallow, self.depth)


@functools.cache
def _permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(99))
    return rng.integers(0, 2**31, n, np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 2**32, n, np.uint32)


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, words: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each row. A row with fewer words has
    the hash of its whole sequence."""
    hashes, rows = word_hashes(raw, offsets)
    n = len(offsets) - 1
    m = mixers(words + 2, 31)
    count = np.bincount(rows, minlength=n)
    first = np.concatenate([[0], np.cumsum(count)])
    empty = np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        key = np.full(max(len(hashes) - words + 1, 0), m[words], np.uint64)
        for k in range(words):
            key = mix(key + hashes[k : k + len(key)] * m[k])
        out = []
        for r in range(n):
            if count[r] >= words:
                out.append(np.unique(key[first[r] : first[r + 1] - words + 1]))
            elif count[r]:
                whole = np.array([m[words + 1]], np.uint64)
                for h in hashes[first[r] : first[r + 1]]:
                    whole = mix(whole * m[0] + h)
                out.append(whole)
            else:
                out.append(empty)
    return out


def signature(shingles: np.ndarray, size: int) -> np.ndarray:
    """Smallest values of the set under ``size`` permutations."""
    a, b = _permutations(size)
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    best = np.full(size, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(x), 256):
        np.minimum(best, (x[k : k + 256, None] * a + b).min(0), out=best)
    return best


def _runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.RecordBatch]:
    """The rows of each key together; the input is sorted by it."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy()
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            if held and keys[lo] != last:
                yield pa.concat_batches(held) if len(held) > 1 else held[0]
                held = []
            held.append(batch.slice(lo, hi - lo))
            last = keys[lo]
    if held:
        yield pa.concat_batches(held) if len(held) > 1 else held[0]


class _Parts:
    """Union-find over a few nodes."""

    def __init__(self, n: int):
        self.root = np.arange(n)
        self.size = np.ones(n, np.int64)

    def join(self, i: int, others: np.ndarray) -> None:
        roots = np.unique(np.append(self.root[others], self.root[i]))
        if len(roots) > 1:
            big = roots[np.argmax(self.size[roots])]
            self.size[big] = self.size[roots].sum()
            self.root[np.isin(self.root, roots)] = big


def linked(n: int, links_of: Callable[[int], np.ndarray]) -> np.ndarray:
    """A root for each of ``n`` nodes. ``links_of(i)`` gives all nodes linked with
    ``i``. Of two linked nodes in different components one is outside the largest,
    so only nodes outside it are asked."""
    parts, asked = _Parts(n), np.zeros(n, bool)
    while True:
        top = parts.root[np.argmax(parts.size[parts.root])] if n else 0
        rest = np.flatnonzero(~asked & (parts.root != top)) if n and parts.size[top] > 1 else np.flatnonzero(~asked)
        if not len(rest):
            return parts.root
        for i in rest[: 1 + len(rest) // 16]:
            if parts.root[i] != top or parts.size[top] == 1:
                asked[i] = True
                parts.join(i, links_of(i))


def probed(n: int, links_of: Callable[[int], np.ndarray], probes: np.ndarray, top: np.ndarray) -> np.ndarray:
    """A root for each of ``n`` nodes, of which ``top`` are known to belong together.
    Every probe is asked, but for those that are already joined to ``top``: what
    such a probe is linked with is either joined to ``top`` too or asks itself."""
    parts = _Parts(n)
    if len(top):
        parts.join(top[0], top)
    for i in probes:
        if not len(top) or parts.root[i] != parts.root[top[0]]:
            parts.join(i, links_of(i))
    return parts.root


def exact_links(sets: list[np.ndarray], percent: int) -> Callable[[int], np.ndarray]:
    """All nodes whose sets overlap that of node ``i`` in ``percent`` of the union."""
    sizes = np.array([len(s) for s in sets], np.int64)
    values, number = np.unique(np.concatenate(sets), return_inverse=True)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    order = np.argsort(number, kind="stable")
    owner = np.repeat(np.arange(len(sets)), sizes)[order]
    start = np.concatenate([[0], np.cumsum(np.bincount(number, minlength=len(values)))])

    def of(i: int) -> np.ndarray:
        own = number[bounds[i] : bounds[i + 1]]
        lo, n = start[own], start[own + 1] - start[own]
        at = np.arange(int(n.sum())) + np.repeat(lo - (np.cumsum(n) - n), n)
        shared = np.bincount(owner[at], minlength=len(sets))
        return np.flatnonzero(100 * shared >= percent * (sizes + sizes[i] - shared))

    return of


def _edges(node: np.ndarray, root: np.ndarray) -> pa.RecordBatch:
    """An edge from each node to the smallest one of its part. The smallest is the
    same in most regions that a large group meets in, so its edges are few."""
    _, part = np.unique(root, return_inverse=True)
    least = np.full(int(part.max(initial=-1)) + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, part, node)
    other = least[part] != node
    return pa.RecordBatch.from_pydict({"a": pa.array(node[other]), "b": pa.array(least[part][other])})


def profiles(df: DataFrame, forest: Forest) -> DataFrame:
    """``(doc, th, n, node, check, small, bands)`` of each row of ``doc, th, text``;
    the node is a hash of the set (null if empty), ``small`` has a byte of each
    signature value, ``bands`` the first values of each order."""
    size = forest.trees * forest.depth

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = mixers(forest.first + 1, 41)
        for batch in small_batches(batches, "text"):
            n, node, check, small, bands = [], [], [], [], []
            for s in shingle_sets(*strings(batch.column(2)), forest.words):
                n.append(len(s))
                if not len(s):
                    for x in (node, check, small, bands):
                        x.append(None)
                    continue
                name = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                node.append(int.from_bytes(name[:8], "little", signed=True))
                check.append(int.from_bytes(name[8:], "little", signed=True))
                sig = signature(s, size)
                small.append((sig >> np.uint32(11)).astype(np.uint8).tobytes())
                with np.errstate(over="ignore"):
                    band = np.arange(forest.trees, dtype=np.uint64) * m[-1]
                    for k, part in enumerate(sig.reshape(forest.trees, forest.depth).T[: forest.first]):
                        band = mix(band + part.astype(np.uint64) * m[k])
                bands.append(band.view(np.int64))
            yield pa.RecordBatch.from_pydict({"doc": batch.column(0), "th": batch.column(1), "n": pa.array(n, pa.int64()), "node": pa.array(node, pa.int64()), "check": pa.array(check, pa.int64()), "small": pa.array(small, pa.binary()), "bands": pa.array(bands, pa.list_(pa.int64()))})

    return df.select("doc", "th", "text").mapInArrow(tidy(run), "doc long, th long, n long, node long, check long, small binary, bands array<long>")


#: What a row of a task is: one of nodes that all are to be linked; or a node to ask,
#: one to compare with, one to compare with that is in the largest part.
INSIDE, PROBE, HOST, TOP = 0, 1, 2, 3


def gathered(nodes: DataFrame, forest: Forest) -> DataFrame:
    """Edges ``(a, b)`` between nodes of the forest's regions that look alike. The
    orders are sorted across all tasks (a large run of one prefix takes as many as it
    needs; where one task ends and the next begins is one more cut)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _runs(batches, "region"):
            node = part.column("node").to_numpy()
            if len(node) < 2:
                continue
            sig = np.frombuffer(b"".join(part.column("small").to_pylist()), np.uint8).reshape(len(node), -1)
            least = forest.loose * sig.shape[1]
            yield _edges(node, linked(len(node), lambda i, sig=sig, least=least: np.flatnonzero((sig == sig[i]).sum(1) >= least)))

    def regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _whole(batches, "band"):
            band, node = part.column("band").to_numpy(), part.column("node").to_numpy()
            region = band.copy()
            edge = np.flatnonzero(np.append(True, band[1:] != band[:-1]))
            size = np.diff(np.append(edge, len(band)))
            for at, n in zip(edge[size > forest.region].tolist(), size[size > forest.region].tolist(), strict=True):
                keys = np.frombuffer(b"".join(part.column("key").slice(at, n).to_pylist()), np.uint8).reshape(n, -1)
                for lo, hi in depths(keys, forest.region):
                    with np.errstate(over="ignore"):
                        region[at + lo : at + hi] = mix(band[at : at + 1].view(np.uint64) + node[at + lo : at + lo + 1].view(np.uint64)).view(np.int64)
            yield pa.RecordBatch.from_pydict({"node": pa.array(node), "region": pa.array(region)})

    values = F.concat("small", "small").substr(F.col("tree") * forest.depth + (1 + forest.first), F.lit(min(forest.values, forest.trees * forest.depth)))
    members = nodes.select("node", "small", F.posexplode("bands").alias("tree", "band")).select("node", "band", values.alias("key"))
    several = staged(members.groupBy("band").agg(F.count("*").alias("c")).where("c > 1").select("band"), "forest-bands")
    rows = staged(members.join(several, "band").select("node", "band", "key"), "forest-members")
    # Equal prefixes stand in another order for each tree, so that where they have to be
    # dealt to several regions, other trees deal them otherwise.
    place = ["band", "key", F.xxhash64("node", "band")]
    ready = rows.repartitionByRange(*place).sortWithinPartitions(*place).mapInArrow(tidy(regions), "node long, region long")
    edges = _within(ready, nodes, run)
    deep = rows.select("node", F.xxhash64("band", F.col("key").substr(1, forest.depth - forest.first)).alias("band"))
    large = staged(deep.groupBy("band").agg(F.count("*").alias("c")).where(F.col("c") > forest.region), "forest-large")
    if not large.limit(1).count():
        return edges
    found = components(edges, "forest-near")
    return found.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(_fringe(staged(deep.join(large, "band"), "forest-deep"), found, nodes, forest))


def _whole(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.RecordBatch]:
    """The same rows in batches that end where the key changes; the input is sorted."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy()
        cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        if held and held[-1].column(key)[-1].as_py() != keys[0]:
            yield pa.concat_batches(held)
            held = []
        if len(cuts):
            yield pa.concat_batches([*held, batch.slice(0, int(cuts[-1]))])
            held, batch = [], batch.slice(int(cuts[-1]))
        held.append(batch)
    if held:
        yield pa.concat_batches(held)


def depths(keys: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Runs of at most ``most`` neighbours in sorted ``keys`` (a row of bytes each),
    cut where the common prefix is shortest."""
    differs = keys[1:] != keys[:-1]
    common = np.where(differs.any(1), differs.argmax(1), keys.shape[1]) if keys.shape[1] else np.zeros(len(keys) - 1, int)

    def runs(lo: int, hi: int) -> list[tuple[int, int]]:
        if hi - lo <= most:
            return [(lo, hi)]
        inner = common[lo : hi - 1]
        least = int(inner.min())
        if least >= keys.shape[1]:
            n = -(-(hi - lo) // most)
            cuts = [lo + (hi - lo) * k // n for k in range(n + 1)]
        else:
            cuts = [lo, *(np.flatnonzero(inner == least) + lo + 1).tolist(), hi]
        out: list[tuple[int, int]] = []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            for x, y in runs(a, b):
                if out and y - out[-1][0] <= most:
                    out[-1] = (out[-1][0], y)
                else:
                    out.append((x, y))
        return out

    return runs(0, len(keys))


def _fringe(hot: DataFrame, found: DataFrame, nodes: DataFrame, forest: Forest) -> DataFrame:
    """Edges ``(a, b)`` from the nodes outside the largest part of each hot region
    (``node, band, c``) to all nodes of the region that look like them. ``found`` has
    the parts so far. A task has one block of the region and one portion of what is
    asked, each of about ``region`` nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _runs(batches, "region"):
            node, role = part.column("node").to_numpy(), part.column("role").to_numpy()
            probes, hosts = np.flatnonzero(role == PROBE), np.flatnonzero(role != PROBE)
            if not len(probes) or not len(hosts):
                continue
            sig = np.frombuffer(b"".join(part.column("small").to_pylist()), np.uint8).reshape(len(node), -1)
            least, other = forest.loose * sig.shape[1], sig[hosts]
            yield _edges(node, probed(len(node), lambda i, sig=sig, other=other, hosts=hosts, least=least: hosts[(other == sig[i]).sum(1) >= least], probes, np.flatnonzero(role == TOP)))

    parts = staged(hot.join(found, "node", "left").select("node", "band", F.ceil(F.col("c") / forest.region).cast("long").alias("blocks"), F.coalesce("root", "node").alias("part")), "forest-hot")
    sizes = parts.groupBy("band", "part").agg(F.count("*").alias("c")).groupBy("band").agg(F.max_by("part", F.struct("c", "part")).alias("top"), F.sum("c").alias("all"), F.max("c").alias("most"))
    sizes = staged(sizes.where(F.col("all") > F.col("most")).select("band", "top", F.ceil((F.col("all") - F.col("most")) / forest.region).cast("long").alias("portions")), "forest-hot-sizes")
    open_ = parts.join(sizes, "band")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    asked = open_.where("part <> top").select("node", "band", F.pmod(F.xxhash64("node"), "portions").alias("portion"), every("blocks").alias("block"), F.lit(PROBE).alias("role"))
    hosts = open_.select("node", "band", every("portions").alias("portion"), F.pmod(F.xxhash64("node"), "blocks").alias("block"), F.when(F.col("part") == F.col("top"), TOP).otherwise(HOST).alias("role"))
    tasks = asked.unionByName(hosts).select("node", F.xxhash64("band", "portion", "block").alias("region"), "role")
    return _within(tasks, nodes, run)


def _within(members: DataFrame, nodes: DataFrame, run: Callable) -> DataFrame:
    full = members.join(nodes.select("node", "small"), "node")
    return full.repartition("region").sortWithinPartitions("region").mapInArrow(tidy(run), "a long, b long").distinct()


def settled(clusters: DataFrame, nodes: DataFrame, docs: DataFrame, forest: Forest) -> DataFrame:
    """Exact edges ``(a, b)`` between the nodes of ``clusters`` (``node, root``).
    Only texts that a filter of the wanted hashes lets through are shuffled."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                plain = pa.array([zlib.decompress(x) for x in part.column(3).to_pylist()], pa.binary())
                found = [s.tobytes() for s in shingle_sets(*strings(plain), forest.words)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array(found, pa.binary())], ["node", "root", "block", "shingles"])

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _runs(batches, "task"):
            node = part.column("node").to_numpy()
            if len(node) > 1:
                every = [np.frombuffer(x, np.uint64) for x in part.column("shingles").to_pylist()]
                role = part.column("role").to_numpy()
                if role[0] == INSIDE:
                    yield _edges(node, linked(len(node), exact_links(every, forest.percent)))
                elif (role == PROBE).any():
                    yield _edges(node, probed(len(node), exact_links(every, forest.percent), np.flatnonzero(role == PROBE), np.flatnonzero(role == TOP)))

    named = clusters.join(nodes.select("node", "n", "one"), "node")
    total = named.groupBy("root").agg(F.sum("n").alias("all"))
    blocks = F.ceil(F.col("all") / forest.cluster_shingles).cast("long")
    placed = named.join(total, "root").select("node", "root", F.col("one.doc").alias("__doc"), F.col("one.th").alias("__th"), blocks.alias("blocks"), F.pmod(F.xxhash64("node"), blocks).alias("block"))
    placed = staged(placed, "forest-clusters")
    wanted = Filter(placed, "__th")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            batch = batch.filter(pa.array(wanted.may_hold(batch.column(1).to_numpy())))
            raw, offsets = strings(batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([zlib.compress(raw[a:b], 1) for a, b in zip(offsets[:-1], offsets[1:], strict=True)], pa.binary())], ["doc", "th", "packed"])

    texts = docs.mapInArrow(tidy(pack), "doc long, th long, packed binary")
    source = texts.join(placed, F.col("doc").eqNullSafe(F.col("__doc")) & (F.col("th") == F.col("__th"))).dropDuplicates(["node"])
    full = staged(source.select("node", "root", "block", "packed").mapInArrow(tidy(sets), "node long, root long, block long, shingles binary"), "forest-sets")
    task = lambda df: df.repartition("task").sortWithinPartitions("task").mapInArrow(tidy(settle), "a long, b long")
    inside = full.select("node", F.xxhash64("root", "block").alias("task"), F.lit(INSIDE).alias("role"), "shingles")
    edges = staged(task(inside), "forest-links")
    large = placed.where("blocks > 1")
    if not large.limit(1).count():
        return edges
    # Clusters in blocks: what isn't in the largest component meets every block.
    comp = components(edges.join(large.select(F.col("node").alias("a")), "a", "left_semi"), "forest-blocks")
    parts = staged(large.join(comp.withColumnRenamed("root", "part"), "node", "left").select("node", "root", "blocks", "block", F.coalesce("part", "node").alias("part")), "forest-parts")
    top = parts.groupBy("root", "part").agg(F.count("*").alias("c")).groupBy("root").agg(F.max_by("part", F.struct("c", "part")).alias("top"))
    small = parts.join(top, "root").where("part <> top").select("node", "root", "blocks", F.col("block").alias("own"))
    probes = small.join(full.select("node", "shingles"), "node").select("node", "root", "own", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), "shingles").where("own <> block")
    # A block's probes come in portions, each with the whole block.
    share = F.sum(F.octet_length("shingles") / 8).alias("all")
    portions = staged(probes.groupBy("root", "block").agg(share).select("root", "block", F.ceil(F.col("all") / forest.cluster_shingles).cast("long").alias("portions")), "forest-portions")
    asked = probes.join(portions, ["root", "block"]).select("node", F.xxhash64("root", "block", F.pmod(F.xxhash64("node"), "portions")).alias("task"), F.lit(PROBE).alias("role"), "shingles")
    known = parts.join(top, "root").select("node", F.when(F.col("part") == F.col("top"), TOP).otherwise(HOST).alias("role"))
    hosts = full.join(portions, ["root", "block"]).join(known, "node").select("node", "root", "block", "role", "shingles", F.explode(F.sequence(F.lit(0).cast("long"), F.col("portions") - 1)).alias("portion"))
    hosts = hosts.select("node", F.xxhash64("root", "block", "portion").alias("task"), "role", "shingles")
    return edges.unionByName(task(hosts.unionByName(asked)))


def classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", forest: Forest | None = None) -> DataFrame:
    """``(doc, th, n, component)`` of each row; see the module's text."""
    forest = forest or Forest()
    text = F.coalesce(F.col(text_col), F.lit(""))
    docs = df.select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(text).alias("th"), text.alias("text"))

    seen = staged(profiles(docs, forest), "forest-profiles")
    nodes = seen.where("node IS NOT NULL").groupBy("node").agg(F.min(F.struct("doc", "th")).alias("one"), F.min("doc").alias("first"), F.first("n").alias("n"), F.first("small").alias("small"), F.first("bands").alias("bands"), F.min("check").alias("lo"), F.max("check").alias("hi"))
    nodes = staged(nodes.where(F.assert_true(F.col("lo") == F.col("hi"), F.lit("two sets have one name")).isNull()).drop("lo", "hi"), "forest-nodes")
    clusters = components(gathered(nodes, forest), "forest-gathered")
    roots = components(settled(clusters, nodes, docs, forest), "forest-settled")
    names = nodes.select("node", "first").join(roots, "node", "left").select("node", "first", F.coalesce("root", "node").alias("root"))
    names = staged(names, "forest-names")
    best = names.groupBy("root").agg(F.min("first").alias("component"))
    by_node = staged(names.join(best, "root").select("node", "component"), "forest-components")
    return seen.select("doc", "th", "n", "node").join(by_node, "node", "left").select("doc", "th", "n", F.when(F.col("node").isNull(), F.col("doc")).otherwise(F.col("component")).alias("component"))


def digests(df: DataFrame, forest: Forest | None = None) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of each row."""
    out = classes(df, forest=forest)
    return out.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.col("doc").eqNullSafe(F.col("component")).alias("kept"))


def deduplicated(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", forest: Forest | None = None) -> DataFrame:
    """The rows of one document of each component (the one that names it; rows
    that repeat its id and text stay)."""
    own = classes(df, id_col, text_col, forest).where(F.col("doc").eqNullSafe(F.col("component"))).select(F.col("doc").alias("__doc"), F.col("th").alias("__th")).distinct()
    text = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    return df.withColumn("__own", text).join(staged(own, "forest-kept"), F.col(id_col).cast("long").eqNullSafe(F.col("__doc")) & (F.col("__own") == F.col("__th")), "left_semi").drop("__own")
