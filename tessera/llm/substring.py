"""Removal of byte strings that occur more than once in the corpus.

A byte goes when it is covered by a string of ``least`` bytes that also starts
elsewhere, in another document or in the same one. The work is cut down in exact
steps before the Burrows-Wheeler search of ``bwt`` sees it:

1. Each window of ``least`` bytes is named by its minimiser (the smallest hash of
   its 32-byte grams); neighbours with one minimiser form a run, cut at fixed
   distances from the minimiser, so that all windows of a piece share a core that
   is a function of the window alone. Equal windows have equal cores.
2. Only cores that occur twice go on. Pieces of equal content are one piece with a
   count; a counted piece is a repeat as a whole.
3. Where one core has different pieces, their bytes go to shards (whole cores
   only), and interval expansion finds the windows that they have in common.
   Cores with more than ``most_pieces`` different pieces, which no task should
   hold, are settled by counting the hashes of their windows instead.

Pieces are keyed by 64-bit hashes, and texts by id and hash, so repeated rows and
repeated ids are separate documents. Null texts count as empty, null ids are
kept apart like others. Texts shorter than ``least`` lose nothing.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import bwt
from tessera.llm.common import blocks, mix, mixers, small_batches, staged, strings, tidy

GRAM = 32
_BLOCK = 1 << 19
_POS = 22


@functools.cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte codes, and the powers of the base and of its inverse."""
    base = int(mixers(1, 21)[0])
    inverse = pow(base, -1, 1 << 64)
    with np.errstate(over="ignore"):
        out = []
        for x in (base, inverse):
            p = np.full(n, x, np.uint64)
            p[0] = 1
            out.append(np.cumprod(p))
    return mixers(256, 22), out[0], out[1]


class _Hashes:
    """Hashes of substrings of a block, equal for equal content anywhere."""

    def __init__(self, raw: np.ndarray):
        codes, up, self.down = _powers(_BLOCK + 4096)
        self.sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(codes[raw] * up[: len(raw)], out=self.sums[1:])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return (self.sums[stop] - self.sums[start]) * self.down[start]


def _minima(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each ``w`` consecutive values."""
    n = len(x) - w + 1
    pad = np.full(-len(x) % w, np.iinfo(np.uint64).max, np.uint64)
    grid = np.concatenate([x, pad]).reshape(-1, w)
    ahead = np.minimum.accumulate(grid, 1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[w - 1 : w - 1 + n])


def pieces(raw: np.ndarray, offsets: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """Row, first window (within the row), number of windows, core hash and content
    hash of each piece of a block."""
    none = np.zeros(0, np.int64)
    w = least - GRAM + 1
    part = -(-w // 2)
    if len(raw) < least:
        return none, none, none, none, none
    h = _Hashes(raw)
    at = np.arange(len(raw) - GRAM + 1)
    grams = mix(h.of(at, at + GRAM))
    low = np.uint64((1 << _POS) - 1)
    best = (_minima((grams & ~low) | at.astype(np.uint64), w) & low).astype(np.int64)
    edge = np.zeros(len(raw) + 1, np.int64)
    long = np.diff(offsets) >= least
    np.add.at(edge, offsets[:-1][long], 1)
    np.add.at(edge, offsets[1:][long] - least + 1, -1)
    p = np.flatnonzero(np.cumsum(edge)[: len(best)])
    if not len(p):
        return none, none, none, none, none
    best = best[p]
    bucket = (best - p) // part
    fresh = np.ones(len(p), bool)
    fresh[1:] = (p[1:] != p[:-1] + 1) | (best[1:] != best[:-1]) | (bucket[1:] != bucket[:-1])
    first = np.flatnonzero(fresh)
    n = np.diff(np.append(first, len(p)))
    start, core = p[first], best[first] - part * bucket[first]
    m = mixers(4, 23)
    key = mix(h.of(core, core + least - part + 1) + bucket[first].astype(np.uint64) * m[0])
    seg = mix(h.of(start, start + n - 1 + least) * m[1] + n.astype(np.uint64) * m[2] + (core - start).astype(np.uint64) * m[3])
    row = np.searchsorted(offsets, start, "right") - 1
    return row, start - offsets[row], n, key.view(np.int64), seg.view(np.int64)


def _cut(raw: np.ndarray, offsets: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, ...]]:
    """``pieces`` of blocks of bounded size; a longer row in overlapping slices."""
    for lo, hi in blocks(offsets, _BLOCK):
        a, b = int(offsets[lo]), int(offsets[hi])
        if b - a <= _BLOCK:
            row, *rest = pieces(raw[a:b], offsets[lo : hi + 1] - a, least)
            yield row + lo, *rest
            continue
        for x in range(a, b - least + 1, _BLOCK):
            y = min(b, x + _BLOCK + least - 1)
            row, s, *rest = pieces(raw[x:y], np.array([0, y - x]), least)
            yield row + lo, s + (x - a), *rest


def _open(packed: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompressobj().decompress(packed)


def _merged(lo: np.ndarray, hi: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of bytes covered by windows that start in ``[lo, hi)``."""
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], np.maximum.accumulate(hi[order] + least - 1)
    new = np.ones(len(lo), bool)
    new[1:] = lo[1:] > hi[:-1]
    at = np.flatnonzero(new)
    return lo[at], hi[np.append(at[1:], len(lo)) - 1]


def repeats(docs: DataFrame, packed: DataFrame, least: int, most_pieces: int) -> DataFrame:
    """``(doc, th, ranges)``: starts ``[lo, hi)`` of repeated windows of each text.
    ``docs`` has ``doc, th, text``; ``packed`` the same with compressed text."""
    long = docs.where(F.octet_length("text") >= least)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            for _, _, _, key, _ in _cut(*strings(batch.column(0)), least):
                yield pa.RecordBatch.from_pydict({"key": pa.array(key)})

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            doc, th = batch.column(0), batch.column(1)
            for row, s, n, key, seg in _cut(*strings(batch.column(2)), least):
                take = pa.array(row)
                yield pa.RecordBatch.from_pydict({"doc": doc.take(take), "th": th.take(take), "s": pa.array(s.astype(np.int32)), "n": pa.array(n.astype(np.int32)), "key": pa.array(key), "seg": pa.array(seg)})

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                text, own = _open(batch.column(2)[k].as_py()), batch.column(3)[k].as_py()
                yield pa.RecordBatch.from_pydict({"doc": pa.array([batch.column(0)[k].as_py()] * len(own), pa.int64()), "th": pa.array([batch.column(1)[k].as_py()] * len(own), pa.int64()), "key": pa.array([x["key"] for x in own], pa.int64()), "s": pa.array([x["s"] for x in own], pa.int32()), "n": pa.array([x["n"] for x in own], pa.int32()), "copies": pa.array([x["copies"] for x in own], pa.int64()), "many": pa.array([x["many"] for x in own], pa.bool_()), "bytes": pa.array([text[x["s"] : x["s"] + x["n"] - 1 + least] for x in own], pa.binary())})

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        group: list[tuple] = []
        size = 0

        def shard() -> pa.RecordBatch:
            out = []
            for (doc, th, _, s, n, copies, _), starts in zip(held, bwt.repeated_starts([np.frombuffer(x[6], np.uint8) for x in held], least), strict=True):
                if copies == 1 and len(starts):
                    lo, hi = _merged(starts[starts < n], starts[starts < n] + 1, 1)
                    out += [(doc, th, int(s + a), int(s + b)) for a, b in zip(lo, hi, strict=True)]
            columns = list(zip(*out, strict=True)) or [(), (), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.int32())], ["doc", "th", "lo", "hi"])

        def weight(rows: list[tuple]) -> int:
            return sum(len(x[6]) + 1 for x in rows)

        rows = (row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in ("doc", "th", "key", "s", "n", "copies", "bytes")), strict=True))
        for row in rows:
            if group and group[-1][2] != row[2]:
                if held and size + weight(group) > bwt.MOST - 2:
                    yield shard()
                    held, size = [], 0
                held.extend(group)
                size += weight(group)
                group = []
            group.append(row)
        if group:
            if held and size + weight(group) > bwt.MOST - 2:
                yield shard()
                held = []
            held.extend(group)
        if held:
            yield shard()

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, th, s, n, copies, raw in zip(*(batch.column(c).to_pylist() for c in ("doc", "th", "s", "n", "copies", "bytes")), strict=True):
                name = [int.from_bytes(hashlib.blake2b(raw[k : k + least], digest_size=8).digest(), "little", signed=True) for k in range(n)]
                yield pa.RecordBatch.from_pydict({"doc": pa.array([doc] * n, pa.int64()), "th": pa.array([th] * n, pa.int64()), "p": pa.array(range(s, s + n), pa.int32()), "copies": pa.array([copies] * n, pa.int64()), "window": pa.array(name, pa.int64())})

    twice = staged(long.select("text").mapInArrow(tidy(keys), "key long").groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key"), "substring-keys")
    found = staged(long.select("doc", "th", "text").mapInArrow(tidy(full), "doc long, th long, s int, n int, key long, seg long").join(twice, "key", "left_semi"), "substring-pieces")
    same = staged(found.groupBy("key", "seg").agg(F.count("*").alias("copies"), F.min(F.struct("doc", "th", "s", "n")).alias("one")), "substring-content")
    mixed = same.groupBy("key").agg(F.count("*").alias("c"), F.min("copies").alias("least")).where("c > 1 AND least = 1").select("key", (F.col("c") > most_pieces).alias("many"))
    wanted = same.join(mixed, "key").groupBy("one.doc", "one.th").agg(F.collect_list(F.struct("key", "one.s", "one.n", "copies", "many")).alias("own"))
    wanted = wanted.withColumnsRenamed({"doc": "__doc", "th": "__th"})
    texts = packed.join(wanted, F.col("doc").eqNullSafe(F.col("__doc")) & (F.col("th") == F.col("__th"))).select("doc", "th", "packed", "own").dropDuplicates(["doc", "th"])
    taken = staged(texts.mapInArrow(tidy(fetch), "doc long, th long, key long, s int, n int, copies long, many boolean, bytes binary"), "substring-bytes")
    few = taken.where("NOT many").repartition("key").sortWithinPartitions("key")
    ranges = few.mapInArrow(tidy(expand), "doc long, th long, lo int, hi int")
    each = taken.where("many").mapInArrow(tidy(windows), "doc long, th long, p int, copies long, window long")
    again = staged(each.groupBy("window").agg(F.sum("copies").alias("c")).where("c > 1").select("window"), "substring-windows")
    rest = each.where("copies = 1").join(again, "window", "left_semi").select("doc", "th", F.col("p").alias("lo"), (F.col("p") + 1).alias("hi"))
    counted = staged(same.where("copies > 1").select("key", "seg"), "substring-copies")
    whole = found.join(counted, ["key", "seg"], "left_semi").select("doc", "th", F.col("s").alias("lo"), (F.col("s") + F.col("n")).alias("hi"))
    return whole.unionByName(ranges).unionByName(rest).groupBy("doc", "th").agg(F.collect_list(F.struct("lo", "hi")).alias("ranges"))


def remove(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 200, most_pieces: int = 2048, keep: bool = False, prefix: str = "") -> DataFrame:
    """The id (with ``keep``, all columns, the text reduced) with ``n_bytes``,
    ``n_removed``, ``n_spans`` and ``kept_sha256``, whose names a prefix can keep
    apart from the table's own. Where the bytes left aren't
    whole characters, the reduced text leaves out the broken ones."""
    if least <= GRAM or least > 4096:
        raise ValueError(f"least must be over {GRAM} and at most 4096")
    columns = df.columns if keep else [id_col]
    rest = [c for c in columns if c != text_col]
    text = F.coalesce(F.col(text_col), F.lit(""))
    docs = df.select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(text).alias("th"), text.alias("text"))
    base = df.select(F.struct(*rest).alias("row"), F.col(id_col).cast("long").alias("doc"), F.xxhash64(text).alias("th"), text.alias("text"), F.col(text_col).isNull().alias("void"))
    kinds = dict(base.dtypes)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=1)
        for batch in small_batches(batches, "text"):
            raw, offsets = strings(batch.column(batch.schema.get_field_index("text")))
            data = [packer.compress(raw[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in ("row", "doc", "th", "void")), pa.array(data, pa.binary())], ["row", "doc", "th", "void", "packed"])

    packed = base.mapInArrow(tidy(pack), f"row {kinds['row']}, doc long, th long, void boolean, packed binary")
    found = repeats(docs, packed.select("doc", "th", "packed"), least, most_pieces).withColumnsRenamed({"doc": "__doc", "th": "__th"})
    joined = packed.join(found, F.col("doc").eqNullSafe(F.col("__doc")) & (F.col("th") == F.col("__th")), "left").select("row", "void", "packed", "ranges")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ranges = part.column(3)
                n_bytes, removed, spans, digest, left = [], [], [], [], []
                for k in range(part.num_rows):
                    text = _open(part.column(2)[k].as_py())
                    own = ranges[k].values if ranges[k].is_valid else None
                    n_bytes.append(len(text))
                    if own is None or not len(own):
                        removed.append(0)
                        spans.append(0)
                    else:
                        lo, hi = _merged(own.field(0).to_numpy().astype(np.int64), own.field(1).to_numpy().astype(np.int64), least)
                        removed.append(int((hi - lo).sum()))
                        spans.append(len(lo))
                        text = b"".join(text[a:b] for a, b in zip([0, *hi.tolist()], [*lo.tolist(), len(text)], strict=True))
                    digest.append(hashlib.sha256(text).hexdigest())
                    if keep:
                        left.append(None if part.column(1)[k].as_py() else text.decode(errors="ignore"))
                row = part.column(0)
                fields = {f.name: row.field(i) for i, f in enumerate(row.type)}
                if keep:
                    fields[text_col] = pa.array(left, pa.string())
                more = {f"{prefix}n_bytes": pa.array(n_bytes, pa.int64()), f"{prefix}n_removed": pa.array(removed, pa.int64()), f"{prefix}n_spans": pa.array(spans, pa.int64()), f"{prefix}kept_sha256": pa.array(digest, pa.string())}
                yield pa.RecordBatch.from_pydict({c: fields[c] for c in columns} | more)

    schema = ", ".join(f"`{c}` {k}" for c, k in df.select(*columns).dtypes)
    return joined.mapInArrow(tidy(finish), f"{schema}, `{prefix}n_bytes` long, `{prefix}n_removed` long, `{prefix}n_spans` long, `{prefix}kept_sha256` string")
