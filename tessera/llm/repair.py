"""Token ids in Re-Pair grammar shards.

Documents are dealt to shards in ascending ``doc_id`` order. Each shard's ids are
compressed by itself: frequent neighbouring pairs are replaced by new symbols
(nonterminals), again and again, until no pair occurs ``least`` times. Of pairs that
overlap, the more frequent one goes first. A pair never spans two documents, so each
document is a run of symbols, and with the rules, their expansion lengths and the
block table any document can be decoded without its neighbours.

File: ``RPG2``, a header, document table, rules, expansion lengths, block table,
then the symbols in zstd blocks. Symbols are unsigned 32-bit, so neither the
vocabulary nor the rules run out.

The ids are those of the tokenizers library and its file as its own call gives them
(the text of its special token is that token's id). On the main path they come from
the rank file by tiktoken, once ``vocab.proven_equal`` has compared the two files
entry for entry; ``engine="tokenizers"`` uses the other library. Null and empty texts
have the end id only; null ids sort first; equal ids (repeated rows, ties) sort by
text hash. A document longer than ``shard_tokens`` is a shard of its own, however
long. An empty table writes no file and gives no rows. Only the id and the text
column are read, so no other column's name can clash.
"""

from __future__ import annotations

import functools
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import files, vocab
from tessera.llm.common import release, shared_path, small_batches, staged, tidy

MAGIC = b"RPG2"
_HEAD = struct.Struct("<4sIQQQI")
#: Symbols of one zstd block.
BLOCK = 1 << 16
#: Least and most bits of a slot in the table that counts pairs.
SLOTS = 16, 24
#: Most tasks that read files back; beyond them a task reads several files in turn.
READERS = 10_000
#: Files that a task reads back in turn; starting a task takes as long as decoding one.
FILES = 4


@dataclass(frozen=True)
class Grammar:
    """Rules ``first + k -> (left[k], right[k])`` over symbols below ``first + k``."""

    first: int
    left: np.ndarray
    right: np.ndarray

    @functools.cached_property
    def levels(self) -> list[tuple[int, int]]:
        """Ranges of rules whose symbols all stand before the range."""
        most = np.maximum.accumulate(np.maximum(self.left, self.right)) if len(self.left) else self.left
        out, lo = [], 0
        while lo < len(self.left):
            hi = int(np.searchsorted(most, self.first + lo, "left"))
            out.append((lo, hi))
            lo = hi
        return out

    @functools.cached_property
    def size(self) -> np.ndarray:
        """Length of each symbol's expansion."""
        out = np.ones(self.first + len(self.left), np.int64)
        for lo, hi in self.levels:
            out[self.first + lo : self.first + hi] = out[self.left[lo:hi]] + out[self.right[lo:hi]]
        return out

    @functools.cached_property
    def flat(self) -> tuple[np.ndarray, np.ndarray]:
        """Start of each symbol's expansion, and the expansions."""
        start = np.concatenate([[0], np.cumsum(self.size)[:-1]])
        out = np.arange(int(self.size.sum()), dtype=np.uint32)
        for lo, hi in self.levels:
            pairs = np.stack([self.left[lo:hi], self.right[lo:hi]], 1).ravel()
            at = start[self.first + lo]
            part = self._gathered(pairs, start, out)
            out[at : at + len(part)] = part
        return start, out

    def _gathered(self, symbols: np.ndarray, start: np.ndarray, flat: np.ndarray) -> np.ndarray:
        n = self.size[symbols]
        return flat[np.arange(int(n.sum())) + np.repeat(start[symbols] - (np.cumsum(n) - n), n)]

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        """The ids of a run of symbols. Where all expansions together would be much
        longer than the run's, the run is opened pair by pair instead."""
        if not len(symbols):
            return np.zeros(0, np.uint32)
        if "flat" in self.__dict__ or int(self.size.sum()) <= max(1 << 22, 4 * int(self.size[symbols].sum())):
            return self._gathered(symbols, *self.flat)
        out = symbols.astype(np.uint32)
        while (deep := out >= self.first).any():
            rule = out[deep] - self.first
            wide = np.repeat(out, 1 + deep)
            at = np.flatnonzero(deep) + np.arange(len(rule))
            wide[at], wide[at + 1] = self.left[rule], self.right[rule]
            out = wide
        return out


def slot_bits(places: int) -> int:
    """Bits of a slot for so many places: an eighth as many slots as places, so that a
    shard's table stays in the cache and a longer document has a larger one."""
    return min(max(places.bit_length() - 3, SLOTS[0]), SLOTS[1])


def compress(ids: np.ndarray, sizes: np.ndarray, first: int, least: int = 8) -> tuple[Grammar, np.ndarray, np.ndarray]:
    """Grammar, symbols, and each document's first symbol (with the end).

    Pairs are counted in a table of slots; of pairs that share a slot one is counted,
    and the others stay for the next round, so counts are exact.

    A round looks at ``live`` places: at first all, later those where a pair is new
    and those whose frequent pair lost to a neighbour. A pair that was rare once
    never gets more frequent, so no other place can matter. Of neighbouring places
    the one with the more frequent pair is replaced, in a run of one pair every
    other. The most frequent pair loses nowhere, so every round gets somewhere."""
    # The last symbol of each document carries a mark in its highest bit.
    mark = np.uint32(1 << 31)
    seq = ids.astype(np.uint32)
    seq[np.cumsum(sizes)[sizes > 0] - 1] |= mark
    rules: list[np.ndarray] = []
    n = first
    live = np.flatnonzero(seq < mark)
    bits = slot_bits(len(live))
    held = np.zeros(1 << bits, np.uint64)
    while len(live) >= least:
        code = seq.take(live).astype(np.uint64)
        code <<= np.uint64(32)
        code |= seq.take(live + 1) & ~mark
        slot = code * np.uint64(0x9E3779B97F4A7C15)
        slot >>= np.uint64(64 - bits)
        slot = slot.view(np.int64)
        held[slot] = code
        late = np.flatnonzero(held.take(slot) != code)
        # Pairs of one count are ordered by their slot; who shares it waits a round.
        order = np.bincount(slot, minlength=1 << bits)
        if len(late):
            order -= np.bincount(slot.take(late), minlength=1 << bits)
        if len(live) > len(order):
            order <<= bits
            order |= np.arange(len(order))
            order = order.take(slot)
        else:
            order = order.take(slot)
            order <<= bits
            order |= slot
        hot = order >= least << bits
        hot[late] = False
        of = np.flatnonzero(hot)
        if not len(of):
            if not len(late):
                break
            live = live[late]
            continue
        # Only frequent pairs compete: a rare neighbour never wins.
        place, order, slot = live.take(of), order.take(of), slot.take(of)
        near = place[1:] == place[:-1] + 1
        same = near & (order[1:] == order[:-1])
        up = near & (order[1:] >= order[:-1])
        win = np.ones(len(place), bool)
        win[1:] = ~near | up
        win[:-1] &= ~up | same
        if same.any():
            same = np.append(False, same)
            turn = np.arange(len(place), dtype=np.int32)
            win &= (turn - np.maximum.accumulate(np.where(same, 0, turn))) % 2 == 0
        won = np.flatnonzero(win)
        chosen = slot.take(won)
        enough = min(3, (least + 1) // 2)
        if 32 * len(chosen) > 1 << bits:
            used = np.bincount(chosen, minlength=1 << bits) >= enough
            pairs, number, thick = held[used], np.cumsum(used, dtype=np.int32).take(chosen) - 1, used.take(chosen)
        else:
            slots, at, count = np.unique(chosen, return_inverse=True, return_counts=True)
            used = count >= enough
            pairs, number, thick = held[slots[used]], np.cumsum(used, dtype=np.int32).take(at) - 1, used.take(at)
        if not thick.all():
            thick = np.flatnonzero(thick)
            won, number = won.take(thick), number.take(thick)
        rules.append(pairs)
        at = place.take(won)
        seq[at] = number.view(np.uint32) + np.uint32(n) | seq.take(at + 1) & mark
        stay = np.ones(len(seq), bool)
        stay[at + 1] = False
        hot[of.take(won)] = False
        hot[late] = True
        lost = live.take(np.flatnonzero(hot))
        lost = lost.take(np.flatnonzero(stay.take(lost)))
        n += len(pairs)
        if 16 * len(lost) > len(seq):
            lost = np.cumsum(stay, dtype=np.int32).take(lost) - 1
        else:
            lost -= np.searchsorted(at + 1, lost, "right")
        seq = seq.take(np.flatnonzero(stay))
        fresh = at - np.arange(len(at))
        if 32 * (len(fresh) + len(lost)) > len(seq):
            seen = np.zeros(len(seq), bool)
            seen[fresh] = seen[fresh[fresh > 0] - 1] = seen[lost] = True
            seen &= seq < mark
            live = np.flatnonzero(seen)
        else:
            live = np.unique(np.concatenate([fresh, fresh[fresh > 0] - 1, lost]))
            live = live[seq.take(live) < mark]
    codes = np.concatenate(rules) if rules else np.zeros(0, np.uint64)
    ends = np.zeros(len(sizes), np.int64)
    ends[sizes > 0] = np.flatnonzero(seq >= mark) + 1
    return Grammar(first, (codes >> np.uint64(32)).astype(np.uint32), (codes & np.uint64(0xFFFFFFFF)).astype(np.uint32)), seq & ~mark, np.concatenate([[0], np.maximum.accumulate(ends)])


def to_bytes(doc_ids: list[int | None], ids: np.ndarray, sizes: np.ndarray, first: int) -> bytes:
    """A shard file."""
    grammar, seq, bounds = compress(ids, sizes, first)
    packer = zstandard.ZstdCompressor(level=1)
    packed = [packer.compress(seq[k : k + BLOCK].astype("<u4").tobytes()) for k in range(0, len(seq), BLOCK)]
    rows = np.array([0 if x is None else x for x in doc_ids], "<i8")
    null = np.packbits(np.array([x is None for x in doc_ids], bool))
    return b"".join([
        _HEAD.pack(MAGIC, first, len(rows), len(grammar.left), len(seq), len(packed)), rows.tobytes(), null.tobytes(), sizes.astype("<i8").tobytes(), bounds.astype("<i8").tobytes(),
        grammar.left.astype("<u4").tobytes(), grammar.right.astype("<u4").tobytes(), grammar.size[first:].astype("<u4").tobytes(), np.array([len(x) for x in packed], "<u4").tobytes(), *packed,
    ])


class Shard:
    """A shard file opened for reading."""

    def __init__(self, raw: bytes):
        magic, first, docs, rules, self.n_symbols, n_blocks = _HEAD.unpack_from(raw)
        if magic != MAGIC:
            raise ValueError("not a shard file")
        at = _HEAD.size

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(raw, kind, n, at)
            at += out.nbytes
            return out

        rows = take("<i8", docs)
        null = np.unpackbits(take("u1", (docs + 7) // 8), count=docs).astype(bool)
        self.doc_ids = [None if z else int(x) for x, z in zip(rows, null, strict=True)]
        self.sizes, self.bounds = take("<i8", docs), take("<i8", docs + 1)
        self.grammar = Grammar(first, take("<u4", rules), take("<u4", rules))
        self.lengths = take("<u4", rules)
        packed = np.concatenate([[0], np.cumsum(take("<u4", n_blocks).astype(np.int64))]) + at
        self._block = lambda k: np.frombuffer(zstandard.ZstdDecompressor().decompress(raw[packed[k] : packed[k + 1]]), "<u4")

    def symbols(self, lo: int, hi: int) -> np.ndarray:
        if lo >= hi:
            return np.zeros(0, np.uint32)
        parts = [self._block(k) for k in range(lo // BLOCK, (hi - 1) // BLOCK + 1)]
        base = lo // BLOCK * BLOCK
        return np.concatenate(parts)[lo - base : hi - base]

    def decode(self, k: int) -> np.ndarray:
        """The ids of the k-th document alone."""
        return self.grammar.expand(self.symbols(int(self.bounds[k]), int(self.bounds[k + 1])))

    def decode_all(self) -> np.ndarray:
        return self.grammar.expand(self.symbols(0, self.n_symbols))


def _engine(name: str, json_path: str, ranks_path: str):
    if name == "tokenizers":
        from tokenizers import Tokenizer

        own = Tokenizer.from_file(json_path)
        return lambda text: np.array(own.encode(text, add_special_tokens=False).ids, np.uint32)
    special = vocab.special(json_path)
    return lambda text: vocab.text_ids(text, ranks_path, special)


def write_shards(df: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, shard_tokens: int = 2_000_000, engine: str = "ranks", json_path: str | None = None, ranks_path: str | None = None) -> DataFrame:
    """Write the shards to ``folder``; returns their manifest (``file``,
    ``part``, ``shard``, ``n_docs``, ``n_tokens``, ``start``), written once."""
    json_path, ranks_path = json_path or vocab.default_json(), ranks_path or vocab.default_ranks()
    if engine == "ranks" and not vocab.proven_equal(json_path, ranks_path):
        raise ValueError("the rank file isn't the vocabulary of the tokenizers file; use engine='tokenizers'")
    first = max(vocab.size(json_path), end_id + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, k = _engine(engine, json_path, ranks_path), files.partition(), 0
        ids: list[np.ndarray] = []
        names: list[int | None] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal ids, names, held, k
            path = f"{folder}/part-{part:06d}-{k:05d}.rpg"
            with files.published(path) as out:
                out.write(to_bytes(names, np.concatenate(ids), np.array([len(x) for x in ids], np.int64), first))
            row = pa.RecordBatch.from_pydict({"file": [path], "part": pa.array([part], pa.int64()), "shard": pa.array([k], pa.int64()), "n_docs": pa.array([len(ids)], pa.int64()), "n_tokens": pa.array([held], pa.int64())})
            ids, names, held, k = [], [], 0, k + 1
            release()
            return row

        end = np.array([end_id], np.uint32)
        for batch in small_batches(batches, text_col):
            for name, text in zip(batch.column(id_col).to_pylist(), batch.column(text_col).to_pylist(), strict=True):
                ids.append(np.concatenate([encode(text or ""), end]))
                names.append(name)
                held += len(ids[-1])
                if held >= shard_tokens:
                    yield flush()
        if ids:
            yield flush()

    dealt = df.select(F.col(id_col).cast("long").alias(id_col), text_col).repartitionByRange(F.col(id_col).asc_nulls_first()).sortWithinPartitions(F.col(id_col).asc_nulls_first(), F.xxhash64(text_col))
    manifest = staged(dealt.mapInArrow(tidy(run), "file string, part long, shard long, n_docs long, n_tokens long"), "repair-manifest")
    inner = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = manifest.groupBy("part").agg(F.sum("n_tokens").alias("all_tokens")).withColumn("before", F.coalesce(F.sum("all_tokens").over(outer), F.lit(0)))
    return manifest.join(parts, "part").select("file", "part", "shard", "n_docs", "n_tokens", (F.col("before") + F.coalesce(F.sum("n_tokens").over(inner), F.lit(0))).alias("start"))


def read_shards(manifest: DataFrame) -> DataFrame:
    """Decode every document of the files: ``doc_id``, ``start``, ``n_tokens``,
    ``ids_crc32``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist(), strict=True):
                shard = Shard(files.read_bytes(path))
                ids = shard.decode_all().astype("<u4")
                ends = np.cumsum(shard.sizes)
                starts = ends - shard.sizes
                if len(ids) != (ends[-1] if len(ends) else 0):
                    raise ValueError(f"{path} doesn't decode to its length")
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(shard.doc_ids, pa.int64()), "start": pa.array(start + starts), "n_tokens": pa.array(shard.sizes),
                    "ids_crc32": pa.array([zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts, ends, strict=True)], pa.int64()),
                })

    # A fixed number of tasks: the names are too few bytes for the planner to deal.
    listed = manifest.select("file", "start")
    n = max(1, min(READERS, -(-listed.count() // FILES)))
    return listed.repartition(n).mapInArrow(tidy(run), "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(df: DataFrame, **options) -> DataFrame:
    """Write the shards to the shared folder and read them back."""
    return read_shards(write_shards(df, shared_path(df.sparkSession, "repair"), **options))
