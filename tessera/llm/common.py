"""Shared plumbing of the training-data operators.

Everything an executor writes, and every table that cuts a lineage, goes to the
folder named by ``spark.checkpoint.dir``; only where that setting is missing
(tests on one machine) a private folder is made and set.
"""

from __future__ import annotations

import contextlib
import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one vectorised step works on at once.
BLOCK_BYTES = 1 << 20

#: Bytes of rows that Spark sends to a Python worker at once, where a caller bounds them.
TRANSFER_BYTES = 1 << 21


def small_transfers(spark: SparkSession) -> None:
    """From now on rows of this session go to Python in batches of ``TRANSFER_BYTES``
    (a longer row is a batch of its own). By default it is 10,000 rows or 64 MB, which
    the executor holds several times over outside its heap, for each running task."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(TRANSFER_BYTES))


@functools.cache
def _trim() -> Callable[[int], int]:
    """The C library's call that gives free memory back, where it has one."""
    with contextlib.suppress(OSError, AttributeError):
        return ctypes.CDLL(None).malloc_trim
    return lambda _: 0


def release() -> None:
    """Give free memory of this worker back to the machine. Workers are reused, and
    what one task has freed would otherwise stay with them through all later ones."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def tidy(run: Callable) -> Callable:
    """``run`` for ``mapInArrow``, with its memory released when it ends."""

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return out


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share. A session on one machine without
    the setting gets a private folder; a cluster without it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    if not found:
        found = getattr(shared_root, "own", None)
        if not found:
            found = shared_root.own = "file://" + tempfile.mkdtemp(prefix="tessera-")
    return found.rstrip("/")


def shared_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_root(spark)}/tessera/{tag}-{uuid.uuid4().hex}"


def staged(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written to the shared folder and read again: a cut in the lineage
    that survives the loss of executors."""
    spark = df.sparkSession
    path = shared_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, df: DataFrame) -> None:
    """Remove the files of a staged table that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def strings(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string column without copies of the rows;
    null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if offsets is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32, len(column) + 1, column.offset * (8 if wide else 4)).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def blocks(offsets: np.ndarray, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes each; a longer row is a range of its own."""
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi
        lo = hi


def small_batches(batches: Iterator[pa.RecordBatch], column: str, most: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of bounded text bytes."""
    for batch in batches:
        if batch.num_rows:
            _, offsets = strings(batch.column(batch.schema.get_field_index(column)))
            for lo, hi in blocks(offsets, most):
                yield batch.slice(lo, hi - lo)


@functools.cache
def mixers(n: int, seed: int = 0x5EED) -> np.ndarray:
    """``n`` odd 64-bit multipliers, the same in every process."""
    return np.random.Generator(np.random.PCG64(seed)).integers(1, 2**63, n, np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def space_table() -> np.ndarray:
    table = np.zeros(256, bool)
    table[[0x20, *range(0x09, 0x0E)]] = True
    return table


_SPACE = space_table()
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@functools.cache
def _byte_codes() -> np.ndarray:
    return np.random.Generator(np.random.PCG64(77)).integers(0, 2**64, 256, np.uint64)


def word_runs(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each run of bytes that aren't white space
    (``[^\\x20\\x09-\\x0D]+``), runs never crossing rows."""
    n = len(raw)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none
    solid = ~_SPACE[raw]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    edge = offsets[:-1][offsets[:-1] < n]
    first[edge] = solid[edge]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    ends = offsets[1:][offsets[1:] > 0] - 1
    last[ends] = solid[ends]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(offsets, starts, "right") - 1


def word_hashes(raw: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word and its row."""
    starts, ends, rows = word_runs(raw, offsets)
    if not len(starts):
        return np.zeros(0, np.uint64), rows
    codes = _byte_codes()
    if lower:
        codes = codes[_LOWER]
    lens = ends - starts
    place = np.arange(len(raw)) - np.repeat(starts, np.diff(np.append(starts, len(raw)))) if starts[0] == 0 else None
    if place is None:
        place = np.zeros(len(raw), np.int64)
        place[starts[0] :] = np.arange(starts[0], len(raw)) - np.repeat(starts, np.diff(np.append(starts, len(raw))))
    with np.errstate(over="ignore"):
        powers = np.full(int(lens.max()) + 1, 0x9E3779B97F4A7C15, np.uint64)
        powers[0] = 1
        powers = np.cumprod(powers)
        value = codes[raw] * powers[np.minimum(place, len(powers) - 1)]
        value[_SPACE[raw]] = 0
        sums = np.add.reduceat(value, starts)
        return mix(sums + lens.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), rows


class Filter:
    """A Bloom filter over 64-bit hashes, of at most 16 MB however many there are;
    beyond what it holds well it only lets more rows through."""

    def __init__(self, hashes: DataFrame, column: str):
        n = hashes.count()
        self.bits = 1 << min(27, max(16, (16 * n).bit_length()))
        first = F.col(column).bitwiseAND(self.bits - 1)
        second = F.shiftrightunsigned(F.col(column), 30).bitwiseAND(self.bits - 1)
        places = hashes.select(F.explode(F.array(first, second)).alias("p"))
        words = places.groupBy(F.shiftright("p", 5).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 31 as int))")).alias("v"))
        self.words = np.zeros(self.bits >> 5, np.uint32)
        table = words.toArrow()
        self.words[table.column("w").to_numpy()] = table.column("v").to_numpy().astype(np.uint32)

    def may_hold(self, hashes: np.ndarray) -> np.ndarray:
        h = hashes.astype(np.int64).view(np.uint64)
        out = np.ones(len(h), bool)
        for p in (h & np.uint64(self.bits - 1), (h >> np.uint64(30)) & np.uint64(self.bits - 1)):
            out &= (self.words[(p >> np.uint64(5)).astype(np.int64)] >> (p & np.uint64(31)).astype(np.uint32)) & np.uint32(1) > 0
        return out
