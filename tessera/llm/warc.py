"""WARC records in seekable Zstandard bundles.

Records are grouped into independent Zstandard frames; the bundle ends with the
seek table of the format (a skippable frame), so one frame can be read alone. An
index maps each record to its frame and to the offset within the frame.

Of records with equal payloads (SHA-1, at least ``least_bytes`` long) the one of
the smallest id is a ``response``, the others are ``revisit`` records that name it
and hold the response's HTTP header only. A null payload counts as empty; a null
id never takes part in deduplication; rows that repeat an id with its payload are
all of the same kind. A payload of any length is one record, in a frame of its own
where it is longer than a frame. An empty table writes no bundle and gives no rows.
Only the three named columns are read, so no other column's name can clash.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import files
from tessera.llm.common import shared_path, staged, tidy

#: Most tasks that read bundles back; beyond them a task reads several in turn.
READERS = 10_000
_SEEK, _SKIP = 0x8F92EAB1, 0x184D2A5E


@dataclass(frozen=True)
class Layout:
    """Bytes of a frame before compression and of a bundle after it."""

    frame_bytes: int = 1 << 20
    bundle_bytes: int = 256 << 20
    level: int = 3
    date: str = "1970-01-01T00:00:00Z"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One WARC record. A revisit keeps the payload's length in its HTTP header."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if refers_to is not None else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {date}"]
    if url:
        lines.append("WARC-Target-URI: " + "".join(f"%{ord(c):02X}" if c in "\r\n" else c for c in url))
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parsed(frame: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of a frame."""
    at = 0
    while at < len(frame):
        end = frame.index(b"\r\n\r\n", at)
        lines = frame[at:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        head = dict(x.split(": ", 1) for x in lines[1:])
        n = int(head["Content-Length"])
        yield head, frame[end + 4 : end + 4 + n]
        at = end + 4 + n + 4


def seek_table(sizes: list[tuple[int, int]]) -> bytes:
    """The footer: compressed and decompressed bytes of each frame."""
    body = b"".join(struct.pack("<II", *x) for x in sizes) + struct.pack("<IBI", len(sizes), 0, _SEEK)
    return struct.pack("<II", _SKIP, len(body)) + body


class Bundle:
    """A bundle opened for reading; frames are decompressed one at a time."""

    def __init__(self, path: str):
        fs, name = files.opened(path)
        self.file = fs.open_input_file(name)
        end = self.file.size()
        n, _, magic = struct.unpack("<IBI", self.file.read_at(9, end - 9))
        if magic != _SEEK:
            raise ValueError(f"{path} has no seek table")
        table = self.file.read_at(8 * n, end - 9 - 8 * n)
        self.at, self.size = [0], []
        for k in range(n):
            packed, plain = struct.unpack_from("<II", table, 8 * k)
            self.at.append(self.at[-1] + packed)
            self.size.append(plain)

    def frame(self, k: int) -> bytes:
        raw = self.file.read_at(self.at[k + 1] - self.at[k], self.at[k])
        return zstandard.ZstdDecompressor().decompress(raw, max_output_size=self.size[k])

    def record(self, frame: int, offset: int) -> tuple[dict[str, str], bytes]:
        """The record at a place that the index names."""
        return next(parsed(self.frame(frame)[offset:]))

    def close(self) -> None:
        self.file.close()


def revisits(df: DataFrame, id_col: str, payload_col: str, least_bytes: int = 0) -> DataFrame:
    """``(id, digest, refers_to)`` of the rows whose payload a smaller id has too.

    Payloads are first reduced to digests, and groups to their smallest id before
    the shuffle. The table of groups is written, so that the join with it deals
    both sides by the digest and a hot digest can be split."""
    body = F.coalesce(F.col(payload_col), F.lit(""))
    seen = df.where(F.col(id_col).isNotNull() & (F.octet_length(body) >= least_bytes)).select(F.col(id_col).alias("page"), F.sha1(body).alias("digest"))
    groups = seen.groupBy("digest").agg(F.min("page").alias("first"), F.max("page").alias("last")).where("first < last").select("digest", "first")
    return seen.join(staged(groups, "warc-groups"), "digest").where("page > first").select("page", "digest", F.col("first").alias("refers_to")).distinct()


def write_bundles(df: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 0, layout: Layout | None = None) -> DataFrame:
    """Write the records; returns the index (``page``, ``file``, ``frame``,
    ``offset``, ``length``), written once."""
    layout = layout or Layout()
    body = F.coalesce(F.col(payload_col), F.lit(""))
    pages = df.select(F.col(id_col).cast("long").alias("page"), F.col(url_col).alias("url"), body.alias("payload"), F.sha1(body).alias("digest"))
    known = revisits(df.select(F.col(id_col).cast("long").alias(id_col), payload_col), id_col, payload_col, least_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, packer = files.partition(), zstandard.ZstdCompressor(level=layout.level)
        rows = (row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in ("page", "url", "payload", "digest", "refers_to")), strict=True))
        row, k = next(rows, None), 0
        while row is not None:
            path, index, sizes, written, frame, held = f"{folder}/part-{part:06d}-{k:05d}.warc.zst", [], [], 0, [], 0
            with files.published(path) as out:
                while row is not None and written < layout.bundle_bytes:
                    page, url, payload, digest, refers_to = row
                    raw = record(page, url, payload.encode(), base64.b32encode(bytes.fromhex(digest)).decode(), refers_to, layout.date)
                    index.append((page, len(sizes), held, len(raw)))
                    frame.append(raw)
                    held += len(raw)
                    row = next(rows, None)
                    if held >= layout.frame_bytes or row is None:
                        packed = packer.compress(b"".join(frame))
                        out.write(packed)
                        sizes.append((len(packed), held))
                        written, frame, held = written + len(packed), [], 0
                if frame:
                    packed = packer.compress(b"".join(frame))
                    out.write(packed)
                    sizes.append((len(packed), held))
                out.write(seek_table(sizes))
            k += 1
            yield pa.RecordBatch.from_pydict({"page": pa.array([x[0] for x in index], pa.int64()), "file": [path] * len(index), "frame": pa.array([x[1] for x in index], pa.int64()), "offset": pa.array([x[2] for x in index], pa.int64()), "length": pa.array([x[3] for x in index], pa.int64())})

    joined = pages.join(known, ["page", "digest"], "left").select("page", "url", "payload", "digest", "refers_to")
    return staged(joined.mapInArrow(tidy(run), "page long, file string, frame long, offset long, length long"), "warc-index")


def _page(urn: str) -> int | None:
    name = urn.removeprefix("<urn:page:").removesuffix(">")
    return None if name == "None" else int(name)


def read_bundles(index: DataFrame) -> DataFrame:
    """Every record of the bundles that the index names, from the bundles alone."""
    from hashlib import sha1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("file").to_pylist():
                bundle = Bundle(path)
                for k in range(len(bundle.size)):
                    out = []
                    for head, block in parsed(bundle.frame(k)):
                        http, _, payload = block.partition(b"\r\n\r\n")
                        n = int(dict(x.split(b": ", 1) for x in http.split(b"\r\n")[1:])[b"Content-Length"])
                        digest, kind = head["WARC-Payload-Digest"].removeprefix("sha1:"), head["WARC-Type"]
                        if kind == "response" and (len(payload) != n or base64.b32encode(sha1(payload).digest()).decode() != digest):
                            raise ValueError(f"{path}: a payload differs from its digest")
                        out.append((_page(head["WARC-Record-ID"]), n, digest, kind, _page(head["WARC-Refers-To"]) if kind == "revisit" else None))
                    a, b, c, d, e = zip(*out, strict=True)
                    yield pa.RecordBatch.from_pydict({"page_id": pa.array(a, pa.int64()), "payload_bytes": pa.array(b, pa.int64()), "payload_digest": pa.array(c, pa.string()), "record_type": pa.array(d, pa.string()), "refers_to": pa.array(e, pa.int64())})
                bundle.close()

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    # A fixed number of tasks: the names are too few bytes for the planner to deal.
    listed = staged(index.select("file").distinct(), "warc-files")
    return listed.repartition(max(1, min(READERS, listed.count()))).mapInArrow(tidy(run), schema)


def round_trip(df: DataFrame, **options) -> DataFrame:
    """Write the bundles to the shared folder and read them back."""
    return read_bundles(write_bundles(df, shared_path(df.sparkSession, "warc"), **options))
