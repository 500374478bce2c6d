"""Byte-level BPE as a monoid over texts.

A text is halved until a piece is short, pieces are encoded by themselves, and
neighbours are joined up the tree. At a join only a window around the cut is
encoded anew. It grows to both sides until each edge is a place where a white
space follows a character that is none: no match of the split pattern holds both
of these, and no alternative of the pattern looks further back, so the matches
on the two sides of such a place depend on their own side alone. Hence the tokens
outside the window are final. Where no such place exists (one very long word) the
window becomes the whole of both halves, which is still exact. Decoding joins the
bytes of the leaves up the same kind of tree.

Nulls count as empty texts; an empty text has no ids and the digest of nothing.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm import vocab
from tessera.llm.common import small_batches, tidy

#: Characters of a leaf, and the first reach of a window to either side.
LEAF, REACH = 4096, 48
_SAFE = re.compile(r"(?<=\S)[ \n]")


def _leaf(text: str, path: str) -> np.ndarray:
    enc = vocab.encoding(path)
    try:
        return enc.encode_to_numpy(text, disallowed_special=())
    except BaseException as e:  # the engine's panics on endless runs aren't Exceptions
        if isinstance(e, (KeyboardInterrupt, SystemExit, MemoryError)):
            raise
        import regex

        table = vocab.ranks(path)
        out: list[int] = []
        for m in regex.finditer(vocab.pattern(), text):
            piece = m[0].encode()
            out += [table[piece]] if piece in table else enc._core_bpe.encode_single_piece(piece)
        return np.array(out, np.uint32)


def _edge_left(text: str, lo: int, cut: int) -> int:
    reach = REACH
    while True:
        at = max(lo, cut - reach)
        last = None
        for m in _SAFE.finditer(text, max(at, lo + 1), cut + 1):
            last = m.start()
        if last is not None:
            return last
        if at == lo:
            return lo
        reach *= 2


def _edge_right(text: str, cut: int, hi: int) -> int:
    reach = REACH
    while True:
        at = min(hi, cut + reach)
        if m := _SAFE.search(text, cut, at):
            return m.start()
        if at == hi:
            return hi
        reach *= 2


def _count(ids: np.ndarray, n_bytes: int, path: str, backward: bool) -> int:
    """How many ids at one end make up exactly ``n_bytes``."""
    if not n_bytes:
        return 0
    size, k = vocab.token_bytes(path), min(len(ids), n_bytes)
    run = np.cumsum(size[ids[len(ids) - k :][::-1] if backward else ids[:k]])
    at = int(np.searchsorted(run, n_bytes))
    if run[at] != n_bytes:
        raise AssertionError("a window's edge isn't a token's edge")
    return at + 1


def encode_tree(text: str, path: str, leaf: int = LEAF) -> np.ndarray:
    """The ids of the whole text, as encoding it at once would give them."""

    def build(lo: int, hi: int) -> list[np.ndarray]:
        if hi - lo <= leaf:
            return [_leaf(text[lo:hi], path)]
        cut = (lo + hi) // 2
        left, right = build(lo, cut), build(cut, hi)
        a, b = _edge_left(text, lo, cut), _edge_right(text, cut, hi)
        if a == cut:
            return left + right
        middle = [_leaf(text[a:b], path)] if b - a < hi - lo or hi - lo <= 2 * leaf else [_leaf(text[lo:hi], path)]
        return _trim(left, len(text[a:cut].encode()), path, True) + middle + _trim(right, len(text[cut:b].encode()), path, False)

    if not text:
        return np.zeros(0, np.uint32)
    parts = build(0, len(text))
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def _trim(parts: list[np.ndarray], n_bytes: int, path: str, backward: bool) -> list[np.ndarray]:
    """The parts without the ids that make up ``n_bytes`` at one end."""
    parts = list(parts)
    size = vocab.token_bytes(path)
    while n_bytes:
        at = -1 if backward else 0
        part = parts.pop(at)
        whole = int(size[part].sum())
        if whole <= n_bytes:
            n_bytes -= whole
            continue
        k = _count(part, n_bytes, path, backward)
        part = part[: len(part) - k] if backward else part[k:]
        parts = [*parts, part] if backward else [part, *parts]
        n_bytes = 0
    return parts


def decode_tree(ids: np.ndarray, path: str, leaf: int = LEAF) -> bytes:
    """Bytes of the ids, joined up the tree."""

    def build(lo: int, hi: int) -> list[bytes]:
        if hi - lo <= leaf:
            return [vocab.encoding(path).decode_bytes(ids[lo:hi].tolist())]
        mid = (lo + hi) // 2
        return build(lo, mid) + build(mid, hi)

    return b"".join(build(0, len(ids)))


def encode_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks_path: str | None = None, leaf: int = LEAF) -> DataFrame:
    """Ids, decoded bytes and their digests for each row; a map over rows without
    a shuffle.

    Columns: the id column, ``n_tokens``, ``ids`` (unsigned 32-bit little-endian
    in a binary), ``decoded``, ``ids_sha256``, ``decoded_sha256``. Unwanted ones
    should be left out with ``digests``.
    """
    return _encoded(df, id_col, text_col, ranks_path, leaf, True)


def digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks_path: str | None = None, leaf: int = LEAF) -> DataFrame:
    """As ``encode_texts`` with the digests only."""
    return _encoded(df, id_col, text_col, ranks_path, leaf, False)


def _encoded(df: DataFrame, id_col: str, text_col: str, ranks_path: str | None, leaf: int, full: bool) -> DataFrame:
    path = ranks_path or vocab.default_ranks()
    kind = dict(df.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, text_col):
            n_tokens, ids_out, bytes_out, ids_sha, bytes_sha = [], [], [], [], []
            for text in batch.column(text_col).to_pylist():
                ids = encode_tree(text or "", path, leaf)
                raw = ids.astype("<u4").tobytes()
                back = decode_tree(ids, path, leaf)
                n_tokens.append(len(ids))
                ids_sha.append(hashlib.sha256(raw).hexdigest())
                bytes_sha.append(hashlib.sha256(back).hexdigest())
                if full:
                    ids_out.append(raw)
                    bytes_out.append(back)
            more = {"ids": pa.array(ids_out, pa.binary()), "decoded": pa.array(bytes_out, pa.binary())} if full else {}
            yield pa.RecordBatch.from_pydict({id_col: batch.column(id_col), "n_tokens": pa.array(n_tokens, pa.int64()), **more, "ids_sha256": pa.array(ids_sha, pa.string()), "decoded_sha256": pa.array(bytes_sha, pa.string())})

    middle = "ids binary, decoded binary, " if full else ""
    return df.select(id_col, text_col).mapInArrow(tidy(run), f"`{id_col}` {kind}, n_tokens long, {middle}ids_sha256 string, decoded_sha256 string")
