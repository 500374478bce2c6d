"""Language of a text by a bidirectional gated recurrent network over its bytes.

Every byte position is labelled from a forward and a backward hidden state; a
document's probabilities are the mean over all its positions. The network is
trained in numpy by backpropagation through time on a bounded sample of labelled
rows; no table of words or letters is given to it. States start anew every
``steps`` bytes, so a text of any length is worked off in blocks.

A null text, or one without a letter, is ``und`` with score 0, as is every text
where no labelled row could be learned from. Rows with a null id are never
trained on. Ties go to the language that sorts first. There is no shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import small_batches, strings, tidy

_LETTER = re.compile(r"[^\W\d_]")


@dataclass(frozen=True)
class Settings:
    """``most_rows`` bounds the labelled sample, ``pieces`` its slices of
    ``steps`` bytes from each row, taken from anywhere in the text."""

    most_rows: int = 6000
    pieces: int = 6
    steps: int = 96
    hidden: int = 8
    batch: int = 384
    updates: int = 420
    rate: float = 0.02
    seed: int = 7
    block: int = 4096


@dataclass(frozen=True)
class Model:
    """Weights by direction, with features in rows, and the languages."""

    langs: tuple[str, ...]
    inputs: tuple[np.ndarray, np.ndarray]
    hidden: tuple[np.ndarray, np.ndarray]
    out: tuple[np.ndarray, np.ndarray]
    bias: np.ndarray


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _forward(x: np.ndarray, w: np.ndarray, u: np.ndarray, order: range) -> list[tuple]:
    h_size = u.shape[1]
    h = np.zeros((h_size, x.shape[1]), np.float32)
    kept: list = [None] * len(x)
    for t in order:
        g, a = w[:, x[t]], u @ h
        zr = _sigmoid(g[: 2 * h_size] + a[: 2 * h_size])
        z, r, m = zr[:h_size], zr[h_size:], a[2 * h_size :]
        n = np.tanh(g[2 * h_size :] + r * m)
        new = n + z * (h - n)
        kept[t] = (h, z, r, n, m, new)
        h = new
    return kept


def _backward(x: np.ndarray, kept: list[tuple], from_out: np.ndarray, u: np.ndarray, order: range) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the input and hidden weights. ``from_out``: steps x hidden x rows."""
    h_size = u.shape[1]
    d_u, d_h = np.zeros_like(u), np.zeros_like(from_out[0])
    d_g = np.empty((len(x), 3 * h_size, x.shape[1]), np.float32)
    for t in reversed(order):
        h, z, r, n, m, _ = kept[t]
        d = from_out[t] + d_h
        d_n = d * (1 - z) * (1 - n * n)
        d_z = d * (h - n) * z * (1 - z)
        d_r = d_n * m * r * (1 - r)
        d_a = np.concatenate([d_z, d_r, d_n * r])
        d_g[t] = np.concatenate([d_z, d_r, d_n])
        d_u += d_a @ h.T
        d_h = d * z + u.T @ d_a
    flat = x.ravel()
    rows = d_g.transpose(1, 0, 2).reshape(3 * h_size, -1)
    return np.stack([np.bincount(flat, row, 256) for row in rows]).astype(np.float32), d_u


def train(pieces: np.ndarray, labels: np.ndarray, langs: tuple[str, ...], s: Settings) -> Model:
    """``pieces``: rows x steps of bytes; ``labels``: index of each row's language."""
    rng = np.random.Generator(np.random.PCG64(s.seed))
    h, c = s.hidden, len(langs)
    near = lambda *shape, by: (rng.standard_normal(shape) * by).astype(np.float32)
    p = [near(3 * h, 256, by=0.3), near(3 * h, 256, by=0.3), near(3 * h, h, by=h**-0.5), near(3 * h, h, by=h**-0.5), near(c, h, by=0.3), near(c, h, by=0.3), np.zeros((c, 1), np.float32)]
    first, second = [np.zeros_like(x) for x in p], [np.zeros_like(x) for x in p]
    by_lang = [np.flatnonzero(labels == k) for k in range(c)]
    ahead, back = range(s.steps), range(s.steps - 1, -1, -1)
    for step in range(1, s.updates + 1):
        pick = np.concatenate([rng.choice(rows, s.batch // c + 1) for rows in by_lang])
        x, y = pieces[pick].T, labels[pick]
        fw, bw = _forward(x, p[0], p[2], ahead), _forward(x, p[1], p[3], back)
        hf, hb = np.stack([k[5] for k in fw]), np.stack([k[5] for k in bw])
        logits = p[4] @ hf + p[5] @ hb + p[6]
        e = np.exp(logits - logits.max(1, keepdims=True))
        d = e / e.sum(1, keepdims=True)
        d[:, y, np.arange(len(y))] -= 1
        d /= d.shape[0] * d.shape[2]
        grads = [None] * 7
        grads[0], grads[2] = _backward(x, fw, p[4].T @ d, p[2], ahead)
        grads[1], grads[3] = _backward(x, bw, p[5].T @ d, p[3], back)
        grads[4], grads[5] = np.einsum("tcb,thb->ch", d, hf), np.einsum("tcb,thb->ch", d, hb)
        grads[6] = d.sum((0, 2))[:, None]
        rate = s.rate * min(1.0, 1.2 - step / s.updates)
        for k, g in enumerate(grads):
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            p[k] = p[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
    return Model(langs, (p[0], p[1]), (p[2], p[3]), (p[4], p[5]), p[6])


def _pooled(model: Model, x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of the position probabilities of each piece (languages x pieces).
    ``x``: steps x pieces; positions from ``sizes`` on don't count."""
    steps, n = x.shape
    h_size, c = model.hidden[0].shape[1], len(model.langs)
    half = np.ones((3 * h_size, 1), np.float32)
    half[: 2 * h_size] = 0.5
    zr_n, a, h, g = (np.empty((k, n), np.float32) for k in (3 * h_size, 3 * h_size, h_size, 3 * h_size))
    logits = np.empty((steps, c, n), np.float32)
    said, total = np.empty((c, n), np.float32), np.zeros((c, n), np.float32)
    for way in (0, 1):
        w, u, v = model.inputs[way] * half, model.hidden[way] * half, model.out[way]
        h[:] = 0
        for t in range(steps) if way == 0 else range(steps - 1, -1, -1):
            np.take(w, x[t], axis=1, out=g, mode="clip")
            np.matmul(u, h, out=a)
            zr = np.add(g[: 2 * h_size], a[: 2 * h_size], out=zr_n[: 2 * h_size])
            np.tanh(zr, out=zr)
            zr *= 0.5
            zr += 0.5
            new = np.multiply(zr[h_size:], a[2 * h_size :], out=zr_n[2 * h_size :])
            new += g[2 * h_size :]
            np.tanh(new, out=new)
            h -= new
            h *= zr[:h_size]
            h += new
            if way:
                h *= t < sizes  # padding comes first on the way back
                y = logits[t]
                y += np.matmul(v, h, out=said)
                y += model.bias
                y -= y.max(0)
                np.exp(y, out=y)
                y *= (t < sizes) / y.sum(0)
                total += y
            else:
                np.matmul(v, h, out=logits[t])
    return total


def probabilities(model: Model, raw: np.ndarray, offsets: np.ndarray, s: Settings) -> np.ndarray:
    """Mean position probabilities of each row (rows x languages); 0 where empty."""
    sizes = np.diff(offsets)
    n = -(-sizes // s.steps)
    rows = np.repeat(np.arange(len(sizes)), n)
    if not len(rows):
        return np.zeros((len(sizes), len(model.langs)))
    inner = np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n)
    begin = offsets[:-1][rows] + inner * s.steps
    length = np.minimum(sizes[rows] - inner * s.steps, s.steps)
    padded = np.concatenate([raw, np.zeros(s.steps, np.uint8)])
    out = np.zeros((len(sizes), len(model.langs)))
    for lo in range(0, len(rows), s.block):
        hi = min(lo + s.block, len(rows))
        x = padded[begin[lo:hi] + np.arange(s.steps)[:, None]]
        got = _pooled(model, x, length[lo:hi])
        for k in range(len(model.langs)):
            out[:, k] += np.bincount(rows[lo:hi], got[k], len(sizes))
    return out / np.maximum(sizes, 1)[:, None]


def held_out(id_col: str) -> Column:
    """Whether a row is kept out of the training."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def learn(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", settings: Settings | None = None) -> Model | None:
    """Train on at most ``most_rows`` labelled rows that aren't held out, chosen by
    a hash of their id."""
    s = settings or Settings()
    able = df.where(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    n = able.count()
    if not n:
        return None
    place = F.xxhash64(F.col(id_col).cast("string"), F.lit(s.seed))
    share = min(1.0, 1.05 * s.most_rows / n)
    sample = able.where((place % 1_000_003 + 1_000_003) % 1_000_003 < share * 1_000_003).select(place.alias("place"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            raw, offsets = strings(batch.column("text"))
            place, lang = batch.column("place").to_pylist(), batch.column("lang").to_pylist()
            out = []
            for k in range(batch.num_rows):
                text = raw[offsets[k] : offsets[k + 1]]
                room = len(text) - s.steps
                at = np.random.Generator(np.random.PCG64(place[k] & (2**63 - 1))).integers(0, room + 1, s.pieces) if room > 0 else [0] if len(text) >= 16 else []
                out += [(place[k], lang[k], np.resize(text, s.steps).tobytes() if room < 0 else text[i : i + s.steps].tobytes()) for i in at]
            if out:
                a, b, c = zip(*out, strict=True)
                yield pa.RecordBatch.from_pydict({"place": pa.array(a, pa.int64()), "lang": pa.array(b, pa.string()), "piece": pa.array(c, pa.binary())})

    rows = sample.mapInArrow(tidy(cut), "place long, lang string, piece binary").collect()
    rows = sorted(rows)[: s.most_rows * s.pieces]
    langs = tuple(sorted({r.lang for r in rows}))
    if not langs:
        return None
    pieces = np.frombuffer(b"".join(r.piece for r in rows), np.uint8).reshape(-1, s.steps)
    return train(pieces, np.array([langs.index(r.lang) for r in rows]), langs, s)


def label(df: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", settings: Settings | None = None, keep: bool = False, prefix: str = "") -> DataFrame:
    """The id (with ``keep``, all columns) with ``lang_pred`` and ``score``, whose
    names a prefix can keep apart from the table's own."""
    s = settings or Settings()
    columns = df.columns if keep else [id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, text_col):
            column = batch.column(batch.schema.get_field_index(text_col))
            spoken = np.array([bool(t and _LETTER.search(t)) for t in column.to_pylist()])
            if model is None:
                best, score = np.zeros(batch.num_rows, int), np.zeros(batch.num_rows)
                spoken[:] = False
            else:
                p = probabilities(model, *strings(column), s)
                best, score = p.argmax(1), np.clip(p.max(1), 0, 1)
            name = [model.langs[k] if z else "und" for k, z in zip(best, spoken, strict=True)]
            fields = [batch.column(batch.schema.get_field_index(c)) for c in columns]
            yield pa.RecordBatch.from_arrays([*fields, pa.array(name, pa.string()), pa.array(np.where(spoken, score, 0.0))], [*columns, f"{prefix}lang_pred", f"{prefix}score"])

    chosen = df.select(*dict.fromkeys([*columns, text_col]))
    fields = ", ".join(f"`{c}` {k}" for c, k in df.select(*columns).dtypes)
    return chosen.mapInArrow(tidy(run), f"{fields}, `{prefix}lang_pred` string, `{prefix}score` double")
