"""Line-first cleaning.

Every line of a text is judged by itself: navigation (separators between few
words), punctuation (no closing mark, piled-up symbols, shouted marks) and
boilerplate (licence, cookie, sign-in phrases). Failing lines are removed, and a
document that loses too large a share of its characters is rejected. Beside the
verdict stand plain counts of the whole text; a text of few words, or of many
words in repeated five-word windows, fails before the verdict.

Windows and words are compared by 64-bit hashes of their bytes. A null text
counts as one without words; blank lines neither fail nor count; a text without
words fails the base rule. Rows are never compared with one another, so there is
no shuffle and repeated rows get equal results.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm.common import mix, mixers, small_batches, strings, tidy, word_hashes, word_runs

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


@dataclass(frozen=True)
class LineRules:
    """Limits of the rules; shares are of words or characters in percent."""

    least_words: int = 10
    most_repeat: int = 20
    window: int = 5
    most_lost: int = 66
    closing: str = ".!?…:;。！？"
    trailing: str = "\"'»”’)]}"
    separators: str = "|»›•·"
    symbols: str = "#*$%&<>"
    boilerplate: str = r"(?i)\b(?:licen[sc]ed? under|released under the|all rights reserved|copyright|cookies?|javascript|privacy policy|terms of (?:use|service)|sign in|log in|subscribe)\b"


def line_fails(line: str, rules: LineRules, boiler: re.Pattern | None) -> bool:
    """Whether a line that isn't blank fails a rule."""
    s = line.strip()
    n = len(s.split())
    bars = sum(s.count(c) for c in rules.separators)
    if bars and 3 * bars >= n:
        return True
    marks = sum(s.count(c) for c in rules.symbols)
    if marks > 1 and 2 * marks >= n or 2 * s.count("!!") >= n + 1:
        return True
    end = s.rstrip(rules.trailing)[-1:]
    if end not in rules.closing or not end:
        return True
    return bool(boiler and boiler.search(s))


def _verdict(text: str, rules: LineRules, boiler: re.Pattern) -> tuple[int, int, str]:
    """Characters of the words of failing lines, failing lines, and the rest."""
    lost, failed, rest = 0, 0, []
    here = boiler if boiler.search(text) else None
    for line in text.split("\n"):
        if line and not line.isspace() and line_fails(line, rules, here):
            lost += len("".join(line.split()))
            failed += 1
        else:
            rest.append(line)
    return lost, failed, "\n".join(rest)


def _counts(raw: np.ndarray, offsets: np.ndarray, rules: LineRules) -> dict[str, np.ndarray]:
    n = len(offsets) - 1
    starts, ends, rows = word_runs(raw, offsets)
    n_words = np.bincount(rows, minlength=n)
    lead = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    word_chars = np.bincount(rows, (lead[ends] - lead[starts]).astype(float), n).astype(np.int64)
    marks = np.concatenate([[0], np.cumsum(_SYMBOL[raw])])
    n_symbols = marks[offsets[1:]] - marks[offsets[:-1]]
    repeat = np.zeros(n, np.int64)
    w = rules.window
    if len(rows) >= w:
        hashes, _ = word_hashes(raw, offsets, lower=False)
        m = mixers(w + 1)
        with np.errstate(over="ignore"):
            key = rows[: len(rows) - w + 1].astype(np.uint64) * m[w]
            for k in range(w):
                key = mix(key + hashes[k : len(hashes) - w + 1 + k] * m[k])
        own = np.flatnonzero(rows[: len(rows) - w + 1] == rows[w - 1 :])
        key = key[own]
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(own), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        edge = np.zeros(len(rows) + 1, np.int64)
        edge[own[twice]] += 1
        np.subtract.at(edge, own[twice] + w, 1)
        repeat = np.bincount(rows[np.cumsum(edge[:-1]) > 0], minlength=n)
    return {"n_words": n_words, "word_chars": word_chars, "n_symbols": n_symbols, "n_repeat_words": repeat}


def _repeated_lines(text: str) -> int:
    lines = text.split("\n")
    if len(set(lines)) == len(lines):
        return 0
    seen: set[str] = set()
    n = 0
    for line in lines:
        if line in seen:
            n += bool(line.strip(" \t\n\r\v\f"))
        else:
            seen.add(line)
    return n


def clean_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: LineRules | None = None, with_text: bool = True) -> DataFrame:
    """Counts, verdict and (``with_text``) the cleaned text of each row.

    Columns: the id, ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``,
    ``n_repeat_words``, ``base_failed``, ``kept``, ``n_failed_lines``,
    ``lost_chars``[, ``clean_text``].
    """
    rules = rules or LineRules()
    kind = dict(df.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        boiler = re.compile(rules.boilerplate)
        for batch in small_batches(batches, text_col):
            column = batch.column(text_col)
            c = _counts(*strings(column), rules)
            texts = [t or "" for t in column.to_pylist()]
            dup = np.array([_repeated_lines(t) for t in texts], np.int64)
            judged = [_verdict(t, rules, boiler) for t in texts]
            lost = np.array([x[0] for x in judged], np.int64)
            base = (c["n_words"] < rules.least_words) | (100 * c["n_repeat_words"] > rules.most_repeat * c["n_words"])
            out = {
                id_col: batch.column(id_col), "n_words": c["n_words"], "word_chars": c["word_chars"], "n_symbols": c["n_symbols"], "n_dup_lines": dup,
                "n_repeat_words": c["n_repeat_words"], "base_failed": base, "kept": ~base & (100 * lost <= rules.most_lost * c["word_chars"]),
                "n_failed_lines": np.array([x[1] for x in judged], np.int64), "lost_chars": lost,
            }
            if with_text:
                out["clean_text"] = pa.array([x[2] for x in judged], pa.string())
            yield pa.RecordBatch.from_pydict({k: v if isinstance(v, pa.Array) else pa.array(v) for k, v in out.items()})

    schema = f"`{id_col}` {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_failed_lines long, lost_chars long"
    return df.select(id_col, text_col).mapInArrow(tidy(run), schema + (", clean_text string" if with_text else ""))
