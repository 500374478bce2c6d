"""Chunkers over a table of files, one Arrow batch at a time and without a shuffle."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.chunking import code, prose, structure
from tessera.chunking.prose import Chunk
from tessera.functions.symbols import imports
from tessera.operators.blocks import small_transfers

SCHEMA = "path string, ord long, chunk_id string, content string, start_line long, end_line long, content_type string, language string, heading_path array<string>, symbol string, kind string, parent string"

CHUNKERS: dict[str, Callable[..., list[Chunk]]] = {
    "syntax": lambda text, language: code.code(text, language),
    "gaps": lambda text, language: code.code(text, language, gaps=True),
    "recursive": code.recursive,
    "browser": lambda text, language: code.browser(text),
    "markdown": lambda text, language: prose.markdown(text),
    "rst": lambda text, language: prose.rst(text),
}


def chunked(files: DataFrame, chunker: str | Callable[[str, str], list[Chunk]] = "syntax") -> DataFrame:
    """Chunks of ``path, language, content``. A null text is an empty one. The
    chunker is an argument of the call and nothing else is changed by it."""
    cut = CHUNKERS[chunker] if isinstance(chunker, str) else chunker
    small_transfers(files.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, language, text in zip(*(batch.column(c).to_pylist() for c in ("path", "language", "content")), strict=True):
                own = cut(text or "", language or "")
                get = lambda name, own=own: [getattr(c, name) for c in own]
                yield pa.RecordBatch.from_pydict({
                    "path": pa.array([path] * len(own), pa.string()), "ord": pa.array(range(len(own)), pa.int64()), "chunk_id": pa.array([f"{path}_chunk_{k}" for k in range(len(own))], pa.string()),
                    "content": pa.array(get("content"), pa.string()), "start_line": pa.array(get("start_line"), pa.int64()), "end_line": pa.array(get("end_line"), pa.int64()), "content_type": pa.array(get("content_type"), pa.string()),
                    "language": pa.array([c.language or language or "" for c in own], pa.string()), "heading_path": pa.array(get("heading_path"), pa.list_(pa.string())), "symbol": pa.array(get("symbol"), pa.string()), "kind": pa.array(get("kind"), pa.string()), "parent": pa.array(get("parent"), pa.string()),
                })

    return files.select("path", "language", "content").mapInArrow(run, SCHEMA)


_RELATION = "array<struct<name:string,base:string,others:array<string>>>"


def structured(files: DataFrame) -> DataFrame:
    """``path, imports, classes, abstracts, aliases`` of each file. Imports of most
    languages are an expression of the scan; the rest is read from the text."""
    relation = pa.list_(pa.struct([("name", pa.string()), ("base", pa.string()), ("others", pa.list_(pa.string()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, classes, abstracts, aliases = [], [], [], []
            for language, text, known in zip(*(batch.column(c).to_pylist() for c in ("language", "content", "known")), strict=True):
                text = text or ""
                found.append(structure.python_imports(text) if language in ("python", "py") else known)
                classes.append([{"name": a, "base": b, "others": c} for a, b, c in structure.heritage(text, language)])
                abstracts.append([{"name": a, "base": None, "others": b} for a, b in structure.abstracts(text)])
                aliases.append([{"name": a, "base": b, "others": []} for a, b in structure.aliases(text)])
            yield pa.RecordBatch.from_pydict({"path": batch.column("path"), "imports": pa.array(found, pa.list_(pa.string())), "classes": pa.array(classes, relation), "abstracts": pa.array(abstracts, relation), "aliases": pa.array(aliases, relation)})

    language = F.lower(F.coalesce("language", F.lit("")))
    rows = files.select("path", language.alias("language"), "content", F.coalesce(imports(F.col("content"), language), F.array().cast("array<string>")).alias("known"))
    return rows.mapInArrow(run, f"path string, imports array<string>, classes {_RELATION}, abstracts {_RELATION}, aliases {_RELATION}")
