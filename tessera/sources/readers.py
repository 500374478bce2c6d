"""Where rows come from: source trees, snapshots, graph files, evaluation sets."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from tessera.functions.text import extension, relative_to
from tessera.operators.filters import DEFAULT_EXTENSIONS, ignored

# Versions of the graph files that can be read.
SYMBOL_GRAPH_VERSIONS = ("v3-1", "v3-2", "v3-3")


def source_tree(spark: SparkSession, root: str, extensions: Iterable[str] = DEFAULT_EXTENSIONS, ignores: Iterable[str] = ()) -> DataFrame:
    """``(path, language, content, hash)`` of the files below ``root``.

    Hidden and ignored paths and other extensions are dropped on the file listing,
    before any content is read; no extensions means all. Files that vanish or can't
    be read are skipped. A file that isn't UTF-8 has its broken bytes replaced."""
    spark_read = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True)
    found = spark_read.load(root)
    scheme = "^[a-z0-9]+:/+"
    path = relative_to(F.regexp_replace("path", scheme, "/"), F.lit(re.sub(scheme, "/", root.rstrip("/"))))
    own = list(extensions)
    files = found.select(path.alias("path"), "content")
    keep = ~ignored(F.col("path"), ignores)
    if own:
        keep = keep & extension(F.col("path")).isin(*own)
    text = F.make_valid_utf8(F.col("content").cast("string"))
    return files.where(keep).select("path", F.substr(extension(F.col("path")), F.lit(2)).alias("language"), text.alias("content"), F.sha2("content", 256).alias("hash"))


def snapshot(spark: SparkSession, path: str, compute) -> DataFrame:
    """The stored state, or ``compute()`` stored for the next time if there is none."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    compute().write.parquet(path)
    return spark.read.parquet(path)


def symbol_graph(df: DataFrame, payload: str = "payload") -> DataFrame:
    """``(axis, key, pos, member)`` of graph files given as JSON text in a column.
    Members that are no text are dropped; a file of an unknown version, or one that
    can't be read, has no rows."""
    lists = "map<string,array<string>>"
    kind = f"struct<version:string,by_symbol:map<string,struct<canonical_chunk_ids:array<string>,mentioned_by_chunk_ids:array<string>>>,by_package:{lists},by_supertype:{lists},by_abstract_underlying:{lists},by_typedef_alias:{lists}>"
    g = df.select(F.from_json(payload, kind).alias("g")).where(F.col("g.version").isin(*SYMBOL_GRAPH_VERSIONS))
    symbols = F.map_entries("g.by_symbol")
    entry = lambda axis, key, members: F.struct(F.lit(axis).alias("axis"), key.alias("key"), members.alias("members"))
    none = F.array().cast("array<struct<axis:string,key:string,members:array<string>>>")

    def listed(axis: str):
        return F.coalesce(F.transform(F.map_entries(f"g.by_{axis}"), lambda e: entry(axis, e["key"], e["value"])), none)

    parts = [
        F.coalesce(F.transform(symbols, lambda e: entry("canonical", e["key"], e["value"]["canonical_chunk_ids"])), none),
        F.coalesce(F.transform(symbols, lambda e: entry("mentioned", e["key"], e["value"]["mentioned_by_chunk_ids"])), none),
        *(listed(x) for x in ("package", "supertype", "abstract_underlying", "typedef_alias")),
    ]
    rows = g.select(F.explode(F.concat(*parts)).alias("e")).select("e.axis", "e.key", F.posexplode("e.members").alias("pos", "member"))
    return rows.where("member IS NOT NULL AND member <> ''")


def prose_graph(df: DataFrame, version: str, payload: str = "payload") -> DataFrame:
    """``(src, dst, type, weight)`` of graph files given as JSON text. Edges without
    a target are dropped; a weight that is no finite number counts 1."""
    kind = "struct<version:string,adjacency:map<string,array<struct<to:string,type:string,weight:double>>>>"
    g = df.select(F.from_json(payload, kind, {"allowNonNumericNumbers": "true"}).alias("g")).where(F.col("g.version") == version)
    e = g.select(F.explode("g.adjacency").alias("src", "edges")).select("src", F.explode("edges").alias("e"))
    w = F.col("e.weight")
    finite = w.isNotNull() & ~F.isnan(w) & (F.abs(w) != float("inf"))
    return e.where("e.to IS NOT NULL AND e.to <> ''").select("src", F.col("e.to").alias("dst"), F.col("e.type").alias("type"), F.when(finite, w).otherwise(1.0).alias("weight"))


def repository_tree(df: DataFrame, extensions: Iterable[str] = DEFAULT_EXTENSIONS) -> DataFrame:
    """Files of a repository listing (``path, type, encoding, content``): blobs of the
    wanted extensions, their base64 contents decoded."""
    blobs = df.where((F.col("type") == "blob") & extension(F.col("path")).isin(*extensions))
    text = F.when(F.col("encoding") == "base64", F.make_valid_utf8(F.unbase64(F.regexp_replace("content", r"\s", "")).cast("string"))).otherwise(F.col("content"))
    return blobs.select("path", F.substr(extension(F.col("path")), F.lit(2)).alias("language"), text.alias("content"))


def evaluation_instances(df: DataFrame) -> DataFrame:
    """Rows of an evaluation file that holds them under ``instances`` or ``test``, or
    is the rows itself."""
    for name in ("instances", "test"):
        if name in df.columns:
            return df.select(F.explode(name).alias("i")).select("i.*")
    return df


def symbol_locations(df: DataFrame, payload: str = "payload") -> DataFrame:
    """``(symbol, kind, path, loc_order, loc_start, loc_end)`` of JSON lists of
    locations. A summary without lines stands for the whole file."""
    kind = "array<struct<relative_path:string,body_location:struct<start_line:bigint,end_line:bigint>>>"
    tail = F.regexp_extract(payload, r"(?s)(\[.*\])", 1)
    each = df.select("symbol", "kind", F.posexplode(F.from_json(tail, kind)).alias("loc_order", "l"))
    return each.select("symbol", "kind", F.col("l.relative_path").alias("path"), "loc_order", F.coalesce("l.body_location.start_line", F.lit(0)).alias("loc_start"), F.coalesce("l.body_location.end_line", F.lit(1_000_000)).alias("loc_end")).where("path IS NOT NULL")


def file_window(files: DataFrame, offset: int = 0, limit: int = 2000) -> DataFrame:
    """Lines ``offset`` to ``offset + limit`` of each file, and whether it has more."""
    lines = F.split("content", "\n", -1)
    return files.select("path", F.slice(lines, offset + 1, limit).alias("lines"), (F.size(lines) > offset + limit).alias("more"))


def directory_tree(files: DataFrame, depth: int = 3, skip: Iterable[str] = ("node_modules", "__pycache__")) -> DataFrame:
    """``(folder, level, n_files)`` of the folders down to ``depth``."""
    parts = F.split("path", "/", -1)
    levels = F.transform(F.sequence(F.lit(1), F.least(F.size(parts) - 1, F.lit(depth))), lambda n: F.struct(F.array_join(F.slice(parts, 1, n), "/").alias("folder"), n.alias("level")))
    keep = (F.size(parts) > 1) & ~F.arrays_overlap(parts, F.array(*map(F.lit, skip)))
    return files.where(keep).select(F.explode(levels).alias("l")).groupBy("l.folder", "l.level").agg(F.count("*").alias("n_files"))
