"""The registered queries of the ten training-data operators.

Each takes ``(spark, sf_dir)``, applies its operator with production parameters
to its whole table and returns the full result. Their SQL is in ``oracles``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import ann, bpe, langid, neardup, packing, pii, quality, repair, substring, warc
from tessera.llm.common import documents
from tessera.llm.oracles import ORACLES as ORACLES


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data and disclosing terms of every document."""
    return pii.digests(documents(spark, sf_dir))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document packed into sequences of 2048 tokens."""
    return packing.pack(documents(spark, sf_dir)).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found of every vector whose id is divisible by 20."""
    return ann.search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)


def op4_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, read back from Re-Pair shards."""
    return repair.round_trip(documents(spark, sf_dir))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and digests of every whole text."""
    return bpe.digests(documents(spark, sf_dir))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and the line-first verdict of every document."""
    return quality.clean_lines(documents(spark, sf_dir), with_text=False)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of every page, read back from seekable bundles."""
    return warc.round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from those that aren't held out."""
    docs = documents(spark, sf_dir)
    model = langid.learn(docs)
    return langid.label(docs.select("doc_id", "text"), model).select("doc_id", langid.held_out("doc_id").alias("held_out"), "lang_pred", "score")


def op9_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document under two-word shingles and 80 percent."""
    return neardup.digests(documents(spark, sf_dir))


def op10_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its repeated strings of 200 bytes."""
    return substring.remove(documents(spark, sf_dir).select("doc_id", "text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": op1_pii,
    "op2_packing": op2_packing,
    "op3_ann": op3_ann,
    "op4_repair": op4_repair,
    "op5_bpe": op5_bpe,
    "op6_quality": op6_quality,
    "op7_warc": op7_warc,
    "op8_langid": op8_langid,
    "op9_neardup": op9_neardup,
    "op10_substring": op10_substring,
}
