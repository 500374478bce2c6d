"""A corpus pipeline over ``documents``: language, near duplicates, repeated
substrings, personal data, packing.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that the stage before
it kept; all but the last return the columns of ``documents``. ``run`` writes each
stage as Parquet to the shared folder and reads it again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import langid, neardup, packing, pii, substring
from tessera.llm.common import small_transfers, staged

#: Below this mean probability of the best language a document goes. Clean text is
#: far above it; what lies below is mostly too short to tell.
LEAST_LANGUAGE = 0.3
#: Near duplicates share this much of their five-word shingles.
NEAR = neardup.Forest(words=5, percent=80)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a letter or without a clear language."""
    small_transfers(spark)
    model = langid.learn(docs)
    return langid.label(docs, model, keep=True, prefix="__").where((F.col("__lang_pred") != "und") & (F.col("__score") >= LEAST_LANGUAGE)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each component."""
    small_transfers(spark)
    return neardup.deduplicated(docs, forest=NEAR)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove strings of 200 bytes or more that occur more than once."""
    small_transfers(spark)
    out = substring.remove(docs, keep=True, prefix="__")
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data and the terms that disclose it."""
    return pii.sanitised(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into training sequences."""
    small_transfers(spark)
    return packing.pack(docs)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("repeated_strings", repeated_strings), ("personal_data", personal_data), ("packing", packed)]

#: Networks, grammars of spans and packing are beyond SQL; the tests hold the language
#: stage to clean and rejected documents, near duplicates, repeated strings and personal
#: data to plain Python over the same rows, and the pieces to the tokenizers library.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
