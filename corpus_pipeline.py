"""From documents to packed windows: quality rules, line dedup, near-dedup, mixing, packing.

Each stage is a DataFrame of the one before, written as Parquet and read again. Nothing is caught here: a stage that fails fails the run.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import linestore, mixing, neardup, packing, quality, storage

#: Every document is taken at most once; four fifths of the tokens that reach the stage.
MIX = mixing.Mix(max_epochs=1)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the repetition rules keep."""
    return quality.filter_quality(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that a document of a smaller id holds; n_chars follows."""
    return linestore.dedup_lines(docs).withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near duplicates."""
    return neardup.deduplicate(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the proportions of the target weights."""
    return mixing.mix_documents(docs, MIX)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of related documents in windows of tokens."""
    return packing.pack(docs)


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mixing", mix), ("packing", pack)]

#: SQL can't express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed documents; what the stages left behind is deleted as soon as the next one is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base, before = f"{storage.shared_dir(spark)}/pipeline-{uuid.uuid4().hex}", None
    for name, stage in STAGES:
        path = f"{base}/{name}"
        with storage.scope():
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            storage.delete(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
