"""Raw documents to packed training sequences in five stages.

Each stage works on everything its predecessor kept and takes effect: documents of low quality go, one of each group of
near duplicates stays, documents with benchmark passages go, secrets are replaced by a mark in the text, and what is
left is packed into sequences. ``run`` writes every stage as Parquet below spark.checkpoint.dir and reads it again, so
a lost executor costs a task, not a stage.

Nulls, ties and extra columns: all but the last stage return the columns they get. Rows without a doc_id can't be told
apart, so no two of them count as duplicates and all stay in that stage. Rows that share a doc_id are compared by their
texts like any others: different texts under one id all stay, and repeated rows leave one. Empty tables pass through as
empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.decontaminate import without_benchmark
from tidemark.llm.packing import pack
from tidemark.llm.quality import QualityModel
from tidemark.llm.secrets import redact
from tidemark.llm.simhash import one_of_each_group
from tidemark.sources.staging import stage


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return QualityModel(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).accepted(docs)


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group the row of the smallest doc_id stays, of several such rows that of the smallest hash."""
    return one_of_each_group(docs)


def free_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_benchmark(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def free_of_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs)


STAGES = [
    ("quality classifier", good_quality),
    ("simhash near-dedup", distinct_texts),
    ("benchmark decontamination", free_of_benchmark),
    ("secret scans", free_of_secrets),
    ("best-fit packing", packed),
]

#: The classifier, component search and packing have no SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, one after the other."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
