"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again by the next one."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lookbook.llm import decontaminate, mixture, personal_data, quality_rules, simhash_dedup
from lookbook.llm.common import checkpoint_dir, read


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_rules.keep_good(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component stays."""
    return simhash_dedup.deduplicate(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.decontaminate(docs, read(spark, sf_dir, "benchmark"))


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is masked."""
    return personal_data.mask_personal_data(docs)


def mixture_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with the words that the mix takes of each and the first slot that holds it."""
    return mixture.mixed_documents(docs)


STAGES = [
    ("quality_rules", quality_stage),
    ("simhash_dedup", near_dedup_stage),
    ("decontaminate", decontamination_stage),
    ("personal_data", personal_data_stage),
    ("mixture", mixture_stage),
]

#: Weak supervision and the span classifier are fitted models, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What all stages keep of ``documents``, with the words that the mix takes of each; each stage's rows are a table in the shared folder.

    Null and empty texts go with the first stage, which finds no words in them; null ids and sources, repeated ids, texts of any
    length and further columns are taken as the stages' functions say. Empty tables give no rows.
    """
    docs, folder = read(spark, sf_dir, "documents"), f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
