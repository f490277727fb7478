"""From raw documents to packed training sequences, a stage at a time."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

from inkstone import attach
from inkstone.llm import mixing, near_dedup, packing, perplexity, quality
from inkstone.llm.common import shared_folder, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose Bradley-Terry score reaches their language's threshold."""
    return quality.filtered(docs, table(attach(spark), sf_dir, "labels"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity lies in their language's band."""
    attach(spark)
    return perplexity.filtered(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    attach(spark)
    return near_dedup.filtered(docs)


def curriculum_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its training time and position in the mixture."""
    attach(spark)
    return mixing.mixed(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences of all documents, each with the position of its first."""
    attach(spark)
    return packing.packed(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", simhash_near_dedup),
    ("curriculum_mixing", curriculum_mixing),
    ("best_fit_packing", best_fit_packing),
]
#: SQL can't express the stages; tests/llm holds run() against stages run one by one, and each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage in turn over all documents; each result is written as Parquet and read again by the next.

    Documents keep all their columns but in the last stage. The files lie in the folder that spark.checkpoint.dir names, else under
    the warehouse directory. Nulls, empty tables, ties and clashing names are handled as the operators' docstrings say.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{shared_folder(spark)}/pipeline-{uuid4().hex}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
