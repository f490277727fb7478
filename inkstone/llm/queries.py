"""The queries of this subpackage and the SQL that some of them are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .. import attach
from . import chat, licenses, mixing, near_dedup, packing, perplexity, quality, sharding, spans, tokens
from .common import table


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.groups(table(attach(spark), sf_dir, "documents"))


def op2_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(attach(spark), sf_dir, "documents"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(attach(spark), sf_dir, "documents"))


def op4_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark = attach(spark)
    return spans.fingerprints(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark = attach(spark)
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perplexity.rate(table(attach(spark), sf_dir, "documents"))


def op7_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(table(attach(spark), sf_dir, "documents"))


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.linked(chat.as_messages(table(attach(spark), sf_dir, "conversations")))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count(table(attach(spark), sf_dir, "documents"))


def op10_curriculum_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.placed(table(attach(spark), sf_dir, "documents"))


_QUERIES = (op1_simhash_near_dedup, op2_license_scans, op3_best_fit_packing, op4_document_fingerprints, op5_quality_classifier, op6_quality_rules, op7_kd_sharding, op8_chat_formatting, op9_token_counts, op10_curriculum_mixing)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op10_curriculum_mixing": mixing.ORACLE_SQL}
