"""The registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontam, dialogue, langid, license, lmscore, mixing, neardup, quality, sadedup, sharding, spelling, toxicity, urlfilter


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return langid.languages(_table(spark, folder, "documents"))


def op2_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return sadedup.digest(_table(spark, folder, "documents"))


def op3_lm_score(spark: SparkSession, folder: str) -> DataFrame:
    return lmscore.scores(_table(spark, folder, "documents"))


def op4_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op5_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontam.contamination(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def op6_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, folder, "documents"), size=3, percent=85)


def op7_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return license.licenses(_table(spark, folder, "documents"))


def op8_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(_table(spark, folder, "documents"))


def op9_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.quality(_table(spark, folder, "documents"))


def op10_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return urlfilter.url_filter(_table(spark, folder, "pages"), urlfilter.RULES)


def op11_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    return dialogue.structure(_table(spark, folder, "conversations"))


def op12_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.shard_documents(_table(spark, folder, "documents"))


def op13_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.variants(_table(spark, folder, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    own = {f.__name__: f for f in (op1_language_id, op2_suffix_dedup, op3_lm_score, op4_toxicity, op5_decontamination, op6_near_dedup, op7_license_scan, op8_mixing, op9_quality, op10_url_filter, op11_conversation_repair, op12_sharding, op13_spelling_variants)}
    return own | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {"op8_mixing": mixing.ORACLE}  # the pipeline's first stage learns a model: corpus_pipeline.ORACLE_SQL is None
