"""From raw documents to a training mix, stage by stage.

Each stage is a function of (spark, docs, folder) that returns a DataFrame, which is written as Parquet and reread as
the next stage's input. Stages but the last return the columns of `documents`; a text that lost bytes gets its new
length in `n_chars`. The last returns one row for each document that the mix takes, with the words taken.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pactlake.llm import common, decontam, mixing, neardup, sadedup, toxicity

#: A text goes from this score on; the labels are fitted on their own share of toxic texts.
REJECT = 0.3
#: Bytes of a passage that is cut wherever it occurs twice: below 50 words of any of the languages.
PASSAGE = 200


def toxicity_stage(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    model = toxicity.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    (score,) = common.free_names(docs, "toxicity")
    return toxicity.score(docs, model, out=score).where(F.col(score) < REJECT).drop(score)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    return neardup.deduplicate(docs, size=5, percent=80)


def suffix_dedup_stage(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    out = sadedup.remove_repeats(docs, length=PASSAGE)
    if "n_chars" in out.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out


def decontamination_stage(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    return decontam.clean(docs, spark.read.parquet(f"{folder}/benchmark.parquet"))


def mixing_stage(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    return mixing.mix(docs).where(F.col("passes") > 0)


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_dedup", near_dedup_stage),
    ("suffix_dedup", suffix_dedup_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
]

#: The first stage learns a model, which SQL can't express; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """All stages on the documents of `folder`. Between stages, tables lie in the shared checkpoint folder."""
    base = f"{common.shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, folder).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return STAGES[-1][1](spark, docs, folder)
