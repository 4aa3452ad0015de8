"""Files of contracts, pages and policies as DataFrames, and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import base_name

# What the bytes 0x80 to 0x9F mean in windows-1252, but for the five that mean nothing.
CP1252 = {0x80: "€", 0x82: "‚", 0x83: "ƒ", 0x84: "„", 0x85: "…", 0x86: "†", 0x87: "‡", 0x88: "ˆ", 0x89: "‰", 0x8A: "Š", 0x8B: "‹", 0x8C: "Œ", 0x8E: "Ž", 0x91: "‘", 0x92: "’", 0x93: "“", 0x94: "”", 0x95: "•", 0x96: "–", 0x97: "—", 0x98: "˜", 0x99: "™", 0x9A: "š", 0x9B: "›", 0x9C: "œ", 0x9E: "ž", 0x9F: "Ÿ"}
OFFICE = r"(?i)\.(docx?|xlsx?|pptx?|odt|ods|odp|zip|rar|7z|gz)$"
POLICY = "policy_id string, risk_threshold int, context string, domains array<struct<domain_name:string,required:boolean,micro_policies:array<struct<id:string,name:string,check:string,risk_weight:int>>>>"


def decode(content: Column) -> Column:
    """Bytes as text: UTF-8 without its mark, else windows-1252, else latin-1 (for the five bytes that windows-1252 lacks)."""
    read = F.try_validate_utf8(content.cast("string"))
    utf8 = F.when(F.startswith(read, F.lit("﻿")), F.substring(read, F.lit(2), F.length(read))).otherwise(read)  # no pattern, which would copy the text twice
    latin = F.decode(content, "ISO-8859-1")
    western = F.translate(latin, "".join(map(chr, CP1252)), "".join(CP1252.values()))
    return F.coalesce(utf8, F.when(latin.rlike(r"[\x{81}\x{8d}\x{8f}\x{90}\x{9d}]"), latin).otherwise(western))


def unreadable(path: Column, content: Column) -> Column:
    """Why a file is no text: office or archive by name or by its first bytes, or a zero byte in the first 2048; null if it is one."""
    head = F.hex(F.substring(content, 1, 2048))
    zero = F.regexp_like(head, F.lit("^(..)*?00"))
    return F.when(path.rlike(OFFICE), "office").when(F.substring(head, 1, 8) == "504B0304", "zip").when(zero, "binary")


def read_contracts(spark: SparkSession, folder: str, pattern: str = "*") -> tuple[DataFrame, DataFrame]:
    """Pages (contract_id, filename, page_no, text) of text files, cut at form feeds, and the files that are no text (path, reason).

    A file is a contract: its hash and its encoding are those of the whole, so a task holds each of its files as one row, some four times over.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    files = files.withColumn("reason", unreadable(F.col("path"), F.col("content")))
    good = files.where(F.col("reason").isNull()).select(F.sha2("content", 256).alias("contract_id"), base_name(F.col("path")).alias("filename"), decode(F.col("content")).alias("_t"))
    good = good.withColumn("_p", F.when(F.contains("_t", F.lit("\f")), F.split("_t", "\f")).otherwise(F.array("_t"))).drop("_t")
    pages = good.select("contract_id", "filename", F.posexplode("_p").alias("page_no", "text")).withColumn("page_no", F.col("page_no") + 1)
    return pages, files.where(F.col("reason").isNotNull()).select("path", "reason")


def read_policies(spark: SparkSession, folder: str) -> DataFrame:
    """Checks of the policies in JSON files: policy_id, risk_threshold, domain, required, check_no, check_id, name, check_text, risk_weight. Files that can't be read are dropped."""
    raw = spark.read.schema(POLICY).option("multiLine", True).option("mode", "DROPMALFORMED").json(folder).where(F.col("policy_id").isNotNull())
    each = raw.select("policy_id", "risk_threshold", F.posexplode("domains").alias("d_no", "d")).select("policy_id", "risk_threshold", "d_no", F.col("d.domain_name").alias("domain"), F.coalesce("d.required", F.lit(False)).alias("required"), F.posexplode("d.micro_policies").alias("m_no", "m"))
    return each.select("policy_id", "risk_threshold", "domain", "required", (F.col("d_no") * 1000 + F.col("m_no")).alias("check_no"), F.col("m.id").alias("check_id"), "m.name", F.col("m.check").alias("check_text"), F.coalesce("m.risk_weight", F.lit(0)).alias("risk_weight"))


def save_policies(policies: DataFrame, folder: str) -> None:
    """Policies with an id, one folder for each; those written again are replaced."""
    policies.where(F.col("policy_id").isNotNull() & (F.col("policy_id") != "")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("policy_id").json(folder)


def save_passages(passages: DataFrame, folder: str, buckets: int = 64) -> None:
    """All passages of the contracts at hand replace those stored in their buckets; write whole buckets (upsert first)."""
    passages.withColumn("bucket", F.pmod(F.xxhash64("contract_id"), F.lit(buckets)).cast("int")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(folder)


def export_json(records: DataFrame, folder: str) -> None:
    records.write.mode("overwrite").json(folder)


def export_csv(rows: DataFrame, folder: str) -> None:
    rows.write.mode("overwrite").option("header", True).option("quoteAll", True).csv(folder)
