"""Figures for overviews of a portfolio."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEVELS = ("high", "medium", "low")


def totals(directory: DataFrame) -> DataFrame:
    """One row: contracts, analysed or not, clauses by risk, the share of high risk as a whole percentage and its band."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    out = directory.agg(F.count(F.lit(1)).alias("contracts"), F.count_if(F.col("status") == "analyzed").alias("analyzed"), F.count_if(F.col("status") != "analyzed").alias("not_analyzed"), total("total_clauses").alias("clauses"), *[total(f"{x}_risk_clauses").alias(x) for x in LEVELS])
    share = F.when(F.col("clauses") > 0, F.floor(100.0 * F.col("high") / F.col("clauses") + 0.5)).otherwise(0).cast("long")
    return out.withColumn("high_percent", share).withColumn("band", F.when(F.col("high_percent") > 20, "red").when(F.col("high_percent") > 10, "yellow").otherwise("green"))


def top_domains(classified: DataFrame, n: int = 6) -> DataFrame:
    return classified.groupBy("domain").agg(F.count(F.lit(1)).alias("clauses")).orderBy(F.desc("clauses"), "domain").limit(n)


def recent(directory: DataFrame, n: int = 5) -> DataFrame:
    when = F.coalesce("updated_at", "created_at", F.lit(""))
    return directory.withColumn("at", when).orderBy(F.desc("at"), "contract_id").limit(n).select("contract_id", "filename", "at", "high_risk_clauses")


def risk_distribution(classified: DataFrame) -> DataFrame:
    return classified.groupBy(F.lower("risk_level").alias("level")).agg(F.count(F.lit(1)).alias("n")).where(F.col("level").isin(*LEVELS))


def daily_trend(directory: DataFrame) -> DataFrame:
    """Contracts, clauses and high-risk clauses by day of creation."""
    return directory.groupBy(F.col("created_at").alias("day")).agg(F.count(F.lit(1)).alias("contracts"), F.coalesce(F.sum("high_risk_clauses"), F.lit(0)).alias("high"), F.coalesce(F.sum("total_clauses"), F.lit(0)).alias("clauses"))


def filtered(directory: DataFrame, classified: DataFrame, name: str = "", risk: str | None = None, domain: str | None = None, days: int | None = None, now: str | None = None) -> DataFrame:
    """Contracts whose name holds `name`, with a clause of a risk level, with a clause in a domain, created in the last `days` before `now`."""
    out = directory.where(F.contains(F.lower("filename"), F.lit(name.lower()))) if name else directory
    if risk:
        out = out.join(classified.where(F.lower("risk_level") == risk.lower()).select("contract_id"), "contract_id", "left_semi")
    if domain:
        out = out.join(classified.where(F.col("domain") == domain).select("contract_id"), "contract_id", "left_semi")
    if days:
        out = out.where(F.datediff(F.to_date(F.lit(now)), F.to_date("created_at")).between(0, days))
    return out


def domains(classified: DataFrame) -> DataFrame:
    return classified.select("domain").distinct()


def counts_by_level(classified: DataFrame) -> DataFrame:
    return classified.groupBy("contract_id").pivot("risk_level", ["High", "Medium", "Low"]).agg(F.count(F.lit(1))).na.fill(0)


def export_rows(classified: DataFrame) -> DataFrame:
    """Clauses as flat text for CSV: commas become semicolons, newlines spaces; what is missing is `Unknown`."""
    from ..functions.text import make_title

    flat = lambda c: F.translate(F.regexp_replace(c, r"\r?\n", " "), ",", ";")
    missing = lambda c: F.coalesce(F.col(c), F.lit("Unknown"))
    return classified.select("contract_id", "clause_id", flat(make_title(F.col("text"), F.col("domain"))).alias("title"), missing("domain").alias("domain"), missing("risk_level").alias("risk_level"), flat(F.coalesce("reason", F.lit("Unknown"))).alias("reasons"), flat(F.coalesce("text", F.lit(""))).alias("text"))


def export_record(directory: DataFrame, classified: DataFrame) -> DataFrame:
    """One nested row for each contract, for JSON: facts, risk summary and clauses in order."""
    clauses = classified.groupBy("contract_id").agg(F.array_sort(F.collect_list(F.struct("clause_id", "domain", "risk_level", "reason", "text"))).alias("clauses"))
    risk = F.struct(*[F.col(f"{x}_risk_clauses").alias(x) for x in LEVELS])
    return directory.withColumn("risk_summary", risk).join(clauses, "contract_id", "left")


def day_of(ts: Column) -> Column:
    return F.date_trunc("day", ts)
