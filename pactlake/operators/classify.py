"""Keyword classification of clauses by domain and risk, quality of an analysis, and the hook for a user's model."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Domains with their words, in order of precedence, and risk words. Matching is by substring, so "nda" is in "mandatory".
DOMAINS: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("Financial", ("payment", "invoice", "fee", "price", "pricing", "revenue", "cost")),
    ("Legal", ("confidential", "nda", "non-disclosure", "trade secret")),
    ("Data Protection", ("data protection", "data processing", "data retention", "data deletion")),
    ("Privacy", ("privacy", "gdpr", "hipaa", "personal information", "personal data")),
    ("Security", ("security", "breach", "encrypt", "encryption", "vulnerability", "patch")),
    ("Operational", ("termination", "renewal", "expiry", "expiration")),
    ("HR", ("employee", "employment", "non-compete", "personnel", "human resources")),
    ("Intellectual Property", ("intellectual property", "copyright", "trademark", "patent", "licence", "license")),
    ("Vendor", ("vendor", "supplier", "subcontractor")),
    ("Compliance", ("compliance", "regulatory", "audit", "anti-bribery", "sanctions")),
    ("Environmental", ("environmental", "emissions", "pollution", "waste disposal")),
)
HIGH = ("indemnify", "indemnification", "penalty", "unlimited liability", "liquidated damages", "warranty disclaimer", "sole discretion")
MEDIUM = ("breach", "termination", "fine", "forfeit", "late payment", "suspend", "automatic renewal")
HIGH_REASON = "Contains potentially high-risk language: "
MEDIUM_REASON = "Contains enforcement, termination, or financial-risk language: "
LOW_REASON = "No strong high-risk keywords were detected"


def keyword_domain(low: Column) -> Column:
    """The domain of a text in lower case. Give a column and no expression: it is looked at for each word."""
    out = F.lit("Other")
    for name, words in reversed(DOMAINS):
        hit = F.contains(low, F.lit(words[0]))
        for w in words[1:]:
            hit = hit | F.contains(low, F.lit(w))
        out = F.when(hit, name).otherwise(out)
    return out


def _hits(low: Column, words: tuple[str, ...]) -> Column:
    return F.array_compact(F.array(*[F.when(F.contains(low, F.lit(w)), w) for w in words]))


def keyword_risk(low: Column) -> Column:
    """A struct of the words for high and for medium risk that a text in lower case holds."""
    return F.struct(_hits(low, HIGH).alias("high"), _hits(low, MEDIUM).alias("medium"))


def signals(text: Column) -> Column:
    low = F.lower(text)
    return F.struct(
        low.rlike(r"\b(expires|expiry|expiration)\b").alias("expiry"),
        low.rlike(r"\b\d+\s*(day|days|month|months|year|years)\b").alias("duration"),
        low.rlike(r"\b(invoice|payment|fee|price|cost)\b").alias("financial"),
    )


def classify(clauses: DataFrame) -> DataFrame:
    """`clauses` (with text) with domain, risk_level and reason; a projection without a shuffle."""
    low = clauses.withColumn("_low", F.lower("text"))
    found = low.withColumn("domain", keyword_domain(F.col("_low"))).withColumn("_risk", keyword_risk(F.col("_low")))
    high, medium = F.size("_risk.high") > 0, F.size("_risk.medium") > 0
    level = F.when(high, "High").when(medium, "Medium").otherwise("Low")
    reason = F.when(high, F.concat(F.lit(HIGH_REASON), F.array_join("_risk.high", ", "))).when(medium, F.concat(F.lit(MEDIUM_REASON), F.array_join("_risk.medium", ", "))).otherwise(LOW_REASON)
    return found.select(*clauses.columns, "domain", level.alias("risk_level"), reason.alias("reason"))


def with_model(clauses: DataFrame, model: Callable[[pd.DataFrame], pd.DataFrame], fields: dict[str, str]) -> DataFrame:
    """`clauses` with what a user's model says of them, null where it fails. The model gets and returns data frames of a batch; its `fields` (name: type) are taken by position of the rows."""
    names, columns = list(fields), clauses.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            try:
                said, error = model(pdf), None
            except Exception as e:  # one failed call must not lose the batch: the rows stay, marked as failed
                said, error = None, str(e)[:200]
            plain = lambda values: pd.Series([None if v is None or v is pd.NA or v != v else v for v in values], index=pdf.index, dtype=object)  # noqa: B023, E731
            out = {n: plain(said[n] if said is not None else [None] * len(pdf)) for n in names}
            yield pdf[columns].assign(**out, model_error=plain([error] * len(pdf)))

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in clauses.schema), *(f"`{n}` {t}" for n, t in fields.items()), "model_error string"])
    return clauses.mapInPandas(run, schema)


def classify_with(clauses: DataFrame, model: Callable[[pd.DataFrame], pd.DataFrame]) -> DataFrame:
    """As classify(), by a user's model (fields domain, risk_level, reason) with keywords where it gives nothing; `method` tells which."""
    said = with_model(clauses, model, {"m_domain": "string", "m_risk_level": "string", "m_reason": "string"})
    both = classify(said)
    ok = F.col("m_domain").isNotNull() & F.col("m_risk_level").isNotNull()
    return both.select(*clauses.columns, *[F.when(ok, F.col(f"m_{c}")).otherwise(F.col(c)).alias(c) for c in ("domain", "risk_level", "reason")], F.when(ok, "llm").otherwise("keyword_fallback").alias("method"))


def to_retry(results: DataFrame) -> DataFrame:
    """Failed rows (method keyword_fallback) of contracts in which at most half failed: those are tried once more."""
    each = Window.partitionBy("contract_id")
    failed = F.col("method") == "keyword_fallback"
    return results.withColumn("_f", F.count_if(failed).over(each)).withColumn("_n", F.count(F.lit(1)).over(each)).where(failed & (F.col("_f") * 2 <= F.col("_n"))).drop("_f", "_n")


def risk_counts(classified: DataFrame, *keys: str, **more: Column) -> DataFrame:
    """Clauses by risk level for each key; levels other than the three are unclassified. Partial counts come before the shuffle. `more` aggregates go along in the same pass."""
    level = F.lower(F.trim(F.coalesce("risk_level", F.lit(""))))
    return classified.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_clauses"),
        F.count_if(level == "high").alias("high"),
        F.count_if(level == "medium").alias("medium"),
        F.count_if(level == "low").alias("low"),
        F.count_if(~level.isin("high", "medium", "low")).alias("unclassified"),
        *[c.alias(n) for n, c in more.items()],
    )


def analysis_quality(results: DataFrame, checks: DataFrame) -> DataFrame:
    """Of each contract: clauses and checks that fell back on keywords, whether the analysis is complete, and a message. results: contract_id, clause_id, method; checks: contract_id, keyword_checks, total_checks."""
    per = results.groupBy("contract_id").agg(F.array_sort(F.collect_list(F.when(F.col("method") == "keyword_fallback", F.col("clause_id")))).alias("fallback_clauses"), F.count(F.lit(1)).alias("n"))
    out = per.join(checks, "contract_id", "left").na.fill(0, ["keyword_checks", "total_checks"])
    complete = (F.size("fallback_clauses") == 0) & (F.col("keyword_checks") == 0)
    parts = F.concat_ws(
        " and ",
        F.when(F.size("fallback_clauses") > 0, F.concat(F.size("fallback_clauses").cast("string"), F.lit(" of "), F.col("n").cast("string"), F.lit(" clauses"))),
        F.when(F.col("keyword_checks") > 0, F.concat(F.col("keyword_checks").cast("string"), F.lit(" of "), F.col("total_checks").cast("string"), F.lit(" policy checks"))),
    )
    message = F.when(~complete, F.concat(F.lit("No model result for "), parts, F.lit("; keywords were used.")))
    return out.select("contract_id", "fallback_clauses", F.col("keyword_checks").alias("fallback_policy_checks"), complete.alias("complete"), message.alias("message"))


def analysis_state(status: Column, n_results: Column, complete: Column) -> Column:
    return F.when((status != "analyzed") | (F.coalesce(n_results, F.lit(0)) == 0), "not_analyzed").when(F.coalesce(complete, F.lit(True)), "analyzed").otherwise("partial")


def overall_badge(high: Column, total: Column) -> Column:
    return F.when(high > 0, "high").when(total > 0, "medium").otherwise("low")


def summary_input(classified: DataFrame, chars: int = 12_000) -> DataFrame:
    """contract_id, total_clauses, high, medium, low (all others) and preview: the first characters of the clauses in order."""
    level = F.lower(F.col("risk_level"))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("clause_id", "text"))), lambda x: x["text"]), "\n")
    per = classified.groupBy("contract_id").agg(F.count(F.lit(1)).alias("total_clauses"), F.count_if(level == "high").alias("high"), F.count_if(level == "medium").alias("medium"), F.substring(lines, 1, chars).alias("preview"))
    return per.withColumn("low", F.col("total_clauses") - F.col("high") - F.col("medium"))


def summarise(inputs: DataFrame, model: Callable[[pd.DataFrame], pd.DataFrame]) -> DataFrame:
    """Inputs with a user's model's reply (field reply) and its parts; the sentiment is Balanced where it is missing."""
    from ..functions.text import recover_object

    said = with_model(inputs, model, {"reply": "string"})
    found = recover_object(F.col("reply"), ["executive_summary"])
    part = lambda k: F.get_json_object(found, f"$.{k}")
    return said.withColumn("executive_summary", part("executive_summary")).withColumn("overall_sentiment", F.coalesce(part("overall_sentiment"), F.lit("Balanced")))


def recommendation_prompts(classified: DataFrame) -> DataFrame:
    """A prompt for each high-risk clause; others get none."""
    prompt = F.concat(F.lit("Suggest a safer wording.\nReasons: "), F.col("reason"), F.lit("\nClause: "), F.col("text"))
    return classified.where(F.lower("risk_level") == "high").withColumn("prompt", prompt)


def with_context(clauses: DataFrame, similar: DataFrame, most: int = 3) -> DataFrame:
    """Clauses with the texts of their most similar ones (contract_id, clause_id, place, text of a search) as one prompt for classification."""
    per = similar.where(F.col("place") <= most).groupBy("contract_id", "clause_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda x: x["text"]), "\n- ").alias("_c"))
    out = clauses.join(per, ["contract_id", "clause_id"], "left")
    return out.withColumn("prompt", F.concat(F.lit("Similar clauses:\n- "), F.coalesce("_c", F.lit("none")), F.lit("\nClause: "), F.col("text"))).drop("_c")
