"""Structured terms of contracts, risk figures, and comparison of pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Terms with their patterns.
TERMS: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("effective_date", (r"(?:effective\s+date|commences?\s+on|effective\s+from)\s*(?:is|of|on|:)?\s*([A-Za-z]+\s+\d{1,2},?\s+\d{4}|\d{1,2}\s+[A-Za-z]+\s+\d{4}|\d{1,2}[/-]\d{1,2}[/-]\d{2,4})",)),
    ("contract_duration", (r"(?:term|duration|period)\s*(?:of|is|:)?\s*(\d+\s*\([^)]+\)\s*(?:year|month|day)s?|\d+\s*(?:year|month|day)s?)", r"(?:remain(?:s)?\s+in\s+force|continue)\s+for\s+(\d+\s*\([^)]+\)\s*(?:year|month|day)s?|\d+\s*(?:year|month|day)s?)")),
    ("renewal_period", (r"(?:renew(?:ed|al)?|automatic(?:ally)?\s+renew(?:ed|al)?).{0,80}?(\d+\s*\([^)]+\)\s*(?:year|month|day)s?|\d+\s*(?:year|month|day)s?)",)),
    ("payment_period", (r"(?:paid|payable|payment\s+shall\s+be\s+made).{0,80}?(?:within|net)\s+(\d+\s*\([^)]+\)\s*(?:business\s+)?days?|\d+\s*(?:business\s+)?days?)", r"\bnet\s+(\d+)\b")),
    ("termination_notice", (r"(?:terminate|termination).{0,120}?(?:notice\s+of|upon|with)\s+(\d+\s*\([^)]+\)\s*(?:business\s+)?days?(?:\s+written\s+notice)?|\d+\s*(?:business\s+)?days?(?:\s+written\s+notice)?)", r"(\d+\s*(?:business\s+)?days?)\s+(?:prior\s+)?written\s+notice")),
    ("liability_cap", (r"(?:liability|aggregate\s+liability).{0,120}?(?:shall\s+not\s+exceed|limited\s+to|capped\s+at|cap(?:ped)?\s+at)\s+([^.;\n]+)", r"(unlimited\s+liability)")),
    ("governing_law", (r"(?:governed\s+by|governing\s+law)(?:\s+the\s+laws?)?(?:\s+of)?\s*([A-Za-z][A-Za-z\s,&-]{2,60})",)),
    ("jurisdiction", (r"(?:exclusive\s+jurisdiction|jurisdiction)(?:\s+of|\s+in|\s+shall\s+be)?\s*([A-Za-z][A-Za-z\s,&-]{2,60})",)),
    ("sla_uptime", (r"(\d{2,3}(?:\.\d+)?\s*%).{0,40}?(?:uptime|availability)", r"(?:uptime|availability).{0,40}?(\d{2,3}(?:\.\d+)?\s*%)")),
    ("breach_notification", (r"(?:security|data)\s+breach.{0,120}?(?:within|no\s+later\s+than)\s+(\d+\s*(?:hours?|days?))", r"(?:notify|notification).{0,80}?(?:breach|security\s+incident).{0,80}?(\d+\s*(?:hours?|days?))")),
)
RISK_POINTS = (("high", 5), ("medium", 3), ("low", 1))


def term_matches(clauses: DataFrame) -> DataFrame:
    """contract_id, term_key, value, clause_id, pattern_no: the first match of each pattern in each clause. One pass over the clauses."""
    text = F.trim(F.coalesce("text", F.lit("")))
    found = []
    for key, patterns in TERMS:
        for k, p in enumerate(patterns):
            value = F.regexp_replace(F.trim(F.regexp_extract(text, "(?is)" + p, 1)), r"\s+", " ")
            found.append(F.when(text.rlike("(?is)" + p), F.struct(F.lit(key).alias("term_key"), value.alias("value"), F.lit(k).alias("pattern_no"))))
    hits = clauses.select("contract_id", "clause_id", F.explode(F.array_compact(F.array(*found))).alias("m"))
    return hits.select("contract_id", "m.term_key", "m.value", "clause_id", "m.pattern_no")


def terms(clauses: DataFrame) -> DataFrame:
    """contract_id, term_key, value and clause_id (of the first match), n_values (distinct but for case) and has_conflict."""
    per = term_matches(clauses).groupBy("contract_id", "term_key").agg(F.min(F.struct("clause_id", "pattern_no", "value")).alias("first"), F.countDistinct(F.lower("value")).alias("n_values"))
    return per.select("contract_id", "term_key", F.col("first.value").alias("value"), F.col("first.clause_id").alias("clause_id"), "n_values", (F.col("n_values") > 1).alias("has_conflict"))


def risk_stats(counts: DataFrame) -> DataFrame:
    """`counts` (total_clauses, high, medium, low, unclassified) with classified, weighted points, their mean and the share of high risk in percent."""
    points = sum((F.col(c) * w for c, w in RISK_POINTS), F.lit(0))
    classified = F.col("high") + F.col("medium") + F.col("low")
    mean = F.when(classified > 0, F.round(points / classified, 2)).otherwise(F.lit(0.0))
    rate = F.when(classified > 0, F.round(100.0 * F.col("high") / classified, 2)).otherwise(F.lit(0.0))
    return counts.withColumns({"classified": classified, "points": points, "normalized_risk_score": mean, "high_risk_rate": rate})


def pair_verdict(pairs: DataFrame, stats: DataFrame) -> DataFrame:
    """Of each pair (id_1, id_2) which contract is safer: the lower score, then the lower share of high risk; null for a tie or if one has no figures."""
    cols = ("normalized_risk_score", "high_risk_rate", "unclassified")
    out = pairs
    for n in (1, 2):
        out = out.join(stats.select(F.col("contract_id").alias(f"id_{n}"), *[F.col(c).alias(f"{c}_{n}") for c in cols]), f"id_{n}", "left")
    known = F.col("normalized_risk_score_1").isNotNull() & F.col("normalized_risk_score_2").isNotNull()
    score, rate = F.signum(F.col("normalized_risk_score_1") - F.col("normalized_risk_score_2")), F.signum(F.col("high_risk_rate_1") - F.col("high_risk_rate_2"))
    side = F.when(score != 0, score).otherwise(rate)
    safer = F.when(known & (side < 0), F.col("id_1")).when(known & (side > 0), F.col("id_2"))
    why = F.when(~known, "not_analyzed").when(score != 0, "score").when(rate != 0, "high_risk_rate").otherwise("tie")
    return out.select("id_1", "id_2", safer.alias("safer"), why.alias("decided_by"), F.round(F.col("normalized_risk_score_1") - F.col("normalized_risk_score_2"), 2).alias("score_difference"), F.round(F.col("high_risk_rate_1") - F.col("high_risk_rate_2"), 2).alias("rate_difference"))


def term_status(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """Of each pair and term: same, different, only_1, only_2 or missing_both."""
    keys = F.array(*[F.lit(k) for k, _ in TERMS])
    out = pairs.withColumn("term_key", F.explode(keys))
    for n in (1, 2):
        out = out.join(found.select(F.col("contract_id").alias(f"id_{n}"), "term_key", F.col("value").alias(f"value_{n}")), [f"id_{n}", "term_key"], "left")
    a, b = F.col("value_1"), F.col("value_2")
    status = F.when(a.isNull() & b.isNull(), "missing_both").when(b.isNull(), "only_1").when(a.isNull(), "only_2").when(F.lower(a) == F.lower(b), "same").otherwise("different")
    return out.select("id_1", "id_2", "term_key", "value_1", "value_2", status.alias("status"))


def domain_comparison(pairs: DataFrame, per_domain: DataFrame) -> DataFrame:
    """Of each pair and domain of either contract: clauses and high-risk clauses on both sides, 0 where absent. per_domain: contract_id, domain, total_clauses, high."""
    sides = []
    for n in (1, 2):
        own = pairs.join(per_domain.withColumnRenamed("contract_id", f"id_{n}"), f"id_{n}")
        sides.append(own.select("id_1", "id_2", "domain", F.col("total_clauses").alias(f"total_{n}"), F.col("high").alias(f"high_{n}")))
    return sides[0].join(sides[1], ["id_1", "id_2", "domain"], "full").na.fill(0, ["total_1", "high_1", "total_2", "high_2"])
