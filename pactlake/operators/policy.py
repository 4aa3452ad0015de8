"""Checks of a policy against clauses, their roll-up for each contract, and the policy library."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpointed

# The built-in policy as (domain, check id, name, check, weight).
DEFAULT_CHECKS = (
    ("Financial", "fin_payment", "Payment Terms", "payment terms 30 days net invoice", 5),
    ("Financial", "fin_late", "Late Fees", "late fee penalty delay payment", 3),
    ("Legal", "legal_liability", "Liability Cap", "liability cap limit exceed", 8),
    ("Legal", "legal_indemnify", "Indemnification", "indemnify indemnification hold harmless", 10),
    ("Legal", "legal_governing", "Governing Law", "governing law jurisdiction", 4),
    ("Operational", "op_term", "Termination Terms", "termination notice period", 6),
    ("Operational", "op_sla", "SLA Requirements", "uptime availability sla service level", 5),
    ("Privacy", "priv_data", "Data Protection", "data protection privacy gdpr personal", 9),
    ("Privacy", "priv_conf", "Confidentiality", "confidential confidentiality nda", 7),
    ("Security", "sec_breach", "Security Breach", "security breach incident notification", 10),
    ("Security", "sec_encrypt", "Encryption", "encryption secure data protection", 6),
    ("Intellectual Property", "ip_ownership", "IP Ownership", "intellectual property ownership rights", 8),
    ("Intellectual Property", "ip_license", "License Terms", "license grant perpetual transferable", 5),
)
DEFAULT_THRESHOLD = 50
WEIGHT = {"high": 5, "medium": 3, "low": 1}


def default_checks(spark: SparkSession) -> DataFrame:
    """check_no (order of the policy), domain, check_id, name, check_text, risk_weight, required. A fixed list of 13 rows."""
    rows = [(k, *c, False) for k, c in enumerate(DEFAULT_CHECKS)]
    return spark.createDataFrame(rows, "check_no int, domain string, check_id string, name string, check_text string, risk_weight int, required boolean")


def check_keywords(check: Column) -> Column:
    """The first eight distinct words of four letters or more, in lower case."""
    return F.slice(F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(check, F.lit("")), F.lit("[A-Za-z]{4,}"), F.lit(0)), F.lower)), 1, 8)


def keywords_match(text: Column, keywords: Column) -> Column:
    """Does a text in lower case hold at least two, and a third, of the keywords (as substrings)?"""
    hits = F.size(F.filter(keywords, lambda k: F.contains(text, k)))
    return (F.size(keywords) > 0) & (hits >= F.greatest(F.lit(2), F.floor(F.size(keywords) / 3)))


def evaluate(clauses: DataFrame, checks: DataFrame, model_results: DataFrame | None = None) -> DataFrame:
    """contract_id, clause_id, check_id, matched, reason, method, call_failed for each clause and check of its domain.

    checks are a policy's: a few hundred rows at most, so Spark broadcasts them by their size. model_results (contract_id, clause_id, check_id, matched, reason) take the place of keywords where given.
    """
    keyed = checks.select("domain", "check_id", check_keywords(F.col("check_text")).alias("_kw"))
    # lower case once for each clause, below the join
    pairs = clauses.select("contract_id", "clause_id", "domain", F.lower(F.coalesce("text", F.lit(""))).alias("_low")).join(keyed, "domain")
    by_keyword = keywords_match(F.col("_low"), F.col("_kw"))
    if model_results is None:
        return pairs.select("contract_id", "clause_id", "check_id", by_keyword.alias("matched"), F.lit("Evaluated by keyword fallback (no LLM available).").alias("reason"), F.lit("keyword").alias("method"), F.lit(True).alias("call_failed"))
    said = model_results.select("contract_id", "clause_id", "check_id", F.col("matched").alias("_m"), F.col("reason").alias("_r"))
    asked = model_results.select("contract_id", "clause_id").distinct().withColumn("_asked", F.lit(True))
    both = pairs.join(said, ["contract_id", "clause_id", "check_id"], "left").join(asked, ["contract_id", "clause_id"], "left")
    got = F.col("_m").isNotNull()
    left_out = F.when(F.col("_asked"), "Evaluated by keyword fallback (LLM omitted this check).").otherwise("Evaluated by keyword fallback (no LLM available).")
    return both.select("contract_id", "clause_id", "check_id", F.coalesce("_m", by_keyword).alias("matched"), F.when(got, F.coalesce("_r", F.lit(""))).otherwise(left_out).alias("reason"), F.when(got, "llm").otherwise("keyword").alias("method"), F.col("_asked").isNull().alias("call_failed"))


def roll_up(contracts: DataFrame, clauses: DataFrame, evaluated: DataFrame, checks: DataFrame, applicability: DataFrame | None = None) -> DataFrame:
    """contract_id, check_id, check_no, name, domain, risk_weight, outcome (satisfied, missing, not_applicable), satisfied_by, reason: a row for each check that bears on a contract.

    A check is satisfied if any clause of its domain matches. A domain without clauses counts only if the policy requires it. A missing check that `applicability` (contract_id, check_id, applicable, reason) rules out is not_applicable.
    """
    # each clause is evaluated against all checks of its domain, so what was evaluated tells which checks are due
    per = evaluated.groupBy("contract_id", "check_id").agg(F.max("matched").alias("ok"), F.array_sort(F.collect_list(F.when(F.col("matched"), F.col("clause_id")))).alias("satisfied_by"), F.min_by(F.when(F.col("reason") != "", F.col("reason")), "clause_id").alias("why"))
    due = per.join(checks, "check_id").withColumn("present", F.lit(True))
    required, out = checks.where("required"), due
    if not required.isEmpty():  # only such a policy has checks that no clause was held against
        present = clauses.select("contract_id", "domain").distinct()
        absent = contracts.select("contract_id").join(F.broadcast(required), F.lit(True)).join(present, ["contract_id", "domain"], "left_anti").withColumn("present", F.lit(False))
        out = due.unionByName(absent, allowMissingColumns=True)
    if applicability is None:
        out = out.withColumn("_applicable", F.lit(True)).withColumn("_why", F.lit(None).cast("string"))
    else:
        out = out.join(applicability.select("contract_id", "check_id", F.col("applicable").alias("_applicable"), F.col("reason").alias("_why")), ["contract_id", "check_id"], "left")
    ok = F.coalesce("ok", F.lit(False))
    excused = F.col("present") & ~F.coalesce("_applicable", F.lit(True))
    outcome = F.when(ok, "satisfied").when(excused, "not_applicable").otherwise("missing")
    empty = F.concat(F.lit("No clause in this contract was classified under the '"), F.col("domain"), F.lit("' domain."))
    reason = F.when(ok, "").when(excused, F.col("_why")).when(F.col("present"), F.col("why")).otherwise(empty)
    return out.select("contract_id", "check_id", "check_no", "name", "domain", "risk_weight", outcome.alias("outcome"), F.coalesce("satisfied_by", F.array().cast("array<int>")).alias("satisfied_by"), reason.alias("reason"))


def summary(rolled: DataFrame, threshold: int) -> DataFrame:
    """contract_id, total_policy_score, is_above_threshold, missing (check ids in the policy's order), not_applicable."""
    ids = lambda outcome: F.transform(F.array_sort(F.collect_list(F.when(F.col("outcome") == outcome, F.struct("check_no", "check_id")))), lambda x: x["check_id"])
    per = rolled.groupBy("contract_id").agg(F.coalesce(F.sum(F.when(F.col("outcome") == "missing", F.col("risk_weight"))), F.lit(0)).alias("total_policy_score"), ids("missing").alias("missing"), ids("not_applicable").alias("not_applicable"))
    return per.withColumn("is_above_threshold", F.lit(threshold > 0) & (F.col("total_policy_score") >= threshold))


def score_of(checks: DataFrame, text: Column, domain: Column) -> Column:
    """As an aggregate over a contract's clauses, the total weight of checks that no clause satisfies by keywords; null if no check is due. One pass without a join, for a policy of a few hundred checks at most, whose rows it reads.

    text is a clause's in lower case.
    """
    keyed = checks.select("domain", "risk_weight", "required", check_keywords(F.col("check_text")).alias("kw")).collect()
    due, total = F.lit(False), F.lit(0)
    for c in keyed:
        hits = sum((F.contains(text, F.lit(w)).cast("int") for w in c.kw), F.lit(0))
        needed = max(2, len(c.kw) // 3)
        ok = F.max(F.when(domain == c.domain, (hits >= needed) if c.kw else F.lit(False)))  # null without a clause of the domain
        due = due | F.lit(bool(c.required)) | ok.isNotNull()
        total = total + F.when(~F.coalesce(ok, F.lit(not c.required)), F.lit(c.risk_weight)).otherwise(0)
    return F.when(due, total)


def clause_matches(clauses: DataFrame, evaluated: DataFrame) -> DataFrame:
    """The checks that each clause satisfies (sorted)."""
    hits = evaluated.where("matched").groupBy("contract_id", "clause_id").agg(F.array_sort(F.collect_list("check_id")).alias("matched_policies"))
    return clauses.select("contract_id", "clause_id", "domain").join(hits, ["contract_id", "clause_id"], "left").withColumn("matched_policies", F.coalesce("matched_policies", F.array().cast("array<string>")))


def fallback_counts(evaluated: DataFrame) -> DataFrame:
    return evaluated.groupBy("contract_id").agg(F.count_if("call_failed").alias("keyword_checks"), F.count(F.lit(1)).alias("total_checks"))


def align_replies(checks: DataFrame, replies: DataFrame) -> DataFrame:
    """A model's results (contract_id, clause_id, results array of (id, matched, reason)) in the order of the checks; checks it left out are null."""
    said = replies.select("contract_id", "clause_id", F.explode_outer("results").alias("r")).select("contract_id", "clause_id", F.col("r.id").alias("check_id"), "r.matched", "r.reason").dropDuplicates(["contract_id", "clause_id", "check_id"])
    asked = replies.select("contract_id", "clause_id").distinct().join(checks.select("check_no", "check_id"), F.lit(True))
    return asked.join(said, ["contract_id", "clause_id", "check_id"], "left")


# ---------------------------------------------------------------- library of labelled policies


def label_roots(labels: DataFrame) -> DataFrame:
    """label_id and root_id of each label (id, parent_id), by pointer doubling: after k rounds each label points 2**k labels up, or to its root. A label that is in a cycle, leads into one or to a parent that is not there has the root null.

    A round joins the labels with themselves once and is checkpointed; the last is the one that brings no further label to its root. A chain has no more labels than there are, so a label that the same number of doublings leaves elsewhere has met itself.
    """
    now = labels.select(F.col("id").alias("label_id"), F.coalesce("parent_id", "id").alias("up"), F.col("parent_id").isNull().alias("done"))
    now = checkpointed(now)
    open_, rounds = now.where("not done").count(), max(1, now.count()).bit_length()
    while open_ and rounds:
        above = now.select(F.col("label_id").alias("up"), F.col("up").alias("_next"), F.col("done").alias("_done"))
        now = checkpointed(now.join(above, "up", "left").select("label_id", F.coalesce("_next", "up").alias("up"), (F.col("done") | F.coalesce("_done", F.lit(False))).alias("done")))
        open_, rounds = now.where("not done").count(), rounds - 1
    return now.select("label_id", F.when(F.col("done"), F.col("up")).alias("root_id"))


def compile_policy(policies: DataFrame, labels: DataFrame, root_domains: DataFrame) -> DataFrame:
    """domain, check_id, name, check_text, risk_weight: each library policy (id, name, description, risk_level, label_ids) under the domains (root_id, domain) of its labels' roots."""
    level = F.lower(F.col("risk_level"))
    weight = F.when(level == "high", WEIGHT["high"]).when(level == "medium", WEIGHT["medium"]).otherwise(WEIGHT["low"])
    tagged = policies.select(F.col("id").alias("check_id"), "name", F.col("description").alias("check_text"), weight.alias("risk_weight"), F.explode("label_ids").alias("label_id"))
    return tagged.join(label_roots(labels), "label_id").join(root_domains, "root_id").select("domain", "check_id", "name", "check_text", "risk_weight").distinct()


def unused_policies(policies: DataFrame, labels: DataFrame, root_domains: DataFrame) -> DataFrame:
    """Policies with no label under a root that has a domain."""
    tagged = policies.select("id", F.explode("label_ids").alias("label_id")).join(label_roots(labels), "label_id").join(root_domains, "root_id")
    return policies.join(tagged.select("id"), "id", "left_anti")


def delete_label(policies: DataFrame, labels: DataFrame, label_id) -> tuple[DataFrame, DataFrame]:
    """Library without a label and its direct children; policies lose them."""
    gone = labels.where((F.col("id") == label_id) | (F.col("parent_id") == label_id)).select(F.col("id").alias("gone"))
    kept = labels.join(gone, labels.id == gone.gone, "left_anti")
    pairs = policies.select("id", F.posexplode("label_ids").alias("pos", "label")).join(kept.select(F.col("id").alias("label")), "label")
    left = pairs.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "label"))), lambda x: x["label"]).alias("_l"))
    changed = policies.join(left, "id", "left").withColumn("label_ids", F.coalesce("_l", F.array().cast(policies.schema["label_ids"].dataType))).drop("_l")
    return changed.select(policies.columns), kept


def update_policies(policies: DataFrame, edits: DataFrame) -> DataFrame:
    """The library with the rows of `edits` (same columns) in place of those with their ids, and with its new ones."""
    return policies.join(edits.select("id"), "id", "left_anti").select(policies.columns).unionByName(edits.select(policies.columns))


def with_names(checks: DataFrame, policies: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """Rows with a check_id, with the library policy's name, risk_level and weight (null if it is not in the library); with labels (id, color), also the color of the policy's first label that has one."""
    level = F.lower("risk_level")
    weight = F.when(level == "high", WEIGHT["high"]).when(level == "medium", WEIGHT["medium"]).when(level.isNotNull(), WEIGHT["low"])
    own = policies.select(F.col("id").alias("check_id"), "name", "risk_level", weight.alias("weight"), "label_ids")
    if labels is not None:
        tagged = own.select("check_id", F.posexplode("label_ids").alias("_k", "_l")).join(labels.select(F.col("id").alias("_l"), "color"), "_l").where(F.col("color").isNotNull())
        own = own.join(tagged.groupBy("check_id").agg(F.min_by("color", "_k").alias("color")), "check_id", "left")
    return checks.join(own.drop("label_ids"), "check_id", "left")


def delete_policy(policies: DataFrame, policy_id) -> DataFrame:
    return policies.where(F.col("id") != policy_id)


def with_label(policies: DataFrame, label_id) -> DataFrame:
    return policies.where(F.array_contains("label_ids", label_id))


def label_tree(labels: DataFrame) -> DataFrame:
    """Top-level labels with the ids of their direct children, sorted."""
    child = labels.where(F.col("parent_id").isNotNull()).groupBy(F.col("parent_id").alias("id")).agg(F.array_sort(F.collect_list("id")).alias("children"))
    top = labels.where(F.col("parent_id").isNull()).select("id")
    return top.join(child, "id", "left").withColumn("children", F.coalesce("children", F.array().cast(child.schema["children"].dataType)))
