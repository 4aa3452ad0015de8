"""Registered queries on contracts, clauses, policies and conversations, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import money, text
from ..operators import classify as cl
from ..operators import compare as cmp
from ..operators import conversations as conv
from ..operators import dashboards as dash
from ..operators import ingest as ing
from ..operators import policy as pol
from ..operators import portfolio as pf
from . import view
from .view import CLAUSES_SQL, CONTRACTS_SQL, table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _any(column: str, words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({column}, {_quoted(w)})" for w in words) + ")"


def _list(words: tuple[str, ...]) -> str:
    return "[" + ", ".join(map(_quoted, words)) + "]"


LOW = "lower(text)"
_HIGH_HITS, _MEDIUM_HITS = (f"list_filter({_list(w)}, lambda w: contains({LOW}, w))" for w in (cl.HIGH, cl.MEDIUM))
CLASSIFIED_SQL = (
    CLAUSES_SQL + ", classified AS (SELECT *, CASE " + " ".join(f"WHEN {_any(LOW, w)} THEN {_quoted(n)}" for n, w in cl.DOMAINS) + " ELSE 'Other' END AS domain, "
    f"CASE WHEN len({_HIGH_HITS}) > 0 THEN 'High' WHEN len({_MEDIUM_HITS}) > 0 THEN 'Medium' ELSE 'Low' END AS risk_level, "
    f"CASE WHEN len({_HIGH_HITS}) > 0 THEN {_quoted(cl.HIGH_REASON)} || array_to_string({_HIGH_HITS}, ', ') WHEN len({_MEDIUM_HITS}) > 0 THEN {_quoted(cl.MEDIUM_REASON)} || array_to_string({_MEDIUM_HITS}, ', ') ELSE {_quoted(cl.LOW_REASON)} END AS reason FROM clauses)"
)
COUNTS_SQL = CLASSIFIED_SQL + ", counts AS (SELECT contract_id, count(*) AS total_clauses, count(*) FILTER (risk_level = 'High') AS high, count(*) FILTER (risk_level = 'Medium') AS medium, count(*) FILTER (risk_level = 'Low') AS low, 0::BIGINT AS unclassified FROM classified GROUP BY 1)"
CHECKS_SQL = "checks AS (SELECT * FROM (VALUES " + ", ".join(f"({k}, {', '.join(map(_quoted, c[:4]))}, {c[4]})" for k, c in enumerate(pol.DEFAULT_CHECKS)) + ") t(check_no, domain, check_id, name, check_text, risk_weight))"
EVALUATED_SQL = (
    COUNTS_SQL + ", " + CHECKS_SQL + ", kw AS (SELECT *, list_slice(list_distinct_ordered, 1, 8) AS kws FROM (SELECT *, list_filter(l, lambda x, i: list_position(l, x) = i) AS list_distinct_ordered FROM (SELECT *, list_transform(regexp_extract_all(check_text, '[A-Za-z]{4,}'), lambda x: lower(x)) AS l FROM checks))), "
    "evaluated AS (SELECT contract_id, clause_id, check_id, domain, len(kws) > 0 AND len(list_filter(kws, lambda k: contains(lower(text), k))) >= greatest(2, len(kws) // 3) AS matched FROM classified JOIN kw USING (domain))"
)
ROLLED_SQL = EVALUATED_SQL + ", rolled AS (SELECT contract_id, check_id, check_no, risk_weight, bool_or(matched) AS ok FROM evaluated JOIN checks USING (check_id) GROUP BY ALL)"
SUMMARY_SQL = ROLLED_SQL + ", scores AS (SELECT contract_id, coalesce(sum(risk_weight) FILTER (NOT ok), 0)::BIGINT AS total_policy_score, coalesce(string_agg(check_id, ',' ORDER BY check_no) FILTER (NOT ok), '') AS missing FROM rolled GROUP BY 1)"
DIRECTORY_SQL = (
    CONTRACTS_SQL + ", " + SUMMARY_SQL + ", directory AS (SELECT c.*, high AS high_risk_clauses, medium AS medium_risk_clauses, low AS low_risk_clauses, total_clauses, total_policy_score::DOUBLE AS policy_risk_score "
    "FROM contracts c LEFT JOIN counts USING (contract_id) LEFT JOIN scores USING (contract_id))"
)


def classified(spark: SparkSession, d: str) -> DataFrame:
    return cl.classify(view.clauses(spark, d))


def rolled(spark: SparkSession, d: str) -> DataFrame:
    clauses, checks = classified(spark, d), pol.default_checks(spark)
    return pol.roll_up(view.contracts(spark, d), clauses, pol.evaluate(clauses, checks), checks)


def directory(spark: SparkSession, d: str) -> DataFrame:
    low = classified(spark, d).withColumn("_low", F.lower("text"))
    score = pol.score_of(pol.default_checks(spark), F.col("_low"), F.col("domain"))
    counts = cl.risk_counts(low, "contract_id", total_policy_score=score)  # clauses are read and classified once
    return pf.directory(view.contracts(spark, d), counts, counts)


def light(spark: SparkSession, d: str) -> DataFrame:
    """Contracts with null risk figures, for questions that need none."""
    none = [F.lit(None).cast("long").alias(c) for c in pf.RISK_FIELDS]
    return view.contracts(spark, d).select("*", *none)


# ------------------------------------------------------------- classification and policy


@query("WITH " + CLASSIFIED_SQL + " SELECT contract_id, clause_id, domain, risk_level, reason FROM classified")
def cls_keywords(spark: SparkSession, d: str) -> DataFrame:
    return classified(spark, d).drop("text")


@query("WITH " + CLAUSES_SQL + r""" SELECT contract_id, clause_id, regexp_matches(lower(text), '\b(expires|expiry|expiration)\b') AS expiry,
 regexp_matches(lower(text), '\b\d+\s*(day|days|month|months|year|years)\b') AS duration, regexp_matches(lower(text), '\b(invoice|payment|fee|price|cost)\b') AS financial FROM clauses""")
def cls_signals(spark: SparkSession, d: str) -> DataFrame:
    return view.clauses(spark, d).select("contract_id", "clause_id", cl.signals(F.col("text")).alias("s")).select("contract_id", "clause_id", "s.*")


@query("WITH " + EVALUATED_SQL + " SELECT contract_id, clause_id, check_id, matched FROM evaluated")
def pol_evaluate(spark: SparkSession, d: str) -> DataFrame:
    return pol.evaluate(classified(spark, d), pol.default_checks(spark)).select("contract_id", "clause_id", "check_id", "matched")


@query("WITH " + ROLLED_SQL + " SELECT contract_id, check_id, risk_weight, CASE WHEN ok THEN 'satisfied' ELSE 'missing' END AS outcome, (SELECT count(*) FROM evaluated e WHERE e.matched AND e.contract_id = rolled.contract_id AND e.check_id = rolled.check_id) AS n_by FROM rolled")
def pol_roll_up(spark: SparkSession, d: str) -> DataFrame:
    return rolled(spark, d).select("contract_id", "check_id", "risk_weight", "outcome", F.size("satisfied_by").cast("long").alias("n_by"))


@query("WITH " + SUMMARY_SQL + f" SELECT contract_id, total_policy_score, missing, total_policy_score >= {pol.DEFAULT_THRESHOLD} AS is_above_threshold FROM scores")
def pol_summary(spark: SparkSession, d: str) -> DataFrame:
    out = pol.summary(rolled(spark, d), pol.DEFAULT_THRESHOLD)
    return out.select("contract_id", F.col("total_policy_score").cast("long").alias("total_policy_score"), F.array_join("missing", ",").alias("missing"), "is_above_threshold")


@query("WITH " + EVALUATED_SQL + " SELECT c.contract_id, c.clause_id, coalesce(string_agg(check_id, ',' ORDER BY check_id) FILTER (matched), '') AS matched_policies FROM classified c LEFT JOIN evaluated e ON c.contract_id = e.contract_id AND c.clause_id = e.clause_id GROUP BY 1, 2")
def pol_clause_matches(spark: SparkSession, d: str) -> DataFrame:
    clauses = classified(spark, d)
    out = pol.clause_matches(clauses, pol.evaluate(clauses, pol.default_checks(spark)))
    return out.select("contract_id", "clause_id", F.array_join("matched_policies", ",").alias("matched_policies"))


@query("WITH " + EVALUATED_SQL + ", e AS (SELECT *, clause_id % 2 = 0 AND length(check_id) % 2 = 0 AS told FROM evaluated), f AS (SELECT *, bool_or(told) OVER (PARTITION BY contract_id, clause_id) AS asked FROM e) SELECT contract_id, count(*) FILTER (NOT asked) AS keyword_checks, count(*) AS total_checks, count(*) FILTER (asked AND NOT told) AS left_out FROM f GROUP BY 1")
def pol_fallback_counts(spark: SparkSession, d: str) -> DataFrame:
    """A model answered for every second clause, and left out some of its checks."""
    clauses, checks = classified(spark, d), pol.default_checks(spark)
    told = clauses.where("clause_id % 2 = 0").select("contract_id", "clause_id", "domain").join(checks.where(F.length("check_id") % 2 == 0).select("domain", "check_id"), "domain")
    evaluated = pol.evaluate(clauses, checks, told.select("contract_id", "clause_id", "check_id", F.lit(True).alias("matched"), F.lit("ok").alias("reason")))
    left_out = evaluated.groupBy("contract_id").agg(F.count_if((F.col("method") == "keyword") & ~F.col("call_failed")).alias("left_out"))
    return pol.fallback_counts(evaluated).join(left_out, "contract_id")


def _applicability(spark: SparkSession, d: str) -> DataFrame:
    checks = pol.default_checks(spark).select("check_id", F.length("check_id").alias("n"))
    return view.contracts(spark, d).where("contract_id % 4 = 0").select("contract_id").join(checks, F.col("n") % 2 == 0).select("contract_id", "check_id", F.lit(False).alias("applicable"), F.lit("does not apply").alias("reason"))


@query("WITH " + ROLLED_SQL + " SELECT contract_id, check_id, CASE WHEN ok THEN 'satisfied' WHEN contract_id % 4 = 0 AND length(check_id) % 2 = 0 THEN 'not_applicable' ELSE 'missing' END AS outcome FROM rolled")
def pol_applicability(spark: SparkSession, d: str) -> DataFrame:
    clauses, checks = classified(spark, d), pol.default_checks(spark)
    out = pol.roll_up(view.contracts(spark, d), clauses, pol.evaluate(clauses, checks), checks, _applicability(spark, d))
    return out.select("contract_id", "check_id", "outcome")


@query("WITH " + CLASSIFIED_SQL + """, r AS (SELECT contract_id, clause_id, clause_id % 3 = 0 AS failed FROM classified)
 SELECT contract_id, coalesce(string_agg(clause_id::VARCHAR, ',' ORDER BY clause_id) FILTER (failed), '') AS fallback_clauses, NOT bool_or(failed) AS complete FROM r GROUP BY 1""")
def qua_analysis(spark: SparkSession, d: str) -> DataFrame:
    results = view.clauses(spark, d).select("contract_id", "clause_id", F.when(F.col("clause_id") % 3 == 0, "keyword_fallback").otherwise("llm").alias("method"))
    none = spark.createDataFrame([], "contract_id long, keyword_checks long, total_checks long")
    return cl.analysis_quality(results, none).select("contract_id", F.array_join("fallback_clauses", ",").alias("fallback_clauses"), "complete")


@query("WITH " + CLAUSES_SQL + ", r AS (SELECT *, clause_id % 3 = 0 AS failed FROM clauses), n AS (SELECT contract_id FROM r GROUP BY 1 HAVING count(*) FILTER (failed) * 2 <= count(*)) SELECT contract_id, clause_id FROM r SEMI JOIN n USING (contract_id) WHERE failed")
def cls_retry(spark: SparkSession, d: str) -> DataFrame:
    results = view.clauses(spark, d).select("contract_id", "clause_id", F.when(F.col("clause_id") % 3 == 0, "keyword_fallback").otherwise("llm").alias("method"))
    return cl.to_retry(results).select("contract_id", "clause_id")


@query("WITH " + DIRECTORY_SQL + ", s AS (SELECT contract_id, status, total_clauses, high_risk_clauses FROM directory) SELECT contract_id, CASE WHEN status <> 'analyzed' OR coalesce(total_clauses, 0) = 0 THEN 'not_analyzed' WHEN total_clauses % 2 = 0 THEN 'analyzed' ELSE 'partial' END AS state, CASE WHEN high_risk_clauses > 0 THEN 'high' WHEN total_clauses > 0 THEN 'medium' ELSE 'low' END AS badge FROM s")
def sta_state(spark: SparkSession, d: str) -> DataFrame:
    return directory(spark, d).select("contract_id", cl.analysis_state(F.col("status"), F.col("total_clauses"), F.col("total_clauses") % 2 == 0).alias("state"), cl.overall_badge(F.col("high_risk_clauses"), F.col("total_clauses")).alias("badge"))


# ------------------------------------------------------------- exact questions


def _rank_sql(source: str, value: str, order: str, group: str, where: str = "", limit: int | None = None, offset: int = 0, keys: str | None = None) -> str:
    keys = keys or f"{value} {order}"
    cut = f" WHERE r <= {limit}" if limit else ""
    return (
        f", a AS (SELECT *, {group} AS currency_group FROM {source} WHERE {value} IS NOT NULL{where}), b AS (SELECT *, (row_number() OVER (PARTITION BY currency_group ORDER BY {keys}, contract_id))::INT AS position FROM a), "
        f"c AS (SELECT *, rank() OVER (PARTITION BY currency_group ORDER BY {value} {order}) AS r FROM b WHERE position > {offset}) SELECT contract_id, currency_group, position FROM c{cut}"
    )


GROUP = "upper(coalesce(currency, 'unknown currency'))"
_SHOW = ("contract_id", "currency_group", "position")


@query("WITH " + CONTRACTS_SQL + _rank_sql("contracts", "contract_value", "DESC", GROUP, limit=1))
def qry_highest_per_currency(spark: SparkSession, d: str) -> DataFrame:
    return pf.run(light(spark, d), pf.Spec(sort_by="contract_value", limit=1)).select(*_SHOW)


@query("WITH " + CONTRACTS_SQL + _rank_sql("contracts", "contract_value", "ASC", GROUP, limit=5, offset=1))
def qry_offset_lowest(spark: SparkSession, d: str) -> DataFrame:
    return pf.run(light(spark, d), pf.Spec(sort_by="contract_value", order="asc", limit=5, offset=1)).select(*_SHOW)


@query("WITH " + DIRECTORY_SQL + _rank_sql("directory", "high_risk_clauses", "DESC", "''", limit=3, keys="coalesce(high_risk_clauses, 0) DESC, coalesce(medium_risk_clauses, 0) DESC, coalesce(policy_risk_score, 0) DESC"))
def qry_riskiest(spark: SparkSession, d: str) -> DataFrame:
    return pf.run(directory(spark, d), pf.Spec(sort_by="high_risk_clauses", limit=3)).select(*_SHOW)


@query("WITH " + CONTRACTS_SQL + _rank_sql("contracts", "end_date", "ASC", "''", limit=10))
def qry_ends_first(spark: SparkSession, d: str) -> DataFrame:
    return pf.run(light(spark, d), pf.Spec(sort_by="end_date", order="asc", limit=10)).select(*_SHOW)


@query("WITH " + CONTRACTS_SQL + f" SELECT contract_id, {GROUP} AS currency_group, contract_value, row_number() OVER (PARTITION BY {GROUP} ORDER BY contract_value DESC, contract_id) AS position FROM contracts WHERE contract_value IS NOT NULL")
def qry_ranked(spark: SparkSession, d: str) -> DataFrame:
    """Every contract with its place in its currency: a ranking without a limit."""
    return pf.run(light(spark, d), pf.Spec(sort_by="contract_value")).select("contract_id", "currency_group", "contract_value", "position")


@query("WITH " + CONTRACTS_SQL + " SELECT * FROM (SELECT contract_id, end_date, row_number() OVER (ORDER BY end_date, contract_id) AS position FROM contracts WHERE end_date IS NOT NULL) WHERE position > 5")
def qry_ranked_by_end(spark: SparkSession, d: str) -> DataFrame:
    return pf.run(light(spark, d), pf.Spec(sort_by="end_date", order="asc", offset=5)).select("contract_id", "end_date", "position")


_SUM = "count(*) AS n, sum(contract_value::DECIMAL(18,2))::DECIMAL(38,2) AS total, round(sum(contract_value::DECIMAL(18,2))::DOUBLE / count(*), 2) AS average"


@query("WITH " + CONTRACTS_SQL + f" SELECT {GROUP} AS currency_group, {_SUM} FROM contracts WHERE contract_value IS NOT NULL GROUP BY 1")
def qry_totals(spark: SparkSession, d: str) -> DataFrame:
    return pf.run(light(spark, d), pf.Spec(operation="sum"))


@query("WITH " + CONTRACTS_SQL + f", t AS (SELECT *, row_number() OVER (PARTITION BY {GROUP} ORDER BY contract_value DESC, contract_id) AS k FROM contracts WHERE contract_value IS NOT NULL) SELECT {GROUP} AS currency_group, {_SUM} FROM t WHERE k <= 3 GROUP BY 1")
def qry_totals_of_largest(spark: SparkSession, d: str) -> DataFrame:
    return pf.run(light(spark, d), pf.Spec(operation="average", limit=3))


_FILTERS = (pf.Filter("lender_name", "contains", "Bank of NATION_1"), pf.Filter("contract_value", "greater_than", "$150k"), pf.Filter("end_date", "before", "1997"))
_LENDER = "trim(regexp_replace(regexp_replace(lower(lender_name), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g'))"


@query("WITH " + CONTRACTS_SQL + f" SELECT contract_id, filename, lender_name, contract_value, end_date FROM contracts WHERE contains({_LENDER}, 'bank of nation 1') AND contract_value > 150000 AND end_date < '1997-01-01'")
def qry_filters(spark: SparkSession, d: str) -> DataFrame:
    return pf.run(light(spark, d), pf.Spec(filters=_FILTERS))


@query("WITH " + CONTRACTS_SQL + f""" SELECT contract_id, 'lender_name' AS field FROM contracts WHERE lender_name IS NULL
 UNION ALL SELECT contract_id, 'contract_value' FROM contracts WHERE contains({_LENDER}, 'bank of nation 1') AND contract_value IS NULL
 UNION ALL SELECT contract_id, 'end_date' FROM contracts WHERE contains({_LENDER}, 'bank of nation 1') AND contract_value > 150000 AND end_date IS NULL""")
def qry_unknown(spark: SparkSession, d: str) -> DataFrame:
    return pf.unknown(light(spark, d), _FILTERS)


@query("WITH " + CONTRACTS_SQL + " SELECT contract_id, filename FROM contracts WHERE regexp_matches(lower(filename), '(^|[^a-z0-9])contract.3([^0-9]|$)')")
def qry_filename(spark: SparkSession, d: str) -> DataFrame:
    return pf.run(light(spark, d), pf.Spec(filters=(pf.Filter("filename", "contains", "Contract_3"),)))


@query("WITH " + CONTRACTS_SQL + " SELECT count(*) AS n FROM contracts WHERE end_date > '1995-06-31'")
def qry_count(spark: SparkSession, d: str) -> DataFrame:
    return pf.run(light(spark, d), pf.Spec(operation="count", filters=(pf.Filter("end_date", "after", "1995-06"),)))


@query("WITH " + CONTRACTS_SQL + f", g AS (SELECT {_LENDER} AS key, min_by(lender_name, contract_id) AS display, count(*) AS n, sum(contract_value::DECIMAL(18,2)) FILTER (currency = 'USD')::DECIMAL(38,2) AS usd, array_to_string(list_slice(list(filename ORDER BY contract_id), 1, 6), ',') AS names FROM contracts WHERE lender_name IS NOT NULL GROUP BY 1) SELECT key, display, n, usd, names FROM (SELECT *, rank() OVER (ORDER BY n DESC) AS r FROM g) WHERE r <= 3")
def qry_group_by_lender(spark: SparkSession, d: str) -> DataFrame:
    out = pf.run(light(spark, d), pf.Spec(operation="group", group_by="lender_name", limit=3))
    return out.select("key", "display", "n", F.try_element_at("totals", F.lit("USD")).alias("usd"), F.array_join("names", ",").alias("names"))


@query("WITH " + CONTRACTS_SQL + f" SELECT {GROUP} AS currency_group, count(*) AS n FROM contracts WHERE contract_value IS NOT NULL GROUP BY 1 HAVING count(*) <= 2700")
def qry_too_few(spark: SparkSession, d: str) -> DataFrame:
    return pf.too_few(light(spark, d), pf.Spec(sort_by="contract_value", offset=2700))


@query("WITH " + CONTRACTS_SQL + " SELECT contract_id FROM contracts WHERE contract_id NOT IN (SELECT contract_id FROM contracts WHERE currency = 'USD')")
def qry_others(spark: SparkSession, d: str) -> DataFrame:
    c = light(spark, d)
    return pf.others(c, c.where("currency = 'USD'").select("contract_id")).select("contract_id")


@query("WITH " + CONTRACTS_SQL + " SELECT contract_id, filename, end_date, coalesce(end_date < '1998-01-01', false) AS is_expired FROM contracts")
def fct_directory(spark: SparkSession, d: str) -> DataFrame:
    return pf.listing(light(spark, d), "1998-01-01").select("contract_id", "filename", "end_date", "is_expired")


@query("WITH " + CONTRACTS_SQL + " SELECT contract_id, filename FROM contracts WHERE NOT coalesce(end_date < '1998-01-01', false)")
def fct_not_expired(spark: SparkSession, d: str) -> DataFrame:
    return pf.listing(light(spark, d), "1998-01-01", include_expired=False).select("contract_id", "filename")


@query("WITH " + DIRECTORY_SQL + """ SELECT contract_id, concat_ws(' | ', filename, 'borrower: ' || customer_name, 'lender: ' || lender_name, 'amount: ' || CASE WHEN contract_value IS NULL THEN 'not found' WHEN currency = 'USD' THEN '$' || format('{:,.2f}', contract_value) WHEN currency = 'INR' THEN '₹' || format('{:,.2f}', contract_value) WHEN currency = 'EUR' THEN '€' || format('{:,.2f}', contract_value) ELSE trim(format('{:,.2f}', contract_value) || ' ' || coalesce(currency, '')) END, 'ends: ' || end_date,
 CASE WHEN total_clauses IS NULL THEN 'not analyzed yet' ELSE 'risk: ' || high_risk_clauses || ' high, ' || medium_risk_clauses || ' medium, ' || low_risk_clauses || ' low' END) AS line FROM directory""")
def fct_directory_line(spark: SparkSession, d: str) -> DataFrame:
    return directory(spark, d).select("contract_id", pf.directory_line().alias("line"))


@query("WITH " + CONTRACTS_SQL + " SELECT contract_id FROM contracts WHERE contract_id % 3 = 0")
def qry_scope(spark: SparkSession, d: str) -> DataFrame:
    c = light(spark, d)
    return pf.scope(c, pf.Spec(), named=c.where("contract_id % 3 = 0").select("contract_id")).select("contract_id")


@query("WITH " + CONTRACTS_SQL + _rank_sql("contracts", "contract_value", "DESC", GROUP, limit=2).replace("SELECT contract_id, currency_group, position FROM c", "SELECT contract_id, position AS source_no, CASE WHEN contract_id % 2 = 0 THEN 'Header ' || contract_id ELSE 'Amount: ' || CASE WHEN currency = 'USD' THEN '$' || format('{:,.2f}', contract_value) WHEN currency = 'INR' THEN '₹' || format('{:,.2f}', contract_value) WHEN currency = 'EUR' THEN '€' || format('{:,.2f}', contract_value) ELSE trim(format('{:,.2f}', contract_value) || ' ' || coalesce(currency, '')) END END AS text FROM c"))
def qry_sources(spark: SparkSession, d: str) -> DataFrame:
    c = light(spark, d).withColumn("header_text", F.when(F.col("contract_id") % 2 == 0, F.concat(F.lit("Header "), F.col("contract_id").cast("string"))))
    return pf.sources(pf.ranked(c, pf.Spec(sort_by="contract_value", limit=2))).select("contract_id", "source_no", "text")


@query("WITH " + CHECKS_SQL + ", r AS (SELECT DISTINCT l_orderkey AS contract_id FROM lineitem) SELECT contract_id, check_id, CASE WHEN check_no % 2 = 0 THEN contract_id % 2 = 0 END AS matched FROM r, checks")
def pol_align(spark: SparkSession, d: str) -> DataFrame:
    """Replies that leave out every second check."""
    checks = pol.default_checks(spark)
    ids = [c[1] for c in pol.DEFAULT_CHECKS][::2]
    contracts = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("contract_id")).distinct()
    said = F.array(*[F.struct(F.lit(i).alias("id"), (F.col("contract_id") % 2 == 0).alias("matched"), F.lit("").alias("reason")) for i in ids])
    return pol.align_replies(checks, contracts.select("contract_id", F.lit(1).alias("clause_id"), said.alias("results"))).select("contract_id", "check_id", "matched")


@query("WITH " + CLASSIFIED_SQL + " SELECT contract_id, clause_id, CASE WHEN clause_id % 2 = 0 THEN 'HR' ELSE domain END AS domain, CASE WHEN clause_id % 2 = 0 THEN 'Low' ELSE risk_level END AS risk_level, CASE WHEN clause_id % 2 = 0 THEN 'llm' ELSE 'keyword_fallback' END AS method FROM classified")
def cls_with_model(spark: SparkSession, d: str) -> DataFrame:
    """A model that answers for every second clause."""

    def model(pdf):
        even = pdf["clause_id"] % 2 == 0
        return pdf.assign(m_domain=["HR" if e else None for e in even], m_risk_level=["Low" if e else None for e in even], m_reason=["said so" if e else None for e in even])

    return cl.classify_with(view.clauses(spark, d), model).select("contract_id", "clause_id", "domain", "risk_level", "method")


@query("WITH " + DIRECTORY_SQL + ", t AS (SELECT count(*) AS contracts, count(*) FILTER (status = 'analyzed') AS analyzed, count(*) FILTER (status <> 'analyzed') AS not_analyzed, sum(total_clauses)::BIGINT AS clauses, sum(high_risk_clauses)::BIGINT AS high, sum(medium_risk_clauses)::BIGINT AS medium, sum(low_risk_clauses)::BIGINT AS low FROM directory WHERE contains(filename, '_1')), p AS (SELECT *, floor(100.0 * high / clauses + 0.5)::BIGINT AS high_percent FROM t) SELECT *, CASE WHEN high_percent > 20 THEN 'red' WHEN high_percent > 10 THEN 'yellow' ELSE 'green' END AS band FROM p")
def dsh_filtered_totals(spark: SparkSession, d: str) -> DataFrame:
    return dash.totals(dash.filtered(directory(spark, d), classified(spark, d), name="_1"))


@query("WITH " + CONTRACTS_SQL + r" SELECT contract_id, contains(' ' || trim(regexp_replace(regexp_replace(lower(filename), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g')) || ' ', ' contract 3 ') AS third, '12 Hill Road ' || contract_id AS address FROM contracts")
def fn_party_texts(spark: SparkSession, d: str) -> DataFrame:
    header = F.concat(F.lit("LOAN AGREEMENT\nBORROWER: "), "customer_name", F.lit(", residing at 12 Hill Road "), F.col("contract_id").cast("string"), F.lit("\nLENDER: X"))
    third = text.contains_name(text.norm_name(F.col("filename")), F.lit("contract 3"))
    return view.contracts(spark, d).select("contract_id", third.alias("third"), text.party_address(header, "BORROWER|CUSTOMER").alias("address"))


# ------------------------------------------------------------- comparison


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return view.contracts(spark, d).select(F.col("contract_id").alias("id_1"), (F.col("contract_id") + 1).alias("id_2"))


_PAIRS_SQL = "pairs AS (SELECT o_orderkey AS id_1, o_orderkey + 1 AS id_2 FROM orders)"
_STATS_SQL = COUNTS_SQL + ", stats AS (SELECT *, round((high * 5 + medium * 3 + low) / (high + medium + low), 2) AS normalized_risk_score, round(100.0::DOUBLE * high / (high + medium + low), 2) AS high_risk_rate FROM counts)"


@query("WITH " + _STATS_SQL + " SELECT contract_id, total_clauses, high, medium, low, unclassified, high * 5 + medium * 3 + low AS points, normalized_risk_score, high_risk_rate FROM stats")
def cmp_risk_stats(spark: SparkSession, d: str) -> DataFrame:
    return cmp.risk_stats(cl.risk_counts(classified(spark, d), "contract_id")).drop("classified")


@query("WITH " + CLASSIFIED_SQL + " SELECT contract_id, domain, count(*) AS total_clauses, count(*) FILTER (risk_level = 'High') AS high FROM classified GROUP BY 1, 2")
def cmp_domain_stats(spark: SparkSession, d: str) -> DataFrame:
    return cl.risk_counts(classified(spark, d), "contract_id", "domain").select("contract_id", "domain", "total_clauses", "high")


@query("WITH " + _STATS_SQL + ", " + _PAIRS_SQL + """ SELECT id_1, id_2, CASE WHEN a.contract_id IS NULL OR b.contract_id IS NULL THEN NULL WHEN a.normalized_risk_score < b.normalized_risk_score THEN id_1 WHEN a.normalized_risk_score > b.normalized_risk_score THEN id_2 WHEN a.high_risk_rate < b.high_risk_rate THEN id_1 WHEN a.high_risk_rate > b.high_risk_rate THEN id_2 END AS safer,
 CASE WHEN a.contract_id IS NULL OR b.contract_id IS NULL THEN 'not_analyzed' WHEN a.normalized_risk_score <> b.normalized_risk_score THEN 'score' WHEN a.high_risk_rate <> b.high_risk_rate THEN 'high_risk_rate' ELSE 'tie' END AS decided_by FROM pairs LEFT JOIN stats a ON a.contract_id = id_1 LEFT JOIN stats b ON b.contract_id = id_2""")
def cmp_verdict(spark: SparkSession, d: str) -> DataFrame:
    return cmp.pair_verdict(_pairs(spark, d), cmp.risk_stats(cl.risk_counts(classified(spark, d), "contract_id"))).select("id_1", "id_2", "safer", "decided_by")


_TERM_HITS = " UNION ALL ".join(f"SELECT contract_id, clause_id, {_quoted(k)} AS term_key, {n} AS pattern_no, regexp_replace(trim(regexp_extract(text, {_quoted('(?is)' + p)}, 1)), '\\s+', ' ', 'g') AS value FROM clauses WHERE regexp_matches(text, {_quoted('(?is)' + p)})" for k, ps in cmp.TERMS for n, p in enumerate(ps))
_TERMS_SQL = CLAUSES_SQL + f", hits AS ({_TERM_HITS}), terms AS (SELECT contract_id, term_key, min({{'c': clause_id, 'p': pattern_no, 'v': value}}).v AS value, min(clause_id) AS clause_id, count(DISTINCT lower(value)) AS n_values, count(DISTINCT lower(value)) > 1 AS has_conflict FROM hits GROUP BY 1, 2)"


@query("WITH " + _TERMS_SQL + " SELECT * FROM terms")
def cmp_terms(spark: SparkSession, d: str) -> DataFrame:
    return cmp.terms(view.clauses(spark, d))


@query("WITH " + _TERMS_SQL + ", " + _PAIRS_SQL + f", keys AS (SELECT unnest({_list(tuple(k for k, _ in cmp.TERMS))}) AS term_key) SELECT id_1, id_2, keys.term_key, CASE WHEN a.value IS NULL AND b.value IS NULL THEN 'missing_both' WHEN b.value IS NULL THEN 'only_1' WHEN a.value IS NULL THEN 'only_2' WHEN lower(a.value) = lower(b.value) THEN 'same' ELSE 'different' END AS status FROM pairs CROSS JOIN keys LEFT JOIN terms a ON a.contract_id = id_1 AND a.term_key = keys.term_key LEFT JOIN terms b ON b.contract_id = id_2 AND b.term_key = keys.term_key")
def cmp_term_status(spark: SparkSession, d: str) -> DataFrame:
    return cmp.term_status(_pairs(spark, d), cmp.terms(view.clauses(spark, d))).select("id_1", "id_2", "term_key", "status")


@query("WITH " + CLASSIFIED_SQL + ", " + _PAIRS_SQL + ", s AS MATERIALIZED (SELECT contract_id, domain, count(*) AS t, count(*) FILTER (risk_level = 'High') AS h FROM classified GROUP BY 1, 2), x AS MATERIALIZED (SELECT id_1, id_2, domain, t, h FROM pairs JOIN s ON contract_id = id_1), y AS MATERIALIZED (SELECT id_1, id_2, domain, t, h FROM pairs JOIN s ON contract_id = id_2) SELECT id_1, id_2, domain, coalesce(x.t, 0) AS total_1, coalesce(x.h, 0) AS high_1, coalesce(y.t, 0) AS total_2, coalesce(y.h, 0) AS high_2 FROM x FULL JOIN y USING (id_1, id_2, domain)")
def cmp_domains(spark: SparkSession, d: str) -> DataFrame:
    return cmp.domain_comparison(_pairs(spark, d), cl.risk_counts(classified(spark, d), "contract_id", "domain").select("contract_id", "domain", "total_clauses", "high"))


# ------------------------------------------------------------- dashboards


@query("WITH " + DIRECTORY_SQL + ", t AS (SELECT count(*) AS contracts, count(*) FILTER (status = 'analyzed') AS analyzed, count(*) FILTER (status <> 'analyzed') AS not_analyzed, sum(total_clauses)::BIGINT AS clauses, sum(high_risk_clauses)::BIGINT AS high, sum(medium_risk_clauses)::BIGINT AS medium, sum(low_risk_clauses)::BIGINT AS low FROM directory), p AS (SELECT *, floor(100.0 * high / clauses + 0.5)::BIGINT AS high_percent FROM t) SELECT *, CASE WHEN high_percent > 20 THEN 'red' WHEN high_percent > 10 THEN 'yellow' ELSE 'green' END AS band FROM p")
def dsh_totals(spark: SparkSession, d: str) -> DataFrame:
    return dash.totals(directory(spark, d))


@query("WITH " + CLASSIFIED_SQL + " SELECT domain, count(*) AS clauses FROM classified GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 6")
def dsh_top_domains(spark: SparkSession, d: str) -> DataFrame:
    return dash.top_domains(classified(spark, d))


@query("WITH " + DIRECTORY_SQL + " SELECT contract_id, filename, coalesce(updated_at, created_at, '') AS \"at\", high_risk_clauses FROM directory ORDER BY 3 DESC, contract_id LIMIT 5")
def dsh_recent(spark: SparkSession, d: str) -> DataFrame:
    return dash.recent(directory(spark, d))


@query("WITH " + CLASSIFIED_SQL + " SELECT lower(risk_level) AS level, count(*) AS n FROM classified GROUP BY 1")
def dsh_risk_distribution(spark: SparkSession, d: str) -> DataFrame:
    return dash.risk_distribution(classified(spark, d))


@query("WITH " + DIRECTORY_SQL + " SELECT created_at AS day, count(*) AS contracts, coalesce(sum(high_risk_clauses), 0)::BIGINT AS high, coalesce(sum(total_clauses), 0)::BIGINT AS clauses FROM directory GROUP BY 1")
def dsh_daily_trend(spark: SparkSession, d: str) -> DataFrame:
    return dash.daily_trend(directory(spark, d))


@query("WITH " + CONTRACTS_SQL + ", " + CLASSIFIED_SQL + " SELECT contract_id, filename FROM contracts c WHERE contains(lower(filename), '_1') AND EXISTS (SELECT 1 FROM classified x WHERE x.contract_id = c.contract_id AND risk_level = 'High') AND EXISTS (SELECT 1 FROM classified x WHERE x.contract_id = c.contract_id AND domain = 'Vendor') AND date_diff('day', created_at::DATE, DATE '1996-01-01') BETWEEN 0 AND 90")
def dsh_filters(spark: SparkSession, d: str) -> DataFrame:
    out = dash.filtered(light(spark, d), classified(spark, d), name="_1", risk="high", domain="Vendor", days=90, now="1996-01-01")
    return out.select("contract_id", "filename")


@query("WITH " + CLASSIFIED_SQL + " SELECT DISTINCT domain FROM classified")
def dsh_domains(spark: SparkSession, d: str) -> DataFrame:
    return dash.domains(classified(spark, d))


@query("WITH " + COUNTS_SQL + ' SELECT contract_id, high AS "High", medium AS "Medium", low AS "Low" FROM counts')
def dsh_counts_by_level(spark: SparkSession, d: str) -> DataFrame:
    return dash.counts_by_level(classified(spark, d))


@query("WITH " + CLASSIFIED_SQL + r""", f AS (SELECT *, list_slice(regexp_extract_all(text, '[A-Za-z0-9]+'), 1, 3) AS w FROM classified) SELECT contract_id, clause_id, array_to_string(list_transform(w, lambda x: upper(x[1]) || lower(x[2:])), ' ') AS title, domain, risk_level, replace(reason, ',', ';') AS reasons, replace(text, ',', ';') AS text FROM f""")
def snk_export_rows(spark: SparkSession, d: str) -> DataFrame:
    return dash.export_rows(classified(spark, d))


# ------------------------------------------------------------- conversations


@query("SELECT conv_id, turn, role, substr(text, 1, 20000) AS text FROM conversations WHERE role IN ('user', 'assistant') AND trim(coalesce(text, '')) <> ''")
def cnv_clean(spark: SparkSession, d: str) -> DataFrame:
    return conv.clean(table(spark, d, "conversations"))


@query("SELECT conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 2")
def cnv_newest_messages(spark: SparkSession, d: str) -> DataFrame:
    return conv.newest(table(spark, d, "conversations"), 2).select("conv_id", "turn")


@query("WITH l AS (SELECT conv_id, max(turn) AS t FROM conversations GROUP BY 1 ORDER BY 2 DESC, 1 DESC LIMIT 20) SELECT conv_id, turn FROM conversations SEMI JOIN l USING (conv_id)")
def cnv_newest_conversations(spark: SparkSession, d: str) -> DataFrame:
    return conv.newest_conversations(table(spark, d, "conversations"), 20).select("conv_id", "turn")


_SQ = r"trim(regexp_replace(q, '\s+', ' ', 'g'))"


@query(f"WITH p AS (SELECT conv_id, min({{'t': turn, 'x': text}}) FILTER (role = 'user' AND trim(text) <> '').x AS q, count(*) AS n_messages, max(turn) AS last_turn FROM conversations GROUP BY 1) SELECT conv_id, coalesce(CASE WHEN length({_SQ}) > 80 THEN rtrim(substr({_SQ}, 1, 79)) || '…' ELSE {_SQ} END, 'New conversation') AS title, n_messages, last_turn FROM p")
def cnv_listing(spark: SparkSession, d: str) -> DataFrame:
    return conv.listing(table(spark, d, "conversations"))


@query("SELECT conv_id, turn, coalesce(array_to_string(list_slice(h, greatest(len(h) - 5, 1), len(h)), chr(10)), '') AS history FROM (SELECT conv_id, turn, list_filter(list(CASE WHEN trim(text) <> '' THEN role || ': ' || substr(text, 1, 1500) END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING), lambda x: x IS NOT NULL) AS h FROM conversations)")
def cnv_history(spark: SparkSession, d: str) -> DataFrame:
    return conv.history(table(spark, d, "conversations")).select("conv_id", "turn", "history")


@query("SELECT conv_id, turn, CASE WHEN length(text) < 80 AND l IS NOT NULL THEN l || ' ' || text ELSE text END AS search_text FROM (SELECT *, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS l FROM conversations) WHERE role = 'user'")
def rte_follow_up_text(spark: SparkSession, d: str) -> DataFrame:
    return conv.follow_up_text(table(spark, d, "conversations")).select("conv_id", "turn", "search_text")


@query("SELECT conv_id, turn, last_value(CASE WHEN role = 'assistant' THEN length(text) END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous_spec FROM conversations")
def cnv_previous_spec(spark: SparkSession, d: str) -> DataFrame:
    return conv.previous_spec(table(spark, d, "conversations").withColumn("spec", F.length("text").cast("long"))).select("conv_id", "turn", "previous_spec")


@query("SELECT conv_id AS answer_id, trim(string_agg(text, '' ORDER BY turn)) AS text FROM conversations GROUP BY 1")
def cnv_reassemble(spark: SparkSession, d: str) -> DataFrame:
    return conv.reassemble(table(spark, d, "conversations").select(F.col("conv_id").alias("answer_id"), F.col("turn").alias("seq"), "text"))


@query(r"SELECT conv_id, regexp_matches('conv-' || lpad(conv_id::VARCHAR, 8, '0') || CASE WHEN conv_id % 5 = 0 THEN ' ' ELSE '' END, '^[A-Za-z0-9_-]{8,64}$') AS ok FROM (SELECT DISTINCT conv_id FROM conversations)")
def cnv_valid_id(spark: SparkSession, d: str) -> DataFrame:
    name = F.concat(F.lit("conv-"), F.lpad(F.col("conv_id").cast("string"), 8, "0"), F.when(F.col("conv_id") % 5 == 0, " ").otherwise(""))
    return table(spark, d, "conversations").select("conv_id").distinct().select("conv_id", conv.valid_id(name).alias("ok"))


# ------------------------------------------------------------- functions on amounts and texts


@query("WITH " + CONTRACTS_SQL + " SELECT contract_id, contract_value AS us, contract_value AS european, floor(contract_value / 1000) * 1000 AS thousands FROM contracts")
def fn_parse_money(spark: SparkSession, d: str) -> DataFrame:
    us = F.format_number("contract_value", 2)
    european = F.translate(us, ",.", ".,")
    return view.contracts(spark, d).select(
        "contract_id", money.parse_money(F.concat(F.lit("USD "), us)).alias("us"), money.parse_money(F.concat(F.lit("EUR "), european, F.lit(" due"))).alias("european"),
        money.parse_money(F.concat(F.lit("$"), F.floor(F.col("contract_value") / 1000).cast("string"), F.lit("k on 2024-01-15"))).alias("thousands"),
    )


@query("WITH " + CONTRACTS_SQL + " SELECT contract_id, contract_value::DECIMAL(18,2)::DOUBLE AS value, CASE WHEN contract_value IS NOT NULL THEN coalesce(currency, 'USD') END AS currency, CASE WHEN contract_value IS NULL THEN 0 ELSE 1 END AS n FROM contracts")
def fn_money_amounts(spark: SparkSession, d: str) -> DataFrame:
    told = F.concat(F.lit("The bank lends "), F.coalesce("currency", F.lit("$")), F.lit(" "), F.format_number("contract_value", 2), F.lit(" for 12 months"))
    found = view.contracts(spark, d).select("contract_id", money.money_amounts(F.coalesce(told, F.lit("The bank lends nothing for 12 months"))).alias("m"))
    return found.select("contract_id", F.get("m", F.lit(0))["value"].alias("value"), F.get("m", F.lit(0))["currency"].alias("currency"), F.size("m").alias("n"))


@query("WITH " + CLAUSES_SQL + r""" SELECT contract_id, clause_id, array_to_string(list_slice(list_concat(list_concat(regexp_extract_all(text, '\b(?:\d{1,2}[\-/]\d{1,2}[\-/]\d{2,4})\b'), regexp_extract_all(text, '\b(?:\d{4}[\-/]\d{1,2}[\-/]\d{1,2})\b')), regexp_extract_all(text, '(?i)\b(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Sept|Oct|Nov|Dec)[a-z]*\s+\d{1,2},\s+\d{4}\b')), 1, 5), ',') AS dates_found,
 array_to_string(list_slice(list_filter(""" + _list(text.RISKY) + r""", lambda w: contains(lower(text), w)), 1, 10), ',') AS risky_terms, regexp_matches(text, '(?i)expiry|expiration|term ends|valid until|renewal') AS expiry_related, length(text)::INT AS length FROM clauses""")
def fn_clause_metadata(spark: SparkSession, d: str) -> DataFrame:
    out = view.clauses(spark, d).select("contract_id", "clause_id", text.clause_metadata(F.col("text")).alias("m"))
    return out.select("contract_id", "clause_id", F.array_join("m.dates_found", ",").alias("dates_found"), F.array_join("m.risky_terms", ",").alias("risky_terms"), "m.expiry_related", "m.length")


@query("WITH " + CONTRACTS_SQL + r" SELECT contract_id, trim(regexp_replace(regexp_replace(lower(customer_name), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g')) AS norm, regexp_replace(filename, '\.[a-z0-9]{2,4}$', '') AS stem, filename AS base FROM contracts")
def fn_names(spark: SparkSession, d: str) -> DataFrame:
    path = F.concat(F.lit("/in/some folder/"), F.col("filename"))
    return view.contracts(spark, d).select("contract_id", text.norm_name(F.col("customer_name")).alias("norm"), text.stem(F.col("filename")).alias("stem"), text.base_name(path).alias("base"))


@query("SELECT doc_id, CASE WHEN n / 1048576 >= 0.01 THEN format('{:,.2f}', floor(n / 1048576 * 100 + 0.5) / 100) || ' MB' WHEN n / 1024 >= 1 THEN floor(n / 1024 + 0.5)::BIGINT || ' KB' ELSE n || ' B' END AS size FROM (SELECT doc_id, n_chars AS n FROM documents)")
def fn_human_size(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.human_size(F.col("n_chars")).alias("size"))


@query("SELECT doc_id, trim(text) AS text FROM documents")
def fn_strip_reasoning(spark: SparkSession, d: str) -> DataFrame:
    wrapped = F.concat(F.lit("<think>let me see\n</think>```json\n"), F.trim("text"), F.lit("\n```"))
    return table(spark, d, "documents").select("doc_id", F.trim(text.strip_reasoning(wrapped)).alias("text"))


def _titles_sql() -> str:
    rules = []
    for words, inner, title in text.TITLES:
        own = "".join(f"WHEN {_any(LOW, w)} THEN {_quoted(t)} " for w, t in inner)
        rules.append(f"WHEN {_any(LOW, words)} THEN " + (f"CASE {own}ELSE {_quoted(title)} END" if inner else _quoted(title)))
    rules += [f"WHEN contains(lower(domain), {_quoted(w)}) THEN {_quoted(t)} || clause_id" for w, t in text.DOMAIN_TITLES]
    return "CASE " + " ".join(rules) + " END"


@query("WITH " + CLASSIFIED_SQL + f" SELECT contract_id, clause_id, {_titles_sql()} AS title FROM classified")
def fn_proper_title(spark: SparkSession, d: str) -> DataFrame:
    return classified(spark, d).select("contract_id", "clause_id", text.proper_title(F.col("text"), F.col("domain"), F.col("clause_id")).alias("title"))


@query("SELECT c_custkey, reverse(c_name) AS backwards, contains(c_name, '.') AS email FROM customer WHERE c_acctbal >= 18")
def fn_exercises(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").where("c_acctbal >= 18").select("c_custkey", text.reversed_text(F.col("c_name")).alias("backwards"), text.plausible_email(F.col("c_name")).alias("email"))


@query("SELECT user_id, count(*) AS n FROM events GROUP BY 1")
def fn_count_by_user(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


@query("WITH " + COUNTS_SQL + ", t AS (SELECT contract_id, substr(string_agg(text, chr(10) ORDER BY clause_id), 1, 12000) AS preview FROM clauses GROUP BY 1) SELECT contract_id, total_clauses, high, medium, total_clauses - high - medium AS low, length(preview)::INT AS n_chars, md5(preview) AS preview FROM counts JOIN t USING (contract_id)")
def sum_input(spark: SparkSession, d: str) -> DataFrame:
    out = cl.summary_input(classified(spark, d))
    return out.select("contract_id", "total_clauses", "high", "medium", "low", F.length("preview").alias("n_chars"), F.md5(F.col("preview").cast("binary")).alias("preview"))


@query("WITH " + CLASSIFIED_SQL + " SELECT contract_id, clause_id FROM classified WHERE risk_level = 'High'")
def sum_recommendations(spark: SparkSession, d: str) -> DataFrame:
    return cl.recommendation_prompts(classified(spark, d)).select("contract_id", "clause_id")


@query("WITH " + CONTRACTS_SQL + " SELECT contract_id, filename, status FROM contracts WHERE contract_id % 50 = 0")
def qry_point_listing(spark: SparkSession, d: str) -> DataFrame:
    c = view.contracts(spark, d)
    return ing.lookup(c, c.where("contract_id % 50 = 0").select("contract_id")).select("contract_id", "filename", "status")


@query("WITH " + CLASSIFIED_SQL + ", d AS (SELECT contract_id, list(DISTINCT domain) AS ds FROM classified GROUP BY 1) SELECT o_orderkey AS contract_id, check_id FROM orders LEFT JOIN d ON contract_id = o_orderkey CROSS JOIN (SELECT 'fin_payment' AS check_id, 'Financial' AS domain UNION ALL SELECT 'fin_late', 'Financial') c WHERE NOT coalesce(list_contains(ds, c.domain), false)")
def pol_required_missing(spark: SparkSession, d: str) -> DataFrame:
    clauses, checks = classified(spark, d), pol.default_checks(spark).where("domain = 'Financial'").withColumn("required", F.lit(True))
    out = pol.roll_up(view.contracts(spark, d), clauses, pol.evaluate(clauses, checks), checks)
    return out.where("outcome = 'missing' and reason like 'No clause%'").select("contract_id", "check_id")
