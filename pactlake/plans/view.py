"""Contracts and clauses seen in the star schema: an order is a contract, its lines are clauses. Defined once for Spark and once in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Clause texts by l_partkey modulo their number. {q} quantity, {d} discount in percent, {p} price, {t} part type, {s} ship date.
TEMPLATES = (
    "Payment of the invoice price shall be made within net {q} days. Late payment carries a penalty of {d} percent.",
    "Confidential information and every trade secret stay protected for a term of {q} months.",
    "Termination is possible upon {q} days written notice. Renewal follows by automatic renewal for {d} years.",
    "Data protection applies to data processing of {t} records; data deletion follows within {q} days.",
    "Privacy and GDPR duties cover personal information about {t} goods until {s}.",
    "A security breach must be notified no later than {q} hours; encryption of {t} data is required.",
    "Intellectual property and the license of {t} designs remain with the borrower.",
    "Aggregate liability shall not exceed USD {p} and the bank may indemnify the borrower at its sole discretion.",
    "This contract is governed by the laws of Freedonia, and exclusive jurisdiction of Freedonia courts applies.",
    "The vendor keeps {q}% uptime for {t} deliveries under liquidated damages.",
    "Effective date: {s}. The duration of {q} years begins then, and the expiry is final.",
    "Compliance with audit rules on {t} is checked each year.",
)
#: Country groups' currencies.
CURRENCIES = {"AMERICA": "USD", "EUROPE": "EUR", "ASIA": "INR", "AFRICA": "ZAR", "MIDDLE EAST": "AED"}
LINE_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _filled(template: str):
    parts = {"q": F.col("l_quantity").cast("int").cast("string"), "d": F.round(F.col("l_discount") * 100).cast("int").cast("string"), "p": F.col("l_extendedprice").cast("decimal(18,2)").cast("string"), "t": F.lower(F.coalesce("p_type", F.lit("mixed"))), "s": F.date_format("l_shipdate", "MM/dd/yyyy")}
    out, rest = [], template
    while "{" in rest:
        head, _, rest = rest.partition("{")
        out += [F.lit(head), parts[rest[0]]]
        rest = rest[2:]
    return F.concat(*out, F.lit(rest))


def clauses(spark: SparkSession, folder: str) -> DataFrame:
    """contract_id, clause_id (from 1) and text; parts come first, so that the shuffle by contract that numbers the clauses is the last, and what groups by contract needs none."""
    part = table(spark, folder, "part").groupBy("p_partkey").agg(F.collect_list(F.struct("p_type")).alias("_types"))  # one, as a key is
    lines = table(spark, folder, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"), "left")
    number = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*LINE_ORDER)).alias("clause_id")
    kind = F.pmod("l_partkey", F.lit(len(TEMPLATES)))
    text = F.lit(None).cast("string")
    for k, t in enumerate(TEMPLATES):
        text = F.when(kind == k, _filled(t)).otherwise(text)
    numbered = lines.select("*", number).select("*", F.explode_outer("_types").alias("_type")).withColumn("p_type", F.col("_type.p_type"))
    return numbered.select(F.col("l_orderkey").alias("contract_id"), "clause_id", text.alias("text"))


def contracts(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each contract with its facts; unknown facts are null."""
    customer = table(spark, folder, "customer")
    nation, region = table(spark, folder, "nation"), table(spark, folder, "region")
    place = nation.join(region, nation.n_regionkey == region.r_regionkey).select("n_nationkey", "n_name", "r_name")
    who = customer.join(place, customer.c_nationkey == place.n_nationkey).select("c_custkey", "c_name", "n_name", "r_name")
    currency = F.try_element_at(F.create_map(*[F.lit(x) for pair in CURRENCIES.items() for x in pair]), F.col("r_name"))
    ends = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("last"), F.count(F.lit(1)).alias("n_clauses"))
    orders = table(spark, folder, "orders")
    key = F.col("o_orderkey")
    full = orders.join(who, orders.o_custkey == who.c_custkey, "left").join(ends, orders.o_orderkey == ends.l_orderkey, "left")
    return full.select(
        key.alias("contract_id"),
        F.concat(F.lit("Contract_"), key.cast("string"), F.lit(".pdf")).alias("filename"),
        F.col("c_name").alias("customer_name"),
        F.when(key % 7 != 0, F.concat(F.lit("BANK OF "), F.col("n_name"))).alias("lender_name"),
        F.when(key % 13 != 0, currency).alias("currency"),
        F.when(key % 10 != 0, F.col("o_totalprice")).alias("contract_value"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("start_date"),
        F.date_format("last", "yyyy-MM-dd").alias("end_date"),
        F.when(F.coalesce("n_clauses", F.lit(0)) > 0, "analyzed").otherwise("uploaded").alias("status"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("created_at"),
        F.when(key % 3 != 0, F.date_format("last", "yyyy-MM-dd")).alias("updated_at"),
    )


def _sql_filled(template: str) -> str:
    parts = {"q": "l_quantity::INT::VARCHAR", "d": "round(l_discount * 100)::INT::VARCHAR", "p": "l_extendedprice::DECIMAL(18,2)::VARCHAR", "t": "lower(coalesce(p_type, 'mixed'))", "s": "strftime(l_shipdate, '%m/%d/%Y')"}
    out, rest = [], template
    while "{" in rest:
        head, _, rest = rest.partition("{")
        out += [f"'{head}'", parts[rest[0]]]
        rest = rest[2:]
    return " || ".join([*out, f"'{rest}'"])


CLAUSES_SQL = (
    "clauses AS (SELECT l_orderkey AS contract_id, clause_id::INT AS clause_id, CASE l_partkey % " + str(len(TEMPLATES)) + " "
    + " ".join(f"WHEN {k} THEN {_sql_filled(t)}" for k, t in enumerate(TEMPLATES))
    + " END AS text FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY " + ", ".join(LINE_ORDER) + ") AS clause_id FROM lineitem) l LEFT JOIN part ON l_partkey = p_partkey)"
)
CONTRACTS_SQL = (
    "contracts AS (SELECT o_orderkey AS contract_id, 'Contract_' || o_orderkey || '.pdf' AS filename, c_name AS customer_name, "
    "CASE WHEN o_orderkey % 7 <> 0 THEN 'BANK OF ' || n_name END AS lender_name, "
    "CASE WHEN o_orderkey % 13 <> 0 THEN CASE r_name " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in CURRENCIES.items()) + " END END AS currency, "
    "CASE WHEN o_orderkey % 10 <> 0 THEN o_totalprice END AS contract_value, strftime(o_orderdate, '%Y-%m-%d') AS start_date, strftime(last, '%Y-%m-%d') AS end_date, "
    "CASE WHEN coalesce(n_clauses, 0) > 0 THEN 'analyzed' ELSE 'uploaded' END AS status, strftime(o_orderdate, '%Y-%m-%d') AS created_at, "
    "CASE WHEN o_orderkey % 3 <> 0 THEN strftime(last, '%Y-%m-%d') END AS updated_at "
    "FROM orders LEFT JOIN (SELECT c_custkey, c_name, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) ON o_custkey = c_custkey "
    "LEFT JOIN (SELECT l_orderkey, max(l_shipdate) AS last, count(*) AS n_clauses FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey)"
)
