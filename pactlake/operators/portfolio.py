"""Exact questions on a portfolio: filters with unknowns, rankings with ties, offsets, totals for each currency, groups.

A Spec says what is asked; run() compiles it into one DataFrame chain over the contract directory. Unknown values are
null and never count as zero: rows that a filter cannot decide are reported apart by unknown().
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.money import parse_money
from ..functions.text import norm_name
from ..session import checkpointed

RISK_FIELDS = ("high_risk_clauses", "medium_risk_clauses", "low_risk_clauses", "total_clauses", "policy_risk_score")
#: Fields that break ties of a ranking by risk.
TIES = {
    "high_risk_clauses": ("high_risk_clauses", "medium_risk_clauses", "policy_risk_score"),
    "medium_risk_clauses": ("medium_risk_clauses", "high_risk_clauses"),
    "low_risk_clauses": ("low_risk_clauses",),
    "total_clauses": ("total_clauses",),
    "policy_risk_score": ("policy_risk_score", "high_risk_clauses"),
}
DATE_FIELDS = ("start_date", "end_date")


@dataclass(frozen=True)
class Filter:
    field: str
    op: str  # contains, equals, greater_than, less_than, before, after, is_true, is_false
    value: str | None = None


@dataclass(frozen=True)
class Spec:
    operation: str = "list"  # list, count, sum, average, group
    sort_by: str | None = None
    order: str = "desc"
    limit: int | None = None
    offset: int = 0
    group_by: str | None = None
    filters: tuple[Filter, ...] = field(default=())
    fields: tuple[str, ...] = field(default=())


def directory(contracts: DataFrame, counts: DataFrame, scores: DataFrame | None = None) -> DataFrame:
    """Contracts with their risk figures: null, not zero, for contracts that are not analysed. counts: contract_id, total_clauses, high, medium, low; scores: contract_id, total_policy_score."""
    named = counts.select("contract_id", *[F.col(c).alias(n) for c, n in (("high", "high_risk_clauses"), ("medium", "medium_risk_clauses"), ("low", "low_risk_clauses"), ("total_clauses", "total_clauses"))])
    together = scores is counts  # one table holds both: joined once
    if together:
        named = counts.select(*[F.col(c).alias(n) for c, n in (("contract_id", "contract_id"), ("high", "high_risk_clauses"), ("medium", "medium_risk_clauses"), ("low", "low_risk_clauses"), ("total_clauses", "total_clauses"), ("total_policy_score", "total_policy_score"))])
    out = contracts.join(named, "contract_id", "left")
    analysed = F.col("status") == "analyzed"
    for c in RISK_FIELDS[:4]:
        out = out.withColumn(c, F.when(analysed, F.col(c)))
    score = F.lit(None).cast("double")
    if scores is not None:
        out = out if together else out.join(scores.select("contract_id", "total_policy_score"), "contract_id", "left")
        score = F.when(analysed, F.col("total_policy_score").cast("double"))
    return out.withColumn("policy_risk_score", score).drop("total_policy_score")


def listing(contracts: DataFrame, today: str, include_expired: bool = True) -> DataFrame:
    """Contracts with is_expired (their end is known and before today); without the expired ones if these are not asked for."""
    out = contracts.withColumn("is_expired", F.coalesce(F.col("end_date") < today, F.lit(False)))
    return out if include_expired else out.where(~F.col("is_expired"))


def currency_group(currency: Column) -> Column:
    return F.upper(F.coalesce(currency, F.lit("unknown currency")))


def date_bound(value: str, op: str) -> str | None:
    """A day for a year, a month or a day, so that `before` and `after` leave it out whole."""
    value, parts = (value or "").strip(), (value or "").strip().split("-")
    if not all(p.isdigit() for p in parts) or [len(p) for p in parts] not in ([4], [4, 2], [4, 2, 2]):
        return None
    tail = {"before": "-01-01", "after": "-12-31"}[op] if len(parts) == 1 else {"before": "-01", "after": "-31"}[op] if len(parts) == 2 else ""
    return value + tail


def predicate(f: Filter) -> Column:
    """True, false, or null where the contract has no value for the field."""
    value = F.col(f.field)
    if f.op in ("is_true", "is_false"):
        return value.cast("boolean") == F.lit(f.op == "is_true")
    if f.op in ("contains", "equals"):
        have = F.when(value.isNotNull(), norm_name(value.cast("string")))
        want = norm_name(F.lit(f.value or ""))
        if f.field == "filename":  # "contract 3" is not in "contract 31"
            bare = " ".join("".join(c if c.isascii() and (c.isalnum() or c == " ") else " " for c in (f.value or "").lower()).split())
            return have.rlike(f"(?<![a-z0-9]){bare}(?![0-9])")
        return F.contains(have, want) if f.op == "contains" else have == want
    if f.op in ("greater_than", "less_than"):
        limit = parse_money(F.lit(f.value or ""))
        return value.cast("double") > limit if f.op == "greater_than" else value.cast("double") < limit
    bound = date_bound(f.value or "", f.op)
    if bound is None:
        return F.lit(None).cast("boolean")
    return value < bound if f.op == "before" else value > bound


def filtered(contracts: DataFrame, filters: tuple[Filter, ...]) -> DataFrame:
    for f in filters:
        contracts = contracts.where(predicate(f))
    return contracts


def unknown(contracts: DataFrame, filters: tuple[Filter, ...]) -> DataFrame:
    """contract_id and field of the rows that a filter could not decide, among those that passed the filters before it."""
    out = None
    for f in filters:
        if f.field != "filename":
            own = contracts.where(predicate(f).isNull()).select("contract_id", F.lit(f.field).alias("field"))
            out = own if out is None else out.unionByName(own)
        contracts = contracts.where(predicate(f))
    return contracts.select("contract_id", F.lit("").alias("field")).limit(0) if out is None else out


def numbered(rows: DataFrame, group: str, order: list[Column], out: str = "position") -> DataFrame:
    """Rows with their number in their group, from 1, in an order that leaves no ties. `group` is never null.

    A range sort deals the rows out evenly, whatever the groups' sizes; a row's number is its place in its task plus the rows of its group in the tasks before, which come from one count for each task and group.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(parts, group, *order).sortWithinPartitions(group, *order).withColumn("_at", F.monotonically_increasing_id())
    held = checkpointed(ranged).withColumn("_task", F.shiftright("_at", 33))  # the ranges come from a sample, so they are taken once
    tasks = held.groupBy(group, "_task").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(group).orderBy("_task")) - F.col("_n")  # a row for each task
    tasks = tasks.select(group, "_task", "_first", before.alias("_before"))
    numbers = held.join(tasks, [group, "_task"]).withColumn(out, F.col("_before") + F.col("_at") - F.col("_first") + 1)
    return numbers.select(*rows.columns, out)


def ranked(contracts: DataFrame, spec: Spec) -> DataFrame:
    """Rows with `currency_group` (amounts are ranked for each currency, else empty) and `position`, after offset and limit; ties at the limit stay. Rows without the value are left out."""
    by = spec.sort_by
    value = F.col(by)
    rows = contracts.where(value.isNotNull())
    turn = (lambda c: c.desc()) if spec.order == "desc" else (lambda c: c.asc())
    if by == "contract_value":
        rows, keys = rows.withColumn("currency_group", currency_group(F.col("currency"))), [value]
    elif by in RISK_FIELDS:
        rows, keys = rows.withColumn("currency_group", F.lit("")), [F.coalesce(F.col(c), F.lit(0)) for c in TIES[by]]
    else:
        rows, keys = rows.withColumn("currency_group", F.lit("")), [F.lower(value.cast("string"))]
    group, last = Window.partitionBy("currency_group"), spec.offset + (spec.limit or 0)
    if spec.limit:
        # each task passes on no more than the first ones and their ties, so a whole group is never in one task
        rows = rows.withColumn("_rank", F.rank().over(group.orderBy(turn(keys[0])))).where(F.col("_rank") <= last).drop("_rank")
        rows = rows.withColumn("position", F.row_number().over(group.orderBy(*map(turn, keys), "contract_id")))
        rows = rows.withColumn("_edge", F.max(F.when(F.col("position") == last, value)).over(group))
        rows = rows.where((F.col("position") <= last) | (value == F.col("_edge"))).drop("_edge")
    else:
        rows = numbered(rows, "currency_group", [*map(turn, keys), F.col("contract_id")])
    return rows.where(F.col("position") > spec.offset) if spec.offset else rows


def too_few(contracts: DataFrame, spec: Spec) -> DataFrame:
    """Currencies with no n-th contract, and how many they have."""
    rows = contracts.where(F.col(spec.sort_by).isNotNull())
    key = currency_group(F.col("currency")) if spec.sort_by == "contract_value" else F.lit("")
    return rows.groupBy(key.alias("currency_group")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= spec.offset)


def totals(contracts: DataFrame, spec: Spec) -> DataFrame:
    """currency_group, n, total and average of the amounts, of all or of the first `limit` for each currency. Sums are decimal, so they do not depend on order."""
    rows = contracts.where(F.col("contract_value").isNotNull()).withColumn("currency_group", currency_group(F.col("currency")))
    if spec.limit:
        key = F.col(spec.sort_by or "contract_value")
        order = key.desc() if spec.order == "desc" else key.asc()
        rows = rows.where(key.isNotNull()).withColumn("_n", F.row_number().over(Window.partitionBy("currency_group").orderBy(order, "contract_id"))).where(F.col("_n") <= spec.limit)
    exact = F.sum(F.col("contract_value").cast("decimal(18,2)"))
    out = rows.groupBy("currency_group").agg(F.count(F.lit(1)).alias("n"), exact.cast("decimal(38,2)").alias("total"))
    return out.withColumn("average", F.round(F.col("total").cast("double") / F.col("n"), 2))


def count(contracts: DataFrame, spec: Spec) -> DataFrame:
    if spec.sort_by and not spec.limit:  # no ranking is needed to count what is behind the offset
        key = currency_group(F.col("currency")) if spec.sort_by == "contract_value" else F.lit("")
        per = contracts.where(F.col(spec.sort_by).isNotNull()).groupBy(key.alias("_g")).agg(F.count(F.lit(1)).alias("n"))
        return per.agg(F.coalesce(F.sum(F.greatest(F.col("n") - spec.offset, F.lit(0))), F.lit(0)).alias("n"))
    rows = ranked(contracts, spec) if spec.sort_by else contracts
    return rows.agg(F.count(F.lit(1)).alias("n"))


def grouped(contracts: DataFrame, spec: Spec) -> DataFrame:
    """key, display (as first seen), n, totals (currency to sum), names (six at most) of each group, by count; the first `limit` groups with ties."""
    label = F.col(spec.group_by)
    rows = contracts.where(label.isNotNull()).withColumn("key", norm_name(label))
    money = F.sum(F.col("contract_value").cast("decimal(18,2)")).cast("decimal(38,2)")
    per = rows.groupBy("key", currency_group(F.col("currency")).alias("cur")).agg(F.count(F.lit(1)).alias("n"), money.alias("total"), F.min(F.struct("contract_id", label.alias("display"))).alias("first"))
    out = per.groupBy("key").agg(F.sum("n").alias("n"), F.min("first")["display"].alias("display"), F.array_sort(F.collect_list(F.when(F.col("total").isNotNull(), F.struct("cur", "total")))).alias("_t"))
    # six names of each group: each task passes on six at most
    some = rows.select("key", "contract_id", "filename", F.row_number().over(Window.partitionBy("key").orderBy("contract_id")).alias("_n")).where(F.col("_n") <= 6)
    names = some.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "filename"))), lambda x: x["filename"]).alias("names"))
    out = out.join(names, "key").select("key", "display", "n", F.map_from_entries("_t").alias("totals"), "names")
    if spec.limit:
        turn = F.col("n").desc() if spec.order == "desc" else F.col("n").asc()
        out = out.withColumn("_r", F.rank().over(Window.orderBy(turn))).where(F.col("_r") <= spec.limit).drop("_r")  # over groups, not contracts
    return out


def run(contracts: DataFrame, spec: Spec) -> DataFrame:
    """The answer of a spec over a contract directory."""
    rows = filtered(contracts, spec.filters)
    if spec.operation == "group" or spec.group_by:
        return grouped(rows, spec)
    if spec.operation in ("sum", "average"):
        return totals(rows, spec)
    if spec.operation == "count":
        return count(rows, spec)
    rows = ranked(rows, spec) if spec.sort_by else rows.limit(spec.limit) if spec.limit else rows
    chosen = list(dict.fromkeys(["contract_id", "filename", *spec.fields, *([spec.sort_by] if spec.sort_by else []), *(f.field for f in spec.filters), *(["currency"] if spec.sort_by == "contract_value" else [])]))
    return rows.select(*chosen, *(["currency_group", "position"] if spec.sort_by else []))


def scope(contracts: DataFrame, spec: Spec, named: DataFrame | None = None, selected: DataFrame | None = None) -> DataFrame:
    """Contracts a question runs over: those it names, else all for rankings, totals and filters, else the selected one. named, selected: contract_id."""
    if named is not None:
        return contracts.join(named, "contract_id", "left_semi")
    aggregate = spec.sort_by or spec.operation != "list" or any(f.field != "filename" for f in spec.filters)
    return contracts if aggregate or selected is None else contracts.join(selected, "contract_id", "left_semi")


def others(contracts: DataFrame, shown: DataFrame) -> DataFrame:
    return contracts.join(shown, "contract_id", "left_anti")


def directory_line(row: Column | None = None) -> Column:
    """A contract in one line of text."""
    from ..functions.money import format_money

    risk = F.when(F.col("total_clauses").isNull(), "not analyzed yet").otherwise(F.concat(F.lit("risk: "), F.col("high_risk_clauses").cast("string"), F.lit(" high, "), F.col("medium_risk_clauses").cast("string"), F.lit(" medium, "), F.col("low_risk_clauses").cast("string"), F.lit(" low")))
    return F.concat_ws(
        " | ", F.col("filename"), F.concat(F.lit("borrower: "), F.col("customer_name")), F.concat(F.lit("lender: "), F.col("lender_name")),
        F.concat(F.lit("amount: "), format_money(F.col("contract_value"), F.col("currency"))), F.concat(F.lit("ends: "), F.col("end_date")), risk,
    )


def sources(rows: DataFrame, header: str = "header_text") -> DataFrame:
    """Numbered sources of an answer's rows (contract_id, filename, position): the header text, else the amount."""
    from ..functions.money import format_money

    return rows.select(F.col("position").alias("source_no"), "contract_id", "filename", F.coalesce(F.col(header), F.concat(F.lit("Amount: "), format_money(F.col("contract_value"), F.col("currency")))).alias("text"))


def markdown(rows: DataFrame, columns: list[str], most: int = 100) -> str:
    """A table of at most `most` rows as markdown. Collects those rows only."""
    got = rows.select(*columns).limit(most).collect()
    show = lambda v: "not found" if v is None else ("Yes" if v else "No") if isinstance(v, bool) else str(int(v)) if isinstance(v, float) and v.is_integer() else str(v)
    return "\n".join(["| " + " | ".join(columns) + " |", "|" + " --- |" * len(columns), *("| " + " | ".join(show(v).replace("|", "\\|") for v in r) + " |" for r in got)])
