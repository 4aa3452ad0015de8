"""Routing of a table of questions: rules to specs, named contracts, follow-ups."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.money import parse_money
from ..functions.text import contains_name, norm_name, recover_object, stem
from .portfolio import Filter, Spec, run

# Words that decide a route.
NOT_AMOUNT = r"(?i)\b(interest|rate|ratio|ltv|loan-to-value|penalt\w*|fee\w*|fine|clause\w*|terminat\w*|insur\w*|guarantee\w*|default|obligation\w*|risk\w*|terms?|condition\w*|warrant\w*|indemn\w*|confidential\w*|jurisdiction|law|tenure|duration|period|months?|years?|days?|install?ments?|payments?|mention\w*|contain\w*|say|says|include\w*)\b"
AMOUNT_WORDS = r"(?i)\b(amounts?|value|valuable|financed|principal|money|worth|loans?|contracts?)\b"
PLAIN_COUNT = r"(?i)^\s*(?:how many|what is the number of|number of|count(?: of)?)\s+(?:contracts|loans|agreements|documents)(?:\s+(?:are there|do (?:we|i) have|in total|have been uploaded|are uploaded|are stored|in the system))?\s*\??\s*$"
ACROSS = r"(?i)\b(which|what|any|all|every|each|how many)\b[^?]*\bcontracts\b|\bany contract\b|\bevery contract\b|\beach contract\b|\bacross\b|\bcompare\b"
ORDINAL_OFFSET = (("second", 1), ("2nd", 1), ("third", 2), ("3rd", 2), ("fourth", 3), ("4th", 3), ("fifth", 4), ("5th", 4))
# words that follow up on an answer, that ask for its rest, and topics that lie in clauses
FOLLOW_UP = r"(?i)\b(others?|other ones|the rest|rest of them|remaining|all of them|all the others|full list|whole list|everything|every one|the whole|more|too|also|as well)\b"
REST = r"(?i)\b(others?|other ones|the rest|rest of them|remaining|all the others)\b"
CLAUSE_TOPIC = r"(?i)\b(terminat\w*|cancel\w*|default\w*|breach\w*|penalt\w*|fines?|fees?|charges?|late|interest|install?ments?|repay\w*|prepay\w*|insur\w*|guarant\w*|collateral|lien|jurisdiction|courts?|arbitrat\w*|disputes?|notices?|confidential\w*|warrant\w*|obligations?|covenants?|assign\w*|force majeure|grace period|mention\w*|say|says)\b"
# rules on a question in lower case, in the order in which they are tried
RISKY = r"\b(riskiest|most risky|highest risks?|most (?:high[- ])?risks?|high[- ]risk)\b"
CONTRACT = r"\bcontracts?\b"
CONTRACTS = r"\bcontracts\b"
OF_CLAUSE = r"\b(clause|say|mention)"
TOP = r"\btop\s+(\d{1,2})\b"
TOP_OF = r"\b(\d{1,2})\s+(?:largest|biggest|highest|smallest|lowest)\b"
MANY = r"\bcontracts\b|\bloans\b|\bamounts\b"
COUNT_OF = r"\b(?:number|count) of (?:contracts|loans|agreements)\b"
TOTAL = r"\b(total|sum|combined|altogether)\b"
AVERAGE = r"\b(average|mean)\b"
MOST = r"\b(highest|largest|biggest|maximum|max|most valuable)\b|\bworth the most\b|\bmost (?:money|expensive)\b"
LEAST = r"\b(lowest|smallest|minimum|min)\b|(?<!\bat )\bleast\b"
GENERIC_PARTY = ("bank", "of", "the", "and", "inc", "llc", "ltd", "limited", "corp", "corporation", "company", "co", "group", "financial", "credit", "union", "national", "first")
SPEC = "struct<operation:string,sort_by:string,order:string,limit:int,offset:int>"


def across_contracts(question: Column) -> Column:
    return F.coalesce(question.rlike(ACROSS), F.lit(False))


def rule_spec(question: Column) -> Column:
    """The spec of a plain question on counts, amounts or risk; null if no rule fits."""
    q, low = F.trim(question), F.lower(F.trim(question))
    spec = lambda op="list", by=None, order="desc", limit=F.lit(None), offset=F.lit(0): F.struct(F.lit(op).alias("operation"), F.lit(by).cast("string").alias("sort_by"), F.lit(order).alias("order"), limit.cast("int").alias("limit"), offset.cast("int").alias("offset"))
    word = F.regexp_extract(low, r"\b(" + "|".join(w for w, _ in ORDINAL_OFFSET) + r")\b", 1)
    offset = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in ORDINAL_OFFSET for x in p]), word), F.lit(0))
    risky = low.rlike(RISKY) & low.rlike(CONTRACT) & ~low.rlike(OF_CLAUSE)
    found = lambda p: F.nullif(F.regexp_extract(low, p, 1), F.lit(""))
    top = F.coalesce(found(TOP), found(TOP_OF)).cast("int")
    limit = F.when(offset > 0, 1).when(top.isNotNull(), top).when(low.rlike(MANY), F.lit(None)).otherwise(1)
    several = F.when(low.rlike(CONTRACTS) & (offset == 0), F.lit(None)).otherwise(1)
    return (
        F.when(q.rlike(PLAIN_COUNT), spec("count"))
        .when(risky, spec(by="high_risk_clauses", limit=several, offset=offset))
        .when(q.rlike(NOT_AMOUNT) | ~q.rlike(AMOUNT_WORDS), F.lit(None).cast(SPEC))
        .when(low.rlike(COUNT_OF), spec("count"))
        .when(low.rlike(TOTAL), spec("sum"))
        .when(low.rlike(AVERAGE), spec("average"))
        .when(low.rlike(MOST), spec(by="contract_value", limit=limit, offset=offset))
        .when(low.rlike(LEAST), spec(by="contract_value", order="asc", limit=limit, offset=offset))
        .when(top.isNotNull(), spec(by="contract_value", limit=limit))
    )


def route(questions: DataFrame) -> DataFrame:
    """Questions (question) with spec and route: structured where a rule fits, else semantic; across tells whether all contracts are meant."""
    out = questions.withColumn("spec", rule_spec(F.col("question")))
    return out.withColumn("route", F.when(F.col("spec").isNotNull(), "structured").otherwise("semantic")).withColumn("across", across_contracts(F.col("question")))


def check_spec(routed: DataFrame) -> DataFrame:
    """Structured questions that select nothing or are about a clause's topic go to semantic search."""
    nothing = (F.col("spec.operation") == "list") & F.col("spec.sort_by").isNull()
    topic = F.col("question").rlike(NOT_AMOUNT) & (F.coalesce(F.col("spec.sort_by"), F.lit("")) == "contract_value")
    return routed.withColumn("route", F.when((F.col("route") == "structured") & (nothing | topic), "semantic").otherwise(F.col("route")))


def follow_up(turns: DataFrame, shown: str | None = None) -> DataFrame:
    """Turns (conv_id, turn, question, spec) with the spec that a follow-up on an exact answer ("list the other ones too") takes over, and `exclude`.

    A short question with such words and no clause topic, whose own spec is missing or selects nothing, takes the spec of the turn before, widened to the whole list (a grouping stays one). If it asks for the rest, what was shown stays out: `exclude` holds the ids in the column `shown` of the turn before; where these are not known, the offset skips them.
    """
    window = Window.partitionBy("conv_id").orderBy("turn")
    ids = F.lag(shown).over(window) if shown else F.lit(None).cast("array<string>")
    out = turns.withColumn("_b", F.lag("spec").over(window)).withColumn("_ids", ids)
    asks = F.col("question").rlike(FOLLOW_UP) & (F.size(F.split(F.trim("question"), r"\s+")) <= 14) & ~F.col("question").rlike(CLAUSE_TOPIC)
    open_ = F.col("spec").isNull() | ((F.col("spec.operation") == "list") & F.col("spec.sort_by").isNull())
    takes = F.coalesce(asks & open_ & F.col("_b").isNotNull(), F.lit(False))
    rest, known = F.col("question").rlike(REST), F.coalesce(F.size("_ids") > 0, F.lit(False))
    skip = F.when(rest & ~known, F.coalesce(F.col("_b.offset"), F.lit(0)) + F.coalesce(F.col("_b.limit"), F.lit(0))).otherwise(0)
    operation = F.when(F.col("_b.operation") == "group", "group").otherwise("list")
    widened = F.struct(operation.alias("operation"), F.col("_b.sort_by").alias("sort_by"), F.col("_b.order").alias("order"), F.lit(None).cast("int").alias("limit"), F.when(F.col("_b.limit").isNotNull(), skip).otherwise(0).cast("int").alias("offset"))
    out = out.withColumn("exclude", F.when(takes & rest & known, F.col("_ids"))).withColumn("spec", F.when(takes, widened).otherwise(F.col("spec")))
    return out.drop("_b", "_ids")


#: Words of a name by which it meets a question; the whole name is compared then.
LEAD = 6


def _windows(text: Column) -> Column:
    """All runs of one to LEAD words of a normalised text."""
    words = F.split(text, " ")
    runs = F.flatten(F.transform(F.sequence(F.lit(1), F.size(words)), lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(LEAD), F.size(words) - i + 1)), lambda n: F.array_join(F.slice(words, i, n), " "))))
    return F.array_distinct(F.filter(runs, lambda x: F.length(x) >= 3))


def _lead(name: Column) -> Column:
    return F.array_join(F.slice(F.split(name, " "), 1, LEAD), " ")


def _in(texts: DataFrame, text: str, names: DataFrame, name: str) -> DataFrame:
    """Pairs of normalised texts and normalised names that the text holds as whole words, met by the name's first words."""
    left = texts.withColumn("_w", F.explode(_windows(F.col(text))))
    return left.join(names.withColumn("_w", _lead(F.col(name))), "_w").where(contains_name(F.col(text), F.col(name))).drop("_w")


def _file_named(question: Column, name: Column) -> Column:
    """Does a question write a file's name of several words as a name: joined as the file joins them, or with a capital?"""
    quoted = lambda w: F.concat(F.lit(r"\Q"), w, F.lit(r"\E"))
    alone = lambda p: F.concat(F.lit("(?i)(?<![A-Za-z0-9])"), p, F.lit("(?![A-Za-z0-9])"))
    joined = name.rlike("[_-]") & F.rlike(question, alone(quoted(name)))
    spaced = F.split(F.trim(F.regexp_replace(name, r"[_\-\s]+", " ")), " ")
    written = F.regexp_extract_all(question, alone(F.array_join(F.transform(spaced, quoted), r"[\s_-]+")), F.lit(0))
    return joined | F.exists(written, lambda x: x.rlike("[A-Z]"))


def named_contracts(questions: DataFrame, contracts: DataFrame, wanted: str | None = None) -> DataFrame:
    """query_id, contract_id, strength (strong or loose) of the contracts that questions (query_id, question) name.

    Strong: a name that a router listed (the array column `wanted`) within a file's or borrower's name or the other way round; a whole file name with its ending; a file name with a digit; one of several words, written as a name; or a borrower's full name of two words or more, as whole words. Loose: one name of four letters or more that only one borrower has, written as a possessive or with a capital within the sentence. Names and texts are joined by the names' first words, so no question meets every contract.
    """
    asked = questions.select("query_id", "question", norm_name(F.col("question")).alias("_q"))
    files = contracts.where(F.col("filename").isNotNull()).select("contract_id", "filename", stem(F.col("filename")).alias("_stem"), norm_name(stem(F.col("filename"))).alias("name"))
    people = contracts.where(F.col("customer_name").isNotNull()).select("contract_id", norm_name(F.col("customer_name")).alias("name"))
    pair = lambda df: df.select("query_id", "contract_id")
    by_file = _in(asked, "_q", files, "name").where(F.col("name").rlike(r"\d") | ((F.size(F.split("name", " ")) >= 2) & _file_named(F.col("question"), F.col("_stem"))))
    by_ending = _in(asked, "_q", files.withColumn("_full", norm_name(F.col("filename"))), "_full").where(F.contains(F.lower("question"), F.lower("filename")))
    by_person = _in(asked, "_q", people.where(F.size(F.split("name", " ")) >= 2), "name")
    strong = pair(by_file).unionByName(pair(by_ending)).unionByName(pair(by_person))
    if wanted:
        listed = questions.select("query_id", F.explode(wanted).alias("_l")).select("query_id", norm_name(F.col("_l")).alias("_l")).where("_l <> ''")
        names = files.select("contract_id", "name").unionByName(people).where("name <> ''")
        within = _in(listed, "_l", names, "name").select("query_id", "contract_id")
        around = _in(names, "name", listed, "_l").select("query_id", "contract_id")
        exact = listed.join(files.select("contract_id", norm_name(F.col("filename")).alias("_l")), "_l").select("query_id", "contract_id")
        strong = strong.unionByName(within).unionByName(around).unionByName(exact)
    strong = strong.distinct().withColumn("strength", F.lit("strong"))
    token = people.select("contract_id", F.explode(F.array_distinct(F.split("name", " "))).alias("name")).where(F.length("name") >= 4)
    owner = token.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("contract_id").alias("contract_id")).where(F.col("n") == 1)
    passing = _in(asked, "_q", owner, "name")
    said = F.concat(F.lit("(?i)(?<![A-Za-z])"), F.col("name"), F.lit("('s|’s)\\b"))
    capital = F.concat(F.lit("[^.?!:\\s]\\s+"), F.initcap("name"), F.lit("(?![A-Za-z])"))
    loose = passing.where(F.rlike("question", said) | F.rlike("question", capital)).select("query_id", "contract_id").distinct()
    return strong.unionByName(loose.join(strong, ["query_id", "contract_id"], "left_anti").withColumn("strength", F.lit("loose")))


def usable_names(named: DataFrame, routed: DataFrame) -> DataFrame:
    """Named contracts, without those of questions on rankings, totals or all contracts that rest on loose names only."""
    both = named.join(routed.select("query_id", "spec", "across"), "query_id").join(named.where("strength = 'strong'").select("query_id", F.lit(True).alias("_s")).distinct(), "query_id", "left")
    aggregate = F.coalesce(F.col("spec").isNotNull() | F.col("across"), F.lit(False))
    return both.where(~(F.col("_s").isNull() & aggregate)).select(named.columns)


def lenders_named(questions: DataFrame, contracts: DataFrame) -> DataFrame:
    """query_id and lender_name where a question holds a lender's full name: a filter on the lender, not a contract's name."""
    asked = questions.select("query_id", norm_name(F.col("question")).alias("_q"))
    lenders = contracts.where(F.col("lender_name").isNotNull()).select("lender_name").distinct().withColumn("name", norm_name(F.col("lender_name")))
    return _in(asked, "_q", lenders, "name").select("query_id", "lender_name").distinct()


def of_party(questions: DataFrame, contracts: DataFrame) -> DataFrame:
    """query_id, contract_id and role (borrower or lender) of the contracts whose party a question asks for: all words of the party's name but generic ones are in the question.

    Words and parties are joined by the party's longest word of its own.
    """
    own = lambda c: F.array_except(F.array_distinct(F.split(norm_name(c), " ")), F.array(*map(F.lit, ("", *GENERIC_PARTY))))
    party = [contracts.where(F.col(c).isNotNull()).select("contract_id", F.lit(role).alias("role"), own(F.col(c)).alias("_p")) for c, role in (("customer_name", "borrower"), ("lender_name", "lender"))]
    parties = party[0].unionByName(party[1]).where(F.size("_p") > 0)
    parties = parties.withColumn("_w", F.array_max(F.transform("_p", lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"])
    asked = questions.select("query_id", own(F.col("question")).alias("_q")).withColumn("_w", F.explode("_q"))
    return asked.join(parties, "_w").where(F.size(F.array_except("_p", "_q")) == 0).select("query_id", "contract_id", "role").distinct()


# What a reply may ask for.
KINDS, OPERATIONS = ("structured", "semantic"), ("list", "count", "sum", "average", "group")
FIELDS = (
    "filename", "customer_name", "lender_name", "contract_about", "governing_law", "currency", "contract_value", "start_date", "end_date", "indemnification_clause_present", "ip_shared_with_customer",
    "high_risk_clauses", "medium_risk_clauses", "low_risk_clauses", "total_clauses", "policy_risk_score",
)
SORT_FIELDS = ("contract_value", "start_date", "end_date", "customer_name", "high_risk_clauses", "medium_risk_clauses", "low_risk_clauses", "total_clauses", "policy_risk_score")
GROUP_FIELDS = ("lender_name", "customer_name", "contract_about", "governing_law", "currency")
OPS = ("contains", "equals", "greater_than", "less_than", "before", "after", "is_true", "is_false")
MOST_ROWS, MOST_NAMES = 100, 10
#: Different specs that one table of questions may ask for: each is a plan of its own.
MOST_SPECS = 1000

FULL_SPEC = "struct<operation:string,sort_by:string,order:string,limit:int,offset:int,group_by:string,filters:array<struct<field:string,op:string,value:string>>,fields:array<string>>"


def prompt(turns: DataFrame, last: int = 4) -> DataFrame:
    """Turns (conv_id, turn, role, text) with a routing prompt of what a reply may hold, the last turns and the question."""
    window = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-last, -1)
    history = F.array_join(F.collect_list(F.concat(F.col("role"), F.lit(": "), F.substring("text", 1, 400))).over(window), "\n")
    told = {"kind": KINDS, "operation": OPERATIONS, "sort_by": SORT_FIELDS, "order": ("asc", "desc"), "group_by": GROUP_FIELDS, "fields": FIELDS, "op": OPS}
    rules = "".join(f"{k}: {', '.join(v)}\n" for k, v in told.items()) + f"limit: 1 to {MOST_ROWS}, offset: 0 to {MOST_ROWS}, filters: a list of field, op and value, contracts: names, across_contracts: true or false, standalone_question: text\n"
    return turns.withColumn("prompt", F.concat(F.lit("Keys of the reply and their values:\n" + rules + "\nEarlier turns:\n"), history, F.lit("\n\nQuestion: "), F.col("text"), F.lit("\nReply with one JSON object.")))


def compile_reply(reply: Column) -> Column:
    """A router's reply as kind, spec (what portfolio.run() takes; null unless structured), contracts, across_contracts, standalone_question and problems; kind and spec are null if there is any problem.

    Each part is held against what is allowed: a word outside its list, a limit or an offset out of range, a filter on an unknown field or with an unknown operation, a date or amount that can't be read and a group without its field are problems. Unknown names among `fields` are left out, and blank contracts; the first ten of these count.
    """
    text = recover_object(reply, ["kind"])
    part = lambda c: F.get_json_object(text, f"$.{c}")
    listed = lambda c: F.coalesce(F.from_json(part(c), "array<string>"), F.array().cast("array<string>"))
    number = lambda c: F.regexp_replace(part(c), r"\.0+$", "").try_cast("int")
    filters = F.coalesce(F.from_json(part("filters"), "array<struct<field:string,op:string,value:string>>"), F.array().cast("array<struct<field:string,op:string,value:string>>"))
    wrong = lambda c, allowed: F.when(part(c).isNotNull() & ~part(c).isin(*allowed), F.concat(F.lit(f"{c}: "), part(c), F.lit(" is not allowed")))
    out_of = lambda c, low: F.when(part(c).isNotNull() & ~F.coalesce(number(c).between(low, MOST_ROWS), F.lit(False)), F.concat(F.lit(f"{c}: "), part(c), F.lit(f" is not a number from {low} to {MOST_ROWS}")))

    def of_filter(f: Column) -> Column:
        named = F.coalesce(f["field"], F.lit("nothing"))
        dated = f["op"].isin("before", "after") & ~F.coalesce(F.trim(f["value"]).rlike(r"^\d{4}(-\d{2}(-\d{2})?)?$"), F.lit(False))
        counted = f["op"].isin("greater_than", "less_than") & parse_money(F.coalesce(f["value"], F.lit(""))).isNull()
        return (
            F.when(~F.coalesce(f["field"].isin(*FIELDS), F.lit(False)), F.concat(F.lit("filters: field "), named, F.lit(" is not allowed")))
            .when(~F.coalesce(f["op"].isin(*OPS), F.lit(False)), F.concat(F.lit("filters: operation "), F.coalesce(f["op"], F.lit("nothing")), F.lit(" is not allowed")))
            .when(dated | counted, F.concat(F.lit("filters: value "), F.coalesce(f["value"], F.lit("nothing")), F.lit(" can't be read")))
        )

    problems = F.array_compact(F.concat(
        F.array(
            F.when(text.isNull(), "no object with a kind"), wrong("kind", KINDS), F.when(text.isNotNull() & part("kind").isNull(), "kind: nothing is not allowed"), wrong("operation", OPERATIONS), wrong("sort_by", SORT_FIELDS), wrong("order", ("asc", "desc")), wrong("group_by", GROUP_FIELDS),
            out_of("limit", 1), out_of("offset", 0), F.when((part("operation") == "group") & part("group_by").isNull(), "group_by: nothing is not allowed"), F.when(part("filters").isNotNull() & ~part("filters").startswith("["), "filters: not a list"),
        ),
        F.transform(filters, of_filter),
    ))
    spec = F.struct(
        F.coalesce(part("operation"), F.lit("list")).alias("operation"), part("sort_by").alias("sort_by"), F.coalesce(part("order"), F.lit("desc")).alias("order"), number("limit").alias("limit"), F.coalesce(number("offset"), F.lit(0)).alias("offset"), part("group_by").alias("group_by"),
        filters.alias("filters"), F.filter(listed("fields"), lambda f: f.isin(*FIELDS)).alias("fields"),
    ).cast(FULL_SPEC)
    fine = F.size(problems) == 0
    names = F.slice(F.filter(F.transform(listed("contracts"), lambda c: F.trim(c)), lambda c: c != ""), 1, MOST_NAMES)
    return F.struct(
        F.when(fine, part("kind")).alias("kind"), F.when(fine & (part("kind") == "structured"), spec).alias("spec"), names.alias("contracts"),
        F.coalesce(part("across_contracts") == "true", F.lit(False)).alias("across_contracts"), F.nullif(F.trim(part("standalone_question")), F.lit("")).alias("standalone_question"), problems.alias("problems"),
    )


def route_with(turns: DataFrame, model: Callable[[pd.DataFrame], pd.DataFrame], last: int = 4) -> DataFrame:
    """Turns of the user (conv_id, turn, role, text) with `routed`, the compiled reply of a user's model that gets a column `prompt` and gives one `reply`. A question whose reply has problems, or none, is semantic."""
    from .classify import with_model

    asked = prompt(turns, last).where("role = 'user'").select("conv_id", "turn", "text", "prompt")
    said = with_model(asked, model, {"reply": "string"})
    return said.select("conv_id", "turn", "text", compile_reply(F.col("reply")).alias("routed")).withColumn("route", F.coalesce("routed.kind", F.lit("semantic")))


def specs(compiled: DataFrame) -> list[tuple[str, Spec]]:
    """The different specs of a table of questions (spec), with their JSON text, MOST_SPECS at most."""
    rows = compiled.where(F.col("spec").isNotNull()).select("spec", F.to_json("spec").alias("_text")).dropDuplicates(["_text"]).limit(MOST_SPECS + 1).collect()
    if len(rows) > MOST_SPECS:
        raise ValueError(f"a table of questions may ask for {MOST_SPECS} different specs: split it")
    own = lambda s: Spec(s["operation"], s["sort_by"], s["order"], s["limit"], s["offset"], s["group_by"], tuple(Filter(f["field"], f["op"], f["value"]) for f in s["filters"]), tuple(s["fields"]))
    return [(r["_text"], own(r["spec"])) for r in rows]


def run_compiled(compiled: DataFrame, contracts: DataFrame, operation: str = "list") -> DataFrame | None:
    """query_id and the columns of portfolio.run() for the questions (query_id, spec) of one operation (sum and average have the same columns); None if there are none. Each different spec is run once over the directory and joined to its questions."""
    kinds = ("sum", "average") if operation in ("sum", "average") else (operation,)
    own = F.when(F.col("spec.group_by").isNotNull(), "group").otherwise(F.col("spec.operation"))
    found = None
    for text, spec in specs(compiled.where(own.isin(*kinds))):
        out = run(contracts, spec).withColumn("_text", F.lit(text))
        found = out if found is None else found.unionByName(out, allowMissingColumns=True)
    asked = compiled.select("query_id", F.to_json("spec").alias("_text"))
    return None if found is None else asked.join(found, "_text").drop("_text")


def describe(contracts: DataFrame) -> Column:
    """A contract in a sentence, from its fields."""
    from ..functions.money import format_money

    span = F.when(F.col("start_date").isNotNull() & F.col("end_date").isNotNull(), F.concat(F.lit(", running "), F.col("start_date"), F.lit(" to "), F.col("end_date"))).when(F.col("end_date").isNotNull(), F.concat(F.lit(", ending "), F.col("end_date"))).otherwise("")
    value = F.when(F.col("contract_value").isNotNull(), F.concat(F.lit(" for **"), format_money(F.col("contract_value"), F.col("currency")), F.lit("**"))).otherwise("")
    return F.concat(F.col("customer_name"), F.lit(" is the borrower of **"), F.col("filename"), F.lit("**"), value, span, F.lit("."))
