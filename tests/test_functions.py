import pytest
from pyspark.sql import functions as F

from pactlake.functions import money, text


def values(spark, rows, column):
    frame = spark.createDataFrame([(k, r) for k, r in enumerate(rows)], "k int, t string")
    return [r.v for r in frame.select("k", column(F.col("t")).alias("v")).orderBy("k").collect()]


def test_parse_money(spark):
    cases = {
        "$50k": 50000, "1.5M": 1500000, "2.5 crore": 25000000, "Rs. 5,00,000": 500000, "EUR 45.892,00": 45892, "2.125": 2.125, "15.01.2024": None, "$45,892 360": 45892,
        "12 500 000 EUR": 12500000, "$1,203,432.00": 1203432, "2024-01-15": None, "$45,892 as of 01/15/2024": 45892, "n/a": None, "": None, "none stated": None, "-3,5": -3.5,
        "45.892.000": 45892000, "1.2.3": None, "9 lakh": 900000, "3 bn": 3e9, "7 months": 7,
    }
    assert values(spark, list(cases), money.parse_money) == [pytest.approx(v) if v is not None else None for v in cases.values()]
    assert values(spark, [None], money.parse_money) == [None]


def test_money_amounts(spark):
    rows = ["lends $45,892.00 or INR 4,58,920.00 and 12,00 EUR", "US$ 5 and Rs.7 but 360 months", "€ 45.892", None, "no 12 money"]
    got = values(spark, rows, lambda c: F.transform(money.money_amounts(c), lambda x: F.concat(x["value"].cast("string"), F.lit(" "), x["currency"])))
    assert got == [["45892.0 USD", "458920.0 INR", "12.0 EUR"], ["5.0 USD", "7.0 INR"], ["45892.0 EUR"], None, []]


def test_format_money(spark):
    frame = spark.createDataFrame([(1203432.0, "usd"), (9.0, "CHF"), (None, "USD"), (1.5, None)], "v double, c string")
    assert [r[0] for r in frame.select(money.format_money(F.col("v"), F.col("c"))).collect()] == ["$1,203,432.00", "9.00 CHF", "not found", "1.50"]


def test_names(spark):
    frame = spark.createDataFrame([("about contract 31", "contract 3"), ("see contract 3 please", "contract 3"), ("ab", "ab")], "t string, n string")
    assert [r[0] for r in frame.select(text.contains_name(F.col("t"), F.col("n"))).collect()] == [False, True, False]
    assert values(spark, ["Contract_3.PDF", "a.b.txt", None], text.stem) == ["Contract_3", "a.b", ""]
    assert values(spark, ["C:\\x\\y.pdf", "/a/b/c.txt", "d"], text.base_name) == ["y.pdf", "c.txt", "d"]


def test_clause_numbers(spark):
    rows = ["clauses 3 and 6", "section six, article 2", "no clause here", "clauses 1, 2, 3, 4, 5, 6, 7", None]
    assert values(spark, rows, text.clause_numbers) == [[3, 6], [6, 2], [], [1, 2, 3, 4, 5, 6], []]


def test_model_replies(spark):
    rows = ['<think>hm {"a": 0}</think>{"a": 1}', '```json\n{"a": 2}\n```', '{"response": "{\\"a\\": 3}"}', '{"response": "{\\"a\\""}\n{"response": ": 4}"}', 'Sure: {"a": 5} there.', '{"b": 6}', "nothing", None, '{"message": {"content": "ok {\\"a\\": 7}"}}']
    got = values(spark, rows, lambda c: F.get_json_object(text.recover_object(c, ["a"]), "$.a"))
    assert got == ["1", "2", "3", "4", "5", None, None, None, "7"]


def test_citations(spark):
    cases = {
        "1.2% [Source 2].": "1.2% [Source 2](#source-2).",
        "1.2% [Source 2 | Contract_5.pdf | clause 3].": "1.2% [Source 2](#source-2).",
        "1% (Source 4).": "1% ([Source 4](#source-4)).",
        "Both [Sources 1, 3].": "Both [Source 1](#source-1), [Source 3](#source-3).",
        "See (Sources 1 and 2).": "See ([Source 1](#source-1), [Source 2](#source-2)).",
        "In Sources 2-4.": "In [Source 2](#source-2), [Source 3](#source-3), [Source 4](#source-4).",
        "60 months [2].": "60 months [Source 2](#source-2).",
        "Per Source 3, 60 months.": "Per [Source 3](#source-3), 60 months.",
        "Right [Source 2](#source-2).": "Right [Source 2](#source-2).",
        "【Source 2】 x": "[Source 2](#source-2) x",
        "See [Source 9] and [Source 9](#source-9) and [12].": "See Source 9 and Source 9 and [12].",
        "```\n[Source 1]\n``` and [1]": "```\n[Source 1]\n``` and [Source 1](#source-1)",
        "Ann [Source 1 | a.txt | contract header (parties, amounts)].": "Ann [Source 1](#source-1).",
        "It is 2% (Source 3) and applies (see below).": "It is 2% ([Source 3](#source-3)) and applies (see below).",
        "[Source 1][Source 2]": "[Source 1](#source-1)[Source 2](#source-2)",
        "": "", "nothing": "nothing", "[a](b) [1](c) Source 7 ends": "[a](b) [1](c) Source 7 ends",
    }
    assert values(spark, [*cases, None], lambda c: text.link_citations(c, F.lit(5))) == [*cases.values(), None]
    assert values(spark, ["[Source 1]"], lambda c: text.link_citations(c, F.lit(0))) == ["[Source 1]"]
    assert values(spark, ["[Source 3](#source-3) [Source 1] #source-3", "x"], text.cited_numbers) == [[1, 3], []]


def test_terms_and_bonus(spark):
    assert values(spark, ["What does the penalty rate of 1.4% say?"], text.query_terms) == [["penalty", "rate", "1.4"]]
    bonus = values(spark, ["A penalty applies", "the rates", "no match", "penalty rate fee interest"], lambda c: text.lexical_bonus(F.array(*map(F.lit, ["penalty", "rate", "fee", "interest"])), c))
    assert bonus == [pytest.approx(x) for x in (0.1, 0.1, 0.0, 0.3)]


def test_enums_and_titles(spark):
    assert values(spark, ["HIGH ", "odd", None], lambda c: text.pick(c, ("High", "Medium", "Low"), "Low")) == ["High", "Low", "Low"]
    assert values(spark, ["Yes", "0", "maybe"], text.pick_flag) == [True, False, None]
    assert values(spark, ["the client shall pay a fee", "nothing of note"], lambda c: text.proper_title(c, F.lit("Financial"), F.lit(4))) == ["Payment Terms", "Financial Clause 4"]
    assert values(spark, ["BORROWER: Ann Lee, residing at 6 Hill Drive, Town; LENDER: X"], lambda c: text.party_address(c, "BORROWER")) == ["6 Hill Drive, Town"]
