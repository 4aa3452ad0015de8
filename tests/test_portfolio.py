import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from pactlake.operators import classify, compare, policy, retrieval, routing
from pactlake.operators import conversations as conv
from pactlake.operators import portfolio as pf

SCHEMA = "contract_id long, filename string, customer_name string, lender_name string, currency string, contract_value double, start_date string, end_date string, status string, high_risk_clauses long, medium_risk_clauses long, low_risk_clauses long, total_clauses long, policy_risk_score double"


def portfolio(rng, n=60):
    rows = []
    for k in range(n):
        done = rng.random() < 0.8
        h, m, low = (rng.randint(0, 3) for _ in range(3))
        rows.append((k, f"Contract_{k}.pdf", rng.choice([f"Name {k % 7}", None]), rng.choice(["Bank A", "BANK  a", "Credit B", None]), rng.choice(["USD", "usd", "INR", None]), rng.choice([None, float(rng.randint(1, 9) * 100)]), "2024-01-01", rng.choice([None, "2025-06-01", "2026-01-31"]), "analyzed" if done else "uploaded", *([h, m, low, h + m + low, float(rng.randint(0, 3))] if done else [None] * 5)))
    return rows


def plain(rows, spec):
    """The same question over tuples."""
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    data = [dict(zip(names, r)) for r in rows]
    norm = lambda v: " ".join("".join(c if c.isalnum() or c == " " else " " for c in str(v).lower()).split())
    for f in spec.filters:
        v = f.field
        test = {
            "contains": lambda r, v=v, f=f: norm(f.value) in norm(r[v]), "equals": lambda r, v=v, f=f: norm(f.value) == norm(r[v]),
            "greater_than": lambda r, v=v, f=f: r[v] > float(f.value), "less_than": lambda r, v=v, f=f: r[v] < float(f.value),
            "before": lambda r, v=v, f=f: r[v] < f.value, "after": lambda r, v=v, f=f: r[v] > f.value,
        }[f.op]
        data = [r for r in data if r[v] is not None and test(r)]
    group = lambda r: (r["currency"] or "unknown currency").upper()
    data = [r for r in data if r[spec.sort_by] is not None]
    sets = {}
    for r in data:
        sets.setdefault(group(r) if spec.sort_by == "contract_value" else "", []).append(r)
    out = []
    for g, own in sets.items():
        keys = pf.TIES.get(spec.sort_by, (spec.sort_by,))
        own.sort(key=lambda r: r["contract_id"])
        own.sort(key=lambda r: tuple((r[k] or 0) if k in pf.RISK_FIELDS else r[k] for k in keys), reverse=spec.order == "desc")
        own = own[spec.offset :]
        if spec.limit and len(own) > spec.limit:
            edge = own[spec.limit - 1][spec.sort_by]
            cut = spec.limit
            while cut < len(own) and own[cut][spec.sort_by] == edge:
                cut += 1
            own = own[:cut]
        out += [(r["contract_id"], g, k + 1 + spec.offset) for k, r in enumerate(own)]
    return sorted(out)


@pytest.mark.parametrize("seed", range(6))
def test_random_rankings(spark, seed):
    rng = random.Random(seed)
    rows = portfolio(rng)
    frame = spark.createDataFrame(rows, SCHEMA)
    for _ in range(4):
        filters = rng.sample([pf.Filter("lender_name", "contains", "bank a"), pf.Filter("contract_value", "greater_than", "200"), pf.Filter("end_date", "after", "2025-07-01"), pf.Filter("currency", "equals", "usd")], rng.randint(0, 2))
        spec = pf.Spec(sort_by=rng.choice(["contract_value", "end_date", "high_risk_clauses", "policy_risk_score"]), order=rng.choice(["asc", "desc"]), limit=rng.choice([None, 1, 3, 10]), offset=rng.choice([0, 0, 1, 2]), filters=tuple(filters))
        got = sorted(tuple(r) for r in pf.run(frame, spec).select("contract_id", "currency_group", "position").collect())
        want = plain(rows, spec)
        if spec.sort_by in ("high_risk_clauses", "policy_risk_score"):
            # a limit keeps ties on the sorted field only, wherever the other fields put them
            assert {g[0] for g in got} >= {w[0] for w in want}
        else:
            assert got == want


def test_unknown_is_never_zero(spark):
    rows = portfolio(random.Random(9))
    frame = spark.createDataFrame(rows, SCHEMA)
    shown = pf.run(frame, pf.Spec(sort_by="high_risk_clauses", order="asc"))
    assert shown.join(frame.where("status = 'uploaded'"), "contract_id").isEmpty()
    filters = (pf.Filter("contract_value", "less_than", "300"), pf.Filter("end_date", "before", "2026"))
    gone = pf.unknown(frame, filters).collect()
    assert {r.contract_id for r in gone if r.field == "contract_value"} == {r[0] for r in rows if r[5] is None}
    assert {r.contract_id for r in gone if r.field == "end_date"} == {r[0] for r in rows if r[5] is not None and r[5] < 300 and r[7] is None}
    assert pf.date_bound("2024", "before") == "2024-01-01" and pf.date_bound("2024-05", "after") == "2024-05-31" and pf.date_bound("soon", "after") is None


def test_filenames_and_groups(spark):
    frame = spark.createDataFrame(portfolio(random.Random(1), 40), SCHEMA)
    got = pf.run(frame, pf.Spec(filters=(pf.Filter("filename", "contains", "Contract_3"),)))
    assert [r.contract_id for r in got.collect()] == [3]
    groups = {r.key: r.n for r in pf.run(frame, pf.Spec(operation="group", group_by="lender_name")).collect()}
    assert set(groups) == {"bank a", "credit b"}
    assert "| filename |" in pf.markdown(frame, ["filename", "contract_value"], 3)


def test_classify_with_model_and_retry(spark):
    rows = [(1, k, t) for k, t in enumerate(["pay the invoice", "fine print", "hold harmless and indemnify", "plain"])]
    frame = spark.createDataFrame(rows, "contract_id long, clause_id int, text string")

    def model(pdf):
        return pdf.assign(m_domain=["Legal" if "plain" not in t else None for t in pdf["text"]], m_risk_level="Low", m_reason="said so")

    got = {r.clause_id: (r.domain, r.risk_level, r.method) for r in classify.classify_with(frame, model).collect()}
    assert got[0] == ("Legal", "Low", "llm") and got[3] == ("Other", "Low", "keyword_fallback")

    def broken(pdf):
        raise ValueError("down")

    got = {r.clause_id: (r.domain, r.risk_level, r.method) for r in classify.classify_with(frame, broken).collect()}
    assert got[0] == ("Financial", "Low", "keyword_fallback") and got[2][1] == "High"
    assert classify.to_retry(classify.classify_with(frame, model)).count() == 1 and classify.to_retry(classify.classify_with(frame, broken)).count() == 0
    told = classify.summarise(classify.summary_input(classify.classify(frame)), lambda pdf: pdf.assign(reply='x {"executive_summary": "s"}')).first()
    assert told.executive_summary == "s" and told.overall_sentiment == "Balanced"


def test_policy_outcomes(spark):
    clauses = spark.createDataFrame([(1, 1, "Legal", "governing law and jurisdiction"), (1, 2, "Legal", "nothing"), (2, 1, "Financial", "payment terms: invoice due in 30 days")], "contract_id long, clause_id int, domain string, text string")
    contracts = clauses.select("contract_id").distinct()
    checks = policy.default_checks(spark).withColumn("required", F.col("check_id") == "sec_breach")
    said = spark.createDataFrame([(1, 2, "legal_liability", True, "capped"), (1, 2, "legal_indemnify", False, "no")], "contract_id long, clause_id int, check_id string, matched boolean, reason string")
    done = policy.evaluate(clauses, checks, said)
    assert {(r.check_id, r.clause_id): r.method for r in done.where("contract_id = 1").collect()}[("legal_liability", 2)] == "llm"
    excused = spark.createDataFrame([(2, "fin_late", False, "no fees here"), (2, "sec_breach", False, "x")], "contract_id long, check_id string, applicable boolean, reason string")
    got = {(r.contract_id, r.check_id): (r.outcome, r.reason) for r in policy.roll_up(contracts, clauses, done, checks, excused).collect()}
    assert got[(1, "legal_liability")] == ("satisfied", "") and got[(1, "legal_governing")][0] == "satisfied"
    assert got[(1, "legal_indemnify")][0] == "missing" and got[(2, "fin_late")] == ("not_applicable", "no fees here")
    assert got[(2, "sec_breach")][0] == "missing" and got[(2, "sec_breach")][1].startswith("No clause") and (1, "fin_late") not in got
    total = {r.contract_id: (r.total_policy_score, r.is_above_threshold) for r in policy.summary(policy.roll_up(contracts, clauses, done, checks, excused), 20).collect()}
    assert total == {1: (20, True), 2: (10, False)}


def test_label_cycles(spark):
    labels = spark.createDataFrame([(1, None), (2, 1), (3, 2), (8, 9), (9, 8)], "id int, parent_id int")
    assert {r.label_id: r.root_id for r in policy.label_roots(labels).collect()} == {1: 1, 2: 1, 3: 1, 8: None, 9: None}


def test_verdicts(spark):
    counts = spark.createDataFrame([(1, 4, 1, 1, 2, 0), (2, 4, 2, 0, 2, 0), (3, 2, 0, 0, 2, 0)], "contract_id long, total_clauses long, high long, medium long, low long, unclassified long")
    pairs = spark.createDataFrame([(1, 2), (3, 1), (1, 1), (1, 7)], "id_1 long, id_2 long")
    got = {(r.id_1, r.id_2): (r.safer, r.decided_by) for r in compare.pair_verdict(pairs, compare.risk_stats(counts)).collect()}
    assert got == {(1, 2): (1, "score"), (3, 1): (3, "score"), (1, 1): (None, "tie"), (1, 7): (None, "not_analyzed")}


def test_names_in_questions(spark):
    contracts = spark.createDataFrame([(1, "Contract_3.pdf", "Julia Miller", "Harborline Credit Union"), (2, "Contract_31.pdf", "Omar Grace", None), (3, "x.pdf", "Julia Smith", None)], "contract_id long, filename string, customer_name string, lender_name string")
    rows = [(1, "What about contract 31?"), (2, "Who is julia miller"), (3, "What is Omar's rate?"), (4, "does it have a grace period?"), (5, "Is Julia late?"), (6, "we asked Omar about it"), (7, "tell me about Harborline Credit Union")]
    asked = spark.createDataFrame(rows, "query_id long, question string")
    got = {(r.query_id, r.contract_id): r.strength for r in routing.named_contracts(asked, contracts).collect()}
    assert got == {(1, 2): "strong", (2, 1): "strong", (3, 2): "loose", (6, 2): "loose"}
    routed = routing.route(asked.withColumn("question", F.lit("What is the total amount of Omar?")))
    assert routing.usable_names(routing.named_contracts(asked, contracts), routed).where("strength = 'loose'").isEmpty()
    assert [r.lender_name for r in routing.lenders_named(asked, contracts).collect()] == ["Harborline Credit Union"]


def test_follow_ups(spark):
    """The others after the highest leave out what was shown; all of them don't; clause topics, long questions and understood ones stay as they are."""
    asked = ["which contract has the highest amount", "list the other ones too"]
    cases = {
        "list the other ones too": ("list", "contract_value", "desc", None, 0, ["a"]),
        "show all of them": ("list", "contract_value", "desc", None, 0, None),
        "what about its default terms too": None,
        "and the lowest amount as well": ("list", "contract_value", "asc", 1, 0, None),
        "nothing of the kind": None,
        "list the others " + "very " * 14: None,
    }
    rows = [(k, t, q, ["a"] if t == 1 else None) for k, last in enumerate(cases) for t, q in ((1, asked[0]), (2, last))]
    turns = spark.createDataFrame(rows, "conv_id int, turn int, question string, shown array<string>")
    out = routing.follow_up(routing.route(turns), "shown").where("turn = 2").orderBy("conv_id").collect()
    assert [r.spec and (*r.spec, r.exclude) for r in out] == list(cases.values())
    blind = routing.follow_up(routing.route(turns.drop("shown"))).where("turn = 2 and conv_id = 0").first()
    assert blind.exclude is None and (blind.spec.limit, blind.spec.offset) == (None, 1)


def test_names_of_all_kinds(spark):
    contracts = spark.createDataFrame(
        [
            ("a", "Loan Agreement.txt", "Julia Miller"), ("b", "ACME_LOAN.pdf", "Peter Chen"), ("c", "Contract_3.pdf", "Grace Park"), ("d", "Contract_31.pdf", None),
            ("e", "x.pdf", "The Very Long Name Of A Farm Equipment Holding Company"), ("f", "lease.docx", "Omar"),
        ],
        "contract_id string, filename string, customer_name string",
    )
    cases = {
        "Does any loan agreement require insurance?": {}, "What does the Loan Agreement say?": {"a": "strong"}, "rate in acme_loan.pdf": {"b": "strong"}, "rate in Acme Loan": {"b": "strong"}, "an acme loan": {},
        "the term of contract 3": {"c": "strong"}, "contract 31": {"d": "strong"}, "julia's interest rate?": {"a": "loose"}, "Which have a Grace Period?": {"c": "loose"}, "a grace period": {},
        "who is julia miller, and Peter": {"a": "strong", "b": "loose"}, "does the very long name of a farm equipment holding company pay": {"e": "strong"}, "the very long name of a farm": {}, "in LEASE.DOCX please": {"f": "strong"}, "": {}, None: {},
    }
    asked = spark.createDataFrame(list(enumerate(cases)), "query_id int, question string")
    got: dict = {k: {} for k in range(len(cases))}
    for r in routing.named_contracts(asked, contracts).collect():
        got[r.query_id][r.contract_id] = r.strength
    assert got == dict(enumerate(cases.values()))
    listed = spark.createDataFrame([(1, "x", ["Miller"]), (2, "x", ["the contract_3.pdf file"]), (3, "x", ["ghost", ""]), (4, "x", None)], "query_id int, question string, names array<string>")
    assert {(r.query_id, r.contract_id) for r in routing.named_contracts(listed, contracts, "names").collect()} == {(1, "a"), (2, "c")}
    parties = spark.createDataFrame([("a", "Ann Lee", "FIRST BANK OF NOWHERE Inc"), ("b", None, "Harborline Credit Union")], "contract_id string, customer_name string, lender_name string")
    ask = spark.createDataFrame([(1, "what did the Bank of Nowhere lend"), (2, "lee and ann"), (3, "a credit union"), (4, "ann")], "query_id int, question string")
    assert {tuple(r) for r in routing.of_party(ask, parties).collect()} == {(1, "a", "lender"), (2, "a", "borrower")}


def test_budgets_and_labels(spark):
    passages = spark.createDataFrame([("a", "1", 1, "short one."), ("a", "2", 2, "short two."), ("b", "1", 1, "x " * 900 + "the rate is 5%. " + "y " * 900)], "contract_id string, passage_id string, place int, text string")
    named = spark.createDataFrame([(1, 1, "a"), (1, 2, "b")], "query_id int, place int, contract_id string")
    hits = passages.where("contract_id = 'b'").select(F.lit(1).alias("query_id"), "contract_id", "passage_id", "place", F.lit("what is the rate").alias("question"), "text")
    got = retrieval.passages_for_named(named, passages, hits, budget=1200).orderBy("place").collect()
    assert [(r.contract_id, r.passage_id) for r in got] == [("a", "1"), ("a", "2"), ("b", "1")] and got[0].text == "short one." and "5%" in got[2].text and len(got[2].text) <= 610
    shared = retrieval.share_budget(hits.unionByName(hits.withColumn("passage_id", F.lit("2"))), budget=800).collect()
    assert len(shared) == 2 and all("5%" in r.text and len(r.text) <= 410 for r in shared)
    contracts = spark.createDataFrame([(k, f"{k}.pdf") for k in "abcde"], "contract_id string, filename string")
    merged = retrieval.merge_identical(spark.createDataFrame([(1, k, c, "7", "Same  words") for k, c in enumerate("abcde")], "query_id int, place int, contract_id string, passage_id string, text string"), most=2)
    sources = retrieval.number_sources(merged, contracts)
    assert sources.first().label == "a.pdf, clause 7 | identical wording also in: b.pdf, c.pdf and 2 more"
    assert {r.contract_id for r in retrieval.discussed(sources).collect()} == {"a", "b", "c"}


def test_library_edits_and_sources_of_messages(spark):
    library = spark.createDataFrame([(1, "One", "d", "high", [5, 6]), (2, "Two", "d", "odd", [])], "id int, name string, description string, risk_level string, label_ids array<int>")
    edits = spark.createDataFrame([(2, "New", "e", "medium", [6]), (3, "Three", "f", "low", [9])], "id int, name string, description string, risk_level string, label_ids array<int>")
    changed = policy.update_policies(library, edits)
    assert {r.id: r.name for r in changed.collect()} == {1: "One", 2: "New", 3: "Three"}
    labels = spark.createDataFrame([(5, None), (6, "red")], "id int, color string")
    got = {r.check_id: (r.name, r.weight, r.color) for r in policy.with_names(spark.createDataFrame([(1,), (2,), (3,), (4,)], "check_id int"), changed, labels).collect()}
    assert got == {1: ("One", 5, "red"), 2: ("New", 3, "red"), 3: ("Three", 1, None), 4: (None, None, None)}
    said = spark.createDataFrame([(1, 1, "user", "q", [("s" * 700, 1)] * 120)], "conv_id int, turn int, role string, text string, sources array<struct<text:string,no:int>>")
    row = conv.clean(said).first()
    assert len(row.sources) == 100 and row.sources[0].text == "s" * 600 + " …"


def test_ranking_without_a_limit_is_spread(spark):
    rows = [(k, "a.pdf", float(k % 7) if k % 11 else None, "usd" if k % 3 else None, None if k % 5 else f"2024-01-{1 + k % 28:02d}") for k in range(2000)]
    contracts = spark.createDataFrame(rows, "contract_id int, filename string, contract_value double, currency string, end_date string")
    for by, order in (("contract_value", "desc"), ("contract_value", "asc"), ("end_date", "asc")):
        spec = pf.Spec(sort_by=by, order=order, offset=3)
        out = pf.ranked(contracts, spec)
        turn = F.col(by).desc() if order == "desc" else F.col(by).asc()
        group = pf.currency_group(F.col("currency")) if by == "contract_value" else F.lit("")
        want = contracts.where(F.col(by).isNotNull()).withColumn("position", F.row_number().over(Window.partitionBy(group).orderBy(turn, "contract_id"))).where("position > 3")
        assert sorted((r.contract_id, r.position) for r in out.collect()) == sorted((r.contract_id, r.position) for r in want.collect())
        plan = out._jdf.queryExecution().toString()
        assert "row_number" not in plan
    assert pf.ranked(contracts.limit(0), pf.Spec(sort_by="end_date")).count() == 0


def test_label_roots_of_any_depth(spark):
    chain = [(k, k - 1 if k else None) for k in range(1000)]
    rows = chain + [(2000, 2001), (2001, 2002), (2002, 2000), (2003, 2000), (3000, 3000), (4000, 9999)]
    got = {r.label_id: r.root_id for r in policy.label_roots(spark.createDataFrame(rows, "id int, parent_id int")).collect()}
    assert got == {k: 0 for k in range(1000)} | dict.fromkeys((2000, 2001, 2002, 2003, 3000, 4000))
    assert policy.label_roots(spark.createDataFrame([], "id int, parent_id int")).count() == 0


def test_search(spark):
    texts = ["interest is 1.2% a month", "Interest is  1.2% a month", "the law of the land", "late interest is 1% a month", "", None]
    passages = retrieval.embed_words(spark.createDataFrame([(k % 2, k, t) for k, t in enumerate(texts)], "contract_id int, passage_id int, text string"))
    asked = retrieval.embed_words(spark.createDataFrame([(1, "what is the interest a month")], "query_id int, text string"), "query_id").withColumnRenamed("text", "question")
    got = retrieval.hybrid(passages, asked, 5, floor=0.1, margin=0.5).orderBy("place").collect()
    assert {r.passage_id for r in got} == {0, 1, 3} and got[0].passage_id in (0, 1) and all(r.score >= 0.1 for r in got)
    each = retrieval.hybrid(passages, asked, per_contract=1).collect()
    assert sorted(r.contract_id for r in each) == [0, 1]
    asked2 = asked.unionByName(asked.withColumn("query_id", F.lit(2)))
    scope = spark.createDataFrame([(1, 1), (2, 0), (2, 9)], "query_id int, contract_id int")
    only = retrieval.hybrid(passages, asked2, per_contract=1, scope=scope).collect()
    assert sorted((r.query_id, r.contract_id) for r in only) == [(1, 1), (2, 0)]
    plan = retrieval.hybrid(passages, asked2, per_contract=1)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_focus_and_answers(spark):
    long = "This clause is about nothing much. " * 20 + "The rate is 1.4% a month. " + "More words follow here. " * 20
    frame = spark.createDataFrame([(long, "what is the rate"), ("short", "x"), ("word " * 300 + "penalty 9% " + "word " * 300, "penalty"), (None, "x")], "text string, question string")
    got = [r.focus for r in retrieval.focus(frame, 200).collect()]
    assert "1.4%" in got[0] and len(got[0]) < 215 and got[1] == "short" and "penalty" in got[2] and got[3] == ""
    prompts = spark.createDataFrame([("a",), ("b",)], "prompt string")

    def down(p):
        raise OSError("no")

    out = {r.prompt: (r.answer, r.model, len(r.failures)) for r in retrieval.answer_with(prompts, [("one", down), ("two", lambda p: [None if x == "b" else "yes" for x in p]), ("three", lambda p: ["late"] * len(p))]).collect()}
    assert out == {"a": ("yes", "two", 1), "b": ("late", "three", 1)}


def test_citations_and_sources(spark):
    sources = spark.createDataFrame([(1, k, 3 + k, f"Contract_{k}.pdf", t) for k, t in enumerate(["rate 1.2% monthly interest", "the law of Freedonia", "penalty of 5%"], 1)], "answer_id int, source_no int, clause_id int, filename string, text string")
    answers = spark.createDataFrame([(1, "It carries monthly interest of 1.2%.")], "answer_id int, text string")
    likely = retrieval.likely_sources(answers, sources)
    assert [r.source_no for r in likely.collect()] == [1]
    assert retrieval.citation_state(answers, likely).first().state == "inferred"
    lines = spark.createDataFrame([(1, 1, "Contract_2 says so in clause 5."), (1, 2, "Nothing.")], "answer_id int, line_no int, text string")
    assert [(r.line_no, r.source_no) for r in retrieval.attach_citations(lines, sources).collect()] == [(1, 2)]


def test_links_in_lines(spark):
    sources = spark.createDataFrame(
        [
            (1, 4, "05_Loan_Delgado.pdf", "7", "CLAUSE SEVEN TERMINATION: The LENDER may terminate this agreement", []),
            (1, 9, "06_Farm_Whitaker.pdf", "7", "CLAUSE SEVEN DEFAULT: An installment not paid by December", []),
            (1, 20, "Contract_1.pdf", "7", "CLAUSE SEVEN TERMINATION: Breach of obligations results in termination", ["Contract_10.pdf", "Contract_3.pdf"]),
            (1, 21, "Contract_1.pdf", "2", "CLAUSE TWO TERM: The financing period shall be up to 60 months", ["Contract_10.pdf", "Contract_3.pdf"]),
        ],
        "answer_id int, source_no int, filename string, clause_id string, text string, also_files array<string>",
    )
    cases = [
        ("| Contract | Clause | Key points |", None), ("|---|---|---|", None),
        ("| 05_Loan_Delgado.pdf | Clause 7 - Termination | Lender may terminate. |", "| 05_Loan_Delgado.pdf | Clause 7 - Termination [Source 4](#source-4) | Lender may terminate. |"),
        ("| 06_Farm_Whitaker.pdf | Clause 7 - Default | Late interest. |", "| 06_Farm_Whitaker.pdf | Clause 7 - Default [Source 9](#source-9) | Late interest. |"),
        ("| Contract_3.pdf (and others) | Clause 2 - Term | Up to 60 months. |", "| Contract_3.pdf (and others) | Clause 2 - Term [Source 21](#source-21) | Up to 60 months. |"),
        ("In Contract_10 clause 7 says so.", "In Contract_10 clause 7 [Source 20](#source-20) says so."),
        ("05_Loan_Delgado.pdf allows the lender to go.", "05_Loan_Delgado.pdf [Source 4](#source-4) allows the lender to go."),
        ("Contract_1 ends on a breach, which results in termination.", "Contract_1 [Source 20](#source-20) ends on a breach, which results in termination."),
        ("Contract_12 clause 7 is another.", None), ("See [Source 4](#source-4) of 05_Loan_Delgado.", None), ("```", None), ("Contract_1 clause 7", None), ("```", None), ("Nothing.", None),
    ]
    lines = spark.createDataFrame([(1, k, t) for k, (t, _) in enumerate(cases)], "answer_id int, line_no int, text string")
    got = [r.text for r in retrieval.link_lines(lines, sources).orderBy("line_no").collect()]
    assert got == [after or before for before, after in cases]


def test_eval_cases(spark):
    cases = spark.createDataFrame([(1, "structured", ["45,892"]), (2, None, ["Park"]), (3, "semantic", ["TODO"]), (4, "semantic", ["x"])], "case_id int, expect_route string, expect_contains array<string>")
    answers = spark.createDataFrame([(1, "It is $45,892.00", "structured"), (2, "rachel park", "semantic"), (4, "x", "structured")], "case_id int, answer string, route string")
    assert {r.case_id: r.status for r in conv.evaluate(answers, cases).collect()} == {1: "pass", 2: "pass", 3: "skip", 4: "fail"}
