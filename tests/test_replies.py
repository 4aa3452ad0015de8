import json
import random
import time
import unicodedata

from pyspark.sql import functions as F

from pactlake.functions import replies, text
from pactlake.operators import facts, parsing, retrieval, routing
from pactlake.operators import portfolio as pf

WANTED = frozenset(["domain", "reasons"])
GOOD = {"domain": "Legal", "reasons": ["a {b} \"c\""]}


def test_objects_in_replies():
    body = json.dumps(GOOD)
    cases = [
        body, f"Sure, here {{it}} is: {body} and {{so}} on }}", f'He said "{{ {body}', json.dumps({"response": body}), json.dumps({"message": {"role": "assistant", "content": "```json\n" + body + "\n```"}}), json.dumps([{"domain": 1}, {"deep": {"data": GOOD}}]),
        json.dumps({"result": json.dumps({"output": body})}), "\n".join(json.dumps({"response": body[i : i + 3], "done": False}) for i in range(0, len(body), 3)), "\n".join(json.dumps({"message": {"content": body[i : i + 7]}}) for i in range(0, len(body), 7)),
        '{"domain": "none"} ' + body + ' {"domain": "later", "reasons": []}', f'{{"other": {{"x": {body}, "y": [1, 2', f"{{broken: }} {body}",
    ]
    assert [replies.find_object(c, WANTED) for c in cases] == [GOOD] * len(cases)
    for nothing in (None, "", "no object", '{"domain": 1}', '{"response": ""}', "[1, 2]", '"text"', "{" * 2000, "[" * 5000):
        assert replies.find_object(nothing, WANTED) is None
    assert list(replies.within('{"a": {"b": 1}} {')) == [{"a": {"b": 1}}, {"b": 1}]


def test_recover_object_in_columns(spark):
    rows = ["<think>{\"domain\": 0, \"reasons\": 0}</think>" + json.dumps(GOOD), None, "nothing"]
    got = [r[0] for r in spark.createDataFrame([(r,) for r in rows], "r string").select(text.recover_object(F.col("r"), ["domain", "reasons"])).collect()]
    assert json.loads(got[0]) == GOOD and got[1:] == [None, None]


def plain_focus(x, terms, limit):
    """All runs of sentences, tried one by one."""
    parts = replies._SENTENCE.split(x)
    score = lambda p: len({w.strip("%.") for w in replies._TERM.findall(p.lower())} & terms)
    runs = [(sum(map(score, parts[i:j])), sum(len(p) + 1 for p in parts[i:j]), -i, j) for i in range(len(parts)) for j in range(i + 1, len(parts) + 1) if sum(len(p) + 1 for p in parts[i:j]) <= limit + 1]
    _, _, lo, hi = max(runs)
    return ("… " if lo else "") + " ".join(parts[-lo:hi]) + (" …" if hi < len(parts) else "")


def test_focus_of_sentences_and_words():
    rng = random.Random(4)
    for _ in range(200):
        x = " ".join(" ".join(rng.choice(["rate", "loan", "of", "bank", "x", "2%"]) for _ in range(rng.randrange(1, 6))) + rng.choice(".;:") for _ in range(rng.randrange(2, 14)))
        limit = rng.randrange(30, 90)
        if len(x) > limit:
            assert replies.focus_of(x, frozenset(["rate", "bank"]), limit) == plain_focus(x, frozenset(["rate", "bank"]), limit)
    words = ["word"] * 3000 + ["penalty", "word", "rate"] + ["word"] * 50 + ["rate"] + ["word"] * 3000
    got = replies.focus_of(" ".join(words), frozenset(["penalty", "rate"]), 100)
    assert "penalty word rate" in got and len(got) <= 104


def test_focus_takes_linear_time(spark):
    rng = random.Random(1)
    names = [f"w{k}" for k in range(300)]
    sentences = " ".join(rng.choice(names) + rng.choice(["", "", "."]) for _ in range(100_000))
    one = " ".join(rng.choice(names) for _ in range(100_000))
    began = time.time()
    for x in (sentences, one):
        assert len(replies.focus_of(x, frozenset(names[:50]), 600)) <= 604
    assert time.time() - began < 5
    rows = spark.createDataFrame([(sentences, "what is w1 and w2"), (None, None)], "text string, question string")
    got = [r.focus for r in retrieval.focus(rows, 300).collect()]
    assert 0 < len(got[0]) <= 304 and got[1] == ""


def test_pages_of_a_long_contract(spark):
    """A contract of 5,000 pages, many of which open alike, in linear work."""
    opening = lambda k: f"Clause {k} - Duties: the parties number {k * 7919 % 10_007} agree that all of this holds for the years to come"
    pages = [(1, p, " ".join(["Common words of the agreement between both."] * 3 + [opening(3 * p + i) + " and more text follows here." for i in range(3)])) for p in range(1, 5001)]
    clauses = [(1, k, opening(k) + " and more text") for k in range(3, 15_003, 5)]
    extra = [(2, 1, "nowhere to be found in any page at all"), (2, 2, "short"), (2, 3, None), (2, 4, "Unbrokenopeningwithoutanyspaceuntilhere and then some words")]
    pages2 = [(2, 1, "nothing"), (2, 7, "xx Unbrokenopeningwithoutanyspaceuntilhere and then some words")]
    schema = "contract_id int, clause_id int, text string"
    began = time.time()
    out = parsing.assign_pages(spark.createDataFrame(clauses + extra, schema), spark.createDataFrame(pages + pages2, "contract_id int, page_no int, text string"))
    got = {(r.contract_id, r.clause_id): r.page for r in out.collect()}
    assert time.time() - began < 60
    assert {k: v for k, v in got.items() if k[0] == 1} == {(1, k): k // 3 for _, k, _ in clauses}
    assert {k[1]: v for k, v in got.items() if k[0] == 2} == {1: 1, 2: 1, 3: 1, 4: 7}


def plain_pages(clauses, pages):
    """The rule tried on every page."""
    low = lambda x: " ".join((x or "").split()).lower()
    page, out = 1, {}
    for k, x in sorted(clauses):
        for n, least in ((80, 20), (30, 12)):
            head = low(x)[:n]
            at = sorted(p for p, t in pages if len(head) >= least and head in low(t))
            if at:
                page = next((p for p in at if p >= page), at[0])
                break
        out[k] = page
    return out


def test_pages_against_the_plain_rule(spark):
    rng = random.Random(9)
    words = ["loan", "the bank", "shall", "borrowerandlenderjointly", "pay", "interest", "of 2%", "Ä", "clause"]
    pages = [(p, " ".join(rng.choice(words) for _ in range(40))) for p in range(1, 30)]
    clauses = []
    for k in range(120):
        t = rng.choice(pages)[1]
        i = rng.randrange(len(t) - 5)
        clauses.append((k, t[i : i + rng.choice([5, 12, 15, 29, 35, 90, 120])].upper() if k % 7 else "not in there at all, really"))
    frame = spark.createDataFrame([(1, k, x) for k, x in clauses], "contract_id int, clause_id int, text string")
    got = {r.clause_id: r.page for r in parsing.assign_pages(frame, spark.createDataFrame([(1, p, t) for p, t in pages], "contract_id int, page_no int, text string")).collect()}
    assert got == plain_pages(clauses, pages)


def test_locating_in_compatibility_forms(spark):
    page = "1. First words. The ﬁnancial oﬃce pays １２３４５ for the café in Zürich №7 each year, Straße and ½ more"
    clause = unicodedata.normalize("NFD", "The financial office pays 12345 for the café in Zürich no7")
    row = spark.createDataFrame([(page, clause), (page, None), (None, clause), ("abc", "xyz" * 10)], "p string, c string").select(parsing.locate(F.col("p"), F.col("c")).alias("at")).collect()
    assert row[0].at == len("1firstwords") + 1 and [r.at for r in row[1:]] == [0, 0, 0]


def test_replies_of_a_router(spark):
    rows = [
        '{"kind":"structured","operation":"list","sort_by":"contract_value","order":"asc","limit":1}',
        'Here: {"kind":"structured","operation":"count","filters":[{"field":"lender_name","op":"contains","value":"financial bank of america"}],"limit":null}',
        '{"kind":"structured","sort_by":"end_date","order":"asc","filters":[{"field":"end_date","op":"before","value":"2027"}],"fields":["end_date","age",1],"contracts":["  ","Contract_3"]}',
        '{"kind":"structured","sort_by":"age","order":"up","limit":0,"offset":"x","filters":[{"field":"age","op":"equals"},{"field":"end_date","op":"near","value":"1"},{"field":"end_date","op":"after","value":"soon"},{"op":"equals"}]}',
        '{"kind":"semantic","across_contracts":true,"standalone_question":" What? "}', '{"kind":"odd"}', "no idea", None, '{"kind":"structured","operation":"group","group_by":"lender_name","limit":2}', '{"kind":"structured","operation":"group"}', '{"kind":"structured","filters":{"field":"end_date"}}', '{"kind":"structured","operation":"sum"}',
    ]
    compiled = spark.createDataFrame(list(enumerate(rows)), "query_id int, reply string").select("query_id", routing.compile_reply(F.col("reply")).alias("r"))
    got = {r.query_id: r.r for r in compiled.collect()}
    assert got[0].spec.limit == 1 and got[0].spec.order == "asc" and got[0].problems == []
    assert got[1].spec.filters[0].op == "contains" and got[1].spec.limit is None
    assert got[2].spec.fields == ["end_date"] and got[2].contracts == ["Contract_3"]
    assert got[3].kind is None and len(got[3].problems) == 8
    assert got[4].kind == "semantic" and got[4].spec is None and got[4].across_contracts and got[4].standalone_question == "What?"
    assert [got[k].kind for k in (5, 6, 7, 9, 10)] == [None] * 5 and all(got[k].problems for k in (5, 6, 7, 9, 10))
    data = [(1, "Contract_1.pdf", 82437.0, "X", None), (2, "Contract_12.pdf", 1203432.0, "Carlos Brown", "2027-03-01"), (3, "Contract_3.pdf", 75546.0, "X", "2026-01-10"), (4, "Contract_31.pdf", 76877.0, "X", None), (5, "Contract_5.pdf", 45892.0, "Julia Miller", None), (6, "test.txt", None, "X", None)]
    contracts = spark.createDataFrame([(i, f, v, c, e, "USD", "FINANCIAL BANK OF AMERICA Inc" if i < 6 else None) for i, f, v, c, e in data], "contract_id int, filename string, contract_value double, customer_name string, end_date string, currency string, lender_name string")
    asked = compiled.select("query_id", "r.spec")
    listed = routing.run_compiled(asked, contracts)
    assert sorted((r.query_id, r.filename) for r in listed.collect()) == [(0, "Contract_5.pdf"), (2, "Contract_3.pdf")]
    assert [(r.query_id, r.n) for r in routing.run_compiled(asked, contracts, "count").collect()] == [(1, 5)]
    assert [(r.query_id, float(r.total)) for r in routing.run_compiled(asked, contracts, "sum").collect()] == [(11, 1484184.0)]
    assert [(r.query_id, r.key, r.n) for r in routing.run_compiled(asked, contracts, "group").collect()] == [(8, "financial bank of america inc", 5)]
    assert routing.run_compiled(asked.limit(0), contracts) is None and isinstance(routing.specs(asked)[0][1], pf.Spec)


def test_routing_with_a_model(spark):
    turns = spark.createDataFrame([(1, 0, "user", "How many?"), (1, 1, "assistant", "5."), (1, 2, "user", "and the highest?"), (2, 0, "user", "fail")], "conv_id int, turn int, role string, text string")

    def model(pdf):
        if pdf["prompt"].str.contains("fail").any():
            raise RuntimeError("down")
        return pdf.assign(reply=['{"kind":"structured","sort_by":"contract_value","limit":1}' if "highest" in p and "How many?" in p else '{"kind":"structured","operation":"count"}' for p in pdf["prompt"]])

    got = {(r.conv_id, r.turn): (r.route, r.routed.spec) for r in routing.route_with(turns.where("conv_id = 1"), model).collect()}
    assert got[1, 0][1].operation == "count" and got[1, 2][1].sort_by == "contract_value"
    assert [r.route for r in routing.route_with(turns.where("conv_id = 2"), model).collect()] == ["semantic"]


def test_facts_by_plain_patterns(spark):
    rows = [
        'Between Bank Of America Inc. (the "BANK") and Customer: Ann Lee, of here. Effective date: 01/02/2024 and valid until 2026-05-01. Paid Rs. 5,000.50. Intellectual property: it retains all right. They indemnify as-is. Governed by the laws of Freedonia.',
        "LENDER: First Bank Ltd, Client - Bob O'Neil. Start date is March 3, 2024; expiration 4-5-25. GBP 10. IP shall belong to Customer. We indemnify you.", "Nothing is said.", None,
    ]
    got = [r.asDict() for r in facts.fallback_facts(spark.createDataFrame(list(enumerate(rows)), "contract_id int, text string")).orderBy("contract_id").collect()]
    assert got[0] == {"contract_id": 0, "customer_name": "Ann Lee", "lender_name": "Bank Of America Inc", "start_date": "01/02/2024", "end_date": "2026-05-01", "governing_law": "Freedonia", "ip_shared_with_customer": False, "indemnification_clause_present": True, "indemnification_strength": "Weak", "contract_value": 5000.5, "currency": "INR"}
    assert got[1] == {"contract_id": 1, "customer_name": "Bob O'Neil", "lender_name": "First Bank Ltd", "start_date": "March 3, 2024", "end_date": "4-5-25", "governing_law": None, "ip_shared_with_customer": True, "indemnification_clause_present": True, "indemnification_strength": "Standard", "contract_value": 10.0, "currency": "GBP"}
    for r in got[2:]:
        assert not r.pop("indemnification_clause_present") and all(v is None for k, v in r.items() if k != "contract_id")
