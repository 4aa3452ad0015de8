from pyspark.sql import functions as F

from pactlake.operators import facts, ingest, parsing

HEADER = "LOAN AGREEMENT\nBORROWER: Ann Lee, residing at 6 Hill Drive.\nLENDER: FIRST BANK OF NOWHERE Inc\nFINANCED AMOUNT: $45,892.00. "
BODY = [
    "CLAUSE ONE – PURPOSE: The lender grants the borrower a loan of the amount above, as per Clause Two below.",
    "CLAUSE TWO – TERM: The term is 36 months and starts on the date of signing by both parties.",
    "CLAUSE THREE – INTEREST: Interest is 1.2% a month on the balance that is outstanding.",
]
SIGNED = "\nIN WITNESS WHEREOF the parties sign.\n________\n"


def split(spark, text):
    docs = spark.createDataFrame([("c", text)], "contract_id string, text string")
    rows = parsing.split_document(docs).orderBy("clause_id").collect()
    return [r.text for r in rows if r.kind == "header"], [r.text for r in rows if r.kind == "clause"]


def test_split_by_lines_and_in_one_line(spark):
    for joint in ("\n\n", " "):
        header, clauses = split(spark, HEADER + joint + joint.join(BODY) + SIGNED)
        assert len(header) == 1 and "$45,892.00" in header[0]
        assert clauses == BODY


def test_split_without_header_numbered_and_titled(spark):
    header, clauses = split(spark, "\n".join(BODY))
    assert header == [] and len(clauses) == 3
    header, clauses = split(spark, "This preamble is long enough to keep.\n1. SERVICES AND FEES The provider shall do what the parties agreed upon.\n2. TERM OF CONTRACT It lasts for as long as the parties want it to.")
    assert len(clauses) == 2 and header == ["This preamble is long enough to keep."]
    _, clauses = split(spark, "Preamble text of some length.\n1. Services: Provider agrees to deliver all of the services.\n2. Fees: The client pays within thirty days of each invoice.")
    assert [c[:12] for c in clauses] == ["1. Services:", "2. Fees: The"]


def test_paragraphs_noise_and_repeats(spark):
    one = "The first paragraph of this text is long enough to be kept here."
    two = "The second paragraph of this text is also long enough to be kept."
    _, clauses = split(spark, f"{one}\n\n{two}\n\nService Agreement between two parties that say very little\n\n{one} \n\nshort")
    assert clauses == [one, two]
    assert split(spark, "") == ([], []) and split(spark, None) == ([], [])


def stripped(spark, pages):
    """Pages of one file without furniture; several files at once must not disturb each other."""
    rows = [(c, k, t) for c in ("x", "y") for k, t in enumerate(pages, 1)]
    out = parsing.strip_furniture(spark.createDataFrame(rows, "contract_id string, page_no int, text string")).orderBy("contract_id", "page_no").collect()
    assert [r.text for r in out[: len(pages)]] == [r.text for r in out[len(pages) :]]
    return [r.text for r in out[: len(pages)]]


def test_furniture(spark):
    pages = [f"ACME CONFIDENTIAL\nBody of page {k} goes on here.\n{k}  0{k}/2025  1,250.00\nPage {k} of 4" for k in range(1, 5)]
    out = stripped(spark, pages)
    assert sum("ACME CONFIDENTIAL" in p for p in out) == 1 and out[0].startswith("ACME")
    assert not any("of 4" in p for p in out) and all("1,250.00" in p for p in out)
    assert stripped(spark, ["7\ntext here"]) == ["7\ntext here"] and stripped(spark, ["- 1 -\ntext here"]) == ["text here"]
    assert stripped(spark, [None, ""]) == ["", ""]


def test_furniture_shapes(spark):
    """Page numbers before headers, deep stacks of furniture, numbers in the body, reprinted clauses, single pages, table rows."""
    body = ["CLAUSE ONE - PURPOSE: some text.", "CLAUSE TWO - TERM: other text.", "CLAUSE THREE - DEFAULT: last words."]
    pages = [f"Page {k}\nCONFIDENTIAL - BANK OF NOWHERE\n" + ("LOAN AGREEMENT\n" if k == 1 else "") + b for k, b in enumerate(body, 1)]
    assert stripped(spark, pages) == ["CONFIDENTIAL - BANK OF NOWHERE\nLOAN AGREEMENT\n" + body[0], *body[1:]]
    deep = [f"Agreement No. 12\nStrictly confidential\nInitials ____\nDraft copy\nPage {k}\n{b}\nmore text that ends here." for k, b in enumerate(body, 1)]
    # the fourth line is beyond the edge when running lines are looked for; the page number behind it is not
    assert stripped(spark, deep)[1:] == [f"Draft copy\n{b}\nmore text that ends here." for b in body[1:]]
    assert stripped(spark, ["LENDER: X\nSSN\n913053758\nmore\nbody\ntext\nhere\n2"]) == ["LENDER: X\nSSN\n913053758\nmore\nbody\ntext\nhere"]
    same = "AGREEMENT\n" + "\n".join(body)
    assert all(body[2] in p and body[0] in p for p in stripped(spark, [same] * 3))
    assert stripped(spark, ["Page 1\nCONFIDENTIAL\nFINANCING AGREEMENT\nBORROWER: Ann"]) == ["CONFIDENTIAL\nFINANCING AGREEMENT\nBORROWER: Ann"]
    rows = [f"Row {a} of table\nRow {a + 1} of table\nRow {a + 2} of table\nRow {a + 3} of table" for a in (1, 5, 9)]
    assert all(sum(x.startswith("Row") for x in p.split("\n")) >= 3 for p in stripped(spark, rows))


def test_pages_of_clauses(spark):
    clauses = spark.createDataFrame([("c", k + 1, t) for k, t in enumerate(BODY)], "contract_id string, clause_id int, text string")
    pages = spark.createDataFrame([("c", 1, HEADER), ("c", 2, BODY[0] + "\n" + BODY[1]), ("c", 3, BODY[2]), ("c", 4, BODY[0])], "contract_id string, page_no int, text string")
    assert [r.page for r in parsing.assign_pages(clauses, pages).orderBy("clause_id").collect()] == [2, 2, 3]
    assert [r.page for r in parsing.assign_pages(clauses, pages.limit(0)).orderBy("clause_id").collect()] == [1, 1, 1]


def test_labelled_facts(spark):
    rows = [("a", HEADER + "\n" + BODY[0]), ("b", "CLIENT: the client\nBANK: Mr. J. Miller, residing at X\nCONTRACT VALUE: EUR 45.892,00"), ("c", "nothing"), ("d", None)]
    got = {r.contract_id: r for r in facts.labelled_facts(spark.createDataFrame(rows, "contract_id string, text string")).collect()}
    assert (got["a"].contract_value, got["a"].currency, got["a"].customer_name, got["a"].lender_name) == (45892.0, "USD", "Ann Lee", "FIRST BANK OF NOWHERE Inc")
    assert (got["b"].contract_value, got["b"].currency, got["b"].customer_name, got["b"].lender_name) == (45892.0, "EUR", None, "Mr. J. Miller")
    assert got["c"].contract_value is None and got["d"].customer_name is None


def test_party_names(spark):
    cases = {
        "Sunrise Solar\nPrivate Limited\nMore text": "Sunrise Solar Private Limited", "Mr. J. P. Morgan, residing at X": "Mr. J. P. Morgan", "Acme Pvt. Ltd. of Boston": "Acme Pvt. Ltd", "Acme Inc. The rest": "Acme Inc",
        "Having Industries Ltd with seat": "Having Industries Ltd", "St. George Bank (the lender)": "St. George Bank", "Ann Lee\nBORROWER: Bob": "Ann Lee", "the borrower": None, "X": None, "Smith & Co; more": "Smith & Co",
    }
    rows = spark.createDataFrame([(k, f"LENDER: {t}") for k, t in enumerate(cases)], "contract_id int, text string")
    got = [r[0] for r in rows.orderBy("contract_id").select(facts.labelled_party(F.col("text"), "lender_name")).collect()]
    assert got == list(cases.values())


def test_replies(spark):
    rows = ['{"domain": "legal", "risk_level": "HIGH", "reasons": [" a ", ""], "key_metadata": {"x": 1, "y": null}}', '{"domain": "odd", "reasons": "only one"}', "{}", None]
    frame = spark.createDataFrame([(r,) for r in rows], "reply string")
    got = [r[0] and r[0].asDict() for r in frame.select(facts.normal_classification(F.col("reply"))).collect()]
    assert got[0] == {"domain": "Legal", "risk_level": "High", "reasons": ["a"], "key_metadata": {"x": "1"}}
    assert got[1]["domain"] == "Other" and got[1]["risk_level"] == "Low" and got[1]["reasons"] == ["only one"]
    assert len(got[2]["reasons"]) == 1 and got[3] is None
    docs = spark.createDataFrame([("a", "a.txt", HEADER), ("b", "b.txt", "Paid USD 5.00 and governed by the laws of Freedonia.")], "contract_id string, filename string, text string")

    def model(pdf):
        said = ['```json\n{"customer_name": "Ann Lee", "lender_name": "n/a", "contract_value": "$45,892", "ip_shared_with_customer": "Yes", "indemnification_strength": "strong"}\n```' if "a.txt" in p else "garbage" for p in pdf["prompt"]]
        return pdf.assign(reply=said)

    out = {r.contract_id: (r.extraction_method, r.facts) for r in facts.extract_with(docs, model).collect()}
    assert out["a"][0] == "llm" and out["a"][1].customer_name == "Ann Lee" and out["a"][1].lender_name is None and out["a"][1].contract_value == 45892.0
    assert out["a"][1].ip_shared_with_customer is True and out["a"][1].indemnification_strength == "Strong"
    assert out["b"][0] == "local_fallback" and out["b"][1].contract_value == 5.0 and out["b"][1].governing_law.startswith("Freedonia")


def test_rebuild_of_everything(spark):
    records = spark.createDataFrame([("a", "h1", "2024", "analyzed", "p"), ("b", "h1", "2025", "analyzed", "p"), ("c", "h2", "2024", "analyzed", None), ("d", "h3", "2024", "analyzed", None)], "contract_id string, content_hash string, updated_at string, status string, policy_id string")
    pages = spark.createDataFrame([("b", 1, HEADER + "\n\n".join(BODY)), ("c", 1, "\n\n".join(BODY)), ("d", 1, "x")], "contract_id string, page_no int, text string")
    stored = spark.createDataFrame([("c", k, t) for k, t in enumerate(BODY, 1)] + [("b", 1, "another text")], "contract_id string, clause_id int, text string")
    out = ingest.rebuild_all(records, pages, stored)
    assert {r.contract_id: r.outcome for r in out.outcome.collect()} == {"a": "duplicate", "b": "rebuilt", "c": "rebuilt", "d": "unreadable"}
    assert {r.contract_id: r.has_policy for r in out.due.collect()} == {"b": True}
    assert [r.contract_id for r in out.not_searchable.collect()] == ["d"]
    assert {(r.contract_id, r.passage_id) for r in out.passages.collect()} >= {("b", "header"), ("c", "3")} and out.passages.schema["embedding"]
    assert {r.contract_id: r.contract_value for r in out.facts.collect()}["b"] == 45892.0


def test_ground(spark):
    docs = spark.createDataFrame([("a", HEADER), ("b", "Paid to Ann Lee Jr: $10.00 in all.")], "contract_id string, text string")
    said = spark.createDataFrame([("a", 1.0, "EUR", "Bob", "X", "2024-01-01", "soon"), ("b", 10.0, "USD", "Ann Lee", "Y", None, None)], "contract_id string, contract_value double, currency string, customer_name string, lender_name string, start_date string, end_date string")
    got = {r.contract_id: r for r in facts.ground(said, docs).collect()}
    assert got["a"].contract_value == 45892.0 and got["a"].customer_name == "Ann Lee" and got["a"].start_date == "2024-01-01" and got["a"].end_date is None
    assert got["a"].field_sources["contract_value"] == "label" and any("end_date" in w for w in got["a"].extraction_warnings)
    assert got["b"].contract_value == 10.0 and got["b"].customer_name == "Ann Lee" and got["b"].lender_name is None and got["b"].field_sources["customer_name"] == "model"


def test_duplicates_and_rebuild(spark):
    records = spark.createDataFrame([("a", "h1", "2024"), ("b", "h1", "2025"), ("c", "h2", None), ("d", None, "2024"), ("e", None, "2024")], "contract_id string, content_hash string, updated_at string")
    assert {r.contract_id: r.keep for r in ingest.exact_duplicates(records).collect()} == {"a": False, "b": True, "c": True, "d": True, "e": True}
    pages = spark.createDataFrame([("b", 1, "\n\n".join(BODY)), ("c", 1, "short")], "contract_id string, page_no int, text string")
    got = {r.contract_id: (r.outcome, r.n_clauses) for r in ingest.rebuild(records, pages).collect()}
    assert got == {"a": ("duplicate", 0), "b": ("rebuilt", 3), "c": ("unreadable", 0), "d": ("unreadable", 0), "e": ("unreadable", 0)}


def test_listing_and_warnings(spark):
    files = spark.createDataFrame([("/x/a.pdf", 10), ("/x/a.pdf", 10), ("/x/.hid", 1), ("/x/b.docx", 5), ("/x/c.pdf", 60 << 20)], "path string, length long")
    assert {r.path: r.status for r in ingest.listing_status(files).collect()} == {"/x/a.pdf": "accepted", "/x/b.docx": "skipped", "/x/c.pdf": "skipped"}
    up = spark.createDataFrame([(None, False, True, None, None), ("k", True, False, "no engine", None)], "duplicate_of string, reprocessed boolean, coverage_ok boolean, ocr_error string, index_error string")
    assert [len(r[0]) for r in up.select(ingest.warnings()).collect()] == [0, 4]


def test_clause_by_number_and_locate(spark):
    docs = spark.createDataFrame([("c", HEADER + "\n\n".join(BODY))], "contract_id string, text string")
    wanted = spark.createDataFrame([("c", 2), ("c", 9)], "contract_id string, number int")
    assert [(r.number, r.clause_id) for r in parsing.clause_by_number(parsing.split_document(docs), wanted).collect()] == [(2, 2)]
    row = spark.createDataFrame([(HEADER + "\n" + BODY[1], BODY[1])], "p string, c string").select(parsing.locate(F.col("p"), F.col("c"))).first()
    assert row[0] > 50
