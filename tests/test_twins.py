"""Queries against their SQL twins on small tables with odd rows."""

import hashlib
import math
import re
import time
from collections import Counter

import duckdb
import numpy as np
from pyspark.sql import functions as F

from pactlake.functions import money
from pactlake.operators import facts, retrieval
from pactlake.plans import document_queries, reply_queries, view

QUERIES = document_queries.QUERIES | reply_queries.QUERIES
ORACLES = document_queries.ORACLES | reply_queries.ORACLES
CONVERSATIONS = "conv_id long, turn long, role string, text string"


def differences(spark, folder, name, **tables):
    """The rows that only the query, and that only its SQL twin gives of the tables, which are written to the folder."""
    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for table, frame in tables.items():
        frame.write.mode("overwrite").parquet(f"{folder}/{table}.parquet")
        c.sql(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    out = QUERIES[name](spark, str(folder))
    want = c.sql(ORACLES[name])
    columns = sorted(out.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(x) for x in columns]
    got, want = ([tuple(r[x] for x in columns) for r in out.collect()], [tuple(r[k] for k in at) for r in want.fetchall()])
    assert len(got) == len(want) > 0
    return set(got) - set(want), set(want) - set(got)


def test_answers_in_capitals(spark, tmp_path):
    """a letter whose capital Python writes as two, and a message without a text beside others."""
    texts = ["ß12", "straße und so", "ŉab", "ﬁnden", "ᾳbc", None, "", "abcd", "İıſ"]
    rows = spark.createDataFrame([(1, k, "user", t) for k, t in enumerate(texts)], CONVERSATIONS).coalesce(1)
    assert differences(spark, tmp_path, "ret_answer_with", conversations=rows) == (set(), set())


def test_focus_with_a_long_sentence(spark, tmp_path):
    """the sentence that shares most words is longer than the limit."""
    long = " ".join(f"alpha{k % 7} beta" for k in range(60))
    texts = [f"First of all. It begins so; {long}. And then it ends. Short again.", long, f"{long}. {long}", "plain", None, f"One alpha1 two. {'x' * 590}. {long}"]
    rows = spark.createDataFrame([(1, k, "user", t) for k, t in enumerate(texts)], CONVERSATIONS)
    assert differences(spark, tmp_path, "ret_focus", conversations=rows) == (set(), set())


def test_embedding_reads_a_text_once(spark):
    """words by their buckets in one pass over a text, not one for each bucket."""
    texts = [" ".join(f"w{(k * 31 + i * i) % 997}" for i in range(400)) for k in range(1200)] + ["", None, "?!", "Ab ab Kİ"]
    rows = spark.createDataFrame(list(enumerate(texts)), "passage_id int, text string").repartition(4)
    retrieval.embed_words(rows.limit(4)).collect()
    began = time.time()
    got = {r.passage_id: r.embedding for r in retrieval.embed_words(rows).collect()}
    assert time.time() - began < 8
    for k, t in enumerate(texts):
        words = re.findall("[a-z0-9]+", (t or "").lower())
        count = Counter(int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % 256 for w in words)
        size = math.sqrt(sum(n * n for n in count.values()))
        assert got[k] == [count[b] / size if size else 0.0 for b in range(256)]


def _talks(spark, n):
    """Conversations in few words, so that terms, wordings and scores often meet; some have many turns, or turns without a text."""
    words = ["rate", "rates", "1.4%", "the", "loan", "bank", "Äx", "pay.", "%", "penalty", "a"]
    say = lambda k, t: None if (k + t) % 23 == 0 else " ".join(words[(k * 7 + t * 3 + i * i) % len(words)].upper() if i % 3 else words[(k + i) % len(words)] for i in range(1 + (k * t) % 13))
    rows = [(k, t, "user" if t % 3 == 0 else "assistant", say(k, t)) for k in range(n) for t in range(30 if k % 10 == 3 else 5)]
    return spark.createDataFrame(rows, CONVERSATIONS)


def test_best_of_each_contract_against_sql(spark, tmp_path):
    """also scores that end in a half at the seventh decimal."""
    for name in ("ret_per_contract", "ret_per_contract_named", "ret_hybrid"):
        assert differences(spark, tmp_path / name, name, conversations=_talks(spark, 110)) == (set(), set())


def test_best_of_each_contract_moves_passages_once(spark):
    """300 questions to 1,500 contracts, of which one has 6,000 passages."""
    rows = [(k % 1500 if k < 6000 else 7, k, f"word{k % 91} word{k % 89} and word{k * k % 97} of {k}") for k in range(12_000)]
    passages = retrieval.embed_words(spark.createDataFrame(rows, "contract_id int, passage_id int, text string").repartition(4))
    asked = spark.createDataFrame([(k, f"what is word{k % 91} or word{k % 97}") for k in range(300)], "query_id int, text string")
    asked = retrieval.embed_words(asked, "query_id").withColumnRenamed("text", "question")
    began = time.time()
    out = retrieval.hybrid(passages, asked, per_contract=2)
    got = {(r.query_id, r.contract_id, r.place): r for r in out.where("contract_id in (7, 8)").collect()}
    assert time.time() - began < 60
    assert "Exchange hashpartitioning(query_id" not in out._jdf.queryExecution().toString()  # pairs move nowhere
    embedded = {r.passage_id: np.array(r.embedding) for r in passages.where("contract_id in (7, 8)").collect()}
    for q in asked.where("query_id % 60 = 7").collect():
        terms = [f"word{q.query_id % 91}", f"word{q.query_id % 97}"]
        for c in (7, 8):
            own = sorted((-round(float(embedded[p] @ np.array(q.embedding)), 9), p, t) for k, p, t in rows if k == c)[:8]
            best = sorted((-(-cos + min(0.3, 0.1 * len({w for w in terms if re.search(rf"\b{w}", t)}))), p) for cos, p, t in own)
            for place, (score, p) in enumerate(best[:2], 1):
                if score <= best[0][0] + 0.3:
                    assert got[q.query_id, c, place].passage_id == p and abs(got[q.query_id, c, place].score + score) < 1e-8


def test_contract_files_are_bounded(spark, tmp_path):
    """with more documents there are more files, as a task holds each of them whole."""
    docs = spark.range(20_000).selectExpr("id AS doc_id", "concat_ws('\\n', 'line', id % 7, repeat('é', id % 5), ' ', NULLIF(id % 3, 0)) AS text", "'en' AS lang", "'src1' AS source", "5 AS n_chars")
    assert differences(spark, tmp_path, "src_read_contracts", documents=docs) == (set(), set())
    assert len(QUERIES["src_read_contracts"](spark, str(tmp_path)).inputFiles()) >= 20


def test_grounding_works_each_value_out_once(spark):
    """an amount's number is read once and not wherever it is named, and a document meets its own facts only."""
    docs = spark.createDataFrame([(1, "LENDER: BANK OF X\nFINANCED AMOUNT: USD 1.203.432,50."), (1, "Pay 5 EUR to Some One"), (2, "US$ 1,20,000 or 9.00 CHF, Rs. 5 and 12 345,67 €")], "contract_id int, text string")
    model = spark.createDataFrame([(1, 5.0, "EUR", "Some One", "Bank of X", "2024-01-02", "soon"), (2, 12345.67, None, None, "x", None, None)], "contract_id int, contract_value double, currency string, customer_name string, lender_name string, start_date string, end_date string")
    got = sorted((r.contract_id, r.contract_value, r.customer_name or "", r.lender_name or "", len(r.extraction_warnings)) for r in facts.ground(model, docs).collect())
    assert got == [(1, 5.0, "Some One", "", 2), (1, 1203432.5, "", "BANK OF X", 2), (2, 12345.67, "", "", 1)]
    plan = docs.select(money.money_amounts(F.col("text")))._jdf.queryExecution().analyzed().toString()
    assert plan.count("regexp_replace") <= 4


def test_clauses_are_grouped_without_another_shuffle(spark, tiny):
    """what groups clauses by contract needs no exchange after the one that numbers them."""
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = view.clauses(spark, tiny).groupBy("contract_id").agg(F.max(F.struct("clause_id", "text")))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert plan.count("Exchange hashpartitioning(l_orderkey") == 1 and "Exchange hashpartitioning(contract_id" not in plan
