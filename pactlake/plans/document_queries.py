"""Registered queries on parsing, facts, ingest, retrieval, routing and streams, with their SQL twins."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import conversations, facts, ingest, parsing, policy, retrieval, routing, vector_index
from ..streaming import streams
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


# ------------------------------------------------------------- contracts as text and back


def rendered(spark: SparkSession, d: str) -> DataFrame:
    """contract_id and text of each contract, as a document with a header and numbered clauses."""
    c = view.contracts(spark, d)
    head = F.concat(
        F.lit("LOAN AGREEMENT\nBORROWER: "), "customer_name", F.lit(", residing at 1 Main Street.\nLENDER: "), F.coalesce("lender_name", F.lit("BANK OF NOWHERE")),
        F.lit("\nFINANCED AMOUNT: USD "), F.format_number(F.coalesce("contract_value", F.lit(1.0)), 2), F.lit(".\n\n"),
    )
    line = F.concat(F.lit("CLAUSE "), F.col("clause_id").cast("string"), F.lit(" - Terms: "), F.col("text"))
    body = view.clauses(spark, d).groupBy("contract_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("clause_id", line.alias("t")))), lambda x: x["t"]), "\n\n").alias("body"))
    return c.join(body, "contract_id").select("contract_id", F.concat(head, "body").alias("text"))


@query("WITH " + CLAUSES_SQL + " SELECT contract_id, clause_id, 'CLAUSE ' || clause_id || ' - Terms: ' || text AS text FROM clauses")
def par_split(spark: SparkSession, d: str) -> DataFrame:
    return parsing.split_document(rendered(spark, d)).where("kind = 'clause'").select("contract_id", "clause_id", "text")


@query("WITH " + CONTRACTS_SQL + " SELECT contract_id, 'LOAN AGREEMENT BORROWER: ' || customer_name || ', residing at 1 Main Street. LENDER: ' || coalesce(lender_name, 'BANK OF NOWHERE') || ' FINANCED AMOUNT: USD ' || format('{:,.2f}', coalesce(contract_value, 1.0)) || '.' AS text FROM contracts WHERE status = 'analyzed'")
def par_header(spark: SparkSession, d: str) -> DataFrame:
    return parsing.split_document(rendered(spark, d)).where("kind = 'header'").select("contract_id", "text")


@query("WITH " + CONTRACTS_SQL + " SELECT contract_id, coalesce(contract_value, 1.0) AS contract_value, 'USD' AS currency, customer_name, coalesce(lender_name, 'BANK OF NOWHERE') AS lender_name FROM contracts WHERE status = 'analyzed'")
def fct_labelled(spark: SparkSession, d: str) -> DataFrame:
    return facts.labelled_facts(rendered(spark, d)).select("contract_id", "contract_value", "currency", "customer_name", "lender_name")


@query("WITH " + CONTRACTS_SQL + " SELECT contract_id, coalesce(contract_value, 1.0) AS contract_value, 'label' AS value_from, customer_name, start_date, CASE WHEN contract_id % 2 = 0 THEN 1 ELSE 0 END AS n_warnings FROM contracts WHERE status = 'analyzed'")
def fct_ground(spark: SparkSession, d: str) -> DataFrame:
    said = view.contracts(spark, d).select("contract_id", F.lit(123456789.5).alias("contract_value"), F.lit("EUR").alias("currency"), "customer_name", F.lit("Invented Lender").alias("lender_name"), "start_date", F.when(F.col("contract_id") % 2 == 0, "next year").alias("end_date"))
    out = facts.ground(said, rendered(spark, d))
    return out.select("contract_id", "contract_value", F.try_element_at("field_sources", F.lit("contract_value")).alias("value_from"), "customer_name", "start_date", F.size("extraction_warnings").alias("n_warnings"))


@query("WITH " + CLAUSES_SQL + " SELECT contract_id, clause_id, 1 + clause_id // 3 AS page FROM clauses")
def par_assign_pages(spark: SparkSession, d: str) -> DataFrame:
    named = view.clauses(spark, d).withColumn("text", F.concat(F.lit("CLAUSE "), F.col("clause_id").cast("string"), F.lit(" - Terms: "), F.col("text")))
    pages = named.groupBy("contract_id", (1 + F.floor(F.col("clause_id") / 3)).cast("int").alias("page_no")).agg(F.array_join(F.collect_list("text"), "\n").alias("text"))
    return parsing.assign_pages(named, pages).select("contract_id", "clause_id", F.col("page").alias("page"))


_PER_PAGE = 3
_NUMBERED_SQL = "CASE contract_id % 4 WHEN 0 THEN 'Page ' || page_no || ' of ' || n WHEN 1 THEN '- ' || page_no || ' -' WHEN 2 THEN page_no::VARCHAR ELSE page_no || '/' || n END"


@query("WITH " + CLAUSES_SQL + f", p AS (SELECT contract_id, 1 + (clause_id - 1) // {_PER_PAGE} AS page_no, string_agg(text, chr(10) ORDER BY clause_id) AS body FROM clauses GROUP BY 1, 2) SELECT contract_id, page_no::INT AS page_no, CASE WHEN page_no = 1 THEN 'Loan agreement no. ' || contract_id || ', confidential' || chr(10) ELSE '' END || body AS text FROM p")
def par_furniture(spark: SparkSession, d: str) -> DataFrame:
    """Each contract's clauses, three to a page, with a header and a page number in one of four forms, at the top or at the bottom."""
    own = view.clauses(spark, d).withColumn("page_no", (1 + F.floor((F.col("clause_id") - 1) / _PER_PAGE)).cast("int"))
    body = own.groupBy("contract_id", "page_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("clause_id", "text"))), lambda x: x["text"]), "\n").alias("body"))
    pages = body.join(own.groupBy("contract_id").agg(F.max("page_no").cast("string").alias("n")), "contract_id")
    no, kind = F.col("page_no").cast("string"), F.col("contract_id") % 4
    number = F.when(kind == 0, F.concat(F.lit("Page "), no, F.lit(" of "), "n")).when(kind == 1, F.concat(F.lit("- "), no, F.lit(" -"))).when(kind == 2, no).otherwise(F.concat(no, F.lit("/"), "n"))
    header = F.concat(F.lit("Loan agreement no. "), F.col("contract_id").cast("string"), F.lit(", confidential"))
    top = F.col("contract_id") % 3 == 0
    return parsing.strip_furniture(pages.select("contract_id", "page_no", F.concat_ws("\n", F.when(top, number), header, "body", F.when(~top, number)).alias("text")))


# ------------------------------------------------------------- parsing over documents

_LINES_SQL = "lines AS (SELECT doc_id, i AS pos, l[i] AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents) d, LATERAL (SELECT unnest(range(1, len(d.l) + 1)) AS i))"


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("contract_id"), F.posexplode(F.split("text", "\n")).alias("pos", "text")).withColumn("pos", F.col("pos") + 1)


@query("WITH " + _LINES_SQL + r", k AS (SELECT *, substr(lower(trim(regexp_replace(text, '\s+', ' ', 'g'))), 1, 80) AS k FROM lines), f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, k ORDER BY pos) AS n FROM k) WHERE n = 1) SELECT doc_id, pos, row_number() OVER (PARTITION BY doc_id ORDER BY pos)::INT AS clause_id FROM f")
def par_dedup(spark: SparkSession, d: str) -> DataFrame:
    return parsing.dedup_clauses(_lines(spark, d)).select(F.col("contract_id").alias("doc_id"), F.col("pos").cast("long").alias("pos"), "clause_id")


@query("SELECT doc_id, length(regexp_replace(text, '[^A-Za-z0-9]', '', 'g')) < 80 AS scanned FROM documents")
def src_scanned_pages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", parsing.looks_scanned(F.col("text")).alias("scanned"))


_ALNUM = "length(regexp_replace({}, '[^A-Za-z0-9]', '', 'g'))"
_OCR_SQL = f"""read AS (SELECT doc_id AS contract_id, text AS ocr, CASE WHEN doc_id % 3 = 0 THEN regexp_replace(text, '[A-Za-z0-9]', '', 'g') ELSE text END AS text FROM documents),
 merged AS (SELECT contract_id, coalesce(contract_id % 2 = 0 AND {_ALNUM.format("text")} < 80 AND {_ALNUM.format("ocr")} > {_ALNUM.format("text")}, false) AS ocr_used, ocr, text FROM read)"""


def _merged(spark: SparkSession, d: str) -> DataFrame:
    """Each document as a page, every third without its letters, and a reading of every second by OCR."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("contract_id"), F.lit(1).alias("page_no"), "text")
    lost = docs.withColumn("text", F.when(F.col("contract_id") % 3 == 0, F.regexp_replace("text", "[A-Za-z0-9]", "")).otherwise(F.col("text")))
    return parsing.merge_ocr(lost, docs.where("contract_id % 2 = 0"))


@query("WITH " + _OCR_SQL + " SELECT contract_id, md5(CASE WHEN ocr_used THEN ocr ELSE text END) AS text, ocr_used FROM merged")
def src_merge_ocr(spark: SparkSession, d: str) -> DataFrame:
    return _merged(spark, d).select("contract_id", F.md5(F.col("text").cast("binary")).alias("text"), F.coalesce("ocr_used", F.lit(False)).alias("ocr_used"))


@query("WITH " + _OCR_SQL + " SELECT contract_id, ocr_used AS used, ocr_used::BIGINT AS pages, CASE WHEN ocr_used THEN length(ocr) ELSE 0 END::BIGINT AS characters FROM merged")
def src_ocr_summary(spark: SparkSession, d: str) -> DataFrame:
    return parsing.ocr_summary(_merged(spark, d))


@query("SELECT doc_id AS contract_id, replace(text, chr(10), chr(10) || chr(10)) AS text FROM documents")
def par_join_pages(spark: SparkSession, d: str) -> DataFrame:
    return parsing.join_pages(_lines(spark, d).select("contract_id", F.col("pos").alias("page_no"), "text"))


_OWN, _KEPT = (f"list_distinct(regexp_extract_all(lower({x}), '[a-z0-9]{{3,}}'))" for x in ("text", "regexp_replace(text, '[A-Za-z0-9]*t[ie][A-Za-z0-9]*', ' ', 'g')"))


@query(f"WITH o AS (SELECT doc_id, unnest({_OWN}) AS w FROM documents), k AS (SELECT doc_id, unnest({_KEPT}) AS w FROM documents), n AS (SELECT doc_id, count(*) AS n FROM o GROUP BY 1), m AS (SELECT doc_id, count(*) AS m, array_to_string(list_slice(list(w ORDER BY w), 1, 20), ',') AS missing FROM o ANTI JOIN k ON o.doc_id = k.doc_id AND o.w = k.w GROUP BY 1), r AS (SELECT doc_id, 1 - coalesce(m::DOUBLE / n, 0) AS r, coalesce(missing, '') AS missing FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)) SELECT doc_id, round(r, 3) AS ratio, r >= 0.95 AS ok, missing FROM r")
def par_coverage(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("contract_id"), "text")
    out = parsing.coverage(docs, docs.withColumn("text", F.regexp_replace("text", "[A-Za-z0-9]*t[ie][A-Za-z0-9]*", " ")))  # words that a splitter lost
    return out.select(F.col("contract_id").alias("doc_id"), "ratio", "ok", F.array_join("missing_sample", ",").alias("missing"))


@query("WITH " + CLAUSES_SQL + ", f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY contract_id, substr(lower(text), 1, 80) ORDER BY clause_id) AS n FROM clauses) WHERE n = 1) SELECT contract_id, (row_number() OVER (PARTITION BY contract_id ORDER BY clause_id))::INT AS clause_id, text FROM f")
def par_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """Contracts without headings: paragraphs, among short ones and noise, some of them twice."""
    body = view.clauses(spark, d).groupBy("contract_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("clause_id", "text"))), lambda x: x["text"]).alias("t"))
    noise = F.array(F.lit("Service Agreement between parties that say very little about it here"), F.lit("Too short."), F.lit("Signed by the parties at the place that is named further above"))
    return parsing.split_document(body.select("contract_id", F.array_join(F.concat(noise, "t", noise), "\n\n").alias("text"))).select("contract_id", "clause_id", "text")


@query("WITH " + CLAUSES_SQL + " SELECT contract_id, clause_id, 'CLAUSE ' || clause_id || ' - Terms: ' || text AS text FROM clauses")
def par_signature(spark: SparkSession, d: str) -> DataFrame:
    """Contracts that end in a signature block."""
    form = F.element_at(F.array(F.lit("\nIN WITNESS WHEREOF the parties sign below.\n________\n"), F.lit("\nSigned at Springfield\nBy: ____"), F.lit("\n__________\nthe borrower")), (F.col("contract_id") % 3 + 1).cast("int"))
    return parsing.split_document(rendered(spark, d).withColumn("text", F.concat("text", form))).where("kind = 'clause'").select("contract_id", "clause_id", "text")


@query("WITH " + CLAUSES_SQL + " SELECT contract_id, clause_id, CASE WHEN clause_id = 6 THEN '6' ELSE clause_id || ',6' END AS numbers FROM clauses")
def par_clause_numbers(spark: SparkSession, d: str) -> DataFrame:
    said = F.concat(F.lit("See clauses "), F.col("clause_id").cast("string"), F.lit(" and Six of it, and section "), F.col("clause_id").cast("string"))
    return view.clauses(spark, d).select("contract_id", "clause_id", F.array_join(F.transform(tx.clause_numbers(said), lambda n: n.cast("string")), ",").alias("numbers"))


@query("WITH " + CLAUSES_SQL + " SELECT contract_id, clause_id AS number, clause_id FROM clauses")
def par_clause_by_number(spark: SparkSession, d: str) -> DataFrame:
    """Every clause by its number: the first two have headings with it, the others are known by their id only."""
    c = view.clauses(spark, d).withColumn("kind", F.lit("clause"))
    headed = c.withColumn("text", F.when(F.col("clause_id") == 1, F.concat(F.lit("CLAUSE ONE - "), "text")).when(F.col("clause_id") == 2, F.concat(F.lit("2. "), "text")).otherwise(F.col("text")))
    return parsing.clause_by_number(headed, c.select("contract_id", F.col("clause_id").alias("number"))).select("contract_id", "number", "clause_id")


_COMPACT = "regexp_replace(lower({}), '[^a-z0-9]', '', 'g')"


@query("WITH " + CLAUSES_SQL + f", p AS (SELECT contract_id, string_agg(text, ' ' ORDER BY clause_id) AS page FROM clauses GROUP BY 1) SELECT contract_id, clause_id, instr({_COMPACT.format('page')}, substr({_COMPACT.format('text')}, 1, 40))::INT AS at FROM clauses JOIN p USING (contract_id)")
def par_locate(spark: SparkSession, d: str) -> DataFrame:
    c = view.clauses(spark, d)
    page = c.groupBy("contract_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("clause_id", "text"))), lambda x: x["text"]), " ").alias("page"))
    return c.join(page, "contract_id").select("contract_id", "clause_id", parsing.locate(F.col("page"), F.col("text")).cast("int").alias("at"))


# ------------------------------------------------------------- ingest


@query("SELECT doc_id AS contract_id, sha256(text) AS content_hash FROM documents")
def ing_content_hash(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("contract_id"), ingest.content_hash(F.col("text").cast("binary")).alias("content_hash"))


@query("WITH " + CONTRACTS_SQL + " SELECT contract_id, coalesce(updated_at, created_at, '') AS \"at\" FROM contracts")
def qry_listing(spark: SparkSession, d: str) -> DataFrame:
    return ingest.newest_first(view.contracts(spark, d)).select("contract_id", F.coalesce("updated_at", "created_at", F.lit("")).alias("at"))


_RECORDS = r"records AS (SELECT doc_id AS contract_id, md5(lower(trim(regexp_replace(text, '\s+', ' ', 'g')))) AS content_hash, source AS updated_at, lang FROM documents)"


def _records(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("contract_id"), F.md5(F.lower(tx.squeeze(F.col("text"))).cast("binary")).alias("content_hash"), F.col("source").alias("updated_at"), "lang")


@query("WITH " + _RECORDS + ", k AS (SELECT content_hash, first(contract_id ORDER BY updated_at DESC, contract_id) AS kept_id FROM records GROUP BY 1) SELECT contract_id, kept_id, contract_id = kept_id AS keep FROM records JOIN k USING (content_hash)")
def ing_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return ingest.exact_duplicates(_records(spark, d)).select("contract_id", "kept_id", "keep")


@query("WITH " + _RECORDS + ", s AS (SELECT content_hash, min(contract_id) AS contract_id FROM records WHERE contract_id % 2 = 0 GROUP BY 1), b AS (SELECT * FROM records WHERE contract_id % 2 = 1) SELECT b.contract_id AS arrival, s.contract_id AS duplicate_of, b.contract_id = min(b.contract_id) OVER (PARTITION BY b.content_hash) AS first_copy FROM b LEFT JOIN s ON b.content_hash = s.content_hash")
def ing_match_stored(spark: SparkSession, d: str) -> DataFrame:
    r = _records(spark, d).withColumn("filename", F.concat(F.lit("f"), F.col("contract_id").cast("string")))
    out = ingest.match_stored(r.where("contract_id % 2 = 1").withColumnRenamed("contract_id", "arrival"), r.where("contract_id % 2 = 0"))
    return out.select("arrival", "duplicate_of", "first_copy")


@query("SELECT DISTINCT l_orderkey AS contract_id, CASE WHEN l_orderkey % 11 = 0 THEN 'added' WHEN l_orderkey % 7 = 0 THEN 'removed' WHEN l_orderkey % 5 = 0 THEN 'changed' ELSE 'same' END AS change FROM lineitem")
def ing_changes(spark: SparkSession, d: str) -> DataFrame:
    old = view.clauses(spark, d)
    new = old.where("contract_id % 7 <> 0 or contract_id % 11 = 0").withColumn("text", F.when((F.col("contract_id") % 5 == 0) & (F.col("clause_id") == 1), F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return ingest.changes(old.where("contract_id % 11 <> 0"), new)


@query("SELECT lang, count(*) AS n, count(*) FILTER (fresh) AS n_new FROM (SELECT lang, doc_id % 3 = 0 AS fresh FROM documents) GROUP BY 1")
def ing_upsert(spark: SparkSession, d: str) -> DataFrame:
    r = _records(spark, d).withColumn("fresh", F.lit(False))
    out = ingest.upsert(r, r.where("contract_id % 3 = 0").withColumn("fresh", F.lit(True)))
    return out.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count_if("fresh").alias("n_new"))


@query("SELECT doc_id AS contract_id FROM documents WHERE source <> 'src1'")
def ing_delete(spark: SparkSession, d: str) -> DataFrame:
    r = _records(spark, d)
    return ingest.delete(r, r.where("updated_at = 'src1'").select("contract_id")).select("contract_id")


@query("WITH " + CONTRACTS_SQL + " SELECT contract_id, contract_id % 4 = 0 AS has_policy FROM contracts WHERE contract_id % 5 = 0 OR status <> 'analyzed'")
def ing_due(spark: SparkSession, d: str) -> DataFrame:
    c = view.contracts(spark, d).withColumn("policy_id", F.when(F.col("contract_id") % 4 == 0, "default"))
    return ingest.due_for_analysis(c, c.select("contract_id", F.when(F.col("contract_id") % 5 == 0, "changed").otherwise("same").alias("change")))


@query("WITH " + CONTRACTS_SQL + " SELECT contract_id, CASE WHEN contract_id % 2 = 0 THEN 'skipped' WHEN contract_id % 3 = 0 THEN 'failed' ELSE 'updated' END AS outcome FROM contracts")
def ing_backfill(spark: SparkSession, d: str) -> DataFrame:
    c = view.contracts(spark, d).withColumn("contract_about", F.when(F.col("contract_id") % 2 == 0, "loan"))
    return ingest.backfill(c, c.where("contract_id % 3 <> 0"))


@query("WITH " + CONTRACTS_SQL + " SELECT status, count(*) AS n, array_to_string(list_slice(list(DISTINCT filename ORDER BY filename), 1, 20), ',') AS some FROM contracts GROUP BY 1")
def ing_outcome(spark: SparkSession, d: str) -> DataFrame:
    return ingest.outcome(view.contracts(spark, d)).select("status", "n", F.array_join("some", ",").alias("some"))


@query("WITH " + CONTRACTS_SQL + " SELECT contract_id, CASE WHEN contract_id % 5 = 0 THEN 'uploaded' ELSE status END AS status FROM contracts")
def ing_reset_changed(spark: SparkSession, d: str) -> DataFrame:
    c = view.contracts(spark, d)
    return ingest.reset_changed(c, c.where("contract_id % 5 = 0").select("contract_id", F.lit("changed").alias("change"))).select("contract_id", "status")


@query("WITH " + CONTRACTS_SQL + " SELECT contract_id, CASE WHEN contract_id % 2 = 0 THEN contract_value ELSE 1.0 END AS contract_value, contract_id % 2 = 0 AS kept FROM contracts")
def ing_keep_better(spark: SparkSession, d: str) -> DataFrame:
    c = view.contracts(spark, d)
    old = c.select("contract_id", "contract_value", F.when(F.col("contract_id") % 2 == 0, "llm").otherwise("fallback").alias("extraction_method"))
    new = c.select("contract_id", F.lit(1.0).alias("contract_value"), F.lit("fallback").alias("extraction_method"))
    out = ingest.keep_better_extraction(old, new, ["contract_value"])
    return out.select("contract_id", "contract_value", (F.size("extraction_warnings") > 0).alias("kept"))


@query("WITH " + CONTRACTS_SQL + " SELECT contract_id, contract_id % 5 <> 0 AND status = 'analyzed' AS skip FROM contracts")
def ing_can_skip(spark: SparkSession, d: str) -> DataFrame:
    return view.contracts(spark, d).select("contract_id", ingest.can_skip(F.when(F.col("contract_id") % 5 == 0, "changed").otherwise("same"), F.col("status")).alias("skip"))


@query("WITH " + CONTRACTS_SQL + " SELECT contract_id, array_to_string(list_filter([CASE WHEN contract_id % 2 = 0 THEN 'Same file as ' || contract_id + 1 END, CASE WHEN contract_id % 3 = 0 THEN 'Replaced the stored version' END, CASE WHEN contract_id % 5 = 0 THEN 'Part of the text is in no clause' END, CASE WHEN contract_id % 7 = 0 THEN 'OCR: no engine' END], lambda x: x IS NOT NULL), '; ') AS said FROM contracts")
def ing_warnings(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("contract_id")
    up = view.contracts(spark, d).select(k, F.when(k % 2 == 0, k + 1).alias("duplicate_of"), (k % 3 == 0).alias("reprocessed"), (k % 5 != 0).alias("coverage_ok"), F.when(k % 7 == 0, "no engine").alias("ocr_error"), F.lit(None).cast("string").alias("index_error"))
    return up.select("contract_id", F.array_join(ingest.warnings(), "; ").alias("said"))


@query("SELECT '/in/' || CASE o_orderkey % 4 WHEN 1 THEN 'b.docx' ELSE 'c.pdf' END || o_orderkey || CASE o_orderkey % 4 WHEN 1 THEN '.docx' ELSE '.pdf' END AS path, CASE WHEN o_orderkey % 4 = 1 OR o_totalprice > 400000 THEN 'skipped' ELSE 'accepted' END AS status FROM orders WHERE o_orderkey % 4 <> 0")
def src_listing(spark: SparkSession, d: str) -> DataFrame:
    """Files of all orders, some hidden, some of another kind, some too large, each listed twice."""
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    name = F.when(k % 4 == 0, F.concat(F.lit("."), k.cast("string"), F.lit(".pdf"))).when(k % 4 == 1, F.concat(F.lit("b.docx"), k.cast("string"), F.lit(".docx"))).otherwise(F.concat(F.lit("c.pdf"), k.cast("string"), F.lit(".pdf")))
    files = o.select(F.concat(F.lit("/in/"), name).alias("path"), F.when(F.col("o_totalprice") > 400000, 60 << 20).otherwise(100).cast("long").alias("length"))
    return ingest.listing_status(files.unionByName(files)).select("path", "status")


# ------------------------------------------------------------- retrieval


@query("WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 50 = 0), s AS (SELECT query_id, vec_id, list_cosine_similarity(e, embedding::DOUBLE[]) AS score FROM q JOIN embeddings ON vec_id <> query_id), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM s) SELECT query_id, vec_id, place::INT AS place, round(score, 6) AS score FROM r WHERE place <= 10")
def ret_nearest(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings")
    out = retrieval.nearest(v, v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), 10, exclude_self=True)
    return out.withColumn("score", F.round("score", 6))


@query("WITH n AS (SELECT count(*) AS rows, count(*) FILTER (WHERE vec_id % 50 = 0) AS queries FROM embeddings WHERE embedding IS NOT NULL) SELECT rows AS indexed, queries, queries * least(10, rows - 1) AS found, queries * least(10, rows - 1) AS exact_scores, true AS recall_enough, true AS work_less FROM n")
def ret_approximate(spark: SparkSession, d: str) -> DataFrame:
    """A search of ten neighbours by the index, held against the exact search: a recall of 0.9 or more, with fewer pairs compared by code than there are and one in ten at most compared by vector."""
    v = table(spark, d, "embeddings")
    asked = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    book = vector_index.fit(v)
    index = vector_index.encode(v, book)
    found = vector_index.search(index, v, asked, book, 10, exclude_self=True)
    exact = retrieval.nearest(v, asked, 10, exclude_self=True)
    both = found.alias("f").join(exact.alias("e"), (F.col("f.query_id") == F.col("e.query_id")) & (F.col("f.vec_id") == F.col("e.vec_id")), "full")
    told = both.agg(F.count("f.vec_id").alias("found"), F.count("e.vec_id").alias("n"), F.count_if(F.col("f.vec_id") == F.col("e.vec_id")).alias("hits"), F.count_if(F.coalesce(F.abs(F.col("f.score") - F.col("e.score")) < 1e-9, F.lit(True)) & F.col("f.vec_id").isNotNull()).alias("exact_scores"))
    size = index.agg(F.count(F.lit(1)).alias("indexed")).crossJoin(asked.agg(F.count(F.lit(1)).alias("queries"))).crossJoin(vector_index.met(index, asked, book)).crossJoin(told)  # one row each
    less = (F.col("pairs") < F.col("of_all")) & (F.lit(book.rescored) <= F.greatest(F.lit(64), F.col("indexed") * 0.1))
    return size.select("indexed", "queries", "found", "exact_scores", (F.col("hits") >= F.col("n") * 0.9).alias("recall_enough"), less.alias("work_less"))


_STOP_SQL = "[" + ", ".join(f"'{w}'" for w in ("", *tx.STOPWORDS)) + "]"
_SEARCH_SQL = rf"""t AS (SELECT *, concat_ws('-', conv_id, turn) AS id FROM conversations), w AS (SELECT id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) AS w FROM t),
 b AS (SELECT id, ('0x' || substr(md5(w), 1, 8))::BIGINT % 256 AS b, count(*)::DOUBLE AS n FROM w GROUP BY ALL), l AS (SELECT id, sqrt(sum(n * n)) AS len FROM b GROUP BY 1),
 q AS (SELECT * FROM t WHERE role = 'user' AND conv_id % 50 = 0), p AS (SELECT * FROM t WHERE role <> 'user' AND trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) <> ''),
 dots AS (SELECT q.id AS query_id, p.id AS passage_id, sum(x.n * y.n) AS d FROM q JOIN b x ON x.id = q.id JOIN b y ON y.b = x.b JOIN p ON p.id = y.id GROUP BY ALL),
 c AS (SELECT q.id AS query_id, p.conv_id AS contract_id, p.id AS passage_id, p.text, q.text AS question, round(coalesce(d / (lq.len * lp.len), 0), 9) AS cos
  FROM q CROSS JOIN p LEFT JOIN dots ON dots.query_id = q.id AND dots.passage_id = p.id LEFT JOIN l lq ON lq.id = q.id LEFT JOIN l lp ON lp.id = p.id),
 words AS (SELECT id, list_filter(list_distinct(list_transform(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9%.]{{3,}}'), lambda x: regexp_replace(x, '^[.%]+|[.%]+$', '', 'g'))), lambda x: NOT list_contains({_STOP_SQL}, x)) AS terms FROM q),
 scored AS (SELECT c.*, cos + least(0.3::DOUBLE, len(list_filter(terms, lambda x: regexp_matches(lower(text), '(^|[^a-z0-9])' || regexp_escape(x)))) * 0.1::DOUBLE) AS score FROM c JOIN words ON words.id = query_id)"""


def _search_sql(candidates: str, cut: str, by: str, k: int) -> str:
    return (
        f"WITH {_SEARCH_SQL}, near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY cos DESC, passage_id) AS n FROM scored) WHERE n <= {candidates}), kept AS (SELECT * FROM (SELECT *, max(score) OVER (PARTITION BY {by}) AS top FROM near) WHERE score >= {cut}), "
        r"single AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, contract_id, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) ORDER BY score DESC, passage_id) AS k FROM kept) WHERE k = 1) "
        f"SELECT * FROM (SELECT query_id, contract_id, passage_id, round(score, 6) AS score, (row_number() OVER (PARTITION BY {by} ORDER BY score DESC, passage_id))::INT AS place FROM single) WHERE place <= {k}"
    )


def _talk(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    talk = retrieval.embed_words(table(spark, d, "conversations").select(F.col("conv_id").alias("contract_id"), F.concat_ws("-", "conv_id", "turn").alias("passage_id"), "role", "text"))
    return talk.where("role <> 'user'"), talk.where("role = 'user' and contract_id % 50 = 0").select(F.col("passage_id").alias("query_id"), "contract_id", F.col("text").alias("question"), "embedding")


#: A score to six decimals, as SQL rounds a double: what its product with a million is nearest to.
_SIX = "round(score * 1e6D) / 1e6D"


@query(_search_sql("20", "greatest(top - 0.12::DOUBLE, 0.3::DOUBLE)", "query_id", 5))
def ret_hybrid(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.hybrid(*_talk(spark, d), 5).drop("text").withColumn("score", F.expr(_SIX))


@query(_search_sql("8", "top - 0.3::DOUBLE", "query_id, contract_id", 2))
def ret_per_contract(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.hybrid(*_talk(spark, d), per_contract=2).drop("text").withColumn("score", F.expr(_SIX))


_WORDING = r"lower(trim(regexp_replace(text, '\s+', ' ', 'g')))"


_SCOPED_SQL = _search_sql("8", "top - 0.3::DOUBLE", "query_id, contract_id", 2).replace("near AS (SELECT * FROM (SELECT *, row_number()", "near AS (SELECT * FROM (SELECT scored.*, row_number()").replace("FROM scored) WHERE n <= 8", "FROM scored JOIN q ON q.id = query_id WHERE abs(contract_id - q.conv_id) <= 20 AND contract_id % 3 <> 0) WHERE n <= 8")


@query(_SCOPED_SQL)
def ret_per_contract_named(spark: SparkSession, d: str) -> DataFrame:
    """The best passages of each conversation that a question names: those of about its number."""
    passages, asked = _talk(spark, d)
    near = asked.select("query_id", F.explode(F.sequence(F.col("contract_id") - 20, F.col("contract_id") + 20)).alias("contract_id")).where("contract_id % 3 <> 0")
    return retrieval.hybrid(passages, asked.drop("contract_id"), per_contract=2, scope=near).drop("text").withColumn("score", F.expr(_SIX))


@query(f"WITH k AS (SELECT *, {_WORDING} AS k FROM documents), g AS (SELECT lang, k, min(doc_id) AS contract_id, count(DISTINCT doc_id) AS n_contracts, array_to_string(list_slice(list(DISTINCT doc_id ORDER BY doc_id), 2, 31), ',') AS also_in FROM k WHERE k <> '' GROUP BY 1, 2) SELECT lang, contract_id, n_contracts, also_in FROM g")
def ret_merge_identical(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("lang", F.col("doc_id").alias("place"), F.col("doc_id").alias("contract_id"), F.lit("1").alias("passage_id"), "text")
    return retrieval.merge_identical(docs, "lang").select("lang", "contract_id", "n_contracts", F.array_join("also_in", ",").alias("also_in"))


@query(f"SELECT DISTINCT lang, sha256({_WORDING}) AS wording, doc_id AS contract_id FROM documents WHERE {_WORDING} <> ''")
def ret_wordings(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.wordings(table(spark, d, "documents").select("lang", F.col("doc_id").alias("contract_id"), "text"), "lang")


_CITES = ("As [Source {0} | a.pdf | clause 3] says.", "See (Sources {0} and 2).", "Per Source {0}, it ends.", "In [Sources {0}-{1}] and [{0}].", "Right [Source {0}](#source-{0}), 【Source {0}】.")


@query("WITH " + CLAUSES_SQL + """, n AS (SELECT contract_id, clause_id, 4 AS n FROM clauses), l AS (SELECT *, '[Source ' || clause_id || '](#source-' || clause_id || ')' AS a, '[Source ' || clause_id + 1 || '](#source-' || clause_id + 1 || ')' AS b FROM n)
 SELECT contract_id, clause_id, CASE clause_id % 5
 WHEN 0 THEN 'As ' || CASE WHEN clause_id <= n THEN a ELSE 'Source ' || clause_id END || ' says.'
 WHEN 1 THEN 'See (' || CASE WHEN clause_id <= n THEN a || ', ' ELSE '' END || '[Source 2](#source-2)).'
 WHEN 2 THEN 'Per ' || CASE WHEN clause_id <= n THEN a ELSE 'Source ' || clause_id END || ', it ends.'
 WHEN 3 THEN 'In ' || CASE WHEN clause_id + 1 <= n THEN a || ', ' || b WHEN clause_id <= n THEN a ELSE 'Source ' || clause_id || ', ' || clause_id + 1 END || ' and ' || CASE WHEN clause_id <= n THEN a ELSE '[' || clause_id || ']' END || '.'
 ELSE 'Right ' || CASE WHEN clause_id <= n THEN a || ', ' || a ELSE 'Source ' || clause_id || ', Source ' || clause_id END || '.' END AS text FROM l""")
def fn_link_citations(spark: SparkSession, d: str) -> DataFrame:
    no = F.col("clause_id")
    said = [F.format_string(c.replace("{0}", "%1$d").replace("{1}", "%2$d"), no, no + 1) for c in _CITES]
    return view.clauses(spark, d).select("contract_id", "clause_id", tx.link_citations(F.element_at(F.array(*said), (no % 5 + 1).cast("int")), F.lit(4)).alias("text"))


@query("SELECT conv_id AS query_id, turn AS place FROM (SELECT *, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS t FROM conversations) WHERE t <= 400")
def ret_fit_budget(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("query_id"), F.col("turn").alias("place"), "text")
    return retrieval.fit_budget(c, 400).select("query_id", "place")


@query("WITH " + CLAUSES_SQL + " SELECT contract_id, clause_id FROM clauses SEMI JOIN (SELECT contract_id FROM clauses GROUP BY 1 HAVING sum(length(text)) <= 300) USING (contract_id)")
def ret_whole_contracts(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.whole_contracts(view.clauses(spark, d), 300).select("contract_id", "clause_id")


@query("SELECT o_orderkey AS contract_id FROM orders ANTI JOIN lineitem ON o_orderkey = l_orderkey")
def ret_not_indexed(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.not_indexed(view.contracts(spark, d).select("contract_id"), view.clauses(spark, d))


@query("SELECT count(*) AS passages, count(DISTINCT l_orderkey) AS contracts FROM lineitem")
def ret_index_size(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.index_size(view.clauses(spark, d))


@query("SELECT conv_id AS query_id, turn AS passage_id, row_number() OVER (PARTITION BY conv_id ORDER BY CASE WHEN turn % 2 = 1 THEN 0 ELSE 1 END, turn)::INT AS place FROM conversations")
def ret_pin(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("query_id"), F.col("conv_id").alias("contract_id"), F.col("turn").alias("passage_id"), F.col("turn").alias("place"))
    return retrieval.pin(c.where("passage_id % 2 = 1"), c).select("query_id", "passage_id", "place")


@query("WITH " + CLAUSES_SQL + ", " + CONTRACTS_SQL + " SELECT contract_id, clause_id, clause_id AS source_no, filename || ', clause ' || clause_id AS label FROM clauses JOIN contracts USING (contract_id) WHERE clause_id <= 3")
def ret_number_sources(spark: SparkSession, d: str) -> DataFrame:
    p = view.clauses(spark, d).withColumn("place", F.col("clause_id")).withColumn("passage_id", F.col("clause_id"))
    return retrieval.number_sources(p, view.contracts(spark, d), "contract_id", 3).select("contract_id", "clause_id", "source_no", "label")


@query("WITH " + CLAUSES_SQL + " SELECT contract_id AS answer_id, clause_id AS source_no FROM clauses WHERE clause_id IN (1, 3)")
def ret_cited_only(spark: SparkSession, d: str) -> DataFrame:
    s = view.clauses(spark, d).select(F.col("contract_id").alias("answer_id"), F.col("clause_id").alias("source_no"))
    a = s.select("answer_id").distinct().withColumn("text", F.lit("As [Source 3](#source-3) and [Source 1](#source-1) say."))
    return retrieval.cited_only(s, a)


@query("WITH " + CLAUSES_SQL + ", l AS (SELECT contract_id AS answer_id, clause_id AS source_no, text, first_value(text) OVER (PARTITION BY contract_id ORDER BY clause_id) AS a FROM clauses) SELECT answer_id, count(*) AS n, min(source_no) AS first_no FROM l WHERE text = a GROUP BY 1")
def ret_likely_sources(spark: SparkSession, d: str) -> DataFrame:
    c = view.clauses(spark, d).select(F.col("contract_id").alias("answer_id"), F.col("clause_id").alias("source_no"), "text")
    answers = c.where("source_no = 1").select("answer_id", "text")
    out = retrieval.likely_sources(answers, c, 1)
    same = c.join(answers.withColumnRenamed("text", "_a"), "answer_id").where("text = _a").groupBy("answer_id").agg(F.count(F.lit(1)).alias("n"))
    return out.join(same, "answer_id").select("answer_id", "n", F.col("source_no").alias("first_no"))


# ------------------------------------------------------------- routing

# Questions and what they ask for.
_ASKED = (
    ("Which contract has the highest amount?", "list", "contract_value", "desc", 1, 0),
    ("What are the top 5 contracts by value?", "list", "contract_value", "desc", 5, 0),
    ("Which loan is the second largest?", "list", "contract_value", "desc", 1, 1),
    ("What is the total amount financed?", "sum", None, "desc", None, 0),
    ("What is the average loan amount?", "average", None, "desc", None, 0),
    ("How many contracts are there?", "count", None, "desc", None, 0),
    ("Which is the riskiest contract?", "list", "high_risk_clauses", "desc", 1, 0),
    ("What does the penalty clause say?", None, None, None, None, None),
    ("Which contracts have the lowest amounts?", "list", "contract_value", "asc", None, 0),
)


def _sql(x) -> str:
    return "NULL" if x is None else "'" + x + "'" if isinstance(x, str) else str(x)


_ASKED_SQL = "asked AS (SELECT * FROM (VALUES " + ", ".join(f"({k}, " + ", ".join(map(_sql, a)) + ")" for k, a in enumerate(_ASKED)) + ') t(k, question, operation, sort_by, "order", "limit", "offset"))'


def _questions(spark: SparkSession, d: str) -> DataFrame:
    """Each user turn's own text (own), and a question put in its place."""
    turns = table(spark, d, "conversations").where("role = 'user'")
    text = F.element_at(F.array(*[F.lit(a[0]) for a in _ASKED]), F.pmod(F.col("conv_id") + F.col("turn"), F.lit(len(_ASKED))).cast("int") + 1)
    return turns.select("conv_id", "turn", F.explode(F.array(F.struct(F.lit(True).alias("own"), F.col("text").alias("question")), F.struct(F.lit(False).alias("own"), text.alias("question")))).alias("q")).select("conv_id", "turn", "q.*")


# the rules' words in SQL, without look-behind
_LEAST = r"regexp_matches(low, '\b(lowest|smallest|minimum|min)\b') OR regexp_matches(regexp_replace(low, '\bat least\b', '', 'g'), '\bleast\b')"
_MOST = r"regexp_matches(low, '\b(highest|largest|biggest|maximum|max|most valuable)\b') OR regexp_matches(low, '\bworth the most\b') OR regexp_matches(low, '\bmost (?:money|expensive)\b')"
_RULED_SQL = f"""said AS (SELECT conv_id, turn, trim(text) AS q, lower(trim(text)) AS low FROM conversations WHERE role = 'user'),
 parts AS (SELECT *, coalesce(map {{{', '.join(f"'{w}': {n}" for w, n in routing.ORDINAL_OFFSET)}}}[regexp_extract(low, '\\b({"|".join(w for w, _ in routing.ORDINAL_OFFSET)})\\b', 1)], 0) AS o,
  coalesce(nullif(regexp_extract(low, '\\btop\\s+(\\d{{1,2}})\\b', 1), ''), nullif(regexp_extract(low, '\\b(\\d{{1,2}})\\s+(?:largest|biggest|highest|smallest|lowest)\\b', 1), ''))::INT AS top FROM said),
 cut AS (SELECT *, CASE WHEN o > 0 THEN 1 WHEN top IS NOT NULL THEN top WHEN regexp_matches(low, '\\bcontracts\\b|\\bloans\\b|\\bamounts\\b') THEN NULL ELSE 1 END AS lim FROM parts),
 ruled AS (SELECT *, CASE WHEN regexp_matches(q, '{routing.PLAIN_COUNT}') THEN 'count' WHEN regexp_matches(q, '{routing.NOT_AMOUNT}') OR NOT regexp_matches(q, '{routing.AMOUNT_WORDS}') THEN NULL
  WHEN regexp_matches(low, '\\b(?:number|count) of (?:contracts|loans|agreements)\\b') THEN 'count' WHEN regexp_matches(low, '\\b(total|sum|combined|altogether)\\b') THEN 'sum' WHEN regexp_matches(low, '\\b(average|mean)\\b') THEN 'average'
  WHEN {_MOST} THEN 'most' WHEN {_LEAST} THEN 'least' WHEN top IS NOT NULL THEN 'top' END AS rule FROM cut),
 own AS (SELECT conv_id, turn, CASE rule WHEN 'most' THEN 'list' WHEN 'least' THEN 'list' WHEN 'top' THEN 'list' ELSE rule END AS operation, CASE WHEN rule IN ('most', 'least', 'top') THEN 'contract_value' END AS sort_by,
  CASE WHEN rule IS NULL THEN NULL WHEN rule = 'least' THEN 'asc' ELSE 'desc' END AS "order", CASE WHEN rule IN ('most', 'least', 'top') THEN lim END AS "limit", CASE WHEN rule IN ('most', 'least') THEN o WHEN rule IS NOT NULL THEN 0 END AS "offset",
  CASE WHEN rule IS NULL OR rule IN ('most', 'least', 'top') AND regexp_matches(q, '{routing.NOT_AMOUNT}') THEN 'semantic' ELSE 'structured' END AS route FROM ruled)"""


@query("WITH " + _ASKED_SQL + ", " + _RULED_SQL + f' SELECT conv_id, turn, false AS own, operation, sort_by, "order", "limit"::INT AS "limit", "offset"::INT AS "offset", CASE WHEN operation IS NULL THEN \'semantic\' ELSE \'structured\' END AS route FROM conversations JOIN asked ON (conv_id + turn) % {len(_ASKED)} = k WHERE role = \'user\' UNION ALL SELECT conv_id, turn, true, operation, sort_by, "order", "limit"::INT, "offset"::INT, route FROM own')
def rte_rules(spark: SparkSession, d: str) -> DataFrame:
    out = routing.check_spec(routing.route(_questions(spark, d)))
    return out.select("conv_id", "turn", "own", *[F.col(f"spec.{c}").alias(c) for c in ("operation", "sort_by", "order", "limit", "offset")], "route")


@query(r"SELECT conv_id, turn, regexp_matches(text, '(?i)\b(which|what|any|all|every|each|how many)\b[^?]*\bcontracts\b|\bany contract\b|\bevery contract\b|\beach contract\b|\bacross\b|\bcompare\b') AS across_all FROM conversations")
def rte_across(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", routing.across_contracts(F.col("text")).alias("across_all"))


@query("WITH " + CONTRACTS_SQL + ", q AS (SELECT * FROM contracts WHERE contract_id % 50 = 0) SELECT contract_id AS query_id, contract_id, 'strong' AS strength FROM q UNION ALL SELECT q.contract_id + 1, c.contract_id, 'strong' FROM q JOIN contracts c USING (customer_name)")
def rte_named(spark: SparkSession, d: str) -> DataFrame:
    """Each fiftieth contract asked for by its file, and its borrower asked for by name."""
    c = view.contracts(spark, d)
    some = c.where("contract_id % 50 = 0")
    by_file = some.select(F.col("contract_id").alias("query_id"), F.concat(F.lit("What is the term of "), F.regexp_replace("filename", r"\.pdf", ""), F.lit(", and who signed it?")).alias("question"))
    by_name = some.where("customer_name is not null").select((F.col("contract_id") + 1).alias("query_id"), F.concat(F.lit("what does "), F.lower("customer_name"), F.lit(" owe us")).alias("question"))
    return routing.named_contracts(by_file.unionByName(by_name), c)


@query("WITH " + CONTRACTS_SQL + " SELECT q.contract_id AS query_id, c.contract_id, 'borrower' AS role FROM contracts q JOIN contracts c USING (customer_name) WHERE q.contract_id % 50 = 0")
def qry_of_party(spark: SparkSession, d: str) -> DataFrame:
    c = view.contracts(spark, d)
    asked = c.where("contract_id % 50 = 0 and customer_name is not null").select(F.col("contract_id").alias("query_id"), F.concat(F.lit("who is "), "customer_name", F.lit(" of the company")).alias("question"))
    return routing.of_party(asked, c)


@query("WITH u AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations WHERE role = 'user') SELECT conv_id, turn, 'list' AS operation, 'contract_value' AS sort_by, CASE WHEN n % 2 = 1 THEN 1 END::INT AS \"limit\", CASE WHEN n % 2 = 0 THEN 1 ELSE 0 END::INT AS \"offset\" FROM u")
def rte_follow_ups(spark: SparkSession, d: str) -> DataFrame:
    """Each second question of a user follows up on the one before."""
    turns = table(spark, d, "conversations").where("role = 'user'").withColumn("n", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")))
    asked = turns.select("conv_id", "turn", F.when(F.col("n") % 2 == 1, "which contract has the highest amount").otherwise("list the other ones too").alias("question"))
    out = routing.follow_up(routing.route(asked))
    return out.select("conv_id", "turn", *[F.col(f"spec.{c}").alias(c) for c in ("operation", "sort_by", "limit", "offset")])


@query("WITH " + CONTRACTS_SQL + " SELECT contract_id AS query_id, lender_name FROM contracts WHERE contract_id % 50 = 0 AND lender_name IS NOT NULL")
def rte_lenders(spark: SparkSession, d: str) -> DataFrame:
    c = view.contracts(spark, d)
    asked = c.where("contract_id % 50 = 0").select(F.col("contract_id").alias("query_id"), F.concat(F.lit("tell me about "), F.coalesce("lender_name", F.lit("nobody"))).alias("question"))
    return routing.lenders_named(asked, c)


_MONEY_SQL = "CASE WHEN currency = 'USD' THEN '$' || format('{:,.2f}', contract_value) WHEN currency = 'INR' THEN '₹' || format('{:,.2f}', contract_value) WHEN currency = 'EUR' THEN '€' || format('{:,.2f}', contract_value) ELSE trim(format('{:,.2f}', contract_value) || ' ' || coalesce(currency, '')) END"


@query("WITH " + CONTRACTS_SQL + f" SELECT contract_id, customer_name || ' is the borrower of **' || filename || '**' || CASE WHEN contract_value IS NOT NULL THEN ' for **' || {_MONEY_SQL} || '**' ELSE '' END || CASE WHEN end_date IS NOT NULL THEN ', running ' || start_date || ' to ' || end_date ELSE '' END || '.' AS said FROM contracts")
def qry_describe(spark: SparkSession, d: str) -> DataFrame:
    c = view.contracts(spark, d)
    return c.select("contract_id", routing.describe(c).alias("said"))


@query("SELECT conv_id AS query_id, conv_id AS contract_id, CASE WHEN conv_id % 2 = 0 THEN 'strong' ELSE 'loose' END AS strength FROM (SELECT DISTINCT conv_id FROM conversations) WHERE conv_id % 2 = 0 OR conv_id % 3 <> 0")
def rte_usable_names(spark: SparkSession, d: str) -> DataFrame:
    """Every third conversation asks for a total; every second names its contract in full."""
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("query_id")).distinct()
    named = c.select("query_id", F.col("query_id").alias("contract_id"), F.when(F.col("query_id") % 2 == 0, "strong").otherwise("loose").alias("strength"))
    asked = c.withColumn("question", F.when(F.col("query_id") % 3 == 0, "what is the total amount financed").otherwise("what does it say"))
    return routing.usable_names(named, routing.route(asked))


@query("SELECT conv_id AS case_id, CASE WHEN conv_id % 5 = 0 THEN 'skip' WHEN conv_id % 2 = 0 AND conv_id % 3 = 0 THEN 'pass' ELSE 'fail' END AS status FROM (SELECT DISTINCT conv_id FROM conversations)")
def rte_evaluate(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("case_id")
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("case_id")).distinct()
    cases = c.select(k, F.lit("semantic").alias("expect_route"), F.array(F.when(k % 5 == 0, "TODO").otherwise("IT IS 5")).alias("expect_contains"))
    answers = c.select(k, F.when(k % 2 == 0, "It is 5.").otherwise("It is 6.").alias("answer"), F.when(k % 3 == 0, "semantic").otherwise("structured").alias("route"))
    return conversations.evaluate(answers, cases)


# ------------------------------------------------------------- policy library over parts

_UP_SQL = "SELECT CASE WHEN id > 10 THEN id // 2 END AS id FROM "
_LIB_SQL = f"l0 AS (SELECT DISTINCT p_size AS id FROM part), l1 AS ({_UP_SQL}l0), l2 AS ({_UP_SQL}l1), l3 AS ({_UP_SQL}l2), labels AS (SELECT DISTINCT id, CASE WHEN id > 10 THEN id // 2 END AS parent_id FROM (SELECT id FROM l0 UNION SELECT id FROM l1 UNION SELECT id FROM l2 UNION SELECT id FROM l3) WHERE id IS NOT NULL), policies AS (SELECT p_partkey AS id, p_size AS label, p_partkey % 3 AS lvl FROM part)"


def _library(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Parts as policies under the label of their size; sizes over ten, and what is above them, have half their number as parent."""
    part = table(spark, d, "part")
    up = lambda c: F.when(c > 10, F.floor(c / 2).cast("int"))
    size = F.col("p_size").cast("int")
    ids = part.select(F.explode(F.array_compact(F.array(size, up(size), up(up(size)), up(up(up(size)))))).alias("id")).distinct()
    labels = ids.select("id", up(F.col("id")).alias("parent_id"))
    level = F.element_at(F.array(F.lit("low"), F.lit("high"), F.lit("medium")), (F.col("p_partkey") % 3).cast("int") + 1)
    policies = part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("description"), level.alias("risk_level"), F.array(F.col("p_size").cast("int")).alias("label_ids"))
    roots = labels.where("parent_id is null and id % 2 = 0").select(F.col("id").alias("root_id"), F.concat(F.lit("Domain "), F.col("id").cast("string")).alias("domain"))
    return policies, labels, roots


_ROOTS_SQL = _LIB_SQL + ", w AS (WITH RECURSIVE r AS (SELECT id, id AS spot FROM labels UNION SELECT r.id, l.parent_id FROM r JOIN labels l ON l.id = r.spot WHERE l.parent_id IS NOT NULL) SELECT id AS label_id, spot AS root_id FROM r WHERE spot IN (SELECT id FROM labels WHERE parent_id IS NULL))"


@query("WITH " + _ROOTS_SQL + " SELECT label_id, root_id FROM w")
def pol_label_roots(spark: SparkSession, d: str) -> DataFrame:
    return policy.label_roots(_library(spark, d)[1])


@query("WITH " + _ROOTS_SQL + " SELECT 'Domain ' || root_id AS domain, id AS check_id, CASE lvl WHEN 1 THEN 5 WHEN 2 THEN 3 ELSE 1 END AS risk_weight FROM policies JOIN w ON label = label_id WHERE root_id % 2 = 0")
def pol_compile_library(spark: SparkSession, d: str) -> DataFrame:
    return policy.compile_policy(*_library(spark, d)).select("domain", "check_id", "risk_weight")


@query("WITH " + _ROOTS_SQL + " SELECT id FROM policies JOIN w ON label = label_id WHERE root_id % 2 = 1")
def pol_unused(spark: SparkSession, d: str) -> DataFrame:
    return policy.unused_policies(*_library(spark, d)).select("id")


@query("WITH " + _LIB_SQL + " SELECT a.id, coalesce(string_agg(b.id::VARCHAR, ',' ORDER BY b.id), '') AS children FROM labels a LEFT JOIN labels b ON b.parent_id = a.id WHERE a.parent_id IS NULL GROUP BY 1")
def pol_label_tree(spark: SparkSession, d: str) -> DataFrame:
    return policy.label_tree(_library(spark, d)[1]).select("id", F.array_join("children", ",").alias("children"))


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 5 = 0 THEN 'changed' ELSE p_name END AS name FROM part UNION ALL SELECT -p_partkey, 'new' FROM part WHERE p_partkey % 10 = 0")
def pol_update(spark: SparkSession, d: str) -> DataFrame:
    policies = _library(spark, d)[0]
    edits = policies.where("id % 5 = 0").withColumn("name", F.lit("changed"))
    new = policies.where("id % 10 = 0").withColumns({"id": -F.col("id"), "name": F.lit("new")})
    return policy.update_policies(policies, edits.unionByName(new)).select("id", "name")


@query("SELECT p.p_partkey + 1 AS check_id, q.p_name AS name, CASE q.p_partkey % 3 WHEN 1 THEN 5 WHEN 2 THEN 3 WHEN 0 THEN 1 END AS weight, CASE WHEN q.p_size % 2 = 0 THEN 'color ' || q.p_size END AS color FROM part p LEFT JOIN part q ON q.p_partkey = p.p_partkey + 1")
def pol_names(spark: SparkSession, d: str) -> DataFrame:
    policies, labels, _ = _library(spark, d)
    colored = labels.select("id", F.when(F.col("id") % 2 == 0, F.concat(F.lit("color "), F.col("id").cast("string"))).alias("color"))
    checks = policies.select((F.col("id") + 1).alias("check_id"))
    return policy.with_names(checks, policies, colored).select("check_id", "name", "weight", "color")


@query("SELECT p_partkey AS id, p_size NOT IN (7, 14, 15) AS has_label FROM part")
def pol_delete_label(spark: SparkSession, d: str) -> DataFrame:
    policies, labels, _ = _library(spark, d)
    return policy.delete_label(policies, labels, 7)[0].select("id", (F.size("label_ids") > 0).alias("has_label"))


# ------------------------------------------------------------- streams


@query("WITH e AS (SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n, sum(value::DECIMAL(18,4))::DECIMAL(28,4) AS total FROM events GROUP BY 1, 2) SELECT day::TIMESTAMP AS day, event_type, n, total FROM e WHERE day + INTERVAL 2 DAY <= (SELECT max(ts) FROM events)")
def str_daily(spark: SparkSession, d: str) -> DataFrame:
    schema = table(spark, d, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{d}/[e]vents.parquet")
    base = f"{streams.shared_folder(spark)}/daily-{uuid.uuid4().hex}"
    q = streams.daily(stream).writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    out = spark.read.schema("day timestamp, event_type string, n long, total decimal(28,4)").parquet(f"{base}/out")
    return out.withColumn("day", F.col("day").cast("timestamp_ntz")).withColumn("total", F.col("total").cast("decimal(28,4)"))
