import datetime
import json

import pytest
from pyspark.sql import functions as F

from pactlake.operators import dashboards, parsing
from pactlake.sources import files
from pactlake.streaming import streams

BODY = ["CLAUSE 1 - PAYMENT: The invoice is due in thirty days from its date.", "CLAUSE 2 - TERM: This contract lasts for two years from today onwards."]


def test_read_contracts(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"\xef\xbb\xbfCaf\xc3\xa9\fpage two")
    (tmp_path / "b.txt").write_bytes("price € 5 “now”".encode("cp1252"))
    (tmp_path / "c.txt").write_bytes(b"odd \x81 byte \xe9")
    (tmp_path / "d.txt").write_bytes(b"PK\x03\x04rest")
    (tmp_path / "e.txt").write_bytes(b"abc\x00def")
    (tmp_path / "f.docx").write_bytes(b"text")
    (tmp_path / "g.txt").write_bytes(b"@0 and P0 0x00 are text")
    pages, bad = files.read_contracts(spark, str(tmp_path))
    got = {(r.filename, r.page_no): r.text for r in pages.collect()}
    assert got == {("a.txt", 1): "Café", ("a.txt", 2): "page two", ("b.txt", 1): "price € 5 “now”", ("c.txt", 1): "odd \x81 byte é", ("g.txt", 1): "@0 and P0 0x00 are text"}
    assert {r.path.rsplit("/", 1)[1]: r.reason for r in bad.collect()} == {"d.txt": "zip", "e.txt": "binary", "f.docx": "office"}


def test_policies(spark, tmp_path):
    one = {"policy_id": "P1", "risk_threshold": 9, "domains": [{"domain_name": "Legal", "required": True, "micro_policies": [{"id": "a", "name": "A", "check": "governing law", "risk_weight": 4}, {"id": "b", "name": "B", "check": "cap", "risk_weight": 2}]}]}
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "p1.json").write_text(json.dumps(one, indent=1))
    (tmp_path / "in" / "bad.json").write_text("{not json")
    (tmp_path / "in" / "noid.json").write_text(json.dumps({"risk_threshold": 1, "domains": []}))
    got = files.read_policies(spark, str(tmp_path / "in")).orderBy("check_no").collect()
    assert [(r.policy_id, r.domain, r.required, r.check_id, r.risk_weight) for r in got] == [("P1", "Legal", True, "a", 4), ("P1", "Legal", True, "b", 2)]
    raw = spark.createDataFrame([("P1", 5), (None, 1), ("P2", 2)], "policy_id string, risk_threshold int")
    files.save_policies(raw, str(tmp_path / "out"))
    files.save_policies(raw.where("policy_id = 'P2'").withColumn("risk_threshold", F.lit(7)), str(tmp_path / "out"))
    assert {r.policy_id: r.risk_threshold for r in spark.read.json(str(tmp_path / "out")).collect()} == {"P1": 5, "P2": 7}


def test_exports(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1, "Legal", "High", "bad, very", "line one\nline two, three")], "contract_id long, clause_id int, domain string, risk_level string, reason string, text string")
    files.export_csv(dashboards.export_rows(rows), str(tmp_path / "csv"))
    got = spark.read.option("header", True).csv(str(tmp_path / "csv")).first()
    assert got.text == "line one line two; three" and got.reasons == "bad; very" and got.title == "Line One Line"
    directory = spark.createDataFrame([(1, "a.pdf", 1, 0, 0)], "contract_id long, filename string, high_risk_clauses int, medium_risk_clauses int, low_risk_clauses int")
    files.export_json(dashboards.export_record(directory, rows), str(tmp_path / "json"))
    got = spark.read.json(str(tmp_path / "json")).first()
    assert got.risk_summary.high == 1 and got.clauses[0].clause_id == 1
    files.save_passages(rows, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 1


def test_incremental_ingest_equals_batch(spark, tmp_path):
    schema = "contract_id string, text string"
    source, target = str(tmp_path / "in"), str(tmp_path / "clauses")
    batches = [[("a", "\n\n".join(BODY)), ("b", BODY[0])], [("c", BODY[1]), ("a", BODY[1])]]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        q = streams.ingest(spark.readStream.schema(schema).parquet(source), target, str(tmp_path / "state"), parts=4)
        assert q.awaitTermination(120) and q.exception() is None
    assert streams.current(spark, str(tmp_path / "nothing")) is None
    last = spark.createDataFrame([("a", BODY[1]), ("b", BODY[0]), ("c", BODY[1])], schema)
    cols = ["contract_id", "kind", "clause_id", "text"]
    got = sorted(tuple(r) for r in streams.current(spark, target).select(cols).collect())
    assert got == sorted(tuple(r) for r in parsing.split_document(last).select(cols).collect())


def test_work_of_a_batch_depends_on_its_buckets(spark, tmp_path, monkeypatch):
    """Fifty batches of a contract each: every batch reads the one folder of its bucket, and what is superseded goes."""
    target, read = str(tmp_path / "clauses"), []
    true_read = streams._read
    monkeypatch.setattr(streams, "_read", lambda s, t, rows: read.append(len(rows)) or true_read(s, t, rows))
    last = {}
    for k in range(50):
        last[f"c{k % 20}"] = BODY[0].replace("CLAUSE", f"CLAUSE {k} of")
        streams.store(spark.createDataFrame([(f"c{k % 20}", last[f"c{k % 20}"])], "contract_id string, text string"), k, target, parts=6)
    assert max(read) == 1 and len(read) == 50
    assert len(streams.snapshots(spark, target)) == 2
    folders = [p for p in (tmp_path / "clauses" / "data").glob("*/bucket=*") if any(p.glob("*.parquet"))]
    named = {r[3] for n in streams.snapshots(spark, target) for r in streams.manifest(spark, target, n)}
    assert {str(p.relative_to(tmp_path / "clauses")) for p in folders} == named and len(named) <= 7
    cols = ["contract_id", "kind", "clause_id", "text"]
    want = parsing.split_document(spark.createDataFrame(list(last.items()), "contract_id string, text string"))
    assert sorted(tuple(r) for r in streams.current(spark, target).select(cols).collect()) == sorted(tuple(r) for r in want.select(cols).collect())


def test_failed_write_leaves_the_old_state(spark, tmp_path, monkeypatch):
    target, frame = str(tmp_path / "clauses"), lambda *rows: spark.createDataFrame(list(rows), "contract_id string, text string")
    assert streams.store(frame(("a", BODY[0]), ("b", BODY[1])), 0, target, parts=3)
    before = sorted(map(str, streams.current(spark, target).collect()))
    reader = streams.current(spark, target)

    def fails(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(streams, "_publish", fails)
        with pytest.raises(OSError):
            streams.store(frame(("a", BODY[1])), 1, target, parts=3)
    assert sorted(map(str, streams.current(spark, target).collect())) == before
    streams.store(frame(("a", BODY[1])), 1, target, parts=3)
    assert sorted(map(str, reader.collect())) == before  # began before the batch
    assert streams.store(frame(("a", BODY[0])), 1, target, parts=3) == []  # a batch that runs again
    streams.store(frame(("a", None)), 2, target, parts=3)
    assert {r.contract_id for r in streams.current(spark, target).collect()} == {"b"}
    assert {r.contract_id for r in streams.current(spark, target, 1).collect()} == {"a", "b"}
    streams.store(frame(("c", BODY[0])), 3, target, parts=3, keep=5)
    assert streams.snapshots(spark, target) == [1, 2, 3]


def _run(spark, frame, name):
    q = frame.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    return spark.table(name).collect()


def test_first_copies(spark, tmp_path):
    rows = [("2024-01-01 00:00:00", "same"), ("2024-01-01 01:00:00", "same"), ("2024-01-01 02:00:00", "other")]
    spark.createDataFrame(rows, "ts string, content string").withColumn("ts", F.to_timestamp("ts")).write.parquet(str(tmp_path / "s"))
    stream = spark.readStream.schema("ts timestamp, content string").parquet(str(tmp_path / "s"))
    assert sorted(r.content for r in _run(spark, streams.first_copies(stream), "firsts")) == ["other", "same"]


def test_answers_from_pieces(spark, tmp_path):
    rows = [(1, 2, "nk>hid", False), (1, 1, "<thi", False), (1, 3, "den</think>The rate ", False), (1, 4, "is 2%.", True), (2, 1, "not done", False)]
    spark.createDataFrame(rows, "answer_id long, seq long, text string, done boolean").write.parquet(str(tmp_path / "s"))
    stream = spark.readStream.schema("answer_id long, seq long, text string, done boolean").parquet(str(tmp_path / "s"))
    assert [(r.answer_id, r.text) for r in _run(spark, streams.answers(stream), "answers")] == [(1, "The rate is 2%.")]


def test_abandoned_answers_leave_the_state(spark, tmp_path):
    """An answer without its last piece goes once the watermark has passed it, or is given as far as it came."""
    schema = "answer_id long, seq long, text string, done boolean, ts timestamp"
    day = lambda h: datetime.datetime(2024, 1, 1, h)
    parts = [[(1, 0, "Half ", False, day(0)), (2, 0, "Whole", False, day(0))], [(2, 1, " answer.", True, day(1)), (3, 0, "x", True, day(6))], [(4, 0, "y", True, day(12))], [(5, 0, "z", True, day(13))]]
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "s" / f"k={k}"))
    for partial, name in ((True, "told"), (False, "dropped")):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "s" / "*"))
        q = streams.answers(stream, time="ts", wait="1 hour", partial=partial).writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
        assert q.awaitTermination(240)
        got = {(r.answer_id, r.text, r.whole) for r in spark.table(name).collect()}
        assert got == {(2, "Whole answer.", True), (3, "x", True), (4, "y", True), (5, "z", True)} | ({(1, "Half", False)} if partial else set())
        assert q.lastProgress.stateOperators[0].numRowsTotal == 0
