import re

import corpus_pipeline
from pactlake.llm import decontam

from .test_neardup import brute as near_brute
from .test_sadedup import brute as repeat_brute


def test_stages_against_brute_force(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet").where("length(text) < 4000").cache()
    names = docs.columns
    steps = dict(corpus_pipeline.STAGES)
    assert list(steps) == ["toxicity", "near_dedup", "suffix_dedup", "decontamination", "mixing"]
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{tiny}/labels.parquet").collect()}
    safe = steps["toxicity"](spark, docs, tiny).cache()
    assert safe.columns == names
    kept = {r.doc_id for r in safe.collect()}
    known = [d for (d,) in docs.select("doc_id").collect() if d in labels]
    assert sum((d in kept) != (labels[d] == 1) for d in known) >= 0.95 * len(known)

    rows = [(r.doc_id, r.text) for r in safe.collect()]
    want = {d for d, (_, root) in near_brute(rows, 5, 80).items() if d == root}
    single = steps["near_dedup"](spark, safe, tiny).cache()
    assert single.columns == names and {r.doc_id for r in single.collect()} == want and single.count() == len(want)

    rows = [(r.doc_id, r.text) for r in single.collect()]
    gone = {d: g for (d, _), (_, g, _, _) in zip(rows, repeat_brute([t for _, t in rows], corpus_pipeline.PASSAGE))}
    cut = steps["suffix_dedup"](spark, single, tiny).cache()
    assert cut.columns == names
    for r in cut.collect():
        before = dict(rows)[r.doc_id]
        assert 0 <= len(before.encode()) - gone[r.doc_id] - len(r.text.encode()) <= 6 and r.n_chars == len(r.text)

    bench = [decontam.plain(r.text).strip() for r in spark.read.parquet(f"{tiny}/benchmark.parquet").collect()]
    clean = steps["decontamination"](spark, cut, tiny).cache()
    exact = {r.doc_id for r in cut.collect() if any(b in decontam.plain(r.text) for b in bench)}
    left = {r.doc_id for r in clean.collect()}
    assert clean.columns == names and not left & exact and len(left) > 0.8 * cut.count()

    mix = steps["mixing"](spark, clean, tiny).collect()
    sizes = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in clean.collect()}
    assert all(r.size == sizes[r.doc_id] and 0 < r.taken <= 3 * r.size for r in mix)
    assert 0.9 * sum(sizes.values()) < sum(r.taken for r in mix) <= sum(sizes.values())


def test_run_and_edge_rows(spark, tiny):
    assert corpus_pipeline.run(spark, tiny).count() > 50
    docs = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0), (2, "ab " * 200, "en", "s", 600), (2, "ab " * 200, "en", "s", 600), (3, "x", None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    for table in (docs, docs.limit(0)):
        now = table
        for _, stage in corpus_pipeline.STAGES[:-1]:
            now = stage(spark, now, tiny)
            assert now.columns == docs.columns
        corpus_pipeline.STAGES[-1][1](spark, now, tiny).collect()


def test_columns_of_any_name(spark, tiny):
    names = ["_id", "_hash", "_text", "_block", "_spans", "_kept", "_hits", "_of", "_toxicity", "node", "grp", "size", "target"]
    rows = [(k, f"text number {k} of several that differ in their words {k} {k * 7}", "en", "s", 9, *names) for k in range(5)]
    now = docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, tiny)
        assert now.columns == docs.columns
    assert now.count() == 5 and corpus_pipeline.STAGES[-1][1](spark, now, tiny).count() > 0
