import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from pactlake.llm import sharding

SCHEMA = "doc_id long, text string, lang string, source string"


def size(text):
    return len((text or "").encode()) + 16


def check(docs, out, shards, slack):
    """Every row once, gapless slots, and shards of near equal bytes."""
    want = Counter((r.doc_id, size(r.text), zlib.crc32((r.text or "").encode())) for r in docs)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in out) == want
    assert all(r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < shards for r in out)
    slots, total = defaultdict(list), Counter()
    for r in out:
        slots[r.shard].append(r.slot)
        total[r.shard] += r.size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    mean = sum(total.values()) / shards
    assert all(abs(total[k] - mean) <= slack for k in range(shards)), (mean, total)


@pytest.mark.parametrize("shards", [40, 7, 1])
def test_given_table(spark, shards):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    docs = table.collect()
    out = sharding.shard_documents(table, shards).collect()
    check(docs, out, shards, slack=1.5 * max(size(r.text) for r in docs))
    again = sharding.shard_documents(table, shards).collect()
    assert {(r.doc_id, r.shard, r.slot) for r in out} == {(r.doc_id, r.shard, r.slot) for r in again}


def brute_force(points, shards):
    """The same tree by sorting: list of rows (places, size) -> shard of each row."""
    points = [(p, s, i) for i, (p, s) in enumerate(points)]
    span = [max(1, max(p[d] for p, _, _ in points) - min(p[d] for p, _, _ in points)) for d in range(4)]
    out = {}

    def cut(rows, k, first):
        if k == 1:
            out.update((i, first) for _, _, i in rows)
            return
        width = [(max(p[d] for p, _, _ in rows) - min(p[d] for p, _, _ in rows)) / span[d] for d in range(4)]
        dim = int(np.argmax(width))
        rows = sorted(rows, key=lambda r: r[0][dim])
        goal, upto, last = sum(s for _, s, _ in rows) * (k // 2) // k, 0, 0
        for n, (_, s, _) in enumerate(rows):
            if upto + s >= goal:
                last = n + 1 if n == 0 or upto + s - goal <= goal - upto else n
                break
            upto += s
        cut(rows[:last], k // 2, first)
        cut(rows[last:], k - k // 2, first + k // 2)

    cut(points, shards, 0)
    return out


def test_tree_against_sorting(spark, tiny):
    held = sharding.cut_lineage(sharding.points(spark.read.parquet(f"{tiny}/documents.parquet")))
    rows = held.collect()
    places = {tuple(r[p] for p in sharding.PLACES): k for k, r in enumerate(rows)}
    assert len(places) == len(rows)
    want = brute_force([(tuple(r[p] for p in sharding.PLACES), r["size"]) for r in rows], 11)
    got = {places[tuple(r[p] for p in sharding.PLACES)]: r["shard"] for r in sharding.assign(held, 11).collect()}
    assert got == want


def test_hot_source_hot_text_and_repeated_rows(spark):
    rows = [(k, f"text {k}", "en", "hot") for k in range(3000)] + [(k, "the same text", "en", "hot") for k in range(3000, 6000)] + [(7, "one row", "de", "other")] * 3000 + [(None, None, None, None)] * 50 + [(9, "long " * 2000, "en", "x")]
    df = spark.createDataFrame(rows, SCHEMA)
    check(df.collect(), sharding.shard_documents(df, 8).collect(), 8, slack=11_000)
    plain = df.where("doc_id is not null and doc_id <> 9")
    check(plain.collect(), sharding.shard_documents(plain, 8).collect(), 8, slack=100)


def test_slots_of_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BUCKET", 20)
    rows = [(k % 700, f"text {k % 700}", "en", "a") for k in range(1500)] + [(7, "one row", "de", "other")] * 900
    df = spark.createDataFrame(rows, SCHEMA)
    check(df.collect(), sharding.shard_documents(df, 5).collect(), 5, slack=60)


def test_empty_few_and_clashing_names(spark, tmp_path):
    assert sharding.shard_documents(spark.createDataFrame([], SCHEMA)).count() == 0
    few = spark.createDataFrame([(1, "a", None, None), (2, "", "x", "y")], SCHEMA)
    assert sorted((r.doc_id, r.size, r.slot) for r in sharding.shard_documents(few, 40).collect()) == [(1, 17, 0), (2, 16, 0)]
    rows = [(k, f"text {k}", "en", "a", k, "s", 0.5) for k in range(300)]
    df = spark.createDataFrame(rows, SCHEMA + ", shard int, p0 string, `_shard` double")
    check(df.collect(), sharding.shard_documents(df, 4).collect(), 4, slack=60)
    sharding.write_shards(df, str(tmp_path / "out"), target_bytes=2000)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(tuple(r) for r in back.select(*[f"`{c}`" for c in df.columns]).collect()) == sorted(rows)
    shards = {r["_shard_"]: r["n"] for r in back.groupBy("_shard_").agg({"doc_id": "count"}).withColumnRenamed("count(doc_id)", "n").collect()}
    assert len(shards) == 4 and max(shards.values()) - min(shards.values()) <= 4
