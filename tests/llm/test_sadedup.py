import hashlib
import random

import pyarrow as pa
import pytest

from pactlake.llm import sadedup

SCHEMA = "doc_id long, text string, source string"


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = {}
    for d, b in enumerate(data):
        for p in range(len(b) - length + 1):
            seen.setdefault(b[p : p + length], []).append((d, p))
    gone = [[False] * len(b) for b in data]
    for places in seen.values():
        if len(places) > 1:
            for d, p in places:
                gone[d][p : p + length] = [True] * length
    out = []
    for b, g in zip(data, gone):
        kept = bytes(x for x, y in zip(b, g) if not y)
        spans = sum(y and (i == 0 or not g[i - 1]) for i, y in enumerate(g))
        out.append((len(b), sum(g), spans, hashlib.sha256(kept).hexdigest()))
    return out


def texts():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randint(1, 6)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = [text(8) for _ in range(4)]
    out = [None, "", "short", "x" * 150, "ab" * 60, text(30)]
    for k in range(40):
        out.append(" ".join(rng.choice([text(rng.randint(1, 9)), rng.choice(shared)]) for _ in range(rng.randint(1, 6))))
    base = text(40)
    out += [base] * 5 + [base[: len(base) // 2] + "Q" + base[len(base) // 2 :], base[10:60]]
    return out


@pytest.mark.parametrize("length,block_bytes", [(20, 1 << 20), (20, 900), (32, 500)])
def test_against_brute_force(spark, length, block_bytes):
    rows = [(i, t, "s") for i, t in enumerate(texts())]
    rows += [(3, "x" * 150, "s")]  # a repeated row
    docs = spark.createDataFrame(rows, SCHEMA)
    out = sadedup.repeated_spans(docs.select("doc_id", "text"), length=length, block_bytes=block_bytes).collect()
    expected = brute([r[1] for r in rows], length)
    want = sorted((r[0], *e) for r, e in zip(rows, expected))
    got = sorted((r.doc_id, len((r.text or "").encode()), sum(b - a for a, b in r._spans), len(r._spans), hashlib.sha256(bytes(r._kept)).hexdigest()) for r in out)
    assert got == want
    assert sum(w[2] for w in want) > 500


def test_pieces_of_a_long_text(spark, monkeypatch):
    monkeypatch.setattr(sadedup, "CHUNK", 64)
    rng = random.Random(5)
    words = ["".join(rng.choice("abc") for _ in range(5)) for _ in range(12)]
    docs = [" ".join(rng.choice(words) for _ in range(80)) for _ in range(6)]
    import numpy as np

    buf = np.frombuffer("".join(docs).encode(), np.uint8)
    offs = np.cumsum([0, *map(len, docs)])
    covered = set()
    for lo, hi, *_ in sadedup.runs(buf, offs, 30):
        for a, b in zip(lo, hi):
            covered.update(range(a, b + 1))
    assert covered == {p for s, e in zip(offs[:-1], offs[1:]) for p in range(s, e - 29)}


def test_empty_and_texts_kept_valid(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert sadedup.digest(empty).collect() == []
    same = "é" * 300
    docs = spark.createDataFrame([(1, same, "a"), (2, same + "z", "b"), (3, None, None), (4, "keep", "c")], SCHEMA)
    out = {r.doc_id: r.text for r in sadedup.remove_repeats(docs).collect()}
    assert out == {1: "", 2: "z", 3: None, 4: "keep"}


def test_columns_of_any_name(spark):
    names = ["_block", "_spans", "_kept", "_text", "c0", "_shard", "of", "key"]
    docs = spark.createDataFrame([(1, "ab" * 300, *names), (2, "ab" * 300, *names), (2, None, *names)], "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names))
    out = sadedup.remove_repeats(docs, length=100)
    assert out.columns == docs.columns
    assert sorted((r.doc_id, r.text, *r[2:]) for r in out.collect() if r.text is not None) == [(1, "", *names), (2, "", *names)] and out.where("text is null").count() == 1


def test_plans_of_wide_tables(spark, monkeypatch):
    """The blocks that are looked at for hot anchors carry no column but the text: what Spark derives from their choice doubles with each."""
    seen, plain = [], sadedup.hot_anchors
    monkeypatch.setattr(sadedup, "hot_anchors", lambda sample, *a: seen.append(sample) or plain(sample, *a))
    names = [f"n{k}" for k in range(9)]
    docs = spark.createDataFrame([(1, "ab" * 300, *names), (2, "ab" * 300, *names)], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    assert sorted((r.doc_id, r.text, *r[2:]) for r in sadedup.remove_repeats(docs, length=100).collect()) == [(1, "", *names), (2, "", *names)]
    assert seen[0]._jdf.queryExecution().optimizedPlan().children().head().output().size() <= 3


def test_a_very_long_text(spark):
    rng = random.Random(9)
    shared = "".join(rng.choice("abcdefghij ") for _ in range(3000))
    long = "".join(rng.choice("abcdefghij ") for _ in range(3_000_000)) + shared
    out = {r.doc_id: (r.n_removed, r.n_spans) for r in sadedup.digest(spark.createDataFrame([(1, long, "a"), (2, "x" + shared + "y", "a"), (3, "é" * 1_000_000, "b")], SCHEMA)).collect()}
    assert out[1][1] == out[2][1] == 1 and 3000 <= out[1][0] <= 3002 and out[2][0] == out[1][0] and out[3] == (2_000_000, 1)


def test_rows_grow_with_the_input():
    """What the blocks send grows with the text, not with the square of the number of blocks, and a passage in all blocks has a row for each."""
    rng = random.Random(12)
    text = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    shared, sent = text(500), []
    for blocks in (4, 16):
        rows = [sadedup.run_counts(*sadedup.text_bytes(pa.array([text(4000) + shared * 3 for _ in range(3)])), 100) for _ in range(blocks)]
        sent.append(sum(len(r[0]) for r in rows))
        pairs = [set(zip(r[0].tolist(), r[1].tolist())) for r in rows]
        assert all(len(p) == len(r[0]) and r[2].max() >= 9 for p, r in zip(pairs, rows)) and set.intersection(*pairs)
    assert 3.8 < sent[1] / sent[0] < 4.2


@pytest.mark.parametrize("length", [20, 32])
def test_anchors_in_many_surroundings(spark, length):
    """A passage shorter than the window, in differing words in all documents, is dealt apart; the result is the same."""
    rng = random.Random(length)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))
    passage = "the same words stand here for all"[: length - 3]
    rows = [(k, f"{word()} {word()} {passage} {word()} {word()}" + (" and the very same end of the text" if k % 9 == 0 else ""), "s") for k in range(300)] + [(k, t, "s") for k, t in enumerate(texts(), 300)]
    out = spark.createDataFrame(rows, SCHEMA)
    want = brute([t for _, t, _ in rows], length)
    for hot_rows in (3, 100_000):
        spans = sadedup.repeated_spans(out, length=length, block_bytes=2000, hot_rows=hot_rows)
        got = {r.doc_id: (len((r.text or "").encode()), len((r.text or "").encode()) - len(r._kept), len(r._spans), hashlib.sha256(r._kept).hexdigest()) for r in spans.collect()}
        assert [got[k] for k, _, _ in rows] == want


def test_totals_of_hot_anchors(spark):
    rng = random.Random(5)
    rows = {(rng.randrange(40), rng.choice([7, 7, 7, rng.randrange(100, 400)]), rng.randrange(300)) for _ in range(3000)}
    sent = spark.createDataFrame([(*r, rng.randrange(1, 4)) for r in sorted(rows)], "_block int, anchor long, whole long, n long")
    hot = sadedup.hot_anchors(sent.where("_block < 20"), 0.5, 50)
    assert 7 in [r.anchor for r in hot.collect()] and sadedup.hot_anchors(sent, 1.0, 10**9) is None
    a, b = (sorted(tuple(r) for r in sadedup.totals(sent, h).collect()) for h in (hot, None))
    assert a == b and len(a) > 1000
