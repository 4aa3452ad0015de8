import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import Row

from pactlake.llm import spelling

SCHEMA = "doc_id long, text string"


def brute_force(rows):
    count = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                count[run] += 1
    n = {w: k for w, k in count.items() if k >= 2}
    near, masks = defaultdict(set), defaultdict(list)
    for w in n:
        for i in range(len(w)):
            masks[w[:i], w[i + 1 :]].append(w)
            shorter = w[:i] + w[i + 1 :]
            if shorter in n:
                near[w].add(shorter)
                near[shorter].add(w)
    for group in masks.values():
        for w in group:
            near[w].update(o for o in group if o != w)
    best = {w: min(((-n[o], o) for o in near[w]), default=None) for w in n}
    form = {w: b[1] if b and -b[0] >= 10 * n[w] else None for w, b in best.items()}
    out = {}
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None)
    return out


def result(df):
    rows = df.collect()
    out = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(out) == len(rows)
    return out


def test_whole_table(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    want = brute_force([(r.doc_id, r.text) for r in docs.collect()])
    assert result(spelling.variants(docs)) == want and any(v[0] for v in want.values())


def test_chains_ties_and_odd_rows(spark):
    text = ("receive " * 2000 + "recieve " * 2 + "recceive " * 20 + "reccceive " * 2 + "Receive ÀÉÎÕÜßÿ " + "àÉÎÕÜßÿ ÀÉÎÕÜßÿ àÉÎÕÜßÿ ÀÉÎÕÜß ÀÉÎÕÜß ÀÉÎÕÜßÿÿ ÀÉÎÕÜßÿÿ short short ")
    long = "ab" * 4000
    rows = [(1, text), (2, None), (3, ""), (None, "receive x"), (5, "planned plammed"), (5, "planned plammed"), (7, f"{long} {long}c {long[:-1]}c"), (8, f"{long} {long}c {long[:-1]}c"), (9, "aaaaaaa aaaaaaaa aaaaaaaaa " * 3)]
    got = result(spelling.variants(spark.createDataFrame(rows, SCHEMA)))
    assert got == brute_force(rows)
    assert got["reccceive"][:2] == ("recceive", "receive")


def test_empty_clashing_names_and_repeated_rows(spark):
    assert spelling.variants(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(1, "wordone wordtwo"), (1, "wordone wordtwo"), (1, "wordone wordtwo")]
    docs = spark.createDataFrame([Row(doc_id=a, text=b, word=1, near="x", cell=None, n=2, h=3, root=[1]) for a, b in rows], "doc_id long, text string, word int, near string, cell int, n int, h int, root array<int>")
    assert result(spelling.variants(docs)) == brute_force(rows)


def test_cells_are_cut(spark, tiny, monkeypatch):
    """Trees of several cells, and cells whose words and queries are cut into parts, find the same pairs."""
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    vocab = spelling.cut_lineage(spelling.vocabulary(spelling.runs(docs), 1))
    want = {(r.word, r.near, r.near_n) for r in spelling.near_words(vocab).collect()}
    monkeypatch.setattr(spelling, "CELL", 60)
    monkeypatch.setattr(spelling, "LONG", 9)
    rows = [(r.word, r.near, r.near_n) for r in spelling.near_words(vocab).collect()]
    assert set(rows) == want and len(rows) == len(want) > 1000


@pytest.mark.parametrize("size", [7, 200])
def test_pairs_within_a_cell(size):
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(size)
    base = ["".join(rng.choice(list("abcé"), size)) for _ in range(3)]
    words = set(base)
    for w in base:
        for _ in range(150):
            i, c = int(rng.integers(size)), str(rng.choice(list("abcé")))
            words |= {w[:i] + c + w[i + 1 :], w[:i] + c + w[i:], w[:i] + w[i + 1 :]}
    words = sorted(words)

    def one_edit(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    want = {(a, b) for a in words for b in words if (len(a), a) < (len(b), b) and one_edit(a, b)}
    q, w = spelling.near_pairs(pa.array(words), pa.array(words))
    got = [(words[i], words[j]) for i, j in zip(q, w, strict=True)]
    assert set(got) == want and len(got) == len(want)
