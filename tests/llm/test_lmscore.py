import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from pactlake.llm import lmscore


class Plain:
    """The model byte by byte, with dictionaries."""

    def __init__(self, texts):
        self.seen = defaultdict(Counter)
        for t in texts:
            data = bytes(lmscore.ORDER) + t.encode() + b"\0"
            for p in range(lmscore.ORDER, len(data)):
                for k in range(lmscore.ORDER + 1):
                    self.seen[data[p - k : p]][data[p]] += 1

    def score(self, text):
        data, total = bytes(lmscore.ORDER) + text.encode() + b"\0", 0.0
        for p in range(lmscore.ORDER, len(data)):
            prob, gone = 1.0, set()
            for k in range(lmscore.ORDER, -1, -1):
                seen = self.seen.get(data[p - k : p])
                if not seen:
                    continue
                left = {s: c for s, c in seen.items() if s not in gone}
                if not left:
                    continue
                whole = sum(left.values()) + len(left)
                if data[p] in left:
                    prob *= left[data[p]] / whole
                    break
                prob *= len(left) / whole
                gone |= left.keys()
            else:
                prob /= 256 - len(gone)
            total += math.log10(prob)
        return total


def corpus():
    rng = random.Random(4)
    vocab = ["alpha", "Beta", "gamma", "délta", "x", "yy", "Zeta"]
    texts = [None, "", "alpha", "unseen ЖЖ"]
    texts += [" ".join(rng.choice(vocab) for _ in range(rng.randint(1, 30))) + rng.choice(["", "\n", " q" + str(rng.random())]) for _ in range(60)]
    return list(enumerate(texts))


def test_against_plain_models(spark):
    rows = corpus()
    docs = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, score string")
    got = {r.doc_id: r for r in lmscore.scores(docs, block_bytes=700).collect()}
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d, _ in rows}
    tokens = {d: [w.lower() if w.isascii() else re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")] + [None] for d, t in rows}
    counts = Counter(w for d in tokens if not held[d] for w in tokens[d])
    n, v = sum(counts.values()), len(counts)
    plain = Plain([t or "" for d, t in rows if not held[d]])
    assert any(held.values()) and len(got) == len(rows)
    for d, t in rows:
        r = got[d]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[d], len(tokens[d]), sum(counts[w] > 0 for w in tokens[d]), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens[d]), abs=1e-9)
        assert r.score == pytest.approx(plain.score(t or ""), abs=1e-8)


def test_a_whole_table_against_the_plain_model(spark):
    """Whole texts of all documents, in two sizes of block: no count is left out, whatever the size."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    plain = Plain([t or "" for d, t in rows if zlib.crc32(str(d).encode()) % 7 != 2])
    some = [(d, t) for d, t in rows if len(t or "") < 3000][::9]
    for block_bytes in (200_000, 16 << 20):
        got = {r.doc_id: r.score for r in lmscore.scores(docs, block_bytes=block_bytes).collect()}
        assert len(got) == len(rows)
        for d, t in some:
            assert got[d] == pytest.approx(plain.score(t or ""), abs=1e-7)


def test_edges(spark):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string")
    assert lmscore.scores(docs.limit(0)).collect() == []
    alone = lmscore.scores(spark.createDataFrame([(None, "a"), (None, "a")], "doc_id long, text string")).collect()
    assert len(alone) == 2 and not alone[0].held_out
    held = next(k for k in range(100) if zlib.crc32(str(k).encode()) % 7 == 2)
    none = lmscore.scores(spark.createDataFrame([(held, "abc")], "doc_id long, text string")).collect()[0]
    assert none.train_tokens == none.n_known == 0 and none.score == pytest.approx(-4 * math.log10(256))
    long = lmscore.scores(spark.createDataFrame([(1, "long words " * 300_000), (2, None)], "doc_id long, text string")).collect()
    assert all(math.isfinite(r.score) and r.score < 0 for r in long)
