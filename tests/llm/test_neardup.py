import math
import random
import re

import numpy as np
import pytest

from pactlake.llm import neardup


def shingles(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    if len(words) < size:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1))


def brute(rows, size, percent):
    sets = [shingles(t, size) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                parent[find(i)] = find(j)
    least = {}
    for k, (d, _) in enumerate(rows):
        r = find(k)
        least[r] = min(least.get(r, d), d)
    return {d: (len(s), least[find(k)]) for k, ((d, _), s) in enumerate(zip(rows, sets))}


def corpus(seed=1, n=250):
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(300)]
    text = lambda m: [rng.choice(vocab) for _ in range(m)]
    out = [None, "", "  \n", "one", "One", "two words", "Two  words", "a b c"]
    while len(out) < n:
        base = text(rng.randint(3, 160))
        for _ in range(rng.choice([1, 1, 1, 2, 3, 12])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3, 5])):
                copy[rng.randrange(len(copy))] = rng.choice(vocab)
            out.append(" ".join(w.upper() if rng.random() < 0.1 else w for w in copy))
    rng.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize("size,percent,small,task", [(3, 85, 400, 20000), (5, 80, 4, 20000), (3, 85, 4, 6), (5, 80, 4, 6)])
def test_against_brute_force(spark, monkeypatch, size, percent, small, task):
    monkeypatch.setattr(neardup, "SMALL", small)
    monkeypatch.setattr(neardup, "TASK", task)
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(docs, size=size, percent=percent).collect()}
    assert got == brute(rows, size, percent)


def test_nulls_repeats_and_empty(spark):
    text = "the same text of some seven words"
    docs = spark.createDataFrame([(5, text, 1), (5, text, 1), (None, text, 2), (7, None, 3), (None, "another text altogether here", 4)], "doc_id long, text string, component_id int")
    got = sorted((str(r.doc_id), str(r.component_id), r.kept) for r in neardup.near_duplicates(docs).collect())
    assert got == [("5", "5", True), ("5", "5", True), ("7", "7", True), ("None", "5", False), ("None", "None", True)]
    assert neardup.near_duplicates(docs.limit(0)).collect() == []


def family(rng, name, members, changes, words=200):
    """Variants of one text, each with some words changed."""
    base = [f"{name}w{rng.randrange(10**6)}" for _ in range(words)]
    out = []
    for k in range(members):
        copy = list(base)
        for at in rng.sample(range(words), rng.choice(changes)):
            copy[at] = f"x{name}{k}y{at}"
        out.append(" ".join(copy))
    return out


def roots(rows, size, percent):
    """As brute(), for many texts: pairs are met by shared shingles, counted with numpy."""
    sets = [shingles(t, size) for _, t in rows]
    number = {}
    flat = np.array([number.setdefault(x, len(number)) for s in sets for x in s])
    doc = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    count = np.bincount(flat)
    keep = count[flat] > 1
    use = np.unique(flat[keep], return_inverse=True)[1]
    m = np.zeros((len(sets), use.max() + 1), np.float32)
    m[doc[keep], use] = 1
    n, parent = np.array([len(s) for s in sets]), np.arange(len(sets))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in range(0, len(sets), 500):
        common = m[i : i + 500] @ m.T
        for a, b in zip(*np.nonzero(100 * common >= percent * (n[i : i + 500, None] + n[None] - common))):
            x, y = find(a + i), find(b)
            parent[max(x, y)] = min(x, y)
    return {rows[k][0]: rows[find(k)][0] for k in range(len(sets))}


@pytest.mark.parametrize("small,task,leaders", [(256, 512, 32), (20, 50, 4), (8, 12, 1)])
def test_families_around_the_threshold(spark, monkeypatch, small, task, leaders):
    """Most pairs of a family lie just under the threshold, the links that hold it together just above."""
    monkeypatch.setattr(neardup, "SMALL", small)
    monkeypatch.setattr(neardup, "TASK", task)
    monkeypatch.setattr(neardup, "LEADERS", leaders)
    rng = random.Random(7)
    texts = [t for k in range(12) for t in family(rng, f"a{k}", 60, [3])] + family(rng, "b", 300, [3]) + family(rng, "c", 200, [2, 3, 3, 4, 5]) + family(rng, "d", 150, [8])
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == roots(rows, 3, 85)


def test_large_groups(spark):
    """A group of 2,500 near copies, one of 2,500 texts around the threshold, and 2,000 that share half of their shingles."""
    rng = random.Random(8)
    page = [f"p{k}" for k in range(60)]
    texts = family(rng, "a", 2500, [0, 1, 1]) + family(rng, "b", 2500, [3]) + [" ".join(page + [f"q{rng.randrange(10**7)}" for _ in range(55)]) for _ in range(2000)]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got == roots(rows, 3, 85)


@pytest.mark.parametrize("percent", [80, 85, 95])
def test_stated_recall(percent):
    s, least = percent / 100, neardup.least_equal(percent / 100)
    assert neardup.missed(s, neardup.trees(s)) <= neardup.MISS < neardup.missed(s, neardup.trees(s) - 1)
    short = lambda k: sum(math.comb(64, x) * s**x * (1 - s) ** (64 - x) for x in range(k))
    assert short(least) <= neardup.MISS < short(least + 1)
    q = 1.0
    for _ in range(50):  # levels
        q = s * (1 - (1 - q) ** neardup.BRANCH)
        assert q >= 2 - 1 / s - 1e-9


@pytest.mark.parametrize("task", [24, 512])
def test_links_on_crowded_paths(spark, monkeypatch, task):
    """Pairs at 0.8 that share their paths with many texts are found as well as in a table of their own."""
    monkeypatch.setattr(neardup, "SMALL", min(task, 256))
    monkeypatch.setattr(neardup, "TASK", task)
    rng = random.Random(11)
    rows = []
    for k in range(700):  # nine words each, six of them in all texts; the two of a pair share eight of ten
        own = [*"abcdef", f"x{k}", f"y{k}"]
        rows += [(2 * k, " ".join([*own, f"z{rng.randrange(10**9)}"])), (2 * k + 1, " ".join([*own, f"z{rng.randrange(10**9)}"]))]
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size=1, percent=80).collect()}
    assert got == {d: d - d % 2 for d, _ in rows}


def test_columns_of_any_name(spark):
    text = "the same text of some seven words"
    docs = spark.createDataFrame([(1, text, "a", 1, 2, 3, 4), (2, text, "a", 1, 2, 3, 4), (3, "", "b", 1, 2, 3, 4)], "doc_id long, text string, node string, _hash int, _id int, _text_hash int, grp int")
    out = neardup.deduplicate(docs)
    assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == [1, 3]


def test_rows_of_one_id_and_text_leave_the_same_one(spark):
    """Of rows that differ in other columns only, the same one stays however they are dealt."""
    text = "one two three four five six seven eight"
    rows = [(1, text, f"s{k}", {"a": k}) for k in range(40)] + [(2, "another text of other words altogether here", "s", {})]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, extra map<string,int>")
    got = {tuple(sorted((r.doc_id, r.source) for r in neardup.deduplicate(docs.repartition(n)).collect())) for n in (1, 3, 7)}
    assert len(got) == 1 and len(next(iter(got))) == 2
