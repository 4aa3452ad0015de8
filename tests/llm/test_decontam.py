import random

import pytest

from pactlake.llm import decontam


def least(pattern, text):
    """Least distance of the pattern to any substring, by the table."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (p != t)))
        row = new
    return min(row)


def edited(rng, text, n):
    out = list(text)
    for _ in range(n):
        k = rng.randrange(len(out))
        out[k : k + 1] = rng.choice([[], [rng.choice("xyz")], [out[k], rng.choice("xyz")]])
    return "".join(out)


def test_distance_against_table():
    rng = random.Random(1)
    for _ in range(200):
        p = "".join(rng.choice("abc") for _ in range(rng.randint(1, 40)))
        t = "".join(rng.choice("abc") for _ in range(rng.randint(0, 80)))
        assert decontam.nearest(decontam.masks(p), len(p), t)[0] == least(p, t)


@pytest.mark.parametrize("block_chars", [10**6, 300])
def test_against_brute_force(spark, block_chars):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    items = [(k, text(rng.randint(8, 30))) for k in range(12)] + [(90, None), (91, "tiny"), (92, "")]
    docs = [None, "", "x", text(200)]
    for _ in range(60):
        _, item = rng.choice(items[:12])
        docs.append(text(rng.randint(0, 30)) + " " + edited(rng, item.upper() if rng.random() < 0.3 else item, rng.randint(0, 14)) + "\n" + text(rng.randint(0, 30)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    frame = spark.createDataFrame([(k, t, "s") for k, t in enumerate(docs)], "doc_id long, text string, item_id string")
    got = {r.doc_id: sorted({h.item for h in r._hits}) for r in decontam.match(frame, bench, block_chars=block_chars).collect()}
    want = {}
    for d, t in enumerate(docs):
        want[d] = []
        for k, item in items[:12]:
            p = decontam.plain(item).strip()
            if t and least(p, decontam.plain(t)) <= decontam.budget(len(p), 0.08):
                want[d].append(k)
    assert got == want
    assert sum(map(bool, want.values())) > 15
    kept = {r.doc_id for r in decontam.clean(frame, bench).collect()}
    assert kept == {d for d, x in want.items() if not x}
    assert decontam.contamination(frame, bench.limit(0)).where("contaminated").count() == 0
    assert decontam.contamination(frame.limit(0), bench).count() == 0


@pytest.mark.parametrize("block_chars", [10**6, 5])
def test_short_items(spark, block_chars):
    bench = spark.createDataFrame([(1, " Who won? "), (2, "iron ore"), (3, "Iron\tore"), (4, " \n"), (5, None), (6, "(c) 42")], "item_id long, text string")
    docs = ["and WHO WON? they asked", "whoso won?", "iron\nore, then iron ores", "environ ore", "iron orb", "x(c) 42.", "(c) 421", "", None]
    frame = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    got = {r.doc_id: [(h.item, h.distance, h.start, h.end) for h in r._hits] for r in decontam.match(frame, bench, block_chars=block_chars).collect()}
    assert got == {0: [(1, 0, 4, 12)], 1: [], 2: [(2, 0, 0, 8), (3, 0, 0, 8)], 3: [], 4: [], 5: [(6, 0, 1, 7)], 6: [], 7: [], 8: []}


@pytest.mark.parametrize("block_chars", [10**6, 60])
def test_items_of_all_lengths(spark, block_chars):
    """Items of 0 to 40 characters with white space of all kinds at their ends, in one block and in several."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcd") for _ in range(rng.randint(1, 4)))
    space = lambda: "".join(rng.choice(" \n\t\r") for _ in range(rng.randint(0, 5)))
    cores = ["", "x", *(" ".join(word() for _ in range(n)) for n in (1, 2, 3, 4, 6, 8, 10, 12, 14) for _ in range(2))]
    items = [(k, space() + c + space()) for k, c in enumerate(cores)] + [(70, "\n" * 30), (71, "x" + "\n" * 30), (72, None)]
    docs = [None, "", "\n" * 40, "x", "xx", "-x-"] + [" ".join(rng.choice([word(), rng.choice(cores), edited(rng, rng.choice(cores[-6:]), 1)]) for _ in range(6)) for _ in range(40)]
    docs += docs[-3:] + ["long text " * 100_000 + cores[-1]]
    frame = spark.createDataFrame([(k, t, 1, "u") for k, t in enumerate(docs)], "doc_id long, text string, _hits int, _of string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: [(h.item, h.distance) for h in r._hits] for r in decontam.match(frame, bench, block_chars=block_chars).collect()}
    for d, t in enumerate(docs[:-1]):
        text, want = decontam.plain(t or ""), set()
        for k, item in items:
            p = decontam.plain(item or "").strip()
            if not p:
                continue
            if len(p) < 24:
                hit = any(text.startswith(p, a) and decontam.bordered(text, a, a + len(p)) for a in range(len(text)))
            else:
                hit = least(p, text) <= decontam.budget(len(p), 0.08)
            if hit:
                want.add(k)
        assert {k for k, _ in got[d]} == want, (d, t)
        assert got[d] == sorted(got[d], key=lambda h: h[0])
    assert len(cores) - 1 in {k for k, _ in got[len(docs) - 1]}
    assert sum(map(bool, got.values())) > 20
    kept = decontam.clean(frame, bench)
    assert kept.columns == frame.columns and {r.doc_id for r in kept.collect()} == {d for d, h in got.items() if not h}
