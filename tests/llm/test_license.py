import random
import time

from pactlake.llm import license as lic


def test_increasing_and_align():
    assert lic.increasing([(0, 3), (1, 1), (2, 2), (3, 5), (4, 4)]) in ([(1, 1), (2, 2), (3, 5)], [(1, 1), (2, 2), (4, 4)])
    assert lic.align("a b c d".split(), "x b y d".split()) == [(1, 1), (3, 3)]
    assert lic.align("a a b a".split(), "a b a".split()) == [(0, 0), (2, 1), (3, 2)]
    rng = random.Random(3)
    for _ in range(300):
        a, b = ([rng.choice("abcdefg") for _ in range(rng.randint(0, 12))] for _ in range(2))
        got = lic.align(a, b)
        assert all(a[i] == b[j] for i, j in got)
        assert all(p < r and q < s for (p, q), (r, s) in zip(got, got[1:]))


def test_scan(spark):
    rng = random.Random(4)
    noise = lambda n: " ".join("".join(rng.choice("aeiorst") for _ in range(5)) for _ in range(n))
    apache, mit, gpl = (lic.TEMPLATES[k][1] for k in (0, 3, 6))
    docs = [
        (0, None), (1, ""), (2, noise(300)), (3, noise(50) + "\n" + apache + "\n" + noise(50)), (4, mit.upper()), (5, gpl.replace("work", "thing") + " " + noise(9)),
        (6, mit + " " + noise(100) + " " + mit), (7, apache + " " + noise(3) + " " + mit), (8, "the license of this village is a general thing"), (9, noise(2000) + " " + lic.TEMPLATES[4][1]),
        (10, mit + "\n" + mit),
    ]
    frame = spark.createDataFrame([(*d, 1.5) for d in docs], "doc_id long, text string, coverage double")
    got = {r.doc_id: (r.license, r.n_notices, r.licenses) for r in lic.licenses(frame).collect()}
    assert got[3] == ("Apache-2.0", 1, ["Apache-2.0"])
    assert got[4][0] == "MIT" and got[5][0] == "GPL-3.0" and got[9][0] == "MIT"
    assert got[6] == ("MIT", 2, ["MIT"]) and got[10] == ("MIT", 2, ["MIT"])
    assert got[7][1:] == (2, ["Apache-2.0", "MIT"])
    assert all(got[k] == (None, 0, []) for k in (0, 1, 2, 8))
    assert lic.licenses(frame.limit(0)).collect() == []


def test_notices_without_their_first_word_in_prose():
    rng = random.Random(5)
    noise = lambda n: " ".join("".join(rng.choice("aeiorst") for _ in range(5)) for _ in range(n))
    scanner = lic.Scanner(lic.TEMPLATES, 0.8)
    notices = [("MIT", "Distributed under the MIT License."), *((name, text.split(" ", 1)[1]) for name, text in lic.TEMPLATES if len(lic.words(text)) > 5)]
    for name, notice in notices:
        for before, after in ((0, 0), (80, 80), (7, 300)):
            text = f"{noise(before)} {notice} {noise(after)}"
            found = scanner(text)
            assert [x["license"] for x in found] == [name], notice
            assert found[0]["coverage"] >= 0.8 and text.find(notice) <= found[0]["start"] < found[0]["end"] <= text.find(notice) + len(notice)
        two = scanner(f"{noise(40)} {notice} {noise(60)} {notice} {noise(40)}")  # places of one region
        assert [x["license"] for x in two] == [name, name]


def longest_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(max(row[j + 1], new[-1], row[j] + (x == y)))
        row = new
    return row[-1]


def test_against_brute_force():
    """All windows from all words of all templates, without filters: the same licences are covered, to the same degree."""
    rng = random.Random(6)
    short = tuple((name, text) for name, text in lic.TEMPLATES if len(lic.words(text)) < 40)
    vocab = sorted({w for _, text in short for w, _, _ in lic.words(text)})
    least, scanner = 0.8, lic.Scanner(short, 0.8)
    hits = 0
    for _ in range(120):
        parts = []
        for _ in range(rng.randint(1, 5)):
            own = [w for w, _, _ in lic.words(rng.choice(short)[1])]
            for _ in range(rng.randint(0, max(1, len(own) // 4))):
                k = rng.randrange(len(own))
                own[k : k + 1] = rng.choice([[], [rng.choice(vocab)], [own[k], rng.choice(vocab)]])
            parts += own + [rng.choice([rng.choice(vocab), "prose"]) for _ in range(rng.choice([0, 0, 3, 20]))]
        best, plain = {}, {}
        for t in (lic.Template(*x, least) for x in short):
            key = (t.license, tuple(t.words))
            for p in range(len(parts)):
                for reach in t.reach:
                    pairs = lic.align(parts[p : p + reach], t.words)
                    if len(pairs) >= least * t.size:
                        best[key] = max(best.get(key, (-999,)), lic.dense((len(pairs), p + pairs[0][0], p + pairs[-1][0])))
                if longest_common(parts[p : p + t.reach[1]], t.words) >= least * t.size:
                    plain[key] = True
        alone = {}
        for t in (lic.Template(*x, least) for x in short):  # template by template: of notices that overlap only one is reported
            for x in t.notices(parts):
                key = (t.license, tuple(t.words))
                alone[key] = max(alone.get(key, (-999,)), lic.dense(x))
        assert alone == best
        assert alone.keys() <= plain.keys()
        found = scanner(" ".join(parts))
        assert {x["license"] for x in found} <= {k for k, _ in best} and bool(found) == bool(best)
        assert all(a["end"] <= b["start"] for a, b in zip(found, found[1:]))
        hits += len(found)
    assert hits > 150


def test_each_template_is_found_in_full_and_in_part():
    rng = random.Random(7)
    noise = lambda n: " ".join("".join(rng.choice("aeiorst") for _ in range(5)) for _ in range(n))
    scanner = lic.Scanner(lic.TEMPLATES, 0.8)
    for name, text in lic.TEMPLATES:
        got = scanner(f"{noise(50)} {text} {noise(50)}")
        assert [(x["license"], x["coverage"]) for x in got] == [(name, 1.0)]
        own = text.split()
        if len(own) > 20:
            for at in rng.sample(range(1, len(own)), len(own) // 12):
                own[at] = "other"
            assert [x["license"] for x in scanner(f"{noise(50)} {' '.join(own)} {noise(50)}")] == [name]
    assert [x["license"] for x in scanner("Distributed under CC BY-NC 4.0.")] == ["CC-BY-NC-4.0"]


def test_long_texts_take_linear_time():
    scanner = lic.Scanner(lic.TEMPLATES, 0.8)
    took = []
    for n in (12_500, 50_000):
        began = time.process_time()
        assert len(scanner("All rights reserved. " * n)) == n
        took.append(time.process_time() - began)
    assert took[1] < 20 and took[1] < 8 * took[0] + 1
    began = time.process_time()
    assert {x["license"] for x in scanner((lic.TEMPLATES[4][1] + "\n") * 4000)} == {"MIT"}
    assert scanner("the license of this software is the license under the terms of the public and general copy " * 10_000) == []
    assert time.process_time() - began < 60


def test_words_of_licences_in_mixed_order_take_little_time():
    """The longest common subsequence of each window bounds how many next ones can be passed over; a notice among such words is found."""
    rng = random.Random(8)
    scanner = lic.Scanner(lic.TEMPLATES, 0.8)
    pool = [w for _, t in lic.TEMPLATES for w, _, _ in lic.words(t)]
    text = " ".join(rng.choice(pool) for _ in range(170_000))
    began = time.process_time()
    found = scanner(text + "\n" + lic._ZLIB + "\n" + text)
    assert time.process_time() - began < 40 and len(text) > 1_000_000
    assert {"license": "Zlib", "coverage": 1.0} in [{k: x[k] for k in ("license", "coverage")} for x in found]


def test_longest_common_subsequence_bounds_alignments():
    rng = random.Random(2)
    t = lic.Template("x", "a b c d e f g h a c", 0.6)
    for _ in range(300):
        have = [rng.choice("abcdefghz") for _ in range(40)]
        at = rng.randrange(20)
        window, row = have[at : at + t.reach[1]], [0] * (t.size + 1)
        for w in window:
            last = row[:]
            for k, v in enumerate(t.words, 1):
                row[k] = last[k - 1] + 1 if v == w else max(last[k], row[k - 1])
        assert t.common(have, at) == row[-1] >= len(lic.align(window, t.words))
