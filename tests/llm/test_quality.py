import random

from pactlake.llm import quality


def brute(text, least=8):
    text = text or ""
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    n = len(words)
    windows = {}
    for p in range(n - least + 1):
        windows.setdefault(tuple(words[p : p + least]), []).append(p)
    covered = set()
    for places in windows.values():
        if len(places) > 1:
            for p in places:
                covered.update(range(p, p + least))
    longest = 0
    for i in range(n):
        for j in range(i + 1, n):
            k = 0
            while j + k < n and words[i + k] == words[j + k]:
                k += 1
            if k >= least:
                longest = max(longest, k)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), longest)


def test_against_brute_force(spark):
    rng = random.Random(2)
    vocab = ["a", "bb", "é", "#x", "**", "longer", "<b>", "w x"]
    texts = [None, "", "   \n\t", "one", "a " * 40, "line\nline\n\nline \nother\nline", "\n\na\n", "x\x0by\x0cz"]
    for _ in range(60):
        line = lambda: " ".join(rng.choice(vocab) for _ in range(rng.randint(0, 14)))
        stock = [line() for _ in range(3)]
        texts.append("\n".join(rng.choice([line(), rng.choice(stock)]) for _ in range(rng.randint(1, 12))))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.longest_repeat) for r in quality.quality(docs).collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts)}


def test_verdicts_and_empty(spark):
    fresh = " ".join(f"w{i}" for i in range(200))
    docs = spark.createDataFrame([(1, fresh, "s"), (2, fresh + " " + fresh, "s"), (3, "few words", "s"), (1, fresh, "s")], "doc_id long, text string, n_words string")
    got = sorted((r.doc_id, r.base_failed, r.kept) for r in quality.quality(docs).collect())
    assert got == [(1, False, True), (1, False, True), (2, True, False), (3, True, False)]
    assert quality.quality(docs.limit(0)).collect() == []
