import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pactlake.llm import langid, toxicity

SF = "/root/testdata/sf0.01"


def test_toxicity_held_out(spark):
    large = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{large}/documents.parquet"), spark.read.parquet(f"{large}/labels.parquet")
    out = toxicity.toxicity(docs, labels).cache()
    assert out.count() == docs.count() and out.where("score < 0 or score > 1 or predicted <> cast(score >= 0.3 as int)").isEmpty()
    # one label for each document here; foreign insults are learned from some forty texts a language
    rows = out.join(labels.select("doc_id", "toxic").distinct(), "doc_id").where("held_out").select("toxic", "score", "predicted").collect()
    pos, neg = ([r for r in rows if r.toxic == k] for k in (1, 0))
    assert sum((p.score > n.score) + 0.5 * (p.score == n.score) for p in pos for n in neg) / (len(pos) * len(neg)) > 0.85
    assert sum(r.predicted for r in neg) < 0.03 * len(neg) and sum(r.predicted for r in pos) > 0.65 * len(pos)
    again = toxicity.toxicity(docs, labels)
    assert out.join(again, ["doc_id", "score"], "left_anti").isEmpty()


def test_toxicity_does_not_see_held_out_labels(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet").limit(200), spark.read.parquet(f"{SF}/labels.parquet")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2
    flipped = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (toxicity.toxicity(docs, x) for x in (labels, flipped))
    assert a.join(b, ["doc_id", "score", "predicted"], "left_anti").isEmpty()


def test_toxicity_edges(spark):
    docs = spark.createDataFrame([(1, "a b", 5), (2, None, 5), (3, "", 5), (None, "you idiot", 5), (4, "you idiot", 5), (4, "you idiot", 5), (5, "x" * 50000, 5)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(1, 0, "z"), (4, 1, "z"), (4, 0, "z"), (5, 0, "z"), (None, 1, "z"), (9, 1, "z"), (3, None, "z")], "doc_id long, toxic int, text string")
    out = toxicity.toxicity(docs, labels).collect()
    assert len(out) == 7 and all(0 <= r.score <= 1 for r in out)
    for l in (labels.limit(0), labels.where("toxic = 0")):
        assert all(r.predicted == 0 for r in toxicity.toxicity(docs, l).collect())
    assert toxicity.toxicity(docs.limit(0), labels).collect() == []


def test_repeated_rows_do_not_enlarge_the_fit(spark):
    """Rows that repeat a labelled id, in copies or with other texts, count as one."""
    rows = [(k, ("you idiot " if k % 3 == 0 else "a kind word ") * (1 + k % 5), "en" if k % 2 else "de") for k in range(60)]
    copies = spark.createDataFrame(rows + [rows[0]] * 2000 + [rows[1]] * 2000, "doc_id long, text string, lang string")
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(60)], "doc_id long, toxic int")
    one, many = toxicity.fit(docs, labels), toxicity.fit(copies, labels)
    assert np.array_equal(one.weight, many.weight) and one.bias == many.bias
    one, many = langid.fit(docs), langid.fit(copies)
    assert np.array_equal(one.weight, many.weight) and one.languages == many.languages
    other = copies.withColumn("text", F.concat("text", F.monotonically_increasing_id().cast("string")))
    seen = []
    true = toxicity.fit_logistic
    toxicity.fit_logistic = lambda starts, *a, **k: seen.append(len(starts) - 1) or true(starts, *a, **k)
    try:
        toxicity.fit(other, labels)
    finally:
        toxicity.fit_logistic = true
    assert seen == [60]


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = langid.languages(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    assert out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.98


def test_language_edges(spark):
    rows = [(k, "the cat and the dog sat there with them " * 3, "en") for k in range(20)] + [(k, "der hund und die katze sind nicht hier gewesen " * 3, "de") for k in range(20, 40)]
    rows += [(50, None, "en"), (51, "", None), (52, "12 34 !!", "de"), (53, "the dog and them", None), (None, "die katze und der hund", "fr"), (54, "É", None)]
    docs = spark.createDataFrame(rows + rows[:3], "doc_id long, text string, lang string")
    got = {}
    for r in langid.languages(docs).collect():
        got.setdefault(r.doc_id, r)
        assert 0 <= r.score <= 1
    assert [got[k].lang_pred for k in (50, 51, 52)] == ["und"] * 3
    assert got[53].lang_pred == "en" and got[None].lang_pred == "de" and got[54].lang_pred in ("en", "de")
    none = langid.languages(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in none} == {"und"}
    one = langid.languages(docs.withColumn("lang", F.lit("xx"))).collect()
    assert {r.lang_pred for r in one} == {"und", "xx"}
    assert langid.languages(docs.limit(0)).collect() == []


def test_codewords_differ():
    for k in (2, 3, 4, 6, 9, 20):
        code = langid.codewords(k)
        assert len({tuple(r) for r in code}) == k and all(abs(int(c.sum())) < k for c in code.T)
    for k in (7, 9, 20, 60):
        code = langid.codewords(k)
        assert len({tuple(c * c[0]) for c in code.T}) == code.shape[1] >= 4 * np.ceil(np.log2(k))


def test_language_against_plain_decoding(spark):
    """The prediction of a fitted model, text by text: grams counted one by one, losses of each codeword summed bit by bit."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    model = langid.fit(docs, per_label=30)
    got = {r.doc_id: (r.lang_pred, r.score, r.ambiguous) for r in langid.predict(docs, model).collect()}
    wrap, f = 2**32, [int(x) for x in langid._FACTORS]

    def feature(h):
        h ^= h >> 15
        return (h * 0x2C1B3C6D % wrap) >> (32 - model.bits)

    for r in docs.collect()[::5]:
        chars = [32]
        for c in f"{r.text.lower()}  ":
            c = ord(c)
            letter = (c >= 192 and c not in (215, 247) and not 0x2000 <= c <= 0x2BFF) or 97 <= c <= 122
            if letter or chars[-1] != 32 or len(chars) == 0:
                chars.append(c if letter else 32)
        n = len(chars) - 2
        features = []
        for i in range(n):
            a, b, c = chars[i : i + 3]
            features += [feature(a * f[0] % wrap), feature((a * f[1] + b * f[2] + 1) % wrap), feature((a * f[2] + b * f[0] + c * f[1] + 2) % wrap)]
        z = [sum(float(model.weight[x, b]) for x in features) * langid.SCALE / max(1, 3 * n) + float(model.bias[b]) for b in range(model.code.shape[1])]
        loss = [sum(float(model.bit_weight[b]) * math.log1p(math.exp(-z[b] * int(word[b]))) for b in range(len(z))) for word in model.code]
        best = min(range(len(loss)), key=lambda k: loss[k])
        near = [math.exp(-4 * (x - loss[best])) for x in loss]
        ranked = sorted(loss)
        pred, score, ambiguous = got[r.doc_id]
        assert pred == model.languages[best] and score == pytest.approx(1 / sum(near), abs=1e-4) and ambiguous == (ranked[1] - ranked[0] < 0.1)


def test_toxicity_against_a_plain_scorer(spark):
    """The log-count ratios from sets of grams, and each text's score as the sum of the weights of its distinct grams."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    bits = 24  # so many that no two grams of this table share a feature
    model = toxicity.fit(docs, labels, bits=bits)
    got = {r.doc_id: r.score for r in toxicity.score(docs.select("doc_id", "text"), model).collect()}
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    mark = {r.doc_id: r.toxic for r in labels.collect() if r.doc_id in texts}

    def grams(text):
        text = f" {text.lower()} ".translate({9: 32, 10: 32, 13: 32}) if text else ""
        return {text[i : i + n] for n in toxicity.ORDERS for i in range(len(text) - n + 1)}

    def feature(gram):
        h = sum(ord(c) * int(toxicity._FACTORS[k]) for k, c in enumerate(gram)) % 2**32
        h ^= h >> 15
        return (h * int(toxicity._FACTORS[len(gram) % 6]) % 2**32) >> (32 - bits)

    own = {d: grams(t) for d, t in texts.items()}
    count = {y: Counter(g for d, k in mark.items() if k == y for g in own[d]) for y in (0, 1)}
    n = Counter(mark.values())
    used = 0
    for g in set(count[0]) | set(count[1]):
        ratio = math.log((count[1][g] + 1) / (n[1] + 2)) - math.log((count[0][g] + 1) / (n[0] + 2))
        if count[0][g] + count[1][g] >= 4 and abs(ratio) >= 0.5:
            used += 1
        elif feature(g) not in shared_features(own, feature):
            assert model.weight[feature(g)] == 0
    assert 0.9 * used < (model.weight != 0).sum() <= used + len(shared_features(own, feature))
    for d, g in list(own.items())[::7]:
        z = sum(float(model.weight[f]) for f in {feature(x) for x in g}) + model.bias
        assert got[d] == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, z)))), abs=1e-6)


_shared: dict = {}


def shared_features(own, feature):
    """Features that two different grams of the table fall on."""
    if id(own) not in _shared:
        seen: dict = {}
        for g in set().union(*own.values()):
            seen.setdefault(feature(g), []).append(g)
        _shared[id(own)] = {f for f, gs in seen.items() if len(gs) > 1}
    return _shared[id(own)]


def test_columns_of_any_name(spark):
    names = ["_letter", "_label", "_text", "_y", "lang_pred", "n_label"]
    docs = spark.createDataFrame([(1, "some text of words", "en", *names), (2, None, "de", *names), (2, None, "de", *names)], "doc_id long, text string, lang string, " + ", ".join(f"`{n}` string" for n in names))
    out = langid.predict(docs, langid.fit(docs))
    assert [c for c in out.columns if c not in ("score", "ambiguous")] == [*[c for c in docs.columns if c != "lang_pred"], "lang_pred"] and out.count() == 3
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    assert toxicity.score(docs, toxicity.fit(docs, labels)).columns == [*docs.columns, "score"]
