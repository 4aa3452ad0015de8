import math
import random
import string
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from pactlake.llm import mixing, urlfilter


def oracle(rows):
    c = duckdb.connect()
    c.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    if rows:
        c.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    return sorted(map(str, (tuple(r) for r in c.sql(f"SELECT doc_id, source, size, source_size, target, taken, passes FROM ({mixing.ORACLE})").fetchall())))


def mixed(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix(docs.withColumn("size", F.lit("x")).withColumn("target", F.lit(1)))
    return sorted(str(tuple(r)) for r in out.select("doc_id", "source", "size", "source_size", "target", "taken", "passes").collect())


@pytest.mark.parametrize("digits", [1, 2, 3, 5])
def test_mixing_against_sql(spark, monkeypatch, digits):
    monkeypatch.setattr(mixing, "_digits", lambda n: digits)
    rows = [(k, "w " * ((k * 37) % 90), f"s{min(k % 11, 4)}") for k in range(400)]
    rows += [(500, None, "s1"), (501, "", None), (502, "a b c", None), (503, " \n", "empty"), (504, "long " * 5000, "big")]
    rows += [(None, f"w{k} " * (k % 7), "s1") for k in range(60)]
    assert mixed(spark, rows) == oracle(rows)


def test_mixing_ties_at_the_cut(spark):
    """Documents of one size in sources of one size: finish times tie throughout, and the cut falls among them."""
    rows = [(k, "w w w", f"s{k % 4}") for k in range(80)]
    assert mixed(spark, rows) == oracle(rows)
    assert mixed(spark, rows[:7]) == oracle(rows[:7])


def test_mixing_targets(spark):
    rows = [(k, "w " * 10, "huge") for k in range(300)] + [(1000 + k, "w " * 7, "small") for k in range(5)] + [(2000, "w w", None)]
    got = {r.source: r for r in mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).groupBy("source").agg(F.first("target").alias("target"), F.first("source_size").alias("size"), F.sum("taken").alias("taken")).collect()}
    assert got["small"].target == 3 * 35 and got[None].target == 6 and got["small"].taken == 105 and got[None].taken == 6
    assert got["huge"].target == pytest.approx(3037 - 105 - 6) and abs(got["huge"].taken - got["huge"].target) <= 10
    assert mixed(spark, []) == []
    assert all(r.taken == 0 for r in mixing.mix(spark.createDataFrame([(1, None, "a"), (2, "", "b")], "doc_id long, text string, source string")).collect())


class PlainModels:
    """The two variable-order models with dictionaries."""

    def __init__(self, urls):
        self.counts = {True: Counter(), False: Counter()}
        for url, good in set(urls):
            code = "^" * urlfilter.ORDER + self.code(url)
            for i in range(urlfilter.ORDER, len(code)):
                for k in range(urlfilter.ORDER + 1):
                    self.counts[good][code[i - k : i + 1]] += 1
        self.totals = {g: Counter() for g in (True, False)}
        for g, own in self.counts.items():
            for gram, n in own.items():
                self.totals[g][gram[:-1]] += n
        self.kinds = len({g for _, g in urls})

    @staticmethod
    def code(url):
        return "".join("0" if c in "123456789" else c if c in urlfilter.SYMBOLS else "!" for c in (url or "").lower())

    def p(self, good, context, symbol):
        own, all_ = self.counts[good], self.totals[good]
        if not context:
            return (own[symbol] + 1) / (all_[""] + urlfilter.N - 1)
        return (own[context + symbol] + urlfilter.MU * self.p(good, context[1:], symbol)) / (all_[context] + urlfilter.MU)

    def score(self, url):
        own = self.code(url)
        code, total = "^" * urlfilter.ORDER + own, 0.0
        if self.kinds < 2:
            return 0.0
        for i in range(urlfilter.ORDER, len(code)):
            k = next((k for k in range(urlfilter.ORDER, 0, -1) if self.totals[True][code[i - k : i]] + self.totals[False][code[i - k : i]] >= urlfilter.LEAST), 0)
            total += math.log(self.p(True, code[i - k : i], code[i])) - math.log(self.p(False, code[i - k : i], code[i]))
        return total / len(own) if own else 0.0


def ruled(url, rules):
    """Host, path and rule of a URL."""
    rest = url.partition("://")[2] if url and "://" in url else ""
    host = rest
    for s in "/?#":
        host = host.partition(s)[0]
    path = rest[len(host) :].partition("?")[0].partition("#")[0]
    host = host.translate(str.maketrans(urlfilter.UPPER, urlfilter.LOWER))
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return host, path, max(fits, key=lambda r: len(r.name), default=None)


def test_urls_against_brute_force(spark):
    pages = [(r.page_id, r.url) for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "url").collect()]
    pages += [(900, None), (901, ""), (902, "no scheme.com/x"), (903, "http://Example.COM"), (904, "HTTP://WWW.Example.com/en/x?y#z"), (905, "http://notexample.com/en/"), (906, "x://a.net/es/1"), (907, "http://éxample.net/fr/"), (908, "http://a.net?x/es/"), (909, "http://anet/es/"), (910, "http://a.org/" + "long/" * 20_000)]
    frame = spark.createDataFrame([(p, u, 1) for p, u in pages], "page_id long, url string, host int")
    got = {r.page_id: r for r in urlfilter.url_filter(frame, urlfilter.RULES).collect()}
    want = {p: (*ruled(u, urlfilter.RULES), u) for p, u in pages}
    learn = sorted({(u, rule.action == "allow") for _, _, rule, u in want.values() if rule and u})
    aside = {r.url for r in spark.createDataFrame(learn, "url string, good boolean").where("pmod(xxhash64(5, url), 5) = 0").collect()}
    plain = PlainModels([(u, g) for u, g in learn if u not in aside])
    assert len(got) == len(want) and aside
    for p, (host, path, rule, u) in want.items():
        r = got[p]
        assert (r.host, r.path, r.rule) == (host, path, rule.name if rule else None)
        assert r.score == pytest.approx(plain.score(u), abs=1e-9)
        assert r.verdict == (rule.action if rule else "allow" if r.score >= r.cut else "block")
    held = [(plain.score(u), g) for u, g in learn if u in aside]
    wrong = lambda cut: sum(s < cut for s, g in held if g) / sum(g for _, g in held) + sum(s >= cut for s, g in held if not g) / sum(not g for _, g in held)
    assert wrong(got[900].cut) <= min(wrong(s) for s, _ in held) + 0.1


def test_urls_without_labels(spark):
    frame = lambda rows: spark.createDataFrame(rows, "page_id long, url string, rule string")
    out = urlfilter.url_filter(frame([(1, "http://a.org/", "x"), (1, "http://a.org/", "x"), (None, None, "x")]), urlfilter.RULES).collect()
    assert [r.verdict for r in out] == ["allow"] * 3
    assert urlfilter.url_filter(frame([]), urlfilter.RULES).collect() == []


def test_all_labelled_urls_and_contexts_count(spark):
    """More labelled URLs of a kind, and more contexts, than fitted a bounded model. Repeated rows count once."""
    rng = random.Random(21)
    part = lambda n: "".join(rng.choice(string.ascii_lowercase) for _ in range(n))
    urls = sorted({f"x://com/{part(6)}" for _ in range(102_000)} | {f"x://net/es/{part(4)}" for _ in range(3_000)} | {f"x://org/{part(5)}" for _ in range(300)})
    frame = spark.createDataFrame(list(enumerate(urls + urls[:500])), "page_id long, url string")
    learn = [(u, rule.action == "allow") for u in urls if (rule := ruled(u, urlfilter.RULES)[2])]
    aside = {r.url for r in spark.createDataFrame([(u,) for u in urls], "url string").where("pmod(xxhash64(5, url), 5) = 0").collect()}
    plain = PlainModels([(u, g) for u, g in learn if u not in aside])
    contexts = plain.totals[True] + plain.totals[False]
    assert sum(g for _, g in learn) > 100_000 and sum(n >= urlfilter.LEAST for n in contexts.values()) > 20_000
    got = urlfilter.url_filter(frame, urlfilter.RULES).collect()
    assert sorted(r.page_id for r in got) == list(range(len(urls) + 500))
    of = {r.page_id: r for r in got}
    for k in rng.sample(range(len(urls)), 1000):
        assert of[k].score == pytest.approx(plain.score(urls[k]), abs=1e-9)
    for k in range(500):
        assert of[len(urls) + k].score == of[k].score
    held = [(of[k].score, ruled(u, urlfilter.RULES)[2].action == "allow") for k, u in enumerate(urls) if u in aside and ruled(u, urlfilter.RULES)[2]]
    wrong = lambda cut: sum(s < cut for s, g in held if g) / sum(g for _, g in held) + sum(s >= cut for s, g in held if not g) / sum(not g for _, g in held)
    assert wrong(got[0].cut) <= min(wrong(s) for s in {round(s, 2) for s, _ in held}) + 0.01


def test_grams_dealt_apart_or_broadcast(spark, monkeypatch):
    """Whether grams are broadcast as frequent ones or shuffled, the results are the same."""
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    out = []
    for share in (1, 100, 10**9):
        monkeypatch.setattr(urlfilter, "HOT_SHARE", share)
        out.append(sorted(map(str, urlfilter.url_filter(pages, urlfilter.RULES).collect())))
    assert out[0] == out[1] == out[2] and len(out[0]) == pages.count()
