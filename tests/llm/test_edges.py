"""Extra columns with clashing names, and very long texts, for the operators whose own tests lack them."""

import pytest
from pyspark.sql import functions as F

from pactlake.llm import langid, license, lmscore, mixing, neardup, quality, toxicity, urlfilter

LONG = "long words of a very long text with more than a few words " * 20_000


def rows():
    base = ["the cat sat on the mat and stayed there", "der hund lag auf der matte und blieb dort", "you idiot go away now please", "", None, "Released under the MIT License.", "one two three four five six seven eight nine ten"]
    out = [(k, t, ("en", "de")[k % 2] if k % 5 else None, f"s{k % 3}" if k % 4 else None) for k, t in enumerate(base * 6)]
    return [*out, (900, LONG, "en", "s0"), (901, LONG, "en", "s1"), out[0], out[0]]


@pytest.fixture(scope="module")
def tables(spark):
    docs = spark.createDataFrame(rows(), "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(k, int(k % 7 == 2)) for k in range(42)], "doc_id long, toxic int")
    pages = spark.createDataFrame([(k, u) for k, u in enumerate(["https://a.com/x", "https://www.example.com/en/y", "http://b.net/es/q", None, "nothing", "http://c.org/" + "z" * 30_000, "http://b.net/fr/q", "http://a.com/x"])], "page_id long, url string")
    return docs, labels, pages


OPS = {
    "langid": lambda d, l, p: langid.languages(d),
    "lmscore": lambda d, l, p: lmscore.scores(d),
    "toxicity": lambda d, l, p: toxicity.toxicity(d, l),
    "neardup": lambda d, l, p: neardup.near_duplicates(d),
    "license": lambda d, l, p: license.licenses(d),
    "mixing": lambda d, l, p: mixing.mix(d),
    "quality": lambda d, l, p: quality.quality(d),
    "urlfilter": lambda d, l, p: urlfilter.url_filter(p, urlfilter.RULES),
}
CLASH = ("score", "size", "node", "hash", "word", "_text", "n", "key", "_block", "c0", "label", "host", "path", "rule", "verdict", "_notices", "n_words", "id", "letter", "bits", "kept", "component_id", "tree", "target", "finish", "_y", "n_label", "grams", "taken", "index", "value", "base_score")


@pytest.mark.parametrize("name", sorted(OPS))
def test_clashing_names_and_long_texts(tables, name):
    clash = lambda df: df.select("*", *[F.array(F.lit(k)).alias(c) for k, c in enumerate(CLASH) if c not in df.columns])
    plain = OPS[name](*tables).select("*")
    odd = OPS[name](*map(clash, tables)).select(plain.columns)
    a, b = (sorted(map(str, df.collect())) for df in (plain, odd))
    assert a == b and len(a) == tables[2 if name == "urlfilter" else 0].count()
