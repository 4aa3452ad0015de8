"""Column functions on names, dates, clause texts and model replies."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .replies import find_object

# Fixed values.
DATE_PATTERNS = (
    r"(?i)\b(?:\d{1,2}[\-/]\d{1,2}[\-/]\d{2,4})\b",
    r"(?i)\b(?:\d{4}[\-/]\d{1,2}[\-/]\d{1,2})\b",
    r"(?i)\b(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Sept|Oct|Nov|Dec)[a-z]*\s+\d{1,2},\s+\d{4}\b",
)
RISKY = (
    "indemnify", "indemnification", "penalty", "termination for cause", "liquidated damages", "hold harmless", "unlimited liability", "warranty disclaimer",
    "non-compete", "exclusive", "non-solicitation", "arbitration", "governing law", "confidentiality breach", "data breach",
)
STOPWORDS = (
    "the", "and", "for", "are", "what", "which", "does", "with", "this", "that", "from", "have", "has",
    "any", "all", "contract", "contracts", "clause", "clauses", "say", "says", "about", "more", "than",
    "less", "how", "much", "many", "there", "their", "they", "who", "when", "mentioned", "mention",
    "is", "was", "were", "been", "being", "its", "into", "our", "your", "you", "did", "do", "can",
    "agreement", "agreements", "specifically", "wrong", "please", "tell", "show", "list", "give",
)
ORDINALS = ("one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen", "twenty")


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def norm_name(text: Column) -> Column:
    """Lower case, only letters, digits and single spaces."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " "))


def contains_name(text_norm: Column, name_norm: Column) -> Column:
    """Does a normalised text hold a normalised name of three letters or more as whole words?"""
    return (F.length(name_norm) >= 3) & F.contains(F.concat(F.lit(" "), text_norm, F.lit(" ")), F.concat(F.lit(" "), name_norm, F.lit(" ")))


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]+)$", 1)


def stem(filename: Column) -> Column:
    return F.regexp_replace(F.coalesce(filename, F.lit("")), r"(?i)\.[a-z0-9]{2,4}$", "")


def iso_date(text: Column) -> Column:
    """The text if it is written as YYYY-MM-DD, else null."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), text)


def dates_found(text: Column) -> Column:
    """At most five dates, by form and place."""
    return F.slice(F.concat(*[F.regexp_extract_all(text, F.lit(p), F.lit(0)) for p in DATE_PATTERNS]), 1, 5)


def phrases_in(text_lower: Column, phrases: tuple[str, ...]) -> Column:
    return F.array_compact(F.array(*[F.when(F.contains(text_lower, F.lit(p)), p) for p in phrases]))


def risky_terms(text: Column) -> Column:
    return F.slice(phrases_in(F.lower(text), RISKY), 1, 10)


def expiry_related(text: Column) -> Column:
    return text.rlike("(?i)expiry|expiration|term ends|valid until|renewal")


def clause_metadata(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    return F.struct(dates_found(text).alias("dates_found"), risky_terms(text).alias("risky_terms"), expiry_related(text).alias("expiry_related"), F.length(text).alias("length"))


def make_title(text: Column, domain: Column) -> Column:
    """The first three words, capitalised; without a word, the domain."""
    first = F.slice(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("[A-Za-z0-9]+"), F.lit(0)), 1, 3)
    return F.when(F.size(first) > 0, F.array_join(F.transform(first, F.initcap), " ")).otherwise(F.coalesce(domain, F.lit("Clause")))


def human_size(size: Column) -> Column:
    """Bytes as text: `0.15 MB` from a hundredth of a megabyte on, else `7 KB` or `512 B`; null for null. Halves go up."""
    mb, kb = size / 1048576, size / 1024
    return (
        F.when(mb >= 0.01, F.concat(F.format_number(F.floor(mb * 100 + 0.5) / 100, 2), F.lit(" MB")))
        .when(kb >= 1, F.concat(F.floor(kb + 0.5).cast("string"), F.lit(" KB"))).when(size.isNotNull(), F.concat(size.cast("string"), F.lit(" B")))
    )


# Titles by the words of a clause, in order; the inner list goes before the title at its end.
TITLES = (
    (("service provider", "provider agrees", "provider shall"), ((("consulting",), "Service Provider Obligations"), (("scope",), "Scope of Services")), "Provider Responsibilities"),
    (("payment", "pay", "fee"), ((("schedule",), "Payment Schedule"), (("client shall", "client will"), "Payment Terms"), (("invoice",), "Invoicing and Payment")), "Payment Obligations"),
    (("confidential",), ((("disclose",), "Confidentiality and Disclosure"), (("both parties",), "Mutual Confidentiality")), "Confidentiality Obligations"),
    (("liability", "liable"), ((("not liable", "not responsible"), "Limitation of Liability"),), "Liability Provisions"),
    (("governing law", "jurisdiction"), (), "Governing Law and Jurisdiction"),
    (("termination", "terminate"), (), "Termination Conditions"),
    (("intellectual property", "copyright"), (), "Intellectual Property Rights"),
    (("warranty", "guarantee"), (), "Warranties and Guarantees"),
    (("dispute", "arbitration"), (), "Dispute Resolution"),
)
DOMAIN_TITLES = (("operational", "Operational Clause "), ("financial", "Financial Clause "), ("confidential", "Confidentiality Clause "), ("", "Clause "))


def _has_any(text: Column, words: tuple[str, ...]) -> Column:
    out = F.contains(text, F.lit(words[0]))
    for w in words[1:]:
        out = out | F.contains(text, F.lit(w))
    return out


def proper_title(text: Column, domain: Column, number: Column) -> Column:
    """A title for a clause: by its words, else by its domain and number."""
    low, kind = F.lower(F.coalesce(text, F.lit(""))), F.lower(F.coalesce(domain, F.lit("")))
    out = F.lit(None).cast("string")
    for word, title in reversed(DOMAIN_TITLES):
        out = F.when(F.contains(kind, F.lit(word)), F.concat(F.lit(title), number.cast("string"))).otherwise(out)
    for words, inner, title in reversed(TITLES):
        own = F.lit(title)
        for w, t in reversed(inner):
            own = F.when(_has_any(low, w), t).otherwise(own)
        out = F.when(_has_any(low, words), own).otherwise(out)
    return out


def reversed_text(text: Column) -> Column:
    return F.reverse(text)


def plausible_email(text: Column) -> Column:
    """Only asks for a dot, as its model does: an address without `@` passes."""
    return F.contains(text, F.lit("."))


def query_terms(text: Column) -> Column:
    """Distinct words of three characters or more that carry meaning."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9%.]{3,}"), F.lit(0))
    words = F.transform(words, lambda w: F.regexp_replace(w, r"^[.%]+|[.%]+$", ""))
    return F.array_except(F.array_distinct(words), F.array(*map(F.lit, ("", *STOPWORDS))))


def lexical_bonus(terms: Column, passage: Column) -> Column:
    """A tenth for each term that starts a word of the passage, 0.3 at most."""
    low = F.lower(F.coalesce(passage, F.lit("")))
    hits = F.size(F.filter(terms, lambda t: F.rlike(low, F.concat(F.lit(r"(?<![a-z0-9])\Q"), t, F.lit(r"\E")))))
    return F.least(F.lit(0.3), hits * F.lit(0.1))


def evidence_terms(text: Column) -> Column:
    """Numbers and longer words that show what an answer rests on."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.array_distinct(F.concat(F.regexp_extract_all(low, F.lit(r"\d[\d,.]*\d|\d"), F.lit(0)), F.array_except(F.regexp_extract_all(low, F.lit("[a-z]{5,}"), F.lit(0)), F.array(*map(F.lit, STOPWORDS)))))


def strip_reasoning(reply: Column) -> Column:
    """A reply without `<think>` blocks and markdown fences."""
    out = F.regexp_replace(reply, r"(?is)<think>.*?</think>", "")
    out = F.regexp_replace(out, r"(?is)^.*</think>", "")
    return F.trim(F.regexp_replace(F.trim(out), r"(?is)^```(?:json)?\s*|\s*```$", ""))


def recover_object(reply: Column, wanted: list[str]) -> Column:
    """The JSON object of a model's reply as text: the first with all wanted keys in the reply, in the pieces of a stream, in what a wrapper holds (`response`, `message.content` and others, as deep as it goes), or within prose; null if there is none."""
    keys = frozenset(wanted)

    def found(replies: pd.Series) -> pd.Series:  # null for null
        objects = (find_object(r, keys) for r in replies)
        return pd.Series([None if o is None else json.dumps(o, ensure_ascii=False) for o in objects], dtype=object)

    return F.pandas_udf(found, T.StringType())(strip_reasoning(reply))


def pick(value: Column, allowed: tuple[str, ...], default: str | None = None) -> Column:
    """The allowed value that equals a text but for case; else the default, else the text."""
    out = F.lit(default) if default is not None else value
    for a in allowed:
        out = F.when(F.lower(F.trim(value)) == a.lower(), F.lit(a)).otherwise(out)
    return out


# Forms in which a reply cites sources.
CITED = r"\d+(?:\s*(?:,|;|&|and|to|-|–)\s*(?:[Ss]ources?\s*)?\d+)*"
CITE_LINKED = r"(?i:\[Sources?\s*\d+\]\(#source-\d+\))"
CITE_SQUARE = r"(?i:\[\s*Sources?\s*" + CITED + r"[^\[\]\n]{0,200}\](?!\())"
CITE_ROUND = r"(?i:\(\s*Sources?\s*" + CITED + r"[^()\n]{0,120}\))"
CITE_CORNER = r"(?i:【\s*Sources?\s*" + CITED + r"[^【】\n]{0,200}】)"
CITE_NUMERIC = r"\[\d+(?:\s*,\s*\d+)*\](?![(:])"
CITE_BARE = r"(?<![\[\w#-])Sources?\s+" + CITED + r"\b(?![\]\w])"
CODE_BLOCK = r"(?s:```.*?```)"


def cited_numbers(reply: Column) -> Column:
    """The source numbers a reply cites by a link or as `[Source n]`, sorted."""
    some = F.concat(F.regexp_extract_all(reply, F.lit(r"#source-(\d+)"), F.lit(1)), F.regexp_extract_all(reply, F.lit(r"\[Source (\d+)\]"), F.lit(1)))
    return F.array_sort(F.array_distinct(F.transform(some, lambda x: x.cast("int"))))


def clause_numbers(text: Column) -> Column:
    """Clause numbers named in a text, in digits or words, six at most."""
    low = F.lower(F.coalesce(text, F.lit("")))
    one = r"\d{1,3}|" + "|".join(sorted(ORDINALS, key=len, reverse=True))
    spans = F.regexp_extract_all(low, F.lit(rf"\b(?:clauses?|sections?|articles?)\s+((?:{one})\b(?:\s*(?:,|and|&|or)\s*(?:and\s+)?(?:{one})\b)*)"), F.lit(1))
    words = F.flatten(F.transform(spans, lambda s: F.regexp_extract_all(s, F.lit(rf"\b({one})\b"), F.lit(1))))
    number = F.create_map(*[F.lit(x) for pair in zip(ORDINALS, range(1, 21), strict=True) for x in pair])
    return F.slice(F.array_distinct(F.transform(words, lambda w: F.coalesce(w.try_cast("int"), F.try_element_at(number, w)))), 1, 6)


def pick_flag(value: Column) -> Column:
    """A boolean from words for yes and no; null for anything else."""
    low = F.lower(F.trim(value))
    return F.when(low.isin("true", "yes", "y", "1"), True).when(low.isin("false", "no", "n", "0"), False)


def party_address(header: Column, role: str) -> Column:
    """The address that a header gives after a party's label."""
    own = F.regexp_extract(header, rf"(?is)\b(?:{role})\b\s*:(.*)", 1)
    return F.nullif(F.trim(F.regexp_extract(own, r"(?i)(?:address|residing at|located at)\s*:?\s*([^\n;]{5,160})", 1)), F.lit(""))


def link_citations(replies: Column, sources: Column) -> Column:
    """A reply with its citations, in whatever form, as `[Source n](#source-n)`. Numbers beyond the `sources` stay plain and code blocks as they are; without sources nothing changes.

    The reply is cut at its citations and code blocks, each of these is written anew, and all is joined again.
    """
    reply, n = F.coalesce(replies, F.lit("")), F.coalesce(sources.cast("int"), F.lit(0))
    form = "|".join((CODE_BLOCK, CITE_LINKED, CITE_SQUARE, CITE_ROUND, CITE_CORNER, CITE_NUMERIC, CITE_BARE))
    between, marks = F.split(reply, form, -1), F.regexp_extract_all(reply, F.lit(form), F.lit(0))
    link = lambda k: F.concat(F.lit("[Source "), k.cast("string"), F.lit("](#source-"), k.cast("string"), F.lit(")"))
    valid = lambda k: k.between(1, n)
    links = lambda some: F.array_join(F.transform(F.filter(some, valid), link), ", ")

    def spread(span: Column) -> Column:
        """The numbers of `3` or, if it spans less than twenty, `1-3`."""
        ends = F.transform(F.regexp_extract_all(span, F.lit(r"\d+"), F.lit(0)), lambda x: x.try_cast("int"))
        lo, hi = F.get(ends, F.lit(0)), F.get(ends, F.lit(1))
        return F.when(hi.isNull(), F.array(lo)).when((hi - lo).between(1, 19), F.sequence(lo, F.greatest(lo, hi))).otherwise(F.array(lo, hi))

    def written(mark: Column) -> Column:
        told = F.regexp_extract(mark, rf"^[\[(【]?\s*(?i:Sources?)?\s*({CITED})", 1)
        numbers = F.array_distinct(F.flatten(F.transform(F.regexp_extract_all(told, F.lit(r"\d+(?:\s*(?:-|–|to)\s*(?:[Ss]ources?\s*)?\d+)?"), F.lit(0)), spread)))
        linked = F.regexp_extract(mark, r"\(#source-(\d+)\)$", 1).try_cast("int")
        first = F.regexp_extract(mark, r"^Sources?\s+(\d+)", 1).try_cast("int")
        none, all_ = ~F.exists(numbers, valid), F.forall(numbers, valid)
        boxed = F.when(none, F.concat(F.lit("Source "), F.array_join(F.transform(numbers, lambda k: k.cast("string")), ", "))).when(mark.startswith("("), F.concat(F.lit("("), links(numbers), F.lit(")"))).otherwise(links(numbers))
        return (
            F.when(mark.startswith("```"), mark)
            .when(linked.isNotNull(), F.when(valid(linked), link(linked)).otherwise(F.concat(F.lit("Source "), linked.cast("string"))))
            .when(mark.rlike(r"^\[\d"), F.when(all_, links(numbers)).otherwise(mark))
            .when(first.isNotNull(), F.when(all_, links(numbers)).when(valid(first), F.concat(link(first), F.regexp_replace(mark, r"^Sources?\s+\d+", ""))).otherwise(mark))
            .otherwise(boxed)
        )

    whole = F.concat(F.get(between, F.lit(0)), F.array_join(F.transform(marks, lambda m, k: F.concat(written(m), F.coalesce(F.get(between, k + 1), F.lit("")))), ""))
    return F.when(replies.isNotNull(), F.when(n > 0, whole).otherwise(reply))
