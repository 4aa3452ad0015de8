"""Column functions on written amounts of money."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Currency symbols and codes, scale words.
SYMBOLS = {
    "$": "USD", "US$": "USD", "₹": "INR", "€": "EUR", "£": "GBP", "Rs.": "INR", "Rs": "INR",
    "R$": "BRL", "C$": "CAD", "CA$": "CAD", "A$": "AUD", "AU$": "AUD", "S$": "SGD", "¥": "JPY",
}
CODES = "INR|USD|EUR|GBP|BRL|CAD|AUD|SGD|AED|JPY|CHF|CNY|ZAR|NZD|HKD|MXN"
SHOWN = {"USD": "$", "INR": "₹", "EUR": "€", "GBP": "£"}
SCALES = (("k|thousand", 1e3), ("m|mn|mm|million", 1e6), ("b|bn|billion", 1e9), ("lakh|lac|lakhs|lacs", 1e5), ("crore|crores|cr", 1e7))
NO_VALUE = ("", "null", "none", "n/a", "na", "unknown", "not stated", "not specified")
AMOUNT = r"\d{1,2}(?:,\d{2})+,\d{3}(?:\.\d{1,2})?|\d{1,3}(?:,\d{3})+(?:\.\d{1,3})?|\d{1,3}(?:\.\d{3})+(?:,\d{1,2})?|\d{1,3}(?:[\x{a0}\x{202f}]\d{3})+(?:[.,]\d{1,2})?|\d{1,3}(?: \d{3})+,\d{1,2}|\d+(?:[.,]\d{1,2})?"
BEFORE = r"(US\$|R\$|CA\$|C\$|AU\$|A\$|S\$|\$|₹|€|£|¥|Rs\.?|" + CODES + r")\s?(" + AMOUNT + r")(?!\d)"
AFTER = r"(?<![\d.,])(" + AMOUNT + r")\s?((?:" + CODES + r")\b|€|₹|£)"
#: What a currency or an amount begins with: places without it are passed over before any form is tried.
MONEY = rf"(?=[\dA-CEGHIJMNRSUZ$₹€£¥])(?:(?:{BEFORE})|(?:{AFTER}))"
WRITTEN = r"-?\d{1,3}(?: \d{3})+,\d{1,2}(?!\d)|-?\d[\d,.]*\d|-?\d"
GROUPED = r"^\s*(?:[A-Za-z$€£₹]{1,3}\.?\s*)?(-?\d{1,3}(?: \d{3})+)\s*(?:[A-Za-z€£₹$]{1,3})?\s*$"
DATE_LIKE = r"\b\d{4}-\d{1,2}-\d{1,2}\b|\b\d{1,2}[./-]\d{1,2}[./-]\d{2,4}\b"


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """`then` of a value that is worked out once, however often `then` names it; also within lambdas, where Spark shares nothing."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def number_from_digits(raw: Column) -> Column:
    """A written number in US, Indian, European or dot-grouped form; null if it is none (a double)."""

    def plain(digits: Column) -> Column:
        commas, dots = F.length(digits) - F.length(F.replace(digits, F.lit(","))), F.length(digits) - F.length(F.replace(digits, F.lit(".")))
        return (
            F.when((commas > 0) & (dots > 0), F.when(digits.rlike(r",[^.]*$"), F.translate(digits, ",.", ".")).otherwise(F.replace(digits, F.lit(","))))
            .when(commas > 0, F.when(digits.rlike(r"^[^,]*,\d{1,2}$"), F.translate(digits, ",", ".")).otherwise(F.replace(digits, F.lit(","))))
            .when(dots > 1, F.when(digits.rlike(r"^[^.]*(\.[^.]{3})+$"), F.replace(digits, F.lit("."))))
            .otherwise(digits)
        )

    def signed(s: Column) -> Column:
        return let(let(F.regexp_replace(s, "^-+", ""), plain).try_cast("double"), lambda value: F.when(s.startswith("-"), -value).otherwise(value))

    return let(F.regexp_replace(raw, r"[\s\x{a0}\x{202f}]", ""), signed)


def parse_money(text: Column) -> Column:
    """The first amount of a text, with its scale word; null for dates, empty words and texts without a number."""
    known = F.when(~F.lower(F.trim(text)).isin(*NO_VALUE), F.regexp_replace(text, DATE_LIKE, " "))
    grouped = F.regexp_extract(known, GROUPED, 1)
    number = F.regexp_extract(known, f"({WRITTEN})", 1)
    rest = F.regexp_extract(known, f"(?s)(?:{WRITTEN})(.*)$", 1)
    factor = F.lit(1.0)
    for names, by in reversed(SCALES):
        factor = F.when(rest.rlike(rf"(?i)^\s*(?:{names})\b"), F.lit(by)).otherwise(factor)
    return F.when(grouped != "", F.replace(grouped, F.lit(" ")).try_cast("double")).when(number != "", number_from_digits(number) * factor)


def currency_code(symbol: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in SYMBOLS.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.trim(symbol)), F.rtrim(F.upper(F.trim(symbol)), F.lit(".")))


def money_amounts(text: Column) -> Column:
    """All amounts of a text with their currency: an array of (value, currency, text)."""
    found = F.regexp_extract_all(text, F.lit(MONEY), F.lit(0))

    def parts(m: Column) -> Column:
        return let(F.regexp_extract(m, f"^{BEFORE}$", 1), lambda symbol: let(F.struct(
            F.when(symbol != "", F.regexp_extract(m, f"^{BEFORE}$", 2)).otherwise(F.regexp_extract(m, f"^{AFTER}$", 1)).alias("number"),
            F.when(symbol != "", symbol).otherwise(F.regexp_extract(m, f"^{AFTER}$", 2)).alias("code"),
        ), lambda x: told(x["number"], x["code"], m)))

    def told(number: Column, code: Column, m: Column) -> Column:
        dotted = number.rlike(r"^\d{1,3}(\.\d{3})+(,\d{1,2})?$")
        value = F.when(dotted, F.translate(number, ",.", ".").try_cast("double")).otherwise(number_from_digits(number))
        return F.struct(value.alias("value"), currency_code(code).alias("currency"), F.trim(m).alias("text"))

    return F.filter(F.transform(found, parts), lambda x: x["value"].isNotNull())


def format_money(value: Column, currency: Column) -> Column:
    """`$1,203,432.00`, `9.00 CHF`, or `not found`."""
    code, shown = F.upper(F.coalesce(currency, F.lit(""))), F.format_number(value, 2)
    symbol = F.try_element_at(F.create_map(*[F.lit(x) for pair in SHOWN.items() for x in pair]), code)
    return F.when(value.isNull(), "not found").when(symbol.isNotNull(), F.concat(symbol, shown)).otherwise(F.trim(F.concat(shown, F.lit(" "), code)))
