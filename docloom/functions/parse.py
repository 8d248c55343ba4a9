"""Column expressions that read amounts, quantities, rates, currencies, dates and tax numbers from text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a currency looks like, in order of preference.
CURRENCY_SYMBOLS = {"₹": "INR", "$": "USD", "€": "EUR", "£": "GBP", "¥": "JPY"}
CURRENCY_WORDS = {"rs": "INR", "rs.": "INR", "inr": "INR", "rupees": "INR", "usd": "USD", "eur": "EUR", "gbp": "GBP", "jpy": "JPY"}

# Date layouts in the order they are tried, day first and month first.
DATE_LAYOUTS = ["y-M-d", "y/M/d", "y.M.d", "d-M-y", "d/M/y", "d.M.y", "d-M-yy", "d/M/yy", "d.M.yy", "d-MMM-y", "d MMM y", "d-MMMM-y", "d MMMM y", "MMM d, y", "MMMM d, y", "MMM d y", "MMMM d y", "yyyyMMdd"]
MONTH_FIRST_LAYOUTS = ["M-d-y", "M/d/y", "M-d-yy", "M/d/yy"]

# The tax number's alphabet and layout, and the assigned state codes.
GSTIN_CHARSET = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"
GSTIN_LAYOUT = "^[0-9]{2}[A-Z]{5}[0-9]{4}[A-Z][1-9A-Z]Z[0-9A-Z]$"
GSTIN_STATES = [f"{n:02d}" for n in range(1, 39)] + ["97", "99"]


def clean_text(x: Column) -> Column:
    """White space collapsed; nothing left is null."""
    return F.nullif(F.trim(F.regexp_replace(x, r"(?U)\s+", " ")), F.lit(""))


def parse_amount(x: Column) -> Column:
    """A signed number: currency marks dropped, brackets or a leading minus negative, the last of . and , decimal.

    A comma alone is decimal unless three characters follow it.
    """
    bare = F.regexp_replace(x, r"[₹$€£¥]|(?i:rs\.?|inr|usd|eur|gbp)", " ")
    kept = F.regexp_replace(bare, r"[^0-9.,\-()]", "")
    inner = F.regexp_replace(kept, r"^[()]+|[()]+$", "")
    negative = kept.rlike(r"^\(.*\)$") | inner.startswith("-")
    digits = F.replace(inner, F.lit("-"), F.lit(""))
    dot, comma = digits.contains("."), digits.contains(",")
    comma_last = F.length(F.substring_index(digits, ",", -1)) < F.length(F.substring_index(digits, ".", -1))
    lone_decimal = F.length(F.substring_index(digits, ",", -1)) != 3
    plain = (
        F.when(dot & comma & comma_last, F.translate(digits, ",.", "."))
        .when(dot & comma, F.translate(digits, ",", ""))
        .when(comma & lone_decimal, F.translate(digits, ",", "."))
        .otherwise(F.translate(digits, ",", ""))
    )
    value = F.when(plain.rlike(r"^(\d+\.?\d*|\.\d+)$"), F.expr("1.0D") * plain.try_cast("double"))
    return F.when(negative, -value).otherwise(value)


def parse_quantity(x: Column) -> Column:
    """The first number in a text."""
    return parse_amount(F.nullif(F.regexp_extract(x, r"-?\d[\d,]*\.?\d*", 0), F.lit("")))


def parse_rate(x: Column) -> Column:
    return parse_quantity(F.translate(x, "%", " "))


def detect_currency(*values: Column) -> Column:
    """The code of the first currency mark: a symbol, or else a word, of each value in turn."""
    found = []
    for x in values:
        symbols = reduce(lambda w, s: w.when(x.contains(s), F.lit(CURRENCY_SYMBOLS[s])), CURRENCY_SYMBOLS, F.when(F.lit(False), F.lit(None).cast("string")))
        codes = F.create_map(*(F.lit(v) for pair in CURRENCY_WORDS.items() for v in pair))
        words = F.filter(F.regexp_extract_all(F.lower(x), F.lit(r"[A-Za-z.]+"), F.lit(0)), lambda w: F.map_contains_key(codes, w))
        found += [symbols, F.try_element_at(codes, F.get(words, F.lit(0)))]
    return F.coalesce(*found)


def normalize_date(x: Column, day_first: bool = True) -> Column:
    """ISO text of the first layout that reads the whole value; two-digit years are this century's."""
    text = F.trim(F.regexp_replace(F.regexp_replace(x, r"[^0-9A-Za-z/.\- ]", " "), r"\s+", " "))
    order = DATE_LAYOUTS + MONTH_FIRST_LAYOUTS if day_first else MONTH_FIRST_LAYOUTS + DATE_LAYOUTS
    tries = []
    for layout in order:
        long_year = "yy" not in layout or "yyyy" in layout
        shape = r"^.*(?<!\d)\d{4}(?!\d).*$" if layout != "yyyyMMdd" else r"^\d{8}$"
        year = text.rlike(shape) if long_year else text.rlike(r"^\d{1,2}[-/.]\d{1,2}[-/.]\d{2}$")
        date = F.to_date(F.try_to_timestamp(F.when(year, text), F.lit(layout)))
        tries.append(date)
    found = F.coalesce(*tries)
    # a two-digit year from 70 on is read as the last century's, as a four-digit one before 1970 is moved up
    moved = F.when((F.year(found) >= 2070) & text.rlike(r"^\d{1,2}[-/.]\d{1,2}[-/.]\d{2}$"), F.add_months(found, -1200)).when(F.year(found) < 1970, F.add_months(found, 1200)).otherwise(found)
    return F.date_format(moved, "yyyy-MM-dd")


def iso_date(x: Column) -> Column:
    """A strict ISO date, or null."""
    return F.to_date(F.try_to_timestamp(F.when(x.rlike(r"^\d{4}-\d{2}-\d{2}$"), x), F.lit("y-M-d")))


def days_between(a: Column, b: Column) -> Column:
    return F.abs(F.datediff(iso_date(a), iso_date(b)))


def normalize_invoice_number(x: Column) -> Column:
    return F.nullif(F.upper(F.regexp_replace(x.cast("string"), "[^0-9A-Za-z]", "")), F.lit(""))


def normalize_gstin(x: Column) -> Column:
    return normalize_invoice_number(x)


def gstin_check_digit(first: Column) -> Column:
    """The mod-36 check character of fourteen characters, weights 2 and 1 from the right; null for other input."""

    def add(total: Column, i: Column) -> Column:
        value = F.instr(F.lit(GSTIN_CHARSET), F.substr(first, F.lit(15) - i, F.lit(1))) - 1
        product = value * F.when(i % 2 == 1, 2).otherwise(1)
        return (total + F.floor(product / 36) + product % 36).cast("int")

    total = F.aggregate(F.sequence(F.lit(1), F.lit(14)), F.lit(0), add)
    digit = F.substr(F.lit(GSTIN_CHARSET), (F.lit(36) - total % 36) % 36 + 1, F.lit(1))
    return F.when(first.rlike("^[0-9A-Z]{14}$"), digit)


def gstin_problems(x: Column) -> Column:
    """Codes of what is wrong with a tax number: empty, length, format, state, checksum; an empty array if nothing."""
    number = normalize_gstin(x)
    digit = gstin_check_digit(F.substr(number, F.lit(1), F.lit(14)))
    deep = F.array_compact(
        F.array(
            F.when(~number.rlike(GSTIN_LAYOUT), "format"),
            F.when(~F.substr(number, F.lit(1), F.lit(2)).isin(GSTIN_STATES), "state"),
            F.when(digit != F.substr(number, F.lit(15), F.lit(1)), "checksum"),
        )
    )
    return F.when(number.isNull(), F.array(F.lit("empty"))).when(F.length(number) != 15, F.array(F.lit("length"))).otherwise(deep)
