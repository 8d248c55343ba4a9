"""Column expressions for names, keys and edit distances, and the Arrow kernels for what has no built-in."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

#: Glyphs that scanners confuse, each with the one that stands for it.
FOLD_FROM, FOLD_TO = "1l|!05862", "iiiiosbgz"
#: Distinct characters that stand for tokens when whole tokens are compared.
TOKEN_ALPHABET = "".join(map(chr, [*range(0x4E00, 0x4E00 + 4096)]))


def fold_glyphs(x: Column) -> Column:
    return F.translate(x, FOLD_FROM, FOLD_TO)


def normalize_company_name(x: Column) -> Column:
    spelled = F.regexp_replace(F.lower(x), "&", " and ")
    return F.trim(F.regexp_replace(F.regexp_replace(spelled, r"[^\p{L}\p{N}]", " "), r"\s+", " "))


def rate_key(x: Column) -> Column:
    """Lower-case letters and digits only: one key for all spellings of an item."""
    return F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), r"[^\p{L}\p{N}]", "")


def anls(a: Column, b: Column) -> Column:
    """One minus the edit distance over the longer length, after trimming and lower-casing; two empty texts are equal."""
    p, q = (F.lower(F.trim(F.coalesce(x, F.lit("")))) for x in (a, b))
    longest = F.greatest(F.length(p), F.length(q))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(p, q) / F.greatest(longest, F.lit(1)))


def collapse(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), r"(?U)\s+", " "))


def cer(reference: Column, hypothesis: Column) -> Column:
    """Edit distance over the reference's length; an empty reference gives 0 against nothing and 1 otherwise."""
    r, h = collapse(reference), collapse(hypothesis)
    return F.when(F.length(r) == 0, F.when(F.length(h) == 0, 0.0).otherwise(1.0)).otherwise(F.levenshtein(r, h) / F.length(r))


def wer(reference: Column, hypothesis: Column) -> Column:
    """Edit distance of whole tokens: each distinct token of a pair becomes one character."""
    r, h = (F.filter(F.split(collapse(x), " "), lambda w: w != "") for x in (reference, hypothesis))
    known = F.array_distinct(F.concat(r, h))
    coded = [F.array_join(F.transform(x, lambda w: F.substr(F.lit(TOKEN_ALPHABET), F.array_position(known, w).cast("int"), F.lit(1))), "") for x in (r, h)]
    return F.when(F.size(r) == 0, F.when(F.size(h) == 0, 0.0).otherwise(1.0)).when(F.size(known) <= len(TOKEN_ALPHABET), F.levenshtein(*coded) / F.size(r))


@F.pandas_udf(StringType())
def _nfkc(x: pd.Series) -> pd.Series:
    return x.map(lambda s: None if s is None else unicodedata.normalize("NFKC", s))


def normalize_text(x: Column, case_fold: bool = True, strip_punct: bool = True) -> Column:
    """Compatibility form, lower case, punctuation as blanks, white space collapsed. Spark has no NFKC: an Arrow kernel."""
    y = _nfkc(x)
    y = F.lower(y) if case_fold else y
    y = F.regexp_replace(y, r"(?U)[^\w\s]", " ") if strip_punct else y
    return F.trim(F.regexp_replace(y, r"(?U)\s+", " "))


def lcs_length(a: str, b: str) -> int:
    """Longest common subsequence, one machine word row at a time (bit-parallel)."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        match = row & places.get(c, 0)
        row = ((row + match) | (row - match)) & full
    return len(a) - row.bit_count()


def indel_ratio(a: str, b: str) -> float:
    total = len(a) + len(b)
    return 100.0 * (2 * lcs_length(a, b) / total) if total else 100.0


def token_sort(s: str) -> str:
    return " ".join(sorted(s.split()))


@F.pandas_udf(DoubleType())
def token_sort_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Insert-and-delete similarity of the sorted tokens, 0 to 100."""
    return pd.Series([None if x is None or y is None else indel_ratio(token_sort(x), token_sort(y)) for x, y in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(DoubleType())
def _name_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else max(indel_ratio(token_sort(x), token_sort(y)), indel_ratio(x, y)) for x, y in zip(a, b, strict=True)], dtype="float64")


def name_similarity(a: Column, b: Column) -> Column:
    """The better of plain and token-sorted similarity of two normalised names, 0 to 100; 0 if either is empty."""
    p, q = normalize_company_name(a), normalize_company_name(b)
    return F.when((F.length(p) == 0) | (F.length(q) == 0), 0.0).otherwise(_name_ratio(p, q))
