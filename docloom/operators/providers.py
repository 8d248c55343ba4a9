"""Pluggable sources of what this engine does not compute: page text, model replies, vectors, generated choices.

A provider is a function from a DataFrame to a DataFrame, registered by name. Stored results are replayed; a name that
is not registered is an error, never another provider.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Provider = Callable[..., DataFrame]
_PROVIDERS: dict[tuple[str, str], Provider] = {}


def register(kind: str, name: str, provider: Provider) -> None:
    _PROVIDERS[kind, name] = provider


def provider(kind: str, name: str) -> Provider:
    if (kind, name) not in _PROVIDERS:
        raise ValueError(f"no {kind} {name!r}; there are {available(kind)}")
    return _PROVIDERS[kind, name]


def available(kind: str) -> list[str]:
    return sorted(n for k, n in _PROVIDERS if k == kind)


def replayed(inputs: DataFrame, stored: DataFrame, key: str = "doc_id") -> DataFrame:
    """Inputs with their stored results; one without stays, so it counts as a miss."""
    return inputs.join(stored, key, "left")


def parsed_reply(reply: str = "raw_response"):
    """The JSON object of a model's reply: the whole of it, a fenced block, or the outermost braces; null if none reads."""
    text = F.col(reply)
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*?\}|\[.*?\])\s*```", 1)
    braces = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    tries = []
    for candidate in (F.trim(text), fenced, braces):
        plain = F.regexp_replace(F.nullif(candidate, F.lit("")), r",(\s*[}\]])", "$1")
        one = F.when(plain.rlike(r"^\[.*\]$") & (F.json_array_length(plain) == 1), F.get_json_object(plain, "$[0]")).otherwise(plain)
        tries.append(F.when(F.json_object_keys(one).isNotNull(), one))
    return F.coalesce(*tries)


def chosen_code(reply: str, codes: list[str]):
    """The account code of a reply: exactly one valid code and no abstention, else null."""
    found = F.array_distinct(F.filter(F.regexp_extract_all(F.col(reply), F.lit(r"\b(\d{4})\b"), F.lit(1)), lambda c: c.isin(codes)))
    return F.when((F.size(found) == 1) & ~F.upper(reply).contains("ABSTAIN"), found[0])


def hinted_prompt(instructions: str, text: str = "text", most: int = 4000):
    """Instructions with the page text, a longer text cut in the middle."""
    half = most // 2
    cut = F.when(F.length(text) <= most, F.col(text)).otherwise(F.concat(F.left(F.col(text), F.lit(half)), F.lit("\n[...]\n"), F.right(F.col(text), F.lit(half))))
    return F.concat_ws("\n\n", F.lit(instructions), F.nullif(F.trim(cut), F.lit("")))


register("extractor", "replay", replayed)
register("generator", "replay", replayed)
register("ocr", "replay", replayed)
register("encoder", "replay", replayed)
