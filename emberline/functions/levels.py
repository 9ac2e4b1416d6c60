"""Log level detection from free text and from JSON objects."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from emberline.functions.text import column, is_blank, trimmed

# In text entries any letter or digit of the basic plane next to a token hides it; '_' does not.
_TEXT_EDGE = r"[\p{L}\p{Nd}&&[\x{0}-\x{FFFF}]]"

# Token -> level, strongest first (fixed values).
_TEXT_TOKENS = [
    ("ERROR", "ERROR", "ERROR"),
    ("WARN", "WARN(?:ING)?", "WARN"),
    ("INFO", "INFO", "INFO"),
    ("DEBUG", "DEBUG", "DEBUG"),
    ("TRACE", "TRACE", "TRACE"),
    ("EXCEPTION", "EXCEPTION", "ERROR"),
]
_JSON_TOKENS = _TEXT_TOKENS[:-1]


def _first_level(value: Column, tokens: list, flags: str, edge: str) -> Column | None:
    """The strongest level named in the text, else null.

    The plain substring test runs first so that most rows never reach the regular expression.
    """
    upper = F.upper(value)
    found = None
    for probe, pattern, level in tokens:
        hit = upper.contains(probe) & value.rlike(f"({flags})(?<!{edge}){pattern}(?!{edge})")
        found = F.when(hit, level) if found is None else found.when(hit, level)
    return found


def text_level(first_line: Column | str) -> Column:
    """Level of a text entry, read from its first line."""
    found = _first_level(column(first_line), _TEXT_TOKENS, "?iu", _TEXT_EDGE)
    return F.coalesce(found, F.lit("UNKNOWN"))


def _json_token_level(value: Column) -> Column:
    return _first_level(value, _JSON_TOKENS, "?i", r"\w")


def named_level(value: Column | str) -> Column:
    """Exact level name after trimming and upper-casing, else null."""
    name = F.upper(trimmed(column(value)))
    return F.when(name == "WARNING", "WARN").when(
        name.isin("ERROR", "WARN", "INFO", "DEBUG", "TRACE"), name
    )


def map_value(fields: Column, key: str) -> Column:
    """The value of a JSON key; of a repeated key the last one counts."""
    matches = F.filter(F.map_entries(fields), lambda entry: entry["key"] == key)
    return F.try_element_at(matches, F.lit(-1))["value"]


def first_value(fields: Column, *keys: str) -> Column:
    return F.coalesce(*[map_value(fields, key) for key in keys])


def _values_in_order(fields: Column) -> Column:
    """Values in document order, repeated keys showing their last value."""
    entries = F.map_entries(fields)
    keys = F.map_keys(fields)
    settled = F.transform(
        entries,
        lambda entry: F.try_element_at(
            F.filter(entries, lambda other: other["key"] == entry["key"]), F.lit(-1)
        )["value"],
    )
    return F.when(F.size(F.array_distinct(keys)) < F.size(keys), settled).otherwise(
        F.map_values(fields)
    )


def _scan_text(value: Column) -> Column:
    """Nested values arrive as JSON text: an escape such as ``\\n`` separates words there."""
    nested = value.rlike(r"^[\[{]") & value.contains("\\")
    return F.when(
        nested, F.regexp_replace(value, r"\\u[0-9A-Fa-f]{4}|\\.", " ")
    ).otherwise(value)


def json_level_value(fields: Column | str) -> Column:
    """The text of the first level key that is not null."""
    return first_value(column(fields), "level", "severity", "lvl")


def json_level(fields: Column | str, message: Column | str, given: Column | str | None = None) -> Column:
    """Level of a JSON entry: level keys, then any value in order, then the raw message.

    ``given`` is the value of the level keys, where it is at hand.
    """
    fields, message = column(fields), column(message)
    by_key = named_level(json_level_value(fields) if given is None else given)
    scanned = F.transform(
        _values_in_order(fields), lambda value: _json_token_level(_scan_text(value))
    )
    by_value = F.try_element_at(F.filter(scanned, lambda level: level.isNotNull()), F.lit(1))
    return F.coalesce(by_key, by_value, _json_token_level(message), F.lit("UNKNOWN"))


__all__ = ["text_level", "json_level", "named_level", "first_value", "map_value", "is_blank"]
