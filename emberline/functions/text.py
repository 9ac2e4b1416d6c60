"""String helpers shared by parsing, dashboard and notification code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode white space without the three no-break spaces, plus the ASCII separators.
BLANK = r"^[\t\n\x0B\f\r\x1C-\x1F\p{Z}&&[^\u00A0\u2007\u202F]]*\z"

# Control characters and the space: what trimming removes at both ends.
TRIMMED = "".join(chr(code) for code in range(0x21))


def column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def is_blank(value: Column | str) -> Column:
    """True for null, empty and all-white-space text."""
    value = column(value)
    return value.isNull() | value.rlike(BLANK)


def trimmed(value: Column | str) -> Column:
    return F.btrim(column(value), F.lit(TRIMMED))


def safe(value: Column | str, default: str = "unknown", trim: bool = True) -> Column:
    """The text, or ``default`` where it is blank."""
    value = column(value)
    return F.when(is_blank(value), F.lit(default)).otherwise(trimmed(value) if trim else value)


def default_if_blank(value: Column | str, fallback: Column | str) -> Column:
    value = column(value)
    return F.when(is_blank(value), column(fallback)).otherwise(value)


def abbreviate(value: Column | str, width: int) -> Column:
    """At most ``width`` characters, the last three being dots where text was cut."""
    value = column(value)
    return F.when(
        F.length(value) > width, F.concat(F.substring(value, 1, width - 3), F.lit("..."))
    ).otherwise(value)


def shorten(value: Column | str, width: int) -> Column:
    """Listing form: blank becomes ``unknown``, long text is cut."""
    return abbreviate(safe(value, trim=False), width)


def escape_html(value: Column | str) -> Column:
    value = column(value)
    for plain, entity in [
        ("&", "&amp;"),
        ("<", "&lt;"),
        (">", "&gt;"),
        ('"', "&quot;"),
        ("'", "&#39;"),
    ]:
        value = F.replace(value, F.lit(plain), F.lit(entity))
    return value


def html_paragraphs(value: Column | str) -> Column:
    return F.replace(escape_html(safe(value)), F.lit("\n"), F.lit("<br/>"))


def badge_slug(value: Column | str) -> Column:
    value = column(value)
    value = F.when(value.isNull() | (value == ""), F.lit("unknown")).otherwise(value)
    return F.regexp_replace(F.lower(trimmed(value)), "[^a-z0-9]+", "-")


def runtime_key(value: Column | str) -> Column:
    """Trimmed lower-case key; null where blank."""
    value = column(value)
    return F.when(~is_blank(value), F.lower(trimmed(value)))


def trim_to_null(value: Column | str) -> Column:
    return F.nullif(trimmed(value), F.lit(""))


def contains_text(value: Column | str, search: str) -> Column:
    """Case-insensitive substring test; null counts as empty text."""
    return F.lower(F.coalesce(column(value), F.lit(""))).contains(search.lower())


def split_recipients(addresses: str) -> Column:
    """A comma-separated setting as an array without blanks."""
    parts = F.split(F.lit(addresses), ",")
    return F.transform(F.filter(parts, lambda part: ~is_blank(part)), trimmed)
