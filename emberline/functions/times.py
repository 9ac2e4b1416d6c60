"""Event times, counting windows and ISO rendering; all in UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from emberline.functions.levels import first_value
from emberline.functions.text import column

# Accepted time shapes. Word edges are ASCII; the left one is tested behind the first
# digit, so that other text is passed over quickly.
TEXT_TIME = (
    r"\d(?<!\w.)\d{3}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}(?:[.,]\d{3})?(?:Z|[+-]\d{2}:?\d{2})?(?!\w)"
)
JSON_TIME = (
    r"^\d{4}-\d{2}-\d{2}[Tt]\d{2}:\d{2}(?::\d{2}(?:\.\d{0,9})?)?"
    r"(?:[Zz]|[+-]\d{2}:\d{2}(?::\d{2})?)\z"
)
JSON_TIME_KEYS = ["@timestamp", "timestamp", "ts", "time"]


def found_time(first_line: Column | str) -> Column:
    """The first time in the line as it stands there, empty if there is none."""
    return F.regexp_extract(column(first_line), TEXT_TIME, 0)


def found_instant(found: Column | str) -> Column:
    """What ``found_time`` has found. Without an offset it is UTC; an offset without a colon is invalid."""
    found = column(found)
    iso = F.translate(found, ", ", ".T")
    return (
        F.when(found == "", None)
        .when(iso.rlike(r"[+-]\d{4}\z"), None)
        .when(iso.rlike(r"(?:Z|[+-]\d{2}:\d{2})\z"), F.try_to_timestamp(iso))
        .otherwise(F.try_to_timestamp(F.concat(iso, F.lit("Z"))))
    )


def text_event_time(first_line: Column | str) -> Column:
    """First time in the line. Without an offset it is UTC; an offset without a colon is invalid."""
    return found_instant(found_time(first_line))


def json_instant(raw: Column | str) -> Column:
    """An ISO instant with a mandatory offset.

    Ordinary values go straight to the cast. Lower-case letters, missing seconds, the end-of-day
    hour 24 and a leap second are put into the form the cast accepts first.
    """
    raw = column(raw)
    upper = F.upper(raw)
    with_seconds = F.regexp_replace(upper, r"T(\d{2}:\d{2})(?=[Z+-])", "T$1:00")
    no_leap = F.regexp_replace(with_seconds, r"T23:59:60", "T23:59:59")
    midnight = no_leap.rlike(r"T24:00:00(?:\.0*)?(?=[Z+-])") & ~upper.rlike(r"T24:00(?=[Z+-])")
    rolled = F.try_to_timestamp(F.regexp_replace(no_leap, "T24:00:00", "T00:00:00"))
    unusual = F.when(
        midnight, F.timestamp_micros(F.unix_micros(rolled) + F.lit(86_400_000_000))
    ).otherwise(F.try_to_timestamp(no_leap))
    direct = F.try_to_timestamp(raw)
    return F.when(~raw.rlike(JSON_TIME), None).otherwise(F.coalesce(direct, unusual))


def json_time_value(fields: Column | str) -> Column:
    """The text of the first time key that is not null."""
    return first_value(column(fields), *JSON_TIME_KEYS)


def json_event_time(fields: Column | str) -> Column:
    """Time of a JSON entry: the first time key that is not null decides, parseable or not."""
    return json_instant(json_time_value(fields))


def event_or_ingest_time(
    event_time: Column | str = "event_time", ingest_time: Column | str = "ingest_time"
) -> Column:
    return F.coalesce(column(event_time), column(ingest_time))


def window_start(ts: Column | str, seconds: int) -> Column:
    """Start of the tumbling window, aligned to the epoch in whole seconds."""
    second = F.unix_seconds(column(ts))
    return F.timestamp_seconds(second - F.pmod(second, F.lit(max(1, seconds))))


def iso_utc(ts: Column | str) -> Column:
    """ISO text with as many fraction digits as needed; ``unknown`` for null."""
    utc = F.to_utc_timestamp(column(ts), F.current_timezone())
    text = F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    stripped = F.regexp_replace(text, r"\.?0*$", "")
    whole = F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss")
    short = F.when(text.endswith(".000000"), whole).otherwise(stripped)
    return F.coalesce(F.concat(short, F.lit("Z")), F.lit("unknown"))
