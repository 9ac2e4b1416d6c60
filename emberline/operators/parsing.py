"""Entries to typed events: JSON where the whole message is one object, text otherwise."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.functions.identity import fingerprint_of
from emberline.functions.levels import json_level, json_level_value, text_level
from emberline.functions.text import column, is_blank, trimmed
from emberline.functions.times import (
    found_instant,
    found_time,
    json_event_time,
    json_instant,
    json_time_value,
    text_event_time,
)

# Strict JSON: Spark's reader would otherwise take single quotes and NaN.
_STRICT = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}


def is_json_candidate(message: Column | str) -> Column:
    """The message, without surrounding control characters and spaces, is wrapped in braces."""
    text = trimmed(message)
    return F.coalesce(text.startswith("{") & text.endswith("}"), F.lit(False))


def json_fields(message: Column | str) -> Column:
    """Top-level fields as an ordered map; null unless the message is exactly one valid object.

    The reader ignores text after the first value. Inside an array such text is an error or a second
    element, unless it closes the array itself; messages with a bracket are therefore read a second
    time inside an object, which the same text cannot close as well.
    """
    message = column(message)
    in_array = F.from_json(
        F.concat(F.lit("["), message, F.lit("]")), "array<map<string,string>>", _STRICT
    )
    in_object = F.from_json(
        F.concat(F.lit('{"x":'), message, F.lit("}")), "map<string,map<string,string>>", _STRICT
    )
    # Through a one-element array, so that the text is read once for the test and the value.
    lone = F.filter(F.array(in_array), lambda values: F.size(values) == 1)
    single = F.get(F.get(lone, F.lit(0)), F.lit(0))
    return F.when(
        is_json_candidate(message),
        F.when(message.contains("]") & F.coalesce(F.size(in_object) != 1, F.lit(True)), None).otherwise(single),
    )


def first_line(message: Column | str) -> Column:
    message = column(message)
    return F.when(is_blank(message), F.lit("")).otherwise(
        trimmed(F.substring_index(message, "\n", 1))
    )


def json_parser(message: Column) -> Column:
    """struct(event_time, level), null where the message is not a JSON object."""
    fields = json_fields(message)
    return F.when(
        fields.isNotNull(),
        F.struct(
            json_event_time(fields).alias("event_time"), json_level(fields, message).alias("level")
        ),
    )


def text_parser(message: Column) -> Column:
    line = first_line(message)
    return F.struct(text_event_time(line).alias("event_time"), text_level(line).alias("level"))


Parser = Callable[[Column], Column]


def _event_columns(entries: DataFrame) -> list:
    return [
        "source_type",
        "source_id",
        "source_name",
        F.col("seen").alias("ingest_time"),
        "event_time",
        "level",
        "message",
        F.expr("cast(map() as map<string,string>)").alias("attributes"),
        F.col("entry_seq").alias("seq"),
    ]


def parse_entries(entries: DataFrame, parsers: list[Parser] | None = None) -> DataFrame:
    """Log events. With ``parsers`` the first one that returns a non-null struct wins."""
    if parsers is not None:
        parsed = entries.withColumn("_parsed", F.coalesce(*[parse(F.col("message")) for parse in parsers]))
        return parsed.select("*", "_parsed.*").select(*_event_columns(entries))
    # Staged, so that the map, the first line and what is found in them are computed once per row.
    staged = entries.withColumn("_fields", json_fields("message")).withColumn(
        "_line", F.when(F.col("_fields").isNull(), first_line("message"))
    )
    is_json = F.col("_fields").isNotNull()
    found = staged.select(
        "*",
        F.when(is_json, json_time_value("_fields")).otherwise(found_time("_line")).alias("_time"),
        F.when(is_json, json_level_value("_fields")).alias("_level"),
    )
    return found.select(
        "*",
        F.when(is_json, json_instant("_time")).otherwise(found_instant("_time")).alias("event_time"),
        F.when(is_json, json_level("_fields", "message", "_level")).otherwise(text_level("_line")).alias("level"),
    ).select(*_event_columns(entries))


def with_fingerprint(events: DataFrame) -> DataFrame:
    return events.withColumn("fingerprint", fingerprint_of("message"))


def log_events(entries: DataFrame) -> DataFrame:
    return with_fingerprint(parse_entries(entries))
