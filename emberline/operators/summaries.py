"""Summary requests, prompts and the mapping of model answers to summaries.

No model is called: answers come from a table column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.functions.text import column, is_blank, safe

# Summaries used when there is no answer, and the prompt layout.
EMPTY = {
    "title": "Unknown incident",
    "summary": "No summary available",
    "probable_cause": "Unknown",
    "suggested_actions": "No suggested actions available",
    "severity": "UNKNOWN",
}
NO_MODEL = {
    "title": "AI unavailable",
    "summary": "No chat model is configured for incident summarization.",
    "probable_cause": "Missing ChatModel bean",
    "suggested_actions": "Configure Spring AI model credentials or disable AI summarization.",
    "severity": "UNKNOWN",
}
NO_CONTENT = {
    "title": "AI Incident Analysis",
    "summary": "No response content returned by model",
    "probable_cause": "Unknown",
    "suggested_actions": "Check model configuration and API response",
    "severity": "UNKNOWN",
}
FAILED = {
    "title": "AI Incident Analysis Failed",
    "summary": "The AI model call failed",
    "suggested_actions": "Check API key, model name, network connectivity, and Spring AI configuration",
    "severity": "UNKNOWN",
}
ANSWERED = {
    "title": "AI Incident Analysis",
    "probable_cause": "See AI analysis",
    "suggested_actions": "See AI analysis",
    "severity": "UNKNOWN",
}
PROMPT = """You are analyzing an application incident detected from logs.

Fingerprint: {fingerprint}
Level: {level}
Occurrences in current window: {count}
Source ID: {sourceId}
Source Name: {sourceName}

Sample logs:
{samples}

Provide:
1. A short title
2. A short summary of what likely happened
3. The probable root cause
4. Suggested investigation steps
5. Severity (LOW, MEDIUM, HIGH)

Format the response as plain text.
"""
FIELDS = ["title", "summary", "probable_cause", "suggested_actions", "severity"]


def _summary(values: dict, **columns: Column) -> Column:
    return F.struct(
        *[(columns[name] if name in columns else F.lit(values[name])).alias(name) for name in FIELDS]
    )


def empty_summary() -> Column:
    return _summary(EMPTY)


def summary_requests(anomalies: DataFrame) -> DataFrame:
    """What a model is asked about: the anomaly and its one sample."""
    samples = F.when(F.col("sample_message").isNotNull(), F.array("sample_message")).otherwise(
        F.expr("cast(array() as array<string>)")
    )
    return anomalies.select(
        "fingerprint", "level", "count", "source_id", "source_name", samples.alias("sample_messages"), "seq"
    )


def render_prompt(template: str = PROMPT) -> Column:
    """The prompt of a summary request. Samples are filled in last, so they cannot add fields."""
    numbered = F.transform(
        "sample_messages",
        lambda text, index: F.concat((index + 1).cast("string"), F.lit(". "), text, F.lit("\n")),
    )
    samples = F.when(
        F.coalesce(F.size("sample_messages"), F.lit(0)) <= 0, F.lit("No sample logs available")
    ).otherwise(F.array_join(numbered, ""))
    prompt = F.lit(template)
    for name, value in [
        ("fingerprint", safe("fingerprint", trim=False)),
        ("level", F.coalesce(F.col("level"), F.lit("null"))),
        ("count", F.col("count").cast("string")),
        ("sourceId", safe("source_id", trim=False)),
        ("sourceName", safe("source_name", trim=False)),
        ("samples", samples),
    ]:
        prompt = F.replace(prompt, F.lit("{" + name + "}"), value)
    return prompt


def map_summary(
    response: Column | str, error: Column | str | None = None, model_configured: bool = True
) -> Column:
    """A summary struct from a model answer; ``error`` names the failure of a call, if any."""
    if not model_configured:
        return _summary(NO_MODEL)
    response = column(response)
    answered = F.when(is_blank(response), _summary(NO_CONTENT)).otherwise(
        _summary(ANSWERED, summary=response)
    )
    if error is None:
        return answered
    error = column(error)
    return F.when(error.isNotNull(), _summary(FAILED, probable_cause=error)).otherwise(answered)


def usable_summary(summary: Column | str) -> Column:
    """Null where the summary only says that there is no model."""
    summary = column(summary)
    missing = (F.lower(summary["title"]) == NO_MODEL["title"].lower()) & (
        F.lower(summary["probable_cause"]) == NO_MODEL["probable_cause"].lower()
    )
    return F.when(F.coalesce(missing, F.lit(False)), None).otherwise(summary)


def resolve_summary(new: Column | str, existing: Column | str) -> Column:
    """The new summary if usable, else the incident's, else the empty one."""
    return F.coalesce(usable_summary(new), column(existing), empty_summary())


def with_summaries(
    anomalies: DataFrame, responses: DataFrame | None, enabled: bool = True
) -> DataFrame:
    """Anomalies with a nullable ``summary`` for the fold.

    ``responses(fingerprint, source_id, seq, response, error)`` holds at most one row per anomaly; an anomaly
    without a row counts as not answered yet. ``None`` means that no model is configured.
    """
    from emberline.schemas import SUMMARY

    nothing = F.lit(None).cast(SUMMARY)
    if not enabled or responses is None:
        return anomalies.withColumn("summary", nothing)
    answers = responses.select(
        F.col("fingerprint").alias("_f"),
        F.col("source_id").alias("_s"),
        F.col("seq").alias("_q"),
        "response",
        "error",
        F.lit(True).alias("_hit"),
    )
    same = (
        (F.col("seq") == F.col("_q"))
        & (F.col("fingerprint") == F.col("_f"))
        & F.col("source_id").eqNullSafe(F.col("_s"))
    )
    return (
        anomalies.join(answers, same, "left")
        .withColumn(
            "summary",
            F.when(F.col("_hit").isNotNull(), usable_summary(map_summary("response", "error"))),
        )
        .drop("_f", "_s", "_q", "response", "error", "_hit")
    )
