"""Incidents: resolving commands, folding anomalies and commands per incident, event history."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.functions.identity import incident_id
from emberline.functions.text import column, is_blank, trim_to_null
from emberline.operators.running import DEFAULT_SLICE_WIDTH, Track, running
from emberline.operators.summaries import empty_summary
from emberline.schemas import OPERATOR_EVENTS, SUMMARY

KEY = ["fingerprint", "source_id"]
_ORDER = ["seq", "_rank"]
_ENDED = ["RESOLVED", "CLOSED"]


# --- anomalies and incidents -----------------------------------------------------------------


def rollup_incidents(anomalies: DataFrame) -> DataFrame:
    """Per (fingerprint, source): first and last sighting, total and last count, last descriptors."""
    order = F.struct("seq", "count")
    last = F.max_by(F.struct("count", "level", "source_name", "detected_at"), order)
    return (
        anomalies.groupBy(*KEY)
        .agg(
            F.min_by("detected_at", order).alias("first_seen_at"),
            F.sum(F.col("count").cast("bigint")).alias("total_occurrences"),
            last.alias("_last"),
        )
        .select(
            incident_id(*KEY).alias("id"),
            *KEY,
            F.col("_last.source_name").alias("source_name"),
            F.col("_last.level").alias("log_level"),
            "first_seen_at",
            F.col("_last.detected_at").alias("last_seen_at"),
            "total_occurrences",
            F.col("_last.count").cast("bigint").alias("last_window_count"),
        )
    )


def first_sightings(anomalies: DataFrame) -> DataFrame:
    """The distinct non-blank sample messages per key, with when each came first."""
    return (
        anomalies.where(~is_blank("sample_message"))
        .groupBy(*KEY, F.col("sample_message").alias("sample"))
        .agg(F.min("seq").alias("first_seq"))
    )


def new_samples(anomalies: DataFrame, stored: DataFrame) -> DataFrame:
    """First sightings of samples that are not stored yet. A stored sample came earlier."""
    known = stored.select(
        F.col("fingerprint").alias("_f"), F.col("source_id").alias("_s"), F.col("sample").alias("_m")
    )
    same = (
        F.col("fingerprint").eqNullSafe(F.col("_f"))
        & F.col("source_id").eqNullSafe(F.col("_s"))
        & (F.col("sample") == F.col("_m"))
    )
    return first_sightings(anomalies).join(known, same, "left_anti")


def numbered_samples(sightings: DataFrame, slice_width: int = DEFAULT_SLICE_WIDTH) -> DataFrame:
    """First sightings with their ``position`` within the incident."""
    return running(
        sightings,
        KEY,
        ["first_seq", "sample"],
        [Track("position", "sum", F.lit(1).cast("bigint"))],
        slice_width,
    )


def incident_samples(
    anomalies: DataFrame, slice_width: int = DEFAULT_SLICE_WIDTH
) -> DataFrame:
    """The distinct non-blank sample messages of every incident, in order of first appearance.

    One row per sample: a busy incident may have more samples than one array could hold.
    """
    return numbered_samples(first_sightings(anomalies), slice_width)


def attach_incident(anomalies: DataFrame, incidents: DataFrame) -> DataFrame:
    """Each anomaly with the incident it belongs to, if there is one yet."""
    known = incidents.select(
        F.col("fingerprint").alias("_fingerprint"),
        F.col("source_id").alias("_source_id"),
        F.col("id").alias("incident_id"),
        F.col("status").alias("incident_status"),
    )
    same = (F.col("fingerprint") == F.col("_fingerprint")) & F.col("source_id").eqNullSafe(
        F.col("_source_id")
    )
    return anomalies.join(known, same, "left").drop("_fingerprint", "_source_id")


# --- commands --------------------------------------------------------------------------------


@dataclass(frozen=True)
class Commands:
    resolved: DataFrame
    rejected: DataFrame


def resolve_commands(commands: DataFrame, incidents: DataFrame) -> Commands:
    """Point every command at an incident: by its id or, for ACKNOWLEDGED, by its own key.

    ``incidents`` needs id, fingerprint and source_id. Commands of an unknown type or incident go to
    ``rejected``. Both lookups are equality joins on the incident id; commands without one get a
    value of their own that matches nothing, so that they spread over all tasks.
    """
    nowhere = F.concat(F.lit("none:"), F.col("seq").cast("string"))
    keys = incidents.select(
        F.col("id").alias("_id"),
        F.col("fingerprint").alias("_fingerprint"),
        F.col("source_id").alias("_source"),
        F.lit(True).alias("_hit"),
    ).dropDuplicates(["_id"])
    known_type = F.coalesce(F.col("type").isin(OPERATOR_EVENTS), F.lit(False))
    by_id = commands.join(
        keys, known_type & (F.coalesce("incident_id", nowhere) == F.col("_id")), "left"
    )
    own_keys = keys.select(F.col("_id").alias("_own_id"), F.col("_hit").alias("_own"))
    falls_back = (F.col("type") == "ACKNOWLEDGED") & F.col("_hit").isNull() & F.col("fingerprint").isNotNull()
    looked_up = by_id.withColumn(
        "_key", F.when(falls_back, incident_id("fingerprint", "source_id")).otherwise(nowhere)
    ).join(own_keys, F.col("_key") == F.col("_own_id"), "left")
    hit = F.col("_hit").isNotNull()
    found = hit | F.col("_own").isNotNull()
    wanted = commands.columns
    targeted = looked_up.where(found).withColumn(
        "fingerprint", F.when(hit, F.col("_fingerprint")).otherwise(F.col("fingerprint"))
    ).withColumn("source_id", F.when(hit, F.col("_source")).otherwise(F.col("source_id")))
    reason = F.when(known_type, F.lit("incident not found")).otherwise(F.lit("unsupported event type"))
    return Commands(
        targeted.select(*wanted),
        looked_up.where(~found).withColumn("reason", reason).select(*wanted, "reason"),
    )


# --- the fold --------------------------------------------------------------------------------


@dataclass(frozen=True)
class Fold:
    """Result of a fold. ``steps`` is the shared input; checkpoint it when using several outputs."""

    steps: DataFrame

    @property
    def incidents(self) -> DataFrame:
        return _incidents(self.steps)

    @property
    def events(self) -> DataFrame:
        return _events(self.steps)

    @property
    def rejected(self) -> DataFrame:
        return _rejected(self.steps)


def _anomaly_rows(anomalies: DataFrame) -> DataFrame:
    summary = F.col("summary") if "summary" in anomalies.columns else F.lit(None).cast(SUMMARY)
    return anomalies.select(
        *KEY,
        "seq",
        F.lit(1).alias("_rank"),
        F.lit("ANOMALY").alias("kind"),
        F.col("detected_at").alias("ts"),
        F.struct(
            F.col("count").cast("bigint").alias("count"), "level", "source_name", "detected_at"
        ).alias("anomaly"),
        F.col("sample_message").alias("sample"),
        summary.alias("summary"),
    )


def _command_rows(commands: DataFrame) -> DataFrame:
    return commands.select(
        *KEY,
        "seq",
        (F.array_position(F.array(*[F.lit(name) for name in OPERATOR_EVENTS]), F.col("type")) + 1)
        .cast("int")
        .alias("_rank"),
        F.col("type").alias("kind"),
        "ts",
        "actor",
        trim_to_null("note").alias("note"),
        F.col("incident_id").alias("given_id"),
    )


def _prior_rows(prior: DataFrame) -> DataFrame:
    """Stored incidents as the first row of their key; a null seq sorts before everything."""
    return prior.select(
        *KEY,
        F.lit(None).cast("bigint").alias("seq"),
        F.lit(0).alias("_rank"),
        F.coalesce("status", F.lit("OPEN")).alias("kind"),
        F.col("last_seen_at").alias("ts"),
        F.struct(
            F.col("last_window_count").cast("bigint").alias("count"),
            F.col("log_level").alias("level"),
            "source_name",
            F.col("last_seen_at").alias("detected_at"),
        ).alias("anomaly"),
        F.col("sample_message").alias("sample"),
        F.struct(
            F.col("ai_title").alias("title"),
            F.col("ai_summary").alias("summary"),
            "probable_cause",
            "suggested_actions",
            "severity",
        ).alias("summary"),
        F.struct(
            "first_seen_at", "acknowledged_at", "resolved_at", "total_occurrences", "regression_count"
        ).alias("prior"),
    )


def fold_incidents(
    anomalies: DataFrame,
    commands: DataFrame | None = None,
    prior: DataFrame | None = None,
    slice_width: int = DEFAULT_SLICE_WIDTH,
) -> Fold:
    """Apply anomalies and resolved commands to incidents in order of ``seq``.

    ``anomalies`` may carry a nullable ``summary`` struct. ``prior`` is a stored incident table that
    the fold continues from. ``seq`` must number both inputs on one arrival scale.
    """
    rows = _anomaly_rows(anomalies)
    if commands is not None:
        rows = rows.unionByName(_command_rows(commands), allowMissingColumns=True)
    if prior is not None:
        rows = rows.unionByName(_prior_rows(prior), allowMissingColumns=True)
    for name, kind in [
        ("actor", "string"),
        ("note", "string"),
        ("given_id", "string"),
        (
            "prior",
            "struct<first_seen_at:timestamp,acknowledged_at:timestamp,resolved_at:timestamp,"
            "total_occurrences:bigint,regression_count:bigint>",
        ),
    ]:
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast(kind))

    # A stored incident always has been seen, whatever its descriptors hold.
    before = running(
        rows,
        KEY,
        _ORDER,
        [
            Track("prev_kind", "last", F.col("kind")),
            Track("prev_anomaly", "last", F.col("anomaly")),
            Track("prev_sample", "last", F.when(~is_blank("sample"), F.col("sample"))),
            Track("first_sample", "first", F.col("sample")),
            Track("prev_summary", "last", F.col("summary")),
        ],
        slice_width,
        include_current=False,
        slice_name="slice",
    )
    is_prior = F.col("prior").isNotNull()
    is_anomaly = F.col("kind") == "ANOMALY"
    seen = F.col("prev_anomaly").isNotNull()
    regress = is_anomaly & F.col("seen") & F.col("prev_kind").isin(_ENDED)
    # What an event says about the incident before it is needed for commands only. Anomalies, which are
    # nearly all rows, keep their own message and no copy of an earlier one.
    carried = ["prev_anomaly", "prev_sample", "first_sample", "prev_summary"]
    slim = before.withColumn("seen", seen).withColumns(
        {name: F.when(~is_anomaly & ~is_prior, F.col(name)) for name in carried}
    )
    seen = F.col("seen")
    return Fold(
        slim.withColumn("is_prior", is_prior)
        .withColumn("accepted", is_anomaly | is_prior | seen)
        .withColumn("creates", is_anomaly & ~seen)
        .withColumn("regress", F.coalesce(regress, F.lit(False)))
        .withColumn("reset", F.col("regress") | ((F.col("kind") == "REGRESSED") & ~is_prior))
        .drop("seen", "slice")
    )


def _incidents(steps: DataFrame) -> DataFrame:
    """Final state per key, by aggregates that are partial before the shuffle."""
    accepted = steps.where("accepted").withColumn("ord", F.struct(*_ORDER))
    is_anomaly = F.col("kind") == "ANOMALY"
    fresh = ~F.col("is_prior")

    def last(value: str, when: Column) -> Column:
        return F.max_by(value, F.when(when, F.col("ord")))

    def first(value: str, when: Column) -> Column:
        return F.min_by(value, F.when(when, F.col("ord")))

    totals = accepted.groupBy(*KEY).agg(
        F.max_by("kind", "ord").alias("last_kind"),
        last("kind", ~is_anomaly).alias("last_command"),
        F.sum(F.col("regress").cast("bigint")).alias("regressions"),
        F.sum(F.when(is_anomaly, F.col("anomaly.count"))).alias("occurrences"),
        first("ts", (F.col("kind") == "ACKNOWLEDGED") & fresh).alias("acked"),
        first("ts", is_anomaly).alias("first_seen"),
        last("anomaly", F.col("anomaly").isNotNull()).alias("last_anomaly"),
        last("sample", ~is_blank("sample")).alias("last_sample"),
        first("sample", is_anomaly).alias("first_own"),
        last("summary", F.col("summary").isNotNull()).alias("summary"),
        last("ts", (F.col("kind") == "RESOLVED") & fresh).alias("last_resolved"),
        F.max(F.when((F.col("kind") == "RESOLVED") & fresh, F.col("ord"))).alias("resolved_ord"),
        F.max(F.when(F.col("reset"), F.col("ord"))).alias("key_reset"),
        F.max_by("prior", F.when(F.col("is_prior"), F.lit(1))).alias("prior"),
    )
    # The first CLOSED after the last reset; only keys that were closed take part.
    closings = accepted.where((F.col("kind") == "CLOSED") & fresh).select(
        F.col("fingerprint").alias("_f"), F.col("source_id").alias("_s"), "ord", "ts"
    )
    same = F.col("fingerprint").eqNullSafe(F.col("_f")) & F.col("source_id").eqNullSafe(F.col("_s"))
    after_reset = F.col("key_reset").isNull() | (F.col("ord") > F.col("key_reset"))
    closed = (
        closings.join(totals.select(*KEY, "key_reset"), same)
        .where(after_reset)
        .groupBy("_f", "_s")
        .agg(F.min_by("ts", "ord").alias("closed"))
    )
    current = F.col("key_reset").isNull() | (F.col("resolved_ord") > F.col("key_reset"))
    folded = totals.join(closed, same, "left").withColumns(
        {"resolved": F.when(current, F.col("last_resolved")), "first_sample": F.col("first_own")}
    )
    status = (
        F.when(F.col("last_kind") != "ANOMALY", F.col("last_kind"))
        .when(F.col("last_command").isNull(), F.lit("OPEN"))
        .when(F.col("last_command").isin(_ENDED), F.lit("REGRESSED"))
        .otherwise(F.col("last_command"))
    )
    summary = F.coalesce("summary", empty_summary())
    prior_resolved = F.when(F.col("key_reset").isNull(), F.col("prior.resolved_at"))
    return folded.select(
        incident_id(*KEY).alias("id"),
        *KEY,
        F.col("last_anomaly.source_name").alias("source_name"),
        F.col("last_anomaly.level").alias("log_level"),
        status.alias("status"),
        summary["severity"].alias("severity"),
        F.coalesce("prior.first_seen_at", "first_seen").alias("first_seen_at"),
        F.col("last_anomaly.detected_at").alias("last_seen_at"),
        F.coalesce("prior.acknowledged_at", "acked").alias("acknowledged_at"),
        F.coalesce("resolved", prior_resolved, "closed").alias("resolved_at"),
        (
            F.coalesce("prior.total_occurrences", F.lit(0)) + F.coalesce("occurrences", F.lit(0))
        ).cast("bigint").alias("total_occurrences"),
        F.col("last_anomaly.count").alias("last_window_count"),
        F.coalesce("last_sample", "first_sample").alias("sample_message"),
        summary["title"].alias("ai_title"),
        summary["summary"].alias("ai_summary"),
        summary["probable_cause"].alias("probable_cause"),
        summary["suggested_actions"].alias("suggested_actions"),
        (F.coalesce("prior.regression_count", F.lit(0)) + F.col("regressions"))
        .cast("bigint")
        .alias("regression_count"),
        F.expr("cast(array() as array<string>)").alias("tags"),
    )


def _events(steps: DataFrame) -> DataFrame:
    """CREATED for the first anomaly of a key, and one event per accepted command."""
    created = F.col("creates")
    command = F.col("accepted") & ~F.col("is_prior") & (F.col("kind") != "ANOMALY")
    anomaly = F.when(created, F.col("anomaly")).otherwise(F.col("prev_anomaly"))
    summary = F.coalesce(
        F.when(created, F.col("summary")), F.col("prev_summary"), empty_summary()
    )
    sample = F.when(created, F.col("sample")).otherwise(
        F.coalesce("prev_sample", "first_sample")
    )
    picked = steps.where(created | command).select(
        "*",
        incident_id(*KEY).alias("incident_id"),
        F.when(created, F.lit("CREATED")).otherwise(F.col("kind")).alias("type"),
        anomaly.alias("_anomaly"),
        summary.alias("_summary"),
        sample.alias("_sample"),
    )
    return picked.select(
        F.sha1(F.concat_ws(":", "incident_id", "type", F.col("seq").cast("string"))).alias("id"),
        "incident_id",
        "type",
        F.col("ts").alias("created_at"),
        *KEY,
        F.col("_anomaly.source_name").alias("source_name"),
        F.col("_anomaly.count").alias("anomaly_count"),
        F.col("_summary.severity").alias("severity"),
        F.col("_summary.title").alias("title"),
        F.col("_summary.summary").alias("summary"),
        F.col("_summary.probable_cause").alias("probable_cause"),
        F.col("_summary.suggested_actions").alias("suggested_actions"),
        F.col("_sample").alias("sample_message"),
        F.when(~created, F.col("actor")).alias("actor"),
        F.when(~created, F.col("note")).alias("note"),
        F.when(~created, F.col("kind")).alias("status"),
        "seq",
    )


def _rejected(steps: DataFrame) -> DataFrame:
    """Commands that came before their incident existed."""
    return steps.where(~F.col("accepted")).select(
        F.col("given_id").alias("incident_id"),
        *KEY,
        F.col("kind").alias("type"),
        "actor",
        "note",
        "ts",
        "seq",
        F.lit("incident not found").alias("reason"),
    )


# --- event history ---------------------------------------------------------------------------


def find_events(events: DataFrame, incident: str, event_type: str | None = None) -> DataFrame:
    """Events of one incident, newest first, optionally of one type."""
    found = events.where(F.col("incident_id") == incident)
    if event_type is not None:
        found = found.where(F.col("type") == event_type)
    return found.orderBy(F.col("created_at").desc(), F.col("id"))


def event_history(incidents: DataFrame, events: DataFrame, event_type: str | None = None) -> DataFrame:
    """Every incident with its events, in no order; ``find_events`` orders those of one incident."""
    named = incidents.select(F.col("id").alias("incident_id"), F.col("status").alias("incident_status"))
    chosen = events if event_type is None else events.where(F.col("type") == event_type)
    return named.join(chosen, "incident_id")


def latest_events(events: DataFrame) -> DataFrame:
    """The newest event of every incident."""
    newest = F.max_by(F.struct(*[name for name in events.columns if name != "incident_id"]),
                      F.struct("created_at", "seq", "id"))
    return events.groupBy("incident_id").agg(newest.alias("_event")).select("incident_id", "_event.*")
