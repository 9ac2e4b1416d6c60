"""Lines to anomalies to incidents, as one declarative chain."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.operators.counting import detect_anomalies
from emberline.operators.dashboard import incident_cards, nest_samples, recent_incidents
from emberline.operators.entries import log_entries
from emberline.operators.incidents import (
    KEY,
    Fold,
    fold_incidents,
    incident_samples,
    resolve_commands,
    rollup_incidents,
)
from emberline.operators.parsing import log_events
from emberline.operators.running import DEFAULT_SLICE_WIDTH
from emberline.session import stage
from emberline.schemas import ALERT_THRESHOLD, IDLE_FLUSH_MS, MAX_ENTRY_LINES, WINDOW_SECONDS


@dataclass(frozen=True)
class Settings:
    max_lines: int = MAX_ENTRY_LINES
    idle_ms: int | None = IDLE_FLUSH_MS
    window_seconds: int = WINDOW_SECONDS
    threshold: int = ALERT_THRESHOLD
    slice_width: int = DEFAULT_SLICE_WIDTH


def events_of(lines: DataFrame, settings: Settings = Settings()) -> DataFrame:
    return log_events(
        log_entries(lines, settings.max_lines, settings.idle_ms, settings.slice_width)
    )


def anomalies_of(events: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Anomalies of stored events, which are read twice: slice totals first, rows second."""
    return detect_anomalies(
        events,
        settings.window_seconds,
        settings.threshold,
        slice_width=settings.slice_width,
    )


def staged_anomalies(lines: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Lines to anomalies with a stored table after each step."""
    events = stage(events_of(lines, settings), "events")
    return stage(anomalies_of(events, settings), "anomalies")


@dataclass(frozen=True)
class Outcome:
    fold: Fold
    unresolved: DataFrame

    @property
    def rejected(self) -> DataFrame:
        """All commands that had no effect."""
        return self.unresolved.unionByName(self.fold.rejected, allowMissingColumns=True)


def incidents_of(
    anomalies: DataFrame,
    commands: DataFrame,
    prior: DataFrame | None = None,
    slice_width: int = DEFAULT_SLICE_WIDTH,
) -> Outcome:
    """Resolve commands against known and newly created incidents, then fold.

    The resolved commands and the folded steps are stored: each is read several times below.
    """
    known = rollup_incidents(anomalies).select("id", *KEY)
    if prior is not None:
        known = known.unionByName(prior.select("id", *KEY))
    commands_by_key = resolve_commands(commands, known)
    resolved = stage(commands_by_key.resolved, "commands")
    steps = fold_incidents(anomalies, resolved, prior, slice_width).steps
    return Outcome(Fold(stage(steps, "steps")), commands_by_key.rejected)


def recent_cards(
    incidents: DataFrame, anomalies: DataFrame, slice_width: int = DEFAULT_SLICE_WIDTH
) -> DataFrame:
    """Cards of the incidents seen last; samples are gathered for those incidents only."""
    recent = recent_incidents(incidents)
    keys = recent.select(F.col("fingerprint").alias("_f"), F.col("source_id").alias("_s"))
    same = (F.col("fingerprint") == F.col("_f")) & F.col("source_id").eqNullSafe(F.col("_s"))
    samples = incident_samples(anomalies.join(keys, same, "left_semi"), slice_width)
    return incident_cards(nest_samples(recent, samples))
