"""Running counts with the state rule applied event by event.

The same counts as ``CountStream``, with the windows of a fingerprint in Spark's keyed state. The narrow
rows that one micro-batch holds of a fingerprint are sorted in one task, so bound the micro-batch
(``maxFilesPerTrigger``, ``maxOffsetsPerTrigger``) and prefer ``CountStream`` for hot fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from emberline.functions.times import event_or_ingest_time
from emberline.schemas import RETAINED_WINDOWS, WINDOW_SECONDS

_OUTPUT = "fingerprint string, seq bigint, source_id string, level string, window_start timestamp, window_count bigint"


class WindowCounter(StatefulProcessor):
    def __init__(self, window_seconds: int, ttl_ms: int | None) -> None:
        self.width = max(1, window_seconds)
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.windows = handle.getMapState(
            "windows", "start bigint", "total bigint", ttlDurationMs=self.ttl_ms
        )

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = {start[0]: total[0] for start, total in self.windows.iterator()}
        stored = dict(held)
        # the rows of a fingerprint in this micro-batch, in order of arrival, whatever chunks they came in
        chunk = pd.concat(list(rows)).sort_values(["seq", "source_id"], kind="stable")
        if len(chunk):
            counts = []
            for start in chunk["window_second"]:
                held[start] = held.get(start, 0) + 1
                counts.append(held[start])
                if len(held) > RETAINED_WINDOWS + 1:
                    oldest = start - self.width * RETAINED_WINDOWS
                    held = {kept: total for kept, total in held.items() if kept >= oldest}
            out = chunk[["fingerprint", "seq", "source_id", "level", "window_start"]].copy()
            out["window_count"] = counts
            yield out
        for start in stored.keys() - held.keys():
            self.windows.removeKey((start,))
        for start, total in held.items():
            if stored.get(start) != total:
                self.windows.updateValue((start,), (int(total),))

    def close(self) -> None:
        pass


def stateful_running_count(
    events: DataFrame, window_seconds: int = WINDOW_SECONDS, ttl_ms: int | None = None
) -> DataFrame:
    """Streaming running counts; needs the RocksDB state store. ``ttl_ms`` forgets idle fingerprints."""
    second = F.unix_seconds(event_or_ingest_time())
    start = second - F.pmod(second, F.lit(max(1, window_seconds)))
    rows = events.select(
        "fingerprint",
        "seq",
        "source_id",
        "level",
        F.timestamp_seconds(start).alias("window_start"),
        start.alias("window_second"),
    )
    return rows.groupBy("fingerprint").transformWithStateInPandas(
        statefulProcessor=WindowCounter(window_seconds, ttl_ms),
        outputStructType=_OUTPUT,
        outputMode="Append",
        timeMode="ProcessingTime" if ttl_ms else "None",
    )
