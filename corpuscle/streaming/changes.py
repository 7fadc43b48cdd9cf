"""Change streams: debounced batches of the last event for each path.

Watermarks and per-path sessions are this engine's own; in a batch the same windows
apply without them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpuscle.operators.maintenance import is_wanted


def debounced(events: DataFrame, quiet: str = "2 seconds", late: str | None = None) -> DataFrame:
    """A row for each path and burst: the last event, its time, and the number of events. events: path, ts, change."""
    rows = events.withWatermark("ts", late) if late else events
    w = F.session_window("ts", quiet)
    return rows.groupBy("path", w).agg(F.max_by("change", F.struct("ts", "change")).alias("change"), F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("events")).select("path", "change", "last_ts", "events")


def watched(events: DataFrame) -> DataFrame:
    """Events of files that an index holds."""
    return events.where(is_wanted(F.col("path")))


def run(events: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True, every: str = "300 seconds") -> StreamingQuery:
    """Starts the stream of debounced changes: all there is, or a batch at every interval."""
    writer = debounced(watched(events), late="10 minutes").writeStream.outputMode("append").foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()
