"""Changes of files as a stream: bursts per path are drawn together, then applied to the index."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

QUIET = "500 milliseconds"
KINDS = ("create", "modify", "remove")


def relevant(events: DataFrame) -> DataFrame:
    """events (path, kind, ts) of the three kinds, outside of hidden folders, such as the index's and git's."""
    return events.where(F.col("kind").isin(*KINDS) & ~F.col("path").rlike(r"(^|/)\.[^/]"))


def debounce(events: DataFrame, gap: str = QUIET, late: str | None = None, by: str | None = None) -> DataFrame:
    """start, end, paths, n_events of each burst: events follow each other within `gap`. by: a column whose values have bursts of their own. On a stream `late` is how long out-of-order events are waited for."""
    if events.isStreaming or late:
        events = events.withWatermark("ts", late or "10 seconds")
    keys = [F.session_window("ts", gap).alias("w"), *([by] if by else [])]
    out = events.groupBy(*keys).agg(F.sort_array(F.collect_set("path")).alias("paths"), F.count("*").alias("n_events"))
    return out.select(*([by] if by else []), F.col("w.start").alias("start"), F.col("w.end").alias("end"), "paths", "n_events")


def follow(events: DataFrame, apply: Callable[[list[str]], None], checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Apply the distinct paths of each micro-batch: apply(paths) has to be safe to repeat. trigger: as of writeStream.trigger; by default every 500 ms."""

    def batch(df: DataFrame, _: int) -> None:
        paths = [r.path for r in relevant(df).select("path").distinct().toLocalIterator()]
        if paths:
            apply(paths)

    return events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": QUIET})).start()
