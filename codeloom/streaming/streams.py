"""Structured Streaming forms: debounced changes, branch switches, metrics, and sessions with state."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.scan import GLOB, sources


def debounced(events: DataFrame, key: str, ts: str, gap: str = "200 milliseconds", late: str = "1 minute") -> DataFrame:
    """events with a timestamp column -> (key, start, end, n, last): a burst is over after a gap without events."""
    return events.withWatermark(ts, late).groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n"), F.max(ts).alias("last")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "last")


def hourly(events: DataFrame, kind: str, ts: str, late: str = "1 hour") -> DataFrame:
    return events.withWatermark(ts, late).groupBy(F.window(ts, "1 hour").alias("w"), kind).agg(F.count("*").alias("calls")).select(F.col("w.start").alias("hour"), kind, "calls")


def sessions(events: DataFrame, key: str) -> DataFrame:
    """(key, n, last): running count and last event of each key, kept as state."""

    def step(k, frames, state):
        n, last = state.get if state.exists else (0, 0)
        for f in frames:
            n, last = n + len(f), max(last, int(f["event_id"].max()))
        state.update((n, last))
        yield pd.DataFrame({key: [k[0]], "n": [n], "last": [last]})

    return events.groupBy(key).applyInPandasWithState(step, f"{key} long, n long, last long", "n long, last long", "update", "NoTimeout")


def file_changes(spark: SparkSession, root: str, files_a_batch: int = 1000, patterns: list[str] = ()) -> DataFrame:
    """A stream of source files that are new or changed below root, new folders included; `ts` is the time of the change.

    The rate limit takes the place of a bounded buffer: what a batch doesn't take waits in the folder, so nothing is dropped.
    """
    raw = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
    raw = raw.option("recursiveFileLookup", True).option("pathGlobFilter", GLOB).option("maxFilesPerTrigger", files_a_batch).load(root)
    return sources(raw, root, patterns)


def record_calls(calls: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Tool calls appended to a table in batches, as they come; arguments are kept as JSON."""
    return calls.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def on_changes(changes: DataFrame, path: str, apply: Callable[[DataFrame], None], rescan: Callable[[], None], checkpoint: str, many: int = 20) -> StreamingQuery:
    """Each micro-batch: the last change of every path is applied; over `many` paths at once, as after a branch switch, all is
    scanned again. Batches are committed one after another, so there's one writer."""

    def batch(df: DataFrame, _: int) -> None:
        last = df.groupBy(path).agg(F.max_by(F.struct(*df.columns), "ts").alias("r")).select("r.*").persist()
        try:
            if last.count() > many:
                rescan()
            elif not last.isEmpty():
                apply(last.drop("ts") if "content_hash" in last.columns else last)
        finally:
            last.unpersist()

    return changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
