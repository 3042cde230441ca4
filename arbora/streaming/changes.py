"""Change streams: debounced file events, and a sync on a timer."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

QUIET = "300 milliseconds"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def debounced(events: DataFrame, quiet: str = QUIET, late: str = "10 seconds") -> DataFrame:
    """path, start, end, op, events: one row for each burst of a path's events, with its last operation.

    A burst ends when nothing comes for the quiet time. For streams and for tables; a stream's bursts come out when the
    watermark has passed them.
    """
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    by = rows.groupBy("path", F.session_window("ts", quiet).alias("w")).agg(F.max_by("op", "ts").alias("op"), F.count(F.lit(1)).alias("events"))
    return by.select("path", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "op", "events")


class Burst(StatefulProcessor):
    """Of a path its open burst, as state: when it began, its last event, what that was, and how many there were."""

    def __init__(self, quiet: int):
        self.quiet = quiet

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("burst", "start timestamp, last timestamp, op string, events long")

    def row(self, path: str, burst: tuple) -> pd.DataFrame:
        start, last, op, events = burst
        return pd.DataFrame({"path": [path], "start": [start], "end": [last + pd.Timedelta(milliseconds=self.quiet)], "op": [op], "events": [events]})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows)).sort_values(["ts", "op"], kind="stable")
        burst = tuple(self.open.get()) if self.open.exists() else None
        for ts, op in zip(events["ts"], events["op"], strict=True):
            if burst is not None and ts - burst[1] >= pd.Timedelta(milliseconds=self.quiet):
                yield self.row(key[0], burst)
                burst = None
            burst = (ts, ts, op, 1) if burst is None else (min(burst[0], ts), max(burst[1], ts), op if ts >= burst[1] else burst[2], burst[3] + 1)
        self.open.update(burst)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.quiet)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.open.exists():
            yield self.row(key[0], tuple(self.open.get()))
            self.open.clear()

    def close(self) -> None:
        pass


def trailing(events: DataFrame, quiet_ms: int = 300) -> DataFrame:
    """path, start, end, op, events of a stream's bursts, each as soon as its path has been quiet for so long by the clock.

    As debounced(), but no later event has to move a watermark: each event sets a processing-time timer of its path anew,
    so a stream's last burst comes out by itself. Events of one micro-batch are also parted where their ts are that far apart.
    Events with a null path or ts are left out; of equal ts the op that sorts last counts. State is a row for each path with an open burst. The stream
    needs the RocksDB state store, which this sets for the session; output mode append or update.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    rows = events.select(F.col("path").cast("string").alias("path"), F.col("ts").cast("timestamp").alias("ts"), F.col("op").cast("string").alias("op")).where("path IS NOT NULL AND ts IS NOT NULL")
    return rows.groupBy("path").transformWithStateInPandas(Burst(quiet_ms), "path string, start timestamp, end timestamp, op string, events long", "Append", "ProcessingTime")


def on_timer(ticks: DataFrame, seconds: int, sync: Callable[[int], None], checkpoint: str) -> StreamingQuery:
    """Calls sync with the batch's number every so many seconds; ticks is any stream that has rows, a rate source for one."""
    if seconds <= 0:
        raise ValueError("the interval must be positive")
    return ticks.writeStream.trigger(processingTime=f"{seconds} seconds").option("checkpointLocation", checkpoint).foreachBatch(lambda _, n: sync(n)).start()


def to_batches(stream: DataFrame, sink: Callable[[DataFrame], None], checkpoint: str) -> StreamingQuery:
    """Hands each micro-batch to a sink; all that is there, then it ends."""
    return stream.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(lambda df, _: sink(df)).start()
