"""Streams of events: a file source with a watermark, rollups and deduplication."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..session import shared_dir, ship


def event_stream(spark: SparkSession, folder: str, watermark: str = "1 hour", pattern: str = "events.parquet") -> DataFrame:
    """The events of a folder as a stream; times become instants, which a watermark needs."""
    schema = spark.read.parquet(f"{folder}/{pattern}").schema
    found = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{folder}/{pattern.split('.')[0]}*.parquet")
    return found.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)


def window_counts(events: DataFrame, width: str = "1 day") -> DataFrame:
    return events.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    return events.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("session_start"), "n")


def deduplicated(events: DataFrame, keys: list[str]) -> DataFrame:
    """One event of each key; on a stream with a watermark, of those within it, so that state is let go."""
    return events.dropDuplicatesWithinWatermark(keys) if events.isStreaming else events.dropDuplicates(keys)


TRACE = "started_at timestamp, updated_at timestamp, n long, last_kind string, last_id long"
#: A trace without events for so long, by the watermark, is let go.
IDLE_MS = 400 * 86_400_000


class _LastKind(StatefulProcessor):
    """A trace's first and last time, its events, and the kind of the last one by time and id; a timer ends it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.trace = handle, handle.getValueState("trace", TRACE)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        started, updated, n, kind, last = self.trace.get() if self.trace.exists() else (None, None, 0, None, -1)
        timers = [] if updated is None else [updated]
        for events in rows:
            newest = events.sort_values(["ts", "event_id"]).iloc[-1]
            first, latest = events["ts"].min().to_pydatetime(), newest["ts"].to_pydatetime()
            started, n = first if started is None else min(started, first), n + len(events)
            if updated is None or (latest, int(newest["event_id"])) > (updated, last):
                updated, kind, last = latest, newest["event_type"], int(newest["event_id"])
        for time in timers:
            self.handle.deleteTimer(int(time.timestamp() * 1000) + IDLE_MS)
        self.handle.registerTimer(int(updated.timestamp() * 1000) + IDLE_MS)
        self.trace.update((started, updated, n, kind, last))
        yield pd.DataFrame([(*key, started, updated, n, kind, last)], columns=["user_id", "started_at", "updated_at", "n", "last_kind", "last_id"])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.trace.clear()
        return iter(())

    def close(self) -> None:
        pass


def traces(events: DataFrame) -> DataFrame:
    """A row for every trace that a batch of events touches, as it stands then: first and last time, events, and the kind of
    the last event by time. One state per trace, so that its events are taken one batch after the other, in any order; it
    ends IDLE_MS after them."""
    rows = events.select("user_id", "ts", "event_id", "event_type")
    return rows.groupBy("user_id").transformWithStateInPandas(_LastKind(), f"user_id long, {TRACE}", "Update", "EventTime")


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """While streams with timers start, states are kept in RocksDB, which those need; the setting is put back."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def drained(stream: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Run a stream over what its source holds now and return its result table, which is written and not kept by the driver.

    In complete mode the last batch is the result, in append and update mode each batch adds rows.
    """
    folder = shared_dir(stream.sparkSession)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/{name}" + ("" if mode == "complete" else f"/batch={number}"))

    with keyed_state(stream.sparkSession):
        query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/{name}")


ship(__name__)
