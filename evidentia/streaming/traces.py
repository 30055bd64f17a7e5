"""Traces as a stream: state for each trace with its spans, in any order of events, let go by a timer of event time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..session import ship

#: Kinds of span whose ends are paid for, and the kind whose end ends the trace.
BILLABLE, ROOT = ("llm", "evaluator"), "agent"
UNSET = "unset"

EVENT = "trace_id string, span_id string, kind string, phase string, status string, error string, workflow_run_id string, ts timestamp, event_id long, duration_ms long, input_tokens long, output_tokens long, cost_usd double"
ROLLUP = (
    "started_at timestamp, updated_at timestamp, span_count long, event_count long, input_tokens long, output_tokens long, cost_usd double, status string, ended_at timestamp, duration_ms long, "
    "error string, workflow_run_ids array<string>"
)
EVENT_FIELDS = [c.split()[0] for c in EVENT.split(", ")]
#: What state holds of a trace: times as microseconds, so that workers neither convert them nor need a time zone.
STATE = ROLLUP.replace("timestamp", "long") + ", ended_id long, failed_at long, failed_id long, timer long"
FIELDS = [f.strip().split()[0] for f in STATE.split(", ")]
SHOWN = [f.strip().split()[0] for f in ROLLUP.split(", ")]
TIMES = [f.split()[0] for f in ROLLUP.split(", ") if f.endswith(" timestamp")]
RESULT = "trace_id string, closed boolean, " + ROLLUP.replace("timestamp", "long")


def cost(direct: Column, model: Column, tokens_in: Column, cached: Column, tokens_out: Column, rates: dict[str, tuple[float, float | None, float]]) -> Column:
    """Dollars of a call: what it says itself if over 0; else by the rates per million of its model (input, cached input or
    None for that of input, output). Nothing without rates, or where a count or rate is negative. Missing counts are 0."""
    n_in, n_cached, n_out = (F.coalesce(c.cast("double"), F.lit(0.0)) for c in (tokens_in, cached, tokens_out))
    by_model = F.lit(0.0)
    for name, (rate_in, rate_cached, rate_out) in rates.items():
        less = rate_in if rate_cached is None else rate_cached
        if min(rate_in, less, rate_out) >= 0:
            by_model = F.when(model == name, (F.greatest(n_in - n_cached, F.lit(0.0)) * rate_in + n_cached * less + n_out * rate_out) / 1e6).otherwise(by_model)
    return F.when(direct > 0, direct).when(F.least(n_in, n_cached, n_out) < 0, 0.0).otherwise(by_model)


def billed(events: DataFrame) -> DataFrame:
    """Events whose tokens and cost count only at the end of a billable span; missing ones are 0."""
    pays = (F.col("phase") == "end") & F.col("kind").isin(*BILLABLE)
    return events.withColumns({c: F.when(pays, F.coalesce(c, F.lit(0).cast(kind))).otherwise(F.lit(0).cast(kind)) for c, kind in (("input_tokens", "long"), ("output_tokens", "long"), ("cost_usd", "double"))})


def rollup(events: DataFrame) -> DataFrame:
    """trace_id and ROLLUP of every trace over a finished table of EVENT rows: what the stream comes to.

    Status, end and length are those of the last end of a root span by time and event_id, else unset and null; the error is
    that of the last event with the status error that says one; runs are sorted. Rows without a trace are left out.
    """
    e = billed(events.where("trace_id is not null and ts is not null"))
    root, failed = (F.col("kind") == ROOT) & (F.col("phase") == "end"), (F.col("status") == "error") & F.col("error").isNotNull()
    at = F.struct("ts", "event_id")
    last = F.max_by(F.struct(F.coalesce("status", F.lit(UNSET)).alias("status"), F.col("ts").alias("ended_at"), F.coalesce("duration_ms", F.lit(0)).alias("duration_ms")), F.when(root, at))
    found = e.groupBy("trace_id").agg(
        F.min("ts").alias("started_at"), F.max("ts").alias("updated_at"), F.count_distinct("span_id").alias("span_count"), F.count("*").alias("event_count"),
        *[F.sum(c).alias(c) for c in ("input_tokens", "output_tokens", "cost_usd")], last.alias("last"), F.max_by("error", F.when(failed, at)).alias("error"),
        F.array_sort(F.collect_set("workflow_run_id")).alias("workflow_run_ids"),
    )
    return found.withColumns({"status": F.coalesce("last.status", F.lit(UNSET)), "ended_at": F.col("last.ended_at"), "duration_ms": F.col("last.duration_ms")}).select(
        "trace_id", *SHOWN
    )


class TraceProcessor(StatefulProcessor):
    """One trace: its rollup as a value, its spans as a list, and one timer, idle after the last event.

    A batch is folded in by comparing times, so events may come in any order within the watermark. Each batch that touches a
    trace gives its row as it stands; when the watermark passes the timer the last row comes, closed, and all state goes.
    Every call on state is a message to the JVM, so there are a few for a trace and batch and none for an event or a span.
    """

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.trace = handle.getValueState("trace", STATE)
        self.spans = handle.getListState("spans", "span_id string")

    def _row(self, key: tuple, state: dict, closed: bool) -> Row:
        return Row(trace_id=key[0], closed=closed, **{k: state[k] for k in SHOWN})

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        old = self.trace.get()
        state = dict(zip(FIELDS, old)) if old is not None else dict.fromkeys(FIELDS)
        for name in ("span_count", "event_count", "input_tokens", "output_tokens"):
            state[name] = state[name] or 0
        state["cost_usd"], state["status"] = state["cost_usd"] or 0.0, state["status"] or UNSET
        runs = set(state["workflow_run_ids"] if state["workflow_run_ids"] is not None else ())
        spans = set()
        for event in rows:
            at = (event.at, event.event_id)
            state["started_at"] = event.at if state["started_at"] is None else min(state["started_at"], event.at)
            state["updated_at"] = event.at if state["updated_at"] is None else max(state["updated_at"], event.at)
            state["event_count"] += 1
            for name in ("input_tokens", "output_tokens", "cost_usd"):
                state[name] += getattr(event, name)
            if event.workflow_run_id is not None:
                runs.add(event.workflow_run_id)
            if event.span_id is not None:
                spans.add(event.span_id)
            if event.root and (state["ended_at"] is None or at > (state["ended_at"], state["ended_id"])):
                state["ended_at"], state["ended_id"] = at
                state["status"] = UNSET if event.status is None else event.status
                state["duration_ms"] = event.duration_ms or 0
            if event.error is not None and event.status == "error" and (state["failed_at"] is None or at > (state["failed_at"], state["failed_id"])):
                state["failed_at"], state["failed_id"] = at
                state["error"] = event.error
        if spans and state["span_count"]:
            spans.difference_update(known for (known,) in self.spans.get())
        if spans:
            self.spans.appendList([(span,) for span in spans])
            state["span_count"] += len(spans)
        state["workflow_run_ids"] = sorted(runs)
        timer = state["updated_at"] // 1000 + self.idle_ms
        if state["timer"] != timer:
            if state["timer"] is not None:
                self.handle.deleteTimer(state["timer"])
            self.handle.registerTimer(timer)
            state["timer"] = timer
        self.trace.update(tuple(state[k] for k in FIELDS))
        yield self._row(key, state, False)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        state = dict(zip(FIELDS, self.trace.get()))
        self.trace.clear()
        self.spans.clear()
        yield self._row(key, state, True)

    def close(self) -> None:
        pass


def traces(events: DataFrame, idle: str = "1 hour") -> DataFrame:
    """A row for every trace that a batch of a stream of EVENT rows (with a watermark on ts) touches, and a last one, closed,
    when the watermark is idle past its last event. Events of a closed trace's id begin a new one."""
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000)
    root = F.coalesce((F.col("kind") == ROOT) & (F.col("phase") == "end"), F.lit(False))
    known = billed(events.where("trace_id is not null and ts is not null")).select(
        "trace_id", "ts", F.unix_micros("ts").alias("at"), "event_id", root.alias("root"), *[c for c in EVENT_FIELDS if c not in ("trace_id", "ts", "event_id", "kind", "phase")]
    )
    found = known.groupBy("trace_id").transformWithState(TraceProcessor(idle_ms), RESULT, "Update", "EventTime")
    return found.select("trace_id", "closed", *[F.timestamp_micros(c).alias(c) if c in TIMES else c for c in SHOWN])


def partials(events: DataFrame, width: str = "1 day") -> DataFrame:
    """What each window of time holds of a trace, as rows that merged() puts together: a streaming aggregation in the JVM.

    State is a row for a trace and window, which the watermark lets go; a trace may last over any number of windows. No event
    or trace passes through Python, so this is for many short traces whose rollups are wanted and not the moment they end.
    """
    e = billed(events.where("trace_id is not null and ts is not null"))
    root, failed = (F.col("kind") == ROOT) & (F.col("phase") == "end"), (F.col("status") == "error") & F.col("error").isNotNull()
    last = F.struct("ts", "event_id", F.coalesce("status", F.lit(UNSET)).alias("status"), F.coalesce("duration_ms", F.lit(0)).alias("duration_ms"))
    return e.groupBy("trace_id", F.window("ts", width).alias("w")).agg(
        F.min("ts").alias("started_at"), F.max("ts").alias("updated_at"), F.count("*").alias("event_count"), *[F.sum(c).alias(c) for c in ("input_tokens", "output_tokens", "cost_usd")],
        F.collect_set("span_id").alias("spans"), F.collect_set("workflow_run_id").alias("runs"), F.max(F.when(root, last)).alias("last"), F.max(F.when(failed, F.struct("ts", "event_id", "error"))).alias("failed"),
    )


def merged(rows: DataFrame) -> DataFrame:
    """trace_id and ROLLUP of every trace in a drained stream of partials; of a window that several batches touched, the row
    with most events counts."""
    columns = [c for c in rows.columns if c not in ("trace_id", "w")]
    whole = rows.groupBy("trace_id", "w").agg(F.max_by(F.struct(*columns), "event_count").alias("p")).select("trace_id", "p.*")
    found = whole.groupBy("trace_id").agg(
        F.min("started_at").alias("started_at"), F.max("updated_at").alias("updated_at"), *[F.sum(c).alias(c) for c in ("event_count", "input_tokens", "output_tokens", "cost_usd")],
        *[F.array_distinct(F.flatten(F.collect_list(c))).alias(c) for c in ("spans", "runs")], F.max("last").alias("last"), F.max("failed").alias("failed"),
    )
    return found.withColumns({
        "span_count": F.size("spans").cast("long"), "status": F.coalesce("last.status", F.lit(UNSET)), "ended_at": F.col("last.ts"), "duration_ms": F.col("last.duration_ms"), "error": F.col("failed.error"),
        "workflow_run_ids": F.array_sort("runs"),
    }).select("trace_id", *SHOWN)


def latest(rows: DataFrame) -> DataFrame:
    """Of a drained stream of traces the last row of each: the one with most events."""
    columns = [c for c in rows.columns if c != "trace_id"]
    return rows.groupBy("trace_id").agg(F.max_by(F.struct(*columns), F.struct("event_count", "closed")).alias("t")).select("trace_id", *[f"t.{c}" for c in columns if c != "closed"], "t.closed")


ship(__name__)
