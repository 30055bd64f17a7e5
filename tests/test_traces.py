"""Traces as a stream against the rollup of all events at once."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from evidentia.streaming import events as streaming
from evidentia.streaming import traces

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def made(seed, n, days=1):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        kind, phase = rng.choice(["agent", "llm", "tool", "evaluator"]), rng.choice(["start", "end"])
        status = rng.choice(["ok", "error", None])
        error = f"fault {k}" if status == "error" and rng.random() < 0.7 else None
        rows.append((f"t{rng.randrange(6)}", f"s{rng.randrange(20)}", kind, phase, status, error, rng.choice([None, "w1", "w2"]), T0 + dt.timedelta(minutes=rng.randrange(50)), k, rng.choice([None, k]), rng.choice([None, 10 * k]), k % 50, rng.choice([None, 0.25, 0.5])))
    return rows


def key(df):
    order = ["trace_id", "started_at", "updated_at", "span_count", "event_count", "input_tokens", "output_tokens", "cost_usd", "status", "ended_at", "duration_ms", "error", "workflow_run_ids"]
    return sorted(tuple(round(r[c], 9) if c == "cost_usd" else (tuple(r[c]) if c == "workflow_run_ids" else r[c]) for c in order) for r in df.collect())


def drain(spark, folder, idle, watermark="1 hour"):
    stream = spark.readStream.schema(traces.EVENT).option("maxFilesPerTrigger", 1).parquet(folder).withWatermark("ts", watermark)
    return streaming.drained(traces.traces(stream, idle), "traces", "update")


@pytest.fixture
def few(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 2)
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_batches_in_any_order_come_to_the_rollup(spark, tmp_path, few):
    rows = made(1, 150)
    for k in range(3):  # each file has events of all times: rows come late, within the watermark
        spark.createDataFrame(rows[k::3], traces.EVENT).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    last = spark.createDataFrame([("end", "s", "agent", "end", "ok", None, None, T0 + dt.timedelta(days=3), 10_000, 5, None, None, None)], traces.EVENT)
    last.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    found = drain(spark, str(tmp_path / "in"), "30 minutes")
    every = spark.createDataFrame(rows, traces.EVENT)
    got = traces.latest(found).where("trace_id <> 'end'")
    assert key(got) == key(traces.rollup(every))
    # the watermark has passed every trace but the last: their rows are closed, and each is closed once
    assert got.where("not closed").count() == 0 and found.where("closed").groupBy("trace_id").count().where("count > 1").count() == 0
    assert found.where("closed").count() == 6


def test_state_is_let_go(spark, tmp_path, few):
    """After the watermark has passed, the only state left is that of the trace that moved it."""
    rows = made(2, 60)
    for part in (rows, [("end", "s", "tool", "end", "ok", None, None, T0 + dt.timedelta(days=2), 10_000, 5, None, None, None)]):
        spark.createDataFrame(part, traces.EVENT).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(traces.EVENT).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).withWatermark("ts", "10 minutes")
    with streaming.keyed_state(spark):
        q = traces.traces(stream, "20 minutes").writeStream.outputMode("update").format("noop").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        q.awaitTermination()
    kept = spark.read.format("statestore").option("stateVarName", "trace").load(str(tmp_path / "check"))
    assert [r.key.trace_id for r in kept.select("key").collect()] == ["end"]


def test_partials_of_any_windows_and_batches_come_to_the_rollup(spark, tmp_path, few):
    rows = made(4, 200) + [(None, "s", "agent", "end", "ok", None, None, T0, 900, 1, None, None, None), ("t0", "s1", "agent", "end", "ok", None, None, None, 901, 1, None, None, None)]
    for k in range(3):
        spark.createDataFrame(rows[k::3], traces.EVENT).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(traces.EVENT).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).withWatermark("ts", "1 hour")
    found = traces.merged(streaming.drained(traces.partials(stream, "10 minutes"), "partials", "update"))
    assert key(found) == key(traces.rollup(spark.createDataFrame(rows, traces.EVENT)))


def test_the_query_sends_no_message_for_each_trace(spark, sf, monkeypatch):
    """A state of its own in Python for every trace took the query over its time on many short traces."""
    from evidentia import queries_life

    monkeypatch.setattr(traces, "traces", lambda *a: pytest.fail("a processor in Python"))
    assert sorted(map(tuple, queries_life.QUERIES["stream_trace_rollups"](spark, sf).collect())) == sorted(map(tuple, queries_life.QUERIES["trace_rollups"](spark, sf).collect()))


def test_costs(spark):
    rates = {"a": (2.0, None, 10.0), "b": (1.0, 0.5, 4.0), "bad": (-1.0, 0.0, 0.0)}
    calls = [(0.7, "a", 100, 0, 10), (0.0, "a", 1_000_000, 400_000, 100_000), (None, "b", 1_000_000, 2_000_000, 0), (None, "bad", 5, 5, 5), (None, "none", 5, 5, 5), (None, "a", -1, 0, 0), (None, None, 1, 1, 1), (None, "a", None, None, 10)]
    df = spark.createDataFrame(calls, "d double, m string, i long, c long, o long")
    got = [r.x for r in df.select(traces.cost(F.col("d"), F.col("m"), F.col("i"), F.col("c"), F.col("o"), rates).alias("x")).collect()]
    assert got == pytest.approx([0.7, 0.6 * 2 + 0.4 * 2 + 1.0, 0.0 + 2 * 0.5, 0.0, 0.0, 0.0, 0.0, 10 * 10 / 1e6])
