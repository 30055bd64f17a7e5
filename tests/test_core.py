"""The engine's operators on hand-computed rows."""

import base64
import dataclasses
import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from evidentia import queries
from evidentia.functions import text
from evidentia.operators import graph, observe, retrieval
from evidentia.plans import semantic, store_query
from evidentia.sources import tables
from evidentia.streaming import events


def ids(df):
    return [r.id for r in df.collect()]


def test_store_sort_and_missing_values(spark):
    df = spark.createDataFrame([("1", True, 2.0), ("2", False, 10.0), ("3", None, None), ("4", False, 1.0)], "id string, flag boolean, n double")
    assert ids(store_query.run(df, {"sort": [{"field": "flag"}]})) == ["2", "4", "1", "3"]
    assert ids(store_query.run(df, {"sort": [{"field": "n"}]})) == ["4", "1", "2", "3"]
    assert ids(store_query.run(df, {"sort": [{"field": "n", "dir": "desc"}]})) == ["3", "2", "1", "4"]


def test_store_logic_is_two_valued(spark):
    df = spark.createDataFrame([("1", 5.0, {"b": "x"}), ("2", None, None)], "id string, n double, a struct<b:string>")
    leaf = {"op": "gt", "field": "n", "value": 3}
    assert ids(store_query.run(df, {"where": leaf})) == ["1"]
    assert ids(store_query.run(df, {"where": {"op": "not", "filter": leaf}})) == ["2"]
    assert ids(store_query.run(df, {"where": {"op": "neq", "field": "n", "value": "5"}})) == ["1"]
    assert ids(store_query.run(df, {"where": {"op": "nin", "field": "n", "value": []}})) == ["1"]
    assert ids(store_query.run(df, {"where": {"op": "in", "field": "n", "value": []}})) == []
    assert ids(store_query.run(df, {"where": {"op": "eq", "field": ["a", "b"], "value": "x"}})) == ["1"]
    assert ids(store_query.run(df, {"where": {"op": "exists", "field": "a.b", "value": False}})) == ["1", "2"]


def test_store_pages_and_errors(spark):
    df = spark.range(5).select(F.col("id").cast("string").alias("id"))
    rows, total, cursor = store_query.page(df, {"limit": 2})
    assert (ids(rows), total) == (["0", "1"], 5)
    rows, total, cursor = store_query.page(df, {"cursor": cursor})
    assert ids(rows) == ["2", "3"]
    rows, total, cursor = store_query.page(df, {"cursor": cursor})
    assert ids(rows) == ["4"] and cursor is None
    for bad, at in (({"limit": 0}, "/limit"), ({"where": {"op": "and", "filters": []}}, "/where/filters"), ({"where": {"op": "like", "field": "a"}}, "/where/op"), ({"what": 1}, "/what"), ({"cursor": "!"}, "/cursor"), *(({"cursor": base64.urlsafe_b64encode(c).decode()}, "/cursor") for c in (b"[1]", b"null", b"\"x\"", b"{\"offset\": -1}", b"{\"offset\": true}")), ({"sort": ["a"]}, "/sort/0"), ({"sort": "a"}, "/sort")):
        with pytest.raises(store_query.StoreQueryError) as e:
            store_query.run(df, bad)
        assert e.value.pointer == at


def test_semantic_plan_caps_and_refuses(spark):
    df = spark.createDataFrame([("paid", 2.0), ("paid", 3.0), ("open", 1.0)], "status string, amount double")
    table = semantic.CatalogTable("orders", (semantic.CatalogColumn("status", display_name="Order Status"), semantic.CatalogColumn("amount", allowed=False)), (semantic.Metric("total", "sum", "amount"), semantic.Metric("rate", "ratio", "amount")), max_rows=50)
    plan = semantic.plan(df, table, "total", ("Order Status",), (("status", "eq", "paid"),), 200)
    assert plan.frame.collect() == [("paid", 5.0)] and plan.limit == 50 and plan.warnings
    limited = dataclasses.replace(table, row_filter="status = 'open;'  or status = 'paid'")
    assert semantic.plan(df, limited, "total").frame.collect() == [(5.0,)]
    for bad in ("1 = 1; DROP TABLE t", "amount > (SELECT 1)", "", "a = 1 /* x", "delete = 1"):
        assert semantic.check_condition(bad)
    with pytest.raises(semantic.PlanError):
        semantic.plan(df, dataclasses.replace(table, row_filter="amount > (SELECT 1)"), "total")
    for args in (("nothing",), ("total", ("amount",)), ("rate",)):
        with pytest.raises(semantic.PlanError):
            semantic.plan(df, table, *args)


@pytest.mark.parametrize(
    "sql, good",
    [
        ("SELECT a FROM t LIMIT 5", True), ("SELECT a FROM t -- delete\nLIMIT 5;", True), ("SELECT 'drop' FROM t LIMIT 1", True), ("DELETE FROM t", False), ("SELECT a FROM t", False),
        ("SELECT a FROM t CROSS JOIN u LIMIT 1", False), ("SELECT 1 LIMIT 1; SELECT 2 LIMIT 1", False), ("WITH x AS (DELETE FROM t) SELECT 1 LIMIT 1", False),
        ("SELECT 1 LIMIT 1 + '--'; DROP TABLE t", False), ("SELECT '/*'; DROP TABLE t; SELECT '*/' LIMIT 1", False), ("SELECT '--', \"/*\" FROM t /* ; */ LIMIT 1", True), ("SELECT 'it''s; drop' FROM t LIMIT 1;;", True),
        ("SELECT a INTO b FROM t LIMIT 1", False), ("SELECT 'a\\'; DROP TABLE t --' LIMIT 1", False), ("SELECT /* /* */ ' */ ; DROP TABLE t --' LIMIT 1", False), ("SELECT 'a LIMIT 1", False), ("SELECT a /* LIMIT 1", False), ("COMMIT", False),
    ],
)
def test_sql_gate(sql, good):
    assert (not semantic.check_sql(sql)) == good


def test_keyed_writes(spark):
    old = spark.createDataFrame([("a", "1", "2024"), ("b", "1", "2024"), ("c", "1", None)], "id string, version string, updated_at string")
    new = spark.createDataFrame([("b", "2", "2024"), ("a", "0", "2023"), ("d", "1", None)], "id string, version string, updated_at string")
    versions = lambda df: {r.id: r.version for r in df.collect()}
    assert versions(tables.import_latest(old, new)) == {"a": "1", "b": "2", "c": "1", "d": "1"}
    assert versions(tables.upsert(old, new)) == {"a": "0", "b": "2", "c": "1", "d": "1"}
    assert versions(tables.import_missing(old, new)) == {"a": "1", "b": "1", "c": "1", "d": "1"}
    assert versions(tables.delete(old, new)) == {"c": "1"}
    changes = spark.createDataFrame([("a", "1"), ("b", "9"), ("z", None)], "id string, expected string")
    assert {r.id: r.applied for r in tables.compare_and_swap(old, changes).collect()} == {"a": True, "b": False, "z": True}


def test_sources(spark, tmp_path):
    (tmp_path / "docs" / "node_modules").mkdir(parents=True)
    (tmp_path / "docs" / "a.md").write_text("# é")
    (tmp_path / "docs" / "node_modules" / "b.md").write_text("no")
    assert [r.text for r in tables.markdown_files(spark, str(tmp_path / "docs")).collect()] == ["# é"]
    (tmp_path / "ns").mkdir()
    (tmp_path / "ns" / "1.json").write_text('{\n"id": "1", "n": 2}')
    assert tables.json_documents(spark, str(tmp_path / "ns"), "id string, n double").collect() == [("1", 2.0)]
    for version in (1, 2):
        tables.snapshot(spark.range(version), str(tmp_path / "snap"), version)
    assert tables.published(spark, str(tmp_path / "snap")).count() == 2


def test_fusion(spark):
    lanes = [spark.createDataFrame([(lane, rank, 0.5, "x")], "retriever string, rank int, score double, id string") for lane, rank in (("a", 1), ("b", 2))]
    row = retrieval.fuse(lanes).first()
    assert row.id == "x" and row.fusion == round(1 / 61 + 1 / 62, 9) and row.retrievers == "a,b"


def test_graph(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "src string, dst string")
    near = {r.id: r.distance for r in graph.neighbours(edges, spark.createDataFrame([("a",)], "id string"), 2).collect()}
    assert near == {"a": 0, "b": 1, "c": 1, "d": 2}
    assert [r.path for r in graph.paths(edges, "a", "d", 3).collect()] == [["a", "c", "d"], ["a", "b", "c", "d"]]


def test_pricing_roi_and_staleness(spark):
    row = spark.createDataFrame([(1_000_000, 200_000, 500_000, 2.0, 0.5, 8.0), (-1, 0, 0, 2.0, 0.5, 8.0), (1, 0, 0, None, 0.5, 8.0)], "i long, c long, o long, rate_in double, rate_cached double, rate_out double")
    assert [r[0] for r in row.select(observe.price(F.col("i"), F.col("c"), F.col("o"))).collect()] == [5.7, 0.0, 0.0]
    base = spark.createDataFrame([("w", 60.0, 120.0)], "workflow_id string, manual_minutes double, hourly_rate double")
    out = spark.createDataFrame([("w", 10, 5, 5, 20.0), ("no", 1, 1, 1, 1.0)], "workflow_id string, active_minutes int, review_minutes int, rework_minutes int, additional_value double")
    assert observe.roi(base, out).collect() == [("w", 1, 0.666667, 100.0)]
    at = dt.datetime(2025, 1, 1)
    rows = spark.createDataFrame([("a", None, at, 60), ("b", None, at, 61), ("c", None, at, None), ("d", "unknown", None, 5), ("e", "stale", at, None)], "id string, state string, read timestamp_ntz, sla long")
    got = {r.id: r.s for r in rows.select("id", observe.staleness("state", "read", "sla", F.lit("2025-01-01 00:01:00").cast("timestamp")).alias("s")).collect()}
    assert got == {"a": "stale", "b": "fresh", "c": "fresh", "d": "unknown", "e": "stale"}


def test_ir_metrics(spark):
    ranking = spark.createDataFrame([("q", 1, "p1"), ("q", 2, "noise"), ("q", 3, "p2"), ("none", 1, "x")], "case_id string, rank int, id string")
    judged = spark.createDataFrame([("q", "p1", 3), ("q", "p2", 1), ("none", "x", 0)], "case_id string, id string, relevance int")
    got = {r.case_id: r for r in observe.ir_metrics(ranking, judged, 3).collect()}
    assert (got["q"].recall, got["q"].precision, got["q"].mrr, got["q"].ndcg) == (1.0, 0.666667, 1.0, round(7.5 / (7 + 1 / math.log2(3)), 6))
    assert got["none"].recall == 1.0 and got["none"].mrr == 0.0


def test_text(spark):
    row = spark.createDataFrame([("Bearer abcdefghijklmnop https://u:pw@h x", "", "a" * 4001)], "a string, b string, c string")
    got = row.select(text.redacted(F.col("a")), text.chunk_list(F.col("b")), F.size(text.chunk_list(F.col("c"))), text.script(F.lit("Привет")), text.token_estimate(F.col("b"))).first()
    assert tuple(got) == ("Bearer [REDACTED] https://u:[REDACTED]@h x", [""], 3, "Cyrillic", 1)


def test_stream_equals_batch(spark, sf):
    stream = events.event_stream(spark, sf)
    got = events.drained(events.window_counts(stream), "window_counts").collect()
    want = queries.QUERIES["stream_window_counts"](spark, sf).collect()
    assert {(r.event_type, r.n, r.total) for r in got} == {(r.event_type, r.n, r.total) for r in want} and len(got) == len(want)


def test_every_query_runs(spark, sf):
    for name, query in queries.QUERIES.items():
        assert query(spark, sf).columns, name
