"""Nested values, patterns, paths and the life of a corpus on hand-computed rows."""

import os

from pyspark.sql import functions as F

from evidentia.functions import values
from evidentia.operators import corpus


def test_patterns_that_are_not_searched_for():
    good = ("a+b", "(?:ab)+", r"\d{4}-\d{2}", "[a-z]+(x|y)", "a" * 256)
    bad = {"": "length", "a" * 257: "length", r"(a)\1": "reference back or look behind", "(?<=a)b": "reference back or look behind", "(a+)+": "repeat of a repeat", "((ab)*c)*": "repeat of a repeat", "(a": "syntax", "(?:a|b+)*": "repeat of a repeat"}
    assert all(values.pattern_fault(p) is None for p in good)
    assert {p: values.pattern_fault(p) for p in bad} == bad


def test_clean_and_schema():
    deep = "x"
    for _ in range(12):
        deep = [deep]
    got = values.clean({"Api-Key": [1], "a": {"t": "sk-abcdefghijklmnop u://me:pw@h"}, "l": list(range(200)), "d": deep, "s": "y" * 5000})
    assert got["Api-Key"] == "[REDACTED]" and got["a"]["t"] == "[REDACTED] u://me:[REDACTED]@h" and len(got["l"]) == 100 and "[TRUNCATED_DEPTH]" in str(got["d"]) and got["s"].endswith("…[TRUNCATED]")
    schema = {"type": "array", "items": {"type": "object", "properties": {"n": {"type": "number", "enum": [1, 2]}, "s": {"minLength": 2}}, "required": ["n"]}}
    assert values.schema_faults(schema, [{"n": 1, "s": "ab"}, {"s": "a"}, {"n": True}, {"n": 3}]) == [("$[1].n", "Required field is missing."), ("$[1].s", "Expected at least 2 character(s)."), ("$[2].n", "Expected number."), ("$[3].n", "Expected one of: 1, 2.")]
    assert values.schema_faults({"type": "integer"}, 2.0) == [] and values.schema_faults({"type": "integer"}, 2.5)


def test_value_columns_with_missing_rows(spark):
    df = spark.createDataFrame([('{"b": 1, "a": [true]}',), ("no json Bearer abcdefghijklmnop",), (None,)], "t string")
    got = df.select(values.canonical_sha256("t").alias("c"), values.redacted_json("t").alias("r"), values.fnv1a("t").alias("f"), values.checked(F.col("t"), {"type": "object"}).alias("k")).collect()
    assert got[0].c is not None and got[1].c is None and got[2] .c is None and got[0].r == '{"a":[true],"b":1}' and got[1].r == "no json Bearer [REDACTED]" and got[2].r is None
    assert got[0].k == [] and got[1].k[0].message == "Expected JSON." and got[2].f is None


def test_files_and_what_is_to_be_read(spark, tmp_path):
    for name, text in (("a.md", "x"), ("b.MD", "yy"), ("c.txt", "z"), ("sub/d.md", "w" * 50), ("node_modules/e.md", "x")):
        os.makedirs(os.path.dirname(tmp_path / name), exist_ok=True)
        (tmp_path / name).write_text(text)
    found = corpus.files(spark, str(tmp_path), ["md"], 10, ["**/node_modules/**"])
    assert sorted(r.path.rsplit("/", 1)[1] for r in found.collect()) == ["a.md", "b.MD"]
    known = found.withColumn("signature", F.lit("v1"))
    assert corpus.to_read(found, known, "v1").count() == 0 and corpus.to_read(found, known, "v2").count() == 2


def test_retired_rows_wait_for_their_grace_and_jobs(spark):
    rows = spark.createDataFrame([("a", "2024-01-01 00:00:00"), ("b", "2024-01-01 00:00:00"), ("a", "2024-01-01 02:00:00")], "context string, retired_at string")
    jobs = spark.createDataFrame([("b", "running"), ("a", "completed")], "context string, status string")
    got = corpus.collectable(rows, jobs, F.lit("2024-01-01 02:30:00").cast("timestamp"), 3600).collect()
    assert [(r.context, r.retired_at) for r in got] == [("a", "2024-01-01 00:00:00")]
    members = spark.createDataFrame([("x",), ("y",)], "id string")
    assert corpus.unseen(members, members.where("id = 'x'"), "id").collect() == [("y",)]
    generations = spark.createDataFrame([("c", "g1", "retired"), ("c", "g2", "active_full")], "context string, generation string, state string")
    rows = spark.createDataFrame([("c", "g1", 1), ("c", "g2", 2)], "context string, generation string, n int")
    assert [r.n for r in corpus.active(rows, generations).collect()] == [2] and [r.n for r in corpus.active(rows, generations, "g1").collect()] == [1]


def test_roots_and_order(spark, tmp_path):
    (tmp_path / "x").mkdir()
    assert corpus.usable_roots(spark, [str(tmp_path / "x"), str(tmp_path / "y")]) == ([str(tmp_path / "x")], [str(tmp_path / "y")])
    paths = spark.createDataFrame([("a/b/c",), ("z",), ("a/a",), ("b",)], "path string")
    assert [r.path for r in corpus.ordered(paths, 3).collect()] == ["b", "z", "a/a"]


def test_byte_ranges_stay_within_the_text(spark):
    df = spark.createDataFrame([("aé",), (None,)], "t string")
    got = df.select(corpus.byte_range(F.col("t"), 1, 3).alias("x"), corpus.byte_range(F.col("t"), 1, 4).alias("y"), corpus.byte_range(F.col("t"), 2, 1).alias("z"), corpus.byte_range(F.col("t"), 0, 3, 2).alias("w")).collect()
    assert bytes(got[0].x) == "é".encode() and got[0].y is None and got[0].z is None and got[0].w is None and got[1].x is None


def test_projections_are_applied_once(spark):
    schema = "target string, payload_sha256 string, status string, at int"
    log = spark.createDataFrame([("a", "p", "applied", 1), ("b", "p", "failed", 1)], schema)
    new = spark.createDataFrame([("a", "p", 2), ("b", "q", 2), ("c", "p", 2)], "target string, payload_sha256 string, at int")
    got = {r.target: (r.payload_sha256, r.status) for r in corpus.projected(log, new).collect()}
    assert got == {"a": ("p", "applied"), "b": ("q", "queued"), "c": ("p", "queued")}
