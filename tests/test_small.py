"""Small operators in full, on hand-computed rows."""

import hashlib

from pyspark.sql import functions as F

from evidentia.functions import entities as ent
from evidentia.operators import corpus, govern
from evidentia.sources import tables


def test_deletes_by_version(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, version string")
    keys = spark.createDataFrame([(1, "a"), (2, "x"), (3, "z"), (4, None), (2, "x")], "id int, expected string")
    left, told = tables.delete_expected(old, keys)
    assert sorted(r.id for r in left.collect()) == [2, 3] and {(r.id, r.deleted) for r in told.collect()} == {(1, True), (2, False), (3, False), (4, False)}
    assert [r.id for r in tables.delete_expected(old, spark.createDataFrame([(3, None)], "id int, expected string"))[0].orderBy("id").collect()] == [1, 2]


def test_shadow_outcomes(spark):
    rows = [("b", "accepted"), ("b", "rejected"), ("a", "mixed"), ("a", None), ("c", "what")]
    got = [tuple(r) for r in govern.shadow_summary(spark.createDataFrame(rows, "workflow_id string, outcome string")).orderBy("place").collect()]
    assert got == [(0, None, 5, 1, 1, 1, 2, 0.2), (1, "a", 2, 0, 0, 1, 1, 0.0), (2, "b", 2, 1, 1, 0, 0, 0.5), (3, "c", 1, 0, 0, 0, 1, 0.0)]
    found = spark.createDataFrame([("s", "stale", "warning"), ("z", "down", "critical"), ("a", "down", "critical")], "source_id string, issue string, severity string")
    assert [r.source_id for r in govern.findings_in_order(found).collect()] == ["a", "z", "s"]


def test_intervals(spark):
    df = spark.createDataFrame([("10s",), ("9s",), ("1.5h",), (" 2d ",), ("1w",), (None,), ("90m",), ("10001ms",)], "t string")
    got = [(r.ms, r.d) for r in df.select(ent.interval_ms(F.col("t")).alias("ms")).withColumn("d", ent.duration_text(F.col("ms"))).collect()]
    assert got == [(10_000, "10s"), (None, None), (5_400_000, "90m"), (172_800_000, "2d"), (None, None), (None, None), (5_400_000, "90m"), (10_001, "10001ms")]


def test_forecasts_and_profiles(spark):
    files = spark.createDataFrame([(10, 30_000, 0), (30 << 20, 5, 3), (300 << 20, 99, 1), (None, None, None)], "size long, passages long, sections long")
    one = corpus.forecast(files, 2).first()
    assert (one.document_vectors, one.section_vectors, one.passage_vectors) == (4, 6, 20_005) and one.vector_bytes == 20_015 * 8 and one.hnsw_bytes == 20_015 * 12
    assert corpus.forecast(files.where("false")).first().object_bytes == 0
    rows = [("c", f"{k:03}", f"t{k:03}", "s" * 400) for k in range(60)] + [("d", "x", None, None)]
    got = {r.collection: r for r in corpus.collection_profile(spark.createDataFrame(rows, "collection string, content_sha256 string, title string, routing_summary string")).collect()}
    assert got["c"].fingerprint == hashlib.md5("".join(f"{k:03}" for k in range(60)).encode()).hexdigest() and len(got["c"].summary) == 12_000 and got["c"].n == 60
    assert got["d"].summary == ": "
    shares = spark.createDataFrame([("a", "fr", 0.5), ("a", "en", 0.5), ("b", "de", 1.0)], "by string, language string, share double")
    assert sorted(map(tuple, corpus.main_language(shares, "by").collect())) == [("a", "en", 0.5), ("b", "de", 1.0)]


def test_a_lifetime_ends_to_the_microsecond(spark, tmp_path):
    from evidentia.queries import QUERIES

    times = ["2024-01-21 23:59:59.999999", "2024-01-22 00:00:00", "2024-01-22 00:00:00.000001", "2024-01-22 00:00:00.5", "2024-01-22 00:00:01", None]
    spark.createDataFrame(list(enumerate(times)), "event_id long, t string").selectExpr("event_id", "cast(t as timestamp_ntz) ts").write.parquet(str(tmp_path / "events.parquet"))
    assert sorted(r[0] for r in QUERIES["ttl_prune"](spark, str(tmp_path)).collect()) == [2, 3, 4]
    rows = spark.read.parquet(str(tmp_path / "events.parquet"))
    assert sorted(r[0] for r in corpus.kept(rows, "ts", F.lit("2024-02-01").cast("timestamp"), 864_000).select("event_id").collect()) == [2, 3, 4, 5]
