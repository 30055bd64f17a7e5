"""Indexes over vectors and postings against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidentia.operators import postings, retrieval, vectors


def nearest(table, queries, k):
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v in table.items()}
    found = set()
    for q, v in queries.items():
        scored = sorted((-round(float(unit[i] @ (np.array(v) / np.linalg.norm(v))), 6), i) for i in unit)
        found |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k]) if s < 0}
    return found


def test_vector_index_exact_and_probed(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 16))
    table = {i: (centres[i % 12] + 0.4 * rng.normal(size=16)).tolist() for i in range(600)}
    table |= {600 + i: table[0] for i in range(40)}  # copies
    rows = [(i, v) for i, v in table.items()] + [(900, [0.0] * 16), (901, [1.0] * 3), (902, None), (903, [None] + [1.0] * 15), (None, table[1])]
    df = spark.createDataFrame(rows, "id long, embedding array<double>").withColumn("cell", F.lit("x")).withColumn("unit", F.lit("y"))
    queries = {i: table[i] for i in range(0, 640, 16)}
    asked = spark.createDataFrame([*queries.items(), (950, [1.0, 2.0]), (951, [0.0] * 16)], "id long, embedding array<double>")
    index = vectors.build(df.where("id is not null"), 16)
    got = {(r.query, r.rank, r.id, r.score) for r in vectors.search(index, asked, 10, index.cells, 0).collect()}
    want = nearest(table, queries, 10)
    assert {x[:2] for x in got} == {x[:2] for x in want} and all(any(abs(a[3] - b[3]) < 2e-6 for b in want if b[:2] == a[:2]) for a in got)
    truth = vectors.search(index, asked, 10, index.cells, 0)
    fast = vectors.tuned(index, asked)
    assert fast.probes < index.cells and vectors.recall(vectors.search(fast, asked, 10), truth) >= 0.9
    assert vectors.recall(vectors.search(index, asked, 10, 1), truth) <= vectors.recall(vectors.search(index, asked, 10, index.cells), truth)


def test_vector_index_recall_on_the_given_table(spark):
    e = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    index = vectors.tuned(vectors.build(e, 64, id_column="vec_id"), e.where("vec_id % 50 = 0"), id_column="vec_id")
    every = e.where("vec_id % 7 = 3")
    truth = vectors.search(index, every, 10, index.cells, 0, id_column="vec_id")
    assert vectors.recall(vectors.search(index, every, 10, id_column="vec_id"), truth) >= 0.9


def test_vector_index_of_nothing(spark):
    none = spark.createDataFrame([], "id long, embedding array<float>")
    index = vectors.build(none, 4)
    assert vectors.search(index, spark.createDataFrame([(1, [1.0, 0.0, 0.0, 0.0])], "id long, embedding array<float>"), 3).count() == 0


def spoken(seed, n):
    rng = random.Random(seed)
    words = ["contract", "Termination", "über", "x-1", "of", "the", "payment", "é"]
    return [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(30))) if i % 9 else None, rng.choice(["the contract", "", "Über"])) for i in range(n)]


@pytest.mark.parametrize("query", ["the contract of the", "über", "absent", ""])
def test_postings_equal_the_scan(spark, query):
    df = spark.createDataFrame(spoken(2, 120), "id long, text string, title string").withColumn("term", F.lit("z")).withColumn("n", F.lit(0))
    index = postings.build(df, {"text": "B"})
    scan = [tuple(r) for r in retrieval.lexical(df, query, 50).collect()] if query else []
    assert [tuple(r) for r in postings.lexical(index, query, 50).collect()] == scan
    asked = spark.createDataFrame([(1, query), (2, "of x-1"), (3, None)], "query long, text string")
    many = postings.lexical_many(index, asked, 50).collect()
    assert sorted((r["rank"], r.score, r.id) for r in many if r.query == 1) == sorted((r["rank"], r.score, r.id) for r in postings.lexical(index, query, 50).collect())


def test_posting_weights_follow_fields(spark):
    rows = spoken(5, 80)
    df = spark.createDataFrame(rows, "id long, text string, title string")
    index = postings.build(df, {"title": "A", "text": "B"})
    terms = {"the", "payment"}
    want = {}
    for i, text, title in rows:
        a, b = ((t or "").lower().split() for t in (title, text))
        mass = (sum(w in terms for w in a) + 0.4 * sum(w in terms for w in b)) / math.sqrt(len(a) + len(b)) if a or b else 0
        if mass:
            want[i] = round(mass / (mass + 1), 9)
    got = {r.id: r.score for r in postings.weighted(index, "payment the", 200).collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 2e-9 for i in want)
    both = {i for i, text, title in rows if terms <= set(f"{text or ''} {title}".lower().split())}
    assert {r.id for r in postings.weighted(index, "payment the", 200, require_all=True).collect()} == both


def test_a_lookup_reads_its_buckets_alone(spark):
    index = postings.build(spark.createDataFrame(spoken(7, 60), "id long, text string, title string"), {"text": "B"})
    plan = postings.matching(index, ["contract"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [(bucket" in plan or "bucket" in plan.split("PartitionFilters")[1][:60]
    assert "PushedFilters" in plan and "contract" in plan.split("PushedFilters")[1][:120]


def shuffled(spark, run):
    """Records that what run() starts writes to shuffles."""
    sc, none = spark.sparkContext, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)

    def total():
        sc._jsc.sc().listenerBus().waitUntilEmpty()
        stages = sc._jsc.sc().statusStore().stageList(None, False, False, none, None)
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = total()
    run()
    return total() - before


def test_postings_are_shuffled_once(spark):
    df = spark.createDataFrame([(i, " ".join(f"w{(i * 7 + k) % 300}" for k in range(40)) + " of of") for i in range(400)], "id long, text string")
    assert shuffled(spark, lambda: postings.build(df, {"text": "B"})) <= 1.1 * 400 * 41


def test_questions_that_share_terms_do_not_multiply_postings(spark):
    """Every document met every question that has one of its words as a row of its own."""
    df = spark.createDataFrame([(i, f"the contract of w{i % 50} of the"[: 30 - i % 7]) for i in range(300)], "id long, text string")
    index = postings.build(df, {"text": "B"})
    asked = spark.createDataFrame([(q, f"the contract of w{q % 60}") for q in range(200)] + [(7, "the contract of w7")], "query long, text string")
    found = []
    assert shuffled(spark, lambda: found.extend(postings.lexical_many(index, asked, 3).collect())) < 10_000
    for q in (3, 58):
        lane = postings.lexical(index, f"the contract of w{q}", 3).collect()
        assert sorted((r["rank"], r.score, r.id) for r in found if r["query"] == q) == sorted((r["rank"], r.score, r.id) for r in lane)
    assert len(found) == 600


def test_questions_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(postings, "QUESTIONS", 3)
    monkeypatch.setattr(postings, "POSTINGS", 50)
    monkeypatch.setattr(postings, "DENSE", 20)
    df = spark.createDataFrame(spoken(4, 100), "id long, text string, title string").selectExpr("concat('d', id) id", "text")
    index = postings.build(df, {"text": "B"})
    texts = ["the contract", "über é", "x-1 of", "payment", "termination the of", "é", "none", ""]
    found = postings.lexical_many(index, spark.createDataFrame(list(enumerate(texts)), "query long, text string"), 12).collect()
    for q, text in enumerate(texts):
        assert sorted((r["rank"], r.score, r.id) for r in found if r["query"] == q) == sorted((r["rank"], r.score, r.id) for r in postings.lexical(index, text, 12).collect())


def test_an_index_has_about_as_many_files_as_cells_and_scores_by_blocks(spark):
    rng = np.random.default_rng(5)
    table = {i: rng.normal(size=8).tolist() for i in range(400)} | {400 + i: [1.0] * 8 for i in range(60)}
    df = spark.createDataFrame(list(table.items()), "id long, embedding array<double>").repartition(6)
    index = vectors.build(df, 8)
    assert len(index.rows.inputFiles()) <= index.cells + 6 and index.rows.count() == 460
    queries = {i: table[i] for i in (3, 77, 401)}
    found = vectors.search(index, spark.createDataFrame(list(queries.items()), "id long, embedding array<double>"), 5, index.cells, 0)
    assert "zip_with(unit" not in found._jdf.queryExecution().analyzed().toString()  # a row for each pair, each product in the interpreter
    assert [(r["query"], r["rank"], r.id) for r in found.orderBy("query", "rank").collect()] == sorted(x[:3] for x in nearest(table, queries, 5))


def test_lanes_of_one_reading_equal_those_of_their_own(spark, sf):
    from evidentia.queries_search import query  # noqa: F401  (adds its queries)
    from evidentia.queries import QUERIES

    df = spark.createDataFrame(spoken(8, 150), "id long, text string, title string")
    asked = {"a": "the contract", "b": "payment of über"}
    tallies = retrieval.tallied(df.select("id", "text", "title"), asked, ["the c", "ATION "])
    for name, q in asked.items():
        assert retrieval.tally_lane(tallies, name, q, 40).collect() == retrieval.lexical(df, q, 40).collect()
    assert retrieval.reference_lane(tallies, 40).collect() == retrieval.exact(df, ["the c", "ATION "], 40).collect()
    # the eight variants read no text but in that one pass
    found = QUERIES["retrieval_variants"](spark, sf)
    assert "documents.parquet" not in found._jdf.queryExecution().executedPlan().toString()
    assert "text" not in tallies.columns
