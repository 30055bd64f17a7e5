"""What becomes of ranked hits, on hand-computed rows."""

import hashlib
import math

from pyspark.sql import functions as F

from evidentia.operators import evidence


def test_diversity_takes_hits_in_order(spark):
    long = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron"
    texts = [(1, 1, "d1", "s1", long), (2, 2, "d1", "s1", long), (3, 3, "d2", None, long.upper() + "!"), (4, 4, "d2", None, None)]
    texts += [(i, i, "d3", "s3", f"short {i}") for i in range(5, 11)] + [(11, 11, "d4", None, "one more"), (12, 12, "d5", None, "and one")]
    df = spark.createDataFrame([(1, *t) for t in texts], "query_id int, id int, rank int, document_id string, section_id string, text string")
    got = {r.id: r.exclusion for r in evidence.diversified(df, 7).collect()}
    assert [i for i, why in got.items() if why is None] == [1, 4, 5, 6, 7, 8, 11]
    assert got[2] == "duplicate content hash" and got[3] == "near-duplicate passage"
    assert got[9] == got[10] == "maximum passages per section" and got[12] == "evidence budget reached"
    assert evidence.diversified(df.limit(0), 7).count() == 0


def test_diversity_document_cap(spark):
    df = spark.createDataFrame([(1, i, i, "d", f"s{i // 3}", f"t{i}") for i in range(10)], "query_id int, id int, rank int, document_id string, section_id string, text string")
    got = [r.exclusion for r in evidence.diversified(df, 25).orderBy("rank").collect()]
    assert got == [None] * 8 + ["maximum passages per document"] * 2


def test_answerability(spark):
    questions = spark.createDataFrame([(1, "lookup"), (2, "comparison"), (3, "exact_reference"), (4, "lookup"), (5, "comparison"), (6, "lookup")], "query_id int, intent string")
    rows = [(1, 1, "a", "s", False, "It must."), (2, 1, "a", "s", False, "x"), (2, 2, "a", "s", False, None), (3, 1, "a", "s", False, "x"), (5, 1, "a", "s", False, "x"), (5, 2, "a", None, False, "x")]
    rows += [(6, 1, "a", "s", False, "It must be so."), (6, 2, "b", "s", False, "That is prohibited")]
    found = spark.createDataFrame(rows, "query_id int, rank int, document_id string, section_id string, exact boolean, text string")
    got = {r.query_id: (r.status, r.score, r.abstained) for r in evidence.answerability(questions, found.select("*", *evidence.polarity(F.col("text")))).collect()}
    assert got[1] == ("sufficient", 0.8, False) and got[2] == ("insufficient", 0.49, True) and got[3] == ("insufficient", 0.49, True)
    assert got[4] == ("insufficient", 0.0, True) and got[5] == ("sufficient", 0.85, False) and got[6] == ("conflicting", 0.65, False)


def test_facts_are_recalled_by_stems(spark):
    rows = [(1, "My server is Helios.", "2024"), (2, "user server is HELIOS", "2025"), (3, "The łódź trip was wspólny", "2023"), (4, None, None)]
    facts = spark.createDataFrame(rows, "id int, fact string, created_at string")
    got = evidence.recalled(facts, "which server is my helios").collect()
    assert [(r.id, r.score) for r in got] == [(2, 1.0)]
    assert [r.id for r in evidence.recalled(facts, "wspolny").collect()] == [3]
    assert evidence.recalled(facts, "nothing known").count() == 0 and evidence.recalled(facts, "").count() == 0


def test_merge_lookup_and_files(spark):
    entries = spark.createDataFrame([("mem0", "u", "x", None, 1), ("mem0", "u", "x", 0.5, 2), ("file-index", "u", "x", 0.9, 3), ("web", "u", "y", 2.5, 4)], "type string, uuid string, content string, confidence double, ordinal int")
    assert [(r.ordinal, r.score) for r in evidence.merged(entries).collect()] == [(2, 2.5), (4, 2.5), (3, 1.9)]
    texts = spark.createDataFrame([(1, "ab AB ab", "p"), (2, "ab", "xab"), (3, "ab", "q"), (4, None, None), (5, "ab ab ab", "q")], "id int, content string, path string")
    assert sorted(r.id for r in evidence.looked_up(texts, ["Ab"]).collect()) == [1, 5]
    assert sorted(r.id for r in evidence.looked_up(texts, ["Ab"], 0.8).collect()) == [1, 2, 5]
    assert evidence.looked_up(texts, ["zz"]).count() == 0 and evidence.looked_up(texts, []).count() == 0
    assert [(r.id, r.score) for r in evidence.file_search(texts, "AB, q", 2).collect()] == [(2, 5), (3, 5)]


def test_federation_and_rerank(spark):
    one = spark.createDataFrame([("w", "s", "a", 1), ("w", "s", "b", 2)], "workspace_id string, source_id string, id string, rank int")
    two = spark.createDataFrame([("w", "s", "b", 1), ("w", "t", "a", 2)], one.schema)
    assert [(r.source_id, r.id, r.score) for r in evidence.federated([one, two]).collect()] == [("s", "b", round(1 / 61 + 1 / 62, 9)), ("s", "a", round(1 / 61, 9)), ("t", "a", round(1 / 62, 9))]
    hits = spark.createDataFrame([(i, i) for i in range(1, 5)], "id int, rank int")
    scores = spark.createDataFrame([(3, 0.9), (4, 1.0)], "id int, score double")
    assert [r.id for r in evidence.reranked(hits, scores, 3).orderBy("new_rank").collect()] == [3, 1, 2, 4]


def test_vectors_and_fingerprints(spark):
    df = spark.createDataFrame([(1, "Cat cat DOG"), (2, None), (3, "!")], "id int, text string")
    bucket = {w: int(hashlib.sha1(w.encode()).hexdigest()[:8], 16) % 384 for w in ("cat", "dog")}
    got = {(r.id, r.bucket): r.weight for r in evidence.hash_vectors(df).collect()}
    assert got == {(1, bucket["cat"]): round(2 / math.sqrt(5), 9), (1, bucket["dog"]): round(1 / math.sqrt(5), 9)}
    prints = {r.id: r.fingerprint for r in evidence.fingerprints(df).collect()}
    assert prints == {1: hashlib.sha256(b"cat").hexdigest()[:16], 2: "f" * 16, 3: "f" * 16}


def test_suites(spark):
    df = spark.createDataFrame([(1, 1.0, 1.0, True, True), (1, 0.0, 3.0, False, False), (2, 0.5, 0.0, False, None)], "run_id int, score double, weight double, passed boolean, required boolean")
    got = {r.run_id: (r.score, r.pass_rate, r.passed) for r in evidence.suite_scores(df, 0.5).collect()}
    assert got == {1: (0.25, 0.5, True), 2: (0.0, 0.0, False)}
