"""Knowledge, narrowing, skills, reconciling, citations and censuses on hand-computed rows."""

import datetime as dt
import hashlib
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from evidentia.operators import census, citations, knowledge, narrowing, reconcile, skills

ENTRIES = [
    (1, ["Ada Lovelace"], "# Engine notes\nengine engine\n#### engine"), (2, ["Charles"], "## engine\nx"), (3, None, None), (4, ["Babbage Engine"], "#engine\n### The ENGINE\r\nengineengine"), (5, [], "nothing"),
]


def entries(spark, rows=ENTRIES):
    return spark.createDataFrame(rows, "id long, entities array<string>, content string").withColumn("score", F.lit("x")).withColumn("rank", F.lit("y"))


def test_knowledge_scores_and_steps(spark):
    got = {r.id: (r.named, r.score) for r in knowledge.scored(entries(spark), ["engine"]).collect()}
    assert got == {1: (False, 20 + 2 + 1), 2: (False, 10), 3: (False, 0), 4: (True, 1 + 5 + 2), 5: (False, 0)}
    step = lambda terms, scores=None, rows=ENTRIES: [(r.id, r.step) for r in knowledge.search(entries(spark, rows), terms, scores).orderBy("rank").collect()]
    assert step(["ada-lovelace"]) == [(1, "entity")] and step(["engine"]) == [(4, "entity")] and step([]) == [] and step(["absent"]) == []
    unnamed = [(i, None, c) for i, _, c in ENTRIES]
    assert step(["engine"], rows=unnamed) == [(1, "content")]  # 23 is twice 10
    close = [*unnamed, (6, None, "# engine\n")]
    assert step(["engine"], rows=close) == [(1, "fallback")]
    scores = spark.createDataFrame([(2, 0.9), (6, 0.5), (1, 0.1), (5, 9.0)], "id long, score double")
    assert step(["engine"], scores, close) == [(2, "rerank")]  # 0.9 of 1.5; an entry without a score of its own has no part


def test_running_totals_over_ranges(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.randrange(50), k, rng.choice([None, 1, 5, -2])) for k in range(500)]
    df = spark.createDataFrame(rows, "g string, t int, id int, v int").repartition(7).withColumn("_own", F.lit(1))
    want, sums = {}, {}
    for g, t, i, v in sorted(rows, key=lambda r: (r[0] or "", r[1], r[2])):
        sums[g] = sums.get(g, 0) + (v or 0)
        want[i] = sums[g]
    got = narrowing.running_totals(df, ["g"], [F.col("t"), F.col("id")], F.col("v"))
    assert {r.id: r.upto for r in got.collect()} == want and got.columns == [*df.columns, "upto"]
    assert narrowing.running_totals(df.where("false"), [], [F.col("id")], F.lit(1)).count() == 0
    kept = narrowing.within(df, [F.col("id")], F.lit(2), 41)
    assert sorted(r.id for r in kept.collect()) == list(range(20))


def test_grep_versions(spark):
    rows = [(f"v{k % 3}", k, f"Text {k} with A match" if k % 2 else "none", ["a"] if k % 5 else ["b"]) for k in range(60)] + [("v0", 99, None, ["a"])]
    df = spark.createDataFrame(rows, "version string, ordinal int, text string, acl_tokens array<string>")
    hits = narrowing.grep_versions(df, ["v0", "v2"], "a MATCH", 5, ["a"]).collect()
    want = sorted((v, k) for v, k, t, acl in rows if v in ("v0", "v2") and t and k % 2 and "a" in acl)[:5]
    assert [(r.version, r.ordinal) for r in hits] == want and [r["rank"] for r in hits] == [1, 2, 3, 4, 5]
    assert len(narrowing.grep_versions(df, ["v1"], "match", 100, None, 50).collect()) == 50 // len("Text 1 with A match")
    for versions, pattern in (([], "a"), ([str(k) for k in range(51)], "a"), (["v0"], "(a+)+"), (["v0"], ""), (["v0"], "(")):
        with pytest.raises(ValueError):
            narrowing.grep_versions(df, versions, pattern)


def test_skill_routes(spark):
    day = dt.datetime(2024, 1, 1)
    facts = [(k, day + dt.timedelta(hours=k % 7), None, None) for k in range(13)] + [(90, day, "old", None), (91, day, None, day + dt.timedelta(days=9)), (92, day, None, day), (93, day, None, None), (94, day, None, None)]
    scores = [(k, s, 0.9) for k in range(13) for s in ("b", "a")] + [(92, "z", 0.5), (93, "z", 0.1), (93, None, 1.0), (90, "a", 1.0)]
    df = spark.createDataFrame(facts, "id long, created_at timestamp_ntz, skill string, ignore_until timestamp_ntz")
    got = {r.id: r for r in skills.routed(df, spark.createDataFrame(scores, "fact_id long, skill string, score double"), F.lit("2024-01-05").cast("timestamp_ntz"), 3600).collect()}
    assert set(got) == {*range(13), 92, 93, 94}
    order = sorted(range(13), key=lambda k: (k % 7, k))
    assert [got[k].cluster for k in order] == [n // 5 for n in range(13)] and {got[k].skill for k in order} == {"a"}
    assert (got[92].decision, got[92].skill, got[92].ignore_until) == ("weak", None, dt.datetime(2024, 1, 5, 1))
    assert got[93].decision == got[94].decision == "none" and got[93].skill == got[94].skill == skills.NO_SKILL


def test_reconcile_waits_for_scans(spark):
    known = spark.createDataFrame([(r, p, "1") for r in "abcd" for p in ("x", "y", "z")] + [("a", None, "1"), ("a", "x", "0")], "root string, path string, fingerprint string")
    seen = spark.createDataFrame([(r, p, f) for r in "abce" for p, f in (("x", "1"), ("y", "2"), ("new", "1"))], "root string, path string, fingerprint string")
    scans = spark.createDataFrame([("a", True, True), ("b", True, False), ("c", False, True), ("e", True, True), ("e", True, None)], "root string, available boolean, complete boolean")
    got = {(r.root, r.path): r.action for r in reconcile.actions(known, seen, scans).collect()}
    for root, gone in (("a", "delete"), ("b", "hold"), ("c", "hold")):
        assert {p: got[root, p] for p in ("x", "y", "z", "new")} == {"x": "keep", "y": "update", "z": gone, "new": "add"}
    assert {got["d", p] for p in "xyz"} == {"hold"} and got["e", "x"] == "add" and len(got) == 3 * 4 + 3 + 3
    after = {(r.root, r.path): r.fingerprint for r in reconcile.applied(known, seen, scans).collect()}
    assert ("a", "z") not in after and after["b", "z"] == "1" and after["a", "y"] == "2" and len(after) == len(got) - 1


def test_deep_citations(spark):
    deep = {"sourceId": "d0", "citation": 1}
    for k in range(12):
        deep = {"in": [deep]} if k % 2 else {"sourceId": f"l{k}", "versionId": None, "x": deep}
    values = [
        json.dumps([{"sourceId": "a", "citation": None}, {"sourceId": "a", "versionId": 2}, {"sourceId": "no"}, {"sourceId": 5, "citation": "c"}, {"b": {"sourceId": "c", "citationText": "t"}}]),
        json.dumps(deep), "not json", None, "3", json.dumps([{"sourceId": f"s{k:03}", "citation": ""} for k in range(150)]), '"sourceId"',
    ]
    df = spark.createDataFrame(list(enumerate(values)) + [(None, values[0])], "id long, j string").withColumn("value", F.lit("x")).withColumn("pos", F.lit("y"))
    got = {r.id: r for r in citations.cited(df, "j").collect()}
    assert got[0].sources == ["a", "c"] and got[2].n == got[3].n == got[4].n == got[6].n == 0 and None not in got
    assert got[5].n == 150 and got[5].sources == [f"s{k:03}" for k in range(100)]

    def walk(v, depth, out):
        if depth > citations.DEPTH:
            return out
        if isinstance(v, dict):
            if isinstance(v.get("sourceId"), str) and {"citation", "citationText", "versionId"} & v.keys():
                out.add(v["sourceId"])
            v = list(v.values())
        if isinstance(v, list):
            for x in v:
                walk(x, depth + 1, out)
        return out

    assert got[1].sources == sorted(walk(json.loads(values[1]), 0, set())) and "d0" not in got[1].sources


def test_census_united_is_one_pass(spark):
    rng = random.Random(8)
    now = dt.datetime(2024, 6, 1)
    names = ["a/archive/x", "OLD/y", "b/signed/z", "c/d", "archived"]
    rows = []
    for k in range(3000):
        text = f"t{rng.randrange(1500)}"
        sha = hashlib.sha256(text.encode()).hexdigest()
        rows.append((f"{names[k % 5]}/{k}", rng.choice([None, 0, 1, 10**6, 5 * 10**7, 3 * 10**8, 3 * 10**9, rng.randrange(10**6)]), now - dt.timedelta(days=rng.choice([0, 7, 8, 30, 31, 90, 91, 365, 366, -3])), now, sha, sha[:15] + rng.choice("01")))
    df = spark.createDataFrame(rows, "path string, size long, modified_at timestamp_ntz, scanned_at timestamp_ntz, content_sha256 string, similarity string")
    part = F.pmod(F.hash("path"), F.lit(3))
    whole, merged = census.sketched(df), census.united([census.sketched(df.where(part == k)) for k in range(3)])
    rows_of = lambda d: sorted((r.kind, r.key or "", r.n or 0, r.path or "") for r in d.collect())
    assert rows_of(whole) == rows_of(merged)
    one = census.summary(merged).first()
    sizes = sorted(r[1] for r in rows if r[1] is not None)
    bins = sorted(min(1023, math.floor(math.log2(s + 1) * 32)) for s in sizes)
    assert one.files == 3000 and one.bytes == sum(sizes) and one.largest == sizes[-1]
    for name, share in census.SHARES.items():
        assert one[name] == round(2 ** ((bins[max(1, math.ceil(len(bins) * share)) - 1] + 0.5) / 32) - 1)
    distinct = len({r[4] for r in rows})
    assert abs(one.exact_rate - (1 - distinct / 3000)) < 0.02 and one.near_rate >= one.exact_rate
    kinds = {(r.kind, r.key): r.n for r in merged.where("kind in ('class', 'age', 'size')").collect()}
    assert kinds["class", "archive"] == 1800 and kinds["class", "authority"] == kinds["class", "current"] == 600 and sum(n for (k, _), n in kinds.items() if k == "age") == 3000
    assert census.summary(census.sketched(df.where("false"))).first().files == 0


def test_citations_shuffle_a_value_once(spark):
    """Every value inside a value was a row of its own, beside what it lay in, at every level anew."""
    words = [{"inner": [{"sourceId": f"w{k % 40}", "versionId": 1}]} for k in range(3000)]
    df = spark.createDataFrame([(i, json.dumps({"items": words})) for i in range(6)] + [(0, '{"sourceId": "x", "citation": null}')], "id long, j string")
    found = citations.cited(df, "j")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Union" not in plan and "Join" not in plan
    assert {r.id: r.n for r in found.collect()} == {0: 41} | {i: 40 for i in range(1, 6)}
