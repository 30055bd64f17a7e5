"""Question planning, Markdown, graph writes, scorers and measures on hand-computed rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from evidentia.operators import graph, markdown, observe, passages, planning, retrieval, scoring


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_question_plan(spark):
    q = frame(spark, [(1, "Compare  Acme Corp versus Beta Works"), (2, "Why did ABC-12 fail?"), (3, 'said "net price" type:Contract as of 2025-02-30'), (4, None), (5, "Summarize all documents on Blue River")], "id long, text string")
    got = {r.id: r for r in planning.planned(q).collect()}
    assert [got[k].intent for k in (1, 2, 3, 4, 5)] == ["comparison", "diagnostic", "as_of", "fact_lookup", "broad_synthesis"]
    assert [p.query for p in got[1].parts][:2] == ["Acme Corp", "Beta Works"] and len(got[1].parts) == 4
    assert [p.reason for p in got[2].parts] == ["diagnostic exact symptom", "diagnostic cause search", "diagnostic remediation search"]
    assert got[3].quoted == ["net price"] and got[3].filters.types == ["Contract"] and got[3].filters.as_of == "2025-02-30" and got[4].parts == []
    assert planning.planned(q.limit(0)).count() == 0 and len(planning.VARIANTS) == 8


def test_filters_as_questions_state_them(spark):
    asked = ['in force 2024-03-01 type: "Master Agreement" jurisdiction : PL', "TYPE:Überlassung type:'a b' type:x_y.z jurisdiction:", "12024-03-01", None]
    q = frame(spark, [(k, t) for k, t in enumerate(asked)], "id long, text string")
    got = {r.id: r.filters for r in planning.planned(q).collect()}
    assert (got[0].types, got[0].jurisdictions, got[0].as_of) == (["Master Agreement"], ["PL"], "2024-03-01")
    assert got[1].types == ["Überlassung", "a b", "x_y.z"] and got[1].jurisdictions == [] and got[2].as_of is None and got[3].types == []


def test_lexical_variants(spark):
    rows = frame(spark, [("termination notice",), ("Übergabe der Zahlung wypowiedzenie",), ("plain",), (None,)], "t string")
    got = [[tuple(v) for v in r.v] if r.v is not None else None for r in rows.select(planning.lexical_variants(F.col("t")).alias("v")).collect()]
    term = "controlled legal terminology expansion for "
    assert got[0] == [("pl", "termination notice wypowiedzenie rozwiązanie umowy", term + "termination"), ("de", "termination notice kündigung vertragsbeendigung", term + "termination")]
    assert got[1][0] == ("und", "Ubergabe der Zahlung wypowiedzenie", "diacritic-folded exact expansion") and [v[0] for v in got[1][1:]] == ["en", "de"]
    assert got[2] == got[3] == []
    three = rows.select(planning.translations(F.col("t")).alias("v")).collect()
    assert [len(r.v) for r in three] == [2, 3, 0, 0]


def test_standalone_questions(spark):
    long = "word " * 400
    turns = [
        (1, 1, "user", "What does the framework agreement with Acme say about the liability of both parties?"), (1, 2, "assistant", " It\nsays  this. "), (1, 3, "user", " and  payment? "), (1, 4, "assistant", "later"),
        (2, 1, "user", "Short one"), (3, 1, "assistant", "no question"), (4, 1, "user", None), (4, 2, "user", "What does Article nine of the Berlin contract require from every party today?"),
        (5, 1, "assistant", "a"), (5, 2, "user", "What does Article nine of the Berlin contract require from every party, and is it that?"),
        *[(6, k, "assistant", long) for k in range(8)], (6, 9, "user", "why"),
        (7, 1, "assistant", "a"), (7, 2, "user", "what kind of insurance must every single contractor in town hold today?"), (8, 1, "assistant", "a"), (8, 2, "user", "Which kinds of insurance must every single contractor in town hold today?"),
    ]
    got = {r.conv_id: r for r in planning.standalone(frame(spark, turns, "conv_id long, turn long, role string, text string").withColumn("context", F.lit("x"))).collect()}
    label = " Conversation context needed to resolve references: "
    assert got[1].query == "and payment?" + label + "user: What does the framework agreement with Acme say about the liability of both parties? assistant: It says this." and got[1].turns_used == 2
    assert got[2].method == got[4].method == got[8].method == "identity" and got[2].query == "Short one" and 3 not in got and got[4].turns_used == 0
    assert got[5].method == got[7].method == "deterministic" and got[5].query.endswith(label + "assistant: a")
    assert got[6].turns_used == 4 and got[6].query.startswith("why" + label) and len(got[6].query) <= 3 + len(label) + 2400


def test_variants_want_their_lanes_and_scores(spark):
    lane = lambda name, *ids: frame(spark, [(name, k + 1, 1.0, i) for k, i in enumerate(ids)], "retriever string, rank int, score double, id long")
    every = {k: lane(k, *ids) for k, ids in {"lexical": (1, 2), "exact": (2,), "dense": (3, 1), "translated": (4,)}.items()}
    names = {k: planning.VARIANTS[k] for k in ("lexical_only", "hybrid_reranked")}
    with pytest.raises(ValueError, match="scores"):
        retrieval.variants(every, names)
    with pytest.raises(ValueError, match="dense_scoped"):
        retrieval.variants(every, planning.VARIANTS, scores=every["dense"])
    scores = frame(spark, [(4, 0.9), (1, 0.2), (1, 0.1)], "id long, score double")
    got = retrieval.variants(every, names, scores=scores).orderBy("variant", "rank").collect()
    assert [(r.variant, r.id) for r in got] == [("hybrid_reranked", 4), ("hybrid_reranked", 1), ("hybrid_reranked", 2), ("hybrid_reranked", 3), ("lexical_only", 2), ("lexical_only", 1)]
    assert list(planning.VARIANTS) == ["flat_dense_baseline", "lexical_only", "dense_only", "hybrid_rrf", "hybrid_translated", "hybrid_reranked", "hierarchical", "hierarchical_lazy"]


MD = "---\ntype: Contract\nparties: [A, 'B']\nbook: Law\nvalid_from: 2024-01-01\nvalid_to: soon\n---\n# Top\nintro é\n\n```\n# no\n\n```\n## Sub\n| a |\n|---|\n"


def test_markdown_units_slice_back(spark):
    table = "".join(f"| row {k} |\n" for k in range(290))
    docs = frame(spark, [(1, MD + table), (2, ""), (3, None), (4, "a\r\nb\r\n\r\nArticle 5 Scope\r\n- x"), (5, "```\nopen")], "id long, text string")
    texts = {r.id: r.text for r in docs.collect()}
    units = markdown.units(docs).orderBy("id", "ordinal").collect()
    for u in units:
        assert texts[u.id].encode()[u.start_byte : u.end_byte].decode() == u.text
    kinds = lambda k: [u.type for u in units if u.id == k]
    assert kinds(1) == ["front_matter", "heading", "paragraph", "code", "heading", "table"] and kinds(2) == kinds(3) == [] and kinds(4) == ["paragraph", "heading", "list"] and kinds(5) == ["code"]
    assert [u.path for u in units if u.id == 1][-1] == ["Top", "Sub"] and [u.section for u in units if u.id == 4] == [0, 1, 1]
    got = markdown.passages(docs.where("id = 1"), target=80, hard=120).orderBy("section", "passage").collect()
    raw = texts[1].encode()
    assert all(raw[p.start_byte : p.end_byte].decode() == p.text for p in got) and "front" not in {p.type for p in got}
    cut = [p for p in got if p.type == "table"]
    assert len(cut) > 1 and all(p.lexical_text == "| a |\n|---|\n" + p.text for p in cut[1:]) and cut[0].lexical_text == cut[0].text
    front = docs.where("id = 1 or id = 4").select("id", markdown.front_matter(F.col("text")).alias("f")).collect()
    front = {r.id: r.f for r in front}
    assert front[4] is None and front[1].document_type == "Contract" and front[1].parties == ["A", "B"] and front[1].collection_id == "Law" and (front[1].valid_from, front[1].valid_to) == ("2024-01-01", None)


ENTITY = "id string, workspace_id string, type string, canonical_name string, aliases array<string>, identifiers map<string,string>, sensitivity string"


def test_graph_writes(spark):
    old = frame(spark, [("a", "w", "person", "Ann", ["x"], {"k": "1"}, None)], ENTITY)
    new = frame(spark, [("a", "w", "person", " Ann  B ", ["y ", "x", " "], {"k": "2", "l": "3"}, None, 1), ("b", "w", "person", "Bob", [], {}, "secret", 0)], ENTITY + ", seq long")
    got = {r.id: r for r in graph.upserted(old, new).collect()}
    assert got["a"].canonical_name == "Ann B" and got["a"].aliases == ["x", "y"] and got["a"].identifiers == {"k": "2", "l": "3"} and got["a"].sensitivity == "internal" and got["b"].sensitivity == "secret"
    said = [("w", "a", "Knows  of", "b", 7.0, "s"), ("w", "a", "knows of", "b", float("nan"), "s"), ("w", "a", "knows", "z", -1.0, "s"), ("v", "a", "knows", "b", None, "s")]
    rows = {(r.workspace_id, r.object): r for r in graph.asserted(frame(spark, said, "workspace_id string, subject string, predicate string, object string, confidence double, source_id string"), graph.upserted(old, new)).collect()}
    assert len(rows) == 3 and rows["w", "b"].confidence == 1.0 and rows["w", "b"].predicate == "knows_of" and rows["w", "z"].fault == "unknown object" and rows["v", "b"].fault == "entities of another workspace"
    ids = frame(spark, [(" New York ",), ("new york",)], "n string").select(graph.entity_id(F.lit("w"), F.lit("t"), F.col("n")).alias("i")).distinct()
    assert ids.count() == 1


def test_graph_ingestion_and_search(spark):
    rows = [("d1", "w", "file", "Plan", "http://x.example/p", "Ask ann@x.example about ABC-12."), ("d2", "w", "ticket", None, None, None)]
    entities, assertions, runs = graph.ingested(frame(spark, rows, "id string, workspace_id string, kind string, title string, uri string, text string"))
    counts = {r.source_id: (r.entity_count, r.relationship_count) for r in runs.collect()}
    assert counts["d2"] == (1, 0) and counts["d1"][1] == assertions.count() and counts["d1"][0] == counts["d1"][1] + 1
    known = graph.upserted(frame(spark, [], ENTITY), entities.withColumn("sensitivity", F.lit(None).cast("string")).withColumn("seq", F.lit(0)))
    assert graph.asserted(assertions, known).where("fault is not null").count() == 0
    assert graph.search(known, "w", ["ann@x.example"]).count() == 1 and graph.search(known, "w", [" "], 2).count() == 2 and graph.search(known, "v", ["plan"]).count() == 0


def test_graph_surroundings_and_paths(spark):
    edges = frame(spark, [(f"e{k}", "w", a, b, "s" if k != 3 else "no") for k, (a, b) in enumerate(["ab", "bc", "cd", "ad", "de"])], "id string, workspace_id string, subject string, object string, source_id string")
    sources = frame(spark, [("s", "w", "granted"), ("no", "w", "denied")], "id string, workspace_id string, permission string")
    open_ = graph.permitted(edges, sources)
    seeds = frame(spark, [("a",)], "id string")
    assert [(r.id, r.step) for r in graph.surrounding(open_, seeds, 3, 10).collect()] == [("e0", 1), ("e1", 2), ("e2", 3)]
    assert [r.id for r in graph.surrounding(open_, seeds, 9, 2).collect()] == ["e0", "e1"] and [r.id for r in graph.surrounding(edges, seeds, 1).collect()] == ["e0", "e3"]
    ways = edges.select(F.col("subject").alias("src"), F.col("object").alias("dst"))
    assert [r.path for r in graph.paths(ways, "a", "e", 4).collect()] == [["a", "d", "e"], ["a", "b", "c", "d", "e"]]
    assert graph.paths(ways, "a", "e", 4, 1).count() == 1 and graph.paths(ways, "a", "e", 1).count() == 0


def test_scorers_and_rubric(spark):
    scorers = frame(spark, [("1", "equals", "x", None, None, 1.0), ("2", "tool_sequence", None, ["a", "b"], None, 1.0), ("3", "citation_count", None, None, 2.0, 0.5), ("4", "nothing", None, None, None, 0.5)], "scorer_id string, type string, expected string, wanted array<string>, budget double, threshold double")
    cases = frame(spark, [("p", ["1"], "x", ["a"], 1.0), ("q", [], None, ["a", "b"], 1.0)], "case_id string, scorer_ids array<string>, actual string, found array<string>, amount double")
    got = {(r.case_id, r.scorer_id): (r.score, r.passed) for r in scoring.scored(scoring.paired(cases, scorers, ["2", "3", "4"])).collect()}
    assert got == {("p", "1"): (1.0, True), ("q", "2"): (1.0, True), ("q", "3"): (1.0, True), ("q", "4"): (0.0, False)}
    answers = frame(spark, [("It is Blue and 7",), ("blue 7 bad",), ("  ",), (None,)], "a string")
    assert [r.s for r in answers.select(scoring.rubric(F.col("a"), F.array(F.array(F.lit("red"), F.lit("BLUE")), F.array(F.lit("[0-9]"))), F.array(F.lit("bad"))).alias("s")).collect()] == [1, 0, 0, 0]


def test_returns_of_nothing_are_null(spark):
    b = frame(spark, [(1, 60.0, 120.0, 10.0)], "baseline_id int, manual_minutes double, hourly_rate double, fixed_cost double")
    o = frame(spark, [(1, 10.0, 5.0, 5.0, 20.0)], "baseline_id int, active_minutes double, review_minutes double, rework_minutes double, additional_value double")
    t = frame(spark, [(2.0,)], "cost double")
    got = scoring.returns(b, o, t).first()
    assert (got.verified_outcomes, got.total_benefit, got.total_cost, got.roi, got.payback_outcomes) == (1, 100.0, 12.0, round(88 / 12, 6), 0.12)
    none = scoring.returns(b.limit(0), o.limit(0), t.limit(0)).first()
    assert none.roi is None and none.payback_outcomes is None


def test_exact_percentiles_and_coverage(spark):
    import math
    import random

    rng = random.Random(4)
    rows = [(g, float(rng.choice([0, 1, 1, 5, rng.random() * 1000]))) for g in ("a", "b", None) for _ in range({"a": 700, "b": 3, None: 40}[g])] + [("a", None)]
    got = {r.g: (r.p10, r.p50, r.p99) for r in observe.percentiles(frame(spark, rows, "g string, v double"), "v", ["g"], {"p10": 0.1, "p50": 0.5, "p99": 0.99}, 8).collect()}
    for g in ("a", "b", None):
        values = sorted(v for k, v in rows if k == g and v is not None)
        assert got[g] == tuple(values[max(1, math.ceil(len(values) * s)) - 1] for s in (0.1, 0.5, 0.99))
    df = frame(spark, [("s", 1, 5), ("s", 2, 5), ("s", 3, 5), ("s", 4, 1), ("t", 5, 1)], "g string, id long, n long")
    assert sorted(r.id for r in retrieval.coverage(df, "g", "n", "id").collect()) == [1, 2, 5]


def test_lines_are_cut_in_place(spark):
    docs = frame(spark, [("a", "é\n\nb"), ("b", None)], "id string, text string")
    assert [(r.id, r.line_no, r.line, r.start_byte, r.end_byte) for r in passages.lines(docs).collect()] == [("a", 1, "é", 0, 2), ("a", 2, "", 3, 3), ("a", 3, "b", 4, 5), ("b", 1, "", 0, 0)]
    assert "Exchange" not in passages.lines(docs)._jdf.queryExecution().executedPlan().toString()


def test_as_of_across_buckets(spark):
    import random

    from evidentia.operators import govern

    rng, start = random.Random(7), dt.datetime(2024, 1, 1)
    at = lambda: start + dt.timedelta(seconds=rng.randrange(4000))
    left = [(k, rng.choice(["a", "b", "c"]), at()) for k in range(60)] + [(99, "a", start - dt.timedelta(days=9))]
    right = [(rng.choice(["a", "b"]), t, n) for n, t in enumerate(sorted({at() for _ in range(25)}))]
    got = govern.as_of(spark.createDataFrame(left, "id int, k string, t timestamp"), spark.createDataFrame(right, "k string, t timestamp, n int"), "k", "t", ["n"], 300)
    for row in got.collect():
        past = [(t, n) for k, t, n in right if k == row.k and t <= row.t]
        assert row.n == (max(past)[1] if past else None)
    assert got.count() == 61
