"""Sections, passages, entities and governance on hand-computed rows."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from evidentia.functions import entities as ent
from evidentia.operators import govern, markdown, passages, retrieval


def test_lines_slice_back_to_the_text(spark):
    texts = {1: "zażółć\ngęślą\r\n\njaźń 🙂", 2: "", 3: None}
    df = spark.createDataFrame(list(texts.items()), "id int, text string")
    for r in passages.lines(df).collect():
        assert (texts[r.id] or "").encode()[r.start_byte : r.end_byte].decode() == r.line
    assert passages.lines(df).where("id = 3").count() == 1 and passages.lines(df.limit(0)).count() == 0


def test_sections_follow_headings(spark):
    text = "intro\n# One\na\n```\n# code\n```\n### Deep\nTwo\n---\n\nb\n3.1 Third\nArticle 7 - Terms\nc\n===\nd"
    got = markdown.sections(spark.createDataFrame([(1, text, "x"), (2, None, "y")], "id int, text string, path string")).orderBy("id", "section").collect()
    one = [(r.section, r.level, r.heading, r.path, r.first_line, r.last_line) for r in got if r.id == 1]
    assert one == [
        (0, None, None, None, 1, 1), (1, 1, "One", ["One"], 2, 6), (2, 3, "Deep", ["One", "Deep"], 7, 7), (3, 2, "Two", ["One", "Two"], 8, 11),
        (4, 3, "3.1 Third", ["One", "Two", "3.1 Third"], 12, 12), (5, 2, "Article 7 - Terms", ["One", "Article 7 - Terms"], 13, 16),
    ]
    assert not [r for r in got if r.id == 2]


def assorted(seed, n):
    rng = random.Random(seed)
    lines = ["# Top", "## Sub  ##", "Title", "=====", "---", "", "", "```", "~~~", "text é👉 of a line", "| a | b |", "|---|---|", "- item", "> said", "Article 5 - Scope", "2.1 Numbered", "x" * 70, "\u2028", " indented"]
    return ("---\ntype: x\n---\n" if seed % 2 else "") + rng.choice(["\n", "\r\n"]).join(rng.choice(lines) for _ in range(n)) + rng.choice(["", "\n"])


@pytest.mark.parametrize("buffer", [200, markdown.BUFFER])
def test_pieces_of_any_size_give_the_same_units(monkeypatch, buffer):
    for seed in range(40):
        data = assorted(seed, 120).encode()
        whole = markdown.Parser(buffer)
        want = [u.row() for u in (*whole.feed(data), *whole.close())]
        assert b"".join(u[6].encode() for u in want) == data and [u[9] for u in want[1:]] == [u[10] for u in want[:-1]]
        assert all(len(u[6].encode()) <= buffer + 74 for u in want)
        for size in (1, 7, 1000):
            parser, got = markdown.Parser(buffer), []
            for at in range(0, len(data), size):
                got += [u.row() for u in parser.feed(data[at : at + size])]
            assert got + [u.row() for u in parser.close()] == want


def test_documents_in_pieces_equal_whole_ones(spark):
    docs = spark.createDataFrame([(k, assorted(k, 600)) for k in range(12)] + [(50, ""), (51, None)], "id long, text string").withColumn("seq", F.lit("x"))
    key = lambda df: sorted(tuple(str(v) for v in r) for r in df.collect())
    for whole, of_pieces in ((markdown.units, markdown.units_of_pieces), (markdown.passages, markdown.passages_of_pieces)):
        want = key(whole(docs))
        for size in (1000, 1 << 20):
            assert key(of_pieces(markdown.pieces(docs, size))) == want
    rows = markdown.passages(docs, target=60, hard=90).collect()
    texts = {r.id: (r.text or "").encode() for r in docs.collect()}
    assert all(texts[r.id][r.start_byte : r.end_byte].decode() == r.text and r.lexical_text.endswith(r.text) for r in rows)
    assert markdown.units(docs.where("false")).count() == 0 and len({r.id for r in rows}) == 12


def test_two_rows_of_one_id_are_two_documents(spark):
    docs = spark.createDataFrame([(1, "a\n\n# b"), (1, "c"), (None, "d")], "id long, text string")
    assert sorted((r.id or 0, r.ordinal, r.text) for r in markdown.units(docs).collect()) == [(0, 0, "d"), (1, 0, "a\n\n"), (1, 0, "c"), (1, 1, "# b")]


def test_packing(spark):
    units = [(1, 1, "paragraph", "x" * 200), (1, 2, "paragraph", "x" * 200), (1, 3, "table", "x" * 8), (1, 4, "paragraph", "x" * 8), (1, 5, "paragraph", "x" * 1000), (2, 1, "paragraph", "")]
    got = passages.packed(spark.createDataFrame(units, "id int, ordinal int, type string, text string"), 80, 120).orderBy("id", "ordinal", "piece").collect()
    assert [(r.ordinal, r.piece, r.tokens, r.passage) for r in got] == [(1, 0, 50, 0), (2, 0, 50, 1), (3, 0, 2, 2), (4, 0, 2, 3), (5, 0, 120, 4), (5, 1, 120, 5), (5, 2, 10, 6), (1, 0, 1, 0)]


def test_evidence_must_still_be_there(spark):
    docs = spark.createDataFrame([(1, "zażółć x", ["a"]), (2, "secret", ["b"])], "id int, text string, acl_tokens array<string>")
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    rows = [(1, 0, 10, sha("zażółć")), (1, 0, 9, sha("zażółć")), (2, 0, 6, sha("secret"))]
    got = passages.verified(spark.createDataFrame(rows, "id int, start_byte long, end_byte long, content_sha256 string"), docs, ["a"]).collect()
    assert [(r.id, r.end_byte) for r in got] == [(1, 10)]


def test_conversation_budget(spark):
    rows = [(1, i, "y " * 500) for i in range(8)] + [(2, 0, None), (2, 1, " a  b ")]
    got = {(r.c, r.turn): len(r.text) for r in passages.compacted(spark.createDataFrame(rows, "c int, turn int, text string"), "c", "turn").collect()}
    assert got == {(1, 7): 800, (1, 6): 800, (1, 5): 800, (1, 4): 600, (2, 1): 3}


def test_neighbours_only_where_needed(spark):
    p = spark.createDataFrame([("s", 1, "short."), ("s", 2, "x" * 200 + "."), ("s", 3, "short"), ("s", 4, "y")], "s string, o int, text string")
    hits = spark.createDataFrame([("s", 2, 1, 1.0), ("s", 3, 2, 0.5)], "s string, o int, rank int, score double")
    got = {r.o: (r.score, r.neighbour) for r in passages.expanded(hits, p, "s", "o").collect()}
    assert got == {2: (1.0, False), 3: (0.5, False), 4: (0.475, True)}


def test_entities(spark):
    text = "# Plan\nsee ABC-12 and abc@d.org, https://x.org/a on 2024-01-02 in crm.users CRM.Users"
    got = {(r.type, r.predicate, r.name) for r in ent.entities(spark.createDataFrame([(1, text), (2, None), (3, "")], "id int, text string")).collect()}
    assert {("document", "has_heading", "plan"), ("ticket", "references_ticket", "abc-12"), ("person", "references_email", "abc@d.org"), ("document", "links_to", "https://x.org/a"), ("decision", "mentions_date", "2024-01-02"), ("system", "references_table", "crm.users")} <= got
    assert len(got) == len({(t, p, n) for t, p, n in got})


def test_globs_and_durations(spark):
    paths = spark.createDataFrame([("a/b/c.ts",), ("c.ts",), ("a/d.TS",), ("x1",), ("xz",)], "p string")
    hit = lambda g: [r.p for r in paths.where(ent.excluded(F.col("p"), g)).collect()]
    assert hit(["**/*.ts"]) == ["a/b/c.ts", "c.ts", "a/d.TS"] and hit(["*.ts"]) == ["c.ts"] and hit(["x?"]) == ["x1", "xz"] and hit(["x[a-z]"]) == ["xz"] and hit([]) == []
    d = spark.createDataFrame([("10s",), ("2 m",), ("x",), (None,)], "d string").select(ent.duration_ms(F.col("d")).alias("ms"))
    assert [r.ms for r in d.collect()] == [10_000, 120_000, None, None]


def test_grants(spark):
    grants = spark.createDataFrame([("k", "*", ["read*"], ["read_secret"], ["s"], None), ("k", "p", ["write:go"], [], ["*"], None), ("k", "q", ["*"], [], ["*"], "2020-01-01")], "connector string, principal string, allowed_tools array<string>, denied_tools array<string>, scopes array<string>, expires_at string")
    calls = [(1, "p", "k", "read_x", None, ["s"]), (2, "p", "k", "read_secret", None, []), (3, "p", "k", "write", "go", ["t"]), (4, "q", "k", "write", "go", []), (5, "q", "k", "read_x", None, ["t"]), (6, "p", "other", "read_x", None, [])]
    df = spark.createDataFrame(calls, "n int, principal string, connector string, tool string, action string, scopes array<string>")
    got = govern.decisions(df, grants.withColumn("expires_at", F.col("expires_at").cast("timestamp")), F.lit("2024-01-01").cast("timestamp"))
    assert {r.n: r.decision for r in got.collect()} == {1: "allowed", 2: "denied", 3: "allowed", 4: "no grant", 5: "no grant", 6: "no grant"}


def test_outcomes_division_and_as_of(spark):
    labels = spark.createDataFrame([(["Good "],), (["bad"],), (["good", "bad"],), (["other"],), ([" "],), (None,)], "l array<string>")
    assert [r.o for r in labels.select(govern.outcome(F.col("l")).alias("o")).collect()] == ["accepted", "rejected", "mixed", "mixed", "unlabeled", "unlabeled"]
    sections = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (2, 2)], "id int, section int")
    sums = spark.createDataFrame([(1, 1, "a", 1), (1, 1, "b", 2), (1, 2, "c", 1), (2, 1, "d", 9)], "id int, section int, signature string, created int")
    assert govern.complete_signatures(sections, sums).collect() == [(1, "b")]
    left = spark.createDataFrame([("u", 5, 1), ("u", 1, 2), ("v", 9, 3)], "k string, t int, n int")
    right = spark.createDataFrame([("u", 2, "x"), ("u", 5, "y"), ("w", 1, "z")], "k string, t int, v string")
    assert {r.n: r.v for r in govern.as_of(left, right, "k", "t", ["v"]).collect()} == {1: "y", 2: None, 3: None}


def test_source_health(spark):
    rows = [(1, "down", "denied", "stale"), (2, "healthy", "granted", "unknown"), (3, "degraded", None, "expired"), (4, None, None, None)]
    df = spark.createDataFrame(rows, "id int, health string, permission string, staleness string")
    got = {(r.source_id, r.issue, r.severity) for r in govern.findings(df, unknown=True).collect()}
    assert got == {(1, "down", "critical"), (1, "permission_denied", "critical"), (1, "stale", "warning"), (2, "unknown_freshness", "warning"), (3, "degraded", "warning"), (3, "expired", "critical")}
    assert tuple(govern.health_report(df).first()) == (4, 2, 2, 2, 2, 3)
    assert tuple(govern.health_report(df.limit(0)).first()) == (0, 0, 0, 0, 0, 0)


def test_hierarchical_routing_finds_the_section_of_a_long_document(spark):
    rows = [(k, f"c{k % 9}", "thing " + "word " * (k % 7 + 1)) for k in range(60)] + [(k, f"c{k}", "thing " + "word " * 20000) for k in (70, 71)] + [(99, "c99", "# A\n" + "word " * 9000 + "\n# Thing\nthing contract é"), (None, "c1", "thing"), (98, None, "thing é"), (97, "c1", None)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    terms = {"thing", "contract"}

    def lane(counts, limit):
        scored = [(-round(m / (2 * n) ** 0.5, 9), i) for i, (m, n) in counts.items() if m]
        return [(i, k + 1, -s) for k, (s, i) in enumerate(sorted(scored)[:limit])]

    def fused(lanes):
        out, best = {}, {}
        for i, k, s in (h for found in lanes for h in found):
            out[i], best[i] = out.get(i, 0) + 1 / (60 + k), max(best.get(i, 0), s)
        return sorted(((round(v, 9), best[i], i) for i, v in out.items()), key=lambda h: (-h[0], -h[1], h[2]))

    def counts(level, inside, key):
        out = {}
        for c, d, n, t in inside:
            if key(c, d, n) is not None:
                words = re.findall(r"\w+", t.lower())
                m, size = out.get((level, *key(c, d, n)), (0, 0))
                out[(level, *key(c, d, n))] = (m + sum(w in terms for w in words), size + len(words))
        return out

    parts = [(c or "", d, n, t) for d, c, text in rows if d is not None for n, t in ([(1, "# A " + "word " * 9000), (2, "# Thing thing contract é")] if d == 99 else [(0, text or "")])]
    of = {"collection": lambda c, d, n: (c, -1, -1) if c else None, "document": lambda c, d, n: (c, d, -1), "section": lambda c, d, n: (c, d, n)}
    size = {"collection": 20, "document": 50, "section": 100}
    lanes = [lane(counts(level, parts, of[level]), size[level]) for level in size]
    top = [i[1] for _, _, i in fused(lanes) if i[0] == "collection"][:10]
    lanes += [lane(counts(level, [p for p in parts if p[0] in top], of[level]), size[level]) for level in ("document", "section")]
    hits = [i for _, _, i in fused(lanes)]
    found = {i[2] for i in [i for i in hits if i[0] != "collection"][:30]}
    inner = {i[2:] for i in [i for i in hits if i[0] == "section"][:50]}
    cut = {(d, n, k): (c, t[k * 2000 : k * 2000 + 2000]) for c, d, n, t in parts for k in range(max(1, -(-len(t) // 2000)))}

    def passage_lane(keep):
        chosen = [(c, d, f"{d}/{n}/{k}", t) for (d, n, k), (c, t) in cut.items() if keep(c, d, n)]
        return [(i[1], k, s) for i, k, s in lane(counts("passage", chosen, lambda c, d, n: (n,)), 150)]

    want = fused([passage_lane(lambda c, d, n: d in found and (d, n) in inner), passage_lane(lambda c, d, n: c in top)])[:100]
    got = [(r.fusion, r.score, r.id) for r in retrieval.hierarchical(docs, "Thing contract", "source", id_column="doc_id").collect()]
    assert got == want and "99/2/0" in [i for _, _, i in got] and "70/0/0" not in [i for _, _, i in got] and len(got) > 30
    assert "99" not in [str(r.id) for r in retrieval.lexical(docs, "Thing contract", 30, id_column="doc_id").collect()]
    assert retrieval.hierarchical(docs.limit(0), "Thing", "source", id_column="doc_id").count() == 0
