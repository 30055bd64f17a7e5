"""Scopes, line counts, trees, registries and what else lies around a corpus, on hand-computed rows."""

import datetime as dt
import hashlib

import pytest
from pyspark.sql import functions as F

from evidentia.operators import observe, shelves

SCOPED = "workspace string, context string, generation string, document long, section long, acl_tokens array<string>, document_type string, jurisdiction string, publication_date date, valid_from date, valid_to date"


def test_scopes(spark):
    day = dt.date(2024, 1, 1)
    base = ("w", "c", "g", 1, 1, ["t"], "Contract", "PL", None, day, None)
    rows = [base] + [(*base[:k], v, *base[k + 1 :]) for k, v in ((0, "x"), (1, "x"), (2, "x"), (3, 2), (4, 2), (5, ["u"]), (5, None), (6, None), (6, "x"), (7, "de"), (9, None), (9, dt.date(2025, 1, 1)), (10, dt.date(2023, 1, 1)))]
    df = spark.createDataFrame(rows, SCOPED)
    count = lambda *a, **k: shelves.in_scope(df, shelves.Scope(*a, **k), spark.createDataFrame([("k", 1), ("k", 1), ("l", 2)], "collection string, document long")).count()
    assert count("w", "c", "g") == 11 and count("w", "c", "g", ("t", "z")) == 9 and count("w", "c", "g", ()) == 0
    assert count("w", "c", "g", documents=(2,)) == 1 and count("w", "c", "g", sections=(2, 3)) == 1 and count("w", "c", "g", collections=("l",)) == 1 and count("w", "c", "g", collections=("k",)) == 10
    assert count("w", "c", "g", types=("contract",), jurisdictions=("pl",)) == 8 and count("w", "c", "g", as_of="2024-01-01") == 9 and count("w", "c", "g", types=()) == 11
    with pytest.raises(ValueError):
        shelves.in_scope(df, shelves.Scope("w", "c", "g", collections=("k",)))


def test_line_counts(spark):
    text = "# A\nArticle 5\n2.1 b\n\ntext\n| a |\n| b |\nmore\n| c |\n\n| d |\n\n  \n##x\n#\ty\n"
    got = {r.id: tuple(r)[1:] for r in shelves.inspected(spark.createDataFrame([(1, text), (2, ""), (3, None)], "id long, text string")).collect()}
    assert got == {1: (2, 2, 3, 3), 2: (0, 0, 0, 0), 3: (0, 0, 0, 0)}


def test_expert_files(spark):
    df = spark.createDataFrame([("b.md", "Foo foo foobar foo-bar"), ("a.md", "FOO x foo, foo"), ("foo/c", None), ("d", "nothing")], "path string, content string")
    got = [(r.path, r.score) for r in shelves.expert_files(df, "the Foo? foo", 10).orderBy("rank").collect()]
    assert got == [("a.md", 3), ("b.md", 3), ("foo/c", 1), ("d", 0)] and [r.score for r in shelves.expert_files(df, "a b", 2).collect()] == [1, 1]
    paths = spark.createDataFrame([("a/b", 1), (".x/b", 1), ("a/.git/c", 1), ("a/node_modules/c", 1), ("node_modules", 1), ("a/node_modules2", 1), ("big", 10)], "path string, size long")
    assert {r.path for r in shelves.expert_scan(paths, 5).collect()} == {"a/b", "a/node_modules2"}


def test_trees(spark):
    df = spark.createDataFrame([("a/b/c", 1), ("a/b/d", 2), ("a/e", None), ("f", 4), (None, 1), ("", 1)], "path string, size long")
    got = {r.path: (r.name, r.depth, r.kind, r.files, r.bytes) for r in shelves.tree(df).collect()}
    assert got == {"a": ("a", 1, "folder", 3, 3), "a/b": ("b", 2, "folder", 2, 3), "a/b/c": ("c", 3, "file", 1, 1), "a/b/d": ("d", 3, "file", 1, 2), "a/e": ("e", 2, "file", 1, 0), "f": ("f", 1, "file", 1, 4)}


def test_sessions_and_registries(spark):
    rows = [(1, "a", "open", 5, " x\n y "), (2, "b", "archived", 9, None), (3, "c", "open", 7, "z" * 100), (4, "d", None, 8, ""), (5, "e", "open", 7, "")]
    df = spark.createDataFrame(rows, "id long, title string, status string, updated_at int, text string")
    assert [(r.id, len(r.preview)) for r in shelves.sessions(df).collect()] == [(3, 80), (5, 0), (1, 3)]
    assert [r.id for r in shelves.sessions(df, True).collect()] == [2, 4, 3, 5, 1]
    events = [("s", "version", "1", None, 1, 1), ("s", "version", "2", None, 1, 2), ("s", "version", None, None, 3, 1), ("s", "health", None, "bad", 2, 1), ("s", "access", None, None, 9, 1), ("new", "access", None, None, 1, 1), (None, "access", None, None, 1, 1)]
    e = spark.createDataFrame(events, "source_id string, kind string, version string, health string, at int, seq int")
    s = spark.createDataFrame([("s", "old", "o", 1), ("s", "name", "o2", 2), ("t", "t", None, 1)], "source_id string, name string, owner string, updated_at int")
    got = {r.source_id: tuple(r)[1:] for r in shelves.registered(s, e).collect()}
    assert got == {"s": ("name", "o2", "2", "bad", 1, 9), "t": ("t", None, None, None, 0, None), "new": (None, None, None, None, 1, 1)}


def test_audits_and_imports(spark):
    hits = spark.createDataFrame([(1, 1), (2, 2), (3, 3)], "id long, rank int")
    got = shelves.audited(hits, hits.where("id = 1"), spark.createDataFrame([(1, "no"), (2, "cap"), (2, "budget")], "id long, reason string"), "r").collect()
    assert sorted((r.id, r.selected, r.reason) for r in got) == [(1, True, None), (2, False, "budget"), (3, False, None)]
    kind = "namespace string, id string, doc string"
    store, ledger = shelves.imported(
        spark.createDataFrame([("a", "1", "new")], kind), spark.createDataFrame([("a", "1", "x"), ("a", "2", "y"), ("b", "1", "z"), ("b", None, "z"), (None, "1", "z")], kind), spark.createDataFrame([("b", 4)], "namespace string, n long")
    )
    assert sorted(map(tuple, store.collect())) == [("a", "1", "new"), ("a", "2", "y")] and sorted(map(tuple, ledger.collect())) == [("a", 2), ("b", 4)]
    df = spark.createDataFrame([("g", "b"), ("g", "a"), ("g", None), ("h", "a")], "g string, d string")
    assert {r.g: r.fingerprint for r in shelves.memory_fingerprint(df, "g", "d").collect()} == {"g": hashlib.sha256(b"a\0b").hexdigest(), "h": hashlib.sha256(b"a").hexdigest()}


def test_one_failing_source_takes_no_other_with_it(spark):
    one = lambda name: spark.createDataFrame([("w", name, k, k + 1) for k in range(3)], "workspace_id string, source_id string, id int, rank int")
    fused, states = shelves.federated([one("a"), one("b")], spark.createDataFrame([("b", "timeout"), ("z", "down")], "source_id string, reason string"), ["a", "b", "c"])
    assert {r.source_id for r in fused.collect()} == {"a"} and sorted(map(tuple, states.collect()), key=str) == [("a", "ok", None, 3), ("b", "failed", "timeout", 0), ("c", "ok", None, 0)]


@pytest.mark.parametrize("few", [0, 10**6])
def test_percentiles_over_ranges(spark, few):
    rows = [(k % 3 or None, float(k * 7919 % 101)) for k in range(900)]
    df = spark.createDataFrame(rows, "g int, v double")
    got = {r.g: (r.a, r.z) for r in observe.percentiles(df, "v", ["g"], {"a": 0.3, "z": 1.0}, few).collect()}
    for g in (None, 1, 2):
        values = sorted(v for k, v in rows if k == g)
        assert got[g] == (values[-(-len(values) * 3 // 10) - 1], values[-1])
    assert observe.percentiles(df, "v", [], {"p": 0.5}, few).first().p == sorted(v for _, v in rows)[449]
    assert observe.percentiles(df.where("false"), "v", ["g"], {"p": 0.5}, few).count() == 0
