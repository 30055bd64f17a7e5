"""Spelling variants, collocations and line deduplication against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from evidentia.llm import collocations, line_dedup, queries, spelling

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
WHITE = " \t\n\x0b\x0c\r"


def frame(spark, rows):
    """(doc_id, text, lang) rows, with columns whose names clash with those of the operators."""
    out = spark.createDataFrame([(i, t, g, "s", 0) for i, t, g in rows], SCHEMA)
    for name in ("h", "g", "mark", "pos", "n_lines", "word", "n", "block", "ids", "phrase", "f", "shard", "start"):
        out = out.withColumn(name, F.lit("x"))
    return out


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


# --- lines


def lines_by_hand(docs, least=20, documents=3):
    key = lambda line: line.strip(WHITE).translate(LOWER)
    where = defaultdict(set)
    for i, text, _ in docs:
        for line in (text or "").split("\n"):
            where[key(line)].add(-1 if i is None else i)
    out = []
    for i, text, _ in docs:
        lines = (text or "").split("\n")
        held = lambda k: len(k) >= least and len(where[k]) >= documents and max(where[k]) != (-1 if i is None else i)  # noqa: B023, E731
        kept = [line for line in lines if not held(key(line))]
        out.append((-1 if i is None else i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out)


def lined(seed, n):
    rng = random.Random(seed)
    pool = ["the same line of all documents", "ÄÉ not lower-cased, but this is", "short", "", "x" * 19, "y" * 20, "日本語" * 7, "twice only, in two documents"]
    vary = [lambda s: s, str.upper, lambda s: f" \t{s}\r", lambda s: s + "\x0b\x0c"]
    return [(i, "\n".join(rng.choice(vary)(rng.choice(pool)) if rng.random() < 0.7 else f"a line of document {i}, {rng.random()}" for _ in range(rng.randrange(1, 30))), "en") for i in range(n)]


@pytest.mark.parametrize("limit", [0, 1 << 20])
@pytest.mark.parametrize("parts", [1, 3, 40])
def test_lines(spark, limit, parts):
    docs = lined(1, 60) + [(100, None, "en"), (101, "", None), (102, "\n", "en"), (None, "the same line of all documents\nz", "en"), (None, "y" * 20, "en")]
    docs += [(103, "the same line of all documents\n" * 4000 + "end", "en")] + [(7, "one id, two rows\ntwice only, in two documents", "en")] * 2
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        df = frame(spark, docs).repartition(3)
        got = line_dedup.without_lines(df, line_dedup.keep_bitmaps(df), limit)
        assert rows(got.na.fill(-1, ["doc_id"]), "doc_id", "n_lines", "n_dropped", "kept") == lines_by_hand(docs)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("seed", range(6))
def test_streams_settle_what_partitions_cut(seed):
    """Sorted rows, cut at any place into partitions and batches, give the same lines as one pass over all of them."""
    rng = random.Random(seed)
    keys = [(rng.randrange(4), rng.randrange(2)) for _ in range(200)] + [(9, 9)] * 300
    table = sorted({(h, g, -rng.randrange(9 if h < 9 else 200), 0, 1, rng.randrange(50)) for h, g in keys})
    docs = defaultdict(set)
    for h, g, d, *_ in table:
        docs[h, g].add(-d)
    want = sorted((h, g, -d, pos) for h, g, d, _, _, pos in table if len(docs[h, g]) >= 3 and -d != max(docs[h, g]))
    cuts = sorted({0, len(table), *(rng.randrange(len(table)) for _ in range(rng.randrange(12)))})
    sure, left = [], []
    for a, z in zip(cuts[:-1], cuts[1:]):
        inner = sorted({a, z, *(rng.randrange(a, z) for _ in range(rng.randrange(8)))})
        batches = []
        for b, y in zip(inner[:-1], inner[1:]):
            h, g, d, m, n, p = zip(*table[b:y])
            types = dict(h=pa.int64(), g=pa.int64(), doc=pa.int64(), mark=pa.int64(), n_lines=pa.int32(), pos=pa.int32())
            batches.append(pa.record_batch([pa.array(x, t) for x, t in zip((h, g, [-x for x in d], m, n, p), types.values())], names=list(types)))
        for batch in line_dedup._stream(3)(iter(batches)):
            for r in batch.to_pylist():
                (sure if r["sure"] else left).append(r)
    runs = defaultdict(lambda: [set(), False])
    for r in left:
        runs[r["h"], r["g"]][0].add(r["doc"])
        runs[r["h"], r["g"]][1] |= r["many"]
    settled = [r for r in left if (len(runs[r["h"], r["g"]][0]) >= 3 or runs[r["h"], r["g"]][1]) and r["doc"] != max(runs[r["h"], r["g"]][0])]
    assert sorted((r["h"], r["g"], r["doc"], r["pos"]) for r in sure + settled) == want
    assert len({r["doc"] for r in left if r["h"] == 9}) <= 4 * len(cuts)


def test_bitmaps_are_small_and_exact(spark):
    docs = frame(spark, lined(3, 40))
    found = line_dedup.keep_bitmaps(docs).collect()
    assert found and all(len(r.bitmap) < 40 and r.n_dropped > 0 for r in found)
    assert line_dedup.kept_text(b"a\nb\nc", zlib.compress(bytes([0b101]))) == b"a\nc"
    assert line_dedup.keep_bitmaps(frame(spark, []).where("false")).count() == 0


# --- spelling


def words_by_hand(docs):
    counts = Counter()
    for i, text, _ in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = 1 if i is None else zlib.crc32(f"{i}:{run}".encode())
            if h % 199 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def apart(u, v):
    """Whether one edit parts two words."""
    if len(u) == len(v):
        return sum(a != b for a, b in zip(u, v)) == 1
    short, long = sorted((u, v), key=len)
    return len(long) - len(short) == 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def spellings_by_hand(docs):
    words = words_by_hand(docs)
    near = {w: [v for v in words if apart(w, v)] for w in words}
    best = {w: min(near[w], key=lambda v: (-words[v], v)) if near[w] else None for w in words}
    form = {w: b if b and words[b] >= 5 * words[w] else None for w, b in best.items()}

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted((w, n, len(near[w]), form[w] or "", words[form[w]] if form[w] else 0, root(w)) for w, n in words.items())


def misspelt(seed, n):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abé") for _ in range(rng.randrange(6, 10))) for _ in range(30)] + ["aaaaaa", "aaaaaaa", "aaaaaaaa", "abababab", "babababa", "ÀÉÿ×÷é"]
    pool = []
    for word in base:
        pool += [word] * rng.choice([1, 8, 60, 400])
        for _ in range(8):
            at = rng.randrange(len(word))
            pool += [rng.choice([word[:at] + word[at + 1 :], word[:at] + "b" + word[at:], word[:at] + "a" + word[at + 1 :]])] * rng.choice([1, 2, 9])
    rng.shuffle(pool)
    return [(i, rng.choice([" ", "\n", "-"]).join(w if rng.random() < 0.7 else w.upper() for w in pool[i::n]), "en") for i in range(n)]


@pytest.mark.parametrize("shard", [7, 100, 40_000])
def test_spellings(spark, shard):
    docs = misspelt(5, 40) + [(None, "abababab " * 7 + "ababbab " * 6, "en"), (900, None, "en"), (901, "", None), (902, "1 2 3 ßß日本", "en"), (3, "Ababab " * 30, "en"), (3, "Ababab " * 30, "en")]
    got = spelling.spelling_groups(frame(spark, docs), shard_words=shard)
    assert rows(got.na.fill({"form": "", "form_n": 0}), "word", "n", "n_near", "form", "form_n", "root") == spellings_by_hand(docs)
    assert any(f and r != f for _, _, _, f, _, r in spellings_by_hand(docs)), "a root further than one form away is covered"


def test_spellings_of_a_table(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang").collect()]
    got = rows(queries.op11_spelling_variants(spark, sf).na.fill({"form": "", "form_n": 0}), "word", "n", "n_near", "form", "form_n", "root")
    assert got == spellings_by_hand(docs) and len(got) > 100
    assert spelling.spelling_groups(frame(spark, []).where("false")).count() == 0


def test_halves_meet_where_words_are_near():
    rng = random.Random(2)
    words = list({"".join(rng.choice("ab") for _ in range(rng.randrange(6, 9))) for _ in range(200)})
    for u in words:
        for v in words:
            if apart(u, v):
                one, two = (h.strip("^$") for h in spelling.halves(v))
                kept = ["^" + one[: spelling.START]] * u.startswith(one) + ["$" + two[: spelling.START]] * u.endswith(two)
                assert kept and set(kept) <= set(spelling.starts(u))


# --- collocations


def collocations_by_hand(docs, least=100, top=2000):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang in docs:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for m in range(1, 6):
                for i in range(len(words) - m + 1):
                    f[lang][tuple(words[i : i + m])] += 1
    out = []
    for lang in f:
        count = f[lang]
        found = [p for p in count if 2 <= len(p) and count[p] >= least]
        hidden = {(p[i : i + k], count[p]) for p in found for k in range(2, len(p)) for i in range(len(p) - k + 1)}
        kept = []
        for p in found:
            if (p, count[p]) not in hidden:
                score, k = min((1000 * count[p] * n[lang] // (count[p[:k]] * count[p[k:]]), k) for k in range(1, len(p)))
                kept.append((-score, -count[p], " ".join(p).encode(), count[p[:k]], count[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


COLUMNS = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def phrased(seed, n):
    rng = random.Random(seed)
    fixed = ["new york city hall", "New\tYork", "é è ê", "as well as", "a a a a", "x.y", "on the other hand side"]
    return [(i, " ".join(rng.choice(fixed) if rng.random() < 0.5 else rng.choice("the of a , . ! to é zz \n".split(" ")) for _ in range(60)), rng.choice(["en", "fr", None, "und"])) for i in range(n)]


@pytest.mark.parametrize("size", [300, 1 << 20])
def test_collocations(spark, monkeypatch, size):
    monkeypatch.setattr(collocations, "BLOCK_BYTES", size)
    monkeypatch.setattr(collocations, "BUCKET_PAIRS", size)
    monkeypatch.setattr(collocations, "BUCKET_WORDS", size)
    docs = phrased(1, 80) + [(900, None, "en"), (901, "", "de"), (902, "a a a a " * 3000, "en"), (None, "the other " * 40, "fr"), (5, "as well as " * 20, "xx"), (5, "as well as " * 20, "xx")]
    got = collocations.collocations(frame(spark, docs), least=20, top=12)
    assert rows(got, *COLUMNS) == collocations_by_hand(docs, 20, 12)


def test_collocation_products_pass_64_bits(spark):
    """Counts as large as these only occur in very large corpora: the product is checked on its own."""
    big = spark.createDataFrame([(3 * 10**12, 10**14 + 7, 4 * 10**12, 5 * 10**12 + 1)], "a long, n long, l long, r long")
    got = big.select(collocations.score("a", "n", "l", "r").alias("s")).first().s
    assert got == 1000 * 3 * 10**12 * (10**14 + 7) // (4 * 10**12 * (5 * 10**12 + 1))


def test_collocations_of_nothing(spark):
    assert collocations.collocations(frame(spark, []).where("false")).count() == 0
    assert collocations.collocations(frame(spark, [(1, "a b", "en"), (2, None, None)])).count() == 0


def test_dealt_queries_carry_their_columns(spark, sf):
    assert queries.op12_collocations(spark, sf).columns == list(COLUMNS)
    got = queries.op13_line_dedup(spark, sf)
    assert got.columns == ["doc_id", "n_lines", "n_dropped", "kept_sha256"] and got.dtypes[1][1] == got.dtypes[2][1] == "bigint"
    kept = line_dedup.without_lines(df := spark.read.parquet(f"{sf}/documents.parquet"), line_dedup.keep_bitmaps(df))
    assert rows(got, "doc_id", "kept_sha256") == sorted((r.doc_id, hashlib.sha256(r.kept.encode()).hexdigest()) for r in kept.collect())
