"""Queries over indexes that are built once and searched for many questions: vectors, postings, knowledge, passes."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from .operators import evidence, passes, planning, postings, retrieval, vectors
from .queries import DENSE, EXACT, LEX, QUESTION, VECTOR, _lane, query
from .session import saved

# vectors

ASKED = "SELECT vec_id AS query, CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id % 50 = 0"
NEAREST = f"""SELECT query, rank, id, score FROM (
  SELECT query, id, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM (
    SELECT query, vec_id AS id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), q), 6) AS score FROM embeddings, ({ASKED})) WHERE score > 0) WHERE rank <= 10"""


def _vector_index(load):
    e = load("embeddings")
    index = vectors.build(e, 64, id_column="vec_id")
    return e.where("vec_id % 50 = 0"), index


@query("vector_index_exact", NEAREST)
def _(spark, load):
    asked, index = _vector_index(load)
    return vectors.search(index, asked, 10, index.cells, 0, id_column="vec_id")


@query("vector_index_topk")
def _(spark, load):
    """Approximate, so without SQL; its recall against the query above is asserted by a test."""
    asked, index = _vector_index(load)
    return vectors.search(vectors.tuned(index, asked, id_column="vec_id"), asked, 10, id_column="vec_id")


# postings

TOKENS = r"regexp_extract_all(lower(coalesce({0}, '')), '[\p{{L}}\p{{N}}_-]+')"
TERMS = "('the', 'of', 'contract', 'for', 'that', 'thing', 'src1')"


@query("posting_index_lexical", f"SELECT * FROM {_lane('lexical', LEX, 50)}")
def _(spark, load):
    return postings.lexical(postings.build(load("documents"), {"text": "B"}, "doc_id"), QUESTION, 50)


WEIGHTED = f"""SELECT doc_id AS id, round(w / (w + 1), 9) AS score FROM (
  SELECT doc_id, (1.0 * len(list_filter(a, lambda x: x IN {TERMS})) + 0.4 * len(list_filter(b, lambda x: x IN {TERMS}))) / sqrt(len(a) + len(b)) AS w
  FROM (SELECT doc_id, {TOKENS.format('source')} AS a, {TOKENS.format('text')} AS b FROM documents)) WHERE w > 0"""


@query("posting_index_weighted", f"SELECT * FROM {_lane('weighted_lexical', WEIGHTED, 50)}")
def _(spark, load):
    return postings.weighted(postings.build(load("documents"), {"source": "A", "text": "B"}, "doc_id"), QUESTION + " src1", 50)


@query("posting_index_questions", f"""WITH d AS (SELECT doc_id, {TOKENS.format('text')} AS t FROM documents),
p AS (SELECT doc_id, len(t) AS n, unnest(t) AS term FROM d), q AS (SELECT item_id AS query, list_distinct({TOKENS.format('text')}) AS t FROM benchmark),
e AS (SELECT query, len(t) AS k, unnest(t) AS term FROM q),
m AS (SELECT query, k, doc_id AS id, n, count(*) AS m FROM p JOIN e USING (term) GROUP BY query, k, doc_id, n),
s AS (SELECT query, id, round(m / sqrt(k::DOUBLE * n), 9) AS score FROM m)
SELECT query, rank, score, id FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 10""")
def _(spark, load):
    """A lexical lane for every benchmark item at once."""
    index = postings.build(load("documents"), {"text": "B"}, "doc_id")
    return postings.lexical_many(index, load("benchmark").select(F.col("item_id").alias("query"), "text"), 10)


# what questions ask for, over the texts of conversations

ASKED_SQL = """SELECT conv_id, turn, trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) AS t, role FROM conversations"""
#: A question of each turn: its whole text with filters behind it, quoted or not by the turn's number.
STATED = "{t} type: \"{r} Notes\" type:{r}_1.x jurisdiction : 'A {k}' due 2024-0{k}-11"
STATED_SQL = "t || ' type: \"' || role || ' Notes\" type:' || role || '_1.x jurisdiction : ''A ' || (turn % 9) || ''' due 2024-0' || (turn % 9) || '-11'"


def _stated(load):
    t = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " "))
    parts = {"{t}": t, "{r}": F.col("role"), "{k}": (F.col("turn") % 9).cast("string")}
    pieces = [parts.get(x, F.lit(x)) for x in re.split(r"(\{\w\})", STATED) if x]
    return load("conversations").select("conv_id", "turn", F.concat(*pieces).alias("q"))


def _stated_values(word: str) -> str:
    found = f"regexp_extract_all(q, '(?i)\\b{word}\\s*:\\s*(?:[\"''][^\"'']+[\"'']|[\\p{{L}}\\p{{N}}_.-]+)')"
    bare = f"list_transform({found}, lambda v: regexp_replace(regexp_replace(v, '(?i)^{word}\\s*:\\s*', ''), '^[\"'']|[\"'']$', '', 'g'))"
    return f"array_to_string(list_filter({bare}, lambda v, i: list_position({bare}, v) = i), ';')"


@query("question_filters", f"SELECT conv_id, turn, {_stated_values('type')} AS types, {_stated_values('jurisdiction')} AS jurisdictions, regexp_extract(q, '\\b(\\d{{4}}-\\d{{2}}-\\d{{2}})\\b', 1) AS as_of FROM (SELECT conv_id, turn, {STATED_SQL} AS q FROM ({ASKED_SQL}))")
def _(spark, load):
    stated = planning.filters(F.col("q"))
    return _stated(load).select("conv_id", "turn", stated.alias("f")).select("conv_id", "turn", F.array_join("f.types", ";").alias("types"), F.array_join("f.jurisdictions", ";").alias("jurisdictions"), "f.as_of")


def _variants_list() -> str:
    """The queries of a question q's variants, as a list; each known term adds one for every language."""
    terms = [f"CASE WHEN contains(lower(q), '{term}') THEN q || ' {' '.join(names)}' END" for term, by in planning.EXPANSIONS.items() for names in by.values()]
    return f"list_filter([CASE WHEN strip_accents(q) <> q THEN strip_accents(q) END, {', '.join(terms)}], lambda v: v IS NOT NULL)"


@query("question_variants", f"SELECT conv_id, turn, len(v) AS n, md5(array_to_string(v, ';')) AS digest, array_to_string(list_transform(v[1:3], lambda x: right(x, 30)), ';') AS lane FROM (SELECT conv_id, turn, {_variants_list()} AS v FROM (SELECT conv_id, turn, t || ['', ' Termination', ' PAYMENT liability', ' płatność'][turn % 4 + 1] AS q FROM ({ASKED_SQL})))")
def _(spark, load):
    asked = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " "))
    tail = F.element_at(F.array(*map(F.lit, ("", " Termination", " PAYMENT liability", " płatność"))), (F.col("turn") % 4 + 1).cast("int"))
    rows = load("conversations").select("conv_id", "turn", F.concat(asked, tail).alias("q")).select("conv_id", "turn", planning.lexical_variants(F.col("q")).alias("v"))
    every = F.transform("v", lambda v: v["query"])
    return rows.select("conv_id", "turn", F.size("v").alias("n"), F.md5(F.array_join(every, ";")).alias("digest"), F.array_join(F.transform(F.slice(every, 1, planning.MOST_VARIANTS), lambda x: F.right(x, F.lit(30))), ";").alias("lane"))


CLEAN = "trim(regexp_replace({0}, '\\s+', ' ', 'g'))"
REWRITE = f"""WITH t AS (SELECT conv_id, role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, coalesce(text, '') DESC) AS age FROM conversations),
q AS (SELECT conv_id, arg_min(substr({CLEAN.format('text')}, 1, 1200), age) AS q, min(age) AS asked FROM t WHERE role = 'user' GROUP BY conv_id),
b AS (SELECT conv_id, role, age, substr({CLEAN.format('text')}, 1, 800) AS s FROM t JOIN q USING (conv_id) WHERE age > asked AND age <= asked + 6),
l AS (SELECT *, sum(length(s)) OVER (PARTITION BY conv_id ORDER BY age) - length(s) AS before FROM b),
c AS (SELECT conv_id, string_agg(role || ': ' || substr(s, 1, (3000 - before)::BIGINT), chr(10) ORDER BY age DESC) AS c, count(*) AS n FROM l WHERE before < 3000 AND s <> '' GROUP BY conv_id),
r AS (SELECT conv_id, q, c, n, n IS NOT NULL AND (regexp_matches(q, '{planning.FOLLOW_UP.replace('(?iu)', '(?i)')}') OR len(string_split(q, ' ')) <= 8
      OR (regexp_matches(q, '{planning.PLAIN_QUESTION}') AND NOT regexp_matches(q, '{planning.NAMED}'))) AS needs FROM q LEFT JOIN c USING (conv_id))
SELECT conv_id, CASE WHEN needs THEN 'deterministic' ELSE 'identity' END AS method, CASE WHEN needs THEN n ELSE 0 END::INT AS turns_used,
  md5(CASE WHEN needs THEN substr({CLEAN.format(f"q || chr(10) || '{planning.CONTEXT_LABEL}' || chr(10) || substr({CLEAN.format('c')}, 1, 2400)")}, 1, 3200) ELSE q END) AS digest FROM r"""


@query("question_rewrite", REWRITE)
def _(spark, load):
    return planning.standalone(load("conversations")).select("conv_id", "method", "turns_used", F.md5("query").alias("digest"))


# the eight variants

LAW = "payment of the contract"


def _terms_sql(words: str) -> str:
    of = retrieval.query_terms(words)
    inside = ", ".join(f"'{t}'" for t in of)
    return LEX.replace("sqrt(6.0", f"sqrt({len(of)}.0").replace("('the', 'of', 'contract', 'for', 'that', 'thing')", f"({inside})")


def _variants_sql() -> str:
    lex, dense_in = _terms_sql(LAW), lambda ids: f"SELECT * FROM ({DENSE}) WHERE id IN ({ids})"
    fused = lambda lanes, limit, weight="1.0": f"(SELECT id, round(sum({weight} / (60 + rank)), 9) AS fusion, max(score) AS score, string_agg(DISTINCT retriever, ',' ORDER BY retriever) AS retrievers FROM ({' UNION ALL '.join(f'SELECT * FROM {lane}' for lane in lanes)}) GROUP BY id ORDER BY fusion DESC, score DESC, id LIMIT {limit})"
    routed = f"SELECT id FROM {fused([_lane('lexical', lex, 50), _lane('exact_reference', EXACT, 50), _lane('dense', DENSE, 50)], 30)}"
    of = ", ".join(f"'{t}'" for t in retrieval.query_terms(LAW))
    sources = f"""SELECT source AS id, round(sum(m) / sqrt({len(retrieval.query_terms(LAW))}.0 * sum(n)), 9) AS score FROM (SELECT source, len(t) AS n, len(list_filter(t, lambda x: x IN ({of}))) AS m
      FROM (SELECT source, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_-]+') AS t FROM documents)) GROUP BY source HAVING sum(m) > 0"""
    members = f"SELECT doc_id FROM documents WHERE source IN (SELECT id FROM {_lane('lexical', sources, 10)})"
    lanes = {
        "lexical": [_lane("lexical", lex, 150)], "exact": [_lane("exact_reference", EXACT, 50)], "dense": [_lane("dense", DENSE, 100)],
        "lexical_scoped": [_lane("lexical", f"SELECT * FROM ({lex}) WHERE id IN ({routed})", 150)], "lexical_collection": [_lane("passage_lexical_collection", f"SELECT * FROM ({lex}) WHERE id IN ({members})", 150)],
        "dense_scoped": [_lane("passage_dense_scoped", dense_in(routed), 100)], "dense_collection": [_lane("passage_dense_collection", dense_in(members), 100)],
        "translated": [_lane("translated_lexical", _terms_sql(f"{LAW} {' '.join(names)}"), 50) for names in planning.EXPANSIONS["payment"].values()],
    }
    weight = "CASE retriever WHEN 'exact_reference' THEN 2.0 WHEN 'dense' THEN 0.8 ELSE 1.0 END"

    def one(name: str, parts: tuple[str, ...]) -> str:
        body = fused([lane for p in parts if p not in planning.STEPS for lane in lanes[p]], 100, weight)
        order = "coalesce(s, 0) DESC, " if "rerank" in parts else ""
        return f"SELECT '{name}' AS variant, row_number() OVER (ORDER BY {order}fusion DESC, score DESC, id) AS rank, id, fusion, score, retrievers FROM {body} LEFT JOIN (SELECT doc_id AS id, max(quality)::DOUBLE AS s FROM labels GROUP BY 1) USING (id)"

    return " UNION ALL ".join(one(n, p) for n, p in planning.VARIANTS.items())


@query("retrieval_variants", _variants_sql())
def _(spark, load):
    """All eight over one question; the labels' quality stands for a reranker's scores."""
    asked = {"law": LAW} | {f"t{k}": f"{LAW} {' '.join(names)}" for k, names in enumerate(planning.EXPANSIONS["payment"].values())}
    d, e = retrieval.tallied(load("documents").select("doc_id", "text", "source"), asked, ["the th", "ION "]), load("embeddings")
    lex = lambda df, limit=150, name="law": retrieval.tally_lane(df, name, asked[name], limit, "doc_id")
    near = lambda df, limit=100: retrieval.dense(df, VECTOR, limit, id_column="vec_id")
    named = lambda lane, name: lane.withColumn("retriever", F.lit(name))
    exact = retrieval.reference_lane(d, 50, "doc_id")
    routed = saved(retrieval.fuse([lex(d, 50), exact, near(e, 50)], limit=30).select(F.col("id").alias("_id")))
    groups = d.groupBy(F.col("source").alias("id")).agg(F.sum("_n").alias("_n"), F.sum("_m_law").alias("_m"))
    best = saved(retrieval._matching(groups, len(retrieval.query_terms(LAW)), "lexical", 10).select(F.col("id").alias("source")))
    members = d.join(F.broadcast(best), "source", "left_semi")
    inside = lambda df, ids, key: df.join(ids, df[key] == ids[ids.columns[0]], "left_semi")
    translated = [named(lex(d, 50, f"t{k}"), "translated_lexical") for k in range(len(asked) - 1)]
    lanes = {
        "lexical": lex(d), "exact": exact, "dense": near(e), "lexical_scoped": lex(inside(d, F.broadcast(routed), "doc_id")), "lexical_collection": named(lex(members), "passage_lexical_collection"),
        "dense_scoped": named(near(inside(e, F.broadcast(routed), "vec_id")), "passage_dense_scoped"), "dense_collection": named(near(inside(e, members.select("doc_id"), "vec_id")), "passage_dense_collection"),
        "translated": translated[0].unionByName(translated[1]),
    }
    scores = load("labels").select(F.col("doc_id").alias("id"), F.col("quality").cast("double").alias("score"))
    return retrieval.variants(lanes, planning.VARIANTS, {"exact_reference": 2.0, "dense": 0.8}, scores=scores)


# a second pass for the questions that need one

ONCE = lambda p: p.replace("(?iu)", "(?i)").replace("'", "''")
INTENT_SQL = "CASE " + " ".join(f"WHEN regexp_matches(t, '{ONCE(p)}'){' OR len(refs) > 0' if name == 'exact_reference' else ''} THEN '{name}'" for name, p in planning.INTENTS) + " ELSE 'fact_lookup' END"
POLAR = [f"regexp_matches(lower(coalesce(text, '')), '{evidence.polarity_pattern(words)}')" for words in (evidence.POSITIVE, evidence.NEGATIVE)]


def _many_sql(asked: str, limit: int) -> str:
    """The lexical lanes of the rows (query, t) of a relation."""
    return f"""(SELECT query, rank, score, id FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM (
      SELECT query, id, round(m / sqrt(k::DOUBLE * n), 9) AS score FROM (SELECT query, k, id, n, count(*) AS m FROM p JOIN (SELECT query, len(u) AS k, unnest(u) AS term FROM (SELECT query, list_distinct({TOKENS.format('t')}) AS u FROM {asked})) USING (term) GROUP BY query, k, id, n))) WHERE rank <= {limit})"""


ITERATIVE = f"""WITH p AS (SELECT doc_id AS id, len(t) AS n, unnest(t) AS term FROM (SELECT doc_id, {TOKENS.format('text')} AS t FROM documents)),
w AS (SELECT item_id AS query, regexp_extract_all(lower(text), '[a-z]+') AS w FROM benchmark),
a AS (SELECT query, array_to_string(w[1:4], ' ') AS a, array_to_string(w[5:8], ' ') AS b FROM w),
q AS (SELECT query, CASE query % 3 WHEN 0 THEN 'compare ' || a || ' versus ' || b WHEN 1 THEN 'why did ' || a || ' fail' ELSE a || ' ' || b END AS t FROM a),
r AS (SELECT query, t, list_distinct(list_concat(regexp_extract_all(t, '{ONCE(planning.REFERENCES[0])}'), regexp_extract_all(t, '{ONCE(planning.REFERENCES[2])}'))) AS refs FROM q),
i AS (SELECT query, t, refs, {INTENT_SQL} AS intent FROM r),
first AS (SELECT query, row_number() OVER (PARTITION BY query ORDER BY fusion DESC, score DESC, id) AS rank, id, fusion, score FROM (SELECT query, id, round(1.0 / (60 + rank), 9) AS fusion, score, rank FROM {_many_sql('q', 150)}) WHERE rank <= 100),
h AS (SELECT query, count(*) AS n, count(DISTINCT id) AS docs, bool_or(rank <= 30 AND {POLAR[0]}) AS yes, bool_or(rank <= 30 AND {POLAR[1]}) AS no FROM first JOIN documents ON doc_id = id GROUP BY query),
v AS (SELECT query, t, refs, intent, coalesce(n, 0) AS n, CASE WHEN coalesce(n, 0) < CASE WHEN intent IN ('comparison', 'diagnostic') THEN 2 ELSE 1 END OR intent = 'exact_reference' THEN 'insufficient' WHEN docs >= 2 AND yes AND no THEN 'conflicting' ELSE 'sufficient' END AS status FROM i LEFT JOIN h USING (query)),
c AS (SELECT *, CASE intent WHEN 'comparison' THEN list_filter(list_transform(regexp_split_to_array(t, '{ONCE(planning.APART)}'), lambda x: trim(regexp_replace(x, '{ONCE(planning.COMPARING)}', '', 'g'))), lambda x: len(regexp_split_to_array(x, '\\s+')) >= 2)[1:3]
      WHEN 'diagnostic' THEN list_concat(refs[1:3], [t || ' root cause', t || ' fix workaround resolution']) WHEN 'broad_synthesis' THEN [] ELSE refs[1:3] END AS raw FROM v),
d AS (SELECT *, list_filter(raw, lambda x, k: x <> '' AND x <> t AND list_position(raw, x) = k)[1:4] AS parts FROM c WHERE intent IN ('comparison', 'diagnostic') OR status <> 'sufficient'),
e AS (SELECT query, t, n, list_concat(parts, CASE WHEN status = 'conflicting' THEN [t || ' current authoritative version effective date'] ELSE [] END) AS asked FROM d),
f AS (SELECT query, CASE WHEN len(asked) = 0 AND n < 3 THEN [t || ' supporting evidence explanation'] ELSE asked[1:4] END AS asked FROM e),
u AS (SELECT query, unnest(asked) AS t, unnest(range(1, len(asked) + 1)) AS k FROM f WHERE len(asked) > 0),
s AS (SELECT query.query AS query, query.k AS k, rank, score, id FROM {_many_sql('(SELECT {query: query, k: k} AS query, t FROM u)'.replace('{query: query, k: k}', "struct_pack(query := query, k := k)"), 100)}),
two AS (SELECT query, id, round(sum(1.0 / (60 + rank)), 9) AS fusion, max(score) AS score FROM (SELECT query, rank, score, id FROM first WHERE query IN (SELECT query FROM u) UNION ALL SELECT query, rank, score, id FROM s) GROUP BY query, id)
SELECT query, rank, id, fusion, score, 1 AS passes FROM first WHERE query NOT IN (SELECT query FROM u)
UNION ALL SELECT * FROM (SELECT query, row_number() OVER (PARTITION BY query ORDER BY fusion DESC, score DESC, id) AS rank, id, fusion, score, 2 AS passes FROM two) WHERE rank <= 100"""


@query("iterative_retrieval", ITERATIVE)
def _(spark, load):
    """Questions made of the benchmark's words: comparisons, diagnoses and plain ones, of which some lack evidence."""
    w = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))
    a, b = F.array_join(F.slice(w, 1, 4), " "), F.array_join(F.slice(w, 5, 4), " ")
    kind = F.col("item_id") % 3
    text = F.when(kind == 0, F.concat(F.lit("compare "), a, F.lit(" versus "), b)).when(kind == 1, F.concat(F.lit("why did "), a, F.lit(" fail"))).otherwise(F.concat_ws(" ", a, b))
    d = load("documents")
    found = passes.searched(load("benchmark").select(F.col("item_id").alias("id"), text.alias("text")), postings.build(d, {"text": "B"}, "doc_id"), d.select(F.col("doc_id").alias("id"), F.col("doc_id").alias("document_id"), F.lit(None).cast("long").alias("section_id"), "text"))
    return found.select("query", "rank", "id", "fusion", "score", "passes")
