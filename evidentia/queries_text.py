"""Queries over documents as Markdown: whole texts, a unit for every line, by a rule that SQL states too."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from .operators import markdown, retrieval, shelves
from .queries import LEX, QUESTION, _lane, query

#: What the lines of a text become in turn, {x} being a line without marks: heading, paragraph, underlined heading, list, table, code.
#: {h} is # to ###, {u} a line of = or -, both by the number of the line.
RULE = ("{h} {x}\n", "{x}\n\n", "{x}\n{u}\n\n", "- {x}\n- {x}\n\n", "| {x} | b |\n|---|---|\n| {x} | 2 |\n\n", "```\n# {x}\n\n```\n")
TYPES = ("heading", "paragraph", "paragraph", "list", "table", "code")
FRONT = "---\ntype: {a}\njurisdiction: P{k}\nparties:\n- \"{b}\"\n- B\nvalid_from: 2024-01-0{d}\nvalid_to: {a}\n---\n"


def _filled(template: str, values: dict):
    return reduce(lambda t, v: F.replace(t, F.lit("{" + v[0] + "}"), v[1]), values.items(), F.lit(template))


def _markdown(load):
    """Every text with front matter and, for line i of it, the i-th shape of RULE in turn."""
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[A-Za-z]+"), F.lit(0))
    word = lambda k: F.coalesce(F.try_element_at(words, F.lit(k)), F.lit("none"))
    front = _filled(FRONT, {"a": word(1), "b": word(2), "k": F.col("doc_id").cast("string"), "d": (F.col("doc_id") % 9 + 1).cast("string")})

    def shaped(line, i):
        x = F.concat(F.lit("w "), F.trim(F.regexp_replace(line, r"[^\p{L}\p{N}]+", " ")))
        turn = F.floor(i / len(RULE))
        values = {"h": F.repeat(F.lit("#"), (turn % 3 + 1).cast("int")), "u": F.when(turn % 2 == 0, "===").otherwise("---"), "x": x}
        return reduce(lambda rest, k: F.when(i % len(RULE) == k, _filled(RULE[k], values)).otherwise(rest), range(len(RULE)), F.lit(""))

    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n", -1), shaped)
    return load("documents").select("doc_id", F.concat(front, F.array_join(lines, "")).alias("text"))


def _sql_text(template: str, values: dict[str, str]) -> str:
    quoted = "'" + template.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
    return reduce(lambda t, v: f"replace({t}, '{{{v[0]}}}', {v[1]})", values.items(), quoted)


_WORD = lambda k: f"coalesce(regexp_extract_all(coalesce(text, ''), '[A-Za-z]+')[{k}], 'none')"
_SHAPES = "CASE i % 6 " + " ".join(f"WHEN {k} THEN {_sql_text(t, {'h': 'repeat(chr(35), (i // 6 % 3 + 1)::INT)', 'u': 'CASE WHEN i // 6 % 2 = 0 THEN repeat(chr(61), 3) ELSE repeat(chr(45), 3) END', 'x': 'x'})}" for k, t in enumerate(RULE)) + " END"
#: id, ordinal, type, level, x and text of every unit, the front matter first; then with bytes and lines, and with sections.
UNITS = f"""SELECT id, i + 1 AS ordinal, ['{"', '".join(TYPES)}'][i % 6 + 1] AS type, CASE i % 6 WHEN 0 THEN i // 6 % 3 + 1 WHEN 2 THEN i // 6 % 2 + 1 END AS level, x, {_SHAPES} AS text FROM (
  SELECT id, i, 'w ' || trim(regexp_replace(line, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) AS x FROM (SELECT id, unnest(l) AS line, unnest(range(0, len(l))) AS i FROM (SELECT doc_id AS id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)))
UNION ALL SELECT doc_id, 0, 'front_matter', NULL, NULL, {_sql_text(FRONT, {'a': _WORD(1), 'b': _WORD(2), 'k': 'doc_id::VARCHAR', 'd': "(doc_id % 9 + 1)::VARCHAR"})} FROM documents"""
PLACED = f"""SELECT *, sum(strlen(text)) OVER w::BIGINT AS end_byte, sum(length(text) - length(replace(text, chr(10), ''))) OVER w::BIGINT AS end_line, count(level) OVER w AS section FROM ({UNITS}) WINDOW w AS (PARTITION BY id ORDER BY ordinal)"""


@query("markdown_units", f"SELECT id, ordinal, section, type, level, md5(text) AS digest, end_byte - strlen(text) AS start_byte, end_byte, end_line FROM ({PLACED})")
def _(spark, load):
    return markdown.units(_markdown(load), id_column="doc_id").select("id", "ordinal", "section", "type", "level", F.md5("text").alias("digest"), "start_byte", "end_byte", "end_line")


@query("markdown_units_of_pieces", f"SELECT id, ordinal, section, type, md5(text) AS digest, end_byte - strlen(text) AS start_byte, end_byte FROM ({PLACED})")
def _(spark, load):
    """The same units where documents come in pieces of 1 kB, cut anywhere."""
    found = markdown.units_of_pieces(markdown.pieces(_markdown(load), 1024, id_column="doc_id"))
    return found.select("id", "ordinal", "section", "type", F.md5("text").alias("digest"), "start_byte", "end_byte")


@query("markdown_sections", f"SELECT id, section, max(level)::INT AS level, max(CASE WHEN level IS NOT NULL THEN x END) AS heading, min(end_line - length(text) + length(replace(text, chr(10), '')) + 1)::BIGINT AS first_line, max(end_line) AS last_line, min(end_byte - strlen(text))::BIGINT AS start_byte, max(end_byte) AS end_byte FROM ({PLACED}) GROUP BY id, section")
def _(spark, load):
    return markdown.sections(_markdown(load), id_column="doc_id").drop("path")


PATHS = f"""WITH RECURSIVE h AS (SELECT id, section, level, x, row_number() OVER (PARTITION BY id ORDER BY ordinal) AS n FROM ({PLACED}) WHERE level IS NOT NULL),
p AS (SELECT id, n, section, [x] AS path FROM h WHERE n = 1 UNION ALL SELECT h.id, h.n, h.section, list_append(p.path[1:h.level - 1], h.x) FROM p JOIN h ON h.id = p.id AND h.n = p.n + 1)"""


@query("markdown_heading_paths", f"{PATHS} SELECT id, section, md5(array_to_string(path, ' > ')) AS path, len(path)::INT AS depth FROM p")
def _(spark, load):
    found = markdown.sections(_markdown(load), id_column="doc_id").where("level is not null")
    return found.select("id", "section", F.md5(F.array_join("path", " > ")).alias("path"), F.size("path").alias("depth"))


#: Packing up to 200 tokens, by sections; nothing is as long as the hard limit, so no unit is split.
PACKED = f"""WITH RECURSIVE u AS (SELECT id, section, ordinal, type, text, end_byte, greatest(1, ceil(length(text) / 4.0))::INT AS tokens, type IN ('code', 'table') AS apart, row_number() OVER (PARTITION BY id, section ORDER BY ordinal) AS n FROM ({PLACED}) WHERE type <> 'front_matter'),
r AS (SELECT id, section, n, 0 AS passage, tokens AS held, type, apart, ordinal FROM u WHERE n = 1
UNION ALL SELECT u.id, u.section, u.n, r.passage + CASE WHEN (u.type <> r.type AND (u.apart OR r.apart)) OR r.held + u.tokens > 200 THEN 1 ELSE 0 END,
  CASE WHEN (u.type <> r.type AND (u.apart OR r.apart)) OR r.held + u.tokens > 200 THEN u.tokens ELSE r.held + u.tokens END, u.type, u.apart, u.ordinal FROM r JOIN u ON u.id = r.id AND u.section = r.section AND u.n = r.n + 1)
SELECT id, section, passage, md5(string_agg(text, '' ORDER BY ordinal)) AS digest, min(end_byte - strlen(text))::BIGINT AS start_byte, max(end_byte) AS end_byte FROM r JOIN u USING (id, section, ordinal) GROUP BY id, section, passage"""


@query("markdown_passages", PACKED)
def _(spark, load):
    found = markdown.passages(_markdown(load), id_column="doc_id", target=200, hard=100_000)
    return found.select("id", "section", "passage", F.md5("text").alias("digest"), "start_byte", "end_byte")


@query("markdown_front_matter", f"SELECT doc_id, {_WORD(1)} AS document_type, 'P' || doc_id AS jurisdiction, {_WORD(2)} || ',B' AS parties, '2024-01-0' || (doc_id % 9 + 1) AS valid_from, NULL::VARCHAR AS valid_to FROM documents")
def _(spark, load):
    found = _markdown(load).select("doc_id", markdown.front_matter(F.col("text")).alias("f"))
    return found.select("doc_id", "f.document_type", "f.jurisdiction", F.array_join("f.parties", ",").alias("parties"), "f.valid_from", "f.valid_to")


# scopes, listings and what is kept about them

ROWS = """SELECT doc_id AS document, doc_id AS section, 'w' || doc_id % 2 AS workspace, 'c' || doc_id % 3 AS context, 'g' || (doc_id % 5 > 0)::INT AS generation, CASE doc_id % 3 WHEN 0 THEN ['a'] WHEN 1 THEN ['a', 'b'] ELSE ['c'] END AS acl_tokens,
  CASE WHEN doc_id % 2 = 0 THEN 'Contract' ELSE 'policy' END AS document_type, upper(lang) AS jurisdiction, CASE WHEN doc_id % 7 <> 0 THEN DATE '2024-01-01' + CAST(doc_id % 700 AS INT) END AS valid_from, CASE WHEN doc_id % 4 <> 0 THEN DATE '2024-06-01' + CAST(doc_id % 900 AS INT) END AS valid_to, source FROM documents"""


def _scoped(load):
    k = F.col("doc_id")
    tokens = F.when(k % 3 == 0, F.array(F.lit("a"))).when(k % 3 == 1, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("c")))
    day = lambda start, n: F.date_add(F.lit(start).cast("date"), (k % n).cast("int"))
    return load("documents").select(
        k.alias("document"), k.alias("section"), F.concat(F.lit("w"), (k % 2).cast("string")).alias("workspace"), F.concat(F.lit("c"), (k % 3).cast("string")).alias("context"), F.concat(F.lit("g"), (k % 5 > 0).cast("int").cast("string")).alias("generation"),
        tokens.alias("acl_tokens"), F.when(k % 2 == 0, "Contract").otherwise("policy").alias("document_type"), F.upper("lang").alias("jurisdiction"), F.lit(None).cast("date").alias("publication_date"),
        F.when(k % 7 != 0, day("2024-01-01", 700)).alias("valid_from"), F.when(k % 4 != 0, day("2024-06-01", 900)).alias("valid_to"), "source",
    )


@query("scope_filters", f"SELECT document FROM ({ROWS}) WHERE workspace = 'w1' AND context = 'c1' AND generation = 'g1' AND list_has_any(acl_tokens, ['b', 'x']) AND lower(document_type) IN ('policy', 'note') AND lower(jurisdiction) IN ('en', 'fr') AND (valid_from IS NULL OR valid_from <= DATE '2025-03-01') AND (valid_to IS NULL OR valid_to >= DATE '2025-03-01') AND source IN ('src1', 'src3', 'src7') AND section < 900")
def _(spark, load):
    rows = _scoped(load)
    members = rows.select(F.col("source").alias("collection"), "document")
    scope = shelves.Scope("w1", "c1", "g1", ("b", "x"), None, ("src1", "src3", "src7"), None, ("Policy", "note"), ("en", "FR"), "2025-03-01")
    return shelves.in_scope(rows.where("section < 900"), scope, members).select("document")


MARKED = f"SELECT id, string_agg(text, '' ORDER BY ordinal) AS text FROM ({UNITS}) GROUP BY id"
CLAUSE_SQL = shelves.CLAUSE_LINE.replace("(?iu)", "(?i)")


@query("line_inspection", f"""WITH l AS (SELECT id, i, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS x FROM (SELECT id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS i FROM ({MARKED}))),
m AS (SELECT id, i, x, regexp_matches(x, '^\\|.*\\|$') AS t, sum((x = '')::INT) OVER (PARTITION BY id ORDER BY i) AS run FROM l), n AS (SELECT *, coalesce(lag(t) OVER (PARTITION BY id ORDER BY i), false) AS before FROM m)
SELECT id, count(*) FILTER (regexp_matches(x, '^#{{1,6}}[ \\t]+'))::INT AS headings, count(*) FILTER (regexp_matches(x, '{CLAUSE_SQL}'))::INT AS clauses, count(DISTINCT run) FILTER (x <> '' AND NOT t)::INT AS paragraphs, count(*) FILTER (t AND NOT before)::INT AS tables FROM n GROUP BY id""")
def _(spark, load):
    return shelves.inspected(_markdown(load), id_column="doc_id")


WANTED = "Which pages say the TION, the ing or une thing_1?"
HAY = "lower(source || '/' || doc_id || chr(10) || coalesce(text, ''))"


SAID = " + ".join(f"len(regexp_extract_all({HAY}, '\\b{t}\\b'))" for t in shelves.expert_terms(WANTED))


@query("expert_files", f"SELECT row_number() OVER (ORDER BY score DESC, path) AS rank, path, score FROM (SELECT source || '/' || doc_id AS path, {SAID} AS score FROM documents) ORDER BY rank LIMIT 40")
def _(spark, load):
    files = load("documents").select(F.concat_ws("/", "source", "doc_id").alias("path"), F.col("text").alias("content"))
    return shelves.expert_files(files, WANTED, 40)


PATHS_SQL = "SELECT source || '/' || CASE WHEN doc_id % 5 = 0 THEN '.git/' WHEN doc_id % 7 = 0 THEN 'node_modules/x/' ELSE lang || '/' END || doc_id % 50 || '/f' || doc_id AS path, n_chars AS size FROM documents"


def _paths(load):
    k = F.col("doc_id")
    folder = F.when(k % 5 == 0, ".git/").when(k % 7 == 0, "node_modules/x/").otherwise(F.concat("lang", F.lit("/")))
    return load("documents").select(F.concat("source", F.lit("/"), folder, (k % 50).cast("string"), F.lit("/f"), k.cast("string")).alias("path"), F.col("n_chars").alias("size"))


@query("expert_scan", f"SELECT path, size FROM ({PATHS_SQL}) WHERE path NOT LIKE '%/.git/%' AND path NOT LIKE '%/node_modules/%' AND size <= 5000")
def _(spark, load):
    return shelves.expert_scan(_paths(load), 5000)


@query("folder_tree", f"""WITH p AS (SELECT string_split(path, '/') AS s, size FROM ({PATHS_SQL})), a AS (SELECT s, size, unnest(range(1, len(s) + 1)) AS k FROM p)
SELECT array_to_string(s[1:k], '/') AS path, any_value(s[k]) AS name, k::INT AS depth, CASE WHEN max(len(s)) > k THEN 'folder' ELSE 'file' END AS kind, count(*) AS files, sum(size)::BIGINT AS bytes FROM a GROUP BY array_to_string(s[1:k], '/'), k""")
def _(spark, load):
    return shelves.tree(_paths(load))


@query("session_list", "SELECT conv_id AS id, 'S' || conv_id AS title, substr(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')), 1, 80) AS preview, TIMESTAMP '2024-01-01' + to_days((conv_id % 40)::INT) AS updated_at FROM conversations WHERE turn = 0 AND conv_id % 3 <> 0")
def _(spark, load):
    k = F.col("conv_id")
    status = F.when(k % 3 == 0, "archived").otherwise("open")
    rows = load("conversations").where("turn = 0").select(k.alias("id"), F.concat(F.lit("S"), k).alias("title"), status.alias("status"), F.date_add(F.lit("2024-01-01").cast("date"), (k % 40).cast("int")).cast("timestamp_ntz").alias("updated_at"), "text")
    return shelves.sessions(rows)


@query("source_registry", """SELECT coalesce(s.source_id, e.source_id) AS source_id, name, owner, version, health, coalesce(accesses, 0) AS accesses, last_event FROM
  (SELECT 's' || c_custkey AS source_id, c_name AS name, c_mktsegment AS owner FROM customer WHERE c_custkey % 2 = 0) s FULL JOIN
  (SELECT 's' || user_id AS source_id, arg_max('v' || event_id, (ts, event_id)) FILTER (event_type = 'purchase') AS version, arg_max(CASE WHEN value > 20 THEN 'bad' ELSE 'good' END, (ts, event_id)) FILTER (event_type = 'error') AS health, count(*) FILTER (event_type NOT IN ('purchase', 'error')) AS accesses, max(ts) AS last_event FROM events GROUP BY 1) e ON s.source_id = e.source_id""")
def _(spark, load):
    e = load("events")
    kind = F.when(F.col("event_type") == "purchase", "version").when(F.col("event_type") == "error", "health").otherwise("access")
    rows = e.select(
        F.concat(F.lit("s"), "user_id").alias("source_id"), kind.alias("kind"), F.when(kind == "version", F.concat(F.lit("v"), "event_id")).alias("version"), F.when(kind == "health", F.when(F.col("value") > 20, "bad").otherwise("good")).alias("health"), F.col("ts").alias("at"), F.col("event_id").alias("seq")
    )
    sources = load("customer").where("c_custkey % 2 = 0").select(F.concat(F.lit("s"), "c_custkey").alias("source_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("owner"), F.lit(0).alias("updated_at"))
    return shelves.registered(sources, rows)


@query("retrieval_audit", f"SELECT 'run-1' AS run_id, id, rank, rank % 3 = 0 AS selected, CASE WHEN rank % 3 = 1 THEN 'document cap' END AS reason FROM {_lane('lexical', LEX, 100)}")
def _(spark, load):
    hits = retrieval.lexical(load("documents"), QUESTION, 100, id_column="doc_id").select("id", "rank")
    return shelves.audited(hits, hits.where("rank % 3 = 0").select("id"), hits.where("rank % 3 < 2").select("id", F.lit("document cap").alias("reason")), "run-1")


def _stores(load):
    d, e = load("documents"), load("events")
    store = d.where("doc_id % 2 = 0").select(F.col("source").alias("namespace"), F.col("doc_id").alias("id"), F.md5("text").alias("doc"))
    legacy = d.select(F.col("source").alias("namespace"), F.col("doc_id").alias("id"), F.concat(F.lit("old "), F.md5("text")).alias("doc"))
    return store, legacy, d.where(F.col("source").isin("src1", "src2")).select(F.col("source").alias("namespace"), F.lit(7).cast("long").alias("n")).distinct()


@query("legacy_import", "SELECT source AS namespace, doc_id AS id, CASE WHEN doc_id % 2 = 0 THEN md5(text) ELSE 'old ' || md5(text) END AS doc FROM documents WHERE doc_id % 2 = 0 OR source NOT IN ('src1', 'src2')")
def _(spark, load):
    return shelves.imported(*_stores(load))[0]


@query("legacy_ledger", "SELECT source AS namespace, CASE WHEN source IN ('src1', 'src2') THEN 7 ELSE count(*) END AS n FROM documents GROUP BY 1")
def _(spark, load):
    return shelves.imported(*_stores(load))[1]


@query("memory_fingerprint", "SELECT source, count(*)::INT AS n, sha256(string_agg(md5(text), chr(0) ORDER BY md5(text))) AS fingerprint FROM documents GROUP BY 1")
def _(spark, load):
    return shelves.memory_fingerprint(load("documents").select("source", F.md5("text").alias("h")), "source", "h")


def _answers(load):
    e = load("embeddings")
    one = lambda name, order: e.orderBy(*order).limit(80).select(F.lit("w").alias("workspace_id"), F.lit(name).alias("source_id"), F.col("vec_id").alias("id"), F.row_number().over(Window.orderBy(*order)).alias("rank"))
    return [one("a", [F.col("label"), F.col("vec_id")]), one("b", [F.col("vec_id").desc()]), one("c", [F.col("vec_id")])]


FED = "SELECT 'w' AS workspace_id, '{0}' AS source_id, vec_id AS id, row_number() OVER (ORDER BY {1}) AS rank FROM embeddings ORDER BY {1} LIMIT 80"
FEDERATED = " UNION ALL ".join(f"SELECT * FROM ({FED.format(n, o)})" for n, o in (("a", "label, vec_id"), ("c", "vec_id")))


@query("federation_isolated", f"SELECT * FROM (SELECT workspace_id, source_id, id, round(sum(1.0 / (60 + rank)), 9) AS score FROM ({FEDERATED}) GROUP BY 1, 2, 3 ORDER BY score DESC, id, source_id, workspace_id LIMIT 50)")
def _(spark, load):
    """Source b fails: its hits do not count, the others' do."""
    return shelves.federated(_answers(load), spark.createDataFrame([("b", "timeout")], "source_id string, reason string"), ["a", "b", "c", "d"])[0]


@query("federation_states", f"SELECT source_id, CASE source_id WHEN 'b' THEN 'failed' ELSE 'ok' END AS state, CASE source_id WHEN 'b' THEN 'timeout' END AS reason, coalesce(n, 0) AS hits FROM (SELECT unnest(['a', 'b', 'c', 'd']) AS source_id) LEFT JOIN (SELECT source_id, count(*) AS n FROM ({FEDERATED}) GROUP BY 1) USING (source_id)")
def _(spark, load):
    return shelves.federated(_answers(load), spark.createDataFrame([("b", "timeout")], "source_id string, reason string"), ["a", "b", "c", "d"])[1]
