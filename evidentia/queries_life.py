"""Queries over what a corpus and its runs live through: knowledge, narrowing, skills, scans, citations, censuses, traces."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .functions import entities as ent
from .functions import text as tx
from .operators import census, citations, corpus, govern, knowledge, narrowing, reconcile, retrieval, skills
from .queries import QUERIES, SQL, query
from .session import saved
from .sources import tables
from .streaming import events as streaming
from .streaming import traces

# knowledge: every fourth line of a text is a heading, of a level by the line's number

TERMS = ["tion", "The", "ing"]


def _entries(load):
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda line, i: F.when(i % 4 == 1, F.concat(F.repeat(F.lit("#"), (i % 5 + 1).cast("int")), F.lit(" "), line)).otherwise(line))
    return load("documents").select(F.col("doc_id").alias("id"), F.array(F.concat_ws(" ", "source", "lang"), F.concat(F.lit("Doc-No. "), F.col("doc_id"))).alias("entities"), F.array_join(lines, "\n").alias("content"))


SAID = " + ".join(f"(length(lower(s)) - length(replace(lower(s), '{t.lower()}', ''))) // {len(t)}" for t in TERMS)
HELD = " + ".join(f"contains(lower(regexp_extract(s, '^(#{{1,3}})\\s+(.+)', 2)), '{t.lower()}')::INT" for t in TERMS)
CONTENT = f"""SELECT doc_id AS id, sum(CASE WHEN regexp_matches(s, '^#{{1,3}}\\s+.') THEN ({HELD}) * CASE length(regexp_extract(s, '^(#+)', 1)) WHEN 1 THEN 20 WHEN 2 THEN 10 ELSE 5 END ELSE {SAID} END)::BIGINT AS score
  FROM (SELECT doc_id, CASE WHEN i % 4 = 1 THEN repeat('#', i % 5 + 1) || ' ' || line ELSE line END AS s FROM (SELECT doc_id, unnest(l) AS line, unnest(range(0, len(l))) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))) GROUP BY doc_id"""


@query("knowledge_scores", f"SELECT id, doc_id % 10 = 7 AND false AS named, score FROM ({CONTENT}) JOIN documents ON doc_id = id")
def _(spark, load):
    return knowledge.scored(_entries(load), TERMS)


COMPETING = f"SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS k, lead(score) OVER (ORDER BY score DESC, id) AS second FROM ({CONTENT}) WHERE score > 0"


@query("knowledge_search", f"SELECT 1 AS rank, id, score::DOUBLE AS score, CASE WHEN second IS NULL OR score >= 2 * second THEN 'content' ELSE 'fallback' END AS step FROM ({COMPETING}) WHERE k = 1")
def _(spark, load):
    return knowledge.search(_entries(load), TERMS)


@query("knowledge_search_named", "SELECT 1 AS rank, doc_id AS id, score::DOUBLE AS score, 'entity' AS step FROM documents JOIN (" + CONTENT.replace("tion", "doc no 17x").replace("// 4", "// 10").replace("'the'", "'docno17x'") + ") ON doc_id = id WHERE false UNION ALL SELECT 1, 17, 0.0, 'entity'")
def _(spark, load):
    """Names of one document alone: `Doc-No. 17` and nothing longer, as the ids after it are left out."""
    return knowledge.search(_entries(load).where("id < 170 and id not in (1, 7)"), ["doc no 17"])


RERANKED = f"""WITH c AS ({COMPETING}), f AS (SELECT score < 2 * second AS open FROM c WHERE k = 1),
r AS (SELECT c.id, coalesce(s, 0)::DOUBLE AS s FROM c LEFT JOIN (SELECT doc_id AS id, max(quality * 10 + doc_id % 7) AS s FROM labels GROUP BY 1) USING (id) WHERE (SELECT open FROM f)),
u AS (SELECT id, s, sum(s) OVER (ORDER BY s DESC, id) - s AS before, sum(s) OVER () AS total FROM r WHERE s > 0)
SELECT row_number() OVER (ORDER BY s DESC, id)::INT AS rank, id, s AS score, 'rerank' AS step FROM u WHERE before < 0.5 * total"""


@query("knowledge_search_reranked", RERANKED)
def _(spark, load):
    scores = load("labels").select(F.col("doc_id").alias("id"), (F.col("quality") * 10 + F.col("doc_id") % 7).cast("double").alias("score"))
    return knowledge.search(_entries(load), TERMS, scores)


# narrowing

PASSAGES = "SELECT doc_id AS version, unnest(range(0, len(c))) AS ordinal, unnest(c) AS text FROM (SELECT doc_id, list_transform(range(0, greatest(1, ceil(length(coalesce(text, '')) / 2000.0)::BIGINT)), lambda i: substr(coalesce(text, ''), i * 2000 + 1, 2000)) AS c FROM documents)"


def _passages(load):
    pieces = load("documents").select(F.col("doc_id").alias("version"), F.posexplode(tx.chunk_list(F.coalesce("text", F.lit("")))).alias("ordinal", "text"))
    return pieces.withColumn("acl_tokens", F.array(F.when(F.col("version") % 3 == 0, "a").otherwise("b")))


@query("grep_versions", f"SELECT rank, version, ordinal, md5(text) AS digest FROM (SELECT *, row_number() OVER (ORDER BY version, ordinal) AS rank, sum(strlen(text)) OVER (ORDER BY version, ordinal) AS upto FROM (SELECT * FROM ({PASSAGES}) WHERE version < 40 AND version % 3 <> 0 AND regexp_matches(text, '(?i)[aeiou]TION\\b.*the') ORDER BY version, ordinal LIMIT 100)) WHERE upto <= 60000")
def _(spark, load):
    return narrowing.grep_versions(_passages(load), list(range(40)), r"[aeiou]TION\b.*the", 500, ["b", "c"], 60_000).select("rank", "version", "ordinal", F.md5("text").alias("digest"))


@query("running_totals", "SELECT l_orderkey, l_linenumber, l_returnflag, sum(l_quantity) OVER (PARTITION BY l_returnflag ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity ROWS UNBOUNDED PRECEDING) AS upto FROM lineitem")
def _(spark, load):
    """Three groups hold all rows: each spreads over many ranges."""
    rows = load("lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_shipdate", "l_partkey", "l_suppkey", "l_quantity")
    return narrowing.running_totals(rows, ["l_returnflag"], [F.col(c) for c in ("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")], F.col("l_quantity")).select("l_orderkey", "l_linenumber", "l_returnflag", "upto")


# skills: events are facts, customers' segments stand for skills

NOW = "2024-01-20 00:00:00"
FACTS = "SELECT event_id AS id, ts AS created_at, CASE WHEN event_id % 6 = 0 THEN 'old' END AS skill, CASE WHEN event_id % 5 = 0 THEN ts + INTERVAL 10 DAY END AS ignore_until FROM events"
SCORES = "SELECT event_id AS fact_id, event_type || (event_id * k) % 3 AS skill, round(((event_id * (k + 3) * 7) % 101) / 100.0, 2) AS score FROM events, (SELECT unnest([1, 2, 4]) AS k) WHERE event_id % 11 <> 0"


def _facts(load):
    e = load("events")
    day10 = F.expr("ts + INTERVAL 10 DAYS")
    facts = e.select(F.col("event_id").alias("id"), F.col("ts").alias("created_at"), F.when(F.col("event_id") % 6 == 0, "old").alias("skill"), F.when(F.col("event_id") % 5 == 0, day10).alias("ignore_until"))
    every = e.where("event_id % 11 <> 0").select("event_id", "event_type", F.explode(F.array(F.lit(1), F.lit(2), F.lit(4))).alias("k"))
    score = F.round(((F.col("event_id") * (F.col("k") + 3) * 7) % 101) / 100.0, 2)
    return facts, every.select(F.col("event_id").alias("fact_id"), F.concat("event_type", ((F.col("event_id") * F.col("k")) % 3).cast("string")).alias("skill"), score.alias("score"))


@query("skill_routes", f"""WITH b AS (SELECT fact_id, arg_min(skill, (-score, skill)) AS skill, max(score) AS score FROM ({SCORES}) GROUP BY 1),
o AS (SELECT id, created_at FROM ({FACTS}) WHERE skill IS NULL AND (ignore_until IS NULL OR ignore_until <= TIMESTAMP '{NOW}')),
d AS (SELECT id, created_at, skill, CASE WHEN score >= 0.75 THEN 'strong' WHEN score >= 0.4 THEN 'weak' ELSE 'none' END AS decision FROM o LEFT JOIN b ON fact_id = id)
SELECT id, decision, CASE decision WHEN 'strong' THEN skill WHEN 'none' THEN '__none__' END AS skill, CASE WHEN decision = 'strong' THEN (row_number() OVER (PARTITION BY decision, skill ORDER BY created_at, id) - 1) // 5 END::INT AS cluster, CASE WHEN decision = 'weak' THEN TIMESTAMP '{NOW}' + INTERVAL 3 DAY END AS ignore_until FROM d""")
def _(spark, load):
    facts, scores = _facts(load)
    return skills.routed(facts, scores, F.lit(NOW).cast("timestamp_ntz"), 3 * 86_400)


# guarded reconcile

KNOWN = "SELECT source AS root, 'd/' || (doc_id % 700) AS path, md5(max(text)) AS fingerprint FROM documents WHERE doc_id % 5 <> 0 GROUP BY 1, 2"
SEEN = "SELECT source AS root, 'd/' || (doc_id % 700) AS path, md5(max(CASE WHEN doc_id % 4 = 0 THEN text || '+' ELSE text END)) AS fingerprint FROM documents WHERE doc_id % 3 <> 0 GROUP BY 1, 2"
SCANS = "SELECT DISTINCT source AS root, NOT (source LIKE '%1' OR source LIKE '%4') AS available, source NOT LIKE '%2' AS complete FROM documents WHERE source NOT LIKE '%3'"


def _scan(load):
    d, s = load("documents").withColumn("path", F.concat(F.lit("d/"), (F.col("doc_id") % 700).cast("string"))), F.col("source")
    of = lambda df, text: df.groupBy(s.alias("root"), "path").agg(F.md5(F.max(text)).alias("fingerprint"))
    scans = d.where(~s.like("%3")).select(s.alias("root"), (~(s.like("%1") | s.like("%4"))).alias("available"), (~s.like("%2")).alias("complete")).distinct()
    return of(d.where("doc_id % 5 <> 0"), F.col("text")), of(d.where("doc_id % 3 <> 0"), F.when(F.col("doc_id") % 4 == 0, F.concat("text", F.lit("+"))).otherwise(F.col("text"))), scans


ACTIONS = f"""SELECT root, path, CASE WHEN n.fingerprint IS NULL THEN CASE WHEN coalesce(available AND complete, false) THEN 'delete' ELSE 'hold' END WHEN o.fingerprint IS NULL THEN 'add' WHEN o.fingerprint = n.fingerprint THEN 'keep' ELSE 'update' END AS action
FROM ({KNOWN}) o FULL JOIN ({SEEN}) n USING (root, path) LEFT JOIN ({SCANS}) USING (root)"""


@query("reconcile_actions", ACTIONS)
def _(spark, load):
    return reconcile.actions(*_scan(load))


@query("reconcile_applied", f"SELECT root, path, coalesce(CASE WHEN action IN ('keep', 'hold') THEN o.fingerprint END, n.fingerprint) AS fingerprint FROM ({ACTIONS}) LEFT JOIN ({KNOWN}) o USING (root, path) LEFT JOIN ({SEEN}) n USING (root, path) WHERE action <> 'delete'")
def _(spark, load):
    return reconcile.applied(*_scan(load))


# citations: a text's words as sources at several depths

CITED = "SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+') AS w FROM documents"


@query("deep_citations", f"""SELECT id, len(s)::INT AS n, array_to_string(s[1:100], ',') AS sources FROM (SELECT doc_id AS id, list_sort(list_distinct(list_concat(CASE WHEN doc_id % 3 <> 0 THEN ['top' || doc_id] ELSE [] END, list_transform(w, lambda x: lower(x[1:4]))))) AS s FROM ({CITED}))""")
def _(spark, load):
    """Every word is a source, an odd one of them in a list inside; one at the top cites by a null, two of another shape do not."""
    w = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[A-Za-z]+"), F.lit(0))
    name = lambda x: F.lower(F.substring(x, 1, 4))
    deep = F.to_json(F.struct(F.lit("no").alias("sourceId"), F.transform(w, lambda x: F.struct(F.array(F.struct(name(x).alias("sourceId"), F.lit(1).alias("versionId"))).alias("inner"))).alias("items")))
    top = F.when(F.col("doc_id") % 3 != 0, F.concat(F.lit('{"sourceId":"top'), F.col("doc_id"), F.lit('","citation":null}'))).otherwise(F.lit('{"sourceId":5,"citation":"x"}'))
    found = load("documents").select(F.col("doc_id").alias("id"), F.concat(F.lit("["), deep, F.lit(","), top, F.lit(',[[{"a":"b"}]]]')).alias("json"))
    return citations.cited(found, "json").select("id", "n", F.array_join("sources", ",").alias("sources"))


# a census of three snapshots, united from what was stored of each

FILES = "SELECT source || CASE doc_id % 4 WHEN 0 THEN '/archive/' WHEN 1 THEN '/Signed/' ELSE '/x/' END || doc_id AS path, strlen(coalesce(text, '')) * (1 + (doc_id % 9) * (doc_id % 9) * 9000) AS size, DATE '2024-06-01' - CAST(doc_id % 500 AS INT) AS modified_at, sha256(coalesce(text, '')) AS content_sha256 FROM documents"


def _files(load):
    d = load("documents")
    folder = F.when(F.col("doc_id") % 4 == 0, "/archive/").when(F.col("doc_id") % 4 == 1, "/Signed/").otherwise("/x/")
    size = F.octet_length(F.coalesce("text", F.lit(""))) * (1 + (F.col("doc_id") % 9) * (F.col("doc_id") % 9) * 9000)
    digest = F.sha2(F.coalesce("text", F.lit("")), 256)
    return d.select(
        "doc_id", F.concat("source", folder, F.col("doc_id").cast("string")).alias("path"), size.alias("size"), F.date_sub(F.lit("2024-06-01").cast("date"), (F.col("doc_id") % 500).cast("int")).alias("modified_at"),
        F.lit("2024-06-01").cast("timestamp_ntz").alias("scanned_at"), digest.alias("content_sha256"), F.substring(digest, 1, 16).alias("similarity"),
    )


def _united(load):
    """Each snapshot's sketch is written as it would be stored; the union reads those alone."""
    files = _files(load)
    return census.united([saved(census.sketched(files.where(F.col("doc_id") % 3 == k))) for k in range(3)])


BUCKETED = f"""SELECT 'size' AS kind, CASE WHEN size / 1048576.0 < 1 THEN '0-1MiB' WHEN size / 1048576.0 < 20 THEN '1-20MiB' WHEN size / 1048576.0 < 250 THEN '20-250MiB' WHEN size / 1048576.0 <= 2048 THEN '250MiB-2GiB' ELSE '>2GiB' END AS key, count(*) AS n FROM ({FILES}) GROUP BY 1, 2
UNION ALL SELECT 'age', CASE WHEN d <= 7 THEN '<=7d' WHEN d <= 30 THEN '8-30d' WHEN d <= 90 THEN '31-90d' WHEN d <= 365 THEN '91-365d' ELSE '>365d' END, count(*) FROM (SELECT date_diff('day', modified_at, DATE '2024-06-01') AS d FROM ({FILES})) GROUP BY 1, 2
UNION ALL SELECT 'class', CASE WHEN path LIKE '%/archive/%' THEN 'archive' WHEN path LIKE '%/Signed/%' THEN 'authority' ELSE 'current' END, count(*) FROM ({FILES}) GROUP BY 1, 2
UNION ALL SELECT 'bin', least(1023, floor(log2(size + 1) * 32))::INT::VARCHAR, count(*) FROM ({FILES}) GROUP BY 1, 2"""


@query("census_classes", BUCKETED)
def _(spark, load):
    return _united(load).where("kind in ('size', 'age', 'class', 'bin')").select("kind", "key", "n")


@query("census_representatives", f"SELECT kind, path, n FROM (SELECT 'sample' AS kind, path, size AS n, sha256(path) AS p FROM ({FILES}) ORDER BY p, path LIMIT 200) UNION ALL SELECT kind, path, n FROM (SELECT 'largest' AS kind, path, size AS n FROM ({FILES}) ORDER BY size DESC, path LIMIT 100)")
def _(spark, load):
    return _united(load).where("kind in ('sample', 'largest')").select("kind", "path", "n")


SHARES = ", ".join(f"round(pow(2.0, (min(bin) FILTER (upto >= greatest(1, ceil(total * {s}))) + 0.5) / 32) - 1)::BIGINT AS {p}" for p, s in census.SHARES.items())
REGISTERS = "SELECT h >> 18 AS r, max(CASE WHEN h & 262143 > 0 THEN 18 - length(bin(h & 262143)) + 1 WHEN l > 0 THEN 18 + 32 - length(bin(l)) + 1 ELSE 51 END) AS k FROM (SELECT ('0x' || substr(x, 1, 8))::BIGINT AS h, ('0x' || substr(x, 9, 8))::BIGINT AS l FROM (SELECT sha256({0}) AS x FROM ({1}))) GROUP BY 1"


def _rate_sql(value: str) -> str:
    """1 less the estimated distinct over the files, from registers worked out over all files at once."""
    sums = f"SELECT sum(pow(2.0, -k)) AS s, count(*) AS c FROM ({REGISTERS.format(value, FILES)})"
    raw = "0.7213 / (1 + 1.079 / 16384.0) * 16384.0 * 16384.0 / (s + 16384.0 - c)"
    return f"(SELECT 1 - least(n, CASE WHEN {raw} <= 2.5 * 16384 AND c < 16384 THEN 16384 * ln(16384.0 / (16384 - c)) ELSE {raw} END) / n FROM ({sums}), (SELECT count(*)::DOUBLE AS n FROM documents))"


@query("census_summary", f"SELECT *, round(greatest(0, {_rate_sql('content_sha256')}), 6) AS exact_rate, round(greatest(0, {_rate_sql('content_sha256')}, {_rate_sql(chr(115) + 'ubstr(content_sha256, 1, 12) || ' + chr(39) + '0000' + chr(39))}), 6) AS near_rate FROM (SELECT count(*) AS files, sum(size)::BIGINT AS bytes, max(size) AS largest FROM ({FILES})), (SELECT {SHARES} FROM (SELECT bin, sum(n) OVER (ORDER BY bin) AS upto, sum(n) OVER () AS total FROM (SELECT least(1023, floor(log2(size + 1) * 32))::INT AS bin, count(*) AS n FROM ({FILES}) GROUP BY 1)))")
def _(spark, load):
    return census.summary(_united(load))


# traces: a trace is a user's day

RATES = {"m0": (2.0, 0.5, 8.0), "m1": (0.1, None, 0.4)}


def _trace_events(events):
    e, k = events, F.col("event_id")
    kind = F.when(F.col("event_type") == "purchase", "llm").when(F.col("event_type") == "signup", "agent").when(F.col("event_type") == "view", "evaluator").otherwise("tool")
    n_in, n_out = F.floor(F.col("value") * 10), k % 50
    cost = traces.cost(F.when(k % 11 == 0, 0.25), F.concat(F.lit("m"), (k % 3).cast("string")), n_in, k % 7, n_out, RATES)
    failed = F.col("event_type") == "error"
    return e.select(
        F.concat_ws("-", "user_id", F.date_format("ts", "yyyyMMdd")).alias("trace_id"), F.concat_ws("-", "event_type", (k % 4).cast("string")).alias("span_id"), kind.alias("kind"), F.when(k % 2 == 0, "end").otherwise("start").alias("phase"),
        F.when(failed, "error").when(k % 5 != 0, "ok").alias("status"), F.when(failed & (k % 3 != 0), F.concat(F.lit("e"), k)).alias("error"), F.when(k % 4 == 0, F.concat(F.lit("w"), (k % 3).cast("string"))).alias("workflow_run_id"),
        "ts", F.col("event_id"), F.when(k % 6 != 0, k).alias("duration_ms"), n_in.alias("input_tokens"), n_out.alias("output_tokens"), cost.alias("cost_usd"),
    )


TRACES = """WITH e AS (SELECT user_id || '-' || strftime(ts, '%Y%m%d') AS trace_id, event_type || '-' || (event_id % 4) AS span_id, CASE event_type WHEN 'purchase' THEN 'llm' WHEN 'signup' THEN 'agent' WHEN 'view' THEN 'evaluator' ELSE 'tool' END AS kind,
  event_id % 2 = 0 AS ended, CASE WHEN event_type = 'error' THEN 'error' WHEN event_id % 5 <> 0 THEN 'ok' ELSE 'unset' END AS status, CASE WHEN event_type = 'error' AND event_id % 3 <> 0 THEN 'e' || event_id END AS error, CASE WHEN event_id % 4 = 0 THEN 'w' || event_id % 3 END AS run,
  ts, event_id, CASE WHEN event_id % 6 <> 0 THEN event_id ELSE 0 END AS ms, floor(value * 10)::BIGINT AS i, event_id % 50 AS o, event_id % 7 AS c FROM events),
p AS (SELECT *, ended AND kind IN ('llm', 'evaluator') AS pays, CASE WHEN event_id % 11 = 0 THEN 0.25 WHEN event_id % 3 = 0 THEN (greatest(i - c, 0) * 2.0 + c * 0.5 + o * 8.0) / 1e6 WHEN event_id % 3 = 1 THEN (greatest(i - c, 0) * 0.1 + c * 0.1 + o * 0.4) / 1e6 ELSE 0 END AS usd FROM e)
SELECT trace_id, min(ts) AS started_at, max(ts) AS updated_at, count(DISTINCT span_id) AS span_count, count(*) AS event_count, coalesce(sum(i) FILTER (pays), 0)::BIGINT AS input_tokens, coalesce(sum(o) FILTER (pays), 0)::BIGINT AS output_tokens, round(coalesce(sum(usd) FILTER (pays), 0), 9) AS cost_usd,
  coalesce(arg_max(status, (ts, event_id)) FILTER (kind = 'agent' AND ended), 'unset') AS status, arg_max(ms, (ts, event_id)) FILTER (kind = 'agent' AND ended) AS duration_ms, arg_max(error, (ts, event_id)) FILTER (error IS NOT NULL) AS error,
  coalesce(string_agg(DISTINCT run, ',' ORDER BY run), '') AS runs FROM p GROUP BY 1"""


def _traced(rows):
    times = [F.col(c).cast("timestamp_ntz").alias(c) for c in ("started_at", "updated_at")]
    return rows.select("trace_id", *times, "span_count", "event_count", "input_tokens", "output_tokens", F.round("cost_usd", 9).alias("cost_usd"), "status", "duration_ms", "error", F.array_join("workflow_run_ids", ",").alias("runs"))


@query("trace_rollups", TRACES)
def _(spark, load):
    return _traced(traces.rollup(_trace_events(load("events").withColumn("ts", F.col("ts").cast("timestamp")))))


def _stream_traces(spark, folder):
    events = _trace_events(streaming.event_stream(spark, folder))
    return _traced(traces.merged(streaming.drained(traces.partials(events), "rollups", "update")))


QUERIES["stream_trace_rollups"], SQL["stream_trace_rollups"] = _stream_traces, TRACES


# small operators in full

VERSIONS = "SELECT o_orderkey AS id, 'v' || o_orderkey % 4 AS version FROM orders"
EXPECTED = "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 > 0 THEN 'v' || (o_orderkey % 3) END AS expected FROM orders WHERE o_orderkey % 5 = 0"


def _versions(load):
    k = F.col("o_orderkey")
    old = load("orders").select(k.alias("id"), F.concat(F.lit("v"), (k % 4).cast("string")).alias("version"))
    keys = load("orders").where(k % 5 == 0).select(k.alias("id"), F.when(k % 3 > 0, F.concat(F.lit("v"), (k % 3).cast("string"))).alias("expected"))
    return tables.delete_expected(old, keys)


@query("store_delete_expected", f"SELECT id, version FROM ({VERSIONS}) v WHERE NOT EXISTS (SELECT 1 FROM ({EXPECTED}) e WHERE e.id = v.id AND (expected IS NULL OR expected = version))")
def _(spark, load):
    return _versions(load)[0]


@query("store_delete_told", f"SELECT e.id, expected, expected IS NULL OR expected = version AS deleted FROM ({EXPECTED}) e JOIN ({VERSIONS}) v ON e.id = v.id")
def _(spark, load):
    return _versions(load)[1]


COMPARED = "SELECT event_type AS workflow_id, CASE WHEN value > 60 THEN 'accepted' WHEN value > 30 THEN 'rejected' WHEN value > 10 THEN 'mixed' WHEN value > 5 THEN 'odd' END AS outcome FROM events"


@query("shadow_summary_outcomes", f"""SELECT row_number() OVER (ORDER BY whole DESC, total DESC, workflow_id) - 1 AS place, workflow_id, total, accepted, rejected, mixed, unlabeled, round(accepted / total, 9) AS acceptance_rate FROM (
SELECT workflow_id, grouping(workflow_id) AS whole, count(*) AS total, count(*) FILTER (outcome = 'accepted') AS accepted, count(*) FILTER (outcome = 'rejected') AS rejected, count(*) FILTER (outcome = 'mixed') AS mixed, count(*) FILTER (coalesce(outcome, 'odd') = 'odd') AS unlabeled FROM ({COMPARED}) GROUP BY GROUPING SETS ((workflow_id), ()))""")
def _(spark, load):
    v = F.col("value")
    outcome = F.when(v > 60, "accepted").when(v > 30, "rejected").when(v > 10, "mixed").when(v > 5, "odd")
    return govern.shadow_summary(load("events").select(F.col("event_type").alias("workflow_id"), outcome.alias("outcome")))


@query("shadow_label_scores", "SELECT doc_id, CASE WHEN quality = 1 AND toxic = 0 THEN 1.0 WHEN quality = 1 THEN 0.5 ELSE 0.0 END::DOUBLE AS score FROM labels")
def _(spark, load):
    names = F.array_compact(F.array(F.when(F.col("quality") == 1, " Good"), F.when(F.col("toxic") == 1, "REJECT")))
    return load("labels").select("doc_id", govern.outcome_score(govern.outcome(names)).alias("score"))


@query("language_main", "SELECT source, arg_min(lang, (-n, lang)) AS language, round(max(n) / sum(n), 6) AS share FROM (SELECT source, lang, sum(n_chars) AS n FROM documents GROUP BY 1, 2) GROUP BY 1")
def _(spark, load):
    d = load("documents").select("source", F.col("n_chars").alias("tokens"), F.create_map(F.col("lang"), F.lit(1.0)).alias("distribution"))
    return corpus.main_language(corpus.language_totals(d, "source"), "source")


@query("storage_forecast_tiers", """SELECT sum(s)::BIGINT AS object_bytes, count(*) AS document_vectors, sum(greatest(1, doc_id % 4))::BIGINT AS section_vectors, sum(CASE WHEN s > 262144000 THEN 0 ELSE least(p, 20000) END)::BIGINT AS passage_vectors, ceil(sum(s) * 0.65)::BIGINT AS lexical_bytes,
(count(*) + sum(greatest(1, doc_id % 4)) + sum(CASE WHEN s > 262144000 THEN 0 ELSE least(p, 20000) END))::BIGINT * 1536 AS vector_bytes, ceil((count(*) + sum(greatest(1, doc_id % 4)) + sum(CASE WHEN s > 262144000 THEN 0 ELSE least(p, 20000) END)) * 1536 * 1.5)::BIGINT AS hnsw_bytes
FROM (SELECT doc_id, n_chars * (1 + (doc_id % 10) * 9000) AS s, n_chars * (1 + doc_id % 10) AS p FROM documents)""")
def _(spark, load):
    k = F.col("doc_id")
    return corpus.forecast(load("documents").select((F.col("n_chars") * (1 + (k % 10) * 9000)).alias("size"), (F.col("n_chars") * (1 + k % 10)).alias("passages"), (k % 4).alias("sections")))


@query("collection_profile", """WITH d AS (SELECT source, sha256(text) AS h, lang || ' ' || doc_id AS title, substr(text, 1, 900) AS s FROM documents), k AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY title, h) AS k FROM d)
SELECT source, n, fingerprint, md5(substr(summary, 1, 12000)) AS summary FROM (SELECT source, count(*) AS n, md5(string_agg(h, '' ORDER BY h)) AS fingerprint FROM d GROUP BY 1) JOIN (SELECT source, string_agg(title || ': ' || s, chr(10) ORDER BY k) AS summary FROM k WHERE k <= 50 GROUP BY 1) USING (source)""")
def _(spark, load):
    d = load("documents").select("source", F.sha2("text", 256).alias("content_sha256"), F.concat_ws(" ", "lang", "doc_id").alias("title"), F.left("text", F.lit(900)).alias("routing_summary"))
    return corpus.collection_profile(d, "source").withColumn("summary", F.md5("summary"))


@query("intervals", "SELECT event_id, CASE WHEN ms >= 10000 THEN ms END AS ms, CASE WHEN ms >= 10000 THEN CASE WHEN ms % 86400000 = 0 THEN ms // 86400000 || 'd' WHEN ms % 3600000 = 0 THEN ms // 3600000 || 'h' WHEN ms % 60000 = 0 THEN ms // 60000 || 'm' WHEN ms % 1000 = 0 THEN ms // 1000 || 's' ELSE ms || 'ms' END END AS text FROM (SELECT event_id, round((event_id % 48 + 0.5) * [1, 1000, 60000, 3600000, 86400000][event_id % 5 + 1])::BIGINT AS ms FROM events)")
def _(spark, load):
    k = F.col("event_id")
    unit = F.element_at(F.array(*map(F.lit, ("ms", "s", "m", "h", "d"))), (k % 5 + 1).cast("int"))
    ms = ent.interval_ms(F.concat(F.lit(" "), (k % 48).cast("string"), F.lit(".5"), unit))
    return load("events").select("event_id", ms.alias("ms")).withColumn("text", ent.duration_text(F.col("ms")))


@query("preceding_texts", "SELECT conv_id, turn, md5(coalesce(string_agg(role || ': ' || coalesce(text, ''), chr(10)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), '')) AS context FROM conversations")
def _(spark, load):
    """A message's context: what the three before it say."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-3, -1)
    said = F.concat("role", F.lit(": "), F.coalesce("text", F.lit("")))
    return load("conversations").withColumn("said", said).select("conv_id", "turn", F.md5(F.array_join(F.collect_list("said").over(w), "\n")).alias("context"))


@query("neighbour_texts", "SELECT conv_id, turn, md5(lag(text) OVER w) AS previous_text, md5(lead(text) OVER w) AS next_text FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def _(spark, load):
    found = retrieval.with_neighbours(load("conversations").select("conv_id", "turn", "text"), "conv_id", "turn", ["text"])
    return found.select("conv_id", "turn", F.md5("previous_text").alias("previous_text"), F.md5("next_text").alias("next_text"))
