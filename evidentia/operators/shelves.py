"""What lies around a corpus: scopes, listings and trees, line counts, expert files, registries, sessions, audits, imports."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Folders that no scan enters, words of a question for expert files, and lines that are clauses or tables.
PRUNED = "node_modules"
EXPERT_WORD = "[a-z0-9_ąćęłńóśźż-]{3,}"
CLAUSE_LINE = r"(?iu)^(?:(?:article|art\.?|chapter|section|clause|annex|appendix|rozdział|artykuł|§)\s+[\w.-]+|\d+(?:\.\d+)+[.)]?\s+)"
#: Rows of a legacy store that are imported at once.
IMPORT_BATCH = 512


@dataclass(frozen=True)
class Scope:
    """What a caller may see and asks for. Lists that are not given do not narrow; an empty list of tokens sees nothing."""

    workspace: str
    context: str
    generation: str
    tokens: tuple[str, ...] | None = None
    documents: tuple | None = None
    collections: tuple | None = None
    sections: tuple | None = None
    types: tuple[str, ...] | None = None
    jurisdictions: tuple[str, ...] | None = None
    as_of: str | None = None


def in_scope(rows: DataFrame, scope: Scope, members: DataFrame | None = None) -> DataFrame:
    """Rows (workspace, context, generation, document, section, acl_tokens, document_type, jurisdiction, publication_date,
    valid_from, valid_to) inside a scope. members (collection, document) says what a collection holds.

    Types and jurisdictions are told in any case; a day must lie inside the bounds that a row has. The conditions on the
    row's own columns reach the scan; collections narrow by a semi join.
    """
    low = lambda values: [v.lower() for v in values]
    tests: list[Column] = [F.col("workspace") == scope.workspace, F.col("context") == scope.context, F.col("generation") == scope.generation]
    if scope.tokens is not None:
        tests.append(F.arrays_overlap("acl_tokens", F.array(*map(F.lit, scope.tokens)).cast("array<string>")))
    for column, values in (("document", scope.documents), ("section", scope.sections)):
        if values is not None:
            tests.append(F.col(column).isin(list(values)))
    for column, values in (("document_type", scope.types), ("jurisdiction", scope.jurisdictions)):
        if values:
            tests.append(F.lower(column).isin(low(values)))
    if scope.as_of:
        day = F.lit(scope.as_of).cast("date")
        tests += [F.col(c).isNull() | (F.col(c) <= day) for c in ("publication_date", "valid_from")] + [F.col("valid_to").isNull() | (F.col("valid_to") >= day)]
    found = rows.where(reduce(lambda a, b: a & b, tests))
    if scope.collections is not None:
        if members is None:
            raise ValueError("a scope of collections needs their members")
        held = members.where(F.col("collection").isin(list(scope.collections))).select("document").distinct()
        found = found.join(held, "document", "left_semi")
    return found


def inspected(docs: DataFrame, text: str = "text", id_column: str = "id") -> DataFrame:
    """id, headings, clauses, paragraphs and tables: the lines of each text that are headings or clauses, and the runs of lines
    that are tables or, up to a blank line, other text. A fold over the lines in their row; nothing is shuffled."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: F.trim(F.regexp_replace(x, r"^\s+|\s+$", "")))
    zero = F.struct(*[F.lit(0).alias(n) for n in ("headings", "clauses", "paragraphs", "tables")], F.lit(False).alias("inside"), F.lit(False).alias("table"))

    def step(s: Column, x: Column) -> Column:
        table = x.rlike(r"^\|.*\|$")
        begins = (x != "") & ~s["inside"] & ~table
        return F.struct(
            (s["headings"] + x.rlike(r"^#{1,6}[ \t]+").cast("int")).alias("headings"), (s["clauses"] + x.rlike(CLAUSE_LINE).cast("int")).alias("clauses"),
            (s["paragraphs"] + begins.cast("int")).alias("paragraphs"), (s["tables"] + (table & ~s["table"]).cast("int")).alias("tables"),
            F.when(x == "", False).otherwise(s["inside"] | begins).alias("inside"), table.alias("table"),
        )

    counts = F.aggregate(lines, zero, step)
    return docs.select(F.col(id_column).alias("id"), counts.alias("c")).select("id", "c.headings", "c.clauses", "c.paragraphs", "c.tables")


def expert_terms(question: str) -> list[str]:
    return list(dict.fromkeys(re.findall(EXPERT_WORD, question.lower())))


def expert_files(files: DataFrame, question: str, limit: int) -> DataFrame:
    """rank, path and score of the files (path, content) that say the question's words most, whole words over path and
    content; ties by path. A question without words scores 1 everywhere; files that score 0 stay, last. Null contents are empty."""
    terms = expert_terms(question)
    hay = F.lower(F.concat(F.col("path"), F.lit("\n"), F.coalesce("content", F.lit(""))))
    edge = r"(?<![A-Za-z0-9_]){}(?![A-Za-z0-9_])"
    score = reduce(lambda a, b: a + b, [F.regexp_count(hay, F.lit(edge.format(re.escape(t)))) for t in terms], F.lit(0)) if terms else F.lit(1)
    order = [F.col("score").desc(), F.col("path")]
    best = files.select("path", score.cast("long").alias("score")).orderBy(*order).limit(limit)
    return best.select(F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)).alias("rank"), "path", "score")


def expert_scan(files: DataFrame, most_bytes: int) -> DataFrame:
    """Files (path, size) below folders that are scanned: no folder or file that begins with a dot, no PRUNED, none too large."""
    return files.where(~F.col("path").rlike(rf"(^|/)(\.|{PRUNED}(/|$))") & (F.col("size") <= most_bytes))


def tree(files: DataFrame) -> DataFrame:
    """path, name, depth, kind (folder or file), files and bytes of everything in a listing (path, size), folders before files
    and both by name when sorted by (parent, kind desc, name). Each file counts for every folder above it, added up before
    the shuffle, so a folder that holds most files is in no one task."""
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    rows = files.where("path is not null and path <> ''").select("path", "size", F.explode(above).alias("at"))
    own = F.max((F.col("at") == F.col("path")).cast("int"))
    return rows.groupBy("at").agg(F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), own.alias("file"), F.max((F.col("at") != F.col("path")).cast("int")).alias("folder")).select(
        F.col("at").alias("path"), F.element_at(F.split("at", "/"), -1).alias("name"), F.size(F.split("at", "/")).alias("depth"), F.when(F.col("folder") == 1, "folder").otherwise("file").alias("kind"), "files", "bytes"
    )


def sessions(rows: DataFrame, archived: bool = False, preview: int = 80) -> DataFrame:
    """Sessions (id, title, status, updated_at, text), newest first, then by id: id, title, preview and updated_at. Archived ones
    only if asked for; a session without a status is not archived but, as a missing field never differs, not listed either."""
    kept = rows if archived else rows.where(F.col("status") != "archived")
    text = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " "))
    return kept.select("id", "title", F.left(text, F.lit(preview)).alias("preview"), "updated_at").orderBy(F.col("updated_at").desc_nulls_last(), "id")


def registered(sources: DataFrame, events: DataFrame) -> DataFrame:
    """Sources (source_id, name, owner, updated_at) after events of their own (source_id, kind, version, health, at, seq).

    A source's version is that of its last version event, its health that of its last health event, and accesses are
    counted; last is by time, then seq. Sources without events keep nulls and 0; events of unknown sources register them
    without a name. One aggregation with partial sums: a source with most events is in no one task before it.
    """
    at = F.struct("at", "seq")
    last = lambda kind, column: F.max_by(column, F.when((F.col("kind") == kind) & F.col(column).isNotNull(), at)).alias(column)
    found = events.where("source_id is not null").groupBy("source_id").agg(
        last("version", "version"), last("health", "health"), F.count_if(F.col("kind") == "access").alias("accesses"), F.max("at").alias("last_event")
    )
    own = sources.where("source_id is not null").groupBy("source_id").agg(F.max_by(F.struct("name", "owner"), "updated_at").alias("s"))
    return own.join(found, "source_id", "full").select("source_id", "s.name", "s.owner", "version", "health", F.coalesce("accesses", F.lit(0)).alias("accesses"), "last_event")


def audited(hits: DataFrame, selected: DataFrame, exclusions: DataFrame, run_id: str) -> DataFrame:
    """The audit rows of a retrieval run: every hit (id, rank) with whether it was selected (id), and else why not (id, reason)."""
    chosen = selected.select("id", F.lit(True).alias("selected")).distinct()
    why = exclusions.groupBy("id").agg(F.min("reason").alias("reason"))
    return hits.join(chosen, "id", "left").join(why, "id", "left").select(
        F.lit(run_id).alias("run_id"), "id", "rank", F.coalesce("selected", F.lit(False)).alias("selected"), F.when(F.col("selected").isNull(), F.col("reason")).alias("reason")
    )


def imported(store: DataFrame, legacy: DataFrame, ledger: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The store (namespace, id, doc) with what a legacy store still has, and the ledger (namespace, n) after it.

    A namespace that the ledger has is done and not imported again. Of the others, rows whose id the store lacks are added;
    n is the number of legacy rows, taken over in batches of IMPORT_BATCH (batch, from 0, by id).
    """
    todo = legacy.where("namespace is not null and id is not null").join(ledger.select("namespace").distinct(), "namespace", "left_anti")
    once = todo.groupBy("namespace", "id").agg(F.max("doc").alias("doc"))
    fresh = once.join(store.select("namespace", "id"), ["namespace", "id"], "left_anti")
    done = once.groupBy("namespace").agg(F.count("*").alias("n"))
    return store.select("namespace", "id", "doc").unionByName(fresh.select("namespace", "id", "doc")), ledger.select("namespace", "n").unionByName(done.select("namespace", "n"))


def memory_fingerprint(rows: DataFrame, by: str, digest: str) -> DataFrame:
    """by, n and fingerprint: the SHA-256 of a group's sorted digests with a zero byte between them, as the store in memory has
    it. The definition takes the list as a whole, so a group's digests meet in one row; collection_rollup does not need that."""
    lists = rows.where(F.col(digest).isNotNull()).groupBy(by).agg(F.array_sort(F.collect_list(digest)).alias("d"))
    return lists.select(by, F.size("d").alias("n"), F.sha2(F.array_join("d", "\0"), 256).alias("fingerprint"))


def federated(responses: list[DataFrame], failures: DataFrame, sources: list[str], limit: int = 50, k: int = 60) -> tuple[DataFrame, DataFrame]:
    """The fused hits of the sources that answered, and every source with its state: a failing source takes no other with it.

    Responses are (workspace_id, source_id, id, rank); failures (source_id, reason). A source that failed counts with none of
    its hits, even if some came.
    """
    failed = failures.groupBy("source_id").agg(F.min("reason").alias("reason"))
    spark = failures.sparkSession
    every = spark.createDataFrame([(s,) for s in sources], "source_id string")
    hits = reduce(DataFrame.unionByName, [r.select("workspace_id", "source_id", "id", "rank") for r in responses]).join(failed, "source_id", "left_anti")
    key = ["workspace_id", "source_id", "id"]
    fused = hits.groupBy(*key).agg(F.round(F.sum(1 / (k + F.col("rank"))), 9).alias("score")).orderBy(F.col("score").desc(), "id", "source_id", "workspace_id").limit(max(1, min(50, limit)))
    counts = hits.groupBy("source_id").agg(F.count("*").alias("n"))
    states = every.join(failed, "source_id", "left").join(counts, "source_id", "left").select(
        "source_id", F.when(F.col("reason").isNotNull(), "failed").otherwise("ok").alias("state"), "reason", F.coalesce("n", F.lit(0)).alias("hits")
    )
    return fused, states
