"""The life of a corpus: what is listed, published, embedded, orphaned and let go."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.entities import excluded
from ..functions.values import OUTPUT_BYTES

#: Bytes up to which a file is embedded at once or soon after, and vectors of a file at most.
EAGER, ASYNC, MOST_VECTORS = 20 << 20, 250 << 20, 20_000


def files(spark: SparkSession, root: str, extensions: list[str], most_bytes: int, globs: list[str] = ()) -> DataFrame:
    """path, size and modified of the files below a folder, of the given extensions, not larger than most_bytes and not excluded."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    return found.where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin([e.lower() for e in extensions]) & (F.col("size") <= most_bytes) & ~excluded(F.col("path"), list(globs)))


def to_read(listing: DataFrame, published: DataFrame, signature: str) -> DataFrame:
    """Listed files (path, size, modified) that are new, or differ from what was published (and signature) of their path."""
    known = published.where(F.col("signature") == signature).select("path", "size", "modified")
    return listing.join(known, ["path", "size", "modified"], "left_anti")


def unseen(members: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """Members of a generation that a whole run did not see any more."""
    return members.join(seen.select(key).distinct(), key, "left_anti")


def orphans(owned: dict[str, tuple[DataFrame, DataFrame]], key: str) -> DataFrame:
    """Of every level, (rows, owners by the same key), the rows whose owner is gone: level, key. An anti-join for each level."""
    return reduce(DataFrame.unionByName, [rows.select(key).distinct().join(owners.select(key), key, "left_anti").select(F.lit(level).alias("level"), key) for level, (rows, owners) in owned.items()])


def collectable(unpublished: DataFrame, jobs: DataFrame, now: Column, grace_seconds: int) -> DataFrame:
    """Unpublished rows (context, retired_at) past their grace, of contexts (context) without a job still running."""
    old = unpublished.where(F.unix_timestamp(F.col("retired_at").cast("timestamp")) + grace_seconds <= F.unix_timestamp(now))
    return old.join(jobs.where(~F.col("status").isin("completed", "failed", "cancelled")).select("context").distinct(), "context", "left_anti")


def authorised(collections: DataFrame, members: DataFrame, tokens: list[str]) -> DataFrame:
    """Collections (collection) with a member (collection, acl_tokens) that the tokens open."""
    mine = members.where(F.arrays_overlap("acl_tokens", F.array(*map(F.lit, tokens))))
    return collections.join(mine.select("collection").distinct(), "collection", "left_semi")


def validated(generations: DataFrame, documents: DataFrame, sections: DataFrame, passages: DataFrame) -> DataFrame:
    """Numbers of distinct documents, sections and passages of every generation, and whether none is missing.

    Every table is counted by itself before it is joined, so that no row meets rows of another table.
    """
    count = lambda df, name: df.groupBy("generation").agg(F.count_distinct("id").alias(name))
    joined = reduce(lambda a, b: a.join(b, "generation", "left"), [count(documents, "documents"), count(sections, "sections"), count(passages, "passages")], generations.select("generation").distinct())
    full = joined.select("generation", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("documents", "sections", "passages")])
    return full.withColumn("valid", (F.col("documents") > 0) & (F.col("sections") >= F.col("documents")) & (F.col("passages") >= F.col("sections")))


def active(rows: DataFrame, generations: DataFrame, asked: str | None = None) -> DataFrame:
    """Rows of the generation that is asked for, or of each context's active one."""
    if asked is not None:
        return rows.where(F.col("generation") == asked)
    return rows.join(generations.where("state like 'active%'").select("context", "generation"), ["context", "generation"], "left_semi")


def embedding_tier(size: Column) -> Column:
    return F.when(size <= EAGER, "eager").when(size <= ASYNC, "async").otherwise("lazy")


def within_budget(rows: DataFrame, by: str, order: list[Column], amount: Column, budget: int) -> DataFrame:
    """The first rows of each group whose amounts stay within a budget together."""
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("_upto", F.sum(amount).over(w)).where(F.col("_upto") <= budget).drop("_upto")


def kept(rows: DataFrame, time: str, now: Column, seconds: int) -> DataFrame:
    """Rows that have not outlived their time, to the microsecond; those without one stay."""
    return rows.where(F.col(time).isNull() | (F.unix_micros(F.col(time).cast("timestamp")) + F.lit(seconds).cast("long") * 1_000_000 > F.unix_micros(now)))


def language_totals(passages: DataFrame, by: str) -> DataFrame:
    """by, language and share: how the tokens of passages (distribution map, tokens) fall to languages."""
    weights = passages.select(by, "tokens", F.explode("distribution").alias("language", "_w")).groupBy(by, "language").agg(F.sum(F.col("_w") * F.col("tokens")).alias("_w"))
    return weights.join(weights.groupBy(by).agg(F.sum("_w").alias("_all")), by).where("_all > 0").select(by, "language", F.round(F.col("_w") / F.col("_all"), 6).alias("share"))


def usable_roots(spark: SparkSession, roots: list[str]) -> tuple[list[str], list[str]]:
    """The folders that are there and those that are not, asked of the file system that Spark reads."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    there = {r: path(r).getFileSystem(conf).exists(path(r)) for r in roots}
    return [r for r in roots if there[r]], [r for r in roots if not there[r]]


def ordered(listing: DataFrame, limit: int) -> DataFrame:
    """Paths of a listing by depth, then name, so many at most."""
    return listing.orderBy(F.size(F.split("path", "/")), "path").limit(limit)


def lines_between(lines: DataFrame, first: int, last: int, most: int = 2_000) -> DataFrame:
    """Lines (id, line_no, ...) from first to last of every document, so many of each at most."""
    return lines.where(F.col("line_no").between(first, min(last, first + most - 1)))


def byte_range(text: Column, start: int, end: int, most: int = OUTPUT_BYTES) -> Column:
    """The bytes of a text from start to end, as binary; null where the range is not within the text or too long."""
    raw = F.encode(text, "UTF-8")
    return F.when(F.lit(0 <= start <= end <= start + most) & (F.octet_length(raw) >= end), F.substring(raw, start + 1, end - start))


def blobs(files: DataFrame) -> DataFrame:
    """Contents (content, binary) once each under their address: sha256, size, content. Equal contents fold before they move."""
    return files.select(F.sha2("content", 256).alias("sha256"), F.octet_length("content").alias("size"), "content").dropDuplicates(["sha256"])


def unreferenced(stored: DataFrame, references: DataFrame) -> DataFrame:
    """Stored blobs (sha256) that nothing refers to any more."""
    return stored.join(references.select("sha256").distinct(), "sha256", "left_anti")


def projected(log: DataFrame, operations: DataFrame) -> DataFrame:
    """A log of projections (target, payload_sha256, status, at) after more operations (target, payload_sha256, at): an
    operation whose payload the target had applied last changes nothing, another one is queued over what was there."""
    last = log.unionByName(operations.withColumn("status", F.lit("queued")))
    same = F.min_by("status", F.when(F.col("status") == "applied", 0).otherwise(1))
    merged = last.groupBy("target", "payload_sha256").agg(same.alias("status"), F.max("at").alias("at"))
    return merged.groupBy("target").agg(F.max_by(F.struct("payload_sha256", "status", "at"), F.struct("at", "payload_sha256")).alias("l")).select("target", "l.*")


def ranked_skills(scores: DataFrame, order: str = "fact_id") -> DataFrame:
    """Scores (fact_id, skill, score) of an outside ranker: each fact's best skill, ties by name."""
    return scores.groupBy(order).agg(F.max_by(F.struct("skill", "score"), F.struct("score", F.expr("transform(split(skill, ''), c -> -ascii(c))"))).alias("b")).select(order, "b.skill", "b.score")


def resolved_evidence(sources: DataFrame, workspace: str, allowed: list[str]) -> DataFrame:
    """Sources (id, workspace_id, permission, health, staleness) that a workflow may cite: id, fault (null if it may) and warning."""
    fault = (
        F.when(~F.col("id").isin(allowed) if allowed else F.lit(False), "not allowed").when(F.col("workspace_id") != workspace, "other workspace").when(F.col("permission") == "denied", "denied")
    )
    warning = F.when(F.col("health").isin("degraded", "down"), F.concat(F.lit("health is "), "health")).when(F.col("staleness").isin("stale", "expired"), F.concat(F.lit("source is "), "staleness"))
    return sources.select("id", fault.alias("fault"), F.when(fault.isNull(), warning).alias("warning"))


def main_language(shares: DataFrame, by: str) -> DataFrame:
    """by, language and share: the language of the greatest share of language_totals(), ties to the first name."""
    best = shares.groupBy(by).agg(F.min(F.struct((-F.col("share")).alias("s"), "language")).alias("b"))
    return best.select(by, "b.language", (-F.col("b.s")).alias("share"))


def forecast(files: DataFrame, dimensions: int = 384) -> DataFrame:
    """What an index of files (size, passages, sections) will take: one row of document, section and passage vectors and bytes.

    Passages get vectors up to MOST_VECTORS a file in the eager and async tiers, and none at first in the lazy one.
    """
    size, lazy = F.coalesce("size", F.lit(0)), embedding_tier(F.coalesce("size", F.lit(0))) == "lazy"
    planned = F.when(lazy, 0).otherwise(F.least(F.coalesce("passages", F.lit(0)), F.lit(MOST_VECTORS)))
    sums = files.agg(
        F.coalesce(F.sum(size), F.lit(0)).alias("object_bytes"), F.count("*").alias("document_vectors"), F.coalesce(F.sum(F.greatest(F.lit(1), F.coalesce("sections", F.lit(0)))), F.lit(0)).alias("section_vectors"),
        F.coalesce(F.sum(planned), F.lit(0)).alias("passage_vectors"),
    )
    raw = (F.col("document_vectors") + F.col("section_vectors") + F.col("passage_vectors")) * dimensions * 4
    return sums.select("*", F.ceil(F.col("object_bytes") * F.expr("0.65")).cast("long").alias("lexical_bytes"), raw.alias("vector_bytes"), F.ceil(raw * F.expr("1.5")).cast("long").alias("hnsw_bytes"))


def collection_profile(members: DataFrame, by: str = "collection", samples: int = 50, most: int = 12_000) -> DataFrame:
    """by, n, fingerprint and summary of collections of documents (by, content_sha256, title, routing_summary).

    fingerprint is the MD5 of the sorted digests of all members end to end, as the store defines it, so a collection's
    digests, 64 bytes each, meet in one row. summary has the first samples members by title as `title: summary` lines, cut to most
    characters; those are found for each collection before their texts meet.
    """
    digests = members.groupBy(by).agg(F.count("*").alias("n"), F.md5(F.array_join(F.array_sort(F.collect_list("content_sha256")), "").cast("binary")).alias("fingerprint"))
    order = Window.partitionBy(by).orderBy("title", "content_sha256")
    first = members.select(by, "title", "content_sha256", F.left("routing_summary", F.lit(most)).alias("routing_summary")).withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= samples)
    line = F.struct("_k", F.concat(F.coalesce("title", F.lit("")), F.lit(": "), F.coalesce("routing_summary", F.lit(""))).alias("line"))
    text = first.groupBy(by).agg(F.left(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["line"]), "\n"), F.lit(most)).alias("summary"))
    return digests.join(text, by)
