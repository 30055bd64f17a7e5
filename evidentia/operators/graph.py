"""A graph of entities and sourced relationships: writes, search, bounded traversals and facts.

Entities have id, workspace_id, type, canonical_name, aliases (array), identifiers (map) and sensitivity; relationships
id, workspace_id, subject, predicate, object, confidence and source_id; sources id, workspace_id, title and the states
permission, health and staleness.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import entities as ent
from ..functions.text import hash_id
from ..session import saved

#: The confidence of a relationship that states none, the sensitivity of an entity, and how far searches go.
CONFIDENCE, SENSITIVITY = 0.8, "internal"
MAX_DEPTH, MAX_PATH, MAX_RELATIONSHIPS, MAX_PATHS = 4, 5, 100, 10


def _between(value: int, most: int) -> int:
    return max(1, min(most, value))


def normalised(name: Column) -> Column:
    """A name as it is compared: lower case, other characters than those of names and addresses as single underscores."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(F.trim(name)), r"[^a-z0-9_@./:#-]+", "_"), "^_+|_+$", "")
    return F.when(bare == "", "unnamed").otherwise(bare)


def relationship_type(predicate: Column) -> Column:
    return F.regexp_replace(F.upper(normalised(predicate)), "[^A-Z0-9_]", "_")


def entity_id(workspace: Column, kind: Column, name: Column) -> Column:
    return hash_id("context-entity", workspace, kind, normalised(name))


def relationship_id(workspace: Column, subject: Column, predicate: Column, object_: Column, source: Column) -> Column:
    """The id of an assertion without version and validity, which are empty parts of it."""
    return hash_id("context-relationship", workspace, subject, normalised(predicate), object_, source, *[F.lit("")] * 3)


def upserted(entities: DataFrame, incoming: DataFrame) -> DataFrame:
    """entities with incoming ones (of the same columns and seq, their order) written over those of their id.

    The last name wins, aliases are united in the order they came, trimmed and without blanks, the last value of an
    identifier stays, and a missing sensitivity leaves what was known. Aliases and identifiers fold before the shuffle,
    one by one, so that no entity's writes are gathered.
    """
    every = entities.withColumn("seq", F.lit(-1).cast("long")).unionByName(incoming.withColumn("seq", F.col("seq").cast("long")))
    plain = every.groupBy("id").agg(
        F.max_by("workspace_id", "seq").alias("workspace_id"), F.max_by("type", "seq").alias("type"),
        F.max_by(F.regexp_replace(F.trim("canonical_name"), r"\s+", " "), "seq").alias("canonical_name"),
        F.coalesce(F.max(F.when(F.col("sensitivity").isNotNull(), F.struct("seq", "sensitivity")))["sensitivity"], F.lit(SENSITIVITY)).alias("sensitivity"),
    )
    alias = every.select("id", "seq", F.posexplode("aliases").alias("at", "alias")).select("id", F.struct("seq", "at").alias("o"), F.trim("alias").alias("alias")).where("alias <> ''")
    aliases = alias.groupBy("id", "alias").agg(F.min("o").alias("o")).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("o", "alias")))["alias"].alias("aliases"))
    name = every.select("id", "seq", F.explode("identifiers").alias("k", "v")).groupBy("id", "k").agg(F.max_by("v", "seq").alias("v"))
    names = name.groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("identifiers"))
    found = plain.join(aliases, "id", "left").join(names, "id", "left")
    return found.select(
        "id", "workspace_id", "type", "canonical_name", F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"),
        F.coalesce("identifiers", F.create_map().cast("map<string,string>")).alias("identifiers"), "sensitivity",
    )


def asserted(assertions: DataFrame, entities: DataFrame) -> DataFrame:
    """Assertions (workspace_id, subject, predicate, object, confidence, source_id) as relationships with id and fault.

    fault is null for a relationship to be written, else what is wrong with it: an endpoint is unknown or belongs to
    another workspace. Confidence is brought between 0 and 1; a missing one is the default. Of assertions of one id the
    surest stays.
    """
    known = entities.select("id", "workspace_id")
    ends = {k: known.select(F.col("id").alias(k), F.col("workspace_id").alias(f"_{k}")) for k in ("subject", "object")}
    joined = assertions.join(ends["subject"], "subject", "left").join(ends["object"], "object", "left")
    fault = (
        F.when(F.col("_subject").isNull(), "unknown subject").when(F.col("_object").isNull(), "unknown object")
        .when((F.col("_subject") != F.col("workspace_id")) | (F.col("_object") != F.col("workspace_id")), "entities of another workspace")
    )
    sure = F.when(F.col("confidence").isNull() | F.isnan("confidence"), CONFIDENCE).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), "confidence")))
    rows = joined.select(
        relationship_id(*(F.col(c) for c in ("workspace_id", "subject", "predicate", "object", "source_id"))).alias("id"), "workspace_id", "subject",
        normalised(F.col("predicate")).alias("predicate"), "object", sure.alias("confidence"), "source_id", fault.alias("fault"),
    )
    keys = [c for c in rows.columns if c != "confidence"]
    return rows.groupBy(*keys).agg(F.max("confidence").alias("confidence")).select(*rows.columns)


def ingested(sources: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sources (id, workspace_id, kind, title, uri, text) as entities, assertions between a source's own entity and those
    that its title, address and text mention, and extraction runs with their numbers."""
    title = F.coalesce("title", "uri", "id")
    kind = F.when(F.col("kind").isin("ticket", "metric"), F.col("kind")).otherwise("document")
    own = sources.select(
        entity_id(F.col("workspace_id"), kind, title).alias("entity"), "id", "workspace_id", kind.alias("type"), title.alias("canonical_name"),
        F.when(F.col("uri").isNotNull(), F.array("uri")).otherwise(F.array().cast("array<string>")).alias("aliases"),
        F.map_filter(F.create_map(F.lit("sourceId"), F.col("id"), F.lit("uri"), F.col("uri")), lambda k, v: v.isNotNull()).alias("identifiers"),
    )
    texts = sources.select("id", F.concat_ws("\n", F.nullif("title", F.lit("")), F.nullif("uri", F.lit("")), F.nullif("text", F.lit(""))).alias("text"))
    found = ent.entities(texts).join(own.select("id", "workspace_id", "entity"), "id")
    target = entity_id(F.col("workspace_id"), F.col("type"), F.col("name"))
    empty = F.array().cast("array<string>").alias("aliases"), F.create_map().cast("map<string,string>").alias("identifiers")
    entities = own.select(F.col("entity").alias("id"), "workspace_id", "type", "canonical_name", "aliases", "identifiers").unionByName(
        found.select(target.alias("id"), "workspace_id", "type", F.col("name").alias("canonical_name"), *empty)
    )
    assertions = found.select("workspace_id", F.col("entity").alias("subject"), "predicate", target.alias("object"), "confidence", F.col("id").alias("source_id"))
    counts = found.groupBy("id").agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0))
    runs = sources.join(counts, "id", "left").select(F.col("id").alias("source_id"), (n + 1).cast("long").alias("entity_count"), n.cast("long").alias("relationship_count"))
    return entities, assertions, runs


def search(entities: DataFrame, workspace: str, terms: list[str], limit: int = 20) -> DataFrame:
    """Entities of a workspace by how many of the terms their name, aliases, identifiers or type hold: id, score; best first."""
    own = entities.where(F.col("workspace_id") == workspace)
    clean = [t for t in (_plain(t) for t in terms) if t]
    names = F.concat(F.array(normalised(F.col("canonical_name"))), F.transform("aliases", normalised), F.transform(F.map_values("identifiers"), normalised), F.array("type"))
    if not clean:
        return own.select("id", F.lit(0).alias("score")).orderBy("id").limit(limit)
    hay = own.select("id", "canonical_name", F.array_join(names, " ").alias("_hay"))
    score = reduce(lambda a, b: a + b, [F.contains("_hay", F.lit(t)).cast("int") for t in clean])
    return hay.withColumn("score", score).where("score > 0").orderBy(F.col("score").desc(), "canonical_name", "id").limit(limit).select("id", "score")


def _plain(term: str) -> str:
    """normalised() of a term at hand; blank terms ask for nothing."""
    import re

    return re.sub("^_+|_+$", "", re.sub(r"[^a-z0-9_@./:#-]+", "_", term.strip().lower()))


def permitted(relationships: DataFrame, sources: DataFrame) -> DataFrame:
    """The relationships whose source is known, of their workspace and not denied."""
    open_ = sources.where("permission <> 'denied'").select(F.col("id").alias("source_id"), "workspace_id")
    return relationships.join(open_, ["source_id", "workspace_id"], "left_semi")


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def neighbours(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """Vertices within depth (1 to 4) steps of the seeds (id), with their least distance.

    One join for each step; ways and frontiers are written, so that a step reads the last one and not all before it.
    """
    ways, front = saved(both_ways(edges)), saved(seeds.select("id", F.lit(0).alias("distance")).distinct())
    found = [front]
    for step in range(1, _between(depth, MAX_DEPTH) + 1):
        near = front.join(ways, front["id"] == ways["src"]).select(F.col("dst").alias("id")).distinct()
        # a way leads one step on, back or to the same distance: only the last two frontiers can hold its end
        for known in found[-2:]:
            near = near.join(known.select("id"), "id", "left_anti")
        front = saved(near.withColumn("distance", F.lit(step)))
        found.append(front)
    return reduce(DataFrame.unionByName, found)


def surrounding(relationships: DataFrame, seeds: DataFrame, depth: int = 1, most: int = 25) -> DataFrame:
    """Relationships met within depth (1 to 4) steps of the seeds (id), each once with the step it is met at: nearest first,
    then by id, at most so many (1 to 100)."""
    ends = saved(relationships.select("id", F.col("subject").alias("src"), F.col("object").alias("dst")))
    near = neighbours(ends, seeds, _between(depth, MAX_DEPTH) - 1) if depth > 1 else seeds.select("id", F.lit(0).alias("distance")).distinct()
    at = near.select(F.col("id").alias("src"), "distance")
    met = ends.join(at, "src").select("id", "distance").unionByName(ends.join(at.withColumnRenamed("src", "dst"), "dst").select("id", "distance"))
    return met.groupBy("id").agg((F.min("distance") + 1).alias("step")).orderBy("step", "id").limit(_between(most, MAX_RELATIONSHIPS))


def paths(edges: DataFrame, start: str, end: str, depth: int, most: int | None = None) -> DataFrame:
    """Simple paths of at most depth (1 to 5) edges between two vertices, as arrays, shortest first, at most so many (1 to 10).

    A path is only followed where its end can still reach the goal in the steps that are left.
    """
    steps = min(max(depth, 1), MAX_PATH)
    ways = saved(both_ways(edges))
    spark = ways.sparkSession
    far = saved(neighbours(edges, spark.range(1).select(F.lit(end).alias("id")), steps - 1)) if steps > 1 else spark.range(1).select(F.lit(end).alias("id"), F.lit(0).alias("distance"))
    onward = ways.join(far.select(F.col("id").alias("dst"), F.col("distance").alias("left")), "dst")
    now = spark.range(1).select(F.array(F.lit(start)).alias("path"), F.lit(start).alias("at"))
    found = []
    for step in range(1, steps + 1):
        now = now.join(onward.where(F.col("left") <= steps - step), now["at"] == onward["src"]).where(~F.array_contains("path", F.col("dst")))
        now = saved(now.select(F.concat("path", F.array("dst")).alias("path"), F.col("dst").alias("at")))
        found.append(now.where(F.col("at") == end).select("path"))
        now = now.where(F.col("at") != end)
    ordered = reduce(DataFrame.unionByName, found).orderBy(F.size("path"), "path")
    return ordered if most is None else ordered.limit(_between(most, MAX_PATHS))


def warning(permission: Column, health: Column, staleness: Column, title: Column) -> Column:
    """What to say of a source's state, or null."""
    said = lambda *x: F.concat(F.lit('Source "'), title, *[F.lit(p) if isinstance(p, str) else p for p in x])
    return (
        F.when(permission == "partial", said('" has partial permissions.'))
        .when(health.isin("degraded", "down"), said('" health is ', health, "."))
        .when(staleness.isin("stale", "expired"), said('" is ', staleness, "."))
    )


def facts(relationships: DataFrame, entities: DataFrame, sources: DataFrame) -> DataFrame:
    """Relationships with the names of both ends, their source's title and its warning; those of denied or unknown sources
    and those without a known end are left out."""
    names = {k: entities.select(F.col("id").alias(k), F.col("canonical_name").alias(f"{k}_name")) for k in ("subject", "object")}
    told = sources.where("permission <> 'denied'").select(
        F.col("id").alias("source_id"), F.coalesce("title", "id").alias("source_title"),
        warning(F.col("permission"), F.col("health"), F.col("staleness"), F.coalesce("title", "id")).alias("warning"),
    )
    return relationships.join(names["subject"], "subject").join(names["object"], "object").join(told, "source_id").select(
        "id", "subject_name", "predicate", "object_name", "confidence", "source_id", "source_title", "warning"
    )


def context(
    entities: DataFrame, relationships: DataFrame, sources: DataFrame, workspace: str, ids: list[str] = (), terms: list[str] = (), source_ids: list[str] = (), depth: int = 1, most: int = 20
) -> DataFrame:
    """The facts around the entities of a workspace that are named, that terms find, or that the given sources speak of."""
    own = relationships.where(F.col("workspace_id") == workspace)
    seeds = entities.where((F.col("workspace_id") == workspace) & F.col("id").isin(list(ids))).select("id")
    if terms:
        seeds = seeds.unionByName(search(entities, workspace, list(terms), _between(most, MAX_RELATIONSHIPS)).select("id"))
    if source_ids:
        said = own.where(F.col("source_id").isin(list(source_ids)))
        seeds = seeds.unionByName(said.select(F.explode(F.array("subject", "object")).alias("id")))
    near = surrounding(permitted(own, sources), seeds.distinct(), depth, most)
    return facts(own.join(near.select("id"), "id", "left_semi"), entities, sources)
