"""Ranked lanes (retriever, rank, score, id), their fusion, and what is done with the fused list."""

from __future__ import annotations

from functools import reduce

import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import chunk_list, cosine, tokens
from ..session import saved
from .markdown import sections

RRF_K = 60
#: Fixed values of hierarchical routing: rows of a lane of each level, and how many of each the fused lanes route to.
LANES = {"collection": 20, "document": 50, "section": 100, "passage": 150}
ROUTED = {"collection": 10, "document": 30, "section": 50}


def ranked(df: DataFrame, retriever: str, limit: int, score: str = "score", id_column: str = "id") -> DataFrame:
    """The best limit rows by score, then id, as a lane. The sort is a top-k; the rank is numbered over those rows alone."""
    best = df.orderBy(F.col(score).desc(), F.col(id_column)).limit(limit)
    return best.select(
        F.lit(retriever).alias("retriever"), F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col(score).desc(), F.col(id_column))).alias("rank"), F.col(score).alias("score"), F.col(id_column).alias("id")
    )


def lexical(df: DataFrame, query: str, limit: int, text: str = "text", id_column: str = "id") -> DataFrame:
    """Matching tokens over the root of (distinct query terms times tokens of the text); rows without a match do not count."""
    terms = query_terms(query)
    return _matching(counted(df.select(F.col(id_column).alias("id"), F.col(text).alias("_text")), terms, "_text"), len(terms), "lexical", limit)


def query_terms(query: str) -> list[str]:
    return sorted(set(regex.findall(r"[\p{L}\p{N}_-]+", query.lower())))


def counted(df: DataFrame, terms: list[str], text: str) -> DataFrame:
    """df with the tokens of a text (_n) and those that are query terms (_m) in its place."""
    return df.withColumn("_t", tokens(F.col(text))).drop(text).select(*[c for c in df.columns if c != text], F.size("_t").alias("_n"), F.size(F.filter("_t", lambda t: t.isin(terms))).alias("_m"))


def tallied(df: DataFrame, queries: dict[str, str], references: list[str], text: str = "text") -> DataFrame:
    """df with its text read once for several lanes: the tokens (_n), those that are terms of each query (_m_<name>) and how
    many of the references it contains (_exact). Written without the text, for tally_lane() and reference_lane()."""
    hits = reduce(lambda a, b: a + b, [F.contains(F.col("_l"), F.lit(r.lower())).cast("int") for r in references], F.lit(0))
    rest = [c for c in df.columns if c != text]
    read = df.select(*rest, F.lower(text).alias("_l"), tokens(F.col(text)).alias("_t"))
    among = lambda terms: lambda t: t.isin(terms)
    of = [F.size(F.filter("_t", among(query_terms(q)))).alias(f"_m_{name}") for name, q in queries.items()]
    return saved(read.select(*rest, F.size("_t").alias("_n"), *of, hits.cast("double").alias("_exact")))


def tally_lane(tallies: DataFrame, name: str, query: str, limit: int, id_column: str = "id") -> DataFrame:
    """lexical() of a query whose terms tallied() has counted under this name."""
    return _matching(tallies.select(F.col(id_column).alias("id"), "_n", F.col(f"_m_{name}").alias("_m")), len(query_terms(query)), "lexical", limit)


def reference_lane(tallies: DataFrame, limit: int, id_column: str = "id") -> DataFrame:
    """exact() of the references that tallied() has counted."""
    return ranked(tallies.select(F.col(id_column).alias("id"), F.col("_exact").alias("score")).where("score > 0"), "exact_reference", limit)


def _matching(counts: DataFrame, terms: int, retriever: str, limit: int) -> DataFrame:
    return ranked(counts.where("_m > 0").withColumn("score", F.round(F.col("_m") / F.sqrt(F.lit(float(terms)) * F.col("_n")), 9)), retriever, limit)


def exact(df: DataFrame, references: list[str], limit: int, text: str = "text", id_column: str = "id") -> DataFrame:
    """How many of the references a text contains, in any case."""
    hits = reduce(lambda a, b: a + b, [F.contains(F.lower(text), F.lit(r.lower())).cast("int") for r in references], F.lit(0))
    return ranked(df.select(F.col(id_column).alias("id"), hits.cast("double").alias("score")).where("score > 0"), "exact_reference", limit)


def dense(df: DataFrame, vector: list[float], limit: int, embedding: str = "embedding", id_column: str = "id") -> DataFrame:
    """Cosine with a query vector; rows at or below zero and of another dimension do not count."""
    query = F.array(*[F.lit(float(v)) for v in vector])
    scored = df.where(F.size(embedding) == len(vector)).select(F.col(id_column).alias("id"), F.round(cosine(F.col(embedding), query), 6).alias("score"))
    return ranked(scored.where("score > 0"), "dense", limit)


def fuse(lanes: list[DataFrame], weights: dict[str, float] | None = None, k: int = RRF_K, limit: int = 100) -> DataFrame:
    """Weighted reciprocal rank fusion: id, fusion, score (the best of any lane) and retrievers, best first."""
    weight: Column = F.lit(1.0)
    for lane, w in (weights or {}).items():
        weight = F.when(F.col("retriever") == lane, float(w)).otherwise(weight)
    return (
        reduce(DataFrame.unionByName, lanes)
        .groupBy("id")
        .agg(F.round(F.sum(weight / (k + F.col("rank"))), 9).alias("fusion"), F.max("score").alias("score"), F.array_join(F.array_sort(F.collect_set("retriever")), ",").alias("retrievers"))
        .orderBy(F.col("fusion").desc(), F.col("score").desc(), "id")
        .limit(limit)
    )


def variants(lanes: dict[str, DataFrame], names: dict[str, tuple[str, ...]], weights: dict[str, float] | None = None, limit: int = 100, scores: DataFrame | None = None, steps: tuple[str, ...] = ("rerank", "lazy")) -> DataFrame:
    """The lists of several variants, each fused of the lanes it names: variant, rank, id, fusion, score, retrievers.

    A variant with the step rerank is ordered by scores (id, score) from outside, missing as 0, ties as fused. Every lane is
    worked out once and written, as it is a short list that several variants read. A lane or scores that a variant names and
    that are not given are an error.
    """
    wanted = {part for parts in names.values() for part in parts} - set(steps)
    missing = sorted(wanted - lanes.keys()) + ["scores"] * (scores is None and any("rerank" in parts for parts in names.values()))
    if missing:
        raise ValueError(f"variants name lanes that are not given: {', '.join(missing)}")
    kept = {k: saved(lane) for k, lane in lanes.items() if k in wanted}
    best = scores.groupBy("id").agg(F.max("score").alias("_s")) if scores is not None else None

    def one(name: str, parts: tuple[str, ...]) -> DataFrame:
        fused = fuse([kept[k] for k in parts if k not in steps], weights, limit=limit)
        order = [F.col("fusion").desc(), F.col("score").desc(), F.col("id")]
        if "rerank" in parts:
            fused, order = fused.join(best, "id", "left"), [F.coalesce("_s", F.lit(0.0)).desc(), *order]
        rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order))  # over limit rows
        return fused.select(F.lit(name).alias("variant"), rank.alias("rank"), "id", "fusion", "score", "retrievers")

    return reduce(DataFrame.unionByName, [one(name, parts) for name, parts in names.items()])


def translated(docs: DataFrame, queries: list[str], limit: int = 50, text: str = "text", id_column: str = "id") -> list[DataFrame]:
    """A lexical lane for each of a question's first variants, all of them named translated_lexical."""
    return [lexical(docs, q, limit, text, id_column).withColumn("retriever", F.lit("translated_lexical")) for q in queries]


def in_scope(df: DataFrame, tokens: list[str], types: list[str] | None = None, as_of: str | None = None) -> DataFrame:
    """Rows whose access tokens meet the caller's, of the given types in any case, valid on a day (missing bounds are open)."""
    df = df.where(F.arrays_overlap("acl_tokens", F.array(*map(F.lit, tokens))))
    if types:
        df = df.where(F.lower("document_type").isin([t.lower() for t in types]))
    if as_of:
        day = F.lit(as_of).cast("date")
        for column, early in (("publication_date", True), ("valid_from", True), ("valid_to", False)):
            df = df.where(F.col(column).isNull() | ((F.col(column) <= day) if early else (F.col(column) >= day)))
    return df


def capped(df: DataFrame, key: str, most: int, order: list[Column]) -> DataFrame:
    """At most so many rows of each key, in an order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("_n") <= most).drop("_n")


def with_neighbours(df: DataFrame, group: str, order: str, columns: list[str]) -> DataFrame:
    """Each row with the previous and next row's columns of its group."""
    w = Window.partitionBy(group).orderBy(order)
    return df.select("*", *[F.lag(c).over(w).alias(f"previous_{c}") for c in columns], *[F.lead(c).over(w).alias(f"next_{c}") for c in columns])


def coverage(df: DataFrame, group: str, score: str, id_column: str, share: float = 0.5) -> DataFrame:
    """The best rows of each group until they hold a share of its score; the row that crosses it is in.

    Running sums go over the histogram of a group's scores, of which there are few beside its rows; only rows of the score
    at which the share is met are numbered, by id.
    """
    w = Window.partitionBy(group)
    mass = F.col("_s") * F.col("_n")
    counts = df.groupBy(group, F.col(score).alias("_s")).agg(F.count("*").alias("_n"))
    edges = (
        counts.withColumn("_upto", F.sum(mass).over(w.orderBy(F.col("_s").desc())))
        .withColumn("_goal", share * F.sum(mass).over(w))
        .where(F.col("_upto") - mass < F.col("_goal"))
        .select(F.col(group).alias("_g"), F.col("_s"), F.when(F.col("_upto") >= F.col("_goal"), F.ceil((F.col("_goal") - (F.col("_upto") - mass)) / F.col("_s"))).alias("_take"))
    )
    joined = df.join(edges, df[group].eqNullSafe(F.col("_g")) & (df[score] == F.col("_s")))
    whole, cut = joined.where("_take is null"), joined.where("_take is not null")
    numbered = cut.withColumn("_k", F.row_number().over(w.orderBy(id_column))).where("_k <= _take")
    return whole.select(*df.columns).unionByName(numbered.select(*df.columns))


def hierarchical(docs: DataFrame, query: str, collection: str, text: str = "text", id_column: str = "id", limit: int = 100) -> DataFrame:
    """Passages (document/section/ordinal) by fusion of a lane in the routed documents and sections and one in the routed collections.

    Collection, document and section lanes are fused to the routed collections; document and section lanes inside those
    join them, and their fusion routes to documents (of documents and of sections) and to sections. What is routed to
    narrows the next lanes by semi joins with lists of a fixed length; nothing reaches the driver. A text's tokens are those
    of its sections, so one pass over the texts counts for all levels, and is written. Rows without an id are left out; those without a collection are in none.
    """
    terms = query_terms(query)
    known = docs.where(F.col(id_column).isNotNull()).select(F.col(id_column).alias("doc"), F.col(collection).alias("collection"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    cut = F.substring(F.encode("text", "UTF-8"), (F.col("start_byte") + 1).cast("int"), (F.col("end_byte") - F.col("start_byte")).cast("int"))
    parts = known.join(sections(known, id_column="doc").withColumnRenamed("id", "doc"), "doc").select("collection", "doc", "section", F.decode(cut, "UTF-8").alias("text"))
    tallies = F.transform(chunk_list(F.col("text")), lambda c: F.struct(F.size(tokens(c)).alias("_n"), F.size(F.filter(tokens(c), lambda t: t.isin(terms))).alias("_m")))
    counts = saved(counted(parts.withColumn("pieces", tallies), terms, "text"))
    order = [F.col("fusion").desc(), F.col("score").desc(), F.col("id")]

    def lane(level: str, inside: DataFrame, retriever: str = "lexical") -> DataFrame:
        keys = ["collection", "doc", "section"][: list(LANES).index(level) + 1]
        names = [F.col(k) if k in keys else F.lit(None).cast(parts.schema[k].dataType).alias(k) for k in ("collection", "doc", "section")]
        sums = inside.groupBy(*keys).agg(F.sum("_n").alias("_n"), F.sum("_m").alias("_m"))
        return _matching(sums.select(F.struct(F.lit(level).alias("level"), *names).alias("id"), "_n", "_m"), len(terms), retriever, LANES[level])

    def routed(hits: DataFrame, levels: tuple[str, ...], most: int, *columns: str) -> DataFrame:
        """The distinct columns of the first hits of some levels: a short list, by which others are narrowed."""
        first = hits.where(F.col("id.level").isin(*levels)).orderBy(*order).limit(most)
        return F.broadcast(first.select(*[F.col(f"id.{c}").alias(c) for c in columns]).distinct())

    first = [lane("collection", counts.where("collection is not null")), lane("document", counts), lane("section", counts)]
    lanes = [saved(reduce(DataFrame.unionByName, first))]  # short lists, which both fusions read
    collections = routed(fuse(lanes, limit=sum(LANES.values())), ("collection",), ROUTED["collection"], "collection")
    members = counts.join(collections, "collection", "left_semi")
    hits = saved(fuse([*lanes, *(lane(level, members, "collection_member_route") for level in ("document", "section"))], limit=2 * sum(LANES.values())))
    found = routed(hits, ("document", "section"), ROUTED["document"], "doc")
    inner = routed(hits, ("section",), ROUTED["section"], "doc", "section")
    chosen = routed(hits, ("collection",), ROUTED["collection"], "collection")
    scopes = {"passage_lexical": counts.join(found, "doc", "left_semi").join(inner, ["doc", "section"], "left_semi"), "passage_lexical_collection": counts.join(chosen, "collection", "left_semi")}
    pieces = lambda rows: rows.select("doc", "section", F.posexplode("pieces").alias("ordinal", "p")).select(F.concat_ws("/", "doc", "section", "ordinal").alias("id"), "p._n", "p._m")
    return fuse([_matching(pieces(rows), len(terms), name, LANES["passage"]) for name, rows in scopes.items()], limit=limit)
