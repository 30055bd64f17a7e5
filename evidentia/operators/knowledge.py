"""Knowledge entries by names and by headings: an entity shortcut, weights of headings and bodies, a clear winner or a share of the weight."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .retrieval import coverage

#: What a term weighs in a heading by its level, how much better a clear winner is, and the share that is kept.
HEADING_WEIGHTS = {1: 20, 2: 10, 3: 5}
DOMINANCE, COVERAGE = 2, 0.5
HEADING = r"^(#{1,3})(?!#)\s+(.+)"


def plain_name(text: Column) -> Column:
    """Letters a-z and digits alone, in lower case: names that only spaces, marks or case part are equal."""
    return F.regexp_replace(F.lower(text), "[^a-z0-9]", "")


def content_score(content: Column, terms: list[str]) -> Column:
    """Line by line: a heading that holds a term weighs what its level says, any other line one for each time that it says it."""
    low = [t.lower() for t in terms if t]

    def line_score(line: Column) -> Column:
        heading = F.lower(F.regexp_extract(line, HEADING, 2))
        level = F.length(F.regexp_extract(line, HEADING, 1))
        weight = reduce(lambda rest, k: F.when(level == k, HEADING_WEIGHTS[k]).otherwise(rest), HEADING_WEIGHTS, F.lit(0))
        held = reduce(lambda a, b: a + b, [F.contains(heading, F.lit(t)).cast("int") for t in low])
        body = F.lower(line)
        said = reduce(lambda a, b: a + b, [F.floor((F.length(body) - F.length(F.replace(body, F.lit(t), F.lit("")))) / len(t)) for t in low])
        return F.when(level > 0, weight * held).otherwise(said).cast("long")

    if not low:
        return F.lit(0).cast("long")
    return F.aggregate(F.transform(F.split(F.coalesce(content, F.lit("")), "\n"), line_score), F.lit(0).cast("long"), lambda s, x: s + x)


def named(entities: Column, terms: list[str]) -> Column:
    """Whether one of the entities holds a term or lies in one, as plain names."""
    plain = F.transform(F.coalesce(entities, F.array().cast("array<string>")), plain_name)
    test = lambda t: F.exists(plain, lambda e: F.contains(e, plain_name(F.lit(t))) | F.contains(plain_name(F.lit(t)), e))
    return reduce(lambda a, b: a | b, [test(t) for t in terms], F.lit(False))


def scored(entries: DataFrame, terms: list[str]) -> DataFrame:
    """id, named and score of every entry (id, entities, content): one pass, no shuffle. Nulls are no names and no lines."""
    return entries.select("id", named(F.col("entities"), terms).alias("named"), content_score(F.col("content"), terms).alias("score"))


def search(entries: DataFrame, terms: list[str], scores: DataFrame | None = None) -> DataFrame:
    """The entries that answer the terms, best first: rank, id, score and step.

    A single entry with such a name wins at once (step entity). Else of the named ones, or of all if none is, those with a
    score compete: the first wins if it is DOMINANCE times as good as the second or alone (content). Otherwise outside scores
    (id, score; missing is 0) order them, and the best stay until they hold COVERAGE of the weight (rerank); without outside
    scores the first wins (fallback). Ties go to the smallest id. No terms or no entries find nothing.
    """
    if not terms:
        return entries.sparkSession.createDataFrame([], f"rank int, id {dict(entries.dtypes)['id']}, score double, step string")
    every = scored(entries, terms)
    count = every.agg(F.count_if("named").alias("_names"))
    pool = every.join(F.broadcast(count)).where((F.col("_names") == 0) | F.col("named"))  # one row beside every entry
    alone = pool.where("_names = 1").select(F.lit(1).alias("rank"), "id", F.col("score").cast("double").alias("score"), F.lit("entity").alias("step"))
    rivals = pool.where("_names <> 1 and score > 0").select("id", F.col("score").cast("double").alias("score"))
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("score").desc(), "id")
    two = rivals.orderBy(F.col("score").desc(), "id").limit(2).withColumn("_second", F.lead("score").over(order)).withColumn("rank", F.row_number().over(order)).where("rank = 1")
    clear = F.col("_second").isNull() | (F.col("score") >= DOMINANCE * F.col("_second"))
    first = two.select("rank", "id", "score", F.when(clear, "content").otherwise("fallback").alias("step"))
    if scores is None:
        return alone.unionByName(first)
    best = scores.groupBy("id").agg(F.max("score").alias("_s"))
    open_ = first.where("step = 'fallback'").select(F.lit(True).alias("_open"))
    ranked = rivals.join(F.broadcast(open_)).join(best, "id", "left").select(F.lit(0).alias("_pool"), "id", F.coalesce("_s", F.lit(0.0)).alias("score"))
    kept = coverage(ranked.where("score > 0"), "_pool", "score", "id", COVERAGE)
    reranked = kept.select(F.row_number().over(order).cast("int").alias("rank"), "id", "score", F.lit("rerank").alias("step"))
    return alone.unionByName(first.where("step = 'content'")).unionByName(reranked)
