"""Retrieval for a table of questions at once: a fused first pass, what it lacks, and a second pass for the questions that need one."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import saved
from . import evidence, planning, postings
from .retrieval import RRF_K

#: Hits of a fused list, of a first lane and of a lane of the second pass; follow-up queries of a question at most.
FUSED, FIRST, SECOND, FOLLOW_UPS = 100, 150, 100, 4
#: Fewer hits than this, and nothing to take the question apart by, ask for a search for more evidence.
FEW = 3


def fuse_many(lanes: list[DataFrame], weights: dict[str, float] | None = None, limit: int = FUSED, k: int = RRF_K) -> DataFrame:
    """Weighted reciprocal rank fusion of each question's lanes (query, retriever, rank, score, id): query, rank, id, fusion,
    score (the best of any lane) and retrievers. Lanes are short lists, so a question's rows are few."""
    weight: Column = F.lit(1.0)
    for lane, w in (weights or {}).items():
        weight = F.when(F.col("retriever") == lane, float(w)).otherwise(weight)
    fused = (
        reduce(DataFrame.unionByName, [lane.select("query", "retriever", F.col("rank").cast("int").alias("rank"), "score", "id") for lane in lanes])
        .groupBy("query", "id")
        .agg(F.round(F.sum(weight / (k + F.col("rank"))), 9).alias("fusion"), F.max("score").alias("score"), F.array_sort(F.collect_set("retriever")).alias("retrievers"))
    )
    order = Window.partitionBy("query").orderBy(F.col("fusion").desc(), F.col("score").desc(), "id")
    return fused.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select("query", "rank", "id", "fusion", "score", "retrievers")


def assessed(plan: DataFrame, hits: DataFrame, texts: DataFrame) -> DataFrame:
    """query, intent, n (hits) and status (sufficient, insufficient or conflicting) of every question of a plan.

    texts has id, document_id, section_id and text; only the texts of hits are looked at, and of them only those of the
    first thirty for what they claim and deny. A question without hits is insufficient.
    """
    positive, negative = evidence.polarity(F.when(F.col("rank") <= 30, F.col("text")))
    found = hits.join(texts.select("id", "document_id", "section_id", "text"), "id").select(
        F.col("query").alias("query_id"), "rank", "document_id", "section_id", F.array_contains("retrievers", "exact_reference").alias("exact"), positive, negative
    )
    found = saved(found)
    verdict = evidence.answerability(plan.select(F.col("id").alias("query_id"), "intent"), found)
    counts = found.groupBy("query_id").agg(F.count("*").alias("n"))
    return plan.select(F.col("id").alias("query_id"), "intent").join(verdict.select("query_id", "status"), "query_id").join(counts, "query_id", "left").select(
        F.col("query_id").alias("query"), "intent", F.coalesce("n", F.lit(0)).alias("n"), "status"
    )


def follow_ups(plan: DataFrame, verdicts: DataFrame) -> DataFrame:
    """query, n (from 1), text and reason of what a second pass asks: FOLLOW_UPS a question at most.

    Comparisons, diagnoses and questions whose first pass does not suffice are taken apart; a conflict asks for the current
    version too; a question that nothing takes apart and that has FEW hits asks for supporting evidence.
    """
    item = lambda key: F.array(F.struct(F.concat("query_text", F.lit(planning.ADDED[key])).alias("query"), F.lit(planning.REASONS[key]).alias("reason")))
    none = F.slice(item("conflict"), 1, 0)
    rows = plan.select(F.col("id").alias("query"), F.col("query").alias("query_text"), "parts").join(verdicts, "query")
    rows = rows.where(F.col("intent").isin("comparison", "diagnostic") | (F.col("status") != "sufficient"))
    every = F.concat("parts", F.when(F.col("status") == "conflicting", item("conflict")).otherwise(none))
    rows = rows.withColumn("every", every)
    recovered = F.when((F.size("every") == 0) & (F.col("n") < FEW), item("evidence")).otherwise(F.col("every"))
    return rows.select("query", F.posexplode(F.slice(recovered, 1, FOLLOW_UPS)).alias("k", "f")).select("query", (F.col("k") + 1).alias("n"), F.col("f.query").alias("text"), "f.reason")


def searched(questions: DataFrame, index: postings.PostingIndex, texts: DataFrame, lanes: list[DataFrame] | None = None, weights: dict[str, float] | None = None, text: str = "text", id_column: str = "id") -> DataFrame:
    """query, rank, id, fusion, score, retrievers and passes (1 or 2) of every question that finds anything.

    The first pass fuses the lexical lane over the index with the lanes given. Where planning and that pass ask for more, the
    lexical lanes of the follow-ups are fused with the first list; other questions keep theirs as it is. Nothing is
    collected: what a question needs is a row, and all questions' lanes are made in one join with the index.
    """
    plan = saved(planning.planned(questions, text, id_column))
    lane = postings.lexical_many(index, plan.select("id", "query"), FIRST, "id", "query").withColumn("retriever", F.lit("lexical"))
    first = saved(fuse_many([lane, *(lanes or [])], weights))
    more = saved(follow_ups(plan, assessed(plan, first, texts)))
    asked = more.select(F.struct("query", "n").alias("key"), "text")
    second = postings.lexical_many(index, asked, SECOND, "key", "text").select(
        F.col("query.query").alias("query"), F.concat(F.lit("iterative_lexical_"), F.col("query.n")).alias("retriever"), "rank", "score", "id"
    )
    again = more.select("query").distinct()
    before = first.join(again, "query", "left_semi").withColumn("retriever", F.lit("first_pass_fused"))
    refused = fuse_many([before, second], None).withColumn("passes", F.lit(2))
    return first.join(again, "query", "left_anti").withColumn("passes", F.lit(1)).unionByName(refused)
