"""Where remembered facts go: routes by the scores of skills, clusters of facts for a skill, deferral until a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .narrowing import running_totals

#: Facts that are merged into a skill at once.
CLUSTER = 5
#: Fixed value: the skill of facts that none suits.
NO_SKILL = "__none__"


def unassigned(facts: DataFrame, now: Column) -> DataFrame:
    """Facts (id, created_at, skill, ignore_until) without a skill that are not put off beyond now."""
    return facts.where(F.col("skill").isNull() & (F.col("ignore_until").isNull() | (F.col("ignore_until") <= now)))


def decisions(scores: DataFrame, strong: float, weak: float) -> DataFrame:
    """fact_id, skill, score and decision (strong, weak, none) by each fact's best skill; ties go to the first name.

    Only the best score of a fact travels: it is a maximum, combined before the shuffle.
    """
    best = scores.where("score is not null and skill is not null").groupBy("fact_id").agg(F.min(F.struct((-F.col("score")).alias("s"), "skill")).alias("b"))
    score = -F.col("b.s")
    return best.select("fact_id", "b.skill", score.alias("score"), F.when(score >= strong, "strong").when(score >= weak, "weak").otherwise("none").alias("decision"))


def routed(facts: DataFrame, scores: DataFrame, now: Column, defer_seconds: int, strong: float = 0.75, weak: float = 0.4, cluster: int = CLUSTER) -> DataFrame:
    """id, decision, skill, cluster and ignore_until of every unassigned fact.

    Strong facts join their skill in clusters of at most so many, oldest first (then by id); clusters of a skill are numbered
    from 0. Weak facts keep no skill and are put off; facts that no skill suits, or that have no scores, get NO_SKILL for
    good. Numbers come from running counts over ranges, so that a skill that most facts suit is in no single task.
    """
    open_ = unassigned(facts, now).select("id", "created_at")
    judged = open_.join(decisions(scores, strong, weak).withColumnRenamed("fact_id", "id"), "id", "left").withColumn("decision", F.coalesce("decision", F.lit("none")))
    chosen = judged.where("decision = 'strong'")
    numbered = running_totals(chosen, ["skill"], [F.col("created_at"), F.col("id")], F.lit(1), "_n")
    until = F.timestamp_seconds(F.unix_timestamp(now.cast("timestamp")) + defer_seconds).cast("timestamp_ntz")
    columns = lambda skill, number, time: ["id", "decision", skill.alias("skill"), number.cast("int").alias("cluster"), time.alias("ignore_until")]
    never = F.lit(None).cast("timestamp_ntz")
    strong_rows = numbered.select(*columns(F.col("skill"), F.floor((F.col("_n") - 1) / cluster), never))
    others = judged.where("decision <> 'strong'")
    weak_ = F.col("decision") == "weak"
    return strong_rows.unionByName(others.select(*columns(F.when(~weak_, NO_SKILL), F.lit(None), F.when(weak_, until))))
