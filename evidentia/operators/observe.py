"""Traces, spans, prices, returns and ranking metrics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import saved
from .narrowing import running_totals


#: Up to so many pairs of group and value, running sums go over a group's values in one task; beyond it, over ranges of them.
FEW_VALUES = 1_000_000


def percentiles(df: DataFrame, value: str, by: list[str], shares: dict[str, float], few: int = FEW_VALUES) -> DataFrame:
    """Nearest-rank percentiles of each group, exact: the smallest value that so many of the group's are at most.

    The input is read once, to count each value of each group, before the shuffle first. All else works on the counts, which
    are written and counted: few of them are summed group by group, more by ranges, so that a group of any size, and of any
    number of values, meets in no task. Nulls of value do not count; null is a group.
    """
    counts = saved(df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_v")).agg(F.count("*").alias("_n")))
    if counts.limit(few + 1).count() <= few:
        upto = counts.withColumn("_upto", F.sum("_n").over(Window.partitionBy(*(by or [F.lit(0)])).orderBy("_v")))
    else:
        upto = running_totals(counts, by, [F.col("_v")], F.col("_n"), "_upto")
    keys = [f"_k{n}" for n in range(len(by))]
    totals = counts.groupBy(*[F.col(c).alias(k) for c, k in zip(by, keys)]).agg(F.sum("_n").alias("_all"))
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(k)) for c, k in zip(by, keys)], F.lit(True))
    rank = lambda share: F.greatest(F.lit(1), F.ceil(F.col("_all") * F.lit(share)))
    return upto.join(totals, same).groupBy(*by).agg(*[F.min(F.when(F.col("_upto") >= rank(s), F.col("_v"))).alias(n) for n, s in shares.items()])


def trace_rollup(events: DataFrame, trace: str, time: str, kind: str, value: str) -> DataFrame:
    """One row per trace: first and last time, events, distinct kinds, total value, and the kind of the last event."""
    return events.groupBy(F.col(trace).alias("trace_id")).agg(
        F.min(time).alias("started_at"), F.max(time).alias("updated_at"), F.count("*").alias("n_events"), F.count_distinct(kind).alias("n_kinds"),
        F.round(F.sum(value), 6).alias("total_value"), F.max_by(kind, F.struct(time, "event_id")).alias("last_kind"),
    )


def price(tokens_in: Column, cached: Column, tokens_out: Column, direct: Column | None = None) -> Column:
    """Dollars of a call: what it says itself, if over 0; else at rates per million (columns rate_in, rate_cached, by default
    that of input, and rate_out): nothing without a rate or for a negative count or rate."""
    rate_cached = F.coalesce("rate_cached", "rate_in")
    bad = (tokens_in < 0) | (cached < 0) | (tokens_out < 0) | (F.col("rate_in") < 0) | (rate_cached < 0) | (F.col("rate_out") < 0)
    cost = (F.greatest(tokens_in - cached, F.lit(0)) * F.col("rate_in") + cached * rate_cached + tokens_out * F.col("rate_out")) / 1e6
    rated = F.when(bad | F.col("rate_in").isNull(), 0.0).otherwise(cost)
    return rated if direct is None else F.when(direct > 0, direct).otherwise(rated)


def roi(baselines: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Per workflow the verified outcomes, hours saved and benefit; outcomes without a baseline do not count."""
    joined = outcomes.join(baselines, "workflow_id")
    saved = F.greatest(F.lit(0.0), F.col("manual_minutes") - F.col("active_minutes") - F.col("review_minutes") - F.col("rework_minutes")) / 60
    return joined.groupBy("workflow_id").agg(
        F.count("*").alias("verified_outcomes"), F.round(F.sum(saved), 6).alias("time_saved_hours"), F.round(F.sum(saved * F.col("hourly_rate") + F.col("additional_value")), 4).alias("benefit")
    )


def ir_metrics(ranking: DataFrame, judged: DataFrame, k: int) -> DataFrame:
    """Per case recall, precision, nDCG at k and reciprocal rank of (case_id, rank, id) against (case_id, id, relevance).

    A case without relevant rows has recall 1 and nDCG 1; without a ranking, precision 0.
    """
    top = ranking.where(F.col("rank") <= k)
    hit = top.join(judged, ["case_id", "id"], "left").groupBy("case_id").agg(
        F.count("*").alias("n"), F.count_if(F.col("relevance") > 0).alias("hits"),
        F.sum((F.pow(F.lit(2.0), F.coalesce("relevance", F.lit(0))) - 1) / F.log2(F.col("rank") + 1.0)).alias("dcg"),
        F.min(F.when(F.col("relevance") > 0, F.col("rank"))).alias("first"),
    )
    best = judged.where("relevance > 0").withColumn("r", F.row_number().over(Window.partitionBy("case_id").orderBy(F.col("relevance").desc(), "id")))
    ideal = best.groupBy("case_id").agg(F.count("*").alias("relevant"), F.sum(F.when(F.col("r") <= k, (F.pow(F.lit(2.0), "relevance") - 1) / F.log2(F.col("r") + 1.0))).alias("ideal"))
    cases = judged.select("case_id").distinct().join(hit, "case_id", "left").join(ideal, "case_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return cases.select(
        "case_id",
        F.round(F.when(zero("relevant") == 0, 1.0).otherwise(zero("hits") / F.col("relevant")), 6).alias("recall"),
        F.round(F.when(zero("n") == 0, 0.0).otherwise(zero("hits") / F.col("n")), 6).alias("precision"),
        F.round(F.when(zero("ideal") == 0, 1.0).otherwise(zero("dcg") / F.col("ideal")), 6).alias("ndcg"),
        F.round(F.coalesce(1.0 / F.col("first"), F.lit(0.0)), 6).alias("mrr"),
    )


def staleness(state: str, read_at: str, sla_seconds: str, at: Column) -> Column:
    """A known state wins; else stale from the end of the agreed time on, fresh without one, unknown if never read."""
    due = F.timestamp_seconds(F.unix_timestamp(F.col(read_at).cast("timestamp")) + F.col(sla_seconds))
    return (
        F.when(F.col(state).isNotNull() & (F.col(state) != "unknown"), F.col(state))
        .when(F.col(read_at).isNull(), "unknown")
        .when(F.col(sla_seconds).isNull(), "fresh")
        .when(due <= at, "stale")
        .otherwise("fresh")
    )
