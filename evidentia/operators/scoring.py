"""Scorers of evaluation cases, and what an observed system is measured by."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import observe
from .govern import budget_score, precision_score, recall_score


def paired(cases: DataFrame, scorers: DataFrame, suite_scorers: list[str]) -> DataFrame:
    """Cases (case_id, scorer_ids, ...) with their scorers (scorer_id, ...): those of the case, or of the suite if it names none."""
    own = F.when(F.size("scorer_ids") > 0, F.col("scorer_ids")).otherwise(F.array(*map(F.lit, suite_scorers)))
    return cases.withColumn("scorer_id", F.explode(own)).drop("scorer_ids").join(scorers, "scorer_id")


def scores() -> dict[str, Column]:
    """The score of every kind of scorer over the columns actual and expected (text), found and wanted (lists), amount and
    budget (numbers). Lists are fields of an object, tools in their order, policy outcomes or retrieved ids by kind."""
    same = lambda a, b: F.coalesce(a.eqNullSafe(b), F.lit(False)).cast("double")
    holds = F.forall("wanted", lambda w: F.array_contains("found", w))
    return {
        "equals": same(F.col("actual"), F.col("expected")),
        "contains": F.contains(F.coalesce("actual", F.lit("")), F.coalesce("expected", F.lit(""))).cast("double"),
        "json_schema": F.coalesce(holds, F.lit(False)).cast("double"),
        "workflow_status": same(F.col("actual"), F.col("expected")),
        "citation_count": F.when(F.coalesce("budget", F.lit(1.0)) <= 0, 1.0).otherwise(F.least(F.lit(1.0), F.size(F.array_distinct("found")) / F.coalesce("budget", F.lit(1.0)))),
        "tool_sequence": same(F.col("found"), F.col("wanted")),
        "latency_budget": budget_score(F.col("amount"), F.col("budget")),
        "cost_budget": budget_score(F.col("amount"), F.col("budget")),
        "policy_decision": F.coalesce(F.array_contains("found", F.col("expected")), F.lit(False)).cast("double"),
        "retrieval_precision_at_k": precision_score(F.col("found"), F.col("wanted")),
        "retrieval_recall_at_k": recall_score(F.col("found"), F.col("wanted")),
    }


def scored(pairs: DataFrame) -> DataFrame:
    """pairs with score and passed by the kind of their scorer (type, threshold); an unknown kind scores 0."""
    score = F.coalesce(reduce(lambda rest, k: F.when(F.col("type") == k[0], k[1]).otherwise(rest), scores().items(), F.lit(0.0)), F.lit(0.0))
    return pairs.withColumn("score", score).withColumn("passed", F.col("score") >= F.col("threshold"))


def rubric(answer: Column, required: Column, forbidden: Column) -> Column:
    """1 if the answer meets a pattern of every required group and none that is forbidden, in any case; an empty answer never does."""
    text = F.trim(F.regexp_replace(F.coalesce(answer, F.lit("")), r"\s+", " "))
    meets = lambda p: F.regexp_like(text, F.concat(F.lit("(?i)"), p))
    good = F.forall(required, lambda group: F.exists(group, meets)) & ~F.exists(forbidden, meets) & (text != "")
    return good.cast("int")


def rows(one: DataFrame, group: str) -> DataFrame:
    """A frame of one row and named numbers as rows (group, metric, value)."""
    numbers = [F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in one.columns]
    return one.select(F.lit(group).alias("group"), F.explode(F.array(*numbers)).alias("m")).select("group", "m.metric", "m.value")


def _share(part: Column, whole: Column) -> Column:
    return F.coalesce(part / F.nullif(whole.cast("double"), F.lit(0.0)), F.lit(0.0))


def measures(traces: DataFrame, spans: DataFrame, outcomes: DataFrame, runs: DataFrame) -> DataFrame:
    """The measures of a workspace as rows (group, metric, value); every group is one aggregate, so nothing is gathered.

    traces: status, input_tokens, output_tokens, cost, duration; spans: trace_id, kind, status, duration, citations
    (array), policy; outcomes: status; runs: status, passed.
    """
    has = lambda c: F.count_if(c)
    kind, n = F.col("kind"), F.count("*")
    found = kind.isin("retriever", "reranker")
    tool, guard = kind == "tool", kind == "guardrail"
    denied = guard & F.col("policy").isin("denied", "aborted")
    blocks = {
        "traces": traces.agg(n.alias("total"), has(F.col("status") == "ok").alias("completed"), has(F.col("status") == "error").alias("errors")),
        "tokens": traces.agg(F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("input"), F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("output"), F.round(F.coalesce(F.sum("cost"), F.lit(0.0)), 6).alias("cost_usd")),
        "latency": traces.agg(F.round(F.coalesce(F.avg("duration"), F.lit(0.0)), 6).alias("average")),
        "retrieval": spans.agg(has(found).alias("operations"), F.round(F.coalesce(F.avg(F.when(found, F.col("duration"))), F.lit(0.0)), 6).alias("average_latency")),
        "actions": spans.agg(has(tool).alias("attempted"), has(tool & (F.col("status") == "ok")).alias("succeeded"), has(tool & (F.col("status") == "error")).alias("failed"), F.round(_share(has(tool & (F.col("status") == "ok")), has(tool)), 6).alias("success_rate")),
        "policy": spans.agg(has(guard).alias("decisions"), has(denied).alias("denied"), F.round(_share(has(denied), has(guard)), 6).alias("deny_rate")),
        "workflows": outcomes.agg(
            n.alias("outcomes"), *[has(F.col("status") == s).alias(a) for s, a in (("verified_completed", "verified"), ("failed", "failed"), ("escalated", "escalated"))],
            F.round(_share(has(F.col("status") == "verified_completed"), n), 6).alias("completion_rate"), F.round(_share(has(F.col("status") == "escalated"), n), 6).alias("escalation_rate"),
        ),
        "evaluations": runs.where("status = 'completed'").agg(n.alias("runs"), has(F.col("passed")).alias("passed"), F.round(_share(has(F.col("passed")), n), 6).alias("pass_rate")),
    }
    cited = spans.select("trace_id", F.size("citations").alias("n")).where("n > 0").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("resolved"), F.count_distinct("trace_id").alias("traces_with_citations"))
    spread = observe.percentiles(traces, "duration", [], {"p50": 0.5, "p95": 0.95, "p99": 0.99})
    kinds = spans.groupBy(F.col("kind").alias("metric")).agg(n.cast("double").alias("value")).select(F.lit("spans").alias("group"), "metric", "value")
    return reduce(DataFrame.unionByName, [*(rows(b, g) for g, b in blocks.items()), rows(cited, "citations"), rows(spread, "latency"), kinds])


def returns(baselines: DataFrame, outcomes: DataFrame, traces: DataFrame) -> DataFrame:
    """The whole return of a workspace in one row: verified outcomes, hours and benefits, costs, net benefit, its share of
    the costs and the outcomes that pay them back; the last two are null where there is nothing to divide by.

    baselines (baseline_id, manual_minutes, hourly_rate, fixed_cost); outcomes (baseline_id, active_minutes,
    review_minutes, rework_minutes, additional_value), verified ones; traces (cost).
    """
    hours = F.greatest(F.lit(0.0), F.col("manual_minutes") - F.col("active_minutes") - F.col("review_minutes") - F.col("rework_minutes")) / 60
    all_ = outcomes.agg(F.count("*").alias("verified_outcomes"))
    gained = outcomes.join(baselines, "baseline_id").agg(*[F.coalesce(F.sum(e), F.lit(0.0)).alias(a) for e, a in ((hours, "hours"), (hours * F.col("hourly_rate"), "labor"), (F.col("additional_value"), "extra"))])
    spent = traces.agg(F.coalesce(F.sum("cost"), F.lit(0.0)).alias("operating"))
    fixed = baselines.agg(F.coalesce(F.sum("fixed_cost"), F.lit(0.0)).alias("fixed"))
    one = reduce(lambda a, b: a.join(F.broadcast(b)), [all_, gained, spent, fixed])  # of one row each
    benefit, cost = F.col("labor") + F.col("extra"), F.col("operating") + F.col("fixed")
    each = benefit / F.nullif(F.col("verified_outcomes"), F.lit(0))
    return one.select(
        "verified_outcomes", F.round("hours", 6).alias("time_saved_hours"), F.round(benefit, 4).alias("total_benefit"), F.round(cost, 4).alias("total_cost"), F.round(benefit - cost, 4).alias("net_benefit"),
        F.round((benefit - cost) / F.nullif(cost, F.lit(0.0)), 6).alias("roi"), F.round(cost / F.when(each > 0, each), 6).alias("payback_outcomes"),
    )


def summary(cases: DataFrame, category: str, names: list[str]) -> DataFrame:
    """The mean of each measure over all cases (category null) and by category, with their number."""
    return cases.groupingSets([[], [category]], category).agg(F.count("*").alias("cases"), *[F.round(F.avg(n), 6).alias(n) for n in names])


def leakage(evidence: DataFrame, forbidden: DataFrame) -> DataFrame:
    """The share of a case's evidence (case_id, id) that it must not see (case_id, id); 0 without evidence."""
    marked = evidence.join(forbidden.distinct().withColumn("_bad", F.lit(1)), ["case_id", "id"], "left")
    return marked.groupBy("case_id").agg(F.round(F.count("_bad") / F.count("*"), 6).alias("leakage"))


def citation_validity(evidence: DataFrame, passages: DataFrame) -> DataFrame:
    """The share of a case's evidence (case_id, id, start_byte, end_byte, content_sha256) that is what its passage says (id and the same columns)."""
    names = ("start_byte", "end_byte", "content_sha256")
    known = passages.select("id", *[F.col(n).alias(f"_{n}") for n in names])
    right = reduce(lambda a, b: a & b, [F.col(n).eqNullSafe(F.col(f"_{n}")) for n in names])
    return evidence.join(known, "id", "left").groupBy("case_id").agg(F.round(F.avg(F.coalesce(right, F.lit(False)).cast("double")), 6).alias("citation_correctness"))
