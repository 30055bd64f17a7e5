"""Who may call what, what reviewers said, and what is complete enough to publish; a join to the latest earlier row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Labels that accept and that reject.
ACCEPT = ("accepted", "approve", "approved", "correct", "good", "useful", "true_positive", "would_execute", "match")
REJECT = ("rejected", "reject", "incorrect", "bad", "not_useful", "false_positive", "would_not_execute", "no_action", "mismatch")


def covers(patterns: Column, tool: Column, action: Column) -> Column:
    """Whether any pattern is *, the tool, tool:action, or a prefix of the tool that ends in *."""
    prefix = lambda p: F.endswith(p, F.lit("*")) & F.startswith(tool, F.substring(p, F.lit(1), F.length(p) - 1))
    return F.coalesce(F.exists(patterns, lambda p: (p == tool) | F.coalesce(p == F.concat(tool, F.lit(":"), action), F.lit(False)) | prefix(p)), F.lit(False))


def decisions(calls: DataFrame, grants: DataFrame, at: Column) -> DataFrame:
    """Calls (principal, connector, tool, action, scopes) with a decision: denied, allowed or no grant.

    Grants (connector, principal or *, allowed_tools, denied_tools, scopes, expires_at) that have expired do not count; a
    denial beats every permission; scopes need the wildcard or each of those asked. Distinct calls are decided, not
    each call: a connector with a hot principal is one row until the verdicts are joined back.
    """
    keys = ["principal", "connector", "tool", "action", "scopes"]
    kinds = calls.select(*keys).distinct()
    live = grants.where(F.col("expires_at").isNull() | (F.col("expires_at") > at)).select(
        F.col("connector").alias("_c"), F.col("principal").alias("_p"), "allowed_tools", "denied_tools", F.col("scopes").alias("_s")
    )
    on = (kinds["connector"] == live["_c"]) & ((live["_p"] == "*") | (live["_p"] == kinds["principal"]))
    scoped = F.array_contains("_s", "*") | (F.size(F.array_except("scopes", "_s")) == 0)
    judged = kinds.join(live, on, "left").groupBy(*keys).agg(
        F.bool_or(covers(F.col("denied_tools"), F.col("tool"), F.col("action"))).alias("_deny"),
        F.bool_or(covers(F.col("allowed_tools"), F.col("tool"), F.col("action")) & F.coalesce(scoped, F.lit(False))).alias("_allow"),
    )
    verdict = F.when(F.col("_deny"), "denied").when(F.col("_allow"), "allowed").otherwise("no grant")
    judged = judged.select(*[F.col(k).alias(f"_{k}") for k in keys], verdict.alias("decision"))
    same = reduce(lambda a, b: a & b, [calls[k].eqNullSafe(judged[f"_{k}"]) for k in keys])
    return calls.join(judged, same).drop(*[f"_{k}" for k in keys])


def outcome(labels: Column) -> Column:
    """accepted, rejected, mixed or unlabeled, of labels in any case."""
    clean = F.filter(F.transform(labels, lambda x: F.lower(F.trim(x))), lambda x: x != "")
    yes, no = (F.arrays_overlap(clean, F.array(*map(F.lit, words))) for words in (ACCEPT, REJECT))
    return F.when(F.coalesce(F.size(clean), F.lit(0)) <= 0, "unlabeled").when(yes & ~no, "accepted").when(no & ~yes, "rejected").otherwise("mixed")


#: What an outcome scores.
OUTCOME_SCORES = {"accepted": 1.0, "rejected": 0.0, "mixed": 0.5, "unlabeled": 0.0}


def outcome_score(outcome_column: Column) -> Column:
    return F.coalesce(*[F.when(outcome_column == name, score) for name, score in OUTCOME_SCORES.items()])


def shadow_summary(comparisons: DataFrame) -> DataFrame:
    """Comparisons (workflow_id, outcome) counted: place, workflow_id (null: all), total, a count for each outcome, and the
    rate of accepted ones. Place 0 is the whole, the workflows follow by total, then id; unknown outcomes are unlabeled."""
    known = comparisons.withColumn("outcome", F.when(F.col("outcome").isin("accepted", "rejected", "mixed"), F.col("outcome")).otherwise("unlabeled"))
    sums = known.groupingSets([["workflow_id"], []], "workflow_id").agg(
        F.grouping("workflow_id").alias("_whole"), F.count("*").alias("total"), *[F.count_if(F.col("outcome") == o).alias(o) for o in OUTCOME_SCORES]
    )
    rate = F.round(F.coalesce(F.col("accepted") / F.nullif(F.col("total"), F.lit(0)), F.lit(0.0)), 9)
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("_whole").desc(), F.col("total").desc(), "workflow_id")) - 1  # a row a workflow
    return sums.select(place.alias("place"), "workflow_id", "total", *OUTCOME_SCORES, rate.alias("acceptance_rate"))


# The severity of an issue; what is not critical is a warning.
CRITICAL = ("expired", "down", "permission_denied")


def findings_in_order(found: DataFrame) -> DataFrame:
    """Findings, the critical ones first, then by source and issue: a total order for paging."""
    return found.orderBy((F.col("severity") == "critical").desc(), "source_id", "issue")


def findings(sources: DataFrame, unknown: bool = False) -> DataFrame:
    """(source_id, issue, severity) for each issue of sources (id, health, permission, staleness); null states raise none."""
    health, stale = F.col("health"), F.col("staleness")
    late = ["expired", "stale"] + (["unknown"] if unknown else [])
    issues = F.array_compact(F.array(
        F.when(health.isin("down", "degraded"), health), F.when(F.col("permission") == "denied", "permission_denied"),
        F.when(stale.isin(late), F.when(stale == "unknown", "unknown_freshness").otherwise(stale)),
    ))
    rows = sources.select(F.col("id").alias("source_id"), F.explode(issues).alias("issue"))
    return rows.withColumn("severity", F.when(F.col("issue").isin(*CRITICAL), "critical").otherwise("warning"))


def health_report(sources: DataFrame, unknown: bool = False) -> DataFrame:
    """One row: sources in all, healthy, stale and unhealthy ones, and findings by severity."""
    per = findings(sources, unknown).groupBy("source_id").agg(
        F.bool_or(F.col("issue").isin("stale", "expired")).alias("late"), F.bool_or(F.col("issue").isin("degraded", "down", "permission_denied")).alias("bad"),
        F.count_if(F.col("severity") == "warning").alias("w"), F.count_if(F.col("severity") == "critical").alias("c"),
    )
    joined = sources.select("id").join(per, F.col("id") == F.col("source_id"), "left")
    return joined.agg(
        F.count("*").alias("sources"), F.count_if(F.col("source_id").isNull()).alias("healthy"), F.count_if("late").alias("stale"), F.count_if("bad").alias("unhealthy"),
        F.coalesce(F.sum("w"), F.lit(0)).alias("warnings"), F.coalesce(F.sum("c"), F.lit(0)).alias("criticals"),
    )


def complete_signatures(sections: DataFrame, summaries: DataFrame) -> DataFrame:
    """Per document the signature of its latest summary, where no section lacks one.

    sections (id, section), summaries (id, section, signature, created): relational division by two counts.
    """
    latest = summaries.groupBy("id", "section").agg(F.max_by(F.struct("signature", "created"), F.struct("created", "signature")).alias("s"))
    joined = sections.join(latest, ["id", "section"], "left")
    whole = joined.groupBy("id").agg(F.count("*").alias("_n"), F.count("s").alias("_have"), F.max_by("s.signature", F.struct("s.created", "s.signature")).alias("signature"))
    return whole.where("_n = _have").select("id", "signature")


def publication_state(documents: Column, embedded: Column) -> Column:
    return F.when(embedded == 0, "lexical").when(embedded == documents, "hybrid_complete").otherwise("hybrid_partial")


def waits(requests: DataFrame, approvals: DataFrame, key: str, time: str) -> DataFrame:
    """Seconds from the last request of a key to each of its approvals, at least 0."""
    last = requests.groupBy(key).agg(F.max(time).alias("_asked"))
    gap = F.unix_micros(F.col(time).cast("timestamp")) - F.unix_micros(F.col("_asked").cast("timestamp"))
    return approvals.join(last, key).withColumn("wait_seconds", F.round(F.greatest(F.lit(0), gap) / 1e6, 6)).drop("_asked")


def merged_attributes(events: DataFrame, key: str, order: list[str], attributes: str) -> DataFrame:
    """One map per key; of an attribute that several events set, the last one stays. Folds before the shuffle, per attribute."""
    rows = events.select(key, *order, F.explode(attributes).alias("_k", "_v"))
    last = rows.groupBy(key, "_k").agg(F.max_by("_v", F.struct(*order)).alias("_v"))
    return last.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("_k", "_v")))).alias(attributes))


def as_of(left: DataFrame, right: DataFrame, key: str, time: str, values: list[str], width: int = 86_400) -> DataFrame:
    """Each left row with the values of the latest right row of its key at or before its time, null where there is none.

    Time is cut into buckets of width seconds. Within a bucket both sides are stacked and carried forward, so that no pair
    of rows is ever made; a row that finds nothing there takes the last row of the buckets before, of which a key has few.
    So a key of any size is spread over its buckets. Right rows of one time and key must agree, or any of them counts.
    """
    names, kind = left.columns, right.select(F.struct(*values)).schema[0].dataType
    bucket = F.floor(F.unix_micros(F.col(time).cast("timestamp")) / (width * 1_000_000)).alias("_b")
    own, other = left.select("*", bucket), right.select(key, time, bucket, F.struct(*values).alias("_v"))
    stacked = own.select("*", F.lit(1).alias("_left"), F.lit(None).cast(kind).alias("_v")).unionByName(other.withColumn("_left", F.lit(0)), allowMissingColumns=True)
    inside = Window.partitionBy(key, "_b").orderBy(time, "_left").rowsBetween(Window.unboundedPreceding, 0)
    carried = stacked.withColumn("_v", F.last("_v", ignorenulls=True).over(inside)).where("_left = 1")
    buckets = stacked.groupBy(F.col(key).alias("_k"), F.col("_b").alias("_c")).agg(F.max_by("_v", F.when(F.col("_left") == 0, F.col(time))).alias("_last"))
    before = Window.partitionBy("_k").orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    known = buckets.withColumn("_before", F.last("_last", ignorenulls=True).over(before)).drop("_last").where("_before is not null")
    found = carried.join(known, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_b") == F.col("_c")), "left")
    return found.withColumn("_v", F.coalesce("_v", "_before")).select(*names, *[F.col(f"_v.{v}").alias(v) for v in values])


# scores of single cases, 0 to 1


def budget_score(value: Column, budget: Column) -> Column:
    """1 within the budget, the share that it covers beyond it, 0 without one."""
    return F.when(value <= budget, 1.0).when(budget > 0, F.greatest(F.lit(0.0), budget / value)).otherwise(0.0)


def precision_score(found: Column, expected: Column) -> Column:
    hits = F.size(F.filter(found, lambda x: F.array_contains(expected, x)))
    return F.when(F.size(found) <= 0, 0.0).otherwise(hits / F.size(found))


def recall_score(found: Column, expected: Column) -> Column:
    hits = F.size(F.filter(found, lambda x: F.array_contains(expected, x)))
    return F.when(F.size(expected) <= 0, 1.0).otherwise(hits / F.size(F.array_distinct(expected)))
