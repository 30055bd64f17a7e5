"""Running totals over any order at scale, and searches whose results share one budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import pattern_fault
from ..session import saved

#: Document versions that a pattern may be asked of, hits, and bytes of all hits together.
MOST_VERSIONS, MOST_HITS, MOST_BYTES = 50, 100, 2 << 20


def running_totals(rows: DataFrame, group: list[str], order: list[Column], amount: Column, name: str = "upto") -> DataFrame:
    """rows with the running sum of an amount within each group, in an order that should be total; nulls add nothing.

    A window over a group would bring it into one task. Here rows are dealt by ranges of group and order and written; sums of
    each range and group are added up first, which are few, and each range adds its own rows to what lies before it. A group
    that holds most rows fills many ranges.
    """
    part, own, before = "_part", "_own", "_before"
    dealt = rows.withColumn(name, F.coalesce(amount, F.lit(0))).repartitionByRange(*group, *order).withColumn(part, F.spark_partition_id())
    dealt = saved(dealt)
    inside = Window.partitionBy(part, *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    sums = dealt.groupBy(part, *group).agg(F.sum(name).alias(own))
    upto = sums.withColumn(before, F.sum(own).over(Window.partitionBy(*(group or [F.lit(0)])).orderBy(part)) - F.col(own)).drop(own)
    keys = [part, *group]
    upto = upto.select(before, *[F.col(k).alias(f"_k{n}") for n, k in enumerate(keys)])
    joined = dealt.withColumn(own, F.sum(name).over(inside)).join(upto, [F.col(k).eqNullSafe(F.col(f"_k{n}")) for n, k in enumerate(keys)])
    return joined.withColumn(name, F.col(own) + F.col(before)).select(*rows.columns, name)


def within(rows: DataFrame, order: list[Column], amount: Column, budget: int) -> DataFrame:
    """The first rows, in an order, whose amounts stay within one budget over the whole table."""
    return running_totals(rows, [], order, amount, "_upto").where(F.col("_upto") <= budget).drop("_upto")


def grep_versions(passages: DataFrame, versions: list, pattern: str, limit: int = 50, tokens: list[str] | None = None, budget: int = MOST_BYTES) -> DataFrame:
    """rank, version, ordinal and text of the passages (version, ordinal, text, acl_tokens) that a pattern finds, in any case.

    Between 1 and MOST_VERSIONS versions may be asked, with a pattern that pattern_fault() passes; else ValueError. At most
    limit hits, MOST_HITS in the end, by version and ordinal, up to the first that would take their bytes past the budget.
    With tokens, only passages that they open. The filter runs at the scan and only the first hits leave it.
    """
    if not 1 <= len(versions) <= MOST_VERSIONS:
        raise ValueError(f"a pattern is asked of 1 to {MOST_VERSIONS} document versions")
    if fault := pattern_fault(pattern):
        raise ValueError(f"this pattern is not searched for: {fault}")
    found = passages.where(F.col("version").isin(versions) & F.col("text").rlike(f"(?i){pattern}"))
    if tokens is not None:
        found = found.where(F.arrays_overlap("acl_tokens", F.array(*map(F.lit, tokens))))
    first = found.orderBy("version", "ordinal").limit(max(1, min(limit, MOST_HITS)))
    order = Window.partitionBy(F.lit(0)).orderBy("version", "ordinal")  # over so many rows at most
    upto = F.sum(F.octet_length("text")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return first.withColumn("_upto", upto).withColumn("rank", F.row_number().over(order)).where(F.col("_upto") <= budget).select("rank", "version", "ordinal", "text")
