"""Reconciling what an index knows with what a scan has seen, without taking an unfinished scan for deletions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def actions(known: DataFrame, seen: DataFrame, scans: DataFrame) -> DataFrame:
    """root, path and action: add, update, keep, delete or hold.

    known and seen have root, path and fingerprint, scans root, available and complete. A file that is known and was not seen
    goes only if its root was there and its scan came to the end; else it is held, with what is published of it. So a
    root without a row in scans holds all it has. What was seen is added, updated where the fingerprint differs, or kept.
    Repeated rows of a path count once, with the greatest fingerprint; rows without a path are left out.
    """
    once = lambda df, name: df.where("path is not null").groupBy("root", "path").agg(F.max("fingerprint").alias(name), F.lit(True).alias(f"{name}_there"))
    ended = scans.groupBy("root").agg(F.bool_and(F.coalesce("available", F.lit(False)) & F.coalesce("complete", F.lit(False))).alias("ended"))
    both = once(known, "old").join(once(seen, "new"), ["root", "path"], "full")
    gone = F.when(F.coalesce("ended", F.lit(False)), "delete").otherwise("hold")
    action = F.when(F.col("new_there").isNull(), gone).when(F.col("old_there").isNull(), "add").when(F.col("old").eqNullSafe(F.col("new")), "keep").otherwise("update")
    return both.join(ended, "root", "left").select("root", "path", action.alias("action"))


def applied(known: DataFrame, seen: DataFrame, scans: DataFrame) -> DataFrame:
    """What is known after the scan: root, path and fingerprint. Held rows stay as they are."""
    acts = actions(known, seen, scans)
    once = lambda df: df.groupBy("root", "path").agg(F.max("fingerprint").alias("fingerprint"))
    stay = once(known).join(acts.where("action in ('keep', 'hold')"), ["root", "path"], "left_semi")
    return stay.unionByName(once(seen).join(acts.where("action in ('add', 'update')"), ["root", "path"], "left_semi"))
