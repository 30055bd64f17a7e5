"""Entities that a text mentions, path patterns and durations, as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of entity extraction: type, predicate, confidence, pattern (its group is the name).
FAMILIES = [
    ("document", "has_heading", 0.9, r"(?m)^#{1,6}\s+(.+)$"),
    ("ticket", "references_ticket", 0.95, r"(\b[A-Z][A-Z0-9]+-\d+\b)"),
    ("ticket", "references_ticket", 0.8, r"(\b#[1-9]\d{1,8}\b)"),
    ("person", "references_email", 0.95, r"(?i)(\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b)"),
    ("document", "links_to", 0.9, r"(?i)(\bhttps?://[^\s)>\]]+)"),
    ("document", "references_file", 0.85, r'(\b(?:[A-Za-z]:\\|\.{1,2}/|/)[^\s:*?"<>|]+)'),
    ("decision", "mentions_date", 0.75, r"(\b\d{4}-\d{2}-\d{2}\b)"),
    ("system", "references_table", 0.7, r"(\b[a-zA-Z_][a-zA-Z0-9_]*\.[a-zA-Z_][a-zA-Z0-9_]*\b)"),
]
#: Milliseconds of the units of a duration.
UNITS = {"ms": 1, "s": 1_000, "m": 60_000, "h": 3_600_000, "d": 86_400_000}


def _family(text: str, kind: str, predicate: str, confidence: float, pattern: str) -> Column:
    names = F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)))
    fixed = (F.lit(kind).alias("type"), F.lit(predicate).alias("predicate"), F.lit(confidence).alias("confidence"))
    return F.transform(names, lambda n: F.struct(*fixed, F.regexp_replace(F.lower(F.trim(n)), r"\s+", " ").alias("name")))


def entities(df: DataFrame, text: str = "text", id_column: str = "id") -> DataFrame:
    """Distinct (id, type, predicate, name) with the best confidence; names are compared in any case, white space runs as one.

    A text without a match, empty or null gives no row. Repeats within a text fold before the shuffle.
    """
    found = F.concat(*[_family(text, *family) for family in FAMILIES])
    rows = df.where(F.col(text).isNotNull()).select(F.col(id_column).alias("id"), F.explode(found).alias("e")).select("id", "e.*").where("name <> ''")
    return rows.groupBy("id", "type", "predicate", "name").agg(F.max("confidence").alias("confidence"))


def glob_pattern(glob: str) -> str:
    """The regular expression of a path glob: ** crosses folders, * and ? stay within one, [..] is a class; any case."""
    out = {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}
    parts = re.split(r"(\*\*/|\*\*|\*|\?|\[[^\]/]+\])", glob)
    return "(?i)^" + "".join(out.get(p) or (re.sub(r"^\[!", "[^", p) if p.startswith("[") and p.endswith("]") and len(p) > 2 else re.escape(p)) for p in parts) + "$"


def excluded(path: Column, globs: list[str]) -> Column:
    """Whether a path meets any of the globs; no globs exclude nothing."""
    return path.rlike("|".join(f"(?:{glob_pattern(g)})" for g in globs)) if globs else F.lit(False)


def duration_ms(text: Column) -> Column:
    """Milliseconds of '10m' and the like; null where the text is no duration."""
    number, unit = F.regexp_extract(text, r"^\s*(\d+)\s*(ms|s|m|h|d)\s*$", 1), F.regexp_extract(text, r"^\s*(\d+)\s*(ms|s|m|h|d)\s*$", 2)
    factor = F.lit(None).cast("long")
    for name, ms in UNITS.items():
        factor = F.when(unit == name, F.lit(ms).cast("long")).otherwise(factor)
    return F.when(number != "", number.cast("long") * factor)


#: The shortest interval of what recurs, in milliseconds.
LEAST_INTERVAL = 10_000


def interval_ms(text: Column) -> Column:
    """Milliseconds of an interval such as '1.5h'; null where it is none, or under LEAST_INTERVAL."""
    pattern = r"^\s*(\d+(?:\.\d+)?)(ms|s|m|h|d)\s*$"
    number, unit = F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")), F.regexp_extract(text, pattern, 2)
    ms = F.round(number.cast("double") * F.coalesce(*[F.when(unit == name, float(size)) for name, size in UNITS.items()])).cast("long")
    return F.when(ms >= LEAST_INTERVAL, ms)


def duration_text(ms: Column) -> Column:
    """Milliseconds in the largest unit that they are whole numbers of."""
    by_size = sorted(UNITS.items(), key=lambda u: -u[1])
    return F.coalesce(*[F.when(ms % size == 0, F.concat((ms / size).cast("long").cast("string"), F.lit(name))) for name, size in by_size])
