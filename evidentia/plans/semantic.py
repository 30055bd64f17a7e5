"""Governed metric queries: a catalog, a planner from metric, dimensions and filters to a bounded aggregate, and a SQL gate."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROW_CAP = 100
#: Words that no read-only statement holds.
DENIED = "insert update delete merge drop alter create truncate grant revoke copy call execute do vacuum analyze set reset begin commit rollback".split()
#: More of them, which write or wait in some engine.
DENIED_TOO = "into refresh lock listen notify".split()
#: A statement's pieces: quoted text, comments, what opens one of them without an end, and all else.
PIECES = re.compile(
    r"(?P<quoted>'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|`(?:[^`]|``)*`|\$(?P<tag>\w*)\$.*?\$(?P=tag)\$)|(?P<comment>--[^\n]*|/\*.*?\*/)|(?P<open>['\"`]|/\*)|.", re.S
)
OPERATORS = ("eq", "neq", "gt", "gte", "lt", "lte", "in", "string_contains")


class PlanError(ValueError):
    """A request that the catalog does not allow."""


@dataclass(frozen=True)
class CatalogColumn:
    name: str
    type: str = "string"
    role: str = "dimension"
    display_name: str = ""
    allowed: bool = True


@dataclass(frozen=True)
class Metric:
    name: str
    aggregation: str
    column: str | None = None
    dimensions: tuple[str, ...] = ("*",)
    filters: tuple[str, ...] = ("*",)


@dataclass(frozen=True)
class CatalogTable:
    name: str
    columns: tuple[CatalogColumn, ...]
    metrics: tuple[Metric, ...]
    row_filter: str | None = None
    allowed: bool = True
    max_rows: int = ROW_CAP


@dataclass
class Plan:
    """A planned query: the result, its bound, what it is guessed to cost, and what to tell the user."""

    frame: DataFrame
    limit: int
    cost: str
    warnings: list[str] = field(default_factory=list)


def normalise(name: str) -> str:
    return re.sub(r"[^a-z0-9_]+", "_", name.strip().lower()).strip("_")


def _resolve(table: CatalogTable, name: str, among: tuple[str, ...]) -> CatalogColumn:
    found = next((c for c in table.columns if name == c.name or normalise(name) in (normalise(c.name), normalise(c.display_name or c.name))), None)
    if found is None or not found.allowed:
        raise PlanError(f"column {name} is not in the catalog or not allowed")
    if "*" not in among and found.name not in among:
        raise PlanError(f"column {name} is not allowed for this metric")
    return found


def _aggregate(metric: Metric) -> Column:
    if metric.aggregation == "count":
        return F.count(metric.column) if metric.column else F.count(F.lit(1))
    if metric.aggregation not in ("sum", "avg", "min", "max", "count_distinct") or not metric.column:
        raise PlanError(f"aggregation {metric.aggregation} cannot be planned")
    return {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "count_distinct": F.count_distinct}[metric.aggregation](metric.column)


def _condition(c: str, op: str, value) -> Column:
    """SQL's three-valued comparison; a value of string_contains is a pattern as given, % and _ included."""
    if op == "in":
        return F.col(c).isin(list(value))
    if op == "string_contains":
        return F.col(c).ilike(f"%{value}%")
    a = F.col(c)
    return {"eq": a == value, "neq": a != value, "gt": a > value, "gte": a >= value, "lt": a < value, "lte": a <= value}[op]


def plan(df: DataFrame, table: CatalogTable, metric_name: str, dimensions: tuple[str, ...] = (), filters: tuple = (), limit: int | None = None) -> Plan:
    """Aggregate df by dimensions under filters ((column, op, value), ...), ordered by the dimensions and bounded."""
    metric = next((m for m in table.metrics if normalise(m.name) == normalise(metric_name)), None)
    if metric is None or not table.allowed:
        raise PlanError(f"metric {metric_name} is unknown or its table not allowed")
    columns = [_resolve(table, d, metric.dimensions).name for d in dimensions]
    if table.row_filter:
        if faults := check_condition(table.row_filter):
            raise PlanError(f"row filter: {'; '.join(faults)}")
        df = df.where(F.expr(table.row_filter))
    for name, op, value in filters:
        if op not in OPERATORS:
            raise PlanError(f"operator {op} is unknown")
        df = df.where(_condition(_resolve(table, name, metric.filters).name, op, value))
    asked = ROW_CAP if limit is None else limit
    bound = min(max(1, asked), table.max_rows)
    warnings = [f"Limit reduced from {asked} to {bound}."] if limit is not None and bound < limit else []
    value = _aggregate(metric).alias(metric.name)
    frame = df.groupBy(*columns).agg(value).orderBy(*columns).limit(bound) if columns else df.agg(value)
    points = 2 * len(columns) + len(filters) + (0 if filters and columns else 2 if filters else 3)
    return Plan(frame, bound, "high" if points >= 6 else "medium" if points >= 3 else "low", warnings)


def bare_sql(sql: str) -> tuple[str, list[str]]:
    """A statement without comments and without what quotes hold, read from left to right, and what cannot be read safely.

    Engines differ on a backslash before a quote and on a comment inside a comment, and so on where a quote or comment
    ends; both are faults, as are quotes and comments that do not end.
    """
    out, faults = [], []
    for m in PIECES.finditer(sql):
        if m["quoted"]:
            out.append("''" if m["quoted"][0] == "'" else '""')
            faults += ["backslash in quoted text"] * ("\\" in m["quoted"])
        elif m["comment"]:
            out.append(" ")
            faults += ["comment inside a comment"] * ("/*" in m["comment"][2:] and m["comment"][0] == "/")
        elif m["open"]:
            faults.append("a quote or comment does not end")
        else:
            out.append(m[0])
    return "".join(out).strip(), faults


def _words(bare: str) -> list[str]:
    return [f"{w.upper()} is not allowed" for w in (*DENIED, *DENIED_TOO) if re.search(rf"\b{w}\b", bare, re.I)]


def check_sql(sql: str, need_limit: bool = True) -> list[str]:
    """What is wrong with a statement that should be a bounded read: comments and quoted text do not count."""
    bare, faults = bare_sql(sql)
    bare = bare.rstrip("; \t\r\n")
    if not re.match(r"select\b", bare, re.I):
        faults.append("statement must start with SELECT")
    if ";" in bare:
        faults.append("one statement only")
    faults += _words(bare)
    if re.search(r"\bcross\s+join\b", bare, re.I):
        faults.append("CROSS JOIN is not allowed")
    if need_limit and not re.search(r"\blimit\s+\d+", bare, re.I):
        faults.append("LIMIT is required")
    return faults


def check_condition(condition: str) -> list[str]:
    """What is wrong with a row filter, which is one condition over the table's own columns."""
    bare, faults = bare_sql(condition)
    if not bare or ";" in bare:
        faults.append("one condition only")
    if re.search(r"\bselect\b", bare, re.I):
        faults.append("a row filter does not read other tables")
    return faults + _words(bare)
