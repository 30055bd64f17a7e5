"""Document-store queries: a filter tree, sort and cursor, validated and compiled to DataFrame operations.

Logic is two-valued: a comparison with a missing field is false, so not(...) of it is true; neq and nin never match a
missing field. Null and absent are the same. Sorts end with id; missing values come last ascending, first descending.
"""

from __future__ import annotations

import base64
import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

COMPARE = ("eq", "neq", "lt", "lte", "gt", "gte")
FIELD_OPS = (*COMPARE, "in", "nin", "exists", "stringContains", "arrayContains")


class StoreQueryError(ValueError):
    """A query that is not well formed; pointer is the JSON pointer of the fault."""

    def __init__(self, pointer: str, code: str):
        super().__init__(f"{pointer or '/'}: {code}")
        self.pointer, self.code = pointer, code


def validate(query: dict) -> None:
    for key in query:
        if key not in ("where", "sort", "limit", "cursor"):
            raise StoreQueryError(f"/{key}", "unknown_key")
    if query.get("where") is not None:
        _validate_filter(query["where"], "/where")
    sort = query.get("sort") or []
    if not isinstance(sort, list):
        raise StoreQueryError("/sort", "invalid_sort")
    for k, spec in enumerate(sort):
        if not isinstance(spec, dict) or not spec.get("field") or spec.get("dir", "asc") not in ("asc", "desc"):
            raise StoreQueryError(f"/sort/{k}", "invalid_sort")
    limit = query.get("limit")
    if limit is not None and (isinstance(limit, bool) or not isinstance(limit, int) or limit < 1):
        raise StoreQueryError("/limit", "invalid_limit")


def _validate_filter(f: dict, at: str) -> None:
    if not isinstance(f, dict) or "op" not in f:
        raise StoreQueryError(at, "invalid_filter")
    op = f["op"]
    if op in ("and", "or"):
        if not f.get("filters"):
            raise StoreQueryError(f"{at}/filters", "empty_group")
        for k, x in enumerate(f["filters"]):
            _validate_filter(x, f"{at}/filters/{k}")
    elif op == "not":
        _validate_filter(f.get("filter"), f"{at}/filter")
    elif op not in FIELD_OPS:
        raise StoreQueryError(f"{at}/op", "unknown_op")
    elif not f.get("field"):
        raise StoreQueryError(f"{at}/field", "invalid_field")
    elif op in COMPARE and (f.get("value") is None or (op[0] in "lg" and not isinstance(f["value"], (str, int, float)))):
        raise StoreQueryError(f"{at}/value", "invalid_operand")


def field(path: str | list[str]) -> Column:
    """A bare string is one key, dots and all; a list is a path."""
    keys = [path] if isinstance(path, str) else path
    return reduce(lambda c, k: c.getField(k), keys[1:], F.col(f"`{keys[0]}`"))


def _kind(value) -> str:
    return "boolean" if isinstance(value, bool) else "string" if isinstance(value, str) else "number"


def _column_kind(schema: T.StructType, path: str | list[str]) -> str:
    kind: T.DataType = schema
    for key in [path] if isinstance(path, str) else path:
        if not isinstance(kind, T.StructType) or key not in kind.names:
            return "missing"
        kind = kind[key].dataType
    if isinstance(kind, T.NumericType):
        return "number"
    return {"string": "string", "boolean": "boolean", "array": "array"}.get(kind.typeName(), "other")


def compile_filter(f: dict, schema: T.StructType) -> Column:
    """A column that is true or false, never null."""
    op = f["op"]
    if op in ("and", "or"):
        parts = [compile_filter(x, schema) for x in f["filters"]]
        return reduce((lambda a, b: a & b) if op == "and" else (lambda a, b: a | b), parts)
    if op == "not":
        return ~compile_filter(f["filter"], schema)
    kind, value = _column_kind(schema, f["field"]), f.get("value")
    if op == "exists":
        there = F.lit(False) if kind == "missing" else field(f["field"]).isNotNull()
        return there if value is not False else ~there
    if kind == "missing":
        return F.lit(False)
    c = field(f["field"])
    if op in ("in", "nin"):
        same = [v for v in f.get("values", value) or [] if _kind(v) == kind]
        inside = c.isin(same) if same else F.lit(False)
        return F.coalesce(inside if op == "in" else c.isNotNull() & ~inside, F.lit(False))
    if op == "stringContains":
        return F.coalesce(c.contains(value), F.lit(False)) if kind == "string" else F.lit(False)
    if op == "arrayContains":
        return F.coalesce(F.array_contains(c, value), F.lit(False)) if kind == "array" else F.lit(False)
    if _kind(value) != kind:
        return c.isNotNull() if op == "neq" else F.lit(False)
    found = {"eq": c == value, "neq": c != value, "lt": c < value, "lte": c <= value, "gt": c > value, "gte": c >= value}[op]
    return F.coalesce(found, F.lit(False))


def order(specs: list[dict] | None, id_column: str = "id") -> list[Column]:
    found = [field(s["field"]).desc_nulls_first() if s.get("dir") == "desc" else field(s["field"]).asc_nulls_last() for s in specs or []]
    return [*found, F.col(id_column).asc()]


def encode_cursor(query: dict, offset: int) -> str:
    state = {k: query.get(k) for k in ("where", "sort", "limit")} | {"offset": offset}
    return base64.urlsafe_b64encode(json.dumps(state, separators=(",", ":")).encode()).decode()


def decode_cursor(cursor: str) -> dict:
    """The query and the offset that a cursor carries."""
    try:
        state = json.loads(base64.urlsafe_b64decode(cursor))
    except (ValueError, TypeError):
        state = None
    offset = state.get("offset", 0) if isinstance(state, dict) else None
    if not isinstance(offset, int) or isinstance(offset, bool) or offset < 0:
        raise StoreQueryError("/cursor", "invalid_cursor")
    return {k: state.get(k) for k in ("where", "sort", "limit")} | {"offset": offset}


def run(df: DataFrame, query: dict, id_column: str = "id") -> DataFrame:
    """The rows of a page. A cursor carries the whole query and overrides what else is given."""
    offset = 0
    if query.get("cursor"):
        query = decode_cursor(query["cursor"])
        offset = query.pop("offset")
    validate(query)
    if query.get("where"):
        df = df.where(compile_filter(query["where"], df.schema))
    df = df.orderBy(*order(query.get("sort"), id_column))
    df = df.offset(offset) if offset else df
    return df.limit(query["limit"]) if query.get("limit") else df


def page(df: DataFrame, query: dict, id_column: str = "id") -> tuple[DataFrame, int, str | None]:
    """A page, the number of rows before paging, and the cursor of the next page if there is one."""
    state = decode_cursor(query["cursor"]) if query.get("cursor") else query
    plain = {k: state.get(k) for k in ("where", "sort")}
    total = run(df, {k: v for k, v in plain.items() if v}, id_column).count()
    end = state.get("offset", 0) + (state.get("limit") or total)
    return run(df, query, id_column), total, encode_cursor(state, end) if end < total else None


def memory_filter(q: str | None = None, state: str = "all") -> dict | None:
    """The filter of remembered facts that hold a text and are unprocessed, processed or ignored; None where all are asked for."""
    clauses = [{"op": "stringContains", "field": "fact", "value": q.strip()}] if q and q.strip() else []
    asked = {"unprocessed": ("dreamSkill", False), "processed": ("dreamSkill", True), "ignored": ("ignoreUntil", True)}.get(state)
    if asked:
        clauses.append({"op": "exists", "field": asked[0], "value": asked[1]})
    return None if not clauses else clauses[0] if len(clauses) == 1 else {"op": "and", "filters": clauses}


def triggers(df: DataFrame, tool: str | None = None, params: str | None = None) -> DataFrame:
    """Triggers (tool, params as canonical JSON) of a tool and of exactly these params, as far as they are given."""
    df = df if tool is None else df.where(F.col("tool") == tool)
    return df if params is None else df.where(F.coalesce("params", F.lit("null")) == params)
