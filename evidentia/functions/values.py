"""Nested values, patterns and paths: canonical form, redaction, schema checks, safe patterns and access rules."""

from __future__ import annotations

import hashlib
import json
import re
from functools import reduce
from re import _constants as codes
from re import _parser as parser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from ..session import ship
from .text import SECRETS

#: Names of secrets, and how much of a nested value is kept.
SECRET_KEY = r"(?i)secret|token|password|authorization|credential|api.?key|cookie"
MAX_DEPTH, MAX_ITEMS, MAX_KEYS, MAX_CHARS = 7, 100, 200, 4_000
#: Folders that say how much a document counts.
PLACES = (("authority", r"(?:^|/)(?:authority|official|signed|approved|executed)(?:/|$)"), ("archive", r"(?:^|/)(?:archive|archived|history|old|obsolete)(?:/|$)"))
#: The length of a pattern that may be searched for, and how long its output may get.
PATTERN_CHARS, OUTPUT_BYTES = 256, 2 << 20


def canonical(value) -> str:
    """A JSON value with the keys of its objects sorted at every depth, without spaces."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


@F.pandas_udf(StringType())
def canonical_sha256(texts: pd.Series) -> pd.Series:
    """The digest of JSON texts in canonical form; null where a text is no JSON."""

    def one(text):
        try:
            return hashlib.sha256(canonical(json.loads(text)).encode("utf-8", "surrogatepass")).hexdigest()
        except (TypeError, ValueError):
            return None

    return texts.map(one)


def clean(value, key: str = "", depth: int = 0):
    """A nested value without secrets: those that their key gives away, and those that are seen in texts; cut where it is too deep or long."""
    if re.search(SECRET_KEY, key):
        return "[REDACTED]"
    if depth > MAX_DEPTH:
        return "[TRUNCATED_DEPTH]"
    if isinstance(value, str):
        for pattern, instead in SECRETS:
            value = re.sub(pattern, instead, value)
        return value if len(value) <= MAX_CHARS else value[:MAX_CHARS] + "…[TRUNCATED]"
    if isinstance(value, list):
        return [clean(v, key, depth + 1) for v in value[:MAX_ITEMS]]
    if isinstance(value, dict):
        return {k: clean(v, k, depth + 1) for k, v in list(value.items())[:MAX_KEYS]}
    return value


@F.pandas_udf(StringType())
def redacted_json(texts: pd.Series) -> pd.Series:
    """JSON texts without secrets, in canonical form; a text that is no JSON is redacted as a text."""

    def one(text):
        if text is None:
            return None
        try:
            value = json.loads(text)
        except ValueError:
            return clean(text)
        return canonical(clean(value))

    return texts.map(one)


FAULTS = ArrayType(StructType([StructField("path", StringType()), StructField("message", StringType())]))
TYPES = {"object": dict, "array": list, "string": str, "boolean": bool}


def schema_faults(schema: dict, value, path: str = "$") -> list[tuple[str, str]]:
    """Where a value departs from a schema of type, minLength, enum, properties, required and items."""
    kind = schema.get("type")
    number = isinstance(value, (int, float)) and not isinstance(value, bool) and value == value and abs(value) != float("inf")
    fits = {"number": number, "integer": number and float(value).is_integer() if number else False}
    if isinstance(kind, str) and not (fits[kind] if kind in fits else kind in TYPES and isinstance(value, TYPES[kind])):
        return [(path, f"Expected {kind}.")]
    out = []
    if isinstance(value, str) and len(value) < schema.get("minLength", 0):
        out.append((path, f"Expected at least {schema['minLength']} character(s)."))
    if isinstance(schema.get("enum"), list) and value not in schema["enum"]:
        out.append((path, f"Expected one of: {', '.join(map(str, schema['enum']))}."))
    if isinstance(value, dict) and isinstance(schema.get("properties"), dict):
        out += [(f"{path}.{k}", "Required field is missing.") for k in schema.get("required", []) if k not in value]
        for k, child in schema["properties"].items():
            if k in value and isinstance(child, dict):
                out += schema_faults(child, value[k], f"{path}.{k}")
    if isinstance(value, list) and isinstance(schema.get("items"), dict):
        for k, item in enumerate(value):
            out += schema_faults(schema["items"], item, f"{path}[{k}]")
    return out


def checked(text: Column, schema: dict) -> Column:
    """The faults (path, message) of JSON texts under a schema; a text that is no JSON has one."""

    @F.pandas_udf(FAULTS)
    def check(texts: pd.Series) -> pd.Series:
        def one(t):
            try:
                return schema_faults(schema, json.loads(t))
            except (TypeError, ValueError):
                return [("$", "Expected JSON.")]

        return texts.map(one)

    return check(text)


def _repeats(node) -> bool:
    """Whether a parsed pattern repeats something that repeats."""

    def inside(tree, under: bool) -> bool:
        for op, args in tree:
            again = op in (codes.MAX_REPEAT, codes.MIN_REPEAT, codes.POSSESSIVE_REPEAT)
            if again and under:
                return True
            for part in args if isinstance(args, (tuple, list)) else (args,):
                for sub in part if isinstance(part, list) else (part,):
                    if isinstance(sub, parser.SubPattern) and inside(sub, under or again):
                        return True
        return False

    return inside(node, False)


def pattern_fault(pattern: str) -> str | None:
    """Why a pattern is not searched for: its length, references back, looks behind, repeats of repeats, or its syntax."""
    if not 1 <= len(pattern) <= PATTERN_CHARS:
        return "length"
    if re.search(r"\\[1-9]|\(\?<[=!]|\(\?P", pattern):
        return "reference back or look behind"
    try:
        return "repeat of a repeat" if _repeats(parser.parse(pattern)) else None
    except re.error:
        return "syntax"


def path_class(path: Column) -> Column:
    """authority, archive or current, by the folders of a path."""
    return reduce(lambda rest, p: F.when(F.lower(path).rlike(p[1]), p[0]).otherwise(rest), reversed(PLACES), F.lit("current"))


def access(path: Column, action: str, roots: dict[str, str], denied: list[str], risky: list[str]) -> Column:
    """Whether an action (read, list, write, delete) on a path is allowed, why not, and whether it is of high risk.

    roots maps folders to read-only or read-write; the first that holds the path counts. A denied fragment anywhere in the
    path comes first; what is deleted needs another way of approval.
    """
    low = F.lower(path)
    none = F.lit(None).cast("string")
    bad = reduce(lambda rest, d: F.when(F.contains(low, F.lit(d.lower())), d).otherwise(rest), reversed(denied), none)
    inside = lambda r: (path == r) | F.startswith(path, F.lit(r.rstrip("/") + "/"))
    mode = reduce(lambda rest, r: F.when(inside(r), roots[r]).otherwise(rest), reversed(list(roots)), none)
    name = F.element_at(F.split(low, "/"), -1)
    high = F.startswith(name, F.lit(".env")) | F.regexp_extract(name, r"[^.](\.[^.]+)$", 1).isin(risky)
    reason = (
        F.when(bad.isNotNull(), F.concat(F.lit("Denied path fragment matched: "), bad)).when(mode.isNull(), "Path is outside configured workspace roots.")
        .when(F.lit(action in ("write", "delete")) & (mode != "read-write"), "Workspace root is read-only.").when(F.lit(action == "delete"), "Delete requires explicit out-of-band approval.")
    )
    return F.struct(reason.isNull().alias("allowed"), reason.alias("reason"), (high & mode.isNotNull() & bad.isNull()).alias("high_risk"))


def snippet(text: Column, terms: list[str], before: int = 120, after: int = 280) -> Column:
    """A text around the first of the terms, white space runs as one space."""
    low = F.lower(text)
    places = [F.nullif(F.instr(low, F.lit(t.lower())), F.lit(0)) for t in terms]
    at = F.coalesce(F.array_min(F.array_compact(F.array(*places))), F.lit(1)) if places else F.lit(1)
    start = F.greatest(F.lit(1), at - before)
    return F.trim(F.regexp_replace(F.substring(text, start, at + after - start), r"\s+", " "))


def needs_attention(health: Column, staleness: Column, permission: Column) -> Column:
    return F.coalesce(health.isin("degraded", "down"), F.lit(False)) | F.coalesce(staleness.isin("stale", "expired"), F.lit(False)) | F.coalesce(permission == "denied", F.lit(False))


def citation(policy: Column, title: Column, uri: Column, source: Column) -> Column:
    return (
        F.when(policy.isin("cite_link", "cite_path"), F.concat(title, F.lit(": "), uri))
        .when(policy == "cite_query", F.concat(title, F.lit(" ("), source, F.lit(")")))
        .when(policy == "do_not_cite", F.concat(F.lit("Citation suppressed for "), title))
    )


@F.pandas_udf(StringType())
def fnv1a(texts: pd.Series) -> pd.Series:
    """The 32-bit FNV-1a hash of a text's UTF-16 code units, in hexadecimal digits without leading zeros."""

    def one(text):
        h = 0x811C9DC5
        data = text.encode("utf-16-le", "surrogatepass")
        for k in range(0, len(data), 2):
            h = ((h ^ (data[k] | data[k + 1] << 8)) * 0x01000193) & 0xFFFFFFFF
        return f"{h:x}"

    return texts.map(one, na_action="ignore")


ship(__name__)
