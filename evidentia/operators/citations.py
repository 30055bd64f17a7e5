"""Citations in nested values: JSON that the JVM has checked, walked level by level in its own row."""

from __future__ import annotations

import json as js

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship

#: Levels of objects and lists that are walked, and ids that are kept of a value.
DEPTH, MOST_IDS = 8, 100
#: A record with the id and one of the other keys is a citation.
ID_KEY, SIGNS = "sourceId", ("citation", "citationText", "versionId")


def _sources(text: str, depth: int) -> list[str]:
    found, level = set(), [js.loads(text, parse_int=len, parse_float=len)]  # numbers do not matter, however long
    for _ in range(depth + 1):
        inner = []
        for value in level:
            if isinstance(value, dict):
                if isinstance(value.get(ID_KEY), str) and any(s in value for s in SIGNS):
                    found.add(value[ID_KEY])
                value = value.values()
            inner.extend(v for v in value if isinstance(v, (dict, list)))
        level = inner
    return [s.encode("utf-8", "replace").decode() for s in found]


def _cited_in(json: Column, depth: int) -> Column:
    @F.pandas_udf("array<string>")
    def sources(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: _sources(t, depth) if t is not None and t.lstrip()[:1] in ("{", "[") else [])

    return sources(json)


def cited(rows: DataFrame, json: str, id_column: str = "id", depth: int = DEPTH, most: int = MOST_IDS) -> DataFrame:
    """id, n and sources: the distinct sources that each value cites, sorted, and the first so many of them.

    A record cites if its sourceId is a string and it has a citation, a citationText or a versionId. Values without any, and
    those that are no JSON, give n 0 and no sources; rows without an id are left out. A value is walked in its own row, a
    level at a time down to depth, so that what is shuffled are the sources of a value and never the values inside it.
    """
    valid = F.when(F.try_parse_json(json).isNotNull(), F.col(json))
    found = rows.where(F.col(id_column).isNotNull()).select(F.col(id_column).alias("id"), _cited_in(valid, depth).alias("hits"))
    every = found.groupBy("id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("hits")))).alias("sources"))
    return every.select("id", F.size("sources").alias("n"), F.slice("sources", 1, most).alias("sources"))


ship(__name__)
