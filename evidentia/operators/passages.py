"""Texts as lines, sections and passages with byte ranges, and what is looked up through them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from ..session import ship

#: Tokens that a passage aims at and must not exceed, and the unit types that share a passage with no other.
TARGET_TOKENS, HARD_TOKENS = 800, 1_200
ALONE = ("code", "table", "front_matter")
#: Lines that are headings.
ATX = r"^#{1,6}[ \t]+(.+?)[ \t]*#*[ \t]*$"
CLAUSE = r"(?iu)^((?:article|art\.?|chapter|section|clause|annex|appendix|rozdział|artykuł|art\.?|§)\s+[\w.-]+(?:[ \t]+[-–—:]?[ \t]*.*)?)$"
NUMBERED = r"^(\d+(?:\.\d+){1,8}[.)]?[ \t]+\S.*)$"
#: Fixed values of the conversation window and of neighbour expansion.
TURNS, TURN_CHARS, WINDOW_CHARS = 6, 800, 3_000
SHORT, NEIGHBOUR_SHARE = 180, 0.95


def _cut_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            found = batch.column(1)[k].as_buffer().to_pybytes().split(b"\n")
            width = np.fromiter(map(len, found), np.int64, len(found))
            end = np.cumsum(width + 1) - 1
            for a in range(0, len(found), 100_000):
                z = min(len(found), a + 100_000)
                ids = batch.column(0).take(pa.array(np.full(z - a, k)))
                yield pa.record_batch([ids, pa.array(np.arange(a + 1, z + 1)), pa.array(found[a:z], pa.binary()).cast(pa.string()), pa.array((end - width)[a:z]), pa.array(end[a:z])], names=["id", "line_no", "line", "start_byte", "end_byte"])


def lines(docs: DataFrame, text: str = "text", id_column: str = "id") -> DataFrame:
    """(id, line_no, line, start_byte, end_byte): lines end at \\n, which no range holds; bytes are those of UTF-8.

    The offsets are a running sum within a row, worked out where the row is: nothing is shuffled. A null text is empty
    and so one empty line.
    """
    rows = docs.select(F.col(id_column).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    schema = StructType([StructField("id", rows.schema["id"].dataType), *(StructField(n, t) for n, t in (("line_no", LongType()), ("line", StringType()), ("start_byte", LongType()), ("end_byte", LongType())))])
    return rows.mapInArrow(_cut_lines, schema)


@F.pandas_udf(ArrayType(IntegerType()))
def _packed(units: pd.Series, target: pd.Series, hard: pd.Series) -> pd.Series:
    out = []
    for found, most, limit in zip(units, target, hard):
        passage, held, before, numbers = 0, 0, None, []
        for u in found:
            apart = before is not None and before != u["type"] and (before in ALONE or u["type"] in ALONE)
            if held and (apart or held + u["tokens"] > most):
                passage, held = passage + 1, 0
            numbers.append(passage)
            held, before = held + u["tokens"], u["type"]
            if held >= limit:
                passage, held, before = passage + 1, 0, None
        out.append(numbers)
    return pd.Series(out)


def packed(units: DataFrame, target: int = TARGET_TOKENS, hard: int = HARD_TOKENS, keys: list[str] | None = None) -> DataFrame:
    """Units (id, ordinal, type, text, or keys in place of id) with the passage each falls into: a new passage starts where the next unit would
    pass the target, after the hard limit and between code, tables or front matter and the rest. Units above the hard
    limit are cut first. Token counts and types alone go through Python, a document at a time.
    """
    step = hard * 4
    pieces = F.transform(F.sequence(F.lit(0), F.floor((F.greatest(F.length("text"), F.lit(1)) - 1) / step).cast("int")), lambda i: F.substring(F.col("text"), i * step + 1, F.lit(step)))
    keys = keys or ["id"]
    cut = units.select(*keys, "ordinal", "type", F.posexplode(pieces).alias("piece", "text"))
    tokens = F.greatest(F.lit(1), F.ceil(F.length("text") / 4)).cast("int")
    listed = cut.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("ordinal", "piece", "type", tokens.alias("tokens")))).alias("u"))
    zipped = listed.select(*keys, F.explode(F.arrays_zip(F.col("u"), _packed("u", F.lit(target), F.lit(hard)).alias("passage"))).alias("z"))
    return zipped.select(*keys, "z.u.ordinal", "z.u.piece", "z.u.type", "z.u.tokens", "z.passage")


def verified(evidence: DataFrame, docs: DataFrame, tokens: list[str], text: str = "text", id_column: str = "id") -> DataFrame:
    """Evidence (id, start_byte, end_byte, content_sha256) whose bytes still have the stored digest, in documents that the tokens open."""
    allowed = docs.where(F.arrays_overlap("acl_tokens", F.array(*map(F.lit, tokens)))).select(F.col(id_column).alias("id"), F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8").alias("_bytes"))
    cut = F.substring(F.col("_bytes"), (F.col("start_byte") + 1).cast("int"), (F.col("end_byte") - F.col("start_byte")).cast("int"))
    return evidence.join(allowed, "id").where(F.sha2(cut, 256) == F.col("content_sha256")).drop("_bytes")


def compacted(turns: DataFrame, group: str, order: str, text: str = "text") -> DataFrame:
    """The last turns of each conversation within a budget of characters, newest first: each turn's text with what is left of it.

    The budget is a running sum, as every turn takes the least of its length, its cap and what is left.
    """
    w = Window.partitionBy(group)
    recent = turns.withColumn("_age", F.row_number().over(w.orderBy(F.col(order).desc()))).where(F.col("_age") <= TURNS)
    clean = recent.withColumn("_clean", F.substring(F.trim(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"\s+", " ")), 1, TURN_CHARS))
    before = F.sum(F.length("_clean")).over(w.orderBy("_age").rowsBetween(Window.unboundedPreceding, 0)) - F.length("_clean")
    left = clean.withColumn("_left", (F.lit(WINDOW_CHARS) - before).cast("int")).where("_left > 0 AND _clean <> ''")
    return left.withColumn(text, F.expr("left(_clean, _left)")).drop("_age", "_clean", "_left")


def needs_neighbours(text: Column) -> Column:
    """A passage that is short or does not end in closing punctuation."""
    trimmed = F.trim(text)
    return (F.length(trimmed) < SHORT) | ~trimmed.rlike(r"[.!?;:)\]]$")


def expanded(hits: DataFrame, passages: DataFrame, group: str, order: str) -> DataFrame:
    """Hits (group, order, rank, score) with the passages beside those that need it; each passage once, as first seen.

    passages has group, order and text. Neighbours follow their hit, the earlier one first, at a share of its score.
    """
    w = Window.partitionBy(group).orderBy(order)
    beside = passages.select(group, order, needs_neighbours(F.col("text")).alias("_needs"), F.lag(order).over(w).alias("_1"), F.lead(order).over(w).alias("_2"))
    joined = hits.join(beside, [group, order])
    near = lambda k: F.struct(F.when(F.col("_needs"), F.col(f"_{k}")).alias("o"), F.lit(k).alias("k"), (F.col("score") * NEIGHBOUR_SHARE).alias("score"))
    own = F.struct(F.col(order).alias("o"), F.lit(0).alias("k"), F.col("score").cast("double").alias("score"))
    rows = joined.select(group, "rank", F.explode(F.array(own, near(1), near(2))).alias("r")).where("r.o is not null")
    first = rows.groupBy(group, F.col("r.o").alias(order)).agg(F.min_by(F.struct("r.score", "r.k"), F.struct("rank", "r.k")).alias("f"))
    return first.select(group, order, F.col("f.score").alias("score"), (F.col("f.k") > 0).alias("neighbour"))


ship(__name__)
