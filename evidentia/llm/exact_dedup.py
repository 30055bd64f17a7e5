"""Exact deduplication by content-defined chunk recipes, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import keyed, salt, salted, saved, without

#: A chunk has 256 to 4096 characters and ends before a word that starts with one of these letter pairs: where it ends
#: hangs on the text near by alone, so equal passages give equal chunks wherever they stand. Text without such words is
#: cut every 4096 characters, which is as exact, and only shares fewer chunks.
CHUNK = r"(?s).{256,4096}?(?= [admADM][aeinrt])|.{1,4096}"


def normalised(text: Column) -> Column:
    """White space runs as one space; null as the empty string. A lone space is left alone, which is most of the work."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]", " ")


def chunks(text: Column) -> Column:
    """The content-defined chunks of a text in order; the empty text has none."""
    return F.regexp_extract_all(text, F.lit(CHUNK), F.lit(0))


def verified_identifiers(texts: DataFrame) -> tuple[DataFrame, bool]:
    """Chunk texts whose 64-bit fingerprint another chunk text bears too, with an ordinal each; and whether there are any.

    Every chunk is deduplicated by its text (partial aggregation first, so frequent chunks do not meet in one task). A
    fingerprint that one distinct chunk text bears is a verified identifier as it stands. The others, expected only in
    very large corpora, get (fingerprint, ordinal) in the order of their texts.
    """
    distinct = texts.select(F.explode(chunks("text")).alias("chunk")).groupBy("chunk").agg(F.count("*").alias("n"))
    shared = saved(
        distinct.select(F.xxhash64("chunk").alias("fp")).groupBy("fp").agg(F.count("*").alias("n")).where("n > 1").select("fp")
    )
    if shared.isEmpty():
        return shared, False
    named = (
        distinct.select(F.xxhash64("chunk").alias("fp"), "chunk")
        .join(shared, "fp")
        .withColumn("ordinal", F.row_number().over(Window.partitionBy("fp").orderBy("chunk")))
    )
    return saved(named.select("fp", F.sha2("chunk", 256).alias("digest"), "ordinal")), True


def recipes(docs: DataFrame, key: str | None = None) -> DataFrame:
    """One row per row of docs: row, doc_id, text_sha256, salt and recipe, the ordered list of (fingerprint, ordinal) of its chunks.

    row is the column key or else a number given here.
    """
    texts = docs.select((F.col(key) if key else F.monotonically_increasing_id()).alias("row"), "doc_id", normalised(F.col("text")).alias("text"))
    clashes, any_clash = verified_identifiers(texts)
    plain = texts.select(
        "row",
        "doc_id",
        F.sha2("text", 256).alias("text_sha256"),
        salt().alias("salt"),
        F.transform(chunks("text"), lambda c: F.struct(F.xxhash64(c).alias("fp"), F.lit(0).alias("ordinal"))).alias("recipe"),
    )
    if not any_clash:
        return saved(plain)
    rows = saved(texts)
    parts = rows.select("row", F.posexplode(chunks("text")).alias("pos", "chunk")).select(
        "row", "pos", F.xxhash64("chunk").alias("fp"), F.sha2("chunk", 256).alias("digest")
    )
    lists = (
        parts.join(clashes, ["fp", "digest"], "left")
        .groupBy("row")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "fp", F.coalesce("ordinal", F.lit(0)).alias("ordinal")))).alias("parts"))
        .select("row", F.transform("parts", lambda p: F.struct(p["fp"].alias("fp"), p["ordinal"].alias("ordinal"))).alias("recipe"))
    )
    empty = F.array().cast(plain.schema["recipe"].dataType)
    return saved(
        rows.select("row", "doc_id", F.sha2("text", 256).alias("text_sha256"))
        .join(lists, "row", "left")
        .select("row", "doc_id", "text_sha256", salt().alias("salt"), F.coalesce("recipe", empty).alias("recipe"))
    )


def exact_groups(docs: DataFrame, key: str | None = None) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256 (and the column key, if given, which tells rows apart).

    Texts are equal when identical after white space runs become one space; null counts as empty. Long texts move once,
    as chunks, to verify the identifiers; after that only recipes of 12 bytes per chunk are compared, with partial
    aggregation. Only groups of two or more are joined back, by recipe and salt, so that a hot group meets in many tasks.

    The row of smallest doc_id stays; a missing doc_id comes after all others, and of rows with one doc_id the first in
    the table stays. Every row gets a row. An empty table gives an empty result. Other columns are not looked at.
    """
    found = recipes(docs, key)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    groups = found.groupBy("recipe").agg(F.min(order).alias("keep"), F.count("*").alias("size")).where("size > 1")
    rows = salted(found, groups, "recipe")
    alone = F.col("size").isNull()
    return rows.select(
        *([F.col("row").alias(key)] if key else []),
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep.doc_id")).alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("row") == F.col("keep.row"))).alias("kept"),
        "text_sha256",
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """Of each group of equal texts the row of smallest doc_id, as exact_groups() has it, all columns as they are."""
    docs, key = keyed(docs)
    return without(docs, exact_groups(docs, key).where(~F.col("kept")), key).drop(key)
