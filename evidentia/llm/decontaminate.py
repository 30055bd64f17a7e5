"""Benchmark decontamination by size-partitioned MinHash containment search, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, keyed, saved, without

WIDTH = 5
CONTAINMENT = 0.8
#: An index of up to this many rows (a hash and an id each) may be broadcast; a larger one is joined by shuffle.
BROADCAST_INDEX = 1_000_000


def words(text: Column) -> Column:
    """Lower-cased runs of letters, marks and digits; null and texts without any give an empty list."""
    line = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{M}\p{N}]+", " ")
    return F.array_remove(F.split(line, " "), "")


def tokenised(texts: DataFrame, key: str) -> DataFrame:
    """(key, tokens): the words as a column of their own, since a lambda would work them out anew for every shingle."""
    return texts.select(key, words(F.col("text")).alias("tokens"))


def shingles(tokens: Column, width: int | Column) -> Column:
    """The distinct shingles of width tokens of a list, as text; fewer tokens make none."""
    starts = F.filter(F.sequence(F.lit(0), F.greatest(F.size(tokens) - width, F.lit(0))), lambda i: i + width <= F.size(tokens))
    return F.array_distinct(F.transform(starts, lambda i: F.concat_ws(" ", F.slice(tokens, i + 1, width))))


def shingle_hashes(tokens: Column, width: int, parts: int = WIDTH) -> Column:
    """The distinct 64-bit hashes of a list's shingles of width tokens; each word is hashed once, not width times."""
    starts = F.when(F.size(tokens) >= width, F.sequence(F.lit(0), F.size(tokens) - width)).otherwise(F.array().cast("array<int>"))
    words = lambda i: [F.get(tokens, i + k) if k < width else F.lit("") for k in range(parts)]
    return F.array_distinct(F.transform(starts, lambda i: F.xxhash64(*words(i))))


def item_grams(benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """item_id, length and grams: the item's distinct shingles of width words, or of all its words if it has fewer."""
    tokens = tokenised(benchmark.where("item_id is not null"), "item_id").where(F.size("tokens") > 0)
    length = F.least(F.size("tokens"), F.lit(width))
    return (
        tokens.select("item_id", length.alias("length"), F.explode(shingles(F.col("tokens"), length)).alias("gram"))
        .groupBy("item_id")
        .agg(F.max("length").alias("length"), F.collect_set("gram").alias("grams"))
    )


def sketches(items: DataFrame, width: int = WIDTH, threshold: float = CONTAINMENT) -> DataFrame:
    """The MinHash index of the items (item_id, grams): rows (hash, item_id), each item's smallest hashes.

    Items are partitioned by the power of two of their shingle count. An item of n shingles that a document contains to
    the threshold t misses at most n - ceil(t n) of them, so of any n - ceil(t n) + 1 at least one is in the document.
    Each class takes that number for its largest size: no contained item is missed, whatever the document's length.
    """
    words = lambda g: [F.coalesce(F.get(F.split(g, " "), F.lit(k)), F.lit("")) for k in range(width)]
    hashed = items.select("item_id", F.size("grams").alias("n"), F.explode(F.transform("grams", lambda g: F.xxhash64(*words(g)))).alias("hash"))
    top = F.pow(F.lit(2.0), F.floor(F.log2(F.col("n").cast("double"))) + 1) - 1
    need = top - F.ceil(top * F.lit(threshold) - F.lit(1e-9)) + 1
    order = Window.partitionBy("item_id").orderBy("hash")
    return hashed.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= need).select("hash", "item_id")


def _bounded(index: DataFrame, limit: int) -> DataFrame:
    return F.broadcast(index) if index.limit(limit + 1).count() <= limit else index


def contained_items(
    docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, threshold: float = CONTAINMENT, broadcast_rows: int = BROADCAST_INDEX, key: str = "doc_id"
) -> DataFrame:
    """Pairs (key, item_id, n_shingles, n_shared, containment) where a document holds at least threshold of an item.

    Words are compared lower-cased and without punctuation, in shingles of width words. Whole documents are searched;
    an item's shingles may lie anywhere in them. An item of fewer words than width is one shingle of all its words, which
    is looked for as a run of words. Candidates come from the sketches; they are verified by counting the item's
    shingles, as text, that the document has. Items without words match nothing and rows without item_id are left out.
    Rows that repeat a doc_id count as one document, and so do those without one; repeated rows give the pair once. An
    empty table of either kind gives an empty result. Other columns of either table are not looked at.
    """
    texts = docs.select(F.col(key).alias("doc"), "text")
    items = saved(item_grams(benchmark, width))
    index = saved(sketches(items, width, threshold))
    widths = sorted(r["length"] for r in items.select("length").distinct().collect())  # width numbers at most
    if not widths:
        widths = [width]
    hashes = F.concat(*(shingle_hashes(F.col("tokens"), w, width) for w in widths))
    grams = tokenised(texts, "doc").select("doc", F.explode(hashes).alias("hash"))
    pairs = saved(grams.join(_bounded(index, broadcast_rows), "hash").select("doc", "item_id").distinct())
    lines = saved(items.select("item_id", F.size("grams").alias("n_shingles"), F.explode("grams").alias("gram")))
    found = F.array_distinct(F.concat(*(shingles(F.col("tokens"), w) for w in widths)))
    near = saved(pairs.select("doc").distinct())
    near = _bounded(near, BROADCAST_IDS)
    suspects = texts.join(near, texts["doc"].eqNullSafe(near["doc"]), "left_semi")
    shared = tokenised(suspects, "doc").select("doc", F.explode(found).alias("gram")).join(_bounded(lines, broadcast_rows), "gram").distinct()
    known = pairs.toDF("doc_", "item_")
    return (
        shared.groupBy("doc", "item_id", "n_shingles")
        .agg(F.count("*").alias("n_shared"))
        .join(known, F.col("doc").eqNullSafe(F.col("doc_")) & (F.col("item_id") == F.col("item_")), "left_semi")
        .withColumn("containment", F.round(F.col("n_shared") / F.col("n_shingles"), 6))
        .where(F.col("n_shared") >= F.ceil(F.col("n_shingles") * F.lit(threshold) - F.lit(1e-9)))
        .select(F.col("doc").alias(key), "item_id", F.col("n_shingles").cast("long").alias("n_shingles"), "n_shared", "containment")
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that hold no benchmark item, all columns as they are. Rows are judged by themselves, whatever their id."""
    docs, key = keyed(docs)
    return without(docs, contained_items(docs, benchmark, key=key), key).drop(key)
