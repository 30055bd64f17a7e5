"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import saved

#: A set of ids up to this many rows (8 bytes each) may be broadcast; beyond it the join is shuffled.
BROADCAST_IDS = 500_000

#: A run of the ASCII white space that the contracts name.
WHITE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one of the tables; only Spark's readers touch the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a number of its own for every row, written once so that it stays, and that column's name.

    Stages filter by it: doc_id may repeat or be missing, and a verdict on a row must not touch another one.
    """
    name = "_row"
    while name in docs.columns:
        name += "_"
    return saved(docs.withColumn(name, F.monotonically_increasing_id())), name


def without(docs: DataFrame, ids: DataFrame, key: str, limit: int = BROADCAST_IDS) -> DataFrame:
    """The rows of docs whose key is not in ids. ids is counted first: up to limit rows it is broadcast, else both sides shuffle."""
    ids = saved(ids.select(F.col(key).alias("_id")).distinct())
    small = ids.limit(limit + 1).count() <= limit
    return docs.join(F.broadcast(ids) if small else ids, docs[key] == ids["_id"], "left_anti")


#: A hot group's rows are spread over this many tasks where they meet what is known of the group.
SALTS = 16


def salted(rows: DataFrame, groups: DataFrame, key: str) -> DataFrame:
    """rows with the columns of groups, null where there is none. rows has a column salt, 0 to SALTS - 1; groups, of which
    there is one row a key, is repeated for each salt, so that no group, however large, meets in one task."""
    spread = groups.withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
    return rows.join(spread, [key, "salt"], "left").drop("salt")


def salt() -> Column:
    """A salt for each row of a table that is about to be written: by its place, as ids may repeat."""
    return F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(SALTS)).cast("int")


def one_each(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, text): of the rows of a key the text of smallest hash, found before any task or the driver holds them all."""
    return rows.groupBy(key).agg(F.min_by(text, F.xxhash64(text)).alias(text))


def remainder(column: Column, modulus: int) -> Column:
    """crc32 of an id as text, modulo modulus: the folds of the classifiers."""
    return F.crc32(column.cast("string").cast("binary")) % modulus


def small_batches(batches: Iterator[pa.RecordBatch], rows: int = 64, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Batches in equal slices of at most so many rows and, but for single rows, about so many bytes: what a worker holds
    results of at once. Nothing of a batch is held while the next one comes."""
    for batch in batches:
        parts = max(1, -(-batch.num_rows // rows), -(-batch.nbytes // size))
        step = max(1, -(-batch.num_rows // parts))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)
        del batch
        pa.default_memory_pool().release_unused()


def white_pieces(data: bytes, size: int = 1 << 22) -> Iterator[bytes]:
    """A text in pieces of about size bytes, cut at white space, so that a huge document is never one list of words."""
    if len(data) <= size:
        yield data
        return
    at = 0
    while at < len(data):
        end = min(len(data), at + size)
        while end < len(data) and data[end] not in b" \t\n\x0b\x0c\r":
            end += 1
        yield data[at:end]
        at = end


def connected(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """Connected components of an undirected edge list (a, b) of longs: rows (node, component), component the smallest node.

    Large-star and small-star steps alternate until the edges stay the same; each round is written to the shared
    folder. No neighbourhood is collected: a node's minimum is an aggregate, joined back to its edges. Nodes without
    an edge do not appear. Loops, repeated edges and nulls are ignored.
    """
    now = saved(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    mark = _mark(now)
    for _ in range(rounds):
        if not mark[0]:
            break
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(least, "a")
            .where("b <> m")
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(least.select("a", F.col("m").alias("b")))
            .where("a <> b")
            .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
            .distinct()
        )
        now = saved(small)
        before, mark = mark, _mark(now)
        if before == mark:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))


def _mark(edges: DataFrame) -> tuple:
    """A count and two checksums that tell whether an edge list has changed."""
    row = edges.agg(
        F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_003), F.sum(F.hash("b", "a").cast("long"))
    ).first()
    return tuple(row)
