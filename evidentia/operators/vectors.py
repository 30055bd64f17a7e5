"""An index over vectors: k-means cells on disk, a byte a dimension for the coarse ranking, whole vectors for the exact one."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..session import saved, shared_dir, ship
from .blocks import Best

#: Vectors that cells are fitted on at most, cells at most, and queries that the number of probes is measured with at most.
SAMPLE, MOST_CELLS, MEASURED = 20_000, 4096, 64
#: How many times the wanted number the coarse ranking fetches, and the recall that an index is tuned to.
OVER, RECALL = 4, 0.95
#: Queries of a block, blocks of them that are broadcast at most, and vectors that are scored at a time.
QUERIES, BROADCAST_BLOCKS, SLICE = 2048, 64, 1024
STEPS = 127.0


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def unit(vector: Column) -> Column:
    """The vector as doubles at length one; null where its length is zero or it has nulls."""
    wide = vector.cast("array<double>")
    size = F.sqrt(dot(wide, wide))
    return F.when(size > 0, F.transform(wide, lambda x: x / size))


@dataclass(frozen=True)
class VectorIndex:
    """rows: cell, id, code (tinyints) and unit, in a folder for each cell. centres: one row, an array of (cell, unit)."""

    rows: DataFrame
    centres: DataFrame
    cells: int
    dimensions: int
    probes: int


def build(vectors: DataFrame, dimensions: int, embedding: str = "embedding", id_column: str = "id", cells: int | None = None, seed: int = 7) -> VectorIndex:
    """Index the vectors of so many dimensions; those of another size, of length zero or with nulls have no place in it.

    Cells are fitted on the SAMPLE vectors whose ids have the smallest hashes; every vector is then put into its nearest
    cell. Cells are about the root of the number of vectors, MOST_CELLS at most, so centres stay small enough to broadcast.
    A cell is a folder; tasks take ranges of cells and ids, so that files are about as many as cells and no task holds a cell
    that many vectors fall into.
    """
    known = vectors.where(F.size(embedding) == dimensions).select(F.col(id_column).alias("id"), unit(F.col(embedding)).alias("unit")).where(~F.exists("unit", lambda x: x.isNull()) & F.col("unit").isNotNull())
    known = known.withColumn("features", array_to_vector("unit"))
    n = known.count()
    cells = max(1, min(cells or ceil(sqrt(n)), MOST_CELLS, max(n, 1)))
    centres: list[list[float]] = [[0.0] * dimensions]
    placed = known.withColumn("cell", F.lit(0))
    if n:
        sample = known.orderBy(F.xxhash64("id"), "id").limit(SAMPLE)
        model = KMeans(k=cells, seed=seed, maxIter=15, featuresCol="features", predictionCol="cell").fit(sample)
        centres = [[float(x) for x in c] for c in model.clusterCenters()]
        placed = model.transform(known)
    path = shared_dir(vectors.sparkSession)
    code = F.transform("unit", lambda x: F.round(x * STEPS).cast("tinyint"))
    placed.select("cell", "id", code.alias("code"), "unit").repartitionByRange("cell", F.xxhash64("id")).write.partitionBy("cell").parquet(path)
    rows = vectors.sparkSession.read.schema(f"id {known.schema['id'].dataType.simpleString()}, code array<tinyint>, unit array<double>, cell int").parquet(path)
    row = [([(k, c) for k, c in enumerate(centres)],)]
    found = vectors.sparkSession.createDataFrame(row, "centres array<struct<cell: int, unit: array<double>>>")
    return VectorIndex(rows, found, len(centres), dimensions, len(centres))


def _matrix(column: pa.Array, kind: type = np.float64) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1).astype(kind, copy=False)


def _packed(kind: pa.DataType, by_cell: bool):
    """For mapInArrow: rows of the index to blocks (cell, ids, codes, units as bytes); with by_cell each is of one cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            cells = batch.column("cell").to_numpy()
            order = np.argsort(cells, kind="stable") if by_cell else np.arange(len(cells))
            cuts = np.nonzero(np.diff(cells[order]))[0] + 1 if by_cell else []
            units, codes = _matrix(batch.column("unit")), _matrix(batch.column("code"), np.int8)
            for part in np.split(order, cuts):
                ids = batch.column("id").take(pa.array(part))
                columns = [pa.array([cells[part[0]]], pa.int32()), pa.array([ids.to_pylist()], pa.list_(kind)), pa.array([codes[part].tobytes()]), pa.array([units[part].tobytes()])]
                yield pa.RecordBatch.from_arrays(columns, ["cell", "ids", "codes", "units"])

    return run


def _scored(limit: int, over: int, dimensions: int, query_type: pa.DataType, id_type: pa.DataType):
    """For mapInArrow: pairs of a block of vectors and a block of queries (key, queries, q) to the best vectors of each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: dict = {}

        def told(key) -> Iterator[pa.RecordBatch]:
            queries, _, best = asked.pop(key)
            if best.id is not None:
                yield pa.RecordBatch.from_arrays([queries.take(pa.array(best.query)).cast(query_type), pa.array(best.id, id_type), pa.array(best.score)], ["query", "id", "score"])

        for batch in batches:
            for row in range(batch.num_rows):
                key = batch.column("key")[row].as_py()
                if key not in asked:
                    if len(asked) >= BROADCAST_BLOCKS:
                        yield from told(next(iter(asked)))
                    queries = batch.column("queries")[row].values
                    q = np.stack([np.frombuffer(x, np.float64) for x in batch.column("q")[row].as_py()])
                    asked[key] = (queries, q, Best(len(q), limit, 6))
                _, q, best = asked[key]
                ids = batch.column("ids")[row].values.to_numpy(zero_copy_only=False)
                units = np.frombuffer(batch.column("units")[row].as_buffer(), np.float64).reshape(-1, dimensions)
                codes = np.frombuffer(batch.column("codes")[row].as_buffer(), np.int8).reshape(-1, dimensions)
                for start in range(0, len(ids), SLICE):
                    part = units[start : start + SLICE]
                    scores = q @ part.T
                    if over and len(part) > limit * over:  # by the bytes first, and by the vectors those that are near by them
                        near = q.astype(np.float32) @ codes[start : start + SLICE].T.astype(np.float32)
                        cut = near.shape[1] - limit * over
                        scores[near < np.partition(near, cut, axis=1)[:, cut : cut + 1]] = -1
                    best.add(scores, ids[start : start + SLICE])
        for key in list(asked):
            yield from told(key)

    return run


def _bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [r.tobytes() for r in _matrix(batch.column("q"))]
        yield pa.RecordBatch.from_arrays([batch.column("query"), pa.array(rows, pa.binary())], ["query", "q"])


def _asked(queries: DataFrame, dimensions: int, embedding: str, id_column: str) -> DataFrame:
    """query and q (its unit vector as bytes) of the queries that can find something."""
    asked = queries.where(F.size(embedding) == dimensions).select(F.col(id_column).alias("query"), unit(F.col(embedding)).alias("q")).where(F.col("q").isNotNull() & ~F.exists("q", lambda x: x.isNull()))
    return asked.mapInArrow(_bytes, f"query {asked.schema['query'].dataType.simpleString()}, q binary")


def _nearest(probes: int):
    """For mapInArrow: queries, each beside the centres, to their nearest cells by nearness (nth, from 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                queries, vectors, centres = (batch.column(c)[row].values for c in ("queries", "q", "centres"))
                cells, points = centres.field("cell").to_numpy(), _matrix(centres.field("unit"))
                for start in range(0, len(queries), SLICE):
                    part = vectors.slice(start, SLICE)
                    q = np.stack([np.frombuffer(x, np.float64) for x in part.to_pylist()])
                    order = np.argsort(-(q @ points.T), axis=1, kind="stable")[:, :probes]
                    at = pa.array(np.repeat(np.arange(len(q)), order.shape[1]))
                    nth = pa.array(np.tile(np.arange(order.shape[1]), len(q)), pa.int32())
                    yield pa.RecordBatch.from_arrays([queries.slice(start, SLICE).take(at), part.take(at), nth, pa.array(cells[order.ravel()], pa.int32())], ["query", "q", "nth", "cell"])

    return run


def _dealt(asked: DataFrame) -> tuple[DataFrame, int]:
    """Blocks of queries (key, queries, q) and how many they are."""
    asked = saved(asked)
    blocks = max(1, -(-asked.count() // QUERIES))
    dealt = asked.groupBy(F.pmod(F.xxhash64("query"), F.lit(blocks)).cast("string").alias("key")).agg(F.collect_list(F.struct("query", "q")).alias("p"))
    return dealt.select("key", F.col("p.query").alias("queries"), "p.q"), blocks


def _routes(index: VectorIndex, asked: DataFrame, probes: int) -> DataFrame:
    """Each query with its nearest cells. The centres are one row, which each block of queries meets once."""
    pairs = _dealt(asked)[0].crossJoin(F.broadcast(index.centres)).select("queries", "q", "centres")
    return pairs.mapInArrow(_nearest(probes), f"query {asked.schema['query'].dataType.simpleString()}, q binary, nth int, cell int")


def search(index: VectorIndex, queries: DataFrame, limit: int, probes: int | None = None, over: int = OVER, embedding: str = "embedding", id_column: str = "id") -> DataFrame:
    """The nearest limit vectors of every query by cosine: query, rank, id, score (rounded to 6 digits; none at or below 0).

    probes cells (the index's own number by default) are searched by the bytes of their vectors for limit x over
    candidates of each block, and those are ranked again by the vectors themselves. probes of at least the number of cells
    with over 0 is exact: every vector is ranked by itself. Ties go to the smallest id. Queries of another size find nothing.
    Blocks of vectors are multiplied with blocks of queries, and a task hands on the best of each query alone.
    """
    asked = _asked(queries, index.dimensions, embedding, id_column)
    probes = min(probes or index.probes, index.cells)
    every = probes >= index.cells
    kind, id_kind = asked.schema["query"].dataType, index.rows.schema["id"].dataType
    packed = index.rows.mapInArrow(_packed(to_arrow_type(id_kind), not every), f"cell int, ids array<{id_kind.simpleString()}>, codes binary, units binary")
    if every:  # each block of vectors meets each block of queries, and cells do not matter
        side, blocks = _dealt(asked)
        pairs = packed.crossJoin(F.broadcast(side) if blocks <= BROADCAST_BLOCKS else side)
    else:
        routed = saved(_routes(index, asked, probes).select("query", "q", "cell"))
        blocks = max(1, -(-routed.count() // (QUERIES * index.cells)))
        side = routed.groupBy("cell", F.pmod(F.xxhash64("query"), F.lit(blocks)).alias("_b")).agg(F.collect_list(F.struct("query", "q")).alias("p"))
        pairs = packed.join(side.select("cell", F.concat_ws(" ", "cell", "_b").alias("key"), F.col("p.query").alias("queries"), "p.q"), "cell")
    run = _scored(limit, over, index.dimensions, to_arrow_type(kind), to_arrow_type(id_kind))
    found = pairs.select("key", "queries", "q", "ids", "codes", "units").mapInArrow(run, f"query {kind.simpleString()}, id {id_kind.simpleString()}, score double")
    return _best(found, "score", limit).select("query", F.col("n").alias("rank"), "id", "score")


def _best(rows: DataFrame, by: str, limit: int) -> DataFrame:
    """The first limit rows of each query. Spark keeps so many of each task before it shuffles, as the limit is a small one."""
    return rows.withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy(F.col(by).desc(), "id"))).where(F.col("n") <= limit)


def recall(found: DataFrame, truth: DataFrame) -> float:
    """The share of truth (query, id) that found has."""
    row = truth.select("query", "id").join(found.select("query", "id", F.lit(1).alias("hit")), ["query", "id"], "left").agg(F.count("*").alias("n"), F.count("hit").alias("m")).first()
    return row.m / row.n if row.n else 1.0


def tuned(index: VectorIndex, queries: DataFrame, limit: int = 10, target: float = RECALL, embedding: str = "embedding", id_column: str = "id") -> VectorIndex:
    """The index with the smallest number of probes that gives the target's recall on a bounded sample of queries.

    One exact search tells in which of its query's cells, by nearness, every true neighbour lies; their running share is the
    recall at each number of probes.
    """
    sample = saved(queries.orderBy(F.xxhash64(id_column), id_column).limit(MEASURED).select(F.col(id_column).alias("id"), F.col(embedding).alias("embedding")))
    truth = search(index, sample, limit, index.cells, 0)
    routes = _routes(index, _asked(sample, index.dimensions, "embedding", "id"), index.cells).select("query", "cell", "nth")
    where = index.rows.select("id", "cell").join(F.broadcast(truth), "id").join(routes, ["query", "cell"]).groupBy("nth").count()
    counts = dict(where.collect())
    total, upto = sum(counts.values()), 0
    for nth in range(index.cells):
        upto += counts.get(nth, 0)
        if upto >= target * total:
            return replace(index, probes=nth + 1)
    return index


ship(__name__)
