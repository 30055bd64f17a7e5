"""Line deduplication: hashes range-partitioned with a secondary sort; streams of first occurrences give keep bitmaps."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved

#: A line counts from so many code points on, and goes if it is in so many documents or more.
LEAST_CHARS, LEAST_DOCUMENTS = 20, 3
#: Bitmaps up to this many bytes in all may be broadcast to the texts; beyond that both are shuffled.
BROADCAST_BYTES = 16 << 20
#: The place of a row without doc_id: before all others, so that a line is rather kept where there is an id.
NO_ID = -(2**63)

UPPER, WHITE = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", " \t\n\x0b\x0c\r"
_PLACE = ["doc", "mark", "n_lines", "pos"]


def line_key(line: Column) -> Column:
    """A line with the ASCII white space at both ends gone and A-Z as a-z. lower() is the same for ASCII text, and faster."""
    bare = F.btrim(line, F.lit(WHITE))
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, UPPER.lower()))


def _identified(docs: DataFrame) -> DataFrame:
    """doc_id, text, and what tells a row wherever it is read: doc, mark (of the text) and n_lines. Rows that share all
    three are copies under one id, with the same verdicts; no number is given out that a second run could give otherwise."""
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.withColumns({
        "doc": F.coalesce("doc_id", F.lit(NO_ID)),
        "mark": F.xxhash64("text"),
        "n_lines": F.char_length("text") - F.char_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1,
    })


def line_hashes(docs: DataFrame, least: int = LEAST_CHARS) -> DataFrame:
    """(h, g, doc, mark, n_lines, pos): the 128-bit hash of the key of every line that counts, and where the line is."""
    lines = _identified(docs).select("doc", "mark", "n_lines", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    keys = lines.where(F.char_length("line") >= least).withColumn("key", line_key(F.col("line"))).where(F.char_length("key") >= least)
    return keys.select(F.xxhash64("key").alias("h"), F.xxhash64(F.lit(1), "key").alias("g"), *_PLACE)


def _nth(doc: np.ndarray, new_run: np.ndarray) -> np.ndarray:
    """Of each row the number of its document in its run, from 0."""
    count = np.cumsum(new_run | np.concatenate(([True], doc[1:] != doc[:-1])))
    starts = np.flatnonzero(new_run)
    return count - np.repeat(count[starts], np.diff(np.append(starts, len(doc))))


class _Run:
    """The rows of one hash at an end of a partition or a batch; documents come from the largest down.

    held are the rows not settled: those of the first document and, while there are too few documents, of the next ones.
    """

    def __init__(self, documents: int, head: bool):
        self.documents, self.head, self.seen, self.last = documents, head, 0, None
        self.held: list[pa.Table] = []

    def add(self, rows: pa.Table) -> Iterator[pa.RecordBatch]:
        doc = rows["doc"].to_numpy()
        nth = np.cumsum(np.concatenate(([doc[0] != self.last], doc[1:] != doc[:-1]))) + self.seen - 1
        self.held.append(rows.append_column("nth", pa.array(nth)))
        self.seen, self.last = int(nth[-1]) + 1, doc[-1]
        if self.seen >= self.documents:
            for part in self.held:
                if pc.max(part["nth"]).as_py():
                    yield _found(part.filter(pc.greater(part["nth"], 0)), True, False)
            self.held = [part.filter(pc.equal(part["nth"], 0)) for part in self.held if part["nth"][0].as_py() == 0]

    def close(self, end: bool) -> Iterator[pa.RecordBatch]:
        """What only other partitions can judge: there is none unless the run is the partition's first or last."""
        for part in self.held if end or self.head else ():
            yield _found(part, False, self.seen >= self.documents)


def _stream(documents: int):
    """Over one partition in order of (h, g, doc falling): the lines that go, and those that only other partitions can judge.

    Of the documents of a run of equal hashes the first keeps its lines, and if there are enough the others lose theirs.
    Only the first and the last run of a partition may go on elsewhere: of those, what is not settled is handed on with
    many, whether the run has documents enough in this partition alone. A run that fills many partitions hands on the lines
    of one document from each.
    """

    def first_occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, key = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            h, g, doc = (rows[k].to_numpy() for k in ("h", "g", "doc"))
            new_run = np.concatenate(([True], (h[1:] != h[:-1]) | (g[1:] != g[:-1])))
            starts = np.flatnonzero(new_run)
            if key != (h[0], g[0]):
                if run:
                    yield from run.close(False)
                run = _Run(documents, run is None)
            yield from run.add(rows.slice(0, starts[1] if len(starts) > 1 else len(h)))
            if len(starts) > 1:
                yield from run.close(False)
                a, z = starts[1], starts[-1]
                if z > a:
                    nth = _nth(doc[a:z], new_run[a:z])
                    sizes = np.diff(starts[1:])
                    enough = np.repeat(np.maximum.reduceat(nth, starts[1:-1] - a) + 1 >= documents, sizes)
                    yield _found(rows.slice(a, z - a).filter(pa.array(enough & (nth > 0))), True, False)
                run = _Run(documents, False)
                yield from run.add(rows.slice(z))
            key = h[-1], g[-1]
        if run:
            yield from run.close(True)

    return first_occurrences


def _found(rows: pa.Table, sure: bool, many: bool) -> pa.RecordBatch:
    flags = [pa.array(np.full(rows.num_rows, x)) for x in (sure, many)]
    columns = [rows[k].combine_chunks() for k in ("h", "g", *_PLACE)]
    return pa.record_batch([*flags, *columns], names=["sure", "many", "h", "g", *_PLACE])


def dropped_lines(docs: DataFrame, least: int = LEAST_CHARS, documents: int = LEAST_DOCUMENTS) -> DataFrame:
    """(doc, mark, n_lines, pos) of every line that goes.

    The hashes are written once, then dealt by ranges of (hash, document falling, position): a line that a third of all
    documents hold fills many partitions, and each is sorted and streamed. What the ends of partitions leave open, lines of
    two documents at most at each end, is settled by one more small aggregation.
    """
    order = ["h", "g", F.col("doc").desc(), "mark", "n_lines", "pos"]
    dealt = saved(line_hashes(docs, least)).repartitionByRange(*order).sortWithinPartitions(*order)
    kinds = "sure boolean, many boolean, h long, g long, doc long, mark long, n_lines int, pos int"
    found = saved(dealt.mapInArrow(_stream(documents), kinds))
    left = found.where("not sure")
    runs = left.groupBy("h", "g").agg(F.max("doc").alias("top"), (F.max("many") | (F.count_distinct("doc") >= documents)).alias("enough"))
    settled = left.join(runs.where("enough"), ["h", "g"]).where("doc <> top")
    return found.where("sure").select(*_PLACE).unionByName(settled.select(*_PLACE))


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, lists = batch.column("n_lines").to_pylist(), batch.column("gone")
        bits, counts = [], []
        for size, gone in zip(n, lists):
            keep = np.ones(size, bool)
            keep[gone.values.to_numpy()] = False
            counts.append(size - int(keep.sum()))
            bits.append(zlib.compress(np.packbits(keep, bitorder="little").tobytes(), 1))
        yield pa.record_batch([batch.column("doc"), batch.column("mark"), batch.column("n_lines"), pa.array(counts, pa.int64()), pa.array(bits, pa.binary())], names=["doc", "mark", "n_lines", "n_dropped", "bitmap"])


def keep_bitmaps(docs: DataFrame, least: int = LEAST_CHARS, documents: int = LEAST_DOCUMENTS) -> DataFrame:
    """A row per document that loses lines: doc (its doc_id), mark and n_lines, which tell it, n_dropped and bitmap.

    A line's key is the line without ASCII white space at its ends, A-Z lower-cased. Keys of least code points or more that
    are in so many documents lose all their lines but those of the largest doc_id. bitmap has a bit a line, 1 if it stays,
    the first line lowest, compressed by zlib. Keys are told by 128 bits of hash.

    Rows of one doc_id are one document; those without a doc_id are one document too, before all others. Null and empty
    texts have one empty line. An empty table gives an empty result. Other columns are not looked at.
    """
    lists = dropped_lines(docs, least, documents).groupBy("doc", "mark", "n_lines").agg(F.collect_list("pos").alias("gone"))
    return lists.mapInArrow(_bitmaps, "doc long, mark long, n_lines int, n_dropped long, bitmap binary")


def kept_text(text: bytes, bitmap: bytes) -> bytes:
    """The lines of a text whose bit is 1."""
    lines = text.split(b"\n")
    keep = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), count=len(lines), bitorder="little")
    return b"\n".join([line for line, k in zip(lines, keep.tolist()) if k])


def _kept(texts: pa.Array, bitmaps: pa.Array) -> pa.Array:
    pairs = zip(texts.cast(pa.binary()), bitmaps)
    return pa.array([kept_text(t.as_py(), b.as_py()) if b.is_valid else None for t, b in pairs], pa.binary()).cast(pa.string())


def without_lines(docs: DataFrame, bitmaps: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """One row per row of docs: doc_id, n_lines (before), n_dropped and kept, the lines left, joined by \\n.

    bitmaps is written and weighed first: up to limit bytes it is broadcast, else both sides are shuffled. Only texts that
    lose lines pass through Python; a very long one is there alone or with few others, as batches are bounded by bytes.
    """
    bitmaps = saved(bitmaps)
    size = bitmaps.agg(F.sum(F.octet_length("bitmap") + 64)).first()[0] or 0
    rows = _identified(docs).join(F.broadcast(bitmaps) if size <= limit else bitmaps.hint("merge"), ["doc", "mark", "n_lines"], "left")
    less = F.arrow_udf(_kept, "string")(F.when(F.col("bitmap").isNotNull(), F.col("text")), "bitmap")
    return rows.select(
        "doc_id", F.col("n_lines").cast("long"), F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"), F.coalesce(less, "text").alias("kept")
    )
