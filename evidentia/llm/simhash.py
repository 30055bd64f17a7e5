"""SimHash near-duplicates by a byte-position inverted index with count filtering."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected, keyed, salt, salted, saved, small_batches, white_pieces, without

WIDTH = 3
MAX_BITS = 2
#: Two fingerprints that differ in MAX_BITS bits agree in at least this many of their 8 bytes.
MIN_BYTES = 8 - MAX_BITS
#: Positional bytes that the members of a list of the index share, and the lists in which such a pair meets at least.
LIST_BYTES = 5
MIN_LISTS = comb(MIN_BYTES, LIST_BYTES)
#: A list of more members sends verified links instead of its pairs, with the tally FULL.
LONG_LIST, FULL = 32, comb(8, LIST_BYTES)


def fingerprint(text: str | None, width: int = WIDTH) -> int:
    """The 64-bit SimHash of a text: a bit is set if over half of the shingles' hashes have it. No words give 0."""
    ones, n, tail = np.zeros(64, np.int64), 0, []
    digest = xxhash.xxh64_intdigest
    pieces = white_pieces((text or "").encode("utf-8", "surrogatepass").lower())
    words: list[bytes] = []
    for piece in pieces:
        words = tail + piece.split()
        if len(words) < width:
            tail = words
            continue
        line = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        hashes = np.fromiter(
            (digest(line[a:b], 42) for a, b in zip(starts.tolist(), ends[width - 1 :].tolist())), np.uint64, len(words) - width + 1
        )
        n += len(hashes)
        for at in range(0, len(hashes), 1 << 16):
            part = hashes[at : at + (1 << 16)]
            ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        tail = words[len(words) - width + 1 :]
    if not n:
        return digest(b" ".join(words), 42) if words else 0
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches, 1024, 16 << 20):
        found = np.fromiter((fingerprint(t.as_py()) for t in batch.column(2)), np.uint64, batch.num_rows)
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(found.view(np.int64))], names=["row", "doc_id", "fp"])


def fingerprints(docs: DataFrame, key: str | None = None) -> DataFrame:
    """row (the column key, or else a number given here), doc_id and fp (the fingerprint as a signed long) of every row."""
    rows = docs.select((F.col(key) if key else F.monotonically_increasing_id()).alias("row"), F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(_fingerprints, "row long, doc_id long, fp long")


def _forest(fps: np.ndarray, ids: np.ndarray, free: int) -> list[tuple[int, int]]:
    """Links that join the members of one posting as all verified pairs would, at most one per member.

    Members agree outside the 16 bits of free. Up to 64 members are compared pair by pair; more of them (65,536 at most,
    as 16 bits are free) by the values at one bit or none from each: members within two bits of each other meet there.
    """
    m = len(fps)
    parent = np.arange(m)
    if m <= 64:
        near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= MAX_BITS
        while True:
            low = np.where(near, parent[None, :], m).min(axis=1)
            if (low == parent).all():
                break
            parent = low
    else:
        low_bits = [b for b in range(64) if free >> b & 1]
        value = np.zeros(m, np.int64)
        for k, b in enumerate(low_bits):
            value |= ((fps >> np.uint64(b)) & np.uint64(1)).astype(np.int64) << k
        size = 1 << len(low_bits)
        every = np.arange(size)
        label = np.full(size, m)
        label[value] = np.arange(m)
        there = label < m
        while True:
            meet = label.copy()
            for k in range(len(low_bits)):
                np.minimum(meet, label[every ^ (1 << k)], out=meet)
            back = meet.copy()
            for k in range(len(low_bits)):
                np.minimum(back, meet[every ^ (1 << k)], out=back)
            back[~there] = m
            if (back == label).all():
                break
            label = back
        parent = label[value]
    return [(int(ids[i]), int(ids[p])) for i, p in enumerate(parent) if p != i]


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs of every list (n 1), or for a long list links that are verified already (n FULL)."""
    for batch in small_batches(batches, 1024):
        a, b, n = [], [], []
        for mask, members in zip(batch.column(0), batch.column(1)):
            fps = np.sort(members.values.to_numpy().view(np.uint64))
            if len(fps) <= LONG_LIST:
                i, j = np.triu_indices(len(fps), 1)
                a, b, n = [*a, fps[i]], [*b, fps[j]], [*n, np.ones(len(i), np.int32)]
                continue
            for x, y in _long_links(fps, mask.as_py() & (2**64 - 1)):
                a, b, n = [*a, x], [*b, y], [*n, np.full(len(x), FULL, np.int32)]
        flat = [np.concatenate(x) if x else np.empty(0, np.uint64) for x in (a, b)]
        yield pa.record_batch([*(pa.array(x.view(np.int64)) for x in flat), pa.array(np.concatenate(n) if n else np.empty(0, np.int32))], names=["a", "b", "n"])


def _long_links(fps: np.ndarray, mask: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links that join the members of a long list as all verified pairs would.

    Of its free bytes two near members share at least one: the list is cut by each in turn, to 65,536 members at most.
    """
    for k in range(8):
        byte = 0xFF << 8 * k
        if mask & byte:
            continue
        key = fps & np.uint64(mask | byte)
        order = np.argsort(key, kind="stable")
        edges = np.flatnonzero(np.concatenate(([True], key[order][1:] != key[order][:-1], [True])))
        for x, y in zip(edges[:-1], edges[1:]):
            if y - x > 1:
                part = fps[order[x:y]]
                links = np.array(_forest(part, np.arange(len(part)), (2**64 - 1) ^ (mask | byte)), np.int64).reshape(-1, 2)
                yield part[links[:, 0]], part[links[:, 1]]


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def links(nodes: DataFrame) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (fp), enough to connect what MAX_BITS bits or fewer part.

    The index has a list for the bytes at every choice of LIST_BYTES positions: a list of one positional byte would hold a
    256th of the corpus, and its pairs grow with the square. Two fingerprints within MAX_BITS bits agree in MIN_BYTES
    positions and so meet in MIN_LISTS lists at least. The lists in which a pair meets are tallied, pairs that reach that
    number are kept and then verified by their bits. A list of more than LONG_LIST members sends no pairs but, one a member
    and cut at most, links to the least member that verified pairs in the list reach: what is near and meets there is
    linked, whatever its tally elsewhere. Two fingerprints never meet in all FULL lists, so those links stand out.
    """
    keys = []
    for kept in combinations(range(8), LIST_BYTES):
        mask = sum(0xFF << 8 * k for k in kept)
        keys.append(F.struct(F.lit(_signed(mask)).alias("mask"), F.col("fp").bitwiseAND(F.lit(_signed(mask))).alias("bytes")))
    posted = nodes.select("fp", F.explode(F.array(*keys)).alias("key"))
    lists = posted.groupBy("key.mask", "key.bytes").agg(F.collect_list("fp").alias("members")).where(F.size("members") > 1).select("mask", "members")
    tallied = lists.mapInArrow(_pairs, "a long, b long, n int").groupBy("a", "b").agg(F.sum("n").alias("n"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS
    return tallied.where(F.col("n") >= MIN_LISTS).where(near | (F.col("n") >= FULL)).select("a", "b")


def _grouped(docs: DataFrame, key: str | None = None) -> DataFrame:
    """row, doc_id, fp and first (none, doc_id, row), the first row of everything that links to it by any number of steps."""
    prints = saved(fingerprints(docs, key).withColumn("salt", salt()))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    nodes = saved(prints.groupBy("fp").agg(F.min(order).alias("first"), F.count("*").alias("n")))
    parts = connected(links(nodes.select("fp")))
    parts = saved(parts.unionByName(parts.select(F.col("component").alias("node"), "component")).distinct())
    whole = parts.join(nodes, parts["node"] == nodes["fp"]).groupBy("component").agg(F.min("first").alias("least"))
    linked = parts.join(whole, "component").select("node", "least")
    named = nodes.join(linked, nodes["fp"] == linked["node"], "left").where("n > 1 or least is not null").select("fp", F.coalesce("least", "first").alias("first"))
    return salted(prints, named, "fp").withColumn("first", F.coalesce("first", order))


def near_groups(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (16 hex digits) and component_id (the smallest doc_id reachable).

    Texts are lower-cased in A-Z, cut into words at ASCII white space and into 3-word shingles, repeats included; a text
    of fewer words is one shingle, one without words (null, empty, white space) has fingerprint zero and links like any
    other. A very long text is read in pieces. Equal fingerprints fold into one node before the index, so thousands of
    copies cost one node. A missing doc_id is never the smallest: component_id is null only where no row has one. A
    repeated doc_id gives a row each time; an empty table gives an empty result. Other columns are not looked at.
    """
    return _grouped(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("first.doc_id").alias("component_id"))


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """Of each group of near copies the row of smallest doc_id (a missing one comes last, of equal ones the first row stays)."""
    docs, key = keyed(docs)
    return without(docs, _grouped(docs, key).where("row <> first.row").select(F.col("row").alias(key)), key).drop(key)
