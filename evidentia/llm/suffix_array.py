"""Substring deduplication on bytes: suffix arrays of shards, refined by doubling, give the repeated strings of 200 bytes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from . import repeats, suffix_sort

LENGTH = 200
#: Bytes of the prefix that a group's windows share: the first, and longer ones for prefixes that too many share.
PREFIXES = (64, 128, LENGTH)
#: Bytes of contexts in a shard, which has one suffix array.
SHARD_BYTES = 256 << 10
#: Bytes of text in a block: a token for each byte takes some sixty bytes of a worker's memory.
BLOCK_BYTES = 1 << 20

_BYTE = np.random.default_rng(20).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def byte_block(texts: list[bytes]) -> repeats.Block:
    """Documents as their bytes, each hashed by a table of random numbers."""
    raw = b"".join(texts)
    places = np.arange(len(raw) + 1)
    return repeats.Block(raw, places[:-1], places[1:], _BYTE[np.frombuffer(raw, np.uint8)], np.fromiter(map(len, texts), np.int64, len(texts)))


class Shard:
    """The suffix array of some contexts, down to windows of length bytes.

    at: where each window starts in the shard; kind: its number among the shard's distinct windows, which are numbered in
    their order; distinct: where the first window of each kind starts.
    """

    def __init__(self, contexts: list[bytes], length: int):
        data, sizes = np.frombuffer(b"".join(contexts), np.uint8), np.fromiter(map(len, contexts), np.int64, len(contexts))
        self.length = length
        self.at = repeats._spread(np.cumsum(sizes) - sizes, sizes - length + 1)
        suffixes = suffix_sort.byte_suffixes(data, length)
        order = suffixes.order(self.at)
        new = np.concatenate(([True], suffixes.common(order[:-1], order[1:], length) < length))
        self.distinct = order[new]
        kind = np.empty(len(data), np.int64)
        kind[order] = np.cumsum(new) - 1
        self.kind = kind[self.at]
        padded = np.concatenate((data, np.zeros(8, np.uint8)))
        self.eights = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, 8)[: len(data)]).view(">u8").ravel().astype(np.uint64)

    def compare(self, at: np.ndarray, other: "Shard", there: np.ndarray) -> np.ndarray:
        """-1, 0 or 1 for each pair of windows here and in another shard, by eight bytes at a time, the last eight overlapping."""
        out, live = np.zeros(len(at), np.int8), np.arange(len(at))
        for k in [*range(0, self.length - 7, 8), self.length - 8]:
            x, y = self.eights[at[live] + k], other.eights[there[live] + k]
            out[live[x < y]], out[live[x > y]] = -1, 1
            live = live[x == y]
        return out

    def find(self, wanted: np.ndarray, other: "Shard") -> np.ndarray:
        """For windows at wanted in another shard, the kind of the equal window here, or -1, by binary search."""
        low, high = np.zeros(len(wanted), np.int64), np.full(len(wanted), len(self.distinct))
        found = np.full(len(wanted), -1)
        live = np.arange(len(wanted))
        while len(live):
            middle = (low[live] + high[live]) // 2
            side = self.compare(self.distinct[middle], other, wanted[live])
            found[live[side == 0]] = middle[side == 0]
            low[live[side < 0]] = middle[side < 0] + 1
            high[live[side > 0]] = middle[side > 0]
            live = live[(side != 0) & (low[live] < high[live])]
        return found


def classes(contexts: list[bytes], keys: np.ndarray, length: int = LENGTH, shard_bytes: int = SHARD_BYTES) -> np.ndarray:
    """A number for every window of length bytes of the contexts in turn, equal where the windows are equal.

    Contexts come in the order of keys and are cut into shards, each with a suffix array of its own. A key whose contexts
    fill several shards is merged: the distinct windows of a shard are looked up in those before it that share the key.
    """
    sizes = np.fromiter(map(len, contexts), np.int64, len(contexts))
    cuts = np.unique([0, *np.searchsorted(np.cumsum(sizes), np.arange(shard_bytes, sizes.sum(), shard_bytes)).tolist(), len(contexts)])
    shards: list[tuple[Shard, np.ndarray, int]] = []
    out, total = [], 0
    for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        shard = Shard(contexts[a:z], length)
        names = np.full(len(shard.distinct), -1)
        while shards and shards[0][2] != keys[a]:
            shards.pop(0)
        for before, known, _ in shards:
            left = np.flatnonzero(names < 0)
            place = before.find(shard.distinct[left], shard)
            names[left[place >= 0]] = known[place[place >= 0]]
        fresh = names < 0
        names[fresh] = total + np.arange(fresh.sum())
        total += int(fresh.sum())
        shards.append((shard, names, keys[z - 1]))
        out.append(names[shard.kind])
    return np.concatenate(out)


def _finish(block: repeats.Block, gone: np.ndarray) -> pd.DataFrame:
    raw, out, at = np.frombuffer(block.raw, np.uint8), [], 0
    for n in block.sizes.tolist():
        drop = gone[at : at + n]
        spans = int(drop[:1].sum() + (drop[1:] & ~drop[:-1]).sum())
        kept = raw[at : at + n][~drop] if spans else raw[at : at + n]
        at += n
        out.append((n, n - len(kept), spans, kept.tobytes()))
    found = pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "kept"])
    found.insert(0, "doc_id", block.doc_ids())
    return found


METHOD = repeats.Method(length=LENGTH, prefixes=PREFIXES, block=byte_block, classes=classes, finish=_finish, keep_first=False)


def without_repeats(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans (maximal removed runs) and kept (the remaining bytes).

    A byte goes if a string of 200 bytes covers it that also starts anywhere else, in the same document or another
    (rows that repeat a doc_id, or have none, are documents of their own here). Matches never cross documents. Null and
    empty texts have no bytes; a very long text is arrays of its bytes in one task. An empty table gives an empty result.
    Other columns are not looked at.
    """
    return repeats.removed(docs, METHOD, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary", BLOCK_BYTES)
