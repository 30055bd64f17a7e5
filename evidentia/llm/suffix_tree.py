"""Substring deduplication on words: prefix-partitioned suffix trees give the repeated windows of 20 words."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from . import repeats, suffix_sort

LENGTH = 20
#: Words of the prefix that a group's suffixes share: the first, and longer ones for prefixes that too many share.
PREFIXES = (6, 12, LENGTH)


_WHITE = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))
_BASE, _INVERSE, _MIX = (np.uint64(x) for x in (0x27D4EB2F165667C5, pow(0x27D4EB2F165667C5, -1, 2**64), 0xC2B2AE3D27D4EB4F))


def word_block(texts: list[bytes]) -> repeats.Block:
    """Documents as words, one space after each, without a Python object for any of them.

    The hash of a word is a polynomial of its bytes: a difference of running sums, moved to the same place by the inverse
    of the base. It only picks anchors; words are never taken to be equal for it.
    """
    data = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    white = _WHITE[data]
    after_word = np.concatenate(([False], ~white[:-1])) if len(data) else white
    first = np.flatnonzero(~white & ~after_word)
    raw = data[~white | after_word].copy()
    raw[_WHITE[raw]] = 32
    stops = np.flatnonzero(raw == 32)
    starts = np.concatenate(([0], stops[:-1] + 1)) if len(stops) else stops
    edges = np.searchsorted(first, np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts]))))
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((raw + np.uint64(1)) * np.multiply.accumulate(np.full(len(raw), _BASE)))))
    h = (total[stops] - total[starts]) * np.concatenate((np.ones(1, np.uint64), np.multiply.accumulate(np.full(len(raw), _INVERSE))))[starts]
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return repeats.Block(raw.tobytes(), starts, stops, h ^ (h >> np.uint64(29)), np.diff(edges))


@dataclass(frozen=True)
class Node:
    """An internal node of a suffix tree: the number of words that lead to it, and the places of its leaves."""

    depth: int
    leaves: np.ndarray


def subtree(contexts: list[bytes]) -> tuple[suffix_sort.Suffixes, np.ndarray, np.ndarray]:
    """The sorted suffixes of the contexts' words, where each context starts among them, and its number of words.

    A number of its own ends every context, so that no branch goes on into another one.
    """
    ids: dict[bytes, int] = {}
    lists = [c.split(b" ") for c in contexts]
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    starts = np.cumsum(sizes + 1) - sizes - 1
    numbers = np.empty(int((sizes + 1).sum()), np.int64)
    numbers[repeats._spread(starts, sizes)] = np.fromiter((ids.setdefault(w, len(ids)) for x in lists for w in x), np.int64, int(sizes.sum()))
    numbers[starts + sizes] = len(ids) + np.arange(len(lists))
    return suffix_sort.number_suffixes(numbers, LENGTH), starts, sizes


def deep_nodes(tree: suffix_sort.Suffixes, places: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The uppermost nodes of depth length or more over the leaves at places: places in the order of leaves, the node of
    each, and each node's depth (a leaf that hangs alone has the depth 0).

    Neighbouring leaves part at the depth of their common prefix. Where it is under length a new node begins; within a
    node the least common prefix is its depth, and the words that lead to it are a repeat that all its leaves share and
    that cannot be made longer to the right.
    """
    order = tree.order(places)
    parted = tree.common(order[:-1], order[1:], 2 * length)
    new = np.concatenate(([True], parted < length))
    edges = np.flatnonzero(new)
    depth = np.minimum.reduceat(np.concatenate((np.where(parted < length, 2 * length, parted), [2 * length])), edges) if len(edges) else edges
    return order, np.cumsum(new) - 1, np.where(np.diff(np.append(edges, len(order))) > 1, depth, 0)


def repeated_nodes(contexts: list[bytes], length: int = LENGTH) -> list[Node]:
    """The uppermost deep nodes with two leaves or more; leaves are numbered over all windows of the contexts in turn."""
    tree, starts, sizes = subtree(contexts)
    places = repeats._spread(starts, np.maximum(sizes - length + 1, 0))
    order, node, depth = deep_nodes(tree, places, length)
    number = np.empty(len(tree.tokens), np.int64)
    number[places] = np.arange(len(places))
    return [Node(int(d), np.sort(number[order[node == k]])) for k, d in enumerate(depth) if d]


def classes(contexts: list[bytes], keys: np.ndarray) -> np.ndarray:
    """The deep node above every window of the contexts: the windows below one node are equal."""
    tree, starts, sizes = subtree(contexts)
    places = repeats._spread(starts, sizes - LENGTH + 1)
    order, node, _ = deep_nodes(tree, places)
    found = np.empty(len(tree.tokens), np.int64)
    found[order] = node
    return found[places]


def _finish(block: repeats.Block, gone: np.ndarray) -> pd.DataFrame:
    raw = np.frombuffer(block.raw, np.uint8)
    width = np.diff(np.append(block.starts, len(raw)))
    kept = raw[np.repeat(~gone, width)].tobytes()
    ends = np.concatenate(([0], np.cumsum(block.sizes)))
    count, size = np.concatenate(([0], np.cumsum(gone))), np.concatenate(([0], np.cumsum(np.where(gone, 0, width))))
    at = size[ends].tolist()
    texts = [kept[a : max(a, z - 1)].decode("utf-8", "surrogatepass") for a, z in zip(at[:-1], at[1:])]
    return pd.DataFrame({"doc_id": block.doc_ids(), "n_words": block.sizes, "n_removed": np.diff(count[ends]), "kept": texts})


METHOD = repeats.Method(length=LENGTH, prefixes=PREFIXES, block=word_block, classes=classes, finish=_finish, keep_first=True)


def without_repeats(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed and kept, its words that no repeated window covers, space-joined.

    A window is 20 consecutive words, unchanged, of one document; it is repeated if the same words also start earlier, in
    a smaller doc_id or earlier in the same document. Rows that repeat a doc_id count as one document after the other, in
    the order of a hash of their texts; rows without a doc_id come after all others and keep the null. Null and
    empty texts have no words. A very long text is arrays of its bytes and words in one task, without objects per word.
    An empty table gives an empty result. Other columns are not looked at.
    """
    return repeats.removed(docs, METHOD, "doc_id long, n_words long, n_removed long, kept string")
