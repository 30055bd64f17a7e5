"""Suffix arrays of small token sequences in numpy: refinement by doubling, and common prefixes from its ranks."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Suffixes:
    """The suffixes of a token sequence, ranked by their first depth tokens at every depth that refinement passed.

    ranks[k][i] is where the suffixes that share the first depths[k] tokens with suffix i begin in sorted order. Past the
    end of the sequence come tokens smaller than all others.
    """

    tokens: np.ndarray
    depths: list[int]
    ranks: list[np.ndarray]

    def order(self, places: np.ndarray) -> np.ndarray:
        """The places in the order of their suffixes, the smaller place first where ranks are equal."""
        return places[np.argsort(self.ranks[-1][places].astype(np.int64) * len(self.tokens) + places)]

    def common(self, a: np.ndarray, b: np.ndarray, limit: int) -> np.ndarray:
        """How many tokens the suffixes at a and b have in common, limit at most.

        A linear pass would take over what is known of the suffix before; here the ranks of every depth, deepest first,
        are asked in turn for all pairs at once, and a depth at which a pair agrees is added to what it has.
        """
        n, done, live = len(self.tokens), np.zeros(len(a), np.int64), np.arange(len(a))
        for depth, rank in zip([*reversed(self.depths), *(1 << k for k in range((self.depths[0] - 1).bit_length() - 1, -1, -1))], [*reversed(self.ranks), *[None] * 64]):
            i, j = a[live] + done[live], b[live] + done[live]
            inside = np.maximum(i, j) + depth <= n
            i, j = np.where(inside, i, 0), np.where(inside, j, 0)
            if rank is not None:
                same = inside & (rank[i] == rank[j])
            else:
                same = inside.copy()
                for k in range(depth):
                    same &= self.tokens[np.minimum(i + k, n - 1)] == self.tokens[np.minimum(j + k, n - 1)]
            done[live[same]] += depth
            live = live[done[live] < limit]
        return np.minimum(done, limit)


def refined(tokens: np.ndarray, first: np.ndarray, start: int, depth: int) -> Suffixes:
    """Larsson-Sadakane refinement: suffixes sorted by their first start tokens, then by twice as many, up to depth at least.

    first holds a number for every suffix that orders it by its first start tokens. Each round sorts the groups of two or
    more suffixes that are still equal by the rank of the suffix that follows at the depth reached, which doubles it;
    suffixes that stand alone are not touched again.
    """
    n = len(tokens)
    order = np.argsort(first)
    new = np.flatnonzero(np.concatenate(([True], first[order][1:] != first[order][:-1]))) if n else np.empty(0, np.int64)
    sizes = np.diff(np.append(new, n))
    rank = np.empty(n, np.int32)
    rank[order] = np.repeat(new, sizes)
    open_ = order[np.repeat(sizes > 1, sizes)]
    depths, ranks, reached = [start], [rank], start
    while reached < depth:
        rank = rank.copy()
        if len(open_):
            after = open_ + reached
            follow = np.where(after < n, ranks[-1][np.minimum(after, n - 1)] + 1, 0)
            old = ranks[-1][open_]
            place = np.argsort(old.astype(np.int64) * (n + 1) + follow)
            open_, old, follow = open_[place], old[place], follow[place]
            at = np.arange(len(open_))
            group = np.concatenate(([True], old[1:] != old[:-1]))
            sub = group | np.concatenate(([True], follow[1:] != follow[:-1]))
            # a suffix's new rank is its group's old one and the number of suffixes of the group before its subgroup
            rank[open_] = old + np.maximum.accumulate(np.where(sub, at, 0)) - np.maximum.accumulate(np.where(group, at, 0))
            edges = np.flatnonzero(sub)
            sizes = np.diff(np.append(edges, len(open_)))
            open_ = open_[np.repeat(sizes > 1, sizes)]
        reached *= 2
        depths.append(reached)
        ranks.append(rank)
    return Suffixes(tokens, depths, ranks)


def byte_suffixes(data: np.ndarray, depth: int) -> Suffixes:
    """Suffixes of bytes, sorted by seven bytes at once to begin with (nine bits each, as there is an end before all bytes)."""
    padded = np.concatenate((data.astype(np.uint64) + np.uint64(1), np.zeros(6, np.uint64)))
    key = np.zeros(len(data), np.uint64)
    for k in range(7):
        key = (key << np.uint64(9)) | padded[k : k + len(data)]
    return refined(data, key, 7, depth)


def number_suffixes(numbers: np.ndarray, depth: int) -> Suffixes:
    """Suffixes of numbers under 2^31, sorted by two at once to begin with."""
    padded = np.append(numbers, -1).astype(np.int64) + 1
    return refined(numbers, (padded[:-1] << 32) | padded[1:], 2, depth)
