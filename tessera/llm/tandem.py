"""Runs of one sequence by the linear tandem-repeat method of Gusfield and Stoye.

1. ``Names`` names blocks of 1, 2, 4, ... symbols, so that two places' longest common extension, forwards or
   backwards, takes one comparison a level, for arrays of places at once; the last level sorts the suffixes.
2. Lempel-Ziv blocks cut the sequence.  A square that isn't a copy of an earlier one touches a border of
   blocks; extensions from the borders give a set of squares that covers every first occurrence from its left.
3. In the suffix tree each of these squares is walked along suffix links, one rotation a step, until a
   rotation doesn't occur or is marked already.  The marks are the vocabulary of all squares.
4. The leaves below a mark are all places of that square; places in a row with one period merge into a run.

Only squares of primitive roots are walked: others lie inside runs of their root's period.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np


class Names:
    """Names of the blocks of 2**j symbols at every place; a tail that is shorter has a name of its own."""

    def __init__(self, symbols: np.ndarray) -> None:
        n = len(symbols)
        self.n, self.levels = n, []
        rank = symbols.astype(np.int64)
        while True:
            self.levels.append(np.append(rank, -1))
            if n == 0 or int(rank.max()) == n - 1:
                break
            step = 1 << (len(self.levels) - 1)
            after = np.zeros(n, np.int64)
            after[: max(0, n - step)] = rank[step:] + 1
            key = rank * (n + 1) + after
            order = np.argsort(key, kind="stable")
            new = np.ones(n, np.int64)
            new[0] = 0
            new[1:] = key[order[1:]] != key[order[:-1]]
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(new)
        self.rank = self.levels[-1][:n]

    def forwards(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How far the suffixes at different places ``i`` and ``j`` agree."""
        i, j = i.copy(), j.copy()
        begin = i.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            step = (self.levels[k][i] == self.levels[k][j]).astype(np.int64) << k
            i += step
            j += step
        return i - begin

    def backwards(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How far the prefixes that end at different places ``i`` and ``j``, these included, agree from their ends."""
        i, j = i.copy(), j.copy()
        begin = i.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            low, high = i - (1 << k) + 1, j - (1 << k) + 1
            fits = (low >= 0) & (high >= 0)
            same = fits & (self.levels[k][np.where(fits, low, 0)] == self.levels[k][np.where(fits, high, 0)])
            step = same.astype(np.int64) << k
            i -= step
            j -= step
        return begin - i


def blocks(places: list[int], lcp: list[int]) -> list[int]:
    """Starts of the Lempel-Ziv blocks: each is the longest prefix of the rest that begins earlier too, or one symbol."""
    n = len(places)
    longest = [0] * n
    stack: list[tuple[int, int]] = []
    for m in range(n + 1):
        place, shared = (places[m], lcp[m]) if m < n else (-1, 0)
        while stack:
            top, reach = stack[-1]
            if place < top:  # the neighbour after is earlier: the better of both sides
                longest[top] = max(reach, shared)
                shared = min(reach, shared)
            elif shared <= reach:
                longest[top] = reach
            else:
                break
            stack.pop()
        stack.append((place, shared))
    starts, at = [], 0
    while at < n:
        starts.append(at)
        at += longest[at] or 1
    return starts


class SuffixTree:
    """Inner nodes over the sorted suffixes: string depth, first and last leaf, parent; and the leaves' parents."""

    def __init__(self, lcp: list[int]) -> None:
        n = len(lcp)
        self.depth, self.first, self.last, self.parent = [0], [0], [n - 1], [-1]
        self.above = [0] * n
        stack = [0]
        for m in range(1, n + 1):
            shared = lcp[m] if m < n else 0
            if shared > self.depth[stack[-1]]:
                stack.append(self._node(shared, m - 1))
            self.above[m - 1] = stack[-1]
            while self.depth[stack[-1]] > shared:
                v = stack.pop()
                self.last[v] = m - 1
                if self.depth[stack[-1]] < shared:
                    stack.append(self._node(shared, self.first[v]))
                self.parent[v] = stack[-1]

    def _node(self, depth: int, first: int) -> int:
        self.depth.append(depth)
        self.first.append(first)
        self.last.append(first)
        self.parent.append(-1)
        return len(self.depth) - 1

    def locus(self, leaf: int, length: int) -> tuple[int, int]:
        """First and last leaf below the place ``length`` symbols down on the way to ``leaf``."""
        v = self.above[leaf]
        if self.depth[v] < length:
            return leaf, leaf
        while (up := self.parent[v]) >= 0 and self.depth[up] >= length:
            v = up
        return self.first[v], self.last[v]


@lru_cache(maxsize=4)
def _least_factors(most: int) -> np.ndarray:
    out = np.zeros(most + 1, np.int64)
    for p in range(2, most + 1):
        if p * p > most:
            break
        if not out[p]:
            span = out[p * p :: p]
            span[span == 0] = p
    return np.where(out == 0, np.arange(most + 1), out)


def _primitive(names: Names, start: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Whether the ``period`` symbols at ``start`` are no power of fewer symbols."""
    out = np.ones(len(start), bool)
    if not len(start):
        return out
    least = _least_factors(1 << int(period.max()).bit_length())
    rest = period.copy()
    while (live := np.flatnonzero(rest > 1)).size:
        prime = least[rest[live]]
        root = period[live] // prime
        out[live] &= names.forwards(start[live], start[live] + root) < period[live] - root
        rest[live] //= prime
    return out


def covering_squares(names: Names, starts: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(start, period) of squares that begin the stretches of squares at the borders of blocks, found by extension."""
    n = names.n
    border = np.array([*starts, n], np.int64)
    size = np.diff(border)
    # one symbol compared with those of the block before a border, and with those of two blocks after it
    before, at = size[:-1], border[1:-1]
    after = size + np.append(size[1:], 0)
    step = lambda count: np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + 1
    left = np.repeat(at, before) - step(before)
    right = np.repeat(at, before)
    low = np.repeat(border[:-1], after)
    high = low + step(after)
    inside = high < n
    i, j = np.concatenate([left, low[inside]]), np.concatenate([right, high[inside]])
    symbol = names.levels[0]
    # the same symbol here or just before, else there is nothing to extend
    some = (symbol[i] == symbol[j]) | ((i > 0) & (symbol[i - 1] == symbol[j - 1]))
    i, j = i[some], j[some]
    back, forth = names.backwards(i - 1, j - 1), names.forwards(i, j)
    period = j - i
    square = back + forth >= period
    found = np.unique(np.stack([(i - back)[square], period[square]], axis=1), axis=0)
    keep = _primitive(names, found[:, 0], found[:, 1])
    return found[keep, 0], found[keep, 1]


def vocabulary(symbols: list[int], names: Names, places: np.ndarray, tree: SuffixTree, squares: tuple[np.ndarray, np.ndarray]) -> set[tuple[int, int, int]]:
    """(first leaf, last leaf, period) of every square's locus: walks along suffix links from ``squares``."""
    n, rank, sa = names.n, names.rank.tolist(), places.tolist()
    marked: set[tuple[int, int, int]] = set()
    for start, period in zip(*(x.tolist() for x in squares), strict=True):
        i = start
        while True:
            mark = (*tree.locus(rank[i], 2 * period), period)
            if mark in marked:
                break
            marked.add(mark)
            # the next rotation: over the suffix link, then down by the symbol that left
            symbol, i = symbols[i], i + 1
            tail = 2 * period - 1
            if i + tail < n and symbols[i + tail] == symbol:
                continue
            low, high = tree.locus(rank[i], tail)
            high += 1
            last = high
            while low < high:
                middle = (low + high) // 2
                place = sa[middle] + tail
                if (symbols[place] if place < n else -1) < symbol:
                    low = middle + 1
                else:
                    high = middle
            if low == last or sa[low] + tail >= n or symbols[sa[low] + tail] != symbol:
                break
            i = sa[low]
    return marked


def runs(symbols: np.ndarray, least: int = 24, times: int = 3) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of at least ``least`` symbols and ``times`` periods, by start, then period.

    ``symbols`` are numbers from 0 without gaps.
    """
    n = len(symbols)
    if n < 2:
        return []
    names = Names(symbols)
    places = np.empty(n, np.int64)
    places[names.rank] = np.arange(n)
    lcp = np.zeros(n, np.int64)
    lcp[1:] = names.forwards(places[:-1], places[1:])
    shared = lcp.tolist()
    squares = covering_squares(names, blocks(places.tolist(), shared))
    marks = vocabulary(symbols.tolist(), names, places, SuffixTree(shared), squares)
    if not marks:
        return []
    first, last, period = np.array(sorted(marks), np.int64).T
    count = last - first + 1
    leaf = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count - first, count)
    where, what = places[leaf], np.repeat(period, count)
    order = np.lexsort((where, what))
    where, what = where[order], what[order]
    new = np.ones(len(where), bool)
    new[1:] = (what[1:] != what[:-1]) | (where[1:] != where[:-1] + 1)
    at = np.flatnonzero(new)
    length = np.diff(np.append(at, len(where))) - 1 + 2 * what[at]
    good = (length >= least) & (length >= times * what[at])
    return sorted(zip(where[at][good].tolist(), length[good].tolist(), what[at][good].tolist(), strict=True), key=lambda r: (r[0], r[2]))
