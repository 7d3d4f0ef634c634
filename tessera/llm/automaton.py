"""A generalised suffix automaton over sequences of integers, with weighted occurrence counts."""

from __future__ import annotations


class SuffixAutomaton:
    """States are classes of substrings with the same end places.

    ``add`` takes one sequence with the number of its occurrences; ``settle`` sums occurrences up the
    suffix links and finds each state's nearest suffix that occurs twice or more.
    """

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        self.count = [0]
        self.twice: list[int] = []

    def _state(self, length: int, link: int, to: dict[int, int]) -> int:
        self.next.append(to)
        self.link.append(link)
        self.length.append(length)
        self.count.append(0)
        return len(self.link) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        """A state of its own for the strings of ``q`` that p's longest string and c make."""
        nxt, link = self.next, self.link
        clone = self._state(self.length[p] + 1, link[q], dict(nxt[q]))
        link[q] = clone
        while p >= 0 and nxt[p].get(c) == q:
            nxt[p][c] = clone
            p = link[p]
        return clone

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        q = nxt[last].get(c)
        if q is not None:
            return q if length[q] == length[last] + 1 else self._split(last, c, q)
        new = self._state(length[last] + 1, 0, {})
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = new
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            link[new] = q if length[q] == length[p] + 1 else self._split(p, c, q)
        return new

    def add(self, sequence: list[int], times: int = 1) -> list[int]:
        """The states of the sequence's prefixes."""
        last, states = 0, []
        for c in sequence:
            last = self._extend(last, c)
            self.count[last] += times
            states.append(last)
        return states

    def settle(self) -> None:
        order = sorted(range(1, len(self.link)), key=self.length.__getitem__)
        for v in reversed(order):
            self.count[self.link[v]] += self.count[v]
        self.twice = [0] * len(self.link)
        for v in order:
            self.twice[v] = v if self.count[v] >= 2 else self.twice[self.link[v]]

    def repeated(self, states: list[int]) -> list[int]:
        """For each prefix of an added sequence the length of its longest suffix that occurs twice or more."""
        length, twice = self.length, self.twice
        return [length[twice[v]] for v in states]

    def matches(self, sequence: list[int]) -> list[int]:
        """Matching statistics: for each place the length of the longest match that ends there."""
        nxt, link, length = self.next, self.link, self.length
        v, found, out = 0, 0, []
        for c in sequence:
            while v and c not in nxt[v]:
                v = link[v]
                found = length[v]
            if c in nxt[v]:
                v = nxt[v][c]
                found += 1
            out.append(found)
        return out
