"""Suffix automata over any symbols, built one symbol at a time."""

from __future__ import annotations

from collections.abc import Hashable


class SuffixAutomaton:
    """Recognises every substring of the strings added; state 0 is the start. Several strings may be added, each from state 0 on."""

    def __init__(self) -> None:
        self.step: list[dict[Hashable, int]] = [{}]
        self.link, self.length = [-1], [0]

    def add(self, last: int, c: Hashable) -> int:
        """The state of the string of state `last`, which ends a string added, with c after it."""
        step, link, length = self.step, self.link, self.length
        there = step[last].get(c)
        if there is not None:  # the substring is known, perhaps in a state to split
            return there if length[there] == length[last] + 1 else self._split(last, c, there)
        new = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p != -1:
            q = step[p][c]
            link[new] = q if length[q] == length[p] + 1 else self._split(p, c, q)
        return new

    def _split(self, p: int, c: Hashable, q: int) -> int:
        """A state for the shorter strings of q, which p and its suffixes lead to by c."""
        step, link, length = self.step, self.link, self.length
        clone = len(step)
        step.append(dict(step[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = clone
        while p != -1 and step[p].get(c) == q:
            step[p][c] = clone
            p = link[p]
        return clone
