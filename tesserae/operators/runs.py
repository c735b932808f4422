"""Longest common runs of two texts by a suffix automaton, in time and memory that grow with their length."""

from __future__ import annotations

from array import array

#: Characters of a text that are one automaton (of some 50 MB); longer texts are read in blocks that overlap by half.
BLOCK = 1 << 17


class SuffixAutomaton:
    """All runs of a text: a state for each set of runs that end in the same places, at most two a character."""

    def __init__(self, text: str):
        self.length, self.link, self.first, self.step = array("q", [0]), array("q", [-1]), array("q", [0]), {}
        step, length, link = self.step, self.length, self.link
        out: list[list[int]] = [[]]  # the characters that lead on from each state
        last = 0
        for c in map(ord, text):
            new = len(length)
            length.append(length[last] + 1)
            self.first.append(length[new])
            link.append(0)
            out.append([])
            at = last
            while at >= 0 and (at << 21 | c) not in step:
                step[at << 21 | c] = new
                out[at].append(c)
                at = link[at]
            if at >= 0:
                next_ = step[at << 21 | c]
                if length[next_] != length[at] + 1:  # some of its runs now end in one more place: they become a state
                    split = len(length)
                    length.append(length[at] + 1)
                    self.first.append(self.first[next_])
                    link.append(link[next_])
                    out.append(list(out[next_]))
                    for x in out[next_]:
                        step[split << 21 | x] = step[next_ << 21 | x]
                    link[next_] = split
                    while at >= 0 and step.get(at << 21 | c) == next_:
                        step[at << 21 | c] = split
                        at = link[at]
                    next_ = split
                link[new] = next_
            last = new

    def longest(self, text: str) -> tuple[int, int, int]:
        """The longest run that ``text`` shares: its length, where it first ends there, and where one first ends here."""
        state = size = best = there = here = 0
        for k, c in enumerate(map(ord, text), 1):
            to = self.step.get(state << 21 | c)
            while to is None and state:
                state = self.link[state]
                size = self.length[state]
                to = self.step.get(state << 21 | c)
            if to is not None:
                state, size = to, size + 1
                if size > best:
                    best, there, here = size, k, self.first[to]
                elif size == best:
                    here = min(here, self.first[to])
        return best, there, here


class Runs:
    """Longest runs that texts share with one text, whose automaton is made once."""

    def __init__(self, canon: str, block: int = BLOCK):
        self.canon, self.block, self.own = canon, block, None

    def longest(self, text: str) -> str:
        """The longest common run; of several, the one that ends first in ``text``; empty where no character is shared.

        The automaton is that of the canon, unless that exceeds a block and ``text`` is shorter. A text of more than a
        block is read in blocks that overlap by half. What is no longer than that half lies whole in one of them;
        where a longer run is found, which may go on beyond its block, blocks of twice the size are read.
        """
        mine = len(self.canon) <= max(self.block, len(text))
        built, read, block = (self.canon, text, self.block) if mine else (text, self.canon, self.block)
        while True:
            size, end = self._best(built, read, block, mine)
            if block >= len(built) or size < block // 2:
                return text[end - size : end]
            block *= 2

    def _best(self, built: str, read: str, block: int, mine: bool) -> tuple[int, int]:
        """Length and first end in the text that is not ``built``, if that is the canon, else in ``built``."""
        if block >= len(built):
            if mine and self.own is None:
                self.own = SuffixAutomaton(built)
            size, there, here = (self.own if mine else SuffixAutomaton(built)).longest(read)
            return size, there if mine else here
        found = []
        for k in range(0, len(built) - block // 2, block // 2):
            size, there, here = SuffixAutomaton(built[k : k + block]).longest(read)
            found.append((size, there if mine else k + here))
        return max(found, key=lambda x: (x[0], -x[1]))
