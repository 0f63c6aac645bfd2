"""Generalised suffix automaton over word sequences, and the streams that are matched against it.

The automaton holds every factor of every sequence (licence templates, test items). Reading a text word by word gives
its matching statistics: at each word the length of the longest factor that ends there, and the state that stands for
it. It is built on the driver from a stated, size-checked set of sequences and sent to the tasks by broadcast; the texts
stream through it where they are.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np


class SuffixAutomaton:
    """States are integers, 0 is the empty factor. ``link`` is the longest proper suffix in another state."""

    def __init__(self) -> None:
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link: list[int] = [-1]
        self.length: list[int] = [0]
        self.sequences: list[list[int]] = []

    def add(self, sequence: Iterable[bytes]) -> int:
        """Insert all factors of a sequence; returns its number."""
        ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in sequence]
        last = 0
        for c in ids:
            last = self._extend(last, c)
        self.sequences.append(ids)
        return len(self.sequences) - 1

    def _state(self, length: int, link: int, follow: dict[int, int]) -> int:
        self.next.append(follow)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, p: int, c: int) -> int:
        """The state for the longest factor of ``p`` followed by ``c``, split off its state where that is longer."""
        q = self.next[p][c]
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            return self._split(last, c)
        new, p = self._state(self.length[last] + 1, 0, {}), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        self.link[new] = self._split(p, c) if p >= 0 else 0
        return new

    def walk(self, sequence: list[int]) -> Iterator[int]:
        """The states of a sequence's prefixes, for one that was added."""
        state = 0
        for c in sequence:
            state = self.next[state][c]
            yield state

    def up(self, state: int, length: int) -> int:
        """The state of the suffix with this length of what ``state`` stands for."""
        while self.length[self.link[state]] >= length:
            state = self.link[state]
        return state

    def top_down(self) -> list[int]:
        """States by length, so that a state comes after its link."""
        return sorted(range(1, len(self.next)), key=self.length.__getitem__)

    def encode(self, text: list[bytes]) -> np.ndarray:
        """Word numbers, -1 for words that no sequence has."""
        get = self.vocabulary.get
        return np.fromiter((get(w, -1) for w in text), dtype=np.int64, count=len(text))

    def matches(self, ids: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
        """(position, state, length) wherever the longest factor that ends there has ``least`` words or more.

        A factor can't hold an unknown word, so only runs of known words with at least that length are read.
        """
        known = np.concatenate(([0], (ids >= 0).view(np.int8), [0]))
        edge = np.diff(known)
        begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        long = end - begin >= least
        follow, link, lengths = self.next, self.link, self.length
        for a, b in zip(begin[long].tolist(), end[long].tolist(), strict=True):
            state = length = 0
            for i, c in enumerate(ids[a:b].tolist(), a):
                to = follow[state].get(c)
                while to is None:  # every word here is known, so state 0 has a step
                    state = link[state]
                    length = lengths[state]
                    to = follow[state].get(c)
                state = to
                length += 1
                if length >= least:
                    yield i, state, length
