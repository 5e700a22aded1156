"""A generalised suffix automaton over sequences of word ids.

States are kept in plain lists; every state knows its longest length, its suffix
link and the sequences in which its strings occur. `Matcher` walks a stream of words
through it and gives the matching statistics: for each position the length of the
longest string that ends there and occurs in some sequence.
"""

from __future__ import annotations

import numpy as np


class SuffixAutomaton:
    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        owners: list[set[int]] = [set()]
        for owner, sequence in enumerate(sequences):
            state = 0
            for symbol in sequence:
                state = self._extend(state, symbol)
                while len(owners) < len(self.next):
                    owners.append(set())
                owners[state].add(owner)
        # what occurs in a sequence with a state occurs there with its suffixes too
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            if self.link[state] > 0:
                owners[self.link[state]] |= owners[state]
        self.owners = [tuple(sorted(x)) for x in owners]

    def _new(self, length: int, edges: dict[int, int], link: int) -> int:
        self.next.append(edges)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _split(self, parent: int, symbol: int, target: int) -> int:
        """A copy of `target` for the strings that go through `parent`."""
        copy = self._new(self.length[parent] + 1, dict(self.next[target]), self.link[target])
        self.link[target] = copy
        while parent >= 0 and self.next[parent].get(symbol) == target:
            self.next[parent][symbol] = copy
            parent = self.link[parent]
        return copy

    def _extend(self, last: int, symbol: int) -> int:
        target = self.next[last].get(symbol)
        if target is not None:  # an earlier sequence has this prefix
            return target if self.length[target] == self.length[last] + 1 else self._split(last, symbol, target)
        state = self._new(self.length[last] + 1, {}, 0)
        at = last
        while at >= 0 and symbol not in self.next[at]:
            self.next[at][symbol] = state
            at = self.link[at]
        if at >= 0:
            target = self.next[at][symbol]
            fits = self.length[target] == self.length[at] + 1
            self.link[state] = target if fits else self._split(at, symbol, target)
        return state

    def suffix_state(self, state: int, length: int) -> int:
        """The state that holds the suffix of this length of a match that ended in `state`."""
        while self.length[self.link[state]] >= length:
            state = self.link[state]
        return state


class Matcher:
    """Streams documents through an automaton.

    Words outside the automaton's vocabulary, and pairs of neighbours that no sequence
    has, end every match. So stretches of known pairs are found with numpy first, and
    only those long enough for a match of `least` words walk the automaton; the
    statistics below `least` are not needed and not computed.
    """

    def __init__(self, sequences: list[list[bytes]], least: int):
        self.least = max(1, least)
        self.vocabulary: dict[bytes, int] = {}
        ids = [[self.vocabulary.setdefault(w, len(self.vocabulary)) for w in s] for s in sequences]
        self.automaton = SuffixAutomaton(ids)
        width = len(self.vocabulary) + 1
        pairs = {a * width + b for s in ids for a, b in zip(s, s[1:])}
        self.width, self.pairs = width, np.array(sorted(pairs) or [-1], dtype=np.int64)

    def ids(self, words: list[bytes]) -> np.ndarray:
        get = self.vocabulary.get
        return np.fromiter((get(w, -1) for w in words), dtype=np.int64, count=len(words))

    def stretches(self, ids: np.ndarray) -> list[tuple[int, int]]:
        """Word ranges in which a match of at least `least` words can lie."""
        if len(ids) < self.least:
            return []
        if self.least == 1:
            good = ids >= 0
            extra = 0
        else:
            first, second = ids[:-1], ids[1:]
            both = np.flatnonzero((first >= 0) & (second >= 0))
            packed = first[both] * self.width + second[both]
            found = np.searchsorted(self.pairs, packed)
            found[found == len(self.pairs)] = 0
            good = np.zeros(len(ids) - 1, dtype=bool)
            good[both[self.pairs[found] == packed]] = True
            extra = 1
        edge = np.flatnonzero(np.diff(np.concatenate(([0], good.view(np.int8), [0]))))
        starts, ends = edge[::2], edge[1::2] + extra
        long = ends - starts >= self.least
        return list(zip(starts[long].tolist(), ends[long].tolist()))

    def statistics(self, ids: np.ndarray) -> list[tuple[int, int, int]]:
        """(position, matching length, state) wherever the length is `least` or more."""
        out = []
        sam = self.automaton
        edges, link, length = sam.next, sam.link, sam.length
        for start, end in self.stretches(ids):
            state = matched = 0
            for at, symbol in enumerate(ids[start:end].tolist(), start):
                while state and symbol not in edges[state]:
                    state = link[state]
                    matched = length[state]
                step = edges[state].get(symbol)
                if step is None:
                    continue
                state = step
                matched += 1
                if matched >= self.least:
                    out.append((at, matched, state))
        return out
