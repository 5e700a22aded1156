"""Where games end in a part of a PGN text, for every state that the text may be in where the part begins.

A part of a text can't know whether it begins inside a comment, a tag pair or a variation. `Scanner` therefore keeps a summary for each
lexical state at its start, and for every depth of variations in one: with r the depth told from 0 and m its least value so far, a start at depth d
has depth r + max(d, -m), so an outcome ends a game exactly where r = m <= -d. Ends are kept by that level m. Summaries of parts that follow
each other combine (`Fold`), so parts are scanned independently of each other.

Bytes are looked at as classes in numpy: the lexical automaton's transitions generate a finite monoid of functions, and prefix products of its
elements over the structural bytes gives the state at each of them for all starts at once. Rules are those of `pgn.frame_stream`.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np

TEXT, BRACE, TAG, STRING, LINE, ESCAPE = range(6)
#: States that a part may begin in, if it begins after a line end.
STARTS = (TEXT, BRACE, TAG, STRING)
_NONE, _OPEN_BRACE, _CLOSE_BRACE, _SEMICOLON, _NEWLINE, _OPEN, _CLOSE, _OPEN_TAG, _CLOSE_TAG, _QUOTE, _BACKSLASH, _PERCENT, _OTHER = range(13)
_CLASS = np.zeros(256, dtype=np.uint8)
for _i, _c in enumerate((b"{", b"}", b";", b"\r\n", b"(", b")", b"[", b"]", b'"', b"\\", b"%"), 1):
    _CLASS[list(_c)] = _i
_CLASS[list(b"-*")] = _OTHER  # outcomes are looked for at these
_DELIMITER = np.zeros(256, dtype=bool)
_DELIMITER[list(b"\t\n\x0c\r {};()$!?[]")] = True
_WIDTH = 128


def _transition(cls: int, state: int) -> int:
    """The state after a structural byte; the byte after a backslash in a string is always one."""
    if state == ESCAPE:
        return STRING
    moves = {
        TEXT: {_OPEN_BRACE: BRACE, _SEMICOLON: LINE, _PERCENT: LINE, _OPEN_TAG: TAG},
        BRACE: {_CLOSE_BRACE: TEXT}, TAG: {_QUOTE: STRING, _CLOSE_TAG: TEXT}, STRING: {_BACKSLASH: ESCAPE, _QUOTE: TAG}, LINE: {_NEWLINE: TEXT},
    }
    return moves[state].get(cls, state)


def _monoid() -> tuple[np.ndarray, np.ndarray]:
    """All functions of states that sequences of classes give (some 6,000; the first is the identity), and by class which one follows."""
    generators = [tuple(range(6))] + [tuple(_transition(c, s) for s in range(6)) for c in range(1, 13)]
    known, order = {generators[0]: 0}, [generators[0]]
    for f in order:  # grows while it is read
        for g in generators:
            h = tuple(g[s] for s in f)
            if h not in known:
                known[h] = len(order)
                order.append(h)
    step = [[known[tuple(g[s] for s in f)] for g in generators] for f in order]
    return np.array(order, dtype=np.uint8), np.array(step, dtype=np.intp).ravel() * 13


_MAPS, _STEP = _monoid()  # functions are told by 13 times their number, so that adding a class gives the place of what follows
AFTER = 7  # bytes that an outcome at the last byte reaches over


@dataclass
class Run:
    """What a start in one state has come to: state, depth and least depth from 0, ends by level: ends, first, lines before it, last, widest gap."""

    state: int
    r: int = 0
    m: int = 0
    levels: dict[int, list[int]] = field(default_factory=dict)

    def add(self, depth: np.ndarray, outcome: np.ndarray, ends: np.ndarray, lines: Callable[[int], int]) -> None:
        """Variations' signs and outcomes in text, in order: what they add to the depth, which are outcomes, where those end."""
        if not len(depth):
            return
        r = self.r + np.cumsum(depth)
        m = np.minimum(self.m, np.minimum.accumulate(r))
        hit = outcome & (r == m)
        at, level = ends[hit], m[hit]
        self.r, self.m = int(r[-1]), int(m[-1])
        cuts = np.flatnonzero(np.diff(level)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(at)]):
            if a == b:
                continue
            own, n = at[a:b], int(level[a])
            gap = int(np.diff(own).max()) if b - a > 1 else 0
            if n in self.levels:
                held = self.levels[n]
                held[4] = max(held[4], gap, int(own[0]) - held[3])
                held[0], held[3] = held[0] + b - a, int(own[-1])
            else:
                self.levels[n] = [b - a, int(own[0]), lines(int(own[0])), int(own[-1]), gap]


class Scanner:
    """Summaries of a text that comes in blocks and begins at `at`, after a line end, for starts in some states."""

    def __init__(self, states=STARTS, at: int = 0):
        self.runs = {s: Run(s) for s in states}
        self.at, self.lines = at, 0
        self.before, self.held = b"\n", b""

    def feed(self, data: bytes, last: bool = False) -> None:
        """The next bytes; with `last` the end of the text, where the part ends after a line end or with the whole text."""
        data = self.held + data
        self.held = b"" if last else data[-AFTER:]
        body, after = (data, b"\n" * AFTER) if last else (data[:-AFTER], self.held)
        if body:
            self._scan(np.frombuffer(self.before + body + after, dtype=np.uint8), len(body))
            self.before = body[-1:]

    def _scan(self, view: np.ndarray, n: int) -> None:
        body = view[1 : n + 1]
        cls = np.frombuffer(body.tobytes().translate(_CLASS.tobytes()), dtype=np.uint8)
        mark = cls != _NONE
        mark[0] = True
        pos = np.flatnonzero(mark)
        found = body[pos]
        breaks = pos[found == 10]
        starts, sizes = _outcomes(view, n, np.concatenate((pos[found == 45], n + np.flatnonzero(view[n + 1 : n + 4] == 45))), pos[found == 42])
        slashes = pos[found == 92] + 1
        more = np.concatenate((starts, slashes[slashes < n]))
        if len(more):
            mark[more] = True
            pos = np.flatnonzero(mark)
        kinds = cls[pos]
        kinds[kinds == _NONE] = _OTHER
        odd = np.flatnonzero(kinds == _PERCENT)
        previous = view[pos[odd]]  # the byte before it
        kinds[odd[(previous != 10) & (previous != 13)]] = _OTHER
        outcome = np.zeros(len(pos), dtype=bool)
        which = np.searchsorted(pos, starts)
        outcome[which] = True
        ends = np.zeros(len(pos), dtype=np.int64)
        ends[which] = starts + sizes + self.at
        weighty = np.flatnonzero((kinds == _OPEN) | (kinds == _CLOSE) | outcome)
        depth = (kinds[weighty] == _OPEN).astype(np.int64) - (kinds[weighty] == _CLOSE)
        prefix, rows = _prefixes(kinds)
        row, column = np.divmod(weighty, _WIDTH)
        seen = prefix[column, row] // 13
        lines = lambda place: self.lines + int(np.searchsorted(breaks, place - self.at))
        told: dict[int, tuple] = {}  # starts that have met are followed once
        for run in self.runs.values():
            if run.state not in told:
                begun = [run.state]
                for f in rows:
                    begun.append(f[begun[-1]])
                text = _MAPS[seen, np.array(begun)[row]] == TEXT
                own = weighty[text]
                told[run.state] = depth[text], outcome[own], ends[own], begun[-1]
            *own, after = told[run.state]
            run.add(*own, lines)
            run.state = after
        self.at += n
        self.lines += len(breaks)


def _outcomes(view: np.ndarray, n: int, dash: np.ndarray, star: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where outcomes between delimiters begin, whatever they stand in, and their sizes, from the places of hyphens and stars.

    The view has a byte before the n bytes and seven after.
    """
    dash = dash + 1
    near = dash[(dash >= 2) & (dash < n + 2)]
    left, right = view[near - 1], view[near + 1]
    near = near[((left == 49) & (right == 48)) | ((left == 48) & (right == 49))] - 2
    far = dash[(dash >= 4) & (dash < n + 4)]
    for k, c in zip((-3, -2, -1, 1, 2, 3), b"1/21/2"):
        far = far[view[far + k] == c]
    starts = np.concatenate((near, far - 4, star))
    sizes = np.repeat((3, 7, 1), (len(near), len(far), len(star)))
    good = _DELIMITER[view[starts]] & _DELIMITER[view[starts + sizes + 1]]
    order = np.argsort(starts[good])
    return starts[good][order], sizes[good][order]


def _prefixes(kinds: np.ndarray) -> tuple[np.ndarray, list[list[int]]]:
    """The function of the classes before each one in its row of `_WIDTH` (by place and row), and that of each row, as states by state."""
    rows = -(-len(kinds) // _WIDTH)
    padded = np.zeros(rows * _WIDTH, dtype=np.uint8)
    padded[: len(kinds)] = kinds
    columns = np.ascontiguousarray(padded.reshape(rows, _WIDTH).T)
    prefix, place = np.zeros((_WIDTH + 1, rows), dtype=np.intp), np.empty(rows, dtype=np.intp)
    for j in range(_WIDTH):
        np.add(prefix[j], columns[j], out=place)
        np.take(_STEP, place, out=prefix[j + 1], mode="clip")
    return prefix, _MAPS[prefix[_WIDTH] // 13].tolist()


def summarise(own: Callable[[int], bytes], tail: Callable[[int], bytes] | None, first: bool, block: int = 1 << 20) -> dict:
    """The summary of a part of a source: `own` reads its bytes, `tail` (None for the last part) what follows them.

    A part's text begins after the first line end of its bytes (the first part's at once) and goes on to the first line end after them, so that no
    token is cut. Gives size (of its bytes), lines (of its text) and runs: by state at the start [state, r, m, [[level, ends, first, lines, last, gap], ...]],
    places counted from the part's first byte.
    """
    size, scanner = 0, Scanner((TEXT,), 0) if first else None
    while data := own(block):
        if scanner is None:
            at = data.find(b"\n")
            size += len(data)
            if at >= 0:
                scanner = Scanner(STARTS, size - len(data) + at + 1)
                scanner.feed(data[at + 1 :])
        else:
            size += len(data)
            scanner.feed(data)
    if scanner is None:
        return {"size": size, "lines": 0, "runs": {s: [s, 0, 0, []] for s in range(6)}}
    while tail and (data := tail(1 << 16)):
        at = data.find(b"\n")
        scanner.feed(data[: at + 1] if at >= 0 else data)
        if at >= 0:
            break
    scanner.feed(b"", last=True)
    return {"size": size, "lines": scanner.lines, "runs": {s: [r.state, r.r, r.m, [[n, *v] for n, v in sorted(r.levels.items(), reverse=True)]] for s, r in scanner.runs.items()}}


class Fold:
    """Where the parts of a source begin that hold whole games, from their summaries in order.

    A part begins after the first game that ends in it. After a game of more than `most` bytes no part begins, as it is not read past.
    """

    def __init__(self, most: int):
        self.most, self.state, self.depth = most, TEXT, 0
        self.base = self.lines = self.games = self.end = 0
        self.closed = self.begun = False

    def add(self, summary: dict) -> tuple[int, int, int, int] | None:
        """start, games before it, lines before it and bytes of the source before the part's own; None where no part begins."""
        runs = {int(k): v for k, v in summary["runs"].items()}
        state, r, m, levels = runs[self.state]
        found = [x for x in levels if x[0] <= -self.depth]
        start = None
        if not self.begun:
            start, self.begun = (0, 0, 0, 0), True
        elif found and not self.closed and self.base + found[0][2] - self.end <= self.most:
            start = (self.base + found[0][2], self.games + 1, self.lines + found[0][3], self.base)
        for _, n, first, _, last, gap in found:
            self.closed |= max(self.base + first - self.end, gap) > self.most
            self.games, self.end = self.games + n, self.base + last
        self.depth, self.state = r + max(self.depth, -m), state
        self.base, self.lines = self.base + summary["size"], self.lines + summary["lines"]
        return start
