"""Operator 13: runs of repeated words, found by string synchronising sets.

A run is a stretch of words with smallest period q (words q apart are identical) of length max(MIN_LENGTH, MIN_REPEATS * q) or
more that no neighbouring word extends. For a document's n words, at every dyadic scale t (16, 32, ...) up to 4n/9:

* Synchronising set: position i belongs to it if the least hash of the t-word substrings that begin at i to i + t/4 is that of
  i or of i + t/4, so membership depends on the words i to i + 5t/4 alone. Substrings of a period up to t/4 take no part;
  instead the last position of each such region belongs to the set. Of t/4 positions in a row one belongs, outside such regions.
* Proposals: two members with equal contexts, next to each other among the equal ones, propose their distance as a period.
  Contexts of 5t/4 words serve periods of 3t/4 to 5t/4, contexts of 7t/4 words those of t to 7t/4; both are at least as
  long as the period, so no equal context lies between, and a run of three periods holds such a pair whatever its place.
* Small periods, below 12, have no scale; they, and the highly periodic regions that scale 16 leaves out, are found by comparing the words with themselves
  shifted. From scale 32 on those regions are runs found before.
* Proposals with one period that overlap by it are one region, which is extended both ways by hashes of dyadic lengths. What
  is long enough is compared word by word, so hashes decide nothing by themselves.

The words of a slice of some MiB of documents (one document at least, whole) lie in one array, longest document first, with a
separator of its own between any two; a scale takes those documents that can have such a period. Work is O(n log n) and
memory O(n log n) words for a document, whatever it holds.

Defined cases: a null, empty or blank text has no words, no run and the hash of the empty text; a null doc_id
never plants; repeated rows each give their row; a text of any length is one document; an
empty table gives none; columns other than doc_id and text are not read, so their names can't clash. Among runs of the greatest exponent the one
with the smallest start, then period, is told.
"""

from __future__ import annotations

import hashlib
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import long_field, map_texts, read_table
from .words import mix

MIN_LENGTH = 24
MIN_REPEATS = 3
#: The first scale; periods below three quarters of it are small.
FIRST_SCALE = 16
_SMALL = FIRST_SCALE * 3 // 4
_LAST = np.uint64(0xFFFFFFFFFFFFFFFF)
_LEFT, _RIGHT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The hash of two substrings in a row from theirs."""
    return mix(a * _LEFT + (b ^ _RIGHT))


def _stretches(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of the runs of consecutive numbers in a rising array."""
    if not len(at):
        return at, at
    cut = np.flatnonzero(np.diff(at) != 1)
    return at[np.concatenate(([0], cut + 1))], at[np.concatenate((cut, [len(at) - 1]))]


def _least(period: int) -> int:
    return max(MIN_LENGTH, MIN_REPEATS * period)


class _Hashes:
    """Hashes of the substrings of 1, 2, 4, ... words, level by level, and how far two places agree."""

    def __init__(self, words: np.ndarray):
        self.levels = [mix(words.astype(np.uint64) + _LEFT)]

    def level(self, k: int, upto: int) -> np.ndarray:
        while len(self.levels) <= k:
            last, half = self.levels[-1], 1 << (len(self.levels) - 1)
            last = last[: max(0, upto - half + 1)]
            self.levels.append(_pair(last[:-half], last[half:]) if len(last) > half else last[:0])
        return self.levels[k]

    def agree(self, i: np.ndarray, j: np.ndarray, back: bool) -> np.ndarray:
        """How many words from i and j on (or before them, with `back`) are the same, for i < j."""
        total = np.zeros(len(i), np.int64)
        top = len(self.levels) - 1
        k, open_ = top, np.arange(len(i))
        while k >= 0:
            width, level = 1 << k, self.levels[k]
            a, b = (i[open_] - total[open_] - width, j[open_] - total[open_] - width) if back else (i[open_] + total[open_], j[open_] + total[open_])
            inside = (a >= 0) & (b < len(level))
            same = np.zeros(len(open_), bool)
            same[inside] = level[a[inside]] == level[b[inside]]
            total[open_[same]] += width
            if k == top and same.any():
                open_ = open_[same]  # as often as it goes
                continue
            open_, k = np.arange(len(i)), k - 1
        return total


def _small_runs(words: np.ndarray) -> tuple[list[tuple[int, int, int]], np.ndarray]:
    """(start, end, period) of regions with periods below _SMALL, and where substrings of FIRST_SCALE words have a period up to a quarter of that."""
    found, omitted = [], np.zeros(len(words) + 1, np.int32)
    for p in range(1, min(_SMALL, len(words))):
        first, last = _stretches(np.flatnonzero(words[p:] == words[:-p]))
        size = last - first + 1 + p
        if p <= FIRST_SCALE // 4:
            long = size >= FIRST_SCALE
            np.add.at(omitted, first[long], 1)
            np.add.at(omitted, last[long] + p + 2 - FIRST_SCALE, -1)
        long = size >= _least(p)
        found += [(x, x + n, p) for x, n in zip(first[long].tolist(), size[long].tolist())]
    return found, np.cumsum(omitted[:-1]) > 0


def _proposals(hashes: _Hashes, scale: int, upto: int, omitted: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """(place, period, context length) by synchronising positions of one scale in the first `upto` words."""
    k, reach = scale.bit_length() - 1, scale // 4
    own, quarter = hashes.level(k, upto), hashes.level(k - 2, upto)
    n = upto - scale + 1 - reach
    if n <= 0:
        return []
    key = np.where(omitted[: len(own)], _LAST, own) if omitted.any() else own
    low = key
    for step in (1 << j for j in range(k - 2)):  # the least of 2, 4, ..., scale / 4 in a row
        low = np.minimum(low[:-step], low[step:])
    low = np.minimum(low[:-1], low[1:])[:n]
    chosen = ((key[:n] == low) | (key[reach : reach + n] == low)) & (low != _LAST)
    chosen[:n] |= omitted[:n] & ~omitted[1 : n + 1]
    at = np.flatnonzero(chosen)
    out = []
    for context, low_d, high_d, shift, tail in ((scale + reach, 3 * reach, 5 * reach, scale, quarter), (scale + 3 * reach, scale, 7 * reach, 3 * reach, own)):
        s = at[at + context <= upto]
        name = _pair(own[s], tail[s + shift])
        order = np.argsort(name, kind="stable")
        s, name = s[order], name[order]
        d = s[1:] - s[:-1]
        near = (name[1:] == name[:-1]) & (d >= low_d) & (d <= high_d)
        out.append((s[:-1][near], d[near], context))
    return out


def _extended(hashes: _Hashes, words: np.ndarray, s: np.ndarray, d: np.ndarray, context: int) -> list[tuple[int, int, int]]:
    """The runs (start, end, period) of proposals; those of one period that overlap by it are one."""
    if not len(s):
        return []
    order = np.lexsort((s, d))
    s, d = s[order], d[order]
    new = np.concatenate(([True], (d[1:] != d[:-1]) | (s[1:] - s[:-1] > context)))
    first, last, d = s[new], s[np.concatenate((np.flatnonzero(new)[1:] - 1, [len(s) - 1]))], d[new]
    start = first - hashes.agree(first, first + d, True)
    end = last + d + hashes.agree(last, last + d, False)
    long = end - start >= np.maximum(MIN_LENGTH, MIN_REPEATS * d)
    out = []
    for x, y, p in zip(start[long].tolist(), end[long].tolist(), d[long].tolist()):
        if not np.array_equal(words[x : y - p], words[x + p : y]):  # hashes that agree by chance: look at the words
            a, b = _stretches(np.flatnonzero(words[p:] == words[:-p]))
            out += [(i, j + 1 + p, p) for i, j in zip(a.tolist(), b.tolist()) if j + 1 + p - i >= _least(p)]
        else:
            out.append((x, y, p))
    return out


def runs_of(words: np.ndarray, sizes: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, end, period) of all runs in an array of documents of `sizes` words, largest first, each followed by a separator of its own."""
    found, omitted = _small_runs(words)
    hashes, scale = _Hashes(words), FIRST_SCALE
    ends = np.cumsum(sizes + 1)
    while True:
        able = int((9 * scale <= 4 * sizes).sum())  # three periods of 3/4 of the scale
        if not able:
            break
        upto = int(ends[able - 1])
        if scale > FIRST_SCALE:
            marks = np.zeros(upto + 1, np.int32)
            for x, y, p in found:
                if 4 * p <= scale <= y - x and y <= upto:
                    marks[x] += 1
                    marks[y - scale + 1] -= 1
            omitted = np.cumsum(marks[:-1]) > 0
        for s, d, context in _proposals(hashes, scale, upto, omitted):
            found += _extended(hashes, words, s, d, context)
        scale *= 2
    best: dict[tuple[int, int], int] = {}
    for x, y, p in found:  # a multiple of a period is none of its own
        best[x, y] = min(p, best.get((x, y), p))
    return sorted((x, y, p) for (x, y), p in best.items())


def planted(n: int, doc_id: int | None) -> tuple[int, int] | None:
    """(a, p) of a document that the contract makes periodic from word a on, with period p."""
    if doc_id is None or n == 0:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    return g % n, 1 + (n - g % n) // (3 + g % 8)


def find_runs(texts: list[bytes | None], plant: list[int | None] | None = None) -> tuple[list[list[bytes]], list[list[tuple[int, int, int]]]]:
    """The words of each text, planted by the keys in `plant`, and its runs as (start, length, period)."""
    lists: list[list[bytes]] = []
    for i, text in enumerate(texts):
        words = (text or b"").split()
        at = planted(len(words), plant[i]) if plant is not None else None
        if at is not None:
            a, p = at
            period, rest = words[a : a + p], len(words) - a
            words = words[:a] + (period * (rest // len(period) + 1))[:rest]
        lists.append(words)
    index: dict[bytes, int] = {}
    order = sorted(range(len(lists)), key=lambda i: -len(lists[i]))
    sizes = np.array([len(lists[i]) for i in order], np.int64)
    starts = np.concatenate(([0], np.cumsum(sizes + 1)))
    flat = np.empty(starts[-1], np.int64)
    for k, i in enumerate(order):
        own = [index.setdefault(w, len(index)) for w in lists[i]]
        flat[starts[k] : starts[k] + len(own)] = own
        flat[starts[k + 1] - 1] = -1 - k
    runs: list[list[tuple[int, int, int]]] = [[] for _ in lists]
    for x, y, p in runs_of(flat, sizes):
        k = int(np.searchsorted(starts, x, "right")) - 1
        runs[order[k]].append((x - int(starts[k]), y - x, p))
    return lists, runs


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words joined by spaces, without those that a run contains after its first period."""
    if runs:
        gone = np.zeros(len(words) + 1, np.int64)
        for start, length, period in runs:
            gone[start + period] += 1
            gone[start + length] -= 1
        words = [words[i] for i in np.flatnonzero(np.cumsum(gone[:-1]) == 0)]
    return b" ".join(words)


_LONGS = ("n_runs", "start", "length", "period", "exponent_milli")


def periodic_runs(docs: DataFrame, plant: bool = False) -> DataFrame:
    """doc_id, number of runs, the run of the greatest exponent, and digests of all runs and of the collapsed text, for every row.

    With `plant`, documents chosen by their doc_id are made periodic before, as the contract of the query says.
    """
    schema = T.StructType([docs.schema["doc_id"], *(long_field(c) for c in _LONGS), T.StructField("runs_sha256", T.StringType()), T.StructField("collapsed_sha256", T.StringType())])

    def start():
        def work(texts: list, rows: pa.RecordBatch) -> dict:
            lists, runs = find_runs(texts, rows.column(1).to_pylist() if plant else None)
            best = [min(r, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=None) for r in runs]
            sha = lambda data: hashlib.sha256(data).hexdigest()
            return {
                "n_runs": [len(r) for r in runs],
                **{c: [None if b is None else b[i] for b in best] for i, c in enumerate(("start", "length", "period"))},
                "exponent_milli": [None if b is None else 1000 * b[1] // b[2] for b in best],
                "runs_sha256": [sha("".join(f"{s},{n},{p}\n" for s, n, p in r).encode()) for r in runs],
                "collapsed_sha256": [sha(collapsed(w, r)) for w, r in zip(lists, runs)],
            }

        return work

    return map_texts(docs, start, schema)


def collapse_runs(docs: DataFrame) -> DataFrame:
    """doc_id and the text with each run cut to its first period, words joined by spaces; null texts stay null."""
    schema = T.StructType([docs.schema["doc_id"], T.StructField("text", T.StringType())])

    def start():
        def work(texts: list, rows: pa.RecordBatch) -> dict:
            lists, runs = find_runs(texts)
            return {"text": [None if t is None else collapsed(w, r).decode("utf-8", "replace") for t, w, r in zip(texts, lists, runs)]}

        return work

    return map_texts(docs, start, schema)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs(read_table(spark, sf_dir, "documents"), plant=True)
