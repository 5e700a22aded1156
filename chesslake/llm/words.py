"""Vectorised word and shingle hashes of a batch of texts.

Words are those of `common.plain_words`. The bytes of all texts of a batch lie in one
array; a word's hash is the difference of two prefix sums of a polynomial modulo 2**64,
so neither words nor shingles become Python objects.
"""

from __future__ import annotations

import numpy as np

from .common import _PLAIN_WORDS

#: An odd base and its inverse modulo 2**64.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_CHUNK = 1 << 16


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    """base**0, base**1, ... modulo 2**64, by doubling."""
    out = np.ones(n, dtype=np.uint64)
    have = 1
    while have < n:
        step = np.uint64(pow(base, have, 1 << 64))
        more = min(have, n - have)
        out[have : have + more] = out[:more] * step
        have += more
    return out


def word_hashes(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word of the batch, and how many words each text has."""
    joined = b" ".join(t or b"" for t in texts).translate(_PLAIN_WORDS)
    data = np.frombuffer(joined, dtype=np.uint8)
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    inside = np.concatenate(([False], data != 32, [False]))
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edge[::2], edge[1::2]
    prefix = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, len(data)), out=prefix[1:])
    hashes = mix((prefix[ends] - prefix[starts]) * _powers(_INVERSE, len(data))[starts])
    sizes = np.array([len(t or b"") + 1 for t in texts], dtype=np.int64)
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    counts = np.diff(np.searchsorted(starts, bounds))
    return hashes, counts


def shingle_hashes(words: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every run of `width` words, and the number of its text.

    A text of fewer words, but not none, has one shingle of all its words.
    """
    owner = np.repeat(np.arange(len(counts)), counts)
    first = np.concatenate(([0], np.cumsum(counts)[:-1]))
    runs = np.maximum(counts - width + 1, np.minimum(counts, 1))
    texts = np.repeat(np.arange(len(counts)), runs)
    at = first[texts] + np.arange(len(texts)) - np.concatenate(([0], np.cumsum(runs)[:-1]))[texts]
    out = np.zeros(len(at), dtype=np.uint64)
    padded = np.concatenate((words, np.zeros(width, np.uint64)))
    owners = np.concatenate((owner, np.full(width, -1)))
    for k in range(width):
        same = owners[at + k] == texts
        out = np.where(same, out * np.uint64(0xD6E8FEB86659FD93) + padded[at + k] + np.uint64(1), out)
    return mix(out), texts


def sequence_hashes(words: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Two 64-bit hashes of each text's whole sequence of words."""
    ends = np.cumsum(counts)
    out = []
    for base in (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9):
        prefix = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(words ^ np.uint64(base)) * _powers(base, len(words)))))
        span = (prefix[ends] - prefix[ends - counts]) * _powers(pow(base, -1, 1 << 64), len(words) + 1)[ends - counts]
        out.append(mix(span + counts.astype(np.uint64)).view(np.int64))
    return np.stack(out, axis=1)
