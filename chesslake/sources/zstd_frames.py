"""Frames of Zstandard files, told from their headers without decompressing anything."""

from __future__ import annotations

from collections.abc import Callable, Iterator

MAGIC = 0xFD2FB528
SKIPPABLE = range(0x184D2A50, 0x184D2A60)


def frames(read_at: Callable[[int, int], bytes], size: int) -> Iterator[tuple[int, int]]:
    """Start and end of each frame of content; skippable frames (such as seek tables) are left out.

    `read_at` gives so many bytes from a place, fewer at the end. Only the headers of frames and blocks are read. From a place on where no whole
    frame begins, the rest is told as one, so that whoever decompresses it meets the fault.
    """
    at = 0
    while at < size:
        end = _frame_end(read_at, at, size)
        if end is None:
            yield at, size
            return
        if int.from_bytes(read_at(at, 4), "little") not in SKIPPABLE:
            yield at, end
        at = end


def _frame_end(read_at: Callable[[int, int], bytes], at: int, size: int) -> int | None:
    head = read_at(at, 9)
    magic = int.from_bytes(head[:4], "little")
    if magic in SKIPPABLE and len(head) >= 8:
        end = at + 8 + int.from_bytes(head[4:8], "little")
        return end if end <= size else None
    if magic != MAGIC or len(head) < 5:
        return None
    flags = head[4]
    single = flags >> 5 & 1
    at += 5 + (1 - single) + (0, 1, 2, 4)[flags & 3] + (single, 2, 4, 8)[flags >> 6]
    last = False
    while not last:
        block = int.from_bytes(read_at(at, 3), "little")
        if at + 3 > size:
            return None
        last = bool(block & 1)
        at += 3 + (1 if block >> 1 & 3 == 1 else block >> 3)  # a block of one byte repeated holds that byte
    at += 4 * (flags >> 2 & 1)
    return at if at <= size else None


def windowed(read: Callable[[int, int], bytes], window: int = 1 << 16) -> Callable[[int, int], bytes]:
    """`read_at` that asks a file for windows, so that headers near each other are one request."""
    held, start = b"", 0

    def read_at(at: int, n: int) -> bytes:
        nonlocal held, start
        if not start <= at <= at + n <= start + len(held):
            held, start = read(at, max(n, window)), at
        return held[at - start : at - start + n]

    return read_at
