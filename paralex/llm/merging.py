"""Sorted runs of byte strings, front-coded, and their merge by a tree of losers.

An entry of a run has how many bytes it shares with the one before, the rest of its bytes,
and bytes that go with it.  In the merge every entry knows how many bytes it shares with the
string that left the tree last.  Of two entries the one that shares more is the smaller;
only if they share as many are bytes compared, from there on, so that no known prefix is
compared again.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator

_HEAD = struct.Struct("<HHI")


def common(x: bytes, y: bytes, known: int = 0) -> int:
    """How many leading bytes are equal, of which ``known`` are sure."""
    n = min(len(x), len(y))
    while known < n:
        a, b = x[known : known + 32], y[known : known + 32]
        if a != b:
            apart = int.from_bytes(a, "little") ^ int.from_bytes(b, "little")
            return min(n, known + ((apart & -apart).bit_length() - 1) // 8) if apart else n
        known += 32
    return n


def write_run(entries: Iterable[tuple[bytes, bytes]]) -> bytes:
    """A run of ``(string, more)`` in ascending order of the strings."""
    out, last = bytearray(), b""
    for text, more in entries:
        shared = common(last, text)
        out += _HEAD.pack(shared, len(text) - shared, len(more))
        out += text[shared:]
        out += more
        last = text
    return bytes(out)


def read_run(run: bytes) -> Iterator[tuple[int, bytes, bytes]]:
    """``shared, string, more`` of each entry."""
    at, last, size = 0, b"", _HEAD.size
    while at < len(run):
        shared, rest, more = _HEAD.unpack_from(run, at)
        at += size
        last = last[:shared] + run[at : at + rest]
        at += rest
        yield shared, last, run[at : at + more]
        at += more


def merge(runs: list[bytes]) -> Iterator[tuple[int, bytes, bytes]]:
    """The entries of all runs in order; ``shared`` is with the entry before."""
    feeds = [read_run(r) for r in runs]
    n = len(feeds)
    shared, text, more = [0] * n, [None] * n, [b""] * n
    for i, feed in enumerate(feeds):
        shared[i], text[i], more[i] = next(feed, (0, None, b""))

    def loses(a: int, b: int) -> bool:
        """Whether entry ``a`` leaves after ``b``; what the loser shares with the winner is noted."""
        x, y = text[a], text[b]
        if x is None or y is None:
            return x is None
        if shared[a] != shared[b]:
            return shared[a] < shared[b]
        m = common(x, y, shared[a])
        later = m < len(x) and (m == len(y) or x[m] > y[m])
        shared[a if later else b] = m
        return later

    losers = [-1] * n
    best = -1
    for i in range(n):  # entries come in one by one; the first at a node waits for the other
        node, best = (i + n) // 2, i
        while node and losers[node] >= 0:
            if loses(best, losers[node]):
                best, losers[node] = losers[node], best
            node //= 2
        if node:
            losers[node] = best
    while n and text[best] is not None:
        yield shared[best], text[best], more[best]
        shared[best], text[best], more[best] = next(feeds[best], (0, None, b""))
        node = (best + n) // 2
        while node:
            if loses(best, losers[node]):
                best, losers[node] = losers[node], best
            node //= 2
