"""Anchors: places that equal windows of bytes share.

Each window of ``length`` bytes has the anchor whose CORE bytes hash least among all in it,
the leftmost of equal ones.  Equal windows have their anchors at the same offset, so a
window can only repeat where the bytes at its anchor do.  Windows that follow one another
and share an anchor are a segment.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes at an anchor that are hashed.
CORE = 32
#: Windows that are looked at together: what fits a cache, and what is held of one text.
TILE, SLICE = 1 << 15, 8 << 20
#: Odd numbers that the words of a core are multiplied by.
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)
_HIGH = np.uint64(0xFFFFFFFF00000000)


def _words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each byte on as a number, without a copy."""
    return np.ndarray((max(0, len(data) - 7),), "<u8", data, strides=(1,))


def _mixed(words: list[np.ndarray]) -> np.ndarray:
    h = words[0] * _MIX[0]
    for word, by in zip(words[1:], _MIX[1:]):
        h ^= h >> np.uint64(29)
        h ^= word
        h *= by
    h ^= h >> np.uint64(32)
    h *= _MIX[0]
    return h


def core_hashes(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Hash of the CORE bytes from each of ``at`` on."""
    words = _words(data)
    return _mixed([words[at + i] for i in range(0, CORE, 8)])


def anchors(data: np.ndarray, length: int) -> np.ndarray:
    """The place of the anchor of the window from each byte on."""
    n = len(data) - length + 1
    out = np.empty(max(0, n), np.int32)
    wide = length - CORE + 1  # cores of a window
    for t in range(0, n, TILE):
        here = data[t : min(t + TILE, n) + length - 1]
        words = _words(here)
        cores = len(here) - CORE + 1
        key = _mixed([words[i : i + cores] for i in range(0, CORE, 8)])
        key &= _HIGH
        key |= np.arange(cores, dtype=np.uint64)
        reach = 1
        while 2 * reach <= wide:  # key[i] is the least of ``reach`` cores from i on
            key = np.minimum(key[:-reach], key[reach:])
            reach *= 2
        if reach < wide:
            key = np.minimum(key[: reach - wide], key[wide - reach :])
        out[t : t + len(key)] = key.astype(np.uint32)
        out[t : t + len(key)] += t
    return out


def segments(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """``text, first, last, anchor`` of every segment of the texts ``starts`` to ``ends`` of
    ``data``; ``first`` and ``last`` are where its windows begin.  A text beyond SLICE bytes is
    cut, and so are the segments there."""
    for t in range(0, len(data) - length + 1, SLICE):
        part = data[t : t + SLICE + length - 1]
        found = anchors(part, length)
        new = np.empty(len(found), bool)
        new[0], new[1:] = True, found[1:] != found[:-1]
        sound = np.zeros(len(found), bool)
        low, high = np.maximum(starts - t, 0), np.minimum(ends - length + 1 - t, len(found))
        for a, b in zip(low.tolist(), high.tolist()):
            if a < b:
                new[a] = sound[a:b] = True
        first = np.flatnonzero(new & sound)
        text = np.searchsorted(starts, first + t, side="right") - 1
        last = np.minimum(np.append(first[1:], len(found)) - 1, high[text] - 1)
        yield text, first + t, last + t, found[first].astype(np.int64) + t
