"""Splitting text into the matches of the public byte-level pattern, in bulk.

The pattern is ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``.
Its matches cover a text without gaps, so they are given by their starts, and
these follow from the class of each character and of its neighbours.  That is
computed with numpy over many texts at once; another pattern falls back to the
``regex`` library.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from itertools import compress, filterfalse
from operator import not_

import numpy as np

#: Fixed value: the pattern that the bulk splitter implements.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

OTHER, LETTER, NUMBER, SPACE, EDGE = range(5)
#: Characters split in one go; a longer text is a group of its own.
GROUP_CHARS = 400_000


@functools.cache
def classes() -> np.ndarray:
    """Class of each code point, as the ``regex`` library sees it."""
    import regex

    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    out = np.zeros(0x110000, np.uint8)
    for kind, what in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(what, every):
            run = np.frombuffer(m[0].encode("utf-32-le"), np.uint32)
            out[run] = kind
    return out


def _starts(points: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Positions where a match begins; ``kind`` starts and ends with EDGE."""
    begin = np.ones(len(points), bool)
    begin[1:] = kind[1:] != kind[:-1]
    blank = points == 32
    # The last character of white space before other text stands apart; a plain
    # space there joins what follows.
    last = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE) & (kind[1:] != EDGE))
    begin[last] = True
    begin[last + 1] = ~blank[last]
    quotes = np.flatnonzero((points == 39) & begin & (kind == OTHER))
    if len(quotes):
        size = len(points) - 1
        one, two = points[np.minimum(quotes + 1, size)], points[np.minimum(quotes + 2, size)]
        inside_one = kind[np.minimum(quotes + 1, size)] == LETTER
        inside_two = inside_one & (kind[np.minimum(quotes + 2, size)] == LETTER)
        short = inside_one & np.isin(one, np.array([ord(c) for c in "stmd"], np.uint32))
        long = np.zeros(len(quotes), bool)
        for a, b in ("re", "ve", "ll"):
            long |= inside_two & (one == ord(a)) & (two == ord(b))
        begin[quotes[short | long] + 1] = False
        begin[quotes[short] + 2] = True
        begin[quotes[long] + 3] = True
    return np.flatnonzero(begin)


def _spans(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """All texts joined, the code points of that, begin and end of each match, and for each
    text the end of its own matches."""
    joined = "\n" + "\n".join(texts) + "\n"
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    kind = classes()[points]
    edges = np.cumsum([0, *(len(t) + 1 for t in texts)])
    kind[edges] = EDGE
    starts = _starts(points, kind)
    ends = np.append(starts[1:], len(points))
    real = kind[starts] != EDGE
    a, b = starts[real], ends[real]
    return joined, points, a, b, np.searchsorted(a, edges[1:]).tolist()


def split_group(texts: list[str]) -> tuple[list[str], list[int]]:
    """Matches of all texts in order, and for each text the end of its own."""
    joined, _, a, b, bounds = _spans(texts)
    return [joined[i:j] for i, j in zip(a.tolist(), b.tolist())], bounds


def groups(texts: list[str]) -> Iterator[list[str]]:
    """The texts in order, in groups of about GROUP_CHARS characters."""
    group: list[str] = []
    held = 0
    for text in texts:
        if group and held + len(text) > GROUP_CHARS:
            yield group
            group, held = [], 0
        group.append(text)
        held += len(text)
    if group:
        yield group


def split_texts(texts: list[str], pattern: str = PATTERN):
    """Yield ``(matches, ends)`` for groups of whole texts, in order."""
    if pattern != PATTERN:
        import regex

        find = regex.compile(pattern).findall
        for text in texts:
            words = find(text)
            yield words, [len(words)]
        return
    yield from map(split_group, groups(texts))


#: Matches that a worker remembers: that many places of 33 bytes in a table, and two
#: generations of an eighth of it in dictionaries, at some 160 bytes each.
CACHE_WORDS = 1 << 20


class PieceCache:
    """Ids (little-endian unsigned 32-bit bytes) of matches, found once each.

    Two generations of about ``limit`` short matches bound its memory; what is
    dropped is computed again when it returns.
    """

    LONGEST = 64

    def __init__(self, encode_many, limit: int = CACHE_WORDS // 8):
        self.encode_many, self.limit = encode_many, limit
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def ids(self, words: list[str]) -> list[bytes]:
        new, old = self.new, self.old
        out = list(map(new.get, words))
        if None not in out:
            return out
        missed = list(compress(range(len(out)), map(not_, out)))  # no ids are empty
        lost = {words[i] for i in missed}
        todo = list(filterfalse(old.__contains__, lost))
        found = {w: old[w] for w in lost.difference(todo)}
        found.update(zip(todo, self.encode_many(todo)))
        for i in missed:
            out[i] = found[words[i]]
        new.update((w, v) for w, v in found.items() if len(w) <= self.LONGEST)
        if len(new) > self.limit:
            self.old, self.new = new, {}
        return out


class PieceTable:
    """Ids of short matches, looked up for many matches at once.

    A match of up to LONGEST bytes is its own key, so a hit is exact: 15 bytes and their
    number are two unsigned longs.  Each key has one place, and a later one takes it; what
    isn't there, or is longer, or has more than MOST ids, is asked of ``cache``.
    """

    LONGEST, MOST = 15, 4
    #: What is kept of the first eight bytes, and of the next seven, of a match by its length.
    FIRST = np.array([(1 << 8 * min(n, 8)) - 1 for n in range(16)], np.uint64)
    NEXT = np.array([(1 << 8 * max(n - 8, 0)) - 1 for n in range(16)], np.uint64)
    #: Odd numbers that mix the bits of a key.
    MIX = tuple(np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))

    def __init__(self, cache: PieceCache, places: int = CACHE_WORDS):
        self.cache = cache
        self.bits = max(4, (places - 1).bit_length())
        # The key and up to four ids are a row of 32 bytes, so a lookup touches one line of memory.
        self.rows = np.zeros((1 << self.bits, 4), np.uint64)
        self.count = np.zeros(1 << self.bits, np.uint8)

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Id bytes of each text of one group."""
        joined, points, a, b, bounds = _spans(texts)
        raw = joined.encode()
        at, end = a, b
        if len(raw) > len(joined):
            place = np.zeros(len(points) + 1, np.int64)
            wide = np.flatnonzero(points > 0x7F)
            more = points[wide]
            place[wide + 1] = 1 + (more > 0x7FF) + (more > 0xFFFF)
            place = np.cumsum(place) + np.arange(len(place))
            at, end = place[a], place[b]
        ids, ends = self._ids(joined, raw, a, b, at, end - at)
        start = 0
        for bound in bounds:
            stop = int(ends[bound - 1]) if bound else 0
            yield ids[start:stop].tobytes()
            start = stop

    def _ids(self, joined: str, raw: bytes, a, b, at, size) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all matches, and the end of each match's own; ``at, size`` are in bytes."""
        eight = np.ndarray((len(raw) + 9,), "<u8", raw + bytes(16), strides=(1,))
        short = size <= self.LONGEST
        known = np.minimum(size, self.LONGEST)
        first = eight[at] & self.FIRST[known]
        rest = eight[at + 8] & self.NEXT[known] | known.astype(np.uint64) << np.uint64(56)
        slot = first * self.MIX[0] ^ rest * self.MIX[1]
        slot = ((slot ^ slot >> np.uint64(32)) * self.MIX[2] >> np.uint64(64 - self.bits)).astype(np.int64)
        rows = self.rows.take(slot, axis=0)
        hit = short & (rows[:, 0] == first) & (rows[:, 1] == rest)
        count = self.count[slot].astype(np.int64)
        missed = np.flatnonzero(~hit)
        values = self.cache.ids([joined[i:j] for i, j in zip(a[missed].tolist(), b[missed].tolist())])
        found = np.fromiter(map(len, values), np.int64, len(values)) // 4
        count[missed] = found
        ends = np.cumsum(count)
        out = np.empty(int(ends[-1]) if len(ends) else 0, "<u4")
        begin = ends - count
        four = rows.view("<u4")
        for k in range(self.MOST):
            here = np.flatnonzero(hit & (count > k))
            out[begin[here] + k] = four[here, 4 + k]
        if len(missed):
            flat = np.frombuffer(b"".join(values), "<u4")
            own = np.cumsum(found) - found  # where each match's ids begin in flat
            out[np.repeat(begin[missed] - own, found) + np.arange(len(flat))] = flat
            self._keep(slot, first, rest, missed[short[missed] & (found <= self.MOST)], out, begin, count)
        return out, ends

    def _keep(self, slot, first, rest, new, out, begin, count) -> None:
        """Put the matches ``new`` in their places, one in each."""
        places, which = np.unique(slot[new], return_index=True)
        new = new[which]
        row = np.zeros((len(new), 4), np.uint64)
        row[:, 0], row[:, 1] = first[new], rest[new]
        four = row.view("<u4")
        for k in range(self.MOST):
            here = np.flatnonzero(count[new] > k)
            four[here, 4 + k] = out[begin[new[here]] + k]
        self.rows[places] = row
        self.count[places] = count[new]


class PieceEncoder:
    """Encodes texts by the ids that ``encode_many`` finds for matches, about ``words`` of which are remembered."""

    def __init__(self, encode_many, words: int = CACHE_WORDS, pattern: str = PATTERN):
        self.pattern = pattern
        self.cache = PieceCache(encode_many, max(1, words // 8))
        self.table = PieceTable(self.cache, words)

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Yield the id bytes of each text."""
        if self.pattern == PATTERN:
            for group in groups(texts):
                yield from self.table.encode(group)
            return
        for words, ends in split_texts(texts, self.pattern):
            values = self.cache.ids(words)
            at = 0
            for end in ends:
                yield b"".join(values[at:end])
                at = end
