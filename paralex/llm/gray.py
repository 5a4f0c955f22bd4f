"""The Gray-order hierarchical index over 64-bit fingerprints."""

from __future__ import annotations

import numpy as np

FAN = 16


def majority(values: np.ndarray) -> int:
    """The fingerprint of hashes: a bit is 1 if it is set in over half of them."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(values), 16_384):
        bits = np.unpackbits(values[at : at + 16_384].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(values), bitorder="little").view("<u8")[0])


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of each code word in the reflected Gray sequence."""
    out = x.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        out ^= out >> np.uint64(shift)
    return out


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of ``n`` nodes over links ``a``-``b``."""
    label = np.arange(n)
    while len(a):
        x, y = label[a], label[b]
        keep = x != y
        if not keep.any():
            break
        a, b, x, y = a[keep], b[keep], x[keep], y[keep]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
    return label


class GrayIndex:
    """Hierarchy over fingerprints in Gray order; level 0 has the leaves.

    ``visited`` counts the nodes and fingerprints that searches were compared with.
    """

    def __init__(self, fps: np.ndarray):
        self.fps = fps
        self.visited = 0
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []  # residual mask, pattern
        every, some = fps, fps
        spans = []
        while len(every) > 1 or not spans:
            cut = np.arange(0, len(every), FAN)
            every, some = np.bitwise_and.reduceat(every, cut), np.bitwise_or.reduceat(some, cut)
            spans.append((~(every ^ some), every))
        for k, (mask, pattern) in enumerate(spans):
            if k + 1 < len(spans):
                above = np.repeat(spans[k + 1][0], FAN)[: len(mask)]
                mask = mask & ~above
            self.levels.append((mask, pattern))

    def uniform(self, label: np.ndarray) -> list[np.ndarray]:
        """Of each level, the label that all of a node's leaves have, else -1."""
        low, high, out = label, label, []
        for mask, _ in self.levels:
            cut = np.arange(0, len(low), FAN)
            low, high = np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut)
            out.append(np.where(low == high, low, -1))
        return out

    def search(
        self, who: np.ndarray, distance: int, label: np.ndarray, same: list[np.ndarray], later: bool = True
    ) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (searcher, other fingerprint) within the distance, of different labels;
        if ``later``, only those that follow the searcher."""
        fps = self.fps
        top = len(self.levels) - 1
        q, node = who, np.zeros(len(who), np.int64)
        gap = np.bitwise_count((fps[q] ^ self.levels[top][1][0]) & self.levels[top][0][0]).astype(np.int16)
        size = FAN ** (top + 1)
        for k in range(top, -1, -1):
            self.visited += len(q)
            keep = (gap <= distance) & (same[k][node] != label[q])
            if later:
                keep &= (node + 1) * size > q + 1
            q, node, gap = q[keep], node[keep], gap[keep]
            below = len(fps) if k == 0 else len(self.levels[k - 1][0])
            child = (node[:, None] * FAN + np.arange(FAN)).ravel()
            q, gap = np.repeat(q, FAN), np.repeat(gap, FAN)
            real = child < below
            q, node, gap = q[real], child[real], gap[real]
            if k:
                mask, pattern = self.levels[k - 1]
                gap = gap + np.bitwise_count((fps[q] ^ pattern[node]) & mask[node])
                size //= FAN
        self.visited += len(q)
        near = ((node > q) if later else label[node] != label[q]) & (np.bitwise_count(fps[q] ^ fps[node]) <= distance)
        return q[near], node[near]
