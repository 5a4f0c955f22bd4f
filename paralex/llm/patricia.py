"""The Patricia tree of sorted sequences, built as they come.

Only points where sequences part or end become nodes; an edge stands for all between.  What
a node says of its sequences is a sum or a minimum over them, so a tree that is built in
parts, from stretches of the sorted sequences, is put together by adding up equal nodes.
For that every part must have the nodes that others make on the paths of its first and last
sequence (``points_between``).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

#: Bytes of one step of a sequence.
STEP = 16


def shared_steps(a: bytes, b: bytes) -> int:
    """How many leading steps are equal."""
    n = min(len(a), len(b)) // STEP
    if a[: n * STEP] == b[: n * STEP]:
        return n
    x, y = (np.frombuffer(s, np.uint64, 2 * n).reshape(n, 2) for s in (a, b))
    return int((x != y).any(axis=1).argmax())


@dataclass
class Sequence:
    """``key`` of STEP bytes a step within ``group``, the bytes of text of each step, and what
    goes on below its last step: bytes that are shared there and leaves that are added."""

    group: tuple
    key: bytes
    sizes: list[int]
    owner: int
    below_saved: int = 0
    below_leaves: int = 0
    more: tuple = ()


@dataclass
class Point:
    """A node on the path of the newest sequence.  ``old``: earlier parts have sequences of it;
    ``head``: the first sequence of this part is one of them."""

    depth: int
    n: int
    low: int
    saved: int
    leaves: int
    children: int
    old: bool
    head: bool


@dataclass
class Node:
    """A node on the path of ``of``, and the bytes of the steps from its parent on."""

    of: Sequence
    depth: int
    parent_depth: int
    edge: list[int]
    point: Point


class Builder:
    """Takes the sequences of one part in order and gives the nodes that are complete.

    ``before`` is the last sequence of the part before; ``first`` and ``last`` are depths of
    nodes that others have on the paths of the first and the last sequence.
    """

    def __init__(self, before: tuple[tuple, bytes] | None = None, first: frozenset[int] = frozenset(), last: frozenset[int] = frozenset()):
        self.before, self.first, self.last = before, first, last
        self.open: list[Point] = []
        self.now: Sequence | None = None
        self.total: list[int] = [0]
        self.started = False
        #: Steps that the newest sequence shares with the one before (-1: another group), and
        #: whether it adds a leaf to the tree of all before it.
        self.shared, self.parts = -1, False

    def _close(self, depth: int) -> Iterator[Node]:
        """Complete the nodes below ``depth``; there is one at ``depth`` afterwards."""
        while self.open and self.open[-1].depth > depth:
            point = self.open.pop()
            above = max(depth, self.open[-1].depth if self.open else -1)
            if above >= 0 and not (self.open and self.open[-1].depth == above):
                between = self.total[point.depth - 1] - self.total[max(0, above - 1)]
                times = point.n if point.old else point.n - 1
                saved = point.saved + times * between
                self.open.append(Point(above, point.n, point.low, saved, point.leaves, 0 if point.old else 1, point.old, point.head))
            low = max(0, above)
            yield Node(self.now, point.depth, above, self.now.sizes[low : point.depth], point)

    def add(self, s: Sequence) -> Iterator[Node]:
        steps = len(s.key) // STEP
        last = (self.now.group, self.now.key) if self.now else self.before
        shared = shared_steps(last[1], s.key) if last and last[0] == s.group else -1
        parts = shared >= 0 and shared < min(len(last[1]) // STEP, steps)
        self.shared, self.parts = shared, parts
        total = [0, *np.cumsum(s.sizes, dtype=np.int64).tolist()]
        head = not self.started
        if self.started:
            yield from self._close(shared)
        self.now, self.total = s, total
        if head and shared >= 0:
            self.open = [Point(d, 0, s.owner, 0, 0, 0, True, True) for d in sorted({0, *self.first})]
        self.started = True
        for point in self.open:
            point.n += 1
            point.low = min(point.low, s.owner)
            point.saved += s.below_saved + total[shared] - total[max(0, point.depth - 1)]
            point.leaves += s.below_leaves + parts
            point.children += point.depth == shared < steps
        for depth in sorted({0, steps} if shared < 0 else {steps} - {shared}):
            self.open.append(Point(depth, 1, s.owner, s.below_saved, 1 + s.below_leaves, int(depth < steps), False, head))

    def end(self) -> Iterator[Node]:
        if self.started:
            for depth in sorted(self.last, reverse=True):
                yield from self._close(depth)
            yield from self._close(-1)


@dataclass
class Stretch:
    """The first and last sequence of a part (group, key), and the depths of its nodes on their paths."""

    first: tuple[tuple, bytes]
    last: tuple[tuple, bytes]
    on_first: frozenset[int]
    on_last: frozenset[int]


def _both(a: tuple[tuple, bytes], b: tuple[tuple, bytes]) -> int:
    return shared_steps(a[1], b[1]) if a[0] == b[0] else -1


def points_between(stretches: list[Stretch]) -> list[tuple[tuple | None, frozenset[int], frozenset[int]]]:
    """For each part, in order: the last sequence before it, and the depths of the nodes that
    other parts have on the paths of its first and of its last sequence."""
    n = len(stretches)
    joints = [_both(a.last, b.first) for a, b in zip(stretches, stretches[1:])]
    within = [_both(s.first, s.last) for s in stretches]
    first, last = [frozenset()] * n, [frozenset()] * n
    for i in range(1, n):
        carried = stretches[i - 1].on_last | {d for d in first[i - 1] if d <= within[i - 1]}
        first[i] = frozenset(d for d in carried | {joints[i - 1]} if 0 <= d <= joints[i - 1])
    for i in range(n - 2, -1, -1):
        carried = stretches[i + 1].on_first | {d for d in last[i + 1] if d <= within[i + 1]}
        last[i] = frozenset(d for d in carried | {joints[i]} if 0 <= d <= joints[i])
    return [(stretches[i - 1].last if i else None, first[i], last[i]) for i in range(n)]
