"""K-d trees over the letter counts of words of one length, and range searches in them.

A word is a point of 32 counts: a to z each their own, other letters in six groups. One
replaced letter moves at most one count up and one down; one more letter moves one
count up. So the words near a given one lie in boxes that are at most one over and one
under its counts, and a subtree whose box is farther away is not entered. Queries go
down together, as arrays.

At a leaf the counts are compared as 64 bits (two for each count, for 1 and for 2 or
more), and the few words left letter by letter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

from stockyard.shipping import ship_by_value

ship_by_value(__name__)

AXES = 32
#: A leaf of a tree inside a task has at most so many words, unless their counts are equal.
BUCKET = 32
#: Pairs that are compared at a time.
PAIRS = 1 << 20


def letters(words: list[str], length: int) -> np.ndarray:
    """The code points of words of one length, a row for each word."""
    return np.array(words, dtype=f"U{max(1, length)}").view(np.uint32).reshape(len(words), -1)


def counts_of(codes: np.ndarray) -> np.ndarray:
    """The points of words: how often each has the letters of an axis."""
    plain = (codes >= 97) & (codes <= 122)
    axis = np.where(plain, codes - 97, 26 + codes % 6).astype(np.int64)
    cells = axis + np.arange(len(codes))[:, None] * AXES
    return np.bincount(cells.reshape(-1), minlength=len(codes) * AXES).reshape(-1, AXES).astype(np.int32)


def marks_of(points: np.ndarray) -> np.ndarray:
    """Two bits for each axis. As many bits differ as the counts, cut at 2, differ."""
    out = np.zeros(len(points), np.uint64)
    for axis in range(AXES):
        out |= (points[:, axis] >= 1).astype(np.uint64) << np.uint64(2 * axis)
        out |= (points[:, axis] >= 2).astype(np.uint64) << np.uint64(2 * axis + 1)
    return out


@dataclass
class Node:
    """A cut of an axis (counts up to `cut` go low), or a leaf with its number and the rows in it."""

    axis: int = -1
    cut: int = 0
    low: Node | None = None
    high: Node | None = None
    leaf: int = -1
    rows: np.ndarray | None = None


def _cut(points: np.ndarray) -> tuple[int, int] | None:
    """The axis of the most even cut, and the cut."""
    best, axis, cut = 0, -1, 0
    for value in range(int(points.max(initial=0))):
        low = (points <= value).sum(0)
        side = np.minimum(low, len(points) - low)
        k = int(side.argmax())
        if side[k] > best:
            best, axis, cut = int(side[k]), k, value
    return (axis, cut) if best else None


def build(points: np.ndarray, bucket: int) -> tuple[Node, int]:
    """A tree whose leaves have at most `bucket` points, or equal ones; and the number of leaves."""
    leaves = 0

    def grow(rows: np.ndarray) -> Node:
        nonlocal leaves
        found = _cut(points[rows]) if len(rows) > bucket else None
        if found is None:
            leaves += 1
            return Node(leaf=leaves - 1, rows=rows)
        low = points[rows, found[0]] <= found[1]
        return Node(*found, grow(rows[low]), grow(rows[~low]))

    return grow(np.arange(len(points))), leaves


def home(tree: Node, points: np.ndarray) -> np.ndarray:
    """The leaf of each point."""
    out = np.zeros(len(points), np.int64)

    def go(node: Node, rows: np.ndarray) -> None:
        if node.axis < 0:
            out[rows] = node.leaf
        elif len(rows):
            low = points[rows, node.axis] <= node.cut
            go(node.low, rows[low])
            go(node.high, rows[~low])

    go(tree, np.arange(len(points)))
    return out


def reached(tree: Node, points: np.ndarray, over: int, under: int) -> Iterator[tuple[Node, np.ndarray]]:
    """Leaves and the queries whose range meets their box: its points may exceed the query by `over` in all, and fall short by `under`."""
    lowest, highest = [0] * AXES, [1 << 30] * AXES

    def go(node: Node, rows: np.ndarray, more: np.ndarray, less: np.ndarray) -> Iterator[tuple[Node, np.ndarray]]:
        if not len(rows):
            return
        if node.axis < 0:
            yield node, rows
            return
        own = points[rows, node.axis]
        was = highest[node.axis]
        short = less - np.maximum(0, own - was) + np.maximum(0, own - node.cut)
        inside = short <= under
        highest[node.axis] = node.cut
        yield from go(node.low, rows[inside], more[inside], short[inside])
        highest[node.axis] = was
        was = lowest[node.axis]
        long = more - np.maximum(0, was - own) + np.maximum(0, node.cut + 1 - own)
        inside = long <= over
        lowest[node.axis] = node.cut + 1
        yield from go(node.high, rows[inside], long[inside], less[inside])
        lowest[node.axis] = was

    zero = np.zeros(len(points), np.int32)
    yield from go(tree, np.arange(len(points)), zero, zero)


def one_apart(longer: np.ndarray, shorter: np.ndarray) -> np.ndarray:
    """Whether two words, row by row, differ by one replaced letter (equal widths) or by one letter that the longer has more."""
    n = shorter.shape[1]
    if longer.shape[1] == n:
        return (longer != shorter).sum(1) == 1
    front = np.logical_and.accumulate(longer[:, :n] == shorter, axis=1).sum(1)
    back = np.logical_and.accumulate((longer[:, 1:] == shorter)[:, ::-1], axis=1).sum(1)
    return front + back >= n


class WordTree:
    """Words of one length, to be searched for the words near others."""

    def __init__(self, words: list[str], length: int):
        self.codes = letters(words, length)
        points = counts_of(self.codes)
        self.marks = marks_of(points)
        self.tree, _ = build(points, BUCKET)

    def near(self, words: list[str], length: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (row of `words`, row of the tree) one edit apart; `words` are as long as the tree's, or longer by one."""
        codes = letters(words, length)
        points, longer = counts_of(codes), length - self.codes.shape[1]
        marks = marks_of(points)
        few, step = 2 - longer, max(1, PAIRS // BUCKET)
        ours, theirs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for leaf, rows in reached(self.tree, points, 1 - longer, 1):
            step = max(1, PAIRS // max(1, len(leaf.rows)))
            for lo in range(0, len(rows), step):
                some = rows[lo : lo + step]
                q, p = np.nonzero(np.bitwise_count(marks[some][:, None] ^ self.marks[leaf.rows][None, :]) <= few)
                ours.append(some[q])
                theirs.append(leaf.rows[p])
        a, b = np.concatenate(ours), np.concatenate(theirs)
        keep = np.zeros(len(a), bool)
        step = max(1, (PAIRS * 16) // max(1, length))
        for lo in range(0, len(a), step):
            keep[lo : lo + step] = one_apart(codes[a[lo : lo + step]], self.codes[b[lo : lo + step]])
        return a[keep], b[keep]
