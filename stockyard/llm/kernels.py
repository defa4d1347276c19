"""Array kernels over the bytes of Arrow string columns: case, words, hashes, counts.

Texts of a batch stay one byte array with row offsets; nothing is done per word
in Python. A null text is an empty one.
"""

from __future__ import annotations

import ctypes
import functools
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

from stockyard.shipping import ship_by_value

ship_by_value(__name__)

#: Texts are worked on in runs of whole rows of about so many bytes.
RUN_BYTES = 1 << 20

def worker_memory(owner: str | None) -> dict:
    """What an operator keeps in a Python worker for the next tasks; what another one kept there is dropped.

    The code of the tasks comes with each of them, so the memory hangs on a module that stays.
    """
    kept = sys.modules["pyarrow"].__dict__.setdefault("_kept_in_worker", {})
    for other in [k for k in kept if k != owner]:
        del kept[other]
    return kept.setdefault(owner, {}) if owner else {}


def give_back() -> None:
    """Return freed memory to the system: the next stage's tasks run beside this worker."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def lean(run: Callable, owner: str | None = None) -> Callable:
    """A task function that begins without other operators' memories and gives its own arrays back at the end."""

    @functools.wraps(run)
    def wrapped(batches: Iterator) -> Iterator:
        worker_memory(owner)
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX2 = np.uint64(0x94D049BB133111EB)
_BASE = 0x5851F42D4C957F2D  # odd, 5 mod 8: powers stay invertible modulo 2^64


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all rows in one array, and the offsets of the rows in it."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64 if wide else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def runs(offsets: np.ndarray, limit: int = RUN_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `limit` bytes, or of one row."""
    rows, lo = len(offsets) - 1, 0
    while lo < rows:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
        hi = min(rows, max(lo + 1, hi))
        yield lo, hi
        lo = hi


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z, all other bytes as they are."""
    return data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)


def row_of(offsets: np.ndarray, positions: np.ndarray) -> np.ndarray:
    return np.searchsorted(offsets, positions, side="right") - 1


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the words, which are runs of bytes other than 0x20 and 0x09 to 0x0D."""
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    first[heads] = inside[heads]
    last[:-1] &= ~inside[1:]
    tails = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    last[tails] = inside[tails]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, row_of(offsets, starts)


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    h = h + _STEP
    h = (h ^ (h >> np.uint64(30))) * _MIX1
    h = (h ^ (h >> np.uint64(27))) * _MIX2
    return h ^ (h >> np.uint64(31))


class SpanHasher:
    """64-bit hashes of spans of a byte array: prefix sums of keyed bytes times powers, modulo 2^64."""

    def __init__(self, seed: int = 1):
        self.seed = np.uint64(seed)
        self.keys = np.random.default_rng(seed).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.powers = np.ones(1, np.uint64)
        self.inverse = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if n > len(self.powers):
            size = max(n, 2 * len(self.powers))
            for name, base in (("powers", _BASE), ("inverse", pow(_BASE, -1, 1 << 64))):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))

    def over(self, data: np.ndarray) -> SpanHasher:
        """Prepare a byte array; `spans` then hashes any spans of it."""
        self._grow(len(data) + 1)
        sums = np.cumsum(self.keys[data] * self.powers[: len(data)], dtype=np.uint64)
        self.sums = np.concatenate([np.zeros(1, np.uint64), sums])
        return self

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        h = (self.sums[ends] - self.sums[starts]) * self.inverse[starts]
        return mix(h ^ ((ends - starts).astype(np.uint64) * _MIX2 + self.seed))


def counted(values: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values in order and how often each occurs, or the sum of its weights."""
    if len(values) == 0:
        return values, np.zeros(0, np.int64)
    if weights is None:
        values = np.sort(values)
    else:
        order = np.argsort(values)
        values, weights = values[order], weights[order]
    heads = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    if weights is None:
        return values[heads], np.diff(np.append(heads, len(values)))
    return values[heads], np.add.reduceat(weights, heads)


def distinct_per_row(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, value) pairs, by row and then by value; `rows` come in order."""
    order = np.lexsort((values, rows))
    rows, values = rows[order], values[order]
    keep = np.ones(len(rows), bool)
    keep[1:] = (rows[1:] != rows[:-1]) | (values[1:] != values[:-1])
    return rows[keep], values[keep]


class HashTable:
    """A read-only map from 64-bit keys to rows of arrays, looked up for whole arrays of keys."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 2))))
        self.slots = np.full(1 << self.bits, -1, np.int32)
        self.keys = keys
        todo, at = np.arange(len(keys), dtype=np.int64), self._home(keys)
        while len(todo):
            free = self.slots[at] < 0
            self.slots[at[free]] = todo[free]
            left = self.slots[at] != todo
            todo, at = todo[left], (at[left] + 1) & (len(self.slots) - 1)

    def parts(self) -> tuple[int, np.ndarray, np.ndarray]:
        """Plain arrays, which can be broadcast."""
        return self.bits, self.slots, self.keys

    @classmethod
    def of(cls, bits: int, slots: np.ndarray, keys: np.ndarray) -> HashTable:
        table = cls.__new__(cls)
        table.bits, table.slots, table.keys = bits, slots, keys
        return table

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return (mix(keys) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The position of each key, or -1."""
        out = np.full(len(keys), -1, np.int32)
        if len(self.keys) == 0:
            return out
        todo, at = np.arange(len(keys)), self._home(keys)
        while len(todo):
            got = self.slots[at]
            hit = (got >= 0) & (self.keys[got] == keys[todo])
            out[todo[hit]] = got[hit]
            left = (got >= 0) & ~hit
            todo, at = todo[left], (at[left] + 1) & (len(self.slots) - 1)
        return out
