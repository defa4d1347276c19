"""Re-Pair grammars of id sequences, and the shards that hold them.

Frequent pairs of neighbouring symbols are replaced by new symbols, again and again,
until no pair has `LEAST` places left. A round counts all pairs, takes those with at
least a sixteenth of the highest count, and where chosen pairs overlap the more frequent
one goes first; so a round stands for many single replacements.

A shard keeps the rules, the length that each rule expands to, and the remaining
symbols. The lengths say which symbols cover any range of ids, so a range is decoded
without the rest of its shard.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np

from stockyard.shipping import ship_by_value

ship_by_value(__name__)

#: Places that a pair must have for a rule of its own.
LEAST = 8

_MAGIC = b"RPG1"
_HEAD = "<4sBqqqqq"
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def _slots(keys: np.ndarray) -> np.ndarray:
    """A place of each pair in a table of 2^18."""
    return (keys.view(np.uint64) * _SPREAD) >> np.uint64(46)


def _apart(places: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """Which places to replace, so that no two overlap: of a lower rank than both neighbours, in stretches of one rank every other."""
    joined = np.zeros(len(places) + 1, bool)
    joined[1:-1] = places[1:] == places[:-1] + 1
    lower = np.empty(len(places), bool)  # than the place before
    lower[:1] = True
    lower[1:] = ~joined[1:-1] | (ranks[:-1] > ranks[1:])
    same = np.zeros(len(places) + 1, bool)
    same[1:-1] = joined[1:-1] & (ranks[1:] == ranks[:-1])
    out = lower & ~same[:-1]
    out[:-1] &= ~joined[1:-1] | (ranks[1:] >= ranks[:-1])
    if same.any():  # as in "a a a a"
        index = np.arange(len(places))
        start = np.maximum.accumulate(np.where(same[:-1], 0, index))
        inner = np.flatnonzero(same[:-1])
        followed = np.zeros(len(inner), bool)
        last = inner + 1 < len(places)
        followed[last] = joined[inner[last] + 1] & (ranks[inner[last] + 1] < ranks[inner[last]])
        out[inner] = ((inner - start[inner]) % 2 == 0) & lower[start[inner]] & ~followed
    return out


def compress(ids: np.ndarray, base: int, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """Rules (left, right) of the symbols from `base` on, and the symbols that stand for `ids` (all below `base`).

    A pair that has become rare stays rare, since replacements only make pairs of new
    symbols. So a round looks only at the places of pairs that were frequent, and
    beside the symbols that the last one made.
    """
    seq, rules, made = ids.astype(np.int64), [], 0
    open_ = np.arange(max(0, len(seq) - 1))
    while len(open_):
        keys = (seq[open_] << 32) | seq[open_ + 1]
        ordered = np.sort(keys)
        heads = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        counts = np.diff(np.append(heads, len(ordered)))
        often = counts >= least
        if not often.any():
            break
        pairs, counts = ordered[heads[often]], counts[often]
        chosen = counts >= max(least, int(counts.max()) // 16)
        kind, slots = np.zeros(1 << 18, np.uint8), _slots(pairs)
        kind[slots] = 1
        kind[slots[chosen]] = 2
        pairs, counts = pairs[chosen], counts[chosen]
        rank = np.empty(len(pairs), np.int64)
        rank[np.lexsort((pairs, -counts))] = np.arange(len(pairs))
        of_place = kind[_slots(keys)]
        maybe = np.flatnonzero(of_place == 2)
        at = np.minimum(np.searchsorted(pairs, keys[maybe]), len(pairs) - 1)
        hit = pairs[at] == keys[maybe]
        places, ranks = open_[maybe[hit]], rank[at[hit]]
        free = _apart(places, ranks)
        places, ranks = places[free], ranks[free]
        worth = np.bincount(ranks, minlength=len(pairs)) >= least
        if not worth.any():
            break
        places, ranks = places[worth[ranks]], ranks[worth[ranks]]
        number = np.cumsum(worth) - 1 + base + made
        by_rank = np.empty(len(pairs), np.int64)
        by_rank[rank] = pairs
        new = by_rank[worth]
        rules.append(np.stack([new >> 32, new & 0xFFFFFFFF], 1))
        made += len(new)
        seq[places] = number[ranks]
        keep, look = np.ones(len(seq), bool), np.zeros(len(seq), bool)
        keep[places + 1] = False
        look[open_[of_place > 0]] = True
        look[places] = True
        look[places[places > 0] - 1] = True
        seq = seq[keep]
        open_ = np.flatnonzero(look[keep])
        open_ = open_[open_ < len(seq) - 1]
    return (np.concatenate(rules) if rules else np.zeros((0, 2), np.int64)), seq


def lengths_of(rules: np.ndarray, base: int) -> np.ndarray:
    """How many ids each rule stands for; a rule only names earlier ones."""
    out = np.zeros(len(rules), np.int64)
    todo = np.arange(len(rules))
    while len(todo):
        pair = rules[todo]
        inner = pair >= base
        parts = np.where(inner, out[np.where(inner, pair - base, 0)], 1)
        known = (parts > 0).all(1)
        out[todo[known]] = parts[known].sum(1)
        todo = todo[~known]
    return out


def expand(seq: np.ndarray, rules: np.ndarray, base: int) -> np.ndarray:
    """The ids that the symbols stand for."""
    seq = np.asarray(seq, np.int64)
    while True:
        at = np.flatnonzero(seq >= base)
        if not len(at):
            return seq
        out = np.repeat(seq, np.where(seq >= base, 2, 1))
        left = at + np.arange(len(at))
        out[left], out[left + 1] = rules[seq[at] - base].T
        seq = out


def _thin(values: np.ndarray, width: int) -> bytes:
    return values.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :width].tobytes()


def _wide(data: memoryview, n: int, width: int) -> np.ndarray:
    out = np.zeros((n, 4), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8, n * width).reshape(n, width)
    return out.view("<u4").reshape(-1).astype(np.int64)


@dataclass
class Shard:
    """Consecutive documents: where each ends, and the grammar of all their ids."""

    base: int
    ends: np.ndarray
    rules: np.ndarray
    lengths: np.ndarray
    symbols: np.ndarray

    @classmethod
    def of(cls, ids: np.ndarray, ends: np.ndarray) -> Shard:
        base = int(ids.max()) + 1 if len(ids) else 0
        rules, symbols = compress(ids, base)
        return cls(base, np.asarray(ends, np.int64), rules, lengths_of(rules, base), symbols)

    def to_bytes(self) -> bytes:
        width = 3 if self.base + len(self.rules) < 1 << 24 else 4
        total = int(self.ends[-1]) if len(self.ends) else 0
        head = struct.pack(_HEAD, _MAGIC, width, self.base, len(self.ends), len(self.rules), len(self.symbols), total)
        parts = [self.ends.astype("<i8").tobytes(), _thin(self.rules.reshape(-1), width)]
        return b"".join([head, *parts, self.lengths.astype("<u4").tobytes(), _thin(self.symbols, width)])

    @classmethod
    def from_bytes(cls, data: bytes | memoryview) -> Shard:
        view = memoryview(data)
        magic, width, base, docs, rules, symbols, total = struct.unpack_from(_HEAD, view)
        size = struct.calcsize(_HEAD) + 8 * docs + 2 * rules * width + 4 * rules + symbols * width
        if magic != _MAGIC or len(view) != size:
            raise ValueError("not a whole shard of token ids")
        at = struct.calcsize(_HEAD)
        ends = np.frombuffer(view[at:], "<i8", docs).astype(np.int64)
        at += 8 * docs
        pairs = _wide(view[at:], 2 * rules, width).reshape(-1, 2)
        at += 2 * rules * width
        lengths = np.frombuffer(view[at:], "<u4", rules).astype(np.int64)
        out = cls(base, ends, pairs, lengths, _wide(view[at + 4 * rules :], symbols, width))
        if int(out.stops[-1] if symbols else 0) != total:
            raise ValueError("a shard's lengths do not add up")
        return out

    @property
    def stops(self) -> np.ndarray:
        """Where each symbol's ids end."""
        if not hasattr(self, "_stops"):
            inner = self.symbols >= self.base
            each = np.ones(len(self.symbols), np.int64)
            each[inner] = self.lengths[self.symbols[inner] - self.base]
            self._stops = np.cumsum(each)
        return self._stops

    def ids(self) -> np.ndarray:
        """All ids: every rule is expanded once, then the symbols take their stretches."""
        flat = np.concatenate([np.arange(self.base), expand(np.arange(len(self.rules)) + self.base, self.rules, self.base)])
        heads = np.concatenate([np.arange(self.base), self.base + np.cumsum(self.lengths) - self.lengths])[self.symbols]
        each = np.diff(self.stops, prepend=0)
        return flat[np.repeat(heads - (self.stops - each), each) + np.arange(self.stops[-1] if len(each) else 0)]

    def span(self, lo: int, hi: int) -> np.ndarray:
        """The ids from lo to hi; only the symbols that cover them are expanded."""
        if hi <= lo:
            return np.zeros(0, np.int64)
        first = int(np.searchsorted(self.stops, lo, side="right"))
        last = int(np.searchsorted(self.stops, hi, side="left"))
        before = int(self.stops[first - 1]) if first else 0
        return expand(self.symbols[first : last + 1], self.rules, self.base)[lo - before : hi - before]

    def document(self, k: int) -> np.ndarray:
        return self.span(int(self.ends[k - 1]) if k else 0, int(self.ends[k]))
