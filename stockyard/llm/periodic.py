"""Runs: stretches of words that repeat with a period, found as maximal pairs.

A maximal pair is two places of a text from which the same `m` words follow, with
different words before them and after them. A run of period q and length n is the
maximal pair of distance q whose words are the n - q that both places share. So runs
with length >= max(6, 4 * q) are exactly the pairs with m >= max(6 - q, 3 * q); of the
pairs that give one stretch the least distance is its period. Nothing is extended.

1. The suffixes of all texts of a batch are sorted by doubling of prefixes, each text
   by itself; a place leaves the sorting when its prefix is unique. All pairs share
   five words or more, so texts in which no five words occur twice are done here.
2. Neighbours in the order of suffixes get their longest common prefixes (LCP) from the
   ranks of the doubling steps.
3. A stack goes up the tree of LCP intervals. A node has the places of its suffixes in
   order and the class of their left words. Children of one class are joined without a
   look at their places. Else each place of the smaller child looks for places of
   another class in the larger one, no farther than a third of the node's LCP. Places so
   near form one arithmetic progression, and all but its first have the same left word;
   so a place looks at its first neighbour below, and above it as far as classes differ.
   That finds all pairs in time that grows with their number, also in "a a a a ...".

Defined results: words are split at 0x20 and 0x09 to 0x0D and compared byte by byte,
case included; null and empty texts have no words and no runs. Every row is worked on by
itself, so repeated rows give equal rows. Extra columns are ignored. A very long text is
one row of a batch; its suffixes take some 30 numbers a word while it is worked on.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockyard.llm.kernels import runs as row_runs
from stockyard.llm.kernels import utf8
from stockyard.shipping import ship_by_value

ship_by_value(__name__)

#: Words that two places of a pair share at least: max(6 - q, 3 * q) for q = 1.
SHARED = 5

_RUN = "struct<start: bigint, length: bigint, period: bigint>"
_ROWS = f"doc_id long, n_words long, runs array<{_RUN}>, best {_RUN}, collapsed string"


def _ranks(x: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For k = 1, 2, 4, ...: k, the rank of each place by its k words, and the places whose k words recur.

    `x` has other numbers in every text; `ends` is the end of each place's text. Equal
    ranks mean equal words, and order is kept from step to step.
    """
    counts = np.bincount(x)
    rank = (np.cumsum(counts) - counts)[x]
    open_ = np.flatnonzero(counts[x] > 1)
    k = 1
    while True:
        yield k, rank, open_
        if not len(open_):
            return
        after = open_ + k
        inside = after < ends[open_]
        second = np.where(inside, rank[np.where(inside, after, 0)] + 1, 0)
        order = np.lexsort((second, rank[open_]))
        places, first, second = open_[order], rank[open_][order], second[order]
        index = np.arange(len(places))
        group = np.ones(len(places), bool)
        group[1:] = first[1:] != first[:-1]
        part = group.copy()
        part[1:] |= second[1:] != second[:-1]
        heads = np.flatnonzero(part)
        shift = np.maximum.accumulate(np.where(part, index, 0)) - np.maximum.accumulate(np.where(group, index, 0))
        rank = rank.copy()
        rank[places] = first + shift
        size = np.repeat(np.diff(np.append(heads, len(places))), np.diff(np.append(heads, len(places))))
        open_ = np.sort(places[size > 1])
        k *= 2


def _recurring(x: np.ndarray, ends: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """The texts in which some `SHARED` words occur twice."""
    first = None
    for k, rank, open_ in _ranks(x, ends):
        if k == 1:
            first = rank
        if k == 4:
            whole = open_[open_ + 4 < ends[open_]]
            keys = rank[whole].astype(np.int64) * (len(x) + 1) + first[whole + 4]
            order = np.argsort(keys, kind="stable")
            twice = keys[order][1:] == keys[order][:-1]
            return np.unique(doc[whole[order[1:][twice]]])
        if not len(open_):
            return np.zeros(0, np.int64)
    return np.zeros(0, np.int64)


def _suffixes(x: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places by the order of their suffixes, and the LCP of each with the one before, both in words."""
    steps = [(k, rank.astype(np.int32)) for k, rank, _ in _ranks(x, ends)]
    order = np.argsort(steps[-1][1])
    lcp = np.zeros(len(x), np.int64)
    near = 1 + np.flatnonzero(steps[min(2, len(steps) - 1)][1][order][1:] == steps[min(2, len(steps) - 1)][1][order][:-1])
    a, b = order[near - 1], order[near]
    length = np.zeros(len(near), np.int64)
    end_a, end_b = ends[a], ends[b]
    for k, rank in reversed(steps):
        inside = (a + length < end_a) & (b + length < end_b)
        same = inside.copy()
        same[inside] = rank[(a + length)[inside]] == rank[(b + length)[inside]]
        length += np.where(same, k, 0)
    lcp[near] = length
    return order, lcp


#: A set of places: their list in order, and the class of all their left words, or None if they differ.
_Places = tuple[list[int], int | None]


def _join(depth: int, one: _Places, two: _Places, left: list[int], found: list[tuple[int, int, int]]) -> _Places:
    """The union of two children of a node, after their pairs of different left words have been told."""
    (few, few_class), (many, many_class) = (one, two) if len(one[0]) <= len(two[0]) else (two, one)
    same = few_class is not None and few_class == many_class
    if not same:
        reach = depth // 3
        for x in few:
            mine, at = left[x], bisect_right(many, x)
            j = at
            while j < len(many) and many[j] - x <= reach and left[many[j]] != mine:
                found.append((x, many[j] - x, depth))
                j += 1
            j = bisect_left(many, x - reach, 0, at)
            if j < at and left[many[j]] != mine:
                found.append((many[j], x - many[j], depth))
    if len(few) * 8 < len(many):
        for x in few:
            insort(many, x)
    else:
        many.extend(few)
        many.sort()
    return many, few_class if same else None


def _pairs(places: list[int], lcp: list[int], left: list[int], found: list[tuple[int, int, int]]) -> None:
    """Maximal pairs of one subtree: `places` in suffix order, `lcp[i]` between places i - 1 and i."""
    stack: list[tuple[int, _Places]] = []
    for i in range(1, len(places) + 1):
        depth = lcp[i] if i < len(places) else 0
        node: _Places = ([places[i - 1]], left[places[i - 1]])
        while stack and stack[-1][0] > depth:
            inner, child = stack.pop()
            node = _join(inner, child, node, left, found)
        if stack and stack[-1][0] == depth:
            node = _join(depth, stack.pop()[1], node, left, found)
        stack.append((depth, node))


def find(x: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of all texts, by text, start and period: text, start (word of the text), length, period.

    `x` has a number for each word, others in each text; text t is x[offsets[t]:offsets[t + 1]].
    """
    none = tuple(np.zeros(0, np.int64) for _ in range(4))
    sizes = np.diff(offsets)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    picked = _recurring(x, offsets[1:][doc], doc)
    if not len(picked):
        return none
    keep = np.isin(doc, picked)
    _, x = np.unique(x[keep], return_inverse=True)
    sizes, doc = sizes[picked], np.repeat(np.arange(len(picked)), sizes[picked])
    ends = np.cumsum(sizes)
    begins = ends - sizes
    order, lcp = _suffixes(x, ends[doc])
    before = np.arange(len(x)) - 1
    left = np.where(np.arange(len(x)) == begins[doc], -1 - doc, x[before])

    # A subtree is a stretch with SHARED common words or more. It goes on if two of its places are near enough.
    deep = lcp >= SHARED
    head = np.flatnonzero(deep & ~np.concatenate([[False], deep[:-1]])) - 1
    tail = np.flatnonzero(deep & ~np.concatenate([deep[1:], [False]])) + 1
    found: list[tuple[int, int, int]] = []
    words_before: list[int] | None = None
    if len(head):
        which = np.repeat(np.arange(len(head)), tail - head)
        at = np.repeat(head - np.concatenate([[0], np.cumsum(tail - head)[:-1]]), tail - head) + np.arange(len(which))
        most = np.maximum.reduceat(np.where(at == np.repeat(head, tail - head), 0, lcp[at]), np.cumsum(tail - head) - (tail - head))
        by_place = np.lexsort((order[at], which))
        gaps = np.diff(order[at][by_place])
        gaps[which[by_place][1:] != which[by_place][:-1]] = len(x)
        least = np.minimum.reduceat(np.append(gaps, len(x)), np.cumsum(tail - head) - (tail - head))
        for s in np.flatnonzero(least <= most // 3).tolist():
            words_before = words_before if words_before is not None else left.tolist()
            _pairs(order[head[s] : tail[s]].tolist(), lcp[head[s] : tail[s]].tolist(), words_before, found)
    if not found:
        return none
    start, period, shared = np.array(found, np.int64).T
    length = shared + period
    by = np.lexsort((period, length, start))
    start, length, period = start[by], length[by], period[by]
    first = np.ones(len(start), bool)
    first[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    start, length, period = start[first], length[first], period[first]
    of = doc[start]
    by = np.lexsort((period, start - begins[of], of))
    return picked[of[by]], (start - begins[of])[by], length[by], period[by]


def best_of(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of greatest length / period; of equal ones the first, then the one of the shorter period."""
    best = None
    for run in runs:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that a run only repeats."""
    drop = np.zeros(len(words), bool)
    for start, length, period in runs:
        drop[start + period : start + length] = True
    return [words[i] for i in np.flatnonzero(~drop).tolist()]


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The contract's rewriting: of one document in ten, by the hash of its id, a stretch repeats up to the end."""
    if doc_id is None or not words:
        return words
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * ((n - a) // p + 1))[: n - a]


def _found(rewrite: Callable[[int | None, list[bytes]], list[bytes]] | None):
    kind = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            all_ids = batch.column("doc_id").to_pylist()
            raw = data.tobytes()
            for lo, hi in row_runs(offsets):
                doc_ids = all_ids[lo:hi]
                texts = [raw[a:b].split() for a, b in zip(offsets[lo:hi], offsets[lo + 1 : hi + 1], strict=True)]
                if rewrite:
                    texts = [rewrite(d, w) for d, w in zip(doc_ids, texts, strict=True)]
                numbers, base = [], 0
                for words in texts:
                    seen = {w: k for k, w in enumerate(dict.fromkeys(words), base)}
                    numbers += [seen[w] for w in words]
                    base += len(seen)
                sizes = [len(w) for w in texts]
                cuts = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
                of, *parts = find(np.array(numbers, np.int64), cuts)
                bounds = np.searchsorted(of, np.arange(len(texts) + 1)).tolist()
                triples = list(zip(*(p.tolist() for p in parts), strict=True))
                each = [triples[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                named = [[dict(zip(("start", "length", "period"), r, strict=True)) for r in runs] for runs in each]
                best = [best_of(runs) for runs in each]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(doc_ids, pa.int64()),
                        pa.array(sizes, pa.int64()),
                        pa.array(named, pa.list_(kind)),
                        pa.array([b and dict(zip(("start", "length", "period"), b, strict=True)) for b in best], kind),
                        pa.array([b" ".join(collapse(w, r) if r else w).decode() for w, r in zip(texts, each, strict=True)], pa.string()),
                    ],
                    ["doc_id", "n_words", "runs", "best", "collapsed"],
                )

    return run


def periodic_runs(docs: DataFrame, rewrite: Callable[[int | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """One row per document: its number of words, its runs, the one repeated most often, and the text without the repeats."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return texts.mapInArrow(_found(rewrite), _ROWS)
