import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from stockyard.llm.kernels import HashTable, SpanHasher, counted, lower_ascii, runs, utf8, word_spans

from .helpers import lower, words

TEXTS = st.lists(st.one_of(st.none(), st.text(st.sampled_from(list("aAbZé 😀\t\n\x0b\x1f ")), max_size=30)), max_size=8)


@settings(max_examples=100, deadline=None)
@given(TEXTS, st.integers(1, 20))
def test_words_and_hashes(texts, limit):
    data, offsets = utf8(pa.array(texts, pa.string()))
    found = [[] for _ in texts]
    hashes = {}
    hasher = SpanHasher(3)
    for lo, hi in runs(offsets, limit):
        part = lower_ascii(data[offsets[lo] : offsets[hi]])
        starts, ends, rows = word_spans(part, offsets[lo : hi + 1] - offsets[lo])
        for s, e, r, h in zip(starts, ends, rows, hasher.over(part).spans(starts, ends), strict=True):
            word = part[s:e].tobytes().decode()
            found[lo + r].append(word)
            assert hashes.setdefault(word, h) == h
    assert found == [words(t) for t in texts]
    assert len(set(hashes.values())) == len(hashes)


def test_lower_is_ascii_only():
    text = "ÀÉ AZaz[@`{ ß"
    assert lower_ascii(np.frombuffer(text.encode(), np.uint8)).tobytes().decode() == lower(text)
    assert re.search("À", lower(text))


@settings(max_examples=50, deadline=None)
@given(st.sets(st.integers(0, 2**64 - 1), max_size=200), st.lists(st.integers(0, 2**64 - 1), max_size=50))
def test_hash_table(keys, others):
    order = np.array(sorted(keys), np.uint64)
    table = HashTable(order)
    asked = np.array([*keys, *others], np.uint64)
    got = HashTable.of(*table.parts()).find(asked)
    where = {int(k): n for n, k in enumerate(order)}
    assert got.tolist() == [where.get(int(a), -1) for a in asked]


def test_counted():
    keys, n = counted(np.array([3, 1, 3], np.uint64), np.array([5, 1, 2]))
    assert keys.tolist() == [1, 3] and n.tolist() == [1, 7]
    assert counted(np.zeros(0, np.uint64))[0].size == 0
