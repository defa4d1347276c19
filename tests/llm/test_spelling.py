import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from stockyard.llm import kdtree, spelling
from stockyard.llm.queries import QUERIES

from .helpers import FOLDER, awkward, documents, lower

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def counts(rows, damaged=0, min_length=6, min_count=5):
    out = Counter()
    for doc_id, text in rows:
        for run in RUN.findall(lower(text)):
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if damaged and h % damaged == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            out[run] += 1
    return {w: n for w, n in out.items() if len(w) >= min_length and n >= min_count}


def edits(word, alphabet):
    for k in range(len(word) + 1):
        yield from (word[:k] + c + word[k:] for c in alphabet)
        if k < len(word):
            yield word[:k] + word[k + 1 :]
            yield from (word[:k] + c + word[k + 1 :] for c in alphabet)


def brute(words, ratio=5):
    alphabet = {c for w in words for c in w}
    best, near = {}, {}
    for w, n in words.items():
        near[w] = {e for e in edits(w, alphabet) if e in words and e != w}
        first = min(near[w], key=lambda e: (-words[e], e), default=None)
        best[w] = first if first is not None and words[first] >= ratio * n else None
    out = []
    for w, n in words.items():
        root = w
        while best[root] is not None:
            root = best[root]
        out.append((w, best[w], root, n, len(near[w]), None if best[w] is None else words[best[w]]))
    return sorted(out, key=lambda r: r[0])


def told(df):
    return sorted((tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()), key=lambda r: r[0])


def test_query_equals_brute_force(spark):
    folder = FOLDER.replace("0.001", "0.01")
    rows = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    got = told(QUERIES["op12_spelling_variants"](spark, folder))
    assert got == brute(counts(rows, damaged=199))
    assert sum(r[1] is not None for r in got) > 20


@pytest.mark.parametrize(("sample", "leaf"), [(1 << 16, 40), (64, 16), (1, 1 << 13)])
def test_leaves_and_slices_lose_no_pair(spark, monkeypatch, sample, leaf):
    monkeypatch.setattr(spelling, "SAMPLE", sample)
    monkeypatch.setattr(spelling, "LEAF", leaf)
    rng = random.Random(8)
    words = {"".join(rng.choice("abé") for _ in range(rng.randint(6, 8))): rng.randint(5, 5000) for _ in range(1500)}
    words |= {"".join(rng.sample("abcdef", 6)): rng.randint(5, 5000) for _ in range(400)}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    assert told(spelling.variants(df)) == brute(words)


def test_tree_search_equals_all_pairs():
    rng = random.Random(4)
    for length in (6, 9):
        words = sorted({"".join(rng.choice("abcxyzäÿ") for _ in range(length)) for _ in range(600)})
        words += [w[:2] + "q" + w[3:] for w in words[:50]] + [w[1:] + w[0] for w in words[:20]]
        words = sorted(set(words))
        tree = kdtree.WordTree(words, length)
        for more in (0, 1):
            asked = words if not more else [w[:k] + "b" + w[k:] for w in words for k in (0, 3, length)]
            a, b = tree.near(asked, length + more)
            got = set(zip(a.tolist(), b.tolist(), strict=True))
            assert len(got) == len(a)
            if more:
                want = {(i, j) for i, x in enumerate(asked) for j, y in enumerate(words) if any(x[:k] + x[k + 1 :] == y for k in range(len(x)))}
            else:
                want = {(i, j) for i, x in enumerate(asked) for j, y in enumerate(words) if sum(p != q for p, q in zip(x, y, strict=True)) == 1}
            assert got == want


def test_axes_hold_counts():
    points = kdtree.counts_of(kdtree.letters(["banana", "zéàzzz"], 6))
    assert points.sum(1).tolist() == [6, 6] and points[0, 0] == 3 and points[1, 25] == 4
    assert np.bitwise_count(kdtree.marks_of(points)).tolist() == [5, 4]


def test_awkward_rows(spark):
    docs = awkward(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    for damaged in (0, 3):
        got = spelling.count_words(docs, min_length=2, min_count=1, damaged=damaged)
        assert {r.word: r.n for r in got.collect()} == counts(rows, damaged, 2, 1)
    assert spelling.variants(spelling.count_words(documents(spark, []))).collect() == []
    long = "q" * 5000
    words = {long: 50, long[:-1]: 10, long[:-1] + "x": 1, "single": 3}
    assert told(spelling.variants(spark.createDataFrame(list(words.items()), "word string, n long"))) == brute(words)


def test_chains_are_followed_to_the_end(spark):
    words = {"a" * 6 + "b" * k: 6**k for k in range(1, 12)}
    got = told(spelling.variants(spark.createDataFrame(list(words.items()), "word string, n long")))
    assert got == brute(words)
    assert {r[2] for r in got} == {"a" * 6 + "b" * 11}
