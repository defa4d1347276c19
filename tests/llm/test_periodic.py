import hashlib
import random
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from stockyard.llm import periodic
from stockyard.llm.queries import QUERIES

from .helpers import FOLDER, WORD, awkward, documents


def brute(w):
    """Every stretch that keeps a period as far as it goes, by trying all periods; the smallest period of each."""
    n, out = len(w), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            length = i + q - s
            part = w[s : s + length]
            if length >= max(6, 4 * q) and not any(part[d:] == part[:-d] for d in range(1, q)):
                out.append((s, length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def found(texts):
    numbers, offsets = [], [0]
    for k, w in enumerate(texts):
        numbers += [k * 100 + v for v in w]
        offsets.append(len(numbers))
    of, *parts = periodic.find(np.array(numbers, np.int64), np.array(offsets, np.int64))
    rows = list(zip(of.tolist(), *(p.tolist() for p in parts), strict=True))
    return [[r[1:] for r in rows if r[0] == k] for k in range(len(texts))]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=50), max_size=4))
def test_runs_of_random_texts(texts):
    assert found(texts) == [brute(w) for w in texts]


def test_runs_of_periodic_texts():
    rng = random.Random(2)
    for _ in range(400):
        w = [rng.randrange(3) for _ in range(rng.randint(0, 20))]
        for _ in range(rng.randint(1, 3)):
            piece = [rng.randrange(rng.randint(1, 4)) for _ in range(rng.randint(1, 9))]
            w += (piece * 9)[: rng.randint(1, 9 * len(piece))] + [rng.randrange(4) for _ in range(rng.randint(0, 4))]
        assert found([w, w[::-1]]) == [brute(w), brute(w[::-1])]


def test_long_texts_of_one_word_and_of_many_lines():
    assert found([[7] * 30_000]) == [[(0, 30_000, 1)]]
    lines = [x for k in range(3000) for x in (1, 2, 3, 4, 5, 6, 7, 8, 9, 10 + k % 90)]
    assert found([lines]) == [[(0, 30_000, 900)]]


def digest(doc_id, text):
    """The contract's row, by trying all periods."""
    w = WORD.findall(text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(w)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute(w)
    drop = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None,) * 3)
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    kept = " ".join(x for i, x in enumerate(w) if i not in drop)
    milli = best[1] and 1000 * best[1] // best[2]
    return (doc_id, len(runs), *best, milli, *(hashlib.sha256(x.encode()).hexdigest() for x in (lines, kept)))


def test_query_equals_brute_force(spark):
    rows = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    got = sorted(tuple(r) for r in QUERIES["op13_periodic_runs"](spark, FOLDER).collect())
    assert got == sorted(digest(*r) for r in rows)
    assert sum(r[1] > 0 for r in got) > 5


def test_awkward_rows(spark):
    got = {}
    for r in periodic.periodic_runs(awkward(spark)).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert len(got[2]) == 2 and got[2][0] == got[2][1]
    assert [(r.n_words, r.runs, r.best, r.collapsed) for k in (3, 4, 5) for r in got[k]] == [(0, [], None, "")] * 3
    assert got[6][0].runs == [] and got[6][0].n_words == 90_000
    assert got[None][0].collapsed == "The cat sat on the mat"
    assert periodic.periodic_runs(documents(spark, [])).collect() == []
    row = periodic.periodic_runs(documents(spark, [(1, " ha" * 6 + "\tHa", None, None)])).first()
    assert [tuple(r) for r in row.runs] == [(0, 6, 1)] and tuple(row.best) == (0, 6, 1) and row.collapsed == "ha Ha"


def test_of_equal_exponents_the_first_wins():
    assert periodic.best_of([(0, 6, 1), (9, 12, 2), (30, 13, 2)]) == (30, 13, 2)
    assert periodic.best_of([(0, 8, 2), (0, 12, 3), (20, 8, 2)]) == (0, 8, 2)
    assert periodic.best_of([]) is None
