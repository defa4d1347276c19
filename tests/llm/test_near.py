import random

import numpy as np
import pyarrow as pa

from stockyard.llm import near
from stockyard.llm.components import components
from stockyard.llm.kernels import SpanHasher, utf8
from stockyard.llm.queries import QUERIES
from stockyard.session import store

from .helpers import FOLDER, awkward, documents, words


def shingles(text, width):
    w = words(text)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) or frozenset([tuple(w)])


def brute(rows, width, percent=80):
    sets = [(i, shingles(t, width)) for i, t in rows]
    parent = {i: i for i, _ in sets}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    by_size = sorted((s for s in sets if s[1]), key=lambda s: len(s[1]))
    for n, (a, x) in enumerate(by_size):
        for b, y in by_size[n + 1 :]:
            if len(x) * 100 < len(y) * percent:
                break
            both = len(x & y)
            if both * 100 >= (len(x) + len(y) - both) * percent:
                ra, rb = top(a), top(b)
                parent[max(ra, rb)] = min(ra, rb)
    return sorted((i, len(s), top(i), top(i) == i) for i, s in sets)


def check(docs, width=4):
    got = near.members(docs, width).select("doc_id", "n_shingles", "component_id", "kept").collect()
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(map(tuple, got)) == brute(rows, width)


def variants(n, base_words, change, seed):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(5000)}" for _ in range(base_words)]
    out = []
    for _ in range(n):
        text = list(base)
        for _ in range(rng.randrange(change + 1)):
            text[rng.randrange(base_words)] = f"v{rng.randrange(10**6)}"
        out.append(" ".join(text))
    return out


def test_given_documents(spark):
    check(spark.read.parquet(f"{FOLDER}/documents.parquet"))


def test_groups_around_the_threshold(spark):
    texts = [t for s in range(6) for t in variants(25, 100, 5, s)] + variants(10, 12, 1, 77)
    random.Random(1).shuffle(texts)
    check(documents(spark, [(i, t, "en", "a") for i, t in enumerate(texts)]))
    check(documents(spark, [(i, t, "en", "a") for i, t in enumerate(texts)]), width=5)


def test_chain_of_copies(spark):
    rng = random.Random(3)
    chain = [[f"c{n}" for n in range(60)]]
    for _ in range(40):
        after = list(chain[-1])
        after[rng.randrange(60)] = f"d{rng.randrange(10**6)}"
        chain.append(after)
    check(documents(spark, [(i, " ".join(c), "en", "a") for i, c in enumerate(chain)]))


def test_many_unlinked_variants_of_one_text(spark):
    """Buckets full of texts around the threshold: the exact way for the rest finds every link."""
    texts = [t for seed in (1, 2) for t in variants(120, 60, 9, seed)]
    texts += [" ".join(t.split()[:50] + [f"z{i}{k}" for k in range(10)]) for i, t in enumerate(texts[:60])]
    check(documents(spark, [(i, t, "en", "a") for i, t in enumerate(texts)]))


def test_nodes_with_a_link_are_not_held_against_the_rest_of_a_component(spark, monkeypatch):
    """Nodes beside a large component: the pairs do not grow with the product of their numbers, and no link is lost."""
    texts = variants(400, 100, 3, 4) + [t for seed in (8, 9) for t in variants(5, 100, 9, seed)]
    docs = documents(spark, [(i, t, "en", "a") for i, t in enumerate(texts)])
    sets = store(docs.select("doc_id", "text").mapInArrow(near._sets(4), near._SETS))
    inner = 360
    nodes = sets.selectExpr("doc_id AS node", "CAST(size(shingles) AS LONG) AS n", f"IF(doc_id < {inner}, 0, doc_id) AS component")
    held, linked = [], near._linked

    def counting(pairs, *others):
        held.append(pairs.count())
        return linked(pairs, *others)

    monkeypatch.setattr(near, "_linked", counting)
    found = near._links_across(store(nodes), sets, 80).collect()
    known = spark.createDataFrame([(0, i) for i in range(1, inner)] + [(r.a, r.b) for r in found], "a long, b long")
    got = {r.node: r.component for r in components(known).collect()}
    kept = [shingles(t, 4) for t in texts]
    wanted = {i: [j for j in range(len(texts)) if j != i and 100 * len(kept[i] & kept[j]) >= 80 * len(kept[i] | kept[j])] for i in range(inner, len(texts))}
    assert all(got.get(i, i) == got.get(j, j) for i, near_i in wanted.items() for j in near_i)
    assert all(100 * len(kept[r.a] & kept[r.b]) >= 80 * len(kept[r.a] | kept[r.b]) for r in found)
    links = sum(j < inner for near_i in wanted.values() for j in near_i)
    assert links > 1000 and sum(held) < links / 4


def test_awkward_rows(spark):
    docs = awkward(spark).where("doc_id is not null").distinct()
    check(docs)
    rows = near.members(awkward(spark), 4).collect()
    assert len(rows) == 12
    assert [(r.component_id, r.kept) for r in rows if r.doc_id is None] == [(None, False)]
    assert all(r.component_id == 1 for r in rows if r.doc_id in (1, 2))
    assert near.members(awkward(spark).where("false")).collect() == []


def test_every_coordinate_fills():
    hasher = SpanHasher(1)
    texts = ["", "one", "one two three", " ".join(f"t{i}" for i in range(3000))]
    data, offsets = utf8(pa.array(texts))
    counts, values = near.shingle_sets(data, offsets, 4, hasher)
    grid = near.sketch(counts, values, 160)
    assert counts.tolist() == [0, 1, 1, 2997]
    assert (grid[0] == near._EMPTY).all() and (grid[1:] != near._EMPTY).all()
    assert ((grid[1:] >> np.uint64(32)) < 320).all()


def test_sketch_estimates_similarity():
    rng = np.random.default_rng(0)
    common, own = rng.integers(0, 2**63, 800, dtype=np.uint64), rng.integers(0, 2**63, 400, dtype=np.uint64)
    a, b = np.sort(np.concatenate([common, own[:200]])), np.sort(np.concatenate([common, own[200:]]))
    grid = near.sketch(np.array([1000, 1000]), np.concatenate([a, b]), 2000)
    assert abs((grid[0] == grid[1]).mean() - 800 / 1200) < 0.04


def test_components(spark):
    rng = random.Random(5)
    pairs = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 160)] + [(200, 200)]
    rng.shuffle(pairs)
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 160)}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_query(spark):
    rows = QUERIES["op9_near_dedup"](spark, FOLDER).collect()
    assert len(rows) == 200 and all(r.kept == (r.doc_id == r.component_id) for r in rows)


def test_bitmaps_never_differ_more_than_sets():
    rng = np.random.default_rng(6)
    pool = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    sets = [np.sort(rng.choice(pool, n, replace=False)) for n in (0, 1, 5, 100, 100, 300, 390)]
    bits = near.bitmaps(np.array([len(x) for x in sets]), np.concatenate(sets))
    for a, x in zip(sets, bits, strict=True):
        assert np.bitwise_count(x).sum() <= len(a)
        for b, y in zip(sets, bits, strict=True):
            assert np.bitwise_count(x ^ y).sum() <= len(np.setxor1d(a, b))
