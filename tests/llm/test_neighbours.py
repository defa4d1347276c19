import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from stockyard.llm import neighbours

SCHEMA = "vec_id long, embedding array<float>, score double, rank string"


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0.0, "x") for i, v in rows], SCHEMA).repartition(3)


def brute(rows, queries, k):
    sound = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v):
            sound.setdefault(i, np.asarray(v, np.float32).astype(float))
    out = {}
    for q in sound:
        if queries(q):
            scored = sorted((-sum(sound[q] * x), i) for i, x in sound.items() if i != q)
            out[q] = [(i, -s) for s, i in scored[:k]]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def recall(got, wanted):
    return np.mean([len({i for i, _ in got.get(q, [])} & {i for i, _ in w}) / max(1, len(w)) for q, w in wanted.items()])


def test_rotation_keeps_lengths():
    x = np.random.default_rng(0).normal(size=(5, 64))
    turned = neighbours.rotate(x, neighbours.signs_of(1, 64)[0])
    assert np.allclose(turned @ turned.T, x @ x.T)


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_on_given_vectors(spark, sf):
    df = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    wanted = brute(rows, lambda i: i % 20 == 0, 20)
    got = found(neighbours.nearest(df, F.col("vec_id") % 20 == 0))
    assert got.keys() == wanted.keys() and all(len(got[q]) == len(wanted[q]) for q in wanted)
    assert recall(got, wanted) >= 0.9
    for q, hits in got.items():
        true = dict(wanted[q])
        assert all(abs(true[i] - s) < 1e-12 for i, s in hits if i in true)
        assert hits == sorted(hits, key=lambda h: (-h[1], h[0]))


def test_lengths_differ(spark):
    rng = np.random.default_rng(4)
    rows = [(i, v) for i, v in enumerate(rng.normal(size=(1500, 24)) * rng.uniform(0.2, 3, (1500, 1)))]
    wanted = brute(rows, lambda i: i % 20 == 0, 20)
    assert recall(found(neighbours.nearest(table(spark, rows), F.col("vec_id") % 20 == 0)), wanted) >= 0.9


def test_ties_and_hot_vector(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "PART", 50)
    rng = np.random.default_rng(5)
    rows = [(i, [1.0] * 8 if i % 2 else rng.normal(size=8)) for i in range(600)]
    wanted = brute(rows, lambda i: i % 20 == 1, 20)
    got = found(neighbours.nearest(table(spark, rows), F.col("vec_id") % 20 == 1))
    for q in wanted:
        assert [i for i, _ in got[q]] == [i for i, _ in wanted[q]] or recall({q: got[q]}, {q: wanted[q]}) > 0.8
        ties = [i for i, s in got[q] if s == got[q][0][1]]
        assert ties == sorted(ties)


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1, 0, 0]), (20, [0, 1, 0]), (1, [1, 1, 0]), (2, None), (3, [0, 0, 0]), (4, [nan, 1, 0]), (5, [inf, 0, 1]),
            (6, [None, 1, 1]), (7, [1, 2]), (8, [-1, 0, 0]), (9, [1, 1, 0]), (9, [1, 1, 0]), (None, [1, 0, 0]), (40, None), (60, [])]
    wanted = brute([r for r in rows if r[1] is None or len(r[1]) == 3], lambda i: i % 20 == 0, 20)
    got = found(neighbours.nearest(table(spark, rows), F.col("vec_id") % 20 == 0))
    assert got == wanted  # fewer than 20 candidates: all of them
    empty = neighbours.nearest(table(spark, rows).where("false"), F.col("vec_id") % 20 == 0)
    assert empty.collect() == [] and empty.columns == ["query_id", "rank", "vec_id", "score"]


@pytest.mark.parametrize("equal", [True, False])
def test_a_repeated_id_takes_one_place(spark, monkeypatch, equal):
    monkeypatch.setattr(neighbours, "PART", 100)
    rng = np.random.default_rng(7)
    near = rng.normal(size=8)
    rows = [(i, near + rng.normal(size=8) * 0.3 if i % 10 == 0 else rng.normal(size=8)) for i in range(500)]
    # The id 10 stands at the queries 30 times, with one vector or with as many.
    rows += [(10, rows[10][1] if equal else near * (1.5 + n / 100)) for n in range(30)]
    rows = [(i, np.asarray(v, np.float32).astype(float)) for i, v in rows]
    wanted = {}
    for q in range(0, 500, 20):
        best = {}
        for i, v in rows:
            if i != q:
                best[i] = max(best.get(i, -math.inf), float(neighbours.inner_products(rows[q][1][None], v[None])[0, 0]))
        wanted[q] = sorted(best.items(), key=lambda h: (-h[1], h[0]))[:20]
    got = found(neighbours.nearest(table(spark, rows), F.col("vec_id") % 20 == 0))
    assert got.keys() == wanted.keys()
    for hits in got.values():
        assert len({i for i, _ in hits}) == len(hits) == 20
    assert recall(got, wanted) >= 0.9
    scores = np.array([[s for _, s in hits] for hits in got.values()])
    assert (scores <= np.array([[s for _, s in wanted[q]] for q in got]) + 1e-12).all()


def test_best_of_a_part_counts_ids():
    ids, x = np.array([1] * 30 + list(range(2, 40))), np.array([[9.0 + n] for n in range(30)] + [[8.0 - n / 10] for n in range(38)])
    (got,) = neighbours._best(np.array([0]), np.array([[1.0]]), ids, x, 20)
    assert got.column("vec_id").to_pylist() == list(range(1, 21)) and got.column("score")[0].as_py() == 38.0
