import random

import numpy as np
from pyspark.sql import functions as F

from stockyard.llm import toxicity
from stockyard.llm.queries import QUERIES

from .helpers import awkward, documents


def test_search_is_exact():
    rng = np.random.default_rng(1)
    vectors = []
    for _ in range(700):
        index = np.sort(rng.choice(40, rng.integers(1, 8), replace=False))
        weights = rng.integers(1, 5, len(index)).astype(float)
        vectors.append((index, weights / np.linalg.norm(weights)))
    index = toxicity.BlockMaxIndex.build(vectors, 40)
    dense = np.zeros((700, 40))
    for n, (i, w) in enumerate(vectors):
        dense[n, i] = w
    for n in range(0, 700, 7):
        got, cosines = index.nearest(*vectors[n], 15, without=n)
        all_of = dense @ dense[n]
        all_of[n] = -1
        wanted = np.sort(all_of[all_of > 0])[::-1][:15]
        assert np.allclose(cosines, wanted) and np.allclose(all_of[got], cosines)


def corpus(spark, n=300):
    rng = random.Random(2)
    rows, marks = [], []
    for i in range(n):
        words = [f"w{rng.randrange(400)}" for _ in range(60)]
        toxic = i % 6 == 0
        if toxic:
            for _ in range(3):
                words[rng.randrange(60)] = rng.choice(["Vilest", "vileness!", "horrid", "(nasty)"])
        rows.append((i, " ".join(words), "en", "a"))
        marks.append((i, int(toxic)))
    return documents(spark, rows), spark.createDataFrame(marks, "doc_id long, toxic int")


def test_finds_planted_words(spark):
    docs, labels = corpus(spark)
    model = toxicity.fit(docs, labels.where("doc_id % 5 <> 0"))
    got = docs.select("doc_id", toxicity.score(model, spark).alias("t")).join(labels, "doc_id").where("doc_id % 5 = 0")
    assert got.where((F.col("t.score") >= 0.5) != (F.col("toxic") == 1)).count() == 0
    shown = got.where("toxic = 1").select("t.neighbours", "t.similarity").first()
    assert shown.neighbours and all(n % 6 == 0 for n in shown.neighbours) and 0 < shown.similarity <= 1


def test_held_out(spark):
    got = QUERIES["op1_toxicity"](spark, "/root/testdata/sf0.1")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").where("toxic is not null")
    rows = got.where("held_out").join(labels.select("doc_id", "toxic"), "doc_id").collect()
    toxic, clean = [r for r in rows if r.toxic], [r for r in rows if not r.toxic]
    # Some labels are noise: toxic ones on texts without any word that others share with toxic texts.
    assert sum(r.predicted for r in toxic) >= 0.9 * len(toxic)
    assert sum(r.predicted for r in clean) <= 0.01 * len(clean)


def test_awkward_rows(spark):
    docs, labels = corpus(spark)
    model = toxicity.fit(docs, labels)
    rows = awkward(spark).select("doc_id", toxicity.score(model, spark).alias("t")).collect()
    assert len(rows) == 12 and all(0 <= r.t.score < 0.5 for r in rows)
    none = toxicity.fit(docs, labels.where("false"))
    assert {r.t.score for r in docs.select(toxicity.score(none, spark).alias("t")).collect()} == {0.0}
    assert awkward(spark).where("false").select(toxicity.score(model, spark).alias("t")).collect() == []
    one = toxicity.fit(docs, labels.where("toxic = 1"))
    assert all(0 <= r.t.score <= 1 for r in docs.select(toxicity.score(one, spark).alias("t")).collect())
    many = labels.unionByName(labels).unionByName(spark.createDataFrame([(None, 1), (4, None), (99999, 1)], "doc_id long, toxic int"))
    again = toxicity.fit(docs.unionByName(docs.limit(5)), many)
    assert again.ids.tolist() == model.ids.tolist()
