import numpy as np
from pyspark.sql import functions as F

from stockyard.llm import language
from stockyard.llm.queries import QUERIES

from .helpers import FOLDER, awkward, documents


def predictions(spark, train, docs):
    model = language.fit(train)
    got = docs.select("doc_id", language.identify(model, spark).alias("l")).select("doc_id", "l.*")
    return got.collect()


def test_codewords_differ():
    for n in (1, 2, 3, 4, 6, 7, 20, 100):
        code = language.codewords(n)
        assert code.shape[0] == n and len({tuple(r) for r in code}) == n
        if n > 3:
            apart = [(a != b).sum() for i, a in enumerate(code) for b in code[:i]]
            assert min(apart) >= 3


def test_bits_correct_errors():
    code = language.codewords(4)
    model = language.LanguageModel(list("abcd"), code, np.zeros((language.FEATURES, code.shape[1])), np.ones(code.shape[1]))
    margins = np.repeat(code[2:3].astype(float), code.shape[1], 0)
    margins[np.arange(code.shape[1]), np.arange(code.shape[1])] *= -1  # one wrong bit each
    best, share, _ = model.decode(margins, np.full(len(margins), 10))
    assert (best == 2).all() and (share > 0.25).all()


def test_held_out_accuracy(spark):
    got = QUERIES["op10_language_id"](spark, "/root/testdata/sf0.01")
    truth = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    right = got.where("held_out").join(truth, "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.97


def test_awkward_rows(spark):
    docs = awkward(spark)
    rows = predictions(spark, docs, docs)
    assert len(rows) == docs.count()
    by = {r.doc_id: r for r in rows}
    for i in (3, 4, 5, 7):
        assert (by[i].lang_pred, by[i].score, by[i].ambiguous) == ("und", 0.0, False)
    assert by[1].lang_pred == by[None].lang_pred == "en"
    assert all(0 <= r.score <= 1 for r in rows)


def test_nothing_to_learn_from(spark):
    docs = awkward(spark)
    assert {r.lang_pred for r in predictions(spark, docs.where("false"), docs)} == {"und"}
    assert predictions(spark, docs, docs.where("false")) == []


def test_ambiguous_is_flagged(spark):
    train = documents(spark, [(1, "aaa bbb aaa", "x", None), (2, "ccc ddd ccc", "y", None), (3, "eee fff eee", "z", None)])
    asked = documents(spark, [(1, "aaa bbb", None, None), (2, "qqq rrr", None, None)])
    by = {r.doc_id: r for r in predictions(spark, train, asked)}
    assert by[1].lang_pred == "x" and not by[1].ambiguous
    assert by[2].ambiguous


def test_every_language_is_learned(spark):
    def text(k, n):
        return " ".join(f"{chr(97 + k % 26)}{chr(97 + k // 26)}{c}" * 3 for c in "xyz"[:n])

    train = documents(spark, [(k, text(k, 3), f"l{k:03}", None) for k in range(300)])
    asked = documents(spark, [(k, text(k, 2), None, None) for k in range(300)])
    got = {r.doc_id: r.lang_pred for r in predictions(spark, train, asked)}
    assert sum(got[k] == f"l{k:03}" for k in range(300)) >= 295


def test_weights_equal_brute_force(spark):
    rows = [(1, "the cat and the dog", "en", None), (2, "der hund und die katze", "de", None), (3, "le chat et le chien", "fr", None)]
    rows += [(4, "the house", "en", None), (5, "", "xx", None), (6, None, "yy", None), (7, "ein Haus", "de", None)]
    model = language.fit(documents(spark, rows))
    assert model.languages == ["de", "en", "fr"]  # from empty texts there is nothing to learn
    counts = np.zeros((3, language.FEATURES))
    for _, text, lang, _ in rows:
        if text:
            data = np.frombuffer(text.encode(), np.uint8)
            grams, _ = language.trigrams(data, np.array([0, len(data)]))
            np.add.at(counts[model.languages.index(lang)], grams, 1)
    share = (counts + language.PRIOR) / (counts.sum(1) + language.PRIOR * language.FEATURES)[:, None]
    for b in range(model.code.shape[1]):
        one, rest = share[model.code[:, b] > 0], share[model.code[:, b] < 0]
        assert np.allclose(model.weights[:, b], np.log(one.mean(0)) - np.log(rest.mean(0)), atol=1e-5)
