import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from stockyard.llm import ppm
from stockyard.llm.queries import QUERIES

from .helpers import FOLDER, awkward, documents, fold, lower, words


def symbols(text):
    return bytes([ppm.BEGIN]) * ppm.ORDER + lower(text).encode() + bytes([ppm.END])


class SlowModel:
    """The same trie, one symbol at a time."""

    def __init__(self, texts):
        self.counts = defaultdict(Counter)
        for text in texts:
            s = symbols(text)
            for at in range(ppm.ORDER, len(s)):
                for k in range(ppm.ORDER + 1):
                    self.counts[s[at - k : at]][s[at]] += 1

    def p(self, context, byte):
        seen = self.counts.get(context)
        if seen is None:
            return self.p(context[1:], byte) if context else ppm.UNIFORM
        total = sum(seen.values())
        if byte in seen:
            return (seen[byte] - 0.5) / total
        lower_p = (lambda b: self.p(context[1:], b)) if context else (lambda b: ppm.UNIFORM)
        return 0.5 * len(seen) / total * lower_p(byte) / max(1e-9, 1 - sum(lower_p(b) for b in seen))

    def log10(self, text):
        s = symbols(text)
        return sum(math.log10(self.p(s[at - ppm.ORDER : at], s[at])) for at in range(ppm.ORDER, len(s)))


def brute(train, rows):
    counts = Counter()
    for text in train:
        counts.update([*words(text), None])
    total, kinds = sum(counts.values()), len(counts)
    slow = SlowModel(train)
    out = {}
    for i, text in rows:
        tokens = [*words(text), None]
        base = sum(math.log10((counts[t] + 0.1) / (total + 0.1 * (kinds + 1))) for t in tokens)
        out[i] = (len(tokens), sum(counts[t] > 0 for t in tokens), total, base, slow.log10(text))
    return out


def check(got, wanted):
    assert len(got) == len(wanted)
    for r in got:
        tokens, known, total, base, score = wanted[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (tokens, known, total)
        assert r.base_score == pytest.approx(base, rel=1e-9, abs=1e-9)
        assert r.score == pytest.approx(score, rel=1e-4, abs=1e-4)


def some(spark, n=40):
    rows = spark.read.parquet(f"{FOLDER}/documents.parquet").orderBy(F.length("text")).limit(n).select("doc_id", "text").collect()
    return [(r.doc_id, r.text) for r in rows]


def test_against_the_slow_model(spark):
    rows = some(spark)
    docs = documents(spark, [(i, t, "en", "a") for i, t in rows])
    model, counts = ppm.fit(docs.where("doc_id % 10 <> 0"))
    check(ppm.score(docs, model, counts).collect(), brute([t for i, t in rows if i % 10], rows))


def test_rare_words_are_joined(spark):
    rows = some(spark)
    docs = documents(spark, [(i, t, "en", "a") for i, t in rows])
    model, counts = ppm.fit(docs.where("doc_id % 10 <> 0"), max_words=5)
    assert len(model.word_counts) <= 5
    check(ppm.score(docs, model, counts).collect(), brute([t for i, t in rows if i % 10], rows))


@pytest.mark.parametrize("most", [0, 50, 3000])
def test_rare_nodes_are_joined(spark, most):
    rows = [*some(spark), (1001, "qzqz unseen ~~ Ω xjxj"), (1002, ""), (1003, None)]
    docs = documents(spark, [(i, t, "en", "a") for i, t in rows])
    train = docs.where("doc_id % 10 <> 0 and doc_id < 1000")
    model, counts = ppm.fit(train, max_nodes=most)
    assert len(model.top_log_p) <= most
    check(ppm.score(docs, model, counts).collect(), brute([t for i, t in rows if i % 10 and i < 1000], rows))


def test_distribution_sums_to_one_even_when_pruned(spark):
    rows = some(spark, 15)
    docs = documents(spark, [(i, t, "en", "a") for i, t in rows])
    for nodes in (ppm.MAX_NODES, 500):
        model, _ = ppm.fit(docs, max_nodes=nodes)
        assert len(model.log_p) <= nodes
        scorer = ppm.Scorer(model)
        for context in (b"the ", b"qqqqqq", rows[3][1].encode()[:6], bytes([ppm.BEGIN] * 6)):
            context = (bytes([ppm.BEGIN] * 6) + lower(context.decode("latin1")).encode("latin1"))[-ppm.ORDER :]
            high = sum(b << (8 * (k + 1)) for k, b in enumerate(reversed(context)))
            codes = np.array([high + b for b in range(256)], np.uint64)
            assert np.exp(scorer.log_probabilities(codes)).sum() == pytest.approx(1, abs=1e-4)


def test_held_out_beats_the_base(spark):
    got = QUERIES["op7_lm_score"](spark, "/root/testdata/sf0.01")
    r = got.where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert r.s > r.b
    ids = {r.doc_id for r in got.where("held_out").collect()}
    assert ids == {i for i in range(1000) if fold(i, 10) == 0}


def test_awkward_rows(spark):
    docs = awkward(spark)
    model, counts = ppm.fit(docs)
    rows = ppm.score(docs, model, counts).collect()
    assert len(rows) == 12
    by = {r.doc_id: r for r in rows}
    assert by[3].n_tokens == by[4].n_tokens == by[5].n_tokens == 1
    assert by[6].n_tokens == 90_001 and all(math.isfinite(r.score) and r.score <= 0 for r in rows)
    assert ppm.score(docs.where("false"), model, counts).collect() == []
    model, counts = ppm.fit(docs.where("false"))
    rows = {r.doc_id: r for r in ppm.score(docs, model, counts).collect()}
    assert rows[9].score == pytest.approx(2 * math.log10(ppm.UNIFORM)) and rows[9].n_known == 0 and rows[9].train_tokens == 0
