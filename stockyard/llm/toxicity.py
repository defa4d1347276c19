"""Toxicity scores from the nearest labelled examples.

Model, fitted on at most `per_class` labelled rows of either class (the ones whose ids
hash lowest; more are not needed for the words that mark toxic texts):

* Terms are words and word beginnings of four and five bytes. The vocabulary holds the
  `max_terms` terms that most significantly prefer toxic examples, by the z-score of
  the two document frequencies, among those that are `MIN_LIFT` times as frequent there.
* Examples are TF-IDF vectors over the vocabulary, of length one. They lie in an
  inverted index whose postings are cut into blocks of `BLOCK` examples, each with the
  greatest weight that it holds.

A text is a query: blocks are opened in the order of their upper bounds, the sum of
query weight times greatest weight, until no unopened block can reach the K-th best
cosine. The nearest K are therefore exact. They vote with weights that fall with
distance; a logistic curve over the vote and the amount of evidence, fitted on
examples that were left out of their own search, turns that into a probability. Texts
without any term get the smoothed rate of toxic ones among such examples.

Columns `neighbours` and `similarity` are the evidence: the nearest examples' ids and
the best cosine.

Defined results: null and empty texts are texts without terms. Labels that are null are
ignored; of several labels of one id the toxic one counts. Without labelled rows every
text scores 0.5 times the prior of none, that is 0. Repeated rows each get a result.
Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockyard.llm.kernels import SpanHasher, counted, lower_ascii, mix, runs, utf8, word_spans
from stockyard.session import store
from stockyard.shipping import ship_by_value

ship_by_value(__name__)

#: Bound of the sample of labelled rows, for each class.
PER_CLASS = 2500
MAX_TERMS = 1024
#: A term needs this z-score, so many toxic examples, and to be so many times as frequent in them.
MIN_Z, MIN_TOXIC, MIN_LIFT = 5.0, 3, 10.0
BLOCK = 64
NEAREST = 15
#: Blocks opened before there is a K-th best cosine to compare the others with.
FIRST_BLOCKS = 8
#: Distance added so that an equal example has a finite weight.
SOFTEN = 0.05
#: Examples that the curve is fitted on, at most.
CURVE = 1500

RESULT = "struct<score double, similarity double, neighbours array<bigint>>"
_PUNCTUATION = np.isin(np.arange(256), list(rb"""!"#$%&'()*+,-./:;<=>?@[\]^_`{|}~"""))


def terms(data: np.ndarray, offsets: np.ndarray, hasher: SpanHasher) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of a text, without punctuation at their ends, and of their beginnings; and the rows."""
    data = lower_ascii(data)
    starts, ends, rows = word_spans(data, offsets)
    for _ in range(3):
        ends = ends - (_PUNCTUATION[data[ends - 1]] & (ends - starts > 1))
        starts = starts + (_PUNCTUATION[data[np.minimum(starts, len(data) - 1)]] & (ends - starts > 1)) if len(data) else starts
    hasher.over(data)
    parts, of = [hasher.spans(starts, ends)], [rows]
    for size in (4, 5):
        long = ends - starts > size
        parts.append(mix(hasher.spans(starts[long], starts[long] + size) + np.uint64(size)))
        of.append(rows[long])
    return np.concatenate(parts), np.concatenate(of)


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Document frequencies of the terms among a task's examples, for each class."""
    hasher, gathered = SpanHasher(1), ([], [])
    for batch in batches:
        data, offsets = utf8(batch.column("text"))
        toxic = batch.column("toxic").to_numpy()
        for lo, hi in runs(offsets):
            found, rows = terms(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], hasher)
            order = np.lexsort((found, rows))
            found, rows = found[order], rows[order]
            first = np.concatenate([[True], (found[1:] != found[:-1]) | (rows[1:] != rows[:-1])])[: len(found)]
            found, labels = found[first], toxic[lo:hi][rows[first]]
            for label in (0, 1):
                gathered[label].append(found[labels == label])
    for label in (0, 1):
        if gathered[label]:
            keys, n = counted(np.concatenate(gathered[label]))
            yield pa.record_batch({"term": keys.view(np.int64), "toxic": np.full(len(keys), label, np.int32), "n": n})


def _vectors(batch_text: pa.Array, vocabulary: np.ndarray, idf: np.ndarray, hasher: SpanHasher):
    """Per row of an Arrow column: term indexes, weights of length one, and the length before."""
    data, offsets = utf8(batch_text)
    order = np.argsort(vocabulary)
    ordered = vocabulary[order]
    for lo, hi in runs(offsets):
        found, rows = terms(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], hasher)
        if len(ordered):
            at = np.minimum(np.searchsorted(ordered, found), len(ordered) - 1)
            known = ordered[at] == found
            keys = rows[known].astype(np.int64) * len(vocabulary) + order[at[known]]
        else:
            keys = np.zeros(0, np.int64)
        keys, tf = counted(keys)
        rows, index = np.divmod(keys, max(1, len(vocabulary)))
        weight = (1 + np.log(tf)) * idf[index] if len(keys) else np.zeros(0)
        length = np.sqrt(np.bincount(rows, weight * weight, hi - lo))
        bounds = np.searchsorted(rows, np.arange(hi - lo + 1))
        for row in range(hi - lo):
            a, b = bounds[row], bounds[row + 1]
            yield index[a:b], weight[a:b] / length[row] if a < b else weight[a:b], length[row]


@dataclass
class BlockMaxIndex:
    """Postings by term, cut at blocks of examples."""

    examples: np.ndarray  # posting: example, by term and then example
    weights: np.ndarray  # posting: weight
    cuts: np.ndarray  # terms x (blocks + 1): where a block's postings begin
    greatest: np.ndarray  # terms x blocks
    size: int

    @classmethod
    def build(cls, vectors: list[tuple[np.ndarray, np.ndarray]], terms_n: int) -> BlockMaxIndex:
        blocks = -(-len(vectors) // BLOCK)
        of = np.concatenate([np.full(len(i), n) for n, (i, _) in enumerate(vectors)] or [np.zeros(0, int)]).astype(np.int64)
        index = np.concatenate([i for i, _ in vectors] or [np.zeros(0, int)]).astype(np.int64)
        weights = np.concatenate([w for _, w in vectors] or [np.zeros(0)])
        order = np.lexsort((of, index))
        of, index, weights = of[order], index[order], weights[order]
        slot = index * blocks + of // BLOCK if len(of) else of
        edges = np.arange(terms_n)[:, None] * blocks + np.arange(blocks + 1)[None, :]
        greatest = np.zeros(terms_n * blocks)
        np.maximum.at(greatest, slot, weights)
        return cls(of, weights, np.searchsorted(slot, edges).astype(np.int32), greatest.reshape(terms_n, blocks), len(vectors))

    def nearest(self, index: np.ndarray, weights: np.ndarray, k: int, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The k examples of greatest cosine (above 0) and the cosines; ties to the smaller example.

        The most promising blocks are opened first; then all others whose bound
        reaches the k-th best found. No other block can hold one of the k best.
        """
        bounds = weights @ self.greatest[index]
        order = np.argsort(-bounds, kind="stable")
        cosines = np.zeros(self.size)
        opened = np.zeros(len(bounds), bool)
        turn = np.zeros(len(bounds), bool)
        turn[order[:FIRST_BLOCKS]] = True
        floor = 0.0
        while turn.any():
            for term, weight in zip(index, weights, strict=True):
                at = slice(self.cuts[term, 0], self.cuts[term, -1])
                examples = self.examples[at]
                inside = turn[examples // BLOCK]
                cosines[examples[inside]] += weight * self.weights[at][inside]
            opened |= turn
            if 0 <= without < self.size:
                cosines[without] = 0.0
            if len(cosines) >= k:
                floor = np.partition(cosines, len(cosines) - k)[len(cosines) - k]
            turn = ~opened & (bounds >= max(floor - 1e-12, 1e-300))
        found = np.flatnonzero((cosines > 0) & (cosines >= floor))
        best = np.lexsort((found, -cosines[found]))[:k]
        return found[best], cosines[found[best]]


@dataclass
class ToxicityModel:
    vocabulary: np.ndarray
    idf: np.ndarray
    index: tuple
    labels: np.ndarray
    ids: np.ndarray
    curve: np.ndarray
    without_terms: float


def _evidence(index: BlockMaxIndex, labels: np.ndarray, terms_of: np.ndarray, weights: np.ndarray, length: float, without: int = -1):
    found, cosines = index.nearest(terms_of, weights, NEAREST, without)
    pull = 1 / (1 - np.minimum(cosines, 1) + SOFTEN)
    vote = (pull @ labels[found] / pull.sum()) if len(found) else 0.0
    amount = np.log1p(length)
    return np.array([1.0, vote, amount, vote * amount]), found, cosines


def _logistic(x: np.ndarray, y: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Weighted logistic regression with a small penalty, by Newton's method."""
    beta = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (weights * (y - p)) - 0.01 * beta
        hessian = (x * (weights * p * (1 - p))[:, None]).T @ x + 0.01 * np.eye(len(beta))
        step = np.linalg.solve(hessian, gradient)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, max_terms: int = MAX_TERMS) -> ToxicityModel:
    """Learn from `labels` (doc_id, toxic) of `docs` (doc_id, text)."""
    marked = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(
        F.max(F.col("toxic").cast("int")).alias("toxic")
    )
    all_of = {r["toxic"]: r["count"] for r in marked.groupBy("toxic").count().collect()}  # two rows
    order = [F.xxhash64(F.lit(1), "doc_id"), F.col("doc_id")]
    sample = store(
        marked.where("toxic = 0").orderBy(*order).limit(per_class).unionByName(marked.where("toxic = 1").orderBy(*order).limit(per_class)),
        "toxicity-sample",
    )
    texts = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(sample), "doc_id")  # at most 2 * per_class ids
    texts = store(texts.dropDuplicates(["toxic", "text"]), "toxicity-examples")
    sizes = {r["toxic"]: r["count"] for r in texts.groupBy("toxic").count().collect()}
    clean_n, toxic_n = sizes.get(0, 0), sizes.get(1, 0)
    per_task = texts.select("text", "toxic").mapInArrow(_term_counts, "term long, toxic int, n long")
    sums = per_task.groupBy("term").agg(
        F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("in_toxic"),
        F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("in_clean"),
    )
    total = max(1, clean_n + toxic_n)
    p = (F.col("in_toxic") + F.col("in_clean")) / F.lit(total)
    spread = F.sqrt(p * (1 - p) * F.lit(1 / max(1, toxic_n) + 1 / max(1, clean_n)) + F.lit(1e-12))
    z = (F.col("in_toxic") / F.lit(max(1, toxic_n)) - F.col("in_clean") / F.lit(max(1, clean_n))) / spread
    lift = (F.col("in_toxic") / F.lit(max(1, toxic_n))) / ((F.col("in_clean") + F.lit(0.5)) / F.lit(max(1, clean_n)))
    chosen = sums.withColumn("z", z).where((F.col("z") >= MIN_Z) & (F.col("in_toxic") >= MIN_TOXIC) & (lift >= MIN_LIFT))
    chosen = chosen.orderBy(F.desc("z"), "term").limit(max_terms).toArrow()
    vocabulary = chosen["term"].to_numpy().view(np.uint64)
    df = chosen["in_toxic"].to_numpy() + chosen["in_clean"].to_numpy()
    idf = np.log((1 + total) / (1 + df)) + 1

    def examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = SpanHasher(1)
        for batch in batches:
            rows = list(_vectors(batch.column("text"), vocabulary, idf, hasher))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").cast(pa.int64()),
                    batch.column("toxic"),
                    pa.array([r[0].tolist() for r in rows], pa.list_(pa.int32())),
                    pa.array([r[1].tolist() for r in rows], pa.list_(pa.float64())),
                    pa.array([float(r[2]) for r in rows]),
                ],
                ["doc_id", "toxic", "terms", "weights", "length"],
            )

    got = texts.select("doc_id", "toxic", "text").mapInArrow(
        examples, "doc_id long, toxic int, terms array<int>, weights array<double>, length double"
    )
    rows = got.toArrow().to_pylist()  # at most 2 * per_class rows
    scale = {c: all_of.get(c, 0) / max(1, sizes.get(c, 0)) for c in (0, 1)}  # rows that an example stands for
    empty = [scale[r["toxic"]] * np.array([1, r["toxic"]]) for r in rows if not r["terms"]]
    none, none_toxic = np.sum(empty, axis=0) if empty else (0.0, 0.0)
    without_terms = float(none_toxic / (none + 1))
    rows = sorted((r for r in rows if r["terms"]), key=lambda r: (r["terms"][int(np.argmax(r["weights"]))], r["toxic"], r["doc_id"]))
    vectors = [(np.array(r["terms"]), np.array(r["weights"])) for r in rows]
    of_class = np.array([r["toxic"] for r in rows], float)
    index = BlockMaxIndex.build(vectors, len(vocabulary))
    curve = np.zeros(4)
    if rows:
        step = -(-len(rows) // CURVE)
        at = range(0, len(rows), step)
        x = np.array([_evidence(index, of_class, *vectors[n], rows[n]["length"], without=n)[0] for n in at])
        weights = np.array([scale[rows[n]["toxic"]] for n in at])
        curve = _logistic(x, of_class[list(at)], weights / weights.mean())
    ids = np.array([r["doc_id"] for r in rows], np.int64)
    return ToxicityModel(vocabulary, idf, tuple(vars(index).values()), of_class, ids, curve, without_terms)


def score(model: ToxicityModel, spark, text: str | Column = "text") -> Column:
    """A struct column of `score`, `similarity` and `neighbours` for a text column."""
    shared = spark.sparkContext.broadcast(tuple(vars(model).values()))

    @F.arrow_udf(RESULT)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model, hasher = ToxicityModel(*shared.value), SpanHasher(1)
        index = BlockMaxIndex(*model.index)
        for texts in batches:
            scores, best, neighbours = np.full(len(texts), model.without_terms), np.zeros(len(texts)), [[]] * len(texts)
            for n, (own, weights, length) in enumerate(_vectors(texts, model.vocabulary, model.idf, hasher)):
                if len(own) and index.size:
                    x, found, cosines = _evidence(index, model.labels, own, weights, length)
                    scores[n] = 1 / (1 + np.exp(-np.clip(x @ model.curve, -30, 30)))
                    best[n] = min(1.0, cosines[0]) if len(cosines) else 0.0
                    neighbours[n] = model.ids[found[:5]].tolist()
            yield pa.StructArray.from_arrays(
                [pa.array(scores), pa.array(best), pa.array(neighbours, pa.list_(pa.int64()))], ["score", "similarity", "neighbours"]
            )

    return run(F.col(text) if isinstance(text, str) else text)
