"""Language identification by error-correcting output codes.

Every language has a binary codeword. Each bit is predicted by one binary
classifier over hashed byte trigrams (lower-cased A-Z, a space at either end),
a log-odds classifier between the languages whose codeword has the bit and those
that lack it. The margins of the bits are decoded by the language whose codeword
has the least weighted loss; a text whose two nearest codewords lie close
together is flagged as ambiguous.

Training counts trigrams per language over all labelled rows, summed in the tasks
before they are shuffled. Every value of the language column is learned; the driver sees
their names and totals, and a number per trigram and bit.

Defined results: a text that is null or has no letter gives `und`, score 0, not
ambiguous. Without any labelled row every text gives `und`. Rows without a
language are not learned from. Repeated rows each count and each get a result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockyard.llm.kernels import lean, lower_ascii, row_of, runs, utf8
from stockyard.operators.sizing import is_small
from stockyard.session import store
from stockyard.shipping import ship_by_value

ship_by_value(__name__)

UNKNOWN = "und"
FEATURE_BITS = 15
FEATURES = 1 << FEATURE_BITS
#: Up to so many languages the distances of their codewords are compared.
CLOSE = 4096
#: Pseudo-count of every trigram in every language.
PRIOR = 0.5
#: Evidence of a text counts as that of so many trigrams at most, when turned into a score.
EVIDENCE = 40.0
#: A text is ambiguous when its best language scores below this.
CLEAR = 0.6

RESULT = "struct<lang_pred string, score double, ambiguous boolean, runner_up string>"


def trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigrams and their rows; each text is put between spaces."""
    lengths = np.diff(offsets)
    at = offsets[:-1] + np.arange(len(lengths)) * 2
    padded = np.full(len(data) + 2 * len(lengths), 32, np.uint8)
    inside = np.ones(len(padded), bool)
    inside[at] = False
    inside[at + lengths + 1] = False
    padded[inside] = lower_ascii(data)
    wide = padded.astype(np.uint32)
    codes = (wide[:-2] << np.uint32(16)) | (wide[1:-1] << np.uint32(8)) | wide[2:] if len(padded) > 2 else wide[:0]
    starts = np.arange(len(codes))
    bounds = np.append(at, len(padded))
    rows = row_of(bounds, starts)
    whole = starts + 2 < bounds[rows + 1]
    return ((codes[whole] * np.uint32(0x9E3779B1)) >> np.uint32(32 - FEATURE_BITS)).astype(np.int64), rows[whole]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        data, offsets = utf8(batch.column("text"))
        langs = batch.column("lang").dictionary_encode()
        names, codes = langs.dictionary.to_pylist(), langs.indices.to_numpy()
        for lo, hi in runs(offsets):
            grams, rows = trigrams(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            of = codes[lo:hi][rows]
            for k in np.unique(codes[lo:hi]):
                got = np.bincount(grams[of == k], minlength=FEATURES)
                sums[names[k]] = sums[names[k]] + got if names[k] in sums else got
    for name, got in sums.items():
        at = np.flatnonzero(got)
        yield pa.record_batch(
            {"lang": pa.array([name] * len(at), pa.string()), "feature": at.astype(np.int32), "n": got[at].astype(np.int64)}
        )


def codewords(languages: int) -> np.ndarray:
    """Codewords of +1 and -1, a row per language, no two bits equal or opposite.

    Up to six languages use every way of splitting them in two; beyond that the
    best of several fixed random codes, by the least distance between two rows.
    """
    if languages <= 6:
        splits = range(1, 1 << max(languages - 1, 1))
        return np.array([[1 if s >> k & 1 else -1 for s in splits] for k in range(languages)], np.int8).reshape(languages, -1)
    bits = 4 * int(np.ceil(np.log2(languages))) + 8
    rng = np.random.default_rng(languages)
    best, reach, draws = None, 0, 0
    while best is None or draws < 64:  # until all codewords differ
        code, draws = rng.choice(np.array([-1, 1], np.int8), (languages, bits)), draws + 1
        if languages > CLOSE:  # the distances of all pairs would be too many
            if len(np.unique(code, axis=0)) == languages:
                return code
            continue
        apart = (bits - code.astype(int) @ code.T) // 2 + bits * np.eye(languages, dtype=int)
        if apart.min() > reach and (np.abs(code.sum(0)) < languages).all():
            best, reach = code, apart.min()
    return best


@dataclass
class LanguageModel:
    languages: list[str]
    code: np.ndarray  # languages x bits
    weights: np.ndarray  # features x bits
    loss_weights: np.ndarray  # of the bits

    def margins(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Mean log-odds per trigram of every bit, and the number of trigrams."""
        grams, rows = trigrams(data, offsets)
        n = np.bincount(rows, minlength=len(offsets) - 1)
        heads = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]])) if len(rows) else np.zeros(0, int)
        out = np.zeros((len(n), self.code.shape[1]))
        if len(rows):
            out[rows[heads]] = np.add.reduceat(self.weights[grams], heads, axis=0, dtype=np.float64)
        return out / np.maximum(n, 1)[:, None], n

    def decode(self, margins: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nearest codeword, its share among all, and the next one.

        The loss of a bit is log(1 + exp(-margin)) for the log-odds that the text holds.
        """
        odds = margins * np.minimum(n, EVIDENCE)[:, None]
        loss = np.zeros((len(n), len(self.languages)))
        for k, word in enumerate(self.code):
            loss[:, k] = (np.logaddexp(0.0, -odds * word) * self.loss_weights).sum(1)
        order = np.argsort(loss, axis=1, kind="stable")
        share = np.exp(loss.min(1)[:, None] - loss)
        share /= share.sum(1)[:, None]
        best = order[:, 0]
        return best, share[np.arange(len(n)), best], order[:, 1] if len(self.languages) > 1 else best


def fit(labelled: DataFrame) -> LanguageModel:
    """Learn from the columns `text` and `lang` of all rows where neither is null.

    A bit's classifier compares the mean shares of a trigram in the languages of either
    side. These are sums of Spark's; the driver holds one number per trigram and bit, and
    the names of the languages.
    """
    spark = labelled.sparkSession
    rows = labelled.select("text", "lang").where("text is not null and lang is not null")
    per_task = rows.mapInArrow(lean(_counts), "lang string, feature int, n long")
    table = store(per_task.groupBy("lang", "feature").agg(F.sum("n").alias("n")), "language-counts")
    totals = sorted(table.groupBy("lang").agg(F.sum("n")).collect())
    languages = [name for name, _ in totals]
    if not languages:
        return LanguageModel([], np.zeros((0, 1), np.int8), np.zeros((FEATURES, 1), np.float32), np.ones(1))
    whole = np.array([n for _, n in totals]) + PRIOR * FEATURES
    code = codewords(len(languages))
    bits = code.shape[1]
    named = [(name, float(1 / w), [bool(c > 0) for c in word]) for name, w, word in zip(languages, whole, code, strict=True)]
    coded = store(spark.createDataFrame(named, "lang string, scale double, one array<boolean>"), "language-codes")
    shares = table.join(F.broadcast(coded) if is_small(coded) else coded, "lang").withColumn("share", F.col("n") * F.col("scale"))
    sides = [F.sum(F.when(F.col("one")[b], F.col("share")).otherwise(0.0)).alias(f"one{b}") for b in range(bits)]
    got = shares.groupBy("feature").agg(F.sum("share").alias("all"), *sides).toArrow()  # at most FEATURES rows
    at = got.column("feature").to_numpy()
    sums = np.zeros((bits + 1, FEATURES))
    for k, name in enumerate([*(f"one{b}" for b in range(bits)), "all"]):
        sums[k, at] = got.column(name).to_numpy()
    prior, ones = PRIOR / whole, code > 0
    weights, apart = np.zeros((FEATURES, bits), np.float32), np.zeros(bits)
    for b in range(bits):
        on = int(ones[:, b].sum())
        if 0 < on < len(languages):
            one = (sums[b] + prior[ones[:, b]].sum()) / on
            rest = (sums[bits] - sums[b]).clip(0) + prior[~ones[:, b]].sum()
            weights[:, b] = np.log(one) - np.log(rest / (len(languages) - on))
            # A bit counts by how far its classifier tells its two sides apart.
            apart[b] = abs(np.average(weights[:, b], weights=one))
    loss_weights = apart / apart.sum() * bits if apart.sum() > 0 else np.ones(bits)
    return LanguageModel(languages, code, weights, loss_weights)


def identify(model: LanguageModel, spark, text: str | Column = "text") -> Column:
    """A struct column of `lang_pred`, `score`, `ambiguous` and `runner_up` for a text column."""
    shared = spark.sparkContext.broadcast((model.languages, model.code, model.weights, model.loss_weights))

    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = LanguageModel(*shared.value)
        names = pa.array([*model.languages, UNKNOWN], pa.string())
        for texts in batches:
            data, offsets = utf8(texts)
            best = np.full(len(texts), len(model.languages), np.int64)
            second, score = best.copy(), np.zeros(len(texts))
            if model.languages:
                for lo, hi in runs(offsets):
                    margins, n = model.margins(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                    best[lo:hi], score[lo:hi], second[lo:hi] = model.decode(margins, n)
            yield pa.StructArray.from_arrays(
                [names.take(pa.array(best)), pa.array(score), pa.array(score < CLEAR), names.take(pa.array(second))],
                ["lang_pred", "score", "ambiguous", "runner_up"],
            )

    predicted = F.arrow_udf(lean(predict), RESULT)
    column = F.col(text) if isinstance(text, str) else text
    none = F.struct(
        F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(False).alias("ambiguous"), F.lit(UNKNOWN).alias("runner_up")
    )
    return F.when(column.isNotNull() & column.rlike(r"\p{L}"), predicted(column)).otherwise(none)
