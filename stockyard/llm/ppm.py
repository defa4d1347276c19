"""Language-model scores by prediction by partial matching over bytes, and a word baseline.

The model is a trie of byte contexts up to `ORDER` bytes with the counts of the bytes
that follow. A byte seen after a context has the probability (count - 1/2) / total; the
rest of the mass, half a count for each kind of byte seen, is the escape to the context
without its furthest byte, where bytes already seen in the longer context are excluded,
so that the escape is shared among the others only. A text's code length is the sum over its bytes and an end mark,
each predicted from the bytes before it in the same text; the trie is pretrained and
does not change while it scores.

1. Every task counts the windows of `ORDER` + 1 bytes and the words of its training
   texts; the sums are shuffled by window and by word.
2. Counts of shorter contexts are sums of these. If there are at most `max_nodes` nodes
   they go to every task as one table. Otherwise probabilities and escapes of all nodes
   are a stored table: nodes that share all but their first and last byte are dealt to
   one task, which has all counts they need. The `max_nodes` most frequent windows go to
   every task, other windows of the texts are shuffled and meet the stored table, first
   the windows seen in training, then the shorter contexts of the rest. Both ways give
   the same sums.
3. Words: the `max_words` most frequent ones go to every task; occurrences of others
   are shuffled by word and meet their counts there. Both ways give the same sums.

Defined results: A-Z are lower-cased; null counts as empty, and an empty text has one
token, the end. Rows without a doc_id belong to the training rows. Without training
rows all probabilities come from the uniform distribution. Repeated rows each count
and each get a result. Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockyard.llm.kernels import HashTable, SpanHasher, counted, lower_ascii, mix, runs, utf8, word_spans
from stockyard.session import store
from stockyard.shipping import ship_by_value

ship_by_value(__name__)

ORDER = 6
BEGIN, END = 0xFF, 0xFE  # bytes that UTF-8 never has
UNIFORM = 1 / 256
TAG = 56  # a node's key holds its order above its bytes
MAX_NODES = 1 << 21
MAX_WORDS = 1 << 18
#: Distinct windows and words that a task gathers before it hands them on.
HELD = 1_000_000
#: Windows whose code length a task remembers, by their hash.
MEMORY_BITS = 20
#: Windows looked up, and rows to be joined handed on, at a time.
LOOKED_UP = 1 << 17

#: Tells the key of a context from that of a node.
CONTEXT = 1 << 60

_EXACT = "key long, n long, value float"
_COUNTS = "kind byte, key long, n long"
_SCORES = "row long, doc_id long, score double, base double, n_tokens long, n_known long, word long, code long, n long"


def mask(order: int) -> int:
    return (1 << (8 * (order + 1))) - 1


def windows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every byte and end mark: it and the `ORDER` bytes before it, nearest lowest, and its row."""
    lengths = np.diff(offsets)
    heads = offsets[:-1] + np.arange(len(lengths)) * (ORDER + 1)
    padded = np.full(len(data) + len(lengths) * (ORDER + 1), BEGIN, np.uint8)
    of = np.repeat(np.arange(len(lengths)), lengths)
    padded[np.arange(len(data)) + of * (ORDER + 1) + ORDER] = np.minimum(data, END - 1)
    padded[heads + lengths + ORDER] = END
    codes = np.zeros(len(padded) - ORDER if len(padded) else 0, np.uint64)
    for back in range(ORDER + 1):
        codes |= padded[ORDER - back : len(padded) - back].astype(np.uint64) << np.uint64(8 * back)
    real = padded[ORDER:] != BEGIN
    rows = np.repeat(np.arange(len(lengths)), lengths + 1)
    return codes[real], rows


class Gathered:
    """Counts of keys that come in chunks."""

    def __init__(self):
        self.keys, self.counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]

    def add(self, keys: np.ndarray) -> None:
        keys, counts = counted(keys)
        self.keys.append(keys)
        self.counts.append(counts)
        if sum(map(len, self.keys[1:])) > HELD:
            self.merge()

    def merge(self) -> int:
        if len(self.keys) > 1:
            keys, counts = counted(np.concatenate(self.keys), np.concatenate(self.counts))
            self.keys, self.counts = [keys], [counts]
        return len(self.keys[0])

    def drain(self, kind: int) -> Iterator[pa.RecordBatch]:
        if self.merge():
            keys, counts = self.keys[0], self.counts[0]
            for lo in range(0, len(keys), 200_000):
                part = keys[lo : lo + 200_000]
                yield pa.record_batch(
                    {
                        "kind": np.full(len(part), kind, np.int8),
                        "key": part.view(np.int64),
                        "n": counts[lo : lo + 200_000].astype(np.int64),
                    }
                )
        self.__init__()


WINDOW, WORD, TEXTS = 0, 1, 2


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher, of_windows, of_words, texts = SpanHasher(7), Gathered(), Gathered(), 0
    for batch in batches:
        data, offsets = utf8(batch.column("text"))
        texts += batch.num_rows
        for lo, hi in runs(offsets):
            part, own = lower_ascii(data[offsets[lo] : offsets[hi]]), offsets[lo : hi + 1] - offsets[lo]
            of_windows.add(windows(part, own)[0])
            starts, ends, _ = word_spans(part, own)
            of_words.add(hasher.over(part).spans(starts, ends))
            for gathered, kind in ((of_windows, WINDOW), (of_words, WORD)):
                if len(gathered.keys[0]) > HELD:
                    yield from gathered.drain(kind)
    yield from of_windows.drain(WINDOW)
    yield from of_words.drain(WORD)
    if texts:
        yield pa.record_batch({"kind": np.array([TEXTS], np.int8), "key": np.zeros(1, np.int64), "n": np.array([texts])})


def least_count(table: DataFrame, most: int) -> int:
    """The least count that at most `most` rows of the table reach."""
    steps = table.groupBy(F.least("n", F.lit(1 << 20)).alias("n")).count().toArrow().to_pydict()
    total, least = 0, (1 << 20) + 1
    for n, rows in sorted(zip(steps["n"], steps["count"], strict=True), reverse=True):
        total += rows
        if total > most:
            break
        least = n
    return least


@dataclass
class Model:
    nodes: tuple  # hash table parts of node keys
    log_p: np.ndarray
    contexts: tuple
    log_escape: np.ndarray
    words: tuple
    word_counts: np.ndarray
    train_tokens: int
    kinds: int
    texts: int
    # With more nodes than fit: the most frequent windows, and the stored table of all nodes and contexts.
    top: tuple | None = None
    top_log_p: np.ndarray | None = None
    exact: DataFrame | None = None


def _contexts_of(keys: np.ndarray) -> np.ndarray:
    """The context of each node: its order and its bytes without the last one."""
    body = np.uint64((1 << TAG) - 1)
    return (keys & ~body) | ((keys & body) >> np.uint64(8))


def _lower(keys: np.ndarray, order: int) -> np.ndarray:
    """The nodes of the same byte after a context one byte shorter."""
    return (keys & np.uint64(mask(order - 1))) | np.uint64((order - 1) << TAG)


def smooth(keys: np.ndarray, counts: np.ndarray, contexts: np.ndarray, totals: np.ndarray):
    """Log-probabilities of the nodes and log escape factors of the contexts (keys in order)."""
    of = np.searchsorted(contexts, _contexts_of(keys))
    p = (counts - 0.5) / totals[of]
    escape = np.maximum(1 - np.bincount(of, p, len(contexts)), 1e-12)
    lower = np.full(len(keys), UNIFORM)
    orders = (keys >> np.uint64(TAG)).astype(int)
    for order in range(1, ORDER + 1):
        own = np.flatnonzero(orders == order)
        lower[own] = p[np.searchsorted(keys, _lower(keys[own], order))]
    left = np.maximum(1 - np.bincount(of, lower, len(contexts)), 1e-9)
    return np.log(p).astype(np.float32), np.log(escape / left).astype(np.float32)


def _smooth_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of (mid, key, n) ordered by mid: log-probabilities of the nodes and log escape factors of their contexts."""

    def smoothed(mid: np.ndarray, keys: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        orders = keys >> np.uint64(TAG)
        contexts, of = np.unique(_contexts_of(keys), return_inverse=True)
        p = (n - 0.5) / np.bincount(of, n)[of]
        # Counts of the nodes one byte shorter, and of their context, are sums within the group.
        _, lower = np.unique(np.stack([mid, keys & np.uint64(0xFF)]), axis=1, return_inverse=True)
        _, group = np.unique(mid, return_inverse=True)
        lower = lower.reshape(-1)
        below = np.where(orders == 0, UNIFORM, (np.bincount(lower, n)[lower] - 0.5) / np.bincount(group, n)[group])
        escape = np.maximum(1 - np.bincount(of, p), 1e-12) / np.maximum(1 - np.bincount(of, below), 1e-9)
        for key, count, value in ((keys, n, np.log(p)), (contexts | np.uint64(CONTEXT), np.zeros(len(contexts)), np.log(escape))):
            yield pa.record_batch({"key": key.view(np.int64), "n": count.astype(np.int64), "value": value.astype(np.float32)})

    held = [np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)]
    for batch in batches:
        new = [batch.column("mid").to_numpy().view(np.uint64), batch.column("key").to_numpy().view(np.uint64), batch.column("n").to_numpy()]
        held = [np.concatenate(pair) for pair in zip(held, new, strict=True)]
        whole = np.searchsorted(held[0], held[0][-1]) if len(held[0]) else 0
        if whole:
            yield from smoothed(*(column[:whole] for column in held))
            held = [column[whole:] for column in held]
    if len(held[0]):
        yield from smoothed(*held)


def smoothed_nodes(nodes: DataFrame) -> DataFrame:
    """key, n, value of all nodes (log-probability) and contexts (log escape factor, `CONTEXT` in the key)."""
    mid = F.lit(0).cast("long")
    for k in range(1, ORDER + 1):
        own = F.shiftright(F.col("key").bitwiseAND(F.lit(mask(k - 1))), 8).bitwiseOR(F.lit(k << TAG))
        mid = F.when(F.shiftright("key", TAG) == k, own).otherwise(mid)
    dealt = nodes.select(mid.alias("mid"), "key", "n").repartition("mid").sortWithinPartitions("mid")
    return store(dealt.mapInArrow(_smooth_groups, _EXACT), "lm-exact")


def fit(training: DataFrame, max_nodes: int = MAX_NODES, max_words: int = MAX_WORDS) -> tuple[Model, DataFrame]:
    """The model and the table of all word counts (key, n)."""
    # A task's keys are distinct already: they are dealt out first and summed there.
    per_task = training.select("text").mapInArrow(_count, _COUNTS).repartition("kind", "key")
    counts = per_task.groupBy("kind", "key").agg(F.sum("n").alias("n"))
    counts = store(counts, "lm-counts")
    words = counts.where(F.col("kind") == WORD).select("key", "n")
    keys = [F.col("key").bitwiseAND(F.lit(mask(k))).bitwiseOR(F.lit(k << TAG)) for k in range(ORDER + 1)]
    nodes = counts.where(F.col("kind") == WINDOW).select(F.explode(F.array(*keys)).alias("key"), "n")
    nodes = store(nodes.groupBy("key").agg(F.sum("n").alias("n")), "lm-nodes")
    body = F.lit((1 << TAG) - 1)
    context = F.col("key").bitwiseAND(F.bitwise_not(body)).bitwiseOR(F.shiftright(F.col("key").bitwiseAND(body), 8))
    contexts = nodes.groupBy(context.alias("key")).agg(
        F.sum("n").alias("total"), F.max("n").alias("most")
    )
    least = least_count(nodes, max_nodes)
    kept = nodes.where(F.col("n") >= least).toArrow()  # at most max_nodes rows
    used = contexts.where(F.col("most") >= least).select("key", "total").toArrow()  # not more
    node_keys, node_counts = kept["key"].to_numpy().view(np.uint64), kept["n"].to_numpy()
    order = np.argsort(node_keys)
    node_keys, node_counts = node_keys[order], node_counts[order]
    context_keys = used["key"].to_numpy().view(np.uint64)
    order = np.argsort(context_keys)
    context_keys = context_keys[order]
    log_p, log_escape = smooth(node_keys, node_counts, context_keys, used["total"].to_numpy()[order])
    frequent = words.where(F.col("n") >= least_count(words, max_words)).toArrow()  # at most max_words rows
    sums = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    texts = counts.where(F.col("kind") == TEXTS).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    model = Model(
        HashTable(node_keys).parts(),
        log_p,
        HashTable(context_keys).parts(),
        log_escape,
        HashTable(frequent["key"].to_numpy().view(np.uint64)).parts(),
        frequent["n"].to_numpy(),
        sums[0] + texts,
        sums[1] + (texts > 0),
        texts,
    )
    if nodes.where(F.col("n") < least).limit(1).count():
        model.exact = smoothed_nodes(nodes)
        longest = model.exact.where(F.shiftright("key", TAG) == ORDER)
        top = longest.where(F.col("n") >= least_count(longest, max_nodes)).toArrow()  # at most max_nodes rows
        model.top = HashTable(top["key"].to_numpy().view(np.uint64)).parts()
        model.top_log_p = top["value"].to_numpy()
    return model, words


class Scorer:
    def __init__(self, model: Model):
        self.nodes, self.contexts = HashTable.of(*model.nodes), HashTable.of(*model.contexts)
        self.log_p, self.log_escape = model.log_p, model.log_escape
        self.seen = np.full(1 << MEMORY_BITS, 0xFFFFFFFFFFFFFFFF, np.uint64)
        self.value = np.zeros(1 << MEMORY_BITS, np.float32)

    def _compute(self, codes: np.ndarray) -> np.ndarray:
        out = np.zeros(len(codes))
        todo = np.arange(len(codes))
        for order in range(ORDER, -1, -1):
            own = codes[todo]
            tag = np.uint64(order << TAG)
            at = self.nodes.find((own & np.uint64(mask(order))) | tag)
            hit = at >= 0
            out[todo[hit]] += self.log_p[at[hit]]
            todo, own = todo[~hit], own[~hit]
            if not len(todo):
                return out
            body = np.uint64(mask(order - 1)) if order else np.uint64(0)
            at = self.contexts.find(((own >> np.uint64(8)) & body) | tag)
            known = at >= 0
            out[todo[known]] += self.log_escape[at[known]]
        out[todo] += np.log(UNIFORM)
        return out

    def log_probabilities(self, codes: np.ndarray) -> np.ndarray:
        """Natural log-probability of each window's byte."""
        slot = (mix(codes) >> np.uint64(64 - MEMORY_BITS)).astype(np.int64)
        out = self.value[slot].astype(np.float64)
        new = np.flatnonzero(self.seen[slot] != codes)
        if len(new):
            distinct, back = np.unique(codes[new], return_inverse=True)
            values = self._compute(distinct)
            out[new] = values[back]
            at = slot[new]
            self.seen[at] = codes[new]
            # Of windows that fall on one slot the last one stays, key and value alike.
            self.value[at] = values[back]
        return out


class TopScorer:
    """Log-probabilities of the most frequent windows; nothing is said of others."""

    def __init__(self, model: Model):
        self.windows, self.log_p = HashTable.of(*model.top), model.top_log_p

    def log_probabilities(self, codes: np.ndarray) -> np.ndarray:
        out = np.full(len(codes), np.nan)
        for lo in range(0, len(codes), LOOKED_UP):
            at = self.windows.find(codes[lo : lo + LOOKED_UP] | np.uint64(ORDER << TAG))
            out[lo : lo + LOOKED_UP][at >= 0] = self.log_p[at[at >= 0]]
        return out


def _distinct(rows: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct pairs and how often they stand."""
    order = np.lexsort((keys, rows))
    rows, keys = rows[order], keys[order]
    heads = np.flatnonzero(np.concatenate([[True], (rows[1:] != rows[:-1]) | (keys[1:] != keys[:-1])]))
    return rows[heads], keys[heads], np.diff(np.append(heads, len(keys)))


def _score(shared):
    names = ["row", "doc_id", "score", "base", "n_tokens", "n_known", "word", "code", "n"]

    def to_join(ids: pa.Array, rows: np.ndarray, keys: np.ndarray, name: str) -> Iterator[pa.RecordBatch]:
        rows, keys, n = _distinct(rows, keys)
        for lo in range(0, len(rows), LOOKED_UP):
            part = slice(lo, lo + LOOKED_UP)
            own = {"row": ids.take(pa.array(rows[part])), name: pa.array(keys[part].view(np.int64)), "n": pa.array(n[part])}
            nulls, none = pa.nulls(len(own["n"]), pa.int64()), pa.nulls(len(own["n"]), pa.float64())
            own |= {"score": none, "base": none}
            yield pa.RecordBatch.from_arrays([own.get(x, nulls) for x in names], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*shared.value)
        scorer = Scorer(model) if model.top is None else TopScorer(model)
        hasher, frequent = SpanHasher(7), HashTable.of(*model.words)
        scale = np.log10(model.train_tokens + 0.1 * (model.kinds + 1))
        end = np.log10(model.texts + 0.1) - scale
        gain = np.log10(model.word_counts + 0.1) - scale
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            ids, doc_ids = batch.column("row"), batch.column("doc_id")
            for lo, hi in runs(offsets):
                n = hi - lo
                part, own = lower_ascii(data[offsets[lo] : offsets[hi]]), offsets[lo : hi + 1] - offsets[lo]
                codes, rows = windows(part, own)
                logs = scorer.log_probabilities(codes)
                score = np.bincount(rows, np.nan_to_num(logs), n) / np.log(10)
                if (rare := np.isnan(logs)).any():
                    yield from to_join(ids.slice(lo, n), rows[rare], codes[rare], "code")
                starts, ends, rows = word_spans(part, own)
                words = hasher.over(part).spans(starts, ends)
                tokens = np.bincount(rows, minlength=n)
                at = frequent.find(words)
                hit = at >= 0
                base = np.bincount(rows[hit], gain[at[hit]], n) + end
                known = np.bincount(rows[hit], minlength=n) + (model.texts > 0)
                nulls = pa.nulls(n, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, n), doc_ids.slice(lo, n), pa.array(score), pa.array(base), pa.array(tokens + 1), pa.array(known), nulls, nulls, nulls],
                    names,
                )
                if not hit.all():
                    yield from to_join(ids.slice(lo, n), rows[~hit], words[~hit], "word")

    return run


def _sent(model: Model) -> tuple:
    """What tasks need of a model."""
    if model.top is None:
        return tuple(vars(model).values())
    none = np.zeros(0, np.float32)
    return tuple((vars(model) | {"nodes": (), "log_p": none, "contexts": (), "log_escape": none, "exact": None}).values())


def _joined(codes: DataFrame, exact: DataFrame) -> DataFrame:
    """code, value: the log-probability of every distinct window by the stored table."""
    seen = exact.where(F.shiftright("key", TAG) == ORDER)
    seen = seen.select(F.col("key").bitwiseAND(F.lit((1 << TAG) - 1)).alias("code"), F.col("value").cast("double").alias("value"))
    found = store(codes.select("code").distinct().join(seen, "code", "left"), "lm-codes")
    keys = []
    for k in range(ORDER + 1):
        own = F.col("code").bitwiseAND(F.lit(mask(k)))
        keys.append(F.struct(F.lit(k).alias("order"), F.lit(False).alias("node"), F.shiftright(own, 8).bitwiseOR(F.lit(k << TAG | CONTEXT)).alias("key")))
        if k < ORDER:
            keys.append(F.struct(F.lit(k).alias("order"), F.lit(True).alias("node"), own.bitwiseOR(F.lit(k << TAG)).alias("key")))
    asked = found.where("value is null").select("code", F.explode(F.array(*keys)).alias("k")).select("code", "k.*")
    parts = asked.join(exact.select("key", F.col("value").cast("double").alias("value")), "key").groupBy("code").agg(
        F.max(F.when(F.col("node"), F.struct("order", "value"))).alias("best"),
        F.collect_list(F.when(~F.col("node"), F.struct("order", "value"))).alias("escapes"),  # one an order
    )
    longest = F.coalesce("best.order", F.lit(-1))
    passed = F.filter("escapes", lambda e: e["order"] > longest)
    value = F.aggregate(passed, F.coalesce("best.value", F.lit(float(np.log(UNIFORM)))), lambda total, e: total + e["value"])
    return found.where("value is not null").unionByName(parts.select("code", value.alias("value")))


def score(docs: DataFrame, model: Model, words: DataFrame) -> DataFrame:
    """One row per input row: doc_id, n_tokens, n_known, train_tokens, base_score and score."""
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    shared = docs.sparkSession.sparkContext.broadcast(_sent(model))
    scored = store(numbered.mapInArrow(_score(shared), _SCORES), "lm-scores")
    scale = float(np.log10(model.train_tokens + 0.1 * (model.kinds + 1)))
    rare = scored.where("word is not null").select("row", "word", "n")
    counts = words.select(F.col("key").alias("word"), F.col("n").alias("c"))
    rare = rare.join(counts, "word", "left").groupBy("row").agg(
        F.sum(F.col("n") * (F.log10(F.coalesce("c", F.lit(0)) + F.lit(0.1)) - F.lit(scale))).alias("rare_base"),
        F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("rare_known"),
    )
    whole = scored.where("word is null and code is null").join(rare, "row", "left")
    total = F.col("score")
    if model.exact is not None:
        pairs = scored.where("code is not null").select("row", "code", "n")
        more = pairs.join(_joined(pairs, model.exact), "code").groupBy("row").agg(F.sum(F.col("n") * F.col("value")).alias("rare_score"))
        whole = whole.join(more, "row", "left")
        total = total + F.coalesce("rare_score", F.lit(0.0)) / F.lit(float(np.log(10)))
    return whole.select(
        "doc_id",
        "n_tokens",
        (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(int(model.train_tokens)).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rare_base", F.lit(0.0))).alias("base_score"),
        total.alias("score"),
    )
