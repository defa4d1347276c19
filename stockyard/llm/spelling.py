"""Spelling variants: words one edit apart, grouped under the form that is most frequent.

1. Words are counted in the tasks first, so a word with a third of all occurrences is
   one row per task.
2. Words of one length are the points of a k-d tree over letter counts (`kdtree.py`).
   Its upper part is built on the driver from at most `SAMPLE` words, chosen by their
   hash; it only says where the boxes are cut, so the sample cannot lose a pair. Every
   word goes to the leaf of its own point, and as a query to all leaves that its range
   meets: in the tree of its own length, and in the tree of words shorter by one. So
   each pair of words meets in one leaf. A leaf with more words than `LEAF`, which
   happens when many have the same counts, is cut into slices that all get its queries.
3. A task builds the tree below a leaf from its words, searches it for the queries as
   they come, and compares what is left letter by letter.
4. A word's form is its near word with the largest n, if that is `ratio` times its own n.
   Forms grow by that factor at each step, so a chain is short; it is followed by
   doubling of pointers.

Defined results: words are longest stretches of A-Z, a-z and U+00C0 to U+00FF, with A-Z
lower-cased and other letters as they are. Null and empty texts have none; repeated rows
count again; a text of any length is one row of a batch and its words are counted one by
one; an empty table gives no words. Extra columns are ignored. Ties of n go to the
smaller word in code-point order.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockyard.llm.kdtree import Node, WordTree, build, counts_of, home, letters, reached
from stockyard.session import store
from stockyard.shipping import ship_by_value

ship_by_value(__name__)

#: Words from which the upper parts of the trees are built, in all.
SAMPLE = 1 << 16
#: Words that a leaf of the upper part should have.
LEAF = 1 << 13
#: Distinct words that a counting task holds.
HELD = 200_000
#: Queries that are searched at a time.
QUERIES = 1 << 15

_PATTERN = re.compile("[A-Za-zÀ-ÿ]+")


def _counted(damaged: int, min_length: int):
    def out(held: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                lowered = (text.as_py() or "").encode().lower().decode()  # of bytes, lower() takes A-Z only
                begin = zlib.crc32(f"{'' if doc_id.as_py() is None else doc_id.as_py()}:".encode())
                for word, n in Counter(_PATTERN.findall(lowered)).items():
                    if damaged:
                        h = zlib.crc32(word.encode(), begin)
                        if h % damaged == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1 :]
                    if len(word) >= min_length:
                        held[word] += n
                if len(held) > HELD:
                    yield out(held)
                    held.clear()
        if held:
            yield out(held)

    return run


def count_words(docs: DataFrame, min_length: int = 6, min_count: int = 5, damaged: int = 0) -> DataFrame:
    """The distinct words of at least `min_length` letters and `min_count` occurrences: word, n.

    With `damaged`, a run whose hash with its document's id is divisible by it loses one letter first.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    counted = texts.mapInArrow(_counted(damaged, min_length), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def _upper_trees(words: DataFrame) -> tuple[dict[int, Node], dict[tuple[int, int], int]]:
    """For each length the upper part of its tree, and the slices of leaves that will be large."""
    total = words.count()
    every = max(1, -(-total // SAMPLE))
    picked = words.where(F.pmod(F.xxhash64("word"), F.lit(every)) == 0) if every > 1 else words
    by_length: dict[int, list[str]] = {}
    for row in picked.select("word").toLocalIterator():
        by_length.setdefault(len(row[0]), []).append(row[0])
    trees, slices = {}, {}
    for length, some in by_length.items():
        points = counts_of(letters(some, length))
        trees[length], _ = build(points, max(8, LEAF // every))
        leaves, sizes = np.unique(home(trees[length], points), return_counts=True)
        for leaf, size in zip(leaves.tolist(), sizes.tolist(), strict=True):
            if size * every > 4 * LEAF:
                slices[length, leaf] = -(-size * every // LEAF)
    return trees, slices


def _bare(node: Node) -> Node:
    """The tree without the rows of the sample."""
    return Node(node.axis, node.cut, node.low and _bare(node.low), node.high and _bare(node.high), node.leaf)


#: A leaf's slice, then 0 for its words and 1 or 2 for queries of its words' length or one more.
_DEALT = "length int, leaf int, slice int, role int, word string, n long"


def _dealt(trees: dict[int, Node], slices: dict[tuple[int, int], int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, n = batch.column("word").to_pylist(), batch.column("n").to_numpy()
            by_length: dict[int, list[int]] = {}
            for k, word in enumerate(words):
                by_length.setdefault(len(word), []).append(k)
            for length, rows in by_length.items():
                some = [words[k] for k in rows]
                names, numbers = pa.array(some, pa.string()), n[rows]
                points = counts_of(letters(some, length))

                def part(role: int, of: int, leaf: int, at: np.ndarray, cut: np.ndarray | int, names=names, numbers=numbers) -> pa.RecordBatch:
                    same = [np.full(len(at), v, np.int32) for v in (of, leaf)]
                    columns = [*same, np.broadcast_to(np.asarray(cut, np.int32), len(at)), np.full(len(at), role, np.int32)]
                    return pa.RecordBatch.from_arrays(
                        [*map(pa.array, columns), names.take(pa.array(at)), pa.array(numbers[at])],
                        [f.split()[0] for f in _DEALT.split(", ")],
                    )

                own = home(trees[length], points) if length in trees else np.zeros(len(rows), np.int64)
                for leaf in np.unique(own).tolist():
                    at = np.flatnonzero(own == leaf)
                    count = slices.get((length, leaf), 1)
                    yield part(0, length, leaf, at, 0 if count == 1 else np.array([hash_of(some[k]) % count for k in at.tolist()]))
                for role, of in ((1, length), (2, length - 1)):
                    everywhere = [(Node(leaf=0), np.arange(len(rows)))]
                    met = reached(trees[of], points, 2 - role, 1) if of in trees else everywhere
                    for leaf, at in met:
                        for cut in range(slices.get((of, leaf.leaf), 1)):
                            yield part(role, of, leaf.leaf, at, cut)

    return run


def hash_of(word: str) -> int:
    return zlib.crc32(word.encode())


def _searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a leaf follow each other, its words before its queries; gives both directions of pairs of unequal length."""
    key, words, numbers, tree = None, [], [], None
    for batch in batches:
        columns = [batch.column(c).to_numpy() for c in ("length", "leaf", "slice", "role")]
        change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
        bounds = [0, *change.tolist(), batch.num_rows] if batch.num_rows else []
        for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
            length, leaf, cut, role = (int(c[lo]) for c in columns)
            if (length, leaf, cut) != key:
                key, words, numbers, tree = (length, leaf, cut), [], [], None
            if role == 0:
                words += batch.column("word").slice(lo, hi - lo).to_pylist()
                numbers += batch.column("n").slice(lo, hi - lo).to_pylist()
                continue
            if not words:
                continue
            tree = tree or WordTree(words, length)
            for at in range(lo, hi, QUERIES):
                size = min(QUERIES, hi - at)
                asked, asked_n = batch.column("word").slice(at, size).to_pylist(), batch.column("n").slice(at, size).to_pylist()
                ours, theirs = (x.tolist() for x in tree.near(asked, length + role - 1))
                word, near, near_n = [asked[k] for k in ours], [words[k] for k in theirs], [numbers[k] for k in theirs]
                if role == 2:
                    word, near = word + near, near + word
                    near_n = near_n + [asked_n[k] for k in ours]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(word, pa.string()), pa.array(near, pa.string()), pa.array(near_n, pa.int64())], ["word", "near", "near_n"]
                )


def near_words(words: DataFrame) -> DataFrame:
    """All pairs of words (columns word, n; stored) one inserted, deleted or replaced letter apart, each in both directions: word, near, near_n."""
    spark = words.sparkSession
    trees, slices = _upper_trees(words)
    dealt = words.mapInArrow(_dealt({k: _bare(t) for k, t in trees.items()}, slices), _DEALT)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    leaf = ["length", "leaf", "slice"]
    rows = dealt.repartition(parts, *leaf).sortWithinPartitions(*leaf, "role")
    return rows.mapInArrow(_searched, "word string, near string, near_n long")


def _roots(forms: DataFrame) -> DataFrame:
    """Follow forms (word, form) to the last one; pointers double in length each round."""
    at = forms.select("word", F.col("form").alias("root"))
    while True:
        on = at.select(F.col("word").alias("via"), F.col("root").alias("further"))
        moved = at.join(on, at["root"] == on["via"], "left")
        after = store(moved.select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        at = after.select("word", "root")
        if after.where("moved").isEmpty():
            return at


def variants(words: DataFrame, ratio: int = 5) -> DataFrame:
    """One row per word (columns word, n): its near words' number, its form with that one's n, and the last form."""
    words = store(words, "words")
    best = near_words(words).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best")
    )
    known = words.join(best, "word", "left")
    wins = -F.col("best.less") >= F.col("n") * ratio
    known = known.select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(wins, F.col("best.near")).alias("form"),
        F.when(wins, -F.col("best.less")).alias("form_n"),
    )
    known = store(known, "near-words")
    roots = _roots(known.where("form is not null").select("word", "form"))
    rows = known.join(roots, "word", "left")
    return rows.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
