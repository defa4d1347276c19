"""Near-duplicate groups by fast similarity sketches, banding and exact verification.

Sketch: a set of shingles is thrown into `BANDS * ROWS` bins round by round. In each of
the first rounds a fresh hash gives every element a bin and a value; a bin keeps the
least (round, value). The second half of the rounds sends all elements to one bin each,
so every coordinate is filled after at most twice as many rounds as there are bins;
most sets are done after a few.

1. Documents with equal sets form a class (a digest of 128 bits), by an aggregate that
   runs in the tasks first. Only the least doc_id of a class goes on.
2. Each class has one key per band; classes that share a key form a bucket.
3. All members of a bucket are compared with one of them, its centre, on their full
   shingle sets, and linked ones are joined into components. Members of one component
   need no further comparison. Nodes of buckets that still hold several components are
   compared across components by an exact prefix filter: they meet on their rarest
   shared shingles only, and if bitmaps of their sets are near enough. A node meets a few nodes of a large component first and
   the rest of it only without a link to those. So no link is left out, and neither a large group of copies
   nor many texts around one passage give all their pairs.
4. Components of the links; every document takes that of its class.

Two sets of similarity 0.8 meet in no band with probability (1 - 0.8^ROWS)^BANDS,
3 in a million; more similar ones less.

Defined results: words are split at 0x20 and 0x09 to 0x0D after lower-casing A-Z; a
document with fewer words than a shingle has all of them as its one shingle; null or
blank texts have no shingle, and link with nothing. Repeated rows are members of one
class. Rows without a doc_id get no component and do not stay. Extra columns are
ignored. Shingles are compared by 64-bit hashes of their words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockyard.llm.components import components
from stockyard.llm.kernels import SpanHasher, lean, lower_ascii, mix, runs, utf8, word_spans
from stockyard.operators.sizing import is_small
from stockyard.session import store
from stockyard.shipping import ship_by_value

ship_by_value(__name__)

BANDS, ROWS = 32, 5
#: 64-bit words of the bitmap that stands for a set: each shingle sets one bit.
WORDS = 8
#: Nodes of a large component that others are held against first, at each shingle, and the growth of this number.
FEW, MORE = 8, 8

_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
_SALT = np.random.default_rng(9).integers(1, 1 << 63, 1024, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

_SIGNATURE = "doc_id long, n_shingles long, key_a long, key_b long, bands array<long>"
_SETS = "doc_id long, shingles array<long>, " + ", ".join(f"bits{k} long" for k in range(WORDS))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int, hasher: SpanHasher) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each row: how many, and all of them by row and value."""
    rows_n = len(offsets) - 1
    data = lower_ascii(data)
    starts, ends, rows = word_spans(data, offsets)
    words = hasher.over(data).spans(starts, ends)
    counts = np.bincount(rows, minlength=rows_n)
    m = max(0, len(words) - width + 1)
    sums = np.zeros(m, np.uint64)
    for k in range(width):
        sums += words[k : k + m] * _SALT[k]
    whole = rows[:m] == rows[width - 1 :] if m else np.zeros(0, bool)
    values, of = mix(sums[whole]), rows[:m][whole]
    few = np.flatnonzero((counts[rows] < width))
    if len(few):
        firsts = np.zeros(rows_n, np.int64)
        firsts[rows[::-1]] = np.arange(len(rows))[::-1]
        short = np.zeros(rows_n, np.uint64)
        np.add.at(short, rows[few], words[few] * _SALT[few - firsts[rows[few]]])
        at = np.flatnonzero((counts > 0) & (counts < width))
        values = np.concatenate([values, mix(short[at] ^ (counts[at].astype(np.uint64) * _SALT[99]))])
        of = np.concatenate([of, at])
        order = np.argsort(of, kind="stable")
        values, of = values[order], of[order]
    bounds = np.searchsorted(of, np.arange(rows_n + 1))
    for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
        values[lo:hi].sort()
    keep = np.ones(len(values), bool)
    keep[1:] = (values[1:] != values[:-1]) | (of[1:] != of[:-1])
    return np.bincount(of[keep], minlength=rows_n), values[keep]


def sketch(counts: np.ndarray, values: np.ndarray, bins: int) -> np.ndarray:
    """A row of `bins` coordinates for each set; rows of empty sets stay empty."""
    out = np.full((len(counts), bins), _EMPTY, np.uint64)
    live = np.flatnonzero(counts > 0)
    rows = np.repeat(np.arange(len(live)), counts[live])
    grid = np.full((len(live), bins), _EMPTY, np.uint64)
    for turn in range(2 * bins):
        h = mix(values ^ _SALT[turn])
        if turn < bins:
            at = ((h >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)
        else:
            at = np.full(len(h), turn - bins, np.uint64)
        value = (np.uint64(turn) << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF))
        np.minimum.at(grid.reshape(-1), rows * bins + at.astype(np.int64), value)
        done = (grid != _EMPTY).all(1)
        if done.any():
            out[live[done]] = grid[done]
            stay = ~done[rows]
            rows, values = (np.cumsum(~done) - 1)[rows[stay]], values[stay]
            live, grid = live[~done], grid[~done]
            if not len(live):
                break
    return out


def band_keys(grid: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key for each row and band."""
    cells = mix(grid).reshape(len(grid), bands, rows)
    sums = np.zeros((len(grid), bands), np.uint64)
    for k in range(rows):
        sums += cells[:, :, k] * _SALT[k]
    return mix(sums + np.arange(bands, dtype=np.uint64) * _SALT[77])


def bitmaps(counts: np.ndarray, values: np.ndarray) -> np.ndarray:
    """`WORDS` words for each set. Two sets differ in at least as many shingles as their bitmaps do in bits."""
    out = np.zeros(len(counts) * WORDS, np.uint64)
    bit = mix(values ^ _SALT[600]) % np.uint64(WORDS * 64)
    at = np.repeat(np.arange(len(counts)), counts) * WORDS + (bit >> np.uint64(6)).astype(np.int64)
    np.bitwise_or.at(out, at, np.uint64(1) << (bit & np.uint64(63)))
    return out.reshape(-1, WORDS)


def _signatures(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = SpanHasher(width)
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            for lo, hi in runs(offsets):
                counts, values = shingle_sets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], width, hasher)
                full = counts > 0
                keys = np.zeros((2, len(counts)), np.uint64)
                if full.any():
                    heads = (np.cumsum(counts) - counts)[full]
                    for k in range(2):
                        keys[k][full] = np.add.reduceat(mix(values ^ _SALT[500 + k]), heads)
                grid = sketch(counts, values, BANDS * ROWS)
                bands = band_keys(grid[full], BANDS, ROWS).view(np.int64).reshape(-1)
                ends = np.concatenate([[0], np.cumsum(np.where(full, BANDS, 0))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(lo, hi - lo),
                        pa.array(counts.astype(np.int64)),
                        pa.array(keys[0].view(np.int64)),
                        pa.array(keys[1].view(np.int64)),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(bands)),
                    ],
                    ["doc_id", "n_shingles", "key_a", "key_b", "bands"],
                )

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = SpanHasher(width)
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            for lo, hi in runs(offsets):
                counts, values = shingle_sets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], width, hasher)
                ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                bits = bitmaps(counts, values).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(lo, hi - lo),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(values.view(np.int64))),
                        *[pa.array(np.ascontiguousarray(bits[:, k])) for k in range(WORDS)],
                    ],
                    ["doc_id", "shingles", *[f"bits{k}" for k in range(WORDS)]],
                )

    return run


def _fitting(percent: int, a: str, b: str) -> Column:
    """Sets of these sizes can reach the similarity."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def _alike(percent: int) -> Column:
    """Bitmaps of x and y that differ in so few bits that the sets can reach the similarity."""
    apart = [F.bit_count(F.col(f"x.bits{k}").bitwiseXOR(F.col(f"y.bits{k}"))) for k in range(WORDS)]
    return sum(apart[1:], apart[0]) * (100 + percent) <= (F.col("x.n") + F.col("y.n")) * (100 - percent)


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs a, b whose full sets are similar enough."""
    first = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("of_a"))
    second = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("of_b"))
    both = F.size(F.array_intersect("of_a", "of_b"))
    total = F.size("of_a") + F.size("of_b")
    joined = pairs.join(second, "b").join(first, "a").select("a", "b", both.alias("both"), total.alias("total"))
    return joined.where(F.col("both") * 100 >= (F.col("total") - F.col("both")) * percent).select("a", "b")


def _open_nodes(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Nodes of buckets with three members or more in several components, with size and component.

    A bucket of two has had its only pair compared in the first round.
    """
    placed = rows.join(known.withColumnRenamed("node", "member"), F.col("node") == F.col("member"), "left").select(
        "bucket", "node", "n", F.coalesce("component", "node").alias("component")
    )
    placed = store(placed, "bucket-rows")
    mixed = placed.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("m"), F.min("component").alias("least"), F.max("component").alias("most")
    )
    opened = mixed.where("m > 2 and least <> most").select("bucket")
    return store(placed.join(opened, "bucket").select("node", "n", "component").distinct(), "open-nodes")


def _prefixes(nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Rows s, node, n, after: the shingles at which nodes of different components have to meet.

    Shingles are ordered: first those that only one component has, then the others
    from rare to frequent. Two similar sets have at least `percent` of either in
    common, so they share one of their first n - percent * n + 1 shingles. This still
    holds when components have been joined since.
    """
    open_sets = sets.join(nodes.withColumnRenamed("node", "doc_id"), "doc_id")
    each = open_sets.select(F.col("doc_id").alias("node"), "n", "component", F.explode("shingles").alias("s"))
    # Counted in the tasks first, however many nodes have a shingle.
    stats = each.groupBy("s").agg(
        F.count(F.lit(1)).alias("df"), F.min("component").alias("least"), F.max("component").alias("most")
    )
    abroad = each.join(stats.where("least <> most").select("s", "df"), "s")
    own = Window.partitionBy("node")  # the shingles of one document
    placed = abroad.withColumn("shared", F.count(F.lit(1)).over(own)).withColumn(
        "place", F.row_number().over(own.orderBy("df", "s"))
    )
    needed = F.expr(f"(n * {percent} + 99) div 100")
    first = placed.where((F.col("shared") >= needed) & (F.col("place") <= F.col("shared") - needed + 1))
    return store(first.select("s", "node", "n", (F.col("shared") - F.col("place")).alias("after")), "prefixes")


def _parts(first: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """`first` with components, for shingles that several components have, and the size c of each component's part of a shingle."""
    first = first.join(nodes.select("node", "component"), "node")
    parts = first.groupBy("s", "component").agg(F.count(F.lit(1)).alias("c"))
    main = parts.groupBy("s").agg(F.max_by("component", F.struct("c", "component")).alias("main"), F.count(F.lit(1)).alias("k"))
    main = main.where("k > 1").select("s", "main")
    return first.join(main, "s"), parts.join(main, "s").select("s", "component", "c")


def _prefix_pairs(first: DataFrame, parts: DataFrame, sets: DataFrame, percent: int, few: int | None = None) -> DataFrame:
    """Pairs of nodes of different components that may be similar; no similar pair is left out.

    At the first prefix shingle shared, what follows in either bounds the overlap, and so do
    the bits in which their bitmaps differ: texts that share a passage and little more make no
    pair. With `few`, only about so many nodes of a larger part of a shingle are met.
    """
    # Nodes of a shingle's largest component meet those of others only, so a component of
    # a third of all nodes costs no more pairs than it has partners outside.
    outer, met = first.where("component <> main"), first
    if few:
        wide = parts.where(F.col("c") > few)
        met = first.join(wide, ["s", "component"]).where(F.pmod(F.xxhash64("node", "s"), F.col("c")) < few).drop("c")
    bits = sets.select(F.col("doc_id").alias("node"), *[f"bits{k}" for k in range(WORDS)])
    x, y = outer.join(bits, "node").alias("x"), met.join(bits, "node").alias("y")
    rest = (F.least("x.after", "y.after") + 1) * (100 + percent) >= (F.col("x.n") + F.col("y.n")) * percent
    once = F.lit(True) if few else (F.col("y.component") == F.col("y.main")) | (F.col("x.node") < F.col("y.node"))
    pairs = x.join(y, F.col("x.s") == F.col("y.s")).where(
        (F.col("x.component") != F.col("y.component")) & once & _fitting(percent, "x.n", "y.n") & rest & _alike(percent)
    )
    return pairs.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()


def _joined(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """`nodes` with the components that the links `found` between them join."""
    ends = [nodes.select(F.col("node").alias(end), F.col("component").alias(f"of_{end}")) for end in ("a", "b")]
    reached = components(found.join(ends[0], "a").join(ends[1], "b").select(F.col("of_a").alias("a"), F.col("of_b").alias("b")))
    reached = reached.select(F.col("node").alias("component"), F.col("component").alias("least"))
    placed = nodes.join(reached, "component", "left").select("node", "n", F.coalesce("least", "component").alias("component"))
    return store(placed, "open-nodes")


def _links_across(nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links that join all components of `nodes` that similar nodes join.

    A node has links to many nodes of a large component, or to few or none. So it is first
    held against `FEW` nodes of such a component at each of its shingles, then against
    `MORE` times as many, while that finds links and there are larger components; who has a
    link belongs to the component and is not held against the rest of it. Those that are left
    are held against all.
    """
    first = _prefixes(nodes, sets, percent)
    found, few = [], FEW
    while True:
        rows, parts = _parts(first, nodes)
        rows, parts = store(rows, "prefixes"), store(parts, "parts")
        if parts.where(F.col("c") > few).isEmpty():
            break
        more = store(_linked(_prefix_pairs(rows, parts, sets, percent, few), sets, percent), "near-links")
        if more.isEmpty():
            break
        found.append(more)
        nodes, few = _joined(nodes, more), few * MORE
    links = _linked(_prefix_pairs(rows, parts, sets, percent), sets, percent)
    for more in found:
        links = links.unionByName(more)
    return links


def links(docs: DataFrame, classes: DataFrame, width: int, percent: int) -> DataFrame:
    """Links a, b between classes (columns node, n, bands) that join all similar ones."""
    rows = classes.select(F.explode("bands").alias("bucket"), "node", "n")
    shared = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("m"), F.min(F.struct("node", "n")).alias("centre")).where("m > 1")
    rows = store(rows.join(shared.select("bucket", "centre"), "bucket"), "bucket-rows")
    pairs = rows.where(_fitting(percent, "n", "centre.n")).select(F.col("centre.node").alias("a"), F.col("node").alias("b"))
    nodes = store(rows.select(F.col("node").alias("doc_id")).distinct(), "bucket-nodes")
    wanted = F.broadcast(nodes) if is_small(nodes) else nodes
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(wanted, "doc_id")
    sets = store(texts.mapInArrow(lean(_sets(width)), _SETS), "shingle-sets")

    found = store(_linked(pairs.where("a <> b").distinct(), sets, percent), "near-links")
    opened = _open_nodes(rows.select("bucket", "node", "n"), components(found))
    if opened.isEmpty():
        return found
    return store(found.unionByName(_links_across(opened, sets, percent)).distinct(), "near-links")


def members(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row per input row: doc_id, n_shingles, class_id, component_id, kept."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = store(texts.mapInArrow(lean(_signatures(width)), _SIGNATURE), "near-signatures")
    full = signed.where("n_shingles > 0 and doc_id is not null")
    classes = full.groupBy("key_a", "key_b", "n_shingles").agg(F.min("doc_id").alias("node"), F.first("bands").alias("bands"))
    classes = store(classes.withColumnRenamed("n_shingles", "n"), "near-classes")
    found = links(docs, classes.select("node", "n", "bands"), width, percent)
    class_of = classes.select("key_a", "key_b", F.col("n").alias("n_shingles"), F.col("node").alias("class_id"))
    placed = full.select("doc_id", "n_shingles", "key_a", "key_b").join(class_of, ["key_a", "key_b", "n_shingles"])
    reached = components(found)
    placed = placed.join(reached, placed["class_id"] == reached["node"], "left")
    placed = placed.select("doc_id", "n_shingles", "class_id", F.coalesce("component", "class_id").alias("component_id"))
    rest = signed.where("n_shingles = 0 or doc_id is null").select(
        "doc_id", "n_shingles", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("component_id")
    )
    rows = placed.unionByName(rest)
    return rows.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
