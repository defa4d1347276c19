"""Approximate nearest neighbours by cross-polytope hashing.

A vector is scaled to length one and turned by pseudo-random rotations (sign flips and
a fast Hadamard transform, three times); its bucket is the nearest signed axis, that
is the coordinate of largest magnitude and its sign. Several tables use different
rotations. A query looks into the buckets of its `probes` nearest signed axes in every
table and compares itself with all vectors there, in double precision.

Vectors that differ in length get one more coordinate, which brings all to the length
of the longest one, before they are hashed: the largest inner product then is the
nearest direction.

Equal rows are made one before they are hashed. Buckets are cut into parts of about
`PART` vectors by a hash of id and vector, and a query goes to all parts of a bucket, so
a bucket or an id with a third of all vectors is many tasks' work. Only the best row of
an id and the best `k` ids of a part are handed on. Queries that end with fewer than `k`
are sent to every bucket of one table, which is exact.

Defined results: vectors that are null, zero, hold a null or a component that is not
finite, or differ in dimension from the most frequent one, take no part; nor do rows
without an id. Repeated rows of an id count once, with their best score; a query never
meets a row of its own id. Ties go to the smaller id. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockyard.session import store
from stockyard.shipping import ship_by_value

ship_by_value(__name__)

TABLES = 4
#: Queries that the number of probes is fitted on, and the share of their neighbours to find.
SAMPLE, RECALL = 64, 0.96
#: Vectors of a part of a bucket, about.
PART = 8192
#: Queries compared with a part at a time.
QUERIES = 256

_HASHED = "id long, vector binary, query boolean, codes array<int>"
_ASKED = "id long, vector binary, bucket int"
_FOUND = "query_id long, vec_id long, score double"


def rotate(x: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """Rows turned by sign flips and Hadamard transforms; the width is a power of two."""
    n = x.shape[1]
    for flip in signs:
        x = x * flip
        half = 1
        while half < n:
            pairs = x.reshape(-1, n // (2 * half), 2, half)
            x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(-1, n)
            half *= 2
        x = x / np.sqrt(n)
    return x


def signs_of(tables: int, width: int, seed: int = 6) -> np.ndarray:
    return np.random.default_rng(seed).choice([-1.0, 1.0], (tables, 3, width))


def axes(x: np.ndarray, flips: np.ndarray) -> np.ndarray:
    """Coordinates of all signed axes after a rotation: the axes and then their opposites."""
    turned = rotate(x, flips)
    return np.concatenate([turned, -turned], axis=1)


def inner_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All inner products, each summed in the same order, so that equal vectors tie exactly."""
    out = np.zeros((len(a), len(b)))
    for k in range(a.shape[1]):
        out += a[:, k, None] * b[None, :, k]
    return out


def _vectors(column: pa.Array, dimension: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(len(column), dimension)


@dataclass(frozen=True)
class Space:
    """The hashed space: dimension, width after padding, longest vector, and whether all are as long."""

    dimension: int
    longest: float
    level: bool
    tables: int

    @property
    def width(self) -> int:
        return 1 << max(0, (self.dimension + (not self.level) - 1)).bit_length()

    @property
    def axes(self) -> int:
        return 2 * self.width

    def padded(self, x: np.ndarray, stored: bool) -> np.ndarray:
        wide = np.zeros((len(x), self.width))
        wide[:, : self.dimension] = x / self.longest
        if stored and not self.level:
            wide[:, self.dimension] = np.sqrt(np.maximum(0, 1 - (wide * wide).sum(1)))
        return wide

    def signs(self) -> np.ndarray:
        return signs_of(self.tables, self.width)


def _raw(x: np.ndarray) -> pa.Array:
    raw, size = x.astype("<f8").tobytes(), 8 * x.shape[1]
    return pa.array([raw[i : i + size] for i in range(0, len(raw), size)], pa.binary())


def _from_raw(column: pa.Array, dimension: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<f8").reshape(-1, dimension)


def _hash(space: tuple):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Space(*space)
        signs = own.signs()
        for batch in batches:
            x = _vectors(batch.column("vector"), own.dimension)
            wide = own.padded(x, stored=True)
            codes = np.stack([axes(wide, f).argmax(1) + t * own.axes for t, f in enumerate(signs)], 1)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(codes.astype(np.int32).reshape(-1)), own.tables)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), _raw(x), batch.column("query"), lists.cast(pa.list_(pa.int32()))],
                ["id", "vector", "query", "codes"],
            )

    return run


def _probe(space: tuple, probes: int):
    """A row for every bucket that a query looks into."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Space(*space)
        signs = own.signs()
        for batch in batches:
            wide = own.padded(_from_raw(batch.column("vector"), own.dimension), stored=False)
            for t, flips in enumerate(signs):
                near = np.argsort(-axes(wide, flips), axis=1, kind="stable")[:, :probes] + t * own.axes
                rows = pa.array(np.repeat(np.arange(len(wide)), near.shape[1]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").take(rows), batch.column("vector").take(rows), pa.array(near.astype(np.int32).reshape(-1))],
                    ["id", "vector", "bucket"],
                )

    return run


def _rows_of(found: pa.RecordBatch, queries: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray) -> list[int]:
    """The row of each pair found: of an id with several vectors the one with the best score."""
    order = np.argsort(ids, kind="stable")
    wanted = found.column("vec_id").to_numpy()
    low, high = (np.searchsorted(ids[order], wanted, side) for side in ("left", "right"))
    which = np.searchsorted(queries, found.column("query_id").to_numpy())
    rows = []
    for n, (lo, hi) in enumerate(zip(low, high, strict=True)):
        own = order[lo:hi]
        rows.append(int(own[0] if hi - lo == 1 else own[inner_products(q[which[n] : which[n] + 1], x[own])[0].argmax()]))
    return rows


def _compare_with(ids: np.ndarray, q: np.ndarray, k: int):
    """The k best of a task's rows for each of a few queries, with their codes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, x = batch.column("id").to_numpy(), _from_raw(batch.column("vector"), q.shape[1])
            for found in _best(ids, q, own, x, k):
                rows = pa.array(_rows_of(found, ids, q, own, x), pa.int64())
                yield found.append_column("codes", batch.column("codes").take(rows))

    return run


def fitted_probes(hashed: DataFrame, space: Space, k: int) -> int:
    """The least number of probes in every table that finds `RECALL` of the neighbours of `SAMPLE` queries."""
    sample = hashed.where("query").orderBy(F.xxhash64(F.lit(6), "id"), "id").select("id", "vector").limit(SAMPLE).toArrow()
    if sample.num_rows == 0:
        return 1
    ids, q = sample["id"].to_numpy(), _from_raw(sample["vector"].combine_chunks(), space.dimension)
    ids, first = np.unique(ids, return_index=True)
    q = q[first]
    near = hashed.mapInArrow(_compare_with(ids, q, k), _FOUND + ", codes array<int>")
    near = near.groupBy("query_id", "vec_id").agg(F.max(F.struct("score", "codes")).alias("b")).select("query_id", "vec_id", "b.*")
    near = _ranked(near, k).toArrow()  # at most SAMPLE * k rows
    if near.num_rows == 0:
        return 1
    which = np.searchsorted(ids, near["query_id"].to_numpy())
    codes = np.array(near["codes"].to_pylist())
    place = np.full(len(codes), space.axes)
    for t, flips in enumerate(space.signs()):
        order = np.argsort(np.argsort(-axes(space.padded(q, stored=False), flips), axis=1, kind="stable"), axis=1, kind="stable")
        place = np.minimum(place, order[which, codes[:, t] - t * space.axes])
    return int(np.sort(place)[int(np.ceil(RECALL * len(place))) - 1]) + 1


def _best(queries: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    scores = inner_products(q, x)
    distinct = np.unique(ids)
    if len(distinct) < len(ids):
        # An id takes one place, with its best row.
        order = np.argsort(ids, kind="stable")
        scores, ids = np.maximum.reduceat(scores[:, order], np.searchsorted(ids[order], distinct), axis=1), distinct
    scores[queries[:, None] == ids[None, :]] = -np.inf
    if len(ids) > k:
        # All that reach the k-th best, then by score and id.
        floor = -np.partition(-scores, k - 1, axis=1)[:, k - 1 : k]
    else:
        floor = np.full((len(q), 1), -np.inf)
    rows, columns = np.nonzero((scores >= floor) & (scores > -np.inf))
    values, found = scores[rows, columns], ids[columns]
    order = np.lexsort((found, -values, rows))
    rows, values, found = rows[order], values[order], found[order]
    heads = np.searchsorted(rows, np.arange(len(q)))
    keep = np.arange(len(rows)) - heads[rows] < k
    yield pa.record_batch({"query_id": queries[rows[keep]], "vec_id": found[keep], "score": values[keep]})


def _compare(dimension: int, k: int):
    """Rows come by part, points before queries; a part's points are held, its queries stream by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, ids, points = None, [], []
        held: tuple[np.ndarray, np.ndarray] | None = None
        for batch in batches:
            buckets, splits = batch.column("bucket").to_numpy(), batch.column("split").to_numpy()
            query = batch.column("query").to_numpy(zero_copy_only=False)
            own = batch.column("id").to_numpy()
            x = _from_raw(batch.column("vector"), dimension)
            change = np.ones(len(own), bool)
            change[1:] = (buckets[1:] != buckets[:-1]) | (splits[1:] != splits[:-1]) | (query[1:] != query[:-1])
            cuts = np.append(np.flatnonzero(change), len(own))
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                name = (buckets[lo], splits[lo])
                if name != part:
                    part, ids, points, held = name, [], [], None
                if not query[lo]:
                    ids.append(own[lo:hi])
                    points.append(x[lo:hi])
                    continue
                if not ids:
                    continue
                if held is None:
                    held = np.concatenate(ids), np.concatenate(points)
                for at in range(lo, hi, QUERIES):
                    to = min(hi, at + QUERIES)
                    yield from _best(own[at:to], x[at:to], *held, k)

    return run


def _search(hashed: DataFrame, asked: DataFrame, parts: DataFrame, dimension: int, k: int) -> DataFrame:
    """`asked`: id, vector, bucket for every probe. The best of every part for every query."""
    points = hashed.select("id", "vector", F.explode("codes").alias("bucket"))
    points = points.join(F.broadcast(parts), "bucket").select(
        "bucket", F.pmod(F.xxhash64("id", "vector"), "parts").alias("split"), F.lit(False).alias("query"), "id", "vector"
    )
    probes = asked.join(F.broadcast(parts), "bucket").select(
        "bucket", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("split"), F.lit(True).alias("query"), "id", "vector"
    )
    dealt = points.unionByName(probes).repartition("bucket", "split").sortWithinPartitions("bucket", "split", "query")
    return dealt.mapInArrow(_compare(dimension, k), _FOUND)


def nearest(
    vectors: DataFrame, queries: Column, k: int = 20, id_column: str = "vec_id", vector_column: str = "embedding", tables: int = TABLES
) -> DataFrame:
    """query_id, rank, vec_id, score: the `k` rows of largest inner product found for rows where `queries` holds."""
    vector = F.col(vector_column).cast("array<double>")
    sound = vectors.select(
        F.col(id_column).cast("long").alias("id"), vector.alias("vector"), F.coalesce(queries, F.lit(False)).alias("query")
    ).where(
        F.col("id").isNotNull()
        & F.col("vector").isNotNull()
        & F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
        & F.exists("vector", lambda v: v != 0)
    )
    length = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, v: s + v * v))
    sizes = sound.groupBy(F.size("vector").alias("d")).agg(F.count(F.lit(1)).alias("n"), F.max(length).alias("most"), F.min(length).alias("least"))
    usual = sizes.orderBy(F.desc("n"), "d").first()
    if usual is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    space = Space(usual["d"], usual["most"], usual["least"] > usual["most"] * (1 - 1e-5), tables)
    plain = tuple(vars(space).values())
    sound = sound.where(F.size("vector") == space.dimension)
    sound = sound.groupBy("id", "vector").agg(F.max("query").alias("query"))
    hashed = store(sound.mapInArrow(_hash(plain), _HASHED), "ann-hashed")
    buckets = hashed.select(F.explode("codes").alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    parts = store(buckets.select("bucket", F.ceil(F.col("n") / PART).alias("parts")), "ann-parts")  # a row a table and axis at most
    asking = hashed.where("query").select("id", "vector")
    asked = asking.mapInArrow(_probe(plain, fitted_probes(hashed, space, k)), _ASKED)
    found = _search(hashed, asked, parts, space.dimension, k).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    found = store(_ranked(found, k), "ann-found")

    # Queries with too few candidates look everywhere, which also makes small tables exact.
    full = found.where(F.col("rank") == k).select(F.col("query_id").alias("id"))
    short = store(asking.join(full, "id", "left_anti"), "ann-short")
    if not short.isEmpty():
        one = hashed.withColumn("codes", F.slice("codes", 1, 1))
        everywhere = short.mapInArrow(_probe((*plain[:3], 1), space.axes), _ASKED)
        more = _search(one, everywhere, parts, space.dimension, k).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        again = _ranked(more, k)
        found = found.join(short.select(F.col("id").alias("query_id")), "query_id", "left_anti").unionByName(again)
    return found.select("query_id", "rank", "vec_id", "score")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k)
