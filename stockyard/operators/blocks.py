"""Ordered work on keyed rows in blocks of even size.

A key that holds a third of the table must not become one task. The rows are
range-partitioned on (key, order), so such a key is cut into many neighbouring
blocks even when all its rows share one timestamp. At most one key continues
from one block into the next, hence whatever is carried over a border has at
most one row per block.

Range borders are sampled, so the layout is pinned with a reliable checkpoint
before two plans read it.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockyard.session import pin, store

_ROW_BITS = 33


def range_blocks(df: DataFrame, key: Sequence[str], order: Sequence[str], blocks: int | None = None) -> DataFrame:
    """Add `block` and `pos` (place in the block); (key, order) should be unique.

    `order` takes names or sort expressions.

    Without `blocks` the number follows spark.sql.shuffle.partitions, and
    adaptive execution merges small neighbours.
    """
    return pin(_placed(df, key, order, blocks))


def _placed(df: DataFrame, key: Sequence[str], order: Sequence[str], blocks: int | None) -> DataFrame:
    cols = [*key, *order]
    ranged = df.repartitionByRange(blocks, *cols) if blocks else df.repartitionByRange(*cols)
    placed = ranged.sortWithinPartitions(*cols).withColumn("_row", F.monotonically_increasing_id())
    return (
        placed.withColumn("block", F.shiftright("_row", _ROW_BITS).cast("int"))
        .withColumn("pos", F.col("_row").bitwiseAND(F.lit((1 << _ROW_BITS) - 1)))
        .drop("_row")
    )


def running_totals(
    blocked: DataFrame, key: Sequence[str], value: str, total: str = "run_sum", low: str = "low_before"
) -> DataFrame:
    """Per key, in order: the running sum of `value` and the lowest earlier running sum (NULL at first).

    Scan inside each block, then add a carry to each block that continues a key.
    Such a key is the first one of some block, so carries are computed from the
    rows of those keys alone. Both the list of first keys and the carries have
    at most one row per block and are broadcast.
    """

    def like(prefix: str) -> Column:
        return reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(prefix + c)) for c in key])

    inner = Window.partitionBy("block", *key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    earlier = inner.rowsBetween(Window.unboundedPreceding, -1)

    def scan(df: DataFrame) -> DataFrame:
        return df.withColumn("_sum", F.sum(F.col(value).cast("bigint")).over(inner))

    firsts = blocked.filter("pos = 0").select(*[F.col(c).alias(f"_f_{c}") for c in key]).distinct()
    per_block = (
        scan(blocked.select("block", "pos", value, *key).join(F.broadcast(firsts), like("_f_"), "left_semi"))
        .groupBy("block", *key)
        .agg(F.max_by("_sum", "pos").alias("_bsum"), F.min("_sum").alias("_bmin"))
    )
    before = Window.partitionBy(*key).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        per_block.withColumn("_sum_before", F.sum("_bsum").over(before))
        .withColumn("_abs_min", F.coalesce("_sum_before", F.lit(0)) + F.col("_bmin"))
        .withColumn("_min_before", F.min("_abs_min").over(before))
        .filter(F.col("_sum_before").isNotNull())
        .select(
            F.col("block").alias("_c_block"), *[F.col(c).alias(f"_c_{c}") for c in key], "_sum_before", "_min_before"
        )
    )
    joined = (
        scan(blocked)
        .withColumn("_min", F.min("_sum").over(earlier))
        .join(F.broadcast(carry), (F.col("block") == F.col("_c_block")) & like("_c_"), "left")
    )
    offset = F.coalesce("_sum_before", F.lit(0))
    return joined.select(
        *[c for c in blocked.columns],
        (offset + F.col("_sum")).alias(total),
        F.least(F.col("_min_before"), offset + F.col("_min")).alias(low),
    )


def row_numbers(df: DataFrame, key: Sequence[str], order: Sequence[str], name: str = "rn", blocks=None) -> DataFrame:
    """row_number() per key without one task per key."""
    blocked = range_blocks(df.withColumn("_one", F.lit(1)), key, order, blocks)
    return running_totals(blocked, key, "_one", name, "_low").drop("_one", "_low", "block", "pos")


def stored_ranks(df: DataFrame, key: Sequence[str], order: Sequence[str], name: str = "rn") -> DataFrame:
    """row_number() per key for keys of many rows, whose rows may be equal in `order`.

    The sorted blocks are stored with every row's place, which is columnar and moves the rows once. A
    rank is the place plus what the block's part of the key begins with: a short
    table, as a block has few of such keys, and hence broadcast.
    """
    # The row id keeps equal rows apart, so that many of them still spread over the blocks.
    placed = _placed(df.withColumn("_id", F.monotonically_increasing_id()), key, [*order, "_id"], None)
    laid = store(placed.drop("_id"), "ranked")
    parts = laid.groupBy("block", *key).agg(F.count("*").alias("_n"), F.min("pos").alias("_first"))
    before = Window.partitionBy(*key).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select(
        F.col("block").alias("_s_block"),
        *[F.col(c).alias(f"_s_{c}") for c in key],
        (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first") + 1).alias("_start"),
    )
    same = reduce(
        lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_s_{c}")) for c in key], F.col("block") == F.col("_s_block")
    )
    return laid.join(F.broadcast(starts), same).select(*df.columns, (F.col("pos") + F.col("_start")).alias(name))


def last_values(blocked: DataFrame, key: Sequence[str], value: str, name: str) -> DataFrame:
    """Per key, in order: the last `value` so far that is not NULL, the row's own included.

    Scan inside each block; a block that continues a key gets what the blocks before it
    end with, at most one row per block and hence broadcast.
    """

    def like(prefix: str) -> Column:
        return reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(prefix + c)) for c in key])

    firsts = blocked.filter("pos = 0").select(*[F.col(c).alias(f"_f_{c}") for c in key]).distinct()
    known = F.col(value).isNotNull()
    per_block = (
        blocked.select("block", "pos", value, *key)
        .join(F.broadcast(firsts), like("_f_"), "left_semi")
        .groupBy("block", *key)
        .agg(F.max_by(F.when(known, F.col(value)), F.when(known, F.col("pos"))).alias("_ends_with"))
    )
    before = Window.partitionBy(*key).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        per_block.withColumn("_carried", F.last("_ends_with", ignorenulls=True).over(before))
        .filter(F.col("_carried").isNotNull())
        .select(F.col("block").alias("_c_block"), *[F.col(c).alias(f"_c_{c}") for c in key], "_carried")
    )
    inner = Window.partitionBy("block", *key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    scanned = blocked.withColumn("_own", F.last(value, ignorenulls=True).over(inner))
    joined = scanned.join(F.broadcast(carry), (F.col("block") == F.col("_c_block")) & like("_c_"), "left")
    return joined.select(*blocked.columns, F.coalesce("_own", "_carried").alias(name))
