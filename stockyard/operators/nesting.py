"""Headers with arrays of details, without one task or row per large group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockyard.operators.blocks import stored_ranks
from stockyard.operators.sizing import SMALL_ROWS, broadcast_when, is_small
from stockyard.session import store

MAX_ITEMS = 10_000
#: Details of one group that one task may rank.
IN_TASK = 100_000


def nest(
    details: DataFrame,
    by: Sequence[str],
    fields: Sequence[str],
    name: str,
    max_items: int = MAX_ITEMS,
    counted: DataFrame | None = None,
) -> DataFrame:
    """One row per group with a sorted array of structs, all details kept.

    The sorted details of a group are cut every `max_items`; each run is a row,
    numbered by `part` from 0, so the parts in order are the whole list. Nothing is
    ranked if no group has several parts; a group of at most `IN_TASK` details is
    ranked by the task that nests it, a larger one over blocks. Sizes come from
    `counted` if given, a table with at least the details of every group that is
    cheaper to read (the details before their joins). If one group is larger, all
    are ranked over blocks unless there are very many, so `details` is derived once.
    """
    counts = (details if counted is None else counted).groupBy(*by).agg(F.count("*").alias("_n"))
    most, groups = counts.agg(F.coalesce(F.max("_n"), F.lit(0)), F.count("*")).first()
    items = F.sort_array(F.collect_list(F.struct(*fields))).alias(name)
    part = F.expr(f"(_rank - 1) div {int(max_items)}").cast("int").alias("part")

    def listed(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*by, "part").agg(items).select(*by, "part", name)

    def parted(ranked: DataFrame) -> DataFrame:
        return listed(ranked.select(*by, *fields, part))

    if most <= max_items:
        return listed(details.withColumn("part", F.lit(0)))

    def ranked_in_tasks(rows: DataFrame) -> DataFrame:
        return rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy(*fields)))

    if most <= IN_TASK:
        return parted(ranked_in_tasks(details))

    def ranked_over_blocks(rows: DataFrame) -> DataFrame:
        return stored_ranks(rows.select(*by, *fields), by, fields, "_rank")

    if groups <= SMALL_ROWS:  # so few that a row for each may be broadcast
        return parted(ranked_over_blocks(details))
    large = store(counts.filter(F.col("_n") > IN_TASK).select(*by))
    marked = broadcast_when(is_small(large), large)
    small = details.join(marked, list(by), "left_anti")
    ranked = ranked_over_blocks(details.join(marked, list(by), "left_semi"))
    return parted(ranked_in_tasks(small)).unionByName(parted(ranked))


def headed(headers: DataFrame, nested: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """`headers` left-joined to their `nested` rows; `keys` has the key of every detail that was nested.

    A left join can only move the nested rows to their key, a task per header; an
    inner join broadcasts the headers when they turn out to be few.
    """
    matched = headers.join(nested, key)
    lonely = headers.join(keys.select(key).distinct(), key, "left_anti")
    return matched.unionByName(lonely, allowMissingColumns=True)


def digest(array: str, fields: Sequence[str]) -> Column:
    """An array of structs as text: fields joined by ',', elements by '|'."""
    return F.concat_ws(
        "|", F.transform(array, lambda x: F.concat_ws(",", *[x[f].cast("string") for f in fields]))
    )
