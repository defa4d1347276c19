"""Broadcasts behind a check of size, and outer joins that skew cannot pin to one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SMALL_ROWS = 500_000


def is_small(pinned: DataFrame, max_rows: int = SMALL_ROWS) -> bool:
    """Whether a pinned frame of narrow rows is short enough to broadcast; counts it now."""
    return pinned.limit(max_rows + 1).count() <= max_rows


def broadcast_when(small: bool, df: DataFrame) -> DataFrame:
    """A short list of changes meets a large table without shuffling the table."""
    return F.broadcast(df) if small else df


def left_join_many(one: DataFrame, many: DataFrame, key: Sequence[str]) -> DataFrame:
    """`one` left-joined to `many`, where a single key may own much of `many`.

    A left join cannot split its right side, an inner join can. So the matches
    are an inner join, and the rest are the keys missing from a distinct list.
    """
    matched = one.join(many, list(key))
    lonely = one.join(many.select(*key).distinct(), list(key), "left_anti")
    return matched.unionByName(lonely, allowMissingColumns=True)
