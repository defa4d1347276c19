"""Sliding-window rate limits replayed over a request log.

A call evicts entries at or before now - window, is refused when `limit` entries
remain, and is recorded only when allowed. Refusals are not recorded, so this is
a replay and not a RANGE window count; `attempt_pressure` is the latter.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockyard.operators.blocks import range_blocks, running_totals
from stockyard.operators.replay import Run, replay, row_by_row
from stockyard.session import store
from stockyard.shipping import ship_by_value

ship_by_value(__name__)

# Fixed values: (limit, window in ms) of each route's limiter.
PRESETS = {
    "user": (10, 10_000),
    "buy": (3, 30_000),
    "global": (1000, 1_000),
    "auth": (5, 60_000),
    "order_reads": (30, 10_000),
    "product_writes": (20, 60_000),
}

_VERDICT = "allowed BOOLEAN, current_count INT, retry_after_s BIGINT, remaining INT"


def window_step(state: list, row: tuple) -> tuple:
    """One limiter call; `state` holds the recorded times, oldest first."""
    ms, limit, window = row
    floor = ms - window
    drop = 0
    for t in state:
        if t > floor:
            break
        drop += 1
    if drop:
        del state[:drop]
    n = len(state)
    if n >= limit:
        retry = -((ms - window - state[0]) // 1000) if state else 0
        return False, n, retry, max(0, limit - n)
    state.append(ms)
    return True, n + 1, 0, max(0, limit - n - 1)


def window_run(limit: int, window_ms: int) -> Run:
    """`window_step` over many rows at once, for one limit and window.

    Keys are laid end to end on one time axis, more than a window apart. A full
    key admits its next call at the first one a window after the call admitted
    `limit` admissions earlier, so only admitted calls are stepped through.
    """
    by_row = row_by_row(lambda state, row: window_step(state, (row[0], limit, window_ms)))

    def run(state: list, args: list, starts: np.ndarray) -> tuple[list, list]:
        ms = args[0].to_numpy(zero_copy_only=False).astype(np.int64)
        held = np.asarray(state, dtype=np.int64)
        zero = int(min(ms.min(), held.min())) if state else int(ms.min())
        apart = int(ms.max()) - zero + window_ms + 1
        if limit <= 0 or apart * len(starts) >= 1 << 62:
            return by_row(state, args, starts)
        c, n = len(held), len(ms)
        place = np.zeros(n, dtype=np.int64)
        place[starts[1:]] = apart
        t = np.concatenate((held - zero, ms - zero + np.cumsum(place)))
        free_at = np.searchsorted(t, t + window_ms, "left").tolist()
        # Up to the first call of a key that has `limit` calls within its window, all are admitted.
        crowded = np.append(np.flatnonzero(t[limit:] - t[:-limit] < window_ms) + limit, c + n)
        lows = starts + c
        highs = np.append(lows[1:], c + n)
        open_to = np.minimum(crowded[np.searchsorted(crowded, lows)], highs)
        admitted = list(range(c))
        first = 0
        for lo, hi, free in zip(lows.tolist(), highs.tolist(), open_to.tolist(), strict=True):
            if lo > c:
                first = len(admitted)
            admitted.extend(range(lo, free))
            i = free
            while i < hi:
                oldest = len(admitted) - limit
                if oldest >= first and free_at[admitted[oldest]] > i:
                    i = free_at[admitted[oldest]]
                    continue
                admitted.append(i)
                i += 1
        inside = np.asarray(admitted, dtype=np.int64)
        flag = np.zeros(c + n, dtype=bool)
        flag[inside] = True
        inside_t, now = t[inside], t[c:]
        expired = np.searchsorted(inside_t, now - window_ms, "right")
        count = np.cumsum(flag)[c:] - expired
        allowed = flag[c:]
        retry = np.zeros(n, dtype=np.int64)
        retry[~allowed] = -((now[~allowed] - window_ms - inside_t[expired[~allowed]]) // 1000)
        live = inside_t[max(first, len(admitted) - limit) :]
        live = live[live > now[-1] - window_ms] - now[-1] + ms[-1]
        return [allowed, count, retry, np.maximum(0, limit - count)], live.tolist()

    return run


def limit_rows(
    df: DataFrame, key: Sequence[str], ms: str, id_: str, blocks: int | None = None, carry: Sequence[str] = ()
) -> DataFrame:
    """Replay with per-row `limit` and `window_ms` columns (routes that share one key)."""
    calls = df.select(
        *key,
        F.col(ms).cast("bigint").alias(ms),
        id_,
        F.col("limit").cast("int").alias("limit"),
        F.col("window_ms").cast("bigint").alias("window_ms"),
        *carry,
    )
    return replay(calls, key, [ms, id_], [ms, "limit", "window_ms"], row_by_row(window_step), _VERDICT, blocks, carry)


def limit_sliding(
    df: DataFrame,
    key: str | Column,
    ms: str,
    id_: str,
    limit: int,
    window_ms: int,
    blocks: int | None = None,
    carry: Sequence[str] = (),
) -> DataFrame:
    """One (limit, window) for all rows: key, ms, id, carried columns and the verdict columns."""
    key_col = F.col(key) if isinstance(key, str) else key
    calls = df.select(key_col.alias("key"), F.col(ms).cast("bigint").alias(ms), id_, *carry)
    return replay(calls, ["key"], [ms, id_], [ms], window_run(limit, window_ms), _VERDICT, blocks, carry)


def limit_user(df, ms, id_, user="user_id", ip=None, preset=PRESETS["user"], blocks=None, carry=()) -> DataFrame:
    """Per user, or per address for calls without a user."""
    key = F.col(user).cast("string")
    if ip:
        key = F.coalesce(key, F.col(ip))
    return limit_sliding(df, key, ms, id_, *preset, blocks=blocks, carry=carry)


def limit_buy(df, ms, id_, user="user_id", ip=None, preset=PRESETS["buy"], blocks=None, carry=()) -> DataFrame:
    return limit_user(df, ms, id_, user, ip, preset, blocks, carry)


def limit_global(df, ms, id_, preset=PRESETS["global"], blocks=None, carry=()) -> DataFrame:
    """One key for all calls; range blocks still spread it over the cluster."""
    return limit_sliding(df, F.lit("orders"), ms, id_, *preset, blocks=blocks, carry=carry)


def limit_auth(df, ms, id_, ip="ip", preset=PRESETS["auth"], blocks=None) -> DataFrame:
    return limit_sliding(df, F.col(ip).cast("string"), ms, id_, *preset, blocks=blocks)


def limit_chain(
    df: DataFrame,
    ms: str,
    id_: str,
    user: str = "user_id",
    presets: dict | None = None,
    blocks: int | None = None,
    carry: Sequence[str] = (),
) -> DataFrame:
    """global -> user -> buy; a call meets the next limiter only if the last one let it pass.

    Adds `stopped_by` (NULL when all three let it pass) and `retry_after_s`.
    Columns travel with the calls, so the stages need no joins. The first two
    results are pinned: the next stage reads them to find its ranges, to lay
    out its blocks, and for the calls that stopped there.
    """
    rates = {**PRESETS, **(presets or {})}
    columns = ["user_id", "ms", "id", *carry]
    calls = df.select(F.col(user).alias("user_id"), F.col(ms).alias("ms"), F.col(id_).alias("id"), *carry)
    first = store(limit_global(calls, "ms", "id", rates["global"], blocks, ["user_id", *carry]))
    passed = first.filter("allowed").select(*columns)
    second = store(
        limit_user(passed, "ms", "id", preset=rates["user"], blocks=blocks, carry=["user_id", *carry])
    )
    passed = second.filter("allowed").select(*columns)
    third = limit_buy(passed, "ms", "id", preset=rates["buy"], blocks=blocks, carry=["user_id", *carry])

    def result(verdicts: DataFrame, name: str) -> DataFrame:
        stopped = ~F.col("allowed")
        return verdicts.select(
            *columns,
            F.when(stopped, name).alias("stopped_by"),
            F.when(stopped, F.col("retry_after_s")).alias("retry_after_s"),
        )

    return (
        result(first.filter("NOT allowed"), "global")
        .unionByName(result(second.filter("NOT allowed"), "user"))
        .unionByName(result(third, "buy"))
    )


def attempt_pressure(df: DataFrame, key: str, ms: str, window_ms: int, blocks: int | None = None) -> DataFrame:
    """Attempts per key in (ms - window, ms] at each instant with an attempt.

    Attempts are first counted per (key, ms). Each count arrives at its instant
    and leaves a window later, leaving before arriving; the running sum of both
    is the count in the window. A RANGE frame would add up the whole window anew
    at every row.
    """
    instants = df.groupBy(F.col(key).alias("key"), F.col(ms).cast("bigint").alias("ms")).agg(
        F.count("*").alias("attempts")
    )
    moves = F.array(
        F.struct(F.col("ms").alias("at"), F.lit(1).alias("arrives"), F.col("attempts").alias("move")),
        F.struct((F.col("ms") + window_ms).alias("at"), F.lit(0).alias("arrives"), (-F.col("attempts")).alias("move")),
    )
    steps = instants.select("key", F.inline(moves))
    summed = running_totals(range_blocks(steps, ["key"], ["at", "arrives"], blocks), ["key"], "move", "in_window")
    return summed.filter("arrives = 1").select(
        "key", F.col("at").alias("ms"), F.col("move").alias("attempts"), "in_window"
    )
