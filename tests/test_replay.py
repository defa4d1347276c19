"""Stateful operators against plain sequential loops, over many small blocks."""

import random

import numpy as np
import pytest

from stockyard.operators import admission, ledger, levels, limits, replay
from stockyard.operators.blocks import range_blocks, row_numbers, running_totals
from stockyard.session import store


def limiter_twin(calls, limit, window):
    """calls: (key, ms, id[, limit, window]) in any order."""
    state, out = {}, {}
    for c in sorted(calls, key=lambda c: (c[1], c[2])):
        lim, win = c[3:] if len(c) > 3 else (limit, window)
        kept = [t for t in state.get(c[0], []) if t > c[1] - win]
        ok = len(kept) < lim
        retry = 0 if ok else -((c[1] - win - kept[0]) // 1000)
        if ok:
            kept.append(c[1])
        state[c[0]] = kept
        n = len(kept)
        out[c[2]] = (ok, n, retry, max(0, lim - n))
    return out


def hot_calls(rng, n, keys=4, span=4000):
    """A third of the rows and more under one key, with ties in time."""
    return [
        (0 if rng.random() < 0.5 else rng.randrange(keys), rng.randrange(span), i)
        for i in range(n)
    ]


def verdicts(df):
    return {r.id: (r.allowed, r.current_count, r.retry_after_s, r.remaining) for r in df.collect()}


@pytest.mark.parametrize("limit,window,blocks", [(1, 7, 6), (3, 50, 7), (10, 40, 5), (3, 4000, 6)])
def test_limiter_blocks(spark, limit, window, blocks):
    calls = hot_calls(random.Random(limit * window), 1500)
    df = spark.createDataFrame(calls, "user BIGINT, ms BIGINT, id BIGINT")
    got = limits.limit_sliding(df, "user", "ms", "id", limit, window, blocks)
    assert verdicts(got) == limiter_twin(calls, limit, window)


@pytest.mark.parametrize("state_bytes", [-1, 1 << 20])
def test_limiter_single_key_never_forgets_phase(spark, monkeypatch, state_bytes):
    """A saturated key with even spacing: no block border is a fresh start."""
    monkeypatch.setattr(replay, "BROADCAST_STATE_BYTES", state_bytes)
    monkeypatch.setattr(replay, "WALK_BLOCKS", 3)
    calls = [("k", 3 * i, i) for i in range(600)]
    df = spark.createDataFrame(calls, "user STRING, ms BIGINT, id BIGINT")
    got = limits.limit_global(df, "ms", "id", preset=(2, 100), blocks=9)
    assert verdicts(got) == limiter_twin(calls, 2, 100)


def test_states_as_rows(spark, monkeypatch):
    monkeypatch.setattr(replay, "BROADCAST_STATE_BYTES", -1)
    calls = hot_calls(random.Random(8), 1200) + [(None, i % 300, 5000 + i) for i in range(400)]
    df = spark.createDataFrame(calls, "user BIGINT, ms BIGINT, id BIGINT")
    got = limits.limit_sliding(df, "user", "ms", "id", 3, 60, 7)
    assert verdicts(got) == limiter_twin(calls, 3, 60)


def test_vector_form_equals_row_form():
    import numpy as np
    import pyarrow as pa

    rng = random.Random(6)
    for _ in range(400):
        limit, window = rng.randrange(0, 6), rng.randrange(1, 60)
        keys = [sorted(rng.randrange(200) for _ in range(rng.randrange(1, 40))) for _ in range(rng.randrange(1, 5))]
        held = sorted(keys[0][0] - rng.randrange(0, window) for _ in range(rng.randrange(0, limit + 1)))
        held = held[:limit]
        starts = np.cumsum([0, *map(len, keys[:-1])])
        args = [pa.array([t for k in keys for t in k], pa.int64())]
        step = replay.row_by_row(lambda s, r: limits.window_step(s, (r[0], limit, window)))
        want, want_state = step(list(held), args, starts)
        got, state = limits.window_run(limit, window)(list(held), args, starts)
        assert [list(map(int, c)) for c in got] == [list(map(int, c)) for c in want]
        assert state == want_state


def test_limiter_one_instant(spark):
    calls = [("k", 5, i) for i in range(300)] + [("k", 2000, 300)]
    df = spark.createDataFrame(calls, "user STRING, ms BIGINT, id BIGINT")
    got = verdicts(limits.limit_global(df, "ms", "id", preset=(7, 1000), blocks=4))
    assert got == limiter_twin(calls, 7, 1000)
    assert sum(v[0] for v in got.values()) == 8


def test_shared_key(spark):
    rng = random.Random(5)
    calls = [(k, ms, i, *rng.choice([(2, 30), (5, 90), (3, 10)])) for k, ms, i in hot_calls(rng, 800, 3, 1500)]
    df = spark.createDataFrame(calls, "user BIGINT, ms BIGINT, id BIGINT, limit INT, window_ms BIGINT")
    assert verdicts(limits.limit_rows(df, ["user"], "ms", "id", blocks=5)) == limiter_twin(calls, 0, 0)


def test_real_presets_on_bursts(spark):
    rng = random.Random(9)
    calls = [(rng.randrange(3), rng.randrange(60_000), i) for i in range(900)]
    df = spark.createDataFrame(calls, "user_id BIGINT, ms BIGINT, id BIGINT")
    assert verdicts(limits.limit_user(df, "ms", "id", blocks=3)) == limiter_twin(calls, 10, 10_000)
    assert verdicts(limits.limit_buy(df, "ms", "id", blocks=3)) == limiter_twin(calls, 3, 30_000)
    assert verdicts(limits.limit_auth(df.withColumnRenamed("user_id", "ip"), "ms", "id")) == limiter_twin(
        calls, 5, 60_000
    )
    burst = [("k", 500 + i // 4, i) for i in range(3000)]
    df = spark.createDataFrame(burst, "user STRING, ms BIGINT, id BIGINT")
    assert verdicts(limits.limit_global(df, "ms", "id", blocks=4)) == limiter_twin(burst, 1000, 1000)


def test_limiter_never_exceeds_limit(spark):
    calls = hot_calls(random.Random(1), 1200)
    df = spark.createDataFrame(calls, "user BIGINT, ms BIGINT, id BIGINT")
    ok = limits.limit_sliding(df, "user", "ms", "id", 4, 60, 5).filter("allowed")
    seen = {}
    for r in ok.orderBy("ms", "id").collect():
        kept = [t for t in seen.get(r.key, []) if t > r.ms - 60] + [r.ms]
        seen[r.key] = kept
        assert len(kept) <= 4


def test_chain(spark):
    rng = random.Random(3)
    calls = [(rng.randrange(5), rng.randrange(3000), i) for i in range(900)]
    df = spark.createDataFrame(calls, "user_id BIGINT, ms BIGINT, id BIGINT")
    rates = {"global": (40, 100), "user": (5, 200), "buy": (3, 300)}
    got = {r.id: r.stopped_by for r in limits.limit_chain(df, "ms", "id", presets=rates, blocks=3).collect()}
    state, want = {}, {}
    for user, ms, i in sorted(calls, key=lambda c: (c[1], c[2])):
        want[i] = None
        for name, key in (("global", "all"), ("user", user), ("buy", user)):
            lim, win = rates[name]
            kept = [t for t in state.get((name, key), []) if t > ms - win]
            if len(kept) < lim:
                state[name, key] = kept + [ms]
            else:
                state[name, key] = kept
                want[i] = name
                break
    assert got == want


def test_pressure_counts_ties(spark):
    calls = hot_calls(random.Random(4), 800, 3, 300)
    df = spark.createDataFrame(calls, "user BIGINT, ms BIGINT, id BIGINT")
    rows = limits.attempt_pressure(df, "user", "ms", 37, blocks=4).collect()
    got = {(r.key, r.ms): r.in_window for r in rows}
    assert len(got) == len(rows) and sum(r.attempts for r in rows) == len(calls)
    for k, ms, _ in calls:
        assert got[k, ms] == sum(1 for q, t, _ in calls if q == k and ms - 37 < t <= ms)


def ledger_twin(events, totals, creates=False, units="per_order"):
    level, out = dict(totals), {}
    for k, ts, i, d in sorted(events, key=lambda e: (e[1], e[2])):
        n = 1 if units == "per_order" else abs(d)
        d = n if d > 0 else -n
        now = level.get(k)
        if now is None:
            if d > 0 and creates:
                level[k] = d
                out[i] = (d, True, None)
            else:
                out[i] = (None, False, "SALE_NOT_FOUND" if d < 0 else None)
        elif d < 0 and (now <= 0 if units == "per_order" else now < n):
            out[i] = (now, False, "OUT_OF_STOCK")
        else:
            level[k] = now + d
            out[i] = (now + d, True, None)
    return out


@pytest.mark.parametrize("units", ["per_order", "quantity"])
@pytest.mark.parametrize("creates", [False, True])
def test_ledger(spark, units, creates):
    rng = random.Random(11)
    events = [
        (0 if rng.random() < 0.5 else rng.randrange(6), rng.randrange(200), i, rng.choice([-3, -1, -1, -2, 1, 2]))
        for i in range(1500)
    ]
    totals = {0: 20, 1: 0, 2: 5, 3: 1}
    df = spark.createDataFrame(events, "k BIGINT, ts BIGINT, id BIGINT, delta INT")
    stock = spark.createDataFrame(list(totals.items()), "k BIGINT, total_qty INT")
    rows = ledger.stock_ledger(df, stock, ["k"], units, creates, blocks=6).collect()
    assert {r.id: (r.level, r.success, r.reason) for r in rows} == ledger_twin(events, totals, creates, units)
    assert all(r.level is None or r.level >= 0 for r in rows)


def stepped(level, deltas):
    for d in deltas:
        level = level if level + d < 0 else level + d
        yield level


def test_level_tables_equal_steps():
    rng = random.Random(3)
    for _ in range(150):
        starts, entry, deltas, want = [], [], [], []
        for _ in range(rng.randint(1, 5)):
            own = [rng.choice([-9, -3, -1, -1, 2, 1, 0, 5]) for _ in range(rng.choice([1, 3, 40, 200]))]
            starts.append(len(deltas))
            entry.append(rng.choice([0, 3, 50, 1000]))
            deltas += own
            want += stepped(entry[-1], own)
        delta = np.array(deltas)
        assert levels.levels_after(delta, np.array(starts), np.array(entry)).tolist() == want
        made = levels.BlockTable(-int(delta[delta < 0].sum()))
        cut = rng.randint(1, len(delta))
        for part in (delta[:cut], delta[cut:]):
            if len(part):
                made.add(part)
        table = made.table()
        for level in (0, 1, 2, 7, 30, len(table) - 1, len(table) + 5):
            got = table[level] if level < len(table) else level + made.net
            assert got == list(stepped(level, deltas))[-1]


@pytest.mark.parametrize("blocks", [2, 16])
def test_quantity_ledger_of_one_hot_key(spark, monkeypatch, blocks):
    rng = random.Random(blocks)
    events = [(7 if rng.random() < 0.95 else None, 0, i, rng.choice([-400, -3, -7, -1, 2, 5, 1])) for i in range(3000)]
    df = spark.createDataFrame(events, "k BIGINT, ts BIGINT, id BIGINT, delta INT")
    stock = spark.createDataFrame([(7, 500)], "k BIGINT, total_qty INT")
    stored = []
    monkeypatch.setattr(levels, "store", lambda d, name: stored.append(name) or store(d, name))
    rows = ledger.stock_ledger(df, stock, ["k"], "quantity", blocks=blocks).collect()
    assert {r.id: (r.level, r.success, r.reason) for r in rows} == ledger_twin(events, {7: 500}, False, "quantity")
    assert stored == ["level-tables"]  # one pass for the tables, however many blocks


@pytest.mark.parametrize("ts", ["0", "id % 1000"])
def test_hot_key_is_cut_into_even_blocks(spark, ts):
    df = spark.range(60_000).selectExpr("IF(id % 10 < 9, 1, id) AS k", f"{ts} AS ts", "id")
    sizes = [r["count"] for r in range_blocks(df, ["k"], ["ts", "id"], 8).groupBy("block").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * 60_000 / 8


def test_running_totals_and_ranks(spark):
    rng = random.Random(2)
    rows = [(0 if rng.random() < 0.6 else rng.randrange(5), rng.randrange(3), i, rng.randrange(-4, 5))
            for i in range(700)]
    df = spark.createDataFrame(rows, "k BIGINT, ts BIGINT, id BIGINT, x INT")
    blocked = range_blocks(df, ["k"], ["ts", "id"], 6)
    assert blocked.select("block").distinct().count() > 3
    got = {r.id: (r.run_sum, r.low_before) for r in running_totals(blocked, ["k"], "x").collect()}
    ranks = {r.id: r.rn for r in row_numbers(df, ["k"], ["ts", "id"], blocks=6).collect()}
    for k in range(5):
        total, low = 0, None
        own = sorted((r for r in rows if r[0] == k), key=lambda r: (r[1], r[2]))
        for n, r in enumerate(own, 1):
            total += r[3]
            assert got[r[2]] == (total, low)
            assert ranks[r[2]] == n
            low = total if low is None else min(low, total)


def admission_twin(log, totals):
    level, live, out = dict(totals), {}, {}
    for s, p, ts, i, kind, u in sorted(log, key=lambda r: (r[2], r[3])):
        k, held = (s, p), live.setdefault((s, p), set())
        if kind == "release":
            if u in held:
                held.discard(u)
                level[k] += 1
                out[i] = "RELEASED"
            else:
                out[i] = "IGNORED"
        elif u in held:
            out[i] = "ALREADY_PURCHASED"
        elif level.get(k) is None:
            out[i] = "SALE_NOT_FOUND"
        elif level[k] <= 0:
            out[i] = "OUT_OF_STOCK"
        else:
            held.add(u)
            level[k] -= 1
            out[i] = "ADMITTED"
    return out


def test_admission(spark):
    rng = random.Random(21)
    log = [
        (1, 0 if rng.random() < 0.5 else rng.randrange(5), rng.randrange(300), i,
         "request" if rng.random() < 0.7 else "release", rng.randrange(40))
        for i in range(1500)
    ]
    totals = {(1, 0): 12, (1, 1): 3, (1, 2): 0, (1, 3): 60}
    df = spark.createDataFrame(log, "sale_id BIGINT, product_id BIGINT, ts BIGINT, id BIGINT, kind STRING, user_id BIGINT")
    stock = spark.createDataFrame([(*k, v) for k, v in totals.items()], "sale_id BIGINT, product_id BIGINT, total_qty INT")
    got = {r.id: r.outcome for r in admission.admit_with_releases(df, stock, blocks=6).collect()}
    assert got == admission_twin(log, totals)

    tries = [r for r in log if r[4] == "request"]
    df = df.filter("kind = 'request'").withColumnRenamed("id", "request_id").drop("kind")
    rows = admission.admit_requests(df, stock, blocks=5).collect()
    assert {r.request_id: r.outcome for r in rows} == admission_twin(tries, totals)
    for k, n in totals.items():
        mine = [r for r in rows if (r.sale_id, r.product_id) == k and r.outcome == "ADMITTED"]
        assert len(mine) <= n and len({r.user_id for r in mine}) == len(mine)
        assert sorted(r.items_remaining for r in mine) == list(range(n - len(mine), n))


def test_idempotent_without_key(spark):
    df = spark.createDataFrame(
        [(1, "a", 5), (2, "a", 4), (3, None, 1), (4, None, 1)], "id BIGINT, idempotency_key STRING, ts BIGINT"
    )
    got = {r.id: (r.first_id, r.is_duplicate) for r in admission.idempotent_dedupe(df).collect()}
    assert got == {1: (2, True), 2: (2, False), 3: (3, False), 4: (4, False)}


@pytest.mark.parametrize("blocks", [1, 7])
def test_gate_against_the_status_told_so_far(spark, blocks):
    rng = random.Random(blocks)
    changes = [(0 if rng.random() < 0.6 else rng.randrange(4), rng.randrange(300), i, rng.choice(["SCHEDULED", "ACTIVE", "ENDED"])) for i in range(200)]
    asked = [(i, 0 if rng.random() < 0.6 else rng.randrange(6), rng.randrange(3), rng.randrange(300)) for i in range(600)]
    want = {}
    for i, sale, product, ts in asked:
        told = [(at, seq, status) for k, at, seq, status in changes if k == sale and at <= ts]
        status = max(told)[2] if told else None
        gate = "SALE_NOT_FOUND" if status is None else "SALE_NOT_ACTIVE" if status != "ACTIVE" else None if product < 2 else "PRODUCT_NOT_IN_SALE"
        want[i] = (status, gate)
    offered = spark.createDataFrame([(s, p) for s in range(4) for p in range(2)], "sale_id BIGINT, product_id BIGINT")
    got = admission.gate_as_of(
        spark.createDataFrame(asked, "request_id BIGINT, sale_id BIGINT, product_id BIGINT, ts BIGINT"),
        spark.createDataFrame(changes, "sale_id BIGINT, changed_at BIGINT, seq BIGINT, status STRING"),
        offered,
        blocks=blocks,
    ).collect()
    assert {r.request_id: (r.sale_status, r.gate) for r in got} == want and len(got) == len(asked)
