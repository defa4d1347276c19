"""Streams fed several files in order give the batch results."""

import random
from collections import namedtuple
from datetime import datetime, timedelta
from decimal import Decimal
from pathlib import Path
from types import SimpleNamespace

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stockyard.operators import ledger, limits, reports
from stockyard.plans.catalog import QUERIES
from stockyard.sources.events import event_stream
from stockyard.sources.fixtures import ts
from stockyard.streaming import processors, streams
from stockyard.streaming.folded import FoldedLog
from stockyard.streaming.processors import Deadline, OrderStatus

T0 = datetime(2024, 1, 1)


def staged(spark, tmp_path, df, order, files=4):
    """Write `df` in `order` as consecutive files and stream them one per batch."""
    rows = df.orderBy(order, *[c for c in df.columns if c == "id"]).collect()
    size = -(-len(rows) // files)
    for i in range(files):
        part = rows[i * size : (i + 1) * size]
        spark.createDataFrame(part, df.schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    return event_stream(spark, f"{tmp_path}/in", df.schema)


def test_stock_levels(spark, tmp_path):
    rng = random.Random(1)
    rows = [
        (1, 0 if rng.random() < 0.5 else rng.randrange(5), T0 + timedelta(seconds=i // 2), i, rng.choice([-1, -1, 1]))
        for i in range(600)
    ]
    df = spark.createDataFrame(rows, "sale_id BIGINT, product_id BIGINT, ts TIMESTAMP_NTZ, id BIGINT, delta INT")
    totals = spark.createDataFrame([(1, p, p) for p in range(4)], "sale_id BIGINT, product_id BIGINT, total_qty INT")
    want = ledger.stock_ledger(df, totals, ["sale_id", "product_id"]).collect()
    got = streams.run_to_files(
        streams.stock_level_stream(staged(spark, tmp_path, df, "ts"), totals), f"{tmp_path}/out"
    )
    assert sorted(map(tuple, got.select(*want[0].__fields__).collect()), key=repr) == sorted(map(tuple, want), key=repr)


def test_stock_events_that_come_again_change_nothing(spark, tmp_path):
    schema = "sale_id BIGINT, product_id BIGINT, ts TIMESTAMP_NTZ, id BIGINT, delta INT"
    rows = [(1, 0, T0 + timedelta(seconds=i), i, -1) for i in range(6)]
    for k, part in enumerate([rows[:3], rows[2:4] + rows[3:4], rows[3:]]):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/part{k}")
    whole = spark.read.parquet(*[f"{tmp_path}/part{k}" for k in range(3)])
    again = whole.withColumn("place", F.monotonically_increasing_id()).orderBy("place").drop("place")
    totals = spark.createDataFrame([(1, 0, 10)], "sale_id BIGINT, product_id BIGINT, total_qty INT")
    got = streams.run_to_files(streams.stock_level_stream(staged(spark, tmp_path, again, "ts", 3), totals), f"{tmp_path}/out")
    done = got.filter("success").collect()
    assert sorted(r.id for r in done) == list(range(6)) and min(r.level for r in done) == 4


def test_limits(spark, tmp_path):
    rng = random.Random(2)
    rows = sorted((T0 + timedelta(milliseconds=rng.randrange(90_000)), str(rng.randrange(4)), i) for i in range(600))
    rows = [(t, k, i) for i, (t, k, _) in enumerate(rows)]
    df = spark.createDataFrame(rows, "ts TIMESTAMP, key STRING, id BIGINT")
    want = limits.limit_sliding(df.withColumn("ms", F.unix_millis("ts")), "key", "ms", "id", 3, 5000)
    got = streams.run_to_files(
        streams.limit_stream(staged(spark, tmp_path, df, "ts"), 3, 5000, "0 seconds"), f"{tmp_path}/out"
    )
    assert got.filter("late").count() == 0
    cols = ["key", "ms", "id", "allowed", "current_count", "retry_after_s", "remaining"]
    assert sorted(map(tuple, got.select(cols).collect())) == sorted(map(tuple, want.select(cols).collect()))


def test_deadlines(spark, tmp_path):
    rng = random.Random(3)
    rows, want = [], set()
    end = T0 + timedelta(hours=3)
    for k in range(300):
        opened = T0 + timedelta(seconds=rng.randrange(7000))
        rows.append((k, opened, "open"))
        if rng.random() < 0.7:
            gap = rng.choice([0, 60, 899, 900, 901, 2000])
            rows.append((k, opened + timedelta(seconds=gap), "close"))
            if gap > 900:
                want.add(k)
        else:
            want.add(k)
    rows.append((-1, end, "tick"))
    df = spark.createDataFrame(rows, "key BIGINT, ts TIMESTAMP, kind STRING")
    alerts = streams.stuck_order_stream(staged(spark, tmp_path, df, "ts"), "0 seconds")
    got = streams.run_to_files(alerts, f"{tmp_path}/out")
    keys = [r.key for r in got.collect()]
    assert sorted(keys) == sorted(want)


def parts(spark, folder, *rows, schema):
    for part in rows:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
    return event_stream(spark, folder, spark.createDataFrame([], schema).schema)


def test_late_calls_get_a_verdict(spark, tmp_path):
    def call(hours, key, id_):
        return (T0 + timedelta(hours=hours), key, id_)

    calls = parts(
        spark, f"{tmp_path}/in", [call(0, "a", 1), call(2, "a", 2)], [call(1, "a", 3), call(0.1, "b", 4)],
        [call(3, "b", 5)], [call(1, "c", 6)], schema="ts TIMESTAMP, key STRING, id BIGINT",
    )
    got = streams.run_to_files(streams.limit_stream(calls, 3, 5000, "0 seconds"), f"{tmp_path}/out").collect()
    assert {r.id: (r.allowed, r.late) for r in got} == {
        1: (True, False), 2: (True, False), 3: (False, True), 4: (False, True), 5: (True, False), 6: (False, True)
    }


def test_late_openings_alert(spark, tmp_path):
    changes = parts(
        spark, f"{tmp_path}/in",
        [(1, T0, "open"), (9, T0 + timedelta(hours=2), "tick")],
        [(2, T0 + timedelta(minutes=1), "open"), (9, T0 + timedelta(hours=3), "tick")],
        [(9, T0 + timedelta(hours=4), "tick")],
        schema="key BIGINT, ts TIMESTAMP, kind STRING",
    )
    got = streams.run_to_files(streams.stuck_order_stream(changes), f"{tmp_path}/out")
    assert sorted(r.key for r in got.collect()) == [1, 2]


def test_requests_without_key_and_late_ones_stay(spark, tmp_path):
    old = T0 - timedelta(days=90)
    requests = parts(
        spark, f"{tmp_path}/in", [(None, T0, 1), (None, T0, 2), ("x", T0, 3)], [(None, old, 4), ("x", T0, 5), ("y", old, 6)],
        schema="idempotency_key STRING, ts TIMESTAMP, id BIGINT",
    )
    got = streams.run_to_files(streams.dedupe_stream(requests), f"{tmp_path}/out")
    assert sorted(r.id for r in got.collect()) == [1, 2, 3, 4, 6]


@pytest.mark.parametrize("name", [q for q in QUERIES if q.endswith("_stream")])
def test_folder_tables_stream_like_files(spark, tmp_path, name):
    source = "/root/testdata/sf0.001"
    times = {"events": "ts", "orders": "o_orderdate"}
    for table in ("customer", "part", "lineitem", "events", "orders"):
        df = spark.read.parquet(f"{source}/{table}.parquet")
        if table not in times:
            df.write.parquet(f"{tmp_path}/{table}.parquet")
            continue
        rows = df.orderBy(times[table], df.columns[0]).toArrow()
        for k in range(3):
            part = spark.createDataFrame(rows.slice(k * -(-len(rows) // 3), -(-len(rows) // 3)), df.schema)
            part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/{table}.parquet")
    want, got = QUERIES[name](spark, source), QUERIES[name](spark, str(tmp_path))
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_dedupe_and_route(spark, tmp_path):
    rows = [(f"k{i % 40}", T0 + timedelta(minutes=i), i) for i in range(200)]
    df = spark.createDataFrame(rows, "idempotency_key STRING, ts TIMESTAMP, id BIGINT")
    got = streams.run_to_files(streams.dedupe_stream(staged(spark, tmp_path, df, "ts")), f"{tmp_path}/out")
    assert sorted(r.id for r in got.collect()) == list(range(40))

    kinds = ["ORDER_CREATED", "CLICK", "PAYMENT_FAILED"]
    log = spark.createDataFrame(
        [(i, kinds[i % 3], "{}", i % 5 == 0, T0 + timedelta(seconds=i)) for i in range(60)],
        "id BIGINT, event_type STRING, payload STRING, published BOOLEAN, created_at TIMESTAMP_NTZ",
    )
    (tmp_path / "r").mkdir()
    routed = streams.route_stream(staged(spark, tmp_path / "r", log, "created_at"), f"{tmp_path}/routes")
    assert sorted(r.id for r in routed.collect()) == [i for i in range(60) if i % 3 != 1 and i % 5]


def test_sale_status_over_batches(spark, tmp_path):
    day = timedelta(days=1)
    sales = spark.createDataFrame(
        [(i, f"s{i}", T0 + i * day, T0 + (i + 2) * day, "SCHEDULED", T0) for i in range(4)],
        "id BIGINT, name STRING, start_time TIMESTAMP_NTZ, end_time TIMESTAMP_NTZ, status STRING, created_at TIMESTAMP_NTZ",
    )
    lines = spark.createDataFrame(
        [(i * 10, i, 1, 5, 0) for i in range(4)], "id BIGINT, sale_id BIGINT, product_id BIGINT, total_qty INT, reserved_qty INT"
    )
    inventory = lines.select(F.col("id").alias("sale_product_id"), F.col("total_qty").alias("available_qty"), ts("2024-01-01 00:00:00").alias("last_synced_at"))
    counters = spark.createDataFrame([], "sale_product_id BIGINT, live_qty INT")
    ticks = spark.createDataFrame([(T0 + i * day, i) for i in range(4)], "ts TIMESTAMP_NTZ, id BIGINT")
    state = {"sales": sales, "sale_products": lines, "inventory": inventory, "counters": counters}
    feed = streams.sale_status_stream(staged(spark, tmp_path, ticks, "ts"), state, f"{tmp_path}/out")
    got = sorted((r.sale_id, r.status) for r in feed.collect())
    assert got == sorted([(i, "ACTIVE") for i in range(4)] + [(i, "ENDED") for i in range(2)])
    now = streams.sale_state(state, f"{tmp_path}/out")
    assert dict(now["sales"].select("id", "status").collect()) == {0: "ENDED", 1: "ENDED", 2: "ACTIVE", 3: "ACTIVE"}
    assert sorted(r.sale_product_id for r in now["counters"].collect()) == [20, 30]
    assert now["inventory"].count() == now["sale_products"].count() == 4
    written = spark.read.parquet(f"{tmp_path}/out/changes/sales")
    assert written.count() == 6  # a row for each change, not a table for each tick


def test_payments_over_batches(spark, tmp_path):
    rows = [(i % 30, T0 + timedelta(seconds=i) + (i // 30) * timedelta(days=40)) for i in range(60)]
    arriving = spark.createDataFrame(rows, "order_id BIGINT, ts TIMESTAMP")
    messages = staged(spark, tmp_path, arriving, "ts").selectExpr(
        "order_id", "ts", "order_id AS user_id", "1L AS sale_product_id", "1L AS quantity",
        "CAST(5 AS DECIMAL(10,2)) AS total_amount", "'p' AS product_name",
    )
    orders = spark.range(30).selectExpr(
        "id", "id AS user_id", "IF(id % 3 = 0, 'FAILED', 'PENDING') AS status", "current_timestamp() AS updated_at"
    )
    outcomes = spark.range(30).selectExpr(
        "id AS order_id", "id AS delivery_id", "id % 2 = 0 AS success", "'t' AS transaction_id", "'no' AS reason"
    )
    sp = spark.createDataFrame([(1, 9)], "id BIGINT, reserved_qty INT")
    counters = spark.createDataFrame([(1, 1)], "sale_product_id BIGINT, live_qty INT")
    got = streams.payment_stream(messages, orders, sp, counters, outcomes, f"{tmp_path}/out", ts("2024-01-02 00:00:00"))
    want = {i: "CONFIRMED" if i % 2 == 0 else "FAILED" for i in range(30) if i % 3}
    rows = got.select("order_id", "status").collect()
    assert len(rows) == len(want) and dict(map(tuple, rows)) == want
    moves = spark.read.parquet(f"{tmp_path}/out/moves/batch=*")
    assert moves.count() == sum(1 for s in want.values() if s == "FAILED")


def test_monitor_is_kept_over_batches_and_restarts(spark, tmp_path):
    rng = random.Random(7)
    orders = {i: (i % 3, [rng.randrange(4) for _ in range(rng.randrange(1, 4))], i % 11 * 10 + 0.5) for i in range(60)}
    told = []
    for i in orders:
        told += [(i, seq, rng.choice(["PENDING", "CONFIRMED", "FAILED"])) for seq in range(rng.randrange(1, 5))]
    # Out of order, some told again, and some lines only after the first status.
    told = sorted(told, key=lambda r: r[0] + rng.random() * 25)
    told += rng.sample(told, 20)
    schema = "order_id BIGINT, seq BIGINT, sale_id BIGINT, product_ids ARRAY<BIGINT>, status STRING, amount DECIMAL(10,2)"
    sale_products = spark.createDataFrame(
        [(10 * s + p, s, p, 5, 1, 2) for s in range(3) for p in range(5)],
        "id BIGINT, sale_id BIGINT, product_id BIGINT, total_qty INT, reserved_qty INT, sale_price INT",
    )
    products = spark.createDataFrame([(p, f"p{p}") for p in range(5)], "id BIGINT, name STRING")
    (tmp_path / "in").mkdir()
    empty = streams.monitor_now(spark, sale_products, products, f"{tmp_path}/out", 2)
    assert {(r.confirmed_orders, r.revenue) for r in empty.collect()} == {(0, 0)}
    seen, size = [], -(-len(told) // 5)
    for k in range(5):
        part = told[k * size : (k + 1) * size]
        seen += part
        rows = [
            (i, seq, *((orders[i][0], orders[i][1]) if seq == 0 else (None, None)), status, Decimal(str(orders[i][2])))
            for i, seq, status in part
        ]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = event_stream(spark, f"{tmp_path}/in", spark.createDataFrame([], schema).schema)
        got = streams.sale_monitor_stream(stream, sale_products, products, f"{tmp_path}/out", 2)
        last = {}
        for i, seq, status in seen:
            last[i] = max(last.get(i, (-1, "")), (seq, status))
        known = {i for i, seq, _ in seen if seq == 0}
        now = [(i, orders[i][0], last[i][1], Decimal(str(orders[i][2]))) for i in known]
        placed = spark.createDataFrame(now, "id BIGINT, sale_id BIGINT, status STRING, total_amount DECIMAL(10,2)")
        items = spark.createDataFrame([(i, p) for i in known for p in orders[i][1]], "order_id BIGINT, product_id BIGINT")
        want = reports.sale_monitor(sale_products, products, placed, items)
        assert sorted(got.collect()) == sorted(want.collect())
    assert sorted(p.name for p in (tmp_path / "out" / "moved").iterdir()) == ["batch=2", "batch=3", "batch=4"]
    assert sorted(p.name for p in (tmp_path / "out" / "folded").iterdir()) == ["below=2", "below=4"]


def test_folded_log_survives_retries_and_gaps_of_a_write(spark, tmp_path):
    def combine(rows):
        return rows.groupBy("k").agg(F.sum("n").alias("n"), F.max("batch").alias("batch"))

    log = FoldedLog(spark, f"{tmp_path}/log", f"{tmp_path}/bases", combine, 3)
    assert log.read() is None and log.batches() == 0
    for batch in range(8):
        rows = spark.createDataFrame([(batch % 2, 10**batch)], "k BIGINT, n BIGINT")
        for again in (rows.selectExpr("k", "n * 5 AS n"), rows, rows):  # a retry replaces its batch, also one that was folded
            log.write(again, batch)
        assert sum(r.n for r in log.read().collect()) == sum(10**b for b in range(batch + 1))
    (tmp_path / "log" / "batch=8").mkdir()  # not complete
    assert log.batches() == 8 and sum(r.n for r in log.read().collect()) == 11111111


def test_sale_changes_are_folded(spark, tmp_path):
    day = timedelta(days=1)
    sales = spark.createDataFrame(
        [(i, f"s{i}", "SCHEDULED", T0 + i * day, T0 + (i + 2) * day) for i in range(5)],
        "id BIGINT, name STRING, status STRING, start_time TIMESTAMP_NTZ, end_time TIMESTAMP_NTZ",
    ).withColumn("updated_at", ts("2024-01-01 00:00:00"))
    lines = spark.createDataFrame([(10 * i, i, i, 5, 0) for i in range(5)], "id BIGINT, sale_id BIGINT, product_id BIGINT, total_qty INT, reserved_qty INT")
    inventory = lines.select(F.col("id").alias("sale_product_id"), F.col("total_qty").alias("available_qty"), ts("2024-01-01 00:00:00").alias("last_synced_at"))
    counters = spark.createDataFrame([], "sale_product_id BIGINT, live_qty INT")
    ticks = spark.createDataFrame([(T0 + i * day, i) for i in range(6)], "ts TIMESTAMP_NTZ, id BIGINT")
    state = {"sales": sales, "sale_products": lines, "inventory": inventory, "counters": counters}
    streams.sale_status_stream(staged(spark, tmp_path, ticks, "ts", 6), state, f"{tmp_path}/out", 2)
    now = streams.sale_state(state, f"{tmp_path}/out", fold_every=2)
    assert dict(now["sales"].select("id", "status").collect()) == {i: "ENDED" if i < 4 else "ACTIVE" for i in range(5)}
    assert [r.sale_product_id for r in now["counters"].collect()] == [40]
    assert sorted(p.name for p in (tmp_path / "out" / "changes" / "sales").iterdir()) == ["batch=4", "batch=5"]


def test_batches_leave_no_stored_tables(spark, tmp_path):
    from stockyard.session import run_folder

    kept = []

    def handle(batch, batch_id):
        kept.append(run_folder(spark, "x"))
        batch.write.parquet(kept[-1])

    rows = staged(spark, tmp_path, spark.range(4), "id", 2)
    streams.run_batches(rows, f"{tmp_path}/out", handle)
    assert len(kept) == 2 and not any(Path(folder.removeprefix("file:")).exists() for folder in kept)


def test_unsettled_orders_alert_as_with_timers(spark, tmp_path):
    rng = random.Random(5)
    minute = timedelta(minutes=1)
    placed = [(i, T0 + rng.randrange(600) * minute) for i in range(80)]
    settled = [(i, at + rng.choice([0, 3, 14, 15, 16, 40]) * minute) for i, at in placed if i % 4]
    placed += placed[:10]  # told again
    end = [(-1, T0 + timedelta(days=2))]
    rows = sorted([(k, at, "open") for k, at in placed] + [(k, at, "close") for k, at in settled], key=lambda r: r[1])
    size = -(-len(rows) // 3)
    files = [rows[k : k + size] for k in (0, size, 2 * size)] + [[(*end[0], "close")]]

    def column(folder, kind, name):
        kept = [[(k, at) for k, at, what in part if kind in (what, None) or k < 0] for part in files]
        return parts(spark, f"{tmp_path}/{folder}", *kept, schema=f"key BIGINT, {name} TIMESTAMP")

    joined = streams.unsettled_stream(column("placed", "open", "opened"), column("settled", "close", "closed"))
    got = streams.run_to_files(joined, f"{tmp_path}/out").collect()
    changes = parts(spark, f"{tmp_path}/in", *files, schema="key BIGINT, ts TIMESTAMP, kind STRING")
    want = streams.run_to_files(streams.stuck_order_stream(changes), f"{tmp_path}/timers").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(want) > 20


class _State:
    """The one value and the timers of a group, with the calls counted."""

    def __init__(self):
        self.value, self.timers, self.calls = None, set(), 0

    def getValueState(self, name, schema):
        return self

    def _called(self):
        self.calls += 1

    def get(self):
        self._called()
        return self.value

    def update(self, value):
        self._called()
        self.value = value

    def clear(self):
        self._called()
        self.value = None

    def registerTimer(self, at):
        self._called()
        self.timers.add(at)

    def deleteTimer(self, at):
        self._called()
        self.timers.discard(at)


def test_deadlines_of_a_bucket_cost_few_calls_of_the_state_store():
    row, state = namedtuple("row", "key ms kind"), _State()
    timers = SimpleNamespace(getCurrentWatermarkInMs=lambda: 5000)
    deadlines = Deadline(100)
    deadlines.init(state)
    rows = [row(k, k, "open") for k in range(1000)] + [row(k, k + 50, "close") for k in range(0, 1000, 2)]
    rows += [row(k, k, "close") for k in range(1000, 1010)] + [row(7, 900, "close")]
    assert [tuple(r) for r in deadlines.handleInputRows((0,), iter(rows), timers)] == [(7, 7, 107)]
    assert state.timers == {102} and state.calls <= 4
    fired = [tuple(r) for r in deadlines.handleExpiredTimer((0,), timers, None)]
    assert fired == [(k, k, k + 100) for k in range(1, 1000, 2) if k != 7]
    assert state.value is None and state.calls <= 7


def test_deadlines_that_are_not_due_wait_for_the_next_timer():
    row, state = namedtuple("row", "key ms kind"), _State()
    deadlines = Deadline(100)
    deadlines.init(state)
    at = SimpleNamespace(getCurrentWatermarkInMs=lambda: 0)
    assert not list(deadlines.handleInputRows((0,), iter([row(1, 0, "open"), row(None, 50, "open")]), at))
    passed = SimpleNamespace(getCurrentWatermarkInMs=lambda: 151)  # a timer fires when the watermark is beyond it
    state.timers.clear()
    assert [r.key for r in deadlines.handleExpiredTimer((0,), passed, None)] == [1]
    assert state.timers == {151}
    assert not list(deadlines.handleInputRows((0,), iter([row(None, 60, "close")]), passed))
    assert not state.timers and state.value is None


def test_stale_events_share_buckets(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(streams, "OPEN_BUCKETS", 2)
    minute = timedelta(minutes=1)
    rows = [(k, T0 + k * minute, "open") for k in range(60)] + [(k, T0 + (k + k % 20) * minute, "close") for k in range(0, 60, 2)]
    df = spark.createDataFrame([*rows, (-1, T0 + timedelta(days=1), "tick")], "key BIGINT, ts TIMESTAMP, kind STRING")
    alerts = streams.stale_outbox_stream(staged(spark, tmp_path, df, "ts"), "0 seconds")
    got = sorted(r.key for r in streams.run_to_files(alerts, f"{tmp_path}/out").collect())
    assert got == [k for k in range(60) if k % 2 or k % 20 > 10]
    assert "bucket" in alerts._jdf.queryExecution().toString()


def test_orders_of_a_bucket_cost_two_calls_of_the_state_store():
    row, state = namedtuple("row", "order_id seq sale_id product_ids status amount"), _State()
    orders = OrderStatus()
    orders.init(state)
    placed = [row(k, 0, 1, [k], "PENDING", 5) for k in range(1000)] + [row(-1, 2, None, None, "FAILED", None)]
    moved = list(orders.handleInputRows((0,), iter(placed), None))
    assert sorted(r.order_id for r in moved) == list(range(1000)) and state.calls == 2
    paid = [row(3, 1, None, None, "CONFIRMED", None), *placed[5:9], row(-1, 0, 2, [9], "PENDING", 7)]
    moved = [tuple(r) for r in orders.handleInputRows((0,), iter(paid), None)]
    assert sorted(moved) == [(-1, 2, [9], None, "FAILED", None, 7), (3, 1, [3], "PENDING", "CONFIRMED", 5, 5)]
    assert state.calls == 4 and len(state.value[0]) == 1001


def _late(changes, age):
    """Alerts, and (opened, due) of what stays, of one key's changes: ms, kind."""
    opened = due = closed = None
    late = []
    for ms, kind in sorted(changes, key=lambda c: (c[0], c[1] == "close")):
        if kind == "open" and opened is None:
            opened, due = (ms, ms + age + 1) if due is None else (None, None)
        elif kind != "open" and opened is not None:
            late += [opened] if ms >= due else []
            opened, due, closed = None, None, ms
        elif kind != "open" and closed is None:
            due = ms + age + 1
    return late, (opened, due)


@pytest.mark.parametrize("crowd", [1, 20, 10_000])
def test_packed_changes_are_judged_as_one_by_one(monkeypatch, crowd):
    monkeypatch.setattr(processors, "CROWD", crowd)
    rng, row, state = random.Random(crowd), namedtuple("row", "bucket changes"), _State()
    passed = SimpleNamespace(getCurrentWatermarkInMs=lambda: 2**60)
    deadlines = processors.PackedDeadline(100)
    deadlines.init(state)
    kinds = ["open", "open", "close", "close", "tick"]
    times = rng.sample(range(5000), 900)
    rows = [(rng.choice([None, 0, -5, *range(1, 200)]) if k % 3 else 7, ms, rng.choice(kinds)) for k, ms in enumerate(times)]
    batch = pa.RecordBatch.from_arrays(
        [
            pa.array([0 if key is None else key % 3 for key, _, _ in rows], pa.int32()),
            pa.array([key for key, _, _ in rows], pa.int64()),
            pa.array([ms for _, ms, _ in rows], pa.int64()),
            *[pa.array([kind == name for _, _, kind in rows]) for name in ("open", "close")],
        ],
        ["bucket", "key", "ms", "open", "close"],
    )
    packed = [row(*r.values()) for b in processors.pack_changes([batch.slice(0, 400), batch.slice(400)]) for r in b.to_pylist()]
    assert sorted(r.bucket for r in packed) == [0, 1, 2]
    for bucket in range(3):
        own = [r for r in packed if r.bucket == bucket]
        late, kept = {}, {}
        for key in {key for key, _, _ in rows if (0 if key is None else key % 3) == bucket}:
            late[key], kept[key] = _late([(ms, kind) for k, ms, kind in rows if k == key], 100)
        got = [pair for r in deadlines.handleInputRows((bucket,), iter(own), None) for pair in zip(*r)]
        assert sorted(got, key=str) == sorted(((k, at) for k, ats in late.items() for at in ats), key=str)
        assert state.timers == {min(due for _, due in kept.values() if due is not None)}
        fired = [pair for r in deadlines.handleExpiredTimer((bucket,), passed, None) for pair in zip(*r)]
        assert sorted(fired, key=str) == sorted(((k, opened) for k, (opened, _) in kept.items() if opened is not None), key=str)
        state.timers.clear()


def test_the_state_of_a_bucket_goes_on_with_the_next_batch():
    row, state = namedtuple("row", "key ms kind"), _State()
    deadlines = Deadline(100)
    deadlines.init(state)
    first = [row(k, k, "open") for k in range(100)] + [row(k, 500 + k, "close") for k in range(100, 150)] + [row(None, 3, "open")]
    assert not list(deadlines.handleInputRows((0,), iter(first), None))
    then = [row(k, 150, "close") for k in range(0, 100, 2)] + [row(k, 480 + k, "open") for k in range(100, 150)] + [row(None, 4, "close")]
    late = [tuple(r) for r in deadlines.handleInputRows((0,), iter(then), None)]
    assert sorted(late) == [(k, k, k + 100) for k in range(0, 50, 2)]
    passed = SimpleNamespace(getCurrentWatermarkInMs=lambda: 151)
    fired = [tuple(r) for r in deadlines.handleExpiredTimer((0,), passed, None)]
    assert sorted(fired) == [(k, k, k + 100) for k in range(1, 50, 2)]
    assert sorted(r.key for r in deadlines.handleExpiredTimer((0,), SimpleNamespace(getCurrentWatermarkInMs=lambda: 10**6), None)) == list(range(51, 100, 2))
    assert state.value is None
