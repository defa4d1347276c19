"""Keyed state for the streams: stock levels, limiter windows, deadlines and order statuses.

A micro-batch hands over a key's rows unsorted, so each processor sorts them by
(ts, id) first. Their number is bounded by the source's rate limit. Rows that
arrive in a later batch than their order allows are marked LATE and change nothing.

Deadlines and order statuses have millions of keys with a few rows each, so their
state is kept by bucket of keys: what costs is a call of the state store from Python.
Changes of deadlines come packed, since a row costs more than the work on it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Row
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from stockyard.operators.limits import window_step
from stockyard.shipping import ship_by_value

ship_by_value(__name__)

LEVEL_OUT = "sale_id BIGINT, product_id BIGINT, us BIGINT, id BIGINT, delta INT, level INT, success BOOLEAN, reason STRING"
LIMIT_OUT = (
    "key STRING, ms BIGINT, id BIGINT, allowed BOOLEAN, current_count INT, retry_after_s BIGINT, remaining INT, "
    "late BOOLEAN"
)
DEADLINE_OUT = "key BIGINT, opened_ms BIGINT, due_ms BIGINT"
ALERTS_OUT = "key ARRAY<BIGINT>, opened_ms ARRAY<BIGINT>"
PACKED = "bucket INT, changes BINARY"
MOVED_OUT = (
    "order_id BIGINT, sale_id BIGINT, product_ids ARRAY<BIGINT>, old_status STRING, status STRING, "
    "old_amount DECIMAL(20,2), amount DECIMAL(20,2)"
)


def _row_type(ddl: str) -> Row:
    return Row(*[field.split()[0] for field in ddl.split(", ")])


LevelRow, LimitRow, DeadlineRow, AlertsRow, MovedRow = map(
    _row_type, (LEVEL_OUT, LIMIT_OUT, DEADLINE_OUT, ALERTS_OUT, MOVED_OUT)
)

# An opening, a close or another change of a key, and a key that is open or whose close is remembered.
CHANGE = np.dtype([("key", "<i8"), ("ms", "<i8"), ("open", "?"), ("close", "?"), ("null", "?")])
SPAN = np.dtype([("key", "<i8"), ("opened", "<i8"), ("due", "<i8"), ("open", "?"), ("null", "?")])
# Changes of a task that are packed together, and the fewest keys that are worth a step over arrays.
PACK_ROWS, CROWD = 1 << 19, 32


class StockLevel(StatefulProcessor):
    """Rows: key, us, id, delta, total_qty. State: the level and the last place in order."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("level", "level INT, us BIGINT, id BIGINT")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        ordered = sorted(rows, key=lambda r: (r.us, r.id))
        held = self.state.get() if self.state.exists() else None
        level, at = (held[0], (held[1], held[2])) if held else (ordered[0].total_qty, (-(2**62), 0))
        for r in ordered:
            if (r.us, r.id) <= at:  # an event that comes again changes nothing
                yield LevelRow(key[0], key[1], r.us, r.id, r.delta, level, False, "LATE")
                continue
            at = (r.us, r.id)
            done, reason = True, None
            if level is None:
                done, reason = False, "SALE_NOT_FOUND" if r.delta < 0 else None
            elif r.delta < 0 and level <= 0:
                done, reason = False, "OUT_OF_STOCK"
            else:
                level += r.delta
            yield LevelRow(key[0], key[1], r.us, r.id, r.delta, level, done, reason)
        self.state.update((level, at[0], at[1]))

    def close(self) -> None:
        pass


class SlidingWindow(StatefulProcessor):
    """Rows: key, ms, id. State: recorded times of one window, dropped when it has passed."""

    def __init__(self, limit: int, window_ms: int):
        self.limit, self.window_ms = limit, window_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("times", "times ARRAY<BIGINT>, ms BIGINT, id BIGINT, expiry BIGINT")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = self.state.get() if self.state.exists() else ([], -(2**62), 0, None)
        times, at, old_expiry = list(held[0]), (held[1], held[2]), held[3]
        passed = timerValues.getCurrentWatermarkInMs()
        for r in sorted(rows, key=lambda r: (r.ms, r.id)):
            if (r.ms, r.id) < at or r.ms < passed:
                yield LimitRow(key[0], r.ms, r.id, False, 0, 0, 0, True)
                continue
            at = (r.ms, r.id)
            verdict = window_step(times, (r.ms, self.limit, self.window_ms))
            yield LimitRow(key[0], r.ms, r.id, *verdict, False)
        if at[0] < 0 and not times:
            return  # only late calls, and nothing to remember
        expiry = at[0] + self.window_ms + 10_000
        if expiry != old_expiry:
            if old_expiry is not None:
                self.handle.deleteTimer(old_expiry)
            self.handle.registerTimer(expiry)
        self.state.update((times, at[0], at[1], expiry))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


class Deadline(StatefulProcessor):
    """Rows: bucket, key, ms, kind ('open' or 'close'). Emits keys that stayed open longer than `age_ms`.

    A close that comes first is remembered for `age_ms`, so that its open does not alert.
    State: the open and the remembered keys of a bucket of keys as one array, read and
    written once a batch, and one timer at the first of their deadlines. A call of the
    state store per key would cost far more than the work itself.
    """

    def __init__(self, age_ms: int):
        self.age_ms = age_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("open", "spans BINARY, timer BIGINT")

    def _read(self) -> tuple[np.ndarray, int | None]:
        """The spans in order of their keys, and the bucket's timer."""
        held = self.state.get()
        return (np.zeros(0, SPAN), None) if held is None else (np.frombuffer(held[0], SPAN), held[1])

    def _write(self, spans: np.ndarray, timer: int | None, fired: bool = False) -> None:
        first = int(spans["due"].min()) if len(spans) else None
        if timer is not None and timer != first and not fired:
            self.handle.deleteTimer(timer)
        if first is None:
            if timer is not None:
                self.state.clear()
            return
        if first != timer:
            self.handle.registerTimer(first)
        self.state.update((spans.tobytes(), first))

    def _changes(self, rows: Iterator[Row]) -> np.ndarray:
        return np.array([(r.key or 0, r.ms, r.kind == "open", r.kind == "close", r.key is None) for r in rows], CHANGE)

    def _alerts(self, spans: np.ndarray) -> Iterator[Row]:
        for key, opened, due, _, null in spans.tolist():
            yield DeadlineRow(None if null else key, opened, due - 1)

    def _judged(self, spans: np.ndarray, changes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The spans after the changes, and those that were closed too late.

        A step takes the next change of every key; the last few keys, which have many, are walked through.
        """
        changes = changes[np.lexsort((changes["close"], changes["ms"], changes["key"], changes["null"]))]
        keys, nulls = changes["key"], changes["null"]
        heads = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (nulls[1:] != nulls[:-1])]))
        counts = np.diff(np.append(heads, len(changes)))
        own = np.zeros(len(heads), SPAN)
        own["key"], own["null"] = keys[heads], nulls[heads]
        plain = spans["key"][~spans["null"]]  # the null key's span is the last
        at = np.where(own["null"], len(plain), np.searchsorted(plain, own["key"]))
        held = at < len(spans)
        held[held] = (spans["key"][at[held]] == own["key"][held]) & (spans["null"][at[held]] == own["null"][held])
        own[held] = spans[at[held]]
        kept, closed, late = held.copy(), np.zeros(len(own), bool), []
        live, turn = np.arange(len(own)), 0
        while len(live) >= CROWD:
            now = changes[heads[live] + turn]
            opens, known, ms = now["open"], own["open"][live], now["ms"]
            fresh = live[opens & ~known & ~kept[live]]
            own["opened"][fresh] = ms[opens & ~known & ~kept[live]]
            own["due"][fresh] = own["opened"][fresh] + self.age_ms + 1
            early = live[opens & ~known & kept[live]]  # their close came first
            ends = live[~opens & known]
            late.append(own[ends[ms[~opens & known] >= own["due"][ends]]])
            first = live[~opens & ~known & ~closed[live]]
            own["due"][first] = ms[~opens & ~known & ~closed[live]] + self.age_ms + 1
            own["open"][fresh], own["open"][ends], closed[ends] = True, False, True
            kept[fresh], kept[first], kept[early], kept[ends] = True, True, False, False
            turn += 1
            live = live[counts[live] > turn]
        for k in live.tolist():
            rest = changes[heads[k] + turn : heads[k] + counts[k]]
            own[k], kept[k], passed = self._walked(own[k], bool(kept[k]), bool(closed[k]), rest)
            late.append(passed)
        untouched = np.ones(len(spans), bool)
        untouched[at[held]] = False
        after = np.concatenate([spans[untouched], own[kept]])
        return after[np.lexsort((after["key"], after["null"]))], np.concatenate([np.zeros(0, SPAN), *late])

    def _walked(self, span: np.void, kept: bool, closed: bool, changes: np.ndarray) -> tuple[tuple, bool, np.ndarray]:
        """One key's span after its changes, whether there is one, and its spans that were closed too late."""
        key, opened, due, known, null = span.tolist()
        late = []
        for ms, opens in zip(changes["ms"].tolist(), changes["open"].tolist()):
            if opens and known:
                continue
            if opens and kept:  # its close came first
                kept = False
            elif opens:
                opened, due, known, kept = ms, ms + self.age_ms + 1, True, True
            elif known:
                if ms >= due:
                    late.append((key, opened, due, True, null))
                known, kept, closed = False, False, True
            elif not closed:
                due, kept = ms + self.age_ms + 1, True
        return (key, opened, due, known, null), kept, np.array(late, SPAN)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        spans, timer = self._read()
        spans, late = self._judged(spans, self._changes(rows))
        yield from self._alerts(late)
        self._write(spans, timer)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        spans, timer = self._read()
        over = spans["due"] < timerValues.getCurrentWatermarkInMs()  # as Spark judges timers
        yield from self._alerts(spans[over & spans["open"]])
        self._write(spans[~over], timer, fired=True)

    def close(self) -> None:
        pass


def pack_changes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of bucket, key, ms, open and close as few rows of bucket and an array of changes: a row costs Python far more."""
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= PACK_ROWS:
            yield _packed(held)
            held, rows = [], 0
    if rows:
        yield _packed(held)


def _packed(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    table = pa.Table.from_batches(batches)
    if table["ms"].null_count:
        raise ValueError("a change needs a time")
    changes = np.zeros(table.num_rows, CHANGE)
    changes["null"] = table["key"].is_null().to_numpy()
    changes["key"] = table["key"].fill_null(0).to_numpy()
    for name in ("ms", "open", "close"):
        changes[name] = table[name].to_numpy()
    buckets = table["bucket"].to_numpy()
    order = np.argsort(buckets, kind="stable")
    buckets, changes = buckets[order], changes[order]
    heads = np.flatnonzero(np.concatenate([[True], buckets[1:] != buckets[:-1]]))
    places = (np.append(heads, len(changes)) * CHANGE.itemsize).astype(np.int32)
    arrays = pa.Array.from_buffers(pa.binary(), len(heads), [None, pa.py_buffer(places), pa.py_buffer(changes.tobytes())])
    return pa.RecordBatch.from_arrays([pa.array(buckets[heads], pa.int32()), arrays], ["bucket", "changes"])


class PackedDeadline(Deadline):
    """`Deadline` over rows of bucket and an array of changes. Emits arrays of keys and of their openings."""

    def _changes(self, rows: Iterator[Row]) -> np.ndarray:
        return np.concatenate([np.frombuffer(r.changes, CHANGE) for r in rows])

    def _alerts(self, spans: np.ndarray) -> Iterator[Row]:
        if len(spans):
            keys = spans["key"].tolist()
            for k in np.flatnonzero(spans["null"]).tolist():
                keys[k] = None
            yield AlertsRow(keys, spans["opened"].tolist())


class OrderStatus(StatefulProcessor):
    """Rows: bucket, order_id, seq, sale_id, product_ids, status, amount. Emits where an order stood before a batch and after it.

    State: of each order of a bucket its sale and products, its last status, and the status
    and amount that were emitted; a bucket is read and written once a batch. A status that
    comes before its order's lines is told with them.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState(
            "orders",
            "orders ARRAY<STRUCT<order_id: BIGINT, sale_id: BIGINT, product_ids: ARRAY<BIGINT>, seq: BIGINT, "
            "status: STRING, amount: DECIMAL(20,2), told: STRING, told_amount: DECIMAL(20,2)>>",
        )

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        changes: dict = {}
        for r in rows:
            changes.setdefault(r.order_id, []).append(r)
        held = self.state.get()
        orders = {o[0]: tuple(o)[1:] for o in held[0]} if held else {}
        for order_id, own in changes.items():
            sale, products, seq, status, amount, told, told_amount = orders.get(order_id, (None,) * 7)
            for r in sorted(own, key=lambda r: r.seq):
                if products is None and r.product_ids is not None:
                    sale, products = r.sale_id, list(r.product_ids)
                if amount is None:
                    amount = r.amount
                if seq is None or r.seq > seq:
                    seq, status, amount = r.seq, r.status, amount if r.amount is None else r.amount
            if products is not None and (status, amount) != (told, told_amount):
                yield MovedRow(order_id, sale, products, told, status, told_amount, amount)
                told, told_amount = status, amount
            orders[order_id] = (sale, products, seq, status, amount, told, told_amount)
        self.state.update(([(order_id, *order) for order_id, order in orders.items()],))

    def close(self) -> None:
        pass
