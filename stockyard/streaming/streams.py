"""Structured Streaming forms of the stateful operators and the relays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, GroupedData, SparkSession
from pyspark.sql import functions as F

from stockyard.operators.outbox import routed
from stockyard.operators.reports import monitor_of_counts
from stockyard.operators.transitions import (
    advance_sales,
    apply_payment_outcomes,
    feed_sale_status,
    sales_due_to_end,
    sales_due_to_start,
)
from stockyard.session import scratch, store
from stockyard.streaming.folded import FOLD_EVERY, FoldedLog
from stockyard.streaming.processors import (
    ALERTS_OUT,
    LEVEL_OUT,
    LIMIT_OUT,
    MOVED_OUT,
    PACKED,
    OrderStatus,
    PackedDeadline,
    SlidingWindow,
    StockLevel,
    pack_changes,
)

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STUCK_MS, STALE_MS = 15 * 60_000, 10 * 60_000
# Buckets of keys. A batch reads and writes the state of those it touches: the keys that are open at a time, and all orders.
OPEN_BUCKETS, ORDER_BUCKETS = 1 << 13, 1 << 17


def use_rocksdb(spark: SparkSession) -> None:
    """Keyed processors need a state store with column families."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def run_to_files(stream: DataFrame, folder: str) -> DataFrame:
    """Process what is available, append it as Parquet, and read it back."""
    query = (
        stream.writeStream.format("parquet")
        .option("path", f"{folder}/rows")
        .option("checkpointLocation", f"{folder}/progress")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows")


def run_batches(stream: DataFrame, folder: str, handle: Callable[[DataFrame, int], None]) -> None:
    """Hand each available micro-batch and its id to `handle`; a retry repeats the id.

    Tables that `handle` stores are removed when it returns.
    """

    def handle_and_clean(batch: DataFrame, batch_id: int) -> None:
        with scratch(batch.sparkSession):
            handle(batch, batch_id)

    query = (
        stream.writeStream.foreachBatch(handle_and_clean)
        .option("checkpointLocation", f"{folder}/progress")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def stock_level_stream(events: DataFrame, totals: DataFrame) -> DataFrame:
    """Levels after each reserve and release; `events`: sale_id, product_id, ts, id, delta."""
    use_rocksdb(events.sparkSession)
    keyed = events.withColumn("us", F.unix_micros(F.col("ts").cast("timestamp"))).join(
        totals, ["sale_id", "product_id"], "left"
    )
    levels = (
        keyed.groupBy("sale_id", "product_id")
        .transformWithState(StockLevel(), LEVEL_OUT, "Append", "None")
    )
    return levels.select(
        "sale_id",
        "product_id",
        F.timestamp_micros("us").cast("timestamp_ntz").alias("ts"),
        "id",
        "delta",
        "level",
        "success",
        "reason",
    )


def _timed(rows: DataFrame, delay: str) -> DataFrame:
    """Rows with `ms` instead of `ts`; the watermark follows `ts`, but drops nothing.

    Without the column in their input the keyed operators get rows behind the
    watermark as well, and decide themselves what becomes of them.
    """
    use_rocksdb(rows.sparkSession)
    return rows.withColumn("ms", F.unix_millis("ts")).withWatermark("ts", delay).drop("ts")


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.hash(key), F.lit(buckets)).alias("bucket")


def _bucketed(rows: DataFrame, key: str, buckets: int) -> GroupedData:
    return rows.select("*", _bucket(key, buckets)).groupBy("bucket")


def limit_stream(calls: DataFrame, limit: int, window_ms: int, delay: str = "1 minute") -> DataFrame:
    """Sliding-window verdicts, one for every call; `calls`: key STRING, ts TIMESTAMP, id.

    Calls behind the watermark, or behind what their key has seen, are refused and
    marked late. A key's state goes window + 10 s after its last call.
    """
    keyed = _timed(calls, delay).groupBy("key")
    return keyed.transformWithState(SlidingWindow(limit, window_ms), LIMIT_OUT, "Append", "EventTime")


def dedupe_stream(requests: DataFrame, key: str = "idempotency_key", keep: str = "30 days") -> DataFrame:
    """First request per key, and every request without a key.

    A key is remembered for `keep` after its arrival (the batch form remembers
    for ever). Arrival time never lags, so no request is dropped for its age.
    """
    keyed = requests.filter(F.col(key).isNotNull()).withColumn("_arrived", F.current_timestamp())
    first = keyed.withWatermark("_arrived", keep).dropDuplicatesWithinWatermark([key]).drop("_arrived")
    return first.unionByName(requests.filter(F.col(key).isNull()))


def deadline_stream(changes: DataFrame, age_ms: int, delay: str = "10 minutes") -> DataFrame:
    """Keys opened and not closed within `age_ms`; `changes`: key BIGINT, ts TIMESTAMP, kind.

    An alert comes once the watermark, `delay` behind the latest change, has passed
    the deadline. Changes behind the watermark are judged too: a late opening alerts
    at once if its deadline has passed, a late closing is remembered as any other.
    """
    rows = _timed(changes, delay).select(
        _bucket("key", OPEN_BUCKETS),
        F.col("key").cast("bigint"),
        "ms",
        *[F.col("kind").eqNullSafe(kind).alias(kind) for kind in ("open", "close")],
    )
    keyed = rows.mapInArrow(pack_changes, PACKED).groupBy("bucket")
    alerts = keyed.transformWithState(PackedDeadline(age_ms), ALERTS_OUT, "Append", "EventTime")
    each = alerts.select(F.inline(F.arrays_zip("key", "opened_ms")))
    return each.withColumn("due_ms", F.col("opened_ms") + age_ms)


def stuck_order_stream(changes: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Orders PENDING for more than 15 minutes: opened when placed, closed by the payment event."""
    return deadline_stream(changes, STUCK_MS, delay)


def unsettled_stream(
    placed: DataFrame, settled: DataFrame, age_ms: int = STUCK_MS, delay: str = "10 minutes"
) -> DataFrame:
    """The alerts of `stuck_order_stream` from two streams, as an outer join over an interval of time.

    `placed`: key BIGINT, opened TIMESTAMP; `settled`: key BIGINT, closed TIMESTAMP. An
    order alerts if no settlement lies within `age_ms` of it, once both streams' watermarks
    have passed its deadline; a key placed again before that alerts once. No Python, and
    the state goes with the watermark, which also means that rows behind it are dropped,
    and that no alert comes while one of the streams is silent; the timers of
    `deadline_stream` judge late rows and need one stream to go on.
    """
    use_rocksdb(placed.sparkSession)
    age = f"INTERVAL '{age_ms / 1000:.3f}' SECOND"  # a literal, from which the state's bound is derived
    left = placed.select("key", "opened").filter("key IS NOT NULL").withWatermark("opened", delay)
    left = left.dropDuplicatesWithinWatermark(["key"])
    right = settled.select(F.col("key").alias("_key"), "closed").withWatermark("closed", delay)
    near = F.expr(f"key = _key AND closed >= opened - {age} AND closed <= opened + {age}")
    joined = left.join(right, near, "left_outer").filter("_key IS NULL")
    opened = F.unix_millis("opened")
    return joined.select("key", opened.alias("opened_ms"), (opened + age_ms).alias("due_ms"))


def stale_outbox_stream(changes: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Events unpublished for more than 10 minutes: opened when logged, closed when published."""
    return deadline_stream(changes, STALE_MS, delay)


def route_stream(outbox: DataFrame, folder: str) -> DataFrame:
    """Relay events to one folder per queue; a retried batch overwrites its own folder."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        events = routed(batch).filter("queue IS NOT NULL AND NOT published")
        events.write.mode("overwrite").partitionBy("queue").parquet(f"{folder}/rows/batch={batch_id}")

    run_batches(outbox, folder, handle)
    return outbox.sparkSession.read.option("basePath", f"{folder}/rows").parquet(f"{folder}/rows/batch=*")


def payment_stream(
    messages: DataFrame,
    orders: DataFrame,
    sale_products: DataFrame,
    counters: DataFrame,
    outcomes: DataFrame,
    folder: str,
    as_of,
) -> DataFrame:
    """Settle each ORDER_CREATED message once; returns the (order_id, status) results.

    A message counts once in its batch, and not at all if an earlier batch has
    settled its order, however long ago. Each batch writes its results, events and
    stock moves under its own id, so a retry replaces them. Of the orders, answers
    and earlier results only the range of the batch's order ids is read.
    """
    spark = messages.sparkSession

    def handle(batch: DataFrame, batch_id: int) -> None:
        batch = store(batch, "payment-batch")  # read several times below
        low, high = batch.agg(F.min("order_id"), F.max("order_id")).first()

        def near(rows: DataFrame, key: str) -> DataFrame:
            return rows.filter(F.col(key).between(F.lit(low), F.lit(high)))

        if batch_id > 0:
            earlier = spark.read.parquet(f"{folder}/settled").filter(F.col("batch") < batch_id)
            done = near(earlier, "order_id").select("order_id")
            batch = store(batch.join(done, "order_id", "left_anti"), "payment-batch")
        own = batch.select("order_id").distinct()
        mine = near(orders, "id").join(own.withColumnRenamed("order_id", "id"), "id", "left_semi")
        answers = near(outcomes, "order_id").join(own, "order_id", "left_semi")
        out = apply_payment_outcomes(mine, sale_products, counters, batch, answers, as_of)
        for name in ("settled", "outbox", "moves"):
            out[name].write.mode("overwrite").parquet(f"{folder}/{name}/batch={batch_id}")

    run_batches(messages, folder, handle)
    return spark.read.parquet(f"{folder}/settled/batch=*")


# Key of each table that a tick of the scheduler changes.
STATE = {"sales": "id", "sale_products": "id", "inventory": "sale_product_id", "counters": "sale_product_id"}


def _last_changes(spark: SparkSession, folder: str, table: str, every: int = FOLD_EVERY) -> FoldedLog:
    """The log of a table's changes; its fold has the last row of every key that changed."""
    key = STATE[table]

    def last(rows: DataFrame) -> DataFrame:
        rest = [c for c in rows.columns if c != key]
        return rows.groupBy(key).agg(F.max_by(F.struct(*rest), "batch").alias("_l")).select(key, "_l.*")

    return FoldedLog(spark, f"{folder}/changes/{table}", f"{folder}/folded/{table}", last, every)


def sale_status_stream(
    ticks: DataFrame, state: dict[str, DataFrame], folder: str, fold_every: int = FOLD_EVERY
) -> DataFrame:
    """Advance sales to the latest `ts` of each micro-batch of ticks; returns the status feed.

    Only sales that start or end at a tick, their lines and the lines' stock and
    counters are advanced and written, below `changes`; a table is what was given,
    overlaid with the last change of every key (`sale_state`). A retry of a batch
    starts from the changes before it. The changes are folded every `fold_every`
    ticks, so a tick reads no more however many have gone by.
    """
    spark = ticks.sparkSession

    def handle(batch: DataFrame, batch_id: int) -> None:
        whole = sale_state(state, folder, batch_id, fold_every)
        as_of = F.lit(batch.agg(F.max("ts")).first()[0]).cast("timestamp_ntz")
        starting = sales_due_to_start(whole["sales"], whole["sale_products"], as_of)
        due = store(starting.unionByName(sales_due_to_end(whole["sales"], as_of)), "sale-due")
        lines = store(whole["sale_products"].join(due.select(F.col("id").alias("sale_id")), "sale_id", "left_semi"), "sale-due")
        ids = lines.select(F.col("id").alias("sale_product_id"))
        before = {
            "sales": due,
            "sale_products": lines.select(*state["sale_products"].columns),
            "inventory": store(whole["inventory"].join(ids, "sale_product_id", "left_semi"), "sale-due"),
            "counters": store(whole["counters"].join(ids, "sale_product_id", "left_semi"), "sale-due"),
        }
        after = advance_sales(*[before[t] for t in STATE], as_of)
        for t, key in STATE.items():
            gone = before[t].join(after[t], key, "left_anti").withColumn("_gone", F.lit(True))
            changed = after[t].withColumn("_gone", F.lit(False)).unionByName(gone, allowMissingColumns=True)
            _last_changes(spark, folder, t, fold_every).write(changed, batch_id)
        moved = spark.read.parquet(f"{folder}/changes/sales/batch={batch_id}")
        feed_sale_status(due, moved).write.mode("overwrite").parquet(f"{folder}/feed/batch={batch_id}")

    run_batches(ticks, folder, handle)
    return spark.read.parquet(f"{folder}/feed/batch=*")


def sale_state(
    state: dict[str, DataFrame], folder: str, until: int | None = None, fold_every: int = FOLD_EVERY
) -> dict[str, DataFrame]:
    """The four tables after the batches below `until` (all of them by default)."""
    out = {}
    for t, key in STATE.items():
        base = state[t]
        last = _last_changes(base.sparkSession, folder, t, fold_every).read(until)
        if last is None:
            out[t] = base
            continue
        last = store(last, "sale-changes")  # as short as the changes are, so joins with it are broadcast
        kept = base.join(last.select(key), key, "left_anti")
        out[t] = kept.unionByName(last.filter("NOT _gone").select(*base.columns))
    return out


def _line_sums(spark: SparkSession, folder: str, every: int = FOLD_EVERY) -> FoldedLog:
    """The log of moved order lines per sale and product; its fold has their sums."""

    def sums(rows: DataFrame) -> DataFrame:
        added = [F.sum(c).alias(c) for c in MOVED]
        added.append(F.sum("revenue").cast("decimal(38,2)").alias("revenue"))
        return rows.groupBy("sale_id", "product_id").agg(*added, F.max("batch").alias("batch"))

    return FoldedLog(spark, f"{folder}/moved", f"{folder}/folded", sums, every)


# Line counts of the monitor and the order status that each counts.
MOVED = {"confirmed_orders": "CONFIRMED", "pending_orders": "PENDING", "failed_orders": "FAILED"}


def sale_monitor_stream(
    changes: DataFrame, sale_products: DataFrame, products: DataFrame, folder: str, fold_every: int = FOLD_EVERY
) -> DataFrame:
    """The live monitor, kept from signed changes; `reports.sale_monitor` counts the same from whole tables.

    `changes`: order_id, seq, sale_id, product_ids, status, amount. The first row of
    an order brings its sale and the product of every line, later ones may leave
    them null. Rows of one order count in the order of `seq`, whichever comes first;
    what comes again or behind a later one changes nothing. A batch writes, per sale
    and product it touches, what the new status adds and the old one takes away, so
    a busy product is a row per batch and no order is read again.
    """
    spark = changes.sparkSession
    use_rocksdb(spark)
    keyed = _bucketed(changes, "order_id", ORDER_BUCKETS)
    moved = keyed.transformWithState(OrderStatus(), MOVED_OUT, "Append", "None")

    def handle(batch: DataFrame, batch_id: int) -> None:
        lines = batch.withColumn("product_id", F.explode("product_ids"))

        def signed(status: str, value=F.lit(1), held=F.lit(1)):
            now = F.when(F.col("status") == status, F.coalesce(value, F.lit(0))).otherwise(0)
            return F.sum(now - F.when(F.col("old_status") == status, F.coalesce(held, F.lit(0))).otherwise(0))

        sums = [signed(status).alias(c) for c, status in MOVED.items()]
        revenue = signed("CONFIRMED", F.col("amount"), F.col("old_amount")).cast("decimal(38,2)").alias("revenue")
        _line_sums(spark, folder, fold_every).write(lines.groupBy("sale_id", "product_id").agg(*sums, revenue), batch_id)

    run_batches(moved, folder, handle)
    return monitor_now(spark, sale_products, products, folder, fold_every)


def monitor_now(
    spark: SparkSession, sale_products: DataFrame, products: DataFrame, folder: str, fold_every: int = FOLD_EVERY
) -> DataFrame:
    """The monitor after the batches that `sale_monitor_stream` has finished."""
    counts = _line_sums(spark, folder, fold_every).read()
    if counts is None:
        none = ", ".join(f"{c} BIGINT" for c in ("sale_id", "product_id", *MOVED, "batch"))
        counts = spark.createDataFrame([], f"{none}, revenue DECIMAL(38,2)")
    return monitor_of_counts(sale_products, products, counts.drop("batch"))
