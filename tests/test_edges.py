"""Edge rows: rounding, prefix parsing, paging, nesting, empty and missing values."""

from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from stockyard.functions import scalars as S
from stockyard.operators import blocks, listings, nesting, outbox, reconcile, reports, rules, transitions
from stockyard.plans.catalog import QUERIES
from stockyard.schemas import TABLES, struct
from stockyard.sources.events import decode_events, decoded, quarantined
from stockyard.sources.fixtures import Fixtures, ts
from stockyard.sources.tables import conform, load

NOW = "2024-05-01 12:00:00"


def at(text):
    return datetime.fromisoformat(text)


def one(df):
    return [tuple(r) for r in df.collect()]


@pytest.mark.parametrize(
    "page,limit,want",
    [
        (None, None, (1, 10, 0)),
        ("2", "0", (2, 10, 10)),
        ("x", "-5", (1, 1, 0)),
        ("-3", "100", (1, 50, 0)),
        ("3abc", "7.9", (3, 7, 14)),
        (0, 20, (1, 20, 0)),
    ],
)
def test_clamp_page(page, limit, want):
    assert S.clamp_page(page, limit) == want


def test_number_prefixes(spark):
    texts = ["12abc", "  -7.5e1x", "0x1F", "-0x10", "abc", "", ".5", "5.", " 42\t", "1e3", "+8", None]
    df = spark.createDataFrame([(t,) for t in texts], "t STRING")
    got = one(df.select(S.parse_int(F.col("t")), S.parse_float(F.col("t"))))
    assert [g[0] for g in got] == [12, -7, 31, -16, None, None, None, 5, 42, 1, 8, None]
    assert [g[1] for g in got] == [12.0, -75.0, 0.0, 0.0, None, None, 0.5, 5.0, 42.0, 1000.0, 8.0, None]


def test_rounding_and_texts(spark):
    df = spark.createDataFrame([(-0.5,), (0.5,), (2.5,), (-1.5,), (12.49,)], "x DOUBLE")
    assert [r[0] for r in one(df.select(S.round_half_up(F.col("x"))))] == [0, 1, 3, -1, 12]
    money = spark.createDataFrame(
        [(Decimal(m),) for m in ("0.00", "999.90", "1000.00", "1234567.05", "-100000.50", "12345678.00")], "m DECIMAL(10,2)"
    )
    assert [r[0] for r in one(money.select(S.indian_grouping(F.col("m"))))] == [
        "0", "999.9", "1,000", "12,34,567.05", "-1,00,000.5", "1,23,45,678"
    ]
    text = spark.createDataFrame([(" 　a b﻿\n",), (" \t ",), (None,)], "t STRING")
    assert one(text.select(S.trim_all(F.col("t")), S.blank_to_null(F.col("t")))) == [
        ("a b", "a b"), ("", None), (None, None)
    ]
    ids = spark.createDataFrame([("ab12-cd-ef", "Ann Lee"), ("solo", "Bo")], "id STRING, n STRING")
    assert one(ids.select(S.short_code(F.col("id")), S.first_name(F.col("n")))) == [("AB12", "Ann"), ("SOLO", "Bo")]
    keys = spark.createDataFrame([("a.png",), ("",), (None,)], "k STRING")
    assert [r[0] for r in one(keys.select(S.image_url(F.col("k"), "http://h/b/")))] == ["http://h/b/a.png", None, None]


def test_sold_pct_and_tiers(spark):
    rows = [(1, "ACTIVE", 8, 7), (2, "ACTIVE", 0, None), (3, "ACTIVE", 10, 2), (4, "ENDED", 10, None),
            (5, "ACTIVE", 10, -1), (6, "ACTIVE", 200, 1)]
    df = spark.createDataFrame(rows, "sale_product_id INT, status STRING, total_qty INT, live_qty INT")
    pct = [r[0] for r in one(df.select(reports.sold_pct(F.col("total_qty"), F.col("live_qty"))))]
    assert pct == [13, None, 80, 0, 110, 100]
    tiers = {r.sale_product_id: r for r in reports.stock_tiers(df).collect()}
    assert (tiers[3].card_low, tiers[3].monitor_low) == (False, True)
    assert (tiers[3].sold_band, tiers[5].sold_band, tiers[1].sold_band) == ("medium", "high", "low")
    assert tiers[5].sold_out and not tiers[5].buyable
    assert not tiers[4].buyable and tiers[4].available == 10
    assert tiers[2].sold_out


def test_deep_page_equals_shallow(spark, monkeypatch):
    df = spark.range(0, 2000).select(
        (F.col("id") * 37 % 101).alias("created_at"), F.col("id"), (F.col("id") % 7).alias("x")
    )
    order = listings.newest_first()
    want = one(listings.page(df, order, 1490, 25))
    placed = one(listings.page(df, order, 1490, 25, "place"))
    assert [r[-1] for r in placed] == list(range(1491, 1516))
    monkeypatch.setattr(listings, "TOP_K_ROWS", 100)
    assert one(listings.page(df, order, 1490, 25)) == want
    assert one(listings.page(df, order, 1490, 25, "place")) == placed
    assert len(want) == 25
    assert one(listings.page(df, order, 1999, 50)) == one(df.orderBy(*order).offset(1999))
    assert listings.page(df, order, 5000, 10).count() == 0


def test_nest_cuts_the_sorted_list(spark):
    df = spark.createDataFrame([(1, (i * 37) % 95) for i in range(95)] + [(2, 0)], "g INT, i INT")
    rows = sorted(nesting.nest(df, ["g"], ["i"], "items", max_items=20).collect(), key=lambda r: (r.g, r.part))
    assert [r.part for r in rows] == [0, 1, 2, 3, 4, 0]
    assert [x.i for r in rows if r.g == 1 for x in r["items"]] == list(range(95))
    assert max(len(r["items"]) for r in rows) == 20


def test_nest_splits_one_repeated_detail(spark):
    df = spark.range(30_000).selectExpr("1 AS order_id", "7 AS product_id", "IF(id = 5, 2, 1) AS quantity")
    rows = nesting.nest(df, ["order_id"], ["product_id", "quantity"], "items", max_items=100).collect()
    assert sorted(r.part for r in rows) == list(range(300)) and {len(r["items"]) for r in rows} == {100}
    joined = [x.quantity for r in sorted(rows, key=lambda r: r.part) for x in r["items"]]
    assert joined == sorted(joined) and sum(joined) == 30_001


def test_nest_of_groups_for_one_task_and_for_blocks(spark, monkeypatch):
    monkeypatch.setattr(nesting, "IN_TASK", 50)
    sizes = {1: 1, 2: 20, 3: 50, 4: 51, 5: 400, None: 70}
    df = spark.createDataFrame([(g, (i * 37) % n // 2) for g, n in sizes.items() for i in range(n)], "g INT, i INT")
    for most, groups in ((20, sizes), (50, [1, 2, 3]), (20, [1, 2])):
        chosen = df.filter(F.coalesce("g", F.lit(0)).isin([g or 0 for g in groups]))
        rows = nesting.nest(chosen, ["g"], ["i"], "items", max_items=most).collect()
        for g in set(groups) - {None}:
            parts = sorted((r.part, [x.i for x in r["items"]]) for r in rows if r.g == g)
            assert [k for k, _ in parts] == list(range(-(-sizes[g] // most)))
            assert [i for _, items in parts for i in items] == sorted(i * 37 % sizes[g] // 2 for i in range(sizes[g]))
            assert all(len(items) == most for _, items in parts[:-1])


def test_pages_come_in_order(spark):
    v = Fixtures(spark, "/root/testdata/sf0.001")
    pages = [
        listings.list_sales_catalog(v.sales, v.sale_products, v.products, max_items=20),
        listings.list_admin_orders(v.orders, v.users, v.sales, v.order_items, v.products, max_items=2),
        listings.list_user_orders(v.orders, v.sales, v.order_items, v.products, user_id=7, max_items=2),
    ]
    for rows in (p.select("position", "part").collect() for p in pages):
        assert rows == sorted(rows) and len(rows) > len({r.position for r in rows})
    users = reports.list_users_spend(v.users, v.orders, page_no=2, limit=15).collect()
    assert [u.position for u in users] == list(range(16, 31))


def test_repeated_changes_apply_in_order(spark):
    now = spark.createDataFrame([(1, 5, "a"), (2, 6, "b")], "k INT, v INT, w STRING")
    new = spark.createDataFrame([(1, 6, 1), (1, 7, 2), (3, 9, 2), (3, 8, 1)], "k INT, v INT, seq INT")
    out = transitions.upsert(now, new, ["k"], ["v"], {"w": F.lit("new")}, ["seq"])
    assert sorted(one(out)) == [(1, 7, "a"), (2, 6, "b"), (3, 9, "new")]
    start = at("2024-01-01 00:00:00")
    products = spark.createDataFrame([(1, "p", "d", Decimal("1.00"), None, True, start)], TABLES["products"])
    flags = {f"has_{f}": False for f in transitions.PATCHABLE}
    fields = dict.fromkeys(transitions.PATCHABLE)
    patches = [
        {"id": 1, "seq": 1, **flags, **fields, "has_name": True, "name": "one", "has_base_price": True, "base_price": "2"},
        {"id": 1, "seq": 2, **flags, **fields, "has_name": True, "name": "two"},
        {"id": 1, "seq": 3, **flags, **fields, "has_name": True, "name": "bad", "has_base_price": True, "base_price": "-1"},
        {"id": 1, "seq": 4, **flags, **fields, "has_description": True, "description": None},
    ]
    schema = "id BIGINT, seq INT, " + ", ".join(f"has_{f} BOOLEAN, {f} STRING" for f in transitions.PATCHABLE)
    out = transitions.patch_products(products, spark.createDataFrame(patches, schema), ["seq"])
    row = out["products"].collect()
    assert [(r.name, r.description, r.base_price) for r in row] == [("two", None, Decimal("2.00"))]
    assert one(out["rejected"]) == [(1, "INVALID_PRICE")]


def test_statuses_keep_unlisted(spark):
    df = spark.createDataFrame([("PENDING",), ("ODD",), ("ODD",)], "status STRING")
    got = dict(one(reports.order_status_counts(df)))
    assert got == {"PENDING": 1, "CONFIRMED": 0, "FAILED": 0, "ODD": 2}


def test_empty_tables(spark):
    frames = {t: spark.createDataFrame([], s) for t, s in TABLES.items()}
    stats = reports.dashboard_stats(frames["users"], frames["orders"], frames["sales"]).first()
    assert stats.total_users == 0 and stats.total_revenue == 0 and stats.total_orders == 0
    meta = listings.pagination_meta(frames["products"], 1, 10).first()
    assert (meta.total, meta.total_pages) == (0, 0)
    run = reconcile.reconcile_run(
        frames["sales"], frames["sale_products"], frames["products"], frames["orders"], frames["order_items"],
        frames["inventory"], spark.createDataFrame([], "sale_product_id BIGINT, live_qty INT"), frames["outbox"], ts(NOW),
    )
    assert not run["summary"].first().has_issues


def test_sale_without_products_has_null_list(spark):
    sales = spark.createDataFrame(
        [(1, "a", at("2024-01-01 00:00:00"), at("2024-02-01 00:00:00"), "ACTIVE", at("2024-01-01 00:00:00"))],
        TABLES["sales"],
    )
    none = spark.createDataFrame([], TABLES["sale_products"])
    products = spark.createDataFrame([], TABLES["products"])
    assert listings.list_sales_catalog(sales, none, products).first().products is None
    counters = spark.createDataFrame([], "sale_product_id BIGINT, live_qty INT")
    assert listings.sale_detail_live(sales, none, products, counters).first().products is None
    assert reports.sale_card_totals(sales, none).first().total_items == 0


def test_boundaries_are_strict(spark):
    orders = spark.createDataFrame(
        [
            (i, 1, 1, f"k{i}", "PENDING", Decimal("1.00"), at(t), at(t))
            for i, t in enumerate(["2024-05-01 11:45:00", "2024-05-01 11:44:59.999"])
        ],
        TABLES["orders"],
    )
    items = spark.createDataFrame([(f"i{i}", i, 1, 2, Decimal("1.00")) for i in (0, 1)], TABLES["order_items"])
    sp = spark.createDataFrame([(9, 1, 1, Decimal("1.00"), 5, 1)], TABLES["sale_products"])
    counters = spark.createDataFrame([(9, 3)], "sale_product_id BIGINT, live_qty INT")
    assert [r.order_id for r in reconcile.stuck_pending_orders(orders, items, sp, ts(NOW)).collect()] == [1]
    out = reconcile.fail_stuck_orders(orders, items, sp, counters, ts(NOW))
    assert dict(out["orders"].select("id", "status").collect()) == {0: "PENDING", 1: "FAILED"}
    assert out["sale_products"].first().reserved_qty == 0
    assert out["counters"].first().live_qty == 5
    log = spark.createDataFrame(
        [(0, "X", "{}", False, at("2024-05-01 11:50:00")), (1, "X", "{}", False, at("2024-05-01 11:49:59"))],
        TABLES["outbox"],
    )
    assert one(reconcile.stale_outbox(log, ts(NOW))) == [("X", 1)]


def reconcile_state(spark):
    start, end = at("2024-04-30 00:00:00"), at("2024-05-02 00:00:00")
    old, new = at("2024-05-01 11:00:00"), at("2024-05-01 11:59:00")
    return {
        "sales": spark.createDataFrame([(1, "s", start, end, "ACTIVE", start)], TABLES["sales"]),
        "sale_products": spark.createDataFrame(
            [(10 + p, 1, p, Decimal("5.00"), 9, 4) for p in range(4)], TABLES["sale_products"]
        ),
        "products": spark.createDataFrame(
            [(p, f"p{p}", None, Decimal("6.00"), None, True, start) for p in range(4)], TABLES["products"]
        ),
        "orders": spark.createDataFrame(
            [(i, i, 1, f"k{i}", s, Decimal("5.00"), t, t)
             for i, (s, t) in enumerate([("PENDING", old), ("PENDING", new), ("CONFIRMED", old), ("FAILED", old)])],
            TABLES["orders"],
        ),
        "order_items": spark.createDataFrame(
            [(f"i{i}", i, i % 3, 1 + i, Decimal("5.00")) for i in range(4)], TABLES["order_items"]
        ),
        "inventory": spark.createDataFrame([(p, 10 + p, 9, start) for p in range(4)], TABLES["inventory"]),
        "counters": spark.createDataFrame([(10, 2), (11, 8), (12, 9)], "sale_product_id BIGINT, live_qty INT"),
        "outbox": spark.createDataFrame([(1, "ORDER_CREATED", "{}", False, new)], TABLES["outbox"]),
    }


def test_reconcile_twice_is_once(spark):
    state = reconcile_state(spark)
    first = reconcile.reconcile_run(**state, as_of=ts(NOW))
    s = first["summary"].first()
    assert (s.stuck_fixed, s.discrepancies, s.stale_events, s.has_issues) == (1, 2, 0, True)
    assert dict(one(first["counters"])) == {10: 9, 11: 8, 12: 8}
    assert first["inventory"].filter("sale_product_id = 13").first().available_qty == 9
    again = {**state, **{k: first[k] for k in ("orders", "sale_products", "inventory", "counters")}}
    second = reconcile.reconcile_run(**again, as_of=ts(NOW))
    assert not second["summary"].first().has_issues
    assert dict(one(second["counters"])) == dict(one(first["counters"]))
    assert second["issues"].count() == 0


def test_payments_replayed_is_once(spark):
    state = reconcile_state(spark)
    messages = spark.createDataFrame(
        [(0, 0, 10, 6, Decimal("5.00"), "p0"), (1, 1, 13, 2, Decimal("5.00"), "p1"), (2, 2, 12, 1, Decimal("5.00"), "p2")],
        "order_id BIGINT, user_id BIGINT, sale_product_id BIGINT, quantity BIGINT, total_amount DECIMAL(10,2), product_name STRING",
    )
    outcomes = spark.createDataFrame(
        [(0, 1, False, None, "no"), (0, 2, True, "t", None), (1, 3, False, None, "no"), (2, 4, False, None, "no"),
         (77, 5, True, "t", None)],
        "order_id BIGINT, delivery_id BIGINT, success BOOLEAN, transaction_id STRING, reason STRING",
    )

    def run(s, **kw):
        return transitions.apply_payment_outcomes(
            s["orders"], s["sale_products"], s["counters"], messages.unionByName(messages), outcomes, ts(NOW), **kw
        )

    out = run(state)
    assert dict(out["orders"].select("id", "status").collect()) == {0: "FAILED", 1: "FAILED", 2: "CONFIRMED", 3: "FAILED"}
    assert dict(out["sale_products"].select("id", "reserved_qty").collect()) == {10: 0, 11: 4, 12: 4, 13: 2}
    assert dict(one(out["counters"])) == {10: 3, 11: 8, 12: 9}
    assert dict(one(run(state, release_creates=True)["counters"])) == {10: 3, 11: 8, 12: 9, 13: 1}
    again = run({**state, **{k: out[k] for k in ("orders", "sale_products", "counters")}})
    assert again["outbox"].count() == 0
    assert dict(one(again["counters"])) == dict(one(out["counters"]))
    log = outbox.append_events(state["outbox"], out["outbox"], "b", ts(NOW))
    assert outbox.append_events(log, out["outbox"], "b", ts(NOW)).count() == log.count() == 3
    later = outbox.append_events(log, out["outbox"].unionByName(out["outbox"]), "b", ts("2024-05-01 12:05:00"))
    assert sorted(one(later)) == sorted(one(log))
    assert outbox.append_events(log, out["outbox"], "c", ts(NOW)).count() == 5


def test_lapsed_sale_takes_two_ticks(spark):
    start, end = at("2024-01-01 00:00:00"), at("2024-01-02 00:00:00")
    sales = spark.createDataFrame(
        [(1, "lapsed", start, end, "SCHEDULED", start), (2, "empty", start, end, "SCHEDULED", start),
         (3, "running", start, end, "ACTIVE", start)],
        TABLES["sales"],
    )
    sp = spark.createDataFrame(
        [(11, 1, 1, Decimal("1.00"), 5, 0), (31, 3, 1, Decimal("1.00"), 5, 1), (32, 3, 2, Decimal("1.00"), 5, 1)],
        TABLES["sale_products"],
    )
    inv = spark.createDataFrame([(i, i, 5, start) for i in (11, 31, 32)], TABLES["inventory"])
    counters = spark.createDataFrame([(31, -2)], "sale_product_id BIGINT, live_qty INT")
    one_tick = transitions.advance_sales(sales, sp, inv, counters, ts(NOW))
    assert dict(one_tick["sales"].select("id", "status").collect()) == {1: "ACTIVE", 2: "SCHEDULED", 3: "ENDED"}
    assert dict(one(one_tick["counters"])) == {11: 5}
    assert dict(one_tick["sale_products"].select("id", "reserved_qty").collect()) == {11: 0, 31: 7, 32: 1}
    assert dict(one_tick["inventory"].select("sale_product_id", "available_qty").collect()) == {11: 5, 31: 0, 32: 5}
    feed = dict(one(transitions.feed_sale_status(sales, one_tick["sales"])))
    assert feed == {1: "ACTIVE", 3: "ENDED"}
    two = transitions.advance_sales(*[one_tick[k] for k in ("sales", "sale_products", "inventory", "counters")], ts(NOW))
    assert dict(two["sales"].select("id", "status").collect()) == {1: "ENDED", 2: "SCHEDULED", 3: "ENDED"}
    assert one(two["counters"]) == []


def test_relay_blocked_by_unknown_types(spark):
    rows = [(i, "CLICK", "{}", False, at(f"2024-01-01 00:00:{i:02d}")) for i in range(3)]
    rows += [(9, "ORDER_CREATED", "{}", False, at("2024-01-01 00:01:00")),
             (8, "ORDER_CREATED", "{}", False, at("2023-12-31 00:00:00")),
             (7, "PAYMENT_FAILED", "{}", False, at("2024-01-01 00:00:01"))]
    log = spark.createDataFrame(rows, TABLES["outbox"])
    state = dict(outbox.outbox_drained(log, batch=3).select("id", "state").collect())
    assert state == {0: "UNROUTABLE", 1: "UNROUTABLE", 2: "UNROUTABLE", 8: "RELAYED", 7: "RELAYED", 9: "BLOCKED"}
    now = log
    for _ in range(5):
        now = outbox.outbox_relay(now, batch=3)
    assert {r.id for r in now.filter("published").collect()} == {8, 7}
    free = dict(outbox.outbox_drained(log, batch=4).select("id", "state").collect())
    assert free[9] == "RELAYED"


def test_event_bodies(spark):
    bodies = ['{"k": 5}', '"{\\"k\\": 6}"', '{"k": 5', "not json", None, '"plain"']
    df = spark.createDataFrame(list(enumerate(bodies)), "id INT, payload STRING")
    out = decode_events(df, struct("k INT"))
    assert {r.id: r.body.k for r in decoded(out).collect()} == {0: 5, 1: 6}
    assert sorted(r.id for r in quarantined(out).collect()) == [2, 3, 4, 5]


def test_rule_order_and_overflow(spark):
    df = spark.createDataFrame(
        [("a", "d", "99999999.99"), ("a", " ", "1e9"), ("", "d", "-1"), ("a", "d", "x"), (" b ", None, "3.999")],
        "name STRING, description STRING, base_price STRING",
    )
    rows = rules.dq_products(df).collect()
    assert [r.error_code for r in rows] == [None, "PRICE_OUT_OF_RANGE", "MISSING_FIELDS", "INVALID_PRICE", None]
    assert (rows[4].name, rows[4].price, rows[0].price) == ("b", Decimal("4.00"), Decimal("99999999.99"))
    requests = spark.createDataFrame(
        [(1, 1, None), (1, 1, 0.0), (1, 1, 5.0), (1, 1, 5.5), (1, 1, 2.5), (None, 1, 9.0), (1, None, 1.0)],
        "sale_id BIGINT, sale_product_id BIGINT, quantity DOUBLE",
    )
    codes = [r.error_code for r in rules.dq_order_requests(requests).collect()]
    assert codes == [None, "INVALID_QUANTITY", None, "INVALID_QUANTITY", "INVALID_QUANTITY", "MISSING_FIELDS", "MISSING_FIELDS"]
    checked = rules.dq_order_requests(requests)
    assert rules.valid(checked).count() + rules.rejected(checked).count() == 7


def test_typed_scan(spark, tmp_path):
    for name, schema in TABLES.items():
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}")
    tables = load(spark, str(tmp_path))
    assert {t: df.schema for t, df in tables.items()} == dict(TABLES)
    loose = spark.createDataFrame([("i", "1", "2", "3", "4.5")], "id STRING, order_id STRING, product_id STRING, quantity STRING, unit_price STRING")
    assert conform(loose, "order_items").first().unit_price == Decimal("4.50")


def test_ordered_operators_on_no_rows(spark):
    from stockyard.operators import admission, ledger, limits

    calls = spark.createDataFrame([], "user_id BIGINT, ms BIGINT, id BIGINT")
    assert limits.limit_chain(calls, "ms", "id").count() == 0
    assert limits.limit_buy(calls, "ms", "id", blocks=3).count() == 0
    assert limits.attempt_pressure(calls, "user_id", "ms", 10).count() == 0
    events = spark.createDataFrame([], "k BIGINT, ts BIGINT, id BIGINT, delta INT")
    totals = spark.createDataFrame([], "k BIGINT, total_qty INT")
    for units in ("per_order", "quantity"):
        assert ledger.stock_ledger(events, totals, ["k"], units).count() == 0
    log = spark.createDataFrame([], "sale_id BIGINT, product_id BIGINT, user_id BIGINT, ts BIGINT, request_id BIGINT")
    stock = spark.createDataFrame([], "sale_id BIGINT, product_id BIGINT, total_qty INT")
    assert admission.admit_requests(log, stock).count() == 0


def test_admin_page_when_most_orders_have_no_items(spark):
    """More than the over-fetched rows drop out, so the full join answers."""
    start = at("2024-01-01 00:00:00")
    orders = spark.range(2000).selectExpr(
        "id", "1L AS user_id", "1L AS sale_id", "'k' AS idempotency_key", "'PENDING' AS status",
        "CAST(1 AS DECIMAL(10,2)) AS total_amount", "TIMESTAMP_NTZ'2024-01-01 00:00:00' + make_dt_interval(0, 0, cast(id AS INT)) AS created_at",
        "TIMESTAMP_NTZ'2024-01-01 00:00:00' AS updated_at",
    )
    users = spark.createDataFrame([(1, "e", "n", "user", True, start)], TABLES["users"])
    sales = spark.createDataFrame([(1, "s", start, start, "ACTIVE", start)], TABLES["sales"])
    products = spark.createDataFrame([(1, "p", None, Decimal("1.00"), None, True, start)], TABLES["products"])
    items = spark.createDataFrame([(f"i{i}", i, 1, 1, Decimal("1.00")) for i in range(30)], TABLES["order_items"])
    got = listings.list_admin_orders(orders, users, sales, items, products, page_no=2, limit=20)
    assert sorted(r.id for r in got.collect()) == list(range(10))
    own = listings.list_user_orders(orders, sales, items, products, user_id=1, page_no=1, limit=7)
    assert sorted(r.id for r in own.collect()) == list(range(23, 30))
    detail = listings.order_detail(orders.filter("id = 3 AND user_id = 1"), sales, items, products).collect()
    assert [x.product_name for x in detail[0]["items"]] == ["p"]


@pytest.mark.parametrize("few", [4, 3])
def test_few_groups_derive_their_details_once(spark, monkeypatch, few):
    monkeypatch.setattr(nesting, "IN_TASK", 50)
    monkeypatch.setattr(nesting, "SMALL_ROWS", few)
    df = spark.createDataFrame([(g, i % 40) for g in (1, 2, None) for i in range(120)] + [(3, 0)], "g INT, i INT")
    nested = nesting.nest(df, ["g"], ["i"], "items", max_items=25)
    assert ("Union" in nested._jdf.queryExecution().optimizedPlan().toString()) == (few < 4)
    for g in (1, 2, None):
        rows = sorted((r for r in nested.collect() if r.g == g), key=lambda r: r.part)
        assert [r.part for r in rows] == list(range(5))
        assert [x.i for r in rows for x in r["items"]] == sorted(i % 40 for i in range(120))


def test_ranks_over_stored_blocks_with_equal_rows(spark):
    rows = [(k, i // 7) for k in range(3) for i in range(100)] + [(9, 1)] * 200
    ranked = blocks.stored_ranks(spark.createDataFrame(rows, "k INT, i INT"), ["k"], ["i"]).collect()
    for k, n in ((0, 100), (1, 100), (2, 100), (9, 200)):
        own = sorted((r.rn, r.i) for r in ranked if r.k == k)
        assert [rn for rn, _ in own] == list(range(1, n + 1)) and [i for _, i in own] == sorted(i for _, i in own)


def _sale_frames(spark, folder):
    sales = [(i, f"s{i}", datetime(2024, 1, i + 1), datetime(2024, 1, i + 9), "ENDED", datetime(2024, 1, 1)) for i in range(4)]
    kinds = "id BIGINT, name STRING, start_time TIMESTAMP_NTZ, end_time TIMESTAMP_NTZ, status STRING, created_at TIMESTAMP_NTZ"
    spark.createDataFrame(sales, kinds).write.parquet(f"{folder}/sales")
    lines = [(10 * s + p, s, p, p, 5, 1) for s in (0, 2) for p in range(7)] + [(99, None, 1, 1, 5, 1)]
    kinds = "id BIGINT, sale_id BIGINT, product_id BIGINT, sale_price INT, total_qty INT, reserved_qty INT"
    spark.createDataFrame(lines, kinds).write.parquet(f"{folder}/lines")
    products = spark.createDataFrame([(p, f"p{p}", "d", "k") for p in range(6)], "id BIGINT, name STRING, description STRING, image_key STRING")
    return spark.read.parquet(f"{folder}/sales"), spark.read.parquet(f"{folder}/lines"), products


def test_headers_do_not_move_their_nested_rows(spark, tmp_path):
    sales, lines, products = _sale_frames(spark, tmp_path)
    docs = reports.nested_sale_products(sales, lines, max_items=3)
    assert "LeftOuter" not in docs._jdf.queryExecution().optimizedPlan().toString()
    got = sorted((r.id, r.part, None if r.products is None else len(r.products)) for r in docs.filter("id % 2 = 0").collect())
    assert got == [(s, k, n) for s in (0, 2) for k, n in enumerate((3, 3, 1))]
    assert sorted((r.id, r.part, r.products) for r in docs.filter("id % 2 = 1").collect()) == [(1, None, None), (3, None, None)]


def test_page_of_sales_is_cut_once(spark, tmp_path):
    sales, lines, products = _sale_frames(spark, tmp_path)
    listed = listings.list_sales_catalog(sales, lines, products, status="ended", limit=3, max_items=5)
    assert not any(f"{tmp_path}/sales" in f for f in listed.inputFiles())
    got = [(r.position, r.id, r.part, r.products and len(r.products)) for r in listed.collect()]
    assert got == [(1, 3, None, None), (2, 2, 0, 5), (2, 2, 1, 2), (3, 1, None, None)]


def test_sale_documents_derive_the_allocations_once(spark):
    for name in ("sale_detail_document", "nested_sale_products"):
        docs = QUERIES[name](spark, "/root/testdata/sf0.001")
        assert not any("lineitem" in f for f in docs.inputFiles())
