"""What the physical plans must and must not contain."""

import pytest

from stockyard.operators import listings, outbox, reports, sketches
from stockyard.plans.catalog import QUERIES
from stockyard.session import scratch, store
from stockyard.sources.fixtures import Fixtures
from stockyard.sources.layout import load_bucketed, save_bucketed, save_in_folders

FOLDER = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_no_cross_joins(spark):
    for name, fn in QUERIES.items():
        if "stream" in name:
            continue
        text = plan(fn(spark, FOLDER))
        assert "CartesianProduct" not in text, name
        assert "BroadcastNestedLoopJoin" not in text, name


def test_monitor_reads_only_its_columns(spark):
    text = plan(QUERIES["sale_monitor"](spark, FOLDER))
    assert "l_tax" not in text and "l_shipdate" not in text and "o_orderpriority" not in text


def test_filters_reach_the_scan(spark, tmp_path):
    v = Fixtures(spark, FOLDER)
    save_in_folders(v.outbox, "outbox", f"{tmp_path}/outbox")
    log = spark.read.parquet(f"{tmp_path}/outbox")
    text = plan(outbox.outbox_batch(log))
    assert "PartitionFilters: [isnotnull(published" in text
    assert "TakeOrderedAndProject" in text


def test_pages_are_top_k(spark):
    v = Fixtures(spark, FOLDER)
    assert "TakeOrderedAndProject" in plan(listings.list_active_products(v.products, "http://x"))


def test_first_pages_per_user_are_cut_before_the_shuffle(spark):
    text = plan(QUERIES["list_user_orders"](spark, FOLDER))
    assert "row_number(), 5, Partial" in text


def test_bucketed_join_has_no_shuffle(spark, tmp_path, no_broadcast):
    v = Fixtures(spark, FOLDER)
    for name in ("orders", "order_items"):
        save_bucketed(getattr(v, name), name, f"b_{name}", 4, f"{tmp_path}/{name}")
    orders, items = load_bucketed(spark, "b_orders"), load_bucketed(spark, "b_order_items")
    joined = reports.join_order_line_to_sale_product
    assert joined(orders, items, v.sale_products).count() == joined(v.orders, v.order_items, v.sale_products).count()
    text = plan(items.join(orders.withColumnRenamed("id", "order_id"), "order_id"))
    assert "SortMergeJoin" in text and "Exchange" not in text
    for name in ("orders", "order_items"):
        spark.sql(f"DROP TABLE b_{name}")


def test_each_limiter_of_the_funnel_is_folded_once(spark):
    text = plan(QUERIES["admission_funnel"](spark, FOLDER))
    assert "MapInArrow" not in text and "MapInPandas" not in text  # all read from what was stored


def test_scratch_tables_are_removed(spark):
    with scratch(spark) as folder:
        inner = store(spark.range(5).toDF("i"))
        assert inner.count() == 5
        assert all(folder in f for f in inner.inputFiles())
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    assert not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    assert store(spark.range(3).toDF("i")).count() == 3


def test_sketched_counts_keep_their_bound_and_repeats_count_once(spark):
    orders = spark.range(120_000).selectExpr(
        "id", "id % 1000 AS user_id", "IF(id % 3 = 0, 'FAILED', 'CONFIRMED') AS status",
        "IF(id = 7, NULL, TIMESTAMP_NTZ'2024-01-01 00:00:00' + make_dt_interval(CAST(id % 20 AS INT))) AS created_at",
    )
    users = spark.range(900).selectExpr("id")
    error = 3 * 1.04 / 2 ** (sketches.LG_K / 2)
    stored = store(sketches.order_sketches(orders.filter("id < 70000"), users))
    again = sketches.order_sketches(orders.filter("id >= 30000 OR id = 7"), users)
    merged = store(sketches.merge_sketches(stored, again))
    assert merged.count() == 20 * 2 + 1
    for status in ("CONFIRMED", None):
        chosen = [listings.status_is(status)] if status else []
        exact = reports.count_distinct_orders(orders, users, *chosen).first().total
        got = sketches.count_from_sketches(merged, *chosen)
        assert abs(got.first().total / exact - 1) < error
    assert sketches.count_from_sketches(merged, listings.status_is("NONE")).first().total == 0
    assert "Scan" not in plan(got).replace("Scan parquet", "") and plan(got).count("Scan parquet") == 1  # the stored sketches only


def test_sketches_of_the_tables(spark):
    exact = QUERIES["count_distinct_orders"](spark, FOLDER).first().total
    assert abs(QUERIES["count_sketched_orders"](spark, FOLDER).first().total / exact - 1) < 0.03
