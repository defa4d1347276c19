"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose
the tables and the local cores. Each query is planned and run to the end once
per round, all rows are produced, and the best of three rounds counts.
"""

from __future__ import annotations

import json
import os
import sys
import time

from stockyard.plans.catalog import QUERIES
from stockyard.session import local_session

HEADLINES = [
    "sale_monitor",
    "sale_monitor_live",
    "sale_monitor_totals",
    "join_items_orders_in_sale",
    "join_order_star",
    "dashboard_stats",
    "user_spend",
    "list_admin_orders",
    "list_sales_catalog",
    "nested_order_items",
    "semi_prior_purchase",
    "idempotent_dedupe",
    "stock_ledger",
    "admit_requests",
    "admit_with_releases",
    "limit_sliding",
    "limit_global",
    "limit_chain",
    "attempt_pressure",
    "admission_funnel",
    "inventory_discrepancies",
    "fail_stuck_orders",
    "reconcile_run",
    "apply_payment_outcomes",
    "advance_sales",
    "sink_outbox_append",
    "outbox_drained",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    rounds = int(os.environ.get("BENCH_ROUNDS", "3"))
    names = sys.argv[1:] or HEADLINES
    spark = local_session(cpus, "stockyard-bench")
    spark.sparkContext.setLogLevel("OFF")
    best: dict[str, float] = {}
    for _ in range(rounds):
        for name in names:
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            taken = time.perf_counter() - start
            best[name] = min(best.get(name, taken), taken)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_query_time",
                "value": round(sum(best.values()), 3),
                "unit": "sec",
                "queries": {name: round(sec, 3) for name, sec in best.items()},
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
                "cpus": int(cpus),
            }
        )
    )


if __name__ == "__main__":
    main()
