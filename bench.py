"""Time the headline queries: one warm-up, then the median of three runs, all rows computed.

Prints one JSON line. ``BENCH_SF_DIR`` and ``BENCH_CPUS`` choose data and cores.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks.registry import QUERIES  # noqa: E402
from stockline.session import build_session  # noqa: E402

HEADLINES = (
    "stock_valuation",          # grouping sets
    "warehouse_comparison",     # pivot
    "low_stock_alerts",         # surplus arrays
    "po_summary",               # pre-aggregated master/detail
    "demand_velocity",          # distinct counts
    "stockout_predictions",     # join, aggregate, rank
    "reorder_recommendations",  # the same with suppliers
    "abc_classification",       # running share over everything
    "price_change_pct",         # top rows per product
    "allocate_backorders",      # running totals per stock row
    "adjust_stock",             # clamped running totals
    "receive_goods",            # receipts with order closing
    "check_credit",             # sequential acceptance per customer
    "create_orders",            # whole order intake
    "dispatch_transfers",       # sequential acceptance across products
    "stream_stock_balance",     # stream run to completion
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))
    spark = build_session(
        "bench", master=f"local[{cpus}]", shuffle_partitions=int(cpus),
        **{"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "12g"},
    )
    spark.sparkContext.setLogLevel("ERROR")

    def run(key: str) -> float:
        start = time.perf_counter()
        QUERIES[key](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    seconds = {}
    for key in HEADLINES:
        run(key)
        seconds[key] = round(statistics.median(run(key) for _ in range(repeats)), 3)
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "cpus": int(cpus),
    }))


if __name__ == "__main__":
    main()
