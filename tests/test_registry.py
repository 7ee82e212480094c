import os

import pytest

import __spark_entry__ as entry
from checks.compare import canonical
from checks.registry import QUERIES

SF = "/root/testdata/sf0.001"

# One query of each kind; ``python -m checks.compare`` runs all of them.
KEYS = ["warehouse_summary", "low_stock_alerts", "stock_valuation", "warehouse_comparison", "stockout_predictions", "route_order",
        "abc_classification", "price_order_lines", "receive_goods", "review_decisions", "create_orders", "allocate_backorders",
        "ingest_invoices", "stream_movements_by_day"]


def test_registry_is_consistent():
    queries, oracle = entry.queries(), entry.oracle_sql()
    assert set(oracle) <= set(queries) and set(KEYS) <= set(oracle)
    assert set(QUERIES) <= set(queries) and not set(QUERIES) - set(oracle)


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
@pytest.mark.parametrize("key", KEYS)
def test_query_equals_sql(spark, key):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{SF}/{name}'")
    df = entry.queries()[key](spark, SF)
    result = con.execute(entry.oracle_sql()[key])
    names = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(names)
    assert canonical([tuple(r) for r in df.collect()], df.columns) == canonical(result.fetchall(), names)


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
def test_flagship(spark):
    assert entry.entry(spark).count() == 130


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
@pytest.mark.parametrize("key", ["warehouse_mismatch", "route_order", "stock_imbalance", "dashboard_warehouses", "price_order_lines",
                                 "transfer_suggestions", "check_moq", "review_queue"])
def test_no_all_pairs_plan(spark, key):
    """Even when nothing is small enough to broadcast, no plan forms all pairs of rows."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = entry.queries()[key](spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "BatchEvalPython" not in plan
