"""Presents the driver's test tables in the library's data model.

Each region is a warehouse and each part a product. Every definition is a
narrow projection written once in SQL that Spark and DuckDB both accept, so the
adapter adds no shuffle to the queries and the SQL check reads the same rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from stockline.tables import Tables

_CURRENCY = "CASE {0} % 3 WHEN 0 THEN 'GBP' WHEN 1 THEN 'USD' ELSE 'EUR' END"
_QTY = "CAST(l_quantity AS INT)"
_CENTS = "CAST(ROUND(l_extendedprice * 100) AS BIGINT)"
_PENCE = f"CAST(FLOOR({_CENTS} / CAST(l_quantity AS BIGINT)) AS BIGINT)"
_UNIT = f"CAST({_PENCE} * 0.01 AS DECIMAL(12,2))"
_LINE_ID = (
    "CONCAT(CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING), '-', CAST(l_partkey AS STRING), "
    f"'-', CAST(l_suppkey AS STRING), '-', CAST({_CENTS} AS STRING))"
)
_SKU = "CONCAT('SKU-', CAST({0} AS STRING))"
_SELL = "CAST(ROUND(p_retailprice * 100) AS BIGINT)"
_COST = f"CAST(FLOOR({_SELL} * (50 + p_partkey % 30) / 100) AS BIGINT)"
_HAND = (
    "CASE WHEN (p_partkey + r_regionkey) % 11 = 0 THEN 0 "
    "ELSE (p_partkey * 31 + r_regionkey * 17) % 97 END"
)
_BACK = (
    f"CASE WHEN l_linestatus = 'O' AND l_returnflag = 'N' THEN {_QTY} "
    f"WHEN l_linestatus = 'O' AND l_returnflag = 'A' THEN CAST(CEIL(l_quantity / 2) AS INT) ELSE 0 END"
)
_YEAR = "CAST(EXTRACT(YEAR FROM {0}) AS STRING)"
_PO_STATUS = (
    "CASE o_orderpriority WHEN '5-LOW' THEN 'draft' WHEN '4-NOT SPECIFIED' THEN 'submitted' "
    "WHEN '3-MEDIUM' THEN 'partial' ELSE 'received' END"
)

# table -> (source, columns, filter)
_VIEWS: dict[str, tuple[str, list[str], str | None]] = {
    "warehouses": ("region", [
        "r_regionkey AS code", "r_name AS name", _CURRENCY.format("r_regionkey") + " AS currency",
    ], None),
    "suppliers": ("supplier", [
        "s_suppkey AS id", "s_name AS name", "CONCAT(s_name, '@example.com') AS contact_email",
        "CAST(7 + s_suppkey % 28 AS INT) AS lead_time_days",
        "CAST(NULL AS DECIMAL(6,1)) AS actual_lead_time_days",
        _CURRENCY.format("s_nationkey") + " AS currency", "CAST(NULL AS STRING) AS notes",
    ], None),
    "products": ("part", [
        "p_partkey AS id", "p_name AS name", _SKU.format("p_partkey") + " AS sku",
        "LPAD(CAST(p_partkey AS STRING), 13, '0') AS barcode", "p_brand AS brand",
        "CASE WHEN p_size = 50 THEN NULL ELSE CAST(FLOOR(p_partkey / 20) AS BIGINT) END AS supplier_id",
        f"CAST({_COST} * 0.01 AS DECIMAL(12,2)) AS cost_price_gbp",
        f"CAST({_SELL} * 0.01 AS DECIMAL(12,2)) AS sell_price_gbp",
        "CAST(p_size % 12 AS INT) AS case_pack", "CAST(1 + p_size % 5 AS INT) AS moq",
        "CASE WHEN p_size <= 10 THEN 'A' WHEN p_size <= 25 THEN 'B' ELSE 'C' END AS abc_class",
    ], None),
    "warehouse_stock": ("part_region", [
        "p_partkey * 10 + r_regionkey AS id", "p_partkey AS product_id", "r_regionkey AS warehouse",
        f"CAST({_HAND} AS INT) AS qty_on_hand",
        f"CAST(FLOOR(({_HAND}) * ((p_partkey + 3 * r_regionkey) % 5) / 10) AS INT) AS qty_reserved",
        "CAST((p_partkey * 7 + r_regionkey) % 30 AS INT) AS reorder_point",
        "CAST(40 + (p_partkey * 7 + r_regionkey) % 30 AS INT) AS max_stock",
        "CONCAT(CASE p_partkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'C' END, '-', "
        "LPAD(CAST(p_partkey % 20 AS STRING), 2, '0'), '-', LPAD(CAST(p_partkey % 6 AS STRING), 2, '0')) AS location",
    ], None),
    "price_tiers": ("part_tier", [
        "p_partkey * 100 + min_qty AS id", "p_partkey AS product_id", "min_qty",
        "CAST(CASE WHEN p_size = 20 AND min_qty = 25 THEN 1 ELSE discount_pct END AS DECIMAL(5,2)) AS discount_pct",
    ], None),
    "customers": ("customer_nation", [
        "c_custkey AS id", "c_name AS company_name", "CAST(NULL AS STRING) AS contact_name",
        "CONCAT(c_name, '@example.com') AS email", "CAST(NULL AS STRING) AS billing_address",
        "'GBP' AS currency_preference", "CAST(NULL AS STRING) AS vat_number", "CAST(NULL AS STRING) AS notes",
        "n_regionkey AS region",
        "CASE c_mktsegment WHEN 'BUILDING' THEN 'wholesale' WHEN 'MACHINERY' THEN 'distributor' "
        "ELSE 'retail' END AS customer_type",
        "CASE c_custkey % 5 WHEN 0 THEN 'prepaid' WHEN 1 THEN 'net-15' WHEN 2 THEN 'net-30' WHEN 3 THEN 'net-60' "
        "ELSE 'net-90' END AS payment_terms",
        "CAST(CASE WHEN c_custkey % 5 = 0 THEN 0 ELSE 50000 + (c_custkey % 10) * 150000 END AS DECIMAL(12,2)) "
        "AS credit_limit_gbp",
        "CAST((c_custkey % 7) * 9000 AS DECIMAL(12,2)) AS credit_used_gbp",
        "CAST((c_custkey % 4) * 2 AS DECIMAL(5,2)) AS default_discount_pct",
    ], None),
    "orders": ("orders", [
        "o_orderkey AS id",
        f"CONCAT('ORD-', {_YEAR.format('o_orderdate')}, '-', CAST(o_orderkey AS STRING)) AS order_ref",
        "o_custkey AS customer_id",
        "CONCAT('Customer#', LPAD(CAST(o_custkey AS STRING), 9, '0')) AS customer_name",
        "'confirmed' AS status",
        "CASE WHEN o_orderstatus = 'F' THEN 'shipped' WHEN o_orderstatus = 'P' THEN CASE o_orderkey % 4 "
        "WHEN 0 THEN 'picking' WHEN 1 THEN 'picked' WHEN 2 THEN 'packing' ELSE 'packed' END "
        "ELSE 'confirmed' END AS fulfilment_status",
        "CAST(o_custkey % 5 AS INT) AS warehouse_code", _CURRENCY.format("o_custkey") + " AS currency",
        "CAST(1 AS DECIMAL(12,6)) AS fx_rate", "CAST(o_totalprice AS DECIMAL(12,2)) AS total_gbp",
        "CAST(NULL AS STRING) AS notes",
        "o_orderstatus = 'O' AND o_orderpriority = '1-URGENT' AS requires_review",
        "o_orderdate AS created_at",
    ], None),
    "order_lines": ("lineitem", [
        f"{_LINE_ID} AS id", "l_orderkey AS order_id", "l_partkey AS product_id",
        "CONCAT('Item ', CAST(l_partkey AS STRING)) AS product_name", _SKU.format("l_partkey") + " AS sku",
        f"{_QTY} AS qty_ordered",
        f"CASE l_returnflag WHEN 'A' THEN NULL WHEN 'R' THEN {_QTY} + l_linenumber ELSE {_QTY} END AS qty_requested",
        f"{_UNIT} AS unit_price_gbp", "CAST(NULL AS INT) AS warehouse_allocated",
        "CASE WHEN l_linestatus = 'O' AND l_returnflag = 'N' THEN 'backordered' "
        "WHEN l_linestatus = 'O' AND l_returnflag = 'A' THEN 'partial' ELSE 'unmatched' END AS fulfilment_status",
        "CAST(NULL AS STRING) AS fulfilment_decision", "CAST(NULL AS INT) AS qty_to_ship",
        "CAST(NULL AS INT) AS qty_to_backorder",
        f"CASE WHEN l_linestatus = 'O' AND l_returnflag = 'A' THEN {_QTY} - CAST(CEIL(l_quantity / 2) AS INT) "
        "ELSE 0 END AS qty_fulfilled",
        f"{_BACK} AS qty_backordered",
    ], None),
    "purchase_orders": ("orders", [
        "o_orderkey AS id",
        f"CONCAT('PO-', {_YEAR.format('o_orderdate')}, '-', CAST(o_orderkey AS STRING)) AS po_ref",
        "CAST(FLOOR(o_orderkey / 150) AS BIGINT) AS supplier_id", "CAST(o_orderkey % 5 AS INT) AS warehouse_code",
        f"{_PO_STATUS} AS status", "CAST(NULL AS STRING) AS notes", "o_orderdate AS created_at",
        "CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_orderdate END AS submitted_at",
        "CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') "
        "THEN o_orderdate + INTERVAL '1' DAY * CAST((o_orderkey * 13) % 60 AS INT) END AS received_at",
        "CAST(NULL AS TIMESTAMP_NTZ) AS updated_at",
    ], None),
    "po_lines": ("lineitem", [
        f"{_LINE_ID} AS id", "l_orderkey AS po_id", "l_partkey AS product_id", f"{_QTY} AS qty_ordered",
        f"CAST(CASE l_returnflag WHEN 'N' THEN 0 WHEN 'A' THEN FLOOR(l_quantity / 2) ELSE l_quantity END AS INT) "
        "AS qty_received",
        f"{_UNIT} AS unit_cost_gbp",
    ], None),
    "stock_transfers": ("orders", [
        "o_orderkey AS id",
        f"CONCAT('TXF-', {_YEAR.format('o_orderdate')}, '-', CAST(o_orderkey AS STRING)) AS transfer_ref",
        "CAST(o_orderkey % 5 AS INT) AS from_warehouse",
        "CAST((o_orderkey + 1 + o_custkey % 4) % 5 AS INT) AS to_warehouse",
        "CASE o_orderstatus WHEN 'O' THEN 'requested' WHEN 'P' THEN 'in_transit' ELSE 'received' END AS status",
        "CAST(NULL AS STRING) AS notes", "o_orderdate AS created_at", "CAST(NULL AS TIMESTAMP_NTZ) AS updated_at",
    ], None),
    "transfer_lines": ("lineitem", [
        f"{_LINE_ID} AS id", "l_orderkey AS transfer_id", "l_partkey AS product_id",
        f"CASE WHEN l_linenumber = 5 THEN -{_QTY} ELSE {_QTY} END AS qty",
    ], None),
    "returns": ("lineitem", [
        f"{_LINE_ID} AS id",
        f"CONCAT('RMA-', {_YEAR.format('l_shipdate')}, '-', CAST(l_orderkey AS STRING)) AS rma_ref",
        "l_orderkey AS order_id", "l_suppkey AS customer_id", "l_partkey AS product_id",
        "CAST(l_suppkey % 5 AS INT) AS warehouse_code", f"{_QTY} AS qty",
        "CASE (l_orderkey + l_linenumber) % 8 WHEN 0 THEN 'Box damaged in transit' WHEN 1 THEN 'Defective parts' "
        "WHEN 2 THEN 'Wrong item sent' WHEN 3 THEN 'Expired stock' WHEN 4 THEN 'Quality below standard' "
        "WHEN 5 THEN 'Changed mind' WHEN 6 THEN NULL ELSE 'Arrived broken, wrong item' END AS reason",
        "CASE WHEN l_tax < 0.005 THEN 'expired' END AS reason_code",
        "CASE WHEN l_discount > 0.055 THEN 'write_off' ELSE 'restock' END AS action",
        "CASE WHEN l_linenumber <= 5 THEN 'pending' ELSE 'processed' END AS status", "l_shipdate AS created_at",
    ], None),
    "audit_log": ("events", [
        "event_id AS id", "ts AS created_at",
        "CASE event_type WHEN 'signup' THEN 'stock_received' WHEN 'purchase' THEN 'stock_shipped' "
        "WHEN 'view' THEN 'stock_returned' WHEN 'click' THEN 'stock_transferred_out' ELSE 'stock_adjusted' END AS action",
        "CASE event_type WHEN 'signup' THEN 'purchase_order' WHEN 'purchase' THEN 'order' WHEN 'view' THEN 'return' "
        "WHEN 'click' THEN 'stock_transfer' ELSE 'warehouse_stock' END AS entity_type",
        "CAST(event_id AS STRING) AS entity_id", "CAST(user_id % 5 AS INT) AS warehouse_code",
        "user_id AS product_id",
        "CAST(CASE event_type WHEN 'signup' THEN 1 WHEN 'view' THEN 1 WHEN 'error' THEN "
        "CASE event_id % 2 WHEN 0 THEN 1 ELSE -1 END ELSE -1 END * FLOOR(value) AS INT) AS qty_change",
        "CAST(NULL AS INT) AS balance_after",
        "CONCAT('Moved via ', CASE event_type WHEN 'signup' THEN 'PO' WHEN 'purchase' THEN 'ORD' "
        "WHEN 'view' THEN 'RMA' WHEN 'click' THEN 'TXF' ELSE 'CC' END, '-2024-', "
        "CAST(1000 + event_id AS STRING), CASE event_type WHEN 'click' THEN ' for ORD-2024-0001' ELSE '' END) AS notes",
    ], None),
    "cycle_counts": ("region", [
        "r_regionkey AS id", "CONCAT('CC-2001-000', CAST(r_regionkey AS STRING)) AS count_ref",
        "r_regionkey AS warehouse_code", "'full' AS scope", "CAST(NULL AS STRING) AS scope_filter",
        "CAST(NULL AS STRING) AS notes", "CAST('2001-07-01' AS DATE) AS planned_date",
        "CASE r_regionkey % 3 WHEN 0 THEN 'planned' WHEN 1 THEN 'in_progress' ELSE 'completed' END AS status",
        "CAST(CASE WHEN r_regionkey < 2 THEN '2001-07-30 00:00:00' ELSE '2001-07-01 00:00:00' END AS TIMESTAMP_NTZ) "
        "AS created_at",
        "CAST(NULL AS TIMESTAMP_NTZ) AS updated_at", "CAST(NULL AS TIMESTAMP_NTZ) AS completed_at",
    ], None),
    "cycle_count_lines": ("warehouse_stock", [
        "id", "warehouse AS cycle_count_id", "product_id", "id AS warehouse_stock_id", "qty_on_hand AS expected_qty",
        "CASE WHEN product_id % 10 = 0 THEN NULL ELSE GREATEST(0, qty_on_hand + CAST(product_id % 7 AS INT) - 3) "
        "END AS counted_qty",
        "CASE WHEN product_id % 10 = 0 THEN NULL ELSE GREATEST(0, qty_on_hand + CAST(product_id % 7 AS INT) - 3) "
        "END - qty_on_hand AS variance",
        "location", "CAST(NULL AS STRING) AS notes", "CAST(NULL AS TIMESTAMP_NTZ) AS counted_at",
    ], None),
    "price_history": ("lineitem", [
        f"{_LINE_ID} AS id", "l_partkey AS product_id",
        "CASE l_linenumber % 2 WHEN 0 THEN 'buy_cost' ELSE 'sell_price' END AS field",
        f"{_UNIT} AS old_value",
        f"CAST(CAST(FLOOR({_PENCE} * (100 + CAST(ROUND(l_tax * 100) AS BIGINT) - CAST(ROUND(l_discount * 100) AS BIGINT))"
        " / 100) AS BIGINT) * 0.01 AS DECIMAL(12,2)) AS new_value",
        "l_shipdate AS changed_at",
    ], None),
    "invoices": ("orders", [
        "o_orderkey AS id", "o_custkey AS customer_id",
        f"CONCAT('ORD-', {_YEAR.format('o_orderdate')}, '-', CAST(o_orderkey AS STRING)) AS order_number",
        "CAST(o_orderdate AS DATE) AS order_date", "CAST(o_orderdate AS DATE) AS invoice_date",
        "CAST(FLOOR(o_totalprice / 1000) AS INT) AS total_units",
        "CAST(o_totalprice AS DECIMAL(12,2)) AS total_value_gbp", "CAST(NULL AS STRING) AS source_filename",
    ], None),
    "invoice_lines": ("lineitem", [
        f"{_LINE_ID} AS id", "l_orderkey AS invoice_id", "l_partkey AS product_id",
        _SKU.format("l_partkey") + " AS sku", "CONCAT('Item ', CAST(l_partkey AS STRING)) AS description",
        "CAST(NULL AS STRING) AS barcode", f"{_UNIT} AS trade_price_gbp", f"{_QTY} AS quantity",
        f"CAST({_QTY} * {_UNIT} AS DECIMAL(12,2)) AS subtotal_gbp",
        "CASE WHEN l_linestatus = 'O' AND l_returnflag = 'N' THEN 'backordered' "
        "WHEN l_linestatus = 'O' AND l_returnflag = 'A' THEN 'partial' ELSE 'fulfilled' END AS fulfilment_status",
        f"{_QTY} - ({_BACK}) AS qty_fulfilled", f"{_BACK} AS qty_backordered", "l_shipdate AS created_at",
    ], None),
    "stock": ("part", [
        "p_brand AS brand", "p_name AS title", _SKU.format("p_partkey") + " AS sku",
        "LPAD(CAST(p_partkey AS STRING), 13, '0') AS ean", "CONCAT('B0', CAST(p_partkey AS STRING)) AS asin",
        f"CAST({_SELL} * 0.01 AS DECIMAL(12,2)) AS rrp_gbp", f"CAST({_COST} * 0.01 AS DECIMAL(12,2)) AS buy_cost_gbp",
        "CAST(p_size % 12 AS INT) AS case_pack", "p_size % 3 <> 0 AS available_uk", "p_size % 2 = 0 AS available_us",
    ], None),
}

_FLAG_TIME = (
    "CAST(CASE l_returnflag WHEN 'A' THEN '2002-01-01 00:00:00' WHEN 'N' THEN '2002-01-02 00:00:00' "
    "ELSE '2002-01-03 00:00:00' END AS TIMESTAMP_NTZ)"
)
_NOW = "CAST('2002-01-01 00:00:00' AS TIMESTAMP_NTZ)"

# Requests for the batch jobs, derived from the same tables.
_REQUESTS: dict[str, tuple[str, list[str], str | None]] = {
    "suppliers": ("supplier", [
        "s_suppkey + 1000000 AS request_id",
        "CASE WHEN s_acctbal < 0 THEN '  ' ELSE CONCAT(' ', s_name, ' new ') END AS name",
        "'' AS contact_email",
        "CASE s_suppkey % 3 WHEN 0 THEN '0' WHEN 1 THEN CONCAT(CAST(s_suppkey AS STRING), ' days') ELSE 'soon' END "
        "AS lead_time_days",
        "CASE s_suppkey % 2 WHEN 0 THEN 'USD' ELSE '' END AS currency", "CAST(NULL AS STRING) AS notes",
    ], None),
    "customers": ("customer", [
        "c_custkey + 10000000 AS request_id",
        "CASE WHEN c_acctbal < 0 THEN ' ' WHEN c_mktsegment = 'BUILDING' THEN c_name "
        "ELSE CONCAT('New ', c_mktsegment, ' ', CAST(CAST(FLOOR(c_custkey / 3) AS BIGINT) AS STRING), ' ') END AS company_name",
        "CAST(NULL AS STRING) AS contact_name", "'a@example.com' AS email", "'' AS billing_address",
        "CAST(NULL AS STRING) AS currency_preference", "CAST(NULL AS STRING) AS vat_number",
        "CAST(NULL AS STRING) AS notes", "c_nationkey AS region",
        "CASE c_custkey % 2 WHEN 0 THEN 'wholesale' ELSE '' END AS customer_type",
        "CAST(NULL AS STRING) AS payment_terms",
        "CASE c_custkey % 2 WHEN 0 THEN '1500.50' ELSE 'unlimited' END AS credit_limit_gbp",
        "'2.5' AS default_discount_pct", f"{_NOW} AS requested_at",
    ], None),
    "pos": ("orders", [
        "o_orderkey + 100000000 AS request_id",
        "CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE CAST(FLOOR(o_orderkey / 150) AS BIGINT) END AS supplier_id",
        "CASE WHEN o_orderpriority = '2-HIGH' THEN NULL ELSE CAST(o_orderkey % 5 AS INT) END AS warehouse_code",
        "'' AS notes", "o_orderdate AS requested_at",
    ], None),
    "po_lines": ("lineitem", [
        "l_orderkey + 100000000 AS request_id", f"{_LINE_ID} AS line_no", "l_partkey AS product_id",
        f"CAST({_QTY} AS STRING) AS qty_ordered", f"CAST({_UNIT} AS STRING) AS unit_cost",
    ], None),
    "po_actions": ("lineitem", [
        f"{_LINE_ID} AS request_id", "l_orderkey AS po_id", "l_shipdate AS requested_at",
    ], None),
    "receipts": ("lineitem", [
        "CONCAT(CAST(l_orderkey AS STRING), '-', l_returnflag) AS request_id", "l_orderkey AS po_id",
        f"{_FLAG_TIME} AS requested_at", f"{_LINE_ID} AS line_no", f"{_LINE_ID} AS line_id",
        f"CASE l_linenumber WHEN 7 THEN '0' WHEN 6 THEN CAST({_QTY} + 5 AS STRING) ELSE CAST({_QTY} AS STRING) END AS qty",
    ], None),
    "transfers": ("orders", [
        "o_orderkey + 100000000 AS request_id",
        "CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE CAST(o_orderkey % 5 AS INT) END AS from_warehouse",
        "CAST(o_custkey % 5 AS INT) AS to_warehouse", "'restock' AS notes", "o_orderdate AS requested_at",
    ], None),
    "transfer_lines": ("lineitem", [
        "l_orderkey + 100000000 AS request_id", f"{_LINE_ID} AS line_no", "l_partkey AS product_id",
        f"CAST({_QTY} AS STRING) AS qty",
    ], None),
    "transfer_actions": ("orders", [
        "o_orderkey AS request_id", "o_orderkey AS transfer_id", "o_orderdate AS requested_at",
    ], None),
    "order_actions": ("lineitem", [
        f"{_LINE_ID} AS request_id", "l_orderkey AS order_id",
        "CASE l_returnflag WHEN 'A' THEN 'pick' WHEN 'N' THEN 'pack' ELSE 'ship' END AS action",
        "l_shipdate AS requested_at",
    ], None),
    "reviews": ("orders", [
        "o_orderkey AS request_id", "o_orderkey AS order_id", "o_orderdate AS requested_at",
    ], None),
    "decisions": ("lineitem", [
        "l_orderkey AS request_id", f"{_LINE_ID} AS line_no", f"{_LINE_ID} AS line_id",
        "CASE l_linenumber WHEN 2 THEN 'custom' WHEN 3 THEN 'hold' WHEN 6 THEN 'custom' WHEN 7 THEN 'later' "
        "ELSE 'ship_available' END AS decision",
        f"CAST(CASE l_linenumber WHEN 6 THEN -3 ELSE {_QTY} + 2 END AS STRING) AS custom_qty",
    ], None),
    "totals": ("orders", [
        "o_orderkey AS request_id", "o_custkey AS customer_id",
        "CAST(o_totalprice AS DECIMAL(12,2)) AS total_gbp", "o_orderdate AS requested_at",
    ], None),
    "new_orders": ("orders", [
        "o_orderkey + 100000000 AS request_id",
        "CASE WHEN o_orderkey % 50 = 7 THEN NULL ELSE o_custkey END AS customer_id", "'  ' AS customer_name",
        "CASE WHEN o_orderstatus = 'O' THEN NULL ELSE CAST(o_custkey % 5 AS INT) END AS warehouse_code",
        "'' AS currency", "CAST(NULL AS STRING) AS notes", "o_orderpriority = '1-URGENT' AS skip_checks",
        "o_orderdate AS requested_at",
    ], None),
    "new_order_lines": ("lineitem", [
        "l_orderkey + 100000000 AS request_id", f"{_LINE_ID} AS line_no", "l_partkey AS product_id",
        "CAST(NULL AS STRING) AS product_name", _SKU.format("l_partkey") + " AS sku",
        f"CAST({_QTY} AS STRING) AS qty", f"CAST({_UNIT} AS STRING) AS base_price",
    ], None),
    "adjustments": ("events", [
        "event_id AS request_id", "CASE WHEN event_type = 'signup' THEN NULL ELSE user_id END AS product_id",
        "CAST(user_id % 6 AS INT) AS warehouse",
        "CASE event_type WHEN 'purchase' THEN CONCAT('-', CAST(CAST(FLOOR(value * 2) AS INT) AS STRING)) "
        "WHEN 'click' THEN CONCAT('-', CAST(CAST(FLOOR(value) AS INT) AS STRING)) "
        "ELSE CAST(CAST(FLOOR(value) AS INT) AS STRING) END AS adjustment",
        "CASE event_type WHEN 'error' THEN 'Damaged on shelf' ELSE '' END AS reason", "ts AS requested_at",
    ], None),
    "new_returns": ("lineitem", [
        f"{_LINE_ID} AS request_id", "l_orderkey AS order_id", "l_suppkey AS customer_id", "l_partkey AS product_id",
        "CASE WHEN l_linenumber = 7 THEN NULL ELSE CAST(l_suppkey % 5 AS INT) END AS warehouse_code",
        f"CASE WHEN l_linenumber = 6 THEN '0' ELSE CAST({_QTY} AS STRING) END AS qty",
        "CAST(NULL AS STRING) AS reason", "CASE WHEN l_linenumber = 1 THEN 'write_off' ELSE '' END AS action",
        "l_shipdate AS requested_at",
    ], None),
    "return_actions": ("lineitem", [
        f"CONCAT('p-', {_LINE_ID}) AS request_id", f"{_LINE_ID} AS return_id", "l_shipdate AS requested_at",
    ], None),
    "counts": ("region", [
        "r_regionkey + 100 AS request_id", "r_regionkey AS warehouse_code",
        "CASE r_regionkey WHEN 1 THEN 'brand' WHEN 2 THEN 'zone' WHEN 3 THEN 'random' ELSE '' END AS scope",
        "CASE r_regionkey WHEN 1 THEN 'Brand#1' WHEN 2 THEN 'A-0' END AS scope_filter", "'' AS notes",
        "CAST(NULL AS DATE) AS planned_date", f"{_NOW} AS requested_at",
    ], None),
    "count_actions": ("region", [
        "r_regionkey AS request_id", "r_regionkey AS count_id", f"{_NOW} AS requested_at",
    ], None),
    "recordings": ("warehouse_stock", [
        "id AS request_id", "CASE WHEN warehouse = 4 THEN -1 ELSE id END AS line_id",
        "CASE product_id % 5 WHEN 0 THEN 'none' WHEN 1 THEN '-4' WHEN 2 THEN CONCAT(CAST(qty_on_hand AS STRING), ' pcs') "
        "ELSE CAST(qty_on_hand + 1 AS STRING) END AS counted_qty", "'' AS notes", f"{_NOW} AS requested_at",
    ], None),
    "new_invoices": ("orders", [
        "o_orderkey + 100000000 AS request_id",
        "CASE o_orderpriority WHEN '4-NOT SPECIFIED' THEN CONCAT('Shop ', CAST(o_custkey % 100 AS STRING)) ELSE "
        "CONCAT(' Customer#', LPAD(CAST(o_custkey AS STRING), 9, '0')) END AS customer_name",
        "CASE o_orderstatus WHEN 'O' THEN '9' ELSE CAST(o_orderkey % 5 AS STRING) END AS customer_region",
        "CASE o_orderpriority WHEN '5-LOW' THEN CONCAT('ORD-', CAST(EXTRACT(YEAR FROM o_orderdate) AS STRING), '-', "
        "CAST(o_orderkey AS STRING)) WHEN '4-NOT SPECIFIED' THEN CONCAT('N-', CAST(o_orderkey % 40 AS STRING)) "
        "WHEN '1-URGENT' THEN '' ELSE CONCAT('N-', CAST(o_orderkey AS STRING)) END AS order_number",
        "CAST(o_orderdate AS DATE) AS order_date", "CAST(NULL AS DATE) AS invoice_date", "'' AS source_filename",
        "o_orderdate AS requested_at",
    ], None),
    "new_invoice_lines": ("lineitem", [
        "l_orderkey + 100000000 AS request_id", f"{_LINE_ID} AS line_no",
        "CASE WHEN l_linenumber = 7 THEN 'unknown' ELSE CONCAT(' SKU-', CAST(l_partkey AS STRING)) END AS sku",
        "'Item' AS description", "CAST(NULL AS STRING) AS barcode", f"CAST({_UNIT} AS STRING) AS trade_price",
        f"CASE WHEN l_linenumber = 3 THEN CONCAT('-', CAST({_QTY} AS STRING)) ELSE CAST({_QTY} AS STRING) END AS quantity", f"CAST(CAST({_QTY} * {_UNIT} AS DECIMAL(12,2)) AS STRING) AS subtotal",
    ], None),
}

BASE = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
                "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}
_TIERS = [(5, 3), (10, 5), (25, 8)]


def fixture(spark: SparkSession, sf_dir: str) -> tuple[Tables, Tables]:
    """The library's tables and the job requests, derived lazily from the Parquet files in ``sf_dir``."""

    def base(name: str) -> DataFrame:
        return spark.read.schema(BASE[name]).parquet(f"{sf_dir}/{name}.parquet")

    def source(name: str) -> DataFrame:
        if name == "part_region":
            codes = base("region").select(F.sort_array(F.collect_list("r_regionkey"))).scalar()
            return base("part").select("p_partkey", F.explode(codes).alias("r_regionkey"))
        if name == "part_tier":
            tiers = F.array(*[F.struct(F.lit(q).alias("min_qty"), F.lit(d).alias("discount_pct")) for q, d in _TIERS])
            return base("part").select("p_partkey", "p_size", F.inline(tiers))
        if name == "customer_nation":
            return base("customer").join(base("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        return base(name) if name in BASE else view(name)

    def view(name: str, of=_VIEWS) -> DataFrame:
        origin, columns, condition = of[name]
        frame = source(origin)
        return (frame.where(condition) if condition else frame).selectExpr(*columns)

    views = {name: lambda name=name: view(name) for name in _VIEWS}
    asked = {f"req_{name}": lambda name=name: view(name, _REQUESTS) for name in _REQUESTS}
    return Tables(views), Tables(asked)


def project(name: str, source: DataFrame) -> DataFrame:
    """One table's or request table's columns over another source of the same base rows, e.g. a stream."""
    _, columns, condition = _VIEWS.get(name) or _REQUESTS[name]
    return (source.where(condition) if condition else source).selectExpr(*columns)


def _duck_views() -> dict[str, str]:
    views = {
        "src_part_region": "SELECT * FROM part CROSS JOIN region",
        "src_part_tier": "SELECT * FROM part CROSS JOIN (VALUES "
        + ", ".join(f"({q}, {d})" for q, d in _TIERS) + ") t(min_qty, discount_pct)",
        "src_customer_nation": "SELECT * FROM customer JOIN nation ON c_nationkey = n_nationkey",
    }
    named = [(f"wms_{n}", v) for n, v in _VIEWS.items()] + [(f"req_{n}", v) for n, v in _REQUESTS.items()]
    for name, (source, columns, condition) in named:
        if source in ("part_region", "part_tier", "customer_nation"):
            source = f"src_{source}"
        elif source == "warehouse_stock":
            source = "wms_warehouse_stock"
        text = f"SELECT {', '.join(columns)} FROM {source}" + (f" WHERE {condition}" if condition else "")
        views[name] = text.replace("TIMESTAMP_NTZ", "TIMESTAMP")
    return views


DUCK_VIEWS = _duck_views()


def with_views(sql: str, extra: dict[str, str] | None = None) -> str:
    """Prefix a query with the view definitions it uses, in dependency order."""
    known = {**DUCK_VIEWS, **(extra or {})}
    ordered: list[str] = []

    def need(text: str) -> None:
        for name in sorted(set(re.findall(r"\b(?:wms|src|req)_\w+", text))):
            if name in known and name not in ordered:
                need(known[name])
                ordered.append(name)

    need(sql)
    head = ", ".join(f"{name} AS ({known[name]})" for name in ordered)
    body = sql.strip()
    if not head:
        return body
    if re.match(r"(?i)with\s+recursive\b", body):
        return f"WITH RECURSIVE {head}, {body[len('with recursive'):].lstrip()}"
    if re.match(r"(?i)with\b", body):
        return f"WITH {head}, {body[4:].lstrip()}"
    return f"WITH {head} {body}"
