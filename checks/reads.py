"""Read queries with the SQL that must give the same rows. Arrays are compared as text."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from stockline import analytics as a
from stockline.sources.layout import write_together
from stockline.sources.staging import staging_root
from stockline.tables import Tables

W = (0, 1, 2, 3, 4)


def text(array: str, *fields: str) -> Column:
    """Render an array of structs as ``a:b,a:b``."""
    return F.array_join(
        F.transform(array, lambda x: F.concat_ws(":", *[x[f].cast("string") for f in fields])), ","
    )


def order_request_lines(t: Tables) -> DataFrame:
    """Every order as a priced request: its lines at the product's selling price."""
    orders = t.orders.select(F.col("id").alias("request_id"), "customer_id", "warehouse_code", "created_at")
    lines = t.order_lines.select(
        F.col("id").alias("line_id"), F.col("order_id").alias("request_id"), "product_id",
        F.col("qty_ordered").alias("qty"),
    )
    products = t.products.select(
        F.col("id").alias("product_id"), F.col("sell_price_gbp").alias("base_price_gbp")
    )
    return lines.join(orders, "request_id").join(products, "product_id")


def purchases_together(t: Tables) -> Tables:
    """Purchase orders and their lines bucketed by the order, as many buckets as a shuffle has partitions."""
    spark = t.orders.sparkSession
    name = f"po_{uuid.uuid4().hex}"
    headers, lines = write_together(
        t.purchase_orders, t.po_lines, f"{staging_root(spark)}/{name}", name, line_key="po_id", buckets=int(spark.conf.get("spark.sql.shuffle.partitions")))
    return t.replace(purchase_orders=headers, po_lines=lines)


def region_distances(t: Tables) -> DataFrame:
    """0 at home, 1 to the next region number, else the default of 2."""
    codes = t.warehouses
    home = codes.select(F.col("code").alias("region"), F.col("code").alias("warehouse"), F.lit(0).alias("distance"))
    near = codes.select(
        F.col("code").alias("region"), ((F.col("code") + 1) % 5).alias("warehouse"), F.lit(1).alias("distance")
    )
    return home.unionByName(near)


REQ_ORDERS = (
    "SELECT l.id AS line_id, o.id AS request_id, o.customer_id, o.warehouse_code, o.created_at, l.product_id, "
    "l.qty_ordered AS qty, p.sell_price_gbp AS base_price_gbp FROM wms_order_lines l "
    "JOIN wms_orders o ON o.id = l.order_id JOIN wms_products p ON p.id = l.product_id"
)
REQ_TIERS = (
    "SELECT product_id, min_qty, MAX(discount_pct) AS discount_pct FROM wms_price_tiers GROUP BY ALL"
)
# Discount of the greatest break reached / of the best break reached, with the customer's own.
REQ_PRICED = (
    "SELECT r.*, GREATEST(c.default_discount_pct, COALESCE((SELECT ARG_MAX(discount_pct, min_qty) FROM req_tiers t "
    "WHERE t.product_id = r.product_id AND t.min_qty <= r.qty), 0))::DECIMAL(5,2) AS discount_pct, "
    "GREATEST(c.default_discount_pct, COALESCE((SELECT MAX(discount_pct) FROM req_tiers t "
    "WHERE t.product_id = r.product_id AND t.min_qty <= r.qty), 0))::DECIMAL(5,2) AS best_pct "
    "FROM req_orders r JOIN wms_customers c ON c.id = r.customer_id"
)
REQ_EXACT = (
    "SELECT line_id, request_id, customer_id, warehouse_code, created_at, product_id, qty, base_price_gbp, discount_pct, "
    "best_pct, ROUND(base_price_gbp * (100 - discount_pct) / 100, 2) AS x FROM req_priced"
)


def half_up(amount: str, pct: str) -> str:
    """Discounted price rounded half-up, in whole-number arithmetic."""
    return (
        f"CAST(((CAST({amount} * 100 AS BIGINT) * CAST((100 - {pct}) * 100 AS BIGINT) + 5000) // 10000) * 0.01 "
        "AS DECIMAL(12,2))"
    )


def margin(sell: str, cost: str) -> str:
    s, d = f"CAST({sell} * 100 AS BIGINT)", f"CAST(({sell} - {cost}) * 100 AS BIGINT)"
    return f"CAST(((2000 * {d} + {s}) // (2 * {s})) * 0.1 AS DECIMAL(12,1))"


REQ_DEMAND = (
    "SELECT l.product_id, o.warehouse_code AS warehouse, SUM(l.qty_ordered) AS units_ordered, "
    "CAST(SUM(l.qty_ordered) AS DOUBLE) / GREATEST(CAST(DATE_DIFF('microsecond', MIN(o.created_at), "
    "(SELECT MAX(created_at) FROM wms_orders)) AS DOUBLE) / 86400000000.0, 1.0) AS daily_rate "
    "FROM wms_order_lines l JOIN wms_orders o ON o.id = l.order_id GROUP BY ALL"
)
REQ_STOCKOUT = (
    "SELECT ws.warehouse, ws.product_id, ws.qty_on_hand, ws.reorder_point, p.name, p.sku, p.brand, p.cost_price_gbp, "
    "s.name AS supplier_name, s.lead_time_days, CAST(COALESCE(d.daily_rate, 0) AS DECIMAL(18,6)) AS burn_rate_per_day, "
    "CAST(ROUND(CAST(ws.qty_on_hand / d.daily_rate AS DECIMAL(20,6)), 1) AS DECIMAL(18,1)) AS days_until_stockout, "
    "CASE WHEN COALESCE(d.daily_rate, 0) <= 0 THEN 'no_demand' WHEN ws.qty_on_hand / d.daily_rate < 14 THEN 'critical' "
    "WHEN ws.qty_on_hand / d.daily_rate < 30 THEN 'warning' ELSE 'healthy' END AS severity "
    "FROM wms_warehouse_stock ws JOIN wms_products p ON p.id = ws.product_id "
    "LEFT JOIN wms_suppliers s ON s.id = p.supplier_id LEFT JOIN req_demand d ON d.product_id = ws.product_id "
    "AND d.warehouse = ws.warehouse WHERE ws.qty_on_hand > 0"
)
REQ_REORDER = (
    "SELECT ws.warehouse, p.supplier_id, s.name AS supplier_name, s.lead_time_days, s.currency AS supplier_currency, "
    "ws.product_id, p.name, p.sku, p.brand, ws.qty_on_hand AS current_stock, ws.reorder_point, ws.max_stock, p.case_pack, "
    "d.daily_rate, CAST(COALESCE(d.daily_rate, 0) AS DECIMAL(18,6)) AS burn_rate_per_day, "
    "CAST(ROUND(CAST(ws.qty_on_hand / d.daily_rate AS DECIMAL(20,6)), 1) AS DECIMAL(18,1)) AS days_until_stockout, "
    "p.cost_price_gbp FROM wms_warehouse_stock ws JOIN wms_products p ON p.id = ws.product_id "
    "LEFT JOIN wms_suppliers s ON s.id = p.supplier_id LEFT JOIN req_demand d ON d.product_id = ws.product_id "
    "AND d.warehouse = ws.warehouse WHERE p.supplier_id IS NOT NULL AND ws.qty_on_hand > 0 AND "
    "((ws.qty_on_hand <= ws.reorder_point AND ws.reorder_point > 0) OR (COALESCE(d.daily_rate, 0) > 0 "
    "AND ws.qty_on_hand / d.daily_rate < COALESCE(s.lead_time_days, 14)))"
)


def reorder_sql(qty: str) -> str:
    return (
        "SELECT warehouse, supplier_id, supplier_name, lead_time_days, supplier_currency, product_id, name, sku, brand, "
        f"current_stock, reorder_point, burn_rate_per_day, days_until_stockout, CAST({qty} AS INT) AS recommended_qty, "
        f"cost_price_gbp, CAST(CAST({qty} AS INT) * cost_price_gbp AS DECIMAL(18,2)) AS estimated_cost_gbp, "
        "CASE WHEN days_until_stockout < 7 THEN 'critical' WHEN days_until_stockout < 14 THEN 'urgent' "
        "WHEN current_stock <= reorder_point THEN 'reorder' ELSE 'preventive' END AS urgency FROM req_reorder"
    )


CASE1 = "COALESCE(NULLIF(case_pack, 0), 1)"
FILL_UP = f"GREATEST(max_stock - current_stock, {CASE1})"
BY_DEMAND = (
    f"GREATEST(CEIL((COALESCE(daily_rate, 0.0) * (COALESCE(lead_time_days, 14) + 14) - current_stock) / {CASE1}), 1) "
    f"* {CASE1}"
)
REQ_RECOMMENDED = reorder_sql(FILL_UP)
REQ_ALERTS = (
    "SELECT ws.warehouse, ws.qty_on_hand, ws.qty_reserved, ws.qty_on_hand - ws.qty_reserved AS qty_available, "
    "ws.reorder_point, p.id AS product_id, p.name, p.sku, p.brand, p.cost_price_gbp, p.case_pack, s.name AS supplier_name, "
    "s.lead_time_days, CASE WHEN ws.qty_on_hand = 0 THEN 'out_of_stock' ELSE 'low_stock' END AS alert_type, "
    "(SELECT STRING_AGG(CONCAT(x.warehouse, ':', x.qty_on_hand - x.qty_reserved), ',' ORDER BY x.warehouse) "
    "FROM wms_warehouse_stock x WHERE x.product_id = p.id AND x.warehouse <> ws.warehouse "
    "AND x.qty_on_hand - x.qty_reserved > x.reorder_point) AS surplus_elsewhere, "
    "(SELECT MAX(x.qty_on_hand - x.qty_reserved) FROM wms_warehouse_stock x WHERE x.product_id = p.id "
    "AND x.warehouse <> ws.warehouse AND x.qty_on_hand - x.qty_reserved > x.reorder_point) AS most, "
    "(SELECT ARG_MIN(x.warehouse, (-(x.qty_on_hand - x.qty_reserved), x.warehouse)) FROM wms_warehouse_stock x "
    "WHERE x.product_id = p.id AND x.warehouse <> ws.warehouse "
    "AND x.qty_on_hand - x.qty_reserved > x.reorder_point) AS best "
    "FROM wms_warehouse_stock ws JOIN wms_products p ON p.id = ws.product_id "
    "LEFT JOIN wms_suppliers s ON s.id = p.supplier_id WHERE ws.qty_on_hand <= ws.reorder_point"
)


def _comparison_columns() -> str:
    cols = []
    for w in W:
        cols += [
            f"COALESCE(MAX(CASE WHEN warehouse = {w} THEN qty_on_hand - qty_reserved END), 0) AS available_{w}",
            f"COALESCE(MAX(CASE WHEN warehouse = {w} THEN qty_on_hand END), 0) AS on_hand_{w}",
            f"COALESCE(MAX(CASE WHEN warehouse = {w} THEN reorder_point END), 0) AS reorder_point_{w}",
        ]
    return ", ".join(cols)


def _status(w: int) -> str:
    return (
        f"CASE WHEN on_hand_{w} = 0 THEN 'out' WHEN reorder_point_{w} > 0 AND on_hand_{w} <= reorder_point_{w} "
        f"THEN 'low' ELSE 'ok' END"
    )


REQ_GRID = f"SELECT product_id, {_comparison_columns()} FROM wms_warehouse_stock GROUP BY product_id"
REQ_COMPARISON = (
    "SELECT g.*, p.name, p.sku, p.brand, " + ", ".join(f"{_status(w)} AS status_{w}" for w in W) + ", "
    + "CAST(" + " + ".join(f"available_{w}" for w in W) + " AS INT) AS total_available, "
    + "(" + " OR ".join(f"available_{w} = 0" for w in W) + ") AND ("
    + " OR ".join(f"available_{w} >= 20" for w in W) + ") AS imbalance, "
    + "CASE WHEN " + " OR ".join(f"on_hand_{w} = 0" for w in W) + " THEN 'out_of_stock' WHEN "
    + " OR ".join(f"{_status(w)} = 'low'" for w in W) + " THEN 'low_stock' ELSE 'healthy' END AS worst_status "
    + "FROM req_grid g JOIN wms_products p ON p.id = g.product_id"
)
REQ_KPI = (
    "SELECT w.code AS warehouse, w.name, w.currency, CAST(COALESCE(SUM(ws.qty_on_hand), 0) AS BIGINT) AS total_units, "
    "CAST(COALESCE(SUM(ws.qty_on_hand * p.cost_price_gbp), 0) AS DECIMAL(18,2)) AS stock_value_gbp, "
    "COUNT(*) FILTER (WHERE ws.qty_on_hand <= ws.reorder_point) AS low_stock_items, "
    "COUNT(*) FILTER (WHERE ws.qty_on_hand = 0) AS out_of_stock_items FROM wms_warehouses w "
    "LEFT JOIN wms_warehouse_stock ws ON ws.warehouse = w.code LEFT JOIN wms_products p ON p.id = ws.product_id GROUP BY ALL"
)
REQ_REVENUE = (
    "SELECT l.product_id, SUM(l.qty_ordered * l.unit_price_gbp) AS revenue FROM wms_order_lines l "
    "JOIN wms_orders o ON o.id = l.order_id WHERE o.created_at >= (SELECT MAX(created_at) FROM wms_orders) "
    "- INTERVAL '90' DAY GROUP BY ALL"
)
REQ_ABC = (
    "SELECT id, name, sku, brand, CAST(rev AS DECIMAL(18,2)) AS revenue, CASE WHEN cum <= 0.8 THEN 'A' "
    "WHEN cum <= 0.95 THEN 'B' ELSE 'C' END AS abc_class FROM (SELECT p.id, p.name, p.sku, p.brand, "
    "COALESCE(r.revenue, 0) AS rev, CAST(SUM(COALESCE(r.revenue, 0)) OVER (ORDER BY COALESCE(r.revenue, 0) DESC) AS DOUBLE) "
    "/ CAST((SELECT COALESCE(SUM(revenue), 1) FROM req_revenue) AS DOUBLE) AS cum FROM wms_products p "
    "LEFT JOIN req_revenue r ON r.product_id = p.id)"
)
REQ_LEAD = (
    "SELECT po.supplier_id, s.name AS supplier_name, s.lead_time_days AS promised_days, COUNT(*) AS po_count, "
    "CAST(((20 * SUM(d) + COUNT(*)) // (2 * COUNT(*))) * 0.1 AS DECIMAL(10,1)) AS avg_actual_days, "
    "CAST(MIN(d) AS DECIMAL(10,1)) AS min_actual_days, CAST(MAX(d) AS DECIMAL(10,1)) AS max_actual_days "
    "FROM (SELECT *, CAST(EXTRACT(DAY FROM received_at - submitted_at) AS BIGINT) AS d FROM wms_purchase_orders) po "
    "JOIN wms_suppliers s ON s.id = po.supplier_id WHERE po.status = 'received' AND po.received_at > po.submitted_at "
    "GROUP BY ALL"
)
REQ_REVIEW = (
    "WITH free AS (SELECT product_id, warehouse, SUM(qty_on_hand) - SUM(qty_reserved) AS units FROM wms_warehouse_stock GROUP BY ALL), "
    "per_line AS (SELECT id AS line_id, (SELECT units FROM free WHERE free.product_id = line.product_id AND warehouse = "
    "(SELECT warehouse_code FROM wms_orders WHERE id = line.order_id)) AS units FROM wms_order_lines line) "
    "SELECT waiting.*, company_name, line_id, product_id, product_name, sku, IFNULL(qty_requested, qty_ordered) AS qty_requested, "
    "qty_ordered, unit_price_gbp, fulfilment_decision, qty_to_ship, qty_to_backorder, CAST(IFNULL(units, 0) AS INT) AS qty_available "
    "FROM per_line JOIN wms_order_lines line ON line.id = line_id SEMI JOIN (SELECT id FROM wms_orders WHERE requires_review) r "
    "ON r.id = line.order_id JOIN (SELECT id AS order_id, order_ref, customer_name, warehouse_code, currency, total_gbp, created_at, "
    "notes FROM wms_orders) waiting USING (order_id) LEFT JOIN (SELECT o.id AS order_id, company_name FROM wms_orders o "
    "JOIN wms_customers c ON o.customer_id = c.id) buyer USING (order_id)"
)
REQ_SKUS = (
    "SELECT sku, description, CAST(SUM(quantity) AS BIGINT) AS total_units, "
    "CAST(SUM(subtotal_gbp) AS DECIMAL(18,2)) AS total_revenue, COUNT(DISTINCT invoice_id) AS invoice_count "
    "FROM wms_invoice_lines GROUP BY ALL"
)

SHARED = {
    "req_orders": REQ_ORDERS, "req_tiers": REQ_TIERS, "req_priced": REQ_PRICED, "req_demand": REQ_DEMAND,
    "req_stockout": REQ_STOCKOUT, "req_reorder": REQ_REORDER, "req_recommended": REQ_RECOMMENDED,
    "req_alerts": REQ_ALERTS, "req_grid": REQ_GRID, "req_comparison": REQ_COMPARISON, "req_kpi": REQ_KPI,
    "req_revenue": REQ_REVENUE, "req_abc": REQ_ABC, "req_lead": REQ_LEAD, "req_review": REQ_REVIEW,
    "req_skus": REQ_SKUS,
}

_STATUS = "CASE WHEN qty_on_hand = 0 THEN 'out_of_stock' WHEN qty_on_hand <= reorder_point THEN 'low' ELSE 'healthy' END"
_SEV = "CASE severity WHEN 'critical' THEN 1 WHEN 'warning' THEN 2 ELSE 3 END"
_STAGE = (
    "CASE o.fulfilment_status WHEN 'confirmed' THEN 1 WHEN 'picking' THEN 2 WHEN 'picked' THEN 3 WHEN 'packing' THEN 4 "
    "WHEN 'packed' THEN 5 WHEN 'shipped' THEN 6 ELSE 7 END"
)
_CATEGORY = (
    "CASE WHEN action IN ('stock_received','stock_shipped','stock_adjusted','stock_returned','stock_written_off') "
    "THEN 'stock' WHEN action IN ('stock_transferred_out','stock_transferred_in','transfer_created') THEN 'transfers' "
    "WHEN action LIKE 'order_%' THEN 'orders' WHEN action LIKE 'po_%' THEN 'po' WHEN action LIKE 'return_%' "
    "THEN 'returns' ELSE 'other' END"
)

Read = Callable[[Tables], DataFrame]

# key -> (query, SQL or None)
READS: dict[str, tuple[Read, str | None]] = {
    "warehouse_summary": (a.warehouse_summary, """
        SELECT w.code, w.name, w.currency, COUNT(p.id) AS total_products,
          CAST(COALESCE(SUM(ws.qty_on_hand), 0) AS BIGINT) AS total_units,
          CAST(COALESCE(SUM(ws.qty_on_hand * p.cost_price_gbp), 0) AS DECIMAL(18,2)) AS stock_value_gbp,
          COUNT(*) FILTER (WHERE ws.qty_on_hand <= ws.reorder_point) AS low_stock_count
        FROM wms_warehouses w LEFT JOIN wms_warehouse_stock ws ON ws.warehouse = w.code
        LEFT JOIN wms_products p ON p.id = ws.product_id GROUP BY ALL"""),
    "stock_status": (a.stock_status_list, f"""
        SELECT ws.id AS stock_id, ws.warehouse, qty_on_hand, qty_reserved, qty_on_hand - qty_reserved AS qty_available,
          reorder_point, max_stock, location, p.id AS product_id, name, sku, barcode, brand, cost_price_gbp,
          sell_price_gbp, case_pack, moq, {_STATUS} AS stock_status
        FROM wms_warehouse_stock ws JOIN wms_products p ON p.id = ws.product_id"""),
    "stock_status_search": (lambda t: a.stock_status_list(t, 1, "r_D", "low"), f"""
        SELECT ws.id AS stock_id, ws.warehouse, qty_on_hand, qty_reserved, qty_on_hand - qty_reserved AS qty_available,
          reorder_point, max_stock, location, p.id AS product_id, name, sku, barcode, brand, cost_price_gbp,
          sell_price_gbp, case_pack, moq, {_STATUS} AS stock_status
        FROM wms_warehouse_stock ws JOIN wms_products p ON p.id = ws.product_id
        WHERE ws.warehouse = 1 AND (name ILIKE '%r_D%' OR sku ILIKE '%r_D%' OR brand ILIKE '%r_D%')
          AND qty_on_hand <= reorder_point AND qty_on_hand > 0"""),
    "inventory_nested": (lambda t: a.inventory_nested(t).withColumn(
        "warehouse_stock", text("warehouse_stock", "warehouse", "qty_on_hand", "qty_reserved", "reorder_point")), """
        SELECT p.id, p.name, p.sku, p.barcode, p.brand, p.cost_price_gbp, p.sell_price_gbp,
          COALESCE(STRING_AGG(CONCAT(ws.warehouse, ':', ws.qty_on_hand, ':', ws.qty_reserved, ':', ws.reorder_point), ','
            ORDER BY ws.warehouse), '') AS warehouse_stock
        FROM wms_products p LEFT JOIN wms_warehouse_stock ws ON ws.product_id = p.id GROUP BY ALL"""),
    "supplier_product_counts": (a.supplier_product_counts, """
        SELECT s.id, s.name, s.contact_email, s.lead_time_days, s.currency, s.notes,
          (SELECT COUNT(*) FROM wms_products p WHERE p.supplier_id = s.id) AS product_count FROM wms_suppliers s"""),
    "po_summary": (a.po_summary, """
        SELECT po.id, po.po_ref, po.supplier_id, s.name AS supplier_name, po.warehouse_code, po.status, po.created_at,
          po.submitted_at, po.received_at, po.notes, po.updated_at, COUNT(l.id) AS line_count,
          CAST(COALESCE(SUM(l.qty_ordered), 0) AS BIGINT) AS total_ordered,
          CAST(COALESCE(SUM(l.qty_received), 0) AS BIGINT) AS total_received,
          CAST(COALESCE(SUM(l.qty_ordered * l.unit_cost_gbp), 0) AS DECIMAL(18,2)) AS total_cost_gbp
        FROM wms_purchase_orders po LEFT JOIN wms_suppliers s ON s.id = po.supplier_id
        LEFT JOIN wms_po_lines l ON l.po_id = po.id GROUP BY ALL"""),
    "po_detail": (a.po_detail, """
        SELECT po.* RENAME (id AS po_id), s.name AS supplier_name, l.id AS line_id,
          l.product_id, p.name AS product_name, p.sku, p.brand, l.qty_ordered, l.qty_received, l.unit_cost_gbp
        FROM wms_purchase_orders po LEFT JOIN wms_po_lines l ON po.id = l.po_id
        LEFT JOIN wms_suppliers s ON s.id = po.supplier_id LEFT JOIN wms_products p ON p.id = l.product_id"""),
    "transfer_summary": (a.transfer_summary, """
        SELECT t.*, COUNT(l.id) AS line_count, CAST(COALESCE(SUM(l.qty), 0) AS BIGINT) AS total_units
        FROM wms_stock_transfers t LEFT JOIN wms_transfer_lines l ON l.transfer_id = t.id GROUP BY ALL"""),
    "transfer_detail": (a.transfer_detail, """
        SELECT t.* RENAME (id AS transfer_id), l.id AS line_id, l.product_id, p.name AS product_name, p.sku, p.brand, l.qty
        FROM wms_stock_transfers t LEFT JOIN wms_transfer_lines l ON t.id = l.transfer_id
        LEFT JOIN wms_products p ON p.id = l.product_id"""),
    "fulfilment_stages": (a.fulfilment_stages, f"""
        SELECT o.id, o.order_ref, o.customer_name, o.status, o.fulfilment_status, o.warehouse_code, o.currency,
          o.total_gbp, o.created_at, COUNT(l.id) AS line_count,
          CAST(COALESCE(SUM(l.qty_ordered), 0) AS BIGINT) AS total_units, {_STAGE} AS stage_rank
        FROM wms_orders o LEFT JOIN wms_order_lines l ON l.order_id = o.id GROUP BY ALL"""),
    "price_tiers_by_product": (lambda t: a.price_tiers_by_product(t).withColumn(
        "tiers", text("tiers", "min_qty", "discount_pct")), """
        SELECT p.id AS product_id, p.name, p.sku, p.brand, p.sell_price_gbp, p.moq,
          STRING_AGG(CONCAT(pt.min_qty, ':', pt.discount_pct), ',' ORDER BY pt.min_qty) AS tiers
        FROM wms_products p JOIN wms_price_tiers pt ON pt.product_id = p.id GROUP BY ALL"""),
    "review_queue": (a.review_queue, "SELECT * FROM req_review"),
    "customer_spend": (a.customer_spend, """
        SELECT c.*, COUNT(o.id) AS order_count,
          CAST(COALESCE(SUM(o.total_gbp), 0) AS DECIMAL(18,2)) AS total_spend_gbp,
          CASE WHEN c.credit_limit_gbp > 0 THEN CAST(c.credit_limit_gbp - c.credit_used_gbp AS DECIMAL(18,2)) END
            AS credit_available_gbp
        FROM wms_customers c LEFT JOIN wms_orders o ON o.customer_id = c.id GROUP BY ALL"""),
    "audit_search": (lambda t: a.audit_search(t, 3), """
        SELECT al.*, p.name AS product_name, p.sku AS product_sku FROM wms_audit_log al
        LEFT JOIN wms_products p ON p.id = al.product_id WHERE al.warehouse_code = 3
        ORDER BY al.created_at DESC, al.id DESC LIMIT 100"""),
    "low_stock_alerts": (lambda t: a.low_stock_alerts(t).withColumn(
        "surplus_elsewhere", F.when(F.col("surplus_elsewhere").isNotNull(),
                                    text("surplus_elsewhere", "warehouse", "qty_available"))),
        "SELECT * EXCLUDE (most, best) FROM req_alerts"),
    "stock_by_brand": (a.stock_by_brand, """
        SELECT p.brand, CAST(SUM(ws.qty_on_hand) AS BIGINT) AS units,
          CAST(SUM(ws.qty_on_hand * p.cost_price_gbp) AS DECIMAL(18,2)) AS value
        FROM wms_warehouse_stock ws JOIN wms_products p ON p.id = ws.product_id GROUP BY ALL"""),
    "stock_by_warehouse": (a.stock_by_warehouse, """
        SELECT w.code AS warehouse, w.name, CAST(SUM(ws.qty_on_hand) AS BIGINT) AS units,
          CAST(SUM(ws.qty_on_hand * p.cost_price_gbp) AS DECIMAL(18,2)) AS value
        FROM wms_warehouses w LEFT JOIN wms_warehouse_stock ws ON ws.warehouse = w.code
        LEFT JOIN wms_products p ON p.id = ws.product_id GROUP BY ALL"""),
    "orders_by_month": (a.orders_by_month, """
        SELECT STRFTIME(created_at, '%Y-%m') AS month, COUNT(*) AS order_count,
          CAST(SUM(total_gbp) AS DECIMAL(18,2)) AS revenue FROM wms_orders
        WHERE created_at >= (SELECT MAX(created_at) FROM wms_orders) - INTERVAL '6' MONTH GROUP BY ALL"""),
    "top_products": (a.top_products, """
        SELECT p.id, p.name, p.sku, CAST(COALESCE(SUM(l.qty_ordered), 0) AS BIGINT) AS total_ordered
        FROM wms_products p LEFT JOIN wms_order_lines l ON l.product_id = p.id GROUP BY ALL
        ORDER BY total_ordered DESC, p.id LIMIT 10"""),
    "kpi_warehouses": (a.kpi_warehouses, "SELECT * FROM req_kpi"),
    "kpi_orders": (a.kpi_orders, """
        SELECT COUNT(*) FILTER (WHERE fulfilment_status = 'confirmed') AS pending,
          COUNT(*) FILTER (WHERE fulfilment_status IN ('picking','picked','packing','packed')) AS in_progress,
          COUNT(*) FILTER (WHERE fulfilment_status = 'shipped') AS shipped,
          CAST(COALESCE(SUM(total_gbp) FILTER (WHERE fulfilment_status = 'shipped'), 0) AS DECIMAL(18,2)) AS revenue_shipped
        FROM wms_orders"""),
    "kpi_transfers": (a.kpi_transfers, """
        SELECT COUNT(*) FILTER (WHERE t.status = 'in_transit') AS in_transit,
          COUNT(*) FILTER (WHERE t.status = 'requested') AS pending,
          CAST(COALESCE(SUM(l.qty) FILTER (WHERE t.status = 'in_transit'), 0) AS BIGINT) AS units_in_transit
        FROM wms_stock_transfers t LEFT JOIN wms_transfer_lines l ON l.transfer_id = t.id"""),
    "kpi_transfers_distinct": (a.kpi_transfers_distinct, """
        SELECT COUNT(DISTINCT t.id) FILTER (WHERE t.status = 'in_transit') AS in_transit,
          COUNT(DISTINCT t.id) FILTER (WHERE t.status = 'requested') AS pending,
          CAST(COALESCE(SUM(l.qty) FILTER (WHERE t.status = 'in_transit'), 0) AS BIGINT) AS units_in_transit
        FROM wms_stock_transfers t LEFT JOIN wms_transfer_lines l ON l.transfer_id = t.id"""),
    "low_stock_count": (a.low_stock_count,
        "SELECT COUNT(*) AS total_alerts FROM wms_warehouse_stock WHERE qty_on_hand <= reorder_point"),
    "product_list": (lambda t: a.product_list(t, warehouse=2), """
        SELECT p.id, p.name, p.sku, p.brand, p.cost_price_gbp, p.sell_price_gbp, p.case_pack, p.supplier_id,
          s.name AS supplier_name, ws.qty_on_hand, ws.qty_on_hand - ws.qty_reserved AS qty_available
        FROM wms_products p LEFT JOIN wms_suppliers s ON s.id = p.supplier_id
        LEFT JOIN wms_warehouse_stock ws ON ws.product_id = p.id AND ws.warehouse = 2"""),
    "price_history": (a.price_history, """
        SELECT ph.*, p.name AS product_name, p.sku FROM wms_price_history ph JOIN wms_products p ON p.id = ph.product_id"""),
    "price_trends": (a.price_trends, """
        SELECT product_id, field, old_value, new_value, changed_at, CASE WHEN new_value > old_value THEN 'up'
          WHEN new_value < old_value THEN 'down' ELSE 'flat' END AS trend
        FROM wms_price_history WHERE field = 'buy_cost'
        QUALIFY ROW_NUMBER() OVER (PARTITION BY product_id ORDER BY changed_at DESC, id DESC) = 1"""),
    "returns_list": (a.returns_list, """
        SELECT r.id, r.rma_ref, r.order_id, o.order_ref, r.customer_id, c.company_name AS customer_name, r.product_id,
          p.name AS product_name, p.sku, p.brand, r.warehouse_code, r.qty, r.reason, r.reason_code, r.action, r.status,
          r.created_at FROM wms_returns r LEFT JOIN wms_products p ON p.id = r.product_id
        LEFT JOIN wms_orders o ON o.id = r.order_id LEFT JOIN wms_customers c ON c.id = r.customer_id"""),
    "packing_slip": (a.packing_slip, """
        SELECT o.* RENAME (id AS order_id, fulfilment_status AS order_fulfilment_status), c.company_name, c.billing_address,
          c.email, l.* EXCLUDE (order_id) RENAME (id AS line_id), p.brand
        FROM wms_orders o LEFT JOIN wms_order_lines l ON l.order_id = o.id
        LEFT JOIN wms_customers c ON c.id = o.customer_id LEFT JOIN wms_products p ON p.id = l.product_id"""),
    "stock_valuation": (a.stock_valuation, """
        WITH worth AS (SELECT warehouse, brand, qty_on_hand AS units, units * cost_price_gbp AS cost, units * sell_price_gbp AS retail
          FROM wms_products AS product, wms_warehouse_stock AS held WHERE product.id = held.product_id AND units > 0),
        levels AS (
          SELECT warehouse, brand, 0 AS is_total, COUNT(*) AS n, SUM(units) AS u, SUM(cost) AS c, SUM(retail) AS r FROM worth GROUP BY warehouse, brand
          UNION ALL SELECT warehouse, NULL, 1, COUNT(*), SUM(units), SUM(cost), SUM(retail) FROM worth GROUP BY warehouse)
        SELECT warehouse, name AS warehouse_name, currency, brand, is_total, n AS sku_count, CAST(u AS BIGINT) AS total_units,
          CAST(c AS DECIMAL(18,2)) AS cost_value, CAST(r AS DECIMAL(18,2)) AS retail_value
        FROM levels JOIN wms_warehouses ON code = warehouse"""),
    "demand_velocity": (lambda t: a.demand_velocity(t).withColumn(
        "stock_by_warehouse", text("stock_by_warehouse", "warehouse", "qty")), """
        SELECT p.id, p.name, p.sku, p.brand, p.cost_price_gbp, p.sell_price_gbp,
          CAST(COALESCE(d.q, 0) AS BIGINT) AS total_ordered, COALESCE(d.n, 0) AS order_count,
          CAST(COALESCE(d.r, 0) AS DECIMAL(18,2)) AS revenue,
          CASE WHEN COALESCE(d.q, 0) = 0 THEN 'dead_stock' WHEN d.q < 5 THEN 'slow_mover' WHEN d.q < 20 THEN 'steady'
            ELSE 'fast_mover' END AS velocity,
          (SELECT STRING_AGG(CONCAT(ws.warehouse, ':', ws.qty_on_hand), ',' ORDER BY ws.warehouse)
            FROM wms_warehouse_stock ws WHERE ws.product_id = p.id) AS stock_by_warehouse
        FROM wms_products p LEFT JOIN (SELECT product_id, SUM(qty_ordered) AS q, COUNT(DISTINCT order_id) AS n,
          SUM(qty_ordered * unit_price_gbp) AS r FROM wms_order_lines GROUP BY ALL) d ON d.product_id = p.id"""),
    "multi_currency_pricing": (a.multi_currency_pricing, f"""
        SELECT id, name, sku, brand, cost_price_gbp, sell_price_gbp,
          CAST(cost_price_gbp * 1.34 AS DECIMAL(18,4)) AS cost_usd, CAST(sell_price_gbp * 1.34 AS DECIMAL(18,4)) AS sell_usd,
          CAST(cost_price_gbp * 1.17 AS DECIMAL(18,4)) AS cost_eur, CAST(sell_price_gbp * 1.17 AS DECIMAL(18,4)) AS sell_eur,
          {margin('sell_price_gbp', 'cost_price_gbp')} AS margin_pct FROM wms_products"""),
    "customer_orders": (a.customer_orders, """
        SELECT o.customer_id, o.id, o.order_ref, o.status, o.currency, o.total_gbp, o.created_at,
          CAST(COALESCE(SUM(l.qty_ordered), 0) AS BIGINT) AS total_units, COUNT(l.id) AS line_count
        FROM wms_orders o LEFT JOIN wms_order_lines l ON l.order_id = o.id GROUP BY ALL"""),
    "backorder_list": (a.backorder_list, """
        SELECT il.id AS line_id, il.invoice_id, il.sku, il.description, il.quantity, il.qty_fulfilled, il.qty_backordered,
          il.fulfilment_status, il.trade_price_gbp, il.created_at AS line_created_at, i.customer_id, i.order_number,
          i.invoice_date, c.company_name, c.region, CAST(COALESCE(s.spend, 0) AS DECIMAL(18,2)) AS customer_total_spend
        FROM wms_invoice_lines il JOIN wms_invoices i ON i.id = il.invoice_id
        LEFT JOIN wms_customers c ON c.id = i.customer_id LEFT JOIN (SELECT customer_id, SUM(total_value_gbp) AS spend
          FROM wms_invoices GROUP BY ALL) s ON s.customer_id = c.id
        WHERE il.fulfilment_status IN ('backordered', 'partial')"""),
    "invoice_totals": (a.invoice_totals, """
        SELECT COUNT(*) AS total_invoices, CAST(COALESCE(SUM(total_value_gbp), 0) AS DECIMAL(18,2)) AS total_revenue,
          CAST(COALESCE(SUM(total_units), 0) AS BIGINT) AS total_units, MIN(invoice_date) AS earliest_date,
          MAX(invoice_date) AS latest_date FROM wms_invoices"""),
    "top_invoice_skus": (a.top_invoice_skus,
        "SELECT * FROM req_skus ORDER BY total_units DESC, sku, description LIMIT 10"),
    "bottom_invoice_skus": (a.bottom_invoice_skus,
        "SELECT * FROM req_skus ORDER BY total_units, sku, description LIMIT 10"),
    "invoice_revenue_by_month": (a.invoice_revenue_by_month, """
        SELECT STRFTIME(invoice_date, '%Y-%m') AS month, CAST(SUM(total_value_gbp) AS DECIMAL(18,2)) AS revenue,
          CAST(SUM(total_units) AS BIGINT) AS units, COUNT(*) AS invoice_count FROM wms_invoices GROUP BY ALL"""),
    "customer_invoice_breakdown": (a.customer_invoice_breakdown, """
        SELECT c.id AS customer_id, c.company_name, c.region, COUNT(*) AS invoice_count,
          CAST(SUM(i.total_value_gbp) AS DECIMAL(18,2)) AS total_revenue,
          CAST(SUM(i.total_units) AS BIGINT) AS total_units
        FROM wms_customers c JOIN wms_invoices i ON i.customer_id = c.id GROUP BY ALL"""),
    "warehouse_mismatch": (lambda t: a.warehouse_mismatch(t, W), """
        WITH in_region AS (SELECT sku, warehouse AS customer_region, SUM(qty_on_hand) AS units
          FROM wms_warehouse_stock s, wms_products product WHERE product.id = s.product_id GROUP BY ALL),
        sold AS (SELECT sku, description, (SELECT region FROM wms_customers WHERE id = i.customer_id) AS customer_region
          FROM wms_invoices i, wms_invoice_lines line WHERE line.invoice_id = i.id GROUP BY ALL)
        SELECT sku, description, customer_region, 0 AS region_stock FROM sold
        ANTI JOIN (SELECT * FROM in_region WHERE units <> 0) stocked USING (sku, customer_region) WHERE customer_region IS NOT NULL"""),
    "stockout_predictions": (a.stockout_predictions, "SELECT * FROM req_stockout"),
    "route_order": (lambda t: a.route_order(t, order_request_lines(t), region_distances(t)).withColumns({
        "factors": text("factors", "factor", "points"), "warnings": F.array_join("warnings", "; ")}), """
        WITH n AS (SELECT request_id, customer_id, COUNT(*) AS lines FROM req_orders GROUP BY ALL),
        c AS (SELECT r.request_id, ws.warehouse, COUNT(*) FILTER (WHERE ws.qty_on_hand - ws.qty_reserved >=
            CASE WHEN r.qty = 0 THEN 1 ELSE r.qty END) AS covered
          FROM req_orders r JOIN wms_warehouse_stock ws ON ws.product_id = r.product_id GROUP BY ALL),
        s AS (SELECT n.request_id, n.customer_id, cu.region, w.code AS warehouse, w.name AS warehouse_name,
            (SELECT MAX(code) FROM wms_warehouses WHERE code = cu.region) AS preferred_warehouse, COALESCE(c.covered, 0) = n.lines AS ok,
            CASE WHEN w.code = cu.region THEN 0 WHEN w.code = (cu.region + 1) % 5 THEN 1 ELSE 2 END AS dist
          FROM n JOIN wms_customers cu ON cu.id = n.customer_id CROSS JOIN wms_warehouses w
          LEFT JOIN c ON c.request_id = n.request_id AND c.warehouse = w.code),
        z AS (SELECT *, 50 + CASE WHEN ok THEN 30 ELSE -20 END + CASE dist WHEN 0 THEN 20 WHEN 1 THEN 10 ELSE -5 END AS score
          FROM s),
        r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY request_id ORDER BY score DESC, warehouse) AS position FROM z)
        SELECT request_id, customer_id, region, preferred_warehouse, warehouse, warehouse_name, score, ok AS can_fulfil,
          CONCAT(CASE WHEN ok THEN 'Full stock:30' ELSE 'Partial stock:-20' END, ',',
            CASE dist WHEN 0 THEN 'Local warehouse:20' WHEN 1 THEN 'Near region:10' ELSE 'Cross-region:-5' END) AS factors,
          CONCAT_WS('; ', CASE WHEN NOT ok THEN 'Cannot fulfill all items from this warehouse' END,
            CASE WHEN dist > 1 THEN 'Cross-region shipping adds cost and transit time' END) AS warnings,
          CAST(position AS INT) AS position, position = 1 AS recommended FROM r"""),
    # The same lines, with every seventh request of a customer that does not exist.
    "unroutable": (lambda t: a.unroutable(t, order_request_lines(t).withColumn(
        "customer_id", F.when(F.col("request_id") % 7 == 0, -1 - F.col("customer_id")).otherwise(F.col("customer_id")))), """
        SELECT DISTINCT request_id, 'customer_not_found' AS error_code, CAST(-1 - customer_id AS VARCHAR) AS detail
        FROM req_orders WHERE request_id % 7 = 0"""),
    "reorder_recommendations": (a.reorder_recommendations, "SELECT * FROM req_recommended"),
    "reorder_recommendations_demand": (a.reorder_recommendations_demand, reorder_sql(BY_DEMAND)),
    "reorder_by_supplier": (a.reorder_by_supplier, """
        SELECT warehouse, supplier_id, supplier_name, lead_time_days, supplier_currency, COUNT(*) AS total_items,
          CAST(SUM(estimated_cost_gbp) AS DECIMAL(18,2)) AS total_cost_gbp FROM req_recommended GROUP BY ALL"""),
    "abc_classification": (a.abc_classification, "SELECT * FROM req_abc"),
    "abc_counts": (a.abc_counts, "SELECT abc_class, COUNT(*) AS products FROM req_abc GROUP BY ALL"),
    "supplier_lead_time_stats": (a.supplier_lead_time_stats, "SELECT * FROM req_lead"),
    "automation_status": (lambda t: a.automation_status(t).withColumn("classes", F.array_join(F.transform(
        F.map_entries("classes"), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))), ",")), """
        SELECT (SELECT COUNT(*) FROM wms_order_lines WHERE fulfilment_status IN ('backordered', 'partial')
            AND qty_backordered > 0) AS pending_lines,
          (SELECT CAST(SUM(qty_backordered) AS BIGINT) FROM wms_order_lines WHERE fulfilment_status
            IN ('backordered', 'partial') AND qty_backordered > 0) AS pending_units,
          (SELECT COUNT(*) FROM wms_returns WHERE status = 'pending') AS pending_returns,
          (SELECT STRING_AGG(CONCAT(abc_class, ':', n), ',' ORDER BY abc_class) FROM (SELECT abc_class, COUNT(*) AS n
            FROM wms_products GROUP BY ALL)) AS classes"""),
    "supplier_lead_times": (a.supplier_lead_times, """
        SELECT id, name, lead_time_days AS promised_days, actual_lead_time_days AS actual_days FROM wms_suppliers"""),
    "cycle_count_summary": (a.cycle_count_summary, """
        SELECT cc.*, COUNT(l.id) AS total_lines, COUNT(l.counted_qty) AS counted_lines
        FROM wms_cycle_counts cc LEFT JOIN wms_cycle_count_lines l ON l.cycle_count_id = cc.id GROUP BY ALL"""),
    "cycle_count_detail": (a.cycle_count_detail, """
        SELECT cc.* RENAME (id AS cycle_count_id), l.id AS line_id, l.product_id, l.counted_at, l.notes AS line_notes,
          p.name AS product_name, p.sku, p.brand, l.location, l.expected_qty, l.counted_qty, l.variance
        FROM wms_cycle_counts cc LEFT JOIN wms_cycle_count_lines l ON cc.id = l.cycle_count_id
        LEFT JOIN wms_products p ON p.id = l.product_id"""),
    "raw_stock_list": (a.raw_stock_list, "SELECT * FROM wms_stock"),
    "warehouse_comparison": (lambda t: a.warehouse_comparison(t, W), "SELECT * FROM req_comparison"),
    "stock_imbalance": (a.stock_imbalance, """
        SELECT p.id AS product_id, p.name, p.sku, p.brand, MAX(qty_on_hand - qty_reserved) AS most_available,
          COUNT(*) FILTER (WHERE qty_on_hand - qty_reserved = 0) AS empty_warehouses
        FROM wms_warehouse_stock ws JOIN wms_products p ON p.id = ws.product_id GROUP BY ALL
        HAVING MAX(qty_on_hand - qty_reserved) >= 20 AND MIN(qty_on_hand - qty_reserved) = 0"""),
    "comparison_filters": (lambda t: a.comparison_filters(t, W, "ed", "", "low_any"),
        "SELECT * FROM req_comparison WHERE (name LIKE '%ed%' OR sku LIKE '%ed%' OR brand LIKE '%ed%') AND "
        "'low' IN (status_0, status_1, status_2, status_3, status_4)"),
    "comparison_totals": (lambda t: a.comparison_totals(a.warehouse_comparison(t, W), W), """
        SELECT COUNT(*) AS products, """ + ", ".join(
            f"CAST(SUM(available_{w}) AS BIGINT) AS available_{w}" for w in W) + """,
          CAST(SUM(total_available) AS BIGINT) AS total_available, COUNT(*) FILTER (WHERE imbalance) AS imbalances
        FROM req_comparison"""),
    "alert_stats": (a.alert_stats, """
        SELECT warehouse, CAST(GROUPING(warehouse) AS INT) AS is_total, COUNT(*) AS alerts,
          COUNT(*) FILTER (WHERE alert_type = 'out_of_stock') AS out_of_stock,
          CAST((200 * COUNT(*) FILTER (WHERE alert_type = 'out_of_stock') + COUNT(*)) // (2 * COUNT(*)) AS BIGINT)
            AS out_of_stock_pct, COUNT(surplus_elsewhere) AS transferable
        FROM req_alerts GROUP BY GROUPING SETS ((warehouse), ())"""),
    "transfer_suggestions": (a.transfer_suggestions, """
        SELECT warehouse, product_id, sku, name, qty_on_hand, reorder_point, alert_type, supplier_name, lead_time_days,
          CASE WHEN most IS NULL THEN 'reorder' ELSE 'transfer' END AS action, best AS from_warehouse,
          CASE WHEN most IS NOT NULL THEN LEAST(most, GREATEST(reorder_point, 1)) END AS transfer_qty,
          CAST(LEAST(100, (200 * qty_on_hand + GREATEST(reorder_point, 1)) // (2 * GREATEST(reorder_point, 1))) AS INT)
            AS fill_pct FROM req_alerts"""),
    "price_change_pct": (a.price_change_pct, """
        SELECT product_id, position, field, old_value, new_value, changed_at,
          CAST(CASE WHEN old_value > 0 THEN SIGN(new_value - old_value) * ((2000 * ABS(CAST((new_value - old_value) * 100
            AS BIGINT)) + CAST(old_value * 100 AS BIGINT)) // (2 * CAST(old_value * 100 AS BIGINT))) * 0.1 ELSE 0 END
            AS DECIMAL(12,1)) AS change_pct, CASE WHEN new_value > old_value THEN 'up' ELSE 'down' END AS direction
        FROM (SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY product_id ORDER BY changed_at DESC, id DESC) AS INT)
          AS position FROM wms_price_history) WHERE position <= 8"""),
    "stock_line_value": (a.stock_line_value, """
        SELECT ws.product_id, ws.warehouse, p.sku, CAST(ws.qty_on_hand * p.cost_price_gbp AS DECIMAL(18,2)) AS line_value_gbp,
          CAST(((20000 * ws.qty_on_hand + m) // (2 * m)) * 0.01 AS DECIMAL(9,2)) AS fill_pct
        FROM (SELECT *, GREATEST(qty_on_hand, reorder_point, 50) AS m FROM wms_warehouse_stock) ws
        JOIN wms_products p ON p.id = ws.product_id"""),
    "ledger_timeline": (a.ledger_timeline, f"""
        SELECT CAST(created_at AS DATE) AS day, warehouse_code, {_CATEGORY} AS category, COUNT(*) AS entries,
          CAST(COALESCE(SUM(qty_change), 0) AS BIGINT) AS net_qty FROM wms_audit_log GROUP BY ALL"""),
    "extract_refs": (a.extract_refs, """
        SELECT id, kind, REGEXP_EXTRACT(notes, CONCAT('(', kind, '-\\d{4}-\\d+)'), 1) AS ref FROM wms_audit_log
        CROSS JOIN (VALUES ('PO'), ('ORD'), ('TXF'), ('RMA'), ('CC')) k(kind)
        WHERE REGEXP_MATCHES(notes, CONCAT(kind, '-\\d{4}-\\d+'))"""),
    "cycle_count_progress": (a.cycle_count_progress, """
        SELECT cc.id, cc.count_ref, cc.status, COUNT(l.counted_qty) AS counted_lines, COUNT(l.id) AS total_lines,
          CAST((200 * COUNT(l.counted_qty) + COUNT(l.id)) // (2 * COUNT(l.id)) AS BIGINT) AS progress_pct,
          COUNT(*) FILTER (WHERE l.counted_qty <> l.expected_qty) AS discrepancies,
          CAST(COALESCE(SUM(ABS(l.variance)), 0) AS BIGINT) AS total_variance,
          cc.status = 'in_progress' AND COUNT(l.counted_qty) = COUNT(l.id) AS completable
        FROM wms_cycle_counts cc LEFT JOIN wms_cycle_count_lines l ON l.cycle_count_id = cc.id
        GROUP BY cc.id, cc.count_ref, cc.status"""),
    "price_order_lines": (lambda t: a.price_order_lines(t, order_request_lines(t)), f"""
        SELECT * EXCLUDE (best_pct), {half_up('base_price_gbp', 'discount_pct')} AS unit_price_gbp FROM req_priced"""),
    "effective_price": (lambda t: a.effective_price(t, order_request_lines(t)), f"""
        SELECT * EXCLUDE (best_pct, discount_pct), best_pct AS discount_pct,
          {half_up('base_price_gbp', 'best_pct')} AS unit_price_gbp FROM req_priced"""),
    "check_moq": (lambda t: a.check_moq(t, order_request_lines(t)), """
        SELECT r.request_id, r.line_id, r.product_id, p.name AS moq_product_name, r.qty AS ordered, p.moq
        FROM req_orders r JOIN wms_products p ON p.id = r.product_id WHERE p.moq > 1 AND r.qty < p.moq"""),
    "cart_totals": (lambda t: a.cart_totals(t, order_request_lines(t)), f"""
        WITH z AS (SELECT request_id, customer_id, CAST(SUM(qty * {half_up('base_price_gbp', 'best_pct')}) AS DECIMAL(18,2))
            AS total_gbp, CAST(SUM(qty * base_price_gbp) AS DECIMAL(18,2)) AS base_total_gbp FROM req_priced GROUP BY ALL)
        SELECT z.*, CAST(base_total_gbp - total_gbp AS DECIMAL(18,2)) AS savings_gbp,
          CASE WHEN c.payment_terms <> 'prepaid' AND c.credit_limit_gbp > 0 THEN
            CAST(GREATEST(0, c.credit_limit_gbp - c.credit_used_gbp - total_gbp) AS DECIMAL(18,2)) END AS credit_remaining_gbp,
          c.payment_terms <> 'prepaid' AND c.credit_limit_gbp > 0 AND total_gbp > c.credit_limit_gbp - c.credit_used_gbp
            AS exceeds_credit FROM z JOIN wms_customers c ON c.id = z.customer_id"""),
    "credit_usage": (a.credit_usage, """
        SELECT id, company_name, CAST(credit_limit_gbp - credit_used_gbp AS DECIMAL(18,2)) AS credit_available_gbp,
          pct AS credit_used_pct, CASE WHEN pct > 80 THEN 'high' WHEN pct > 60 THEN 'medium' ELSE 'low' END AS credit_band,
          credit_used_gbp > credit_limit_gbp * 0.8 AS over_80_pct FROM (SELECT *, CASE WHEN credit_limit_gbp > 0 THEN
            (200 * CAST(credit_used_gbp AS BIGINT) + CAST(credit_limit_gbp AS BIGINT)) // (2 * CAST(credit_limit_gbp AS BIGINT)) ELSE 0 END AS pct
          FROM wms_customers)"""),
    "catalogue_filter": (lambda t: a.catalogue_filter(t, "RED", "", "uk"), f"""
        SELECT *  EXCLUDE (available_uk, available_us), CASE WHEN rrp_gbp > 0 THEN {margin('rrp_gbp', 'buy_cost_gbp')} END
          AS margin_pct, CASE WHEN available_uk AND available_us THEN 'uk+us' WHEN available_uk THEN 'uk' WHEN available_us
          THEN 'us' ELSE 'none' END AS availability
        FROM wms_stock WHERE available_uk AND (LOWER(title) LIKE '%red%' OR LOWER(brand) LIKE '%red%'
          OR LOWER(sku) LIKE '%red%' OR ean LIKE '%red%')"""),
    "margin_bands": (a.margin_bands, f"""
        SELECT id, sku, brand, m AS margin_pct, CASE WHEN m >= 40 THEN 'high' WHEN m >= 25 THEN 'mid' ELSE 'low' END
          AS price_band, CASE WHEN m > 15 THEN 'good' WHEN m > 0 THEN 'thin' ELSE 'none' END AS supplier_band
        FROM (SELECT *, {margin('sell_price_gbp', 'cost_price_gbp')} AS m FROM wms_products)"""),
    "review_issue_counts": (a.review_issue_counts, """
        SELECT order_id, order_ref, COUNT(*) AS lines, COUNT(*) FILTER (WHERE qty_available < qty_requested) AS short_lines
        FROM req_review GROUP BY ALL"""),
    "order_totals": (a.order_totals, f"""
        SELECT o.id, o.order_ref, CAST(COALESCE(SUM(l.qty_ordered), 0) AS BIGINT) AS total_units,
          CAST(COALESCE(SUM(l.qty_ordered * l.unit_price_gbp), 0) AS DECIMAL(18,2)) AS total_value_gbp,
          {_STAGE} - 1 AS stage_index
        FROM wms_orders o LEFT JOIN wms_order_lines l ON l.order_id = o.id GROUP BY o.id, o.order_ref, o.fulfilment_status"""),
    "dashboard_totals": (a.dashboard_totals, """
        SELECT COUNT(*) AS warehouses, CAST(SUM(total_units) AS BIGINT) AS total_units,
          CAST(SUM(stock_value_gbp) AS DECIMAL(18,2)) AS stock_value_gbp,
          CAST(SUM(low_stock_items) AS BIGINT) AS low_stock_items,
          CAST(SUM(out_of_stock_items) AS BIGINT) AS out_of_stock_items FROM req_kpi"""),
    "dashboard_warehouses": (a.dashboard_warehouses, """
        SELECT *, CAST((200 * total_units + (SELECT MAX(total_units) FROM req_kpi)) // (2 * (SELECT MAX(total_units)
          FROM req_kpi)) AS BIGINT) AS share_of_largest_pct, CASE WHEN out_of_stock_items > 0 THEN 'critical'
          WHEN low_stock_items > 0 THEN 'warning' ELSE 'healthy' END AS health FROM req_kpi"""),
    "prediction_summary": (a.prediction_summary,
        "SELECT severity, COUNT(*) AS items FROM req_stockout GROUP BY ALL"),
    "prediction_page": (a.prediction_page, f"""
        SELECT * FROM req_stockout WHERE severity <> 'no_demand'
        ORDER BY {_SEV}, days_until_stockout, product_id, warehouse LIMIT 50"""),
    "table_row_counts": (a.table_row_counts, " UNION ALL ".join(
        f"SELECT '{n}' AS table_name, COUNT(*) AS rows FROM wms_{n}" for n in (
            "audit_log", "customers", "cycle_count_lines", "cycle_counts", "invoice_lines", "invoices", "order_lines",
            "orders", "po_lines", "price_history", "price_tiers", "products", "purchase_orders", "returns", "stock",
            "stock_transfers", "suppliers", "transfer_lines", "warehouse_stock", "warehouses"))),
}
READS["po_summary_together"] = (lambda t: a.po_summary(purchases_together(t)), READS["po_summary"][1])
