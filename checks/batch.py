"""Batch jobs over whole request tables, with the SQL that must give the same rows.

Sequential jobs are checked by folding each ordered list of requests in SQL, so
the check does not repeat the closed form the library uses.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from checks.reads import READS, half_up
from stockline.sources.buckets import Bucketed, create, read, run_on_buckets
from stockline.sources.snapshots import append_ledger, read_ledger
from stockline.sources.staging import staging_root
from stockline import analytics, jobs
from stockline.jobs.purchasing import update_lead_times
from stockline.tables import Tables

NOW = datetime(2002, 1, 1)
ASOF = datetime(2001, 8, 1)

Job = Callable[[Tables, Tables], DataFrame]


def at(c: str) -> Column:
    return F.col(c).cast("timestamp_ntz")


def ref(prefix: str, view: str, column: str, order: str, year: str) -> str:
    """Next reference by row number after the highest existing number of the year."""
    n = (
        f"COALESCE((SELECT MAX(CAST(REGEXP_EXTRACT({column}, '^{prefix}-\\d{{4}}-(\\d+)', 1) AS BIGINT)) FROM {view} "
        f"WHERE {column} LIKE '{prefix}-' || y || '-%'), 0) + ROW_NUMBER() OVER (PARTITION BY y ORDER BY {order})"
    )
    return (
        f"CONCAT('{prefix}-', y, '-', CASE WHEN {n} < 1000 THEN LPAD(CAST({n} AS VARCHAR), 4, '0') "
        f"ELSE CAST({n} AS VARCHAR) END)"
    )


# -- helpers over the requests ------------------------------------------------

REQ_PO_FIRST = (
    "SELECT a.*, p.status AS po_status, ROW_NUMBER() OVER (PARTITION BY a.po_id ORDER BY a.requested_at, a.request_id) = 1 "
    "AND COALESCE(p.status = 'draft', FALSE) AS ok FROM req_po_actions a LEFT JOIN wms_purchase_orders p ON p.id = a.po_id"
)
# Receipts: an order closes with the first request after which all its lines are complete.
REQ_GOT = (
    "SELECT r.*, CAST(r.qty AS INT) AS n, l.product_id, l.qty_received, l.qty_ordered, p.warehouse_code, p.status, p.po_ref "
    "FROM req_receipts r JOIN wms_po_lines l ON l.id = r.line_id JOIN wms_purchase_orders p ON p.id = r.po_id "
    "WHERE p.status IN ('submitted', 'partial')"
)
REQ_CLOSE = (
    "SELECT po_id, MIN(requested_at) AS closed FROM req_got g WHERE requested_at >= (SELECT CASE WHEN "
    "BOOL_AND(qty_received >= qty_ordered OR (n > 0 AND qty_received + n >= qty_ordered)) THEN COALESCE(MAX(CASE WHEN "
    "qty_received < qty_ordered THEN requested_at END), TIMESTAMP '1900-01-01') END FROM req_got x "
    "WHERE x.po_id = g.po_id) GROUP BY po_id"
)
REQ_BOOKED = (
    "SELECT g.* FROM req_got g LEFT JOIN req_close c ON c.po_id = g.po_id "
    "WHERE c.closed IS NULL OR g.requested_at <= c.closed"
)
# Orders move forward: each stage takes the first matching request after the one before.
REQ_ADV = (
    "SELECT a.*, o.fulfilment_status AS was, o.warehouse_code, (a.requested_at, a.request_id) AS k "
    "FROM req_order_actions a JOIN wms_orders o ON o.id = a.order_id"
)
REQ_PICK = "SELECT order_id, MIN(k) AS k FROM req_adv WHERE action = 'pick' AND was = 'confirmed' GROUP BY order_id"
REQ_PACK = (
    "SELECT a.order_id, MIN(a.k) AS k FROM req_adv a LEFT JOIN req_pick p ON p.order_id = a.order_id WHERE action = 'pack' "
    "AND (was IN ('picking', 'picked') OR a.k > p.k) GROUP BY a.order_id"
)
REQ_SHIP = (
    "SELECT a.order_id, MIN(a.k) AS k FROM req_adv a LEFT JOIN req_pack p ON p.order_id = a.order_id WHERE action = 'ship' "
    "AND (was IN ('packing', 'packed') OR a.k > p.k) GROUP BY a.order_id"
)
# Review decisions folded per stock row, in order.
REQ_REVIEW_WORK = (
    "SELECT d.line_id, d.decision, r.requested_at, r.request_id, d.line_no, r.order_id, l.product_id, o.warehouse_code, "
    "l.unit_price_gbp, COALESCE(NULLIF(l.qty_requested, 0), l.qty_ordered) AS requested, "
    "GREATEST(0, CAST(d.custom_qty AS INT)) AS q, ws.qty_on_hand - ws.qty_reserved AS opening "
    "FROM req_decisions d JOIN req_reviews r ON r.request_id = d.request_id JOIN wms_orders o ON o.id = r.order_id "
    "AND o.requires_review JOIN wms_order_lines l ON l.id = d.line_id AND l.order_id = r.order_id "
    "LEFT JOIN wms_warehouse_stock ws ON ws.product_id = l.product_id AND ws.warehouse = o.warehouse_code "
    "WHERE d.decision IN ('ship_available', 'custom', 'hold')"
)
REQ_REVIEW_FOLD = (
    "SELECT UNNEST(LIST_REDUCE(LIST_PREPEND({'avail': ANY_VALUE(opening), 'rows': [{'id': '', 'd': '', 'req': 0, 'q': 0, "
    "'ship': 0, 'before': 0}]}, LIST({'avail': 0, 'rows': [{'id': line_id, 'd': decision, 'req': requested, 'q': q, "
    "'ship': 0, 'before': 0}]} ORDER BY requested_at, request_id, line_no)), lambda acc, x: {'avail': acc.avail - "
    "GREATEST(0, CASE x.rows[1].d WHEN 'ship_available' THEN LEAST(x.rows[1].req, acc.avail) WHEN 'custom' THEN x.rows[1].q "
    "ELSE 0 END), 'rows': LIST_APPEND(acc.rows, {'id': x.rows[1].id, 'd': x.rows[1].d, 'req': x.rows[1].req, 'q': "
    "x.rows[1].q, 'ship': CASE x.rows[1].d WHEN 'ship_available' THEN LEAST(x.rows[1].req, acc.avail) WHEN 'custom' "
    "THEN x.rows[1].q ELSE 0 END, 'before': acc.avail})}).rows, recursive := true) FROM req_review_work "
    "GROUP BY product_id, warehouse_code"
)


def serve_fold(source: str) -> str:
    """Serve needs one by one: all of a need that fits in what is left, else what is left, if anything."""
    got = "CASE WHEN acc.b >= x.r[1].n THEN x.r[1].n WHEN acc.b > 0 THEN acc.b ELSE 0 END"
    return (
        "SELECT UNNEST(LIST_REDUCE(LIST_PREPEND({'b': CAST(ANY_VALUE(avail) AS BIGINT), 'r': [{'o': NULL::BIGINT, 'l': NULL, 'n': 0::BIGINT, "
        "'got': 0::BIGINT, 'seen': 0::BIGINT}]}, LIST({'b': 0::BIGINT, 'r': [{'o': CAST(order_key AS BIGINT), 'l': line_key, 'n': CAST(need AS BIGINT), "
        "'got': 0::BIGINT, 'seen': 0::BIGINT}]} ORDER BY moment, order_key, line_key)), lambda acc, x: {'b': acc.b - "
        f"{got}, 'r': LIST_APPEND(acc.r, {{'o': x.r[1].o, 'l': x.r[1].l, 'n': x.r[1].n, 'got': {got}, 'seen': acc.b}})}}).r, "
        f"recursive := true) FROM ({source}) GROUP BY product_id, warehouse"
    )


def credit_fold(source: str) -> str:
    """Accept totals in order while they fit into what is left; ``free`` ones are taken unchecked."""
    return (
        "SELECT UNNEST(LIST_REDUCE(LIST_PREPEND({'left': ANY_VALUE(credit), 'rows': [{'id': -1::BIGINT, 'v': 0::BIGINT, "
        "'free': FALSE, 'ok': FALSE}]}, LIST({'left': 0::BIGINT, 'rows': [{'id': request_id, 'v': v, 'free': free, 'ok': FALSE}]} "
        "ORDER BY requested_at, request_id)), lambda acc, x: {'left': acc.left - CASE WHEN x.rows[1].free OR "
        "x.rows[1].v <= acc.left THEN x.rows[1].v ELSE 0 END, 'rows': LIST_APPEND(acc.rows, {'id': x.rows[1].id, 'v': "
        "x.rows[1].v, 'free': x.rows[1].free, 'ok': x.rows[1].free OR x.rows[1].v <= acc.left})}).rows, recursive := true) "
        f"FROM {source} GROUP BY customer_id"
    )


REQ_CREDIT_WORK = (
    "SELECT r.*, CAST(r.total_gbp * 100 AS BIGINT) AS v, FALSE AS free, CAST((c.credit_limit_gbp - c.credit_used_gbp) * 100 "
    "AS BIGINT) AS credit FROM req_totals r JOIN wms_customers c ON c.id = r.customer_id "
    "WHERE c.payment_terms <> 'prepaid' AND c.credit_limit_gbp > 0"
)
REQ_CREDIT = credit_fold("req_credit_work")

# Order intake step by step.
REQ_NEW_VALID = (
    "SELECT r.*, COALESCE(r.warehouse_code, 0) AS wh, NOT COALESCE(r.skip_checks, FALSE) AS checked "
    "FROM req_new_orders r WHERE r.customer_id IS NOT NULL AND EXISTS (SELECT 1 FROM req_new_order_lines l "
    "WHERE l.request_id = r.request_id)"
)
REQ_NEW_ITEMS = (
    "SELECT l.request_id, l.line_no, l.product_id, l.sku, CAST(l.qty AS INT) AS qty, CAST(l.base_price AS DECIMAL(12,2)) "
    "AS base_price_gbp, v.customer_id, v.wh, v.checked, p.moq FROM req_new_order_lines l JOIN req_new_valid v "
    "ON v.request_id = l.request_id JOIN wms_products p ON p.id = l.product_id"
)
REQ_NEW_MOQ = "SELECT DISTINCT request_id FROM req_new_items WHERE checked AND moq > 1 AND qty < moq"
REQ_NEW_DISCOUNT = (
    "SELECT i.*, CASE WHEN i.checked THEN GREATEST(c.default_discount_pct, COALESCE((SELECT ARG_MAX(discount_pct, min_qty) "
    "FROM req_tiers t WHERE t.product_id = i.product_id AND t.min_qty <= i.qty), 0)) ELSE 0 END::DECIMAL(5,2) AS pct, "
    "i.qty > COALESCE(ws.qty_on_hand - ws.qty_reserved, 0) AS short FROM req_new_items i "
    "JOIN wms_customers c ON c.id = i.customer_id LEFT JOIN wms_warehouse_stock ws ON ws.product_id = i.product_id "
    "AND ws.warehouse = i.wh WHERE i.request_id NOT IN (SELECT request_id FROM req_new_moq)"
)
REQ_NEW_PRICED = f"SELECT *, {half_up('base_price_gbp', 'pct')} AS unit_price_gbp FROM req_new_discount"
REQ_NEW_TOTALS = (
    "SELECT p.request_id, v.customer_id, v.requested_at, v.wh, NOT v.checked AS free, COUNT(*) AS line_count, "
    "CAST(SUM(p.qty * p.unit_price_gbp) AS DECIMAL(12,2)) AS total_gbp, BOOL_OR(p.short) AS needs_review "
    "FROM req_new_priced p JOIN req_new_valid v ON v.request_id = p.request_id GROUP BY ALL"
)
REQ_NEW_CREDIT_WORK = (
    "SELECT n.*, CAST(n.total_gbp * 100 AS BIGINT) AS v, CAST((c.credit_limit_gbp - c.credit_used_gbp) * 100 AS BIGINT) "
    "AS credit FROM req_new_totals n JOIN wms_customers c ON c.id = n.customer_id "
    "WHERE c.payment_terms <> 'prepaid' AND c.credit_limit_gbp > 0"
)
REQ_NEW_CREDIT = credit_fold("req_new_credit_work")
REQ_NEW_TAKEN = (
    "SELECT n.* FROM req_new_totals n LEFT JOIN req_new_credit f ON f.id = n.request_id WHERE COALESCE(f.ok, TRUE)"
)
# Adjustments folded per stock row with the floor at zero applied at every step.
REQ_ADJ_WORK = (
    "SELECT a.*, CAST(a.adjustment AS INT) AS n, ws.qty_on_hand AS opening FROM req_adjustments a JOIN wms_warehouse_stock ws "
    "ON ws.product_id = a.product_id AND ws.warehouse = a.warehouse"
)
REQ_ADJ = (
    "SELECT product_id, warehouse, UNNEST(LIST_REDUCE(LIST_PREPEND({'b': ANY_VALUE(opening), 'rows': [{'id': 0::BIGINT, 'n': 0, "
    "'after': 0}]}, LIST({'b': 0, 'rows': [{'id': request_id, 'n': n, 'after': 0}]} ORDER BY requested_at, request_id)), "
    "lambda acc, x: {'b': GREATEST(0, acc.b + x.rows[1].n), 'rows': LIST_APPEND(acc.rows, {'id': x.rows[1].id, "
    "'n': x.rows[1].n, 'after': GREATEST(0, acc.b + x.rows[1].n)})}).rows, recursive := true), "
    "GENERATE_SUBSCRIPTS(LIST_PREPEND(0, LIST(n)), 1) AS i FROM req_adj_work GROUP BY product_id, warehouse"
)
# Dispatch, one transfer after another: taken if the stock less what earlier ones took is enough for each of its products.
REQ_DISPATCH_WANTED = (
    "SELECT a.transfer_id, MIN(a.requested_at) AS requested_at FROM req_transfer_actions a JOIN wms_stock_transfers s "
    "ON s.id = a.transfer_id AND s.status = 'requested' GROUP BY ALL"
)
REQ_DISPATCH_NEED = (
    "SELECT transfer_id, requested_at, k, CAST(SUM(qty) AS BIGINT) AS n, CAST(MAX(so_far) AS BIGINT) AS peak, "
    "CAST(COALESCE(ANY_VALUE(have), -1000000000) AS BIGINT) AS have FROM (SELECT d.transfer_id, d.requested_at, CONCAT(l.product_id, '/', "
    "s.from_warehouse) AS k, l.qty, ws.qty_on_hand AS have, SUM(l.qty) OVER (PARTITION BY d.transfer_id, l.product_id ORDER BY l.id "
    "ROWS UNBOUNDED PRECEDING) AS so_far FROM req_dispatch_wanted d JOIN wms_stock_transfers s "
    "ON s.id = d.transfer_id JOIN wms_transfer_lines l ON l.transfer_id = d.transfer_id LEFT JOIN wms_warehouse_stock ws "
    "ON ws.product_id = l.product_id AND ws.warehouse = s.from_warehouse) GROUP BY ALL"
)
_DISPATCH_SHORT = "LEN(LIST_FILTER(x.need, lambda y: y.peak + COALESCE(acc.took[y.k], 0) > y.have))"
REQ_DISPATCH_FOLD = (
    "SELECT UNNEST(LIST_REDUCE(LIST_PREPEND({'took': MAP([]::VARCHAR[], []::BIGINT[]), 'need': NULL::STRUCT(k VARCHAR, n BIGINT, peak BIGINT, have BIGINT)[], "
    "'id': NULL::BIGINT, 'done': []::BIGINT[]}, LIST({'took': NULL::MAP(VARCHAR, BIGINT), 'need': need, 'id': transfer_id, 'done': NULL::BIGINT[]} "
    "ORDER BY requested_at, transfer_id)), lambda acc, x: {'took': CASE WHEN " + _DISPATCH_SHORT + " > 0 THEN acc.took ELSE "
    "MAP_CONCAT(acc.took, MAP_FROM_ENTRIES(LIST_TRANSFORM(x.need, lambda y: {'k': y.k, 'v': COALESCE(acc.took[y.k], 0) + y.n}))) END, "
    "'need': x.need, 'id': x.id, 'done': CASE WHEN " + _DISPATCH_SHORT + " > 0 THEN acc.done ELSE LIST_APPEND(acc.done, x.id) END}).done) AS id "
    "FROM (SELECT transfer_id, requested_at, LIST({'k': k, 'n': n, 'peak': peak, 'have': have}) AS need FROM req_dispatch_need GROUP BY ALL)"
)
REQ_BACK_OPEN = (
    "SELECT l.id AS line_id, l.order_id, o.order_ref, l.product_id, o.warehouse_code, l.product_name, l.sku, l.qty_backordered, "
    "o.created_at, ws.qty_on_hand - ws.qty_reserved AS avail FROM wms_order_lines l JOIN wms_orders o ON o.id = l.order_id "
    "JOIN wms_warehouse_stock ws ON ws.product_id = l.product_id AND ws.warehouse = o.warehouse_code "
    "WHERE l.fulfilment_status IN ('backordered', 'partial') AND l.qty_backordered > 0 AND ws.qty_on_hand - ws.qty_reserved > 0"
)
REQ_BACK_FOLD = serve_fold(
    "SELECT order_id AS order_key, line_id AS line_key, created_at AS moment, product_id, warehouse_code AS warehouse, "
    "qty_backordered AS need, avail FROM req_back_open"
)
REQ_BACK = (
    "SELECT b.* EXCLUDE (created_at, avail), f.got AS qty_fulfilled FROM req_back_open b JOIN req_back_fold f ON f.l = b.line_id"
)
REQ_DISPOSED = (
    "SELECT id, rma_ref, product_id, warehouse_code, qty, created_at, code AS reason_code, CASE WHEN code IN ('damaged', "
    "'defective', 'expired', 'quality_issue') THEN 'write_off' ELSE 'restock' END AS action FROM (SELECT *, COALESCE("
    "reason_code, CASE WHEN LOWER(reason) LIKE '%damage%' OR LOWER(reason) LIKE '%broken%' THEN 'damaged' "
    "WHEN LOWER(reason) LIKE '%defect%' OR LOWER(reason) LIKE '%faulty%' THEN 'defective' WHEN LOWER(reason) LIKE '%wrong%' "
    "OR LOWER(reason) LIKE '%incorrect%' THEN 'wrong_item' WHEN LOWER(reason) LIKE '%expir%' THEN 'expired' "
    "WHEN LOWER(reason) LIKE '%quality%' THEN 'quality_issue' ELSE 'customer_change' END) AS code FROM wms_returns "
    "WHERE status = 'pending')"
)
REQ_AUTO = (
    "SELECT ws.warehouse AS warehouse_code, p.supplier_id, ws.product_id, p.cost_price_gbp AS unit_cost_gbp, "
    "GREATEST(ws.max_stock - ws.qty_on_hand, COALESCE(NULLIF(p.case_pack, 0), 1)) AS qty_ordered "
    "FROM wms_warehouse_stock ws JOIN wms_products p ON p.id = ws.product_id WHERE ws.qty_on_hand <= ws.reorder_point "
    "AND ws.reorder_point > 0 AND p.supplier_id IS NOT NULL"
)
# Invoices.
REQ_INV_VALID = (
    "SELECT i.* EXCLUDE (customer_name, order_number), TRIM(i.customer_name) AS customer_name, "
    "NULLIF(TRIM(i.order_number), '') AS order_number, CASE WHEN i.customer_region IN ('0','1','2','3','4') THEN "
    "CAST(i.customer_region AS INT) END AS region FROM req_new_invoices i WHERE EXISTS (SELECT 1 FROM req_new_invoice_lines l "
    "WHERE l.request_id = i.request_id)"
)
REQ_INV_OK = (
    "SELECT v.*, c.id AS known_id FROM req_inv_valid v LEFT JOIN wms_customers c ON c.company_name = v.customer_name "
    "WHERE (v.order_number IS NULL OR NOT EXISTS (SELECT 1 FROM wms_invoices x WHERE x.customer_id = c.id "
    "AND x.order_number = v.order_number)) QUALIFY v.order_number IS NULL OR ROW_NUMBER() OVER (PARTITION BY "
    "v.customer_name, v.order_number ORDER BY v.requested_at, v.request_id) = 1"
)
REQ_INV_ITEMS = (
    "SELECT l.request_id, l.line_no, TRIM(l.sku) AS sku, CAST(l.quantity AS INT) AS qty, p.id AS product_id, "
    "CASE o.region WHEN 1 THEN 1 ELSE 0 END AS warehouse, o.requested_at, ws.qty_on_hand - ws.qty_reserved AS avail "
    "FROM req_new_invoice_lines l JOIN req_inv_ok o ON o.request_id = l.request_id "
    "LEFT JOIN wms_products p ON p.sku = TRIM(l.sku) LEFT JOIN wms_warehouse_stock ws ON ws.product_id = p.id "
    "AND ws.warehouse = CASE o.region WHEN 1 THEN 1 ELSE 0 END"
)
REQ_INV_SERVED_FOLD = serve_fold(
    "SELECT request_id AS order_key, line_no AS line_key, requested_at AS moment, product_id, warehouse, qty AS need, avail "
    "FROM req_inv_items WHERE avail IS NOT NULL"
)
REQ_INV_SERVED = (
    "SELECT i.*, COALESCE(f.got, 0) AS got, CASE WHEN f.seen >= i.qty THEN 'fulfilled' WHEN f.seen > 0 THEN 'partial' "
    "ELSE 'backordered' END AS status FROM req_inv_items i LEFT JOIN req_inv_served_fold f "
    "ON f.o = i.request_id AND f.l = i.line_no"
)

SHARED = {name.lower(): value for name, value in dict(globals()).items() if name.startswith("REQ_")}

_RECEIVED = "CASE WHEN c.closed IS NOT NULL THEN 'received' WHEN x.any_received THEN 'partial' ELSE p.status END"


def _stock(column: str, delta: str) -> str:
    """Stock with a grouped change added to one column."""
    return (
        f"SELECT ws.* REPLACE (CAST(ws.{column} + COALESCE(d.q, 0) AS INT) AS {column}) FROM wms_warehouse_stock ws "
        f"LEFT JOIN ({delta}) d ON d.product_id = ws.product_id AND d.warehouse = ws.warehouse"
    )


def _ledger(df: DataFrame) -> DataFrame:
    return df.select("action", "entity_id", "warehouse_code", "product_id", "qty_change", "balance_after", "notes")


def _adjusted_in_buckets(t: Tables, r: Tables) -> DataFrame:
    """Stock after the adjustments, which read and write only the buckets of the stock rows that they name."""
    spark = t.orders.sparkSession
    stock = t.warehouse_stock
    table = Bucketed(f"{staging_root(spark)}/buckets-{uuid.uuid4().hex}", ", ".join(f"{n} {kind}" for n, kind in stock.dtypes), ("product_id", "warehouse"))
    create(table, stock)
    run_on_buckets(table, "warehouse_stock", jobs.adjust_stock, t, r["req_adjustments"], 0)
    return read(spark, table, 1).select("product_id", "warehouse", "qty_on_hand")


def _appended_ledger(t: Tables, r: Tables) -> DataFrame:
    """The disposition ledger written to a ledger folder and read back."""
    spark = t.orders.sparkSession
    path = f"{staging_root(spark)}/ledger-{uuid.uuid4().hex}"
    jobs.ledger_append(jobs.returns_disposition(t, NOW).ledger, path, "1")
    return read_ledger(spark, path)


def _search_by_day(t: Tables) -> DataFrame:
    """The whole ledger in day folders, searched from the newest day backwards."""
    spark = t.orders.sparkSession
    path = f"{staging_root(spark)}/ledger-{uuid.uuid4().hex}"
    append_ledger(t.audit_log, path, "1")
    return analytics.audit_search_newest(t, read_ledger(spark, path), 3)


def _new_orders(t: Tables, r: Tables):
    return jobs.create_orders(t, r["req_new_orders"], r["req_new_order_lines"], default_warehouse=0)


def _invoices(t: Tables, r: Tables):
    return jobs.ingest_invoices(
        t, r["req_new_invoices"], r["req_new_invoice_lines"], valid_regions=(0, 1, 2, 3, 4), region_warehouses={1: 1},
        default_warehouse=0,
    )


JOBS: dict[str, tuple[Job, str | None]] = {
    "ingest_suppliers": (lambda t, r: jobs.ingest_suppliers(t, r["req_suppliers"]).accepted, """
        SELECT request_id AS id, TRIM(name) AS name, NULL::VARCHAR AS contact_email, CASE WHEN (request_id - 1000000) % 3 = 1
          THEN CAST(request_id - 1000000 AS INT) ELSE 14 END AS lead_time_days, CASE WHEN currency = '' THEN 'GBP'
          ELSE currency END AS currency, notes FROM req_suppliers WHERE TRIM(name) <> ''"""),
    "ingest_customers": (lambda t, r: jobs.ingest_customers(t, r["req_customers"]).accepted, """
        SELECT request_id AS id, TRIM(company_name) AS company_name, contact_name, email, NULL::VARCHAR AS billing_address,
          'GBP' AS currency_preference, vat_number, notes, region, CASE customer_type WHEN '' THEN 'retail' ELSE customer_type
          END AS customer_type, 'prepaid' AS payment_terms, CAST(CASE credit_limit_gbp WHEN '1500.50' THEN 1500.50 ELSE 0 END
          AS DECIMAL(12,2)) AS credit_limit_gbp, CAST(0 AS DECIMAL(12,2)) AS credit_used_gbp,
          CAST(2.5 AS DECIMAL(5,2)) AS default_discount_pct
        FROM req_customers WHERE TRIM(company_name) <> '' AND TRIM(company_name) NOT IN (SELECT company_name FROM wms_customers)
        QUALIFY ROW_NUMBER() OVER (PARTITION BY TRIM(company_name) ORDER BY requested_at, request_id) = 1"""),
    "patch_customers": (lambda t, r: jobs.patch_customers(t, r["req_totals"].select(
        "request_id", "customer_id", "requested_at", F.create_map(
            F.lit("notes"), F.when(F.col("request_id") % 3 != 0, F.col("request_id").cast("string")),
            F.when(F.col("request_id") % 2 == 0, "payment_terms").otherwise("ignored"), F.lit("net-90"),
        ).alias("fields"))).accepted, """
        SELECT c.* REPLACE (x.notes AS notes, CASE WHEN x.terms THEN 'net-90' ELSE c.payment_terms END AS payment_terms)
        FROM wms_customers c JOIN (SELECT customer_id, BOOL_OR(request_id % 2 = 0) AS terms,
          ARG_MAX_NULL(CASE WHEN request_id % 3 <> 0 THEN CAST(request_id AS VARCHAR) END, (requested_at, request_id)) AS notes
          FROM req_totals GROUP BY customer_id) x ON x.customer_id = c.id"""),
    "create_purchase_orders": (lambda t, r: jobs.create_purchase_orders(t, r["req_pos"], r["req_po_lines"]).accepted, f"""
        SELECT request_id AS id, {ref('PO', 'wms_purchase_orders', 'po_ref', 'requested_at, request_id', 'y')} AS po_ref,
          supplier_id, warehouse_code, 'draft' AS status, NULL::VARCHAR AS notes, requested_at AS created_at, n AS line_count
        FROM (SELECT r.*, CAST(YEAR(requested_at) AS VARCHAR) AS y, (SELECT COUNT(*) FROM req_po_lines l
          WHERE l.request_id = r.request_id) AS n FROM req_pos r)
        WHERE supplier_id IS NOT NULL AND warehouse_code IS NOT NULL AND n > 0"""),
    "create_purchase_orders_rejects": (
        lambda t, r: jobs.create_purchase_orders(t, r["req_pos"], r["req_po_lines"]).rejects.drop("detail"), """
        SELECT * FROM (SELECT CAST(request_id AS VARCHAR) AS request_id, CASE WHEN supplier_id IS NULL
            THEN 'supplier_id_required' WHEN warehouse_code IS NULL THEN 'warehouse_code_required' WHEN NOT EXISTS (
            SELECT 1 FROM req_po_lines l WHERE l.request_id = r.request_id) THEN 'lines_required' END AS error_code
          FROM req_pos r) WHERE error_code IS NOT NULL"""),
    "delete_draft_pos": (lambda t, r: jobs.delete_draft_pos(t, r["req_po_actions"]).state["purchase_orders"], """
        SELECT * FROM wms_purchase_orders WHERE id NOT IN (SELECT po_id FROM req_po_first WHERE ok)"""),
    "submit_pos": (lambda t, r: jobs.submit_pos(t, r["req_po_actions"]).state["purchase_orders"], """
        SELECT p.* REPLACE (CASE WHEN f.ok THEN 'submitted' ELSE p.status END AS status,
          CASE WHEN f.ok THEN f.requested_at ELSE p.submitted_at END AS submitted_at,
          CASE WHEN f.ok THEN f.requested_at ELSE p.updated_at END AS updated_at)
        FROM wms_purchase_orders p LEFT JOIN req_po_first f ON f.po_id = p.id AND f.ok"""),
    "submit_pos_rejects": (lambda t, r: jobs.submit_pos(t, r["req_po_actions"]).rejects, """
        SELECT request_id, 'cannot_submit' AS error_code, CAST(po_id AS VARCHAR) AS detail FROM req_po_first WHERE NOT ok"""),
    "receive_goods": (lambda t, r: jobs.receive_goods(t, r["req_receipts"]).state["purchase_orders"], f"""
        SELECT p.* REPLACE (CASE WHEN b.po_id IS NOT NULL THEN {_RECEIVED} ELSE p.status END AS status,
          COALESCE(b.last, p.updated_at) AS updated_at, COALESCE(c.closed, p.received_at) AS received_at)
        FROM wms_purchase_orders p LEFT JOIN (SELECT po_id, MAX(requested_at) AS last FROM req_booked GROUP BY ALL) b
          ON b.po_id = p.id LEFT JOIN req_close c ON c.po_id = p.id LEFT JOIN (SELECT l.po_id,
          BOOL_OR(l.qty_received + COALESCE(g.n, 0) > 0) AS any_received FROM wms_po_lines l LEFT JOIN req_booked g
          ON g.line_id = l.id GROUP BY ALL) x ON x.po_id = p.id"""),
    "receive_goods_stock": (lambda t, r: jobs.receive_goods(t, r["req_receipts"]).state["warehouse_stock"],
        _stock("qty_on_hand", "SELECT product_id, warehouse_code AS warehouse, SUM(n) AS q FROM req_booked WHERE n > 0 GROUP BY ALL")),
    "receive_goods_ledger": (lambda t, r: _ledger(jobs.receive_goods(t, r["req_receipts"]).ledger), """
        SELECT 'stock_received' AS action, CAST(b.po_id AS VARCHAR) AS entity_id, CAST(b.warehouse_code AS VARCHAR) AS
          warehouse_code, CAST(b.product_id AS VARCHAR) AS product_id, b.n AS qty_change, CAST(ws.qty_on_hand + SUM(b.n) OVER
          (PARTITION BY b.product_id, b.warehouse_code ORDER BY b.requested_at, b.request_id, b.line_no
          ROWS UNBOUNDED PRECEDING) AS INT) AS balance_after, CONCAT('Received ', b.n, ' units via ', b.po_ref) AS notes
        FROM req_booked b JOIN wms_warehouse_stock ws ON ws.product_id = b.product_id AND ws.warehouse = b.warehouse_code
        WHERE b.n > 0"""),
    "create_transfers": (lambda t, r: jobs.create_transfers(t, r["req_transfers"], r["req_transfer_lines"]).accepted, f"""
        SELECT request_id AS id, {ref('TXF', 'wms_stock_transfers', 'transfer_ref', 'requested_at, request_id', 'y')}
          AS transfer_ref, from_warehouse, to_warehouse, 'requested' AS status, notes, requested_at AS created_at, n AS line_count
        FROM (SELECT r.*, CAST(YEAR(requested_at) AS VARCHAR) AS y, (SELECT COUNT(*) FROM req_transfer_lines l
          WHERE l.request_id = r.request_id) AS n FROM req_transfers r)
        WHERE from_warehouse IS NOT NULL AND from_warehouse <> to_warehouse AND n > 0"""),
    "eligible_backorders": (lambda t, r: jobs.eligible_backorders(t), "SELECT * RENAME (avail AS qty_available) FROM req_back_open"),
    "dispatch_transfers": (lambda t, r: jobs.dispatch_transfers(t, r["req_transfer_actions"]).accepted.drop("_hit"), """
        SELECT transfer_id AS id, 'in_transit' AS status, requested_at AS updated_at FROM req_dispatch_wanted
        WHERE transfer_id IN (SELECT id FROM req_dispatch_fold) OR transfer_id NOT IN (SELECT transfer_id FROM req_dispatch_need)"""),
    "dispatch_transfers_stock": (lambda t, r: jobs.dispatch_transfers(t, r["req_transfer_actions"]).state["warehouse_stock"],
        _stock("qty_on_hand", "SELECT l.product_id, s.from_warehouse AS warehouse, -SUM(l.qty) AS q FROM req_dispatch_fold f "
               "JOIN wms_stock_transfers s ON s.id = f.id JOIN wms_transfer_lines l ON l.transfer_id = f.id GROUP BY ALL")),
    "receive_transfers": (lambda t, r: jobs.receive_transfers(t, r["req_transfer_actions"]).state["warehouse_stock"],
        _stock("qty_on_hand", "SELECT l.product_id, s.to_warehouse AS warehouse, SUM(l.qty) AS q FROM wms_transfer_lines l "
               "JOIN wms_stock_transfers s ON s.id = l.transfer_id WHERE s.status = 'in_transit' GROUP BY ALL")),
    "advance_orders": (lambda t, r: jobs.advance_orders(t, r["req_order_actions"]).accepted.drop("_hit"), """
        SELECT o.id, CASE WHEN s.k IS NOT NULL THEN 'shipped' WHEN p.k IS NOT NULL THEN 'packing' ELSE 'picking' END
          AS fulfilment_status FROM wms_orders o LEFT JOIN req_pick i ON i.order_id = o.id
        LEFT JOIN req_pack p ON p.order_id = o.id LEFT JOIN req_ship s ON s.order_id = o.id
        WHERE i.k IS NOT NULL OR p.k IS NOT NULL OR s.k IS NOT NULL"""),
    "advance_orders_stock": (lambda t, r: jobs.advance_orders(t, r["req_order_actions"]).state["warehouse_stock"],
        _stock("qty_on_hand", "SELECT l.product_id, o.warehouse_code AS warehouse, -SUM(l.qty_ordered) AS q FROM req_ship s "
               "JOIN wms_orders o ON o.id = s.order_id JOIN wms_order_lines l ON l.order_id = o.id GROUP BY ALL")),
    "advance_orders_rejects": (lambda t, r: jobs.advance_orders(t, r["req_order_actions"]).rejects, """
        SELECT a.request_id, 'invalid_transition' AS error_code, CAST(a.order_id AS VARCHAR) AS detail FROM req_adv a
        LEFT JOIN req_pick i ON i.order_id = a.order_id AND a.action = 'pick' AND i.k = a.k
        LEFT JOIN req_pack p ON p.order_id = a.order_id AND a.action = 'pack' AND p.k = a.k
        LEFT JOIN req_ship s ON s.order_id = a.order_id AND a.action = 'ship' AND s.k = a.k
        WHERE i.k IS NULL AND p.k IS NULL AND s.k IS NULL"""),
    "review_decisions": (lambda t, r: jobs.review_decisions(t, r["req_reviews"], r["req_decisions"]).accepted.select(
        "line_id", "decision", "qty_to_ship", "qty_to_backorder", "over_requested", "overdrawn"), """
        SELECT id AS line_id, d AS decision, ship AS qty_to_ship, req - ship AS qty_to_backorder, ship > req AS over_requested,
          before < 0 AS overdrawn FROM req_review_fold WHERE id <> ''"""),
    "check_credit": (lambda t, r: jobs.check_credit(t, r["req_totals"]).accepted.select("request_id", "accepted"), """
        SELECT r.request_id, COALESCE(f.ok, TRUE) AS accepted FROM req_totals r LEFT JOIN req_credit f ON f.id = r.request_id"""),
    "create_orders": (lambda t, r: _new_orders(t, r).accepted, f"""
        SELECT request_id AS id, {ref('ORD', 'wms_orders', 'order_ref', 'requested_at, request_id', 'y')} AS order_ref,
          customer_id, '' AS customer_name, 'confirmed' AS status, 'confirmed' AS fulfilment_status, wh AS warehouse_code,
          'GBP' AS currency, CAST(1 AS DECIMAL(12,6)) AS fx_rate, total_gbp, NULL::VARCHAR AS notes, needs_review AS
          requires_review, requested_at AS created_at, line_count
        FROM (SELECT *, CAST(YEAR(requested_at) AS VARCHAR) AS y FROM req_new_taken)"""),
    "create_orders_lines": (lambda t, r: _new_orders(t, r).extra["lines"], """
        SELECT CONCAT(p.request_id, '-', p.line_no) AS id, p.request_id AS order_id, p.product_id, '' AS product_name, p.sku,
          p.qty AS qty_ordered, p.qty AS qty_requested, p.unit_price_gbp, p.wh AS warehouse_allocated,
          CASE WHEN n.needs_review THEN 'pending_review' ELSE 'unmatched' END AS fulfilment_status
        FROM req_new_priced p JOIN req_new_taken n ON n.request_id = p.request_id"""),
    "create_orders_rejects": (lambda t, r: _new_orders(t, r).rejects.drop("detail"), """
        SELECT CAST(request_id AS VARCHAR) AS request_id, CASE WHEN customer_id IS NULL THEN 'customer_id_required'
          ELSE 'lines_required' END AS error_code FROM req_new_orders WHERE request_id NOT IN (SELECT request_id FROM req_new_valid)
        UNION ALL SELECT CAST(request_id AS VARCHAR), 'moq_not_met' FROM req_new_moq
        UNION ALL SELECT CAST(id AS VARCHAR), 'credit_limit_exceeded' FROM req_new_credit WHERE NOT ok AND id >= 0"""),
    "allocate_backorders": (lambda t, r: jobs.allocate_backorders(t, NOW).accepted, """
        SELECT *, qty_backordered - qty_fulfilled AS remaining, CASE WHEN qty_backordered = qty_fulfilled THEN 'fulfilled'
          ELSE 'partial' END AS status FROM req_back WHERE qty_fulfilled > 0"""),
    "allocate_backorders_stock": (lambda t, r: jobs.allocate_backorders(t, NOW).state["warehouse_stock"],
        _stock("qty_reserved", "SELECT product_id, warehouse_code AS warehouse, SUM(qty_fulfilled) AS q FROM req_back GROUP BY ALL")),
    "adjust_stock": (lambda t, r: jobs.adjust_stock(t, r["req_adjustments"]).accepted, """
        SELECT id AS request_id, product_id, warehouse, n AS qty_change, after AS balance_after FROM req_adj WHERE i > 1"""),
    "adjust_stock_in_buckets": (_adjusted_in_buckets, """
        SELECT ws.product_id, ws.warehouse, COALESCE(x.after, ws.qty_on_hand) AS qty_on_hand FROM wms_warehouse_stock ws
        LEFT JOIN (SELECT product_id, warehouse, MAX_BY(after, i) AS after FROM req_adj WHERE i > 1 GROUP BY ALL) x
          ON x.product_id = ws.product_id AND x.warehouse = ws.warehouse"""),
    "adjust_stock_rejects": (lambda t, r: jobs.adjust_stock(t, r["req_adjustments"]).rejects.drop("detail"), """
        SELECT CAST(request_id AS VARCHAR) AS request_id, CASE WHEN product_id IS NULL THEN 'missing_fields'
          ELSE 'stock_record_not_found' END AS error_code FROM req_adjustments
        WHERE request_id NOT IN (SELECT request_id FROM req_adj_work)"""),
    "create_returns": (lambda t, r: jobs.create_returns(t, r["req_new_returns"]).accepted, f"""
        SELECT request_id AS id, {ref('RMA', 'wms_returns', 'rma_ref', 'requested_at, request_id', 'y')} AS rma_ref, order_id,
          customer_id, product_id, warehouse_code, CAST(qty AS INT) AS qty, reason, CASE action WHEN '' THEN 'restock'
          ELSE action END AS action, 'pending' AS status, requested_at AS created_at
        FROM (SELECT *, CAST(YEAR(requested_at) AS VARCHAR) AS y FROM req_new_returns)
        WHERE warehouse_code IS NOT NULL AND qty <> '0'"""),
    "process_returns": (lambda t, r: jobs.process_returns(t, r["req_return_actions"]).state["warehouse_stock"],
        _stock("qty_on_hand", "SELECT product_id, warehouse_code AS warehouse, SUM(qty) AS q FROM wms_returns "
               "WHERE status = 'pending' AND action = 'restock' GROUP BY ALL")),
    "returns_disposition": (lambda t, r: jobs.returns_disposition(t, NOW).accepted.drop("product_name", "sku"),
        "SELECT * EXCLUDE (created_at) FROM req_disposed"),
    "returns_disposition_ledger": (lambda t, r: _ledger(jobs.returns_disposition(t, NOW).ledger), """
        SELECT CASE action WHEN 'restock' THEN 'stock_returned' ELSE 'stock_written_off' END AS action, d.id AS entity_id,
          CAST(d.warehouse_code AS VARCHAR) AS warehouse_code, CAST(d.product_id AS VARCHAR) AS product_id,
          CASE action WHEN 'restock' THEN d.qty ELSE 0 END AS qty_change, CAST(CASE action WHEN 'restock' THEN ws.qty_on_hand
          + SUM(CASE action WHEN 'restock' THEN d.qty ELSE 0 END) OVER (PARTITION BY d.product_id, d.warehouse_code
          ORDER BY d.created_at, d.id ROWS UNBOUNDED PRECEDING) END AS INT) AS balance_after, CONCAT('Auto-', CASE action
          WHEN 'restock' THEN 'restocked ' ELSE 'written off ' END, d.qty, ' units via ', d.rma_ref, ' (', d.reason_code, ')')
          AS notes FROM req_disposed d JOIN wms_warehouse_stock ws ON ws.product_id = d.product_id
          AND ws.warehouse = d.warehouse_code"""),
    "ledger_append": (lambda t, r: _appended_ledger(t, r).groupBy("ledger_date", "action").agg(
        F.count("*").alias("n"), F.sum("qty_change").alias("q"), F.count_distinct("warehouse_code").alias("w")), """
        SELECT DATE '2002-01-01' AS ledger_date, CASE action WHEN 'restock' THEN 'stock_returned' ELSE 'stock_written_off' END
          AS action, COUNT(*) AS n, CAST(SUM(CASE action WHEN 'restock' THEN qty ELSE 0 END) AS BIGINT) AS q,
          COUNT(DISTINCT warehouse_code) AS w FROM req_disposed GROUP BY ALL"""),
    "audit_search_by_day": (lambda t, r: _search_by_day(t), READS["audit_search"][1]),
    "assign_refs": (lambda t, r: jobs.assign_refs(
        t.orders.select("id", "created_at"), t.purchase_orders, "po_ref", "PO", F.year("created_at"),
        [F.col("created_at"), F.col("id")]), f"""
        SELECT id, created_at, {ref('PO', 'wms_purchase_orders', 'po_ref', 'created_at, id', 'y')} AS po_ref
        FROM (SELECT id, created_at, CAST(YEAR(created_at) AS VARCHAR) AS y FROM wms_orders)"""),
    "disposition_summary": (lambda t, r: jobs.returns_disposition(t, NOW).extra["summary"], """
        SELECT COUNT(*) AS total_processed, COUNT(*) FILTER (WHERE action = 'restock') AS restocked,
          COUNT(*) FILTER (WHERE action = 'write_off') AS written_off FROM req_disposed"""),
    "auto_reorder": (lambda t, r: jobs.auto_reorder(t, ASOF).accepted.drop("id", "created_at"), f"""
        SELECT {ref('PO', 'wms_purchase_orders', 'po_ref', 'warehouse_code, supplier_id', 'y')} AS po_ref, g.supplier_id,
          s.name AS supplier_name, g.warehouse_code, 'draft' AS status, g.n AS line_count,
          CONCAT('Auto-generated reorder for ', g.n, ' low-stock items') AS notes
        FROM (SELECT warehouse_code, supplier_id, COUNT(*) AS n, '2001' AS y FROM req_auto GROUP BY ALL) g
        LEFT JOIN wms_suppliers s ON s.id = g.supplier_id"""),
    "auto_reorder_lines": (lambda t, r: jobs.auto_reorder(t, ASOF).extra["lines"].drop("id", "po_id"), """
        SELECT product_id, qty_ordered, 0 AS qty_received, unit_cost_gbp FROM req_auto"""),
    "abc_apply": (lambda t, r: jobs.abc_apply(t).state["products"], """
        SELECT p.* REPLACE (a.abc_class AS abc_class) FROM wms_products p JOIN req_abc a ON a.id = p.id"""),
    "schedule_cycle_counts": (lambda t, r: jobs.schedule_cycle_counts(t, ASOF).accepted, f"""
        SELECT CONCAT('abc-20010801-', code) AS id, {ref('CC', 'wms_cycle_counts', 'count_ref', 'code', 'y')} AS count_ref,
          code AS warehouse_code, 'brand' AS scope, 'A' AS scope_filter,
          'Auto-scheduled ABC count: classes A (week 30)' AS notes, DATE '2001-08-01' AS planned_date, 'planned' AS status,
          TIMESTAMP '2001-08-01' AS created_at, (SELECT COUNT(*) FROM wms_warehouse_stock ws JOIN wms_products p
            ON p.id = ws.product_id WHERE ws.warehouse = code AND p.abc_class = 'A') AS line_count
        FROM (SELECT code, '2001' AS y FROM wms_warehouses) WHERE code NOT IN (SELECT warehouse_code FROM wms_cycle_counts
          WHERE status IN ('planned', 'in_progress') AND created_at >= TIMESTAMP '2001-07-27')"""),
    "create_cycle_counts": (lambda t, r: jobs.create_cycle_counts(t, r["req_counts"]).extra["lines"].groupBy(
        "cycle_count_id").agg(F.count("*").alias("n"), F.count_distinct("warehouse_stock_id").alias("d")), """
        SELECT c.request_id AS cycle_count_id, CASE c.scope WHEN 'random' THEN LEAST(20, COUNT(*)) ELSE COUNT(*) END AS n,
          CASE c.scope WHEN 'random' THEN LEAST(20, COUNT(*)) ELSE COUNT(*) END AS d
        FROM req_counts c JOIN wms_warehouse_stock ws ON ws.warehouse = c.warehouse_code
        JOIN wms_products p ON p.id = ws.product_id WHERE CASE c.scope WHEN 'brand' THEN p.brand = c.scope_filter
          WHEN 'zone' THEN ws.location LIKE c.scope_filter || '%' ELSE TRUE END GROUP BY c.request_id, c.scope"""),
    "start_counts": (lambda t, r: jobs.start_counts(t, r["req_count_actions"]).state["cycle_counts"], """
        SELECT * REPLACE (CASE status WHEN 'planned' THEN 'in_progress' ELSE status END AS status,
          CASE status WHEN 'planned' THEN TIMESTAMP '2002-01-01' ELSE updated_at END AS updated_at) FROM wms_cycle_counts"""),
    "record_counts": (lambda t, r: jobs.record_counts(t, r["req_recordings"]).accepted.drop("_hit"), """
        SELECT id, CAST(qty_on_hand + CASE product_id % 5 WHEN 2 THEN 0 ELSE 1 END AS INT) AS counted_qty,
          CAST(CASE product_id % 5 WHEN 2 THEN 0 ELSE 1 END AS INT) AS variance, NULL::VARCHAR AS notes,
          TIMESTAMP '2002-01-01' AS counted_at FROM wms_warehouse_stock WHERE warehouse <> 4 AND product_id % 5 >= 2"""),
    "complete_cycle_counts": (lambda t, r: jobs.complete_cycle_counts(t, r["req_count_actions"]).state["warehouse_stock"], """
        SELECT ws.* REPLACE (COALESCE(l.counted_qty, ws.qty_on_hand) AS qty_on_hand) FROM wms_warehouse_stock ws
        LEFT JOIN wms_cycle_count_lines l ON l.warehouse_stock_id = ws.id AND l.counted_qty IS NOT NULL AND l.variance <> 0
          AND l.cycle_count_id IN (SELECT id FROM wms_cycle_counts WHERE status = 'in_progress')"""),
    "update_lead_times": (lambda t, r: update_lead_times(t, NOW).accepted, """
        SELECT *, new_lead_time <> promised_days AS adjusted FROM (SELECT *, CASE WHEN po_count >= 2 AND ABS(avg_actual_days -
          promised_days) > 0.2 * promised_days THEN CAST(CEIL((7 * avg_actual_days + 3 * promised_days) / 10.0) AS INT)
          ELSE promised_days END AS new_lead_time FROM req_lead)"""),
    "ingest_invoices": (lambda t, r: _invoices(t, r).extra["lines"].select(
        "invoice_id", "id", "product_id", "sku", "quantity", "fulfilment_status", "qty_fulfilled", "qty_backordered"), """
        SELECT request_id AS invoice_id, CONCAT(request_id, '-', line_no) AS id, product_id, sku, qty AS quantity,
          status AS fulfilment_status, CAST(got AS INT) AS qty_fulfilled, CAST(qty - got AS INT) AS qty_backordered FROM req_inv_served"""),
    "ingest_invoices_customers": (lambda t, r: _invoices(t, r).state["customers"].select("id", "company_name", "region"), """
        WITH x AS (SELECT customer_name, MAX(known_id) AS known_id, ARG_MIN(request_id, (requested_at, request_id)) AS new_id,
          ARG_MAX(region, (requested_at, request_id)) FILTER (WHERE region IS NOT NULL) AS region FROM req_inv_ok GROUP BY ALL)
        SELECT c.id, c.company_name, COALESCE(x.region, c.region) AS region FROM wms_customers c
        LEFT JOIN x ON x.known_id = c.id
        UNION ALL SELECT new_id, customer_name, region FROM x WHERE known_id IS NULL"""),
    "ingest_invoices_rejects": (lambda t, r: _invoices(t, r).rejects.drop("detail"), """
        SELECT CAST(request_id AS VARCHAR) AS request_id, CASE WHEN request_id IN (SELECT request_id FROM req_inv_valid)
          THEN 'duplicate_invoice' ELSE 'lines_required' END AS error_code FROM req_new_invoices
        WHERE request_id NOT IN (SELECT request_id FROM req_inv_ok)"""),
}
