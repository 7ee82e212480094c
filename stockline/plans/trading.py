"""Orders, purchasing, transfers, returns, counts, customers and invoices.

Detail queries return one row per line with the header's columns repeated:
nothing is gathered per header, so a header with very many lines stays spread
over the cluster.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from stockline.functions import MONEY, available, matches, moment, money, month, units
from stockline.operators.joins import SLICE_ROWS, growing, in_slices
from stockline.tables import Tables

# Order of the fulfilment stages.
STAGES = ("confirmed", "picking", "picked", "packing", "packed", "shipped")


def stage_rank(c: str = "fulfilment_status") -> Column:
    rank = F.when(F.lit(False), 0)
    for i, stage in enumerate(STAGES, start=1):
        rank = rank.when(F.col(c) == stage, i)
    return rank.otherwise(len(STAGES) + 1)


def default_asof(t: Tables) -> Column:
    """The latest order time, used where the reference asks the clock."""
    return t.orders.select(F.max("created_at")).scalar()


def _asof(t: Tables, asof) -> Column:
    return default_asof(t) if asof is None else moment(asof)


def _named_products(t: Tables, *extra: str) -> DataFrame:
    return t.products.select(
        F.col("id").alias("product_id"), F.col("name").alias("product_name"), "sku", "brand", *extra
    )


def _by_id(df: DataFrame, column: str, value) -> DataFrame:
    return df if value is None else df.where(F.col(column) == F.lit(value))


# -- purchasing --------------------------------------------------------------

def po_summary(t: Tables, status: str = "", ordered: bool = False) -> DataFrame:
    """Purchase orders with supplier, line count, units and cost; zeros without lines."""
    headers = t.purchase_orders if not status else t.purchase_orders.where(F.col("status") == status)
    lines = t.po_lines.groupBy("po_id").agg(
        F.count("*").alias("line_count"), units("qty_ordered").alias("total_ordered"),
        units("qty_received").alias("total_received"),
        money(F.col("qty_ordered") * F.col("unit_cost_gbp")).alias("total_cost_gbp"),
    )
    suppliers = t.suppliers.select(F.col("id").alias("supplier_id"), F.col("name").alias("supplier_name"))
    out = (
        headers.join(lines, F.col("id") == F.col("po_id"), "left")
        .join(suppliers, "supplier_id", "left")
        .select(
            "id", "po_ref", "supplier_id", "supplier_name", "warehouse_code", "status", "created_at", "submitted_at",
            "received_at", "notes", "updated_at",
            *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
              for c in ("line_count", "total_ordered", "total_received")],
            F.coalesce("total_cost_gbp", F.lit(0)).cast(MONEY).alias("total_cost_gbp"),
        )
    )
    return out.orderBy(F.desc("created_at"), F.desc("id")) if ordered else out


def po_detail(t: Tables, po_id=None, ordered: bool = False) -> DataFrame:
    """Purchase orders with supplier, lines and products; an order without lines is one row without line columns."""
    headers = _by_id(t.purchase_orders, "id", po_id).withColumnRenamed("id", "po_id")
    lines = _by_id(t.po_lines, "po_id", po_id).withColumnRenamed("id", "line_id")
    suppliers = t.suppliers.select(F.col("id").alias("supplier_id"), F.col("name").alias("supplier_name"))
    out = (
        headers.join(lines, "po_id", "left")
        .join(suppliers, "supplier_id", "left")
        .join(_named_products(t), "product_id", "left")
        .select(
            "po_id", "po_ref", "supplier_id", "supplier_name", "warehouse_code", "status", "notes", "created_at",
            "submitted_at", "received_at", "updated_at", "line_id", "product_id", "product_name",
            "sku", "brand", "qty_ordered", "qty_received", "unit_cost_gbp",
        )
    )
    return out.orderBy("po_id", "brand", "product_name", "line_id") if ordered else out


# -- transfers ---------------------------------------------------------------

def transfer_summary(t: Tables, ordered: bool = False) -> DataFrame:
    lines = t.transfer_lines.groupBy("transfer_id").agg(
        F.count("*").alias("line_count"), units("qty").alias("total_units")
    )
    out = t.stock_transfers.join(lines, F.col("id") == F.col("transfer_id"), "left").select(
        "id", "transfer_ref", "from_warehouse", "to_warehouse", "status", "notes", "created_at", "updated_at",
        F.coalesce("line_count", F.lit(0)).cast("bigint").alias("line_count"),
        F.coalesce("total_units", F.lit(0)).cast("bigint").alias("total_units"),
    )
    return out.orderBy(F.desc("created_at"), F.desc("id")) if ordered else out


def transfer_detail(t: Tables, transfer_id=None, ordered: bool = False) -> DataFrame:
    """Transfers with lines and products; a transfer without lines is one row without line columns."""
    headers = _by_id(t.stock_transfers, "id", transfer_id).withColumnRenamed("id", "transfer_id")
    lines = _by_id(t.transfer_lines, "transfer_id", transfer_id).withColumnRenamed("id", "line_id")
    out = (
        headers.join(lines, "transfer_id", "left")
        .join(_named_products(t), "product_id", "left")
        .select(
            "transfer_id", "transfer_ref", "from_warehouse", "to_warehouse", "status", "notes", "created_at",
            "updated_at", "line_id", "product_id", "product_name", "sku", "brand", "qty",
        )
    )
    return out.orderBy("transfer_id", "brand", "product_name", "line_id") if ordered else out


def kpi_transfers(t: Tables) -> DataFrame:
    """Transfer KPIs as the reference shows them: the counts are of transfer lines.

    A transfer without lines counts once, one with n lines counts n times. The
    lines are folded per transfer first, so the join moves one row per transfer.
    """
    lines = t.transfer_lines.groupBy("transfer_id").agg(F.count("*").alias("n"), F.sum("qty").alias("qty"))
    joined = t.stock_transfers.select("id", "status").join(lines, F.col("id") == F.col("transfer_id"), "left")
    weight = F.coalesce("n", F.lit(1))
    return joined.agg(
        units(F.when(F.col("status") == "in_transit", weight)).alias("in_transit"),
        units(F.when(F.col("status") == "requested", weight)).alias("pending"),
        units(F.when(F.col("status") == "in_transit", F.col("qty"))).alias("units_in_transit"),
    )


def kpi_transfers_distinct(t: Tables) -> DataFrame:
    """The same KPIs counting each transfer once."""
    lines = t.transfer_lines.groupBy("transfer_id").agg(F.sum("qty").alias("qty"))
    joined = t.stock_transfers.select("id", "status").join(lines, F.col("id") == F.col("transfer_id"), "left")
    return joined.agg(
        F.count_if(F.col("status") == "in_transit").alias("in_transit"),
        F.count_if(F.col("status") == "requested").alias("pending"),
        units(F.when(F.col("status") == "in_transit", F.col("qty"))).alias("units_in_transit"),
    )


# -- orders ------------------------------------------------------------------

def _line_totals(t: Tables) -> DataFrame:
    return t.order_lines.groupBy("order_id").agg(
        F.count("*").alias("line_count"), units("qty_ordered").alias("total_units"),
        money(F.col("qty_ordered") * F.col("unit_price_gbp")).alias("total_value"),
    )


def fulfilment_stages(t: Tables, status: str = "", ordered: bool = False) -> DataFrame:
    """Orders with line count and units, by stage and then by age."""
    headers = t.orders if not status else t.orders.where(F.col("fulfilment_status") == status)
    lines = _line_totals(t).select("order_id", "line_count", "total_units")
    out = headers.join(lines, F.col("id") == F.col("order_id"), "left").select(
        "id", "order_ref", "customer_name", "status", "fulfilment_status", "warehouse_code", "currency", "total_gbp",
        "created_at",
        F.coalesce("line_count", F.lit(0)).cast("bigint").alias("line_count"),
        F.coalesce("total_units", F.lit(0)).cast("bigint").alias("total_units"),
        stage_rank().alias("stage_rank"),
    )
    return out.orderBy("stage_rank", "created_at", "id") if ordered else out


def order_totals(t: Tables) -> DataFrame:
    """Units and value of each order's lines and its position among the stages (-1 if unknown)."""
    index = F.when(stage_rank() <= len(STAGES), stage_rank() - 1).otherwise(-1)
    return t.orders.join(_line_totals(t), F.col("id") == F.col("order_id"), "left").select(
        "id", "order_ref",
        F.coalesce("total_units", F.lit(0)).cast("bigint").alias("total_units"),
        F.coalesce("total_value", F.lit(0)).cast(MONEY).alias("total_value_gbp"),
        index.alias("stage_index"),
    )


def packing_slip(t: Tables, order_id=None, ordered: bool = False) -> DataFrame:
    """Order lines with the whole header, customer and brand, for one order or all."""
    headers = _by_id(t.orders, "id", order_id).withColumnsRenamed(
        {"id": "order_id", "fulfilment_status": "order_fulfilment_status"}
    )
    customers = t.customers.select(F.col("id").alias("customer_id"), "company_name", "billing_address", "email")
    brands = t.products.select(F.col("id").alias("product_id"), "brand")
    lines = _by_id(t.order_lines, "order_id", order_id).withColumnRenamed("id", "line_id")
    if order_id is None:
        customers, brands = growing(customers), growing(brands)
    # Each side takes its names before the two meet, so that no row of header and line is shuffled.
    out = (
        headers.join(customers, "customer_id", "left")
        .join(lines.join(brands, "product_id", "left"), "order_id", "left")
        .select(
            *headers.columns, "company_name", "billing_address", "email",
            *[c for c in lines.columns if c != "order_id"], "brand",
        )
    )
    return out.orderBy("order_id", "brand", "product_name", "line_id") if ordered else out


def review_queue(t: Tables, ordered: bool = False) -> DataFrame:
    """Lines of orders awaiting review with what is available for each now (0 without a stock row)."""
    headers = t.orders.where("requires_review").select(
        F.col("id").alias("order_id"), "order_ref", "customer_id", "customer_name", "warehouse_code", "currency",
        "total_gbp", "created_at", "notes",
    )
    customers = t.customers.select(F.col("id").alias("customer_id"), "company_name")
    lines = t.order_lines.select(
        F.col("id").alias("line_id"), "order_id", "product_id", "product_name", "sku",
        F.coalesce("qty_requested", "qty_ordered").alias("qty_requested"), "qty_ordered", "unit_price_gbp",
        "fulfilment_decision", "qty_to_ship", "qty_to_backorder",
    )
    stock = t.warehouse_stock.select(
        "product_id", F.col("warehouse").alias("warehouse_code"), available().alias("avail")
    )
    out = (
        headers.join(lines, "order_id")
        .join(customers, "customer_id", "left")
        .join(growing(stock), ["product_id", "warehouse_code"], "left")
        .select(
            "order_id", "order_ref", "customer_name", "company_name", "warehouse_code", "currency", "total_gbp",
            "created_at", "notes", "line_id", "product_id", "product_name", "sku", "qty_requested", "qty_ordered",
            "unit_price_gbp", "fulfilment_decision", "qty_to_ship", "qty_to_backorder",
            F.coalesce("avail", F.lit(0)).alias("qty_available"),
        )
    )
    return out.orderBy("created_at", "order_id", "product_name", "line_id") if ordered else out


def review_issue_counts(t: Tables) -> DataFrame:
    """Lines short of stock per order under review."""
    need = F.coalesce(F.nullif(F.col("qty_requested"), F.lit(0)), F.col("qty_ordered"))
    return review_queue(t).groupBy("order_id", "order_ref").agg(
        F.count("*").alias("lines"), F.count_if(F.col("qty_available") < need).alias("short_lines")
    )


def kpi_orders(t: Tables) -> DataFrame:
    s = F.col("fulfilment_status")
    return t.orders.agg(
        F.count_if(s == "confirmed").alias("pending"),
        F.count_if(s.isin("picking", "picked", "packing", "packed")).alias("in_progress"),
        F.count_if(s == "shipped").alias("shipped"),
        money(F.when(s == "shipped", F.col("total_gbp"))).alias("revenue_shipped"),
    )


def orders_by_month(t: Tables, asof=None) -> DataFrame:
    """Orders and revenue per month over the six months before ``asof``."""
    since = _asof(t, asof) - F.expr("INTERVAL '6' MONTH")
    return (
        t.orders.where(F.col("created_at") >= since)
        .groupBy(month("created_at").alias("month"))
        .agg(F.count("*").alias("order_count"), money(F.col("total_gbp")).alias("revenue"))
        .orderBy("month")
    )


def top_products(t: Tables, n: int = 10) -> DataFrame:
    """The n products with most units ordered; a product never ordered counts as zero."""
    sold = t.order_lines.groupBy("product_id").agg(F.sum("qty_ordered").alias("qty"))
    return (
        t.products.join(sold, F.col("id") == F.col("product_id"), "left")
        .select("id", "name", "sku", F.coalesce("qty", F.lit(0)).cast("bigint").alias("total_ordered"))
        .orderBy(F.desc("total_ordered"), "id")
        .limit(n)
    )


# -- customers ---------------------------------------------------------------

def customer_spend(t: Tables, search: str = "", customer_id=None) -> DataFrame:
    """Customers with order count, spend and available credit (NULL without a limit)."""
    customers = _by_id(t.customers, "id", customer_id)
    if search:
        customers = customers.where(matches(search, "company_name"))
    spend = t.orders.groupBy("customer_id").agg(
        F.count("*").alias("n"), F.sum("total_gbp").cast(MONEY).alias("spend")
    )
    limit, used = F.col("credit_limit_gbp"), F.col("credit_used_gbp")
    return customers.join(spend, F.col("id") == F.col("customer_id"), "left").select(
        "id", "company_name", "contact_name", "email", "billing_address", "currency_preference", "vat_number", "notes",
        "region", "customer_type", "payment_terms", "credit_limit_gbp",
        "credit_used_gbp", "default_discount_pct",
        F.coalesce("n", F.lit(0)).cast("bigint").alias("order_count"),
        F.coalesce("spend", F.lit(0)).cast(MONEY).alias("total_spend_gbp"),
        F.when(limit > 0, (limit - used).cast(MONEY)).alias("credit_available_gbp"),
    )


def customer_orders(t: Tables, customer_id=None, ordered: bool = False) -> DataFrame:
    """Orders of one customer (or of all) with units and line count."""
    lines = _line_totals(t).select("order_id", "line_count", "total_units")
    out = _by_id(t.orders, "customer_id", customer_id).join(lines, F.col("id") == F.col("order_id"), "left").select(
        "customer_id", "id", "order_ref", "status", "currency", "total_gbp", "created_at",
        F.coalesce("total_units", F.lit(0)).cast("bigint").alias("total_units"),
        F.coalesce("line_count", F.lit(0)).cast("bigint").alias("line_count"),
    )
    return out.orderBy(F.desc("created_at"), F.desc("id")) if ordered else out


def credit_usage(t: Tables) -> DataFrame:
    """Used share of each credit limit with its band, and the customer list's 80 % flag."""
    limit = F.coalesce("credit_limit_gbp", F.lit(0))
    used = F.coalesce("credit_used_gbp", F.lit(0))
    pct = F.when(limit > 0, F.round(used.cast("decimal(20,6)") / F.nullif(limit, F.lit(0)) * 100)).otherwise(0)
    return t.customers.select(
        "id", "company_name", (limit - used).cast(MONEY).alias("credit_available_gbp"),
        pct.cast("bigint").alias("credit_used_pct"),
        F.when(pct > 80, "high").when(pct > 60, "medium").otherwise("low").alias("credit_band"),
        (used > limit * F.lit("0.8").cast("decimal(3,2)")).alias("over_80_pct"),
    )


# -- returns and counts ------------------------------------------------------

def returns_list(t: Tables, ordered: bool = False, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Returns with the order's reference and the names of customer and product.

    Only the three keys travel from one table of names to the next; a return's row is shuffled once, to meet what
    its keys have found. More than ``slice_rows`` returns are listed slice by slice, each with all rows of its keys,
    so that the disk holds the shuffles of one slice at a time; all slices but the last are staged.
    """
    keys = ["order_id", "customer_id", "product_id"]
    out = in_slices(t.returns, keys, slice_rows, lambda some: _named_returns(t, some, keys), "returns-list")
    return out.orderBy(F.desc("created_at"), F.desc("id")) if ordered else out


def _named_returns(t: Tables, returns: DataFrame, keys: list[str]) -> DataFrame:
    orders = t.orders.select(F.col("id").alias("order_id"), "order_ref")
    customers = t.customers.select(
        F.col("id").alias("customer_id"), F.col("company_name").alias("customer_name")
    )
    named = (
        returns.select(*keys).distinct()
        .join(growing(orders), "order_id", "left")
        .join(growing(customers), "customer_id", "left")
        .join(growing(_named_products(t)), "product_id", "left")
        .withColumnsRenamed({k: f"_{k}" for k in keys})
    )
    met = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return returns.join(growing(named), met).select(
        "id", "rma_ref", "order_id", "order_ref", "customer_id", "customer_name", "product_id", "product_name",
        "sku", "brand", "warehouse_code", "qty", "reason", "reason_code", "action", "status", "created_at",
    )


def cycle_count_summary(t: Tables) -> DataFrame:
    lines = t.cycle_count_lines.groupBy("cycle_count_id").agg(
        F.count("*").alias("total_lines"), F.count("counted_qty").alias("counted_lines")
    )
    return (
        t.cycle_counts.join(lines, F.col("id") == F.col("cycle_count_id"), "left")
        .select(
            "id", "count_ref", "warehouse_code", "scope", "scope_filter", "notes", "status", "planned_date",
            "created_at", "updated_at", "completed_at",
            F.coalesce("total_lines", F.lit(0)).cast("bigint").alias("total_lines"),
            F.coalesce("counted_lines", F.lit(0)).cast("bigint").alias("counted_lines"),
        )
        .orderBy(F.desc("created_at"), F.desc("id"))
    )


def cycle_count_detail(t: Tables, count_id=None, ordered: bool = False) -> DataFrame:
    """Counts with lines and products; a count without lines is one row without line columns."""
    headers = _by_id(t.cycle_counts, "id", count_id).withColumnRenamed("id", "cycle_count_id")
    lines = _by_id(t.cycle_count_lines, "cycle_count_id", count_id).withColumnsRenamed({"id": "line_id", "notes": "line_notes"})
    named = lines.join(growing(_named_products(t)), "product_id", "left")
    # An outer join would gather all lines of a count in one task, or broadcast the lines.
    empty = headers.join(lines.select("cycle_count_id").distinct(), "cycle_count_id", "left_anti")
    out = named.join(headers, "cycle_count_id").unionByName(empty, allowMissingColumns=True).select(
        "cycle_count_id", "count_ref", "warehouse_code", "scope", "scope_filter", "notes", "planned_date", "status",
        "created_at", "updated_at", "completed_at", "line_id", "counted_at", "line_notes", "product_id", "product_name", "sku",
        "brand", "location", "expected_qty", "counted_qty", "variance",
    )
    return out.orderBy("cycle_count_id", "brand", "product_name", "line_id") if ordered else out


def cycle_count_progress(t: Tables) -> DataFrame:
    """Counted share, discrepancies and total variance per count, and whether it can be completed."""
    lines = t.cycle_count_lines.groupBy("cycle_count_id").agg(
        F.count("*").alias("total"), F.count("counted_qty").alias("counted"),
        F.count_if(F.col("counted_qty") != F.col("expected_qty")).alias("discrepancies"),
        units(F.abs("variance")).alias("total_variance"),
    )
    total, counted = F.coalesce("total", F.lit(0)), F.coalesce("counted", F.lit(0))
    pct = F.when(total > 0, F.round(counted.cast("decimal(20,6)") / F.nullif(total, F.lit(0)) * 100)).otherwise(0)
    return t.cycle_counts.join(lines, F.col("id") == F.col("cycle_count_id"), "left").select(
        "id", "count_ref", "status", counted.alias("counted_lines"), total.alias("total_lines"),
        pct.cast("bigint").alias("progress_pct"),
        F.coalesce("discrepancies", F.lit(0)).cast("bigint").alias("discrepancies"),
        F.coalesce("total_variance", F.lit(0)).cast("bigint").alias("total_variance"),
        ((F.col("status") == "in_progress") & (counted == total)).alias("completable"),
    )


# -- invoices ----------------------------------------------------------------

def backorder_list(t: Tables, ordered: bool = False) -> DataFrame:
    """Short invoice lines with their customer's lifetime spend, by SKU and then by spend."""
    short = t.invoice_lines.where(F.col("fulfilment_status").isin("backordered", "partial")).select(
        F.col("id").alias("line_id"), "invoice_id", "sku", "description", "quantity", "qty_fulfilled",
        "qty_backordered", "fulfilment_status", "trade_price_gbp", F.col("created_at").alias("line_created_at"),
    )
    invoices = t.invoices.select(
        F.col("id").alias("invoice_id"), "customer_id", "order_number", "invoice_date"
    )
    spend = t.invoices.groupBy("customer_id").agg(F.sum("total_value_gbp").alias("spend"))
    customers = (
        t.customers.select(F.col("id").alias("customer_id"), "company_name", "region")
        .join(spend, "customer_id", "left")
    )
    out = (
        short.join(invoices, "invoice_id")
        .join(customers, "customer_id", "left")
        .withColumn("customer_total_spend", F.coalesce("spend", F.lit(0)).cast(MONEY))
        .drop("spend")
    )
    return out.orderBy("sku", F.desc("customer_total_spend"), "line_id") if ordered else out


def invoice_totals(t: Tables) -> DataFrame:
    return t.invoices.agg(
        F.count("*").alias("total_invoices"), money(F.col("total_value_gbp")).alias("total_revenue"),
        units("total_units").alias("total_units"),
        F.min("invoice_date").alias("earliest_date"), F.max("invoice_date").alias("latest_date"),
    )


def _invoice_skus(t: Tables) -> DataFrame:
    return t.invoice_lines.groupBy("sku", "description").agg(
        units("quantity").alias("total_units"), money(F.col("subtotal_gbp")).alias("total_revenue"),
        F.count_distinct("invoice_id").alias("invoice_count"),
    )


def top_invoice_skus(t: Tables, n: int = 10) -> DataFrame:
    return _invoice_skus(t).orderBy(F.desc("total_units"), "sku", "description").limit(n)


def bottom_invoice_skus(t: Tables, n: int = 10) -> DataFrame:
    return _invoice_skus(t).orderBy("total_units", "sku", "description").limit(n)


def invoice_revenue_by_month(t: Tables) -> DataFrame:
    return (
        t.invoices.groupBy(month("invoice_date").alias("month"))
        .agg(
            money(F.col("total_value_gbp")).alias("revenue"), units("total_units").alias("units"),
            F.count("*").alias("invoice_count"),
        )
        .orderBy("month")
    )


def customer_invoice_breakdown(t: Tables) -> DataFrame:
    """Customers with at least one invoice, by revenue."""
    per_customer = t.invoices.groupBy("customer_id").agg(
        F.count("*").alias("invoice_count"), money(F.col("total_value_gbp")).alias("total_revenue"),
        units("total_units").alias("total_units"),
    )
    customers = t.customers.select(F.col("id").alias("customer_id"), "company_name", "region")
    return per_customer.join(customers, "customer_id").orderBy(F.desc("total_revenue"), "customer_id")


def warehouse_mismatch(t: Tables, regions: Sequence = ("uk", "us")) -> DataFrame:
    """SKUs invoiced into a region whose own warehouse holds none; a missing stock row counts as none.

    (sku, region) pairs are made distinct before products and stock are joined.
    """
    customers = t.customers.where(F.col("region").isin(list(regions))).select(
        F.col("id").alias("customer_id"), F.col("region").alias("customer_region")
    )
    sold = (
        t.invoice_lines.select("invoice_id", "sku", "description")
        .join(t.invoices.select(F.col("id").alias("invoice_id"), "customer_id"), "invoice_id")
        .join(customers, "customer_id")
        .select("sku", "description", "customer_region")
        .distinct()
    )
    products = t.products.select("sku", F.col("id").alias("product_id"))
    stock = t.warehouse_stock.select(
        "product_id", F.col("warehouse").alias("customer_region"), F.col("qty_on_hand").alias("region_stock")
    )
    return (
        sold.join(products, "sku", "left")
        .join(stock, ["product_id", "customer_region"], "left")
        .where(F.coalesce("region_stock", F.lit(0)) == 0)
        .select("sku", "description", "customer_region", F.lit(0).alias("region_stock"))
        .distinct()
    )
