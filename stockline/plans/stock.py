"""Stock queries: levels, valuation, comparison between warehouses, alerts.

``ordered=True`` on a listing adds the screen order of the reference at the
price of one range shuffle; aggregates over a dimension are always ordered.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from stockline.functions import (
    MONEY, available, cell_status, contains_ci, is_low, margin_pct, matches, money, status_rank, stock_status, units,
)
from stockline.operators.joins import growing
from stockline.tables import Tables


def _stock_products(t: Tables, *product_columns: str) -> DataFrame:
    """Stock rows with the named product columns; products without stock rows do not appear."""
    products = t.products.select(F.col("id").alias("product_id"), *product_columns)
    return t.warehouse_stock.join(growing(products), "product_id")


def _stock_by(t: Tables) -> DataFrame:
    """Per-warehouse aggregates over stock and cost price, the common base of the dashboards."""
    value = F.col("qty_on_hand") * F.col("cost_price_gbp")
    return _stock_products(t, "cost_price_gbp").groupBy("warehouse").agg(
        F.count("*").alias("rows"),
        F.sum("qty_on_hand").alias("units"),
        F.sum(value).cast(MONEY).alias("value"),
        F.count_if(is_low()).alias("low"),
        F.count_if(F.col("qty_on_hand") == 0).alias("out"),
    )


def warehouse_summary(t: Tables) -> DataFrame:
    """Per warehouse: products, units, cost value and low-stock rows; zeros for an empty warehouse."""
    s = _stock_by(t)
    return (
        t.warehouses.join(s, F.col("code") == F.col("warehouse"), "left")
        .select(
            "code", "name", "currency",
            F.coalesce("rows", F.lit(0)).cast("bigint").alias("total_products"),
            F.coalesce("units", F.lit(0)).cast("bigint").alias("total_units"),
            F.coalesce("value", F.lit(0)).cast(MONEY).alias("stock_value_gbp"),
            F.coalesce("low", F.lit(0)).cast("bigint").alias("low_stock_count"),
        )
        .orderBy("code")
    )


def stock_status_list(
    t: Tables, warehouse=None, search: str = "", status: str = "", ordered: bool = False
) -> DataFrame:
    """Stock of one warehouse (or all) with availability and status; ``status`` is low, out or healthy."""
    stock = t.warehouse_stock
    if warehouse is not None:
        stock = stock.where(F.col("warehouse") == F.lit(warehouse))
    conditions = {
        "low": is_low() & (F.col("qty_on_hand") > 0),
        "out": F.col("qty_on_hand") == 0,
        "healthy": F.col("qty_on_hand") > F.col("reorder_point"),
    }
    if status:
        stock = stock.where(conditions[status]) if status in conditions else stock.where(F.lit(False))
    products = t.products
    if search:
        products = products.where(matches(search, "name", "sku", "brand"))
    products = products.select(
        F.col("id").alias("product_id"), "name", "sku", "barcode", "brand", "cost_price_gbp", "sell_price_gbp",
        "case_pack", "moq",
    )
    out = stock.join(growing(products), "product_id").select(
        F.col("id").alias("stock_id"), "warehouse", "qty_on_hand", "qty_reserved",
        available().alias("qty_available"), "reorder_point", "max_stock", "location",
        "product_id", "name", "sku", "barcode", "brand", "cost_price_gbp", "sell_price_gbp", "case_pack", "moq",
        stock_status().alias("stock_status"),
    )
    if ordered:
        out = out.orderBy(status_rank(), F.col("brand").asc_nulls_last(), "name", "stock_id")
    return out


def inventory_nested(t: Tables, ordered: bool = False) -> DataFrame:
    """Per product the array of its stock rows, at most one per warehouse; empty array if none."""
    per_product = t.warehouse_stock.groupBy("product_id").agg(
        F.sort_array(
            F.collect_list(F.struct("warehouse", "qty_on_hand", "qty_reserved", "reorder_point"))
        ).alias("warehouse_stock")
    )
    out = (
        t.products.join(per_product, F.col("id") == F.col("product_id"), "left")
        .select(
            "id", "name", "sku", "barcode", "brand", "cost_price_gbp", "sell_price_gbp",
            F.coalesce("warehouse_stock", F.array()).alias("warehouse_stock"),
        )
    )
    return out.orderBy("name", "id") if ordered else out


def stock_by_brand(t: Tables) -> DataFrame:
    return (
        _stock_products(t, "brand", "cost_price_gbp")
        .groupBy("brand")
        .agg(units("qty_on_hand").alias("units"), money(F.col("qty_on_hand") * F.col("cost_price_gbp")).alias("value"))
        .orderBy(F.desc("units"), "brand")
    )


def stock_by_warehouse(t: Tables) -> DataFrame:
    """Units and value per warehouse; NULL, not zero, for a warehouse without stock."""
    s = _stock_by(t)
    return (
        t.warehouses.join(s, F.col("code") == F.col("warehouse"), "left")
        .select(F.col("code").alias("warehouse"), "name", F.col("units").cast("bigint").alias("units"), "value")
        .orderBy("warehouse")
    )


def kpi_warehouses(t: Tables) -> DataFrame:
    s = _stock_by(t)
    return (
        t.warehouses.join(s, F.col("code") == F.col("warehouse"), "left")
        .select(
            F.col("code").alias("warehouse"), "name", "currency",
            F.coalesce("units", F.lit(0)).cast("bigint").alias("total_units"),
            F.coalesce("value", F.lit(0)).cast(MONEY).alias("stock_value_gbp"),
            F.coalesce("low", F.lit(0)).cast("bigint").alias("low_stock_items"),
            F.coalesce("out", F.lit(0)).cast("bigint").alias("out_of_stock_items"),
        )
        .orderBy("warehouse")
    )


def dashboard_warehouses(t: Tables) -> DataFrame:
    """KPI rows with each warehouse's size relative to the largest and its health tag."""
    k = kpi_warehouses(t).select(
        "warehouse", "name", "currency", "total_units", "stock_value_gbp", "low_stock_items", "out_of_stock_items",
        # One row per warehouse reaches this window, never stock rows.
        F.max("total_units").over(Window.partitionBy()).alias("largest"),
    )
    share = F.round(F.col("total_units").cast("decimal(20,6)") / F.greatest("largest", F.lit(1)) * 100)
    return k.select(
        "warehouse", "name", "currency", "total_units", "stock_value_gbp", "low_stock_items", "out_of_stock_items",
        share.cast("bigint").alias("share_of_largest_pct"),
        F.when(F.col("out_of_stock_items") > 0, "critical")
        .when(F.col("low_stock_items") > 0, "warning").otherwise("healthy").alias("health"),
    )


def dashboard_totals(t: Tables) -> DataFrame:
    k = kpi_warehouses(t)
    return k.agg(
        F.count("*").alias("warehouses"),
        F.sum("total_units").alias("total_units"),
        F.sum("stock_value_gbp").cast(MONEY).alias("stock_value_gbp"),
        F.sum("low_stock_items").alias("low_stock_items"),
        F.sum("out_of_stock_items").alias("out_of_stock_items"),
    )


def low_stock_count(t: Tables) -> DataFrame:
    return t.warehouse_stock.agg(F.count_if(is_low()).alias("total_alerts"))


def low_stock_alerts(t: Tables, ordered: bool = False) -> DataFrame:
    """Stock at or below its reorder point, with the other warehouses that hold a surplus.

    A product's surplus is one array (at most one entry per warehouse) built by
    a grouped aggregate and filtered per alert, so no pairs of stock rows are
    formed. ``surplus_elsewhere`` is NULL when no other warehouse has any.
    """
    surplus = (
        t.warehouse_stock.where(available() > F.col("reorder_point"))
        .groupBy("product_id")
        .agg(F.sort_array(F.collect_list(
            F.struct("warehouse", available().alias("qty_available")))).alias("surplus"))
    )
    products = t.products.select(
        F.col("id").alias("product_id"), "name", "sku", "brand", "cost_price_gbp", "case_pack", "supplier_id"
    )
    suppliers = t.suppliers.select(
        F.col("id").alias("supplier_id"), F.col("name").alias("supplier_name"), "lead_time_days"
    )
    elsewhere = F.filter("surplus", lambda x: x["warehouse"] != F.col("warehouse"))
    out = (
        t.warehouse_stock.where(is_low())
        .join(surplus, "product_id", "left")
        .join(products, "product_id")
        .join(suppliers, "supplier_id", "left")
        .select(
            "warehouse", "qty_on_hand", "qty_reserved", available().alias("qty_available"), "reorder_point",
            "product_id", "name", "sku", "brand", "cost_price_gbp", "case_pack", "supplier_name", "lead_time_days",
            F.when(F.col("qty_on_hand") == 0, "out_of_stock").otherwise("low_stock").alias("alert_type"),
            F.when(F.size(elsewhere) > 0, elsewhere).alias("surplus_elsewhere"),
        )
    )
    return out.orderBy("qty_on_hand", "warehouse", "brand", "name", "product_id") if ordered else out


def alert_stats(t: Tables) -> DataFrame:
    """Per warehouse and in total: alerts, out-of-stock share (rounded percent), transferable alerts."""
    a = low_stock_alerts(t)
    out = F.count_if(F.col("alert_type") == "out_of_stock")
    share = F.round(out.cast("decimal(20,6)") / F.greatest(F.count("*"), F.lit(1)) * 100).cast("bigint")
    return (
        a.groupingSets([["warehouse"], []], "warehouse")
        .agg(
            F.grouping("warehouse").cast("int").alias("is_total"),
            F.count("*").alias("alerts"), out.alias("out_of_stock"), share.alias("out_of_stock_pct"),
            F.count_if(F.col("surplus_elsewhere").isNotNull()).alias("transferable"),
        )
        .orderBy("is_total", "warehouse")
    )


def transfer_suggestions(t: Tables, search: str = "", alert_type: str = "", action: str = "") -> DataFrame:
    """For each alert: move stock from the warehouse with the largest surplus, else reorder.

    The first warehouse wins a tie. Quantity is the smaller of that surplus and
    the reorder point (at least 1).
    """
    alerts = low_stock_alerts(t)
    if search:
        alerts = alerts.where(contains_ci(search, "name", "sku", "brand"))
    if alert_type:
        alerts = alerts.where(F.col("alert_type") == alert_type)
    most = F.array_max(F.transform("surplus_elsewhere", lambda x: x["qty_available"]))
    best = F.filter("surplus_elsewhere", lambda x: x["qty_available"] == most)[0]
    point = F.greatest("reorder_point", F.lit(1))
    out = alerts.select(
        "warehouse", "product_id", "sku", "name", "qty_on_hand", "reorder_point", "alert_type", "supplier_name",
        "lead_time_days",
        F.when(F.col("surplus_elsewhere").isNull(), "reorder").otherwise("transfer").alias("action"),
        best["warehouse"].alias("from_warehouse"),
        F.when(F.col("surplus_elsewhere").isNotNull(), F.least(best["qty_available"], point)).alias("transfer_qty"),
        F.least(F.lit(100), F.round(F.col("qty_on_hand").cast("decimal(20,6)") / point * 100)).cast("int")
        .alias("fill_pct"),
    )
    return out.where(F.col("action") == action) if action else out


def stock_line_value(t: Tables) -> DataFrame:
    """Cost value of each stock row and how full its bar is drawn."""
    full = F.greatest("qty_on_hand", "reorder_point", F.lit(50))
    return _stock_products(t, "sku", "cost_price_gbp").select(
        "product_id", "warehouse", "sku",
        (F.col("qty_on_hand") * F.col("cost_price_gbp")).cast(MONEY).alias("line_value_gbp"),
        F.least(F.lit(100), F.col("qty_on_hand").cast("decimal(20,6)") / full * 100).cast("decimal(9,2)")
        .alias("fill_pct"),
    )


def stock_valuation(t: Tables) -> DataFrame:
    """Stocked SKUs, units, cost and retail value per warehouse and brand, with warehouse subtotals.

    ``is_total`` is 1 on a subtotal, so that a NULL brand stays distinguishable.
    """
    rows = _stock_products(t.replace(warehouse_stock=t.warehouse_stock.where(F.col("qty_on_hand") > 0)),
                           "brand", "cost_price_gbp", "sell_price_gbp")
    per_brand = rows.groupBy("warehouse", "brand").agg(
        F.count("*").alias("sku_count"),
        F.sum("qty_on_hand").alias("total_units"),
        F.sum(F.col("qty_on_hand") * F.col("cost_price_gbp")).cast("decimal(28,2)").alias("cost_value"),
        F.sum(F.col("qty_on_hand") * F.col("sell_price_gbp")).cast("decimal(28,2)").alias("retail_value"),
    )
    named = per_brand.join(
        t.warehouses.select("code", F.col("name").alias("warehouse_name"), "currency"),
        F.col("code") == F.col("warehouse"),
    )
    # The stock rows are already folded to one row per warehouse and brand, so
    # the grouping sets expand that small result and not the stock table.
    keys = ["warehouse", "warehouse_name", "currency"]
    return (
        named.groupingSets([[*keys, "brand"], keys], *keys, "brand")
        .agg(
            F.grouping("brand").cast("int").alias("is_total"),
            F.sum("sku_count").alias("sku_count"),
            F.sum("total_units").alias("total_units"),
            F.sum("cost_value").cast(MONEY).alias("cost_value"),
            F.sum("retail_value").cast(MONEY).alias("retail_value"),
        )
        .orderBy("warehouse", F.desc("is_total"), F.col("brand").asc_nulls_first())
    )


def warehouse_comparison(t: Tables, warehouses: Sequence) -> DataFrame:
    """One row per stocked product with a group of columns per warehouse.

    A missing stock row counts as zero and is reported as out of stock.
    """
    def pick(w, value):
        return F.max(F.when(F.col("warehouse") == F.lit(w), value))

    per_product = t.warehouse_stock.groupBy("product_id").agg(
        *[pick(w, available()).alias(f"available_{w}") for w in warehouses],
        *[pick(w, F.col("qty_on_hand")).alias(f"on_hand_{w}") for w in warehouses],
        *[pick(w, F.col("reorder_point")).alias(f"reorder_point_{w}") for w in warehouses],
    )
    filled = per_product.na.fill(0)
    statuses = {w: cell_status(f"on_hand_{w}", f"reorder_point_{w}") for w in warehouses}
    total = sum((F.col(f"available_{w}") for w in warehouses), F.lit(0))
    some_zero = F.lit(False)
    some_full = F.lit(False)
    for w in warehouses:
        some_zero = some_zero | (F.col(f"available_{w}") == 0)
        some_full = some_full | (F.col(f"available_{w}") >= 20)
    graded = filled.select(
        "*", *[s.alias(f"status_{w}") for w, s in statuses.items()],
        total.cast("int").alias("total_available"), (some_zero & some_full).alias("imbalance"),
    )
    listed = F.array(*[F.col(f"status_{w}") for w in warehouses])
    worst = (
        F.when(F.array_contains(listed, "out"), "out_of_stock")
        .when(F.array_contains(listed, "low"), "low_stock").otherwise("healthy")
    )
    products = t.products.select(F.col("id").alias("product_id"), "name", "sku", "brand")
    return graded.join(products, "product_id").select(
        "product_id", "name", "sku", "brand", *[c for c in graded.columns if c != "product_id"],
        worst.alias("worst_status"),
    )


def comparison_filters(
    t: Tables, warehouses: Sequence, search: str = "", brand: str = "", status: str = ""
) -> DataFrame:
    """The comparison narrowed by text, brand and status (imbalance, out_any, low_any, healthy_all)."""
    out = warehouse_comparison(t, warehouses)
    if search:
        out = out.where(contains_ci(search, "name", "sku", "brand"))
    if brand:
        out = out.where(F.col("brand") == brand)
    values = F.array(*[F.col(f"available_{w}") for w in warehouses])
    states = F.array(*[F.col(f"status_{w}") for w in warehouses])
    if status == "imbalance":
        out = out.where("imbalance")
    elif status == "out_any":
        out = out.where(F.array_contains(values, 0))
    elif status == "low_any":
        out = out.where(F.array_contains(states, "low"))
    elif status == "healthy_all":
        out = out.where(F.forall(states, lambda s: s == "ok"))
    return out


def comparison_totals(comparison: DataFrame, warehouses: Sequence) -> DataFrame:
    """Footer of the comparison: product count, available units per warehouse and overall."""
    return comparison.agg(
        F.count("*").alias("products"),
        *[units(f"available_{w}").alias(f"available_{w}") for w in warehouses],
        units("total_available").alias("total_available"),
        F.count_if(F.col("imbalance")).alias("imbalances"),
    )


def stock_imbalance(t: Tables, surplus: int = 20) -> DataFrame:
    """Products with nothing in one warehouse and a surplus in another; a missing row counts as zero.

    Works for any number of warehouses without building the product × warehouse
    grid: fewer rows than warehouses means that some cell is missing.
    """
    n = t.warehouses.select(F.count("*")).scalar()
    per_product = t.warehouse_stock.groupBy("product_id").agg(
        F.count("*").alias("cells"),
        F.count_if(available() == 0).alias("empty"),
        F.max(available()).alias("most_available"),
    ).where(((F.col("empty") > 0) | (F.col("cells") < n)) & (F.col("most_available") >= surplus))
    products = t.products.select(F.col("id").alias("product_id"), "name", "sku", "brand")
    return per_product.join(products, "product_id").select(
        "product_id", "name", "sku", "brand", "most_available",
        (F.col("empty") + n - F.col("cells")).cast("bigint").alias("empty_warehouses"),
    )


def raw_stock_list(t: Tables, ordered: bool = True) -> DataFrame:
    """The imported catalogue in brand and title order."""
    return t.stock.orderBy("brand", "title", "sku") if ordered else t.stock


def catalogue_filter(t: Tables, search: str = "", brand: str = "", region: str = "") -> DataFrame:
    """Imported catalogue narrowed by text, brand and availability (uk, us or both), with margin."""
    out = t.stock
    if search:
        out = out.where(contains_ci(search, "title", "brand", "sku", "ean"))
    if brand:
        out = out.where(F.col("brand") == brand)
    uk, us = F.coalesce("available_uk", F.lit(False)), F.coalesce("available_us", F.lit(False))
    if region:
        out = out.where({"uk": uk, "us": us, "both": uk & us}[region])
    sell = F.coalesce("rrp_gbp", F.lit(0))
    return out.select(
        "brand", "title", "sku", "ean", "asin", "rrp_gbp", "buy_cost_gbp", "case_pack",
        F.when(sell > 0, margin_pct(sell, F.coalesce("buy_cost_gbp", F.lit(0)))).alias("margin_pct"),
        F.when(uk & us, "uk+us").when(uk, "uk").when(us, "us").otherwise("none").alias("availability"),
    )
