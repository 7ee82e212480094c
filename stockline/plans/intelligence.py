"""Forecasts, recommendations and classifications."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from stockline.functions import MONEY, available, money, replenish_qty, units, whole_days
from stockline.operators.demand import days_left, demand_rates, one_decimal
from stockline.operators.prefix import running_totals
from stockline.plans.trading import _asof
from stockline.tables import Tables


def demand_velocity(t: Tables) -> DataFrame:
    """Per product: units, distinct orders, revenue, speed class and its stock per warehouse."""
    sold = t.order_lines.groupBy("product_id").agg(
        F.sum("qty_ordered").alias("qty"), F.count_distinct("order_id").alias("n"),
        F.sum(F.col("qty_ordered") * F.col("unit_price_gbp")).cast(MONEY).alias("rev"),
    )
    stock = t.warehouse_stock.groupBy("product_id").agg(
        F.sort_array(F.collect_list(F.struct("warehouse", F.col("qty_on_hand").alias("qty")))).alias("stock")
    )
    qty = F.coalesce("qty", F.lit(0))
    return (
        t.products.join(sold.withColumnRenamed("product_id", "id"), "id", "left")
        .join(stock.withColumnRenamed("product_id", "id"), "id", "left")
        .select(
            "id", "name", "sku", "brand", "cost_price_gbp", "sell_price_gbp",
            qty.cast("bigint").alias("total_ordered"),
            F.coalesce("n", F.lit(0)).cast("bigint").alias("order_count"),
            F.coalesce("rev", F.lit(0)).cast(MONEY).alias("revenue"),
            F.when(qty == 0, "dead_stock").when(qty < 5, "slow_mover").when(qty < 20, "steady")
            .otherwise("fast_mover").alias("velocity"),
            F.col("stock").alias("stock_by_warehouse"),
        )
    )


# -- stockouts ---------------------------------------------------------------

def stockout_predictions(t: Tables, asof=None, ordered: bool = False) -> DataFrame:
    """Days of cover and severity of every stock row that holds something."""
    rates = demand_rates(t, _asof(t, asof))
    products = t.products.select(
        F.col("id").alias("product_id"), "name", "sku", "brand", "cost_price_gbp", "supplier_id"
    )
    suppliers = t.suppliers.select(
        F.col("id").alias("supplier_id"), F.col("name").alias("supplier_name"), "lead_time_days"
    )
    cover = days_left()
    severity = (
        F.when(cover.isNull(), "no_demand").when(cover < 14, "critical").when(cover < 30, "warning")
        .otherwise("healthy")
    )
    out = (
        t.warehouse_stock.where(F.col("qty_on_hand") > 0)
        .join(rates, ["product_id", "warehouse"], "left")
        .join(products, "product_id")
        .join(suppliers, "supplier_id", "left")
        .select(
            "warehouse", "product_id", "qty_on_hand", "reorder_point", "name", "sku", "brand", "cost_price_gbp",
            "supplier_name", "lead_time_days",
            F.coalesce(F.col("daily_rate"), F.lit(0.0)).cast("decimal(18,6)").alias("burn_rate_per_day"),
            one_decimal(cover).alias("days_until_stockout"), severity.alias("severity"),
        )
    )
    if ordered:
        rank = (
            F.when(F.col("severity") == "critical", 1).when(F.col("severity") == "warning", 2)
            .when(F.col("severity") == "healthy", 3).otherwise(4)
        )
        out = out.orderBy(rank, F.coalesce("days_until_stockout", F.lit(9999)), "product_id", "warehouse")
    return out


def prediction_summary(t: Tables, asof=None) -> DataFrame:
    return stockout_predictions(t, asof).groupBy("severity").agg(F.count("*").alias("items")).orderBy("severity")


def prediction_page(t: Tables, warehouse=None, severity: str = "", limit: int = 50, asof=None) -> DataFrame:
    """The first rows of the predictions screen: most urgent first, rows without demand hidden."""
    p = stockout_predictions(t, asof).where(F.col("severity") != "no_demand")
    if warehouse is not None:
        p = p.where(F.col("warehouse") == F.lit(warehouse))
    if severity:
        p = p.where(F.col("severity") == severity)
    rank = F.when(F.col("severity") == "critical", 1).when(F.col("severity") == "warning", 2).otherwise(3)
    return p.orderBy(rank, "days_until_stockout", "product_id", "warehouse").limit(limit)


# -- reordering --------------------------------------------------------------

def _reorder_base(t: Tables, warehouse, asof) -> DataFrame:
    stock = t.warehouse_stock.where(F.col("qty_on_hand") > 0)
    if warehouse is not None:
        stock = stock.where(F.col("warehouse") == F.lit(warehouse))
    products = t.products.where(F.col("supplier_id").isNotNull()).select(
        F.col("id").alias("product_id"), "name", "sku", "brand", "cost_price_gbp", "case_pack", "supplier_id"
    )
    suppliers = t.suppliers.select(
        F.col("id").alias("supplier_id"), F.col("name").alias("supplier_name"), "lead_time_days",
        F.coalesce(F.col("currency"), F.lit("GBP")).alias("supplier_currency"),
    )
    cover = days_left()
    rows = (
        stock.join(demand_rates(t, _asof(t, asof)), ["product_id", "warehouse"], "left")
        .join(products, "product_id")
        .join(suppliers, "supplier_id", "left")
    )
    at_point = (F.col("qty_on_hand") <= F.col("reorder_point")) & (F.col("reorder_point") > 0)
    too_short = F.coalesce(cover < F.coalesce("lead_time_days", F.lit(14)), F.lit(False))
    return rows.where(at_point | too_short).withColumn("days_until_stockout", one_decimal(cover))


def _recommendation(rows: DataFrame, qty: Column) -> DataFrame:
    days = F.col("days_until_stockout")
    return rows.select(
        "warehouse", "supplier_id", "supplier_name", "lead_time_days", "supplier_currency", "product_id", "name",
        "sku", "brand", F.col("qty_on_hand").alias("current_stock"), "reorder_point",
        F.coalesce("daily_rate", F.lit(0.0)).cast("decimal(18,6)").alias("burn_rate_per_day"),
        "days_until_stockout", qty.cast("int").alias("recommended_qty"), "cost_price_gbp",
        (qty * F.col("cost_price_gbp")).cast(MONEY).alias("estimated_cost_gbp"),
        F.when(days < 7, "critical").when(days < 14, "urgent")
        .when(F.col("qty_on_hand") <= F.col("reorder_point"), "reorder").otherwise("preventive").alias("urgency"),
    )


def reorder_recommendations(t: Tables, warehouse=None, asof=None) -> DataFrame:
    """What to reorder, one row per product and warehouse: fill up to max stock, at least one case."""
    qty = replenish_qty("max_stock", "qty_on_hand", "case_pack")
    return _recommendation(_reorder_base(t, warehouse, asof), qty)


def reorder_recommendations_demand(t: Tables, warehouse=None, asof=None) -> DataFrame:
    """Variant sized by demand: burn rate over lead time plus 14 days, less stock, in whole cases."""
    case = F.coalesce(F.nullif(F.col("case_pack"), F.lit(0)), F.lit(1))
    horizon = F.coalesce("lead_time_days", F.lit(14)) + 14
    gap = F.coalesce("daily_rate", F.lit(0.0)) * horizon - F.col("qty_on_hand")
    qty = F.greatest(F.ceil(gap / case), F.lit(1)) * case
    return _recommendation(_reorder_base(t, warehouse, asof), qty)


def reorder_by_supplier(t: Tables, warehouse=None, asof=None) -> DataFrame:
    """Items and cost of the recommendations per warehouse and supplier, most expensive first."""
    return (
        reorder_recommendations(t, warehouse, asof)
        .groupBy("warehouse", "supplier_id", "supplier_name", "lead_time_days", "supplier_currency")
        .agg(F.count("*").alias("total_items"), money(F.col("estimated_cost_gbp")).alias("total_cost_gbp"))
        .orderBy(F.desc("total_cost_gbp"), "warehouse", "supplier_id")
    )


# -- routing -----------------------------------------------------------------

def route_order(
    t: Tables,
    request_lines: DataFrame,
    distances: DataFrame,
    default_region="uk",
    unknown_distance: int = 2,
) -> DataFrame:
    """Score every warehouse for every request; one row per option, best first by ``position``.

    ``request_lines`` has request_id, customer_id, product_id and qty (missing
    or 0 counts as 1); ``distances`` has region, warehouse and distance. A request of an unknown
    customer yields no row (see ``unroutable``). Score: 50, +30 when every line
    is in stock or else -20, +20 local, +10 near, -5 farther. Ties keep the order of ``code``.
    ``preferred_warehouse`` is that of the customer's region, or of the default region where it has none.
    """
    need = F.coalesce(F.nullif(F.col("qty"), F.lit(0)), F.lit(1))
    stock = t.warehouse_stock.select("product_id", "warehouse", available().alias("avail"))
    covered = (
        request_lines.select("request_id", "product_id", need.alias("need"))
        .join(stock, "product_id")
        .groupBy("request_id", "warehouse")
        .agg(F.count_if(F.col("avail") >= F.col("need")).alias("covered"))
    )
    headers = request_lines.groupBy("request_id", "customer_id").agg(F.count("*").alias("lines"))
    regions = t.customers.select(
        F.col("id").alias("customer_id"), F.coalesce(F.col("region"), F.lit(default_region)).alias("region")
    )
    # Every request is offered every warehouse: the result has that many rows
    # by definition, and the list comes from a one-row subquery.
    codes = t.warehouses.select(F.sort_array(F.collect_list("code"))).scalar()
    options = (
        headers.join(regions, "customer_id")
        .select("request_id", "customer_id", "region", "lines", F.explode(codes).alias("warehouse"))
        .join(covered, ["request_id", "warehouse"], "left")
        .join(distances, ["region", "warehouse"], "left")
    )
    names = t.warehouses.select(F.col("code").alias("warehouse"), F.col("name").alias("warehouse_name"))
    kind = dict(t.warehouses.dtypes)["code"]
    own = F.when(F.array_contains(codes, F.col("region").cast(kind)), F.col("region").cast(kind))
    options = options.join(names, "warehouse", "left").withColumn(
        "preferred_warehouse", F.coalesce(own, F.lit(default_region).cast("string").try_cast(kind)))
    full = F.coalesce("covered", F.lit(0)) == F.col("lines")
    dist = F.coalesce("distance", F.lit(unknown_distance))
    stock_points = F.when(full, 30).otherwise(-20)
    near_points = F.when(dist == 0, 20).when(dist == 1, 10).otherwise(-5)

    def factor(name: Column, points: Column) -> Column:
        return F.struct(name.alias("factor"), points.alias("points"))

    scored = options.select(
        "request_id", "customer_id", "region", "preferred_warehouse", "warehouse", "warehouse_name",
        (50 + stock_points + near_points).alias("score"), full.alias("can_fulfil"),
        F.array(
            factor(F.when(full, "Full stock").otherwise("Partial stock"), stock_points),
            factor(F.when(dist == 0, "Local warehouse").when(dist == 1, "Near region").otherwise("Cross-region"),
                   near_points),
        ).alias("factors"),
        F.array_compact(F.array(
            F.when(~full, "Cannot fulfill all items from this warehouse"),
            F.when(dist > 1, "Cross-region shipping adds cost and transit time"),
        )).alias("warnings"),
    )
    # One row per warehouse in each window group.
    best = Window.partitionBy("request_id").orderBy(F.desc("score"), "warehouse")
    ranked = scored.withColumn("position", F.row_number().over(best))
    return ranked.withColumn("recommended", F.col("position") == 1)


def unroutable(t: Tables, request_lines: DataFrame) -> DataFrame:
    """Requests whose customer does not exist."""
    known = t.customers.select(F.col("id").alias("customer_id"))
    return request_lines.select("request_id", "customer_id").distinct().join(known, "customer_id", "left_anti").select(
        "request_id", F.lit("customer_not_found").alias("error_code"), F.col("customer_id").cast("string").alias("detail")
    )


# -- ABC ---------------------------------------------------------------------

def product_revenue(t: Tables, asof=None, days: int = 90) -> DataFrame:
    """Revenue per product over the days before ``asof``."""
    since = _asof(t, asof) - F.expr(f"INTERVAL '{int(days)}' DAY")
    recent = t.orders.where(F.col("created_at") >= since).select(F.col("id").alias("order_id"))
    lines = t.order_lines.select("order_id", "product_id", "qty_ordered", "unit_price_gbp")
    return lines.join(recent, "order_id").groupBy("product_id").agg(
        F.sum(F.col("qty_ordered") * F.col("unit_price_gbp")).cast(MONEY).alias("revenue")
    )


def abc_classification(t: Tables, asof=None) -> DataFrame:
    """A up to 80 % of cumulated revenue, B up to 95 %, else C; equal revenues share a class.

    The running share is taken over distinct revenues, range-partitioned, so no
    task sees the whole catalogue. Products without sales are C and never take part in it.
    """
    revenue = product_revenue(t, asof).where(F.col("revenue") != 0)
    per_value = revenue.groupBy("revenue").agg(F.sum("revenue").cast("decimal(28,2)").alias("subtotal"))
    total = revenue.select(F.sum("revenue").cast("decimal(28,2)")).scalar()
    running = running_totals(per_value, [], [F.desc("revenue")], {"before": F.col("subtotal")})
    share = F.try_divide((F.col("before") + F.col("subtotal")).cast("double"), total.cast("double"))
    graded = running.select(
        "revenue", F.when(share <= 0.8, "A").when(share <= 0.95, "B").otherwise("C").alias("cls")
    )
    classes = revenue.join(graded, "revenue").select(F.col("product_id").alias("id"), "revenue", "cls")
    return t.products.select("id", "name", "sku", "brand").join(classes, "id", "left").select(
        "id", "name", "sku", "brand", F.coalesce("revenue", F.lit(0)).cast(MONEY).alias("revenue"),
        F.coalesce("cls", F.lit("C")).alias("abc_class"),
    )


def abc_counts(t: Tables, asof=None) -> DataFrame:
    return abc_classification(t, asof).groupBy("abc_class").agg(F.count("*").alias("products")).orderBy("abc_class")


# -- suppliers and automation ------------------------------------------------

def supplier_lead_time_stats(t: Tables) -> DataFrame:
    """Whole days from submission to receipt per supplier: count, average, least and most."""
    days = whole_days(F.col("received_at"), F.col("submitted_at"))
    received = (
        t.purchase_orders.where(
            (F.col("status") == "received") & F.col("submitted_at").isNotNull() & F.col("received_at").isNotNull()
            & (F.col("received_at") > F.col("submitted_at"))
        )
        .groupBy("supplier_id")
        .agg(
            F.count("*").alias("po_count"),
            F.round(F.sum(days).cast("decimal(20,8)") / F.count("*"), 1).cast("decimal(10,1)").alias("avg_actual_days"),
            F.min(days).cast("decimal(10,1)").alias("min_actual_days"),
            F.max(days).cast("decimal(10,1)").alias("max_actual_days"),
        )
    )
    suppliers = t.suppliers.select(
        F.col("id").alias("supplier_id"), F.col("name").alias("supplier_name"),
        F.col("lead_time_days").alias("promised_days"),
    )
    return received.join(suppliers, "supplier_id").select(
        "supplier_id", "supplier_name", "promised_days", "po_count", "avg_actual_days", "min_actual_days",
        "max_actual_days",
    )


def automation_status(t: Tables) -> DataFrame:
    """One row: open backorder lines and units, pending returns, products per ABC class."""
    short = t.order_lines.where(
        F.col("fulfilment_status").isin("backordered", "partial") & (F.col("qty_backordered") > 0)
    )
    back = short.agg(F.struct(F.count("*").alias("n"), units("qty_backordered").alias("u"))).scalar()
    pending = t.returns.where(F.col("status") == "pending").select(F.count("*")).scalar()
    # One entry per class, not per product.
    per_class = t.products.groupBy("abc_class").agg(F.count("*").alias("n"))
    classes = per_class.select(F.map_from_entries(F.sort_array(F.collect_list(
        F.struct(F.coalesce("abc_class", F.lit("unclassified")).alias("c"), F.col("n"))
    )))).scalar()
    one = t.products.sparkSession.range(1)
    return one.select(
        back["n"].alias("pending_lines"), back["u"].alias("pending_units"), pending.alias("pending_returns"),
        classes.alias("classes"),
    )


def supplier_lead_times(t: Tables) -> DataFrame:
    """Promised and measured lead time of each supplier."""
    return t.suppliers.select(
        "id", "name", F.col("lead_time_days").alias("promised_days"),
        F.nullif(F.col("actual_lead_time_days"), F.lit(0)).alias("actual_days"),
    )
