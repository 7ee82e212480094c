"""Products, suppliers and prices."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from stockline.functions import available, contains_ci, margin_pct
from stockline.tables import Tables

# Exchange rates of the pricing page, per pound.
GBP_USD = "1.34"
GBP_EUR = "1.17"


def supplier_product_counts(t: Tables) -> DataFrame:
    counts = t.products.groupBy("supplier_id").agg(F.count("*").alias("n"))
    return (
        t.suppliers.join(counts, F.col("id") == F.col("supplier_id"), "left")
        .select(
            "id", "name", "contact_email", "lead_time_days", "currency", "notes",
            F.coalesce("n", F.lit(0)).cast("bigint").alias("product_count"),
        )
        .orderBy("name")
    )


def product_list(t: Tables, supplier=None, warehouse=None, ordered: bool = False) -> DataFrame:
    """Products with supplier name and, when a warehouse is named, their stock there."""
    products = t.products
    if supplier is not None:
        products = products.where(F.col("supplier_id") == F.lit(supplier))
    suppliers = t.suppliers.select(F.col("id").alias("supplier_id"), F.col("name").alias("supplier_name"))
    out = products.join(suppliers, "supplier_id", "left")
    extra: list[str] = []
    if warehouse is not None:
        here = t.warehouse_stock.where(F.col("warehouse") == F.lit(warehouse)).select(
            F.col("product_id").alias("id"), "qty_on_hand", available().alias("qty_available")
        )
        out = out.join(here, "id", "left")
        extra = ["qty_on_hand", "qty_available"]
    out = out.select(
        "id", "name", "sku", "brand", "cost_price_gbp", "sell_price_gbp", "case_pack", "supplier_id",
        "supplier_name", *extra,
    )
    return out.orderBy("brand", "name", "id") if ordered else out


def tier_arrays(t: Tables) -> DataFrame:
    """Per product its quantity breaks in ascending order, one entry per distinct break.

    Duplicates are folded before the arrays are built, so an array is only as
    long as the product's number of distinct breaks.
    """
    breaks = t.price_tiers.groupBy("product_id", "min_qty").agg(F.max("discount_pct").alias("discount_pct"))
    return breaks.groupBy("product_id").agg(
        F.sort_array(F.collect_list(F.struct("min_qty", "discount_pct"))).alias("tiers")
    )


def price_tiers_by_product(t: Tables, product_id=None, ordered: bool = False) -> DataFrame:
    """Products that have quantity breaks, with the breaks nested in order."""
    scoped = t
    if product_id is not None:
        scoped = t.replace(
            price_tiers=t.price_tiers.where(F.col("product_id") == F.lit(product_id)),
            products=t.products.where(F.col("id") == F.lit(product_id)),
        )
    products = scoped.products.select(
        F.col("id").alias("product_id"), "name", "sku", "brand", "sell_price_gbp", "moq"
    )
    out = products.join(tier_arrays(scoped), "product_id")
    return out.orderBy("brand", "name", "product_id") if ordered else out


def price_history(t: Tables, product_id=None, ordered: bool = False) -> DataFrame:
    """Price changes with product names, of one product or of all."""
    history = t.price_history
    if product_id is not None:
        history = history.where(F.col("product_id") == F.lit(product_id))
    products = t.products.select(
        F.col("id").alias("product_id"), F.col("name").alias("product_name"), "sku"
    )
    out = history.join(products, "product_id")
    return out.orderBy("product_id", F.desc("changed_at"), F.desc("id")) if ordered else out


def price_trends(t: Tables) -> DataFrame:
    """Latest buying-cost change per product: one hash aggregate, no sort. Ties go to the highest id."""
    latest = t.price_history.where(F.col("field") == "buy_cost").groupBy("product_id").agg(
        F.max(F.struct("changed_at", "id", "field", "old_value", "new_value")).alias("x")
    )
    return latest.select("product_id", "x.field", "x.old_value", "x.new_value", "x.changed_at", _direction(
        F.col("x.old_value"), F.col("x.new_value")).alias("trend"))


def _direction(old, new):
    return F.when(new > old, "up").when(new < old, "down").otherwise("flat")


def price_change_pct(t: Tables, latest: int = 8) -> DataFrame:
    """The latest changes of every product with percentage and direction.

    The rank filter is applied before the shuffle as well as after it, so a
    product with very many changes sends only ``latest`` rows per task.
    """
    w = Window.partitionBy("product_id").orderBy(F.desc("changed_at"), F.desc("id"))
    old, new = F.col("old_value"), F.col("new_value")
    change = F.round((new - old).cast("decimal(20,6)") / old * 100, 1)
    return (
        t.price_history.withColumn("position", F.row_number().over(w))
        .where(F.col("position") <= latest)
        .select(
            "product_id", "position", "field", "old_value", "new_value", "changed_at",
            F.when(old > 0, change).otherwise(0).cast("decimal(12,1)").alias("change_pct"),
            F.when(new > old, "up").otherwise("down").alias("direction"),
        )
    )


def multi_currency_pricing(t: Tables, usd: str = GBP_USD, eur: str = GBP_EUR, ordered: bool = False) -> DataFrame:
    """Cost and selling price in three currencies, with margin and its band."""
    def priced(column: str, rate: str):
        return (F.col(column) * F.lit(rate).cast("decimal(8,4)")).cast("decimal(18,4)")

    margin = margin_pct("sell_price_gbp", "cost_price_gbp")
    out = t.products.select(
        "id", "name", "sku", "brand", "cost_price_gbp", "sell_price_gbp",
        priced("cost_price_gbp", usd).alias("cost_usd"), priced("sell_price_gbp", usd).alias("sell_usd"),
        priced("cost_price_gbp", eur).alias("cost_eur"), priced("sell_price_gbp", eur).alias("sell_eur"),
        margin.alias("margin_pct"),
    )
    return out.orderBy("brand", "name", "id") if ordered else out


def margin_bands(t: Tables, search: str = "", brand: str = "") -> DataFrame:
    """Price-list band (40/25) and supplier-catalogue band (15/0) of each product's margin."""
    products = t.products
    if search:
        products = products.where(contains_ci(search, "name", "sku", "brand"))
    if brand:
        products = products.where(F.col("brand") == brand)
    m = F.coalesce(margin_pct("sell_price_gbp", "cost_price_gbp"), F.lit(0))
    return products.select(
        "id", "sku", "brand", m.cast("decimal(12,1)").alias("margin_pct"),
        F.when(m >= 40, "high").when(m >= 25, "mid").otherwise("low").alias("price_band"),
        F.when(m > 15, "good").when(m > 0, "thin").otherwise("none").alias("supplier_band"),
    )
