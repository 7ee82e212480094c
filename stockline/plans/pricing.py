"""Order pricing checks that only read: line prices, minimum quantities, carts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from stockline.functions import MONEY, discounted
from stockline.operators.joins import growing
from stockline.operators.tiers import with_tiers
from stockline.tables import Tables


def _with_discount(t: Tables, lines: DataFrame, tier: str) -> DataFrame:
    known = "default_discount_pct" in lines.columns
    # Breaks first: lines that come from a join on the product lie where the breaks are needed. Both tables are met by
    # shuffles; order intake, whose lines bring the discount, leaves the choice to Spark.
    priced = with_tiers(lines if known else growing(lines), t.price_tiers)
    if not known:
        priced = priced.join(
            growing(t.customers.select(F.col("id").alias("customer_id"), "default_discount_pct")), "customer_id", "left"
        )
    own, none = F.col("default_discount_pct").cast("decimal(5,2)"), F.lit(0).cast("decimal(5,2)")
    return (
        priced
        .withColumn("discount_pct", F.greatest(own, F.col(tier).cast("decimal(5,2)"), none))
        .withColumn(
            "unit_price_gbp",
            F.when(F.col("discount_pct") > 0, discounted("base_price_gbp", F.col("discount_pct")))
            # Without a discount nothing is rounded: further decimals of the base price stay.
            .otherwise(F.col("base_price_gbp").cast(dict(lines.dtypes)["base_price_gbp"])),
        )
        .drop("at_pct", "best_pct", "default_discount_pct")
    )


def price_order_lines(t: Tables, lines: DataFrame) -> DataFrame:
    """Price lines (customer_id, product_id, qty, base_price_gbp) as order intake does.

    The tier with the greatest break not above the quantity counts, if it beats
    the customer's own discount. The price passed in must be the base price.
    Lines that already carry default_discount_pct save the join with customers.
    """
    return _with_discount(t, lines, "at_pct")


def effective_price(t: Tables, lines: DataFrame) -> DataFrame:
    """Price lines as the ordering portal shows them: the largest discount of any break reached."""
    return _with_discount(t, lines, "best_pct")


def moq_failures(t: Tables, lines: DataFrame) -> DataFrame:
    """Lines below their product's minimum order quantity (only minima above 1 count)."""
    minima = t.products.where(F.col("moq") > 1).select(
        F.col("id").alias("product_id"), F.col("name").alias("moq_product_name"), "moq"
    )
    return lines.join(minima, "product_id").where(F.col("qty") < F.col("moq"))


def check_moq(t: Tables, lines: DataFrame) -> DataFrame:
    """One row per failing line; an order with any such line is rejected."""
    return moq_failures(t, lines).select(
        "request_id", "line_id", "product_id", "moq_product_name", F.col("qty").alias("ordered"), "moq"
    )


def cart_totals(t: Tables, cart: DataFrame) -> DataFrame:
    """Cart total, base total, savings and what the customer's credit leaves, per cart.

    ``cart`` holds request_id, customer_id, product_id, qty and base_price_gbp.
    """
    priced = effective_price(t, cart)
    qty = F.col("qty")
    totals = priced.groupBy("request_id", "customer_id").agg(
        F.sum(qty * F.col("unit_price_gbp")).cast(MONEY).alias("total_gbp"),
        F.sum(qty * F.col("base_price_gbp")).cast(MONEY).alias("base_total_gbp"),
    )
    customers = t.customers.select(
        F.col("id").alias("customer_id"), "payment_terms", "credit_limit_gbp", "credit_used_gbp"
    )
    on_credit = (F.col("payment_terms") != "prepaid") & (F.col("credit_limit_gbp") > 0)
    credit = F.col("credit_limit_gbp") - F.col("credit_used_gbp")
    return totals.join(customers, "customer_id", "left").select(
        "request_id", "customer_id", "total_gbp", "base_total_gbp",
        (F.col("base_total_gbp") - F.col("total_gbp")).cast(MONEY).alias("savings_gbp"),
        F.when(on_credit, F.greatest(F.lit(0), credit - F.col("total_gbp")).cast(MONEY)).alias("credit_remaining_gbp"),
        F.coalesce(on_credit & (F.col("total_gbp") > credit), F.lit(False)).alias("exceeds_credit"),
    )
