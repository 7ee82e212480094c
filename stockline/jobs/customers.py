"""Customers and invoices."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from stockline.functions import available, parse_int, parse_money, parse_number, text_or
from stockline.jobs.common import (
    OUT_OF_RANGE, JobResult, append_rows, missing, no_ledger, rank, reject, unfit, union, updated,
)
from stockline.operators.allocation import allocate_fifo
from stockline.operators.joins import growing
from stockline.operators.movements import apply_deltas
from stockline.operators.prefix import HOT_ROWS
from stockline.sources.staging import stage
from stockline.tables import Tables

# The customer fields a patch may change.
PATCHABLE = (
    "company_name", "contact_name", "email", "billing_address", "currency_preference", "vat_number", "notes",
    "region", "customer_type", "payment_terms", "credit_limit_gbp", "credit_used_gbp", "default_discount_pct",
)


def ingest_customers(t: Tables, requests: DataFrame) -> JobResult:
    """New customers with defaults; company names are unique, the first request of a name wins."""
    named = requests.withColumn("company_name", F.trim(F.coalesce(F.col("company_name"), F.lit(""))))
    discount = parse_money("default_discount_pct").try_cast("decimal(5,2)")
    too_large = unfit(parse_money("credit_limit_gbp"), discount)
    filled = named.where((F.col("company_name") != "") & ~too_large)
    first = filled.groupBy("company_name").agg(F.min(rank()).alias("_first"))
    taken = t.customers.select("company_name").distinct().withColumn("_taken", F.lit(True))
    judged = filled.join(first, "company_name").join(taken, "company_name", "left").withColumn(
        "_ok", F.col("_taken").isNull() & (rank() == F.col("_first"))
    )
    new = judged.where("_ok").select(
        F.col("request_id").alias("id"), "company_name", text_or("contact_name", None).alias("contact_name"),
        text_or("email", None).alias("email"), text_or("billing_address", None).alias("billing_address"),
        text_or("currency_preference", "GBP").alias("currency_preference"),
        text_or("vat_number", None).alias("vat_number"), text_or("notes", None).alias("notes"), "region",
        text_or("customer_type", "retail").alias("customer_type"),
        text_or("payment_terms", "prepaid").alias("payment_terms"),
        parse_money("credit_limit_gbp").alias("credit_limit_gbp"),
        F.lit(0).cast("decimal(12,2)").alias("credit_used_gbp"),
        discount.alias("default_discount_pct"),
    )
    bad = union(
        reject(named.where(F.col("company_name") == ""), "company_name_required"),
        reject(named.where((F.col("company_name") != "") & too_large), OUT_OF_RANGE),
        reject(judged.where(~F.col("_ok")), "duplicate_company_name", "company_name"),
    )
    return JobResult({"customers": append_rows(t.customers, new)}, no_ledger(new), bad, new)


def patch_customers(t: Tables, requests: DataFrame) -> JobResult:
    """Change only the fields a request names; a named field with NULL is cleared.

    ``requests``: request_id, customer_id, requested_at, fields (map of text).
    Of several values for a field the last one stays.
    """
    known = t.customers.select(F.col("id").alias("customer_id"), F.lit(True).alias("_known"))
    judged = requests.join(known, "customer_id", "left")
    # 13 maxima per customer in one aggregate: a map without the key is skipped.
    latest = judged.where("_known").groupBy("customer_id").agg(*[
        F.max_by(
            F.struct(F.element_at("fields", F.lit(f)).alias("value")),
            F.when(F.map_contains_key("fields", f), rank()),
        ).alias(f"_{f}") for f in PATCHABLE
    ]).withColumnRenamed("customer_id", "id")
    kinds = dict(t.customers.dtypes)
    patched = t.customers.join(latest, "id", "left").select(*[
        F.when(F.col(f"_{c}").isNotNull(), F.col(f"_{c}.value").cast(kinds[c])).otherwise(F.col(c)).alias(c)
        if c in PATCHABLE else F.col(c) for c in t.customers.columns
    ])
    changed = patched.join(latest.select("id"), "id", "left_semi")
    bad = reject(judged.where(F.col("_known").isNull()), "not_found", "customer_id")
    return JobResult({"customers": patched}, no_ledger(patched), bad, changed)


def ingest_invoices(
    t: Tables, requests: DataFrame, lines: DataFrame, valid_regions: Sequence = ("uk", "us", "eu"),
    region_warehouses: Mapping | None = None, default_warehouse="uk", hot_rows: int = HOT_ROWS,
) -> JobResult:
    """Book invoices: upsert the customer by name, match SKUs, reserve what is available in line order.

    ``requests``: request_id, customer_name, customer_region, order_number,
    order_date, invoice_date, source_filename, requested_at. ``lines``:
    request_id, line_no, sku, description, barcode, trade_price, quantity,
    subtotal. An order number already invoiced to the customer is refused.
    Stock is taken in the warehouse of the request's region, else the default.
    """
    region_warehouses = {"us": "us"} if region_warehouses is None else region_warehouses
    counts = lines.groupBy("request_id").agg(
        F.count("*").alias("line_count"), F.sum(parse_int("quantity")).try_cast("int").alias("total_units"),
        F.round(F.sum(parse_number("subtotal")), 2).try_cast("decimal(12,2)").alias("total_value_gbp"),
        F.bool_or(unfit(parse_int("quantity"), parse_number("subtotal"), parse_money("trade_price"))).alias("unfit"),
    )
    region = F.lower(F.coalesce(F.col("customer_region").cast("string"), F.lit("")))
    kind = dict(t.customers.dtypes)["region"]
    clean = requests.join(counts, "request_id", "left").withColumns({
        "customer_name": F.trim(F.coalesce("customer_name", F.lit(""))),
        "order_number": text_or(F.trim(F.coalesce("order_number", F.lit(""))), None),
        "_region": F.when(region.isin([str(r) for r in valid_regions]), region).cast(kind),
        "invoice_date": F.coalesce(F.col("invoice_date"), F.to_date("requested_at")),
    })
    error = F.when(F.col("customer_name") == "", "customer_name_required").when(
        F.col("line_count").isNull(), "lines_required"
    ).when(F.col("unfit") | unfit(F.col("total_units"), F.col("total_value_gbp")), OUT_OF_RANGE)
    checked = clean.withColumn("_error", error)
    valid = checked.where(F.col("_error").isNull())

    customers = t.customers.select(F.col("company_name").alias("customer_name"), F.col("id").alias("known_id"))
    booked = t.invoices.where(F.col("order_number").isNotNull()).select(
        F.col("customer_id").alias("known_id"), "order_number").distinct().withColumn("_booked", F.lit(True))
    first = valid.where(F.col("order_number").isNotNull()).groupBy("customer_name", "order_number").agg(
        F.min(rank()).alias("_first"))
    judged = stage(
        valid.join(growing(customers), "customer_name", "left")
        .join(growing(booked), ["known_id", "order_number"], "left")
        .join(growing(first), ["customer_name", "order_number"], "left")
        .withColumn("_ok", F.col("_booked").isNull() & (F.col("_first").isNull() | (rank() == F.col("_first"))))
        .drop("_error"),
        "invoice-headers",
    )
    accepted = judged.where("_ok")

    # Customers: the last region given stays; an unknown name becomes a customer
    # whose id is that of its first request.
    per_name = accepted.groupBy("customer_name").agg(
        F.max("known_id").alias("known_id"), F.min_by("request_id", rank()).alias("_new_id"),
        F.max_by("_region", F.when(F.col("_region").isNotNull(), rank())).alias("region"),
    )
    id_kind = dict(t.customers.dtypes)["id"]
    owner = F.coalesce(F.col("known_id"), F.col("_new_id").cast(id_kind))
    new_customers = per_name.where(F.col("known_id").isNull()).select(
        owner.alias("id"), F.col("customer_name").alias("company_name"), "region"
    )
    regions = per_name.where(F.col("known_id").isNotNull() & F.col("region").isNotNull()).select(
        F.col("known_id").alias("id"), F.lit(True).alias("_hit"), "region"
    )
    invoices = accepted.drop("known_id").join(
        growing(per_name.select("customer_name", owner.alias("customer_id"))), "customer_name"
    )
    new_invoices = invoices.select(
        F.col("request_id").alias("id"), "customer_id", "order_number", F.col("order_date").cast("date").alias("order_date"),
        F.col("invoice_date").cast("date").alias("invoice_date"), "total_units", "total_value_gbp",
        text_or("source_filename", None).alias("source_filename"),
    )
    warehouse = F.lit(default_warehouse)
    for r, w in region_warehouses.items():
        warehouse = F.when(F.col("_region") == F.lit(r), F.lit(w)).otherwise(warehouse)
    skus = t.products.groupBy("sku").agg(F.min("id").alias("product_id"))
    # A product's stock in all warehouses comes along with its SKU, so that lines are not shuffled once more to meet it.
    stock = t.warehouse_stock.groupBy("product_id").agg(F.collect_list(F.struct("warehouse", available().alias("_avail"))).alias("_stock"))
    shelves = skus.join(growing(stock), "product_id", "left")
    here = F.filter("_stock", lambda x: x["warehouse"] == F.col("warehouse"))
    # Allocation reads them several times, so the joins are done once.
    items = stage(
        lines.withColumn("sku", F.trim(F.coalesce("sku", F.lit("")))).withColumn("qty", parse_int("quantity"))
        .join(growing(accepted.select("request_id", "requested_at", warehouse.alias("warehouse"))), "request_id")
        .join(growing(shelves), "sku", "left")
        .select("*", F.explode_outer(here).alias("_here")).withColumn("_avail", F.col("_here._avail")).drop("_stock", "_here"),
        "invoice-items",
    )
    order = [F.col("requested_at"), F.col("request_id"), F.col("line_no")]
    stocked = items.where(F.col("_avail").isNotNull())
    served = allocate_fifo(stocked, ["product_id", "warehouse"], order, "qty", "_avail", "qty_fulfilled", hot_rows)
    unserved = items.where(F.col("_avail").isNull()).withColumns({"qty_fulfilled": F.lit(0), "_left": F.lit(None).cast("bigint")})
    short = F.col("qty") - F.col("qty_fulfilled")
    status = (
        F.when(F.col("_left") >= F.col("qty"), "fulfilled").when(F.col("_left") > 0, "partial").otherwise("backordered")
    )
    done = stage(served.unionByName(unserved).select(
        F.concat_ws("-", F.col("request_id").cast("string"), F.col("line_no").cast("string")).alias("id"),
        F.col("request_id").alias("invoice_id"), "product_id", "warehouse", "sku",
        F.trim(F.coalesce("description", F.lit(""))).alias("description"),
        text_or(F.trim(F.coalesce("barcode", F.lit(""))), None).alias("barcode"),
        parse_money("trade_price").alias("trade_price_gbp"), F.col("qty").alias("quantity"),
        parse_money("subtotal").alias("subtotal_gbp"), status.alias("fulfilment_status"), "qty_fulfilled",
        short.cast("int").alias("qty_backordered"), F.col("requested_at").alias("created_at"),
    ), "invoice-lines")
    reserve = done.where(F.col("qty_fulfilled") != 0).select("product_id", "warehouse", "qty_fulfilled")
    state = {
        "customers": append_rows(updated(t.customers, regions, "id"), new_customers),
        "invoices": append_rows(t.invoices, new_invoices),
        "invoice_lines": append_rows(t.invoice_lines, done.drop("warehouse")),
        "warehouse_stock": apply_deltas(t.warehouse_stock, reserve, "qty_fulfilled", "qty_reserved"),
    }
    summary = done.groupBy("invoice_id").agg(
        F.count("*").alias("line_count"),
        *[F.count_if(F.col("fulfilment_status") == s).alias(s) for s in ("fulfilled", "partial", "backordered")],
    )
    bad = union(
        reject(checked.where(F.col("_error").isNotNull()), F.col("_error")),
        reject(judged.where(~F.col("_ok")), "duplicate_invoice", "order_number"),
    )
    return JobResult(state, no_ledger(done), bad, new_invoices, {"lines": done, "summary": summary})
