"""Queries over the append-only stock ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from stockline.sources.snapshots import newest_days
from stockline.tables import Tables

# Activity category of each ledger action; anything else is "other".
CATEGORIES = {
    "stock": ("stock_received", "stock_shipped", "stock_adjusted", "stock_returned", "stock_written_off"),
    "transfers": ("stock_transferred_out", "stock_transferred_in", "transfer_created"),
    "orders": ("order_created", "order_pick", "order_pack", "order_ship"),
    "po": ("po_created", "po_submitted", "po_auto_created", "po_received"),
    "returns": ("return_created", "return_processed"),
}

# Prefixes of the document references that appear in notes.
REF_PREFIXES = ("PO", "ORD", "TXF", "RMA", "CC")


def category(action: str = "action") -> Column:
    out = F.when(F.lit(False), "")
    for name, actions in CATEGORIES.items():
        out = out.when(F.col(action).isin(list(actions)), name)
    return out.otherwise("other")


def _filtered(log: DataFrame, warehouse, action: str) -> DataFrame:
    if warehouse is not None:
        log = log.where(F.col("warehouse_code") == F.lit(warehouse))
    if action:
        log = log.where(F.col("action") == action)
    return log


def audit_search(t: Tables, warehouse=None, action: str = "", limit: int = 100) -> DataFrame:
    """Newest ledger rows with product names.

    The top rows are chosen before the join, so only ``limit`` rows meet the
    product table.
    """
    newest = _filtered(t.audit_log, warehouse, action).orderBy(F.desc("created_at"), F.desc("id")).limit(limit)
    products = t.products.select(
        F.col("id").alias("product_id"), F.col("name").alias("product_name"), F.col("sku").alias("product_sku")
    )
    return (
        newest.join(products, "product_id", "left")
        .select(
            "id", "created_at", "action", "entity_type", "entity_id", "warehouse_code", "product_id", "qty_change",
            "balance_after", "notes", "product_name", "product_sku",
        )
        .orderBy(F.desc("created_at"), F.desc("id"))
    )


def audit_search_newest(t: Tables, ledger: DataFrame, warehouse=None, action: str = "", limit: int = 100) -> DataFrame:
    """``audit_search`` over a ledger folder (``read_ledger``) that reads the newest days only, until ``limit`` rows are found."""
    newest = newest_days(_filtered(ledger, warehouse, action), limit)
    return audit_search(t.replace(audit_log=newest), warehouse, action, limit)


def ledger_timeline(t: Tables, warehouse=None, category_filter: str = "") -> DataFrame:
    """Ledger rows per day, warehouse and category with their net quantity."""
    log = _filtered(t.audit_log, warehouse, "").select(
        F.to_date("created_at").alias("day"), "warehouse_code", category().alias("category"), "qty_change"
    )
    if category_filter:
        log = log.where(F.col("category") == category_filter)
    return (
        log.groupBy("day", "warehouse_code", "category")
        .agg(F.count("*").alias("entries"), F.coalesce(F.sum("qty_change"), F.lit(0)).cast("bigint").alias("net_qty"))
        .orderBy(F.desc("day"), "warehouse_code", "category")
    )


def extract_refs(t: Tables) -> DataFrame:
    """First reference of each document kind in a ledger row's notes, one row per reference found."""
    found = F.array(*[
        F.struct(
            F.lit(prefix).alias("kind"),
            # A reference may start inside a word, as the reference's search allows.
            F.nullif(F.regexp_extract("notes", rf"({prefix}-\d{{4}}-\d+)", 1), F.lit("")).alias("ref"),
        )
        for prefix in REF_PREFIXES
    ])
    return (
        t.audit_log.where(F.col("notes").isNotNull())
        .select("id", F.inline(F.filter(found, lambda x: x["ref"].isNotNull())))
    )


def table_row_counts(t: Tables) -> DataFrame:
    """Rows per table; each count is answered from file footers or a narrow scan."""
    counts = None
    for name in sorted(t):
        one = t[name].agg(F.count("*").alias("rows")).select(F.lit(name).alias("table_name"), "rows")
        counts = one if counts is None else counts.unionByName(one)
    return counts
