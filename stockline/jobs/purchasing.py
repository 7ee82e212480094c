"""Suppliers, purchase orders and goods receipt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from stockline.functions import moment, parse_int, parse_money, replenish_qty, text_or
from stockline.jobs.common import (
    OUT_OF_RANGE, JobResult, append_rows, first_per, ledger_rows, missing, no_ledger, no_rejects, rank, reject, unfit, union,
    updated,
)
from stockline.operators.movements import apply_deltas, balances
from stockline.operators.numbering import assign_refs
from stockline.operators.prefix import HOT_ROWS, running_totals
from stockline.plans.intelligence import supplier_lead_time_stats
from stockline.sources.staging import stage
from stockline.tables import Tables


def ingest_suppliers(t: Tables, requests: DataFrame) -> JobResult:
    """New suppliers; a lead time that is 0 or not a number becomes 14 days."""
    named = requests.withColumn("name", F.trim(F.coalesce(F.col("name"), F.lit(""))))
    too_long = unfit(parse_int("lead_time_days"))
    good = named.where((F.col("name") != "") & ~too_long).select(
        F.col("request_id").alias("id"), "name", text_or("contact_email", None).alias("contact_email"),
        F.coalesce(F.nullif(parse_int("lead_time_days"), F.lit(0)), F.lit(14)).alias("lead_time_days"),
        text_or("currency", "GBP").alias("currency"), text_or("notes", None).alias("notes"),
    )
    bad = reject(
        named.where((F.col("name") == "") | too_long), F.when(F.col("name") == "", "name_required").otherwise(OUT_OF_RANGE))
    return JobResult({"suppliers": append_rows(t.suppliers, good)}, no_ledger(good), bad, good)


def _with_line_counts(requests: DataFrame, lines: DataFrame, *numbers: Column) -> DataFrame:
    """Add ``line_count`` and whether a line has a number that does not fit (``unfit``)."""
    counts = lines.groupBy("request_id").agg(F.count("*").alias("line_count"), F.bool_or(unfit(*numbers)).alias("unfit"))
    return requests.join(counts, "request_id", "left").withColumns({
        "line_count": F.coalesce("line_count", F.lit(0)), "unfit": F.coalesce("unfit", F.lit(False)),
    })


def create_purchase_orders(t: Tables, requests: DataFrame, lines: DataFrame) -> JobResult:
    """Draft purchase orders with the next PO references.

    ``requests``: request_id, supplier_id, warehouse_code, notes, requested_at.
    ``lines``: request_id, line_no, product_id, qty_ordered, unit_cost. The
    request id becomes the order's id.
    """
    counted = _with_line_counts(requests, lines, parse_int("qty_ordered"), parse_money("unit_cost"))
    error = (
        F.when(missing("supplier_id"), "supplier_id_required")
        .when(missing("warehouse_code"), "warehouse_code_required")
        .when(F.col("line_count") == 0, "lines_required").when(F.col("unfit"), OUT_OF_RANGE)
    )
    checked = counted.withColumn("_error", error)
    good = checked.where(F.col("_error").isNull())
    numbered = assign_refs(
        good, t.purchase_orders, "po_ref", "PO", F.year("requested_at"), [F.col("requested_at"), F.col("request_id")]
    )
    headers = numbered.select(
        F.col("request_id").alias("id"), "po_ref", "supplier_id", "warehouse_code", F.lit("draft").alias("status"),
        text_or("notes", None).alias("notes"), F.col("requested_at").alias("created_at"), "line_count",
    )
    new_lines = lines.join(good.select("request_id"), "request_id", "left_semi").select(
        F.concat_ws("-", F.col("request_id").cast("string"), F.col("line_no").cast("string")).alias("id"),
        F.col("request_id").alias("po_id"), "product_id", parse_int("qty_ordered").alias("qty_ordered"),
        F.lit(0).alias("qty_received"), parse_money("unit_cost").alias("unit_cost_gbp"),
    )
    ledger = ledger_rows(
        headers, "po_created", "purchase_order", F.col("id"),
        F.concat(F.lit("PO "), "po_ref", F.lit(" created for "), F.col("line_count").cast("string"),
                 F.lit(" line items")),
        F.col("created_at"), F.col("warehouse_code"),
    )
    bad = reject(checked.where(F.col("_error").isNotNull()), F.col("_error"))
    state = {
        "purchase_orders": append_rows(t.purchase_orders, headers), "po_lines": append_rows(t.po_lines, new_lines),
    }
    return JobResult(state, ledger, bad, headers, {"lines": new_lines})


def _po_requests(t: Tables, requests: DataFrame, status: str) -> DataFrame:
    """Requests (request_id, po_id, requested_at) with the order's state; ``_ok`` for the first on an order in ``status``."""
    state = t.purchase_orders.select(
        F.col("id").alias("po_id"), F.col("status").alias("po_status"), "po_ref", "warehouse_code"
    )
    return first_per(requests, "po_id").join(state, "po_id", "left").withColumn(
        "_ok", F.col("_first") & F.coalesce(F.col("po_status") == status, F.lit(False))
    )


def delete_draft_pos(t: Tables, requests: DataFrame) -> JobResult:
    checked = _po_requests(t, requests, "draft")
    gone = checked.where("_ok").select(F.col("po_id").alias("id"), "po_ref")
    state = {
        "purchase_orders": t.purchase_orders.join(gone.select("id"), "id", "left_anti"),
        "po_lines": t.po_lines.join(gone.select(F.col("id").alias("po_id")), "po_id", "left_anti"),
    }
    return JobResult(state, no_ledger(gone), reject(checked.where(~F.col("_ok")), "cannot_delete_non_draft", "po_id"),
                     gone)


def submit_pos(t: Tables, requests: DataFrame) -> JobResult:
    checked = _po_requests(t, requests, "draft")
    done = checked.where("_ok")
    changes = done.select(
        F.col("po_id").alias("id"), F.lit(True).alias("_hit"), F.lit("submitted").alias("status"),
        F.col("requested_at").alias("submitted_at"), F.col("requested_at").alias("updated_at"),
    )
    ledger = ledger_rows(
        done, "po_submitted", "purchase_order", F.col("po_id"),
        F.concat(F.lit("PO "), "po_ref", F.lit(" submitted")), F.col("requested_at"), F.col("warehouse_code"),
    )
    state = {"purchase_orders": updated(t.purchase_orders, changes, "id")}
    return JobResult(state, ledger, reject(checked.where(~F.col("_ok")), "cannot_submit", "po_id"), changes)


def receive_goods(t: Tables, receipts: DataFrame, hot_rows: int = HOT_ROWS) -> JobResult:
    """Book received quantities into stock.

    ``receipts``: request_id, po_id, requested_at, line_no, line_id, qty. Only
    submitted or partial orders receive. An order closes with the first request
    after which every line is complete; later requests on it are refused.
    There is no upper bound on a quantity.
    """
    orders = t.purchase_orders.select(F.col("id").alias("po_id"), "po_ref", "warehouse_code", "status")
    requests = receipts.groupBy("request_id", "po_id", "requested_at").agg(F.bool_or(unfit(parse_int("qty"))).alias("unfit"))
    open_po = F.coalesce(F.col("status").isin("submitted", "partial"), F.lit(False)) & ~F.col("unfit")
    # Read by every step below, so the receipts are grouped once.
    known = stage(requests.join(orders, "po_id", "left").withColumn("_open", open_po), "receipt-requests")
    served = known.where("_open")

    po_lines = t.po_lines.select(
        F.col("id").alias("line_id"), "po_id", "product_id", "qty_ordered", "qty_received"
    )
    # Read three times below, so the joins are done once.
    effective = stage(
        receipts.withColumn("qty", parse_int("qty")).where(F.col("qty") > 0)
        .join(served.select("request_id", "po_id", "po_ref", "warehouse_code"), ["request_id", "po_id"])
        .join(po_lines, ["line_id", "po_id"]),
        "receipts",
    )
    order = [F.col("requested_at"), F.col("request_id"), F.col("line_no")]
    filled = running_totals(effective, ["line_id"], order, {"_earlier": F.col("qty")}, hot_rows=hot_rows)
    full = F.col("qty_received") + F.col("_earlier") + F.col("qty") >= F.col("qty_ordered")
    reached = filled.where(full).groupBy("line_id").agg(F.min(rank()).alias("_at"))

    # When is the last open line of an order filled?
    asked = served.select("po_id").distinct()
    progress = po_lines.join(asked, "po_id", "left_semi").join(reached, "line_id", "left")
    already = F.col("qty_received") >= F.col("qty_ordered")
    complete = progress.groupBy("po_id").agg(
        F.bool_and(already | F.col("_at").isNotNull()).alias("_all"),
        F.max(F.when(~already, F.col("_at"))).alias("_complete_at"),
    ).where("_all")
    closing = served.join(complete, "po_id").where(
        F.col("_complete_at").isNull() | (rank() >= F.col("_complete_at"))
    ).groupBy("po_id").agg(F.min(rank()).alias("_closed"))

    judged = stage(known.join(closing, "po_id", "left").withColumn(
        "_ok", F.col("_open") & (F.col("_closed").isNull() | (rank() <= F.col("_closed")))
    ), "judged")
    accepted = judged.where("_ok")
    booked = effective.join(accepted.select("request_id", "po_id"), ["request_id", "po_id"], "left_semi").select(
        "request_id", "po_id", "po_ref", "line_id", "line_no", "requested_at", "product_id",
        F.col("warehouse_code").alias("warehouse"), F.col("qty").alias("qty_change"),
    )
    per_line = booked.groupBy("line_id").agg(F.sum("qty_change").alias("_got"))
    new_lines = t.po_lines.join(per_line, F.col("id") == F.col("line_id"), "left").select(*[
        (F.col(c) + F.coalesce("_got", F.lit(0))).cast("int").alias(c) if c == "qty_received" else F.col(c)
        for c in t.po_lines.columns
    ])
    any_received = po_lines.join(asked, "po_id", "left_semi").join(per_line, "line_id", "left").groupBy("po_id").agg(
        F.bool_or(F.col("qty_received") + F.coalesce("_got", F.lit(0)) > 0).alias("_any")
    )
    last = accepted.groupBy("po_id", "status").agg(
        F.max("requested_at").alias("updated_at"), F.max("_closed").alias("_closed")
    )
    changes = (
        last.join(any_received, "po_id", "left")
        .join(t.purchase_orders.select(F.col("id").alias("po_id"), F.col("received_at").alias("_was")), "po_id")
        .select(
            F.col("po_id").alias("id"), F.lit(True).alias("_hit"),
            F.when(F.col("_closed").isNotNull(), "received").when(F.col("_any"), "partial")
            .otherwise(F.col("status")).alias("status"),
            "updated_at", F.coalesce("_closed.requested_at", "_was").alias("received_at"),
        )
    )
    moved = balances(t.warehouse_stock, booked, order, absent=F.col("qty_change"), hot_rows=hot_rows)
    ledger = ledger_rows(
        moved, "stock_received", "purchase_order", F.col("po_id"),
        F.concat(F.lit("Received "), F.col("qty_change").cast("string"), F.lit(" units via "), "po_ref"),
        F.col("requested_at"), F.col("warehouse"), F.col("product_id"), F.col("qty_change"), F.col("balance_after"),
    )
    state = {
        "warehouse_stock": apply_deltas(t.warehouse_stock, booked),
        "po_lines": new_lines,
        "purchase_orders": updated(t.purchase_orders, changes, "id"),
    }
    return JobResult(state, ledger, reject(
        judged.where(~F.col("_ok")), F.when(F.col("unfit"), OUT_OF_RANGE).otherwise("cannot_receive"), "po_id"), changes)


def auto_reorder(t: Tables, asof, warehouse=None) -> JobResult:
    """One draft purchase order per warehouse and supplier for stock at or below its reorder point."""
    at = moment(asof)
    low = t.warehouse_stock.where((F.col("qty_on_hand") <= F.col("reorder_point")) & (F.col("reorder_point") > 0))
    if warehouse is not None:
        low = low.where(F.col("warehouse") == F.lit(warehouse))
    products = t.products.where(F.col("supplier_id").isNotNull()).select(
        F.col("id").alias("product_id"), "supplier_id", "cost_price_gbp", "case_pack"
    )
    items = low.join(products, "product_id").select(
        F.concat_ws("-", F.lit("auto"), F.date_format(at, "yyyyMMddHHmmss"), F.col("warehouse").cast("string"),
                    F.col("supplier_id").cast("string")).alias("po_id"),
        F.col("warehouse").alias("warehouse_code"), "supplier_id", "product_id",
        replenish_qty("max_stock", "qty_on_hand", "case_pack").cast("int").alias("qty_ordered"),
        F.col("cost_price_gbp").alias("unit_cost_gbp"),
    )
    suppliers = t.suppliers.select(F.col("id").alias("supplier_id"), F.col("name").alias("supplier_name"))
    headers = items.groupBy("po_id", "warehouse_code", "supplier_id").agg(F.count("*").alias("line_count")).join(
        suppliers, "supplier_id", "left"
    )
    numbered = assign_refs(
        headers, t.purchase_orders, "po_ref", "PO", F.year(at), [F.col("warehouse_code"), F.col("supplier_id")]
    ).select(
        F.col("po_id").alias("id"), "po_ref", "supplier_id", "supplier_name", "warehouse_code",
        F.lit("draft").alias("status"), at.alias("created_at"), "line_count",
        F.concat(F.lit("Auto-generated reorder for "), F.col("line_count").cast("string"),
                 F.lit(" low-stock items")).alias("notes"),
    )
    lines = items.select(
        F.concat_ws("-", F.col("po_id"), F.col("product_id").cast("string")).alias("id"), "po_id", "product_id",
        "qty_ordered", F.lit(0).alias("qty_received"), "unit_cost_gbp",
    )
    ledger = ledger_rows(
        numbered, "po_auto_created", "purchase_order", F.col("id"),
        F.concat(F.lit("Auto-reorder PO "), "po_ref", F.lit(": "), F.col("line_count").cast("string"),
                 F.lit(" items for "), F.coalesce("supplier_name", F.lit("unknown supplier"))),
        at, F.col("warehouse_code"),
    )
    state = {
        "purchase_orders": append_rows(t.purchase_orders, numbered), "po_lines": append_rows(t.po_lines, lines),
    }
    return JobResult(state, ledger, no_rejects(lines), numbered, {"lines": lines})


def update_lead_times(t: Tables, asof) -> JobResult:
    """Store measured lead times; move the promise when at least two orders differ by more than 20 %.

    The new promise is ceil(0.7 × measured + 0.3 × promised); a supplier counts
    as adjusted only if that changes the number. From a promise of 0 (or none,
    which counts as 0) any difference is more than 20 %.
    """
    stats = supplier_lead_time_stats(t)
    actual, promised = F.col("avg_actual_days"), F.coalesce("promised_days", F.lit(0))
    drift = F.try_divide(F.abs(actual - promised), promised.cast("decimal(10,1)"))
    proposed = F.ceil(actual * F.lit("0.7").cast("decimal(2,1)") + promised * F.lit("0.3").cast("decimal(2,1)"))
    far = F.coalesce(drift > F.lit("0.2").cast("decimal(2,1)"), actual != 0)
    adjust = (F.col("po_count") >= 2) & far & (proposed != promised)
    out = stats.select(
        "*", F.coalesce(adjust, F.lit(False)).alias("adjusted"),
        F.when(adjust, proposed).otherwise(promised).cast("int").alias("new_lead_time"),
    )
    changes = out.select(
        F.col("supplier_id").alias("id"), F.lit(True).alias("_hit"), actual.alias("actual_lead_time_days"),
        F.col("new_lead_time").alias("lead_time_days"),
    )
    ledger = ledger_rows(
        out.where("adjusted"), "lead_time_adjusted", "supplier", F.col("supplier_id"),
        F.concat("supplier_name", F.lit(": lead time adjusted from "), promised.cast("string"), F.lit("d to "),
                 F.col("new_lead_time").cast("string"), F.lit("d (actual avg: "), actual.cast("string"),
                 F.lit("d across "), F.col("po_count").cast("string"), F.lit(" POs)")),
        moment(asof),
    )
    return JobResult({"suppliers": updated(t.suppliers, changes, "id")}, ledger, no_rejects(out), out)
