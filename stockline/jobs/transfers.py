"""Stock transfers between warehouses."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from stockline.functions import parse_int, text_or
from stockline.jobs.common import OUT_OF_RANGE, JobResult, append_rows, first_per, ledger_rows, missing, reject, updated
from stockline.jobs.purchasing import _with_line_counts
from stockline.operators.admission import admit_all_or_nothing, so_far
from stockline.operators.movements import apply_deltas, balances, create_missing
from stockline.operators.numbering import assign_refs
from stockline.operators.prefix import HOT_ROWS, hot_groups, running_totals
from stockline.sources.staging import stage
from stockline.tables import Tables


def create_transfers(t: Tables, requests: DataFrame, lines: DataFrame) -> JobResult:
    """``requests``: request_id, from_warehouse, to_warehouse, notes, requested_at; ``lines``: request_id, line_no, product_id, qty."""
    counted = _with_line_counts(requests, lines, parse_int("qty"))
    error = (
        F.when(missing("from_warehouse", "to_warehouse"), "warehouses_required")
        .when(F.col("from_warehouse") == F.col("to_warehouse"), "same_warehouse")
        .when(F.col("line_count") == 0, "lines_required").when(F.col("unfit"), OUT_OF_RANGE)
    )
    checked = counted.withColumn("_error", error)
    good = checked.where(F.col("_error").isNull())
    headers = assign_refs(
        good, t.stock_transfers, "transfer_ref", "TXF", F.year("requested_at"),
        [F.col("requested_at"), F.col("request_id")],
    ).select(
        F.col("request_id").alias("id"), "transfer_ref", "from_warehouse", "to_warehouse",
        F.lit("requested").alias("status"), text_or("notes", None).alias("notes"),
        F.col("requested_at").alias("created_at"), "line_count",
    )
    new_lines = lines.join(good.select("request_id"), "request_id", "left_semi").select(
        F.concat_ws("-", F.col("request_id").cast("string"), F.col("line_no").cast("string")).alias("id"),
        F.col("request_id").alias("transfer_id"), "product_id", parse_int("qty").alias("qty"),
    )
    ledger = ledger_rows(
        headers, "transfer_created", "stock_transfer", F.col("id"),
        F.concat(F.lit("Transfer "), "transfer_ref", F.lit(": "), F.col("from_warehouse").cast("string"),
                 F.lit(" → "), F.col("to_warehouse").cast("string"), F.lit(", "),
                 F.col("line_count").cast("string"), F.lit(" items")),
        F.col("created_at"), F.col("from_warehouse"),
    )
    state = {
        "stock_transfers": append_rows(t.stock_transfers, headers),
        "transfer_lines": append_rows(t.transfer_lines, new_lines),
    }
    bad = reject(checked.where(F.col("_error").isNotNull()), F.col("_error"))
    return JobResult(state, ledger, bad, headers, {"lines": new_lines})


def _judged(t: Tables, requests: DataFrame, status: str) -> DataFrame:
    state = t.stock_transfers.select(
        F.col("id").alias("transfer_id"), "transfer_ref", "from_warehouse", "to_warehouse",
        F.col("status").alias("transfer_status"),
    )
    return first_per(requests, "transfer_id").join(state, "transfer_id", "left").withColumn(
        "_in_state", F.coalesce(F.col("transfer_status") == status, F.lit(False))
    )


def _lines(t: Tables, headers: DataFrame) -> DataFrame:
    lines = t.transfer_lines.select(F.col("id").alias("line_id"), "transfer_id", "product_id", "qty")
    return lines.join(headers, "transfer_id")


_ORDER = ("requested_at", "transfer_id", "line_id")
_PLACE = ["product_id", "from_warehouse"]


def dispatch_transfers(t: Tables, requests: DataFrame, hot_rows: int = HOT_ROWS) -> JobResult:
    """Take the stock of requested transfers out of their source warehouse, all lines or none.

    ``requests``: request_id, transfer_id, requested_at. The check is against
    on-hand stock and ignores reservations; lines are served in the order of
    their ids, and a negative one adds to the stock. A transfer refused for want
    of stock names the product of its first line that fails.
    """
    judged = _judged(t, requests, "requested")
    wanted = judged.where(F.col("_first") & F.col("_in_state"))
    stock = t.warehouse_stock.select(
        "product_id", F.col("warehouse").alias("from_warehouse"), F.col("qty_on_hand").alias("supply"))
    lines = stage(_lines(t, wanted).join(stock, ["product_id", "from_warehouse"], "left").select(
        "transfer_id", "line_id", "product_id", "from_warehouse", "requested_at", "qty", "supply"), "transfer-lines")
    admitted = stage(admit_all_or_nothing(
        lines, "transfer_id", _PLACE, ["requested_at"], "qty", "supply", ["line_id"], hot_rows=hot_rows,
    ), "admitted")
    # A transfer without lines has nothing to fail on.
    outcome = wanted.join(admitted, "transfer_id", "left").withColumn("accepted", F.coalesce("accepted", F.lit(True)))
    short = _first_short(lines, admitted, hot_rows)
    sent = outcome.where("accepted")
    moves = _lines(t, sent).select(
        "transfer_id", "transfer_ref", "line_id", "requested_at", "to_warehouse", "product_id",
        F.col("from_warehouse").alias("warehouse"), (-F.col("qty")).alias("qty_change"),
    )
    moved = balances(t.warehouse_stock, moves, [F.col(c) for c in _ORDER], absent=F.lit(None), hot_rows=hot_rows)
    ledger = ledger_rows(
        moved, "stock_transferred_out", "stock_transfer", F.col("transfer_id"),
        F.concat(F.lit("Dispatched "), (-F.col("qty_change")).cast("string"), F.lit(" units via "), "transfer_ref",
                 F.lit(" → "), F.col("to_warehouse").cast("string")),
        F.col("requested_at"), F.col("warehouse"), F.col("product_id"), F.col("qty_change"), F.col("balance_after"),
    )
    changes = sent.select(
        F.col("transfer_id").alias("id"), F.lit(True).alias("_hit"), F.lit("in_transit").alias("status"),
        F.col("requested_at").alias("updated_at"),
    )
    verdict = outcome.select("transfer_id", "accepted").join(short, "transfer_id", "left")
    refused = judged.join(verdict, "transfer_id", "left").withColumn(
        "_error",
        F.when(~F.col("_in_state"), "cannot_dispatch").when(~F.col("accepted"), "insufficient_stock")
        .when(~F.col("_first"), "cannot_dispatch"),
    ).where(F.col("_error").isNotNull()).withColumn(
        "_detail", F.when(F.col("_error") == "insufficient_stock", F.col("_short").cast("string"))
        .otherwise(F.col("transfer_id").cast("string")))
    state = {
        "warehouse_stock": apply_deltas(t.warehouse_stock, moves),
        "stock_transfers": updated(t.stock_transfers, changes, "id"),
    }
    return JobResult(state, ledger, reject(refused, F.col("_error"), "_detail"), changes)


def _first_short(lines: DataFrame, admitted: DataFrame, hot_rows: int) -> DataFrame:
    """``transfer_id, _short``: the product of the first line of a refused transfer that finds too little."""
    # Large groups are looked for in the staged lines, not in the totals.
    own = ["transfer_id", *_PLACE]
    hot, hot_own = hot_groups(lines, _PLACE, hot_rows), hot_groups(lines, own, hot_rows)
    taken = running_totals(
        lines.join(admitted, "transfer_id"), _PLACE, [F.col(c) for c in _ORDER],
        {"_taken": F.when(F.col("accepted"), F.col("qty")).otherwise(0)}, hot_rows=hot_rows, hot=hot)
    refused = so_far(taken.where("NOT accepted"), own, ["line_id"], "qty", hot_rows, hot_own)
    fails = ~F.coalesce(F.col("supply") - F.col("_taken") >= F.col("_so_far"), F.lit(False))
    return refused.where(fails).groupBy("transfer_id").agg(F.min_by("product_id", "line_id").alias("_short"))


def receive_transfers(t: Tables, requests: DataFrame, hot_rows: int = HOT_ROWS) -> JobResult:
    """Add the stock of transfers in transit to their destination, creating missing stock rows."""
    judged = _judged(t, requests, "in_transit").withColumn("_ok", F.col("_first") & F.col("_in_state"))
    arrived = judged.where("_ok")
    moves = _lines(t, arrived).select(
        "transfer_id", "transfer_ref", "line_id", "requested_at", "from_warehouse", "product_id",
        F.col("to_warehouse").alias("warehouse"), F.col("qty").alias("qty_change"),
    )
    # A created row starts at 0, so its balances are running totals from there.
    with_new = t.warehouse_stock.select("product_id", "warehouse", "qty_on_hand").unionByName(
        create_missing(t.warehouse_stock, moves).select("product_id", "warehouse", F.lit(0).alias("qty_on_hand"))
    )
    moved = balances(with_new, moves, [F.col(c) for c in _ORDER], absent=F.col("qty_change"), hot_rows=hot_rows)
    ledger = ledger_rows(
        moved, "stock_transferred_in", "stock_transfer", F.col("transfer_id"),
        F.concat(F.lit("Received "), F.col("qty_change").cast("string"), F.lit(" units via "), "transfer_ref",
                 F.lit(" from "), F.col("from_warehouse").cast("string")),
        F.col("requested_at"), F.col("warehouse"), F.col("product_id"), F.col("qty_change"), F.col("balance_after"),
    )
    changes = arrived.select(
        F.col("transfer_id").alias("id"), F.lit(True).alias("_hit"), F.lit("received").alias("status"),
        F.col("requested_at").alias("updated_at"),
    )
    state = {
        "warehouse_stock": apply_deltas(t.warehouse_stock, moves).unionByName(
            create_missing(t.warehouse_stock, moves)
        ),
        "stock_transfers": updated(t.stock_transfers, changes, "id"),
    }
    return JobResult(state, ledger, reject(judged.where(~F.col("_ok")), "cannot_receive", "transfer_id"), changes)
