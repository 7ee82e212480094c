"""Order intake, credit, review, fulfilment and backorders."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from stockline.functions import MONEY, available, moment, parse_int, parse_money, parse_number, text_or
from stockline.jobs.common import (
    OUT_OF_RANGE, JobResult, append_rows, first_per, ledger_rows, missing, no_ledger, no_rejects, rank, reject, unfit, union,
    updated,
)
from stockline.jobs.purchasing import _with_line_counts
from stockline.operators.admission import FOLD_ROWS, admit_within_limit
from stockline.operators.allocation import allocate_fifo
from stockline.operators.movements import apply_deltas, balances
from stockline.operators.joins import growing
from stockline.operators.numbering import assign_refs
from stockline.operators.prefix import HOT_ROWS, running_totals
from stockline.plans.pricing import price_order_lines
from stockline.sources.staging import stage
from stockline.tables import Tables


# -- fulfilment stages -------------------------------------------------------

def judge_stages(orders: DataFrame, requests: DataFrame) -> DataFrame:
    """Judge order actions: adds ``from_status``, ``to_status``, ``accepted`` and the order's columns.

    ``orders``: order_id, was (its stage) and any columns to carry along;
    ``requests``: request_id, order_id, action, requested_at. An order only ever
    moves forward, so of each action the first one that comes after the accepted
    earlier stage is the accepted one: three minima over one grouping key, and
    no order's requests have to be gathered.
    """
    asked = stage(
        requests.select("request_id", "order_id", "action", "requested_at").join(orders, "order_id", "left"), "actions"
    )
    at, action, was = rank(), F.col("action"), F.col("was")
    picked = asked.where((action == "pick") & (was == "confirmed")).groupBy("order_id").agg(F.min(at).alias("pick_at"))
    can_pack = (action == "pack") & (
        was.isin("picking", "picked") | ((was == "confirmed") & (at > F.col("pick_at")))
    )
    packed = asked.join(picked, "order_id", "left").where(can_pack).groupBy("order_id").agg(F.min(at).alias("pack_at"))
    can_ship = (action == "ship") & (
        was.isin("packing", "packed") | (at > F.col("pack_at"))
    )
    shipped = asked.join(packed, "order_id", "left").where(can_ship).groupBy("order_id").agg(F.min(at).alias("ship_at"))
    before = (
        F.when(F.col("ship_at") < at, "shipped").when(F.col("pack_at") < at, "packing")
        .when(F.col("pick_at") < at, "picking").otherwise(was)
    )
    accepted = F.coalesce(
        ((action == "pick") & (at == F.col("pick_at"))) | ((action == "pack") & (at == F.col("pack_at")))
        | ((action == "ship") & (at == F.col("ship_at"))), F.lit(False))
    target = F.when(action == "pick", "picking").when(action == "pack", "packing").otherwise("shipped")
    return stage(
        asked.join(picked, "order_id", "left").join(packed, "order_id", "left").join(shipped, "order_id", "left")
        .withColumn("from_status", before).withColumn("accepted", accepted)
        .withColumn("to_status", F.when(F.col("accepted"), target).otherwise(F.col("from_status")))
        .drop("pick_at", "pack_at", "ship_at"),
        "judged",
    )


def advance_orders(t: Tables, requests: DataFrame, hot_rows: int = HOT_ROWS) -> JobResult:
    """Move orders through picking, packing and shipping; shipping takes stock.

    ``requests``: request_id, order_id, action (pick, pack, ship), requested_at.
    Shipping has no lower bound on stock and does not release reservations.
    """
    orders = t.orders.select(
        F.col("id").alias("order_id"), "order_ref", "warehouse_code", F.col("fulfilment_status").alias("was")
    )
    at, action = rank(), F.col("action")
    judged = judge_stages(orders, requests).withColumn("_ok", F.col("accepted"))
    done = judged.where("_ok").withColumn("new_status", F.col("to_status"))
    changes = done.groupBy("order_id").agg(F.max_by("new_status", at).alias("fulfilment_status")).select(
        F.col("order_id").alias("id"), F.lit(True).alias("_hit"), "fulfilment_status"
    )
    gone = done.where((action == "ship") & F.col("warehouse_code").isNotNull())
    lines = t.order_lines.where(F.col("product_id").isNotNull()).select(
        F.col("id").alias("line_id"), "order_id", "product_id", "qty_ordered"
    )
    moves = lines.join(gone, "order_id").select(
        "order_id", "order_ref", "line_id", "requested_at", "request_id", "product_id",
        F.col("warehouse_code").alias("warehouse"), (-F.col("qty_ordered")).alias("qty_change"),
    )
    moved = balances(
        t.warehouse_stock, moves, [F.col("requested_at"), F.col("request_id"), F.col("line_id")], absent=F.lit(0),
        hot_rows=hot_rows,
    )
    ledger = union(
        ledger_rows(
            moved, "stock_shipped", "order", F.col("order_id"),
            F.concat(F.lit("Shipped "), (-F.col("qty_change")).cast("string"), F.lit(" units for "), "order_ref"),
            F.col("requested_at"), F.col("warehouse"), F.col("product_id"), F.col("qty_change"),
            F.col("balance_after"),
        ),
        ledger_rows(
            done, F.concat(F.lit("order_"), action), "order", F.col("order_id"),
            F.concat(F.lit("Order "), "order_ref", F.lit(" → "), "new_status"), F.col("requested_at"),
            F.col("warehouse_code"),
        ),
    )
    state = {
        "orders": updated(t.orders, changes, "id"),
        "warehouse_stock": apply_deltas(t.warehouse_stock, moves),
    }
    return JobResult(state, ledger, reject(judged.where(~F.col("_ok")), "invalid_transition", "order_id"), changes)


# -- review ------------------------------------------------------------------

def review_decisions(t: Tables, requests: DataFrame, decisions: DataFrame, hot_rows: int = HOT_ROWS) -> JobResult:
    """Apply reviewers' decisions to order lines and reserve what will ship.

    ``requests``: request_id, order_id, requested_at. ``decisions``: request_id,
    line_no, line_id, decision, custom_qty. ship_available ships what is there,
    custom ships the stated quantity without any bound, hold ships nothing.

    Availability only falls. While it is positive, every decision takes its full
    demand; the one that uses it up is found by a running total. After that only
    custom quantities lower it further, by a second running total. So no line
    has to wait for another. ``over_requested`` and ``overdrawn`` in the output
    flag custom quantities above the request and ships from negative stock.
    """
    counts = decisions.groupBy("request_id").agg(
        F.count("*").alias("decided"), F.bool_or(F.coalesce(F.col("decision") == "custom", F.lit(False)) & unfit(parse_int("custom_qty"))).alias("unfit"))
    orders = t.orders.select(
        F.col("id").alias("order_id"), "order_ref", "warehouse_code",
        F.coalesce("requires_review", F.lit(False)).alias("_open"),
    )
    nonempty = requests.join(counts, "request_id", "left")
    empty = nonempty.where(F.col("decided").isNull())
    judged = first_per(nonempty.where("NOT unfit"), "order_id").join(
        orders, "order_id", "left"
    ).withColumn("_ok", F.col("_first") & F.coalesce("_open", F.lit(False)))
    served = judged.where("_ok")

    lines = t.order_lines.select(
        F.col("id").alias("line_id"), "order_id", "product_id", "unit_price_gbp",
        F.coalesce(F.nullif(F.col("qty_requested"), F.lit(0)), F.col("qty_ordered")).alias("requested"),
    )
    stock = t.warehouse_stock.select(
        "product_id", F.col("warehouse").alias("warehouse_code"), available().alias("opening")
    )
    decision = F.col("decision")
    custom = F.greatest(F.lit(0), parse_int("custom_qty"))
    # Running totals read it several times, so the joins are done once.
    work = stage(
        decisions.where(decision.isin("ship_available", "custom", "hold"))
        .join(served.select("request_id", "order_id", "order_ref", "warehouse_code", "requested_at"), "request_id")
        .join(lines, ["line_id", "order_id"])
        .join(growing(stock), ["product_id", "warehouse_code"], "left")
        .withColumn("_custom", F.when(decision == "custom", custom).otherwise(0))
        .withColumn("_demand", F.when(decision == "ship_available", F.col("requested")).otherwise(F.col("_custom"))),
        "review-work",
    )
    keys = ["product_id", "warehouse_code"]
    order = [F.col("requested_at"), F.col("request_id"), F.col("line_no")]
    summed = stage(running_totals(
        work, keys, order, {"_before": F.col("_demand"), "_custom_before": F.col("_custom")}, hot_rows=hot_rows
    ), "review")
    opening, before = F.col("opening"), F.col("_before")
    used_up = summed.where(
        (opening > 0) & (before < opening) & (before + F.col("_demand") >= opening)
    ).select(
        *keys,
        F.when(decision == "ship_available", 0).otherwise(opening - before - F.col("_demand")).alias("_rest"),
        (F.col("_custom_before") + F.col("_custom")).alias("_custom_then"),
    )
    # At most one row per stock row; a hot key's side is split by the adaptive join.
    known = summed.join(used_up, keys, "left")
    avail = (
        F.when(opening.isNull(), 0)
        .when(opening <= 0, opening - F.col("_custom_before"))
        .when(before < opening, opening - before)
        .otherwise(F.col("_rest") - (F.col("_custom_before") - F.col("_custom_then")))
    )
    ship = F.when(decision == "ship_available", F.least("requested", avail)).otherwise(F.col("_custom"))
    decided = known.withColumn("qty_to_ship", ship.cast("int")).select(
        "request_id", "order_id", "line_id", "line_no", "product_id", "warehouse_code", "requested", "decision",
        "unit_price_gbp", "qty_to_ship",
        (F.col("requested") - F.col("qty_to_ship")).cast("int").alias("qty_to_backorder"),
        (F.col("qty_to_ship") > F.col("requested")).alias("over_requested"), (avail < 0).alias("overdrawn"),
    )
    status = (
        F.when(F.col("qty_to_backorder") > 0, F.when(F.col("qty_to_ship") > 0, "partial").otherwise("backordered"))
        .otherwise("unmatched")
    )
    last = decided.groupBy("line_id").agg(F.max_by(
        F.struct("decision", "qty_to_ship", "qty_to_backorder", status.alias("status")), "line_no").alias("d"))
    line_changes = last.select(
        F.col("line_id").alias("id"), F.lit(True).alias("_hit"), F.col("d.decision").alias("fulfilment_decision"),
        F.col("d.qty_to_ship").alias("qty_to_ship"), F.col("d.qty_to_backorder").alias("qty_to_backorder"),
        F.col("d.qty_to_ship").alias("qty_ordered"), F.lit(0).alias("qty_fulfilled"),
        F.col("d.qty_to_backorder").alias("qty_backordered"), F.col("d.status").alias("fulfilment_status"),
    )
    values = decided.groupBy("order_id").agg(
        F.sum(F.col("qty_to_ship") * F.col("unit_price_gbp")).cast(MONEY).alias("value")
    )
    closed = served.join(values, "order_id", "left").withColumn(
        "value", F.coalesce("value", F.lit(0)).cast(MONEY)
    )
    order_changes = closed.select(
        F.col("order_id").alias("id"), F.lit(True).alias("_hit"), F.lit(False).alias("requires_review"),
        F.col("value").alias("total_gbp"),
    )
    reserve = decided.where((F.col("qty_to_ship") > 0) & F.col("product_id").isNotNull()).select(
        "product_id", F.col("warehouse_code").alias("warehouse"), "qty_to_ship"
    )
    ledger = ledger_rows(
        closed, "order_reviewed", "order", F.col("order_id"),
        F.concat(F.lit("Order "), "order_ref", F.lit(" reviewed: £"), F.col("value").cast("string"),
                 F.lit(" to ship, "), F.col("decided").cast("string"), F.lit(" lines decided")),
        F.col("requested_at"), F.col("warehouse_code"),
    )
    state = {
        "order_lines": updated(t.order_lines, line_changes, "id"),
        "orders": updated(t.orders, order_changes, "id"),
        "warehouse_stock": apply_deltas(t.warehouse_stock, reserve, "qty_to_ship", "qty_reserved"),
    }
    bad = union(
        reject(empty, "lines_required"), reject(nonempty.where("unfit"), OUT_OF_RANGE, "order_id"),
        reject(judged.where(~F.col("_ok")), "not_reviewable", "order_id"),
    )
    return JobResult(state, ledger, bad, decided)


# -- credit and intake -------------------------------------------------------

def _credit_terms(t: Tables) -> DataFrame:
    on_credit = (F.coalesce("payment_terms", F.lit("")) != "prepaid") & (F.col("credit_limit_gbp") > 0)
    left = (F.col("credit_limit_gbp") - F.coalesce("credit_used_gbp", F.lit(0))).cast("decimal(14,2)")
    return t.customers.select(
        F.col("id").alias("customer_id"), F.coalesce(on_credit, F.lit(False)).alias("on_credit"),
        F.when(on_credit, (left * 100).cast("bigint")).alias("_left_pence"),
    )


def _admit(t: Tables, requests: DataFrame, forced: str | None, fold_rows: int, hot_rows: int) -> DataFrame:
    """Add ``accepted`` to requests with customer_id, total_gbp, requested_at and request_id."""
    terms = requests.join(_credit_terms(t), "customer_id", "left").withColumn(
        "on_credit", F.coalesce("on_credit", F.lit(False))
    ).withColumn("_pence", (F.col("total_gbp") * 100).cast("bigint"))
    free = terms.where(~F.col("on_credit")).withColumn("accepted", F.lit(True))
    checked = admit_within_limit(
        terms.where("on_credit"), "customer_id", ["requested_at", "request_id"], "_pence", "_left_pence",
        forced=forced, fold_rows=fold_rows, hot_rows=hot_rows,
    )
    return free.unionByName(checked).drop("_pence", "_left_pence")


def _charged(t: Tables, admitted: DataFrame) -> DataFrame:
    spent = admitted.where(F.col("accepted") & F.col("on_credit")).groupBy("customer_id").agg(
        F.sum("total_gbp").alias("_spent")
    ).withColumnRenamed("customer_id", "id")
    kind = dict(t.customers.dtypes)["credit_used_gbp"]
    return t.customers.join(spent, "id", "left").select(*[
        (F.coalesce("credit_used_gbp", F.lit(0)) + F.coalesce("_spent", F.lit(0))).cast(kind).alias(c)
        if c == "credit_used_gbp" else F.col(c) for c in t.customers.columns
    ])


def check_credit(
    t: Tables, requests: DataFrame, fold_rows: int = FOLD_ROWS, hot_rows: int = HOT_ROWS
) -> JobResult:
    """Accept orders while they fit into the customer's free credit; accepted ones use it up.

    ``requests``: request_id, customer_id, total_gbp, requested_at. Prepaid
    customers and those without a limit are not checked.
    """
    admitted = stage(_admit(t, requests, None, fold_rows, hot_rows), "credit")
    bad = reject(admitted.where(~F.col("accepted")), "credit_limit_exceeded", "customer_id")
    return JobResult({"customers": _charged(t, admitted)}, no_ledger(admitted), bad, admitted)


def create_orders(
    t: Tables, requests: DataFrame, lines: DataFrame, default_warehouse="uk",
    fold_rows: int = FOLD_ROWS, hot_rows: int = HOT_ROWS,
) -> JobResult:
    """Order intake: minimum quantities, prices, credit, availability, numbering.

    ``requests``: request_id, customer_id, customer_name, warehouse_code,
    currency, notes, skip_checks, requested_at. ``lines``: request_id, line_no,
    product_id, product_name, sku, qty, base_price (not yet discounted). The
    request id becomes the order's id. Nothing is reserved.
    """
    counted = _with_line_counts(requests, lines, parse_int("qty"), parse_money("base_price"))
    error = F.when(missing("customer_id"), "customer_id_required").when(
        F.col("line_count") == 0, "lines_required"
    ).when(F.col("unfit"), OUT_OF_RANGE)
    first = counted.withColumn("_error", error)
    valid = first.where(F.col("_error").isNull()).drop("_error").withColumn(
        "warehouse_code", F.when(missing("warehouse_code"), F.lit(default_warehouse)).otherwise(F.col("warehouse_code"))
    )
    customers = t.customers.select(
        F.col("id").alias("customer_id"), F.lit(True).alias("_known"), "default_discount_pct"
    )
    headers = stage(valid.join(customers, "customer_id", "left").withColumn(
        "_checked", F.coalesce("_known", F.lit(False)) & ~F.coalesce("skip_checks", F.lit(False))
    ).withColumn("_unchecked", ~F.col("_checked")).drop("_known").withColumn(
        "_header", F.monotonically_increasing_id()
    ), "order-headers")

    items = lines.select(
        "request_id", "line_no", F.when(~missing("product_id"), F.col("product_id")).alias("product_id"),
        text_or("product_name", "").alias("product_name"),
        text_or("sku", "").alias("sku"), parse_int("qty").alias("qty"),
        # All of parse_number's values fit, and 16 digits are kept in one word.
        parse_number("base_price").cast("decimal(16,6)").alias("base_price_gbp"),
    )
    # What is found out about a line goes by these; its texts stay behind, and meet that only in the end. Lines alike
    # in an order are one row, judged once for each header that has its request id.
    alike = ["request_id", "product_id", "qty", "base_price_gbp"]
    told = ["warehouse_code", "_checked", "default_discount_pct"]
    wanted = items.select(*alike).join(headers.select("request_id", "_header", *told), "request_id").groupBy(
        *alike, "_header", *told
    ).agg(F.count("*").alias("_alike")).drop("_header")
    stock = t.warehouse_stock.select(
        F.col("product_id").alias("_product"), F.col("warehouse").alias("_warehouse"), available().alias("_avail")
    )
    minima = t.products.where(F.col("moq") > 1).select(
        F.col("id").alias("product_id"), F.col("name").alias("moq_product_name"), "moq"
    )
    # Unchecked orders, and lines without a product, keep the price they came with.
    own_price = ~F.col("_checked") | F.col("product_id").isNull()
    short = F.col("product_id").isNotNull() & (F.col("qty") > F.coalesce("_avail", F.lit(0)))
    # Lines lie by product after prices and minima. With the warehouse among the join's keys they would be shuffled again
    # to meet stock; as a range of one value it picks among the rows of a product.
    here = (F.col("_product") == F.col("product_id")) & F.col("warehouse_code").between(F.col("_warehouse"), F.col("_warehouse"))
    below = F.col("_checked") & F.coalesce(F.col("qty") < F.col("moq"), F.lit(False))
    ready = stage(
        price_order_lines(t, wanted)
        .join(minima, "product_id", "left")
        .join(growing(stock), here, "left")
        .select(
            *alike, "warehouse_code", "_alike", F.when(own_price, F.col("base_price_gbp")).otherwise(F.col("unit_price_gbp")).alias("unit_price_gbp"),
            short.alias("_short"), below.alias("_below"),
            *[F.when(below, F.col(c)).alias(c) for c in ("moq_product_name", "moq")],
        ),
        "order-lines",
    )

    def meet(found: DataFrame) -> DataFrame:
        """Lines with their texts and what was found out about them."""
        found = found.withColumnsRenamed({c: f"_{c}" for c in alike})
        return items.join(growing(found), [F.col(c).eqNullSafe(F.col(f"_{c}")) if c == "product_id" else F.col(c) == F.col(f"_{c}") for c in alike])

    totals = ready.groupBy("request_id").agg(
        F.round(F.sum(F.col("qty") * F.col("unit_price_gbp") * F.col("_alike")), 2).try_cast("decimal(12,2)").alias("total_gbp"),
        F.bool_or("_short").alias("needs_review"), F.sum(F.when(F.col("_below"), F.col("_alike")).otherwise(0)).alias("failures"),
    )
    every = stage(headers.drop("_header").join(totals, "request_id"), "order-totals")
    summed = every.where(F.col("total_gbp").isNotNull())
    failing = summed.where(F.col("failures") > 0)
    # Only orders with credit terms are held against the limit; the rest, and
    # unchecked ones, are taken as they are.
    admitted = stage(_admit(t, summed.where(F.col("failures") == 0), "_unchecked", fold_rows, hot_rows), "orders")
    taken = admitted.where("accepted")
    numbered = stage(assign_refs(
        taken, t.orders, "order_ref", "ORD", F.year("requested_at"), [F.col("requested_at"), F.col("request_id")]
    ), "numbered")
    new_orders = numbered.select(
        F.col("request_id").alias("id"), "order_ref", "customer_id", F.trim("customer_name").alias("customer_name"),
        F.lit("confirmed").alias("status"), F.lit("confirmed").alias("fulfilment_status"), "warehouse_code",
        text_or("currency", "GBP").alias("currency"), F.lit(1).cast("decimal(12,6)").alias("fx_rate"), "total_gbp",
        text_or("notes", None).alias("notes"), F.col("needs_review").alias("requires_review"),
        F.col("requested_at").alias("created_at"), "line_count",
    )
    # Staged, so that meeting the texts finds on disk no shuffle but its own.
    verdicts = stage(ready.join(numbered.select("request_id", "needs_review"), "request_id").select(
        *alike, "warehouse_code", "unit_price_gbp", "needs_review"
    ), "line-verdicts")
    new_lines = meet(verdicts).select(
        F.concat_ws("-", F.col("request_id").cast("string"), F.col("line_no").cast("string")).alias("id"),
        F.col("request_id").alias("order_id"), "product_id", "product_name", "sku", F.col("qty").alias("qty_ordered"),
        F.col("qty").alias("qty_requested"), F.col("unit_price_gbp").cast("decimal(12,2)").alias("unit_price_gbp"),
        F.col("warehouse_code").alias("warehouse_allocated"),
        F.when(F.col("needs_review"), "pending_review").otherwise("unmatched").alias("fulfilment_status"),
    )
    ledger = ledger_rows(
        new_orders, "order_created", "order", F.col("id"),
        F.concat(F.lit("Order "), "order_ref", F.lit(" created: "), F.col("line_count").cast("string"),
                 F.lit(" lines, £"), F.col("total_gbp").cast("string"),
                 F.when(F.col("requires_review"), " (requires review — partial stock)").otherwise("")),
        F.col("created_at"), F.col("warehouse_code"),
    )
    bad = union(
        reject(first.where(F.col("_error").isNotNull()), F.col("_error")),
        reject(every.where(F.col("total_gbp").isNull()), OUT_OF_RANGE),
        reject(failing, "moq_not_met", "failures"),
        reject(admitted.where(~F.col("accepted")), "credit_limit_exceeded", "total_gbp"),
    )
    state = {
        "orders": append_rows(t.orders, new_orders), "order_lines": append_rows(t.order_lines, new_lines),
        "customers": _charged(t, admitted),
    }
    return JobResult(state, ledger, bad, new_orders, {
        "lines": new_lines,
        "moq_failures": meet(ready.where("_below").select(*alike, "moq_product_name", "moq")).select(
            "request_id", "line_no", "product_id", "moq_product_name", F.col("qty").alias("ordered"), "moq"
        ),
    })


# -- backorders --------------------------------------------------------------

def eligible_backorders(t: Tables, warehouse=None) -> DataFrame:
    """Backordered lines whose product is available in their order's warehouse."""
    lines = t.order_lines.where(
        F.col("fulfilment_status").isin("backordered", "partial") & (F.col("qty_backordered") > 0)
    ).select(F.col("id").alias("line_id"), "order_id", "product_id", "product_name", "sku", "qty_backordered")
    orders = t.orders.select(F.col("id").alias("order_id"), "order_ref", "warehouse_code", "created_at")
    if warehouse is not None:
        orders = orders.where(F.col("warehouse_code") == F.lit(warehouse))
    stock = t.warehouse_stock.where(available() > 0).select(
        "product_id", F.col("warehouse").alias("warehouse_code"), available().alias("qty_available")
    )
    return lines.join(orders, "order_id").join(stock, ["product_id", "warehouse_code"])


def allocate_backorders(t: Tables, asof, warehouse=None, hot_rows: int = HOT_ROWS) -> JobResult:
    """Serve backordered lines oldest order first from what is available, and reserve it."""
    served = allocate_fifo(
        eligible_backorders(t, warehouse), ["product_id", "warehouse_code"],
        [F.col("created_at"), F.col("order_id"), F.col("line_id")], "qty_backordered", "qty_available",
        "qty_fulfilled", hot_rows=hot_rows, credits=False,
    ).where(F.col("qty_fulfilled") > 0).withColumn(
        "remaining", (F.col("qty_backordered") - F.col("qty_fulfilled")).cast("int")
    ).withColumn("status", F.when(F.col("remaining") <= 0, "fulfilled").otherwise("partial"))
    out = served.select(
        "line_id", "order_id", "order_ref", "product_id", "warehouse_code", "product_name", "sku", "qty_backordered",
        "qty_fulfilled", "remaining", "status",
    )
    gain = out.select(F.col("line_id").alias("id"), F.col("qty_fulfilled").alias("_gain"), "remaining",
                      F.col("status").alias("_status"))
    hit = F.col("_gain").isNotNull()
    values = {
        "qty_fulfilled": (F.coalesce("qty_fulfilled", F.lit(0)) + F.coalesce("_gain", F.lit(0))).cast("int"),
        "qty_backordered": F.when(hit, F.col("remaining")).otherwise(F.col("qty_backordered")),
        "fulfilment_status": F.when(hit, F.col("_status")).otherwise(F.col("fulfilment_status")),
    }
    lines = t.order_lines.join(gain, "id", "left").select(*[
        values[c].alias(c) if c in values else F.col(c) for c in t.order_lines.columns
    ])
    reserve = out.select("product_id", F.col("warehouse_code").alias("warehouse"), "qty_fulfilled")
    ledger = ledger_rows(
        out, "backorder_fulfilled", "order", F.col("order_id"),
        F.concat(F.lit("Auto-fulfilled "), F.col("qty_fulfilled").cast("string"), F.lit(" of "),
                 F.col("qty_backordered").cast("string"), F.lit(" backordered units for "), "order_ref"),
        moment(asof), F.col("warehouse_code"), F.col("product_id"), F.col("qty_fulfilled"),
    )
    state = {
        "order_lines": lines,
        "warehouse_stock": apply_deltas(t.warehouse_stock, reserve, "qty_fulfilled", "qty_reserved"),
    }
    return JobResult(state, ledger, no_rejects(out), out)
