"""Adjustments, returns, cycle counts and ABC classes."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window, functions as F

from stockline.functions import moment, parse_int, parse_int_strict, text_or
from stockline.jobs.common import (
    OUT_OF_RANGE, JobResult, append_rows, first_per, ledger_rows, missing, no_ledger, no_rejects, rank, reject, union, updated,
)
from stockline.operators.movements import KEY, apply_deltas, balances
from stockline.operators.numbering import assign_refs
from stockline.operators.prefix import HOT_ROWS, running_totals
from stockline.plans.intelligence import abc_classification
from stockline.sources.staging import stage
from stockline.tables import Tables


def adjust_stock(t: Tables, requests: DataFrame, hot_rows: int = HOT_ROWS) -> JobResult:
    """Add signed adjustments to stock, never going below zero at any step.

    ``requests``: request_id, product_id, warehouse, adjustment, reason,
    requested_at. Clamping at each step equals the running total less its
    lowest value so far when that is negative. The ledger keeps the adjustment asked for.
    """
    bad = missing("product_id", "warehouse") | F.col("adjustment").isNull()
    incomplete = requests.where(bad)
    stock = t.warehouse_stock.select(*KEY, F.col("qty_on_hand").alias("opening"))
    parsed = requests.where(~bad).withColumn("qty_change", parse_int("adjustment"))
    known = parsed.where(F.col("qty_change").isNotNull()).join(stock, KEY, "left")
    found = known.where(F.col("opening").isNotNull())
    order = [F.col("requested_at"), F.col("request_id")]
    summed = running_totals(
        found, KEY, order, {"_before": F.col("qty_change")},
        floors={"_low": F.col("opening") + F.col("_before_incl")}, hot_rows=hot_rows,
    )
    balance = F.col("opening") + F.col("_before") + F.col("qty_change") - F.least(F.lit(0), F.col("_low"))
    done = summed.withColumn("balance_after", balance.cast("int"))
    final = done.groupBy(*KEY).agg(F.max_by("balance_after", rank()).alias("qty_on_hand")).withColumn(
        "_hit", F.lit(True)
    )
    signed = F.concat(F.when(F.col("qty_change") > 0, "+").otherwise(""), F.col("qty_change").cast("string"))
    ledger = ledger_rows(
        done, "stock_adjusted", "warehouse_stock", None,
        F.coalesce(text_or("reason", None), F.concat(F.lit("Manual adjustment: "), signed)),
        F.col("requested_at"), F.col("warehouse"), F.col("product_id"), F.col("qty_change"), F.col("balance_after"),
    )
    rejects = union(
        reject(incomplete, "missing_fields"), reject(parsed.where(F.col("qty_change").isNull()), OUT_OF_RANGE, "product_id"),
        reject(known.where(F.col("opening").isNull()), "stock_record_not_found", "product_id"),
    )
    out = done.select("request_id", *KEY, "qty_change", "balance_after")
    return JobResult({"warehouse_stock": updated(t.warehouse_stock, final, KEY)}, ledger, rejects, out)


# -- returns -----------------------------------------------------------------

def create_returns(t: Tables, requests: DataFrame) -> JobResult:
    """Register returns with the next RMA references; the default action is restock."""
    qty = parse_int("qty")
    bad = missing("product_id", "warehouse_code") | F.col("qty").isNull() | F.col("qty").cast("string").isin("", "0")
    good = requests.where(~bad & qty.isNotNull()).select("*", qty.alias("_qty"), text_or("action", "restock").alias("_action"))
    new = assign_refs(
        good, t.returns, "rma_ref", "RMA", F.year("requested_at"), [F.col("requested_at"), F.col("request_id")]
    ).select(
        F.col("request_id").alias("id"), "rma_ref", "order_id", "customer_id", "product_id", "warehouse_code",
        F.col("_qty").alias("qty"), text_or("reason", None).alias("reason"), F.col("_action").alias("action"),
        F.lit("pending").alias("status"), F.col("requested_at").alias("created_at"),
    )
    ledger = ledger_rows(
        new, "return_created", "return", F.col("id"),
        F.concat(F.lit("RMA "), "rma_ref", F.lit(": "), F.col("qty").cast("string"), F.lit(" units, action: "),
                 "action"),
        F.col("created_at"), F.col("warehouse_code"), F.col("product_id"),
    )
    return JobResult({"returns": append_rows(t.returns, new)}, ledger, union(
        reject(requests.where(bad), "missing_fields"), reject(requests.where(~bad & qty.isNull()), OUT_OF_RANGE)), new)


def _apply_returns(t: Tables, done: DataFrame, prefix: str, suffix: Column, hot_rows: int):
    """Stock and ledger for processed returns (id, rma_ref, product_id, warehouse_code, qty, action, at)."""
    restock = done.where(F.col("action") == "restock").select(
        "*", F.col("warehouse_code").alias("warehouse"), F.col("qty").alias("qty_change")
    )
    moved = balances(t.warehouse_stock, restock, [F.col("at"), F.col("id")], absent=F.col("qty"), hot_rows=hot_rows)
    word = "restocked" if prefix else "Restocked"
    gone = "written off" if prefix else "Written off"
    ledger = union(
        ledger_rows(
            moved, "stock_returned", "return", F.col("id"),
            F.concat(F.lit(f"{prefix}{word} "), F.col("qty").cast("string"), F.lit(" units via "), "rma_ref", suffix),
            F.col("at"), F.col("warehouse"), F.col("product_id"), F.col("qty"), F.col("balance_after"),
        ),
        ledger_rows(
            done.where(F.col("action") != "restock"), "stock_written_off", "return", F.col("id"),
            F.concat(F.lit(f"{prefix}{gone} "), F.col("qty").cast("string"), F.lit(" units via "), "rma_ref", suffix),
            F.col("at"), F.col("warehouse_code"), F.col("product_id"), F.lit(0),
        ),
    )
    return apply_deltas(t.warehouse_stock, restock), ledger


def process_returns(t: Tables, requests: DataFrame, hot_rows: int = HOT_ROWS) -> JobResult:
    """Process pending returns: restock, or write off. ``requests``: request_id, return_id, requested_at."""
    state = t.returns.select(
        F.col("id").alias("return_id"), "rma_ref", "product_id", "warehouse_code", "qty",
        F.coalesce("action", F.lit("")).alias("action"), F.col("status").alias("was"),
    )
    judged = first_per(requests, "return_id").join(state, "return_id", "left").withColumn(
        "_ok", F.col("_first") & F.coalesce(F.col("was") == "pending", F.lit(False))
    )
    # Read several times below, so the requests are judged once.
    done = stage(judged.where("_ok").select(
        F.col("return_id").alias("id"), "rma_ref", "product_id", "warehouse_code", "qty", "action",
        F.col("requested_at").alias("at"),
    ), "returns-done")
    stock, ledger = _apply_returns(t, done, "", F.lit(""), hot_rows)
    changes = done.select("id", F.lit(True).alias("_hit"), F.lit("processed").alias("status"))
    return JobResult(
        {"warehouse_stock": stock, "returns": updated(t.returns, changes, "id")}, ledger,
        reject(judged.where(~F.col("_ok")), "cannot_process", "return_id"), done.drop("at"),
    )


# Words that decide a return's reason code, first match wins.
REASON_WORDS = (
    ("damaged", ("damage", "broken")),
    ("defective", ("defect", "faulty")),
    ("wrong_item", ("wrong", "incorrect")),
    ("expired", ("expired", "expir")),
    ("quality_issue", ("quality",)),
)
WRITE_OFF_REASONS = ("damaged", "defective", "expired", "quality_issue")


def reason_code(reason: str = "reason") -> Column:
    lowered = F.lower(F.col(reason))
    out = F.when(F.lit(False), "")
    for code, words in REASON_WORDS:
        hit = F.lit(False)
        for word in words:
            hit = hit | lowered.contains(word)
        out = out.when(hit, code)
    return out.otherwise("customer_change")


def returns_disposition(t: Tables, asof, hot_rows: int = HOT_ROWS) -> JobResult:
    """Decide and process every pending return by its reason; an existing reason code wins."""
    code = F.coalesce(text_or("reason_code", None), reason_code())
    pending = t.returns.where(F.col("status") == "pending").withColumn("_code", code).select(
        "id", "rma_ref", "product_id", "warehouse_code", "qty", F.col("_code").alias("reason_code"),
        F.when(F.col("_code").isin(list(WRITE_OFF_REASONS)), "write_off").otherwise("restock").alias("action"),
        F.col("created_at").alias("at"),
    )
    stock, ledger = _apply_returns(
        t, pending, "Auto-", F.concat(F.lit(" ("), F.col("reason_code"), F.lit(")")), hot_rows
    )
    changes = pending.select(
        "id", F.lit(True).alias("_hit"), "reason_code", "action", F.lit("processed").alias("status")
    )
    products = t.products.select(F.col("id").alias("product_id"), F.col("name").alias("product_name"), "sku")
    processed = pending.drop("at").join(products, "product_id", "left")
    ledger = ledger.withColumn("created_at", moment(asof))
    return JobResult(
        {"warehouse_stock": stock, "returns": updated(t.returns, changes, "id")}, ledger, no_rejects(pending),
        processed, {"summary": disposition_summary(pending)},
    )


def disposition_summary(processed: DataFrame) -> DataFrame:
    return processed.agg(
        F.count("*").alias("total_processed"), F.count_if(F.col("action") == "restock").alias("restocked"),
        F.count_if(F.col("action") == "write_off").alias("written_off"),
    )


# -- ABC and cycle counts ----------------------------------------------------

def abc_apply(t: Tables, asof=None) -> JobResult:
    """Store the current ABC class of every product."""
    classes = abc_classification(t, asof)
    changes = classes.select("id", F.lit(True).alias("_hit"), "abc_class")
    return JobResult({"products": updated(t.products, changes, "id")}, no_ledger(classes), no_rejects(classes), classes)


def classes_due(asof: datetime) -> tuple[list[str], int]:
    """ABC classes to count in the week of ``asof``: A always, B every 4th week, C every 13th."""
    week = asof.timetuple().tm_yday // 7
    due = ["A"] + (["B"] if week % 4 == 0 else []) + (["C"] if week % 13 == 0 else [])
    return due, week


def _count_lines(counts: DataFrame, stock: DataFrame) -> DataFrame:
    """Lines of new counts; ``counts`` has cycle_count_id and warehouse."""
    return stock.join(counts, "warehouse").select(
        F.concat_ws("-", F.col("cycle_count_id").cast("string"), F.col("id").cast("string")).alias("id"),
        "cycle_count_id", "product_id", F.col("id").alias("warehouse_stock_id"),
        F.col("qty_on_hand").alias("expected_qty"), "location",
    )


def schedule_cycle_counts(t: Tables, asof: datetime, warehouse=None) -> JobResult:
    """Plan this week's counts for every warehouse that has no open count of the last five days."""
    due, week = classes_due(asof)
    at = moment(asof)
    codes = t.warehouses.select(F.col("code").alias("warehouse_code"))
    if warehouse is not None:
        codes = codes.where(F.col("warehouse_code") == F.lit(warehouse))
    active = t.cycle_counts.where(
        F.col("status").isin("planned", "in_progress") & (F.col("created_at") >= at - F.expr("INTERVAL '5' DAY"))
    ).select("warehouse_code").distinct()
    free = codes.join(active, "warehouse_code", "left_anti")
    headers = assign_refs(
        free, t.cycle_counts, "count_ref", "CC", F.year(at), [F.col("warehouse_code")]
    ).select(
        F.concat_ws("-", F.lit("abc"), F.lit(asof.strftime("%Y%m%d")), F.col("warehouse_code").cast("string"))
        .alias("id"),
        "count_ref", "warehouse_code", F.lit("full" if len(due) == 3 else "brand").alias("scope"),
        F.lit(",".join(due)).alias("scope_filter"),
        F.lit(f"Auto-scheduled ABC count: classes {', '.join(due)} (week {week})").alias("notes"),
        F.to_date(at).alias("planned_date"), F.lit("planned").alias("status"), at.alias("created_at"),
    )
    wanted = t.products.where(F.col("abc_class").isin(due)).select(F.col("id").alias("product_id"))
    lines = _count_lines(
        headers.select(F.col("id").alias("cycle_count_id"), F.col("warehouse_code").alias("warehouse")),
        t.warehouse_stock.join(wanted, "product_id", "left_semi"),
    )
    sizes = lines.groupBy("cycle_count_id").agg(F.count("*").alias("n")).withColumnRenamed("cycle_count_id", "id")
    counted = headers.join(sizes, "id", "left").withColumn("line_count", F.coalesce("n", F.lit(0))).drop("n")
    ledger = ledger_rows(
        counted, "cycle_count_created", "cycle_count", F.col("id"),
        F.concat(F.lit("Auto-scheduled "), "count_ref", F.lit(f": ABC classes {','.join(due)} ("),
                 F.col("line_count").cast("string"), F.lit(" items)")),
        at, F.col("warehouse_code"),
    )
    rejects = reject(
        codes.join(active, "warehouse_code", "left_semi").withColumn("request_id", F.col("warehouse_code")),
        "active_count_exists", "warehouse_code",
    )
    state = {
        "cycle_counts": append_rows(t.cycle_counts, headers),
        "cycle_count_lines": append_rows(t.cycle_count_lines, lines),
    }
    return JobResult(state, ledger, rejects, counted, {"lines": lines})


RANDOM_SAMPLE = 20


def create_cycle_counts(t: Tables, requests: DataFrame, seed: int = 0) -> JobResult:
    """Counts on request: full, by brand, by location prefix (zone) or a random sample of 20 rows.

    ``requests``: request_id, warehouse_code, scope, scope_filter, notes,
    planned_date, requested_at. The sample order is a hash of seed, request and
    stock row, so a repeated run draws the same rows; the rank filter is applied
    before the shuffle too, which keeps 20 rows per request and task.
    """
    bad = missing("warehouse_code")
    good = requests.where(~bad).withColumn("scope", text_or("scope", "full")).withColumn(
        "scope_filter", text_or("scope_filter", None)
    )
    headers = assign_refs(
        good, t.cycle_counts, "count_ref", "CC", F.year("requested_at"),
        [F.col("requested_at"), F.col("request_id")],
    ).select(
        F.col("request_id").alias("id"), "count_ref", "warehouse_code", "scope", "scope_filter",
        text_or("notes", None).alias("notes"), F.col("planned_date").cast("date").alias("planned_date"),
        F.lit("planned").alias("status"), F.col("requested_at").alias("created_at"),
    )
    wanted = good.select(F.col("request_id").alias("cycle_count_id"), F.col("warehouse_code").alias("warehouse"),
                         "scope", "scope_filter")
    brands = t.products.select(F.col("id").alias("product_id"), "brand")
    stock = t.warehouse_stock.join(brands, "product_id").join(wanted, "warehouse")
    filtered = F.col("scope_filter").isNotNull()
    fits = (
        F.when((F.col("scope") == "brand") & filtered, F.col("brand") == F.col("scope_filter"))
        .when((F.col("scope") == "zone") & filtered, F.col("location").startswith(F.col("scope_filter")))
        .otherwise(F.lit(True))
    )
    columns = ["cycle_count_id", "id", "product_id", "qty_on_hand", "location"]
    listed = stock.where((F.col("scope") != "random") & fits).select(*columns)
    drawn = Window.partitionBy("cycle_count_id").orderBy(
        F.xxhash64(F.lit(seed), F.col("cycle_count_id"), F.col("id")), F.col("id")
    )
    sampled = (
        stock.where(F.col("scope") == "random").withColumn("_n", F.row_number().over(drawn))
        .where(F.col("_n") <= RANDOM_SAMPLE).select(*columns)
    )
    lines = listed.unionByName(sampled).select(
        F.concat_ws("-", F.col("cycle_count_id").cast("string"), F.col("id").cast("string")).alias("id"),
        "cycle_count_id", "product_id", F.col("id").alias("warehouse_stock_id"),
        F.col("qty_on_hand").alias("expected_qty"), "location",
    )
    state = {
        "cycle_counts": append_rows(t.cycle_counts, headers),
        "cycle_count_lines": append_rows(t.cycle_count_lines, lines),
    }
    # The reference writes no ledger row here.
    return JobResult(state, no_ledger(headers), reject(requests.where(bad), "warehouse_required"), headers,
                     {"lines": lines})


def start_counts(t: Tables, requests: DataFrame) -> JobResult:
    """Planned counts go in progress. ``requests``: request_id, count_id, requested_at."""
    state = t.cycle_counts.select(F.col("id").alias("count_id"), F.col("status").alias("was"))
    judged = first_per(requests, "count_id").join(state, "count_id", "left").withColumn(
        "_ok", F.col("_first") & F.coalesce(F.col("was") == "planned", F.lit(False))
    )
    changes = judged.where("_ok").select(
        F.col("count_id").alias("id"), F.lit(True).alias("_hit"), F.lit("in_progress").alias("status"),
        F.col("requested_at").alias("updated_at"),
    )
    return JobResult({"cycle_counts": updated(t.cycle_counts, changes, "id")}, no_ledger(changes),
                     reject(judged.where(~F.col("_ok")), "cannot_start", "count_id"), changes)


def record_counts(t: Tables, requests: DataFrame) -> JobResult:
    """Counted quantities; the last valid one of a line stays.

    ``requests``: request_id, line_id, counted_qty, notes, requested_at.
    """
    qty = parse_int_strict("counted_qty")
    parsed = requests.withColumn("_qty", qty)
    invalid = F.col("_qty").isNull() | (F.col("_qty") < 0)
    lines = t.cycle_count_lines.select(F.col("id").alias("line_id"), "expected_qty")
    valid = parsed.where(~invalid).join(lines.withColumn("_known", F.lit(True)), "line_id", "left")
    last = valid.where("_known").groupBy("line_id").agg(F.max_by(
        F.struct("_qty", text_or("notes", None).alias("notes"), "requested_at", "expected_qty"), rank()).alias("x"))
    changes = last.select(
        F.col("line_id").alias("id"), F.lit(True).alias("_hit"), F.col("x._qty").alias("counted_qty"),
        (F.col("x._qty") - F.col("x.expected_qty")).alias("variance"), F.col("x.notes").alias("notes"),
        F.col("x.requested_at").alias("counted_at"),
    )
    bad = union(
        reject(parsed.where(invalid), "invalid_qty", "line_id"),
        reject(valid.where(F.col("_known").isNull()), "not_found", "line_id"),
    )
    return JobResult({"cycle_count_lines": updated(t.cycle_count_lines, changes, "id")}, no_ledger(changes), bad,
                     changes)


def complete_cycle_counts(t: Tables, requests: DataFrame) -> JobResult:
    """Finish counts in progress: counted lines that differ overwrite on-hand stock."""
    headers = t.cycle_counts.select(
        F.col("id").alias("count_id"), "count_ref", "warehouse_code", F.col("status").alias("was")
    )
    judged = first_per(requests, "count_id").join(headers, "count_id", "left").withColumn(
        "_ok", F.col("_first") & F.coalesce(F.col("was") == "in_progress", F.lit(False))
    )
    done = judged.where("_ok")
    lines = t.cycle_count_lines.where(F.col("counted_qty").isNotNull() & (F.col("variance") != 0)).select(
        F.col("id").alias("line_id"), F.col("cycle_count_id").alias("count_id"), "product_id", "warehouse_stock_id",
        "counted_qty", "variance",
    ).join(done, "count_id")
    last = lines.groupBy("warehouse_stock_id").agg(F.max_by(
        "counted_qty", F.struct("requested_at", "request_id", "line_id")).alias("qty_on_hand")).select(
        F.col("warehouse_stock_id").alias("id"), F.lit(True).alias("_hit"), "qty_on_hand")
    sizes = lines.groupBy("count_id").agg(F.count("*").alias("n"))
    changes = done.join(sizes, "count_id", "left").select(
        F.col("count_id").alias("id"), F.lit(True).alias("_hit"), F.lit("completed").alias("status"),
        F.col("requested_at").alias("completed_at"), F.col("requested_at").alias("updated_at"),
        F.coalesce("n", F.lit(0)).alias("adjustments"),
    )
    ledger = ledger_rows(
        lines, "stock_adjusted", "cycle_count", F.col("count_id"),
        F.concat(F.lit("Cycle count "), "count_ref", F.lit(": adjusted by "), F.col("variance").cast("string")),
        F.col("requested_at"), F.col("warehouse_code"), F.col("product_id"), F.col("variance"), F.col("counted_qty"),
    )
    state = {
        "warehouse_stock": updated(t.warehouse_stock, last, "id"),
        "cycle_counts": updated(t.cycle_counts, changes.drop("adjustments"), "id"),
    }
    return JobResult(state, ledger, reject(judged.where(~F.col("_ok")), "cannot_complete", "count_id"), changes)
