"""Column expressions shared by the queries; all of them stay in generated JVM code."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, functions as F

MONEY = "decimal(18,2)"
LARGEST = 9_999_999_999  # money columns hold ten digits before the point


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


# -- totals ------------------------------------------------------------------

def units(c: str | Column) -> Column:
    """Sum of a quantity, 0 for no rows."""
    return F.coalesce(F.sum(col(c)), F.lit(0)).cast("bigint")


def money(c: Column) -> Column:
    """Sum of a money amount with two decimals, 0 for no rows."""
    return F.coalesce(F.sum(c), F.lit(0)).cast(MONEY)


def zero(c: str | Column) -> Column:
    return F.coalesce(col(c), F.lit(0))


# -- stock -------------------------------------------------------------------

def available(prefix: str = "") -> Column:
    return F.col(f"{prefix}qty_on_hand") - F.col(f"{prefix}qty_reserved")


def stock_status(on_hand: str | Column = "qty_on_hand", point: str | Column = "reorder_point") -> Column:
    return (
        F.when(col(on_hand) == 0, "out_of_stock")
        .when(col(on_hand) <= col(point), "low")
        .otherwise("healthy")
    )


def status_rank(on_hand: str | Column = "qty_on_hand", point: str | Column = "reorder_point") -> Column:
    return F.when(col(on_hand) == 0, 0).when(col(on_hand) <= col(point), 1).otherwise(2)


def is_low(on_hand: str = "qty_on_hand", point: str = "reorder_point") -> Column:
    return F.col(on_hand) <= F.col(point)


def cell_status(on_hand: str | Column, point: str | Column) -> Column:
    """Status of one warehouse cell in the comparison grid; a missing stock row is ``na``."""
    return (
        F.when(col(on_hand).isNull(), "na")
        .when(col(on_hand) == 0, "out")
        .when((col(point) > 0) & (col(on_hand) <= col(point)), "low")
        .otherwise("ok")
    )


def replenish_qty(max_stock: str, on_hand: str, case_pack: str) -> Column:
    """Fill up to max stock, but never less than one case (a missing or zero case counts as one)."""
    case = F.coalesce(F.nullif(F.col(case_pack), F.lit(0)), F.lit(1))
    return F.greatest(F.col(max_stock) - F.col(on_hand), case)


# -- prices ------------------------------------------------------------------

def margin_pct(sell: str | Column, cost: str | Column) -> Column:
    """Margin on the selling price in percent, one decimal; NULL when nothing is charged."""
    ratio = (col(sell) - col(cost)).cast("decimal(20,6)") / F.nullif(col(sell), F.lit(0))
    return F.round(ratio * 100, 1).cast("decimal(12,1)")


def discounted(base: str | Column, pct: Column) -> Column:
    """Price after a percentage discount, rounded half-up to pennies."""
    factor = (F.lit(100) - pct).cast("decimal(7,2)")
    return F.round(col(base).cast("decimal(20,6)") * factor / 100, 2).cast("decimal(12,2)")


# -- text --------------------------------------------------------------------

def parse_int(c: str | Column) -> Column:
    """Leading integer of a text, 0 when there is none (lenient request parsing), NULL when it does not fit."""
    text = F.trim(col(c).cast("string"))
    digits = F.coalesce(F.regexp_extract(text, r"^([+-]?\d+)", 1), F.lit(""))
    return F.coalesce(text.try_cast("int"), F.when(digits == "", 0).otherwise(F.nullif(digits, F.lit("")).try_cast("int")))


def parse_int_strict(c: str | Column) -> Column:
    """Leading integer of a text, NULL when there is none; only unusual texts reach the pattern."""
    text = F.trim(col(c).cast("string"))
    return F.coalesce(text.try_cast("int"), F.regexp_extract(text, r"^([+-]?\d+)", 1).try_cast("int"))


def parse_number(c: str | Column) -> Column:
    """Whole text as a number with six decimals, 0 when it is not one, NULL when it is too large for a money column."""
    text = F.trim(col(c).cast("string"))
    value, number = text.try_cast("decimal(20,6)"), text.try_cast("double")
    is_number = F.coalesce(~F.isnan(number) & (F.abs(number) < float("inf")), F.lit(False))
    # Not a number: 0. A number that does not fit: NULL.
    return F.when(~is_number, F.lit(0).cast("decimal(20,6)")).when(F.abs(value) < F.lit(LARGEST).cast("decimal(20,6)"), value)


def parse_money(c: str | Column) -> Column:
    """``parse_number``, rounded to two decimals."""
    return parse_number(c).try_cast("decimal(12,2)")


def text_or(c: str | Column, default: str | None) -> Column:
    """The text, or ``default`` when it is NULL or empty."""
    value = F.when(F.length(col(c)) > 0, col(c))
    return value if default is None else F.coalesce(value, F.lit(default))


def matches(search: str, *columns: str) -> Column:
    """Case-insensitive pattern search over several columns; % and _ act as wildcards."""
    pattern = f"%{search}%"
    found = F.lit(False)
    for name in columns:
        found = found | F.coalesce(F.col(name).ilike(pattern), F.lit(False))
    return found


def contains_ci(search: str, *columns: str) -> Column:
    """Case-insensitive literal substring search over several columns."""
    needle = search.lower()
    found = F.lit(False)
    for name in columns:
        found = found | F.coalesce(F.lower(F.col(name)).contains(needle), F.lit(False))
    return found


# -- time --------------------------------------------------------------------

def moment(at: datetime | str | Column) -> Column:
    """A wall-clock time as a column; a datetime keeps its face value in any session time zone."""
    if isinstance(at, Column):
        return at.cast("timestamp_ntz")
    return F.lit(str(at)).cast("timestamp_ntz")


def days_between(later: Column, earlier: Column) -> Column:
    """Fractional days between two timestamps."""
    return F.timestamp_diff("MICROSECOND", earlier, later).cast("double") / F.lit(86400000000.0)


def whole_days(later: Column, earlier: Column) -> Column:
    """Whole days between two timestamps, truncated toward zero."""
    return F.timestamp_diff("DAY", earlier, later)


def month(c: str | Column) -> Column:
    return F.date_format(col(c), "yyyy-MM")
