"""Numbers in requests: what does not fit is refused, and nothing is rounded before the total is."""
from datetime import datetime, timedelta
from decimal import Decimal as D

import pytest

from stockline import jobs
from stockline.functions import parse_int, parse_int_strict, parse_money, parse_number

T0 = datetime(2024, 3, 1)
BIG = "3000000000"


def at(n):
    return T0 + timedelta(minutes=n)


def errors(result):
    return {r.request_id: r.error_code for r in result.rejects.collect()}


def test_parsing(spark):
    texts = ["12", " -7 ", "12abc", "1e3", "", None, "x", BIG, "-" + BIG, "2147483647", "0.125", "12345678901.50", "9999999999.99", "-9999999999", "1e30", "NaN", "Infinity", "1e400"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", parse_int("t"), parse_int_strict("t"), parse_number("t"), parse_money("t")).collect()
    got = {r[0]: tuple(r[1:]) for r in got}
    zero = D("0.000000")
    assert got["12"] == (12, 12, D("12.000000"), D("12.00")) and got[" -7 "] == (-7, -7, D("-7.000000"), D("-7.00"))
    assert got["12abc"] == (12, 12, zero, D("0.00")) and got["1e3"] == (1, 1, D("1000.000000"), D("1000.00"))
    for t in ("", None, "x", "NaN", "Infinity"):
        assert got[t] == (0, None, zero, D("0.00")), t
    assert got[BIG][:2] == got["-" + BIG][:2] == (None, None) and got["2147483647"][0] == 2147483647
    assert got["0.125"][2:] == (D("0.125000"), D("0.13"))
    assert got["12345678901.50"][2:] == got["1e30"][2:] == (None, None)
    assert got["9999999999.99"][2:] == (None, None) and got["-9999999999"][2:] == (None, None)  # the limit is 9,999,999,999


ORDERS = ("request_id string, customer_id string, customer_name string, warehouse_code string, currency string, notes string, "
          "skip_checks boolean, requested_at timestamp_ntz")
LINES = "request_id string, line_no int, product_id string, product_name string, sku string, qty string, base_price string"


def test_orders_keep_decimals_until_the_total_and_refuse_what_does_not_fit(tables, make):
    t = tables(customers=[dict(id="c", company_name="C", payment_terms="prepaid"), dict(id="d", company_name="D", payment_terms="prepaid", default_discount_pct=D("10.00"))],
               products=[dict(id="p", name="P")])
    asked = [("a", "c", "p", "1000", "0.125"), ("b", "d", "p", "1000", "0.125"), ("e", "c", "p", BIG, "1"), ("f", "c", "p", "1", "12345678901.50"),
             ("g", "c", "p", "2000000000", "9000000000"), ("h", "c", "", "3", "0.333"), ("i", "c", "p", "4", "x")]
    r = jobs.create_orders(
        t, make(ORDERS, *[dict(request_id=i, customer_id=c, customer_name="n", warehouse_code="", requested_at=at(k)) for k, (i, c, *_) in enumerate(asked)]),
        make(LINES, *[dict(request_id=i, line_no=1, product_id=p, qty=q, base_price=b) for i, _, p, q, b in asked]))
    assert errors(r) == {i: "out_of_range" for i in "efg"}
    # Rounding each price first would give 130.00 for a, and the discount of a rounded price 120.00 for b.
    assert {x.id: x.total_gbp for x in r.accepted.collect()} == {"a": D("125.00"), "b": D("110.00"), "h": D("1.00"), "i": D("0.00")}
    lines = {x.order_id: x for x in r.extra["lines"].collect()}
    assert (lines["a"].unit_price_gbp, lines["h"].product_id) == (D("0.13"), None)
    assert {x.warehouse_code for x in r.accepted.collect()} == {"uk"}  # an empty warehouse is a missing one


def test_invoices_refuse_what_does_not_fit(tables, make):
    t = tables(customers=[dict(id="k", company_name="K")])
    ddl = "request_id string, customer_name string, customer_region string, order_number string, order_date date, invoice_date date, source_filename string, requested_at timestamp_ntz"
    lines = [("a", "1", "0.004", "0.005"), ("a", "2", "0.004", "0.005"), ("b", BIG, "1", "1"), ("c", "1", "1", "12345678901"), ("d", "2000000000", "1", "1"), ("d", "2000000000", "1", "1"), ("e", "1", "1e12", "1")]
    r = jobs.ingest_invoices(
        t, make(ddl, *[dict(request_id=i, customer_name="K", requested_at=at(k)) for k, i in enumerate("abcde")]),
        make("request_id string, line_no int, sku string, description string, barcode string, trade_price string, quantity string, subtotal string",
             *[dict(request_id=i, line_no=k, sku="s", quantity=q, trade_price=p, subtotal=s) for k, (i, q, p, s) in enumerate(lines)]))
    assert errors(r) == {i: "out_of_range" for i in "bcde"}
    assert [(x.total_units, x.total_value_gbp) for x in r.accepted.collect()] == [(3, D("0.01"))]
    assert {x.subtotal_gbp for x in r.extra["lines"].collect()} == {D("0.01")}


@pytest.fixture
def stocked(tables):
    return tables(
        warehouse_stock=[dict(id="1", product_id="p", warehouse="uk", qty_on_hand=5, qty_reserved=0)],
        purchase_orders=[dict(id="po", po_ref="PO-2024-0001", warehouse_code="uk", status="submitted")],
        po_lines=[dict(id="l", po_id="po", product_id="p", qty_ordered=9, qty_received=0)],
        orders=[dict(id="o", order_ref="R", warehouse_code="uk", requires_review=True)],
        order_lines=[dict(id="ol", order_id="o", product_id="p", qty_ordered=4, unit_price_gbp=D("1.00"))])


def test_other_jobs_refuse_what_does_not_fit(stocked, make):
    t = stocked
    head = "request_id string, {}, notes string, requested_at timestamp_ntz"
    two = [dict(request_id="a", requested_at=at(0)), dict(request_id="b", requested_at=at(1))]
    r = jobs.create_purchase_orders(
        t, make(head.format("supplier_id string, warehouse_code string"), *[{**x, "supplier_id": "s", "warehouse_code": "uk"} for x in two]),
        make("request_id string, line_no int, product_id string, qty_ordered string, unit_cost string",
             *[dict(request_id=i, line_no=1, product_id="p", qty_ordered=q, unit_cost=c) for i, q, c in [("a", BIG, "1"), ("b", "2", "0.125")]]))
    assert errors(r) == {"a": "out_of_range"} and [x.unit_cost_gbp for x in r.extra["lines"].collect()] == [D("0.13")]

    r = jobs.create_transfers(
        t, make(head.format("from_warehouse string, to_warehouse string"), *[{**x, "from_warehouse": "uk", "to_warehouse": "us"} for x in two]),
        make("request_id string, line_no int, product_id string, qty string", *[dict(request_id=i, line_no=1, product_id="p", qty=q) for i, q in [("a", BIG), ("b", "2")]]))
    assert errors(r) == {"a": "out_of_range"} and r.extra["lines"].count() == 1

    r = jobs.receive_goods(t, make(
        "request_id string, po_id string, requested_at timestamp_ntz, line_no int, line_id string, qty string",
        dict(request_id="a", po_id="po", requested_at=at(0), line_no=1, line_id="l", qty="3"),
        dict(request_id="a", po_id="po", requested_at=at(0), line_no=2, line_id="l", qty=BIG),
        dict(request_id="b", po_id="po", requested_at=at(1), line_no=1, line_id="l", qty="4")))
    assert errors(r) == {"a": "out_of_range"} and [x.qty_received for x in r.state["po_lines"].collect()] == [4]

    r = jobs.adjust_stock(t, make(
        "request_id string, product_id string, warehouse string, adjustment string, reason string, requested_at timestamp_ntz",
        *[{**x, "product_id": "p", "warehouse": "uk", "adjustment": a} for x, a in zip(two, ("-" + BIG, "-2"))]))
    assert errors(r) == {"a": "out_of_range"} and [x.qty_on_hand for x in r.state["warehouse_stock"].collect()] == [3]

    r = jobs.create_returns(t, make(
        "request_id string, order_id string, customer_id string, product_id string, warehouse_code string, qty string, reason string, action string, requested_at timestamp_ntz",
        *[{**x, "product_id": "p", "warehouse_code": "uk", "qty": q} for x, q in zip(two, (BIG, "1"))]))
    assert errors(r) == {"a": "out_of_range"} and [x.id for x in r.accepted.collect()] == ["b"]

    r = jobs.review_decisions(
        t, make("request_id string, order_id string, requested_at timestamp_ntz", *[{**x, "order_id": "o"} for x in two]),
        make("request_id string, line_no int, line_id string, decision string, custom_qty string",
             *[dict(request_id=i, line_no=1, line_id="ol", decision="custom", custom_qty=q) for i, q in [("a", BIG), ("b", "2")]]))
    # A refused request does not close the order for the next one.
    assert errors(r) == {"a": "out_of_range"} and [x.qty_to_ship for x in r.accepted.collect()] == [2]

    r = jobs.ingest_suppliers(t, make("request_id string, name string, contact_email string, lead_time_days string, currency string, notes string",
                                      dict(request_id="a", name="A", lead_time_days=BIG), dict(request_id="b", name="B", lead_time_days="x")))
    assert errors(r) == {"a": "out_of_range"} and [x.lead_time_days for x in r.accepted.collect()] == [14]
