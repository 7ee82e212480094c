import random
from datetime import datetime, timedelta
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from stockline import jobs
from stockline.jobs.stock import classes_due

T0 = datetime(2024, 3, 1)


def rows(df):
    return [r.asDict(recursive=True) for r in df.collect()]


def by(df, key, value):
    return {r[key]: r[value] for r in rows(df)}


def errors(result):
    return {r["request_id"]: r["error_code"] for r in rows(result.rejects)}


def stock_row(i, product, hand, reserved=0, warehouse="uk", **more):
    return dict(id=str(i), product_id=product, warehouse=warehouse, qty_on_hand=hand, qty_reserved=reserved, **more)


def at(n):
    return T0 + timedelta(minutes=n)


def conserved(before, result):
    """On-hand stock changed by exactly what the ledger says."""
    moved = sum(r["qty_change"] or 0 for r in rows(result.ledger.where("action <> 'backorder_fulfilled'")))
    change = sum(r["qty_on_hand"] for r in rows(result.state["warehouse_stock"])) - sum(r["qty_on_hand"] for r in rows(before))
    return moved == change


# -- suppliers and purchasing ------------------------------------------------

def test_suppliers_and_customers_get_defaults(tables, make):
    t = tables(customers=[dict(id="c0", company_name="Old")])
    asked = make("request_id string, name string, contact_email string, lead_time_days string, currency string, notes string",
                 dict(request_id="s1", name="  Acme ", lead_time_days="0"), dict(request_id="s2", name=" "),
                 dict(request_id="s3", name="B", lead_time_days="21 days", currency="USD"))
    r = jobs.ingest_suppliers(t, asked)
    assert {x["id"]: (x["name"], x["lead_time_days"], x["currency"]) for x in rows(r.state["suppliers"])} == {
        "s1": ("Acme", 14, "GBP"), "s3": ("B", 21, "USD")}
    assert errors(r) == {"s2": "name_required"}
    ddl = ("request_id string, company_name string, contact_name string, email string, billing_address string, "
           "currency_preference string, vat_number string, notes string, region string, customer_type string, "
           "payment_terms string, credit_limit_gbp string, default_discount_pct string, requested_at timestamp_ntz")
    asked = make(ddl, *[dict(request_id=i, company_name=n, requested_at=at(k)) for k, (i, n) in enumerate(
        [("a", "New"), ("b", " New "), ("c", "Old"), ("d", "")])])
    r = jobs.ingest_customers(t, asked)
    assert sorted(x["company_name"] for x in rows(r.state["customers"])) == ["New", "Old"]
    assert errors(r) == {"b": "duplicate_company_name", "c": "duplicate_company_name", "d": "company_name_required"}


def test_patch_tells_null_from_absent(tables, make):
    t = tables(customers=[dict(id="c", company_name="X", notes="n", region="uk", credit_limit_gbp=D("5.00"))])
    ddl = "request_id string, customer_id string, requested_at timestamp_ntz, fields map<string,string>"
    asked = make(ddl, dict(request_id="1", customer_id="c", requested_at=at(1), fields={"notes": None, "region": "us"}),
                 dict(request_id="2", customer_id="c", requested_at=at(2), fields={"region": "eu", "credit_limit_gbp": "7.5", "id": "hack"}),
                 dict(request_id="3", customer_id="zz", requested_at=at(2), fields={}))
    r = jobs.patch_customers(t, asked)
    c = rows(r.state["customers"])[0]
    assert (c["id"], c["company_name"], c["notes"], c["region"], c["credit_limit_gbp"]) == ("c", "X", None, "eu", D("7.50"))
    assert errors(r) == {"3": "not_found"}


def test_purchase_orders_are_numbered_and_refused(tables, make):
    t = tables(purchase_orders=[dict(id="x", po_ref="PO-2024-0041")])
    asked = make("request_id string, supplier_id string, warehouse_code string, notes string, requested_at timestamp_ntz",
                 dict(request_id="b", supplier_id="s", warehouse_code="uk", requested_at=at(2)),
                 dict(request_id="a", supplier_id="s", warehouse_code="uk", requested_at=at(1)),
                 dict(request_id="c", supplier_id="", warehouse_code="uk", requested_at=at(3)),
                 dict(request_id="d", supplier_id="s", requested_at=at(3)),
                 dict(request_id="e", supplier_id="s", warehouse_code="uk", requested_at=at(3)))
    lines = make("request_id string, line_no int, product_id string, qty_ordered string, unit_cost string",
                 *[dict(request_id=i, line_no=1, product_id="p", qty_ordered="3", unit_cost="1.5") for i in "abcd"])
    r = jobs.create_purchase_orders(t, asked, lines)
    assert by(r.accepted, "id", "po_ref") == {"a": "PO-2024-0042", "b": "PO-2024-0043"}
    assert errors(r) == {"c": "supplier_id_required", "d": "warehouse_code_required", "e": "lines_required"}
    assert sorted(x["po_id"] for x in rows(r.state["po_lines"])) == ["a", "b"]
    assert "PO PO-2024-0042 created for 1 line items" in {x["notes"] for x in rows(r.ledger)}


@pytest.mark.parametrize("status", ["draft", "submitted", "partial", "received"])
def test_purchase_order_moves(tables, make, status):
    t = tables(purchase_orders=[dict(id="o", po_ref="R", status=status)],
               po_lines=[dict(id="l", po_id="o", product_id="p", qty_ordered=5, qty_received=0)])
    asked = make("request_id string, po_id string, requested_at timestamp_ntz",
                 dict(request_id="1", po_id="o", requested_at=at(1)), dict(request_id="2", po_id="o", requested_at=at(2)),
                 dict(request_id="3", po_id="none", requested_at=at(2)))
    submitted, deleted = jobs.submit_pos(t, asked), jobs.delete_draft_pos(t, asked)
    first = {} if status == "draft" else {"1": "cannot_submit"}
    assert errors(submitted) == {**first, "2": "cannot_submit", "3": "cannot_submit"}
    assert rows(submitted.state["purchase_orders"])[0]["status"] == ("submitted" if status == "draft" else status)
    assert len(rows(deleted.state["purchase_orders"])) == (0 if status == "draft" else 1)
    assert len(rows(deleted.state["po_lines"])) == (0 if status == "draft" else 1)


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("hot_rows", [10**9, 3])
def test_receipts_equal_serving_one_by_one(tables, make, seed, hot_rows):
    rng = random.Random(seed)
    pos = [dict(id=f"o{i}", po_ref=f"R{i}", warehouse_code="uk", status=rng.choice(["draft", "submitted", "partial", "received"]))
           for i in range(6)]
    lines = [dict(id=f"l{i}", po_id=f"o{rng.randrange(6)}", product_id=rng.choice(["p", "p", "p", "q", "gone"]),
                  qty_ordered=rng.randint(1, 6), qty_received=rng.choice([0, 0, 2])) for i in range(14)]
    stock = [stock_row(1, "p", 3), stock_row(2, "q", 0)]
    receipts = []
    for n in range(16):
        po = rng.choice(pos)["id"]
        for k in range(rng.randint(1, 3)):
            receipts.append(dict(request_id=f"r{n:02d}", po_id=po, requested_at=at(n), line_no=k,
                                 line_id=rng.choice(lines)["id"], qty=rng.choice(["0", "-1", "2", "4", "x"])))
    # Serve one by one.
    status, got, hand = {p["id"]: p["status"] for p in pos}, {l["id"]: l["qty_received"] for l in lines}, {"p": 3, "q": 0}
    refused, ledger = set(), []
    for n in range(16):
        mine = [r for r in receipts if r["request_id"] == f"r{n:02d}"]
        po = mine[0]["po_id"]
        if status[po] not in ("submitted", "partial"):
            refused.add(f"r{n:02d}")
            continue
        for r in mine:
            line = next(l for l in lines if l["id"] == r["line_id"])
            qty = int(r["qty"]) if r["qty"] not in ("x",) else 0
            if qty <= 0 or line["po_id"] != po:
                continue
            got[line["id"]] += qty
            if line["product_id"] in hand:
                hand[line["product_id"]] += qty
            ledger.append((line["product_id"], qty, hand.get(line["product_id"], qty)))
        own = [l for l in lines if l["po_id"] == po]
        if own and all(got[l["id"]] >= l["qty_ordered"] for l in own):
            status[po] = "received"
        elif any(got[l["id"]] > 0 for l in own):
            status[po] = "partial"
    r = jobs.receive_goods(tables(purchase_orders=pos, po_lines=lines, warehouse_stock=stock), make(
        "request_id string, po_id string, requested_at timestamp_ntz, line_no int, line_id string, qty string", *receipts), hot_rows)
    assert by(r.state["purchase_orders"], "id", "status") == status
    assert by(r.state["po_lines"], "id", "qty_received") == got
    assert by(r.state["warehouse_stock"], "product_id", "qty_on_hand") == hand
    assert set(errors(r)) == refused
    assert sorted((x["product_id"], x["qty_change"], x["balance_after"]) for x in rows(r.ledger)) == sorted(ledger)


def test_auto_reorder_includes_empty_stock(tables):
    t = tables(products=[dict(id="p", supplier_id="s", case_pack=12, cost_price_gbp=D("2.00")), dict(id="q", supplier_id=None)],
               suppliers=[dict(id="s", name="Acme")],
               warehouse_stock=[stock_row(1, "p", 0, reorder_point=5, max_stock=8), stock_row(2, "q", 0, reorder_point=5, max_stock=8),
                                stock_row(3, "p", 0, warehouse="us", reorder_point=0, max_stock=8)])
    r = jobs.auto_reorder(t, T0)
    assert [(x["warehouse_code"], x["line_count"], x["po_ref"]) for x in rows(r.accepted)] == [("uk", 1, "PO-2024-0001")]
    assert rows(r.extra["lines"])[0]["qty_ordered"] == 12
    assert len(rows(r.state["po_lines"])) == 1


def test_lead_time_needs_two_orders_and_a_fifth(tables):
    def po(supplier, days, n):
        return [dict(id=f"{supplier}{i}", supplier_id=supplier, status="received", submitted_at=T0, received_at=T0 + timedelta(days=days))
                for i in range(n)]
    t = tables(suppliers=[dict(id=s, name=s, lead_time_days=d) for s, d in (("a", 10), ("b", 10), ("c", 10), ("d", 0))],
               purchase_orders=po("a", 12, 2) + po("b", 13, 2) + po("c", 30, 1) + po("d", 5, 2))
    r = jobs.update_lead_times(t, T0)
    # Exactly 20 % does not count; from a promise of 0 every difference does.
    assert by(r.accepted, "supplier_id", "new_lead_time") == {"a": 10, "b": 13, "c": 10, "d": 4}
    assert sorted(x["entity_id"] for x in rows(r.ledger)) == ["b", "d"]
    assert by(r.state["suppliers"], "id", "actual_lead_time_days")["c"] == D("30.0")


# -- transfers ---------------------------------------------------------------

def _transfers(make, ids):
    return make("request_id string, transfer_id string, requested_at timestamp_ntz",
                *[dict(request_id=f"r{k}", transfer_id=i, requested_at=at(k)) for k, i in enumerate(ids)])


def test_transfer_creation(tables, make):
    asked = make("request_id string, from_warehouse string, to_warehouse string, notes string, requested_at timestamp_ntz",
                 dict(request_id="a", from_warehouse="uk", to_warehouse="us", requested_at=at(1)),
                 dict(request_id="b", from_warehouse="uk", to_warehouse="uk", requested_at=at(1)),
                 dict(request_id="c", to_warehouse="uk", requested_at=at(1)),
                 dict(request_id="d", from_warehouse="uk", to_warehouse="us", requested_at=at(1)))
    lines = make("request_id string, line_no int, product_id string, qty string", dict(request_id="a", line_no=1, product_id="p", qty="4"))
    r = jobs.create_transfers(tables(), asked, lines)
    assert by(r.accepted, "id", "transfer_ref") == {"a": "TXF-2024-0001"}
    assert errors(r) == {"b": "same_warehouse", "c": "warehouses_required", "d": "lines_required"}


def test_dispatch_is_all_or_nothing_and_repeatable(tables, make):
    t = tables(
        stock_transfers=[dict(id=i, transfer_ref=i, from_warehouse="uk", to_warehouse="us", status=s) for i, s in (
            ("a", "requested"), ("b", "requested"), ("c", "requested"), ("d", "in_transit"), ("e", "requested"), ("n", "requested"))],
        transfer_lines=[dict(id="1", transfer_id="a", product_id="p", qty=6), dict(id="2", transfer_id="b", product_id="p", qty=6),
                        dict(id="3", transfer_id="b", product_id="q", qty=1), dict(id="4", transfer_id="c", product_id="q", qty=2),
                        dict(id="5", transfer_id="c", product_id="p", qty=4), dict(id="6", transfer_id="n", product_id="p", qty=-1)],
        warehouse_stock=[stock_row(1, "p", 10, reserved=9), stock_row(2, "q", 2)])
    r = jobs.dispatch_transfers(t, _transfers(make, ["a", "b", "c", "d", "e", "a", "n", "zz"]))
    assert errors(r) == {"r1": "insufficient_stock", "r3": "cannot_dispatch", "r5": "cannot_dispatch", "r7": "cannot_dispatch"}
    assert by(r.rejects, "request_id", "detail")["r1"] == "p"
    # The negative line of n gives one unit back.
    assert by(r.state["warehouse_stock"], "product_id", "qty_on_hand") == {"p": 1, "q": 0}
    assert by(r.state["stock_transfers"], "id", "status") == {
        "a": "in_transit", "b": "requested", "c": "in_transit", "d": "in_transit", "e": "in_transit", "n": "in_transit"}
    assert conserved(t.warehouse_stock, r)
    again = jobs.dispatch_transfers(t.replace(**r.state), _transfers(make, ["a", "b"]))
    assert errors(again) == {"r0": "cannot_dispatch", "r1": "insufficient_stock"} and rows(again.ledger) == []


def test_receipt_creates_missing_stock_rows(tables, make):
    t = tables(stock_transfers=[dict(id=i, transfer_ref=i, from_warehouse="uk", to_warehouse="us", status="in_transit") for i in "ab"],
               transfer_lines=[dict(id="1", transfer_id="a", product_id="p", qty=6), dict(id="2", transfer_id="b", product_id="p", qty=1),
                               dict(id="3", transfer_id="b", product_id="q", qty=2)],
               warehouse_stock=[stock_row(1, "q", 10, warehouse="us")])
    r = jobs.receive_transfers(t, _transfers(make, ["a", "b", "b"]))
    new = {x["product_id"]: x for x in rows(r.state["warehouse_stock"])}
    assert (new["p"]["qty_on_hand"], new["p"]["qty_reserved"], new["p"]["reorder_point"]) == (7, 0, 5)
    assert sorted((x["product_id"], x["balance_after"]) for x in rows(r.ledger)) == [("p", 6), ("p", 7), ("q", 12)]
    assert errors(r) == {"r2": "cannot_receive"} and conserved(t.warehouse_stock, r)


# -- orders ------------------------------------------------------------------

STAGES = ["confirmed", "picking", "picked", "packing", "packed", "shipped"]
NEXT = {("confirmed", "pick"): "picking", ("picking", "pack"): "packing", ("picked", "pack"): "packing",
        ("packing", "ship"): "shipped", ("packed", "ship"): "shipped"}


def test_every_stage_and_action(tables, make):
    orders = [dict(id=f"{s}-{x}", order_ref="R", fulfilment_status=s, warehouse_code="uk") for s in STAGES for x in ("pick", "pack", "ship")]
    asked = make("request_id string, order_id string, action string, requested_at timestamp_ntz",
                 *[dict(request_id=o["id"], order_id=o["id"], action=o["id"].split("-")[1], requested_at=at(0)) for o in orders])
    r = jobs.advance_orders(tables(orders=orders), asked)
    assert by(r.state["orders"], "id", "fulfilment_status") == {
        o["id"]: NEXT.get(tuple(o["id"].split("-")), o["fulfilment_status"]) for o in orders}
    assert set(errors(r)) == {o["id"] for o in orders if tuple(o["id"].split("-")) not in NEXT}


@pytest.mark.parametrize("seed", [4, 5])
def test_order_sequences_equal_serving_one_by_one(tables, make, seed):
    rng = random.Random(seed)
    orders = [dict(id=f"o{i}", order_ref=f"R{i}", fulfilment_status=rng.choice(STAGES), warehouse_code="uk") for i in range(25)]
    lines = [dict(id=f"l{i}", order_id=f"o{rng.randrange(25)}", product_id=rng.choice(["p", "p", "q", None]), qty_ordered=rng.randint(1, 5))
             for i in range(60)]
    asked = [dict(request_id=f"r{n:03d}", order_id=f"o{rng.randrange(25)}", action=rng.choice(["pick", "pack", "ship"]), requested_at=at(n))
             for n in range(120)]
    status, hand, refused, ledger = {o["id"]: o["fulfilment_status"] for o in orders}, {"p": 10}, set(), []
    for q in asked:
        to = NEXT.get((status[q["order_id"]], q["action"]))
        if not to:
            refused.add(q["request_id"])
            continue
        status[q["order_id"]] = to
        if to == "shipped":
            for l in lines:
                if l["order_id"] == q["order_id"] and l["product_id"]:
                    if l["product_id"] in hand:
                        hand[l["product_id"]] -= l["qty_ordered"]
                    ledger.append((q["order_id"], l["product_id"], -l["qty_ordered"]))
    t = tables(orders=orders, order_lines=lines, warehouse_stock=[stock_row(1, "p", 10)])
    r = jobs.advance_orders(t, make("request_id string, order_id string, action string, requested_at timestamp_ntz", *asked))
    assert by(r.state["orders"], "id", "fulfilment_status") == status and set(errors(r)) == refused
    assert by(r.state["warehouse_stock"], "product_id", "qty_on_hand") == hand
    shipped = rows(r.ledger.where("action = 'stock_shipped'"))
    assert sorted((x["entity_id"], x["product_id"], x["qty_change"]) for x in shipped) == sorted(ledger)
    if any(x["product_id"] == "p" for x in shipped):
        assert min(x["balance_after"] for x in shipped if x["product_id"] == "p") == hand["p"]
    assert {x["balance_after"] for x in shipped if x["product_id"] == "q"} <= {0}


@pytest.mark.parametrize("seed,hot_rows", [(1, 10**9), (2, 10**9), (3, 5), (6, 10**9)])
def test_review_decisions_equal_serving_one_by_one(tables, make, seed, hot_rows):
    rng = random.Random(seed)
    opening = {"p": rng.randint(0, 30), "q": rng.randint(-4, 6), "z": 0}
    orders = [dict(id=f"o{i:02d}", order_ref="R", warehouse_code="uk", requires_review=rng.random() < 0.9) for i in range(20)]
    lines = [dict(id=f"l{i:02d}", order_id=f"o{i % 20:02d}", product_id=rng.choice(["p", "p", "q", "none"]), qty_ordered=rng.randint(1, 6),
                  qty_requested=rng.choice([None, 0, 3, 7]), unit_price_gbp=D("1.25")) for i in range(60)]
    asked = [dict(request_id=f"r{i:02d}", order_id=f"o{rng.randrange(22):02d}", requested_at=at(i)) for i in range(24)]
    decisions = []
    for q in asked[1:]:
        own = [l for l in lines if l["order_id"] == q["order_id"]]
        for k, l in enumerate(rng.sample(own, len(own))):
            decisions.append(dict(request_id=q["request_id"], line_no=k, line_id=l["id"], custom_qty=rng.choice(["-2", "1", "9", "x"]),
                                  decision=rng.choice(["ship_available", "ship_available", "custom", "hold", "other"])))
    avail, ships, reserved, refused, open_orders, totals = dict(opening), {}, {}, set(), {o["id"]: o["requires_review"] for o in orders}, {}
    for q in asked:
        mine = [d for d in decisions if d["request_id"] == q["request_id"]]
        if not mine or not open_orders.get(q["order_id"]):
            refused.add(q["request_id"])
            continue
        open_orders[q["order_id"]] = False
        totals[q["order_id"]] = D(0)
        for d in mine:
            l = next(x for x in lines if x["id"] == d["line_id"])
            want = l["qty_requested"] or l["qty_ordered"]
            if d["decision"] == "ship_available":
                ship = min(want, avail.get(l["product_id"], 0))
            elif d["decision"] == "custom":
                ship = max(0, int(d["custom_qty"]) if d["custom_qty"] != "x" else 0)
            elif d["decision"] == "hold":
                ship = 0
            else:
                continue
            if ship > 0:
                if l["product_id"] in avail:
                    avail[l["product_id"]] -= ship
                reserved[l["product_id"]] = reserved.get(l["product_id"], 0) + ship
            ships[l["id"]] = (ship, want - ship)
            totals[q["order_id"]] += ship * l["unit_price_gbp"]
    stock = [stock_row(k, p, v + 5, reserved=5) for k, (p, v) in enumerate(opening.items())]
    r = jobs.review_decisions(
        tables(orders=orders, order_lines=lines, warehouse_stock=stock),
        make("request_id string, order_id string, requested_at timestamp_ntz", *asked),
        make("request_id string, line_no int, line_id string, decision string, custom_qty string", *decisions), hot_rows)
    assert {x["line_id"]: (x["qty_to_ship"], x["qty_to_backorder"]) for x in rows(r.accepted)} == ships
    assert by(r.state["warehouse_stock"], "product_id", "qty_reserved") == {p: 5 + reserved.get(p, 0) for p in opening}
    assert set(errors(r)) == refused
    assert {k: v for k, v in by(r.state["orders"], "id", "total_gbp").items() if k in totals} == totals
    done = {x["id"]: x for x in rows(r.state["order_lines"])}
    for line, (ship, back) in ships.items():
        expected = ("partial" if ship > 0 else "backordered") if back > 0 else "unmatched"
        assert (done[line]["qty_ordered"], done[line]["qty_backordered"], done[line]["fulfilment_status"]) == (ship, back, expected)


NEW_ORDERS = ("request_id string, customer_id string, customer_name string, warehouse_code string, currency string, notes string, "
              "skip_checks boolean, requested_at timestamp_ntz")
NEW_LINES = "request_id string, line_no int, product_id string, product_name string, sku string, qty string, base_price string"


@pytest.fixture(scope="module")
def intake(tables):
    return tables(
        customers=[dict(id="c", company_name="C", payment_terms="net-30", credit_limit_gbp=D("100.00"), credit_used_gbp=D("40.00"),
                        default_discount_pct=D("2.00")),
                   dict(id="pre", company_name="P", payment_terms="prepaid", credit_limit_gbp=D("1.00"), credit_used_gbp=D("0.00"))],
        products=[dict(id="p", name="Robot", moq=3), dict(id="q", name="Doll", moq=1)],
        price_tiers=[dict(id="1", product_id="p", min_qty=5, discount_pct=D("10.00"))],
        warehouse_stock=[stock_row(1, "p", 10, reserved=4), stock_row(2, "q", 100)],
        orders=[dict(id="x", order_ref="ORD-2024-0009")])


def test_order_intake_order_of_checks(intake, make):
    asked = [("a", "c", None), ("b", "c", None), ("d", "c", None), ("e", "c", True), ("f", None, None), ("g", "c", None), ("h", "ghost", None),
             ("i", "pre", None), ("j", "c", None)]
    lines = {"a": ("p", "5", "10"), "b": ("p", "2", "10"), "d": ("q", "1", "20"), "e": ("p", "2", "30"), "f": ("q", "1", "1"),
             "h": ("p", "1", "500"), "i": ("q", "101", "9.99"), "j": ("q", "1", "0.01")}
    r = jobs.create_orders(
        intake, make(NEW_ORDERS, *[dict(request_id=i, customer_id=c, customer_name=" n ", skip_checks=s, requested_at=at(k)) for k, (i, c, s) in enumerate(asked)]),
        make(NEW_LINES, *[dict(request_id=i, line_no=1, product_id=p, qty=q, base_price=b) for i, (p, q, b) in lines.items()]))
    # a: 5 x 9.00 fits into 60; b: below the minimum; d: 19.60 exceeds the 15 left; e: unchecked and overdraws;
    # g: no lines; j: nothing left; h: unknown customer, taken as it is.
    assert errors(r) == {"b": "moq_not_met", "d": "credit_limit_exceeded", "f": "customer_id_required", "g": "lines_required",
                         "j": "credit_limit_exceeded"}
    made = {x["id"]: x for x in rows(r.accepted)}
    assert {i: x["total_gbp"] for i, x in made.items()} == {"a": D("45.00"), "e": D("60.00"), "h": D("500.00"), "i": D("1008.99") - D("0.00")}
    assert [made[i]["order_ref"] for i in "aehi"] == [f"ORD-2024-00{n}" for n in (10, 11, 12, 13)]
    assert {i: x["requires_review"] for i, x in made.items()} == {"a": False, "e": False, "h": False, "i": True}
    assert by(r.state["customers"], "id", "credit_used_gbp") == {"c": D("145.00"), "pre": D("0.00")}
    assert {x["order_id"]: x["fulfilment_status"] for x in rows(r.extra["lines"])}["i"] == "pending_review"
    assert made["a"]["warehouse_code"] == "uk" and made["a"]["customer_name"] == "n"


def test_credit_exactly_equal_is_accepted(intake, make):
    asked = make("request_id string, customer_id string, total_gbp decimal(12,2), requested_at timestamp_ntz",
                 dict(request_id="a", customer_id="c", total_gbp=D("60.01"), requested_at=at(0)),
                 dict(request_id="b", customer_id="c", total_gbp=D("60.00"), requested_at=at(1)),
                 dict(request_id="d", customer_id="c", total_gbp=D("0.01"), requested_at=at(2)),
                 dict(request_id="e", customer_id="pre", total_gbp=D("9999.00"), requested_at=at(2)))
    for fold_rows in (10**6, 0):
        r = jobs.check_credit(intake, asked, fold_rows=fold_rows)
        assert errors(r) == {"a": "credit_limit_exceeded", "d": "credit_limit_exceeded"}
        assert by(r.state["customers"], "id", "credit_used_gbp")["c"] == D("100.00")


@pytest.mark.parametrize("hot_rows", [10**9, 4])
def test_backorders_oldest_first(tables, hot_rows):
    rng = random.Random(3)
    orders = [dict(id=f"o{i:02d}", order_ref=f"R{i}", warehouse_code="uk", created_at=at(rng.randrange(4))) for i in range(12)]
    lines = [dict(id=f"l{i:02d}", order_id=f"o{rng.randrange(12):02d}", product_id=rng.choice("ppq"), qty_fulfilled=1,
                  qty_backordered=rng.randint(0, 5), fulfilment_status=rng.choice(["backordered", "partial", "fulfilled"])) for i in range(40)]
    free, expected = {"p": 17, "q": 3}, {}
    age = {o["id"]: o["created_at"] for o in orders}
    for l in sorted(lines, key=lambda l: (age[l["order_id"]], l["order_id"], l["id"])):
        if l["fulfilment_status"] == "fulfilled" or l["qty_backordered"] == 0:
            continue
        got = min(l["qty_backordered"], free[l["product_id"]])
        if got > 0:
            expected[l["id"]] = got
            free[l["product_id"]] -= got
    t = tables(orders=orders, order_lines=lines, warehouse_stock=[stock_row(1, "p", 20, reserved=3), stock_row(2, "q", 3)])
    r = jobs.allocate_backorders(t, T0, hot_rows=hot_rows)
    assert by(r.accepted, "line_id", "qty_fulfilled") == expected
    left = {x["product_id"]: x["qty_on_hand"] - x["qty_reserved"] for x in rows(r.state["warehouse_stock"])}
    assert left == free and min(left.values()) >= 0
    done = by(r.state["order_lines"], "id", "qty_fulfilled")
    assert all(done[l["id"]] == 1 + expected.get(l["id"], 0) for l in lines)


# -- stock, returns, counts --------------------------------------------------

@pytest.mark.parametrize("hot_rows", [10**9, 10])
def test_adjustments_clamp_at_every_step(tables, make, hot_rows):
    rng = random.Random(9)
    asked = [dict(request_id=f"r{n:03d}", product_id=rng.choice(["p", "p", "p", "q", "none", None]), warehouse="uk",
                  adjustment=str(rng.randint(-9, 8)), requested_at=at(n)) for n in range(60)]
    hand, after = {"p": 4, "q": 0}, {}
    for q in asked:
        if q["product_id"] in hand:
            hand[q["product_id"]] = max(0, hand[q["product_id"]] + int(q["adjustment"]))
            after[q["request_id"]] = hand[q["product_id"]]
    t = tables(warehouse_stock=[stock_row(1, "p", 4), stock_row(2, "q", 0), stock_row(3, "still", 7)])
    r = jobs.adjust_stock(t, make(
        "request_id string, product_id string, warehouse string, adjustment string, reason string, requested_at timestamp_ntz", *asked), hot_rows)
    assert by(r.accepted, "request_id", "balance_after") == after
    assert by(r.state["warehouse_stock"], "product_id", "qty_on_hand") == {**hand, "still": 7}
    assert {e for e in errors(r).values()} == {"missing_fields", "stock_record_not_found"}


def test_returns_life(tables, make):
    t = tables(warehouse_stock=[stock_row(1, "p", 5)], products=[dict(id="p", name="R")])
    ddl = ("request_id string, order_id string, customer_id string, product_id string, warehouse_code string, qty string, reason string, "
           "action string, requested_at timestamp_ntz")
    asked = [dict(request_id="a", reason="BROKEN and wrong"), dict(request_id="b", reason="Wrong size"), dict(request_id="c", reason=None),
             dict(request_id="d", reason="past expiry"), dict(request_id="e", qty="0")]
    made = jobs.create_returns(t, make(ddl, *[{"product_id": "p", "warehouse_code": "uk", "qty": "2", "requested_at": at(k), **q} for k, q in enumerate(asked)]))
    assert errors(made) == {"e": "missing_fields"}
    assert [x["rma_ref"] for x in sorted(rows(made.accepted), key=lambda x: x["id"])] == [f"RMA-2024-000{n}" for n in (1, 2, 3, 4)]
    now = t.replace(**made.state)
    r = jobs.returns_disposition(now, T0)
    assert by(r.accepted, "id", "reason_code") == {"a": "damaged", "b": "wrong_item", "c": "customer_change", "d": "expired"}
    assert rows(r.extra["summary"]) == [{"total_processed": 4, "restocked": 2, "written_off": 2}]
    assert by(r.state["warehouse_stock"], "product_id", "qty_on_hand") == {"p": 9} and conserved(t.warehouse_stock, r)
    asked = make("request_id string, return_id string, requested_at timestamp_ntz",
                 *[dict(request_id=f"r{k}", return_id=i, requested_at=at(k)) for k, i in enumerate(["a", "b", "a", "zz"])])
    r = jobs.process_returns(now, asked)
    assert by(r.state["warehouse_stock"], "product_id", "qty_on_hand") == {"p": 9}
    assert errors(r) == {"r2": "cannot_process", "r3": "cannot_process"}
    assert set(errors(jobs.process_returns(now.replace(**r.state), asked))) == {"r0", "r1", "r2", "r3"}


def test_classes_due():
    assert classes_due(datetime(2024, 1, 3)) == (["A", "B", "C"], 0)
    assert classes_due(datetime(2024, 1, 8)) == (["A"], 1)
    assert classes_due(datetime(2024, 1, 28)) == (["A", "B"], 4)
    assert classes_due(datetime(2024, 4, 1)) == (["A", "C"], 13)


def test_cycle_count_life(tables, make):
    t = tables(warehouses=[dict(code="uk"), dict(code="us")],
               products=[dict(id="p", brand="X", abc_class="A"), dict(id="q", brand="Y", abc_class="B")],
               warehouse_stock=[stock_row(1, "p", 5, location="A-01-02"), stock_row(2, "q", 9, location="B-01-02")]
               + [stock_row(100 + i, f"n{i}", i, warehouse="us") for i in range(30)],
               cycle_counts=[dict(id="old", count_ref="CC-2024-0003", warehouse_code="us", status="planned", created_at=T0 - timedelta(days=4))])
    r = jobs.schedule_cycle_counts(t, T0)
    assert [(x["warehouse_code"], x["count_ref"], x["line_count"]) for x in rows(r.accepted)] == [("uk", "CC-2024-0004", 2)]
    assert errors(r) == {"us": "active_count_exists"}  # week 8: A and B are due
    ddl = ("request_id string, warehouse_code string, scope string, scope_filter string, notes string, planned_date date, requested_at timestamp_ntz")
    products = t.products.unionByName(make("products", *[dict(id=f"n{i}") for i in range(30)]))
    r = jobs.create_cycle_counts(t.replace(products=products), make(
        ddl, dict(request_id="f", warehouse_code="uk", requested_at=at(0)), dict(request_id="b", warehouse_code="uk", scope="brand", scope_filter="Y", requested_at=at(1)),
        dict(request_id="z", warehouse_code="uk", scope="zone", scope_filter="A-01", requested_at=at(2)), dict(request_id="r", warehouse_code="us", scope="random", requested_at=at(3)),
        dict(request_id="x", requested_at=at(4))), seed=1)
    sizes = {k: len([x for x in rows(r.extra["lines"]) if x["cycle_count_id"] == k]) for k in "fbzr"}
    assert sizes == {"f": 2, "b": 1, "z": 1, "r": 20} and errors(r) == {"x": "warehouse_required"} and rows(r.ledger) == []
    now = t.replace(products=products, **r.state)
    go = make("request_id string, count_id string, requested_at timestamp_ntz", dict(request_id="1", count_id="f", requested_at=at(5)),
              dict(request_id="2", count_id="f", requested_at=at(6)))
    assert errors(jobs.complete_cycle_counts(now, go)) == {"1": "cannot_complete", "2": "cannot_complete"}
    started = jobs.start_counts(now, go)
    assert errors(started) == {"2": "cannot_start"}
    now = now.replace(**started.state)
    say = make("request_id string, line_id string, counted_qty string, notes string, requested_at timestamp_ntz",
               *[dict(request_id=str(k), line_id=i, counted_qty=q, requested_at=at(k)) for k, (i, q) in enumerate(
                   [("f-1", "4"), ("f-1", "7"), ("f-2", "9"), ("f-2", "-1"), ("f-2", "x"), ("none", "3")])])
    counted = jobs.record_counts(now, say)
    assert errors(counted) == {"3": "invalid_qty", "4": "invalid_qty", "5": "not_found"}
    now = now.replace(**counted.state)
    done = jobs.complete_cycle_counts(now, go)
    assert {k: v for k, v in by(done.state["warehouse_stock"], "product_id", "qty_on_hand").items() if k in "pq"} == {"p": 7, "q": 9}
    assert [(x["product_id"], x["qty_change"], x["balance_after"]) for x in rows(done.ledger)] == [("p", 2, 7)]
    assert conserved(now.warehouse_stock, done)


# -- invoices ----------------------------------------------------------------

def test_invoices(tables, make):
    t = tables(customers=[dict(id="k", company_name="Known", region="uk")], invoices=[dict(id="old", customer_id="k", order_number="N1")],
               products=[dict(id="p2", sku="S"), dict(id="p1", sku="S")],
               warehouse_stock=[stock_row(1, "p1", 5, warehouse="uk"), stock_row(2, "p1", 2, warehouse="us")])
    ddl = ("request_id string, customer_name string, customer_region string, order_number string, order_date date, invoice_date date, "
           "source_filename string, requested_at timestamp_ntz")
    asked = make(ddl, *[dict(request_id=i, customer_name=n, customer_region=r, order_number=o, requested_at=at(k)) for k, (i, n, r, o) in enumerate([
        ("a", "Known", "", "N1"), ("b", " Known ", "EU", "N2"), ("c", "Known", "mars", "N2"), ("d", "Fresh", "us", ""), ("e", "Fresh", "", ""),
        ("f", "", "uk", "N9"), ("g", "Known", "uk", "N7")])])
    lines = make("request_id string, line_no int, sku string, description string, barcode string, trade_price string, quantity string, subtotal string",
                 *[dict(request_id=i, line_no=k, sku=s, quantity=q, subtotal="2.5") for i, k, s, q in [
                     ("a", 1, "S", "1"), ("b", 1, " S", "4"), ("b", 2, "S", "3"), ("b", 3, "S", "1"), ("b", 4, "nope", "1"), ("c", 1, "S", "1"),
                     ("d", 1, "S", "2"), ("e", 1, "S", "0"), ("f", 1, "S", "1")]])
    r = jobs.ingest_invoices(t, asked, lines)
    assert errors(r) == {"a": "duplicate_invoice", "c": "duplicate_invoice", "f": "customer_name_required", "g": "lines_required"}
    got = {x["id"]: (x["fulfilment_status"], x["qty_fulfilled"], x["qty_backordered"]) for x in rows(r.extra["lines"])}
    assert got == {"b-1": ("fulfilled", 4, 0), "b-2": ("partial", 1, 2), "b-3": ("backordered", 0, 1), "b-4": ("backordered", 0, 1),
                   "d-1": ("fulfilled", 2, 0), "e-1": ("fulfilled", 0, 0)}
    assert {x["company_name"]: (x["id"], x["region"]) for x in rows(r.state["customers"])} == {"Known": ("k", "eu"), "Fresh": ("d", "us")}
    assert {x["id"]: x["customer_id"] for x in rows(r.accepted)} == {"b": "k", "d": "d", "e": "d"}
    assert {x["id"]: x["total_value_gbp"] for x in rows(r.accepted)}["b"] == D("10.00")
    assert by(r.state["warehouse_stock"], "id", "qty_reserved") == {"1": 5, "2": 2}


def test_nested_request_lines_are_flattened(spark):
    df = spark.createDataFrame([("r", [("p", 2), ("q", 3)])], "request_id string, lines array<struct<product_id: string, qty: int>>")
    headers, lines = jobs.nested_lines(df)
    assert headers.columns == ["request_id"]
    assert [tuple(r) for r in lines.orderBy("line_no").collect()] == [("r", 1, "p", 2), ("r", 2, "q", 3)]


def test_invoice_joins_do_not_broadcast(spark, make, tables, tmp_path, monkeypatch):
    """However small their files are, customers, products and stock are not collected on the driver; the joins run once."""
    from stockline.jobs import customers as module

    plans = {}

    def stage(df, label):
        plans[label] = df._jdf.queryExecution().executedPlan().toString()
        path = str(tmp_path / label)
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    monkeypatch.setattr(module, "stage", stage)
    t = tables()
    for name, row in (("products", dict(id="p1", sku="A")), ("warehouse_stock", dict(id="w1", product_id="p1", warehouse="uk", qty_on_hand=5, qty_reserved=0)),
                      ("customers", dict(id="c1", company_name="One")), ("invoices", dict(id="i1", customer_id="c1", order_number="N-1"))):
        make(name, row).write.parquet(str(tmp_path / name))
        t = t.replace(**{name: spark.read.parquet(str(tmp_path / name))})
    asked = make("request_id string, customer_name string, customer_region string, order_number string, order_date date, invoice_date date, "
                 "source_filename string, requested_at timestamp_ntz",
                 dict(request_id="r1", customer_name="One", order_number="N-2", requested_at=datetime(2024, 1, 1)),
                 dict(request_id="r2", customer_name="One", order_number="N-1", requested_at=datetime(2024, 1, 1)))
    lines = make("request_id string, line_no int, sku string, description string, barcode string, trade_price string, quantity string, subtotal string",
                 *[dict(request_id=r, line_no=n, sku=s, trade_price="1", quantity="4", subtotal="4")
                   for r, n, s in (("r1", 1, "A"), ("r1", 2, "A"), ("r1", 3, "?"), ("r2", 1, "A"))])
    r = jobs.ingest_invoices(t, asked, lines)
    assert list(plans) == ["invoice-headers", "invoice-items", "invoice-lines"]
    assert not any("BroadcastHashJoin" in p for p in plans.values())
    assert "products" not in plans["invoice-lines"] and "customers" not in plans["invoice-lines"]
    assert sorted((x.id, x.qty_fulfilled, x.fulfilment_status) for x in r.extra["lines"].collect()) == [
        ("r1-1", 4, "fulfilled"), ("r1-2", 1, "partial"), ("r1-3", 0, "backordered")]
    assert [x.request_id for x in r.rejects.collect()] == ["r2"]


@pytest.fixture
def filed(spark, make, tables, tmp_path):
    """Tables read from small Parquet files, so that plans name their paths and Spark would broadcast them."""
    def build(**given):
        t = tables()
        for name, rows in given.items():
            make(name, *rows).write.parquet(str(tmp_path / name))
            t = t.replace(**{name: spark.read.parquet(str(tmp_path / name))})
        return t
    return build


@pytest.fixture
def staged_plans(monkeypatch):
    """Physical plans of what jobs and operators stage, by label."""
    from stockline.jobs import orders, purchasing, stock
    from stockline.operators import prefix
    from stockline.sources import staging

    plans = {}

    def stage(df, label):
        plans.setdefault(label, []).append(df._jdf.queryExecution().executedPlan().toString())
        return staging.stage(df, label)

    for module in (orders, purchasing, stock, prefix):
        monkeypatch.setattr(module, "stage", stage, raising=False)
    return plans


STOCK = dict(id="w1", product_id="p1", warehouse="uk", qty_on_hand=5, qty_reserved=0)


def test_balances_meet_stock_by_a_shuffle(filed):
    t = filed(warehouse_stock=[STOCK], returns=[dict(id="r1", rma_ref="RMA-1", product_id="p1", warehouse_code="uk", qty=2, status="pending", reason="other",
                                                     created_at=T0)])
    ledger = jobs.returns_disposition(t, T0).ledger
    assert "BroadcastHashJoin" not in ledger._jdf.queryExecution().executedPlan().toString()
    assert [(r.product_id, r.balance_after) for r in ledger.collect()] == [("p1", 7)]


def test_order_lines_meet_stock_by_a_shuffle(make, filed, staged_plans):
    t = filed(warehouse_stock=[STOCK], products=[dict(id="p1", moq=1)], customers=[dict(id="c1")])
    asked = make("request_id string, customer_id string, customer_name string, warehouse_code string, currency string, notes string, skip_checks boolean, "
                 "requested_at timestamp_ntz", dict(request_id="r1", customer_id="c1", customer_name="One", warehouse_code="uk", requested_at=T0))
    lines = make("request_id string, line_no int, product_id string, product_name string, sku string, qty string, base_price string",
                 dict(request_id="r1", line_no=1, product_id="p1", qty="6", base_price="1"))
    r = jobs.create_orders(t, asked, lines)
    plan, = staged_plans["order-lines"]
    joins = [x for x in plan.splitlines() if "BroadcastHashJoin" in x or "SortMergeJoin" in x]
    assert any("SortMergeJoin" in x and "warehouse_code" in x for x in joins) and not any("BroadcastHashJoin" in x and "warehouse_code" in x for x in joins)
    assert [x.requires_review for x in r.accepted.collect()] == [True]


NEW_ORDERS_AND_LINES = (
    "request_id string, customer_id string, customer_name string, warehouse_code string, currency string, notes string, skip_checks boolean, "
    "requested_at timestamp_ntz",
    "request_id string, line_no int, product_id string, product_name string, sku string, qty string, base_price string")


def test_order_lines_travel_without_their_texts(make, filed, monkeypatch):
    """Only the meeting of lines with what was found out about them moves texts; the rest moves twice, by order and by product."""
    from stockline.jobs import orders
    from stockline.sources import staging
    from tests.test_reads import shuffles

    t = filed(warehouse_stock=[STOCK], products=[dict(id="p1", moq=3)], customers=[dict(id="c1")])
    orders_ddl, lines_ddl = NEW_ORDERS_AND_LINES
    asked = make(orders_ddl, dict(request_id="r1", customer_id="c1", customer_name="One", requested_at=T0))
    lines = make(lines_ddl, dict(request_id="r1", line_no=1, product_id="p1", product_name="P", sku="S", qty="6", base_price="1"))
    texts, moves = [], []

    def stage(df, label):
        texts.append(shuffles(df, "sku"))
        if label == "order-lines":
            moves.append(shuffles(df, "base_price_gbp"))
        return staging.stage(df, label)

    monkeypatch.setattr(orders, "stage", stage)
    r = jobs.create_orders(t, asked, lines)
    assert (sum(texts), moves, shuffles(r.extra["lines"], "sku"), shuffles(r.extra["lines"], "needs_review")) == (0, [2], 1, 1)
    assert [(x.id, x.product_name, x.sku, x.unit_price_gbp) for x in r.extra["lines"].collect()] == [("r1-1", "P", "S", D("1.00"))]


def test_order_lines_alike_and_keys_there_twice(tables, make):
    t = tables(
        customers=[dict(id="c", payment_terms="prepaid", default_discount_pct=D(d)) for d in (0, 10)],
        products=[dict(id="p", name="P", moq=2), dict(id="p", name="Pb", moq=3), dict(id="q", name="Q", moq=9), dict(id=None, name="none", moq=9)],
        warehouse_stock=[stock_row(1, "p", 5), stock_row(2, "p", 1), stock_row(3, None, 0), stock_row(4, "p", 0, warehouse="us"), stock_row(5, "p", 0, warehouse=None)])
    orders_ddl, lines_ddl = NEW_ORDERS_AND_LINES
    asked = make(orders_ddl, *[dict(request_id=i, customer_id="c", customer_name="n", requested_at=at(k)) for k, i in enumerate("aabd")])
    lines = make(lines_ddl, *[dict(request_id=i, line_no=n, product_id=p, sku=f"s{n}", qty=q, base_price=b) for i, n, p, q, b in [
        ("a", 1, "p", "3", "1.00"), ("a", 1, "p", "3", "1.00"), ("a", 2, "p", "3", "1.000"), ("a", 3, "", "1", "0.5"), ("a", 4, None, "1", "0.5"),
        ("b", 1, "q", "8", "1"), ("b", 1, "q", "8", "1"), ("b", 2, "q", "9", "1"), ("d", 1, "x", "1", "2.345"), ("z", 1, "x", "1", "1")]])
    r = jobs.create_orders(t, asked, lines)
    # Headers: 2 requests x 2 customers for a, 2 for b and d; each meets its customer's terms twice. A line of p meets 2 minima and 2 stock rows.
    taken = rows(r.accepted)
    assert {(x["id"], x["total_gbp"], x["requires_review"]) for x in taken} == {("a", D("140.80"), True), ("d", D("4.46"), True)}
    assert sorted(x["id"] for x in taken) == ["a"] * 8 + ["d"] * 4
    made = {}
    for x in rows(r.extra["lines"]):
        key = (x["id"], x["product_id"], x["sku"], x["unit_price_gbp"])
        made[key] = made.get(key, 0) + 1
    # a-1 twice in the table; of its headers half have a discount.
    assert made == {("a-1", "p", "s1", D("1.00")): 2 * 8 * 8, ("a-1", "p", "s1", D("0.90")): 2 * 8 * 8, ("a-2", "p", "s2", D("1.00")): 8 * 8,
                    ("a-2", "p", "s2", D("0.90")): 8 * 8, ("a-3", None, "s3", D("0.50")): 4 * 8, ("a-4", None, "s4", D("0.50")): 4 * 8,
                    ("d-1", "x", "s1", D("2.35")): 4, ("d-1", "x", "s1", D("2.11")): 4}
    # b has two lines alike, below the minimum for both headers.
    assert {(x.request_id, x.error_code, x.detail) for x in r.rejects.collect()} == {("b", "moq_not_met", "4")}
    assert sorted((x.line_no, x.moq_product_name, x.ordered, x.moq) for x in r.extra["moq_failures"].collect()) == [(1, "Q", 8, 9)] * 4


def test_review_joins_run_once(make, filed, staged_plans):
    t = filed(warehouse_stock=[STOCK], orders=[dict(id="o1", warehouse_code="uk", requires_review=True)],
              order_lines=[dict(id="l1", order_id="o1", product_id="p1", qty_ordered=7)])
    asked = make("request_id string, order_id string, requested_at timestamp_ntz", dict(request_id="r1", order_id="o1", requested_at=T0))
    decisions = make("request_id string, line_no int, line_id string, decision string, custom_qty string",
                     dict(request_id="r1", line_no=1, line_id="l1", decision="ship_available"))
    r = jobs.review_decisions(t, asked, decisions)
    assert all("Join" not in p for label in ("hot-groups", "review") for p in staged_plans[label])
    assert [(x.qty_to_ship, x.qty_to_backorder) for x in r.accepted.collect()] == [(5, 2)]


def test_returns_are_judged_once(make, filed, staged_plans):
    t = filed(warehouse_stock=[STOCK], returns=[dict(id="r1", product_id="p1", warehouse_code="uk", qty=2, action="restock", status="pending")])
    asked = make("request_id string, return_id string, requested_at timestamp_ntz", dict(request_id="q1", return_id="r1", requested_at=T0))
    r = jobs.process_returns(t, asked)
    assert all("Join" not in p for p in staged_plans["hot-groups"])
    assert [x.qty_on_hand for x in r.state["warehouse_stock"].collect()] == [7]


def test_receipts_are_grouped_once(make, filed, staged_plans):
    t = filed(warehouse_stock=[STOCK], purchase_orders=[dict(id="o1", warehouse_code="uk", status="submitted")],
              po_lines=[dict(id="l1", po_id="o1", product_id="p1", qty_ordered=4, qty_received=0)])
    asked = make("request_id string, po_id string, requested_at timestamp_ntz, line_no int, line_id string, qty string",
                 dict(request_id="q1", po_id="o1", requested_at=T0, line_no=1, line_id="l1", qty="4"))
    r = jobs.receive_goods(t, asked)
    assert all("purchase_orders" not in p for label in ("receipts", "judged") for p in staged_plans[label])
    assert [(x.id, x.status) for x in r.state["purchase_orders"].collect()] == [("o1", "received")]
