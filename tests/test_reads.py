from datetime import datetime
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from stockline import analytics as a
from stockline.functions import discounted, margin_pct, parse_int, parse_money, stock_status


def rows(df):
    return [r.asDict(recursive=True) for r in df.collect()]


@pytest.fixture(scope="module")
def shop(tables):
    return tables(
        warehouses=[dict(code="eu", name="E", currency="EUR"), dict(code="uk", name="U", currency="GBP"),
                    dict(code="us", name="S", currency="USD")],
        suppliers=[dict(id="s1", name="Acme", lead_time_days=10, currency="GBP"), dict(id="s2", name="Bolt")],
        products=[
            dict(id="p1", name="Robot", sku="R-1", brand="Aa", supplier_id="s1", cost_price_gbp=D("2.50"),
                 sell_price_gbp=D("5.00"), case_pack=6, moq=1),
            dict(id="p2", name="Doll_x", sku="D-1", brand=None, supplier_id=None, cost_price_gbp=D("1.00"),
                 sell_price_gbp=D("0.00"), case_pack=0, moq=2),
        ],
        warehouse_stock=[
            dict(id="1", product_id="p1", warehouse="uk", qty_on_hand=0, qty_reserved=0, reorder_point=5, max_stock=30),
            dict(id="2", product_id="p1", warehouse="us", qty_on_hand=40, qty_reserved=10, reorder_point=5, max_stock=30),
            dict(id="3", product_id="p2", warehouse="uk", qty_on_hand=5, qty_reserved=5, reorder_point=5, max_stock=50),
        ],
        orders=[dict(id="o1", customer_id="c1", warehouse_code="us", total_gbp=D("10.00"), fulfilment_status="shipped",
                     created_at=datetime(2024, 1, 1), requires_review=True, order_ref="ORD-2024-0001"),
                dict(id="o2", customer_id="c1", warehouse_code="uk", total_gbp=D("7.25"), fulfilment_status="odd",
                     created_at=datetime(2024, 1, 11), requires_review=None)],
        order_lines=[dict(id="l1", order_id="o1", product_id="p1", qty_ordered=20, unit_price_gbp=D("5.00"),
                          fulfilment_status="unmatched", product_name="Robot"),
                     dict(id="l2", order_id="o1", product_id=None, qty_ordered=3, unit_price_gbp=D("1.00"),
                          product_name="Gift")],
        customers=[dict(id="c1", company_name="Shop 1", credit_limit_gbp=D("100.00"), credit_used_gbp=D("80.00"), region="uk"),
                   dict(id="c2", company_name="Shop 2", credit_limit_gbp=D("0.00"), credit_used_gbp=D("0.00"))],
    )


def test_expressions(spark):
    df = spark.createDataFrame(
        [(0, 5, "12abc", "1.5"), (5, 5, " -3 ", "x"), (6, 5, None, None), (1, 0, "abc", "")],
        "h int, p int, i string, m string")
    got = df.select(stock_status("h", "p"), parse_int("i"), parse_money("m")).collect()
    assert [tuple(r) for r in got] == [
        ("out_of_stock", 12, D("1.50")), ("low", -3, D("0.00")), ("healthy", 0, D("0.00")), ("healthy", 0, D("0.00"))]
    money = spark.createDataFrame([(D("3.00"), D("1.00")), (D("0.00"), D("1.00"))], "s decimal(12,2), c decimal(12,2)")
    assert [r[0] for r in money.select(margin_pct("s", "c")).collect()] == [D("66.7"), None]
    half = spark.createDataFrame([(D("10.10"),)], "b decimal(12,2)").select(discounted("b", F.lit(50).cast("decimal(5,2)")))
    assert half.collect()[0][0] == D("5.05")


def test_empty_warehouse_counts_zero_or_null(shop):
    summary = {r["code"]: r for r in rows(a.warehouse_summary(shop))}
    assert summary["eu"]["total_products"] == 0 and summary["eu"]["stock_value_gbp"] == D("0.00")
    assert summary["uk"]["low_stock_count"] == 2 and summary["us"]["stock_value_gbp"] == D("100.00")
    assert {r["warehouse"]: r["units"] for r in rows(a.stock_by_warehouse(shop))} == {"eu": None, "uk": 5, "us": 40}
    kpi = {r["warehouse"]: r for r in rows(a.kpi_warehouses(shop))}
    assert kpi["eu"]["low_stock_items"] == 0 and kpi["uk"]["out_of_stock_items"] == 1


def test_status_search_and_order(shop):
    listed = rows(a.stock_status_list(shop, "uk", ordered=True))
    assert [r["stock_status"] for r in listed] == ["out_of_stock", "low"]
    # The underscore is a wildcard in a search.
    assert [r["name"] for r in rows(a.stock_status_list(shop, "uk", "R_B"))] == ["Robot"]
    assert [r["name"] for r in rows(a.stock_status_list(shop, "uk", "R_bb"))] == []
    assert [r["name"] for r in rows(a.stock_status_list(shop, "uk", "", "low"))] == ["Doll_x"]


def test_alerts_and_transfer_suggestion(shop):
    alerts = {(r["warehouse"], r["product_id"]): r for r in rows(a.low_stock_alerts(shop))}
    assert alerts[("uk", "p1")]["surplus_elsewhere"] == [{"warehouse": "us", "qty_available": 30}]
    assert alerts[("uk", "p2")]["surplus_elsewhere"] is None
    moves = {(r["warehouse"], r["product_id"]): r for r in rows(a.transfer_suggestions(shop))}
    assert (moves[("uk", "p1")]["from_warehouse"], moves[("uk", "p1")]["transfer_qty"]) == ("us", 5)
    assert (moves[("uk", "p2")]["action"], moves[("uk", "p2")]["transfer_qty"]) == ("reorder", None)
    total = [r for r in rows(a.alert_stats(shop)) if r["is_total"]][0]
    assert (total["alerts"], total["out_of_stock"], total["out_of_stock_pct"], total["transferable"]) == (2, 1, 50, 1)


def test_valuation_tells_null_brand_from_total(shop):
    got = [(r["warehouse"], r["brand"], r["is_total"], r["total_units"]) for r in rows(a.stock_valuation(shop))]
    assert got == [("uk", None, 1, 5), ("uk", None, 0, 5), ("us", None, 1, 40), ("us", "Aa", 0, 40)]


def test_comparison_counts_missing_rows_as_out(shop):
    grid = {r["product_id"]: r for r in rows(a.warehouse_comparison(shop, ["uk", "us", "eu"]))}
    assert grid["p1"]["status_eu"] == "out" and grid["p1"]["imbalance"] and grid["p1"]["total_available"] == 30
    assert grid["p2"]["status_uk"] == "low" and not grid["p2"]["imbalance"]
    assert [r["product_id"] for r in rows(a.stock_imbalance(shop))] == ["p1"]
    assert rows(a.stock_imbalance(shop))[0]["empty_warehouses"] == 2
    assert [r["product_id"] for r in rows(a.comparison_filters(shop, ["uk", "us"], status="imbalance"))] == ["p1"]


def test_inventory_and_tiers_nest(shop, tables):
    nested = {r["id"]: r["warehouse_stock"] for r in rows(a.inventory_nested(shop))}
    assert [s["warehouse"] for s in nested["p1"]] == ["uk", "us"]
    tiers = tables(products=[dict(id="p1", name="R"), dict(id="p2", name="D")],
                   price_tiers=[dict(id="2", product_id="p1", min_qty=10, discount_pct=D("5")),
                                dict(id="1", product_id="p1", min_qty=5, discount_pct=D("3"))])
    got = rows(a.price_tiers_by_product(tiers))
    assert len(got) == 1 and [x["min_qty"] for x in got[0]["tiers"]] == [5, 10]
    assert rows(a.inventory_nested(tiers))[0]["warehouse_stock"] == []


def test_burn_rate_thresholds(shop, tables):
    # 20 units since the first order; asof decides the span, at least one day.
    at = {r["product_id"]: r for r in rows(a.stockout_predictions(shop, datetime(2024, 1, 1, 6)))}
    assert at["p1"]["burn_rate_per_day"] == D("20.000000") and at["p1"]["days_until_stockout"] == D("2.0")
    assert at["p1"]["severity"] == "critical"
    assert at["p2"]["severity"] == "no_demand" and at["p2"]["days_until_stockout"] is None
    for days, severity in ((7, "warning"), (6.9, "critical"), (15, "healthy"), (14.9, "warning")):
        from datetime import timedelta
        got = rows(a.stockout_predictions(shop, datetime(2024, 1, 1) + timedelta(days=days)).where("product_id = 'p1'"))
        assert got[0]["severity"] == severity, days


def test_reorder_needs_stock_supplier_and_reason(shop):
    # us/p1: 40 on hand, 20 sold in 10 days: 20 days of cover, lead time 10: nothing to do.
    assert rows(a.reorder_recommendations(shop, asof=datetime(2024, 1, 11))) == []
    got = rows(a.reorder_recommendations(shop, asof=datetime(2024, 1, 5)))
    assert [(r["warehouse"], r["recommended_qty"], r["urgency"]) for r in got] == [("us", 6, "urgent")]
    assert got[0]["estimated_cost_gbp"] == D("15.00")
    # 5 a day over 24 days less 40 on hand is 80, in cases of 6.
    assert rows(a.reorder_recommendations_demand(shop, asof=datetime(2024, 1, 5)))[0]["recommended_qty"] == 84


def test_abc_boundaries_and_ties(tables):
    def shop_of(revenues):
        return tables(
            products=[dict(id=f"p{i}", name="x") for i in range(len(revenues))],
            orders=[dict(id="o", created_at=datetime(2024, 1, 1))],
            order_lines=[dict(id=str(i), order_id="o", product_id=f"p{i}", qty_ordered=1, unit_price_gbp=D(v))
                         for i, v in enumerate(revenues) if v])

    def classes(revenues):
        return [r["abc_class"] for r in sorted(rows(a.abc_classification(shop_of(revenues))), key=lambda r: r["id"])]

    assert classes(["80", "15", "5", 0]) == ["A", "B", "C", "C"]
    # A first product above the limit is not an A, and equal revenues share a class.
    assert classes(["81", "14", "5"]) == ["B", "B", "C"]
    assert classes(["60", "20", "20"]) == ["A", "C", "C"]
    assert classes([0, 0]) == ["C", "C"]


def test_review_queue_falls_back(shop):
    lines = {r["line_id"]: r for r in rows(a.review_queue(shop))}
    assert lines["l1"]["qty_available"] == 30 and lines["l2"]["qty_available"] == 0
    assert lines["l1"]["qty_requested"] == 20
    assert rows(a.review_issue_counts(shop))[0]["short_lines"] == 1


def test_customers_and_credit(shop):
    spend = {r["id"]: r for r in rows(a.customer_spend(shop))}
    assert spend["c1"]["total_spend_gbp"] == D("17.25") and spend["c1"]["credit_available_gbp"] == D("20.00")
    assert spend["c2"]["order_count"] == 0 and spend["c2"]["credit_available_gbp"] is None
    usage = {r["id"]: r for r in rows(a.credit_usage(shop))}
    assert (usage["c1"]["credit_used_pct"], usage["c1"]["credit_band"], usage["c1"]["over_80_pct"]) == (80, "medium", False)


def test_kpis_keep_the_line_counting_quirk(tables):
    t = tables(
        stock_transfers=[dict(id="a", status="in_transit"), dict(id="b", status="requested")],
        transfer_lines=[dict(id="1", transfer_id="a", product_id="p", qty=2), dict(id="2", transfer_id="a", product_id="q", qty=3)])
    assert rows(a.kpi_transfers(t)) == [{"in_transit": 2, "pending": 1, "units_in_transit": 5}]
    assert rows(a.kpi_transfers_distinct(t)) == [{"in_transit": 1, "pending": 1, "units_in_transit": 5}]


def test_routing_scores_and_ties(shop, spark):
    lines = spark.createDataFrame([("r1", "c1", "p1", 30), ("r2", "c2", "p1", None), ("r3", "nobody", "p1", 1)],
                                  "request_id string, customer_id string, product_id string, qty int")
    far = spark.createDataFrame([("uk", "uk", 0), ("uk", "eu", 1), ("uk", "us", 2)], "region string, warehouse string, distance int")
    got = rows(a.route_order(shop, lines, far).where("request_id = 'r1'").orderBy("position"))
    # us has everything but is far: 50+30-5; uk is local but short: 50-20+20; eu near and short: 50-20+10.
    assert [(r["warehouse"], r["score"], r["can_fulfil"]) for r in got] == [("us", 75, True), ("uk", 50, False), ("eu", 40, False)]
    assert got[0]["warnings"] == ["Cross-region shipping adds cost and transit time"]
    # No region counts as uk; a missing quantity as 1.
    assert rows(a.route_order(shop, lines, far).where("request_id = 'r2' and recommended"))[0]["warehouse"] == "us"
    assert [r["request_id"] for r in rows(a.unroutable(shop, lines))] == ["r3"]


def test_price_history_windows(tables):
    t = tables(products=[dict(id="p", name="x")], price_history=[
        dict(id=f"{i:02d}", product_id="p", field="buy_cost", old_value=D(i), new_value=D(i + 1), changed_at=datetime(2024, 1, 1))
        for i in range(10)])
    top = sorted(rows(a.price_change_pct(t)), key=lambda r: r["position"])
    assert len(top) == 8 and top[0]["old_value"] == D("9.00") and top[0]["change_pct"] == D("11.1")
    # Equal times: the highest id is the latest.
    assert rows(a.price_trends(t))[0]["new_value"] == D("10.00")


def test_lead_times_ignore_reversed_dates(tables):
    def po(i, s, r):
        return dict(id=str(i), supplier_id="s", status="received", submitted_at=datetime(2024, 1, s), received_at=datetime(2024, 1, r))
    t = tables(suppliers=[dict(id="s", name="S", lead_time_days=10)], purchase_orders=[po(1, 1, 5), po(2, 1, 6), po(3, 6, 6), po(4, 9, 2)])
    assert rows(a.supplier_lead_time_stats(t))[0]["avg_actual_days"] == D("4.5")
    assert rows(a.supplier_lead_time_stats(t))[0]["po_count"] == 2


def test_mismatch_only_for_named_regions(tables):
    t = tables(
        customers=[dict(id="c", company_name="x", region="us"), dict(id="d", company_name="y", region="eu")],
        invoices=[dict(id="i", customer_id="c"), dict(id="j", customer_id="d")],
        invoice_lines=[dict(id="1", invoice_id="i", sku="A", description="a"), dict(id="2", invoice_id="j", sku="A", description="a"),
                       dict(id="3", invoice_id="i", sku="ZZ", description="z")],
        products=[dict(id="p", sku="A")], warehouse_stock=[dict(id="1", product_id="p", warehouse="uk", qty_on_hand=4)])
    assert sorted((r["sku"], r["customer_region"]) for r in rows(a.warehouse_mismatch(t))) == [("A", "us"), ("ZZ", "us")]


def test_ledger_refs_and_categories(tables):
    t = tables(audit_log=[
        dict(id="1", created_at=datetime(2024, 1, 1, 23), action="order_pick", warehouse_code="uk", notes="ORD-2024-0001 via PO-2024-12 and PO-2024-13"),
        dict(id="2", created_at=datetime(2024, 1, 2, 1), action="something", warehouse_code="uk", qty_change=3)])
    assert sorted((r["kind"], r["ref"]) for r in rows(a.extract_refs(t))) == [("ORD", "ORD-2024-0001"), ("PO", "PO-2024-12")]
    days = [(str(r["day"]), r["category"], r["net_qty"]) for r in rows(a.ledger_timeline(t))]
    assert days == [("2024-01-02", "other", 3), ("2024-01-01", "orders", 0)]
    assert [r["id"] for r in rows(a.audit_search(t, limit=1))] == ["2"]


def _broadcast_joins(df):
    return df._jdf.queryExecution().executedPlan().toString().count("BroadcastHashJoin")


@pytest.mark.parametrize("query", [a.warehouse_summary, a.kpi_warehouses, a.dashboard_warehouses,
                                   a.dashboard_totals, a.stock_line_value, a.stock_status])
def test_stock_meets_products_by_a_shuffle(spark, make, tables, tmp_path, query):
    """However small their files are, neither stock nor products are collected on the driver."""
    t = tables(warehouses=[{"code": "uk"}])
    for name, row in (("products", {"id": "p1", "cost_price_gbp": D("2.00")}), ("warehouse_stock", {"id": "s1", "product_id": "p1", "warehouse": "uk"})):
        make(name, row).write.parquet(str(tmp_path / name))
        t = t.replace(**{name: spark.read.parquet(str(tmp_path / name))})
    warehouses = query not in (a.stock_line_value, a.stock_status)
    plan = query(t)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [product_id" in plan and _broadcast_joins(query(t)) <= warehouses


def test_count_lines_are_not_broadcast(spark, make, tables, tmp_path):
    t = tables()
    for name, rows in (("products", [{"id": "p1", "name": "One"}]), ("cycle_counts", [{"id": "a"}, {"id": "b"}, {"id": "b"}, {"id": None}]),
                       ("cycle_count_lines", [{"id": "l1", "cycle_count_id": "a", "product_id": "p1"}, {"id": "l2", "cycle_count_id": "a"},
                                              {"id": "l3", "cycle_count_id": "gone"}])):
        make(name, *rows).write.parquet(str(tmp_path / name))
        t = t.replace(**{name: spark.read.parquet(str(tmp_path / name))})
    df = a.cycle_count_detail(t)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [product_id" in plan and "LeftOuter, BuildRight" not in plan
    got = sorted((r.cycle_count_id or "-", r.line_id or "-", r.product_name or "-") for r in df.collect())
    assert got == [("-", "-", "-"), ("a", "l1", "One"), ("a", "l2", "-"), ("b", "-", "-"), ("b", "-", "-")]


def test_review_lines_meet_stock_by_a_shuffle(spark, make, tables, tmp_path):
    t = tables()
    for name, row in (("warehouse_stock", {"id": "s1", "product_id": "p1", "warehouse": "uk", "qty_on_hand": 3, "qty_reserved": 1}),
                      ("orders", {"id": "o1", "warehouse_code": "uk", "requires_review": True}), ("order_lines", {"id": "l1", "order_id": "o1", "product_id": "p1"})):
        make(name, row).write.parquet(str(tmp_path / name))
        t = t.replace(**{name: spark.read.parquet(str(tmp_path / name))})
    df = a.review_queue(t)
    joins = [x for x in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in x and "warehouse_code" in x]
    assert joins and all("SortMergeJoin" in x for x in joins)
    assert [r.qty_available for r in df.collect()] == [2]


def shuffles(df, *columns):
    """How many shuffles carry all these columns, when nothing is broadcast."""
    import re

    spark = df.sparkSession
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = df.select("*")._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    inputs = re.findall(r"\(\d+\) Exchange\nInput \[\d+\]: \[(.*?)\]\n", plan)
    return sum(all(f"{c}#" in i for c in columns) for i in inputs)


@pytest.fixture(scope="module")
def paperwork(tables):
    """Keys that are null, unknown or there twice."""
    keys = [None, "1", "2", "x"]
    return tables(
        orders=[dict(id="1", order_ref="O1", customer_id="1"), dict(id="2", order_ref="O2", customer_id=None), dict(id="2", order_ref="O2b", customer_id="x"),
                dict(id=None, order_ref="none", customer_id="2"), dict(id="3", order_ref="O3", customer_id="2")],
        customers=[dict(id="1", company_name="C1", default_discount_pct=D(0)), dict(id="1", company_name="C1b", default_discount_pct=D(4)),
                   dict(id="2", company_name="C2", default_discount_pct=D(7)), dict(id=None, company_name="none", default_discount_pct=D(9))],
        products=[dict(id="1", name="P1", sku="S1", brand="B1"), dict(id="2", name="P2"), dict(id="2", name="P2b", brand="B2"), dict(id=None, name="none")],
        price_tiers=[dict(id="t", product_id="1", min_qty=5, discount_pct=D(5)), dict(id="u", product_id="1", min_qty=10, discount_pct=D(3)),
                     dict(id="v", product_id=None, min_qty=1, discount_pct=D(50))],
        order_lines=[dict(id=f"{o}{p}", order_id=o, product_id=p, sku="s") for o in keys for p in keys] * 2,
        returns=[dict(id=f"{o}{c}{p}", rma_ref="R", order_id=o, customer_id=c, product_id=p, qty=1) for o in keys for c in keys for p in keys] * 2,
    )


def _left(left, right, key):
    """A left join by hand: unknown and null keys meet nothing."""
    return [(*x, y) for x in left for y in [r for r in right if r["id"] is not None and r["id"] == key(x)] or [{}]]


def test_returns_are_shuffled_once(paperwork):
    t = paperwork
    df = a.returns_list(t)
    assert shuffles(df, "rma_ref") == 1
    o, c, p = (rows(x) for x in (t.orders, t.customers, t.products))
    want = _left(_left(_left([(r,) for r in rows(t.returns)], o, lambda x: x[0]["order_id"]), c, lambda x: x[0]["customer_id"]), p, lambda x: x[0]["product_id"])
    assert sorted(map(str, ((r.id, r.order_ref, r.customer_name, r.product_name, r.sku, r.brand) for r in df.collect()))) == sorted(map(str, (
        (r["id"], x.get("order_ref"), y.get("company_name"), z.get("name"), z.get("sku"), z.get("brand")) for r, x, y, z in want)))


def test_returns_are_listed_in_slices(paperwork, monkeypatch):
    """A slice's shuffles are gone when the next one is listed; rows with equal keys share a slice, and none is lost or doubled."""
    from stockline.operators import joins

    staged, stage = [], joins.stage
    monkeypatch.setattr(joins, "stage", lambda df, label: staged.append(shuffles(df, "rma_ref")) or stage(df, label))
    whole = a.returns_list(paperwork)
    assert not staged
    sliced = a.returns_list(paperwork, slice_rows=20)
    assert staged == [1] * 6 and shuffles(sliced, "rma_ref") == 1  # 128 returns
    assert sliced.schema == whole.schema and sorted(map(str, rows(sliced))) == sorted(map(str, rows(whole)))
    assert a.returns_list(paperwork, slice_rows=1) and len(staged) == 6 + joins.MOST_SLICES - 1


def test_slips_meet_names_before_lines_meet_headers(paperwork):
    t = paperwork
    df = a.packing_slip(t)
    assert shuffles(df, "order_ref", "sku") == 0
    c, p = rows(t.customers), rows(t.products)
    lines = [dict(x, id=x["order_id"], line=x["id"]) for x in rows(t.order_lines)]
    want = _left(_left([(x, y) for x, y in _left([(h,) for h in rows(t.orders)], lines, lambda x: x[0]["id"])], c, lambda x: x[0]["customer_id"]),
                 p, lambda x: x[1].get("product_id"))
    assert sorted(map(str, ((r.order_ref, r.line_id, r.company_name, r.brand) for r in df.collect()))) == sorted(map(str, (
        (h["order_ref"], x.get("line"), y.get("company_name"), z.get("brand")) for h, x, y, z in want)))
    assert {r.line_id for r in a.packing_slip(t, order_id="1").collect()} == {x["line"] for x in lines if x["order_id"] == "1"}


@pytest.mark.parametrize("price, of_ten", [(a.effective_price, D(5)), (a.price_order_lines, D(3))])
def test_priced_lines_meet_breaks_where_they_met_products(paperwork, make, price, of_ten):
    t = paperwork
    lines = make("line_id string, customer_id string, product_id string, qty int, base_price_gbp decimal(12,2)", *[
        dict(line_id=f"{c}{p}{q}", customer_id=c, product_id=p, qty=q, base_price_gbp=D(100)) for c in (None, "1", "2", "x") for p in (None, "1", "x") for q in (4, 5, 10)])
    joined = lines.join(t.products.select(F.col("id").alias("product_id"), "name"), "product_id", "left")
    assert shuffles(price(t, joined), "line_id") == 2  # products and breaks, customers
    got = sorted((r.line_id, r.discount_pct, r.unit_price_gbp) for r in price(t, lines).collect())
    own = {"1": [D(0), D(4)], "2": [D(7)]}
    want = sorted((f"{c}{p}{q}", d := max(o, {4: D(0), 5: D(5), 10: of_ten}[q] if p == "1" else D(0)), 100 - d)
                  for c in (None, "1", "2", "x") for p in (None, "1", "x") for q in (4, 5, 10) for o in own.get(c, [D(0)]))
    assert got == want
