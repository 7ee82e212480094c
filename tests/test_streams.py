import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from stockline import streams
from stockline.jobs.orders import advance_orders, allocate_backorders
from stockline.jobs.stock import adjust_stock
from stockline.sources.snapshots import read_ledger
from stockline.tables import SCHEMAS

T0 = datetime(2024, 5, 1)


def row(i, minutes, action="stock_adjusted", product="p", qty=1, warehouse="uk"):
    return dict(id=str(i), created_at=T0 + timedelta(minutes=minutes), action=action, product_id=product, warehouse_code=warehouse,
                qty_change=qty)


@pytest.fixture
def ledger(spark, make, tmp_path):
    """Write each list of rows as one file and read them as a stream, a file per micro-batch."""
    def build(*files, schema="audit_log"):
        path = str(tmp_path / "in")
        for n, rows in enumerate(files):
            make(schema, *rows).coalesce(1).write.mode("append").parquet(path)
            newest = max((os.path.join(path, f) for f in os.listdir(path) if f.endswith(".parquet")), key=os.path.getmtime)
            os.utime(newest, (1000 + n, 1000 + n))
            for f in os.listdir(path):
                if f.endswith(".parquet") and os.path.getmtime(os.path.join(path, f)) > 10**6:
                    os.utime(os.path.join(path, f), (1000 + n, 1000 + n))
        return streams.read_ledger_stream(spark, path, SCHEMAS.get(schema, schema), maxFilesPerTrigger="1"), path

    return build


def run_append(stream, tmp_path):
    out, schema = str(tmp_path / "out"), stream.schema
    streams.append_sink(stream, out, str(tmp_path / "cp")).awaitTermination()
    return stream.sparkSession.read.schema(schema).parquet(out)


def test_balance_over_several_batches_equals_batch(spark, ledger, tmp_path):
    stream, path = ledger([row(1, 0, qty=5), row(2, 1, product="q", qty=2)], [row(3, 2, qty=-3)], [row(4, 3, product=None, qty=9), row(5, 4, qty=4)])
    streams.update_sink(streams.stream_stock_balance(stream), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = streams.latest(spark, str(tmp_path / "out"), ["warehouse_code", "product_id"]).collect()
    assert {(r.product_id, r.balance, r.movements) for r in got} == {("p", 6, 3), ("q", 2, 1)}


def test_duplicates_within_the_delay_are_dropped(ledger, tmp_path):
    stream, _ = ledger([row(1, 0), row(1, 1)], [row(1, 2), row(2, 3)])
    assert sorted(r.id for r in run_append(streams.stream_dedup_ledger(stream), tmp_path).collect()) == ["1", "2"]


def test_movements_by_day_drop_rows_behind_the_watermark(spark, ledger, tmp_path):
    day = 24 * 60
    # Late rows are judged by the watermark of the micro-batch before the last one.
    stream, _ = ledger([row(1, 0), row(2, 5 * day)], [row(5, 5 * day)], [row(3, 10, qty=50), row(4, 4 * day, action="order_pick", qty=None)])
    streams.update_sink(streams.stream_movements_by_day(stream, "2 days"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = streams.latest(spark, str(tmp_path / "out"), ["day", "warehouse_code", "category"]).collect()
    # Row 3 is five days late and is not counted.
    assert {(str(r.day), r.category, r.entries, r.net_qty) for r in got} == {
        ("2024-05-01", "stock", 1, 1), ("2024-05-06", "stock", 2, 2), ("2024-05-05", "orders", 1, 0)}


def test_burn_rate_slides_by_day(ledger, tmp_path):
    day = 24 * 60
    stream, _ = ledger([row(1, 0, "stock_shipped", qty=-30), row(2, 60, "stock_shipped", qty=-30), row(3, day, "stock_received", qty=7)],
                       [row(4, 40 * day, "stock_shipped", qty=-1)], [row(5, 41 * day, "stock_shipped", qty=-1)])
    got = run_append(streams.stream_burn_rate(stream, "1 day", days=3), tmp_path).where("units = 60").collect()
    assert sorted(str(r.to_at.date()) for r in got) == ["2024-05-02", "2024-05-03", "2024-05-04"]
    assert {str(r.daily_rate) for r in got} == {"20.0000"}


def test_alerts_fire_only_on_crossing(tables, ledger, tmp_path):
    t = tables(warehouse_stock=[dict(id="1", product_id="p", warehouse="uk", qty_on_hand=10, reorder_point=5),
                                dict(id="2", product_id="low", warehouse="uk", qty_on_hand=1, reorder_point=5)])
    stream, _ = ledger([row(1, 0, qty=-4), row(2, 0.5, qty=-1), row(3, 2, qty=-1), row(4, 2, product="low", qty=1)], [row(5, 10, qty=9), row(6, 20, qty=-14)],
                       [row(7, 100, product="other"), row(8, 200, product="other")])
    got = run_append(streams.stream_low_stock_alerts(stream, t), tmp_path).collect()
    assert sorted((r.at.strftime("%H:%M"), r.product_id, r.balance, r.alert_type) for r in got) == [
        ("00:00", "p", 5, "low_stock"), ("00:10", "p", 13, "recovered"), ("00:20", "p", -1, "out_of_stock")]


def test_order_stage_stream_matches_the_state_machine(spark, tables, ledger, tmp_path):
    stages = ["confirmed", "picking", "picked", "packing", "packed", "shipped"]
    legal = {("confirmed", "pick"): "picking", ("picking", "pack"): "packing", ("picked", "pack"): "packing",
             ("packing", "ship"): "shipped", ("packed", "ship"): "shipped"}
    pairs = [(s, a) for s in stages for a in ("pick", "pack", "ship", "fly")]
    t = tables(orders=[dict(id=f"{s}-{a}", fulfilment_status=s) for s, a in pairs] + [dict(id="o", fulfilment_status="confirmed")])
    schema = "request_id string, order_id string, action string, requested_at timestamp_ntz"
    stream, _ = ledger([dict(request_id=f"{s}-{a}", order_id=f"{s}-{a}", action=a, requested_at=T0) for s, a in pairs],
                       [dict(request_id="1", order_id="o", action="pick", requested_at=T0)],
                       # Judged by time, not by position in the file.
                       [dict(request_id="4", order_id="o", action="ship", requested_at=T0 + timedelta(3)),
                        dict(request_id="2", order_id="o", action="ship", requested_at=T0 + timedelta(1)),
                        dict(request_id="3", order_id="o", action="pack", requested_at=T0 + timedelta(2))],
                       [dict(request_id="5", order_id="o", action="pick", requested_at=T0 + timedelta(4))], schema=schema)
    root = str(tmp_path / "state")
    streams.stream_order_states(stream, t, root, str(tmp_path / "cp")).awaitTermination()
    got = {r.request_id: r for r in spark.read.parquet(f"{root}/moves").collect()}
    for s, a in pairs:
        r = got[f"{s}-{a}"]
        assert (r.accepted, r.to_status) == ((s, a) in legal, legal.get((s, a), s))
    # State is kept from batch to batch.
    assert [(got[i].accepted, got[i].from_status, got[i].to_status) for i in "12345"] == [
        (True, "confirmed", "picking"), (False, "picking", "picking"), (True, "picking", "packing"), (True, "packing", "shipped"),
        (False, "shipped", "shipped")]
    assert got["5"].error_code == "invalid_transition"


def test_late_actions_are_judged_where_they_belong(spark, tables, ledger, tmp_path):
    """Three micro-batches out of order within the delay equal one batch; what comes later still gets a verdict, and is marked."""
    hours = lambda n: T0 + timedelta(hours=n)
    t = tables(orders=[dict(id="a", fulfilment_status="confirmed"), dict(id="b", fulfilment_status="confirmed")])
    schema = "request_id string, order_id string, action string, requested_at timestamp_ntz"
    action = lambda i, o, a, n: dict(request_id=str(i), order_id=o, action=a, requested_at=hours(n))
    stream, path = ledger(
        [action(1, "a", "ship", 5), action(2, "b", "pick", 1), action(9, "nobody", "pick", 1)],
        [action(3, "a", "pack", 3), action(4, "a", "pick", 2), action(5, "b", "ship", 6)],
        [action(6, "a", "pick", 1), action(7, "b", "pack", 4), action(8, "b", "pack", 40)],
        [action(11, "a", "pick", 90)], [action(10, "b", "pack", 2)], schema=schema)
    root = str(tmp_path / "state")
    streams.stream_order_states(stream, t, root, str(tmp_path / "cp"), delay="12 hours").awaitTermination()
    moves = spark.read.parquet(f"{root}/moves")
    got = {r.request_id: (r.accepted, r.to_status, r.late) for r in moves.collect()}
    assert got == {
        "6": (True, "picking", False), "4": (False, "picking", False), "3": (True, "packing", False), "1": (True, "shipped", False),
        "2": (True, "picking", False), "7": (True, "packing", False), "5": (True, "shipped", False), "9": (False, None, False),
        "8": (False, "shipped", False), "10": (False, "shipped", True)}  # 11 waits for the watermark
    batch = advance_orders(t.replace(order_lines=t.order_lines), spark.read.schema(schema).parquet(path).where("request_id NOT IN ('10', '11')"))
    refused = streams.order_rejects(spark, root, moves.schema)
    out = run_append(refused, tmp_path / "rejects")
    assert {r.request_id for r in out.where("NOT late").collect()} == {r.request_id for r in batch.rejects.collect()}
    assert [(r.request_id, r.error_code, r.detail) for r in out.where("late").collect()] == [("10", "invalid_transition", "b")]


def test_changes_are_merged_into_snapshots(spark, ledger, tmp_path):
    files = [[row(10 * n + i, n, product="pqrs"[(n + i) % 4], qty=n + 1) for i in range(2)] for n in range(7)]
    stream, _ = ledger(*files)
    out, keys = str(tmp_path / "out"), ["warehouse_code", "product_id"]
    streams.update_sink(streams.stream_stock_balance(stream), out, str(tmp_path / "cp"), keys=keys, every=3).awaitTermination()
    folders = {f for f in os.listdir(out) if "=" in f}
    assert len([f for f in folders if f.startswith("base=")]) == 1 and len(folders) <= 3
    want = {}
    for r in (r for f in files for r in f):
        want[r["product_id"]] = want.get(r["product_id"], 0) + r["qty_change"]
    assert {r.product_id: r.balance for r in streams.latest(spark, out, keys).collect()} == want
    # A merge that was stopped: no mark, so nobody reads it; then folders that should have gone.
    os.makedirs(f"{out}/base=99")
    spark.range(3).write.parquet(f"{out}/base=99/_temporary/0")
    streams.compact(spark, out, keys)
    (base,) = [f for f in os.listdir(out) if f.startswith("base=") and f != "base=99"]
    spark.createDataFrame([("uk", "p", -1, 1, T0)], "warehouse_code string, product_id string, balance long, movements long, last_at timestamp_ntz").write.parquet(f"{out}/batch=0")
    assert {r.product_id: r.balance for r in streams.latest(spark, out, keys).collect()} == want
    streams.compact(spark, out, keys)
    assert {f for f in os.listdir(out) if "=" in f} == {base, "base=99"}
    assert {r.product_id: r.balance for r in streams.latest(spark, out, keys).collect()} == want


def test_backorders_over_several_batches_equal_one_allocation(spark, tables, ledger, tmp_path):
    """Stock that only arrives: what three micro-batches serve adds up to what one batch job serves at the end."""
    orders = [dict(id=f"o{i}", order_ref=f"R{i}", warehouse_code="uk", created_at=T0 + timedelta(i)) for i in range(12)]
    lines = [dict(id=f"l{i}", order_id=f"o{(i * 5) % 12}", product_id="pq"[i % 2], qty_backordered=i % 4 + 1, fulfilment_status="backordered") for i in range(24)]
    stock = [dict(id=p, product_id=p, warehouse="uk", qty_on_hand=0, qty_reserved=0) for p in "pq"]
    t = tables(orders=orders, order_lines=lines, warehouse_stock=stock)
    files = [[row(1, 0, "stock_received", "p", 7)], [row(2, 1, "stock_received", "q", 4), row(3, 1, "stock_received", "p", 1)], [row(4, 2, "stock_received", "q", 9), row(5, 2, "stock_received", "z", 9)]]
    stream, _ = ledger(*files)
    root = str(tmp_path / "state")
    streams.stream_backorder_allocation(stream, t, root, str(tmp_path / "cp")).awaitTermination()
    got = {r.line_id: r.qty for r in spark.read.parquet(f"{root}/allocations").groupBy("line_id").agg(F.sum("qty").alias("qty")).collect()}
    after = tables(orders=orders, order_lines=lines, warehouse_stock=[{**s, "qty_on_hand": {"p": 8, "q": 13}[s["product_id"]]} for s in stock])
    assert got == {r.line_id: r.qty_fulfilled for r in allocate_backorders(after, T0).accepted.collect()}
    notes = {r.notes for r in read_ledger(spark, f"{root}/ledger").collect()}
    assert all(n.startswith("Auto-fulfilled ") and " backordered units for R" in n for n in notes)


def test_backorders_are_served_as_stock_arrives(spark, tables, ledger, tmp_path):
    t = tables(
        orders=[dict(id="o1", order_ref="R1", warehouse_code="uk", created_at=T0), dict(id="o2", order_ref="R2", warehouse_code="uk", created_at=T0 + timedelta(1))],
        order_lines=[dict(id="l2", order_id="o2", product_id="p", qty_backordered=4, fulfilment_status="backordered"),
                     dict(id="l1", order_id="o1", product_id="p", qty_backordered=5, fulfilment_status="backordered"),
                     dict(id="l3", order_id="o1", product_id="q", qty_backordered=1, fulfilment_status="backordered")],
        warehouse_stock=[dict(id="1", product_id="p", warehouse="uk", qty_on_hand=2, qty_reserved=2), dict(id="2", product_id="q", warehouse="uk", qty_on_hand=9, qty_reserved=0)])
    stream, _ = ledger([row(1, 0, "stock_received", qty=3)], [row(2, 1, "stock_shipped", qty=-1)], [row(3, 2, "stock_received", qty=2), row(4, 2, "stock_received", qty=2)])
    root = str(tmp_path / "state")
    streams.stream_backorder_allocation(stream, t, root, str(tmp_path / "cp")).awaitTermination()
    got = spark.read.parquet(f"{root}/allocations").orderBy("batch", "line_id").collect()
    # 3 arrive; 1 leaves; 4 arrive: 3 free. Nothing arrived for q, so nothing is looked at.
    assert [(r.batch, r.line_id, r.qty) for r in got] == [(0, "l1", 3), (2, "l1", 2), (2, "l2", 1)]
    assert read_ledger(spark, f"{root}/ledger").count() == 3


def test_requests_as_json_files_run_a_job_per_batch(spark, tables, tmp_path):
    """One state version per micro-batch; a repeated micro-batch writes the same version again."""
    t = tables(warehouse_stock=[dict(id="1", product_id="p", warehouse="uk", qty_on_hand=5, qty_reserved=0)], warehouses=[dict(code="uk")])
    root, schema = str(tmp_path / "state"), "request_id string, product_id string, warehouse string, adjustment string, reason string, requested_at timestamp_ntz"
    streams.write_state({"warehouse_stock": t.warehouse_stock, "warehouses": t.warehouses}, root, 0)
    (tmp_path / "in").mkdir()
    line = '{{"request_id": "{}", "product_id": "p", "warehouse": "uk", "adjustment": "{}", "requested_at": "2024-01-0{}T00:00:00"}}\n'
    for n, text in enumerate([line.format("a", -9, 1) + line.format("b", 4, 2), line.format("c", "x", 1) + '{"request_id": \n', line.format("d", 7, 1) + line.format("e", 3_000_000_000, 2)]):
        (tmp_path / "in" / f"{n}.json").write_text(text)
        os.utime(tmp_path / "in" / f"{n}.json", (1000 + n, 1000 + n))

    def run(checkpoint):
        streams.stream_requests(spark, str(tmp_path / "in"), schema, adjust_stock, root, str(tmp_path / checkpoint), max_files=1).awaitTermination()
        stock = [streams.read_state(spark, root, v).warehouse_stock.collect()[0].qty_on_hand for v in range(4)]
        refused = sorted((r.batch, r.request_id or "", r.error_code) for r in spark.read.parquet(f"{root}/rejects").collect())
        return stock, refused, read_ledger(spark, f"{root}/ledger").count(), spark.read.parquet(f"{root}/accepted").count()

    first = run("cp")
    assert first == ([5, 4, 4, 11], [(1, "", "invalid_json"), (2, "e", "out_of_range")], 4, 4)
    assert run("cp-lost") == first  # all micro-batches once more
    assert streams.read_state(spark, root, 3).warehouses.count() == 1
    assert os.listdir(f"{root}/tables/warehouses") == ["0"]


def _state_rows(query):
    query.awaitTermination()
    return max(o["numRowsTotal"] for p in query.recentProgress for o in p["stateOperators"])


def test_order_stages_are_kept_by_shards_of_orders(spark, tables, ledger, tmp_path, monkeypatch):
    """State is a few rows per shard, not per order; several shards and a second start give what one does."""
    t = tables(orders=[dict(id=str(i), fulfilment_status=["confirmed", "picked", None][i % 3]) for i in range(300)])
    schema = "request_id long, order_id string, action string, requested_at timestamp_ntz"
    rows = [dict(request_id=None if i % 50 == 9 else 2**60 + i, order_id=str(i * 7 % 310), action=["ship", "pack", "pick", None][i * 5 % 4],
                 requested_at=T0 + timedelta(minutes=i * 37 % 600)) for i in range(900)]
    now = {str(i): ["confirmed", "picked", None][i % 3] for i in range(300)}
    want = []
    for r in sorted(rows, key=lambda r: (r["requested_at"], r["request_id"] is not None, r["request_id"] or 0)):
        was, leads = now.get(r["order_id"]), {("confirmed", "pick"): "picking", ("picking", "pack"): "packing", ("picked", "pack"): "packing",
                                               ("packing", "ship"): "shipped"}
        now[r["order_id"]] = leads.get((was, r["action"]), was)
        want.append((str(r["request_id"]), r["order_id"], str(was), str(now[r["order_id"]]), (was, r["action"]) in leads))
    stream, _ = ledger(rows[:400], rows[400:], schema=schema)
    for keys in (4096, 40):
        monkeypatch.setattr("stockline.streaming.stateful.SHARD_KEYS", keys)
        root = str(tmp_path / f"state-{keys}")
        assert _state_rows(streams.stream_order_states(stream, t, root, str(tmp_path / f"cp-{keys}"), delay="1 day")) < 60
        # Started again with another number of orders: the shards stay.
        monkeypatch.setattr("stockline.streaming.stateful.SHARD_KEYS", 1)
        end = spark.createDataFrame([(0, "none", "pick", T0 + timedelta(days=9))], schema)
        if keys == 4096:
            end.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        streams.stream_order_states(stream, t, root, str(tmp_path / f"cp-{keys}"), delay="1 day").awaitTermination()
        got = spark.read.parquet(f"{root}/moves").where("NOT late").collect()
        assert sorted((str(r.request_id), r.order_id, str(r.from_status), str(r.to_status), r.accepted) for r in got) == sorted(want)


def test_backorder_queues_are_kept_by_shards_of_stock_rows(spark, tables, ledger, tmp_path, monkeypatch):
    n = 200
    t = tables(orders=[dict(id="o", order_ref="R", warehouse_code="uk", created_at=T0)],
               order_lines=[dict(id=f"l{i}", order_id="o", product_id=f"p{i}", qty_backordered=5, fulfilment_status="backordered") for i in range(n)],
               warehouse_stock=[dict(id=str(i), product_id=f"p{i}", warehouse="uk", qty_on_hand=None if i == 7 else 0, qty_reserved=1) for i in range(n)])
    stream, _ = ledger([row(i, i, "stock_received", f"p{i}", 3) for i in range(n)], [row(n + i, n + i, "stock_received", f"p{i}", i % 3) for i in range(n)])
    for keys in (4096, 30):
        monkeypatch.setattr("stockline.streaming.stateful.SHARD_KEYS", keys)
        root = str(tmp_path / f"state-{keys}")
        assert _state_rows(streams.stream_backorder_allocation(stream, t, root, str(tmp_path / f"cp-{keys}"))) < 10
        got = {(r.batch, r.line_id): r.qty for r in spark.read.parquet(f"{root}/allocations").collect()}
        # Stock of unknown quantity (p7) serves nobody.
        assert got == {(b, f"l{i}"): q for i in range(n) if i != 7 for b, q in ((0, 2), (1, i % 3)) if q}


def test_micro_batches_of_several_files_hold_the_same_rows(spark, make, monkeypatch):
    """The checks' streams write large micro-batches as several files, side by side, and read as many at a time."""
    from checks import live

    rows = make("audit_log", *[row(i, i) for i in range(3000)])
    monkeypatch.setattr(live, "FILE_ROWS", 300)
    stream, sizes = live._in_files(spark, rows, "created_at", "id", 1), []

    def look(batch, _):
        times = sorted(r.created_at for r in batch.collect())
        sizes.append((len(times), batch.select(F.input_file_name()).distinct().count(), times[0], times[-1]))

    stream.writeStream.foreachBatch(look).trigger(availableNow=True).start().awaitTermination()
    assert len(sizes) == 3 and sum(s[0] for s in sizes) == 3000 and {s[1] for s in sizes} == {3}
    assert all(a[2] < b[2] and a[3] < b[3] for a, b in zip(sizes, sizes[1:]))
