from datetime import datetime, timedelta
import random

import pytest

from stockline.jobs.common import LEDGER
from stockline import analytics, jobs
from stockline.sources import buckets, layout, snapshots
from stockline.sources.staging import stage, staging_root
from stockline.tables import SCHEMAS, Tables


def test_snapshot_round_trip_and_no_overwrite(spark, tables, tmp_path):
    t = tables(warehouses=[dict(code="uk", name="U", currency="GBP")], orders=[dict(id="o", created_at=datetime(2024, 1, 1, 5))])
    root = str(tmp_path)
    snapshots.write_snapshot({n: t[n] for n in ("warehouses", "orders")}, root, 1)
    back = snapshots.read_snapshot(spark, root, 1, ["warehouses", "orders"])
    assert back.orders.schema == t.orders.schema and back.orders.collect() == t.orders.collect()
    with pytest.raises(Exception):
        snapshots.write_snapshot({"orders": t.orders}, root, 1)


def test_ledger_batches_replace_themselves(spark, make, tmp_path):
    path = str(tmp_path / "ledger")
    rows = [dict(created_at=datetime(2024, 1, d), action="a", warehouse_code=w, qty_change=d) for d in (1, 2) for w in ("uk", "us")]
    for batch in ("one", "two", "one"):
        snapshots.append_ledger(make(LEDGER, *rows), path, batch)
    back = snapshots.read_ledger(spark, path)
    assert back.count() == 8
    plan = back.where("ledger_date = DATE'2024-01-01' AND warehouse_code = 'uk'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(ledger_date" in plan
    assert back.where("ledger_date = DATE'2024-01-01' AND warehouse_code = 'uk'").count() == 2


def test_requests_with_bad_json_are_rejected(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"request_id": "a", "qty": "3", "lines": [{"p": "x"}]}\n{"request_id": "b", \n{"request_id": "c", "qty": null}\n')
    good, bad = snapshots.read_requests(spark, str(tmp_path), "request_id string, qty string, lines array<struct<p: string>>")
    assert sorted(r.request_id for r in good.collect()) == ["a", "c"]
    assert [r.error_code for r in bad.collect()] == ["invalid_json"]


def test_json_sink(spark, make, tmp_path):
    snapshots.write_json(make("warehouses", dict(code="uk")), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).collect()[0].code == "uk"


def test_staging_uses_the_configured_folder(spark, make):
    root = staging_root(spark)
    assert root.startswith(spark.conf.get("spark.checkpoint.dir"))
    staged = stage(make("warehouses", dict(code="uk")), "t")
    assert staged.inputFiles()[0].startswith(f"file://{root}") and staged.collect()[0].code == "uk"


def test_staging_drops_what_it_shuffled(spark):
    import time

    import pyarrow.parquet as pq

    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    # The driver's garbage collection may remove files of earlier tests meanwhile, but adds none.
    def held():
        files = manager.getAllFiles()
        return {n for n in (files.apply(i).getName() for i in range(files.size())) if n.startswith("shuffle_")}

    before, setting = held(), spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    staged = stage(spark.range(1000).repartition(3, "id"), "shuffled")
    for _ in range(50):
        if not held() - before:
            break
        time.sleep(0.1)
    assert not held() - before
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == setting
    assert sorted(r.id for r in staged.collect()) == list(range(1000))
    assert {pq.ParquetFile(f.removeprefix("file://")).metadata.row_group(0).column(0).compression for f in staged.inputFiles()} == {"ZSTD"}


def test_tables_are_built_on_use():
    calls = []
    t = Tables({"orders": lambda: calls.append(1)})
    assert calls == [] and len(t) == 1
    with pytest.raises(AttributeError):
        t.nothing


def _files(df):
    return {path.split(f"{buckets.BUCKET}=")[1].split("/")[0] for path in df.inputFiles()}


def test_an_upsert_reads_and_writes_only_its_buckets(spark, tmp_path):
    table = buckets.Bucketed(str(tmp_path / "t"), "k long, w string, v int", ("k", "w"), 16)
    rows = {(i, w): i for i in range(60) for w in ("uk", None)}
    buckets.create(table, spark.createDataFrame([(k, w, v) for (k, w), v in rows.items()], table.schema))
    assert len(buckets.manifest(spark, table, 0)) == 16
    one = spark.createDataFrame([(7, "uk", -7, False)], "k int, w string, v int, gone boolean")
    named = buckets.touched(table, one)
    assert len(named) == 1 and _files(buckets.read(spark, table, 0, named)) == {str(named[0])}
    buckets.upsert(table, one, 0, "gone")
    rows[7, "uk"] = -7
    assert {b for b, v in buckets.manifest(spark, table, 1).items() if v == 1} == set(named)
    rng, version = random.Random(2), 1
    for _ in range(3):
        changes = {(rng.randrange(90), rng.choice(["uk", None])): (rng.randrange(1000), rng.random() < 0.3) for _ in range(25)}
        buckets.upsert(table, spark.createDataFrame([(k, w, v, gone) for (k, w), (v, gone) in changes.items()], "k long, w string, v int, gone boolean"), version, "gone")
        version += 1
        for key, (v, gone) in changes.items():
            rows.pop(key, None)
            if not gone:
                rows[key] = v
        assert {(r.k, r.w): r.v for r in buckets.read(spark, table, version).collect()} == rows
    everything = spark.createDataFrame([(k, w, 0, True) for k, w in rows], "k long, w string, v int, gone boolean")
    buckets.upsert(table, everything, version, "gone")
    assert buckets.read(spark, table, version + 1).count() == 0 and buckets.read(spark, table, version).count() == len(rows)


def test_an_upsert_that_was_stopped_changes_nothing(spark, tmp_path):
    table = buckets.Bucketed(str(tmp_path / "t"), "k long, v int", ("k",), 4)
    buckets.create(table, spark.createDataFrame([(i, i) for i in range(20)], table.schema))
    change = spark.createDataFrame([(3, 33)], table.schema)
    change.withColumn(buckets.BUCKET, table.bucket()).write.partitionBy(buckets.BUCKET).parquet(f"{table.root}/rows/1")  # no manifest follows
    assert sorted(r.v for r in buckets.read(spark, table, 0).collect()) == list(range(20))
    for _ in range(2):  # a repeated run replaces what it wrote
        buckets.upsert(table, change, 0)
        assert {r.k: r.v for r in buckets.read(spark, table, 1).collect()} == {**{i: i for i in range(20)}, 3: 33}


def test_a_job_on_its_buckets_equals_one_on_the_whole_table(spark, tables, make, tmp_path):
    stock = [dict(id=f"s{i}", product_id=f"p{i}", warehouse=w, qty_on_hand=i, qty_reserved=0) for i in range(40) for w in ("uk", "us")]
    t = tables(warehouse_stock=stock)
    requests = make("request_id string, product_id string, warehouse string, adjustment string, reason string, requested_at timestamp_ntz", *[
        dict(request_id=f"r{i}", product_id=f"p{i % 3}", warehouse="uk", adjustment=str(5 - 2 * i), requested_at=datetime(2024, 1, 1 + i)) for i in range(6)],
        dict(request_id="x", product_id="unknown", warehouse="uk", adjustment="1", requested_at=datetime(2024, 1, 1)))
    table = buckets.Bucketed(str(tmp_path / "stock"), SCHEMAS["warehouse_stock"], ("product_id", "warehouse"), 32)
    buckets.create(table, t.warehouse_stock)
    part = buckets.run_on_buckets(table, "warehouse_stock", jobs.adjust_stock, t, requests, 0)
    whole = jobs.adjust_stock(t, requests)
    after = buckets.read(spark, table, 1)
    assert sorted(map(str, after.collect())) == sorted(map(str, whole.state["warehouse_stock"].collect()))
    assert sorted(part.accepted.collect()) == sorted(whole.accepted.collect()) and part.rejects.collect() == whole.rejects.collect()
    assert len([b for b, v in buckets.manifest(spark, table, 1).items() if v == 1]) <= 4


def test_headers_and_lines_laid_out_together_join_without_a_shuffle(spark, tmp_path):
    headers = spark.range(500).selectExpr("id", "id % 7 AS customer_id")
    lines = spark.range(3000).selectExpr("id AS line_id", "id % 600 AS order_id", "CAST(id % 5 AS INT) AS qty")
    h, n = layout.write_together(headers, lines, str(tmp_path), f"t{tmp_path.name.replace('-', '_')}", buckets=6)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        def per_order(h, n):
            totals = n.groupBy("order_id").sum("qty")
            return h.join(n, h.id == n.order_id, "left").join(totals, "order_id").groupBy("id").count()

        assert "Exchange" in per_order(headers, lines)._jdf.queryExecution().executedPlan().toString()
        plan = per_order(h, n)._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        assert sorted(per_order(h, n).collect()) == sorted(per_order(headers, lines).collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_newest_search_reads_no_more_files_as_the_ledger_ages(spark, make, tables, tmp_path):
    def ledger(days, path):
        rows = [dict(id=f"{d:03}-{i}", created_at=datetime(2024, 6, 30, i) - timedelta(days=d), action="rare" if d == days - 2 else "a",
                     warehouse_code="uk" if i else "us", product_id="p") for d in range(days) for i in range(3)]
        rows.append(dict(id="x", created_at=None, action="timeless", warehouse_code="uk"))
        frame = make("audit_log", *rows)
        snapshots.append_ledger(frame, path, "1")
        return frame, snapshots.read_ledger(spark, path)

    def files(frame):
        return frame.select("_metadata.file_path").distinct().count()

    reads = []
    for days in (4, 12):
        frame, folder = ledger(days, str(tmp_path / f"of-{days}"))
        reads.append((files(snapshots.newest_days(folder, 3)), files(folder)))
        t = tables().replace(audit_log=frame)
        for asked in (dict(limit=4), dict(warehouse="us", limit=2), dict(action="rare"), dict(action="timeless", limit=1), dict(action="none")):
            want = [tuple(r) for r in analytics.audit_search(t, **asked).collect()]
            assert [tuple(r) for r in analytics.audit_search_newest(t, folder, **asked).collect()] == want
    assert reads[0][0] == reads[1][0] == 2 and reads[0][1] < reads[1][1]
