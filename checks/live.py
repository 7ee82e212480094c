"""Streaming views run to completion over the whole test tables, as file streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from checks.fixture import BASE, fixture, project
from checks.batch import JOBS, SHARED
from checks.reads import _CATEGORY
from stockline import jobs, streams
from stockline.sources.snapshots import write_json
from stockline.sources.staging import staging_root


def _source(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return streams.read_ledger_stream(spark, sf_dir, BASE[name], pathGlobFilter=f"{name}.parquet")


def _ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project("audit_log", _source(spark, sf_dir, "events"))


FILE_ROWS = 500_000


def _in_files(spark: SparkSession, source: DataFrame, at: str, ident: str, days: int, files: int = 3) -> DataFrame:
    """The same rows as a stream of ``files`` micro-batches, in order but for ``days``: each is of later rows, shaken up that far.

    A micro-batch is one file, or of large tables as many as keep each near ``FILE_ROWS``, the same number in every micro-batch.
    """
    shaken = F.timestamp_add("SECOND", F.pmod(F.xxhash64(ident), F.lit(days * 86_400)), F.col(at))
    seconds = F.timestamp_diff("SECOND", F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'"), shaken)
    bounds, rows = source.agg(F.percentile_approx(seconds, [i / files for i in range(1, files)]), F.count("*")).first()
    number = sum(((seconds > b).cast("int") for b in bounds or []), F.lit(0))
    path = f"{staging_root(spark)}/files-{uuid.uuid4().hex}"
    marked = source.withColumn("_file", number)
    parts = max(1, rows // files // FILE_ROWS)
    if parts > 1:  # dealt out in turn, every part gets rows and so its file, unless a micro-batch is nearly empty
        least = min((r[1] for r in marked.groupBy("_file").count().where("_file IS NOT NULL").collect()), default=0)
        parts = parts if least > 100 * parts and bounds else 1
    for n in range(files):  # one after another, as a file stream goes by the time of writing
        marked.where(F.col("_file") == n).drop("_file").repartition(parts).write.mode("append").parquet(path)
    return spark.readStream.schema(source.schema).option("maxFilesPerTrigger", parts).parquet(path)


def _place(spark: SparkSession) -> tuple[str, str]:
    root = f"{staging_root(spark)}/stream-{uuid.uuid4().hex}"
    return f"{root}/out", f"{root}/checkpoint"


def _updated(stream: DataFrame, keys: list[str]) -> DataFrame:
    out, checkpoint = _place(stream.sparkSession)
    streams.update_sink(stream, out, checkpoint).awaitTermination()
    return streams.latest(stream.sparkSession, out, keys)


def _appended(stream: DataFrame) -> DataFrame:
    spark = stream.sparkSession
    out, checkpoint = _place(spark)
    schema = stream.schema
    streams.append_sink(stream, out, checkpoint).awaitTermination()
    return spark.read.schema(schema).parquet(out)


def balance(spark, d):
    return _updated(streams.stream_stock_balance(_ledger(spark, d)), ["warehouse_code", "product_id"])


def movements(spark, d):
    return _updated(
        streams.stream_movements_by_day(_ledger(spark, d)), ["day", "warehouse_code", "category"]
    )


def burn_rate(spark, d):
    return _appended(streams.stream_burn_rate(_ledger(spark, d)))


def dedup(spark, d):
    twice = _ledger(spark, d).select("*", F.explode(F.array(F.lit(1), F.lit(2))).alias("copy")).drop("copy")
    return _appended(streams.stream_dedup_ledger(twice))


def alerts(spark, d):
    return _appended(streams.stream_low_stock_alerts(_ledger(spark, d), fixture(spark, d)[0]))


def order_states(spark, d):
    actions = project("order_actions", _source(spark, d, "lineitem"))
    out, checkpoint = _place(spark)
    streams.stream_order_states(actions, fixture(spark, d)[0], out, checkpoint).awaitTermination()
    return spark.read.parquet(f"{out}/moves").select("request_id", "order_id", "action", "to_status", "accepted", "error_code")


def late_order_states(spark, d):
    actions = project("order_actions", spark.read.schema(BASE["lineitem"]).parquet(f"{d}/lineitem.parquet"))
    out, checkpoint = _place(spark)
    t = fixture(spark, d)[0]
    streams.stream_order_states(_in_files(spark, actions, "requested_at", "request_id", 30), t, out, checkpoint, delay="60 days").awaitTermination()
    return spark.read.parquet(f"{out}/moves").select("request_id", "order_id", "action", "to_status", "accepted", "error_code", "late")


def compacted_balance(spark, d):
    ledger = project("audit_log", spark.read.schema(BASE["events"]).parquet(f"{d}/events.parquet"))
    out, checkpoint = _place(spark)
    keys = ["warehouse_code", "product_id"]
    stream = streams.stream_stock_balance(_in_files(spark, ledger, "created_at", "id", 1, files=5))
    streams.update_sink(stream, out, checkpoint, keys=keys, every=2).awaitTermination()
    return streams.latest(spark, out, keys)


def backorders_in_steps(spark, d):
    """The ledger's receipts alone, in three micro-batches: stock only grows, so the sum is that of one batch."""
    ledger = project("audit_log", spark.read.schema(BASE["events"]).parquet(f"{d}/events.parquet")).where("action = 'stock_received'")
    out, checkpoint = _place(spark)
    streams.stream_backorder_allocation(_in_files(spark, ledger, "created_at", "id", 1), fixture(spark, d)[0], out, checkpoint).awaitTermination()
    return spark.read.parquet(f"{out}/allocations").groupBy("line_id", "product_id", "warehouse").agg(F.sum("qty").cast("int").alias("qty"))


def backorders(spark, d):
    out, checkpoint = _place(spark)
    streams.stream_backorder_allocation(_ledger(spark, d), fixture(spark, d)[0], out, checkpoint).awaitTermination()
    return spark.read.parquet(f"{out}/allocations").select("line_id", "product_id", "warehouse", "qty")


_ADJUSTMENT = "request_id long, product_id long, warehouse int, adjustment string, reason string, requested_at timestamp_ntz"


def json_requests(spark, d):
    """Adjustments as three JSON files, in order of time, and one broken document: one state version per file."""
    t, requests = fixture(spark, d)
    asked, root = requests["req_adjustments"], f"{staging_root(spark)}/requests-{uuid.uuid4().hex}"
    third = asked.agg(F.percentile_approx(F.timestamp_diff("SECOND", F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'"), "requested_at"), [1 / 3, 2 / 3])).first()[0]
    seconds = F.timestamp_diff("SECOND", F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'"), F.col("requested_at"))
    number = sum(((seconds > b).cast("int") for b in third), F.lit(0))
    for n in range(3):
        write_json(asked.where(number == n).coalesce(1), f"{root}/in/{n}")
    spark.createDataFrame([('{"request_id": 7, ',)], "value string").coalesce(1).write.text(f"{root}/in/3")
    streams.write_state({"warehouse_stock": t.warehouse_stock}, f"{root}/state", 0)
    streams.stream_requests(spark, f"{root}/in/*", _ADJUSTMENT, jobs.adjust_stock, f"{root}/state", f"{root}/checkpoint", max_files=1).awaitTermination()
    return root


def requests_accepted(spark, d):
    return spark.read.parquet(f"{json_requests(spark, d)}/state/accepted").select("request_id", "product_id", "warehouse", "qty_change", "balance_after")


def requests_rejected(spark, d):
    return spark.read.parquet(f"{json_requests(spark, d)}/state/rejects").select("request_id", "error_code")


def requests_state(spark, d):
    return streams.read_state(spark, f"{json_requests(spark, d)}/state", 4).warehouse_stock.select("product_id", "warehouse", "qty_on_hand")


# A window is emitted once the watermark has passed its end.
_PASSED = "(SELECT MAX(created_at) FROM wms_audit_log WHERE action = 'stock_shipped') - INTERVAL '1' DAY"

STREAMS = {
    "stream_stock_balance": (balance, """
        SELECT warehouse_code, product_id, CAST(SUM(qty_change) AS BIGINT) AS balance, COUNT(*) AS movements,
          MAX(created_at) AS last_at FROM wms_audit_log GROUP BY ALL"""),
    "stream_movements_by_day": (movements, f"""
        SELECT CAST(created_at AS DATE) AS day, warehouse_code, {_CATEGORY} AS category, COUNT(*) AS entries,
          CAST(COALESCE(SUM(qty_change), 0) AS BIGINT) AS net_qty FROM wms_audit_log GROUP BY ALL"""),
    "stream_burn_rate": (burn_rate, f"""
        WITH d AS (SELECT DATE_TRUNC('day', created_at) AS day, warehouse_code, product_id, -SUM(qty_change) AS n
          FROM wms_audit_log WHERE action = 'stock_shipped' GROUP BY ALL HAVING DATE_TRUNC('day', created_at)
          + INTERVAL '1' DAY <= {_PASSED}),
        w AS (SELECT day - INTERVAL '1' DAY * k AS from_at, warehouse_code, product_id, n FROM d, RANGE(0, 30) r(k))
        SELECT from_at, from_at + INTERVAL '30' DAY AS to_at, warehouse_code, product_id, CAST(SUM(n) AS BIGINT) AS units,
          CAST(((2 * SUM(n) * 10000 + 30) // 60) * 0.0001 AS DECIMAL(18,4)) AS daily_rate
        FROM w WHERE from_at + INTERVAL '30' DAY <= {_PASSED} GROUP BY ALL"""),
    "stream_dedup_ledger": (dedup, "SELECT * FROM wms_audit_log"),
    # One row per minute and stock row; a crossing is a change of "at or below the reorder point".
    "stream_low_stock_alerts": (alerts, """
        WITH m AS (SELECT DATE_TRUNC('minute', created_at) + INTERVAL '1' MINUTE AS ends, warehouse_code, product_id,
            SUM(qty_change) AS change FROM wms_audit_log GROUP BY ALL),
        b AS (SELECT m.*, ws.reorder_point, ws.qty_on_hand, CAST(ws.qty_on_hand + SUM(m.change) OVER (PARTITION BY
            m.warehouse_code, m.product_id ORDER BY ends) AS BIGINT) AS balance FROM m JOIN wms_warehouse_stock ws
            ON ws.product_id = m.product_id AND ws.warehouse = m.warehouse_code
            WHERE ends <= (SELECT MAX(created_at) FROM wms_audit_log) - INTERVAL '10' MINUTE),
        x AS (SELECT *, balance <= reorder_point AS low, COALESCE(LAG(balance) OVER (PARTITION BY warehouse_code, product_id
            ORDER BY ends), qty_on_hand) <= reorder_point AS was FROM b)
        SELECT CAST(warehouse_code AS VARCHAR) AS warehouse_code, CAST(product_id AS VARCHAR) AS product_id,
          ends - INTERVAL '1' MICROSECOND AS at, balance, reorder_point, CASE WHEN NOT low THEN 'recovered'
          WHEN balance <= 0 THEN 'out_of_stock' ELSE 'low_stock' END AS alert_type FROM x WHERE low <> was"""),
    "stream_order_states": (order_states, """
        SELECT a.request_id, a.order_id, a.action, a.k = i.k OR a.k = p.k OR a.k = s.k AS accepted, CASE WHEN s.k <= a.k
          THEN 'shipped' WHEN p.k <= a.k THEN 'packing' WHEN i.k <= a.k THEN 'picking' ELSE a.was END AS to_status,
          CASE WHEN NOT (a.k = i.k OR a.k = p.k OR a.k = s.k) THEN 'invalid_transition' END AS error_code
        FROM (SELECT * FROM req_adv) a
        LEFT JOIN req_pick i0 ON i0.order_id = a.order_id LEFT JOIN req_pack p0 ON p0.order_id = a.order_id
        LEFT JOIN req_ship s0 ON s0.order_id = a.order_id,
        LATERAL (SELECT COALESCE(i0.k, (TIMESTAMP '9999-01-01', '')) AS k) i,
        LATERAL (SELECT COALESCE(p0.k, (TIMESTAMP '9999-01-01', '')) AS k) p,
        LATERAL (SELECT COALESCE(s0.k, (TIMESTAMP '9999-01-01', '')) AS k) s"""),
    # Out of order within the delay, in three micro-batches; actions behind the last watermark still wait.
    "stream_order_states_late": (late_order_states, """
        SELECT a.request_id, a.order_id, a.action, a.k = i.k OR a.k = p.k OR a.k = s.k AS accepted, CASE WHEN s.k <= a.k
          THEN 'shipped' WHEN p.k <= a.k THEN 'packing' WHEN i.k <= a.k THEN 'picking' ELSE a.was END AS to_status,
          CASE WHEN NOT (a.k = i.k OR a.k = p.k OR a.k = s.k) THEN 'invalid_transition' END AS error_code, FALSE AS late
        FROM (SELECT * FROM req_adv) a
        LEFT JOIN req_pick i0 ON i0.order_id = a.order_id LEFT JOIN req_pack p0 ON p0.order_id = a.order_id
        LEFT JOIN req_ship s0 ON s0.order_id = a.order_id,
        LATERAL (SELECT COALESCE(i0.k, (TIMESTAMP '9999-01-01', '')) AS k) i,
        LATERAL (SELECT COALESCE(p0.k, (TIMESTAMP '9999-01-01', '')) AS k) p,
        LATERAL (SELECT COALESCE(s0.k, (TIMESTAMP '9999-01-01', '')) AS k) s
        WHERE a.requested_at <= (SELECT MAX(requested_at) FROM req_order_actions) - INTERVAL '60' DAY"""),
    # The whole ledger is one micro-batch here: stock after all movements serves the pairs that received.
    "stream_backorder_allocation": (backorders, """
        WITH m AS (SELECT product_id, warehouse_code AS warehouse, SUM(qty_change) AS change FROM wms_audit_log GROUP BY ALL
            HAVING BOOL_OR(action = 'stock_received')),
        s AS (SELECT m.product_id, m.warehouse, ws.qty_on_hand + m.change - ws.qty_reserved AS avail FROM m
            JOIN wms_warehouse_stock ws ON ws.product_id = m.product_id AND ws.warehouse = m.warehouse),
        a AS (SELECT l.id AS line_id, l.product_id, o.warehouse_code AS warehouse, CAST(GREATEST(0, LEAST(l.qty_backordered,
            s.avail - COALESCE(SUM(l.qty_backordered) OVER (PARTITION BY l.product_id, o.warehouse_code ORDER BY o.created_at,
            l.order_id, l.id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS INT) AS qty
          FROM wms_order_lines l JOIN wms_orders o ON o.id = l.order_id JOIN s ON s.product_id = l.product_id
            AND s.warehouse = o.warehouse_code WHERE l.fulfilment_status IN ('backordered', 'partial')
            AND l.qty_backordered > 0 AND s.avail > 0)
        SELECT * FROM a WHERE qty > 0"""),
    "stream_backorder_steps": (backorders_in_steps, """
        WITH m AS (SELECT product_id, warehouse_code AS warehouse, SUM(qty_change) AS change FROM wms_audit_log WHERE action = 'stock_received' GROUP BY ALL),
        s AS (SELECT m.product_id, m.warehouse, ws.qty_on_hand + m.change - ws.qty_reserved AS avail FROM m
            JOIN wms_warehouse_stock ws ON ws.product_id = m.product_id AND ws.warehouse = m.warehouse),
        a AS (SELECT l.id AS line_id, l.product_id, o.warehouse_code AS warehouse, CAST(GREATEST(0, LEAST(l.qty_backordered,
            s.avail - COALESCE(SUM(l.qty_backordered) OVER (PARTITION BY l.product_id, o.warehouse_code ORDER BY o.created_at,
            l.order_id, l.id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS INT) AS qty
          FROM wms_order_lines l JOIN wms_orders o ON o.id = l.order_id JOIN s ON s.product_id = l.product_id
            AND s.warehouse = o.warehouse_code WHERE l.fulfilment_status IN ('backordered', 'partial')
            AND l.qty_backordered > 0 AND s.avail > 0)
        SELECT * FROM a WHERE qty > 0"""),
    "stream_stock_balance_compacted": (compacted_balance, """
        SELECT warehouse_code, product_id, CAST(SUM(qty_change) AS BIGINT) AS balance, COUNT(*) AS movements,
          MAX(created_at) AS last_at FROM wms_audit_log GROUP BY ALL"""),
    "json_requests": (requests_accepted, JOBS["adjust_stock"][1]),
    "json_requests_rejects": (requests_rejected, JOBS["adjust_stock_rejects"][1] + " UNION ALL SELECT NULL, 'invalid_json'"),
    "json_requests_state": (requests_state, """
        SELECT ws.product_id, ws.warehouse, COALESCE(x.after, ws.qty_on_hand) AS qty_on_hand FROM wms_warehouse_stock ws
        LEFT JOIN (SELECT product_id, warehouse, MAX_BY(after, i) AS after FROM req_adj WHERE i > 1 GROUP BY ALL) x
          ON x.product_id = ws.product_id AND x.warehouse = ws.warehouse"""),
}
